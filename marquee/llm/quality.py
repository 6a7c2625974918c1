"""Quality rules by distribution divergence.

Every language has two references, counted over all documents of the corpus
in that language: a histogram of character classes and one of common words
(a list per language, everything else in one bin). A document is compared
with the references of its language, and with the others if it is far from
those, by Jensen-Shannon distance (square root of the divergence in bits). A
finite sample strays from its own source by about (bins - 1) / (8 n ln 2)
bits; twice that is allowed on top of the limit, and documents below a minimum
length are not judged by divergence at all.

Three passes over the texts: two whose sums are the references (a few hundred
numbers, bounded by the lists; the second counts only documents near the
first, so that much junk doesn't become the norm), and one that measures every
document. Only the references' counts are shuffled.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from marquee.llm.bpe import chunks, raw_texts
from marquee.llm.common import pick, unused

#: Function words per language: a parameter, extend it for other languages.
COMMON_WORDS = {
    "en": "the of and to in is that for it as was with be by on not he are this at from or have an they which one you had were all her she there would their we him been has when who will more no if out so up said what its about than into them can only other new some could time these two may then do first any my now such like our over even most after also".split(),
    "fr": "de la le et les des en un une du que est dans qui par pour au il sur ne se pas plus ce avec sont aux ou son sa mais on nous comme ses vous elle leur y dont être fait été ont cette".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también fue había era muy años hasta desde está".split(),
}
#: Digits are counted with the marks of prose: a number or key in a short text
#: is no divergence, a text of numbers still is.
CLASSES = ("lower", "upper", "space", "line end", "stop or digit", "other mark", "symbol", "accented", "other letter")

#: Limits of the distances, and the lengths from which they are applied.
MAX_CLASS_DISTANCE, MIN_CHARS = 0.17, 300
MAX_WORD_DISTANCE, MIN_WORDS = 0.32, 50


def _class_table() -> np.ndarray:
    """Class of a UTF-8 byte; continuation bytes have none (the last)."""
    table = np.full(256, CLASSES.index("other mark"))
    table[0x00:0x20] = CLASSES.index("space")
    for chars, name in (
        (range(0x61, 0x7B), "lower"), (range(0x41, 0x5B), "upper"), (range(0x30, 0x3A), "stop or digit"),
        (b" \t\r\x0b\x0c", "space"), (b"\n", "line end"), (b".,;:!?'\"-()", "stop or digit"), (b"#*$%&|<>=+~^_\\/@{}[]`", "symbol"),
        (range(0xC3, 0xCA), "accented"), (range(0xCA, 0x100), "other letter"), (range(0x80, 0xC0), None),
    ):
        for c in chars:
            table[c] = len(CLASSES) if name is None else CLASSES.index(name)
    return table


_TABLE = _class_table()


def class_counts(raw: bytes) -> np.ndarray:
    return np.bincount(_TABLE[np.frombuffer(raw, np.uint8)], minlength=len(CLASSES) + 1)[: len(CLASSES)]


def forms_of(common: dict[str, list[str]]) -> dict[str, tuple[dict[bytes, int], int]]:
    """Per language the written forms of its listed words, with the word's
    bin, and the number of bins: as listed, capitalized or in capitals, with
    one mark behind or none."""
    out = {}
    for language, words in common.items():
        forms = {}
        for i, w in enumerate(dict.fromkeys(words)):
            for case in (w, w.capitalize(), w.upper()):
                for mark in ("", ".", ",", ";", ":", "!", "?"):
                    forms.setdefault((case + mark).encode(), i)
        out[language] = forms, len(dict.fromkeys(words)) + 1
    return out


def word_counts(words: list[bytes], forms: dict[bytes, int], bins: int) -> np.ndarray:
    """Counts of the listed words and in the last bin of all others."""
    found = Counter(map(forms.get, words))
    out = np.zeros(bins, np.int64)
    out[-1] = found.pop(None, 0)
    for i, n in found.items():
        out[i] += n
    return out


def distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance of two histograms; 1 if one is empty."""
    if not p.sum() or not q.sum():
        return 1.0
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        parts = np.where(p > 0, p * np.log2(p / m), 0) + np.where(q > 0, q * np.log2(q / m), 0)
    return float(np.sqrt(max(0.0, parts.sum() / 2)))


def allowance(bins: int, n: int) -> float:
    """Twice the bits that a sample of n strays from its source on average."""
    return 2 * (bins - 1) / (8 * n * math.log(2))


def repeated_words(words: list[bytes]) -> int:
    """Words inside a 3-word window that occurs twice or more."""
    if len(words) < 4:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    with np.errstate(over="ignore"):
        keys = (h[:-2] * np.uint64(0x9E3779B97F4A7C15) + h[1:-1]) * np.uint64(0xC2B2AE3D27D4EB4F) + h[2:]
    order = np.argsort(keys)
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    maybe = np.zeros(len(keys), bool)  # equal keys; equal windows are among them
    maybe[order[1:][same]] = maybe[order[:-1][same]] = True
    at = np.flatnonzero(maybe).tolist()
    windows = [(words[i], words[i + 1], words[i + 2]) for i in at]
    seen = Counter(windows)
    covered, total = 0, 0  # words before ``covered`` are counted already
    for i, w in zip(at, windows):
        if seen[w] > 1:
            total += i + 3 - max(i, covered)
            covered = i + 3
    return total


def base_counts(raw: bytes, words: list[bytes]) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    lines = [line for line in raw.split(b"\n") if line.strip(b" \t\r\x0b\x0c")]
    symbols = len(raw) - len(raw.translate(None, b"#*$%&|<>"))
    return len(words), len(b"".join(words).decode()), symbols, len(lines) - len(set(lines)), repeated_words(words)


def fails_base(n_words: int, n_repeat_words: int) -> bool:
    return n_words < 50 or 100 * n_repeat_words > 50 * n_words


def distances(raw: bytes, words: list[bytes], language: str | None, references: dict, forms: dict) -> tuple[float | None, float | None, bool]:
    """Distances in character classes and common words (null below the
    minimum lengths) to the document's language, or to the nearest other if
    it names none or isn't near it, and whether both are within the limits.
    A document of a language without a reference is compared with none."""
    if language is not None and language not in references:
        return None, None, True
    classes = class_counts(raw)
    n = int(classes.sum())
    best: tuple = (None, None, True)
    for x in sorted(references, key=lambda r: r != language):
        d_class = distance(classes, references[x]["class"]) if n >= MIN_CHARS else None
        d_word = distance(word_counts(words, *forms[x]), references[x]["word"]) if len(words) >= MIN_WORDS else None
        near = (d_class is None or d_class**2 <= MAX_CLASS_DISTANCE**2 + allowance(len(CLASSES), n)) and (
            d_word is None or d_word**2 <= MAX_WORD_DISTANCE**2 + allowance(forms[x][1], len(words))
        )
        if near:
            return d_class, d_word, True
        if best[2] or (d_class or 0) + (d_word or 0) < (best[0] or 0) + (best[1] or 0):
            best = (d_class, d_word, False)
    return best


def language_references(df: DataFrame, common: dict[str, list[str]], first: dict | None = None) -> dict[str, dict[str, np.ndarray]]:
    """Both histograms of every listed language over its documents that pass
    the base rule, or, with ``first`` references, over those of them within the
    limits of these, so that much junk in the corpus doesn't become the norm.

    ``df``: (lang, text). At most (classes + listed words + 1) sums for each
    listed language come to the driver, whatever the corpus.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forms = forms_of(common)
        sums: dict[tuple[str, str], np.ndarray] = {}
        for batch in batches:
            for language, raw in zip(batch.column(0).to_pylist(), raw_texts(batch.column(1))):
                if language not in forms:
                    continue
                words = raw.split()
                if fails_base(len(words), repeated_words(words)):
                    continue
                if first and not distances(raw, words, language, first, forms)[2]:
                    continue
                for kind, counts in (("class", class_counts(raw)), ("word", word_counts(words, *forms[language]))):
                    sums[language, kind] = sums.get((language, kind), 0) + counts
        rows = [{"lang": x, "kind": kind, "bin": i, "n": int(n)} for (x, kind), counts in sums.items() for i, n in enumerate(counts)]
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("lang", pa.string()), ("kind", pa.string()), ("bin", pa.int32()), ("n", pa.int64())]))

    summed = df.mapInArrow(work, "lang string, kind string, bin int, n bigint").groupBy("lang", "kind", "bin").agg(F.sum("n").alias("n"))
    found: dict[str, dict[str, list[int]]] = {}
    for r in summed.orderBy("lang", "kind", "bin").collect():
        found.setdefault(r["lang"], {}).setdefault(r["kind"], []).append(r["n"])
    return {x: {kind: np.array(n) for kind, n in kinds.items()} for x, kinds in found.items()}


def judge(raw: bytes, language: str | None, references: dict, forms: dict) -> dict:
    """Base counts, distances and verdict of one document."""
    words = raw.split()
    n_words, chars, symbols, dup_lines, repeated = base_counts(raw, words)
    failed = fails_base(n_words, repeated)
    d_class, d_word, near = distances(raw, words, language, references, forms)
    return {
        "n_words": n_words, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup_lines, "n_repeat_words": repeated,
        "base_failed": failed, "kept": not failed and near, "class_distance": d_class, "word_distance": d_word,
    }


_FIELDS = [
    *((n, "bigint", pa.int64()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
    ("base_failed", "boolean", pa.bool_()), ("kept", "boolean", pa.bool_()),
    ("class_distance", "double", pa.float64()), ("word_distance", "double", pa.float64()),
]


def judge_documents(df: DataFrame, text: str = "text", lang: str = "lang", common: dict[str, list[str]] = COMMON_WORDS, into: str = "quality") -> DataFrame:
    """Add struct ``into``: base counts, ``base_failed``, the two distances
    (null below the minimum lengths) and the verdict ``kept``.

    Null text counts as empty (fails the base rule); a null language is
    compared with the nearest reference; where the language has no reference
    (it is not listed, or none of its documents passes the base rule) only the
    base rule judges. Repeated rows are judged alike; all other columns stay.
    """
    slim = pick(df, lang, text).toDF("lang", "text")
    references = language_references(slim, common, language_references(slim, common))
    place, language_place = df.columns.index(text), df.columns.index(lang)
    name = unused(df, into) if into in df.columns else into
    kinds = ", ".join(f"{n} {t}" for n, t, _ in _FIELDS)
    schema = StructType([*df.schema.fields, StructField(name, StructType.fromDDL(kinds))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forms = forms_of(common)
        for batch in batches:
            for part in chunks(batch, place):
                rows = [judge(raw, x, references, forms) for raw, x in zip(raw_texts(part.column(place)), part.column(language_place).to_pylist())]
                verdicts = pa.array(rows, pa.struct([(n, t) for n, _, t in _FIELDS]))
                yield pa.RecordBatch.from_arrays([*part.columns, verdicts], [*part.schema.names, name])

    return df.mapInArrow(work, schema)
