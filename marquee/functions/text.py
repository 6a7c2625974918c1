"""Tokenisation, stop words and trigram helpers (JVM-side expressions)."""

from __future__ import annotations

import functools
from importlib import resources

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word tokens: maximal runs of (Unicode) word characters, at least 2 long.
_NON_WORD = r"(?U)\W+"


@functools.lru_cache(maxsize=None)
def default_stop_words(language: str = "english") -> tuple[str, ...]:
    """The stop-word list shipped as ``data/stop_words_<language>.txt``.

    A text file of the package (Spark's public English list, one word per
    line), so neither a JVM nor a particular PySpark installation is needed.
    """
    listed = resources.files("marquee.functions").joinpath(f"data/stop_words_{language}.txt")
    return tuple(listed.read_text(encoding="utf-8").split())


def word_tokens(text: Column) -> Column:
    """Lower-cased word tokens of length >= 2 (regex ``\\b\\w\\w+\\b``)."""
    parts = F.split(F.lower(text), _NON_WORD, -1)
    return F.filter(parts, lambda t: F.length(t) >= 2)


def without_stop_words(tokens: Column, stop_words: tuple[str, ...] | list[str]) -> Column:
    if not stop_words:
        return tokens
    sw = F.array(*[F.lit(w) for w in stop_words])
    return F.filter(tokens, lambda t: ~F.array_contains(sw, t))


def trigrams(text: Column) -> Column:
    """Distinct character trigrams of each word, padded like pg_trgm.

    Words are runs of alphanumerics, lower-cased; each word gets two leading
    spaces and one trailing space before slicing.
    """
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+", -1), lambda w: F.length(w) > 0)
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    grams = F.transform(
        padded,
        lambda p: F.transform(F.sequence(F.lit(1), F.length(p) - 2), lambda i: F.substring(p, i, 3)),
    )
    return F.array_distinct(F.flatten(grams))
