"""Secret scan: signatures plus a battery of randomness tests.

Signatures (``assign``, ``access``, ``hex``) find keys by their surroundings
or prefix. Every other run of 20 or more key characters is a candidate: its
encoding is inferred (hexadecimal, also in groups with dashes, base32, base64,
base64url, or else the smallest alphabet of digits, lower case, upper case and
pairs of marks that holds all its characters), its characters become symbol
numbers of that alphabet, and tests ask whether they look like independent
uniform symbols:

* chi-squared uniformity over the alphabet (Wilson-Hilferty normal score),
* runs above and below the middle of the alphabet (Wald-Wolfowitz),
* serial correlation of neighbouring symbols,
* frequent letter pairs of written language among neighbours (one-sided; not
  for alphabets without most letters).

The p-values combine by Bonferroni. Over the candidates of a
document the Benjamini-Hochberg step-up, with p-values weighted by length
(longer candidates give the tests more power), decides which ones are
structured, at most ``fdr`` of those decisions being expected to dismiss a
truly random string. What is not dismissed is reported as ``random``.

One projection per row, no shuffle.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.llm.common import let, running, slices_of, spans, text_or_empty, unused

KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"  # a run is taken whole, so this is a run of 24 or more
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"
MIN_VALUE, MIN_ACCESS, MIN_HEX, MIN_RANDOM = 6, 20, 24, 20

#: name, what a candidate of it consists of, what it must contain, alphabet.
ENCODINGS = (
    ("hex", r"^(?:[0-9a-f]+|[0-9A-F]+)$", (r"[0-9]", r"[A-Fa-f]"), "0123456789abcdef"),
    ("hex groups", r"^(?:[0-9a-f-]+|[0-9A-F-]+)$", (r"[0-9]", r"[A-Fa-f]", "-"), "0123456789abcdef-"),
    ("base32", r"^[A-Z2-7]+$", (r"[2-7]", r"[A-Z]"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base64", r"^[A-Za-z0-9+/]+$", (r"[0-9]", r"[A-Z]", r"[a-z]"), "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", r"^[A-Za-z0-9_-]+$", (r"[0-9]", r"[A-Z]", r"[a-z]"), "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
    ("lower base32", r"^[a-z2-7]+$", (r"[2-7]", r"[a-z]"), "abcdefghijklmnopqrstuvwxyz234567"),
)
#: What any other candidate's alphabet is made of: what occurs in it, in this order.
PARTS = (
    (r"[A-Z]", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (r"[a-z]", "abcdefghijklmnopqrstuvwxyz"), (r"[0-9]", "0123456789"),
    (r"[+/]", "+/"), (r"[_-]", "-_"),
)
#: Frequent pairs of letters in English, French, German and Spanish: a parameter.
PAIRS = (
    "ab ac ad ai al am an ar as at au be bl bu by ca ce ch ci ck cl co ct da de di do ea ec ed ee ef ei el em en ep er es et "
    "eu ex fi fo fr ge ha he hi ho hr ht ic ie if ig il im in io is it iv ke la le li ll lo ly ma me mo mp na nc nd ne ng ni "
    "no ns nt oc od of om on op or os ot ou ow pa pe pl po pr pt qu ra re ri rn ro rr rs rt sc se si so ss st su ta te th ti "
    "to tr ts tu ty ue ul um un up ur us ut va ve we wh wi"
).split()
MIN_PAIRS = 10
SPAN = "struct<start:bigint,kind_order:int,kind:string,end:bigint>"
_NO_SPANS = f"cast(array() as array<{SPAN}>)"


def two_sided(z: Column) -> Column:
    """Two-sided normal p-value; the tail by a rational fit of erfc (absolute
    error below 2e-7: Abramowitz and Stegun 7.1.26, fixed coefficients)."""

    def tail(x: Column) -> Column:
        return let(1.0 / (1.0 + 0.3275911 * x), lambda t: F.least(F.lit(1.0), poly(t) * t * F.exp(-x * x)))

    def poly(t: Column) -> Column:
        out = F.lit(1.061405429)
        for c in (-1.453152027, 1.421413741, -0.284496736, 0.254829592):
            out = out * t + c
        return out

    return let(F.abs(z) / math.sqrt(2.0), tail)


def infer_encoding(token: Column) -> Column:
    """Alphabet of the first encoding that fits, or else of the parts that
    occur in the token."""
    alphabet = F.concat(*[F.when(token.rlike(occurs), letters).otherwise("") for occurs, letters in PARTS])
    for _, consists, contains, letters in reversed(ENCODINGS):
        fits = token.rlike(consists)
        for need in contains:
            fits = fits & token.rlike(need)
        alphabet = F.when(fits, letters).otherwise(alphabet)
    return alphabet


def _letters(token: Column) -> Column:
    return F.filter(F.split(token, "", -1), lambda c: c != "")


def _without_last(array: Column) -> Column:
    return F.slice(array, F.lit(1), F.greatest(F.size(array) - 1, F.lit(0)))


def _without_first(array: Column) -> Column:
    return F.slice(array, F.lit(2), F.greatest(F.size(array) - 1, F.lit(0)))


def _symbols(token: Column, alphabet: Column) -> Column:
    # a hexadecimal token may be in upper case; its alphabet is in lower case
    folded = F.when(alphabet.startswith("0123456789abcdef"), F.lower(token)).otherwise(token)
    return F.transform(_letters(folded), lambda c: F.instr(alphabet, c) - 1)


def like_language(token: Column, k: Column) -> Column:
    """p-value of "uniform letters" by the number of neighbouring letters that
    are a frequent pair of written language; null for alphabets without most
    letters and for fewer than ``MIN_PAIRS`` pairs."""
    share = len(PAIRS) / 26**2
    # neighbouring pairs have a letter in common, so their counts correlate
    both = sum(1 for p in PAIRS for q in PAIRS if p[1] == q[0]) / 26**3
    unit = share * (1 - share) + 2 * (both - share**2)
    listed = F.lit(" ".join(PAIRS))

    def counted(letters: Column) -> Column:
        pairs = F.zip_with(_without_last(letters), _without_first(letters), lambda a, b: F.concat(a, b))
        pairs = F.filter(pairs, lambda p: p.rlike("^[a-z]{2}$"))
        return let(pairs, lambda ps: F.struct(F.size(ps).cast("double").alias("n"), F.size(F.filter(ps, lambda p: F.contains(listed, p))).alias("found")))

    def tested(c: Column) -> Column:
        z = (c["found"] - 0.5 - c["n"] * share) / F.sqrt(c["n"] * unit)
        one_sided = F.when(z > 0, two_sided(z) / 2).otherwise(1.0)
        return F.when((k > 17) & (c["n"] >= MIN_PAIRS), one_sided)

    return let(let(_letters(F.lower(token)), counted), tested)


def battery(symbols: Column, k: Column, language: Column) -> Column:
    """p-value of "independent uniform symbols" from the three tests and that
    of ``language`` (null: not applied).

    ``symbols``: array of numbers below ``k``. A test that cannot be computed
    (all symbols on one side or equal) gives p-value 0: not random.
    """
    total = lambda array: F.aggregate(array, F.lit(0.0), lambda a, x: a + x)
    count = lambda array, test: F.size(F.filter(array, test)).cast("double")

    def tests(x: Column, n: Column, k: Column, pairs: Column) -> Column:
        counts = F.transform(F.sequence(F.lit(0), k.cast("int") - 1), lambda s: count(x, lambda y: y == s))
        chi = total(F.transform(counts, lambda c: c * c)) * k / n - n
        dof = k - 1.0
        spread = 2.0 / (9.0 * dof)
        p_uniform = two_sided((F.pow(chi / dof, F.lit(1.0 / 3.0)) - (1.0 - spread)) / F.sqrt(spread))

        half = k / 2
        sides = F.struct(count(x, lambda y: y >= half).alias("upper"), (1.0 + count(pairs, lambda p: (p["a"] >= half) != (p["b"] >= half))).alias("runs"))
        expected = lambda s: F.struct((2.0 * s["upper"] * (n - s["upper"]) / n + 1.0).alias("mean"), s["runs"].alias("runs"))
        spread_of = lambda e: (e["mean"] - 1.0) * (e["mean"] - 2.0) / (n - 1.0)
        p_runs = let(let(sides, expected), lambda e: F.when(spread_of(e) > 0, two_sided((e["runs"] - e["mean"]) / F.sqrt(spread_of(e)))).otherwise(0.0))

        def moments(average: Column) -> Column:
            squares = total(F.transform(x, lambda y: (y - average) * (y - average)))
            cross = total(F.transform(pairs, lambda p: (p["a"] - average) * (p["b"] - average)))
            return F.struct(squares.alias("squares"), cross.alias("cross"))

        serial = lambda m: F.when(m["squares"] > 0, two_sided((m["cross"] / m["squares"] + 1.0 / n) * F.sqrt(n))).otherwise(0.0)
        p_serial = let(let(total(x) / n, moments), serial)
        return let(language, lambda spoken: F.least(F.lit(1.0), F.when(spoken.isNull(), 3.0).otherwise(4.0) * F.least(p_uniform, p_runs, p_serial, spoken)))

    both = lambda x: F.zip_with(_without_last(x), _without_first(x), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    known = lambda x: F.struct(F.size(x).cast("double").alias("n"), k.cast("double").alias("k"), both(x).alias("pairs"))
    return let(symbols, lambda x: let(known(x), lambda s: tests(x, s["n"], s["k"], s["pairs"])))


def not_dismissed(tested: Column, fdr: float) -> Column:
    """Candidates that the weighted step-up doesn't dismiss as structured."""

    def weigh(t: Column) -> Column:
        mean_length = F.aggregate(t, F.lit(0.0), lambda a, c: a + (c["end"] - c["start"])) / F.size(t)
        weighted = let(mean_length, lambda mean: F.transform(t, lambda c: c["p"] * mean / (c["end"] - c["start"])))
        return let(weighted, lambda w: let(F.array_sort(w), lambda ranked: let(limit(ranked), lambda most: kept(t, w, most))))

    def limit(ranked: Column) -> Column:
        passed = let(F.size(ranked), lambda m: F.transform(ranked, lambda q, i: F.when(q <= fdr * (i + 1) / m, q)))
        return F.coalesce(F.array_max(F.filter(passed, lambda q: q.isNotNull())), F.lit(-1.0))

    def kept(t: Column, weighted: Column, most: Column) -> Column:
        both = F.zip_with(t, weighted, lambda c, q: F.struct(c.alias("t"), q.alias("q")))
        return F.transform(F.filter(both, lambda b: b["q"] > most), lambda b: b["t"])

    return let(tested, weigh)


def outside(found: Column, base: Column) -> Column:
    """The spans of ``found`` that lie in no span of ``base``."""
    ours = F.transform(base, lambda b: F.struct(b["start"].alias("start"), F.lit(0).alias("mine"), b["end"].alias("end"), F.lit(None).cast("string").alias("match")))
    theirs = F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(1).alias("mine"), s["end"].alias("end"), s["match"].alias("match")))

    def uncovered(spans_: Column) -> Column:
        reach = running(F.transform(spans_, lambda s: F.when(s["mine"] == 0, s["end"]).otherwise(F.lit(0).cast("long"))), F.greatest)
        both = F.zip_with(spans_, reach, lambda s, r: F.struct(s.alias("s"), r.alias("reach")))
        return F.transform(F.filter(both, lambda b: (b["s"]["mine"] == 1) & (b["reach"] < b["s"]["end"])), lambda b: b["s"])

    return let(F.array_sort(F.concat(ours, theirs)), uncovered)


def _tagged(found: Column, kind: str) -> Column:
    return F.transform(
        found,
        lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind_order"), F.lit(kind).alias("kind"), s["end"].alias("end")),
    )


def scan_secrets(df: DataFrame, text: str = "text", fdr: float = 0.01, into: str = "secrets") -> DataFrame:
    """Add ``into``: array<struct<start, kind_order, kind, end>> by start, then
    kind; positions in code points, end exclusive.

    ``random`` spans never lie inside a signature's span. Null text counts as
    empty: no spans. Copies of a row give copies of the result. ``into`` is
    lengthened if a column is called so. The work is linear in the text and
    the candidates but for their sorting.
    """
    into = unused(df, into)
    prefix = into + "_"
    while any(c.lower().startswith(prefix.lower()) for c in df.columns):
        prefix += "_"
    body, base, runs, tested = (prefix + n for n in ("body", "base", "runs", "tested"))
    t = F.col(body)
    lower = F.lower(t)
    named = reduce(or_, [F.contains(lower, F.lit(w)) for w in ("passw", "secret", "token", "apikey", "api_key")])
    has_run = t.rlike(CANDIDATE)
    nothing = F.expr(_NO_SPANS)

    assign = F.filter(spans(t, ASSIGN), lambda s: F.length(F.regexp_extract(s["match"], ASSIGN, 2)) >= MIN_VALUE)
    access = F.filter(spans(t, ACCESS), lambda s: F.length(s["match"]) >= MIN_ACCESS)
    signed = F.concat(
        F.when(named, _tagged(assign, "assign")).otherwise(nothing),
        F.when(F.col(runs) & F.contains(t, F.lit("AKIA")), _tagged(access, "access")).otherwise(nothing),
        F.when(F.col(runs), _tagged(spans(t, HEX), "hex")).otherwise(nothing),
    )
    step = df.withColumn(body, text_or_empty(text))
    step = step.withColumn(runs, has_run)
    step = step.withColumn(base, F.array_sort(signed))
    candidates = F.transform(outside(spans(t, CANDIDATE), F.col(base)), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["match"].alias("match"), infer_encoding(s["match"]).alias("alphabet")))
    symbols = F.transform(candidates, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.length(s["alphabet"]).alias("k"), s["match"].alias("match"), _symbols(s["match"], s["alphabet"]).alias("x")))
    scored = F.transform(symbols, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), battery(s["x"], s["k"], like_language(s["match"], s["k"])).alias("p")))
    step = step.withColumn(tested, F.when(F.col(runs), scored))
    random = F.when(F.size(F.col(tested)) > 0, _tagged(not_dismissed(F.col(tested), fdr), "random")).otherwise(nothing)
    return step.withColumn(into, F.array_sort(F.concat(F.col(base), random))).drop(body, base, runs, tested)


def redact(text: Column, found: Column, mark: str = "[SECRET]") -> Column:
    """The text with every found span (by start) replaced; overlapping spans
    as one."""
    nothing = F.lit(0).cast("long")

    def gaps(spans_: Column, reach: Column) -> Column:
        """What stays: from the farthest end so far to a start beyond it."""
        before = F.concat(F.array(nothing), _without_last(reach))
        both = F.zip_with(spans_, before, lambda s, r: F.struct(r.alias("a"), s["start"].alias("b")))
        last = F.array(F.struct(F.element_at(reach, -1).alias("a"), F.length(text).cast("long").alias("b")))
        return F.concat(F.filter(F.transform(both, lambda g, i: F.struct(g["a"].alias("a"), g["b"].alias("b"), i.alias("i"))), lambda g: (g["b"] >= g["a"]) | (g["i"] == 0)), F.transform(last, lambda g: F.struct(g["a"], g["b"], F.lit(-1).alias("i"))))

    def cut(part: Column) -> Column:
        """The gaps of a slice, cut from the stretch of text that holds them."""
        start = part[0]["a"]
        stretch = text.substr((start + 1).cast("int"), (F.element_at(part, -1)["b"] - start).cast("int"))
        return let(F.struct(stretch.alias("t"), start.alias("o")), lambda z: F.transform(part, lambda g: z["t"].substr((g["a"] - z["o"] + 1).cast("int"), (g["b"] - g["a"]).cast("int"))))

    def clear(spans_: Column) -> Column:
        kept = let(running(F.transform(spans_, lambda s: s["end"]), F.greatest), lambda reach: gaps(spans_, reach))
        return F.array_join(F.flatten(let(kept, lambda g: F.transform(slices_of(g), cut))), mark)

    return F.when(F.size(found) == 0, text).otherwise(let(found, clear))
