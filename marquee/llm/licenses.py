"""License scan: ordered signature rules with keyword prefilter.

A text becomes its *wrapped* form: every word (a run of ASCII letters, digits
and characters beyond ASCII) between two spaces of its own. A rule runs on a text
only if all its keywords occur in it. Detections are word intervals; one is
dropped when its interval lies inside that of a detection of higher priority
(a rule of smaller rank), which a single sweep over the detections in start
order decides with the intervals still open at that point.

Everything is one projection per row: no shuffle, no state between rows, so a
hot source or a million copies cost the same as any other rows.
"""

from __future__ import annotations

import json
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.llm.common import let, slices_of, spans, text_or_empty, unused
from marquee.llm.license_rules import ROOTS, RULES, Rule

_WORD = r"a-zA-Z0-9\x{80}-\x{10FFFF}"
#: Separator runs other than one lone space; most separators are just that
#: and need no replacing.
_RUNS = rf"[^{_WORD} ][^{_WORD}]*+| [^{_WORD}]++"
_DETECTION = "array<struct<start:bigint,end_back:bigint,rank:int,label:string,confidence:double,base:boolean>>"


def spaced(text: Column) -> Column:
    """The words of a text with one space between them."""
    return F.trim(F.regexp_replace(text, _RUNS, " "))


def wrapped(spaced_text: Column) -> Column:
    """Every word between two spaces of its own."""
    return F.concat(F.lit(" "), F.replace(spaced_text, F.lit(" "), F.lit("  ")), F.lit(" "))


def _n_spaces(text: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))).cast("long")


def count_wrapped(run: Column) -> Column:
    """Number of words in a run of wrapped words."""
    return (_n_spaces(run) / 2).cast("long")


def _rules_literal(rules: tuple[Rule, ...]) -> Column:
    """The rules as one constant (folded when the plan is optimized)."""
    rows = [
        {"rank": r.rank, "label": r.label, "keywords": r.keywords, "pattern": "(?i)" + r.pattern, "confidence": r.confidence, "base": r.base}
        for r in rules
    ]
    kind = "array<struct<rank:int,label:string,keywords:array<string>,pattern:string,confidence:double,base:boolean>>"
    return F.from_json(F.lit(json.dumps(rows)), kind)


def _matches(words: Column, present: Column, rules: tuple[Rule, ...]) -> Column:
    """All matches of the rules whose keywords are ``present``, by start."""
    live = F.filter(_rules_literal(rules), lambda r: F.size(F.array_except(r["keywords"], present)) == 0)
    per_rule = F.transform(
        live,
        lambda r: F.transform(
            spans(words, r["pattern"], count_wrapped),
            lambda s: F.struct(
                s["start"].alias("start"),
                (-s["end"]).alias("end_back"),  # of two that start together the longer comes first
                r["rank"].alias("rank"),
                r["label"].alias("label"),
                r["confidence"].alias("confidence"),
                r["base"].alias("base"),
            ),
        ),
    )
    return F.array_sort(F.flatten(per_rule))


def _surviving(found: Column) -> Column:
    """Detections not contained in one of higher priority.

    Containment is transitive and so is priority: if the containing one is
    itself dropped, what dropped it contains this one too. So it is enough to
    look for any earlier, still open interval that reaches at least as far.
    """
    kept_type = "array<struct<start:bigint,end:bigint,rank:int,label:string,confidence:double>>"

    def step(acc: Column, d: Column) -> Column:
        still_open = F.filter(acc["open"], lambda o: o["end"] > d["start"])
        hidden = F.exists(still_open, lambda o: (o["end"] >= -d["end_back"]) & (o["rank"] < d["rank"]))
        this_open = F.array(F.struct((-d["end_back"]).alias("end"), d["rank"].alias("rank")))
        this = F.array(
            F.struct(d["start"].alias("start"), (-d["end_back"]).alias("end"), d["rank"].alias("rank"), d["label"].alias("label"), d["confidence"].alias("confidence"))
        )
        return F.struct(
            F.concat(still_open, this_open).alias("open"),
            F.when(hidden, acc["kept"]).otherwise(F.concat(acc["kept"], this)).alias("kept"),
        )

    none = F.expr(f"cast(array() as {kept_type})")
    start = F.struct(F.expr("cast(array() as array<struct<end:bigint,rank:int>>)").alias("open"), F.expr(f"cast(array() as array<{kept_type}>)").alias("kept"))

    def walk(acc: Column, part: Column) -> Column:
        """One slice of detections; only its own ones are copied as they grow."""
        inside = F.aggregate(part, F.struct(acc["open"].alias("open"), none.alias("kept")), step)
        return let(inside, lambda now: F.struct(now["open"].alias("open"), F.concat(acc["kept"], F.array(now["kept"])).alias("kept")))

    return let(found, lambda ds: F.flatten(F.aggregate(slices_of(ds), start, walk, lambda acc: acc["kept"])))


def scan_licenses(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, into: str = "licenses") -> DataFrame:
    """Add struct column ``into``: ``n_words``, ``base`` (places of the base
    phrases, start word and label) and ``detections`` that survive (word
    interval, rank, label, confidence), both by start.

    Null text counts as empty: no words, empty arrays. Copies of a row give
    copies of the result; no other column is read.
    """
    into = unused(df, into)
    prefix = into + "_"
    while any(c.lower().startswith(prefix.lower()) for c in df.columns):
        prefix += "_"
    words, lower, present, found = (prefix + n for n in ("words", "lower", "present", "found"))
    keywords = sorted({k for r in rules for k in r.keywords})
    has = lambda k: F.contains(F.col(lower), F.lit(k))
    listed = F.array_compact(F.array(*[F.when(has(k), F.lit(k)) for k in keywords]))
    none = F.expr("cast(array() as array<string>)")
    nothing = F.expr(f"cast(array() as {_DETECTION})")
    step = df.withColumn(words, spaced(text_or_empty(text)))
    step = step.withColumn(lower, F.concat(F.lit(" "), F.lower(F.col(words)), F.lit(" ")))
    step = step.withColumn(present, F.when(reduce(or_, [has(k) for k in ROOTS]), listed).otherwise(none))
    step = step.withColumn(
        found, F.when(F.size(F.col(present)) > 0, _matches(wrapped(F.col(words)), F.col(present), rules)).otherwise(nothing)
    )
    base = F.transform(F.filter(F.col(found), lambda d: d["base"]), lambda d: F.struct(d["start"].alias("start"), d["label"].alias("label")))
    return step.withColumn(
        into,
        F.struct(
            F.when(F.col(words) == "", F.lit(0)).otherwise(_n_spaces(F.col(words)) + 1).cast("long").alias("n_words"),
            base.alias("base"),
            _surviving(F.filter(F.col(found), lambda d: ~d["base"])).alias("detections"),
        ),
    ).drop(words, lower, present, found)
