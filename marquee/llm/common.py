"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# White space that separates words: space and the ASCII controls 09-0D.
SPACE_CLASS = r"\x20\x09-\x0D"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns, found by their exact spelling.

    Columns are addressed by position, so a table that also carries ``TEXT``
    or a second ``text`` is read without an ambiguity error; the first column
    of the exact name counts.
    """
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    if len({c.lower() for c in df.columns}) == len(df.columns):
        return df.select(*[F.col(f"`{n}`") for n in names])
    numbered = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return numbered.select(*[F.col(f"c{df.columns.index(n)}").alias(n) for n in names])


def carried(df: DataFrame, *names: str) -> DataFrame:
    """The named columns (the first of each name) and all others packed into
    one more called ``row``: whatever those are called, no operator meets
    their names. ``unpacked`` undoes it."""
    places = [f"c{i}" for i in range(len(df.columns))]
    mine = [places[df.columns.index(n)] for n in names]
    rest = [F.col(p) for p in places if p not in mine] or [F.lit(0).alias("c")]
    return df.toDF(*places).select(*[F.col(p).alias(n) for p, n in zip(mine, names)], F.struct(*rest).alias("row"))


def cells(columns: list[str], names: tuple[str, ...]) -> list[Column]:
    """The original columns of a frame that ``carried`` made with ``names``."""
    return [F.col(c) if c in names and columns.index(c) == i else F.col(f"row.c{i}") for i, c in enumerate(columns)]


def unpacked(df: DataFrame, columns: list[str], *names: str) -> DataFrame:
    """Exactly the original ``columns`` of a frame made by ``carried``."""
    return df.select(*[value.alias(c) for value, c in zip(cells(columns, names), columns)])


def unused(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_or_empty(column: str | Column) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(c, F.lit(""))


def sql_string(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


#: Elements of an array that are folded together; see ``running``.
SLICE = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once: inside a lambda an outer
    expression is computed anew for every element, a lambda's variable is not."""
    return F.transform(F.array(value), body)[0]


def slices_of(array: Column) -> Column:
    """The array in runs of ``SLICE`` elements (the empty array: one empty run)."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.size(array), F.lit(1)) - 1) / SLICE).cast("int")), lambda c: F.slice(array, c * SLICE + 1, F.lit(SLICE)))


def running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """Running sums (or maxima, by ``join``) of an array of bigint from 0 on.

    An array that grows by one element is copied each time, so the sums run
    inside slices first, then over the slices' totals, and are added up last:
    the work per element is bounded.
    """
    none, zero = F.expr("cast(array() as array<bigint>)"), F.lit(0).cast("long")
    empty = F.struct(zero.alias("at"), none.alias("out"))

    def step(acc: Column, x: Column) -> Column:
        return let(join(acc["at"], x), lambda now: F.struct(now.alias("at"), F.concat(acc["out"], F.array(now)).alias("out")))

    def add_up(inside: Column) -> Column:
        totals = F.transform(inside, lambda part: F.coalesce(F.get(part, F.size(part) - 1), zero))
        before = F.aggregate(totals, empty, lambda acc, t: F.struct(join(acc["at"], t).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])
        return F.flatten(F.zip_with(inside, before, lambda part, base: F.transform(part, lambda x: join(base, x))))

    inside = lambda array: F.transform(slices_of(array), lambda part: F.aggregate(part, empty, step, lambda acc: acc["out"]))
    return let(values, lambda array: let(inside(array), add_up))


def spans(text: Column, pattern: Column | str, measure: Callable[[Column], Column] = F.length) -> Column:
    """All leftmost, non-overlapping matches of ``pattern`` with positions.

    ``array<struct<start bigint, end bigint, match string>>``, positions in
    units of ``measure`` (code points by default). The text between matches
    comes from ``split`` and the matches from ``regexp_extract_all``; both
    walk the text once with the same engine, so the k-th match starts after
    the first k pieces and the first k-1 matches. A pattern must not match
    the empty string. The work is linear in text and matches.
    """
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern

    def placed(found: Column) -> Column:
        between = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
        measured = F.zip_with(between, found, lambda b, m: F.struct(measure(b).cast("long").alias("b"), measure(m).cast("long").alias("n"), m.alias("m")))
        return let(measured, lambda steps: F.zip_with(steps, running(F.transform(steps, lambda s: s["b"] + s["n"]), lambda a, b: a + b), row))

    def row(step: Column, end: Column) -> Column:
        return F.struct((end - step["n"]).alias("start"), end.alias("end"), step["m"].alias("match"))

    return let(F.regexp_extract_all(text, pattern, F.lit(0)), placed)
