"""Serving-table builders: movies, text features, credits (second tier).

These follow the documented serving contract (the reference specifies
them without code): movies keyed by ``tconst`` with a display title free of
the transitional ``" (tt…)"`` suffix; versioned text features identified by
the SHA-256 of their text with one active row per feature contract; credits
from crew and principals with crew authoritative for directors/writers.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marquee.functions.scalars import empty_if_null, split_ids

# Fixed values of the contract.
SOUP_FEATURE = "recommendation_soup"
SOUP_VERSION = "v1"
SOUP_BUILD_METHOD = "curated_lists"
SUFFIX_PATTERN = r" \(tt[0-9]+\)$"
CANONICAL_ID_PATTERN = r"^tt[0-9]+$"
SOUP_DIRECTORS = 3
SOUP_CAST = 5
CREW_ROLES = ("director", "writer")


def strip_title_suffix(title: str | F.Column) -> F.Column:
    t = F.col(title) if isinstance(title, str) else title
    return F.regexp_replace(t, SUFFIX_PATTERN, "")


def movies_from_curated(curated: DataFrame) -> DataFrame:
    """Serving ``movies`` rows from the curated catalogue (CSV backfill rule):
    display title from the primary title, else the title without suffix."""
    return curated.select(
        "tconst",
        F.coalesce(F.col("primary_title"), strip_title_suffix("title")).alias("display_title"),
        "primary_title",
        F.col("score").alias("weighted_score"),
        empty_if_null("genres").alias("genres"),
        F.lit(True).alias("active"),
    )


def normalize_text(c: F.Column) -> F.Column:
    """Lower-case, trim, single spaces."""
    return F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))


def recommendation_soup(curated: DataFrame, version: str = SOUP_VERSION) -> DataFrame:
    """One text feature row per title: ``title | genres | directors | cast``
    (each part normalised, lists joined by ``, ``, null names skipped),
    at most 3 directors and 5 cast, plus the SHA-256 of the text."""

    def joined(arr: str, n: int | None = None) -> F.Column:
        listed = empty_if_null(arr) if n is None else F.slice(empty_if_null(arr), 1, n)
        kept = F.filter(listed, lambda x: x.isNotNull())
        return F.array_join(F.transform(kept, normalize_text), ", ")

    text = F.concat_ws(
        " | ",
        normalize_text(F.coalesce(F.col("primary_title"), strip_title_suffix("title"))),
        joined("genres"),
        joined("director_names", SOUP_DIRECTORS),
        joined("actors", SOUP_CAST),
    )
    return curated.select(
        "tconst",
        F.lit(SOUP_FEATURE).alias("feature_name"),
        F.lit(version).alias("feature_version"),
        text.alias("source_text"),
        F.sha2(text, 256).alias("source_text_sha256"),
        F.lit(SOUP_BUILD_METHOD).alias("build_method"),
    )


def add_feature_run(existing: DataFrame | None, new_rows: DataFrame, run_id: int) -> DataFrame:
    """Append a feature build: a text whose hash is already stored keeps its
    row (and notes the run that built it again); a new hash adds a row.
    Afterwards exactly the row built last per ``(tconst, feature_name,
    feature_version)`` is active, also when a text returns to an older one."""
    key = ["tconst", "feature_name", "feature_version"]
    ident = key + ["source_text_sha256"]
    run = F.lit(int(run_id)).cast("bigint")
    fresh = new_rows.withColumns({"source_etl_run_id": run, "last_built_run_id": run})
    if existing is None:
        allrows = fresh
    else:
        again = new_rows.select(*ident).distinct().withColumn("again", run)
        old = existing.drop("active").join(again, ident, "left")
        old = old.withColumn("last_built_run_id", F.coalesce("again", "last_built_run_id")).drop("again")
        allrows = old.unionByName(fresh.join(old.select(*ident), ident, "left_anti"))
    w = Window.partitionBy(*key).orderBy(F.col("last_built_run_id").desc(), F.col("source_text_sha256"))
    return allrows.withColumn("active", F.row_number().over(w) == 1)


def one_active_violations(features: DataFrame) -> DataFrame:
    """Feature contracts with more than one active row."""
    key = ["tconst", "feature_name", "feature_version"]
    return features.groupBy(*key).agg(F.count_if(F.col("active")).alias("active_rows")).where(F.col("active_rows") > 1)


def credits(crew: DataFrame, principals: DataFrame) -> DataFrame:
    """``(tconst, nconst, role_type, credit_order, source)``.

    Directors and, where the table has them, writers come from crew (list
    order, 1-based); principals give every other credit by ``ordering``,
    with their raw ``category`` and ``job`` where given. A principal credit whose person already
    has the same crew role on the title is dropped (crew is authoritative).
    Unique on ``(tconst, nconst, role_type, credit_order)``.
    """
    none = F.lit(None).cast("string")
    of_role = [
        crew.select("tconst", F.posexplode(split_ids(role + "s")).alias("pos", "nconst")).select(
            "tconst", "nconst", F.lit(role).alias("role_type"), (F.col("pos") + 1).cast("bigint").alias("credit_order"),
            F.lit("crew").alias("source"), none.alias("category"), none.alias("job"),
        )
        for role in CREW_ROLES
        if role + "s" in crew.columns
    ]
    d = reduce(DataFrame.unionByName, of_role)
    cols = principals.columns
    role = F.col("category") if "category" in cols else F.lit("unknown")
    p = principals.select(
        "tconst", "nconst", role.alias("role_type"), F.col("ordering").cast("bigint").alias("credit_order"), F.lit("principals").alias("source"),
        (F.col("category") if "category" in cols else none).alias("category"), (F.col("job") if "job" in cols else none).alias("job"),
    ).where(F.col("nconst").isNotNull())
    crew_roles = d.select("tconst", "nconst", "role_type").distinct()
    p = p.join(crew_roles, ["tconst", "nconst", "role_type"], "left_anti")
    return d.unionByName(p).dropDuplicates(["tconst", "nconst", "role_type", "credit_order"])


def credits_from_lists(curated: DataFrame) -> DataFrame:
    """Credits from the curated id/name lists (CSV backfill): list order is
    the credit order; entries without an id are skipped."""
    dz = curated.select("tconst", F.posexplode(F.arrays_zip("director_ids", "director_names")).alias("pos", "z")).select(
        "tconst", F.col("z.director_ids").alias("nconst"), F.col("z.director_names").alias("name"), F.lit("director").alias("role_type"), (F.col("pos") + 1).alias("credit_order")
    )
    cz = curated.select("tconst", F.posexplode(F.arrays_zip("cast_ids", "actors")).alias("pos", "z")).select(
        "tconst", F.col("z.cast_ids").alias("nconst"), F.col("z.actors").alias("name"), F.lit("actor").alias("role_type"), (F.col("pos") + 1).alias("credit_order")
    )
    return dz.unionByName(cz).where(F.col("nconst").isNotNull())


def validate_ids(ids: DataFrame, col: str = "tconst") -> DataFrame:
    """``(id, accepted)``: only canonical title ids are accepted."""
    return ids.select(F.col(col).alias("id"), F.coalesce(F.col(col).rlike(CANONICAL_ID_PATTERN), F.lit(False)).alias("accepted"))
