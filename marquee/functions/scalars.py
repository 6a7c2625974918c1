"""Column expressions for the catalogue (all JVM-side, codegen friendly)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that results depend on.
MISSING_MARKER = "\\N"  # missing value marker of the raw tab-separated sources
NOT_FOUND_ERROR = "This movie is not in the dataset."
NO_HEADER_ERROR = "Dataset is missing a header row."
MISSING_COLUMNS_ERROR = "Dataset is missing required column(s): "
DUPLICATE_NO_ID_ERROR = (
    "Dataset contains duplicate title values and no tconst values to disambiguate them."
)
EMPTY_STRING_ARRAY = "array<string>"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def weighted_score(votes: str | Column, rating: str | Column, mean_rating, min_votes) -> Column:
    """Bayesian weighted rating ``v/(v+m)*R + m/(m+v)*C``.

    ``try_divide`` turns the ``v+m = 0`` case into a null score instead of an
    error; a NaN result is normalised to null so it sorts last.
    """
    v = _col(votes).cast("double")
    r = _col(rating).cast("double")
    c = mean_rating if isinstance(mean_rating, Column) else F.lit(mean_rating)
    m = min_votes if isinstance(min_votes, Column) else F.lit(min_votes)
    m = m.cast("double")
    c = c.cast("double")
    value = F.try_divide(v, v + m) * r + F.try_divide(m, m + v) * c
    return F.nanvl(value, F.lit(None).cast("double"))


def split_ids(value: str | Column, limit: int | None = None) -> Column:
    """Comma list → array, dropping empty items and the missing marker.

    A null or missing-marker cell gives an empty array; ``limit`` keeps the
    first items in list order.
    """
    v = _col(value)
    parts = F.filter(
        F.split(v, ",", -1),
        lambda x: (x != F.lit("")) & (x != F.lit(MISSING_MARKER)),
    )
    parts = F.when(v.isNull() | (v == F.lit(MISSING_MARKER)), F.array().cast(EMPTY_STRING_ARRAY)).otherwise(parts)
    if limit is not None:
        parts = F.slice(parts, 1, max(0, int(limit))) if limit > 0 else F.array().cast(EMPTY_STRING_ARRAY)
    return parts


def split_genres(value: str | Column) -> Column:
    """Genre text → array (same rules as :func:`split_ids`, no limit)."""
    return split_ids(value)


def empty_if_null(arr: str | Column) -> Column:
    """Null list → empty list."""
    return F.coalesce(_col(arr), F.array().cast(EMPTY_STRING_ARRAY))


def first_or_empty(arr: str | Column) -> Column:
    """First element, ``''`` for an empty list; a null first element stays null."""
    a = _col(arr)
    return F.when(F.size(a) > 0, F.try_element_at(a, F.lit(1))).otherwise(F.lit(""))


def disambiguated_title(title: str | Column, tconst: str | Column, is_duplicate: Column) -> Column:
    """``"{title} ({tconst})"`` for duplicated titles, the title otherwise."""
    t = _col(title)
    return F.when(is_duplicate, F.concat(t, F.lit(" ("), _col(tconst), F.lit(")"))).otherwise(t)


def normalize_term(value: str | Column) -> Column:
    """Lower-case and delete everything outside ``[a-z0-9]``."""
    return F.regexp_replace(F.lower(_col(value)), "[^a-z0-9]+", "")


def terms_of(*arrays: Column) -> Column:
    """Distinct non-empty normalised terms of several string arrays.

    Null elements and terms that normalise to nothing are dropped; fields
    share one namespace.
    """
    merged = F.concat(*[empty_if_null(a) for a in arrays])
    normed = F.transform(merged, lambda x: normalize_term(x))
    return F.array_distinct(F.filter(normed, lambda x: x.isNotNull() & (x != F.lit(""))))


def clean_name(value: str | Column) -> Column:
    """Delete spaces and lower-case (cosine path)."""
    return F.lower(F.replace(_col(value), F.lit(" "), F.lit("")))


def soup(actors: Column, director: Column, genres: Column) -> Column:
    """Each list glued without separator, the three parts joined by a space."""
    return F.concat_ws(
        " ",
        F.array_join(F.transform(empty_if_null(actors), clean_name), ""),
        F.array_join(F.transform(empty_if_null(director), clean_name), ""),
        F.array_join(F.transform(empty_if_null(genres), clean_name), ""),
    )


def join_or_none(arr: str | Column, sep: str = ", ") -> Column:
    """Joined list text, ``(none)`` when empty."""
    return F.coalesce(F.nullif(F.array_join(_col(arr), sep), F.lit("")), F.lit("(none)"))


def list_text(arr: str | Column, null_as: str = "?", sep: str = "|") -> Column:
    """Stable text form of a nullable string array (nulls kept as ``null_as``)."""
    return F.array_join(F.transform(_col(arr), lambda x: F.coalesce(x, F.lit(null_as))), sep)


def clamp0(n: int) -> int:
    return max(0, int(n))
