"""Python-list-literal text ⇄ ``array<string>`` (curated CSV columns).

The curated CSV stores lists the way Python prints them, e.g.
``['Mara Vale', "O'Brien"]``. Decoding runs in the JVM through the JSON
reader with single quotes and backslash escapes allowed; no per-row Python.

Decode rules (per cell):

* null or empty text → ``[]``;
* a list literal → its items as text; ``None``/``nan`` items → null;
* anything else (including a list literal that does not parse) → a
  one-element list holding the raw text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marquee.functions.scalars import EMPTY_STRING_ARRAY

_JSON_OPTS = {
    "allowSingleQuotes": "true",
    "allowBackslashEscapingAnyCharacter": "true",
    "allowNonNumericNumbers": "true",
    "mode": "PERMISSIVE",
}
# Bare None / nan items between list delimiters become JSON nulls.
_NULL_ITEM = r"(?<=[\[,])(\s*)(?:None|nan)(?=\s*[,\]])"


def decode_list(text: Column | str) -> Column:
    t = F.col(text) if isinstance(text, str) else text
    trimmed = F.trim(t)
    is_list = trimmed.startswith("[") & trimmed.endswith("]")
    parsed = F.from_json(F.regexp_replace(trimmed, _NULL_ITEM, "$1null"), EMPTY_STRING_ARRAY, _JSON_OPTS)
    return (
        F.when(t.isNull() | (t == F.lit("")), F.array().cast(EMPTY_STRING_ARRAY))
        .when(is_list & parsed.isNotNull(), parsed)
        .otherwise(F.array(t))
    )


def encode_list(arr: Column | str) -> Column:
    """``array<string>`` → Python list literal text (null items as ``None``)."""
    a = F.col(arr) if isinstance(arr, str) else arr

    def item(x: Column) -> Column:
        has_single = F.instr(x, "'") > 0
        has_double = F.instr(x, '"') > 0
        escaped = F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))
        dq = F.concat(F.lit('"'), F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit('"'))
        sq = F.concat(F.lit("'"), escaped, F.lit("'"))
        return F.when(x.isNull(), F.lit("None")).when(has_single & ~has_double, dq).otherwise(sq)

    return F.concat(F.lit("["), F.array_join(F.transform(a, item), ", "), F.lit("]"))


def as_string_list(col: Column, data_type) -> Column:
    """Typed arrays pass through; text is decoded; other scalars → one item."""
    from pyspark.sql.types import ArrayType, StringType

    if isinstance(data_type, ArrayType):
        return col.cast(EMPTY_STRING_ARRAY)
    if isinstance(data_type, StringType):
        return decode_list(col)
    return F.when(col.isNull(), F.array().cast(EMPTY_STRING_ARRAY)).otherwise(F.array(col.cast("string")))
