"""Chat formatting with typed content parts.

A message is a list of parts ``struct<kind, text, uri, tokens>``; ``kind`` is
``text``, ``image``, ``audio`` or ``document``. A visitor flattens the parts
in order: text is escaped, every other part becomes a placeholder
``<|image|>`` / ``<|audio|>`` / ``<|document|>`` and leaves an attachment
(reference and the number of tokens its placeholder expands to). Messages of
a conversation are joined as::

    <|im_start|>ROLE\\nCONTENT<|im_end|>\\n

Control strings start with ``<|``. Inside texts and roles every ``<`` that is
followed by backslashes and ``|`` gets one more backslash, so no ``<|`` of a
text survives; removing one backslash restores it exactly.

Work per message is one projection; one grouping by conversation follows.
A conversation is one output value, so its turns have to meet in one task;
nothing else does, and conversations are spread by their id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.llm.common import pick, text_or_empty

START, END, SEPARATOR, NEWLINE = "<|im_start|>", "<|im_end|>", "<|part|>", "<|nl|>"
KINDS = ("image", "audio", "document")
#: Tokens that a placeholder expands to when its part does not say.
DEFAULT_TOKENS = {"image": 576, "audio": 750, "document": 1024}
PART = "struct<kind:string,text:string,uri:string,tokens:int>"
ATTACHMENT = "struct<kind:string,uri:string,source:string,tokens:int>"

#: Inline references that ``parts_from_text`` turns into typed parts.
LINK = r"!\[[^\]\n]*\]\([^()\s]+\)"
_EXTENSIONS = {
    "image": ("png", "jpg", "jpeg", "gif", "webp", "bmp"),
    "audio": ("wav", "mp3", "ogg", "flac", "m4a"),
    "document": ("pdf", "doc", "docx", "txt", "html"),
}


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _part(kind: Column, text: Column, uri: Column, tokens: Column) -> Column:
    return F.struct(kind.alias("kind"), text.alias("text"), uri.alias("uri"), tokens.cast("int").alias("tokens"))


def parts_from_text(text: Column) -> Column:
    """Split a plain text at inline ``![alt](file)`` references.

    References become image, audio or document parts by their extension
    (image where it is none of the known ones); their ``text`` keeps the
    source, so the message can be restored. A null text is no part.
    """
    none = F.lit(None)
    plain = F.array(_part(F.lit("text"), text, none.cast("string"), none))

    def link(source: Column) -> Column:
        uri = F.regexp_extract(source, r"\(([^()\s]+)\)$", 1)
        ending = F.lower(F.regexp_extract(uri, r"\.([A-Za-z0-9]+)$", 1))
        kind = F.when(ending.isin(*_EXTENSIONS["audio"]), "audio").when(ending.isin(*_EXTENSIONS["document"]), "document").otherwise("image")
        return _part(kind, source, uri, none)

    pieces = F.transform(F.split(text, LINK, -1), lambda t: _part(F.lit("text"), t, none.cast("string"), none))
    links = F.transform(F.regexp_extract_all(text, F.lit(LINK), F.lit(0)), link)
    mixed = F.flatten(F.zip_with(pieces, links, lambda p, q: F.array_compact(F.array(p, q))))
    split = F.filter(mixed, lambda p: (p["kind"] != "text") | (p["text"] != ""))
    return F.when(text.isNull(), F.expr(f"cast(array() as array<{PART}>)")).when(F.contains(text, F.lit("![")), split).otherwise(plain)


def visit(parts: Column) -> Column:
    """Flatten parts: ``struct<content, attachments>``.

    Two texts in a row are kept apart by a separator, or the end of one and
    the start of the next could form a control string. Parts of an unknown
    kind count as text; a null text is empty.
    """
    is_attachment = lambda p: p["kind"].isin(*KINDS)

    def flat(p: Column, i: Column) -> Column:
        before = F.get(parts, i - 1)  # null for the first
        gap = F.when((i > 0) & ~F.coalesce(before["kind"], F.lit("")).isin(*KINDS), F.lit(SEPARATOR)).otherwise(F.lit(""))
        return F.when(is_attachment(p), F.concat(F.lit("<|"), p["kind"], F.lit("|>"))).otherwise(
            F.concat(gap, escape(F.coalesce(p["text"], F.lit(""))))
        )

    def attach(p: Column) -> Column:
        tokens = F.lit(DEFAULT_TOKENS["image"])
        for kind in ("audio", "document"):
            tokens = F.when(p["kind"] == kind, DEFAULT_TOKENS[kind]).otherwise(tokens)
        return F.struct(
            p["kind"].alias("kind"), p["uri"].alias("uri"), F.coalesce(p["text"], F.lit("")).alias("source"), F.coalesce(p["tokens"], tokens).alias("tokens")
        )

    content = F.array_join(F.transform(parts, lambda p, i: flat(p, i)), "")
    return F.struct(content.alias("content"), F.transform(F.filter(parts, is_attachment), attach).alias("attachments"))


def format_conversations(messages: DataFrame) -> DataFrame:
    """One row per ``conv_id`` from messages (conv_id, turn, role, parts).

    Output: ``segments`` (array of struct<text, loss>; loss is true for what
    an assistant says), ``formatted`` (their concatenation), ``attachments``
    (one array per turn) and ``expanded_tokens``. Turns are in order of
    ``turn`` (null first), ties by role and content, so that reruns agree;
    repeated rows stay. Null roles count as empty. A null conv_id is a
    conversation of its own. An empty table gives no row.
    """
    rows = pick(messages, "conv_id", "turn", "role", "parts")
    rows = rows.withColumn("v", visit(F.coalesce("parts", F.expr(f"cast(array() as array<{PART}>)"))))
    turn = F.struct("turn", text_or_empty("role").alias("role"), F.col("v.content").alias("content"), F.col("v.attachments").alias("attachments"))
    grouped = rows.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))

    def laid_out(t: Column) -> Column:
        role = F.replace(escape(t["role"]), F.lit("\n"), F.lit(NEWLINE))
        segment = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        no = F.lit(False)
        return F.array(
            segment(F.concat(F.lit(START), role, F.lit("\n")), no),
            segment(t["content"], t["role"] == "assistant"),
            segment(F.lit(END + "\n"), no),
        )

    out = grouped.select(
        "conv_id",
        F.flatten(F.transform("turns", laid_out)).alias("segments"),
        F.transform("turns", lambda t: t["attachments"]).alias("attachments"),
    )
    tokens = F.aggregate(F.flatten("attachments"), F.lit(0).cast("long"), lambda n, a: n + a["tokens"])
    return out.select(
        "conv_id",
        "segments",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        "attachments",
        tokens.alias("expanded_tokens"),
    )


def _restored(content: Column, attachments: Column) -> Column:
    """The text of a message from its content and its attachments."""
    texts = F.split(F.replace(content, F.lit(SEPARATOR), F.lit("")), r"<\|(?:" + "|".join(KINDS) + r")\|>", -1)
    both = F.zip_with(texts, F.coalesce(attachments, F.expr(f"cast(array() as array<{ATTACHMENT}>)")), lambda t, a: F.concat(unescape(t), F.coalesce(a["source"], F.lit(""))))
    return F.array_join(both, "")


def read_turns(formatted: Column, attachments: Column) -> Column:
    """Parse formatted text back: array of struct<role, text>."""
    pieces = F.slice(F.split(formatted, r"<\|im_start\|>", -1), F.lit(2), F.greatest(F.size(F.split(formatted, r"<\|im_start\|>", -1)) - 1, F.lit(0)))

    def turn(piece: Column, listed: Column) -> Column:
        role = F.substring_index(piece, "\n", 1)
        body = piece.substr(F.length(role) + 2, F.length(piece) - F.length(role) - 1 - len(END) - 1)
        return F.struct(unescape(F.replace(role, F.lit(NEWLINE), F.lit("\n"))).alias("role"), _restored(body, listed).alias("text"))

    return F.zip_with(pieces, attachments, turn)


def read_loss_text(segments: Column, attachments: Column) -> Column:
    """All text under the loss mask, unescaped, in order, nothing between."""
    kept = F.filter(segments, lambda s: s["loss"])
    # a segment under the mask is the middle one of its turn
    owners = F.filter(F.transform(attachments, lambda a, i: F.struct(a.alias("a"), F.get(segments, i * 3 + 1)["loss"].alias("loss"))), lambda o: o["loss"])
    return F.array_join(F.zip_with(kept, owners, lambda s, o: _restored(s["text"], o["a"])), "")
