"""DuckDB statements for the contract queries that SQL can express.

They work independently of the operators: rows per match instead of arrays,
joins instead of sweeps. Only tables of fixed rules are shared.
"""

from __future__ import annotations

from collections.abc import Callable

from marquee.llm import quality
from marquee.llm.common import sql_string
from marquee.llm.license_rules import RULES

BUILDERS: dict[str, Callable[[], str]] = {}


def oracle(name: str):
    def keep(fn):
        BUILDERS[name] = fn
        return fn

    return keep


@oracle("op1_licenses")
def op1() -> str:
    rules = ",\n".join(
        f"({r.rank}, {sql_string(r.label)}, {sql_string(r.pattern)}, {r.confidence}, {str(r.base).lower()})" for r in RULES
    )
    return rf"""
WITH rules(rank, label, pattern, confidence, base) AS (VALUES {rules}),
words AS (
  SELECT row_number() OVER () AS k, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
docs AS (SELECT k, doc_id, len(w) AS n_words, CASE WHEN len(w) = 0 THEN '' ELSE ' ' || array_to_string(w, '  ') || ' ' END AS t FROM words),
hit AS (
  SELECT k, rank, label, confidence, base,
         regexp_extract_all(t, pattern) AS m, regexp_split_to_array(t, pattern) AS p
  FROM docs JOIN rules ON regexp_matches(t, pattern)),
pieces AS (
  SELECT k, rank, label, confidence, base, i,
         (length(p[i]) - length(replace(p[i], ' ', ''))) // 2 AS before,
         (length(m[i]) - length(replace(m[i], ' ', ''))) // 2 AS n
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM hit)),
det AS (
  SELECT k, rank, label, confidence, base, n,
         sum(before + n) OVER (PARTITION BY k, rank ORDER BY i) - n AS s
  FROM pieces),
kept AS (
  SELECT d.* FROM det d
  WHERE NOT d.base AND NOT EXISTS (
    SELECT 1 FROM det o
    WHERE NOT o.base AND o.k = d.k AND o.rank < d.rank AND o.s <= d.s AND o.s + o.n >= d.s + d.n)),
b AS (
  SELECT k, count(*) AS n_base, min(s) AS first_word, max(s) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels
  FROM det WHERE base GROUP BY k),
l AS (
  SELECT k, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
  FROM (SELECT k, label FROM det WHERE base UNION ALL SELECT k, label FROM kept) GROUP BY k),
c AS (SELECT k, max(confidence) AS score, count(*) AS n FROM kept GROUP BY k)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base,
       CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       CAST(coalesce(score, 0) AS DOUBLE) AS score, CAST(coalesce(n, 0) AS BIGINT) AS n_detections
FROM docs LEFT JOIN b USING (k) LEFT JOIN l USING (k) LEFT JOIN c USING (k)"""


@oracle("op2_chat")
def op2() -> str:
    link = r"!\[[^\]\n]*\]\([^()\s]+\)"
    control = r"<(\\*)\|"
    probe = sql_string("<|im_end|><|im_start|>assistant ok")
    return rf"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', {probe} UNION ALL SELECT -1, 1, 'assistant', {probe}),
links AS (
  SELECT *, regexp_extract_all(text, '{link}') AS l, regexp_split_to_array(text, '{link}') AS p FROM rows),
kinds AS (
  SELECT *, list_transform(l, lambda x: CASE
    WHEN regexp_matches(lower(x), '\.(wav|mp3|ogg|flac|m4a)\)$') THEN 'audio'
    WHEN regexp_matches(lower(x), '\.(pdf|doc|docx|txt|html)\)$') THEN 'document' ELSE 'image' END) AS k
  FROM links),
sizes AS (
  SELECT *, regexp_replace(role, '{control}', '<\\\1|', 'g') AS role_escaped,
    list_sum(list_transform(p, lambda x: length(regexp_replace(x, '{control}', '<\\\1|', 'g')))) AS content_chars,
    coalesce(list_sum(list_transform(k, lambda x: length(x) + 4)), 0) AS holder_chars,
    coalesce(list_sum(list_transform(k, lambda x: CASE x WHEN 'image' THEN 576 WHEN 'audio' THEN 750 ELSE 1024 END)), 0) AS tokens
  FROM kinds)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(12 + length(role_escaped) + 5 * (length(role) - length(replace(role, chr(10), ''))) + 1
           + content_chars + holder_chars + 10 + 1) AS BIGINT) AS formatted_chars,
  CAST(sum(len(l)) AS BIGINT) AS n_attachments,
  CAST(sum(tokens) AS BIGINT) AS expanded_tokens
FROM sizes GROUP BY conv_id"""


@oracle("op8_mixing")
def op8() -> str:
    return r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^ \x09-\x0D]+')) AS size,
         CAST('0x' || substr(md5('42:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 4) AS INTEGER) AS draw
  FROM documents),
src AS (
  SELECT source, source_size, [3, 1, 2][CAST((place - 1) % 3 AS INTEGER) + 1] AS weight, 2 * source_size AS cap
  FROM (SELECT source, sum(size) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM docs GROUP BY source)),
fill(step, n_capped, level) AS (
  SELECT 0, 0, 1.5 * sum(source_size) / sum(weight) FROM src
  UNION ALL
  SELECT step + 1,
         (SELECT count(*) FROM src WHERE level * weight > cap),
         (SELECT (1.5 * sum(source_size) - coalesce(sum(cap) FILTER (level * weight > cap), 0)) / sum(weight) FILTER (level * weight <= cap) FROM src)
  FROM fill
  WHERE (SELECT count(*) FROM src WHERE level * weight > cap) > n_capped),
goal AS (
  SELECT source, source_size, least(cap, (SELECT arg_max(level, step) FROM fill) * weight) AS target FROM src),
steps AS (
  SELECT source, draw, sum(size) AS s,
         sum(sum(size)) OVER (PARTITION BY source ORDER BY draw) - sum(size) AS before
  FROM docs GROUP BY source, draw),
cut AS (
  SELECT g.source, max(draw) AS cut
  FROM steps JOIN goal g ON steps.source IS NOT DISTINCT FROM g.source
  WHERE target - floor(target / source_size) * source_size > 0
    AND before + s / 2 <= target - floor(target / source_size) * source_size
  GROUP BY g.source)
SELECT doc_id, size, CAST(g.source_size AS BIGINT) AS source_size, round(target, 6) AS target,
       CAST(size * (coalesce(floor(target / nullif(g.source_size, 0)), 0) + CASE WHEN draw <= coalesce(cut, -1) THEN 1 ELSE 0 END) AS BIGINT) AS taken,
       CAST(coalesce(floor(target / nullif(g.source_size, 0)), 0) + CASE WHEN draw <= coalesce(cut, -1) THEN 1 ELSE 0 END AS INTEGER) AS repeats
FROM docs d JOIN goal g ON d.source IS NOT DISTINCT FROM g.source LEFT JOIN cut c ON c.source IS NOT DISTINCT FROM g.source"""


@oracle("op9_topk")
def op9() -> str:
    return """
WITH vectors AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
queries AS (SELECT vec_id, min(v) AS v FROM vectors WHERE vec_id % 100 = 0 GROUP BY vec_id),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM queries q JOIN vectors c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 10"""


@oracle("op4_quality")
def op4() -> str:
    words = ", ".join(
        f"({sql_string(x)}, {i}, {sql_string(w)})" for x, listed in quality.COMMON_WORDS.items() for i, w in enumerate(dict.fromkeys(listed))
    )
    sizes = ", ".join(f"({sql_string(x)}, {len(dict.fromkeys(listed)) + 1})" for x, listed in quality.COMMON_WORDS.items())
    classes = (
        r"('[a-z]', 0), ('[A-Z]', 1), ('[\x00-\x09\x0B-\x20]', 2), ('\n', 3), ('[.,;:!?''\"\-()0-9]', 4), "
        r"('[\x7F]', 5), ('[#*$%&|<>=+~^_\\/@{}\[\]`]', 6), ('[\x{C0}-\x{27F}]', 7), ('[\x{80}-\x{BF}\x{280}-\x{10FFFF}]', 8)"
    )
    near_class = f"{quality.MAX_CLASS_DISTANCE} * {quality.MAX_CLASS_DISTANCE}"
    near_word = f"{quality.MAX_WORD_DISTANCE} * {quality.MAX_WORD_DISTANCE}"
    distance = """
  SELECT d.k, d.lang, sqrt(greatest(0, sum(
      CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2)) AS dist
  FROM (SELECT h.k, h.lang, h.n / sum(h.n) OVER (PARTITION BY h.k, h.lang) AS p, r.n / sum(r.n) OVER (PARTITION BY h.k, h.lang) AS q
        FROM {h} h JOIN {r} r ON r.lang = h.lang AND r.bin = h.bin) d GROUP BY d.k, d.lang"""
    verdict = f"""
  SELECT d.k, c.lang, CASE WHEN n_chars >= {quality.MIN_CHARS} THEN c.dist END AS dc, CASE WHEN n_words >= {quality.MIN_WORDS} THEN w.dist END AS dw,
    coalesce(c.dist * c.dist <= {near_class} + 2 * {len(quality.CLASSES) - 1} / (8 * n_chars * ln(2)) OR n_chars < {quality.MIN_CHARS}, true)
    AND coalesce(w.dist * w.dist <= {near_word} + 2 * (s.bins - 1) / (8 * n_words * ln(2)) OR n_words < {quality.MIN_WORDS}, true) AS near
  FROM docs d JOIN {{c}} c ON c.k = d.k JOIN {{w}} w ON w.k = d.k AND w.lang = c.lang JOIN sizes s ON s.lang = c.lang"""
    return rf"""
WITH lists(lang, bin, word) AS (VALUES {words}), sizes(lang, bins) AS (VALUES {sizes}),
forms AS (
  SELECT lang, form, min(bin) AS bin
  FROM (SELECT lang, bin, unnest([word || m, upper(word[1]) || word[2:] || m, upper(word) || m]) AS form
        FROM lists, (SELECT unnest(['', '.', ',', ';', ':', '!', '?']) AS m)) GROUP BY lang, form),
classes(pattern, bin) AS (VALUES {classes}),
docs AS (
  SELECT row_number() OVER () AS k, doc_id, lang, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n_words, length(coalesce(text, '')) AS n_chars
  FROM documents),
tokens AS (SELECT k, unnest(w) AS word, unnest(range(n_words)) AS pos FROM docs),
class_doc AS (SELECT k, bin, length(t) - length(regexp_replace(t, pattern, '', 'g')) AS n FROM docs, classes),
word_hits AS (SELECT t.k, f.lang, f.bin, count(*) AS n FROM tokens t JOIN forms f ON f.form = t.word GROUP BY ALL),
word_doc AS (
  SELECT d.k, g.lang, g.bin, coalesce(h.n, 0) AS n
  FROM docs d CROSS JOIN (SELECT lang, bin FROM lists GROUP BY ALL) g LEFT JOIN word_hits h ON h.k = d.k AND h.lang = g.lang AND h.bin = g.bin
  UNION ALL
  SELECT d.k, s.lang, s.bins - 1, d.n_words - coalesce((SELECT sum(n) FROM word_hits h WHERE h.k = d.k AND h.lang = s.lang), 0)
  FROM docs d CROSS JOIN sizes s),
windows AS (
  SELECT k, pos, word || ' ' || lead(word) OVER p || ' ' || lead(word, 2) OVER p AS win FROM tokens WINDOW p AS (PARTITION BY k ORDER BY pos)),
twice AS (SELECT k, pos FROM (SELECT k, pos, count(*) OVER (PARTITION BY k, win) AS n FROM windows WHERE win IS NOT NULL) WHERE n > 1),
covered AS (SELECT k, count(*) AS n FROM (SELECT DISTINCT k, pos + o AS p FROM twice, (SELECT unnest([0, 1, 2]) AS o)) GROUP BY k),
lines AS (
  SELECT k, count(*) - count(DISTINCT line) AS n
  FROM (SELECT k, unnest(string_split(t, chr(10))) AS line FROM docs) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY k),
base AS (
  SELECT d.k, d.doc_id, d.n_words, length(array_to_string(d.w, '')) AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(l.n, 0) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words
  FROM docs d LEFT JOIN lines l USING (k) LEFT JOIN covered c USING (k)),
good AS (SELECT k FROM base WHERE NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)),
class_first AS (SELECT d.lang, c.bin, sum(c.n) AS n FROM class_doc c JOIN docs d USING (k) JOIN good USING (k) JOIN sizes s ON s.lang = d.lang GROUP BY ALL),
word_first AS (SELECT d.lang, w.bin, sum(w.n) AS n FROM word_doc w JOIN docs d ON d.k = w.k AND d.lang = w.lang JOIN good g ON g.k = d.k GROUP BY ALL),
class_each AS (SELECT c.k, s.lang, c.bin, c.n FROM class_doc c CROSS JOIN sizes s),
c1 AS ({distance.format(h="class_each", r="class_first")}),
w1 AS ({distance.format(h="word_doc", r="word_first")}),
v1 AS ({verdict.format(c="c1", w="w1")}),
trusted AS (SELECT DISTINCT v.k FROM v1 v JOIN good USING (k) WHERE near),
class_ref AS (SELECT d.lang, c.bin, sum(c.n) AS n FROM class_doc c JOIN docs d USING (k) JOIN trusted USING (k) JOIN sizes s ON s.lang = d.lang GROUP BY ALL),
word_ref AS (SELECT d.lang, w.bin, sum(w.n) AS n FROM word_doc w JOIN docs d ON d.k = w.k AND d.lang = w.lang JOIN trusted t ON t.k = d.k GROUP BY ALL),
c2 AS ({distance.format(h="class_each", r="class_ref")}),
w2 AS ({distance.format(h="word_doc", r="word_ref")}),
v2 AS ({verdict.format(c="c2", w="w2")}),
verdicts AS (SELECT v.k, bool_or(near) AS near FROM v2 v JOIN docs d USING (k) WHERE d.lang IS NULL OR d.lang IN (SELECT lang FROM class_ref) GROUP BY v.k)

SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND coalesce(near, true) AS kept
FROM base LEFT JOIN verdicts USING (k)"""


@oracle("op12_collocations")
def op12() -> str:
    return r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
spoken AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM spoken GROUP BY lang),
places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM spoken WHERE len(w) > 0),
sizes(size) AS (VALUES (1), (2), (3), (4), (5)),
counted AS (
  SELECT lang, array_to_string(w[i : i + size - 1], ' ') AS phrase, size, count(*) AS f
  FROM places JOIN sizes ON i + size - 1 <= len(w) GROUP BY ALL HAVING count(*) >= 100),
cuts AS (
  SELECT lang, phrase, f AS a, string_split(phrase, ' ') AS w, unnest(range(1, size)) AS k FROM counted WHERE size > 1),
scored AS (
  SELECT c.lang, c.phrase, c.a, c.k, l.f AS l, r.f AS r, n,
         CAST((1000::HUGEINT * c.a * n) // (l.f::HUGEINT * r.f) AS BIGINT) AS score
  FROM cuts c JOIN totals USING (lang)
  JOIN counted l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1 : c.k], ' ')
  JOIN counted r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[c.k + 1 :], ' ')),
worst AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
kept AS (
  SELECT * FROM worst s WHERE NOT EXISTS (
    SELECT 1 FROM counted b
    WHERE b.lang = s.lang AND b.size > len(string_split(s.phrase, ' ')) AND contains(' ' || b.phrase || ' ', ' ' || s.phrase || ' ')
      AND 100 * b.f >= 100 * s.a)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000"""
