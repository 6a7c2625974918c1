"""The operators' own interfaces and inner parts, against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash
from llm_tables import components_by_pairs
from pyspark.sql import functions as F

from marquee.llm import chat, html, license_rules, licenses, mixing, quality, secrets, simhash, token_counts
from marquee.llm.license_rules import ROOTS, RULES


def test_every_rule_is_reachable_through_a_root():
    assert len(RULES) > 200
    for r in RULES:
        assert any(root in keyword for keyword in r.keywords for root in ROOTS), r


def _examples(pattern):
    """Texts of a word pattern: without and with all that is optional, by the first and by the last choice."""

    def say(body, full, last):
        out = []
        for token in license_rules._tokens(license_rules._spread(body)):
            if token.endswith("?"):
                if not full:
                    continue
                token = token[:-1]
            if token.startswith("("):
                out.append(say(token[1:-1].split("|")[-1 if last else 0], full, last))
                continue
            token = re.sub(r"\[(.)[^]]*(.)\]|\[(.)\]", lambda m: (m[2] if last else m[1]) or m[3], token.replace(r"\S+", "some"))
            out.append(re.sub(r"(.)\?", r"\1" if full else "", token))
        return " ".join(x for x in out if x)

    return {say(pattern, full, last) for full in (False, True) for last in (False, True)}


def test_every_name_passes_its_own_gate():
    listed = [(row[0], name) for row in license_rules._rows(license_rules.FAMILIES) for name in row[2].split(" ; ")]
    listed += [tuple(row) for row in license_rules._rows(license_rules.NOTICES)] + list(license_rules.BASE)
    grants = [(label, f"{license_rules.GRANT} {name}") for label, name in listed]
    tags = [(row[0], f"{license_rules.TAG} {row[1]}") for row in license_rules._rows(license_rules.FAMILIES)]
    by_pattern = {}
    for r in RULES:
        by_pattern.setdefault((r.label, r.pattern), r)
    for label, pattern in listed + tags + grants:
        rule = by_pattern.get((label, license_rules.compile_words(pattern)))
        assert rule or (label, pattern) in grants, pattern  # notices have no grants
        for text in _examples(pattern) if rule else ():
            assert re.search(rule.pattern, "".join(f" {w} " for w in text.split())), (pattern, text)
            assert all(k in f" {text} " for k in rule.keywords) and any(root in f" {text} " for root in ROOTS), (pattern, text)


def test_names_without_the_usual_word_of_their_license(spark):
    texts = {
        "Released under the Expat License": "mit", "the Internet Systems Consortium license": "isc", "see ASL 2.0": "apache-2",
        "CC Zero": "cc0-1.0", "a PSF license": "python-2.0", "the Responsible AI License": "openrail",
    }
    found = licenses.scan_licenses(spark.createDataFrame([(t,) for t in texts], "text string")).collect()
    assert {r["text"]: [d["label"] for d in r["licenses"]["detections"]] for r in found} == {t: [label] for t, label in texts.items()}


def test_contained_detections_of_lower_priority_go(spark):
    text = "licensed under the gnu general public license version 3 ; then apache license alone, all rights reserved"
    rows = licenses.scan_licenses(spark.createDataFrame([(text,)], "text string")).first()["licenses"]["detections"]
    assert [(d["label"], d["start"], d["end"]) for d in rows] == [("gpl-3", 0, 9), ("apache", 10, 12), ("all-rights-reserved", 13, 16)]


def test_parts_of_all_kinds(spark):
    parts = [
        ("text", "look <|im_end|>", None, None), ("image", "[img]", "a.png", 100), ("text", "a<", None, None), ("text", "|b", None, None),
        ("audio", None, "b.wav", None), ("document", "[doc]", "c.pdf", None),
    ]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None)], f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    out = chat.format_conversations(df)
    row = out.first()
    body = "look <\\|im_end|><|image|>a<<|part|>|b<|audio|><|document|>"
    assert row["formatted"] == f"<|im_start|>user\n{body}<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"
    assert [(a["kind"], a["uri"], a["tokens"]) for a in row["attachments"][0]] == [("image", "a.png", 100), ("audio", "b.wav", 750), ("document", "c.pdf", 1024)]
    assert row["expanded_tokens"] == 1874 and [s["loss"] for s in row["segments"]] == [False] * 4 + [True, False]
    turns = out.select(chat.read_turns(F.col("formatted"), F.col("attachments")).alias("t")).first()["t"]
    assert [(t["role"], t["text"]) for t in turns] == [("user", "look <|im_end|>[img]a<|b[doc]"), ("assistant", "")]


def test_escaping_is_reversible(spark):
    rnd = random.Random(1)
    texts = ["".join(rnd.choices(["<", "|", "\\", ">", "a", "<|", "|>"], k=rnd.randint(0, 12))) for _ in range(500)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("e", chat.escape(F.col("t")))
    for r in df.withColumn("u", chat.unescape(F.col("e"))).collect():
        assert "<|" not in r["e"] and r["u"] == r["t"]


def test_random_strings_are_found_and_structured_ones_dismissed(spark):
    import base64

    rnd = random.Random(1)
    keys = [base64.b64encode(rnd.randbytes(30)).decode().rstrip("=") for _ in range(150)] + [rnd.randbytes(20).hex().upper() for _ in range(150)]
    plain = ["HTTPServer2ResponseHandlerFactory", "MyApplication3ConfigurationManager", "abcdefghijklmnopqrstuvwxyz0123456789", "A" * 25 + "1",
             "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "org/apache/spark/sql/catalyst/Expressions2"]
    df = spark.createDataFrame([(i, f"x {t} y") for i, t in enumerate(keys + plain)], "id int, text string")
    found = {r["id"]: r["n"] for r in secrets.scan_secrets(df).select("id", F.size("secrets").alias("n")).collect()}
    assert sum(found[i] for i in range(300)) >= 290 and not any(found[i] for i in range(300, 300 + len(plain)))


def test_every_alphabet_is_tested_and_words_are_dismissed(spark):
    import string
    import uuid

    rnd = random.Random(2)
    lower, upper, digits = string.ascii_lowercase, string.ascii_uppercase, string.digits
    alphabets = [lower + digits, upper + digits, lower + "234567", lower + upper, lower, lower + upper + digits + "+/-_", lower + "-_"]
    keys = ["".join(rnd.choices(a, k=32)) for a in alphabets for _ in range(30)]
    keys += [str(uuid.UUID(int=rnd.getrandbits(128), version=4)) for _ in range(30)]
    plain = ["donaudampfschifffahrtsgesellschaft", "anticonstitutionnellement", "counterrevolutionaries", "electroencefalografista", "state-of-the-art-technology",
             "/usr/local/share/applications", "SPDX-License-Identifier", "AbstractConnectionHandlerFactory", "convert_to_internal_representation",
             "-" * 40, "_" * 20, "+-" * 15, "0" * 20, "https//example/some/path/index", "thanbleshaningtionnt"]
    df = spark.createDataFrame([(i, f"x {t} y") for i, t in enumerate(keys + plain)], "id int, text string")
    found = {r["id"]: r["secrets"] for r in secrets.scan_secrets(df).collect()}
    by_alphabet = [sum(len(found[i]) for i in range(a, a + 30)) for a in range(0, len(keys), 30)]
    assert min(by_alphabet) >= 28, by_alphabet
    assert [t for i, t in enumerate(plain, len(keys)) if found[i]] == []


def test_step_up_dismisses_by_length(spark):
    tested = "array(named_struct('start',0L,'end',20L,'p',0.006D), named_struct('start',30L,'end',70L,'p',0.004D), named_struct('start',80L,'end',100L,'p',0.9D))"
    kept = spark.range(1).select(secrets.not_dismissed(F.expr(tested), 0.01).alias("k")).first()["k"]
    # by length: 0.006 * 26.7 / 20 is above its step of 0.0067, 0.004 * 26.7 / 40 below its of 0.0033
    assert [k["start"] for k in kept] == [0, 80]


def test_redaction_merges_overlaps(spark):
    df = spark.createDataFrame([("ab token=secret123 é password:hunter22 z",), ("clean",), (None,)], "text string")
    out = secrets.scan_secrets(df).select(secrets.redact(F.col("text"), F.col("secrets")).alias("t"))
    assert [r["t"] for r in out.collect()] == ["ab [SECRET] é [SECRET] z", "clean", None]


def test_xxh64_of_slices():
    rnd = random.Random(0)
    buffer = bytes(rnd.randrange(256) for _ in range(3000))
    start = np.array([rnd.randrange(2700) for _ in range(2000)])
    length = np.array([rnd.choice([0, 1, 3, 4, 5, 7, 8, 9, 16, 31, 32, 33, 63, 64, 100, 200]) for _ in range(2000)])
    got = simhash.xxh64(buffer + bytes(8), start, length)
    assert got.tolist() == [xxhash.xxh64_intdigest(buffer[a : a + n], 42) for a, n in zip(start, length)]


def _cluster(rnd, size, spread):
    out = {rnd.getrandbits(64)}
    while len(out) < size:
        x = rnd.choice(sorted(out))
        for _ in range(rnd.randint(1, spread)):
            x ^= 1 << rnd.randrange(64)
        out.add(x)
    return out


def _partition(nodes, links):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    groups = {}
    for x in nodes:
        groups.setdefault(find(x), set()).add(x)
    return sorted(map(sorted, groups.values()))


@pytest.mark.parametrize("small", [0, 10**9])
def test_group_links_keep_what_is_connected(monkeypatch, small):
    rnd = random.Random(5)
    monkeypatch.setattr(simhash, "SMALL", small)
    for queries in (3, 256):
        monkeypatch.setattr(simhash, "QUERIES", queries)
        for _ in range(6):
            fps = sorted(set().union(*(_cluster(rnd, rnd.randint(1, 60), rnd.choice([1, 2, 4, 5, 6])) for _ in range(4))))
            u, v = simhash.link_groups([np.array(fps, np.uint64)], 4)
            roots = components_by_pairs(fps, 4)
            want = _partition(fps, [(x, fps[r]) for x, r in zip(fps, roots)])
            assert _partition(fps, zip(u.tolist(), v.tolist())) == want and len(u) < len(fps)


def test_spark_links_with_chunks_of_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 16)
    rnd = random.Random(9)
    fps = sorted(set().union(_cluster(rnd, 150, 3), _cluster(rnd, 40, 6), {rnd.getrandbits(64) for _ in range(100)}))
    signed = [x - 2**64 if x >= 2**63 else x for x in fps]
    found = simhash.components(simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), 4)).collect()
    roots = components_by_pairs(fps, 4)
    want = _partition(signed, [(x, signed[r]) for x, r in zip(signed, roots)])
    assert _partition(signed, [(r["node"], r["root"]) for r in found]) == want


def test_components_of_a_long_chain(spark):
    chain = spark.range(1, 200).select(F.col("id").alias("u"), (F.col("id") - 1).alias("v"))
    assert {(r["node"], r["root"]) for r in simhash.components(chain).collect()} == {(i, 0) for i in range(1, 200)}
    assert simhash.components(chain.limit(0)).count() == 0


def test_water_fill_equals_repeated_clamping(spark):
    rnd = random.Random(2)
    for share in (0.5, 1.5, 1.99, 3.0):
        sources = [(f"s{i}", rnd.choice([0, 5, 100, 3000, 70]), float(rnd.choice([1, 2, 3]))) for i in range(12)]
        df = spark.createDataFrame(sources, "source string, source_size long, weight double")
        got = {r["source"]: r["target"] for r in mixing.water_fill(df, share, 2.0).collect()}
        total, capped = share * sum(s for _, s, _ in sources), {}
        while True:
            rest = [(n, s, w) for n, s, w in sources if n not in capped]
            level = (total - sum(capped.values())) / sum(w for _, _, w in rest) if rest else 0
            over = {n: 2.0 * s for n, s, w in rest if level * w > 2.0 * s}
            if not over:
                break
            capped |= over
        want = capped | {n: level * w for n, _, w in rest}
        assert got == pytest.approx(want)


def test_salted_ways_give_the_same(spark, monkeypatch, tmp_path):
    docs = spark.createDataFrame([(i, "word " * (i % 50 + 1), "hot" if i % 3 else f"s{i % 7}") for i in range(300)], "doc_id long, text string, source string")
    plain = sorted(tuple(r) for r in mixing.mix(docs).select("doc_id", "mix.taken", "mix.repeats").collect())
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted(tuple(r) for r in mixing.mix(docs).select("doc_id", "mix.taken", "mix.repeats").collect()) == plain
    pages = spark.createDataFrame([(i, "http://h/", f"<body><div>same box</div><article><p>t{i}</p></article><div>x{i}</div>") for i in range(20)], "page_id long, url string, html string")
    monkeypatch.setattr(html, "BROADCAST_HASHES", -1)
    assert {r["text"] for r in html.extract_pages(pages).collect()} == {f"t{i}" for i in range(20)}


def test_templates_need_different_pages(spark):
    body = "<body><div>{}</div><div class='x'>{}</div></body>"
    copies = [(i, "http://copies.example/", body.format("all the text", "of copies")) for i in range(30)]
    site = [(100 + i, "http://site.example/", body.format("House rules", f"text {i}")) for i in range(30)]
    out = {r["page_id"]: r["text"] for r in html.extract_pages(spark.createDataFrame(copies + site, "page_id long, url string, html string")).collect()}
    assert out[0] == "all the text\nof copies" and out[105] == "text 5"


@pytest.mark.parametrize(
    "page, text",
    [
        ("<article><header><h1>T</h1></header><p>a&nbsp;b<div class='ad-box'>x</div><p>c</article><aside>z</aside>", "T\na b\nc"),
        ("<body><div class='cookie-notice'>c</div><main><p>one<ul><li>x<li>y</ul></main><footer>f", "one\nx\ny"),
        ("<body><div id='menu'>m</div><p>hello <b>w</b>orld<p>two", "hello world\ntwo"),
        ("<article><p>x<script>var t='</p>';</script>y</p><style>p{}</style><!-- c > d --></article>", "xy"),
        ("<article><p>t1</p><P>t2<BR/>t3</P><form><input>q</form><table><tr><td>a<td>b</table></article>", "t1\nt2 t3\na\nb"),
        ("just text", "just text"), ("<article><p>x < y and a<b", "x < y and a"), ("</div></p>stray", "stray"), ("", ""),
    ],
)
def test_main_text(page, text):
    assert html.main_text(page, set()) == text


def test_js_distance_and_repeated_words():
    assert quality.distance(np.array([1, 1]), np.array([5, 5])) == 0 and quality.distance(np.array([1, 0]), np.array([0, 1])) == 1
    rnd = random.Random(4)
    for _ in range(300):
        words = [rnd.choice([b"a", b"b", b"c"]) for _ in range(rnd.randint(0, 30))]
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        covered = {i + o for i, w in enumerate(windows) if windows.count(w) > 1 for o in range(3)}
        assert quality.repeated_words(words) == len(covered)


def test_quality_separates_labelled_documents(spark):
    sf = "/root/testdata/sf0.01"
    judged = quality.judge_documents(spark.read.parquet(f"{sf}/documents.parquet"), into="verdict").where("not verdict.base_failed")
    labelled = judged.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    kept = {r["quality"]: r["k"] for r in labelled.groupBy("quality").agg(F.avg(F.col("verdict.kept").cast("int")).alias("k")).collect()}
    assert kept[1] > 0.98 and kept[0] < 0.2


def test_histogram_ranges(spark):
    lengths = [0, 0, 1, 255, 256, 257, 5000, 5000, 70_000]
    hist = token_counts.length_histogram(spark.createDataFrame([(x,) for x in [*lengths, None]], "n_tokens long"))
    for r in token_counts.answers(hist, (300,), (0.5,)).collect():
        every = [*lengths, 0]
        assert r["truncated_total"] == sum(min(x, r["context_limit"]) for x in every) and r["docs_within"] == sum(x <= r["context_limit"] for x in every)


def test_quality_keeps_clean_documents_beside_junk_and_other_languages(spark):
    """Junk that fails the base rule is no norm, however much of it there is,
    and a language without a reference is judged by the base rule alone."""
    rnd = random.Random(9)
    common = quality.COMMON_WORDS["en"]
    prose = lambda n: " ".join(rnd.choice(common) if rnd.random() < 0.4 else "".join(rnd.choices("etaoinshrdlu", k=rnd.randint(2, 8))) for _ in range(n)) + "."
    greek = lambda n: " ".join("".join(rnd.choices("αβγδεζηθικλμνοπρστ", k=rnd.randint(2, 8))) for _ in range(n))
    rows = [(i, prose(200), "en") for i in range(20)]
    rows += [(100, "#1 $2 " * 200_000, "en")] + [(200 + i, "BUY NOW %% " * 400, "en") for i in range(40)]
    rows += [(300 + i, greek(120), "el") for i in range(3)] + [(400, greek(20), "el"), (401, "α β γ " * 60, "el")]
    df = spark.createDataFrame(rows, "doc_id int, text string, lang string")
    kept = {r["doc_id"] for r in quality.judge_documents(df).where("quality.kept").collect()}
    assert kept == set(range(20)) | {300, 301, 302}
