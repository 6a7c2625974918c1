"""Secret and license scans: an independent battery, and time against size."""

import base64
import math
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from llm_tables import base_secrets
from marquee.llm import common, licenses, secrets


def two_sided(z):
    return math.erfc(abs(z) / math.sqrt(2))


def alphabet_of(token):
    for _, consists, contains, letters in secrets.ENCODINGS:
        if re.search(consists, token) and all(re.search(c, token) for c in contains):
            return letters
    return "".join(letters for occurs, letters in secrets.PARTS if re.search(occurs, token))


def p_value(token):
    letters = alphabet_of(token)
    folded = token.lower() if letters.startswith("0123456789abcdef") else token
    x, k, n = [letters.index(c) for c in folded], len(letters), len(token)
    chi = sum(x.count(s) ** 2 for s in range(k)) * k / n - n
    spread = 2 / (9 * (k - 1))
    ps = [two_sided(((chi / (k - 1)) ** (1 / 3) - (1 - spread)) / math.sqrt(spread))] if k > 1 else [0.0]
    upper = sum(v >= k / 2 for v in x)
    runs = 1 + sum((a >= k / 2) != (b >= k / 2) for a, b in zip(x, x[1:]))
    mean = 2 * upper * (n - upper) / n + 1
    variance = (mean - 1) * (mean - 2) / (n - 1)
    ps.append(two_sided((runs - mean) / math.sqrt(variance)) if variance > 0 else 0.0)
    average = sum(x) / n
    squares = sum((v - average) ** 2 for v in x)
    cross = sum((a - average) * (b - average) for a, b in zip(x, x[1:]))
    ps.append(two_sided((cross / squares + 1 / n) * math.sqrt(n)) if squares > 0 else 0.0)
    low = token.lower()
    pairs = [low[i : i + 2] for i in range(n - 1) if re.fullmatch("[a-z]{2}", low[i : i + 2])]
    if k > 17 and len(pairs) >= secrets.MIN_PAIRS:
        share = len(secrets.PAIRS) / 26**2
        both = sum(p[1] == q[0] for p in secrets.PAIRS for q in secrets.PAIRS) / 26**3
        unit = share * (1 - share) + 2 * (both - share**2)
        z = (sum(p in secrets.PAIRS for p in pairs) - 0.5 - len(pairs) * share) / math.sqrt(len(pairs) * unit)
        ps.append(two_sided(z) / 2 if z > 0 else 1.0)
    return min(1.0, len(ps) * min(ps))


def random_spans(text, fdr=0.01):
    """(start, end) of the candidates that the weighted step-up lets stand,
    and how near the closest decision was."""
    signed = base_secrets(text)
    found = [m for m in re.finditer(secrets.CANDIDATE, text) if not any(a <= m.start() and b >= m.end() for a, _, _, b in signed)]
    if not found:
        return [], 1.0
    mean = sum(len(m[0]) for m in found) / len(found)
    weighted = [p_value(m[0]) * mean / len(m[0]) for m in found]
    ranked = sorted(weighted)
    passed = [q for i, q in enumerate(ranked) if q <= fdr * (i + 1) / len(found)]
    limit = max(passed, default=-1.0)
    margin = min(abs(q - fdr * (i + 1) / len(found)) for i, q in enumerate(ranked))
    return [(m.start(), m.end()) for m, q in zip(found, weighted) if q > limit], margin


def test_battery_and_step_up_equal_an_independent_version(spark):
    rnd = random.Random(12)
    words = ["HTTPServer2ResponseHandlerFactory", "convert_to_internal_representation", "donaudampfschifffahrtsgesellschaft", "a" * 30, "ab" * 15, "0123456789" * 3]

    def token():
        kind = rnd.randrange(6)
        n = rnd.randint(20, 60)
        alphabet = ["0123456789abcdefg", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "abcdefghijklmnopqrstuvwxyz", "abcXYZ019+/", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789-_"]
        return rnd.choice(words) if kind == 5 else "".join(rnd.choices(alphabet[kind], k=n))

    texts = [" é ".join(token() for _ in range(rnd.randint(1, 12))) + (" password=" + token() if rnd.random() < 0.2 else "") for _ in range(150)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    rows = {r["id"]: [(s["start"], s["end"]) for s in r["secrets"] if s["kind"] == "random"] for r in secrets.scan_secrets(df).collect()}
    clear = 0
    for i, text in enumerate(texts):
        want, margin = random_spans(text)
        if margin > 1e-5:  # the fitted tail is good to 2e-7
            clear += 1
            assert rows[i] == want, text
    assert clear >= 140 and any(rows.values()) and any(len(rows[i]) < len(re.findall(secrets.CANDIDATE, t)) for i, t in enumerate(texts))


def test_running_sums_over_many_slices(spark):
    rnd = random.Random(3)
    for n in (0, 1, 255, 256, 257, 1500):
        values = [rnd.randrange(1000) for _ in range(n)]
        row = spark.createDataFrame([(values,)], "v array<bigint>").select(
            common.running(F.col("v"), lambda a, b: a + b).alias("sum"), common.running(F.col("v"), F.greatest).alias("max")
        ).first()
        sums, most = [], []
        for v in values:
            sums.append((sums[-1] if sums else 0) + v)
            most.append(max(most[-1] if most else 0, v))
        assert (row["sum"], row["max"]) == (sums, most)


def test_spans_and_redaction_of_many_matches(spark):
    rnd = random.Random(5)
    text = "".join(rnd.choice(["password=abcdefg12 ", "é x ", "token:secret=zzzzzz9 ", "0123456789abcdef01234567 ", "plain "]) for _ in range(3000))
    row = secrets.scan_secrets(spark.createDataFrame([(text,)], "text string")).select("secrets", secrets.redact(F.col("text"), F.col("secrets")).alias("t")).first()
    found = base_secrets(text)
    assert [(s["start"], s["end"], s["kind"]) for s in row["secrets"]] == [(a, b, k) for a, _, k, b in found]
    out, last = "", 0
    for a, _, _, b in found:
        if a >= last:
            out += text[last:a] + "[SECRET]"
        last = max(last, b)
    assert row["t"] == out + text[last:]


def test_taken_names_are_lengthened(spark):
    df = spark.createDataFrame([("MIT License token=abcdef1", 1, 2)], "text string, secrets int, licenses int")
    scanned = licenses.scan_licenses(secrets.scan_secrets(df))
    row = scanned.first()
    assert (row["secrets"], row["licenses"], len(row["secrets_"]), scanned.columns[-1]) == (1, 2, 1, "licenses_")


@pytest.mark.parametrize("kind", ["base64 lines", "assignments", "base phrases", "detections"])
def test_time_is_linear_in_matches(spark, kind):
    rnd = random.Random(1)
    line = {
        "base64 lines": lambda: base64.b64encode(rnd.randbytes(45)).decode() + "\n", "assignments": lambda: 'password="abcdefgh" ',
        "base phrases": lambda: "under the mit license ", "detections": lambda: "SPDX-License-Identifier: GPL-2.0-or-later\n",
    }[kind]

    def seconds(n):
        df = spark.createDataFrame([("".join(line() for _ in range(n)),)], "text string")
        if kind in ("base64 lines", "assignments"):
            out = secrets.scan_secrets(df).select(F.length(secrets.redact(F.col("text"), F.col("secrets"))))
        else:
            out = licenses.scan_licenses(df).select(F.size("licenses.base") + F.size("licenses.detections"))
        begin = time.perf_counter()
        assert out.first()[0]
        return time.perf_counter() - begin

    seconds(50)
    small, large = seconds(2500), seconds(10_000)
    assert large < 8 * small + 5, (small, large)
