"""Quoted CSV at any number of splits, and digests of any bytes."""

import csv
import gzip
import hashlib
import io
import os
import random

import pytest

from marquee.sources import digest as dg
from marquee.sources import split_csv as sc


@pytest.fixture
def small_splits(spark):
    """A file of n bytes in about n / size splits."""
    keys = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum"]
    old = {k: spark.conf.get(k, None) for k in keys}

    def use(size):
        spark.conf.set(keys[0], str(size))
        spark.conf.set(keys[1], "1")
        spark.conf.set(keys[2], "1")

    yield use
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def awkward_table(seed, rows=300):
    rnd = random.Random(seed)
    parts = ["a", "bc", "\n", "\n\n", '"', '""', ",", "é", " ", "x" * 50, "\t", "', '", "[", "tt1"]
    cell = lambda: "".join(rnd.choice(parts) for _ in range(rnd.randint(1, 6)))
    return [[f"r{i}", cell() if rnd.random() < 0.5 else "plain", cell() if rnd.random() < 0.2 else str(i)] for i in range(rows)]


def write_csv(path, table, header=("id", "a b", "c`d"), line="\n"):
    out = io.StringIO()
    writer = csv.writer(out, lineterminator=line, quoting=csv.QUOTE_MINIMAL)
    writer.writerow(header)
    writer.writerows(table)
    data = out.getvalue().encode()
    path.write_bytes(data)
    return len(data)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_same_rows_at_1_and_16_and_many_splits(spark, tmp_path, small_splits, seed):
    table = awkward_table(seed)
    size = write_csv(tmp_path / "t.csv", table)
    want = sorted(tuple(r) for r in table)
    for splits in (1, 16, 200):
        small_splits(size // splits + 1)
        found = sc.read_csv(spark, str(tmp_path / "t.csv"), ["id", "a b", "c`d"])
        assert found.columns == ["id", "a b", "c`d"]
        assert sorted(tuple(r) for r in found.collect()) == want, splits
        blocks = sc.csv_records(spark, str(tmp_path / "t.csv")).select("block").distinct().count()
        assert (blocks == 1) if splits == 1 else (blocks >= splits / 4)


def test_equals_the_whole_file_reader(spark, tmp_path, small_splits):
    for i in range(3):
        write_csv(tmp_path / f"part-{i}.csv", awkward_table(10 + i, 100))
    small_splits(1500)
    whole = spark.read.options(header=True, quote='"', escape='"', multiLine=True).csv(str(tmp_path))
    assert sorted(map(repr, sc.read_csv(spark, str(tmp_path), whole.columns).collect())) == sorted(map(repr, whole.collect()))


def test_one_cell_over_many_splits(spark, tmp_path, small_splits):
    """A cell longer than several splits, right after the header."""
    table = [["big", "\n".join(f"line {i}, \"q\"" for i in range(2000)), "z"], ["end", "x", "y"]]
    size = write_csv(tmp_path / "t.csv", table)
    small_splits(size // 20)
    assert sorted(tuple(r) for r in sc.read_csv(spark, str(tmp_path / "t.csv"), ["i", "a", "c"]).collect()) == sorted(map(tuple, table))


def test_line_ends_empty_cells_and_empty_files(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b'h1,h2\r\n1,"x\r\ny"\r\n\r\n2,\r\n3,""\r\n4')
    (tmp_path / "b.csv").write_bytes(b"")
    (tmp_path / "c.csv").write_bytes(b"h1,h2\n")
    found = sorted(map(tuple, sc.read_csv(spark, str(tmp_path), ["h1", "h2"]).collect()))
    assert [f[0] for f in found] == ["1", "2", "3", "4"] and found[0][1] == "x\r\ny" and found[1][1] is None and found[3][1] is None
    assert sc.read_csv(spark, str(tmp_path / "b.csv"), ["h1"]).collect() == []
    assert sc.read_csv(spark, str(tmp_path / "c.csv"), ["h1"], header=False).count() == 1


FILES = {
    "one.csv": b"x", "line.csv": b"x\n", "feeds.bin": b"\n\n\n", "mark.csv": b"\xef\xbb\xbfa,b\n1,2\n", "mark_only.csv": b"\xef\xbb\xbf",
    "mark_open.csv": b"\xef\xbb\xbfa", "crlf.tsv": b"a\r\nb\r\n", "noise.bin": random.Random(1).randbytes(300_000), "long line.txt": b"y" * 3_000_000,
    "packed.tsv.gz": gzip.compress(b"a\tb\n" * 1000, mtime=0), "many.txt": b"".join(b"line %d\n" % i for i in range(200_000)),
}


def test_digests_of_any_bytes(spark, tmp_path, small_splits):
    for name, data in FILES.items():
        (tmp_path / name).write_bytes(data)
    (tmp_path / "empty.csv").write_bytes(b"")
    small_splits(64 * 1024)
    rows = {os.path.basename(r["source_path"]): r for r in dg.file_digests(spark, str(tmp_path)).collect()}
    assert set(rows) == set(FILES)
    for name, data in FILES.items():
        assert (rows[name]["source_size"], rows[name]["source_sha256"]) == (len(data), hashlib.sha256(data).hexdigest()), name
    one = dg.file_digests(spark, str(tmp_path / "many.txt")).collect()
    assert len(one) == 1 and one[0]["source_sha256"] == rows["many.txt"]["source_sha256"]


def test_running_digest_holds_no_file():
    state = dg.RunningDigest()
    plain = hashlib.sha256()
    for i in range(300):
        state.update(b"%d" % i * 1000)
        plain.update((b"\n" if i else b"") + b"%d" % i * 1000)
    size = sum(len(b"%d" % i) * 1000 for i in range(300)) + 299
    assert state.hexdigest(size) == plain.hexdigest()
    with pytest.raises(ValueError, match="changed while it was read"):
        state.hexdigest(size + 2)


def test_row_numbers_follow_the_records_of_split_files(spark, tmp_path, small_splits):
    from marquee.operators.index import prepare_catalog
    from marquee.sources.curated_io import read_curated_csv

    rows = [[f"t{i}", "two\nlines" if i % 3 else "one", "['Drama']", "8.0", "['P']"] for i in range(120)]
    size = write_csv(tmp_path / "c.csv", rows, ("title", "director", "genres", "score", "actors"))
    for splits in (1, 9):
        small_splits(size // splits + 1)
        got = {r["raw_title"]: r["tconst"] for r in prepare_catalog(read_curated_csv(spark, str(tmp_path))).collect()}
        assert got == {f"t{i}": f"row:{i + 1}" for i in range(120)}


def test_place_is_shown_only_where_a_row_has_no_id(spark, tmp_path, small_splits):
    from marquee.operators.index import prepare_catalog
    from marquee.sources.curated_io import read_curated_csv

    head = ("tconst", "title", "director", "genres", "score", "actors")
    rows = [[f"tt{i}", f"t{i}", "two\nlines" if i % 3 else "one", "['Drama']", "8.0", "['P']"] for i in range(60)]
    size = write_csv(tmp_path / "c.csv", rows, head)
    small_splits(size // 5 + 1)
    assert read_curated_csv(spark, str(tmp_path)).columns == list(head)
    rows[50][0] = ""
    write_csv(tmp_path / "c.csv", rows, head)
    got = {r["raw_title"]: r["tconst"] for r in prepare_catalog(read_curated_csv(spark, str(tmp_path))).collect()}
    assert got == {f"t{i}": "row:51" if i == 50 else f"tt{i}" for i in range(60)}
