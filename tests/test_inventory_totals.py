"""Download URLs of the source set and the totals over what is present."""

from marquee.sources import inventory as inv


def test_urls_and_destinations(spark):
    rows = {r["kind"]: r for r in inv.manifest(spark, "https://mirror.example/sets/", "/data/raw/").collect()}
    assert len(rows) == 5
    assert rows["titles"]["url"] == "https://mirror.example/sets/title.basics.tsv.gz"
    assert rows["names"]["destination"] == "/data/raw/name.basics.tsv.gz"


def test_total_bytes_of_present_files(spark, tmp_path):
    (tmp_path / "title.basics.tsv").write_bytes(b"x" * 100)
    (tmp_path / "title.ratings.tsv.gz").write_bytes(b"y" * 23)
    folder = tmp_path / "name.basics.tsv"
    folder.mkdir()
    (folder / "part-0").write_bytes(b"z" * 5)
    (folder / "part-1").write_bytes(b"z" * 6)
    (tmp_path / "other.tsv").write_bytes(b"not of the set")
    total = inv.inventory_totals(inv.source_inventory(spark, str(tmp_path))).first()
    assert (total["files_present"], total["files_missing"], total["total_bytes"]) == (3, 2, 134)
    inv.check_size_cap(inv.source_inventory(spark, str(tmp_path)), 100)
    over = inv.size_violations(inv.source_inventory(spark, str(tmp_path)), 99).collect()
    assert [(r["file_name"], r["length"]) for r in over] == [("title.basics.tsv.gz", 100)]
