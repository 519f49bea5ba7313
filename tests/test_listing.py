from datetime import datetime, timezone

import pytest
from helpers import put

from portage.sources import listing, manifest


def test_ranges_hold_every_name_once():
    page = [f"n{i:03d}" for i in range(100)] * 2
    ranges = listing.ranges_of(page, False, 4)
    assert len(ranges) == 4 and ranges[0].low is None and ranges[-1].high is None
    for name in ["", "a", *page, "zzz"]:
        assert sum((r.low is None or name >= r.low) and (r.high is None or name < r.high) for r in ranges) == 1
    assert len(listing.ranges_of(page, True, 4)) == 1
    assert len(listing.ranges_of(["same"] * 50, False, 4)) == 2  # one bound, as all names are alike


def test_pages_and_ranges_of_one_directory(spark, tmp_path):
    for i in range(1000):
        put(tmp_path / "d" / f"n{i:04d}.csv", "x" * (i % 7))
    put(tmp_path / "d" / "folder" / "inner.csv")
    listed = listing.list_names(spark, f"{tmp_path}/d", ranges=5, page=64)
    assert listed.rdd.getNumPartitions() == 5
    rows = listed.collect()
    assert sorted((r.name, r.length, r.is_directory) for r in rows) == sorted(
        [(f"n{i:04d}.csv", i % 7, False) for i in range(1000)] + [("folder", 0, True)])
    assert all(r.path == f"file:{tmp_path}/d/{r.name}" for r in rows)
    changed = datetime.fromtimestamp((tmp_path / "d" / "n0000.csv").stat().st_mtime, timezone.utc).replace(tzinfo=None)
    assert abs(min(r.modified for r in rows if r.name == "n0000.csv").timestamp() - changed.replace(tzinfo=timezone.utc).timestamp()) < 1
    assert listing.list_names(spark, f"{tmp_path}/d", prefix="n000").count() == 10
    assert listing.list_names(spark, f"{tmp_path}/nowhere").count() == 0


def test_newest_of_very_many_names(spark, tmp_path, monkeypatch):
    """No list of names is made in the driver; 100 000 names are several tasks' work."""
    for i in range(100_000):
        (tmp_path / f"e_{(i * 7919) % 100_000:08d}.csv").touch()
    for name in ("e_20241231.csv", "e_20250229.csv", "f_20990101.csv", "e_20990101.csv.bak"):
        (tmp_path / name).touch()
    monkeypatch.setattr(manifest.storage, "glob_names", lambda *_: pytest.fail("names in the driver"))
    assert manifest.child_names(spark, str(tmp_path), "e_").rdd.getNumPartitions() == listing.RANGES
    assert manifest.find_latest(spark, f"{tmp_path}/e_yyyymmdd.csv") == "e_20241231.csv"


def test_newest_where_arrow_cannot_list(spark, tmp_path, monkeypatch):
    for name in ("a_20240101.csv", "a_20240301.csv", "b_20250101.csv"):
        put(tmp_path / name, "k\n1\n")
    monkeypatch.setattr(listing, "SCHEMES", frozenset())
    assert manifest.find_latest(spark, f"{tmp_path}/a_yyyymmdd.csv") == "a_20240301.csv"
