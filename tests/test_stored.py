"""Stored statistics: files that come, change and go."""

import os
import shutil

from lodestar.operators.stored import StoredCounts, totals


def put(spark, at, name, rows, when):
    """A single Parquet file of rows (v, m) under a name of its own."""
    spark.createDataFrame(rows, "v string, m double").coalesce(1).write.mode("overwrite").parquet(f"{at}-one")
    part = next(f for f in os.listdir(f"{at}-one") if f.endswith(".parquet"))
    os.makedirs(at, exist_ok=True)
    shutil.copy(f"{at}-one/{part}", f"{at}/{name}.parquet")
    os.utime(f"{at}/{name}.parquet", (when, when))


def test_only_files_that_changed_are_counted(spark, tmp_path):
    at, rows = str(tmp_path / "table"), {"a": [("x", 1.5), (None, 2.0)], "b": [("x", 1.0), ("y", 1.0), ("y", None)]}
    for i, (name, r) in enumerate(rows.items()):
        put(spark, at, name, r, 1_000_000 + i)
    stored = StoredCounts(spark, str(tmp_path / "stored"))
    refresh = lambda **kw: sorted(os.path.basename(f) for f in stored.refresh(at, ["v"], "m", **kw))
    got = lambda: {(r.column, r.value): (r.n, r.total and float(r.total)) for r in stored.values().collect()}
    assert refresh() == ["a.parquet", "b.parquet"]
    assert got() == {("", None): (5, 5.5), ("v", "x"): (2, 2.5), ("v", "y"): (2, 1.0), ("v", None): (1, 2.0)}
    assert {tuple(r) for r in totals(stored.values()).collect()} == {("", 5, 0), ("v", 4, 2)}
    assert refresh() == []
    put(spark, at, "c", [("z", 1.0)], 1_000_010)  # comes
    assert refresh() == ["c.parquet"] and got()["v", "z"] == (1, 1.0)
    put(spark, at, "b", [("w", 3.0)], 1_000_020)  # changes
    assert refresh() == ["b.parquet"]
    assert got() == {("", None): (4, 7.5), ("v", "x"): (1, 1.5), ("v", None): (1, 2.0), ("v", "z"): (1, 1.0), ("v", "w"): (1, 3.0)}
    os.remove(f"{at}/a.parquet")  # goes
    assert refresh() == [] and got() == {("", None): (2, 4.0), ("v", "z"): (1, 1.0), ("v", "w"): (1, 3.0)}
    again = StoredCounts(spark, str(tmp_path / "stored"))
    assert again.refresh(at, ["v"], "m") == [] and again.values().count() == 3
    assert len(refresh(version="2")) == 2 and got()["v", "w"] == (1, 3.0)
