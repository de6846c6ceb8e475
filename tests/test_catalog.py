"""All catalog queries against DuckDB on the smallest tables, and properties that hold for any data."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from lodestar.operators import facets, fusion
from lodestar.operators import predicates as P
from lodestar.plans import parsing
from lodestar.sources import sinks

AT = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{AT}/{t}.parquet'")
    return c


def value(v):
    return float(f"{v:.9g}") if isinstance(v, float) and not math.isnan(v) else v


@pytest.mark.parametrize("name", sorted(set(__spark_entry__._base()) & set(__spark_entry__.oracle_sql())))
def test_same_as_sql(spark, duck, name):
    df = __spark_entry__._base()[name](spark, AT)
    rel = duck.sql(__spark_entry__.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    got = sorted(repr([value(r[c]) for c in sorted(df.columns)]) for r in df.collect())
    rows = [dict(zip(rel.columns, r, strict=True)) for r in rel.fetchall()]
    assert got == sorted(repr([value(r[c]) for c in sorted(df.columns)]) for r in rows)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_facet_leaves_out_its_own_filter(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), (None, "x"), ("", "y")], "f string, g string")
    both = {"f": F.col("f") == "a", "g": F.col("g") == "x"}
    got = {(r.facet, r.value): r["count"] for r in facets.self_excluding(df, {"f": "f", "g": "g"}, both).collect()}
    assert got == {("f", "a"): 1, ("f", "b"): 1, ("g", "x"): 1, ("g", "y"): 1}


def test_null_behaviours_of_negative_filters(spark):
    df = spark.createDataFrame([("a",), ("b",), ("",), (None,)], "v string")
    rows = lambda p: {r.v for r in df.filter(p).collect()}
    assert rows(P.not_in("v", ["a"], keep_null=False)) == {"b", ""}
    assert rows(P.not_in("v", ["a"], keep_null=True)) == {"b", "", None}
    assert rows(P.not_like("v", ["A"])) == {"b", "", None}
    assert rows(P.present("v")) == {"a", "b"}
    assert rows(P.like_any("v", ["%"])) == set()


def test_fusion_never_merges_one_source(spark):
    df = spark.createDataFrame([("h", "a", 1), ("h", "a", 2), ("h", "b", 3), ("h", "c", 4), (None, "a", 5)], "h string, s string, i int")
    groups = fusion.merge_keys(df, "h", "s", "i").filter("group_no is not null").groupBy("h", "group_no").agg(F.count("*").alias("n"), F.countDistinct("s").alias("d")).collect()
    assert all(r.n == r.d for r in groups) and len(groups) == 2


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    assert {(r.node, r.label) for r in fusion.connected(edges).collect()} == {(i, 0) for i in range(41)} | {(100, 100), (101, 100)}


@pytest.mark.parametrize(
    ("sentence", "least", "years", "wanted", "unwanted"),
    [("open orders, at least 1.5k", 1500.0, (None, None), {"f": ["O"]}, {}), ("not open 2024+", None, (2024, None), {}, {"f": ["O"]}), ("排除open, in 2020", None, (2020, 2020), {}, {"f": ["O"]}), ("reopened", None, (None, None), {}, {})],
)
def test_rule_parser(sentence, least, years, wanted, unwanted):
    q = parsing.parse(sentence, {"f": {"open": ["O"]}}, {})
    assert (q.least, q.years, q.wanted, q.unwanted) == (least, years, wanted, unwanted)


def test_sinks_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a", "b"]), (2, [])], "i int, s array<string>")
    sinks.to_release(df, str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "r/parquet")).count() == 2
    assert {r.s for r in spark.read.option("header", True).csv(str(tmp_path / "r/csv")).collect()} == {"a; b", None}


@pytest.mark.parametrize("name", ["stream_dedup_late", "stream_sessions", "stream_tumbling"])
def test_streams_are_written_by_executors(spark, name):
    files = __spark_entry__.queries()[name](spark, AT).inputFiles()
    assert files and all(f.endswith(".parquet") and "/streams/" in f for f in files)
