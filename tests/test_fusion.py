"""Fusion across sources against a plain walk over the groups, and the plans of what goes with it."""

import random

import pytest
from pyspark.sql import functions as F

from lodestar.operators import fusion
from lodestar.plans import records
from lodestar.plans.binding import Replaced
from lodestar.plans.queries import closure


def walked(groups):
    """Each group (id, place, hash, sources) in order of place -> the record that it goes into."""
    merged, into = [], {}
    for g, _, h, sources in sorted(groups, key=lambda x: x[1]):
        for record in merged:
            if h and record[1] == h and not record[2] & set(sources):
                record[2].update(sources)
                into[g] = record[0]
                break
        else:
            merged.append((g, h, set(sources)))
            into[g] = g
    return into


@pytest.mark.parametrize("most", [1, 3])
def test_groups_of_one_hash_same_as_a_walk(spark, most):
    random.seed(most)
    groups = [(i, 1000 - 3 * i, random.choice(["a", "b", "c", "", None]), random.sample("uvwxyz", random.randint(1, most))) for i in range(300)]
    got = fusion.merged_by_hash(spark.createDataFrame(groups, "group long, place long, hash string, sources array<string>").repartition(5)).collect()
    assert {r.group: r.into for r in got} == walked(groups) and len(got) == len(groups)


def test_fused_same_as_a_walk(spark):
    random.seed(6)
    rows = [(i, random.choice("xyz"), random.choice(["h1", "h2", "", None])) for i in range(120)]
    links = [(random.randrange(150), random.randrange(150)) for _ in range(50)]  # some lead out of the results
    up = {i: i for i, *_ in rows}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        if a in up and b in up:
            a, b = sorted((root(a), root(b)))
            up[b] = a
    groups = {}
    for i, s, h in rows:
        groups.setdefault(root(i), []).append((i, s, h))
    table = [(g, min(m)[0], next((h for *_, h in m if h), None), {s for _, s, _ in m}) for g, m in groups.items()]
    into = walked(table)
    results = spark.createDataFrame(rows, "pk long, s string, h string")
    got = fusion.fused(results, spark.createDataFrame(links, "a long, b long"), "pk", "s", "h", "pk").collect()
    assert {r.pk: r.record for r in got} == {i: into[root(i)] for i, *_ in rows}
    one = fusion.fused(results.filter("s = 'x'"), spark.createDataFrame(links, "a long, b long"), "pk", "s", "h", "pk").collect()
    assert all(r.pk == r.record for r in one)
    assert fusion.fused(results.limit(0), spark.createDataFrame([], "a long, b long"), "pk", "s", "h", "pk").count() == 0


def test_closure_ends_at_a_cycle(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("d", "a")], "child string, parent string")
    got = sorted(map(tuple, closure(edges).collect()))
    assert got == sorted([(x, y) for x in "abc" for y in "abc"] + [("d", y) for y in "abc"])


def test_mirrors_name_a_few_and_count_all(spark):
    rows = [("k", "s", f"{i:02}") for i in range(30)] + [("k", "s", "00"), (None, "s", "x"), ("one", "s", "y")]
    x = fusion.mirrors(spark.createDataFrame(rows, "key string, s string, id string"), "key", "s", "id", 3)
    got = {(r.id, r.mirrors, r.n_mirrors) for r in x.collect()}
    assert ("00", "s/01,s/02,s/03", 29) in got and ("29", "s/00,s/01,s/02", 29) in got and ("x", "", 0) in got and ("y", "", 0) in got and x.count() == 33


def test_a_page_by_turns_keeps_a_page_of_each_source(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 7).alias("s"))
    x = fusion.round_robin(df, "s", "id", 20)
    assert [r.id for r in x.collect()] == list(range(20))
    assert "WindowGroupLimit" in x._jdf.queryExecution().executedPlan().toString()


def test_groups_of_one_hash_are_dealt_by_a_shuffle_of_their_own(spark):
    """The partitions of a join are not kept where it turns into a broadcast, so they are not enough for the walk."""
    random.seed(5)
    groups = [(i, i, random.choice("ab"), random.sample("uvwxyz", random.randint(1, 3))) for i in range(400)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = fusion.merged_by_hash(spark.createDataFrame(groups, "group long, place long, hash string, sources array<string>").repartition(5))
        assert "REPARTITION_BY_COL" in got._jdf.queryExecution().executedPlan().toString()
        assert {r.group: r.into for r in got.collect()} == walked(groups)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_mirrors_name_all(spark):
    rows = [(0, f"s{i:02}") for i in range(30)] + [(7, "x")]  # one study in 30 sources, and a sample
    d = spark.createDataFrame(rows, "doc_id long, source string").selectExpr("*", "1L as n_chars", "'en' as lang", "'x' as text")
    got = {(r.mirrors, r.n_mirrors) for r in records.mirrors(Replaced(spark, "", {"documents": d})).collect()}
    every = [f"s{i:02}/GSE0" for i in range(30)]
    assert got == {(",".join(n for n in every if n != own), 29) for own in every} | {("", 0)}
