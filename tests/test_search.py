"""The q-gram join and the text index against brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lodestar.operators import substrings, textindex
from lodestar.operators.textindex import TextIndex, prefix_ranked
from lodestar.plans import discovery, search  # noqa: F401
from lodestar.plans.queries import QUERIES

TEXTS = {1: "The quick brown fox.", 2: "the QUICK-brown, quick brown dog", 3: "brown quick the", 4: None, 5: "", 6: "fox the quick the quick brown fox", 7: "Émile été 123 fox_trot"}


def words(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


def test_contained_same_as_brute_force(spark):
    random.seed(8)
    make = lambda n: "".join(random.choices("abAB é%_", k=n))
    values = list({make(random.randint(0, 12)) for _ in range(400)}) + [None]
    asked = list({make(random.randint(0, 6)) for _ in range(200)}) + ["aaaa", None]
    got = substrings.contained(spark.createDataFrame([(t,) for t in asked], "term string"), spark.createDataFrame([(v,) for v in values], "value string"))
    want = {(t, v) for t in asked if t for v in values if v is not None and t.lower() in v.lower()}
    rows = [(r.term, r.value) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want)
    empty = spark.createDataFrame([], "term string")
    assert substrings.contained(empty, empty.toDF("value")).count() == 0


def test_guard_and_folding(spark):
    asked = {"widget": True, "WIDGET": False, "RED BOLT": True, "bolt": False, " abc  ": False, "12345": False, "Pbmcs": True, None: False}
    df = spark.createDataFrame([(t,) for t in asked], "t string")
    assert {r.t: r.s for r in df.select("t", substrings.safe(F.col("t")).alias("s")).collect()} == asked
    x = spark.createDataFrame([("q", "Liver", 3), ("q", "LIVER", 7), ("q", "liver", 7), ("q", "lung", 1)], "term string, value string, n long")
    assert {tuple(r) for r in substrings.folded(x, ["term"]).collect()} == {("q", "LIVER", 7), ("q", "lung", 1)}


def test_direct_values_are_the_most_frequent(spark):
    values = spark.createDataFrame([(f"value {i:02}", 30 - i) for i in range(30)] + [("other", 99)], "value string, n long")
    got = [tuple(r) for r in substrings.direct_values(spark.createDataFrame([("value",), ("valuE 0",)], "term string"), values).collect()]
    assert sorted(r for r in got if r[0] == "value") == [("value", f"value {i:02}", 30 - i) for i in range(20)]
    assert len([r for r in got if r[0] == "valuE 0"]) == 10


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    x = TextIndex(spark, str(tmp_path_factory.mktemp("index")))
    rows = spark.createDataFrame(list(TEXTS.items()), "id long, t string")
    x.add(rows.filter("id < 3"), "id", "t")
    x.add(rows.filter("id >= 3"), "id", "t")
    return x


def starts(phrase):
    found = {}
    for k, t in TEXTS.items():
        w = words(t)
        at = [i for i in range(len(w)) if w[i : i + len(phrase)] == phrase]
        if at and phrase:
            found[k] = at
    return found


@pytest.mark.parametrize("phrase", ["quick brown", "the quick", "the quick the", "fox", "brown quick brown", "été 123", "no such", "the the", ""])
def test_phrases_same_as_brute_force(index, phrase):
    assert {r.pk: sorted(r.starts) for r in index.phrase(words(phrase)).collect()} == starts(words(phrase))


def test_table_of_phrases(spark, index):
    asked = ["quick brown", "the quick the", "fox", "no such", "", "the quick brown fox"]
    got = index.phrases(spark.createDataFrame(list(enumerate(asked)), "id long, p string"), "id", "p").collect()
    assert sorted(map(tuple, got)) == sorted((i, k) for i, p in enumerate(asked) for k in starts(words(p)))


def test_phrases_in_texts_and_in_the_index(spark, index):
    asked = [(0, "quick brown"), (0, "fox"), (1, "quick brown"), (1, "quick brown"), (2, "the quick the quick"), (3, "the QUICK the"), (4, "no quick"), (5, "quick no"), (6, " "), (7, None), (8, "quick the"), (9, "123 fox trot")]
    want = sorted((i, k) for i, p in asked for k in starts(words(p)))
    q = spark.createDataFrame(asked, "id long, p string")
    texts = spark.createDataFrame(list(TEXTS.items()), "id long, t string")
    assert sorted(map(tuple, index.phrases(q, "id", "p").collect())) == want
    assert sorted(map(tuple, textindex.phrases_in(texts, "id", "t", q, "id", "p").collect())) == want
    own = texts.select(F.col("id").alias("pk"), textindex.tokens(F.coalesce("t", F.lit(""))).alias("w"))
    assert sorted(map(tuple, textindex._matched(own, textindex._asked(q, "id", "p"), held=2).collect())) == want
    for a, b in ((q.limit(0), texts), (q, texts.limit(0)), (q.filter("id = 6"), texts)):
        assert textindex.phrases_in(b, "id", "t", a, "id", "p").count() == 0


def test_random_phrases_same_as_brute_force(spark):
    random.seed(3)
    texts = [(i, random.choices("abc", k=random.randint(0, 30))) for i in range(300)]
    asked = [(i, random.choices("abcd", k=random.randint(1, 6))) for i in range(200)]
    want = sorted((i, k) for i, p in asked for k, w in texts if any(w[j : j + len(p)] == p for j in range(len(w))))
    make = lambda x: spark.createDataFrame([(i, " ".join(w)) for i, w in x], "id long, t string")
    assert sorted(map(tuple, textindex.phrases_in(make(texts), "id", "t", make(asked), "id", "t").collect())) == want


def test_phrases_of_texts_meet_no_postings(spark):
    plan = QUERIES["fts_phrases"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan


def test_user_text_and_prefix(spark, index):
    assert {r.pk for r in index.matching("fox; 'QUICK-brown'").collect()} == {1, 6}
    assert index.matching(' ;" ') is None and index.matching("nowhere fox").count() == 0
    assert {r.pk for r in index.prefixed("FO").collect()} == {1, 6, 7}
    again = TextIndex(spark, index.path)
    assert again._segments == [0, 1] and again.phrase(["fox"]).count() == 3
    assert {(r.token, r.df, r.tf) for r in again.token_counts().collect() if r.token in ("the", "fox")} == {("the", 4, 5), ("fox", 3, 4)}
    assert {r.pk: r.length for r in index.lengths().collect()} == {k: len(words(t)) for k, t in TEXTS.items()}


def test_a_search_reads_its_folder_alone(spark, index):
    plan = index.phrase(["fox"])._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan) and "EqualTo(token,fox)" in plan and " t#" not in plan
    empty = TextIndex(spark, index.path + "-none")
    assert empty.phrase(["fox"]).count() == 0 and empty.token_counts().count() == 0


def test_prefixes_of_short_and_long_terms(spark):
    labels = spark.createDataFrame([("a", "heart muscle"), ("b", "hearing"), ("c", "muscle of heart heart"), ("d", None)], "id string, label string")
    asked = spark.createDataFrame([("hea",), ("of m",), ("x",), ("",), ("h",)], "term string")
    got = [(r.term, r.id) for r in prefix_ranked(asked, "term", labels, "id", [F.col("label")]).orderBy("term", "place").collect()]
    assert {k for t, k in got if t == "hea"} == {"a", "b", "c"} and {k for t, k in got if t == "of m"} == {"c"} and {k for t, k in got if t == "h"} == {"a", "b", "c"}
    assert not [k for t, k in got if t in ("x", "")]


def test_scores_do_not_cut_texts_again(spark):
    x = QUERIES["fts_bm25_top"](spark, "/root/testdata/sf0.001")
    assert "regexp_extract_all" not in x._jdf.queryExecution().optimizedPlan().toString()


def test_postings_are_grouped_before_they_are_dealt(spark, tmp_path):
    rows = [(i, " ".join(["a", "b", "a"] * 400) if i % 3 else None) for i in range(30)]
    x = TextIndex(spark, str(tmp_path / "i"))
    dealt = []
    frame = type(spark.range(1))
    usual = frame.repartition
    try:
        frame.repartition = lambda self, *c: (dealt.append(self) if "positions" in self.columns else None, usual(self, *c))[1]
        x.add(spark.createDataFrame(rows, "id long, t string"), "id", "t")
    finally:
        frame.repartition = usual
    assert dealt[0].count() == 40 and {(r.token, tuple(r.positions)) for r in x.postings().collect()} == {("a", tuple(i for i in range(1200) if i % 3 != 1)), ("b", tuple(range(1, 1200, 3)))}


def test_a_common_beginning_is_not_dealt_by_its_letters(spark):
    labels = spark.range(2000).selectExpr("id", "concat('customer ', id) as label")
    conf = "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(conf, "-1")
    try:
        x = prefix_ranked(spark.createDataFrame([("customer 7",), ("17",)], "term string"), "term", labels, "id", [F.col("label")], top=2)
        plan = x._jdf.queryExecution().executedPlan().toString()
        assert not re.search(r"SortMergeJoin \[gram", plan) and [r.id for r in x.filter("term = '17'").orderBy("place").collect()] == [17, 170]
    finally:
        spark.conf.unset(conf)
