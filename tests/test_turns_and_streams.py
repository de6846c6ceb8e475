"""Follow-up sentences, and streams whose files come one after another with late rows."""

import datetime as dt
import os
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lodestar.functions import accessions
from lodestar.operators import routing as R
from lodestar.plans import sentences as S
from lodestar.plans.parsing import Question
from lodestar.streaming import windows


def test_follow_ups():
    first, second, third, last = S.conversation(S.TURNS)
    assert first.wanted == {"tissue_standard": ["1-URGENT"], "source_database": ["asia"]} and first.years == (1994, None)
    assert second.wanted == {"tissue_standard": ["2-HIGH"], "source_database": ["asia"]} and second.unwanted == {"disease_category": ["O"]}
    assert third.wanted["source_database"] == ["asia", "europe"] and third.least == 100_000 and third.years == (1994, None)
    assert last.unwanted == {"disease_category": ["O", "F"]} and last.years == (1994, 1996) and last.wanted == third.wanted


@pytest.mark.parametrize("sentence, values", [("blood", ["blood"]), ("also blood", ["liver", "blood"]), ("还要 blood", ["liver", "blood"]), ("plush blood", ["blood"])])
def test_added_or_replaced(sentence, values):
    assert S.refined(Question(wanted={"tissue": ["liver"]}), Question(wanted={"tissue": ["blood"]}), sentence).wanted == {"tissue": values}


def test_life_stages_and_scope(spark):
    asked = {"fetal bovine serum": "", "foetal liver": "fetal", "embryonic stem": "", "stem of embryos": "embryonic", "infants and child": "newborn,child", "adult in calf serum": "adult", "": ""}
    df = spark.createDataFrame([(t, v) for t, v in asked.items()], "t string, want string")
    x = df.select("want", F.array_join(S.categories_named(F.split("t", " ")), ",").alias("got"))
    assert x.filter("want <> got").count() == 0
    q = spark.createDataFrame([("Liver by brand",), ("pf of co",), (None,)], "q string").select(S.scope(F.col("q"), {"platform": ["pf", "brand"]}, {"tissue": ["LIVER", "co"]}).alias("f"))
    assert [r.f for r in q.collect()] == [["platform", "tissue"], [], []]


@pytest.mark.parametrize(("asked", "held", "found"), [("Smart-seq2", "smartseq v3", True), ("SMARTSEQ", "Smart-seq2", True), ("cel-seq 2", "CELseq", True), ("Brand#12", "brand#1", False), ("10x 3' v3", "10x 5'", True), ("ab1", "xab", False)])
def test_assay_families(spark, asked, held, found):
    df = spark.createDataFrame([(held, None)], "assay string, platform string")
    assert df.filter(R.assay_matches([asked])).count() == found


def test_accessions(spark):
    want = {"srr1234567": "run", "ERP123456": "study", "DRX12345": None, " SAMEA1234567": "sample", "SAMN123456": "sample", "PRJNA1": "study", "PRJ1": None, "GSE1": None, "SRA000001": "submission"}
    df = spark.createDataFrame([(k,) for k in want], "id string")
    assert {r.id: r.f for r in df.select("id", accessions.family_of(F.col("id")).alias("f")).collect()} == want


@pytest.fixture
def log(tmp_path):
    """Three files: in the last one a row is late, one comes again, and one is in time. A watermark counts from the batch after next on."""
    at = lambda day, hour: dt.datetime(2024, 1, day, hour)
    files = [[(1, at(1, 8), "a", 1.0), (2, at(3, 12), "a", 3.0)], [(5, at(3, 12), "c", 2.0)], [(3, at(1, 9), "a", 5.0), (2, at(3, 12), "a", 3.0), (4, at(3, 13), "b", 7.0)]]
    for i, rows in enumerate(files):
        ids, ts, kinds, values = zip(*rows, strict=True)
        n = len(rows)
        pq.write_table(pa.table({"event_id": ids, "ts": pa.array(ts, pa.timestamp("us")), "user_id": [1] * n, "event_type": kinds, "value": values, "props": ["{}"] * n}), tmp_path / f"{i}.parquet")
        os.utime(tmp_path / f"{i}.parquet", (1_000_000 + i, 1_000_000 + i))
    return str(tmp_path), {"files": "*.parquet", "files_per_batch": 1}


def test_late_rows_are_left_out(spark, log):
    path, source = log
    days = {(r.day, r.event_type): r.n for r in windows.daily_counts(spark, path, **source).collect()}
    assert days == {("2024-01-01", "a"): 1, ("2024-01-03", "a"): 2, ("2024-01-03", "b"): 1, ("2024-01-03", "c"): 1}
    assert sorted(r.event_id for r in windows.distinct_events(spark, path, **source).collect()) == [1, 2, 4, 5]


def test_running_means(spark, log):
    path, source = log
    assert {(r.event_type, r.n, r["mean"]) for r in windows.feedback_means(spark, path, **source).collect()} == {("a", 4, 3.0), ("b", 1, 7.0), ("c", 1, 2.0)}


def written(path, files):
    """One file of events (event_id, seconds, user) after another."""
    begin = dt.datetime(2024, 1, 1)
    for i, rows in enumerate(files):
        ids, seconds, users = zip(*rows, strict=True)
        ts = pa.array([begin + dt.timedelta(seconds=s) for s in seconds], pa.timestamp("us"))
        n = len(rows)
        pq.write_table(pa.table({"event_id": pa.array(ids, pa.int64()), "ts": ts, "user_id": pa.array(users, pa.int64()), "event_type": ["a"] * n, "value": [1.0] * n, "props": ["{}"] * n}), path / f"{i}.parquet")
        os.utime(path / f"{i}.parquet", (1_000_000 + i, 1_000_000 + i))
    return str(path), {"files": "*.parquet", "files_per_batch": 1}


def state_left(spark, **options):
    """The state of the stream that was run last."""
    from lodestar.sources.shared import shared_dir

    at = max((os.path.join(d, x) for d in [shared_dir(spark).removeprefix("file://") + "/streams"] for x in os.listdir(d)), key=os.path.getmtime)
    return spark.read.format("statestore").options(**options).load(f"{at}/state")


def events(n=600, seed=3):
    random.seed(seed)
    t, rows = 0.0, []
    for i in range(n):
        t += random.choice([0, 0, 1, 7, 40, 61, 2000 if i % 50 == 0 else 5])
        rows.append((i, t, random.randint(1, 4)))
    return rows


@pytest.mark.parametrize("size", [600, 97, 31])
def test_rate_limit_same_for_every_split(spark, tmp_path, size):
    rows = events()
    cuts = [i for i in range(0, len(rows), size)]
    while any(i and rows[i][1] == rows[i - 1][1] for i in cuts):  # equal times are in one file
        cuts = [i + 1 if i and rows[i][1] == rows[i - 1][1] else i for i in cuts]
    path, source = written(tmp_path, [rows[i:j] for i, j in zip(cuts, [*cuts[1:], len(rows)], strict=True)])
    got = {r.event_id: r.in_window for r in windows.sliding_counts(spark, path, **source).collect()}
    assert got == {i: sum(u == v and s - 60 <= x <= s for _, x, v in rows) for i, s, u in rows}


def test_rate_limit_state_is_short(spark, tmp_path):
    rows = [(i, 10.0 * i, 1) for i in range(2000)] + [(5000, 0.0, 2)]
    path, source = written(tmp_path, [[rows[-1], *rows[:500]], rows[500:1000], rows[1000:1500], rows[1500:2000]])
    assert windows.sliding_counts(spark, path, **source).count() == 2001
    left = state_left(spark, stateVarName="times", flattenCollectionTypes="true").collect()
    assert {r.key.user_id for r in left} == {1} and len(left) < 600  # a batch's rows at most; the quiet user's are gone


@pytest.mark.parametrize("size", [600, 40])
def test_sessions_same_for_every_split(spark, tmp_path, size):
    rows = events()
    path, source = written(tmp_path, [rows[i : i + size] for i in range(0, len(rows), size)])
    want = []
    for u in {u for *_, u in rows}:
        n, last = 0, None
        for s in sorted(s for _, s, v in rows if v == u):
            if last is not None and s - last >= 1800:
                want.append((u, n))
                n = 0
            n, last = n + 1, s
        want.append((u, n))
    assert sorted(map(tuple, windows.sessions(spark, path, **source).collect())) == sorted(want)


def test_ended_sessions_leave_the_state(spark, tmp_path):
    path, source = written(tmp_path, [[(i, 10_000.0 * i + j, i) for j in range(3)] for i in range(8)])
    assert windows.sessions(spark, path, **source).count() == 8
    assert state_left(spark).count() < 8 and windows.sessions(spark, path, files="none*").count() == 0
