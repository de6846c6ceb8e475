"""Staged records, OBO files, release bundles and workspaces: files in, the same answers by plain Python."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from lodestar.functions import text
from lodestar.plans.queries import closure
from lodestar.sources import obo, release
from lodestar.sources import staged as S
from lodestar.streaming import workspaces

RECORDS = [
    {"id": str(i), "title": f"{a} {b}" if i % 9 else None, "summary": "single cell" if i % 2 else None, "organism": [None, "Homo sapiens", "Mus musculus"][i % 3], "kind": "series" if i % 4 else "sample", "collection": f"c{i % 5}", "year": None if i % 7 == 0 else 2000 + i % 20}
    for i, (a, b) in enumerate((a, b) for a in ("Lung", "lung cancer", "Heart", "brain") for b in ("atlas", "tumor", "10x", "of mice", "CELL"))
]


def holds(term, r):
    """A term by its meaning."""
    if isinstance(term, S.Said):
        return any(term.words.lower() in (r[c] or "").lower() for c in ("title", "summary"))
    if isinstance(term, S.Is):
        return r[term.field] == term.value
    if isinstance(term, S.Years):
        return r["year"] is not None and (term.first or 0) <= r["year"] <= (term.last or 9999)
    if isinstance(term, S.Turned):
        return not holds(term.part, r)
    return (all if term.word == "AND" else any)(holds(p, r) for p in term.parts)


TERMS = [
    S.term_of({"disease": ["cancer", "tumor"], "tissue": ["lung"]}, species=["Homo sapiens"], kind="series", years=S.Years(2003, 2015), without=["10x", "of", "mice", "x y"]),
    S.term_of({"tissue": ["heart"]}, sentence="single cell"), S.term_of({}, sentence="cell"), S.scoped_term({"tissue": ["lung", "cancer", "none"]}, ["x"], ["c1", "c2"]), S.scoped_term({}, ["cell", "lung", "atlas", "none"]),
    ~(S.Is("organism", "Homo sapiens") | S.Years(last=2005)) & S.Said("CELL"),
]


@pytest.mark.parametrize("number", range(len(TERMS)))
def test_staged_records_same_as_by_hand(spark, tmp_path, number):
    (tmp_path / "r.json").write_text("\n".join(map(json.dumps, RECORDS)))
    term = TERMS[number]
    got = {r.id for r in S.staged(spark, str(tmp_path), term).collect()}
    assert got == {r["id"] for r in RECORDS if holds(term, r)}
    assert S.staged(spark, str(tmp_path)).count() == len(RECORDS)


def test_the_scan_takes_conditions_over(spark, tmp_path, monkeypatch):
    spark.conf.set("spark.sql.maxMetadataStringLength", "3000")
    (tmp_path / "r.json").write_text("\n".join(map(json.dumps, RECORDS)))
    plan = S.staged(spark, str(tmp_path), TERMS[0]).select("id")._jdf.queryExecution().executedPlan().toString()
    for pushed in ("EqualTo(organism,Homo sapiens)", "EqualTo(kind,series)", "GreaterThanOrEqual(year,2003)"):
        assert pushed in plan
    assert "more" not in plan.split("ReadSchema")[1]
    assert TERMS[0].text() == '(("cancer" OR "tumor") AND "lung" AND "Homo sapiens"[Organism] AND "series"[Kind] AND 2003:2015[Year] AND NOT "10x" AND NOT "mice")'
    assert S.term_of({}) is None and S.scoped_term({}, []) is None


OBO = r"""format-version: 1.2
ontology: x

[Term]
id: A:1
name: root
def: "The \"first\" one, [with brackets]." [X:1]
synonym: "top \"term\"" EXACT []
synonym: "begin" BROAD []
is_a: A:3 ! a cycle

[Term]
id: A:2
name: child
is_a: A:1 ! root
is_a: A:1

[Term]
id: A:3
name: grandchild
is_a: A:2

[Term]
id: A:4
name: gone
is_obsolete: true

[Term]
id: A:2

[Typedef]
id: part_of
name: part of

[Term]
name: without an id
"""


def test_an_ontology_file(spark, tmp_path):
    (tmp_path / "x.obo").write_text(OBO)
    x = obo.read_terms(spark, str(tmp_path))
    got = {r.id: r for r in x.collect()}
    assert set(got) == {"A:1", "A:2", "A:3"} and got["A:1"].definition == 'The "first" one, [with brackets].' and got["A:1"].synonyms == ['top "term"', "begin"]
    assert got["A:2"].parents == ["A:1"] and got["A:2"].name == "child" and got["A:2"].definition is None
    assert {r.id for r in obo.read_terms(spark, str(tmp_path), obsolete=True).collect()} == {*got, "A:4"}
    pairs = {tuple(r) for r in closure(obo.edges(x)).collect()}
    assert pairs == {(a, b) for a in got for b in got}


def test_a_large_file_is_read_by_several_tasks(spark, tmp_path):
    stanzas = [f'[Term]\nid: B:{i}\nname: term {i}\ndef: "{"long " * 20}{i}" []\nis_a: B:{i // 2}\n' for i in range(1, 5000)]
    (tmp_path / "x.obo").write_text("ontology: b\n\n" + "\n".join(stanzas))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        assert spark.read.option("lineSep", obo.BETWEEN).text(str(tmp_path)).rdd.getNumPartitions() > 4
        x = obo.read_terms(spark, str(tmp_path))
        assert {(r.id, r.name, *r.parents) for r in x.collect()} == {(f"B:{i}", f"term {i}", f"B:{i // 2}") for i in range(1, 5000)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_a_release_reads_back(spark, tmp_path):
    a = spark.createDataFrame([(i, f"n{i % 3}", [str(i)], {"k": "v"}) for i in range(50)], "i int, s string, l array<string>, m map<string, string>").drop("m")
    b = spark.createDataFrame([(None, 1.5), (2, None), (2, None)], "i int, d double")
    at = str(tmp_path / "r")
    release.release({"a": a, "b": b}, at)
    rows = release.verified(spark, at).collect()
    assert all(r.right for r in rows) and {r.name for r in rows if r.what == "table"} == {"a", "b"} and len(rows) >= 6
    assert release.fingerprint(a) == release.fingerprint(a.repartition(7).orderBy("s")) != release.fingerprint(a.limit(49).union(a.limit(1)))
    assert release.fingerprint(b)[0] == 3 and release.fingerprint(b) != release.fingerprint(b.distinct())
    part = next(f for f in os.listdir(f"{at}/b/parquet") if f.endswith(".parquet"))
    b.limit(1).coalesce(1).write.parquet(f"{at}-other")
    other = next(f for f in os.listdir(f"{at}-other") if f.endswith(".parquet"))
    os.remove(f"{at}/b/parquet/.{part}.crc")
    os.replace(f"{at}-other/{other}", f"{at}/b/parquet/{part}")
    wrong = {(r.what, r.name.split("/")[0]) for r in release.verified(spark, at).collect() if not r.right}
    assert wrong == {("table", "b"), ("file", "b")}


def changes(n=400):
    random.seed(7)
    ops = ["add"] * 8 + ["remove"] * 2 + ["delete", "recover", "recover", "odd"]
    return [(i, random.randint(1, 4), random.choice(ops), random.choice([f"i{j}" for j in range(12)] + [None]), random.choice(["a", None])) for i in range(n)]


def replayed(rows, most):
    state = {}
    for event, w, op, item, note in rows:
        deleted, items = state.setdefault(w, [False, {}])
        if op in ("delete", "recover"):
            state[w][0] = op == "delete"
        elif not deleted and item:
            if op == "remove":
                items.pop(item, None)
            elif op == "add" and (item in items or len(items) < most):
                items[item] = (note, items[item][1] if item in items else event)
    return {(w, d, i, *x) for w, (d, items) in state.items() for i, x in (items or {None: (None, -1)}).items()}


@pytest.mark.parametrize("size", [400, 90])
def test_workspaces_same_for_every_split(spark, tmp_path, size):
    rows = changes()
    for i in range(0, len(rows), size):
        path = tmp_path / f"{i:04}.json"
        path.write_text("\n".join(json.dumps(dict(zip(("event", "workspace", "op", "item", "note"), r, strict=True))) for r in rows[i : i + size]))
        os.utime(path, (1_000_000 + i, 1_000_000 + i))
    got = workspaces.kept_by_stream(spark, str(tmp_path), most=6, maxFilesPerTrigger=1)
    assert {tuple(r) for r in got.collect()} == replayed(rows, 6)


def test_sizes_are_rounded_as_c_does(spark):
    numbers = [0, 1023, 1024, 1075, 1280, 1331, 1792, 3328, 1048575, 1048576, 2359296, 1331 * 1024**2, 1024**4 * 9 // 4, 20000 * 1024**4 + 1024**4 // 20, 250_000 * 1024**4, None]
    units = ["KB", "MB", "GB", "TB"]

    def label(n):
        if n is None or n < 1024:
            return n if n is None else f"{n} B"
        i = next((i for i in (1, 2, 3) if n < 1024 ** (i + 1)), 4)
        return f"{n / 1024**i:.1f} {units[i - 1]}"

    df = spark.createDataFrame([(n,) for n in numbers], "n long")
    assert [r.x for r in df.select("n", text.human_size(F.col("n")).alias("x")).collect()] == [label(n) for n in numbers]
