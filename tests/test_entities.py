"""Conditions by tiers: which rows each tier takes."""

import pytest
from pyspark.sql import functions as F

from lodestar.operators import entities as E

T = E.Tiers("raw", "std", "cat", own={"covid": "covid"}, upper_of={"cancer": "neoplasm"}, standard_of={"flu": "influenza", "blood": ["blood", "pbmc"], "t2d": "diabetes 2"}, above={"diabetes 2": "metabolic"}, deep=frozenset({"blood"}))
ROWS = [("covid lung", "COVID-19", "virus"), ("old Covid", None, None), ("x", "tumor", "neoplasm"), ("y", "influenza", "virus"), ("z", "pbmc", None), ("cord blood", None, None), ("q", "diabetes 2", "metabolic"), ("r", "obesity", "metabolic"), ("some flu", None, None), (None, None, None)]


@pytest.mark.parametrize(
    ("text", "excluded", "want"),
    [
        ("Covid", [], {0, 1}), ("cancer", [], {2}), ("flu", [], {3}), ("flu", ["INFLUENZA"], {8}), ("blood", [], {4, 5}), ("blood", ["pbmc"], {5}), ("blood", ["pbmc", "blood"], {4, 5}),
        ("t2d", [], {6, 7}), ("lung", [], {0}), ("cancer", ["neoplasm"], set()),
    ],
)
def test_tiers(spark, text, excluded, want):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(ROWS)], "i int, raw string, std string, cat string")
    got = df.filter(E.entities_condition([E.Entity("d", text, ["no such value"])], {"d": T}, excluded={"d": excluded}))
    assert {r.i for r in got.collect()} == want


def test_kinds_are_joined_and_alternatives_are_not(spark):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(ROWS)], "i int, raw string, std string, cat string")
    rows = lambda es, **kw: {r.i for r in df.filter(E.entities_condition(es, {"d": T, "e": T}, ("raw", {"n": ["%old%"]}, {"x": "std"}), **kw)).collect()}
    assert rows([E.Entity("d", "flu", ["v"]), E.Entity("d", "cancer", ["v"])]) == {2, 3}
    assert rows([E.Entity("d", "flu", ["v"]), E.Entity("e", "cancer", ["v"])]) == set()
    assert rows([E.Entity("d", "flu", ["v"], negated=True), E.Entity("other", "q", ["v"])]) == set(range(len(ROWS)))
    assert rows([E.Entity("cell_type", "odd", ["z"], "n")]) == {1, 4} and rows([E.Entity("cell_type", "x", ["q"])]) == {2, 6}


def test_words_of_both_columns_must_be_met(spark):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(ROWS)], "i int, raw string, std string, cat string")
    rows = lambda *a, **kw: {r.i for r in df.filter(F.coalesce(E.words_condition(*a, **kw), F.lit(False))).collect()}
    assert rows(["cancer"], T) == {2} and rows(["cancer", "flu"], T) == set() and rows(["flu", "blood"], T) == {3, 4, 5}
    assert rows(["cancer"], T, strict=True) == set() and rows([], T) == set(range(len(ROWS))) and rows(["blood"], T, ["pbmc"]) == {5}
