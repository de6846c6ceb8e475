"""N-gram Jaccard join: near-duplicate groups of documents by exact Jaccard similarity of their word-shingle sets."""

from __future__ import annotations

from functools import reduce
from operator import add

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from lodestar.llm import shingles as S
from lodestar.llm.components import components
from lodestar.llm.store import dropped, heavy_first, most_frequent, short_batches, small_side, written

#: Similarity in percent.
PERCENT = 75
#: Shingles found in FREQUENT_FROM or more of one document in SAMPLE are ordered last, MAX_FREQUENT of them at most.
#: This sets only the order in which members are tried, and so the speed: any order gives the same links.
SAMPLE, FREQUENT_FROM, MAX_FREQUENT = 8, 3, 1_000_000

#: Shingles of so many documents make tiles in which coarse bitmaps are compared.
CROWD = 64
#: The left side of a tile is dealt out in parts of about so many rows, each with a copy of the right side's ids and bitmaps.
PART = 2048


def _frequent(docs: DataFrame) -> np.ndarray:
    seen = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0).select("text").mapInArrow(S.counted, "h long, df long")
    counts = written(seen.groupBy("h").agg(F.sum("df").alias("df")).filter(F.col("df") >= FREQUENT_FROM), "frequent")
    top = most_frequent(counts, "df", MAX_FREQUENT).select("h").toArrow()
    dropped(counts)
    return np.sort(top.column("h").to_numpy().astype(np.int64).view(np.uint64))


def _band(n, percent: int):
    """Sets in bands further apart than one are too unlike in size to be linked."""
    return F.floor(F.log(n.cast("double")) / F.lit(-np.log(percent / 100) + 1e-9)).cast("int")


@F.pandas_udf(LongType())
def _at_most(na: pd.Series, nb: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(S.common_at_most(na.to_numpy(), nb.to_numpy(), a.to_list(), b.to_list()) if len(na) else [], dtype="int64")


@F.pandas_udf(LongType())
def _common(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([S.common_members(x, y) for x, y in zip(a, b, strict=True)], dtype="int64")


def _linked(pairs: DataFrame, sets: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Those of the candidate pairs (a, b) that are links. The bound by bit counts goes first; whole sets are then
    made again from the texts of what is left, and intersected."""
    reaches = lambda common: 100 * common >= percent * (F.col("na") + F.col("nb") - common)
    of = sets.select("doc_id", "n_shingles", "bits")
    x = pairs.join(of.toDF("a", "na", "bits_a"), "a").filter("na > 0").join(of.toDF("b", "nb", "bits_b"), "b")
    x = x.filter(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
    left = written(x.filter(reaches(_at_most("na", "nb", "bits_a", "bits_b"))).select("a", "b", "na", "nb"), "pairs")
    ids = written(left.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "ids")
    whole = written(docs.join(small_side(ids), "doc_id", "left_semi").select("doc_id", "text").mapInArrow(S.members, "doc_id long, members array<long>"), "members")
    y = left.join(whole.toDF("a", "in_a"), "a").join(whole.toDF("b", "in_b"), "b")
    links = written(y.filter(reaches(_common("in_a", "in_b"))).select("a", "b").distinct(), "links")
    dropped(left, ids, whole)
    return links


def _stars(firsts: DataFrame) -> DataFrame:
    """Pairs of each document and the least one that has the same least shingle under one of a few permutations.
    They tie most near copies together by a few links each."""
    x = firsts.select(F.col("doc_id").alias("b"), F.posexplode("stars").alias("i", "h"))
    leader = x.groupBy("i", "h").agg(F.min("b").alias("a"), F.max("b").alias("last")).filter("a < last").drop("last")
    return x.join(leader, ["i", "h"]).filter("a < b").select("a", "b").distinct()


def _tiles(firsts: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Pairs that no chain of star links ties together yet, that share a tile: a shingle of both prefixes, and a
    band of sizes or one of the next."""
    rare = firsts.select("doc_id", F.explode("rare").alias("h")).repartition("h")
    twice = rare.groupBy("h").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi").select("h")
    x = rare.join(twice.hint("shuffle_hash"), "h").union(firsts.select("doc_id", F.explode("common").alias("h")).select("h", "doc_id"))
    x = x.join(labels, x.doc_id == labels.node, "left").select("h", "doc_id", F.coalesce("label", "doc_id").alias("label"))
    x = written(x, "tiles")
    # A shingle whose documents are all tied together already has nothing to add; in the others the label that most
    # documents have is named, as these need not be compared among themselves.
    per = x.groupBy("h", "label").agg(F.count("*").alias("c"))
    open_ = per.groupBy("h").agg(F.count("*").alias("labels"), F.max(F.struct("c", "label")).alias("main"), F.sum("c").alias("c")).filter("labels > 1").select("h", F.col("main.label").alias("main"), (F.col("c") >= CROWD).alias("crowd"), F.ceil(F.col("c") / PART).cast("int").alias("parts"))
    sizes = firsts.select("doc_id", F.col("n_shingles").alias("n"), _band(F.col("n_shingles"), percent).alias("band"), "coarse")
    x = x.join(open_, "h").join(sizes, "doc_id")
    x = written(x.select("h", "doc_id", "label", (F.col("label") == F.col("main")).alias("main"), "n", "band", "parts", *[F.when(F.col("crowd"), F.col("coarse")[i]).otherwise(F.lit(0)).alias(f"w{i}") for i in range(S.COARSE)]), "tiles")
    words = lambda side: [F.col(f"w{i}").alias(f"{side}{i}") for i in range(S.COARSE)]
    left = x.filter("not main").select("h", F.explode(F.array(*[F.col("band") + i for i in (-1, 0, 1)])).alias("tile"), F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int").alias("part"), F.col("label").alias("la"), F.col("doc_id").alias("a"), F.col("n").alias("na"), *words("x"))
    right = x.select("h", F.col("band").alias("tile"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("label").alias("lb"), F.col("doc_id").alias("b"), F.col("n").alias("nb"), "main", *words("y"))
    # Sizes, and in crowded tiles the bit counts of coarse bitmaps, bound the overlap inside the join.
    differ = reduce(add, [F.bit_count(F.col(f"x{i}").bitwiseXOR(F.col(f"y{i}"))) for i in range(S.COARSE)])
    fits = (F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent) & ((100 + percent) * (F.col("na") + F.col("nb") - differ) >= 2 * percent * (F.col("na") + F.col("nb")))
    pairs = left.join(right, ["h", "tile", "part"]).filter((F.col("la") != F.col("lb")) & (F.col("main") | (F.col("a") < F.col("b"))) & fits)
    pairs = pairs.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.count("*").alias("shared"), F.max(F.greatest("na", "nb")).alias("most"), F.max(F.col("na") + F.col("nb")).alias("both"))
    # What is common is in both prefixes or behind the prefix that ends first, so `shared` bounds it from above.
    behind = F.ceil(F.col("most") * percent / 100) - 1
    return pairs.filter((100 + percent) * (F.col("shared") + behind) >= percent * F.col("both")).select("a", "b")


def jaccard_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, copy_of.

    Two documents are linked when 100 * |A and B| >= percent * |A or B| for their sets of five-word shingles (64-bit
    hashes). component_id is the smallest doc_id reachable over links, copy_of the smallest doc_id with an equal set.
    Copies are one class from the start. Links of classes come from tiles: shingles of the rare-first prefixes that
    both have, within a band of sizes or two neighbouring ones; bitmaps bound the overlap from above before the
    sorted sets are intersected. Documents that verified links already tie together are not compared again, so a
    large group of near copies costs a few links per member instead of all pairs, and no group is held in one task.
    So groups and copies are given, not every link or the number of a document's links.

    Null, empty and blank texts: n_shingles 0, component of their own. Null doc_id: component_id and copy_of null,
    linked with nothing. Repeated rows come back repeated. doc_id is expected to name one text; rows that give it
    several are grouped by each of these texts. Other columns are not read. Empty table: no rows."""
    short_batches(docs.sparkSession)
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    named = docs.filter("doc_id is not null")
    sets = written(docs.mapInArrow(S.described(_frequent(named), percent), S.DESCRIBED), "sets")
    known = sets.filter("n_shingles > 0 and doc_id is not null")
    classes = written(known.groupBy("digest").agg(F.min("doc_id").alias("copy_of"), F.count("*").alias("n")), "classes")
    shared = written(classes.filter("n > 1"), "shared")
    copies = written(heavy_first(known.select("digest", "doc_id"), shared, ["digest"], "n").filter("doc_id <> copy_of").select("digest", "doc_id").distinct(), "copies")
    firsts = known.join(small_side(copies), ["digest", "doc_id"], "left_anti").drop("digest")
    near = _linked(_stars(firsts), sets, named, percent)
    far = _linked(_tiles(firsts, components(near), percent), sets, named, percent)
    labels = components(near.union(far))
    groups = classes.join(labels, classes.copy_of == labels.node, "left").select("digest", "copy_of", "n", F.coalesce("label", "copy_of").alias("label"))
    # Only classes of several documents or with links change anything.
    tied = written(groups.filter("n > 1 or label <> copy_of"), "groups")
    dropped(classes, shared, copies)
    own, some = F.col("doc_id").isNotNull(), F.col("n_shingles") > 0
    key = F.when(some, F.col("digest")).otherwise(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "utf-8"))  # texts without words are no class
    out = sets.select("doc_id", "n_shingles", key.alias("digest"))
    out = heavy_first(out, tied, ["digest"], "n")
    return out.select("doc_id", "n_shingles", *[F.when(own, F.coalesce(c, "doc_id")).alias(n) for c, n in (("label", "component_id"), ("copy_of", "copy_of"))])
