"""Cross-source fusion, interleaving, mirrors and components."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.sources.shared import kept, shared_dir


def _checkpointed(df: DataFrame) -> DataFrame:
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def connected(edges: DataFrame) -> DataFrame:
    """(node, label) over undirected edges (a, b): the least node reached, by least neighbour and pointer jumping."""
    both = _checkpointed(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = _checkpointed(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("label")))
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("m"))
        up = labels.select(F.col("node").alias("u"), F.col("label").alias("ul"))
        new = labels.join(near, labels.node == near.a, "left").join(up, labels.label == up.u, "left")
        new = _checkpointed(new.select("node", F.col("label").alias("old"), F.least("label", "m", "ul").alias("label")))
        if new.filter("old <> label").isEmpty():
            return new.select("node", "label")
        labels = new.select("node", "label")


def linked_groups(results: DataFrame, links: DataFrame, pk: str) -> DataFrame:
    """results with `group`: the least pk that a row is tied to by links (a, b) whose ends are both in the results."""
    ids = results.select(F.col(pk).alias("id")).distinct()
    inside = links.select("a", "b").join(ids.withColumnRenamed("id", "a"), "a", "left_semi").join(ids.withColumnRenamed("id", "b"), "b", "left_semi")
    labels = connected(inside).select(F.col("node").alias(pk), "label")
    return results.join(labels, pk, "left").withColumn("group", F.coalesce("label", pk)).drop("label")


def _greedy(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """From rows sorted by (hash, place): (group, into). Each group goes into the first merged one of its hash that has none
    of its sources, else it begins one. Merged ones of equal sources are a queue, so what is looked through is as many
    as there are different sets of sources, and only numbers are held."""
    last, queues, kinds = None, {}, {}
    for part in rows:
        into = []
        for h, group, place, sources in zip(part["hash"], part["group"], part["place"], part["sources"], strict=True):
            if h != last:
                last, queues, kinds = h, {}, {}
            own = frozenset(kinds.setdefault(x, x) for x in sources)
            fits = [(q[0], have) for have, q in queues.items() if not have & own]
            if fits:
                found, have = min(fits, key=lambda x: x[0])
                heapq.heappop(queues[have])
                if not queues[have]:
                    del queues[have]
                own |= have
            else:
                found = (place, group)
            heapq.heappush(queues.setdefault(own, []), found)
            into.append(found[1])
        yield pd.DataFrame({"group": part["group"], "into": into})


def merged_by_hash(groups: DataFrame) -> DataFrame:
    """(group, into) for groups (group, place, hash, sources): groups of one hash are merged in order of place where they
    have no source in common, each into the first that fits. A null or empty hash merges nothing.

    Where all groups of a hash have a single source, the i-th of each source are merged: a row number, whatever the number
    of groups. The others are walked through in order, hash by hash, in tasks that hold numbers alone. They are written
    first: dealt by hash straight from the join, they would lose that order where the join turns into a broadcast at run
    time, as Spark takes its partitions for those that are asked for."""
    hashed = groups.filter("hash <> ''")
    kind = hashed.groupBy("hash").agg(F.max(F.size("sources")).alias("most"), F.count("*").alias("n"))
    x = hashed.join(kind.filter("n > 1"), "hash")
    single = x.filter("most <= 1").withColumn("i", F.row_number().over(Window.partitionBy("hash", F.get("sources", F.lit(0))).orderBy("place", "group")))
    first = single.groupBy("hash", "i").agg(F.min_by("group", F.struct("place", "group")).alias("into"))
    plain = single.join(first, ["hash", "i"]).select("group", "into")
    kinds = dict(groups.dtypes)
    several = kept(x.filter("most > 1").select("hash", "group", "place", F.array_sort("sources").alias("sources")), "several")
    walked = several.repartition("hash").sortWithinPartitions("hash", "place", "group").mapInPandas(_greedy, f"group {kinds['group']}, into {kinds['group']}")
    merged = plain.union(walked)
    return groups.select("group").join(merged, "group", "left").select("group", F.coalesce("into", "group").alias("into"))


def fused(results: DataFrame, links: DataFrame, pk: str, source: str, key: str, order: str) -> DataFrame:
    """results with `record`: rows with one value are one record. Rows tied by links are a group; then groups of one key
    (the first key of a group's rows that is not empty) are merged across sources. Results of a single source stay as
    they are. order: the order in which the rows came, distinct numbers."""
    if results.select(source).distinct().limit(2).count() <= 1:
        return results.withColumn("record", F.col(pk))
    grouped = _checkpointed(linked_groups(results, links, pk))
    first = F.min_by(key, F.when(F.col(key) != "", F.col(order)))
    groups = grouped.groupBy("group").agg(F.min(order).alias("place"), first.alias("hash"), F.collect_set(F.coalesce(source, F.lit(""))).alias("sources"))
    return grouped.join(merged_by_hash(_checkpointed(groups)), "group").withColumnRenamed("into", "record").drop("group")


def merge_keys(df: DataFrame, key: str, source: str, order: str) -> DataFrame:
    """Records with one key merge only across sources: the i-th record of each source is in group i. NULL keys merge
    with nothing. Adds group_no, null for NULL keys."""
    i = F.row_number().over(Window.partitionBy(key, source).orderBy(order))
    return df.withColumn("group_no", F.when(F.col(key).isNotNull(), i))


def filled(*columns: str) -> Column:
    """How many of the columns are neither NULL, '' nor 0."""
    return sum((F.when(F.col(c).isNotNull() & ~F.col(c).cast("string").isin("", "0", "0.0"), 1).otherwise(0) for c in columns), F.lit(0))


def round_robin(df: DataFrame, source: str, order: str, page: int) -> DataFrame:
    """The first `page` rows, by turns: the n-th record of every source comes before the (n+1)-th, sources by their first
    record. Adds turn and first. A source can give no more than a page, so each task keeps that many rows of it before
    they meet; the first record of a source is the one of turn 1."""
    some = df.withColumn("turn", F.row_number().over(Window.partitionBy(source).orderBy(order))).filter(F.col("turn") <= page)
    return some.withColumn("first", F.min(order).over(Window.partitionBy(source))).orderBy("turn", "first").limit(page)


#: Archives' names for studies that are in several of them, and the family whose numbers they share (fixed formats).
STUDIES = {"GEO": ["GSE", "E-GEOD-", "S-GEOD-"], "MTAB": ["E-MTAB-", "S-BSST-?"], "ANND": ["E-ANND-"]}


def canonical_key(c: Column) -> Column:
    """Accessions of one study in several archives get one key, whatever their case; others NULL."""
    number = lambda names: F.regexp_extract(c, rf"(?i)^(?:{'|'.join(names)})(\d+)$", 1)
    return F.coalesce(*[F.when(number(names) != "", F.concat(F.lit(f"{family}:"), number(names))) for family, names in STUDIES.items()])


def mirrors(df: DataFrame, key: str, source: str, ident: str, most: int | None = None) -> DataFrame:
    """df with mirrors, 'source/id' of the other rows with the same key, in order (the first `most`, if given), and n_mirrors,
    how many there are. Each key has its names once, however many rows it has, and they are joined to the rows."""
    name = F.concat_ws("/", F.col(source), F.col(ident))
    names = df.filter(F.col(key).isNotNull()).select(key, name.alias("name")).distinct()
    few = names
    if most is not None:
        few = names.withColumn("i", F.row_number().over(Window.partitionBy(key).orderBy("name"))).filter(F.col("i") <= most + 1)
    first = few.groupBy(key).agg(F.array_sort(F.collect_list("name")).alias("first"))
    per = names.groupBy(key).agg(F.count("*").alias("n"))
    x = df.join(first.join(per, key), key, "left")
    others = F.array_remove(F.coalesce("first", F.array().cast("array<string>")), name)
    others = others if most is None else F.slice(others, 1, most)
    return x.withColumn("mirrors", F.array_join(others, ",")).withColumn("n_mirrors", F.coalesce(F.col("n") - 1, F.lit(0))).drop("first", "n")
