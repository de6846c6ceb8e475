"""Workspaces as the state of a log of changes, kept as versions of a snapshot that each batch of the log moves on."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.sources.shared import shared_dir

#: Items that a workspace can hold.
MOST = 500
CHANGES = "event long, workspace long, op string, item string, note string"
STATE = "workspace long, deleted boolean, item string, note string, event long"


def _moved_on(parts: Iterator[pd.DataFrame], most: int) -> Iterator[pd.DataFrame]:
    """From rows sorted by (workspace, op is null first, event): the state of each workspace. Rows of the last state come
    first (op null; a workspace without items has a row without one), then changes in order. Adding an item that is
    there changes its note; a full workspace takes no more; changes to a deleted one wait for its recovery: they do
    nothing. What is held is one workspace."""
    at, deleted, items = None, False, {}

    def given() -> pd.DataFrame:
        rows = [(at, deleted, i, note, event) for i, (note, event) in items.items()] or [(at, deleted, None, None, -1)]
        return pd.DataFrame(rows, columns=["workspace", "deleted", "item", "note", "event"])

    for part in parts:
        for r in part.itertuples(index=False):
            if r.workspace != at:
                if at is not None:
                    yield given()
                at, deleted, items = r.workspace, False, {}
            if r.op is None or r.op != r.op:
                deleted = bool(r.deleted)
                if isinstance(r.item, str):
                    items[r.item] = (r.note if isinstance(r.note, str) else None, r.event)
            elif r.op == "delete":
                deleted = True
            elif r.op == "recover":
                deleted = False
            elif deleted or not isinstance(r.item, str):
                continue
            elif r.op == "remove":
                items.pop(r.item, None)
            elif r.op == "add" and (r.item in items or len(items) < most):
                items[r.item] = (r.note if isinstance(r.note, str) else None, items[r.item][1] if r.item in items else r.event)
    if at is not None:
        yield given()


def moved_on(state: DataFrame, changes: DataFrame, most: int = MOST) -> DataFrame:
    """The state after the changes, which are taken in the order of their event numbers."""
    nothing = lambda t: F.lit(None).cast(t)
    old = state.select("workspace", "deleted", "item", "note", "event", nothing("string").alias("op"))
    new = changes.select("workspace", F.lit(False).alias("deleted"), "item", "note", "event", F.coalesce("op", F.lit("")).alias("op")).filter("workspace is not null")
    dealt = old.union(new).repartition("workspace").sortWithinPartitions("workspace", F.col("op").isNotNull(), "event", "item")
    return dealt.mapInPandas(lambda parts: _moved_on(parts, most), STATE)


def kept_by_stream(spark: SparkSession, path: str, most: int = MOST, **source) -> DataFrame:
    """(workspace, deleted, item, note, event) after all changes in the files (JSON lines) under a path, taken by a stream in
    batches. Each batch writes the next version of the snapshot from the last one; a batch that is run again writes its
    own version again, from the same one. Changes are expected in the order of the files."""
    at = f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}"
    stream = spark.readStream.schema(CHANGES).options(**source).json(path)
    done = {-1: spark.createDataFrame([], STATE)}

    def write(batch: DataFrame, number: int) -> None:
        last = max(n for n in done if n < number)
        moved_on(done[last], batch, most).write.mode("overwrite").parquet(f"{at}/version={number}")
        done[number] = spark.read.schema(STATE).parquet(f"{at}/version={number}")
        for n in [n for n in done if n < last]:  # the last two versions are enough to run a batch again
            old = spark._jvm.org.apache.hadoop.fs.Path(f"{at}/version={n}")
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
            del done[n]

    stream.writeStream.option("checkpointLocation", f"{at}/state").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    return done[max(done)]
