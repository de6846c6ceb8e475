"""The folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A join side is broadcast only if it has been counted and has no more narrow rows than this.
BROADCAST_ROWS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset, a local session gets a temporary one; a cluster must name its
    own, as its machines share no temporary folder."""
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not at:
        if not sc.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='lodestar-')}"
        sc.setCheckpointDir(at)
    return at


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/catalog/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again: it is computed once, and lineage ends here."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it counts at most `limit` rows; as it is beyond, for a shuffled join. It is counted here,
    so it should be a table that was written or read."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df
