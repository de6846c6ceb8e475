"""Written tables in the cluster's shared folder, and size-checked broadcasts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.sources.shared import shared_dir

#: A join side is broadcast only if it has been counted and has no more rows of a few longs than this.
BROADCAST_ROWS = 1_000_000


def _run_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tables/{spark.sparkContext.applicationId}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends here, and a lost executor loses nothing.
    Tables lie in one folder per application; see dropped() and clear()."""
    spark = df.sparkSession
    path = f"{_run_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more."""
    for t in tables:
        _delete(t.sparkSession, t.written_at)


def clear(spark: SparkSession) -> None:
    """Delete all tables that this application has written. Call it when the results are taken: they read these tables."""
    _delete(spark, _run_dir(spark))


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def small_side(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it counts at most `limit` rows; otherwise as it is, for a shuffled join.
    df should be a written table: it is counted here."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def heavy_first(rows: DataFrame, classes: DataFrame, keys: list[str], count: str, heavy: int = 1_000) -> DataFrame:
    """rows left joined with classes (one row for each value of keys, not null; a written table, whose column `count` counts
    its rows), the count left out. Classes of `heavy` rows or more are broadcast if there are few of them, so no task gets
    all rows of such a class; the others are joined as a whole, broadcast or shuffled."""
    if classes.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(classes.drop(count)), keys, "left")
    large = small_side(classes.filter(F.col(count) >= heavy).drop(count))
    rest = rows.join(large.select(*keys), keys, "left_anti").join(classes.filter(F.col(count) < heavy).drop(count), keys, "left")
    return rest.unionByName(rows.join(large, keys))


def most_frequent(counts: DataFrame, count: str, limit: int) -> DataFrame:
    """The rows of the largest counts (positive), at most `limit` of them: all rows over the least eighth of an octave that
    still fits. A histogram by eighths of octaves comes to the driver, a few hundred rows; no rows meet in one task."""
    part = F.floor(F.log2(F.col(count).cast("double")) * 8).cast("int")
    least, total = None, 0
    for r in sorted(counts.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r.part):
        total += r.n
        if total > limit:
            break
        least = r.part
    return counts.limit(0) if least is None else counts.filter(part >= least)


def one_thread(spark: SparkSession) -> None:
    """From now on matrix products in Python tasks run in the task's own thread: Spark has a task for each core already,
    and idle helper threads would take turns with them."""
    spark.sparkContext.environment.setdefault("OPENBLAS_NUM_THREADS", "1")


def short_batches(spark: SparkSession, rows: int = 1000, size: int = 4 << 20) -> None:
    """From now on batches of the session, Arrow's and those of Parquet scans, have fewer rows and bytes than by Spark's
    defaults, unless these were set to something else: rows here are whole texts, and a batch is held by the executor
    and by its Python worker at once. A single row over `size` bytes is an Arrow batch of its own."""
    for name, usual, ours in (("execution.arrow.maxRecordsPerBatch", "10000", rows), ("execution.arrow.maxBytesPerBatch", "67108864b", size), ("parquet.columnarReaderBatchSize", "4096", rows)):
        name = f"spark.sql.{name}"
        if spark.conf.get(name, usual) == usual:
            spark.conf.set(name, ours)
