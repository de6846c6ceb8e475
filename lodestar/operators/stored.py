"""Stored statistics: counts of values by file, added up on reading, computed anew only for files that came or changed."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.sources.shared import small_side


def files_of(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """(path, time of change, length) of the Parquet files of a table, which is a file or a folder of files."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    found, listed = [], fs.listFiles(at, True)
    while listed.hasNext():
        f = listed.next()
        if f.getPath().getName().endswith(".parquet"):
            found.append((f.getPath().toString(), f.getModificationTime(), f.getLen()))
    return sorted(found)


@dataclass
class StoredCounts:
    """Counts of a table's values in the folder `path`: (column, value, n, total) of each file, in one batch for each refresh.
    Counts of rows, of filled and of distinct values, sections of a dashboard and sums all follow from them by addition."""

    spark: SparkSession
    path: str

    PARTIALS, FILES = "file string, column string, value string, n long, total decimal(38,2), batch int", "file string, changed long, length long, version string, batch int"

    def _read(self, name: str, schema: str) -> DataFrame:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def refresh(self, table: str, columns: list[str], measure: str | None = None, rows: Callable[[DataFrame], DataFrame] | None = None, version: str = "") -> list[str]:
        """Count the files of the table that are new, changed, or were counted under another version; the files counted.

        rows: what to count of the files' rows; it keeps their column `file`. version: names all else that the rows
        depend on, as the state of joined tables. Files that are gone are left out of what is read from now on."""
        now = self.spark.createDataFrame([(*f, version) for f in files_of(self.spark, table)], "file string, changed long, length long, version string")
        known = self._read("files", self.FILES)
        last = known.groupBy("file").agg(F.max(F.struct("batch", "changed", "length", "version")).alias("was")).select("file", "was.*")
        state = now.join(last.withColumnsRenamed({c: f"was_{c}" for c in ("changed", "length", "version")}), "file", "left")
        same = F.expr("changed = was_changed and length = was_length and version = was_version")
        listed = state.select("file", "changed", "length", "version", "batch", F.coalesce(same, F.lit(False)).alias("same")).collect()  # a row a file, as the driver lists them anyway
        stale = [r.file for r in listed if not r.same]
        number = (known.agg(F.max("batch")).first()[0] or 0) + 1
        if stale:
            read = self.spark.read.parquet(*stale).withColumn("file", F.col("_metadata.file_path"))
            x = rows(read) if rows else read
            each = F.explode(F.array(F.struct(F.lit("").alias("column"), F.lit(None).cast("string").alias("value")), *[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]))
            total = F.col(measure).cast("decimal(18,2)") if measure else F.lit(None).cast("decimal(18,2)")
            per = x.select("file", total.alias("measure"), each.alias("x")).groupBy("file", "x.column", "x.value").agg(F.count("*").alias("n"), F.sum("measure").cast("decimal(38,2)").alias("total"))
            per.write.parquet(f"{self.path}/partials/batch={number}")
            counted = [(r.file, r.changed, r.length, r.version) for r in listed if not r.same]
            self.spark.createDataFrame(counted, now.schema).coalesce(1).write.parquet(f"{self.path}/files/batch={number}")
        self._current = self.spark.createDataFrame([(r.file, r.batch if r.same else number) for r in listed], "file string, batch int")
        return stale

    def values(self) -> DataFrame:
        """(column, value, n, total) of the table as it was at the last refresh; column '' counts the rows."""
        own = self._read("partials", self.PARTIALS).join(small_side(self._current), ["file", "batch"], "left_semi")
        return own.groupBy("column", "value").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def totals(values: DataFrame) -> DataFrame:
    """(column, filled, distinct_values) of stored values."""
    return values.groupBy("column").agg(F.sum(F.when(F.col("value").isNotNull() | (F.col("column") == ""), F.col("n"))).alias("filled"), F.count("value").alias("distinct_values"))
