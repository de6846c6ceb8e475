"""Release bundles: tables as zstd Parquet and gzipped CSV, with fingerprints of their rows and checksums of their files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.sources import sinks

#: Rows in a file, so that a file is no larger than what a task reads whole for its checksum.
FILE_ROWS = 1_000_000


def fingerprint(df: DataFrame) -> tuple[int, int, int]:
    """(rows, sum, parity) of hashes of the rows: the same for any order and any split, other for other rows. The sum tells
    repeated rows, which the parity alone would not. One row comes to the driver."""
    own = F.xxhash64(*[F.to_json(F.struct(F.col(c.name))) if "map<" in c.dataType.simpleString() else F.struct(F.col(c.name), F.col(c.name).isNull()) for c in df.schema])
    h = own.alias("h")
    r = df.select(h).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("h").cast("decimal(38,0)")), F.lit(0)).alias("s"), F.coalesce(F.bit_xor("h"), F.lit(0)).alias("x")).first()
    return int(r.n), int(r.s), int(r.x)


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes, sha256) of the files under a path, by the tasks that read them."""
    x = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path)
    return x.select(F.regexp_replace("path", "^.*/(?=[^/]+/[^/]+/[^/]+$)", "").alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def release(tables: dict[str, DataFrame], path: str) -> None:
    """Write the tables to path/<table>/parquet and path/<table>/csv, the data dictionary to path/dictionary, what each table
    holds to path/contents, and the checksums of all files to path/checksums."""
    spark = next(iter(tables.values())).sparkSession
    contents, dictionary = [], None
    for name, df in tables.items():
        df.write.option("compression", "zstd").option("maxRecordsPerFile", FILE_ROWS).parquet(f"{path}/{name}/parquet")
        written = spark.read.schema(df.schema).parquet(f"{path}/{name}/parquet")
        sinks.flat(written).write.option("header", True).option("compression", "gzip").option("maxRecordsPerFile", FILE_ROWS).csv(f"{path}/{name}/csv")
        n, total, parity = fingerprint(written)
        contents.append((name, n, len(df.columns), str(total), parity))
        own = sinks.data_dictionary(written).select(F.lit(name).alias("table"), "*")
        dictionary = own if dictionary is None else dictionary.union(own)
    dictionary.coalesce(1).write.option("header", True).csv(f"{path}/dictionary")
    spark.createDataFrame(contents, "table string, n long, columns int, total string, parity long").coalesce(1).write.json(f"{path}/contents")
    files = checksums(spark, path).filter(~F.col("file").rlike("^[^/]*/(contents|dictionary)/|^(contents|dictionary)/"))
    files.write.json(f"{path}/checksums")


def verified(spark: SparkSession, path: str) -> DataFrame:
    """(what, name, right): whether each table reads back as it was written, and each file is what it was."""
    contents = spark.read.schema("table string, n long, columns int, total string, parity long").json(f"{path}/contents").collect()  # a row a table
    tables = []
    for r in contents:
        n, total, parity = fingerprint(spark.read.parquet(f"{path}/{r.table}/parquet"))
        tables.append(("table", r.table, (n, str(total), parity) == (r.n, r.total, r.parity)))
    now = checksums(spark, path).select("file", F.col("sha256").alias("now"))
    was = spark.read.schema("file string, bytes long, sha256 string").json(f"{path}/checksums")
    files = was.join(now, "file", "left").select(F.lit("file").alias("what"), F.col("file").alias("name"), F.coalesce(F.col("now") == F.col("sha256"), F.lit(False)).alias("right"))
    return spark.createDataFrame(tables, "what string, name string, right boolean").union(files)
