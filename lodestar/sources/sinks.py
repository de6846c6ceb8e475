"""Writers: every one is a distributed write to a folder, none gathers rows."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def flat(df: DataFrame) -> DataFrame:
    """df with arrays of text joined by '; ', so that it fits a CSV file."""
    return df.select(*[F.array_join(f.name, "; ").alias(f.name) if f.dataType.typeName() == "array" else F.col(f.name) for f in df.schema])


def chosen(df: DataFrame, fields: list[str] | None = None, excluded: list[str] = ()) -> DataFrame:
    """df with the fields asked for (all if none are), in their order, without the excluded ones and those it lacks."""
    names = [c for c in (fields or df.columns) if c in df.columns and c not in excluded]
    return df.select(*dict.fromkeys(names))


def to_csv(df: DataFrame, path: str, fields: list[str] | None = None, excluded: list[str] = ()) -> None:
    """Gzipped CSV with a header in each file; lists are joined by '; '."""
    flat(chosen(df, fields, excluded)).write.option("header", True).option("compression", "gzip").csv(path)


def to_json(df: DataFrame, path: str, fields: list[str] | None = None, excluded: list[str] = (), beside: tuple[str, ...] = (), summary: str = "") -> None:
    """A folder with `envelope`, one line of the summary and the number of results, and `results`, a line for each: its data,
    and the columns `beside` it. Lines are written by the tasks, so results of any size are not held as one document."""
    data = chosen(df.drop(*beside), fields, excluded)
    df.select(F.struct(*data.columns).alias("data"), *beside).write.option("ignoreNullFields", False).json(f"{path}/results")
    df.agg(F.lit(summary).alias("summary"), F.count("*").alias("total_count")).coalesce(1).write.json(f"{path}/envelope")


def to_release(df: DataFrame, path: str) -> None:
    """Parquet with zstd, beside gzipped CSV."""
    df.write.option("compression", "zstd").parquet(f"{path}/parquet")
    to_csv(df, f"{path}/csv")


def data_dictionary(df: DataFrame) -> DataFrame:
    """(column, type, filled, distinct_values): the percentage of rows that are neither NULL nor '', and exact distinct
    values, of every column in one pass."""
    n = F.greatest(F.count(F.lit(1)), F.lit(1))
    value = lambda c: F.nullif(F.col(c).cast("string"), F.lit(""))
    one = df.agg(*[F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"), F.bround(100.0 * F.count(value(f.name)) / n, 2).alias("filled"), F.countDistinct(f.name).alias("distinct_values")).alias(f"c{i}") for i, f in enumerate(df.schema)])
    return one.select(F.explode(F.array(*one.columns)).alias("x")).select("x.*")


def csv_line(values: list) -> Column:
    """Values of a CSV line; one is quoted, its quotation marks doubled, only if it has a comma or a quotation mark."""
    quoted = lambda v: F.when(v.rlike('[,"]'), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.coalesce(v, F.lit("")))
    return F.array_join(F.array(*map(quoted, values)), ",")


#: A file's line in each kind of manifest: columns folder, name, url, bytes in braces.
MANIFESTS = {
    "tsv": "{folder}\t{name}\t{bytes}",
    "bash": "curl -fL --create-dirs -o '{folder}/{name}' '{url}'",
    "aria2": "{url}\n  dir={folder}\n  out={name}",
    "snakemake": '    "{folder}/{name}",',
    "python": '    ("{url}", "{folder}/{name}"),',
}


def manifest_lines() -> Column:
    """A map of the kinds of manifests to the line of a row with the columns folder, name, url and bytes."""
    parts = lambda template: [F.col(p[1:-1]).cast("string") if p.startswith("{") else F.lit(p) for p in re.split(r"(\{\w+\})", template) if p]
    return F.create_map(*[x for kind, template in MANIFESTS.items() for x in (F.lit(kind), F.concat(*parts(template)))])
