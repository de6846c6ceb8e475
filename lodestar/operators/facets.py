"""Facet histograms: unfiltered by grouping sets, filtered by one scan in which each facet leaves out its own filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.operators.predicates import all_of


def unfiltered(df: DataFrame, facets: dict[str, str]) -> DataFrame:
    """(facet, value, count) of all facets in one pass."""
    at = F.array(*[F.struct(F.lit(n).alias("facet"), F.col(c).cast("string").alias("value")) for n, c in facets.items()])
    return df.select(F.explode(at).alias("x")).filter("x.value is not null and x.value <> ''").groupBy("x.facet", "x.value").agg(F.count("*").alias("count"))


def self_excluding(df: DataFrame, facets: dict[str, str], filters: dict[str, Column], top: int = 800) -> DataFrame:
    """(facet, value, count), where a facet's counts obey all filters except the facet's own; null and empty values
    dropped, the `top` most frequent values of each facet kept (ties by value)."""
    keep = {n: all_of([F.coalesce(p, F.lit(False)) for f, p in filters.items() if f != n]) for n in facets}
    at = F.array(*[F.struct(F.lit(n).alias("facet"), F.col(c).cast("string").alias("value"), keep[n].alias("keep")) for n, c in facets.items()])
    x = df.select(F.explode(at).alias("x")).filter("x.keep and x.value is not null and x.value <> ''")
    x = x.groupBy("x.facet", "x.value").agg(F.count("*").alias("count"))
    rank = F.row_number().over(Window.partitionBy("facet").orderBy(F.desc("count"), "value"))
    return x.withColumn("rank", rank).filter(F.col("rank") <= top).drop("rank")


def case_folded(df: DataFrame, c: str) -> DataFrame:
    """(value, count): spellings that differ by case or outer blanks are one, shown as the most frequent (then least)."""
    counts = df.filter(F.col(c).isNotNull() & (F.col(c) != "") & ~F.col(c).rlike("[A-Z].*_[0-9]")).groupBy(F.lower(F.trim(c)).alias("norm"), F.col(c).alias("v")).agg(F.count("*").alias("n"))
    return counts.groupBy("norm").agg(F.min(F.struct((-F.col("n")).alias("m"), F.col("v").alias("v"))).alias("x"), F.sum("n").alias("count")).select(F.col("x.v").alias("value"), "count")


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column: total, non-null, distinct, null percentage (half to even), selectivity."""
    n = df.count()
    one = df.agg(*[F.count(c).alias(f"{c}_n") for c in columns], *[F.countDistinct(c).alias(f"{c}_d") for c in columns])
    at = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"{c}_n").alias("non_null"), F.col(f"{c}_d").alias("distinct_values")) for c in columns])
    x = one.select(F.explode(at).alias("x")).select("x.*")
    total = F.lit(n).cast("long")
    return x.select("column", total.alias("total"), "non_null", "distinct_values", F.bround(100.0 * (total - F.col("non_null")) / F.greatest(total, F.lit(1)), 2).alias("null_pct"), (F.col("distinct_values") / F.greatest(total, F.lit(1))).alias("selectivity"))
