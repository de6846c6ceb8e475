"""Join of terms with the values that have them inside, by an index of the values' q-grams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.sources.shared import kept, small_side

#: Characters of a gram; shorter terms are looked up by grams of their own length.
GRAM = 3


def grams(c: Column, size: int) -> Column:
    """The distinct runs of `size` characters of a text."""
    starts = F.when(F.length(c) >= size, F.sequence(F.lit(1), F.length(c) - (size - 1))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(c, i, F.lit(size))))


def contained(terms: DataFrame, values: DataFrame) -> DataFrame:
    """(term, value): each pair of a distinct term and a distinct value that has the term in it, whatever their case.
    terms has a column `term`, values a column `value`; null and empty terms are in nothing.

    Each term is looked up by that gram of its own which the fewest values have, and what is found is verified. So a
    common run of letters in a term costs nothing, and values are compared only with terms that share a gram with them:
    no term meets all values."""
    t = kept(terms.select("term").filter("term <> ''").distinct().withColumn("low", F.lower("term")), "terms")
    v = kept(values.select("value").filter("value is not null").distinct().withColumn("low", F.lower("value")), "values")
    size = F.least(F.length("low"), F.lit(GRAM))
    shortest = t.agg(F.min(size)).first()[0] or GRAM
    asked = t.select("term", F.col("low").alias("t"), F.explode(F.coalesce(*[F.when(size == n, grams(F.col("low"), n)) for n in range(shortest, GRAM + 1)])).alias("gram"))
    held = v.select("value", F.col("low").alias("v"), F.explode(F.concat(*[grams(F.col("low"), n) for n in range(shortest, GRAM + 1)])).alias("gram"))
    # Counted for the grams that are asked for alone; a term with a gram that no value has is in none.
    wanted = small_side(kept(asked.select("gram").distinct(), "grams"))
    counts = held.join(wanted, "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("n"))
    each = asked.join(counts, "gram", "left").groupBy("term", "t").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("rarest"))
    keys = kept(each.filter("rarest.n > 0").select("term", "t", F.col("rarest.gram").alias("gram")), "keys")
    return held.join(small_side(keys), "gram").filter(F.contains("v", F.col("t"))).select("term", "value")


def safe(term: Column) -> Column:
    """Whether a term may be looked for inside other words: over four characters, and no abbreviation (all capitals
    without a space), judged as the user wrote it."""
    s = F.trim(term)
    return F.coalesce((F.length(s) > 4) & ((F.upper(s) != s) | F.contains(s, F.lit(" "))), F.lit(False))


def direct_values(terms: DataFrame, values: DataFrame, top: int = 20) -> DataFrame:
    """(term, value, n): for each safe term the `top` most frequent values that have it in them. values: (value, n),
    one row each. Equal counts go by the value."""
    pairs = contained(terms.filter(safe(F.col("term"))), values)
    found = pairs.join(values, "value")
    place = F.row_number().over(Window.partitionBy("term").orderBy(F.desc("n"), "value"))
    return found.withColumn("place", place).filter(F.col("place") <= top).select("term", "value", "n")


def folded(found: DataFrame, keys: list[str], value: str = "value", n: str = "n") -> DataFrame:
    """Values that differ in case alone are one: of each the most frequent spelling stays (the least at a tie)."""
    best = F.min(F.struct((-F.col(n)).alias("less"), F.col(value).alias("spelt"))).alias("b")
    x = found.groupBy(*keys, F.lower(value).alias("fold")).agg(best)
    return x.select(*keys, F.col("b.spelt").alias(value), (-F.col("b.less")).alias(n))
