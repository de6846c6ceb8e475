"""Filters as values: strict as written, relaxed where nothing is found, and what dropping each would find."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.operators.predicates import all_of, like_any


@dataclass(frozen=True)
class Filter:
    """A condition on a column: `in` or `not in` values, or a comparison (<, <=, >, >=, <>) with one. field names it to the
    user; NULLs meet no condition but `not in` and `<>`, as in a search nothing is known of them."""

    field: str
    column: str
    op: str
    values: tuple

    def strict(self) -> Column:
        c = F.col(self.column)
        if self.op == "in":
            return F.coalesce(c.isin(*self.values), F.lit(False))
        if self.op in ("not in", "<>"):
            return c.isNull() | ~c.isin(*self.values)
        value = F.lit(self.values[0])
        return F.coalesce({"<": c < value, "<=": c <= value, ">": c > value, ">=": c >= value}[self.op], F.lit(False))

    def relaxed(self) -> Column:
        """Equality with text becomes text inside, whatever the case; all else is as strict as it was."""
        if self.op == "in" and all(isinstance(v, str) for v in self.values):
            return F.coalesce(like_any(self.column, list(self.values)), F.lit(False))
        return self.strict()


def found(df: DataFrame, filters: list[Filter]) -> tuple[DataFrame, str]:
    """The rows that meet all filters; if there are none, those that meet all of them relaxed; and which of both it was."""
    strict = df.filter(all_of([f.strict() for f in filters]))
    if not strict.isEmpty():
        return strict, "strict"
    return df.filter(all_of([f.relaxed() for f in filters])), "relaxed"


def broadened(df: DataFrame, filters: list[Filter], order: list[str], most: int = 3) -> DataFrame:
    """(dropped, was, n): what is found without a filter, for the first `most` fields of `order` that are filtered by, where
    something is. Fields that are not in `order` are never dropped. One pass over the rows."""
    by = {f.field: f for f in filters}
    tried = [name for name in order if name in by][:most]
    if not tried:
        return df.sparkSession.createDataFrame([], "dropped string, was string, n long")
    each = [F.count_if(all_of([f.strict() for f in filters if f.field != name])).alias(name) for name in tried]
    rows = [F.struct(F.lit(name).alias("dropped"), F.lit(", ".join(map(str, by[name].values))).alias("was"), F.col(name).alias("n")) for name in tried]
    return df.agg(*each).select(F.explode(F.array(*rows)).alias("x")).select("x.*").filter("n > 0")
