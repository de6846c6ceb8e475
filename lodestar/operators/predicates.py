"""Filter algebra: each function gives a Column; fields are joined by AND, values of a field by OR."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F


def escaped(v: str) -> str:
    return v.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def any_of(cs: list[Column]) -> Column:
    return reduce(or_, cs, F.lit(False))


def all_of(cs: list[Column]) -> Column:
    return reduce(and_, cs, F.lit(True))


def like_any(c: str, values: list[str]) -> Column:
    """Case-insensitive substring of any value."""
    return any_of([F.col(c).ilike(f"%{escaped(v)}%") for v in values])


def not_like(c: str, values: list[str]) -> Column:
    """Keeps NULLs; one clause per value."""
    return all_of([F.col(c).isNull() | ~F.col(c).ilike(f"%{escaped(v)}%") for v in values])


def not_in(c: str, values: list[str], keep_null: bool) -> Column:
    out = ~F.col(c).isin(*values)
    return F.col(c).isNull() | out if keep_null else out


def folded_in(c: str, values: list[str]) -> Column:
    """Equality without case and outer blanks."""
    return F.lower(F.trim(F.col(c))).isin(*[v.strip(" ").lower() for v in values])


def canonical_in(c: str, values: list[str], vocabulary: list[str]) -> Column:
    """Stored spellings where all values are known, so that the scan can use plain equality; folded_in otherwise."""
    stored = {v.lower(): v for v in vocabulary}
    found = [stored.get(v.strip(" ").lower()) for v in values]
    return F.col(c).isin(*found) if all(found) else folded_in(c, values)


def present(c: str) -> Column:
    return F.col(c).isNotNull() & (F.col(c).cast("string") != "")


def flag(c: str, wanted: bool) -> Column:
    """Tri-state flag: wanted false means false or unknown."""
    return F.col(c) if wanted else F.col(c).isNull() | ~F.col(c)


def overlaps(lo: str, hi: str, a: Column, b: Column) -> Column:
    """Both ends known and the range [lo, hi] meets [a, b]."""
    return F.col(lo).isNotNull() & F.col(hi).isNotNull() & (F.col(hi) >= a) & (F.col(lo) <= b)


def keyword(standard: str, raw: str, values: list[str], mapping: dict[str, list[str]], excluded: list[str] = (), strict: bool = False) -> Column:
    """Keywords that the vocabulary maps become standard values without the excluded ones; others match the raw text."""
    mapped = [s for v in values for s in mapping.get(v.lower(), []) if s not in excluded]
    rest = [v for v in values if v.lower() not in mapping]
    return any_of(([F.col(standard).isin(*dict.fromkeys(mapped))] if mapped else []) + ([like_any(raw, rest)] if rest and not strict else []))


def relaxed(c: str, values: list[str]) -> Column:
    """The fuzzy form of a positive text predicate: equality becomes a substring match."""
    return like_any(c, values)
