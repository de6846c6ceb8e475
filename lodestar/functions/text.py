"""Sizes, years, tokens and repairs of text, as Columns."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

WORD = r"[\p{L}\p{N}]+"


def size_bytes(c: Column) -> Column:
    """Bytes of sizes such as 762M or 1.5K (steps of 1024); null for anything else."""
    number = F.regexp_extract(c, r"^([0-9.]+)([KMGTPkmgtp]?)$", 1).try_cast("double")
    power = F.instr(F.lit("KMGTP"), F.upper(F.regexp_extract(c, r"^([0-9.]+)([KMGTPkmgtp]?)$", 2)))
    unit = F.regexp_extract(c, r"([KMGTPkmgtp]?)$", 1)
    return F.floor(number * F.pow(F.lit(1024.0), F.when(unit == "", 0).otherwise(power))).cast("long")


def year_of(c: Column) -> Column:
    """The first year from 1900 to 2099 in a text, null for none."""
    return F.regexp_extract(c, r"(19|20)\d{2}", 0).try_cast("int")


def human_size(c: Column) -> Column:
    """Bytes as B, KB, MB, GB or TB, in steps of 1024, with one decimal from KB up; NULL for NULL. The decimal is rounded as
    C does, on the exact value and halves to even, which format_string does not."""

    def label(i: int, unit: str) -> Column:
        n, size = c.cast("double").cast("long"), 1024**i
        over = F.pmod(n, F.lit(size)) * 10
        whole, rest = F.floor(n / size) * 10 + F.floor(over / size), F.pmod(over, F.lit(size)) * 2
        tenths = (whole + F.when((rest > size) | ((rest == size) & (whole % 2 == 1)), 1).otherwise(0)).cast("long")
        return F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit(f" {unit}"))

    steps = [F.when(c < 1024, F.format_string("%d B", c))]
    for i, unit in enumerate(("KB", "MB", "GB"), 1):
        steps.append(F.when(c < 1024 ** (i + 1), label(i, unit)))
    return F.coalesce(*steps, F.when(c.isNotNull(), label(4, "TB")))


def unlisted(c: Column) -> Column:
    """A list that was stored as Python text, as its distinct items joined by commas; other text as it is."""
    return F.when(c.rlike(r"^\[.*\]$"), F.array_join(F.array_distinct(F.regexp_extract_all(c, F.lit("'([^']*)'"), 1)), ", ")).otherwise(c)


def safe_name(c: Column) -> Column:
    """A name for a file: 80 characters at most, letters, digits, dots, dashes and underscores alone."""
    return F.regexp_replace(F.left(c, F.lit(80)), "[^A-Za-z0-9._-]", "_")


def cjk_share(c: Column) -> Column:
    """The share of a text's characters that are Chinese ones; 0 for no text."""
    return F.coalesce(F.length(F.regexp_replace(c, r"[^\x{4e00}-\x{9fff}]", "")) / F.nullif(F.length(c), F.lit(0)), F.lit(0.0))


def tokens(c: Column) -> Column:
    """Words of letters and digits in lower case."""
    return F.regexp_extract_all(F.lower(c), F.lit(WORD), 0)


@F.pandas_udf(StringType())
def repaired(texts: pd.Series) -> pd.Series:
    """UTF-8 that was read as CP1252 or Latin-1, read again rightly; a text is left alone where that gives no valid
    UTF-8. Spark's encode has no CP1252, so this is a UDF over Arrow batches."""

    def one(t: str | None) -> str | None:
        for charset in ("cp1252", "latin-1") if t and not t.isascii() else ():
            try:
                return t.encode(charset).decode("utf-8")
            except UnicodeError:
                continue
        return t

    return texts.map(one)


def first_named(c: Column, table: list[tuple[str, list[str]]]) -> Column:
    """The first name of the table one of whose words a text has, NULL for none. A word is found as a whole word whatever the
    case; spaces, dashes and underscores inside it are the same and may be left out."""

    def pattern(words: list[str]) -> str:
        parts = [re.split(r"[\s_-]+", w) for w in words]
        return r"(?i)\b(?:" + "|".join(r"[\s_-]?".join(map(re.escape, p)) for p in parts) + r")\b"

    return F.coalesce(*[F.when(c.rlike(pattern([name, *words])), name) for name, words in table])
