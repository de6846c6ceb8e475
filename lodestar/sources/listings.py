"""Files named in the HTML of directory listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.text import size_bytes

#: Files that describe the listing itself, and endings of archives.
SKIPPED, ARCHIVES = ("filelist.txt", "index.html"), ("tar", "gz", "zip", "bz2", "tgz")


def _is_file(target: Column) -> Column:
    """A link to a file of the listing: not up, not elsewhere, not a folder, not another order of the listing."""
    return (target != "") & ~target.contains("/") & ~target.contains("?") & ~F.lower(target).isin(*SKIPPED)


def listed_files(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, name, bytes, archive) of each listed file: a listing has a line per entry, with a link and, as its last
    column, the size; bytes is null where that is not a size. Pages without such lines give none."""
    lines = pages.select(key, F.explode(F.split(html, "\n")).alias("line"))
    shown = F.split(F.trim(F.regexp_replace("line", "<[^>]*>", " ")), r"\s+")
    x = lines.select(key, F.regexp_extract("line", 'href="([^"]*)"', 1).alias("name"), F.element_at(shown, -1).alias("size")).filter(_is_file(F.col("name")))
    return x.select(key, "name", size_bytes(F.col("size")).alias("bytes"), F.lower(F.regexp_extract("name", r"\.(\w+)$", 1)).isin(*ARCHIVES).alias("archive"))
