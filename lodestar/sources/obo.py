"""Ontologies in OBO files with Unix line ends: read by stanzas, in as many tasks as the files have splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What stands between stanzas (fixed format).
BETWEEN = "\n\n["
#: A quoted text with escaped characters inside.
_QUOTED = r'"((?:[^"\\]|\\.)*)"'


def stanza_fields(s: Column) -> list[Column]:
    """id, name, parents, synonyms, definition and whether it is obsolete, of a stanza's text."""
    one = lambda p: F.nullif(F.regexp_extract(s, p, 1), F.lit(""))
    every = lambda p: F.regexp_extract_all(s, F.lit(p), 1)
    plain = lambda c: F.regexp_replace(c, r"\\(.)", "$1")
    return [
        one(r"(?m)^id: *(\S+)").alias("id"), F.trim(one(r"(?m)^name: *(.+)$")).alias("name"), F.array_distinct(every(r"(?m)^is_a: *(\S+)")).alias("parents"),
        F.transform(every(rf"(?m)^synonym: *{_QUOTED}"), plain).alias("synonyms"), plain(one(rf"(?m)^def: *{_QUOTED}")).alias("definition"), s.rlike(r"(?m)^is_obsolete: *true").alias("obsolete"),
    ]


def read_terms(spark: SparkSession, path: str, obsolete: bool = False) -> DataFrame:
    """(id, name, parents, synonyms, definition) of the term stanzas of the files under a path; stanzas of other kinds, file
    headers and terms without an id are left out, obsolete ones unless they are asked for. Of several stanzas with one
    id, as in files that extend others, the one with most fields stays."""
    parts = spark.read.option("lineSep", BETWEEN).text(path)
    x = parts.select(F.col("value").alias("s")).filter(F.col("s").startswith("Term]") | F.col("s").startswith("[Term]")).select(*stanza_fields(F.col("s"))).filter("id is not null")
    x = x if obsolete else x.filter("not obsolete")
    filled = F.struct((F.size("parents") + F.size("synonyms") + F.when(F.col("definition").isNull(), 0).otherwise(1)).alias("filled"), "name", "parents", "synonyms", "definition")
    return x.groupBy("id").agg(F.max(filled).alias("t")).select("id", "t.name", "t.parents", "t.synonyms", "t.definition")


def edges(terms: DataFrame) -> DataFrame:
    """(child, parent) of terms."""
    return terms.select(F.col("id").alias("child"), F.explode("parents").alias("parent"))
