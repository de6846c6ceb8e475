"""From raw documents to packed training sequences: quality rules, language, near duplicates, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.jaccard_join import jaccard_groups
from lodestar.llm.langid import identify
from lodestar.llm.packing import pack_documents
from lodestar.llm.quality_rules import quality_rules
from lodestar.llm.store import small_side, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the certified rules keep, each judged by itself: repeated rows and rows without doc_id too. Null and
    empty texts go. An empty table stays empty; columns of any names pass through."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return _without(docs, quality_rules(_keyed(docs), labels, keep=[KEY]).filter("not kept"), "rejected")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language is identified and not rejected, each judged by itself, as in quality()."""
    return _without(docs, identify(_keyed(docs), keep=[KEY]).filter("rejected"), "rejected")


#: A hash of what the verdicts on a row depend on, under a name that no table has.
KEY = "corpus_pipeline_row_key"


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", "lang", F.xxhash64("text", "lang").alias(KEY))


def _without(docs: DataFrame, verdicts: DataFrame, name: str) -> DataFrame:
    """docs without the rows of the verdicts. Texts stay where they are: only the rejected rows' doc_ids and keys are
    written, and broadcast if there are few enough of them; beyond that it is a shuffled join."""
    gone = small_side(written(verdicts.select(F.col("doc_id").alias("gone_id"), F.col("source_row")[KEY].alias("gone_key")).distinct(), name))
    same = F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.xxhash64("text", "lang") == F.col("gone_key"))
    return docs.join(gone, same, "left_anti")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near duplicates.

    Rows without doc_id or without words belong to no group and stay. Repeated rows come out once; a doc_id with several
    texts stays, with each of them once, if it is the smallest of a group by any."""
    groups = jaccard_groups(docs).filter("doc_id is not null").groupBy("doc_id")
    ids = written(groups.agg(F.count("*").alias("n"), F.bool_or(F.expr("component_id = doc_id")).alias("first")), "ids")
    x = docs.join(small_side(ids.filter("not first").select("doc_id")), "doc_id", "left_anti").select(docs.columns)
    repeated = ids.filter("first and n > 1").select("doc_id")
    if repeated.limit(1).count() == 0:
        return x
    repeated = small_side(repeated)
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    once = x.join(repeated, "doc_id", "left_semi").groupBy("doc_id", "text").agg(F.min(F.struct(*others, F.lit(0).alias("least"))).alias("row"))
    return x.join(repeated, "doc_id", "left_anti").unionByName(once.select("doc_id", "text", *[F.col("row")[c].alias(c) for c in others]))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of the documents that are left lies in the packed sequences. Null and empty texts are an end
    alone; rows without doc_id and repeated rows are packed like others. An empty table gives no rows."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality rules", quality), ("language ID", language), ("near duplicates", near_duplicates), ("packing", packing)]

#: The stages fit models and tokenize, which SQL cannot express; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over the documents table, each stage's result written and read again. For the cases of nulls,
    empty and long texts, repeated rows and other columns see each stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
