"""Queries on columns of questions: what their words stand for, what they exclude, what they ask of which archive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.operators import matcher
from lodestar.plans.binding import Catalog
from lodestar.plans.queries import query

col, lit = F.col, F.lit

#: Words for the test tables' values in two languages, beside those that the tables give themselves.
WORDS = [
    ("priority", "urgent", "1-URGENT"), ("priority", "加急", "1-URGENT"), ("priority", "high", "2-HIGH"), ("priority", "高", "2-HIGH"), ("priority", "low", "5-LOW"),
    ("region", "asia", "asia"), ("region", "亚洲", "asia"), ("region", "europe", "europe"), ("region", "欧洲", "europe"), ("species", "mouse", "Mus musculus"), ("species", "小鼠", "Mus musculus"),
    ("species", "human", "Homo sapiens"), ("recent", "latest", "recent"), ("recent", "最新", "recent"), ("archive", "geo", "geo"), ("archive", "sra", "sra"),
]


def vocabulary(k: Catalog) -> DataFrame:
    """Words with what they stand for: the parts' names and their single words, brands, and WORDS."""
    p = k.table("part")
    names = p.select(lit("part").alias("field"), F.lower("p_name").alias("word"), col("p_name").alias("value"))
    single = p.select(lit("kind"), F.explode(F.split(F.lower("p_name"), " ")).alias("word"), col("word"))
    brands = p.select(lit("brand"), F.lower("p_brand"), col("p_brand"))
    return names.union(single).union(brands).union(k.spark.createDataFrame(WORDS, "field string, word string, value string")).distinct()


def questions(k: Catalog) -> DataFrame:
    """(id, question): sentences over parts and whole documents, in two languages, with and without negations."""
    p, i = k.table("part"), col("p_partkey")
    kinds = ["urgent {n} of asia", "{n} or gear, not high or {b}, in Europe", "最新 亚洲 小鼠 {n}, 排除 {b}", "no {n} but {b} from GEO", "human {n}s without mouse"]
    made = F.get(F.array(*map(lit, kinds)), (i % len(kinds)).cast("int"))
    made = F.replace(F.replace(made, lit("{n}"), col("p_name")), lit("{b}"), col("p_brand"))
    return p.select(i.alias("id"), made.alias("question")).union(k.table("documents").select((-1 - col("doc_id")).alias("id"), "text"))


@query()
def questions_matched(k: Catalog) -> DataFrame:
    """Each word of the vocabulary in each question, the longest first, and whether it is negated."""
    return matcher.matched(questions(k), "id", "question", vocabulary(k))


@query()
def question_intents(k: Catalog) -> DataFrame:
    """What each question asks for: lists of values, a species, whether it wants recent records, archives, exclusions."""
    x = matcher.intents(questions(k), "id", "question", vocabulary(k), ["part", "kind", "brand", "priority", "region", "archive"], {"species": "Homo sapiens"}, ["recent"])
    return x.select("id", *[F.array_join(c, "|").alias(c) for c in ("part", "kind", "brand", "priority", "region", "archive", "excluded")], "species", "recent")
