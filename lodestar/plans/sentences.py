"""Sentences in turn: follow-ups that change the question before them, life stages, and the fields that a question names."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.plans.binding import Catalog
from lodestar.plans.parsing import Question, parse, predicate
from lodestar.plans.queries import count, query

col, lit = F.col, F.lit

#: A follow-up that adds to what was asked for before: adverbs of addition, or one of the Chinese signs for it.
ADDS = re.compile(r"\b(?:also|too|as well|in addition|furthermore|add|adding|plus)\b|[还也另加]")


def refined(before: Question, after: Question, sentence: str) -> Question:
    """The question that a follow-up makes of the one before. Fields it does not name stay; values it gives for a field
    take the place of the earlier ones, or are added if the sentence says so. What was excluded stays excluded. Bounds
    and years hold until others are given."""
    wanted = before.wanted | after.wanted
    if ADDS.search(sentence.lower()):
        wanted = {f: list(dict.fromkeys(before.wanted.get(f, []) + after.wanted.get(f, []))) for f in wanted}
    unwanted = {f: list(dict.fromkeys(before.unwanted.get(f, []) + after.unwanted.get(f, []))) for f in before.unwanted | after.unwanted}
    years = tuple(old if new is None else new for old, new in zip(before.years, after.years, strict=True))
    return replace(after, wanted=wanted, unwanted=unwanted, least=before.least if after.least is None else after.least, years=years)


VOCABULARY = {
    "tissue_standard": {"urgent": ["1-URGENT"], "high": ["2-HIGH"], "low": ["5-LOW"]},
    "disease_category": {"open": ["O"], "finished": ["F"], "partial": ["P"]},
    "source_database": {"asia": ["asia"], "europe": ["europe"]},
}
TURNS = ["urgent samples of asia since 1994", "only high ones, without open", "also europe, over 100k cells", "now before 1997, excluding finished"]


def conversation(sentences: list[str]) -> list[Question]:
    """The question as it stands after each turn."""
    asked = [parse(s, VOCABULARY, {}) for s in sentences]
    for i in range(1, len(asked)):
        asked[i] = refined(asked[i - 1], asked[i], sentences[i])
    return asked


@query("""WITH {S}, t AS (SELECT 0 AS turn, * FROM samples WHERE tissue_standard = '1-URGENT' AND source_database = 'asia' AND year(publication_date) >= 1994
 UNION ALL SELECT 1, * FROM samples WHERE tissue_standard = '2-HIGH' AND source_database = 'asia' AND year(publication_date) >= 1994 AND disease_category IS DISTINCT FROM 'O'
 UNION ALL SELECT 2, * FROM samples WHERE tissue_standard = '2-HIGH' AND source_database IN ('asia', 'europe') AND year(publication_date) >= 1994
  AND disease_category IS DISTINCT FROM 'O' AND n_cells >= 100000
 UNION ALL SELECT 3, * FROM samples WHERE tissue_standard = '2-HIGH' AND source_database IN ('asia', 'europe') AND year(publication_date) BETWEEN 1994 AND 1996
 AND disease_category IS DISTINCT FROM 'O' AND disease_category IS DISTINCT FROM 'F' AND n_cells >= 100000)
 SELECT turn, source_database, count(*) AS n FROM t GROUP BY 1, 2""")
def nl_refined(k: Catalog) -> DataFrame:
    """Samples per source after each turn of a conversation, in one pass."""
    turns = [F.when(predicate(q, "n_cells", "publication_date"), lit(i)) for i, q in enumerate(conversation(TURNS))]
    x = k.samples().select("source_database", F.explode(F.array_compact(F.array(*turns))).alias("turn"))
    return x.groupBy("turn", "source_database").agg(count())


@dataclass(frozen=True)
class Named:
    """A vocabulary of categories: the words of each, and words after which or before which one of them means something
    else (stem after embryonic, calf before serum). Plurals and the spelling oe for e are found by rule."""

    words: dict[str, list[str]]
    next_to: dict[str, list[str]]

    def forms(self) -> dict[str, str]:
        """Every form of every word -> its category."""
        each = ((c, w) for c, ws in self.words.items() for w in (c, *ws))
        return {form: c for c, w in each for form in (w, f"{w}s", *((w.replace("fet", "foet"),) if w.startswith("fet") else ()))}


#: Life stages as the test tables have none of their own: a parameter of the operator, here for its query.
LIFE = Named(
    words={"embryonic": ["embryo"], "fetal": ["fetus"], "newborn": ["infant", "baby"], "child": ["children", "toddler"], "adult": ["grown-up"], "old": ["elderly"]},
    next_to={"embryonic": ["stem"], "fetal": ["bovine", "calf", "serum"]},
)


def categories_named(words: Column, named: Named = LIFE) -> Column:
    """Categories of a text's words (lower case, in order), each once, in the order of the text. A word does not count if
    the next or the last word is one that turns its meaning."""

    def read(w: Column, i: Column) -> Column:
        found = F.try_element_at(F.create_map(*[F.lit(x) for pair in named.forms().items() for x in pair]), w)
        near = F.array(F.get(words, i - 1), F.get(words, i + 1))
        turned = [(found == c) & F.coalesce(F.arrays_overlap(near, F.array(*map(lit, others))), lit(False)) for c, others in named.next_to.items()]
        return F.when(~reduce(or_, turned, lit(False)), found)

    return F.array_distinct(F.array_compact(F.transform(words, read)))


_STAGE_ROWS = ", ".join(f"('{w}', '{c}', {LIFE.next_to.get(c, []) or ['-']})" for w, c in LIFE.forms().items())


@query(f"""WITH kw AS (SELECT {list(LIFE.forms())} AS ws),
 d AS (SELECT doc_id, upper(ws[doc_id % len(ws) + 1]) || ' ' || CASE doc_id % 4 WHEN 0 THEN 'stem cells' WHEN 1 THEN 'calf serum' WHEN 2 THEN 'and adult tissue'
  ELSE 'of old' END || ', ' || coalesce(text, '') AS t FROM documents, kw),
 w AS (SELECT doc_id, regexp_extract_all(lower(t), '[a-z]+') AS ws FROM d), p AS (SELECT doc_id, ws, unnest(ws) AS one, generate_subscripts(ws, 1) AS i FROM w),
 m(kw, cat, others) AS (VALUES {_STAGE_ROWS}),
 h AS (SELECT doc_id, cat, min(i) AS i FROM p JOIN m ON one = kw WHERE NOT coalesce(list_contains(others, ws[i + 1]), false) AND NOT (i > 1
  AND coalesce(list_contains(others, ws[i - 1]), false)) GROUP BY 1, 2)
 SELECT doc_id, coalesce(string_agg(cat, ',' ORDER BY i), '') AS stages FROM w LEFT JOIN h USING (doc_id) GROUP BY 1""")
def question_life_stages(k: Catalog) -> DataFrame:
    """Life stages named in whole texts. Stem cells and serum of a stage are not that stage."""
    forms = list(LIFE.forms())
    start = F.upper(F.get(F.array(*map(lit, forms)), (col("doc_id") % len(forms)).cast("int")))
    rest = F.get(F.array(*map(lit, ("stem cells", "calf serum", "and adult tissue", "of old"))), (col("doc_id") % 4).cast("int"))
    t = F.concat(start, lit(" "), rest, lit(", "), F.coalesce("text", lit("")))
    x = k.table("documents").select("doc_id", F.regexp_extract_all(F.lower(t), lit("[a-z]+"), 0).alias("words"))
    return x.select("doc_id", F.array_join(categories_named(col("words")), ",").alias("stages"))


def scope(question: Column, aliases: dict[str, list[str]], values: dict[str, list[str]], least: int = 3) -> Column:
    """Fields that a question is about: those with an alias or one of their frequent values in it, of `least` characters
    or more, whatever the case."""
    low = F.lower(question)
    names = {f: [w.lower() for w in aliases.get(f, []) + values.get(f, []) if len(w) >= least] for f in sorted(aliases | values)}
    hits = [F.when(F.coalesce(*[F.when(low.contains(w), True) for w in words], lit(False)), f) for f, words in names.items()]
    return F.array_compact(F.array(*hits))


ALIASES = {"assay": ["assay", "technology"], "platform": ["platform", "brand", "pf"], "title": ["title", "name"]}
_FREQUENT = 20
_Q = """q AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'Samples by BRAND and pf' WHEN 1 THEN 'the Assay of parts' WHEN 2 THEN 'all promo goods in ' || lang
  WHEN 3 THEN 'made as brand#' || (doc_id % 60) ELSE 'name of ' || source END AS question FROM documents)"""


@query(f"""WITH {_Q}, v AS (SELECT * FROM (SELECT 'assay' AS field, p_type AS value, count(*) AS n FROM part GROUP BY 2 ORDER BY n DESC, value LIMIT {_FREQUENT})
 UNION ALL SELECT * FROM (SELECT 'platform', p_brand AS value, count(*) AS n FROM part GROUP BY 2 ORDER BY n DESC, value LIMIT {_FREQUENT})),
 words AS (SELECT field, lower(value) AS w FROM v WHERE length(value) >= 3 UNION ALL SELECT *
  FROM (VALUES ('assay', 'assay'), ('assay', 'technology'), ('platform', 'platform'), ('platform', 'brand'), ('title', 'title'), ('title', 'name')))
 SELECT doc_id, coalesce(string_agg(DISTINCT field, ',' ORDER BY field), '') AS fields FROM q LEFT JOIN words ON contains(lower(question), w) GROUP BY 1""")
def question_scope(k: Catalog) -> DataFrame:
    """The fields that each question is about. Only the most frequent values of a field come to the driver, a fixed number."""
    top = {f: [r[0] for r in k.series().groupBy(f).agg(count()).filter(col(f).isNotNull()).orderBy(F.desc("n"), f).limit(_FREQUENT).collect()] for f in ("assay", "platform")}
    i, text = col("doc_id") % 5, lambda c: col(c).cast("string")
    made = F.concat(lit("made as brand#"), (col("doc_id") % 60).cast("string"))
    kinds = [lit("Samples by BRAND and pf"), lit("the Assay of parts"), F.concat(lit("all promo goods in "), text("lang")), made, F.concat(lit("name of "), text("source"))]
    x = k.table("documents").select("doc_id", F.get(F.array(*kinds), i.cast("int")).alias("question"))
    return x.select("doc_id", F.array_join(scope(col("question"), ALIASES, top), ",").alias("fields"))
