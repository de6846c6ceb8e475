"""License scans: windows of documents' words against license templates by Dice's coefficient; DataFrame functions only."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import license_texts

#: Least Dice coefficient of the sets of word bigrams.
LEAST = 0.75
#: Templates have at most so many words in all: they are part of every task's plan.
MOST_WORDS = 1_000_000
#: Beginnings of windows are gathered by this part of the template's length, from this share of its bigrams up.
SPAN, VOTES = 8, 0.25


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), where value is computed once however often f uses it."""
    return F.transform(F.array(value), f)[0]


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _bigrams(words: Column) -> Column:
    """Hashes of the bigrams of words in turn; a single word is its own bigram."""
    two = lambda w: F.slice(F.transform(w, lambda a, i: F.xxhash64(a, F.get(w, i + 1))), F.lit(1), F.greatest(F.size(w) - 1, F.lit(1)))
    return two(words)


def _given(spark: SparkSession, templates: DataFrame | None, least: float) -> tuple[str, str, int]:
    """As JSON: the templates (number, license, distinct bigrams, their number, words, least overlap) and all their
    bigrams; and the least overlap of any. Templates without words have nothing to compare."""
    if templates is None:
        templates = spark.createDataFrame(license_texts.templates(), "license string, text string")
    x = templates.select(F.col("license").cast("string").alias("license"), _words(F.col("text")).alias("w")).filter("size(w) > 0 and license is not null")
    total = x.agg(F.sum(F.size("w"))).first()[0] or 0
    if total > MOST_WORDS:
        raise ValueError(f"templates have {total} words, over {MOST_WORDS}")
    rows = sorted(x.select("license", F.size("w").alias("words"), F.array_distinct(_bigrams(F.col("w"))).alias("first"), _bigrams(F.col("w")).alias("all")).distinct().collect())
    made = [{"license": r.license, "words": r.words, "grams": r.first, "at": [r.all.index(g) for g in r.first], "least": -int(-len(r.first) * least // (2 - least))} for r in rows]
    return json.dumps(made), json.dumps(sorted({g for t in made for g in t["grams"]})), min((t["least"] for t in made), default=1 << 30)


_TEMPLATE = "struct<license: string, words: int, grams: array<bigint>, at: array<int>, least: int>"


def _windows(g: Column, t: Column, least: float) -> Column:
    """The windows of the bigrams g whose Dice coefficient with template t is at least `least`.

    Each bigram of t in g votes for where the template would begin; votes are gathered in bins of 1 / SPAN of its length. A bin
    with VOTES of the template's bigrams or more gives one window: from its most voted beginning (at a tie the first),
    cut at the text's start, of as many words as the template."""
    bin_ = lambda s: F.floor(s / F.greatest(F.lit(1), F.floor(t["words"] / SPAN))).cast("int")
    votes = F.filter(F.transform(g, lambda x, i: F.when(F.array_contains(t["grams"], x), i - F.get(t["at"], F.array_position(t["grams"], x).cast("int") - 1))), lambda s: s.isNotNull())

    def begins(votes: Column) -> Column:
        """The most voted beginning of each bin with enough votes: one walk over the votes in order."""
        enough = F.lit(VOTES) * F.size(t["grams"])
        number = lambda x: F.lit(x).cast("int")
        flushed = lambda a: F.when(a["n"] >= enough, F.array_append(a["out"], a["best"])).otherwise(a["out"])

        def step(a: Column, s: Column) -> Column:
            same = F.coalesce(a["bin"] == bin_(s), F.lit(False))
            times = F.when(same & (a["at"] == s), a["times"] + 1).otherwise(number(1))
            better = ~same | (times > a["most"])
            return F.struct(
                bin_(s).alias("bin"), F.when(same, a["n"] + 1).otherwise(number(1)).alias("n"), s.alias("at"), times.alias("times"),
                F.when(better, s).otherwise(a["best"]).alias("best"), F.when(better, times).otherwise(a["most"]).alias("most"), F.when(same, a["out"]).otherwise(flushed(a)).alias("out"),
            )

        start = F.struct(number(None).alias("bin"), number(0).alias("n"), number(None).alias("at"), number(0).alias("times"), number(None).alias("best"), number(0).alias("most"), F.array().cast("array<int>").alias("out"))
        return F.reduce(F.array_sort(votes), start, step, flushed)

    def dice(s: Column) -> Column:
        at = F.greatest(s, F.lit(0))
        w = F.array_distinct(F.slice(g, at + 1, F.greatest(F.lit(1), t["words"] - 1 - (at - s))))
        return _let(w, lambda w: F.struct(t["license"].alias("license"), at.alias("word_no"), (2 * F.size(F.array_intersect(w, t["grams"])) / (F.size(w) + F.size(t["grams"]))).alias("dice")))

    return F.filter(F.transform(begins(votes), dice), lambda r: r["dice"] >= least)


def license_matches(docs: DataFrame, text: str = "text", templates: DataFrame | None = None, least: float = LEAST) -> DataFrame:
    """docs with `matches`: an array of (license, word_no, dice) of the whole text's windows of words that are like a
    template: where the window begins (from 0), and 2 * common / (bigrams of the window + bigrams of the template) over
    sets of word bigrams, `least` or more.

    Texts and templates are normalised to lower-case words of letters and digits, so wrapped lines, comment marks and
    other words around a notice do not matter. A template is a candidate only if the text has least / (2 - least) of its
    bigrams, as many as a window of any size needs for `least`; other templates and most texts end there. templates
    has columns license and text (of any size up to MOST_WORDS words); rows without either or without words are not used.
    Windows may overlap and templates may be alike, so a notice can give several matches. The time grows with the words of a
    text and the windows in it, however long it is. Null and empty texts have no matches. An empty table gives no rows. Every row comes back, repeated ones and those without doc_id too."""
    each, every, fewest = _given(docs.sparkSession, templates, least)
    all_ = F.from_json(F.lit(every), "array<bigint>")
    given = F.from_json(F.lit(each), f"array<{_TEMPLATE}>")
    none = F.array().cast("array<struct<license: string, word_no: int, dice: double>>")

    def of(g: Column, hit: Column) -> Column:
        fit = F.filter(given, lambda t: F.size(F.array_intersect(hit, t["grams"])) >= t["least"])
        return F.when(F.size(hit) >= fewest, F.flatten(F.transform(fit, lambda t: _windows(g, t, least)))).otherwise(none)

    # One pass over a text gives its bigrams; _let keeps them from being made again for each use.
    found = _let(_words(F.coalesce(F.col(text), F.lit(""))), lambda w: F.when(F.size(w) > 0, _let(_bigrams(w), lambda g: _let(F.array_intersect(g, all_), lambda hit: of(g, hit)))).otherwise(none))
    return docs.select("*", found.alias("matches"))


def license_scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: DataFrame | None = None, least: float = LEAST) -> DataFrame:
    """One row per row of docs: doc_id, n_matches (windows that match, see license_matches), license (the best match's, at a
    tie the first in alphabetical order; null for none), dice (its coefficient, 0 for none). Nothing is shuffled."""
    x = license_matches(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), "text", templates, least)
    x = x.select("doc_id", F.size("matches").cast("long").alias("n_matches"), F.array_min(F.transform("matches", lambda m: F.struct((-m["dice"]).alias("d"), m["license"].alias("license")))).alias("best"))
    return x.select("doc_id", "n_matches", F.col("best.license").alias("license"), F.coalesce(-F.col("best.d"), F.lit(0.0)).alias("dice"))
