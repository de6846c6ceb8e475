"""Quality rules whose cutoffs are certified on labelled documents: DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.llm.store import small_side, written

SPACE = r"[\x20\x09-\x0D]+"
_BLANKS = " \t\n\x0b\x0c\r"
#: In each stratum at most RISK of the good documents may be rejected, with probability 1 - MISS over all of them.
RISK, MISS = 0.05, 0.1
#: A good document that a cutoff rejects weighs as much as so many bad ones that it catches.
PRICE = 10
#: Cutoffs tried for each rule, from lenient to strict. They are fixed here and never taken from the labels.
CUTOFFS = {
    "symbol_share": [0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.12, 0.1, 0.08, 0.06, 0.05],
    "upper_share": [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15],
    "dup_line_share": [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15],
    "repeat_share": [0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.18, 0.16, 0.14, 0.12, 0.1],
}


def _words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(_BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE))


def measured(docs: DataFrame, doc_id: str, text: str, stratum: str, keep: list[str] | None = None) -> DataFrame:
    """One row per row of docs: doc_id, stratum, source_row (a struct of the columns `keep`), the contract's counts and
    the values of the rules."""
    row = F.struct(*keep) if keep else F.struct(F.lit(None).cast("int").alias("none"))
    x = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(stratum).cast("string").alias("stratum"), row.alias("source_row"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    x = x.select("doc_id", "stratum", "source_row", "text", _words(F.col("text")).alias("w"), F.split("text", "\n").alias("lines"))
    x = x.select(
        "doc_id",
        "stratum",
        "source_row",
        "w",
        F.filter("lines", lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count("text", F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        F.regexp_count("text", F.lit(r"\p{L}")).cast("long").alias("n_letters"),
    )
    # Windows of three words as 64-bit hashes; (hash, place) is sorted only where some hash comes twice.
    x = x.select("*", F.when(F.size("w") >= 3, F.slice(F.transform("w", lambda a, i: F.xxhash64(a, F.get("w", i + 1), F.get("w", i + 2))), F.lit(1), F.size("w") - 2)).alias("g"))
    x = x.select("*", F.when(F.size(F.array_distinct("g")) < F.size("g"), F.sort_array(F.transform("g", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("s"))
    x = x.select("*", F.filter("s", lambda a, k: (F.get("s", k - 1)["h"] == a["h"]) | (F.get("s", k + 1)["h"] == a["h"])).alias("twice"))
    covered = F.aggregate(
        F.sort_array(F.transform("twice", lambda a: a["i"])),
        F.struct(F.lit(-3).alias("at"), F.lit(0).cast("long").alias("n")),
        lambda acc, i: F.struct(i.alias("at"), (acc["n"] + F.least(F.lit(3), i - acc["at"])).alias("n")),
        lambda acc: acc["n"],
    )
    x = x.select(
        "doc_id",
        "stratum",
        "source_row",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"),
        F.size("lines").alias("n_lines"),
        "n_upper",
        "n_letters",
    )
    share = lambda a, b: (F.col(a) / F.greatest(F.col(b), F.lit(1))).cast("double")
    return x.select(
        *x.columns[:8],
        ((F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed"),
        share("n_symbols", "word_chars").alias("symbol_share"),
        share("n_upper", "n_letters").alias("upper_share"),
        share("n_dup_lines", "n_lines").alias("dup_line_share"),
        share("n_repeat_words", "n_words").alias("repeat_share"),
    )


def _at_most(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X binomial (n, p), exact, summed from logarithms of the terms; 1 where k is over the mean, as
    no bound is wanted there."""
    first = n * F.lit(math.log1p(-p))
    step = lambda i: F.log((n - i + 1) / i) + F.lit(math.log(p) - math.log1p(-p))
    tail = F.aggregate(
        F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<long>")),
        F.struct(first.alias("term"), F.exp(first).alias("sum")),
        lambda acc, i: F.struct((acc["term"] + step(i)).alias("term"), (acc["sum"] + F.exp(acc["term"] + step(i))).alias("sum")),
        lambda acc: acc["sum"],
    )
    return F.when(k > n * p, F.lit(1.0)).otherwise(tail)


def certified_cutoffs(values: DataFrame, labels: DataFrame, risk: float = RISK, miss: float = MISS) -> DataFrame:
    """(stratum, rule, cutoff) for each rule that may be used in a stratum.

    The labelled documents that pass the base rules are the holdout; a label is a number over 0 for good, 0 for bad,
    null for none. A cutoff of a rule is certified when P(Bin(n, risk / rules) <= k) <= miss / (strata * rules), with k of the
    stratum's n good documents over the cutoff: then the true rate is below risk / rules. Cutoffs are tried from
    lenient to strict and the first failure ends the sequence, so one test per rule and stratum is all that the
    correction must count (Bonferroni over these). The sum over the rules keeps the risk of a stratum. Of the certified cutoffs
    the one is taken that catches most bad documents less PRICE times the good ones it rejects, at a tie the most
    lenient; one that catches none is not used. A stratum with too few labels gets no cutoff: nothing is rejected."""
    rules = list(CUTOFFS)
    held = values.filter(~F.col("base_failed")).join(labels, "doc_id").select("stratum", "quality", *rules)
    tried = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(i).alias("place"), F.lit(c).alias("cutoff"), (F.col(r) > c).alias("over")) for r in rules for i, c in enumerate(CUTOFFS[r])])
    counts = (
        held.select("stratum", (F.col("quality") > 0).alias("good"), F.explode(tried).alias("t"))
        .groupBy("stratum", "t.rule", "t.place", "t.cutoff")
        .agg(F.count_if("good").alias("n"), F.count_if(F.col("good") & F.col("t.over")).alias("k"), F.count_if(~F.col("good") & F.col("t.over")).alias("caught"))
    )
    counts = written(counts, "tried")
    strata = max(1, counts.select("stratum").distinct().count())
    tested = counts.withColumn("passed", (_at_most(F.col("k"), F.col("n"), risk / len(rules)) <= miss / len(rules) / strata).cast("int"))
    upto = Window.partitionBy("stratum", "rule").orderBy("place")
    gain = F.col("caught") - PRICE * F.col("k")
    fit = tested.withColumn("passed", F.min("passed").over(upto)).filter("passed = 1").withColumn("gain", gain).filter("gain > 0")
    best = Window.partitionBy("stratum", "rule").orderBy(F.desc("gain"), "place")
    return fit.withColumn("rank", F.row_number().over(best)).filter("rank = 1").select("stratum", "rule", "cutoff")


def quality_rules(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", stratum: str = "lang", keep: list[str] | None = None) -> DataFrame:
    """One row per row of docs: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    kept, broken, the certified rules that the document breaks, and source_row, a struct of the columns `keep`.

    kept is false if base_failed (under 50 words, or over half of the words in repeated windows of three words), or
    if a rule's value is over its certified cutoff in the document's stratum. Null and empty texts have no words and
    so fail the base rules. A null stratum is a stratum of its own, apart from the empty one. A label counts for every
    row with its doc_id; of several labels for a doc_id the least counts, a null label or doc_id does not count.
    Columns not named are not read. Without labels only the base rules act. Windows are compared by 64-bit hashes, over
    whole texts however long. Empty table: no rows."""
    values = written(measured(docs, doc_id, text, stratum, keep), "measures")
    known = labels.filter("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    cut = certified_cutoffs(values.drop("source_row"), known).groupBy("stratum").pivot("rule", list(CUTOFFS)).agg(F.min("cutoff"))
    cut = cut.select(F.col("stratum").alias("of"), *[F.col(r).alias(f"{r}_most") for r in CUTOFFS])
    broken = F.filter(F.array(*[F.when(F.col(r) > F.col(f"{r}_most"), F.lit(r)) for r in CUTOFFS]), lambda r: r.isNotNull())
    x = values.join(small_side(written(cut, "cutoffs")), F.col("stratum").eqNullSafe(F.col("of")), "left").withColumn("broken", broken)
    kept = ~F.col("base_failed") & (F.size("broken") == 0)
    return x.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "broken", "source_row")
