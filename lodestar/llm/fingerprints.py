"""Homomorphic document fingerprints, and each document's successor by id: DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.llm.store import small_side, written

#: 64-bit hashes a paragraph; each gives two lanes that are summed modulo 2**32.
HASHES = 4
#: Votes: each of these bit positions of a phrase's hash is counted; three counters of 21 bits share a long, and what a
#: counter has beyond them stands apart. CHUNK paragraphs and phrases are counted at a time, so that no counter runs over.
PLACES, SPREAD, FIELD, CHUNK = 21, 1 | 1 << 21 | 1 << 42, (1 << 21) - 1, 1 << 20
VOTE_HASHES = 2
#: A phrase: up to eight words, ending at the end of a sentence, a cell or a line (so within one paragraph).
PHRASE = r"[^\s.!?|]+(?:[ \t]+[^\s.!?|]+){0,7}"
#: Documents in one stretch of ids.
STRETCH = 64


def fingerprints(docs: DataFrame, keys: list[str], texts: dict[str, str]) -> DataFrame:
    """One row per row of docs: its keys and, for each result name and text column of `texts`, a struct (lanes, packed, high, phrases).

    The fingerprint of a text is the sum of wide vectors, one from each of its paragraphs (lines with other than
    white space): lanes from the paragraph's hashes, summed modulo 2**32, and votes from the hashes of its phrases.
    So the order of paragraphs does not matter, equal texts have equal fingerprints, and a paragraph is added or taken
    away by adding or subtracting its vector (combined()). A null text is an empty one: all sums 0. Texts may be as long
    as a string can be: the sums of chunks are added up in wide counters."""
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), *keys, F.array(*[F.coalesce(F.col(c), F.lit("")) for c in texts.values()]).alias("t"))
    rows = rows.select("rid", *keys, F.posexplode("t").alias("which", "t"))
    lines = F.transform(F.filter(F.split("t", "\n"), lambda p: p.rlike(r"\S")), lambda p: F.struct(F.lit(True).alias("whole"), p.alias("s")))
    phrases = F.transform(F.regexp_extract_all("t", F.lit(PHRASE), 0), lambda p: F.struct(F.lit(False).alias("whole"), p.alias("s")))
    units = rows.select("rid", *keys, "which", F.posexplode_outer(F.concat(lines, phrases)).alias("at", "u"))
    units = units.select("rid", *keys, "which", F.floor(F.coalesce("at", F.lit(0)) / CHUNK).alias("chunk"), F.col("u.whole").alias("whole"), F.col("u.s").alias("s"))
    hashed = units.select(
        "rid", *keys, "which", "chunk", "whole",
        *[F.when(F.col("whole"), F.xxhash64(F.lit(i), "s")).otherwise(F.lit(0)).alias(f"h{i}") for i in range(HASHES)],
        *[F.when(~F.col("whole"), F.xxhash64(F.lit(100 + i), "s")).otherwise(F.lit(0)).alias(f"v{i}") for i in range(VOTE_HASHES)],
    )
    low = F.lit(0xFFFFFFFF)
    sums = [F.sum(part).alias(f"e{i}_{j}") for i in range(HASHES) for j, part in enumerate((F.col(f"h{i}").bitwiseAND(low), F.shiftrightunsigned(F.col(f"h{i}"), 32)))]
    votes = [F.sum(F.shiftrightunsigned(F.col(f"v{i}"), k).bitwiseAND(F.lit(SPREAD))).alias(f"p{i}_{k}") for i in range(VOTE_HASHES) for k in range(PLACES)]
    summed = hashed.groupBy("rid", *keys, "which", "chunk").agg(*sums, *votes, F.count_if(~F.col("whole")).alias("phrases"))
    lanes = F.array(*[F.col(f"e{i}_{j}").bitwiseAND(low) for i in range(HASHES) for j in (0, 1)])
    packed = F.array(*[F.col(f"p{i}_{k}") for i in range(VOTE_HASHES) for k in range(PLACES)])
    one = F.struct(lanes.alias("lanes"), packed.alias("packed"), F.array().cast("array<bigint>").alias("high"), "phrases")
    made = summed.select("rid", *keys, "which", one.alias("f"))
    x = made.groupBy("rid", *keys).agg(*[F.collect_list(F.when(F.col("which") == i, F.col("f"))).alias(name) for i, name in enumerate(texts)])
    # One chunk, or the sum of several.
    return x.select(*keys, *[F.when(F.size(name) == 1, F.get(name, F.lit(0))).otherwise(F.reduce(F.slice(name, 2, F.size(name)), F.get(name, F.lit(0)), lambda x, y: combined(x, y))).alias(name) for name in texts])


def votes(f: Column) -> Column:
    """The counters of a fingerprint's votes."""
    low = F.flatten(F.transform(f["packed"], lambda p: F.array(*[F.shiftrightunsigned(p, 21 * i).bitwiseAND(F.lit(FIELD)) for i in range(3)])))
    return F.when(F.size(f["high"]) == 0, low).otherwise(F.zip_with(low, f["high"], lambda x, h: x + h * (FIELD + 1)))


def combined(a: Column, b: Column, sign: int = 1) -> Column:
    """The fingerprint of the paragraphs of a and of b together; with sign -1 of a's without b's."""
    total = F.zip_with(votes(a), votes(b), lambda x, y: x + sign * y)
    n = VOTE_HASHES * PLACES
    field = lambda i, k: F.shiftleft(F.get(total, 3 * i + k).bitwiseAND(F.lit(FIELD)), 21 * k)
    return F.struct(
        F.zip_with(a["lanes"], b["lanes"], lambda x, y: F.pmod(x + sign * y, F.lit(1 << 32))).alias("lanes"),
        F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: field(i, 0).bitwiseOR(field(i, 1)).bitwiseOR(field(i, 2))).alias("packed"),
        F.when(F.array_max(total) > FIELD, F.transform(total, lambda x: F.shiftright(x, 21))).otherwise(F.array().cast("array<bigint>")).alias("high"),
        (a["phrases"] + sign * b["phrases"]).alias("phrases"),
    )


def as_text(f: Column) -> Column:
    """A fingerprint as hexadecimal text."""
    return F.concat_ws(".", F.array_join(F.transform(f["lanes"], lambda x: F.lpad(F.hex(x), 8, "0")), ""), F.array_join(F.transform(f["packed"], lambda x: F.hex(x)), "-"), F.hex(f["phrases"]), F.when(F.size(f["high"]) > 0, F.array_join(F.transform(f["high"], lambda x: F.hex(x)), "-")))


def likeness(a: Column, b: Column) -> Column:
    """From 0 to 1: 1 for equal fingerprints, else the cosine of the vote vectors (each phrase votes +1 or -1 at each
    place), at least 0. It estimates the share of common phrases with a standard error of about 0.09."""
    signed = lambda f: F.transform(votes(f), lambda v: (2 * v - f["phrases"]).cast("double"))
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda acc, x: acc + x)
    dot = total(F.zip_with(signed(a), signed(b), lambda x, y: x * y))
    norm = F.sqrt(total(F.transform(signed(a), lambda x: x * x)) * total(F.transform(signed(b), lambda x: x * x)))
    return F.when(a == b, F.lit(1.0)).when(norm > 0, F.least(F.greatest(dot / norm, F.lit(0.0)), F.lit(1.0))).otherwise(F.lit(0.0))


def _successors(firsts: DataFrame, few: int = 50_000) -> DataFrame:
    """(k, next) for distinct values of k, ascending, and from the last one to the first one. Values are dealt out by
    stretches, the first values of the stretches are put in order in the same way, and so on until they are few."""
    if firsts.limit(few + 1).count() <= few:
        w = Window.partitionBy(F.lit(0)).orderBy("k")
        least = F.min("k").over(Window.partitionBy(F.lit(0)))
        return firsts.select("k", F.coalesce(F.lead("k").over(w), least).alias("next"))
    within = written(firsts.select("k", F.floor(F.col("k") / STRETCH).alias("s")).select("k", "s", F.lead("k").over(Window.partitionBy("s").orderBy("k")).alias("next")), "stretches")
    heads = _successors(written(within.groupBy("s").agg(F.min("k").alias("head")), "heads").select(F.col("s").alias("k")), few)
    of = within.groupBy("s").agg(F.min("k").alias("head"))
    over = heads.join(of, heads.next == of.s).select(heads.k.alias("s"), F.col("head"))
    return within.join(over, "s", "left").select("k", F.coalesce("next", "head").alias("next"))


def with_next(docs: DataFrame, value: str, order: list[str], name: str) -> DataFrame:
    """docs with `name`: the `value` of the next row in ascending doc_id (then `order`), of the first row for the last.
    Rows are dealt out by stretches of ids, so each text is moved once; only the first row of each stretch is sent
    to the last row of the stretch before. Rows without doc_id stay where they are and get a null. Rows that repeat one
    doc_id are in one stretch."""
    nameless = docs.filter("doc_id is null").select("*", F.lit(None).cast(docs.schema[value].dataType).alias(name))
    docs = docs.filter("doc_id is not null")
    x = docs.withColumn("stretch", F.floor(F.col("doc_id") / STRETCH))
    stretches = _successors(written(x.select(F.col("stretch").alias("k")).distinct(), "stretches"))
    back = stretches.select(F.col("next").alias("stretch"), F.col("k").alias("to"))
    ids = docs.groupBy(F.floor(F.col("doc_id") / STRETCH).alias("stretch")).agg(F.min("doc_id").alias("doc_id")).join(back, "stretch")
    ids = written(ids.select("doc_id", "to"), "heads")
    heads = docs.join(small_side(ids), "doc_id").select("to", F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.col(value).alias("v")).alias("h"))
    heads = heads.groupBy("to").agg(F.min("h").alias("h")).select(F.col("to").alias("stretch"), F.col("h.v").alias("over"))
    w = Window.partitionBy("stretch").orderBy("doc_id", *order)
    x = x.select("*", F.lead(value).over(w).alias("within"), F.lead(F.lit(1)).over(w).alias("has_next"))
    x = x.join(heads, "stretch", "left")
    return x.select(*docs.columns, F.when(F.col("has_next").isNotNull(), F.col("within")).otherwise(F.col("over")).alias(name)).union(nameless)


def edited_fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text is the text with its last floor(n_chars / 2) code points replaced by the first as many (or all)
    of the next document, ascending doc_id, the first after the last. Null texts are empty. Rows of one doc_id follow
    each other by the digest of their texts. A row without doc_id has no next document: an empty one is taken, and
    near_next is null. Texts of any length are counted whole. Other columns are not read. Empty table: no rows."""
    x = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    x = with_next(x.withColumn("sha", F.sha2("text", 256)), "text", ["sha"], "next_text")
    n = F.length("text")
    edited = F.concat(F.expr("left(text, length(text) - cast(floor(length(text) / 2) as int))"), F.expr("left(coalesce(next_text, ''), cast(floor(length(text) / 2) as int))"))
    x = x.select("doc_id", "sha", n.cast("long").alias("n_chars"), "text", edited.alias("edited"))
    x = x.select("*", F.sha2("edited", 256).alias("edited_sha256"))
    f = written(fingerprints(x, ["doc_id", "sha", "n_chars", "edited_sha256"], {"f": "text", "e": "edited"}), "fingerprints")
    f = with_next(f, "f", ["sha"], "next_f")
    return f.select("doc_id", "n_chars", "edited_sha256", as_text(F.col("f")).alias("fingerprint"), as_text(F.col("e")).alias("edited_fingerprint"), likeness(F.col("f"), F.col("e")).alias("near_edited"), F.when(F.col("next_f").isNotNull(), likeness(F.col("f"), F.col("next_f"))).alias("near_next"))
