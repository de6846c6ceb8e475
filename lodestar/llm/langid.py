"""Language identification: averaged hashed subword embeddings with a linear softmax, and calibrated rejection."""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.recent import giving_back
from lodestar.llm.sampling import arrays, chosen, fold, sampled
from lodestar.llm.store import short_batches, written

#: Rows of documents with this remainder are never learned from.
FOLDS, HELD = 5, 0
BUCKETS, DIM, FIT_EACH, EPOCHS = 1 << 14, 16, 1300, 6
#: Share of documents predicted rightly that the calibrated rejection may turn away.
REJECT = 0.001
#: Of ROLES equal parts of the labelled rows not held out (by a hash of doc_id), the first sets the temperature, and the
#: next BOUND parts are never fitted on: with the rows that were not sampled they set the bounds of the rejection.
ROLES, BOUND = 10, 3
#: What the rejection looks at, each with an equal part of REJECT: the mean log-likelihood of the text's subwords in the
#: predicted language, the log-odds of that language, the logarithm of the share of letters among characters not blank.
STATS = ("typical", "odds", "letters")
#: Ranks of the order statistics are off by at most 1 in ACCURACY rows.
ACCURACY = 100_000
#: Where the tail begins that is carried on for languages of few rows.
TAIL = 0.1
NONE = "und"
_WORDS = re.compile(r"[^\W\d_]+")


def subwords(word: str) -> list[int]:
    """Buckets of the word with its ends marked and of its parts of two to four characters."""
    w = f"<{word}>"
    return [zlib.crc32(w[i : i + n].encode("utf-8", "surrogatepass")) % BUCKETS for n in (2, 3, 4) for i in range(len(w) - n + 1)]


def words_of(text: str | None) -> list[str]:
    """The words of letters of a text in lower case; none if it has no letter."""
    words = _WORDS.findall((text or "").lower())
    return words if any(c.isalpha() for w in words for c in w) else []


@giving_back
def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, buckets, counts) of texts: at most BUCKETS entries however long a text is."""
    for batch in batches:
        bags = []
        for text in batch.column(1).to_pylist():
            total = np.zeros(BUCKETS, np.int32)
            for w in words_of(text):
                np.add.at(total, subwords(w), 1)
            bags.append((np.flatnonzero(total).astype(np.int32), total[total > 0]))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([b for b, _ in bags], pa.list_(pa.int32())), pa.array([c for _, c in bags], pa.list_(pa.int32()))], names=["label", "buckets", "counts"])


@dataclass
class Model:
    labels: list[str]
    #: Embedding times weights: what a subword adds to the logits, before the average; and the bias.
    gain: np.ndarray
    bias: np.ndarray
    #: Natural logarithms of the subwords' shares in each language.
    likely: np.ndarray
    temperature: float

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        x = logits / self.temperature
        x = np.exp(x - x.max(-1, keepdims=True))
        return x / x.sum(-1, keepdims=True)


def fit(bags: list[tuple[str, np.ndarray, np.ndarray, bool]], seed: int = 7) -> Model:
    """Stochastic gradient descent over the documents, those marked kept for the temperature that makes their
    likelihood greatest."""
    bags = sorted((b for b in bags if len(b[1])), key=lambda b: (b[0], len(b[1]), b[1].tobytes(), b[2].tobytes()))
    labels = sorted({b[0] for b in bags})
    place = {label: i for i, label in enumerate(labels)}
    rng = np.random.default_rng(seed)
    embed = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    weights, bias = np.zeros((DIM, len(labels)), np.float32), np.zeros(len(labels), np.float32)
    order = rng.permutation(len(bags))
    held, learned = (np.array([k for k in order.tolist() if bags[k][3] == kept], np.int64) for kept in (True, False))
    seen = np.full((BUCKETS, len(labels)), 0.5)
    for k in learned.tolist():
        seen[bags[k][1], place[bags[k][0]]] += bags[k][2]
    for epoch in range(EPOCHS):
        rate = 0.5 * (1 - epoch / EPOCHS)
        for k in rng.permutation(learned).tolist():
            label, buckets, counts, _ = bags[k]
            share = (counts / counts.sum()).astype(np.float32)
            doc = share @ embed[buckets]
            logits = doc @ weights + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[place[label]] -= 1
            back = weights @ p
            weights -= rate * np.outer(doc, p)
            bias -= rate * p
            embed[buckets] -= rate * 15 * share[:, None] * back
    model = Model(labels, embed @ weights, bias, np.log(seen / seen.sum(0)), 1.0)
    if len(held):
        logits = np.array([(bags[k][2] / bags[k][2].sum()) @ model.gain[bags[k][1]] + bias for k in held])
        right = np.array([place[bags[k][0]] for k in held])
        at = np.arange(len(held))

        def loss(t: float) -> float:
            x = logits / t
            return float((np.log(np.exp(x - x.max(1, keepdims=True)).sum(1)) + x.max(1) - x[at, right]).sum())

        model.temperature = min((0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 3.0), key=loss)
    return model


class _Scorer:
    """Means of the words' logits and log-likelihoods; the words met lately are rows of a table, which is emptied
    between texts when large."""

    def __init__(self, model: Model, limit: int = 250_000):
        self.model, self.limit = model, limit
        self.each = np.concatenate([model.gain, model.likely], 1)
        self.rows, self.table = {}, np.zeros((1024, 2 * len(model.labels) + 1), np.float32)

    def sums(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The logits of the languages, and the mean log-likelihoods of the subwords in them."""
        if len(self.rows) > self.limit:
            self.rows.clear()
        get, rows = self.rows.get, self.rows
        at = []
        for w in words:
            i = get(w)
            if i is None:
                i = rows[w] = len(rows)
                if i >= len(self.table):
                    self.table = np.concatenate([self.table, np.zeros_like(self.table)])
                s = subwords(w)
                self.table[i, :-1], self.table[i, -1] = self.each[s].sum(0), len(s)
            at.append(i)
        total = self.table[at].sum(0, dtype=np.float64)
        mean, n = total[:-1] / total[-1], len(self.model.labels)
        return mean[:n] + self.model.bias, mean[n:]


def _role() -> Column:
    return F.pmod(F.xxhash64(F.lit("role"), "doc_id"), F.lit(ROLES))


def language_model(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", fit_each: int = FIT_EACH) -> tuple[Model, Column]:
    """A model fitted on about fit_each documents of each language (see sampled() for many languages), of those with a
    lang and a doc_id not held out, of several texts of a doc_id the least; and a condition on rows (doc_id, held_out, lang) that holds for labelled ones that
    had no part in it. Only bags of hashed subwords, of bounded size, come to the driver."""
    x = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    x = x.filter((fold(F.col("doc_id"), FOLDS) != HELD) & F.col("lang").isNotNull())
    bound = _role().between(1, BOUND)
    few, shares = sampled(x.filter(~bound), "lang", fit_each)
    few = few.groupBy("doc_id", "lang").agg(F.min("text").alias("text")).select(F.struct("lang", (_role() == 0).alias("kept")).alias("label"), "text")
    got = few.mapInArrow(_bags, "label struct<lang: string, kept: boolean>, buckets array<int>, counts array<int>").toArrow()
    names = got.column(0).to_pylist()
    model = fit([(n["lang"], b, c, n["kept"]) for n, b, c in zip(names, arrays(got.column(1)), arrays(got.column(2)), strict=True)])
    return model, ~F.col("held_out") & F.col("lang").isNotNull() & (bound | ~chosen("lang", shares))


def bounds(right: DataFrame, reject: float = REJECT) -> dict[str | None, tuple[float, ...]]:
    """Language -> the bounds of STATS, from written rows (lang_pred, *STATS) predicted rightly and not fitted on; None ->
    those of all other languages. Nothing only if there is no such row.

    With n rows of a language and a share a = reject / 3, a new one is under the k-th smallest with a probability of at
    most k / (n + 1), so k is a * (n + 1) rounded down. Where that gives 0, the tail is carried on as an exponential one:
    a row's distance to its language's median is under the tenth percentile u of the distances of all languages by m
    on average, so with j rows under u the bound is median + u - m * j * ((0.1 / a) ** (1 / j) - 1), that of the
    prediction of a new row when m is known from j rows. m is at least their deviation, and 1 / rows are added to it,
    so that equal rows have a bound too. One row a language comes to the driver."""
    share = reject / len(STATS)
    each = right.groupBy("lang_pred").agg(F.count("*").alias("n"), *[F.percentile_approx(x, 0.5, ACCURACY).alias(x) for x in STATS]).collect()
    if not each:
        return {}
    # Half a row and the error of the sketch less than k, so that the rank is at most k.
    places = {r.lang_pred: max(0.0, (k - 0.5) / r.n - 1 / ACCURACY) for r in each if (k := int(share * (r.n + 1)))}
    asked = sorted(set(places.values()))
    low = right.filter(F.col("lang_pred").isin(list(places))).groupBy("lang_pred").agg(*[F.percentile_approx(x, asked, ACCURACY).alias(x) for x in STATS]).collect() if places else []
    n, middle = sum(r.n for r in each), {x: F.create_map(*[F.lit(v) for r in each for v in (r.lang_pred, r[x])])[F.col("lang_pred")] for x in STATS}
    away = right.select(*[(F.col(x) - middle[x]).alias(x) for x in STATS])
    tenth = away.agg(*[F.percentile_approx(x, TAIL, ACCURACY).alias(x) for x in STATS]).first()
    spread = away.agg(*[f.alias(f"{x}_{i}") for x in STATS for i, f in enumerate((F.mean(F.when(F.col(x) < tenth[x], tenth[x] - F.col(x))), F.stddev_pop(x)))]).first()
    j = max(1.0, TAIL * n)
    reach = {x: tenth[x] - (max(spread[f"{x}_0"] or 0.0, spread[f"{x}_1"]) + 1 / n) * j * ((TAIL / share) ** (1 / j) - 1) for x in STATS}
    found = {r.lang_pred: tuple(r[x] + reach[x] for x in STATS) for r in each}
    found |= {r.lang_pred: tuple(float(r[x][asked.index(places[r.lang_pred])]) for x in STATS) for r in low}
    # A language of which no row was predicted rightly has the lowest bounds of the others.
    return found | {None: tuple(min(b[i] for b in found.values()) for i in range(len(STATS)))}


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", fit_each: int = FIT_EACH, keep: list[str] | None = None) -> DataFrame:
    """One row per row of docs: doc_id, held_out, lang_pred, score, rejected, and source_row, a struct of the columns `keep`.

    lang_pred is the likeliest learned language of the whole text, `und` with score 0 if the text is null or has no
    letter (or if nothing was learned); score is its calibrated probability. rejected: `und`, or a statistic (STATS)
    under its bound, see bounds(). A null doc_id is held out. Repeated rows come back repeated. Predictions use the
    text alone."""
    short_batches(docs.sparkSession)
    model, apart = language_model(docs, doc_id, text, lang, fit_each)
    row = F.struct(*(keep or [])) if keep else F.struct(F.lit(None).cast("int").alias("none"))
    key = F.col(doc_id).cast("long")
    x = docs.select(key.alias("doc_id"), F.coalesce(fold(key, FOLDS) == HELD, F.lit(True)).alias("held_out"), F.col(lang).alias("lang"), row.alias("source_row"), F.col(text).alias("text"))
    x = x.select("doc_id", "held_out", F.when(apart, F.col("lang")).alias("apart"), "source_row", "text")
    schema = f"doc_id long, held_out boolean, apart string, source_row {x.schema['source_row'].dataType.simpleString()}, lang_pred string, score double, " + ", ".join(f"{c} double" for c in STATS)

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(model)
        for batch in batches:
            for part in (batch.slice(i, 1000) for i in range(0, batch.num_rows, 1000)):
                out = []
                for t in part.column(4).to_pylist():
                    words = words_of(t) if model.labels else []
                    if not words:
                        out.append((NONE, 0.0, None, None, None))
                        continue
                    logits, likely = scorer.sums(words)
                    p = model.probabilities(logits)
                    top = int(p.argmax())
                    odds = float(np.log(max(p[top], 1e-12) / max(p.sum() - p[top], 1e-12)))
                    out.append((model.labels[top], float(p[top]), float(likely[top]), odds, math.log(sum(map(len, words)) / len("".join(t.split())))))
                c = list(zip(*out, strict=True)) or [()] * 5
                kinds = (pa.string(), *[pa.float64()] * 4)
                yield pa.RecordBatch.from_arrays([*part.columns[:4], *(pa.array(x, k) for x, k in zip(c, kinds, strict=True))], names=["doc_id", "held_out", "apart", "source_row", "lang_pred", "score", *STATS])

    scored = written(x.mapInArrow(run, schema), "languages")
    least = bounds(scored.filter("apart = lang_pred"))
    under = F.lit(False)
    if least:
        rest = least[None]
        named = {x: v for x, v in least.items() if x is not None}
        for i, x in enumerate(STATS):
            of = F.create_map(*[F.lit(v) for pair in named.items() for v in (pair[0], pair[1][i])])
            under = under | (F.col(x) < F.coalesce(F.try_element_at(of, F.col("lang_pred")), F.lit(rest[i])))
    return scored.select("doc_id", "held_out", "lang_pred", "score", ((F.col("lang_pred") == NONE) | F.coalesce(under, F.lit(False))).alias("rejected"), "source_row")
