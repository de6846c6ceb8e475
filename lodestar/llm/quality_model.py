"""Quality classifier by attention-based multiple-instance learning over the passages of a document."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.recent import Recent
from lodestar.llm.sampling import arrays, fold, sampled
from lodestar.llm.store import one_thread, small_side, written

#: Rows of documents with this remainder are never learned from.
FOLDS, HELD = 3, 1
#: Words in a passage; buckets of word shapes, and of words with a trained embedding of DIM numbers each; sizes of the
#: encoding and of the attention.
PASSAGE, SHAPES, WORDS, DIM, HIDDEN, ATTEND = 64, 64, 8192, 12, 24, 12
#: Documents fitted on per label. Of a longer document than FIT_PASSAGES passages so many are fitted on in a step, evenly
#: spaced over the whole text; every document is scored on all its passages.
FIT_EACH, FIT_PASSAGES, STEPS, BATCH = 3000, 128, 1500, 64
#: Share of passages whose words are left out in a step, so that the model doesn't lean on words that it met a few times.
DROP = 0.5
_COUNTS = 6
#: Numbers of a passage beside its words' embeddings.
FEATURES = SHAPES + _COUNTS + 3


def _word(raw: bytes) -> tuple[int, ...]:
    """(shape bucket, characters, upper, digits, symbols, other marks, word bucket) of a word. A shape is its runs of kinds;
    the bucket is that of the letters and digits in lower case."""
    word, shape, n = raw.decode("utf-8", "replace"), "", [0, 0, 0, 0]
    for c in word:
        kind = "l" if c.islower() else "U" if c.isupper() else "a" if c.isalpha() else "d" if c.isdigit() else c if c < "\x80" else "o"
        n[0] += kind == "U"
        n[1] += kind == "d"
        n[2] += kind in "#*$%&|<>"
        n[3] += kind not in "lUad"
        if not shape.endswith(kind):
            shape += kind
    core = "".join(c for c in word.lower() if c.isalnum())
    return zlib.crc32(shape.encode()) % SHAPES, len(word), *n, zlib.crc32(core.encode("utf-8", "surrogatepass")) % WORDS


_words = Recent(lambda w: np.array(_word(w), np.int32).tobytes(), size=300_000)


@dataclass
class Bag:
    """The passages of a text: features, the words' buckets one after the other, and where each passage's begin. Every
    passage has a word, the bucket 0 if the text has none."""

    x: np.ndarray
    words: np.ndarray
    starts: np.ndarray

    def __len__(self) -> int:
        return len(self.x)

    def thinned(self, most: int) -> Bag:
        """At most so many passages, evenly spaced from the first to the last."""
        if len(self) <= most:
            return self
        keep = np.linspace(0, len(self) - 1, most).astype(np.int64)
        parts = [self.words[a:b] for a, b in zip(self.starts[keep], np.append(self.starts, len(self.words))[keep + 1], strict=True)]
        return Bag(self.x[keep], np.concatenate(parts), np.cumsum([0, *map(len, parts[:-1])]))


def passages(text: str | None) -> Bag:
    """One row of features per passage of PASSAGE words (the last may be shorter): the shares of word shapes, counts
    per word or character, and how much of it is new. A text without words is one passage of zeros."""
    words = (text or "").encode("utf-8", "surrogatepass").split()
    n = len(words)
    if not n:
        return Bag(np.zeros((1, FEATURES), np.float32), np.zeros(1, np.int32), np.zeros(1, np.int64))
    at = np.frombuffer(b"".join(map(_words.__getitem__, words)), np.int32).reshape(n, _COUNTS + 1)
    starts = np.arange(0, n, PASSAGE)
    size = np.diff(np.append(starts, n)).astype(np.float32)
    m, which = len(starts), np.arange(n) // PASSAGE
    shapes = np.bincount(which * SHAPES + at[:, 0], minlength=m * SHAPES).reshape(m, SHAPES) / size[:, None]
    sums = np.add.reduceat(at[:, 1:_COUNTS], starts, axis=0).astype(np.float32)
    ids = np.full(m * PASSAGE, -1, np.int64)
    ids[:n] = np.fromiter(map(zlib.crc32, words), np.int64, n)
    ids = ids.reshape(m, PASSAGE)
    same = ((ids[:, 1:] == ids[:, :-1]) & (ids[:, 1:] >= 0)).sum(1) / size
    ids.sort(1)
    new = ((ids[:, 1:] != ids[:, :-1]).sum(1) + (ids[:, 0] >= 0)) / size
    chars = np.maximum(sums[:, :1], 1)
    x = np.column_stack([shapes, sums[:, :1] / size[:, None] / 10, sums[:, 1:] / chars, size / PASSAGE, same, new, np.full(m, min(n, 500) / 500)])
    return Bag(x.astype(np.float32), at[:, _COUNTS].copy(), starts)


def together(bags: list[Bag]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(x, words, where each passage's words begin, where each text's passages begin) of several texts in a row."""
    words = np.cumsum([0, *(len(b.words) for b in bags[:-1])])
    return np.concatenate([b.x for b in bags]), np.concatenate([b.words for b in bags]), np.concatenate([b.starts + w for b, w in zip(bags, words, strict=True)]), np.cumsum([0, *(len(b) for b in bags[:-1])])


@dataclass
class Model:
    """Passage encoding tanh((features, mean embedding of its words) E + e); attention softmax(tanh(h V) * sigmoid(h U) . w);
    score sigmoid(z . c + d) of the weighted encoding z."""

    p: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, words: np.ndarray, begin: np.ndarray, starts: np.ndarray, kept: np.ndarray | None = None) -> tuple:
        """See together() for the arguments; kept: per passage, what its words' mean embedding is multiplied by."""
        p = self.p
        size = np.diff(np.append(begin, len(words))).astype(np.float32)[:, None]
        size = size if kept is None else size / np.maximum(kept, 1e-9)
        full = np.column_stack([x, np.add.reduceat(p["W"][words], begin, axis=0) / size])
        h = np.tanh(full @ p["E"] + p["e"])
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        s = (t * g) @ p["w"]
        doc = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(x))))
        a = np.exp(s - np.maximum.reduceat(s, starts)[doc])
        a /= np.add.reduceat(a, starts)[doc]
        z = np.add.reduceat(a[:, None] * h, starts, axis=0)
        return full, size, h, t, g, a, doc, z, 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"], -30, 30)))

    def gradients(self, bag: tuple, labels: np.ndarray, weights: np.ndarray, kept: np.ndarray | None = None) -> dict[str, np.ndarray]:
        """Of the mean weighted log loss of texts, through the attention to every passage and word."""
        p, (_, words, begin, starts) = self.p, bag
        full, size, h, t, g, a, doc, z, y = self.forward(*bag, kept)
        d = ((y - labels) * weights / len(labels)).astype(np.float32)
        dz = d[:, None] * p["c"]
        da = (dz[doc] * h).sum(1)
        ds = a * (da - np.add.reduceat(a * da, starts)[doc])
        du = ds[:, None] * p["w"]
        dt, dg = du * g * (1 - t * t), du * t * g * (1 - g)
        dh = (a[:, None] * dz[doc] + dt @ p["V"].T + dg @ p["U"].T) * (1 - h * h)
        each = np.repeat((dh @ p["E"][FEATURES:].T) / size, np.diff(np.append(begin, len(words))), axis=0)
        dw = np.stack([np.bincount(words, weights=each[:, i], minlength=WORDS) for i in range(DIM)], 1)
        return {"W": dw.astype(np.float32), "E": full.T @ dh, "e": dh.sum(0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ ds, "c": z.T @ d, "d": d.sum(keepdims=True)}


def start(seed: int = 3) -> Model:
    rng = np.random.default_rng(seed)
    normal = lambda *shape: rng.normal(0, shape[0] ** -0.5, shape).astype(np.float32)
    p = {"W": rng.normal(0, 0.1, (WORDS, DIM)).astype(np.float32), "E": normal(FEATURES + DIM, HIDDEN), "e": np.zeros(HIDDEN, np.float32), "V": normal(HIDDEN, ATTEND)}
    return Model(p | {"U": normal(HIDDEN, ATTEND), "w": normal(ATTEND), "c": normal(HIDDEN), "d": np.zeros(1, np.float32)})


def fit(bags: list[Bag], labels: np.ndarray, weights: np.ndarray, seed: int = 3) -> Model:
    """Adam over batches of documents."""
    rng, model = np.random.default_rng(seed), start(seed)
    p = model.p
    m, v = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}
    for step in range(1, STEPS + 1 if bags else 1):
        pick = rng.integers(0, len(bags), BATCH)
        bag = together([bags[i] for i in pick])
        kept = (rng.random((len(bag[0]), 1)) >= DROP).astype(np.float32) / (1 - DROP)
        grad = model.gradients(bag, labels[pick], weights[pick], kept)
        rate = 0.01 * (1 - step / (STEPS + 1))
        for k in p:
            m[k] += 0.1 * (grad[k] - m[k])
            v[k] += 0.001 * (grad[k] ** 2 - v[k])
            p[k] -= (0.1 if k == "W" else 1) * rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8) + rate * 1e-3 * p[k]
    return model


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bags = [passages(t).thinned(FIT_PASSAGES) for t in batch.column(1).to_pylist()]
        columns = [pa.array([b.x.reshape(-1) for b in bags], pa.list_(pa.float32())), *(pa.array([a.astype(np.int32) for a in x], pa.list_(pa.int32())) for x in ([b.words for b in bags], [b.starts for b in bags]))]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["label", "bag", "words", "starts"])


def quality_model(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", fit_each: int = FIT_EACH) -> Model:
    """Fit on about fit_each labelled documents per label, weighted back to the labels' true shares. Held-out, null and
    unlabelled rows are not learned from; of several labels of a doc_id the least counts, of several texts the least.

    Only the sampled doc_ids are broadcast (their number is checked), so of the documents only the chosen ones move.
    At most FIT_PASSAGES passages of each come to the driver, in all some 2 * fit_each * FIT_PASSAGES."""
    known = labels.filter("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.min("quality") > 0).cast("int").alias("quality"))
    few, shares = sampled(known.filter(fold(F.col("doc_id"), FOLDS) != HELD), "quality", fit_each)
    few = small_side(written(few.select("doc_id", "quality"), "sample"))
    got = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(few, "doc_id")
    got = got.groupBy("doc_id", "quality").agg(F.min("text").alias("text")).select("quality", "text")
    got = got.mapInArrow(_bags, "label int, bag array<float>, words array<int>, starts array<int>").toArrow()
    bags = [Bag(x.reshape(-1, FEATURES), w, s) for x, w, s in zip(*(arrays(got.column(i)) for i in (1, 2, 3)), strict=True)]
    rows = sorted(zip(got.column(0).to_pylist(), bags, strict=True), key=lambda r: (r[0], len(r[1]), r[1].words.tobytes(), r[1].x.tobytes()))
    y = np.array([r[0] for r in rows], np.float32)
    w = np.array([1 / shares[int(x)] for x in y], np.float32)
    return fit([r[1] for r in rows], y, w / w.mean() if len(w) else w)


def quality_scores(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", fit_each: int = FIT_EACH) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted, n_passages, top_passage (from 0, the one that the
    attention weighs most, the first at a tie).

    score is the model's probability of label 1 for the whole text; null and empty texts count as one empty passage.
    predicted is 1 for a score of 0.5 or more. A null doc_id is held out. Repeated rows come back repeated. Scores use
    the text alone. Without labels the untrained model's scores are given."""
    one_thread(docs.sparkSession)
    model = quality_model(docs, labels, doc_id, text, fit_each)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 64) for i in range(0, batch.num_rows, 64)):
                bags = [passages(t) for t in part.column(2).to_pylist()]
                sizes = np.array([len(b) for b in bags])
                *_, starts = bag = together(bags)
                *_, a, _, _, y = model.forward(*bag)
                top = [int(a[i : i + n].argmax()) for i, n in zip(starts, sizes, strict=True)]
                y = y.astype(np.float64)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(y), pa.array((y >= 0.5).astype(np.int32)), pa.array(sizes.astype(np.int64)), pa.array(top, pa.int64())],
                    names=["doc_id", "held_out", "score", "predicted", "n_passages", "top_passage"],
                )

    key = F.col(doc_id).cast("long")
    x = docs.select(key.alias("doc_id"), F.coalesce(fold(key, FOLDS) == HELD, F.lit(True)).alias("held_out"), F.col(text).alias("text"))
    return x.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, n_passages long, top_passage long")
