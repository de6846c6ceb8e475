"""Language-model scoring: a log-bilinear model trained by noise-contrastive estimation, over exact corpus counts."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.sampling import fold
from lodestar.llm.store import dropped, most_frequent, one_thread, written

#: Rows of documents with this remainder are never learned from.
FOLDS, HELD = 7, 2
#: Words with an embedding of their own (the most frequent), and embeddings that all other words share by a hash.
WORDS, BUCKETS = 16_000, 384
#: Words whose counts every task holds (the most frequent); words over LONGEST bytes are known by their digest.
KNOWN, LONGEST = 300_000, 64
#: Words before a token that predict it; size of the embeddings; symbols in a class.
CONTEXT, DIM, WIDTH = 2, 16, 128
#: Noise symbols and noise classes that the tokens of a batch share; tokens in a batch; step size.
NOISE, CLASS_NOISE, BATCH, RATE = 32, 16, 2048, 0.08
#: Documents are dealt by a hash into shards of about so many tokens, and each shard's into ROUNDS parts. In a round every
#: shard trains on its part from the same parameters, and their mean is where the next round begins.
SHARD, ROUNDS = 5_000_000, 4
#: Training meets at least so many tokens: the tokens of a smaller corpus are gone over again, PASSES times at most.
LEAST, PASSES = 500_000, 6
#: Means of parameters are added up as integers of this unit, so that they do not depend on the order of addition.
UNIT = 1 << 28
#: Distinct words that a task counts before it gives them out.
FLUSH = 200_000


def word_key(word: bytes) -> bytes:
    """A word, or for one over LONGEST bytes its digest behind a byte that no UTF-8 text has."""
    return word if len(word) <= LONGEST else b"\xff" + hashlib.md5(word).digest()


@dataclass
class Stats:
    """Counts of the KNOWN words, sums by bucket, totals, and the symbols: the end of a text, words, buckets of the other
    words. Symbols are numbered by falling counts, and WIDTH that follow each other are a class."""

    known: list[bytes]
    counts: np.ndarray
    words: int
    bucket_mass: np.ndarray
    tokens: int
    distinct: int
    texts: int
    made: dict = field(default_factory=dict)

    def __getstate__(self):
        return self.__dict__ | {"made": {}}

    def __post_init__(self):
        mass = np.concatenate([[self.texts], self.counts[: self.words], self.bucket_mass]).astype(np.float64)
        order = np.argsort(-mass, kind="stable")
        self.rank = np.empty(len(mass), np.int32)
        self.rank[order] = np.arange(len(mass))
        self.share = (mass[order] + 1e-3) / (mass.sum() + 1e-3 * len(mass))
        self.classes = -(-len(mass) // WIDTH)
        self.class_share = np.add.reduceat(self.share, np.arange(0, len(mass), WIDTH))
        self.end = int(self.rank[0])

    def bucket(self, key: bytes) -> int:
        return int(self.rank[1 + self.words + zlib.crc32(key) % BUCKETS])

    def lookups(self) -> tuple[dict, np.ndarray, np.ndarray]:
        """word key -> place, and per place its symbol (one more for the place -1) and log10(count + 1). Made once a process."""
        if not self.made:
            symbol = np.array([self.rank[1 + i] if i < self.words else self.bucket(w) for i, w in enumerate(self.known)] + [0], np.int32)
            self.made.update(of={w: i for i, w in enumerate(self.known)}, symbol=symbol, log=np.log10(self.counts + 1.0))
        return self.made["of"], self.made["symbol"], self.made["log"]

    def start(self, seed: int = 11) -> dict[str, np.ndarray]:
        """Parameters before training, the same in every task: position matrices C, embeddings r of symbols that predict;
        embeddings and biases q of symbols and k of classes that are predicted. Biases are logarithms of shares."""
        rng, n = np.random.default_rng(seed), len(self.share)
        made = lambda rows, share: np.column_stack([rng.normal(0, 0.05, (rows, DIM)), np.log(share)]).astype(np.float32)
        near = np.stack([np.eye(DIM) * 0.7**j for j in range(CONTEXT)]).astype(np.float32)
        return {"r": rng.normal(0, 0.3, (n, DIM)).astype(np.float32), "C": near, "q": made(n, self.share), "k": made(self.classes, self.class_share)}


def cut(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct words of texts, and of each word where it stands its text and its number among them."""
    trimmed = pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words = pc.ascii_split_whitespace(trimmed)
    size, flat = words.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), words.flatten()
    none = pc.binary_length(trimmed).to_numpy(zero_copy_only=False) == 0  # such a text is cut into one empty word
    if none.any():
        flat, size[none] = flat.filter(pa.array(np.repeat(~none, size))), 0
    flat = flat.cast(pa.binary()).dictionary_encode()
    distinct = pc.binary_join(pa.ListArray.from_arrays([0, len(flat.dictionary)], flat.dictionary), b" ")[0].as_py().split()  # several times as fast as to_pylist
    return distinct, np.repeat(np.arange(len(size)), size), flat.indices.to_numpy()


def _merged(rows: np.ndarray, grads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows and the sums of their gradients."""
    order = np.argsort(rows.astype(np.uint16), kind="stable")  # symbols are 16-bit numbers, which numpy sorts by digits
    rows = rows[order]
    starts = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
    times = np.diff(starts, append=len(rows))
    out, more = grads.take(order[starts], 0), times > 1  # most rows come once; reduceat takes its time for each of them
    if more.any():
        times = times[more]
        out[more] = np.add.reduceat(grads.take(order[np.repeat(more, np.diff(starts, append=len(rows)))], 0), np.cumsum(times) - times)
    return rows[starts], out


def _logistic(x: np.ndarray) -> np.ndarray:
    """1 / (1 + exp(-x)) in the place of x."""
    np.clip(x, -30, 30, out=x)
    np.exp(np.negative(x, out=x), out=x)
    x += 1
    return np.reciprocal(x, out=x)


#: Parameters, and the sums of their squared gradients.
State = tuple[dict[str, np.ndarray], dict[str, np.ndarray]]


def begun(stats: Stats) -> State:
    p = stats.start()
    return p, {k: np.full_like(x, 1e-4) for k, x in p.items()}


class Trainer:
    """Stochastic gradient steps of noise-contrastive estimation over batches of (context, token)."""

    def __init__(self, stats: Stats, seed: int | tuple[int, ...], begin: State | None = None):
        """begin: parameters and sums of squared gradients to go on from; else the start."""
        p, sums = begin or begun(stats)
        self.p, self.sums, self.rng = ({k: x.copy() for k, x in p.items()}, {k: x.copy() for k, x in sums.items()}, np.random.default_rng(seed))
        self.met = {k: np.zeros(len(x)) for k, x in self.p.items()}
        self.draws = {"q": (np.cumsum(stats.share), np.log(NOISE * stats.share).astype(np.float32), NOISE), "k": (np.cumsum(stats.class_share), np.log(CLASS_NOISE * stats.class_share).astype(np.float32), CLASS_NOISE)}

    def _moved(self, name: str, rows, grad: np.ndarray) -> None:
        """rows: distinct numbers, or all of them for None."""
        x, sums = self.p[name], self.sums[name]
        total = grad * grad
        total += sums if rows is None else sums.take(rows, 0)
        move = RATE * grad
        move /= np.sqrt(total)
        if rows is None:
            sums[:], x[:] = total, x - move
        else:
            sums[rows], x[rows] = total, x.take(rows, 0) - move

    def gradients(self, name: str, h: np.ndarray, right: np.ndarray, noise: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of a batch's loss, by h (with a column of ones), by the rows of the right symbols and by those of the noise.

        The loss is -log s(right) - sum log(1 - s(noise)), s the logistic function of score - log(noise tokens * share)."""
        table, shift = self.p[name], self.draws[name][1]
        own, others = table.take(right, 0), table.take(noise, 0)
        a = _logistic(np.einsum("ij,ij->i", h, own) - shift.take(right))[:, None] - 1
        b = _logistic(h @ others.T - shift.take(noise))
        own *= a
        own += b @ others
        return own, a * h, b.T @ h

    def step(self, context: np.ndarray, token: np.ndarray) -> None:
        p, n = self.p, len(token)
        before = [p["r"].take(context[:, j], 0) for j in range(CONTEXT)]
        h = np.ones((n, DIM + 1), np.float32)
        h[:, :DIM] = sum(x @ c for x, c in zip(before, p["C"], strict=True))
        dh = np.zeros_like(h)
        for name, right in (("q", token), ("k", token // WIDTH)):
            cdf, _, m = self.draws[name]
            noise = np.minimum(np.searchsorted(cdf, self.rng.random(m)), len(cdf) - 1)
            g, own, others = self.gradients(name, h, right, noise)
            dh += g
            rows, grad = _merged(np.concatenate([right, noise]), np.concatenate([own, others]))
            self._moved(name, rows, grad)
            self.met[name][rows] += 1
        dh = dh[:, :DIM]
        rows, grad = _merged(context.T.reshape(-1), np.concatenate([dh @ c.T for c in p["C"]]))
        self._moved("C", None, np.stack([x.T @ dh for x in before]))
        self._moved("r", rows, grad)
        self.met["r"][rows] += 1
        self.met["C"] += 1

    def batches(self, context: np.ndarray, token: np.ndarray) -> None:
        for i in range(0, len(token), BATCH):
            self.step(context[i : i + BATCH], token[i : i + BATCH])

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(key, times met, values) of the rows that were met; keys number the rows of all parameters and then of all sums,
        which are given by their binary logarithms."""
        keys, met, values, first = [], [], [], 0
        for group in (self.p, {k: np.log2(x) for k, x in self.sums.items()}):
            for name, x in group.items():
                flat, times = x.reshape(-1, x.shape[-1]), np.repeat(self.met[name], x[0].size // x.shape[-1])
                at = np.flatnonzero(times)
                keys.append(first + at)
                met.append(times[at])
                values.append(np.pad(flat[at], ((0, 0), (0, DIM + 1 - flat.shape[1]))))
                first += len(flat)
        return np.concatenate(keys), np.concatenate(met), np.concatenate(values)


def replaced(state: State, keys: np.ndarray, values: np.ndarray) -> State:
    """state with other values in the rows of these keys, as Trainer.rows gives them."""
    out, first = ({k: x.copy() for k, x in state[0].items()}, {k: np.log2(x) for k, x in state[1].items()}), 0
    for group in out:
        for x in group.values():
            flat = x.reshape(-1, x.shape[-1])
            own = (keys >= first) & (keys < first + len(flat))
            flat[keys[own] - first] = values[own][:, : flat.shape[1]]
            first += len(flat)
    return out[0], {k: np.exp2(x) for k, x in out[1].items()}


def examples(symbols: list[np.ndarray], end: int) -> tuple[np.ndarray, np.ndarray]:
    """(context, token) of texts given as symbols without their end: the CONTEXT symbols before, the nearest first, ends
    before the first word."""
    pad = np.full(CONTEXT, end, np.int32)
    stream = np.concatenate([x for s in symbols for x in (pad, s, pad[:1])] or [pad[:0]])
    sizes = np.array([len(s) + 1 for s in symbols], np.int64)
    at = np.arange(sizes.sum()) + np.repeat(CONTEXT * np.arange(1, len(symbols) + 1), sizes)
    return np.stack([stream[at - 1 - j] for j in range(CONTEXT)], 1) if len(at) else np.empty((0, CONTEXT), np.int32), stream[at]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word key, count) of texts, given out whenever FLUSH keys have gathered."""
    seen: dict[bytes, int] = {}

    def given() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(map(word_key, seen), pa.binary()), pa.array(seen.values(), pa.int64())], names=["word", "c"])
        seen.clear()
        return out

    for batch in batches:
        for part in (batch.slice(i, 2000) for i in range(0, batch.num_rows, 2000)):
            words, _, number = cut(part.column(0))
            for w, n in zip(words, np.bincount(number, minlength=len(words)).tolist(), strict=True):
                seen[w] = seen.get(w, 0) + n
            if len(seen) >= FLUSH:
                yield given()
    yield given()


def places(stats: Stats, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Of words: places among the known words (-1 for none), symbols, and the keys of those without a place."""
    of, symbol, _ = stats.lookups()
    at = np.fromiter(map(of.get, words, repeat(-1)), np.int64, len(words))
    far = np.flatnonzero(at < 0).tolist()
    for i in far:
        if len(words[i]) > LONGEST:
            at[i] = of.get(word_key(words[i]), -1)
    rest = [word_key(words[i]) for i in far if at[i] < 0]
    s = symbol[at]
    s[at < 0] = stats.rank[1 + stats.words + np.fromiter(map(zlib.crc32, rest), np.int64, len(rest)) % BUCKETS]
    return at, s, rest


class Steps:
    """Cuts a stream of texts into examples, BATCH tokens at a time, wherever the rows' batches end."""

    def __init__(self, end: int):
        self.end, self.symbols, self.size = end, [], 0
        self.left = examples([], end)

    def add(self, symbols: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        self.symbols.append(symbols)
        self.size += len(symbols) + 1
        if self.size >= 16 * BATCH:
            yield from self._cut()

    def rest(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        yield from self._cut()
        if len(self.left[1]):
            yield self.left

    def _cut(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        context, token = (np.concatenate([a, b]) for a, b in zip(self.left, examples(self.symbols, self.end), strict=True))
        whole = len(token) // BATCH * BATCH
        for i in range(0, whole, BATCH):
            yield context[i : i + BATCH], token[i : i + BATCH]
        self.left, self.symbols, self.size = (context[whole:], token[whole:]), [], 0


def _trained(held, begin, number: int, passes: int):
    """For mapInArrow over (shard, symbols), sorted by shard: what each shard makes of the parameters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stats, shard = held.value, None

        def given() -> pa.RecordBatch:
            for part in steps.rest():
                met(part)
            for _ in range(passes - 1):
                for part in kept:
                    trainer.step(*part)
            keys, times, values = trainer.rows()
            units = np.rint(times[:, None] * values * UNIT).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(times.astype(np.int64)), *(pa.array(units[:, i]) for i in range(DIM + 1))], names=["key", "met", *(f"v{i}" for i in range(DIM + 1))])

        def met(part) -> None:
            trainer.step(*part)
            if passes > 1:
                kept.append(part)

        for batch in batches:
            for at, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if at != shard:
                    if shard is not None:
                        yield given()
                    shard, trainer, steps, kept = at, Trainer(stats, (at, number), begin.value), Steps(stats.end), []
                for part in steps.add(np.frombuffer(raw, np.uint16)):
                    met(part)
        if shard is not None:
            yield given()

    return run


def train(encoded: DataFrame, stats: Stats, held) -> dict[str, np.ndarray]:
    """Parameters trained over all learned texts (place, symbols), in ROUNDS rounds. The shard, the round and the order of a
    text follow from its `place`, a hash of it, and the number of shards from the corpus, so the result does not depend on
    how the table is split. After a round each row of the parameters is the mean over the shards that met it, weighted by
    how often. What comes to the driver has the size of the model."""
    sc = encoded.sparkSession.sparkContext
    shards = max(1, round(stats.tokens / SHARD))
    passes = min(PASSES, max(1, -(-LEAST // stats.tokens))) if stats.tokens else 1
    columns = [f"v{i}" for i in range(DIM + 1)]
    dealt = encoded.select(F.pmod("place", F.lit(shards)).cast("int").alias("shard"), F.pmod(F.shiftright("place", 32), F.lit(ROUNDS)).alias("turn"), "place", "symbols")
    state = begun(stats)
    for number in range(ROUNDS if stats.tokens else 0):
        begin = sc.broadcast(state)
        part = dealt.filter(F.col("turn") == number).repartition(shards, "shard").sortWithinPartitions("shard", "place", "symbols").select("shard", "symbols")
        rows = part.mapInArrow(_trained(held, begin, number, passes), "key long, met long, " + ", ".join(f"{c} long" for c in columns))
        got = rows.groupBy("key").agg(*[F.sum(c).alias(c) for c in ("met", *columns)]).toArrow()
        times = got.column("met").to_numpy()[:, None] * float(UNIT)
        state = replaced(state, got.column("key").to_numpy(), (np.column_stack([got.column(c).to_numpy() for c in columns]) / times).astype(np.float32))
        begin.destroy()
    return state[0]


@dataclass
class Scorer:
    """Normalised log10 probabilities: of a token's class among all classes, then of the token within its class."""

    context: list[np.ndarray]
    classes: np.ndarray
    symbols: np.ndarray

    @staticmethod
    def of(p: dict[str, np.ndarray]) -> Scorer:
        n = len(p["k"])
        q = np.zeros((n * WIDTH, DIM + 1), np.float32)
        q[:, DIM] = -1e4
        q[: len(p["q"])] = p["q"]
        # The column of ones that biases are multiplied by comes with the nearest symbol.
        context = [np.pad(p["r"] @ c, ((0, 0), (0, 1)), constant_values=float(j == 0)) for j, c in enumerate(p["C"])]
        return Scorer(context, p["k"], q.reshape(n, WIDTH, DIM + 1))

    def log10(self, context: np.ndarray, token: np.ndarray, chunk: int = 65536) -> np.ndarray:
        out = np.empty(len(token))
        for i in range(0, len(token), chunk):
            c, t = context[i : i + chunk], token[i : i + chunk]
            kind = (t // WIDTH).astype(np.uint16)
            order = np.argsort(kind, kind="stable")
            c, kind, t = c.take(order, 0), kind[order], t[order]
            h = self.context[0].take(c[:, 0], 0)
            for j, x in enumerate(self.context[1:], 1):
                h += x.take(c[:, j], 0)
            got = _log_softmax(h, self.classes, kind)
            starts = np.flatnonzero(np.concatenate([[True], kind[1:] != kind[:-1]]))
            for a, b in zip(starts, [*starts[1:], len(kind)], strict=True):
                got[a:b] += _log_softmax(h[a:b], self.symbols[kind[a]], t[a:b] % WIDTH)
            out[i : i + chunk][order] = got
        return out / np.log(10)


def _log_softmax(h: np.ndarray, table: np.ndarray, at: np.ndarray, block: int = 1024) -> np.ndarray:
    """Of the scores h @ table.T, the logarithms of the shares of those at the places `at`. A block's scores fit the cache."""
    out, ones, turned = np.empty(len(at), h.dtype), np.ones(len(table), h.dtype), table.T
    for i in range(0, len(at), block):
        x = h[i : i + block]
        scores = x @ turned
        own = scores[np.arange(len(x)), at[i : i + block]]
        with np.errstate(over="ignore", divide="ignore"):
            total = np.log(np.exp(scores, out=scores) @ ones)
        odd = ~np.isfinite(total)
        if odd.any():  # scores too large or small for their exponentials
            scores = x[odd] @ turned
            top = scores.max(1)
            total[odd] = top + np.log(np.exp(scores - top[:, None]).sum(1))
        out[i : i + block] = own - total
    return out


def corpus_stats(texts: DataFrame) -> tuple[Stats, DataFrame]:
    """Stats of the learned texts (a column `text`, no nulls), and the written counts (word, c) of all word keys."""
    counts = written(texts.mapInArrow(_counted, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c")), "counts")
    n_texts = texts.count()
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    top = most_frequent(counts, "c", KNOWN).toArrow()
    known, c = top.column(0).to_pylist(), top.column(1).to_numpy()
    order = sorted(range(len(known)), key=lambda i: (-c[i], known[i]))
    known, c = [known[i] for i in order], c[order].astype(np.float64)
    words = min(WORDS, len(known))
    mass = np.ones(BUCKETS)
    for b, m, k in counts.groupBy(F.pmod(F.crc32("word"), F.lit(BUCKETS))).agg(F.sum("c"), F.count("*")).collect():
        mass[b] += m + k
    for w, m in zip(known[:words], c, strict=False):
        mass[zlib.crc32(w) % BUCKETS] -= m + 1
    return Stats(known, c, words, mass, int(total) + n_texts, int(distinct) + (n_texts > 0), n_texts), counts


def _encoded(held):
    """For mapInArrow over (rid, doc_id, held_out, place, text): counts of the words that every task knows, the other words,
    and the symbols of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stats = held.value
        *_, log = stats.lookups()
        end, shared = np.log10(stats.texts + 1.0), np.zeros(len(stats.rank))
        hashed, buckets = np.zeros(len(stats.rank), bool), stats.rank[1 + stats.words :]
        shared[buckets], hashed[buckets] = np.log10(stats.bucket_mass), True
        for batch in batches:
            for part in (batch.slice(i, 1000) for i in range(0, batch.num_rows, 1000)):
                n, (words, row, number) = part.num_rows, cut(part.column(4))
                at, s, rest = places(stats, words)
                there, logs = at >= 0, np.zeros(len(words))
                logs[there] = log[at[there]]
                more = np.where(hashed[s], logs - shared[s], 0.0)
                added = lambda x: np.bincount(row, x[number], n).astype(np.float64)  # noqa: B023, E731 (without words they are integers)
                ends = lambda of: pa.array(np.append(0, np.cumsum(np.bincount(of, minlength=n))), pa.int32())  # noqa: B023, E731
                # The other words of a text, each once, and how often it has them.
                far = ~there[number]
                few, times = np.unique(row[far] * max(1, len(rest)) + (np.cumsum(~there) - 1)[number[far]], return_counts=True)
                few_row, few = few // max(1, len(rest)), few % max(1, len(rest))
                size = np.bincount(row, minlength=n)
                symbols = pa.Array.from_buffers(pa.binary(), n, [None, pa.array(np.append(0, 2 * np.cumsum(size)), pa.int32()).buffers()[1], pa.py_buffer(s[number].astype(np.uint16))])
                made = [pa.array(x) for x in (size + 1, added(there).astype(np.int64) + (stats.texts > 0), added(logs) + end, added(more))]
                made += [pa.ListArray.from_arrays(ends(few_row), x) for x in (pa.array(rest, pa.binary()).take(pa.array(few)), pa.array(times, pa.int64()))] + [symbols]
                yield pa.RecordBatch.from_arrays([*part.columns[:4], *made], names=["rid", "doc_id", "held_out", "place", "n_tokens", "n_known", "logs", "more", "rest", "times", "symbols"])

    return run


def _scored(end: int, model):
    """For mapInArrow over (more, symbols): `score`, put before them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer.of(model.value)
        for batch in batches:
            for part in (batch.slice(i, 200) for i in range(0, batch.num_rows, 200)):
                symbols = [np.frombuffer(x, np.uint16) for x in part.column(1).to_pylist()]
                each = scorer.log10(*examples(symbols, end))
                starts = np.cumsum([0, *(len(s) + 1 for s in symbols[:-1])])
                score = np.add.reduceat(each, starts) + part.column(0).to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(score), *part.columns[2:]], names=["score", *part.schema.names[2:]])

    return run


def lm_scores(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are the words of the whole text, A-Z in lower case, and one end. Counts are exact and over all documents
    that are not held out. base_score is the add-one unigram log10 probability. score is the model's: the CONTEXT
    symbols before a token (words, buckets of rare words, ends) predict it as the sum of their embeddings, each
    through the matrix of its position, first its class, then the symbol in the class, both normalised; for a word
    of a bucket this is multiplied by (c + 1) / (tokens + distinct words + 1) of the bucket, the last 1 being all unseen words.
    So the probabilities of all words sum to at most 1 in each context. Training goes over all tokens not held out, in
    rounds over shards of documents, and gives the same model however the table is split (see train). Counts of the KNOWN most frequent words are in every task; the other words of each document are
    joined with the table of counts, whatever its size.
    Null texts are empty ones. A null doc_id is held out. Repeated rows come back repeated and count repeatedly.
    Without learned documents all counts are 0. Very long texts are scored whole. Other columns are not read. Empty
    table: no rows."""
    key = F.col(doc_id).cast("long")
    rows = docs.select(key.alias("doc_id"), F.coalesce(fold(key, FOLDS) == HELD, F.lit(True)).alias("held_out"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    learned = rows.filter(~F.col("held_out")).select("text")
    stats, counts = corpus_stats(learned)
    # Both broadcasts have a fixed bound: KNOWN keys of LONGEST bytes with their counts, and the model's parameters.
    sc = docs.sparkSession.sparkContext
    one_thread(docs.sparkSession)
    held = sc.broadcast(stats)
    schema = "rid long, doc_id long, held_out boolean, place long, n_tokens long, n_known long, logs double, more double, rest array<binary>, times array<long>, symbols binary"
    place = F.xxhash64("doc_id", "text").alias("place")
    encoded = written(rows.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "held_out", place, "text").mapInArrow(_encoded(held), schema), "encoded")
    model = sc.broadcast(train(encoded.filter(~F.col("held_out")).select("place", "symbols"), stats, held))
    rest = encoded.select("rid", F.explode(F.arrays_zip("rest", "times")).alias("x")).select("rid", F.col("x.rest").alias("word"), F.col("x.times").alias("times"))
    found = rest.join(counts, "word").groupBy("rid").agg(F.sum("times").alias("known"), F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("more"))
    scored = encoded.select("more", "symbols", "rid", "doc_id", "held_out", "n_tokens", "n_known", "logs")
    scored = scored.mapInArrow(_scored(stats.end, model), "score double, rid long, doc_id long, held_out boolean, n_tokens long, n_known long, logs double")
    x = written(scored, "scores").join(written(found, "rest"), "rid", "left")
    dropped(counts, encoded)
    known, more = F.coalesce("known", F.lit(0).cast("long")), F.coalesce("more", F.lit(0.0))
    each = float(np.log10(stats.tokens + stats.distinct + 1))
    return x.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + known).alias("n_known"), F.lit(stats.tokens).cast("long").alias("train_tokens"),
        (F.col("logs") + more - F.col("n_tokens") * each).alias("base_score"), (F.col("score") + more).alias("score"),
    )
