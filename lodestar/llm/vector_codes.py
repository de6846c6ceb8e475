"""Vector code compression: product codes by exact integer k-means, with lower bounds from means of segments."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.sampling import arrays
from lodestar.llm.store import dropped, heavy_first, one_thread, written

#: A component is this times its value, rounded down, and at most LARGEST away from 0, so that sums of squares stay exact.
SCALE, LARGEST = 1024, 1 << 24
PARTS, ENTRIES, ROUNDS = 4, 256, 4
#: Blocks of a part whose means are compared, coarse to fine.
BLOCKS = (1, 4)
#: Vectors in a step.
STEP = 2048


def _blocks(x: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row: the means of its blocks, times the square root of a block's size, and the norm of what is left; and
    the largest absolute value, for rounding errors."""
    cuts = np.linspace(0, x.shape[1], min(blocks, x.shape[1]) + 1).astype(int)
    size = np.diff(cuts)
    total = np.add.reduceat(x, cuts[:-1], axis=1).astype(np.float64)
    left = (x.astype(np.float64) ** 2).sum(1) - (total * total / size).sum(1)
    return total / np.sqrt(size), np.sqrt(np.maximum(left, 0)), np.abs(x).max(1).astype(np.float64)


class Codebook:
    """Entries of one part position, and their blocks."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.blocks = [_blocks(entries, b) for b in BLOCKS] if entries.shape[1] else []

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of each row (the lower index at a tie) and its squared distance, exactly.

        The squared distance of two vectors is at least that of their block means, each times the block's size, plus the
        squared difference of the norms of the rest. An entry is dropped if this bound is over the exact distance of
        another one. Blocks are tried coarse to fine; what is left is measured in integers."""
        n, k = len(x), len(self.entries)
        if not self.blocks or not n:
            return np.zeros(n, np.int64), np.zeros(n, np.int64)
        exact = lambda i, c: ((x[i] - self.entries[c]) ** 2).sum(1)
        rows, best = np.arange(n), np.full(n, np.iinfo(np.int64).max)
        i, c = np.repeat(rows, k), np.tile(np.arange(k), n)
        for level, (mean, rest, top) in zip(BLOCKS, self.blocks, strict=True):
            m, r, most = _blocks(x, level)
            if level == BLOCKS[0]:  # all entries: as matrices
                bound = (m**2).sum(1)[:, None] + (mean**2).sum(1) - 2 * m @ mean.T + (r[:, None] - rest) ** 2
                slack = 1e-9 * x.shape[1] * (most[:, None] + top + 1) ** 2
                first = bound.argmin(1)
                best = exact(rows, first)
                i, c = np.nonzero(bound - slack <= best[:, None])
            else:
                bound = ((m[i] - mean[c]) ** 2).sum(1) + (r[i] - rest[c]) ** 2
                slack = 1e-9 * x.shape[1] * (most[i] + top[c] + 1) ** 2
                starts = np.searchsorted(i, rows)
                least = np.minimum.reduceat(bound, starts)
                at = np.flatnonzero(bound == least[i])
                at = at[np.searchsorted(i[at], rows)]
                best = np.minimum(best, exact(rows, c[at]))
                left = bound - slack <= best[i]
                i, c = i[left], c[left]
        d = exact(i, c)
        starts = np.searchsorted(i, rows)
        best = np.minimum.reduceat(d, starts)
        at = np.flatnonzero(d == best[i])
        return c[at[np.searchsorted(i[at], rows)]], best


def _vectors(column: pa.Array, width: int) -> np.ndarray:
    return np.concatenate(arrays(pa.chunked_array([column])) or [np.empty(0)]).astype(np.int64).reshape(len(column), width)


def _steps(batch: pa.RecordBatch, column: int, width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for i in range(0, batch.num_rows, STEP):
        some = batch.slice(i, STEP)
        yield some, _vectors(some.column(column), width)


def _added_up(books: Broadcast, width: int):
    """(cell, place, total, n): the sums and numbers of each entry's parts in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, k, w = [Codebook(b) for b in books.value], len(books.value[0]), width // PARTS
        total, n = np.zeros((PARTS * k, w), np.int64), np.zeros(PARTS * k, np.int64)
        for batch in batches:
            for _, x in _steps(batch, 0, width):
                for p, book in enumerate(made):
                    part = x[:, p * w : (p + 1) * w]
                    cell = p * k + book.nearest(part)[0]
                    np.add.at(total, cell, part)
                    n += np.bincount(cell, minlength=len(n))
        used = np.flatnonzero(n)
        cells, places = np.repeat(used, w), np.tile(np.arange(w), len(used))
        columns = [pa.array(cells.astype(np.int32)), pa.array(places.astype(np.int32)), pa.array(total[used].reshape(-1)), pa.array(np.repeat(n[used], w))]
        yield pa.RecordBatch.from_arrays(columns, names=["cell", "place", "total", "n"])

    return run


def _coded(books: Broadcast, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, w = [Codebook(b) for b in books.value], width // PARTS
        for batch in batches:
            for some, x in _steps(batch, 2, width):
                got = [book.nearest(x[:, p * w : (p + 1) * w]) for p, book in enumerate(made)]
                codes = np.stack([c for c, _ in got], 1).astype(np.uint8)
                error = sum(d for _, d in got)
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array([c.tobytes().hex() for c in codes]), pa.array(error)], names=["vec_id", "label", "code", "error"])

    return run


def integers(vectors: DataFrame, vec_id: str, vector: str, label: str) -> DataFrame:
    """(vec_id, label, v): vectors of finite components as integers."""
    whole = lambda x: F.greatest(F.least(F.floor(x.cast("double") * SCALE), F.lit(LARGEST).cast("long")), F.lit(-LARGEST).cast("long")).cast("int")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))
    kept = vectors.filter(F.col(vector).isNotNull() & F.forall(vector, finite))
    return kept.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"), F.transform(vector, whole).alias("v"))


def fit(kept: DataFrame, width: int) -> list[np.ndarray]:
    """The codebooks of the part positions after ROUNDS rounds over all vectors (column v). Each round adds up the vectors
    of each entry in the tasks; what comes to the driver has the size of the codebooks."""
    sc, w = kept.sparkSession.sparkContext, width // PARTS
    firsts = kept.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(ENTRIES).select("v").collect()
    start = np.array([r.v for r in firsts], np.int64).reshape(len(firsts), width)
    books = [start[:, p * w : (p + 1) * w].copy() for p in range(PARTS)]
    for _ in range(ROUNDS if len(start) and w else 0):
        held = sc.broadcast(books)
        sums = kept.select("v").mapInArrow(_added_up(held, width), "cell int, place int, total long, n long")
        got = sums.groupBy("cell", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).toArrow()
        cell, place, total, n = (got.column(c).to_numpy() for c in ("cell", "place", "total", "n"))
        books = [b.copy() for b in books]
        for p, b in enumerate(books):
            own = cell // len(b) == p
            b[cell[own] % len(b), place[own]] = total[own] // n[own]
        held.destroy()
    return books


def vector_codes(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """One row per vector kept: vec_id, code, error, label_error, codebooks_sha256.

    Components become integers, floor(1024 * x); vectors are cut into four equal parts. Each position's codebook starts as
    that part of the 256 vectors of the smallest vec_ids; four rounds assign every part to the nearest entry and replace
    each used entry by its parts' means, rounded down; then parts are assigned again. code: two hex digits a part; error:
    the squared distances summed; label_error: these summed over the rows of a label. All distances are exact integers.

    Dropped: vectors that are null or have null or infinite components or NaN, and those of another length than the
    vector of the smallest vec_id kept (of equal ids the smallest vector). Other cases: components beyond 16,384 count as
    16,384; lengths that are no multiple of four are filled up with zeros; empty vectors have error 0. Fewer than
    256 rows make fewer entries. Null vec_ids come last for the start and are coded; rows of null labels are summed
    together; repeated rows come back repeated and count. Other columns are not read. Empty table: no rows."""
    one_thread(vectors.sparkSession)
    kept = integers(vectors, vec_id, vector, label)
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "v").select(F.size("v")).first()
    size = first[0] if first else 0
    width = -(-size // PARTS) * PARTS
    filled = F.concat("v", F.array_repeat(F.lit(0), width - size)) if width > size else F.col("v")
    kept = written(kept.filter(F.size("v") == size).select("vec_id", "label", filled.alias("v")), "vectors")
    books = fit(kept, width)
    digest = hashlib.sha256(",".join(str(x) for b in books for x in b.reshape(-1).tolist()).encode()).hexdigest()
    held = kept.sparkSession.sparkContext.broadcast(books)
    kind = kept.schema["label"].dataType.simpleString()
    coded = kept.mapInArrow(_coded(held, width), f"vec_id long, label {kind}, code string, error long")
    named = (F.col("label").isNull().alias("unnamed"), F.coalesce(F.col("label").cast("string"), F.lit("")).alias("name"))
    coded = written(coded.select("vec_id", *named, "code", "error"), "codes")
    dropped(kept)
    sums = written(coded.groupBy("unnamed", "name").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")), "labels")
    out = heavy_first(coded, sums, ["unnamed", "name"], "n").select("vec_id", "code", "error", "label_error")
    return out.select("*", F.lit(digest).alias("codebooks_sha256"))
