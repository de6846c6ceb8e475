"""Cross-tokenizer alignment: which tokens of two vocabularies cover the same bytes, and how often over the corpus."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.bpe import PATTERN, byte_of_char
from lodestar.llm.recent import Recent, giving_back
from lodestar.llm.store import dropped, short_batches, written

#: A block: documents whose postings are held together, at most so many, and about so many characters (one text at least).
BLOCK, CHARS = 1000, 3_000_000
#: B ids are dealt into so many buckets by remainder, and a bucket's postings into parts of about PART.
BUCKETS, PART = 32, 30_000_000
#: Pairs that a task counts before it gives them out; pairs in a row of counts.
FLUSH, CHUNK = 2_000_000, 100_000
#: A pair of ids is one integer: b << WIDE | a.
WIDE = 24


class Vocabularies:
    """Tokenizers A (byte-level BPE, whose ids are its ranks) and B (sentencepiece), and their tokens' lengths in bytes."""

    def __init__(self, a: str, b: str):
        with open(a, encoding="utf-8") as f:
            spec = json.load(f)
        of, added = byte_of_char(), {t["content"] for t in spec["added_tokens"]}
        vocab = spec["model"]["vocab"]
        ranks = {bytes(of[c] for c in token): i for token, i in vocab.items() if token not in added}
        merged = [vocab[x + y] for x, y in spec["model"]["merges"]]
        if merged != sorted(merged):
            raise ValueError(f"{a}: ids do not follow the order of merges")
        self.a = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.a_bytes[i] = token
        self.b = sentencepiece.SentencePieceProcessor(model_file=b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_len, self.b_len = (np.array(list(map(len, x)), np.int64) for x in (self.a_bytes, self.b_bytes))
        # Where no piece has a space behind another character, no merge reaches over the start of a run of spaces.
        self.cut = not any("▁" in p.lstrip("▁") for p in pieces)
        self.fragments = Recent(self._fragment, size=150_000)
        self.first = len(self.b.encode("a"))

    def _fragment(self, fragment: str) -> bytes:
        blank = not fragment.strip(" ")
        ids = self.b.encode("a" + fragment)[self.first :] if blank else self.b.encode(fragment[1:])
        return np.array(ids, np.int32).tobytes()

    def encode_a(self, text: str) -> np.ndarray:
        return self.a.encode_to_numpy(" " + text, disallowed_special=()).astype(np.int32)

    def encode_b(self, text: str) -> np.ndarray:
        if not self.cut:
            return np.array(self.b.encode(text), np.int32)
        return np.frombuffer(b"".join(map(self.fragments.__getitem__, _SPACED.findall(" " + text))), np.int32)


#: A run of spaces with what follows it.
_SPACED = regex.compile(r" +[^ ]*")


@lru_cache(maxsize=1)
def _vocabularies(a: str, b: str) -> Vocabularies:
    return Vocabularies(a, b)


class Writer:
    """Writes ids behind separators as bytes, for whole arrays at once."""

    def __init__(self, ids: int):
        width = len(str(ids)) + 1
        text = [[f"{s}{i}".encode() for i in range(ids)] for s in ",|;"]
        self.ids, self.size = ids, np.array([len(x) for row in text for x in row])
        self.table = np.array([x for row in text for x in row], f"S{width}").view(np.uint8).reshape(-1, width)

    def __call__(self, separator: np.ndarray, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        at = separator * self.ids + ids
        rows = self.table[at]
        return rows[rows > 0].tobytes(), self.size[at]


@lru_cache(maxsize=1)
def _writer(ids: int) -> Writer:
    return Writer(ids)


def aligned(texts: list[str | None], v: Vocabularies) -> tuple[dict[str, np.ndarray | list], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Counts and digest of each text; and the links' pairs: (distinct pairs, texts of each, then for each pair in turn the
    texts, and how often each has it)."""
    ids_a, ids_b, there = [], [], []
    for i, t in enumerate(texts):
        if t:
            raw = (" " + t).encode("utf-8", "surrogatepass")
            a, b = v.encode_a(t), v.encode_b(t)
            if b"".join(map(v.b_bytes.__getitem__, b.tolist())) == raw and b"".join(map(v.a_bytes.__getitem__, a.tolist())) == raw:
                ids_a.append(a)
                ids_b.append(b)
                there.append(i)
    n, there = len(texts), np.array(there, np.int64)
    out: dict = {k: np.zeros(n, np.int64) for k in ("n_a", "n_b", "n_groups", "n_links")} | {"groups_sha256": [""] * n}
    none = np.empty(0, np.int64)
    if not len(there):
        return out, (none, none, none, none)
    n_a, n_b = (np.array(list(map(len, x)), np.int64) for x in (ids_a, ids_b))
    a, b = np.concatenate(ids_a), np.concatenate(ids_b)
    # All texts in a row: a text's end is an end in both, so one pass over the ends serves all of them.
    end_a, end_b = np.cumsum(v.a_len[a]), np.cumsum(v.b_len[b])
    ends = np.concatenate([end_a, end_b])
    ends.sort(kind="stable")
    ends = ends[np.concatenate([[True], ends[1:] != ends[:-1]])]
    # Between two ends that follow each other lies one overlap of one A token with one B token.
    at_a, at_b = np.searchsorted(end_a, ends), np.searchsorted(end_b, ends)
    doc_ends = end_a[np.cumsum(n_a) - 1]
    doc = np.searchsorted(doc_ends, ends)
    closes = (end_a[at_a] == ends) & (end_b[at_b] == ends)
    out["n_a"][there], out["n_b"][there] = n_a, n_b
    out["n_links"][there] = np.bincount(doc, minlength=len(there))
    out["n_groups"][there] = np.bincount(doc[closes], minlength=len(there))
    for i, digest in zip(there.tolist(), _digests(a, b, at_a[closes], at_b[closes], np.cumsum(n_a), np.cumsum(n_b), max(len(v.a_len), len(v.b_len))), strict=True):
        out["groups_sha256"][i] = digest
    # Pairs first, then texts: one sort of both together gives the postings in order.
    pair = (b[at_b].astype(np.int64) << WIDE) | a[at_a]
    bits = max(1, len(there)).bit_length()
    if bits + WIDE + len(v.b_len).bit_length() > 63:
        raise ValueError("too many texts in a block")
    posting = pair << bits | doc
    posting.sort()
    first = np.flatnonzero(np.concatenate([[True], posting[1:] != posting[:-1]]))
    times = np.diff(np.append(first, len(posting)))
    posting = posting[first]
    pair, doc = posting >> bits, there[posting & (1 << bits) - 1]
    starts = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
    return out, (pair[starts], np.diff(np.append(starts, len(pair))), doc, times)


def _digests(a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray, docs_a: np.ndarray, docs_b: np.ndarray, ids: int) -> list[str]:
    """SHA-256 of each text's groups; last_a and last_b are the last tokens of the groups."""
    separator, order = np.zeros(len(a) + len(b), np.int64), np.empty(len(a) + len(b), np.int64)
    group_a, group_b = np.searchsorted(last_a, np.arange(len(a))), np.searchsorted(last_b, np.arange(len(b)))
    # A token of A stands behind all B tokens of earlier groups, one of B behind all A tokens up to its group's.
    place_a = np.arange(len(a)) + np.concatenate([[0], last_b + 1])[group_a]
    place_b = np.arange(len(b)) + (last_a + 1)[group_b]
    order[place_a], order[place_b] = a, b
    separator[place_a[np.concatenate([[0], last_a[:-1] + 1])]] = 2
    separator[place_b[np.concatenate([[0], last_b[:-1] + 1])]] = 1
    ends = (docs_a + docs_b).tolist()
    out, begin = [], 0
    made = _writer(ids)
    while begin < len(ends):  # about so many tokens at a time
        i = 0 if not begin else ends[begin - 1]
        stop = max(begin + 1, int(np.searchsorted(ends, i + 1_000_000, "right")))
        j = ends[stop - 1]
        text, sizes = made(separator[i:j], order[i:j])
        at = np.concatenate([[0], np.cumsum(sizes)])
        for k in range(begin, stop):
            x, y = at[(ends[k - 1] if k else 0) - i], at[ends[k] - i]
            out.append(hashlib.sha256(text[x + 1 : y]).hexdigest())  # but the separator before the first group
        begin = stop
    return out


def _packed(x: np.ndarray) -> bytes:
    """Counts in the narrowest unsigned integers that hold them; the width follows from the length."""
    top = int(x.max()) if len(x) else 0
    return x.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32).tobytes()


def _unpacked(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, f"u{len(raw) // n}") if n else np.empty(0, np.uint8)


BLOCKS = "block long, at int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, bucket int, size long, pairs binary, texts binary, docs binary, times binary"
_NAMES = [x.split()[0] for x in BLOCKS.split(", ")]
_TYPES = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
_FIELDS = pa.schema([(x.split()[0], _TYPES[x.split()[1]]) for x in BLOCKS.split(", ")])


def _batch(n: int, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in _FIELDS], schema=_FIELDS)


def _blocks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    begin = size = 0
    for i, t in enumerate(texts):
        if i > begin and (i - begin == BLOCK or size + len(t or "") > CHARS):
            yield begin, i
            begin, size = i, 0
        size += len(t or "")
    if begin < len(texts):
        yield begin, len(texts)


def _encoded(a: str, b: str):
    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, block = _vocabularies(a, b), TaskContext.get().partitionId() << 32
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for begin, end in _blocks(texts):
                counts, (pairs, n, docs, times) = aligned(texts[begin:end], v)
                k = end - begin
                yield _batch(k, block=[block] * k, at=np.arange(k, dtype=np.int32), doc_id=batch.column(0).slice(begin, k), **counts)
                bucket = (pairs >> WIDE) % BUCKETS
                of = np.repeat(bucket, n)
                rows = []
                for x in np.unique(bucket).tolist():
                    p, own = bucket == x, of == x
                    rows.append((x, int(own.sum()), pairs[p].tobytes(), _packed(n[p]), docs[own].astype(np.uint16).tobytes(), _packed(times[own])))
                if rows:
                    yield _batch(len(rows), block=[block] * len(rows), **dict(zip(("bucket", "size", "pairs", "texts", "docs", "times"), zip(*rows, strict=True), strict=True)))
                block += 1

    return run


def _block_row(pairs: bytes, texts: bytes, docs: bytes, times: bytes) -> tuple[np.ndarray, ...]:
    p, d = np.frombuffer(pairs, np.int64), np.frombuffer(docs, np.uint16)
    return p, _unpacked(texts, len(p)).astype(np.int64), d, _unpacked(times, len(d)).astype(np.int64)


@giving_back
def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, pair, n) over blocks' rows, added up within a task until FLUSH pairs have gathered."""
    kept, size = [], 0

    def given() -> pa.RecordBatch:
        pair, at = np.unique(np.concatenate([p for p, _ in kept]), return_inverse=True)
        n = np.zeros(len(pair), np.int64)
        np.add.at(n, at, np.concatenate([c for _, c in kept]))
        return pa.RecordBatch.from_arrays([pa.array(((pair >> WIDE) % BUCKETS).astype(np.int32)), pa.array(pair), pa.array(n)], names=["bucket", "pair", "n"])

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            p, n, _, times = _block_row(*row)
            kept.append((p, np.add.reduceat(times, np.cumsum(n) - n)))
            size += len(p)
            if size >= FLUSH:
                yield given()
                kept, size = [], 0
    if kept:
        yield given()


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of up to CHUNK counts of a bucket's pairs, as (bucket, pairs, times), from rows sorted by bucket and pair."""
    for batch in batches:
        bucket, pair, n = (c.to_numpy() for c in batch.columns)
        cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else []
        for i, j in zip(cuts, [*cuts[1:], len(bucket)], strict=True):
            spans = [(x, min(x + CHUNK, j)) for x in range(i, j, CHUNK)]
            made = [pa.array([bucket[i]] * len(spans), pa.int32()), pa.array([pair[x:y].tobytes() for x, y in spans], pa.binary()), pa.array([n[x:y].tobytes() for x, y in spans], pa.binary())]
            yield pa.RecordBatch.from_arrays(made, names=["bucket", "pairs", "times"])


@giving_back
def _contributed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by (bucket, part), a bucket's counts before its postings: for each row of postings the sums of its
    documents, (block, docs, n_best, count_sum). What is held are one bucket's counts."""
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    for _, group in groupby(rows, key=lambda r: r[:2]):
        counts, known = [], None
        for _, _, block, pairs, texts, docs, times in group:
            if block is None:
                counts.append((np.frombuffer(pairs, np.int64), np.frombuffer(times, np.int64)))
                continue
            if known is None:
                known, total = (np.concatenate(x) for x in zip(*counts, strict=True))
                order = np.argsort(known, kind="stable")
                known, total = known[order], total[order]
                side = known >> WIDE
                starts = np.flatnonzero(np.concatenate([[True], side[1:] != side[:-1]]))
                best = total == np.repeat(np.maximum.reduceat(total, starts), np.diff(np.append(starts, len(side))))
            p, n, d, times = _block_row(pairs, texts, docs, times)
            at = np.repeat(np.searchsorted(known, p), n)
            of, d = np.unique(d, return_inverse=True)
            n_best, count_sum = np.zeros(len(of), np.int64), np.zeros(len(of), np.int64)
            np.add.at(n_best, d, np.where(best[at], times, 0))
            np.add.at(count_sum, d, times * total[at])
            yield pa.RecordBatch.from_arrays([pa.array([block]), *(pa.array([x.tobytes()], pa.binary()) for x in (of, n_best, count_sum))], names=["block", "docs", "n_best", "count_sum"])


@giving_back
def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, at, n_best, count_sum) from rows of contributions sorted by block; one block's sums are held."""
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    for block, group in groupby(rows, key=lambda r: r[0]):
        n_best, count_sum = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        seen = np.zeros(1 << 16, bool)
        for _, docs, best, total in group:
            d = np.frombuffer(docs, np.uint16)
            seen[d] = True
            n_best[d] += np.frombuffer(best, np.int64)
            count_sum[d] += np.frombuffer(total, np.int64)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), block)), pa.array(at.astype(np.int32)), pa.array(n_best[at]), pa.array(count_sum[at])], names=["block", "at", "n_best", "count_sum"])


def align(docs: DataFrame, a: str, b: str, doc_id: str = "doc_id", text: str = "text", part: int = PART) -> DataFrame:
    """One row per row of docs: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    a: path of a byte-level BPE in a tokenizers file, b: of a sentencepiece model, both readable on all executors. A encodes
    a space and the text, B the text, to which it adds the space; strings of special tokens are plain text. Links are the
    pairs of an A and a B token whose bytes overlap, groups lie between bytes where tokens of both end. A pair of ids counts
    the links that have it in all documents. n_best: links whose count is the highest of their B id, ties included;
    count_sum: the sum of the links' counts.

    Each block of documents has its postings (pair, documents, how often) by bucket of B ids. Counts of pairs are added up in
    the tasks, then by pair. Counts and postings of a bucket meet in one sorted stream, counts first: the highest are taken
    there, and each row of postings gives its documents' shares, which are added up by block. A bucket of more than `part`
    postings is dealt out by blocks, with a copy of its counts for each part, so a frequent id is no hot spot; a task
    holds the counts of one bucket's pairs, which the vocabularies bound, and a row of postings.

    Null and empty texts, and those whose tokens do not give their bytes back: zeros and an empty digest. Null doc_ids
    and repeated rows come back as they are, and count. Very long texts are a block of their own. Other columns are not
    read. Empty table: no rows."""
    short_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    made = written(rows.mapInArrow(_encoded(a, b), BLOCKS), "blocks")
    postings = made.filter("bucket is not null")
    sizes = postings.groupBy("bucket").agg(F.sum("size").alias("n")).collect()  # BUCKETS rows at most
    parts = F.coalesce(*[F.when(F.col("bucket") == r.bucket, F.lit(-(-r.n // part))) for r in sizes if r.n > part], F.lit(1)).cast("int")
    counts = postings.select("pairs", "texts", "docs", "times").mapInArrow(_counted, "bucket int, pair long, n long").groupBy("bucket", "pair").agg(F.sum("n").alias("n"))
    counts = written(counts.repartition("bucket").sortWithinPartitions("bucket", "pair").mapInArrow(_chunked, "bucket int, pairs binary, times binary"), "counts")
    nothing = F.lit(None).cast("binary")
    first = counts.select("bucket", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.lit(None).cast("long").alias("block"), "pairs", nothing.alias("texts"), nothing.alias("docs"), "times")
    then = postings.select("bucket", F.pmod(F.xxhash64("block"), parts).cast("int").alias("part"), "block", "pairs", "texts", "docs", "times")
    met = first.union(then).repartition("bucket", "part").sortWithinPartitions("bucket", "part", F.col("block").asc_nulls_first())
    shares = met.mapInArrow(_contributed, "block long, docs binary, n_best binary, count_sum binary")
    sums = shares.repartition("block").sortWithinPartitions("block").mapInArrow(_summed, "block long, at int, n_best long, count_sum long")
    sums = written(sums, "sums")
    dropped(counts)
    own = made.filter("bucket is null").select("block", "at", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    zero = F.lit(0).cast("long")
    x = own.join(sums, ["block", "at"], "left")
    return x.select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")
