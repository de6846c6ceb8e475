"""Byte-level BPE by forced boundaries: encoding and decoding of whole texts."""

from __future__ import annotations

import heapq
import json
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.recent import Recent
from lodestar.llm.sampling import arrays

#: Two ids, or a rank and an id, are held in one integer; what pairs that do not merge have.
WIDE, MASK, NEVER = 32, (1 << 32) - 1, 1 << 64

#: White space as the tokenizer's pattern has it, and that pattern (fixed values).
_S = r"\t-\r \x85\xa0  -     　"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_S}\p{{L}}\p{{N}}]+|[{_S}]+(?![^{_S}])|[{_S}]+"


def byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies write a byte as a printable character: itself where it is one, else one from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBPE:
    """Encoder and decoder of a byte-level BPE vocabulary in a tokenizers file, without normalizer.

    A pair of bytes that is next to each other in no token of the vocabulary is a certain cut: no merge can reach over
    it, so fragments between cuts are encoded by themselves and joined. The pattern that splits text before merging
    must find the same pieces in a fragment as in the text; `cuts` leaves out pairs where it might not: inside a character,
    from white space to something else (the last space belongs to what follows), after a character of several bytes
    unless white space follows, and before an apostrophe that could then start a contraction."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        of = byte_of_char()
        vocab: dict[str, int] = spec["model"]["vocab"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.added_pattern = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.bytes = [b""] * (max([*vocab.values(), *self.added.values()]) + 1)
        for token, i in vocab.items():
            self.bytes[i] = bytes(of[c] for c in token) if token not in self.added else token.encode()
        for token, i in self.added.items():
            self.bytes[i] = token.encode()
        self.tokens = np.array(self.bytes, object)
        single = {of[t]: i for t, i in vocab.items() if len(t) == 1}
        self.of_byte = [single[b] for b in range(256)]
        # A pair of ids as one integer -> its rank and the id that it becomes, also as one integer, in order of rank.
        self.merges = {vocab[a] << WIDE | vocab[b]: rank << WIDE | vocab[a + b] for rank, (a, b) in enumerate(spec["model"]["merges"])}
        self.pattern = regex.compile(PATTERN)
        self.fragments = Recent(self.encode_fragment)
        joined = np.zeros((256, 256), bool)
        for token, i in vocab.items():
            if token not in self.added:
                x = np.frombuffer(self.bytes[i], np.uint8)
                joined[x[:-1], x[1:]] = True
        b = np.arange(256)
        space = np.isin(b, [9, 10, 11, 12, 13, 32])
        alnum = np.isin(b, [i for i in range(128) if chr(i).isalnum()])
        first, second = b[:, None], b[None, :]
        plain = (first < 128) & ~space[:, None]
        allowed = (plain | (space[:, None] & space[None, :]) | ((first >= 128) & space[None, :])) & ~((second >= 0x80) & (second < 0xC0))
        allowed &= (second != ord("'")) | alnum[:, None]
        self.cuts = (~joined & allowed).reshape(-1)

    def merged(self, piece: bytes) -> list[int]:
        """Merge the pair of least rank, the leftmost at a tie, until no pair is left."""
        ids = list(map(self.of_byte.__getitem__, piece))
        get, n = self.merges.get, len(ids)
        if n < 64:
            pairs = [get(a << WIDE | b, NEVER) for a, b in zip(ids, ids[1:])]  # noqa: B905
            while pairs and (best := min(pairs)) != NEVER:
                i = pairs.index(best)
                ids[i] = best & MASK
                del ids[i + 1], pairs[i]
                if i:
                    pairs[i - 1] = get(ids[i - 1] << WIDE | ids[i], NEVER)
                if i < len(pairs):
                    pairs[i] = get(ids[i] << WIDE | ids[i + 1], NEVER)
            return ids
        after, before, gone = [*range(1, n), -1], [*range(-1, n - 1)], [False] * n
        heap = [(m, i, ids[i], ids[i + 1]) for i in range(n - 1) if (m := get(ids[i] << WIDE | ids[i + 1]))]
        heapq.heapify(heap)
        while heap:
            m, i, a, b = heapq.heappop(heap)
            j = after[i]
            if gone[i] or j < 0 or ids[i] != a or ids[j] != b:
                continue
            ids[i], gone[j], after[i] = m & MASK, True, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right >= 0 and (m := get(ids[left] << WIDE | ids[right])):
                    heapq.heappush(heap, (m, left, ids[left], ids[right]))
        return [x for x, g in zip(ids, gone, strict=True) if not g]

    def encode_fragment(self, fragment: bytes) -> bytes:
        if fragment.isalpha() or (fragment[:1] == b" " and fragment[1:].isalpha()):  # ASCII letters: one piece
            return array("i", self.merged(fragment)).tobytes()
        ids = [i for piece in self.pattern.findall(fragment.decode("utf-8", "surrogatepass")) for i in self.merged(piece.encode("utf-8", "surrogatepass"))]
        return array("i", ids).tobytes()

    def _encode(self, text: str) -> bytes:
        raw = text.encode("utf-8", "surrogatepass")
        if not raw:
            return b""
        x = np.frombuffer(raw, np.uint8).astype(np.uint16)
        ends = (np.flatnonzero(self.cuts[(x[:-1] << np.uint16(8)) | x[1:]]) + 1).tolist()
        get = self.fragments.__getitem__
        return b"".join([get(raw[i:j]) for i, j in zip([0, *ends], [*ends, len(raw)], strict=True)])

    def encode(self, text: str | None) -> bytes:
        """Token ids as little-endian 32-bit integers. Strings of added tokens are these tokens."""
        if not text:
            return b""
        if self.added_pattern is None or not self.added_pattern.search(text):
            return self._encode(text)
        return b"".join(np.int32(self.added[part]).tobytes() if part in self.added else self._encode(part) for part in self.added_pattern.split(text))

    def decode(self, ids: np.ndarray) -> str:
        """The text of the ids; bytes that are not UTF-8 become U+FFFD."""
        return b"".join(self.tokens[ids].tolist()).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def _bpe(path: str) -> ByteBPE:
    return ByteBPE(path)


def bpe_encode(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, ids (array of token ids of the whole text).

    vocabulary: path of the tokenizers file, readable on all executors. Null and empty texts have no ids; null
    doc_ids and repeated rows come back as they are; very long texts are encoded whole, by fragments; other columns are not
    read. Empty table: no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(vocabulary)
        for batch in batches:
            for part in (batch.slice(i, 1000) for i in range(0, batch.num_rows, 1000)):
                made = [bpe.encode(t) for t in part.column(1).to_pylist()]
                offsets = np.cumsum([0, *(len(m) // 4 for m in made)]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(made), np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=["doc_id", "ids"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def bpe_decode(encoded: DataFrame, vocabulary: str, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """One row per row of encoded: doc_id, ids, decoded (the text of the ids; a null array makes an empty one)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(vocabulary)
        for batch in batches:
            for part in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
                texts = [bpe.decode(x) for x in arrays(pa.chunked_array([part.column(1)]))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], names=["doc_id", "ids", "decoded"])

    return encoded.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(ids).cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, ids array<int>, decoded string")
