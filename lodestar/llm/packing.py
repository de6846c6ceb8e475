"""Best-fit packing of tokenized documents into sequences of a fixed length by the sum-of-squares rule."""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestar.llm.bpe import byte_of_char
from lodestar.llm.recent import Recent, forgettable, giving_back
from lodestar.llm.store import short_batches, written

LENGTH, END = 2048, 0
#: Pieces packed together in one group. A group leaves a few sequences that are not full, so the loss is about
#: one part in a thousand; groups are what Spark spreads over tasks.
GROUP = 8192


#: Words whose ids the library's merges give directly: composed Latin letters in lower case, then stops and commas.
_PLAIN = re.compile(r"([a-zà-öø-ÿ]+)([.,]*)")


class WordTokenizer:
    """Token ids of texts by a tokenizers file of this kind: lower case, no token over white space or between letters
    and marks, nothing dependent on what lies beyond white space. Ids of the words met lately are kept, in two
    generations of about `size` words. A new plain word needs only the merges, any other the whole tokenizer."""

    def __init__(self, path: str, size: int = 200_000, longest: int = 48):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.merge = self.tokenizer.model.tokenize
        self.characters = {b: c for c, b in byte_of_char().items() if b >= 0x80}
        self.marks = Recent(lambda m: array("I", self.tokenizer.encode(m, add_special_tokens=False).ids).tobytes(), size=1000)
        self.size, self.longest, self.now, self.old = size, longest, {}, {}
        forgettable(self)

    def word(self, raw: bytes) -> bytes:
        text = raw.decode("utf-8", "replace")
        plain = _PLAIN.fullmatch(text.lower())
        if not plain:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32).tobytes()
        core, marks = plain.groups()
        if not core.isascii():
            core = core.encode().decode("latin-1").translate(self.characters)
        ids = array("I", [t.id for t in self.merge(core)]).tobytes()
        return ids + self.marks[marks] if marks else ids

    def encode(self, texts: list[str | None]) -> list[bytes]:
        split = [(t or "").encode("utf-8", "surrogatepass").split() for t in texts]
        if len(self.now) >= self.size:
            self.old, self.now = self.now, {}
        now, old = self.now, self.old
        new: set[bytes] = set()
        for words in split:
            new |= set(words).difference(now)
        for w in new:
            now[w] = old.get(w) or self.word(w)
        made = [b"".join(map(now.__getitem__, words)) for words in split]
        for w in new:
            if len(w) > self.longest:
                del now[w]
        return made

    def rest(self) -> None:
        """Forget the older words: a worker process outlives its task."""
        self.old = {}

    def forget(self) -> None:
        self.now, self.old = {}, {}


@lru_cache(maxsize=2)
def _tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def token_pieces(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, piece (from 0), start, length, ids_crc32 and, with_ids, ids. A document is the ids of
    its whole text and then END; only a longer one than `length` is cut, the last piece may be shorter. Null and
    empty texts are END alone. Null doc_ids and repeated rows are kept."""
    step = 4 * length

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(vocabulary)
        for batch in batches:
            for part in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
                rows = []
                for key, ids in zip(part.column(0).to_pylist(), tokenizer.encode(part.column(1).to_pylist()), strict=True):
                    ids += np.uint32(END).tobytes()
                    rows += [(key, i // step, i // 4, len(p := ids[i : i + step]) // 4, zlib.crc32(p), p) for i in range(0, len(ids), step)]
                columns = list(zip(*rows, strict=True)) or [()] * 6
                arrays = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=False)]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    arrays.append(pa.array([np.frombuffer(p, np.int32) for p in columns[5]], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names=names)
        tokenizer.rest()

    short_batches(docs.sparkSession)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each item, longest first. Of the open bins that have room, an item goes where the sum over
    residual gaps of the squared number of open bins with that gap becomes least, at a tie to the smaller gap; a bin
    is opened when none has room. (Letting the rule itself open bins took half a percent more of them here.)"""
    count = np.zeros(capacity + 1, np.int64)
    open_: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    made, never = 0, np.iinfo(np.int64).max
    for k in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[k])
        gaps = count[n:]
        change = np.where(gaps > 0, 2 * (count[: capacity + 1 - n] - gaps + 1), never)
        if gaps[0]:
            change[0] = 1 - 2 * gaps[0]
        best = int(change.argmin())
        if change[best] == never:
            gap, b, made = capacity, made, made + 1
        else:
            gap = n + best
            b = open_[gap].pop()
            count[gap] -= 1
        bins[k], offsets[k] = b, capacity - gap
        if gap > n:
            open_[gap - n].append(b)
            count[gap - n] += 1
    return bins, offsets


def packed(pieces: DataFrame, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """pieces (a column `length` from 1 to `length`, and any others) with sequence_id and offset: where each piece lies,
    the pieces of a sequence end to end from 0. Pieces are dealt evenly by a hash of doc_id and piece into groups of
    about `group`, which are packed by themselves; the groups' number follows the input. pieces is counted and read
    again, so give a written table. Empty table: no rows."""
    n = max(1, -(-pieces.count() // group))
    dealt = pieces.withColumn("group", F.pmod(F.xxhash64("doc_id", "piece", "start"), F.lit(n)))

    def run(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values(["doc_id", "piece"], kind="stable")
        bins, offsets = sum_of_squares(x["length"].to_numpy(), length)
        return x.assign(sequence_id=x["group"].to_numpy() * (1 << 32) + bins, offset=offsets).drop(columns="group")

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    return dealt.groupBy("group").applyInPandas(run, schema)


def pack_documents(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """Where the pieces of the documents lie in the packed sequences: doc_id, piece, start, length, ids_crc32,
    sequence_id, offset. See token_pieces and packed for the cases."""
    return packed(written(token_pieces(docs, vocabulary, doc_id, text, length, with_ids=False), "pieces"), length)
