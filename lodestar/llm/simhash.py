"""SimHash near duplicates: 64-bit fingerprints, joined on the Golay codewords near their segments, and verified."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.llm.components import components
from lodestar.llm.recent import giving_back
from lodestar.llm.store import dropped, heavy_first, short_batches, written

#: Words in a shingle; the seed of XXH64; differing bits of linked fingerprints.
SHINGLE, SEED, ERRORS = 3, 42, 3
#: The Golay code: words of 23 bits, 12 of them data; its generator polynomial (fixed value).
BITS, DATA, GENERATOR = 23, 12, 0b101011100011
#: A segment of 16 bits without an error, and one half of the other 48 bits with one error at most.
SEGMENTS, SEGMENT, HALF = 4, 16, 24
#: A codeword met by more fingerprints than this is crowded: these fingerprints are linked by the points around them.
CROWD = 1024


def fingerprint(text: str | None, chunk: int = 100_000) -> int:
    """A bit is 1 if it is set in over half of the hashes of a text's shingles; 0 for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n, k = len(words), min(SHINGLE, len(words))
    if not n:
        return 0
    shingles, total, votes = n - k + 1, n - k + 1, np.zeros(64, np.int64)
    for i in range(0, shingles, chunk):
        some = (b" ".join(words[j : j + k]) for j in range(i, min(i + chunk, shingles)))
        h = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in some), np.uint64, min(chunk, shingles - i))
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * votes > total, bitorder="little").view("<i8")[0])


@giving_back
def _fingerprinted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = [fingerprint(t) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.int64())], names=["doc_id", "fp"])


@lru_cache(maxsize=1)
def golay() -> tuple[np.ndarray, np.ndarray]:
    """Parity bits of each data word, and for each syndrome what to change in a word's data bits to get its own codeword
    (first column) and the others that words one bit away from it decode to (five or none, -1).

    The code is perfect: each word is within three errors of one codeword. So words one error apart have a codeword in
    common: the own one of the first is among those of the second."""
    parity = np.zeros(1 << DATA, np.int64)
    for i in range(DATA):  # the remainder of each data bit by the generator; others are sums of them
        r = 1 << (i + BITS - DATA)
        for j in range(BITS - 1, BITS - DATA - 1, -1):
            if r >> j & 1:
                r ^= GENERATOR << (j - (BITS - DATA))
        parity[np.arange(1 << DATA) >> i & 1 == 1] ^= r
    low = (1 << BITS - DATA) - 1
    errors = [sum(1 << i for i in at) for k in range(4) for at in combinations(range(BITS), k)]
    leader = np.zeros(low + 1, np.int64)
    for e in errors:
        leader[e & low ^ parity[e >> BITS - DATA]] = e
    around = np.full((low + 1, 6), -1, np.int64)
    for s in range(low + 1):
        near = dict.fromkeys(int(w >> BITS - DATA ^ leader[w & low ^ parity[w >> BITS - DATA]] >> BITS - DATA) for w in [s, *(s ^ 1 << i for i in range(BITS))])
        around[s, : len(near)] = list(near)
    return parity, around


def keys(fps: np.ndarray) -> np.ndarray:
    """Keys of fingerprints: (fingerprints, places, 6), of each place the own codeword first, -1 for none.

    Of three errors in 64 bits none is in one of four segments of 16 bits, and at most one in a half of the other 48.
    So two fingerprints within three errors have, at one of the eight places, an equal segment and halves within one
    error: the own key of either is among the other's keys. A key is the place, the segment, and the codeword of the
    first 23 bits of the half."""
    parity, around = golay()
    fps, out = fps.view(np.uint64), []
    part = [(fps >> np.uint64(SEGMENT * i)) & np.uint64((1 << SEGMENT) - 1) for i in range(SEGMENTS)]
    for i in range(SEGMENTS):
        others = [p for j, p in enumerate(part) if j != i]
        rest = sum(p << np.uint64(SEGMENT * j) for j, p in enumerate(others))
        for half in range(2):
            word = (rest >> np.uint64(HALF * half) & np.uint64((1 << BITS) - 1)).astype(np.int64)
            data = word >> BITS - DATA
            change = around[word & (1 << BITS - DATA) - 1 ^ parity[data]]
            key = ((2 * i + half) << SEGMENT | part[i].astype(np.int64)) << DATA
            out.append(np.where(change >= 0, key[:, None] | data[:, None] ^ change, -1))
    return np.stack(out, 1)


@giving_back
def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, fp, own) for a column of fingerprints."""
    for batch in batches:
        for part in (batch.slice(i, 10_000) for i in range(0, batch.num_rows, 10_000)):
            fps = part.column(0).to_numpy()
            k = keys(fps)
            at = np.nonzero(k >= 0)
            yield pa.RecordBatch.from_arrays([pa.array(k[at]), pa.array(fps[at[0]]), pa.array(at[2] == 0)], names=["key", "fp", "own"])


def _around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(point, fp, near) for a column of fingerprints: all points within two bits; near within one."""
    one = [1 << i for i in range(64)]
    flips = np.array([0, *one, *(a | b for a, b in combinations(one, 2))], np.uint64).view(np.int64)
    for batch in batches:
        for part in (batch.slice(i, 50) for i in range(0, batch.num_rows, 50)):
            fps = part.column(0).to_numpy()
            near = np.tile(np.arange(len(flips)) <= 64, len(fps))
            yield pa.RecordBatch.from_arrays([pa.array((fps[:, None] ^ flips).reshape(-1)), pa.array(np.repeat(fps, len(flips))), pa.array(near)], names=["point", "fp", "near"])


def _crowded_links(fps: DataFrame) -> DataFrame:
    """Pairs that connect what links of these fingerprints connect, without comparing all of them: two fingerprints within
    three bits have a point within one bit of the first and two of the second. So a point's fingerprints within two bits are
    all linked to any one within one bit; at most 2,081 fingerprints are within two bits of a point."""
    x = fps.mapInArrow(_around, "point long, fp long, near boolean")
    x = x.select("fp", F.min(F.when(F.col("near"), F.col("fp"))).over(Window.partitionBy("point")).alias("to"))
    return x.filter("to <> fp").select(F.col("to").alias("x"), F.col("fp").alias("y")).distinct()


def links(fps: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Pairs (x, y) of the distinct fingerprints in `fps` (column fp) that differ in at most ERRORS bits: all of them but
    those among crowded fingerprints, where the pairs given connect the same groups. Each pair is verified."""
    k = written(fps.mapInArrow(_keyed, "key long, fp long, own boolean"), "keys")
    sizes = k.groupBy("key").agg(F.count("*").alias("n"), F.count_if("own").alias("own"))
    shared = written(sizes.filter("n > 1 and own > 0").select("key", (F.col("n") > crowd).alias("crowded")), "shared")
    x = written(k.join(shared, "key"), "candidates")
    few = x.filter("not crowded")
    pairs = few.filter("own").select("key", F.col("fp").alias("x")).join(few.select("key", F.col("fp").alias("y")), "key").filter("x <> y")
    verified = F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= ERRORS
    found = pairs.filter(verified).select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
    crowded = x.filter("crowded").select("fp").distinct()
    out = written(found.union(_crowded_links(crowded).filter(verified)).distinct(), "links")
    dropped(k, shared, x)
    return out


def simhash_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", crowd: int = CROWD) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id, copy_of.

    The fingerprint is by majority over the XXH64 of the three-word shingles of the whole text, repeats included, A-Z in
    lower case, words split at ASCII white space; texts of fewer words are one shingle. Fingerprints are linked if they
    differ in three bits or fewer. component_id is the smallest doc_id reachable over links, copy_of the smallest with an
    equal fingerprint. Equal fingerprints are one class from the start; classes are joined on keys() and verified, and
    beyond `crowd` fingerprints of one key they are linked as in _crowded_links(), so no group is held in one task.

    Null, empty and blank texts: fingerprint zero, linked like any other. Null doc_id: component_id and copy_of null,
    linked with nothing. Repeated rows come back repeated; a doc_id with several texts is grouped by each of them.
    Very long texts are hashed whole, in parts. Other columns are not read. Empty table: no rows."""
    short_batches(docs.sparkSession)
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    made = written(docs.mapInArrow(_fingerprinted, "doc_id long, fp long"), "fingerprints")
    classes = written(made.filter("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("copy_of"), F.count("*").alias("n")), "classes")
    found = links(classes.select("fp"), crowd)
    of = classes.select("fp", "copy_of")
    edges = found.join(of.toDF("x", "a"), "x").join(of.toDF("y", "b"), "y").select("a", "b")
    labels = components(edges)
    groups = classes.join(labels, classes.copy_of == labels.node, "left").select("fp", "copy_of", "n", F.coalesce("label", "copy_of").alias("label"))
    # A class of one document without links is its own component; the others are joined with their documents.
    tied = written(groups.filter("n > 1 or label <> copy_of"), "groups")
    dropped(classes, found)
    out = heavy_first(made, tied, ["fp"], "n")
    own = F.col("doc_id").isNotNull()
    each = [F.when(own, F.coalesce(c, "doc_id")).alias(name) for c, name in (("label", "component_id"), ("copy_of", "copy_of"))]
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), *each)
