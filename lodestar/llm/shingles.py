"""Sets of hashed word shingles, their prefixes, signatures and tests; numpy helpers of the n-gram Jaccard join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

from lodestar.llm.recent import Recent, giving_back

SHINGLE = 5
BITS = 2048
#: Longs of the coarse bitmap: the bitmap folded by exclusive or.
COARSE = 8
N_STARS = 8
#: Odd multipliers of the word roll, of the final mixing and of the star permutations (fixed values).
ROLL, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
STARS = np.array([xxhash.xxh3_64_intdigest(f"star {i}") | 1 for i in range(N_STARS)], np.uint64)
_hashes = Recent(xxhash.xxh3_64_intdigest, size=150_000)


def shingle_set(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the `size`-word shingles of a text, A-Z in lower case, words split at
    ASCII white space. Fewer words make one shingle; no words or no text make an empty set."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, n)
    k = min(size, n)
    m = n - k + 1
    acc = np.full(m, k, np.uint64)
    for j in range(k):
        acc = acc * ROLL + h[j : j + m]
        acc ^= acc >> np.uint64(31)
    acc *= MIX
    acc ^= acc >> np.uint64(29)
    return np.unique(acc)


def parity_bits(s: np.ndarray) -> bytes:
    """A bitmap of BITS bits; each is the parity of the members hashed to it. Two bitmaps differ in at most as many
    bits as the sets have members not in common."""
    odd = np.bincount((s * MIX >> np.uint64(64 - BITS.bit_length() + 1)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def prefix_length(n: int, percent: int) -> int:
    """Two sets with 100 * common >= percent * union share a member among the first prefix_length of either, in any
    common order of members."""
    return n - -(-n * percent // 100) + 1 if n else 0


def described(frequent: np.ndarray, percent: int):
    """For mapInArrow over (doc_id, text): set size, digest, rare-first prefix and signatures of each document.
    frequent: sorted hashes that come last in the order of members; any such list gives the same links."""

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 2000) for i in range(0, batch.num_rows, 2000)):
                n, digest, rare, common, stars, bits, coarse = [], [], [], [], [], [], []
                for text in part.column(1).to_pylist():
                    s = shingle_set(text)
                    n.append(len(s))
                    digest.append(xxhash.xxh3_128_digest(s.tobytes()))
                    late = np.zeros(len(s), bool)
                    if len(frequent) and len(s):
                        at = np.searchsorted(frequent, s)
                        late = frequent[np.minimum(at, len(frequent) - 1)] == s
                    p, early = prefix_length(len(s), percent), s[~late]
                    rare.append(early[:p].view(np.int64))
                    common.append(s[late][: max(0, p - len(early))].view(np.int64))
                    stars.append((s[:, None] * STARS).min(0).view(np.int64) if len(s) else [])
                    bits.append(parity_bits(s))
                    coarse.append(np.bitwise_xor.reduce(np.frombuffer(bits[-1], np.int64).reshape(-1, COARSE)))
                longs = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(rare, longs), pa.array(common, longs), pa.array(stars, longs), pa.array(bits, pa.binary()), pa.array(coarse, longs)],
                    names=["doc_id", "n_shingles", "digest", "rare", "common", "stars", "bits", "coarse"],
                )

    return run


DESCRIBED = "doc_id long, n_shingles long, digest binary, rare array<long>, common array<long>, stars array<long>, bits binary, coarse array<long>"


@giving_back
def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over (doc_id, text): (doc_id, members), the whole sorted set of each document."""
    for batch in batches:
        for part in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
            sets = [shingle_set(t).view(np.int64) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["doc_id", "members"])


@giving_back
def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over (text): (h, df), in how many texts of a batch each shingle is."""
    for batch in batches:
        for part in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
            sets = [shingle_set(t) for t in part.column(0).to_pylist()]
            h, df = np.unique(np.concatenate(sets or [np.empty(0, np.uint64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(df.astype(np.int64))], names=["h", "df"])


def common_at_most(na: np.ndarray, nb: np.ndarray, bits_a: list[bytes], bits_b: list[bytes]) -> np.ndarray:
    """Upper bounds of the numbers of common members, from the sizes and the bit counts of the differing bits."""
    a, b = (np.frombuffer(b"".join(x), np.uint64).reshape(-1, BITS // 64) for x in (bits_a, bits_b))
    return (na + nb - np.bitwise_count(a ^ b).sum(1, dtype=np.int64)) // 2


def common_members(a: np.ndarray, b: np.ndarray) -> int:
    """The size of the intersection of two sorted arrays of distinct hashes."""
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    return int((both[1:] == both[:-1]).sum())
