"""Vector codes, SimHash groups and alignment against SQL and brute force, and their edge cases."""

import hashlib
import random

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__
from lodestar.llm import alignment, simhash, store, vector_codes
from test_llm import AT, EDGE, SCHEMA, fuzz

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGE, SCHEMA)


def codes_of(rows):
    """Product codes by the definition: (vec_id, label, vector) of kept rows -> {place: (code, error)}, codebooks."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0], rows[i][2]))
    x = [[int(np.floor(1024 * float(c))) for c in rows[i][2]] for i in order]
    w = len(x[0]) // 4
    out, books = {i: ["", 0] for i in order}, []
    for p in range(4):
        parts = [v[p * w : (p + 1) * w] for v in x]
        book = [list(v) for v in parts[:256]]
        for r in range(5):
            got = []
            for v in parts:
                d = [sum((a - b) ** 2 for a, b in zip(v, e, strict=True)) for e in book]
                got.append((d.index(min(d)), min(d)))
            if r < 4:
                for e in range(len(book)):
                    own = [v for v, (g, _) in zip(parts, got, strict=True) if g == e]
                    if own:
                        book[e] = [sum(c) // len(own) for c in zip(*own, strict=True)]
        books += [c for e in book for c in e]
        for i, (e, d) in zip(order, got, strict=True):
            out[i][0] += f"{e:02x}"
            out[i][1] += d
    return out, hashlib.sha256(",".join(map(str, books)).encode()).hexdigest()


def test_vector_codes_same_as_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{AT}/embeddings.parquet'")
    want = sorted(con.sql(__spark_entry__.oracle_sql()["op11_vector_codes"]).fetchall())
    got = sorted(tuple(r) for r in __spark_entry__.queries()["op11_vector_codes"](spark, AT).collect())
    assert got == want


def test_vector_codes_same_as_definition(spark):
    random.seed(3)
    rows = [(i, i % 3 or None, [random.choice([0.0, 0.25, -0.3, 0.7001, 12.5, -3e3]) + random.choice([0, 1e-3]) for _ in range(8)]) for i in range(300)]
    rows += [(i, 1, rows[7][2]) for i in range(400, 420)] + [rows[5], (None, None, rows[9][2])]
    bad = [(500, 1, None), (501, 1, [1.0, None] * 4), (502, 1, [float("nan")] * 8), (503, 1, [float("inf")] * 8), (504, 1, [1.0] * 4)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows + bad], "vec_id long, label int, embedding array<double>, error string, cell int").repartition(3)
    want, digest = codes_of(rows)
    sums = {}
    for i, (_, e) in want.items():
        sums[rows[i][1]] = sums.get(rows[i][1], 0) + e
    got = vector_codes.vector_codes(df).collect()
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(map(tuple, got), key=key) == sorted([(rows[i][0], c, e, sums[rows[i][1]], digest) for i, (c, e) in want.items()], key=key)


def test_vector_codes_cases(spark):
    schema = "vec_id long, label string, embedding array<float>"
    assert vector_codes.vector_codes(spark.createDataFrame([], schema)).collect() == []
    one = vector_codes.vector_codes(spark.createDataFrame([(1, None, [0.5, -0.5, 1.0])], schema)).collect()
    assert [(r.vec_id, r.code, r.error, r.label_error) for r in one] == [(1, "00000000", 0, 0)]
    empty = vector_codes.vector_codes(spark.createDataFrame([(1, "a", []), (2, "a", [])], schema)).collect()
    assert [(r.code, r.error) for r in empty] == [("00000000", 0)] * 2
    huge = vector_codes.vector_codes(spark.createDataFrame([(1, "a", [1e30] * 4), (2, "a", [16384.0] * 4)], schema)).collect()
    assert [r.error for r in huge] == [0, 0] and len({r.code for r in huge}) == 1


def test_bounds_never_drop_the_nearest():
    rng = np.random.default_rng(4)
    for scale in (3, 300, 1 << 24):
        for w in (1, 3, 16, 33):
            book, x = rng.integers(-scale, scale + 1, (256, w)), rng.integers(-scale, scale + 1, (500, w))
            x[:50] = book[:50]
            got, d = vector_codes.Codebook(book).nearest(x)
            want = ((x[:, None] - book) ** 2).sum(2)
            assert (got == want.argmin(1)).all() and (d == want.min(1)).all()


def print_of(text):
    words = (text or "").encode().translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")).split()
    if not words:
        return 0
    s = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups_of(prints):
    """Smallest id reachable over pairs of fingerprints within three bits, by comparing all."""
    of = {}
    for i, p in prints:
        of[p] = min(i, of.get(p, i))
    nodes = list(of)
    up = {p: p for p in nodes}

    def root(p):
        while up[p] != p:
            up[p] = up[up[p]]
            p = up[p]
        return p

    x = np.array(nodes, np.uint64)
    for i, p in enumerate(nodes):
        for j in np.flatnonzero(np.bitwise_count(x[i + 1 :] ^ x[i]) <= 3):
            up[root(nodes[i + 1 + j])] = root(p)
    least = {}
    for p in nodes:
        least[root(p)] = min(of[p], least.get(root(p), of[p]))
    return {p: least[root(p)] for p in nodes}


def test_simhash_same_as_brute_force(spark):
    docs = spark.read.parquet(f"{AT}/documents.parquet")
    prints = [(r.doc_id, print_of(r.text)) for r in docs.collect()]
    group = groups_of(prints)
    got = sorted(tuple(r) for r in __spark_entry__.queries()["op12_simhash"](spark, AT).collect())
    assert got == sorted((i, f"{p:016x}", group[p]) for i, p in prints)


def test_simhash_keys_meet_within_three_bits():
    parity, around = simhash.golay()
    assert ((around >= 0).sum(1) == 1).sum() == 1 + 23 + 253 and ((around >= 0).sum(1) == 6).sum() == 1771
    rng = np.random.default_rng(2)
    x = rng.integers(-(2**63), 2**63 - 1, 20_000)
    for errors in range(4):
        y = x.view(np.uint64).copy()
        for _ in range(errors):
            y ^= np.uint64(1) << rng.integers(0, 64, len(y), dtype=np.uint64)
        assert (simhash.keys(x)[:, :, :1] == simhash.keys(y.view(np.int64))).any((1, 2)).all()


@pytest.mark.parametrize("crowd", [1, 8, 1024])
def test_simhash_links_connect_the_same_groups(spark, crowd):
    rng = np.random.default_rng(5)
    prints = []
    for center in rng.integers(-(2**63), 2**63 - 1, 6):
        for _ in range(60):
            y = np.uint64(np.int64(center).view(np.uint64))
            for _ in range(rng.integers(0, 7)):
                y ^= np.uint64(1) << np.uint64(rng.integers(0, 40))
            prints.append(int(y))
    prints = sorted(set(prints))
    df = spark.createDataFrame([(int(np.uint64(p).view(np.int64)),) for p in prints], "fp long")
    found = simhash.links(df, crowd).collect()
    assert all((r.x ^ r.y).bit_count() <= 3 if r.x >= 0 and r.y >= 0 else bin((r.x ^ r.y) & (1 << 64) - 1).count("1") <= 3 for r in found)
    want, group = groups_of([(p, p) for p in prints]), {p: p for p in prints}

    def root(p):
        while group[p] != p:
            p = group[p]
        return p

    mask = (1 << 64) - 1
    for r in found:
        a, b = sorted((root(r.x & mask), root(r.y & mask)))
        group[b] = a
    assert {p: root(p) for p in prints} == want
    if crowd == 1024:  # nothing is crowded: all links are there
        x = np.array(prints, np.uint64)
        assert len(found) == sum(int((np.bitwise_count(x[i + 1 :] ^ x[i]) <= 3).sum()) for i in range(len(x)))


def test_simhash_cases(spark, edge):
    got = simhash.simhash_groups(edge).collect()
    assert len(got) == len(EDGE)
    for doc, text, *_ in EDGE:
        mine = [r for r in got if r.doc_id == doc]
        assert f"{print_of(text):016x}" in {r.fingerprint for r in mine}
    named = {r.doc_id: r for r in got}
    assert named[None].component_id is None and named[2].component_id == 1 and [r.doc_id for r in got].count(1) == 2
    assert {named[i].fingerprint for i in (3, 4, 5)} == {"0" * 16} and {named[i].component_id for i in (3, 4, 5)} == {3}
    assert simhash.simhash_groups(edge.limit(0)).collect() == []
    long = " ".join(f"w{i}" for i in range(250_000))
    assert simhash.fingerprint(long) & (1 << 64) - 1 == print_of(long)


def alignment_of(texts):
    """What align() returns, by the definition: all pairs of tokens whose bytes overlap."""
    of = alignment.byte_of_char()
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    found, counts = [], {}
    for t in texts:
        x, y, raw = [], [], (" " + (t or "")).encode()
        if t:
            x = [(i, bytes(of[c] for c in a.id_to_token(i))) for i in a.encode(" " + t, add_special_tokens=False).ids]
            y = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(t)]
            if b"".join(z for _, z in x) != raw or b"".join(z for _, z in y) != raw:
                x, y = [], []
        links, text = [], ""
        ends = [np.cumsum([0, *(len(z) for _, z in s)]) for s in (x, y)]
        for i in range(len(x)):
            for j in range(len(y)):
                if ends[0][i] < ends[1][j + 1] and ends[1][j] < ends[0][i + 1]:
                    links.append((x[i][0], y[j][0]))
        common = sorted(set(ends[0][1:]) & set(ends[1][1:]))
        for low, high in zip([0, *common], common, strict=False):
            part = [",".join(str(s[k][0]) for k in range(len(s)) if low < e[k + 1] <= high) for s, e in ((x, ends[0]), (y, ends[1]))]
            text += (";" if text else "") + "|".join(part)
        for k in links:
            counts[k] = counts.get(k, 0) + 1
        found.append((len(x), len(y), len(common), links, hashlib.sha256(text.encode()).hexdigest() if x else ""))
    best = {}
    for (_, y), n in counts.items():
        best[y] = max(n, best.get(y, 0))
    return [(*f[:3], len(f[3]), sum(counts[k] == best[k[1]] for k in f[3]), sum(counts[k] for k in f[3]), f[4]) for f in found]


@pytest.mark.parametrize("part", [alignment.PART, 500])
def test_alignment_same_as_definition(spark, part):
    texts = [r.text for r in spark.read.parquet(f"{AT}/documents.parquet").limit(60).collect() if r.text and len(r.text) < 3000]
    texts += fuzz(400) + ["a ", " ", "  x  y ", "▁", "</s> <s> <0x41>", "\u0000a", None, "", texts[0], texts[0]]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, block string").repartition(5)
    got = {r[0]: tuple(r)[1:] for r in alignment.align(df, A, B, part=part).collect()}
    assert [got[i] for i in range(len(texts))] == alignment_of(texts)


def test_alignment_cases(spark, edge):
    got = alignment.align(edge, A, B).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in EDGE)
    zero = [r for r in got if r.doc_id in (3, 4)]
    assert all(tuple(r)[1:] == (0, 0, 0, 0, 0, 0, "") for r in zero) and len(zero) == 2
    same = {tuple(r)[1:] for r in got if r.doc_id in (1, 2, None)}
    assert len(same) == 1
    assert all(r.n_links >= max(r.n_a, r.n_b) and 0 < r.n_best <= r.n_links for r in got if r.n_a)
    assert alignment.align(edge.limit(0), A, B).collect() == []


def test_blocks_of_texts():
    assert list(alignment._blocks(["x"] * 2500)) == [(0, 1000), (1000, 2000), (2000, 2500)]
    assert list(alignment._blocks(["x" * 4_000_000, "y", None, "z" * 2_999_999, "w"])) == [(0, 1), (1, 4), (4, 5)]
    assert list(alignment._blocks([])) == []


def test_heavy_classes_same_as_a_join(spark, monkeypatch):
    rows = spark.createDataFrame([(i, "k%d" % (0 if i < 400 else i % 7)) for i in range(600)] + [(600, "none")], "i long, k string")
    classes = store.written(rows.filter("k <> 'none'").groupBy("k").agg(F.min("i").alias("first"), F.count("*").alias("n")), "classes")
    want = {r.i: r["first"] for r in rows.join(classes, "k", "left").collect()}
    for most in (1000, 2):  # all broadcast; heavy ones alone
        monkeypatch.setattr(store, "BROADCAST_ROWS", most)
        got = store.heavy_first(rows, classes, ["k"], "n", heavy=100).collect()
        assert {r.i: r["first"] for r in got} == want and len(got) == len(want)


def test_empty_tables_and_values_of_repeated_rows(spark, edge):
    from lodestar.llm import bpe, token_counts

    assert token_counts.token_counts(edge.limit(0), B).collect() == [] and bpe.bpe_encode(edge.limit(0), A).collect() == []
    counts = token_counts.token_counts(edge, B).collect()
    column = next(c for c in counts[0].asDict() if c != "doc_id")
    assert len({r[column] for r in counts if r.doc_id in (1, 2, None)}) == 1 and {r[column] for r in counts if r.doc_id in (3, 4)} == {0}
    ids = {r.doc_id: r.ids for r in bpe.bpe_encode(edge, A).collect()}
    assert ids[1] == ids[2] == ids[None] and ids[3] == ids[4] == [] and len(ids[6]) > 30_000
