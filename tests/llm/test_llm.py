"""The training-data operators against brute force, exact round trips and held-out accuracy, and their edge cases."""

import collections
import hashlib
import math
import random
import re
import textwrap
import types
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, pre_tokenizers

import __spark_entry__
import corpus_pipeline
from lodestar.llm import bpe, fingerprints, jaccard_join, langid, license_texts, licenses, lm, packing, quality_model, quality_rules, recent, store, token_counts

AT, MORE, MOST = "/root/testdata/sf0.001", "/root/testdata/sf0.01", "/root/testdata/sf0.1"
BYTES, WORDS, PIECES = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, label string, h long"
#: Nulls, empty and blank texts, ties, repeated rows, a very long text, columns with names that operators use inside.
EDGE = [
    (1, "alpha beta gamma delta epsilon zeta", "en", "s", 1, "x", 1), (1, "alpha beta gamma delta epsilon zeta", "en", "s", 1, "x", 1), (2, "alpha beta gamma delta epsilon zeta", None, None, None, None, None),
    (3, None, "en", "s", 0, "x", 1), (4, "", "en", "s", 0, "x", 1), (5, " \n\t ", "en", "s", 0, "x", 1), (None, "alpha beta gamma delta epsilon zeta", "en", "s", 1, "x", 1),
    (6, "MIT License. " + "word " * 30000, "fr", "s", 1, "x", 1), (7, "Released under the MIT License.", "fr", "s", 1, "x", 1), (9, "12 34 !!", "fr", "s", 1, "x", 1), (8, "<|endoftext|> don't ÉÉ été   x", "fr", "s", 1, "x", 1),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{AT}/documents.parquet").cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{AT}/labels.parquet").cache()


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGE, SCHEMA)


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


def fuzz(n=3000):
    random.seed(5)
    parts = ["a", "b", "the", "'s", "'", "!", " ", "  ", "\n", "\t", " ", "é", "Σ", "ς", "1", "22", "漢字", "\x1c", "don't", "$", "<|endoftext|>", "<|startoftext|>", "́", "İ", "½", "　", "\x85", "🙂", "▁", "THE.", "the,"]
    return ["".join(random.choices(parts, k=random.randint(0, 14))) for _ in range(n)] + ["a" * 3000, "é" * 500, "ab" * 31 + "c", "ab" * 32 + "c", "!?" * 300, " " * 50 + "x"]


@pytest.mark.parametrize(("name", "at"), [("op1_jaccard_join", AT), ("op4_license_scan", AT), ("op4_license_scan", MORE), ("op5_quality_rules", AT), ("op5_quality_rules", MOST)])
def test_same_as_sql(spark, name, at):
    c = duckdb.connect()
    for t in ("documents", "labels"):
        c.sql(f"create view {t} as select * from '{at}/{t}.parquet'")
    df, rel = __spark_entry__.queries()[name](spark, at), c.sql(__spark_entry__.oracle_sql()[name])
    rows = [dict(zip(rel.columns, r, strict=True)) for r in rel.fetchall()]
    assert sorted(str(sorted(r.asDict().items())) for r in df.collect()) == sorted(str(sorted(r.items())) for r in rows)


def test_jaccard_edges_and_near_copies(spark, edge):
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_groups(edge).collect()}
    assert {(1, 2, 1), (2, 2, 1), (3, 0, 3), (4, 0, 4), (5, 0, 5), (None, 2, None), (9, 1, 9)} <= got
    assert jaccard_join.jaccard_groups(edge.limit(0)).count() == 0
    random.seed(1)
    base = [f"w{i}" for i in range(120)]
    near = [(i, " ".join(f"x{i}" if random.random() < 0.03 else w for w in base)) for i in range(80)]
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(116)} for i, t in near}
    root = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = root[a], root[b]
                root = {k: min(x, y) if v in (x, y) else v for k, v in root.items()}
    assert {r.doc_id: r.component_id for r in jaccard_join.jaccard_groups(spark.createDataFrame(near, "doc_id long, text string")).collect()} == root


def test_token_counts(spark, docs, edge, texts):
    vocabulary = token_counts.unigram_vocabulary(PIECES)
    exact = Tokenizer(models.Unigram([("<unk>", 0.0), *vocabulary], unk_id=0))
    exact.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    counter = token_counts.Counter(vocabulary)
    assert [counter.count(t) for t in fuzz()] == [len(e.ids) for e in exact.encode_batch(fuzz())]
    assert {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs, PIECES).collect()} == {i: len(exact.encode(t).ids) for i, t in texts.items()}
    assert token_counts.token_counts(edge, PIECES).count() == len(EDGE)


def test_fingerprints(spark, docs, edge, texts):
    rows = sorted(fingerprints.edited_fingerprints(docs).collect(), key=lambda r: r.doc_id)
    ids = sorted(texts)
    of = collections.defaultdict(set)
    for r, i, j in zip(rows, ids, ids[1:] + ids[:1], strict=True):
        n = len(texts[i])
        assert (r.n_chars, r.edited_sha256) == (n, hashlib.sha256((texts[i][: n - n // 2] + texts[j][: n // 2]).encode()).hexdigest())
        of[r.fingerprint].add(texts[i])
    assert all(len(x) == 1 for x in of.values()) and len(of) == len(set(texts.values()))
    assert np.mean([r.near_edited for r in rows]) > 0.3 > np.mean([r.near_next for r in rows])
    got = fingerprints.edited_fingerprints(edge).collect()
    assert len(got) == len(EDGE) and len({r.fingerprint for r in got if r.doc_id in (1, 2, None)}) == 1
    assert fingerprints.edited_fingerprints(edge.limit(0)).count() == 0


def test_fingerprints_do_not_mind_order_and_add_up(spark):
    df = spark.createDataFrame([("one two.\nthree four", "three four\none two.", "one two.", "three four")], "a string, b string, c string, d string")
    f = fingerprints.fingerprints(df, [], {"a": "a", "b": "b", "c": "c", "d": "d"})
    t = fingerprints.as_text
    r = f.select((F.col("a") == F.col("b")).alias("same"), (t(fingerprints.combined(F.col("c"), F.col("d"))) == t(F.col("a"))).alias("sum"), (t(fingerprints.combined(F.col("a"), F.col("d"), -1)) == t(F.col("c"))).alias("less")).first()
    assert r.same and r.sum and r.less


def print_of(text):
    """A fingerprint's lanes, votes and phrases in plain Python."""
    lanes, votes, phrases = [0] * 8, [0] * 126, re.findall(fingerprints.PHRASE, text)
    chained = lambda i, s: xxhash.xxh64_intdigest(s.encode(), xxhash.xxh64_intdigest(i.to_bytes(4, "little"), 42))
    for p in (p for p in text.split("\n") if p.strip()):
        for i in range(4):
            h = chained(i, p)
            lanes[2 * i], lanes[2 * i + 1] = (lanes[2 * i] + h) % 2**32, (lanes[2 * i + 1] + (h >> 32)) % 2**32
    for p, times in collections.Counter(phrases).items():
        for i in range(2):
            h = chained(100 + i, p)
            for k in range(21):
                for j in range(3):
                    votes[63 * i + 3 * k + j] += times * (h >> k + 21 * j & 1)
    return lanes, votes, len(phrases)


def cosine(a, b):
    if a == b:
        return 1.0
    x, y = ([2 * v - n for v in votes] for _, votes, n in (a, b))
    norm = math.sqrt(sum(v * v for v in x) * sum(v * v for v in y))
    return min(1.0, max(0.0, sum(v * w for v, w in zip(x, y, strict=True)) / norm)) if norm else 0.0


def test_fingerprints_same_as_plain_python(spark, docs):
    rows = docs.orderBy("doc_id").limit(40).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    texts = [r.text for r in rows.collect()]
    f = fingerprints.fingerprints(rows, ["doc_id"], {"f": "text"}).select("doc_id", "f.lanes", fingerprints.votes(F.col("f")).alias("votes"), "f.phrases").orderBy("doc_id")
    want = [print_of(t) for t in texts]
    assert [(r.lanes, r.votes, r.phrases) for r in f.collect()] == want
    got = fingerprints.edited_fingerprints(rows).orderBy("doc_id").collect()
    for i, r in enumerate(got):
        n, after = len(texts[i]), (i + 1) % len(texts)
        edited = print_of(texts[i][: n - n // 2] + texts[after][: n // 2])
        assert r.near_edited == pytest.approx(cosine(want[i], edited)) and r.near_next == pytest.approx(cosine(want[i], want[after]))


def test_fingerprints_of_millions_of_phrases(spark):
    long = "ab." * 5_000_000
    df = spark.createDataFrame([(1, long + "\n" + "cd. " * 9), (2, "cd. " * 9 + "\n" + long), (3, "cd. ef"), (None, long)], "doc_id long, text string").repartition(4)
    got = {r.doc_id: r for r in fingerprints.edited_fingerprints(df).collect()}
    a, b, c = print_of(long + "\n" + "cd. " * 9), print_of("cd. " * 9 + "\n" + long), print_of("cd. ef")
    assert a == b and max(a[1]) > 1 << 22 and got[1].fingerprint == got[2].fingerprint and got[1].near_next == 1.0
    assert got[2].near_next == pytest.approx(cosine(b, c)) and got[None].near_next is None


def test_licenses_edges(spark, edge):
    got = collections.defaultdict(list)
    for r in licenses.license_scan(edge).collect():
        got[r.doc_id].append((r.license, r.n_matches > 0))
    assert got[7] == [("MIT", True)] and got[3] == got[4] == got[5] == [(None, False)] and got[1] == [(None, False)] * 2 and len(got[None]) == 1
    assert licenses.license_scan(edge.limit(0)).count() == 0
    other = spark.createDataFrame([("B", "you may not copy this at all"), ("A", "you may not copy this at all"), (None, "word word"), ("C", None), ("D", " - ")], "license string, text string")
    rows = spark.createDataFrame([(1, "So: you may\n not copy this at all, thanks"), (2, "nothing of the kind")], "doc_id long, text string")
    assert {r.doc_id: (r.n_matches, r.license, r.dice) for r in licenses.license_scan(rows, templates=other).collect()} == {1: (2, "A", 1.0), 2: (0, None, 0.0)}
    assert licenses.license_scan(rows, templates=other.limit(0)).filter("n_matches > 0").count() == 0


def test_licenses_wrapped_over_lines_and_amid_other_words(spark):
    full = {}
    for name, text in license_texts.TEXTS:
        full.setdefault(name, text)
    wrapped = {i: (name, "def f():\n" + "\n".join(f"    # {line}" for line in textwrap.wrap(full[name], 60)) + "\nreturn 1") for i, name in enumerate(["MIT", "Apache-2.0", "GPL-3.0", "BSD-3-Clause", "ISC", "Zlib"])}
    wrapped[10] = ("Proprietary", "Copyright 2020 Example Corp. All rights reserved.")
    wrapped[11] = ("MIT", "Some prose here. Released under the MIT License. More prose.")
    wrapped[12] = ("BSD-3-Clause", "\n".join("dnl " + line for line in textwrap.wrap(full["BSD-3-Clause"], 70)))
    got = licenses.license_matches(spark.createDataFrame([(i, t) for i, (_, t) in wrapped.items()], "doc_id long, text string")).collect()
    for r in got:
        name, text = wrapped[r.doc_id]
        assert name in {m.license for m in r.matches}
        for m in r.matches:  # no window of more than a template's words is like it by chance
            assert 0 <= m.word_no < len(re.findall(r"\w+", text)) and 0.75 <= m.dice <= 1


def binomial_at_most(k, n, p):
    return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))


def test_certified_cutoffs_same_as_brute_force(spark):
    """Several strata (null and empty apart), all rules, k > 0, a failure in the middle of a sequence, ties of gain."""
    random.seed(8)
    rules, values = list(quality_rules.CUTOFFS), []
    for stratum, n in (("a", 3000), ("b", 1500), (None, 900), ("", 900), ("few", 40)):
        for _ in range(n):
            good = random.random() < 0.7
            v = [random.random() ** (1.2 if not good else 25 if i else 120) * (0.9 if good else 1) for i, _ in enumerate(rules)]
            values.append((len(values), stratum, random.random() < 0.05, int(good), *v))
    df = spark.createDataFrame(values, "doc_id long, stratum string, base_failed boolean, quality int, " + ", ".join(f"{r} double" for r in rules))
    got = {(r.stratum, r.rule): r.cutoff for r in quality_rules.certified_cutoffs(df.drop("quality"), df.select("doc_id", "quality")).collect()}
    want, middle, some = {}, 0, 0
    strata = {v[1] for v in values}
    for stratum in strata:
        own = [v for v in values if v[1] == stratum and not v[2]]
        n = sum(v[3] for v in own)
        for i, rule in enumerate(rules):
            best = None
            for place, cutoff in enumerate(quality_rules.CUTOFFS[rule]):
                k, caught = (sum(v[3] == q and v[4 + i] > cutoff for v in own) for q in (1, 0))
                p = quality_rules.RISK / len(rules)
                if k > n * p or binomial_at_most(k, n, p) > quality_rules.MISS / len(rules) / len(strata):
                    middle += place > 0
                    break
                gain = caught - quality_rules.PRICE * k
                some += k > 0
                if gain > 0 and (best is None or gain > best[0]):
                    best = (gain, cutoff)
            if best:
                want[stratum, rule] = best[1]
    assert got == want and middle and some and len(want) > 5 and not any(s == "few" for s, _ in want)


def test_quality_rules(spark, edge, labels):
    assert quality_rules.quality_rules(edge, labels).count() == len(EDGE)
    assert quality_rules.quality_rules(edge.limit(0), labels.limit(0)).count() == 0
    plain = " ".join(f"w{i}" for i in range(80))
    rows = [(i, plain + (" ###***$$$%%%" * 60 if i % 4 == 0 else ""), "en") for i in range(4000)]
    got = quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(4000)], "doc_id long, quality int"))
    assert {(r.bad, r.kept) for r in got.select((F.col("doc_id") % 4 == 0).alias("bad"), "kept").distinct().collect()} == {(True, False), (False, True)}
    k, n = 7, 900
    exact = sum(math.comb(n, i) * 0.01**i * 0.99 ** (n - i) for i in range(k + 1))
    got = spark.range(1).select(quality_rules._at_most(F.lit(k).cast("long"), F.lit(n).cast("long"), 0.01).alias("p")).first().p
    assert got == pytest.approx(exact, rel=1e-9)


def naive_sum_of_squares(lengths, capacity, may_open):
    """Bins by trying every gap; may_open: a new bin is one of the choices even if others have room."""
    gaps, bins = collections.Counter(), 0
    for n in sorted(lengths, reverse=True):
        choices = [g for g in gaps if g >= n and gaps[g]]
        if may_open or not choices:
            choices.append(capacity + 1)

        def cost(g):
            after = collections.Counter(gaps)
            if g <= capacity:
                after[g] -= 1
            left = min(g, capacity) - n
            after[left] += left > 0
            return sum(v * v for k, v in after.items() if k > 0), g

        g = min(choices, key=cost)
        bins += g > capacity
        if g <= capacity:
            gaps[g] -= 1
        if min(g, capacity) - n > 0:
            gaps[min(g, capacity) - n] += 1
    return bins


def test_packing_rule_same_as_naive():
    """Placement by the plain rule, and both variants' numbers of sequences: that of opening late is not larger."""
    random.seed(9)
    for _ in range(20):
        lengths = [random.randint(1, 40) for _ in range(random.randint(1, 150))]
        bins, offsets = packing.sum_of_squares(np.array(lengths), 40)
        assert len(set(bins.tolist())) == naive_sum_of_squares(lengths, 40, False)
        full = collections.Counter()
        for b, n in zip(bins.tolist(), lengths, strict=True):
            full[b] += n
        assert max(full.values()) <= 40
    lengths = [min(2048, int(random.lognormvariate(5, 1)) + 1) for _ in range(400)]
    assert naive_sum_of_squares(lengths, 2048, False) <= naive_sum_of_squares(lengths, 2048, True)


def test_packing(spark, docs, edge, texts):
    exact = Tokenizer.from_file(WORDS)
    some = fuzz()
    tokenizer = packing.WordTokenizer(WORDS)
    assert [np.frombuffer(x, np.uint32).tolist() for x in tokenizer.encode(some)] == [e.ids for e in exact.encode_batch(some, add_special_tokens=False)]
    rows = packing.pack_documents(docs, WORDS).toPandas()
    for i, t in texts.items():
        ids = [*exact.encode(t, add_special_tokens=False).ids, 0]
        want = [(p // 2048, p, len(x := ids[p : p + 2048]), zlib.crc32(np.array(x, "<u4").tobytes())) for p in range(0, len(ids), 2048)]
        assert want == [tuple(r) for r in rows[rows.doc_id == i].sort_values("piece")[["piece", "start", "length", "ids_crc32"]].itertuples(index=False)]
    rows = rows.sort_values(["sequence_id", "offset"])
    assert (rows.groupby("sequence_id").length.cumsum() - rows.length == rows.offset).all() and rows.groupby("sequence_id").length.sum().max() <= 2048
    assert rows.sequence_id.nunique() <= math.ceil(rows.length.sum() / 2048) + 2
    assert packing.pack_documents(edge.limit(0), WORDS).count() == 0
    assert packing.pack_documents(edge, WORDS).select("doc_id").distinct().count() == 10


def test_bpe(spark, docs, edge, texts):
    exact, own = Tokenizer.from_file(BYTES), bpe.ByteBPE(BYTES)
    for t, e in zip(fuzz(), exact.encode_batch(fuzz(), add_special_tokens=False), strict=True):
        ids = np.frombuffer(own.encode(t), np.int32)
        assert ids.tolist() == e.ids and own.decode(ids) == exact.decode(e.ids, skip_special_tokens=False)
    for r in bpe.bpe_decode(bpe.bpe_encode(docs, BYTES), BYTES).collect():
        assert r.ids == exact.encode(texts[r.doc_id], add_special_tokens=False).ids and r.decoded == texts[r.doc_id]
    assert sorted(len(r.decoded) for r in bpe.bpe_decode(bpe.bpe_encode(edge, BYTES), BYTES).collect()) == sorted(len(e[1] or "") for e in EDGE)


def test_lm(spark, docs, edge, texts):
    rows = {r.doc_id: r for r in lm.lm_scores(docs).collect()}
    c, n = collections.Counter(), 0
    split = {i: [*t.encode().lower().split(), None] for i, t in texts.items()}
    for i, w in split.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            c.update(w)
            n += len(w)
    for i, w in split.items():
        r = rows[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(w), sum(c[x] > 0 for x in w), n, zlib.crc32(str(i).encode()) % 7 == 2)
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 1) / (n + len(c) + 1)) for x in w), rel=1e-9)
    assert sum(r.score for r in rows.values() if not r.held_out) > sum(r.base_score for r in rows.values() if not r.held_out)
    assert lm.lm_scores(edge).count() == len(EDGE) and lm.lm_scores(edge.limit(0)).count() == 0
    assert sum(r.score for r in rows.values() if r.held_out) > sum(r.base_score for r in rows.values() if r.held_out)


def test_lm_scores_are_those_of_the_definition(spark):
    """Probabilities from the parameters by plain loops over all symbols; they sum to 1; gradients by differences."""
    rng = np.random.default_rng(2)
    known = [f"w{i}".encode() for i in range(300)]
    stats = lm.Stats(known, np.arange(300.0, 0, -1), 250, np.full(lm.BUCKETS, 2.0), 45150 + 50, 301, 50)
    trainer = lm.Trainer(stats, 1)
    n = len(stats.share)
    symbols = [rng.integers(0, n, size).astype(np.int32) for size in (40, 0, 3)]
    context, token = lm.examples(symbols, stats.end)
    assert len(token) == 46 and context[0].tolist() == [stats.end] * lm.CONTEXT and token[39:42].tolist() == [symbols[0][39], stats.end, stats.end]
    assert context[5].tolist() == [symbols[0][4 - j] for j in range(lm.CONTEXT)]
    trainer.batches(context, token)
    p = {k: x.astype(np.float64) for k, x in trainer.p.items()}
    got = lm.Scorer.of(trainer.p).log10(context, token)
    for c, t, log in zip(context, token, got, strict=True):
        h = sum(p["r"][c[j]] @ p["C"][j] for j in range(lm.CONTEXT))
        classes = np.exp(p["k"][:, :-1] @ h + p["k"][:, -1])
        each = np.exp(p["q"][:, :-1] @ h + p["q"][:, -1])
        of = lambda s: classes[s // lm.WIDTH] / classes.sum() * each[s] / each[s // lm.WIDTH * lm.WIDTH : (s // lm.WIDTH + 1) * lm.WIDTH].sum()  # noqa: B023, E731
        assert log == pytest.approx(math.log10(of(t)), abs=1e-4)
        assert sum(of(s) for s in range(n)) == pytest.approx(1)
    h = np.column_stack([rng.normal(0, 1, (5, lm.DIM)), np.ones(5)])
    right, noise, table, shift = rng.integers(0, n, 5), rng.integers(0, n, 7), p["q"], trainer.draws["q"][1]
    s = lambda x: 1 / (1 + np.exp(-x))
    loss = lambda h: -np.log(s((h * table[right]).sum(1) - shift[right])).sum() - np.log(1 - s(h @ table[noise].T - shift[noise])).sum()
    dh = trainer.gradients("q", h, right, noise)[0]
    e = np.zeros_like(h)
    e[2, 3] = 1e-5
    assert dh[2, 3] == pytest.approx((loss(h + e) - loss(h - e)) / 2e-5, rel=1e-3)


def test_lm_does_not_mind_the_split(spark, docs, monkeypatch):
    monkeypatch.setattr(lm, "SHARD", 20_000)  # several shards
    of = lambda n: {(r.doc_id, r.n_tokens): r.score for r in lm.lm_scores(docs.repartition(n)).collect()}
    one, many = of(1), of(24)
    assert one.keys() == many.keys() and all(many[k] == pytest.approx(x, rel=1e-6) for k, x in one.items())


def test_lm_steps_do_not_mind_the_batches():
    rng = np.random.default_rng(1)
    symbols = [rng.integers(0, 900, n).astype(np.uint16) for n in rng.integers(0, 900, 400)]
    steps = lm.Steps(7)
    got = [part for s in symbols for part in steps.add(s)] + list(steps.rest())
    context, token = lm.examples(symbols, 7)
    assert (np.concatenate([c for c, _ in got]) == context).all() and (np.concatenate([t for _, t in got]) == token).all()
    assert {len(t) for _, t in got[:-1]} == {lm.BATCH} and list(lm.Steps(7).rest()) == []


def test_lm_state_comes_back_from_its_rows():
    stats = lm.Stats([b"a", b"b", b"c"], np.array([3.0, 2, 1]), 3, np.ones(lm.BUCKETS), 9, 4, 3)
    trainer = lm.Trainer(stats, (1, 2))
    trainer.step(*lm.examples([np.array([1, 2, 1, 3])], stats.end))
    keys, times, values = trainer.rows()
    p, sums = lm.replaced(lm.begun(stats), keys, values.astype(np.float32))
    assert (times > 0).all() and all((p[k] == x).all() for k, x in trainer.p.items()) and all(np.allclose(sums[k], x, rtol=1e-5) for k, x in trainer.sums.items())


def test_lm_words_are_cut_as_bytes_are():
    rng = np.random.default_rng(4)
    odd = ["", "  ", None, "\x0b", *("".join(rng.choice(list(" \t\n\r\x0b\x0c\x1c\x85\xa0\u2003\x00aAbÉé"), n)) for n in rng.integers(0, 40, 500))]
    for texts in (odd, ["", None], []):
        words, row, number = lm.cut(pa.array(texts, pa.string()))
        got = [[] for _ in texts]
        for r, n in zip(row, number, strict=True):
            got[r].append(words[n])
        assert got == [(t or "").encode().lower().split() for t in texts] and len(set(words)) == len(words)


def test_lm_looks_each_distinct_word_up_once(monkeypatch):
    stats, seen, own = lm.Stats([b"a"], np.array([3.0]), 1, np.ones(lm.BUCKETS), 9, 4, 3), [], lm.places
    monkeypatch.setattr(lm, "places", lambda stats, words: seen.extend(words) or own(stats, words))
    n = 50
    ids, texts = pa.array(range(n)), pa.array(["a b A  c b " * 20, ""] * (n // 2))
    batch = pa.RecordBatch.from_arrays([ids, ids, pa.array([False] * n), ids, texts], names=["rid", "doc_id", "held_out", "place", "text"])
    rows = pa.Table.from_batches(lm._encoded(types.SimpleNamespace(value=stats))([batch])).to_pylist()
    assert sorted(seen) == [b"a", b"b", b"c"]
    for i, r in enumerate(rows):
        few = dict(zip(r["rest"], r["times"], strict=True))
        assert (r["n_tokens"], r["n_known"], few) == ((101, 41, {b"b": 40, b"c": 20}) if i % 2 == 0 else (1, 1, {})) and len(r["symbols"]) == 2 * (r["n_tokens"] - 1)
        assert r["logs"] == pytest.approx((r["n_known"] - 1) * math.log10(4) + math.log10(4))


def test_lm_with_no_learned_words(spark):
    held = [i for i in range(40) if zlib.crc32(str(i).encode()) % 7 == 2]
    for rows in ([(i, "some words") for i in held], [(i, "some words" if i in held else " ") for i in range(40)]):
        got = lm.lm_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        learned = len(rows) - len(held)
        assert sorted((r.doc_id, r.n_tokens, r.n_known) for r in got) == sorted((i, len(t.split()) + 1, int(learned > 0)) for i, t in rows)
        assert all(math.isfinite(r.score) and r.train_tokens == learned for r in got)


def test_lm_long_words_and_text_end(spark):
    rows = [(i, "x" * 300 + " a b a" if i % 2 else "y" * 70 + " a") for i in range(40)]
    got = {r.doc_id: r for r in lm.lm_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    learned = [i for i in range(40) if zlib.crc32(str(i).encode()) % 7 != 2]
    c = collections.Counter(w for i in learned for w in [*rows[i][1].split(), None])
    n = sum(c.values())
    for i, t in rows:
        w = [*t.split(), None]
        assert got[i].n_known == len(w) and got[i].base_score == pytest.approx(sum(math.log10((c[x] + 1) / (n + len(c) + 1)) for x in w))
        assert math.isfinite(got[i].score) and got[i].score < 0


def test_quality_model(spark, docs, labels, edge):
    big, more = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality_model.quality_scores(big, more).join(more, "doc_id").filter("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.95
    assert quality_model.quality_scores(edge, labels).count() == len(EDGE)
    assert quality_model.quality_scores(edge.limit(0), labels.limit(0)).count() == 0


def test_quality_model_same_as_definition():
    """The forward pass by loops over passages and words, and the gradients by differences."""
    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{i * k % 90}" for i in range(150)) for k in (1, 7)] + ["", "One two $$$ three!"]
    bags = [quality_model.passages(t) for t in texts]
    model = quality_model.start(5)
    p = model.p = {k: x.astype(np.float64) for k, x in model.p.items()}
    *_, a, _, _, y = model.forward(*quality_model.together(bags))
    at = 0
    for b, score in zip(bags, y, strict=True):
        hs, ss = [], []
        for i in range(len(b)):
            words = b.words[b.starts[i] : b.starts[i + 1] if i + 1 < len(b) else None]
            h = np.tanh(np.concatenate([b.x[i], np.mean([p["W"][w] for w in words], 0)]) @ p["E"] + p["e"])
            hs.append(h)
            ss.append((np.tanh(h @ p["V"]) / (1 + np.exp(-(h @ p["U"])))) @ p["w"])
        weight = np.exp(ss) / np.exp(ss).sum()
        assert np.allclose(a[at : at + len(b)], weight, atol=1e-5)
        z = sum(w * h for w, h in zip(weight, hs, strict=True))
        assert score == pytest.approx(1 / (1 + math.exp(-(z @ p["c"] + p["d"][0]))), abs=1e-5)
        at += len(b)
    labels, weights = np.array([1.0, 0.0, 1.0, 0.0]), np.array([1.0, 2.0, 0.5, 1.0])
    bag = quality_model.together(bags)

    def loss():
        y = model.forward(*bag)[-1]
        return -(weights * (labels * np.log(y) + (1 - labels) * np.log(1 - y))).mean()

    grad = model.gradients(bag, labels, weights)
    for name, x in p.items():
        i = tuple(rng.integers(0, s) for s in x.shape) if name != "W" else (int(bags[0].words[3]), 2)
        old = x[i]
        x[i] = old + 1e-4
        up = loss()
        x[i] = old - 1e-4
        slope = (up - loss()) / 2e-4
        x[i] = old
        assert grad[name][i] == pytest.approx(slope, rel=1e-2, abs=1e-6), name
    long = quality_model.passages("a " * 64 * 300)
    thin = long.thinned(100)
    assert len(long) == 300 and len(thin) == 100 and len(thin.words) == 6400 and thin.starts[-1] == 99 * 64


def test_quality_model_cases(spark, edge, labels):
    rows = quality_model.quality_scores(edge, labels).collect()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) and 0 <= r.top_passage < r.n_passages for r in rows)
    of = collections.defaultdict(set)
    for r in rows:
        of[r.doc_id].add((round(r.score, 6), r.n_passages))
    assert len(of[1]) == 1 and of[1] == of[2] == of[None] and of[3] == of[4] == of[5]
    assert {r.held_out for r in rows if r.doc_id is None} == {True}


def test_language_id(spark, docs, edge):
    rows = langid.identify(docs).join(docs, "doc_id").filter("held_out").collect()
    assert np.mean([r.lang_pred == r.lang for r in rows]) > 0.95
    got = {r.doc_id: r for r in langid.identify(edge).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 and got[i].rejected for i in (3, 4, 5, 9))
    assert langid.identify(edge.limit(0)).count() == 0


def test_language_id_same_as_definition(spark):
    """Logits of a text as the mean of its subwords' contributions, by loops; ties go to the first label."""
    rng = np.random.default_rng(1)
    model = langid.Model(["a", "b", "c"], rng.normal(0, 1, (langid.BUCKETS, 3)), rng.normal(0, 1, 3), rng.normal(0, 1, (langid.BUCKETS, 3)), 2.0)
    text = "Été à la   plage, l'été! 12 x"
    words = langid.words_of(text)
    assert words == ["été", "à", "la", "plage", "l", "été", "x"]
    parts = [zlib.crc32(f"<{w}>"[i : i + n].encode()) % langid.BUCKETS for w in words for n in (2, 3, 4) for i in range(len(w) + 3 - n)]
    logits, likely = langid._Scorer(model).sums(words)
    assert np.allclose(logits, np.mean([model.gain[x] for x in parts], 0) + model.bias, atol=1e-5)
    assert np.allclose(likely, np.mean([model.likely[x] for x in parts], 0), atol=1e-5)
    e = np.exp(logits / 2)
    assert np.allclose(model.probabilities(logits), e / e.sum())
    rows = [(i, "same words here", "x" if i % 2 else "y") for i in range(40)] + [(100, "same words here " * 20000, None)]
    got = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert len({r.lang_pred for r in got}) == 1 and len({round(r.score, 4) for r in got}) == 1 and len(got) == 41


def test_many_languages_are_all_learned(spark):
    random.seed(2)
    rows = [(i, " ".join("".join(random.choices("bcdfgaeiou", k=2)) + chr(0x4E00 + i % 230) * 3 for _ in range(20)), f"l{i % 230:03}") for i in range(5750)]
    got = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert len({r.lang_pred for r in got}) > 210


def test_pipeline_stages_edges(spark, edge, tmp_path):
    wide = edge.withColumn("n", F.lit(1)).withColumn("kept", F.lit("x")).withColumn("stratum", F.lit("y")).withColumn("rejected", F.lit(2))
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    prose = " ".join(f"word{i} and" for i in range(60))
    more = spark.createDataFrame([(None, prose, "en", "s", 1, "x", 1), (20, prose, "en", "s", 1, "x", 1), (20, prose, "en", "s", 1, "x", 1), (21, prose + " end", "en", "s", 1, "x", 1)], SCHEMA)
    both = wide.select(edge.columns).union(more)
    for docs, size in ((wide, None), (both, None), (wide.limit(0), 0)):
        out = docs
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, out, str(tmp_path))
            if name != "packing":
                assert out.columns == docs.columns
            assert size is None or out.count() == size
    kept = corpus_pipeline.quality(spark, more, str(tmp_path))
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["20", "20", "21", "None"]
    assert sorted(str(r.doc_id) for r in corpus_pipeline.near_duplicates(spark, more, "").collect()) == ["20", "None"]


def test_pipeline_same_as_brute_force(spark, texts):
    rows = corpus_pipeline.run(spark, AT).toPandas()
    words = {i: (t or "").encode().split() for i, t in texts.items()}
    repeated = {}
    for i, w in words.items():
        n, at = collections.Counter(zip(w, w[1:], w[2:], strict=False)), set()
        for k in range(len(w) - 2):
            at |= {k, k + 1, k + 2} if n[w[k], w[k + 1], w[k + 2]] > 1 else set()
        repeated[i] = len(at)
    kept = {i for i, w in words.items() if len(w) >= 50 and 2 * repeated[i] <= len(w)}  # too few labels here for more
    sets = {i: {tuple(x.lower() for x in words[i][k : k + 5]) for k in range(len(words[i]) - 4)} for i in sorted(kept)}
    root = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = root[a], root[b]
                root = {k: min(x, y) if v in (x, y) else v for k, v in root.items()}
    assert set(rows.doc_id) == set(root.values())
    assert rows.groupby("sequence_id").length.sum().max() <= 2048


FOREIGN = [
    "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä.",
    "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa.",
    "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства.",
]


def test_language_id_rejects_at_every_size(spark):
    random.seed(3)
    gibberish = [" ".join("".join(random.choices("bcdfghjklmnpqrstvwxzj", k=random.randint(3, 9))) for _ in range(120)) for _ in range(3)]
    planted = [(-1 - i, " ".join([t] * 3), None) for i, t in enumerate(FOREIGN + gibberish)] + [(-9, "de " + "1234 5678 %% " * 200, None)]
    for at in (AT, "/root/testdata/sf0.01", "/root/testdata/sf0.1"):
        docs = spark.read.parquet(f"{at}/documents.parquet").select("doc_id", "text", "lang")
        rows = langid.identify(docs.union(spark.createDataFrame(planted, docs.schema))).collect()
        assert all(r.rejected for r in rows if r.doc_id < 0), at
        assert np.mean([r.rejected for r in rows if r.doc_id >= 0]) < 0.01, at


def test_token_counts_of_whole_texts(spark):
    vocabulary = token_counts.unigram_vocabulary(PIECES)
    least = min(s for _, s in vocabulary)
    exact = Tokenizer(models.Unigram([("<unk>", 0.0), *vocabulary, *((f"<0x{i:02X}>", least) for i in range(256))], unk_id=0, byte_fallback=True))
    exact.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="never", split=False)
    own = ["def f():\n" + " " * 16 + "return 1\n\n\n", "a  b   c", "🫠🫠", "\n\n\n", "x\t\ty  ", *fuzz()]
    rows = spark.createDataFrame(list(enumerate(own)), "doc_id long, text string")
    want = [len(exact.encode("▁" + t).ids) if t else 0 for t in own]
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(rows, PIECES).collect()}
    assert [got[i] for i in range(len(own))] == want
    assert got[3] == 4 and got[2] == 9


def test_batches_of_texts_are_short_in_bytes(spark):
    sizes = lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows], "size": [b.nbytes]}) for b in batches)
    store.short_batches(spark)
    long = spark.range(0, 300, 1, 1).select(F.repeat(F.lit("0123456789"), 10_000).alias("text"))
    rows = long.mapInArrow(sizes, "n long, size long").collect()
    assert sum(r.n for r in rows) == 300 and max(r.size for r in rows) < 5 << 20
    huge = spark.range(0, 3, 1, 1).select(F.repeat(F.lit("0123456789"), 800_000).alias("text"))
    assert [r.n for r in huge.mapInArrow(sizes, "n long, size long").collect()] == [1, 1, 1]


def test_caches_are_emptied_for_other_operators():
    def of(operator):
        def run(batches):
            yield from ([cache[b] for b in batches])

        run.__module__ = operator
        return recent.giving_back(run)

    cache, tokenizer = recent.Recent(len, size=2), packing.WordTokenizer(WORDS)
    ids = tokenizer.encode(["some words"])
    assert list(of("one")(["a", "bb", "ccc"])) == [1, 2, 3] and dict(cache) == {"ccc": 3} and cache.old == {"a": 1, "bb": 2}
    assert list(of("one")(["bb"])) == [2] and len(cache) + len(cache.old) == 4  # kept between tasks of one operator
    assert list(of("other")([])) == [] and not cache and not cache.old and not tokenizer.now
    assert tokenizer.encode(["some words"]) == ids
