"""The matcher of a vocabulary in sentences against a plain reading, and its cases."""

import random
import re

from lodestar.operators import matcher
from lodestar.plans import questions as Q
from lodestar.plans.binding import Catalog

AT = "/root/testdata/sf0.001"


def plainly(sentence, vocabulary):
    """The same by trying each word at each place, with no index."""
    text, taken, hits = (sentence or "").lower(), set(), []
    letter = lambda c: c.isalnum() and not "一" <= c <= "鿿"
    for word in sorted({w.lower() for _, w, _ in vocabulary}, key=lambda w: (-len(w), w)):
        for i in range(len(text)):
            j = i + len(word)
            if text[i:j] == word and not (i and letter(text[i - 1]) and letter(text[i])) and not (j < len(text) and letter(text[j]) and letter(text[j - 1])):
                hits.append((-len(word), i, word))
    found = []
    for n, i, word in sorted(hits):
        if not taken & set(range(i, i - n)):
            taken |= set(range(i, i - n))
            found.append((i, word))
    out = []
    for i, word in found:
        # Walk back to the last negation that no clause end lies behind.
        negated = False
        for m in matcher.NEGATION.finditer(text):
            ends = [e.start() for e in matcher.CLAUSE.finditer(text) if e.start() not in taken and e.start() >= m.end()]
            negated |= m.start() not in taken and m.end() <= i < min([*ends, len(text)])
        out += [(i, f, word, v, negated) for f, w, v in sorted(set(vocabulary)) if w.lower() == word]
    return sorted(out)


VOCABULARY = [("tissue", "liver", "L"), ("tissue", "bone marrow", "BM"), ("tissue", "bone", "B"), ("marrow", "Marrow", "M"), ("tech", "10x", "X"), ("tissue", "肝", "L"), ("tissue", "肝脏", "L"), ("both", "liver", "other"), ("a", "a b", "1"), ("a", "b a", "2")]


def test_cases():
    read = lambda s: matcher.Matcher(VOCABULARY).read(s)
    assert [(w, n) for _, _, w, _, n in read("Bone marrow without 10X or bone, in liver")] == [("bone marrow", False), ("10x", True), ("bone", True), ("liver", False), ("liver", False)]
    assert [w for _, _, w, *_ in read("livers bones 肝脏肝")] == ["肝脏", "肝"] and read(None) == [] and read("") == []
    assert [w for _, _, w, *_ in read("a b a")] == ["a b"]
    assert [(w, n) for _, _, w, _, n in read("排除 肝脏 但 10x")] == [("肝脏", True), ("10x", False)]
    assert matcher.Matcher([]).read("liver") == []


def test_same_as_a_plain_reading():
    random.seed(4)
    parts = ["liver", "bone", "marrow", " ", " ", ", ", "not ", "without ", "10x", "肝", "脏", "a", "b", " but ", "no", " in ", "s", "非"]
    m = matcher.Matcher(VOCABULARY)
    for _ in range(3000):
        s = "".join(random.choices(parts, k=random.randint(1, 12)))
        assert sorted(m.read(s)) == plainly(s, VOCABULARY), s


def test_queries_same_as_a_plain_reading(spark):
    k = Catalog(spark, AT)
    asked = {r.id: r.question for r in Q.questions(k).collect() if r.id >= 0 or len(r.question or "") < 300}
    words = [tuple(r) for r in Q.vocabulary(k).collect()]
    got = {}
    for r in Q.questions_matched(k).collect():
        got.setdefault(r.id, []).append((r.at, r.field, r.word, r.value, r.negated))
    some = [i for i in asked if i < 0] + [i for i in asked if 0 <= i < 40]
    assert all(sorted(got.get(i, [])) == plainly(asked[i], words) for i in some)
    intents = {r.id: r for r in Q.question_intents(k).collect()}
    assert len(intents) == Q.questions(k).count()
    for i in some:
        hits = plainly(asked[i], words)
        of = lambda f: list(dict.fromkeys(v for _, n, _, v, x in hits if n == f and not x))  # noqa: B023, E731
        r = intents[i]
        assert r.part == "|".join(of("part")) and r.region == "|".join(of("region")) and r.recent == bool(of("recent")) and r.species == (of("species") or ["Homo sapiens"])[0]
        assert set(filter(None, r.excluded.split("|"))) == {w for _, _, w, _, x in hits if x}


def test_too_large_a_vocabulary_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(matcher, "MOST_WORDS", 3)
    rows = spark.createDataFrame([("f", f"w{i}", "v") for i in range(5)], "field string, word string, value string")
    try:
        matcher.matched(spark.createDataFrame([(1, "w1")], "id long, t string"), "id", "t", rows)
    except ValueError as e:
        assert re.search("more than 3", str(e))
    else:
        raise AssertionError


def test_few_sentences_words_are_held():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array(["red bolt"] * 999 + [None])], names=["id", "t"])
    got = list(matcher._read(matcher.Matcher([("f", "red", "r"), ("f", "bolt", "b")]), iter([batch, batch.slice(0, 0)]), "id"))
    assert max(b.num_rows for b in got) <= 2 * matcher.HELD and [i for b in got for i in b.column(0).to_pylist()] == [i // 2 for i in range(1998)]
