"""Words of a vocabulary in a column of sentences: all of them in one pass, longest first, with the reach of negations."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A vocabulary of more words than this would not be broadcast: it is an error.
MOST_WORDS = 500_000
#: What turns the meaning of the words behind it, and what ends its reach (fixed values).
NEGATION = re.compile(r"\b(?:not|no|non|without|excluding|exclude|except)\b|排除|除了|不是|不要|没有|非")
CLAUSE = re.compile(r"[.;!?,，。；！？]|\b(?:but|with|in|from|and also)\b|但是?|而")
#: Sentences whose words are held at once.
HELD = 200
FOUND = "id {id}, at int, field string, word string, value string, negated boolean"


def _letter(c: str) -> bool:
    return c.isalnum() and not "一" <= c <= "鿿"


@dataclass
class Matcher:
    """Finds the words of (field, word, value) rows. Of words that overlap the longest is taken, of equally long ones the
    first; what it took is not read again. A word of letters is found as a whole word, Chinese signs anywhere. One
    word may stand for several values, of several fields."""

    rows: list[tuple[str, str, str]]

    def __post_init__(self):
        self.trie, of = ahocorasick.Automaton(), {}
        for name, word, value in sorted({(n, w.lower(), v) for n, w, v in self.rows if w and w.strip()}):
            of.setdefault(word, []).append((name, value))
        for word, meant in of.items():
            self.trie.add_word(word, (word, meant))
        if of:
            self.trie.make_automaton()

    def spans(self, text: str) -> list[tuple[int, str, list[tuple[str, str]]]]:
        """(place, word, meanings) in order of place."""
        if not len(self.trie):
            return []
        whole = lambda i, j: not (i > 0 and _letter(text[i - 1]) and _letter(text[i])) and not (j < len(text) and _letter(text[j]) and _letter(text[j - 1]))
        hits = [(end + 1 - len(word), word, meant) for end, (word, meant) in self.trie.iter(text)]
        taken, found = bytearray(len(text)), []
        for i, word, meant in sorted((h for h in hits if whole(h[0], h[0] + len(h[1]))), key=lambda h: (-len(h[1]), h[0])):
            if not any(taken[i : i + len(word)]):
                taken[i : i + len(word)] = b"\1" * len(word)
                found.append((i, word, meant))
        return sorted(found)

    def read(self, sentence: str | None) -> list[tuple[int, str, str, str, bool]]:
        """(place, field, word, value, negated). A negation reaches to the end of its clause, over a list of words: in
        'without liver or lung, in mice' liver and lung are excluded."""
        text = (sentence or "").lower()
        found = self.spans(text)
        inside = bytearray(len(text) + 1)
        for i, word, _ in found:
            inside[i : i + len(word)] = b"\1" * len(word)
        ends = [m.start() for m in CLAUSE.finditer(text) if not inside[m.start()]] + [len(text)]
        reach = [(m.end(), next(e for e in ends if e >= m.end())) for m in NEGATION.finditer(text) if not inside[m.start()]]
        return [(i, name, word, value, any(a <= i < b for a, b in reach)) for i, word, meant in found for name, value in meant]


def _read(matcher: Matcher, batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    """The words of (key, sentence) batches. They are many times as large as the sentences, so few sentences' are held."""
    kinds = (pa.int32(), pa.string(), pa.string(), pa.string(), pa.bool_())
    for batch in (b.slice(i, HELD) for b in batches for i in range(0, b.num_rows, HELD)):
        ids, out = batch.column(0), []
        for i, sentence in enumerate(batch.column(1).to_pylist()):
            out += [(i, *hit) for hit in matcher.read(sentence)]
        columns = list(zip(*out, strict=True)) or [()] * 6
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(columns[0], pa.int64())), *(pa.array(c, k) for c, k in zip(columns[1:], kinds, strict=True))], names=[key, "at", "field", "word", "value", "negated"])


def matched(sentences: DataFrame, key: str, text: str, vocabulary: DataFrame) -> DataFrame:
    """(key, at, field, word, value, negated) for every word of the vocabulary (field, word, value) in the sentences, a row for
    each meaning. The vocabulary is counted, gathered once and sent to the tasks, which read the sentences in Arrow
    batches. Null sentences and an empty vocabulary give no rows."""
    rows = vocabulary.select("field", "word", "value").dropna().distinct().limit(MOST_WORDS + 1).collect()
    if len(rows) > MOST_WORDS:
        raise ValueError(f"more than {MOST_WORDS} words: such a vocabulary is to be joined, not sent to all tasks")
    held = sentences.sparkSession.sparkContext.broadcast([tuple(r) for r in rows])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _read(Matcher(held.value), batches, key)

    kind = sentences.schema[key].dataType.simpleString()
    return sentences.select(key, text).mapInArrow(run, FOUND.format(id=kind).replace("id", key, 1))


def intents(sentences: DataFrame, key: str, text: str, vocabulary: DataFrame, lists: list[str], single: dict[str, str | None], flags: list[str]) -> DataFrame:
    """One row per sentence: for each field of `lists` its wanted values, each once, in the order of the text; for each of
    `single` its first wanted value, else the one given; for each of `flags` whether any of its words is there; and
    `excluded`, the negated words. Sentences that name nothing have empty lists."""
    hits = matched(sentences, key, text, vocabulary)
    ordered = lambda c, p: F.array_sort(F.collect_list(F.when(p, F.struct("at", F.col(c).alias("v")))))
    own = lambda f: (F.col("field") == f) & ~F.col("negated")
    x = hits.groupBy(key).agg(*[ordered("value", own(f)).alias(f) for f in (*lists, *single)], *[F.count_if(own(f)).alias(f) for f in flags], ordered("word", F.col("negated")).alias("excluded"))
    x = sentences.select(key).join(x, key, "left")
    values = lambda c: F.array_distinct(F.transform(F.coalesce(c, F.array().cast("array<struct<at:int,v:string>>")), lambda s: s["v"]))
    return x.select(key, *[values(f).alias(f) for f in lists], *[F.coalesce(F.get(values(f), F.lit(0)), F.lit(other)).alias(f) for f, other in single.items()], *[(F.coalesce(f, F.lit(0)) > 0).alias(f) for f in flags], values("excluded").alias("excluded"))
