"""Count-only unigram tokenization: how many pieces the best segmentation of each text has."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.recent import Recent

#: The mark of a word's start, and the penalty of an unknown character below the least score (fixed values).
MARK, UNKNOWN_PENALTY = "▁", 10.0


def unigram_vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces of a sentencepiece model with scores falling by rank as -ln(rank + 2); control, unknown and byte pieces
    are left out of the matches. (The public file ranks its pieces; it has no log probabilities.)"""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    return [(p, -math.log(i + 2)) for i, p in enumerate(pieces)]


class Counter:
    """Piece counts of words. The automaton gives all vocabulary matches that end at a place, longest first; the
    program keeps for each place the best score, how many pieces it took, and whether the last was unknown. A later
    match replaces an earlier one only if its score is higher; an unknown character is tried after all matches, only
    where no piece is just that character; neighbouring unknown characters are one piece."""

    def __init__(self, vocabulary: list[tuple[str, float]]):
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(s for _, s in vocabulary) - UNKNOWN_PENALTY
        self.words = Recent(self.count_word)

    def count_word(self, word: str) -> int:
        n = len(word)
        ending: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for end, match in self.automaton.iter(word):
            ending[end].append(match)
        best, pieces, last_unknown = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        for end in range(n):
            top, single = None, False
            for length, score in ending[end]:
                start = end + 1 - length
                single = single or length == 1
                if top is None or score + best[start] > top:
                    top, pieces[end + 1], last_unknown[end + 1] = score + best[start], pieces[start] + 1, False
            if not single and (top is None or self.unknown + best[end] > top):
                top, pieces[end + 1], last_unknown[end + 1] = self.unknown + best[end], pieces[end] + self.unknown_pieces(word[end], last_unknown[end]), True
            best[end + 1] = top
        return pieces[n]

    def unknown_pieces(self, char: str, after_unknown: bool) -> int:
        return int(not after_unknown)

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        text = text.replace(MARK, " ")
        words = text.split(" ") if text[0] != " " else text[1:].split(" ")
        return sum(map(self.words.__getitem__, [MARK + w for w in words]))


class TextCounter(Counter):
    """Piece counts of whole marked texts. A text is cut only before marks over which no piece of the vocabulary
    reaches, so runs of spaces meet the pieces of several marks; an unknown character is as many pieces as it has bytes."""

    def __init__(self, vocabulary: list[tuple[str, float]]):
        super().__init__(vocabulary)
        over = sorted({a for piece, _ in vocabulary for a, b in zip(piece, piece[1:], strict=False) if b == MARK})
        self.cut = re.compile(f"(?<=[^{''.join(map(re.escape, over))}])(?={MARK})" if over else f"(?<=.)(?={MARK})", re.DOTALL)

    def unknown_pieces(self, char: str, after_unknown: bool) -> int:
        return len(char.encode("utf-8", "surrogatepass"))

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        return sum(map(self.words.__getitem__, self.cut.split(MARK + text.replace(" ", MARK))))


@lru_cache(maxsize=2)
def _counter(path: str) -> TextCounter:
    return TextCounter(unigram_vocabulary(path))


def token_counts(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, the number of unigram pieces of the whole text.

    vocabulary: path of a sentencepiece model that all executors can read, with the 256 byte pieces. Each space is a mark, and
    one stands before the text; see TextCounter. Null and empty texts have 0 pieces. Long words cost time in proportion to their
    length. Null doc_ids and repeated rows come back as they are. Other columns are not read. Empty table: no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(vocabulary)
        for batch in batches:
            for part in (batch.slice(i, 1000) for i in range(0, batch.num_rows, 1000)):
                n = [counter.count(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64())], names=["doc_id", "n_tokens"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, n_tokens long")
