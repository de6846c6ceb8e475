"""A rule parser of short filter sentences. It runs once per question, on the driver; its result is a Column."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestar.operators.predicates import all_of

_SCALE = {"": 1, "k": 1_000, "m": 1_000_000}
_NOT = re.compile(r"(?:\bnot|\bwithout|\bexcluding|\bexcept|排除|不是|非)\s*$")


@dataclass
class Question:
    """What a sentence asks: values to have and not to have by field, bounds of the measure, first and last year, and
    the field of a 'which X has the most'."""

    wanted: dict[str, list[str]] = field(default_factory=dict)
    unwanted: dict[str, list[str]] = field(default_factory=dict)
    least: float | None = None
    years: tuple[int | None, int | None] = (None, None)
    group_by: str | None = None


def parse(sentence: str, vocabulary: dict[str, dict[str, list[str]]], groups: dict[str, str]) -> Question:
    """vocabulary: field -> keyword -> stored values; groups: word -> field. Longer keywords are taken first, and
    what one keyword took is not read again."""
    text, q = sentence.lower(), Question()
    if m := re.search(r"which (\w+) has the most", text):
        q.group_by = groups.get(m[1])
    if m := re.search(r"(?:at least|more than|over|至少)\s*(\d+(?:\.\d+)?)\s*([km]?)\b", text):
        q.least = float(m[1]) * _SCALE[m[2]]
    lo = hi = None
    if m := re.search(r"\bbefore ((?:19|20)\d{2})", text):
        hi = int(m[1]) - 1
    if m := re.search(r"\b(?:since|from) ((?:19|20)\d{2})|\b((?:19|20)\d{2})\s*(?:\+|以后|onwards)", text):
        lo = int(m[1] or m[2])
    if m := re.search(r"\bin ((?:19|20)\d{2})\b", text):
        lo = hi = int(m[1])
    q.years = (lo, hi)
    for name, word, values in sorted(((n, w, v) for n, ws in vocabulary.items() for w, v in ws.items()), key=lambda x: (-len(x[1]), x[1])):
        for m in reversed(list(re.finditer(rf"(?<![a-z]){re.escape(word)}(?![a-z])", text))):
            side = q.unwanted if _NOT.search(text[: m.start()]) else q.wanted
            side.setdefault(name, []).extend(v for v in values if v not in side.get(name, ()))
            text = text[: m.start()] + " " * len(word) + text[m.end() :]
    return q


def predicate(q: Question, measure: str, date: str) -> Column:
    """Values of a field are joined by OR, fields by AND; unwanted values keep NULLs; bounds drop them."""
    lo, hi = q.years
    parts = [F.col(f).isin(*v) for f, v in q.wanted.items()]
    parts += [F.col(f).isNull() | ~F.col(f).isin(*v) for f, v in q.unwanted.items()]
    parts += [F.col(measure) >= q.least] if q.least is not None else []
    parts += [F.year(date) >= lo] if lo else []
    parts += [F.year(date) <= hi] if hi else []
    return all_of(parts)
