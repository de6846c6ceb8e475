"""Scores of results, as Columns."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestar.operators.fusion import filled
from lodestar.operators.routing import contains_any


def hits(text: Column, words: list[str]) -> Column:
    """How many of the words are in the text."""
    return reduce(add, [F.coalesce(F.contains(text, F.lit(w)), F.lit(False)).cast("int") for w in words], F.lit(0))


def quality(fields: list[str], sources: str, availability: list[tuple[str, int]], citations: str) -> Column:
    """0 to 100: 40 for the share of filled fields, 25 for three sources or more, up to 20 for the first kind of access
    that there is, 15 for a hundred citations or more. Rounded half to even, to tenths."""
    one = F.lit(1.0)
    access = F.coalesce(*[F.when(F.col(c), points) for c, points in availability], F.lit(0))
    known = F.coalesce(F.col(citations), F.lit(0))
    return F.bround(40.0 * filled(*fields) / len(fields) + F.least(F.col(sources) / 3, one) * 25 + access + F.least(known / 100, one) * 15, 1)


@dataclass
class Intent:
    """What is asked for: synonyms of each field, species, a span of years, words; stop words count for nothing."""

    fields: dict[str, list[str]]
    species: list[str] = field(default_factory=list)
    years: tuple[int, int] | None = None
    words: list[str] = field(default_factory=list)
    stop: list[str] = field(default_factory=list)


def intent_score(intent: Intent, title: str, description: str, organism: str, year: str, mirrors: str) -> Column:
    """2.0 for each field that title or description has; 1.0 if the title has two; 0.6 for the species, -0.6 for another;
    0.5 in the years; 0.3 times the Jaccard similarity of words; 0.2 times the root of the number of mirrors."""
    head = F.lower(F.coalesce(F.col(title), F.lit("")))
    whole = F.concat(head, F.lit(" "), F.lower(F.coalesce(F.col(description), F.lit(""))))
    has = lambda text: reduce(add, [(hits(text, [w.lower() for w in ws]) > 0).cast("int") for ws in intent.fields.values()], F.lit(0))
    have, species, nothing = F.lower(F.col(organism)), F.lit(0.0), F.array().cast("array<string>")
    if intent.species:
        same = reduce(lambda a, b: a | b, [F.contains(have, F.lit(s.lower())) | F.contains(F.lit(s.lower()), have) for s in intent.species])
        species = F.when(F.coalesce(have, F.lit("")) == "", 0.0).when(same, 0.6).otherwise(-0.6)
    recent = F.when(F.col(year).between(*intent.years), 0.5).otherwise(0.0) if intent.years else F.lit(0.0)
    stop = F.array(*map(F.lit, intent.stop)) if intent.stop else nothing
    own = F.array_except(F.regexp_extract_all(head, F.lit("[a-z0-9-]+"), 0), stop)
    asked = F.array_except(F.array(*map(F.lit, intent.words)), stop) if intent.words else nothing
    overlap = F.when((F.size(own) > 0) & (F.size(asked) > 0), F.size(F.array_intersect(own, asked)) / F.size(F.array_union(own, asked))).otherwise(0.0)
    return 2.0 * has(whole) + F.when(has(head) >= 2, 1.0).otherwise(0.0) + species + recent + 0.3 * overlap + 0.2 * F.sqrt(F.coalesce(F.col(mirrors), F.lit(0)).cast("double"))


def grade(column: str, whole: list[str], part: list[str]) -> Column:
    """match for one of the whole values, partial for a text with one of the parts in it, else miss."""
    c = F.lower(F.col(column))
    return F.when(c.isin([w.lower() for w in whole]), "match").when(F.coalesce(contains_any(column, part), F.lit(False)), "partial").otherwise("miss")


def _tokens(text: Column) -> Column:
    """Distinct words of Latin letters, digits and dashes, of two signs or more, in lower case."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[a-zA-Z0-9\-]+"), 0), lambda t: F.length(t) > 1))


def lexical(query: str | Column, categories: list[str], title: str, description: str) -> Column:
    """3 for each word of the query in the title, 1 for each in the description, 0.5 for each category term all of whose
    words are in either, and 0.001 for each word of the title up to 20."""
    asked, head, body = _tokens(F.lit(query) if isinstance(query, str) else query), _tokens(F.col(title)), _tokens(F.col(description))
    both = F.array_union(head, body)
    whole = [F.when((F.size(_tokens(F.lit(c))) > 0) & (F.size(F.array_except(_tokens(F.lit(c)), both)) == 0), 0.5).otherwise(0.0) for c in categories]
    return 3.0 * F.size(F.array_intersect(asked, head)) + 1.0 * F.size(F.array_intersect(asked, body)) + reduce(add, whole, F.lit(0.0)) + 0.001 * F.least(F.size(head), F.lit(20))


def says(text: Column, phrases: list[str], generic: list[str]) -> Column:
    """Whether a text has one of the phrases in it, or one of their telling words as a word: one of three letters or more
    that is not among the generic ones."""
    import re

    low = F.lower(F.coalesce(text, F.lit("")))
    kept = [p.lower().strip() for p in phrases if p and p.strip()]
    telling = sorted({w for p in kept for w in re.findall(r"[a-z0-9\-]+", p) if len(w) > 2 and w not in generic})
    words = F.regexp_extract_all(low, F.lit(r"[a-zA-Z0-9\-]+"), 0)
    inside = reduce(lambda a, b: a | b, [F.contains(low, F.lit(p)) for p in kept], F.lit(False))
    return inside | F.arrays_overlap(words, F.array(*map(F.lit, telling))) if telling else inside
