"""Records of archives that were staged as files of JSON lines, read through a tree of conditions that the scan takes over."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What every staged record has; archives' own fields stay in `more`.
RECORD = "id string, title string, summary string, organism string, kind string, collection string, year int, more map<string, string>"


class Term:
    """A condition of a search: a Column over staged records, and the text that an archive takes. Conditions are joined by &
    and |, and turned by ~."""

    def column(self) -> Column:
        raise NotImplementedError

    def text(self) -> str:
        raise NotImplementedError

    def __and__(self, other: Term) -> Term:
        return Joined("AND", (self, other))

    def __or__(self, other: Term) -> Term:
        return Joined("OR", (self, other))

    def __invert__(self) -> Term:
        return Turned(self)


@dataclass(frozen=True)
class Said(Term):
    """Words anywhere in the title or the summary, whatever their case."""

    words: str

    def column(self) -> Column:
        return reduce(or_, [F.coalesce(F.contains(F.lower(c), F.lit(self.words.lower())), F.lit(False)) for c in ("title", "summary")])

    def text(self) -> str:
        return '"{}"'.format(self.words.replace('"', " ").strip())


@dataclass(frozen=True)
class Is(Term):
    """A field with exactly this value."""

    field: str
    value: str

    def column(self) -> Column:
        return F.col(self.field) == self.value

    def text(self) -> str:
        return f'"{self.value}"[{self.field.capitalize()}]'


@dataclass(frozen=True)
class Years(Term):
    """Years from first to last, both included; either may be open."""

    first: int | None = None
    last: int | None = None

    def column(self) -> Column:
        parts = ([F.col("year") >= self.first] if self.first is not None else []) + ([F.col("year") <= self.last] if self.last is not None else [])
        return reduce(and_, parts, F.lit(True))

    def text(self) -> str:
        return f"{self.first or 1900}:{self.last or 3000}[Year]"


@dataclass(frozen=True)
class Joined(Term):
    word: str
    parts: tuple[Term, ...]

    def column(self) -> Column:
        return reduce(and_ if self.word == "AND" else or_, [p.column() for p in self.parts])

    def text(self) -> str:
        return "({})".format(f" {self.word} ".join(p.text() for p in self.parts))


@dataclass(frozen=True)
class Turned(Term):
    """Records for which the condition does not hold, those without the field too."""

    part: Term

    def column(self) -> Column:
        return ~F.coalesce(self.part.column(), F.lit(False))

    def text(self) -> str:
        return f"NOT {self.part.text()}"


def every(terms: list[Term]) -> Term | None:
    return terms[0] if len(terms) == 1 else Joined("AND", tuple(terms)) if terms else None


def any_of(terms: list[Term]) -> Term | None:
    return terms[0] if len(terms) == 1 else Joined("OR", tuple(terms)) if terms else None


def term_of(asked: Mapping[str, list[str]], sentence: str = "", species: list[str] = (), kind: str | None = None, years: Years | None = None, without: list[str] = (), most_without: int = 3) -> Term | None:
    """A whole question (three words or over 20 characters) is searched as it is; else each field's words are alternatives
    and all fields must be met. The species, the kind of record and the years are added, and up to `most_without` words
    of three letters or more are excluded."""
    sentence = sentence.strip()
    fields = [any_of([Said(w) for w in words]) for words in asked.values() if words]
    whole = len(sentence.split()) > 2 or len(sentence) > 20
    parts = [Said(sentence)] if sentence and (whole or not fields) else fields
    parts += [any_of([Is("organism", s) for s in species])] if species else []
    parts += [Is("kind", kind)] if kind else []
    parts += [years] if years else []
    parts += [~Said(w) for w in without[:most_without] if len(w.strip()) > 2]
    return every(parts)


def scoped_term(asked: Mapping[str, list[str]], keywords: list[str], collections: list[str] = (), each: int = 2, most_keywords: int = 3) -> Term | None:
    """At most `each` words of a field, all of them wanted, beside `most_keywords` keywords where no field has words; only in
    the collections named, if any."""
    words = [w for ws in asked.values() for w in ws[:each]] or keywords[:most_keywords]
    parts = [Said(w) for w in words]
    return every(parts + ([any_of([Is("collection", c) for c in collections])] if collections else []))


def staged(spark: SparkSession, path: str, term: Term | None = None) -> DataFrame:
    """The records of the files under a path that meet the term. Comparisons of fields and years are taken over by the
    scan, which does not make the rows that fail them."""
    x = spark.read.schema(RECORD).json(path)
    return x if term is None else x.filter(term.column())
