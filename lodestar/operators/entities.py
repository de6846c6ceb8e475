"""Conditions from resolved entities and from words, by tiers: level and category columns, standard values, raw text."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestar.operators.predicates import all_of, any_of
from lodestar.operators.routing import contains_any

#: Values of an entity that are looked for.
MOST_VALUES = 8


@dataclass(frozen=True)
class Tiers:
    """A field's columns, and what words stand for in them. `upper` is the column of categories or of the level above the
    standard values. own: words of one specific value, looked for as text wherever it is, and never widened; upper_of:
    words of a whole category or level; standard_of: words of standard values; above: the category that a standard
    value is widened by; deep: words whose raw values often name a part alone, so that raw text is searched too."""

    raw: str
    standard: str
    upper: str
    own: Mapping[str, str] = field(default_factory=dict)
    upper_of: Mapping[str, str] = field(default_factory=dict)
    standard_of: Mapping[str, str | list[str]] = field(default_factory=dict)
    above: Mapping[str, str] = field(default_factory=dict)
    deep: frozenset[str] = frozenset()


@dataclass(frozen=True)
class Entity:
    """What a sentence names: its kind, its words, the name they were resolved to, and values of the data, frequent first."""

    kind: str
    text: str
    values: list[str]
    name: str = ""
    negated: bool = False


def _known(of: Mapping, keys: list[str]):
    return next((of[k] for k in keys if k in of), None)


def _less(values: str | list[str], excluded: set[str]) -> list[str]:
    return [v for v in dict.fromkeys([values] if isinstance(values, str) else values) if v.lower().strip() not in excluded]


def tiered(e: Entity, t: Tiers, excluded: Iterable[str] = ()) -> Column:
    """A specific word matches as text, in standard and raw values; else a word of a category or level matches that column
    alone; else standard values match, widened by the category above them, without the excluded ones; else the raw column
    is searched for the entity's values and words. Of an umbrella whose values are all excluded all stay; where the only
    value is, the raw column is searched."""
    keys, out = [e.text.lower().strip(), (e.name or e.text).lower().strip()], {x.lower().strip() for x in excluded}
    searched = contains_any(t.raw, list(dict.fromkeys([*e.values[:MOST_VALUES], e.text])))
    if own := _known(t.own, keys):
        return contains_any(t.standard, [own]) | contains_any(t.raw, [own])
    if upper := _known(t.upper_of, keys):
        return searched if upper.lower().strip() in out else F.col(t.upper) == upper
    meant = _known(t.standard_of, keys)
    if meant is None:
        return searched
    left = _less(meant, out)
    if not left and isinstance(meant, str):
        return searched
    parts = [F.col(t.standard).isin(left or list(dict.fromkeys(meant)))]
    parts += [F.col(t.upper) == t.above[meant]] if isinstance(meant, str) and meant in t.above else []
    parts += [contains_any(t.raw, [keys[0]])] if t.deep & set(keys) else []
    return any_of(parts)


def cell_type(e: Entity, raw: str, patterns: Mapping[str, list[str]], also: Mapping[str, str]) -> Column:
    """One of the entity's values, or one of the patterns of its name or words (the words themselves without such); some
    are looked for in a second column too."""
    parts = [F.col(raw).isin(e.values[:MOST_VALUES])]
    own = _known(patterns, [e.name or e.text, e.text])
    parts += [F.col(raw).ilike(p) for p in own] if own else [contains_any(raw, [e.text])]
    other = _known(also, [(e.name or e.text).lower(), e.text.lower().strip()])
    return any_of(parts + ([contains_any(other, [e.text])] if other else []))


def entities_condition(entities: list[Entity], tiers: Mapping[str, Tiers], cells: tuple[str, Mapping, Mapping] | None = None, excluded: Mapping[str, list[str]] | None = None) -> Column:
    """Entities of one kind are alternatives, kinds must all be met; negated ones, those without values and those of other
    kinds are left to the plain filters."""
    by_kind: dict[str, list[Column]] = {}
    for e in entities:
        if e.negated or not e.values:
            continue
        if e.kind in tiers:
            by_kind.setdefault(e.kind, []).append(tiered(e, tiers[e.kind], (excluded or {}).get(e.kind, ())))
        elif e.kind == "cell_type" and cells:
            by_kind.setdefault(e.kind, []).append(cell_type(e, *cells))
    return all_of([F.coalesce(any_of(cs), F.lit(False)) for cs in by_kind.values()])


def words_condition(words: list[str], t: Tiers, excluded: Iterable[str] = (), strict: bool = False) -> Column:
    """A filter by words of a field. Words of a level match the level column; the others match standard values, beside raw
    text for deep words and for those that the vocabulary does not know; both must be met where both are given. Excluded
    values take no part. strict: no levels."""
    out = {x.lower().strip() for x in excluded}
    level = {} if strict else {w: t.upper_of[w.lower().strip()] for w in words if w.lower().strip() in t.upper_of}
    rest = [w for w in words if w not in level]
    parts = []
    if upper := _less(list(level.values()), out):
        parts.append(F.col(t.upper).isin(upper))
    if rest:
        meant, raw = [], []
        for w in rest:
            m = t.standard_of.get(w.lower().strip())
            meant += [] if m is None else [m] if isinstance(m, str) else m
            raw += [w] if m is None or w.lower().strip() in t.deep else []
        own = ([F.col(t.standard).isin(_less(meant, out))] if _less(meant, out) else []) + ([contains_any(t.raw, raw)] if raw else [])
        parts += [any_of(own)] if own else []
    return all_of(parts)
