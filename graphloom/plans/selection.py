"""Which fields of a document come back: all of them, or - with additionalProperties: false - those a schema names.

A field can depend on a condition: the keys that a branch of anyOf adds come back where that branch holds.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.predicates import Predicate, all_of, any_of, column, sure
from ..functions.values import Typed
from .schema import Schema

Value = Typed


@dataclass
class Fields:
    """Selected fields by name; whole: the condition under which everything below comes back."""

    whole: Predicate = False
    below: dict[str, Fields] = field(default_factory=dict)

    def at(self, name: str) -> Fields:
        return self.below.setdefault(name, Fields())

    def names(self) -> list[str]:
        return list(self.below)


def selection(s: Schema, value, test: Callable[[Schema, object], Predicate], when: Predicate = True) -> Fields:
    """Of a schema at a value; test(schema, value) is the predicate of a branch."""
    out = Fields()
    closed = s.get("additionalProperties") is False
    if not closed:
        out.whole = when
    _named(out, s, value, test, when)
    for sub in s.get("allOf", ()):
        more = selection(sub, value, test, when)
        if more.whole is not True:
            out = more if out.whole is True else meet(out, more)
        elif closed:
            _named(out, sub, value, test, when)
    return out


def _named(out: Fields, s: Schema, value, test, when: Predicate) -> None:
    for name in s.get("required", ()):
        if name not in s.get("properties", {}):
            out.at(name).whole = any_of(out.at(name).whole, when)
    for name, sub in s.get("properties", {}).items():
        if sub.always is not False:
            join(out.at(name), selection(sub, value.field(name), test, when))
    for sub in s.get("anyOf", ()):
        holds = sure(test(sub, value))
        more = Fields()
        _named(more, sub, value, test, all_of(when, holds))
        join(out, more)


def join(a: Fields, b: Fields) -> None:
    a.whole = any_of(a.whole, b.whole)
    for name, f in b.below.items():
        join(a.at(name), f)


def meet(a: Fields, b: Fields) -> Fields:
    """What both select."""
    out = Fields(all_of(a.whole, b.whole))
    for name in {*a.below, *b.below}:
        x, y = a.below.get(name), b.below.get(name)
        x = x if x is not None else Fields(a.whole)
        y = y if y is not None else Fields(b.whole)
        both = meet(x, y)
        if both.whole is not False or both.below:
            out.below[name] = both
    return out


def render(f: Fields, value) -> Column | None:
    """The selected part of a value, or None if nothing of it is selected."""
    if f.whole is True:
        return value.column
    if isinstance(value, Typed) and isinstance(value.kind, T.StructType):
        parts = []
        for name in value.kind.names:
            sub = f.below.get(name, Fields())
            inner = render(Fields(any_of(f.whole, sub.whole), sub.below), value.field(name))
            if inner is not None:
                parts.append(inner.alias(name))
        return F.struct(*parts) if parts else None
    if f.below and not isinstance(value, Typed):
        parts = [(name, render(Fields(any_of(f.whole, sub.whole), sub.below), value.field(name))) for name, sub in f.below.items()]
        parts = [c.alias(n) for n, c in parts if c is not None]
        # Keys that are missing stay missing.
        narrow = F.parse_json(F.to_json(F.struct(*parts)))
        return narrow if f.whole is False else F.when(column(f.whole), value.column).otherwise(narrow)
    if f.whole is False:
        return None
    return F.when(column(f.whole), value.column)
