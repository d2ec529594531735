"""Query schemas as immutable trees, checked while they are read."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Any

from ..errors import InvalidSchema
from ..functions.formats import FORMATS, java_pattern

TYPES = ("array", "boolean", "integer", "null", "number", "object", "string")
IGNORED = ("title", "description", "examples", "$id")


@dataclass(frozen=True)
class Schema:
    """A schema: always true or false, or the parsed argument of each keyword."""

    always: bool | None = None
    words: dict[str, Any] = field(default_factory=dict)
    path: str = ""

    def get(self, word: str, default=None):
        return self.words.get(word, default)

    @property
    def types(self) -> frozenset[str] | None:
        return self.words.get("type")

    def children(self):
        """(keyword, subschema) pairs, links apart."""
        for word, x in self.words.items():
            if isinstance(x, Schema):
                yield word, x
            elif word == "properties":
                yield from ((word, s) for s in x.values())
            elif word in ("allOf", "anyOf", "oneOf") or word == "items" and isinstance(x, tuple):
                yield from ((word, s) for s in x)

    def __hash__(self) -> int:
        return id(self)


def fail(path: str, what: str):
    raise InvalidSchema(f"{path or '/'}: {what}")


def _number(x, path):
    if isinstance(x, bool) or not isinstance(x, int | float):
        fail(path, "a number is expected")
    return x


def _count(x, path):
    if isinstance(x, bool) or not isinstance(x, int | float) or x < 0 or x != int(x):
        fail(path, "a whole number of at least 0 is expected")
    return int(x)


def _types(x, path):
    names = [x] if isinstance(x, str) else x
    if not isinstance(names, list) or not names or any(n not in TYPES for n in names):
        fail(path, "a type or a list of types is expected")
    return frozenset(names)


def _strings(x, path):
    if not isinstance(x, list) or not all(isinstance(s, str) for s in x):
        fail(path, "a list of strings is expected")
    return tuple(x)


def _list(x, path):
    if not isinstance(x, list) or not x:
        fail(path, "a list of schemas is expected")
    return tuple(parse(s, f"{path}/{i}") for i, s in enumerate(x))


def _map(x, path):
    if not isinstance(x, dict):
        fail(path, "an object of schemas is expected")
    return {k: parse(s, f"{path}/{k}") for k, s in x.items()}


def _items(x, path):
    return _list(x, path) if isinstance(x, list) and x else () if x == [] else parse(x, path)


def _pattern(x, path):
    if not isinstance(x, str):
        fail(path, "a string is expected")
    return java_pattern(x)


def _regexp(x, path):
    if isinstance(x, str):
        return java_pattern(x)
    if not isinstance(x, dict) or not isinstance(x.get("pattern"), str) or x.get("flags", "") not in ("", "i"):
        fail(path, "a string, or a pattern with the flag i, is expected")
    return java_pattern(x["pattern"], x.get("flags") == "i")


def _format(x, path):
    if x not in FORMATS:
        fail(path, f"unknown format {x!r}")
    return x


def _bool(x, path):
    if not isinstance(x, bool):
        fail(path, "true or false is expected")
    return x


def _enum(x, path):
    if not isinstance(x, list) or not x:
        fail(path, "a list of values is expected")
    return tuple(x)


def _search(x, path):
    if x is True:
        return None
    if not isinstance(x, dict) or not isinstance(x.get("term"), str):
        fail(path, "an object with a term is expected")
    return x["term"]


def _text(x, path):
    if not isinstance(x, str):
        fail(path, "a string is expected")
    return x


READ = {
    "type": _types, "const": lambda x, p: x, "enum": _enum, "not": lambda x, p: parse(x, p), "if": lambda x, p: parse(x, p), "then": lambda x, p: parse(x, p), "else": lambda x, p: parse(x, p),
    "minimum": _number, "maximum": _number, "exclusiveMinimum": _number, "exclusiveMaximum": _number, "multipleOf": _number,
    "minLength": _count, "maxLength": _count, "minItems": _count, "maxItems": _count, "minProperties": _count, "maxProperties": _count,
    "pattern": _pattern, "regexp": _regexp, "format": _format, "formatMinimum": _text, "formatMaximum": _text,
    "properties": _map, "required": _strings, "additionalProperties": _bool, "items": _items, "contains": lambda x, p: parse(x, p),
    "allOf": _list, "anyOf": _list, "oneOf": _list, "$$links": _map, "fullTextSearch": _search,
}


def parse(schema: Any, path: str = "") -> Schema:
    """A schema from JSON values, or InvalidSchema with the place of what is wrong."""
    if isinstance(schema, Schema):
        return schema
    if isinstance(schema, bool):
        return Schema(schema, path=path)
    if not isinstance(schema, dict):
        fail(path, "a schema is an object, true or false")
    words = {}
    for word, x in schema.items():
        if word in IGNORED:
            continue
        if word not in READ:
            fail(path, f"invalid key {word!r}")
        words[word] = READ[word](x, f"{path}/{word}")
    if ("formatMinimum" in words or "formatMaximum" in words) and words.get("format") not in ("date-time", "date", "time"):
        fail(path, "formatMinimum and formatMaximum need the format date-time, date or time")
    if isinstance(words.get("multipleOf"), int | float) and words["multipleOf"] <= 0:
        fail(path, "multipleOf must be above 0")
    return Schema(None, words, path)


def canonical(value: Any) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def links_of(schema: Schema, inside: bool = False):
    """(verb, subschema) of every link of this document, wherever it stands; links of linked documents apart."""
    for verb, s in schema.get("$$links", {}).items():
        yield verb, s
    for _, s in schema.children():
        yield from links_of(s)


def without_mandatory_links(schema: Schema) -> tuple[Schema, list[tuple[str, Schema]]]:
    """schema apart from the links that every result must have, and those links."""
    found = list(schema.get("$$links", {}).items())
    words = {k: v for k, v in schema.words.items() if k != "$$links"}
    if "allOf" in words:
        parts = [without_mandatory_links(s) for s in words["allOf"]]
        words["allOf"] = tuple(s for s, _ in parts)
        found += [x for _, more in parts for x in more]
    return (Schema(schema.always, words, schema.path), found) if found else (schema, [])


def contract_types(schema: Schema) -> set[str] | None:
    """Types that a document of the result can have, from const and enum on `type`; None if any."""
    found: set[str] | None = None

    def meet(x: set[str] | None) -> None:
        nonlocal found
        if x is not None:
            found = x if found is None else found & x

    t = schema.get("properties", {}).get("type")
    if t is not None:
        if "const" in t.words:
            meet({t.words["const"]})
        if "enum" in t.words:
            meet(set(t.words["enum"]))
    for s in schema.get("allOf", ()):
        meet(contract_types(s))
    branches = [contract_types(s) for s in schema.get("anyOf", ())]
    if branches and None not in branches:
        meet(set().union(*branches))
    return found
