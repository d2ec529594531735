"""Row and field security as schemas: roles, markers and scope, pushed into every link."""

from __future__ import annotations

import ast
import copy
import operator
import re
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import InvalidSchema

NOTHING = {"not": {}}
ADMIN = "user-admin"


def role_schema(reads: list[dict]) -> dict:
    """What any of an actor's roles may read; no role may read nothing."""
    return copy.deepcopy(reads[0]) if len(reads) == 1 else {"anyOf": copy.deepcopy(reads)} if reads else NOTHING


def marker_schema(actor_slug: str, org_slugs: list[str]) -> dict | bool:
    """Every marker must be one of the actor's, or hold one among its parts joined by `+`; the admin sees all."""
    if actor_slug == ADMIN:
        return True
    own = [actor_slug, *org_slugs]
    escaped = "|".join("".join(f"\\{c}" if c in r".^$*+?()[]{}|\\" else c for c in s) for s in own)
    return {"type": "object", "properties": {"markers": {"type": "array", "items": {"type": "string", "anyOf": [{"enum": own}, {"pattern": rf"(^|\+)({escaped})(\+|$)"}]}}}}


def markers_visible(markers: Column, own: list[str]) -> Column:
    """The same rule on a typed column."""
    return F.forall(markers, lambda m: F.arrays_overlap(F.split(m, r"\+"), F.array(*map(F.lit, own))))


_OPERATORS = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.Eq: operator.eq, ast.NotEq: operator.ne, ast.Lt: operator.lt, ast.LtE: operator.le, ast.Gt: operator.gt, ast.GtE: operator.ge, ast.In: lambda x, y: x in y}
_WORDS = {"&&": " and ", "||": " or ", "!": " not ", "true": "True", "false": "False", "null": "None"}


def value_of(expression: str, context: dict) -> Any:
    """Of an expression over a context: names, dots, [n], [a:b], literals, lists, + - * /, comparisons, in, &&, || and !."""

    def walk(n: ast.AST) -> Any:
        match n:
            case ast.Constant():
                return n.value
            case ast.Name():
                return context[n.id]
            case ast.Attribute():
                return walk(n.value)[n.attr]
            case ast.Subscript(slice=ast.Slice()):
                return walk(n.value)[slice(*(None if x is None else walk(x) for x in (n.slice.lower, n.slice.upper)))]
            case ast.Subscript():
                return walk(n.value)[walk(n.slice)]
            case ast.List():
                return [walk(x) for x in n.elts]
            case ast.UnaryOp(op=ast.Not()):
                return not walk(n.operand)
            case ast.UnaryOp(op=ast.USub()):
                return -walk(n.operand)
            case ast.BinOp() if type(n.op) in _OPERATORS:
                return _OPERATORS[type(n.op)](walk(n.left), walk(n.right))
            case ast.Compare(ops=[op], comparators=[right]) if type(op) in _OPERATORS:
                return _OPERATORS[type(op)](walk(n.left), walk(right))
            case ast.BoolOp():
                held = (bool(walk(x)) for x in n.values)
                return all(held) if isinstance(n.op, ast.And) else any(held)
        raise InvalidSchema(f"$eval does not take {ast.dump(n)}")

    # Outside of quotes, words that Python spells otherwise.
    parts = re.split(r"""('[^']*'|"[^"]*")""", expression)
    parts[::2] = [re.sub(r"&&|\|\||!(?!=)|\b(?:true|false|null)\b", lambda m: _WORDS[m[0]], p) for p in parts[::2]]
    try:
        tree = ast.parse("".join(parts).strip(), mode="eval").body
    except SyntaxError as error:
        raise InvalidSchema(f"$eval: {expression!r}") from error
    return walk(tree)


def evaluate(schema: Any, context: dict) -> Any:
    """schema with {$eval: expression} replaced by its value, without $id."""
    if isinstance(schema, list):
        return [evaluate(x, context) for x in schema]
    if not isinstance(schema, dict):
        return schema
    if "$eval" in schema:
        return value_of(schema["$eval"], context)
    return {k: evaluate(v, context) for k, v in schema.items() if k != "$id"}


def authorize(schema: Any, permission: Any) -> dict:
    """schema under a permission, which also holds for every linked document, however deep the link stands."""

    def links(s: Any) -> Any:
        if isinstance(s, list):
            return [links(x) for x in s]
        if not isinstance(s, dict):
            return s
        out = {}
        for k, v in s.items():
            if k == "$$links":
                out[k] = {verb: {"allOf": [permission, links(sub)]} for verb, sub in v.items()}
            elif k in ("const", "enum", "examples"):
                out[k] = v
            elif k == "properties":
                out[k] = {name: links(sub) for name, sub in v.items()}
            else:
                out[k] = links(v)
        return out

    return {"allOf": [permission, links(schema)]}


def permission(actor: dict, role_reads: list[dict], org_slugs: list[str], scope: dict | None = None) -> dict:
    """What an actor may see: roles and markers, and the session's scope if any."""
    parts = [evaluate(role_schema(role_reads), {"user": actor}), marker_schema(actor["slug"], org_slugs), *([scope] if scope else [])]
    parts = [p for p in parts if p is not True]
    return {"allOf": parts}
