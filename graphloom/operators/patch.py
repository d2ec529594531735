"""JSON Patch on one document."""

from __future__ import annotations

import copy
from typing import Any

from ..errors import InvalidPatch, SchemaMismatch
from .validate import same, valid

#: Fields that patches leave as they are, silently.
READ_ONLY = ("/id", "/links", "/linked_at", "/created_at", "/updated_at")


def _steps(path: str) -> list[str]:
    if path == "":
        return []
    if not path.startswith("/"):
        raise InvalidPatch(f"not a path: {path!r}")
    return [p.replace("~1", "/").replace("~0", "~") for p in path[1:].split("/")]


def _index(step: str, size: int, end: bool) -> int:
    if end and step == "-":
        return size
    if not step.isdigit() or int(step) > size - (not end):
        raise InvalidPatch(f"no element {step}")
    return int(step)


def _find(doc: Any, steps: list[str]) -> Any:
    for s in steps:
        if isinstance(doc, list):
            doc = doc[_index(s, len(doc), False)]
        elif isinstance(doc, dict) and s in doc:
            doc = doc[s]
        else:
            raise InvalidPatch(f"nothing at {s}")
    return doc


def _put(doc: Any, steps: list[str], value: Any, replace: bool) -> Any:
    if not steps:
        return value
    at, last = _find(doc, steps[:-1]), steps[-1]
    if isinstance(at, list):
        i = _index(last, len(at), not replace)
        at[i : i + replace] = [value]
    elif isinstance(at, dict):
        if replace and last not in at:
            raise InvalidPatch(f"nothing at {last}")
        at[last] = value
    else:
        raise InvalidPatch(f"no place for {last}")
    return doc


def _take(doc: Any, steps: list[str]) -> Any:
    value = _find(doc, steps)
    at = _find(doc, steps[:-1])
    if isinstance(at, list):
        del at[int(steps[-1])]
    else:
        del at[steps[-1]]
    return value


def apply(doc: dict, operations: list[dict]) -> dict:
    """doc after all operations, or InvalidPatch and no change at all."""
    out = copy.deepcopy(doc)
    for o in operations:
        op, path = o.get("op"), o.get("path")
        if op not in ("add", "remove", "replace", "move", "copy", "test") or not isinstance(path, str):
            raise InvalidPatch(f"not an operation: {o!r}")
        if any(path == p or path.startswith(p + "/") for p in READ_ONLY):
            continue
        steps = _steps(path)
        if op in ("add", "replace"):
            out = _put(out, steps, copy.deepcopy(o.get("value")), op == "replace")
        elif op == "remove":
            _take(out, steps)
        elif op == "test":
            if not same(_find(out, steps), o.get("value")):
                raise InvalidPatch(f"test failed at {path}")
        else:
            source = _steps(o.get("from", ""))
            value = _take(out, source) if op == "move" else copy.deepcopy(_find(out, source))
            out = _put(out, steps, value, False)
    return out


def patched(full: dict, visible: dict, operations: list[dict], type_schema: Any, auth_schema: Any = True) -> tuple[dict, dict, bool]:
    """(full document, what the actor sees, whether anything changed) after a patch.

    The visible document must still be allowed, the full one must fit its type.
    """
    seen = apply(visible, operations)
    if not valid(auth_schema, seen):
        raise SchemaMismatch("the patched document is not allowed")
    new = apply(full, operations)
    if not valid(type_schema, new):
        raise SchemaMismatch("the patched document does not fit its type")
    return new, seen, not same(new, full)
