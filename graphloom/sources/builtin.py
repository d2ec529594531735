"""Documents that every store begins with: the types the engine itself reads."""

from __future__ import annotations

_TEXT, _TEXTS = {"type": "string"}, {"type": "array", "items": {"type": "string"}}
_SCHEMAS = {"type": "array", "items": {"type": "object", "required": ["name", "schema"], "properties": {"name": _TEXT, "schema": {"type": "object"}}}}
_END = {"type": "object", "required": ["id", "type"], "properties": {"id": _TEXT, "type": _TEXT}}

#: Slug of each built-in type, its required data fields and the schemas of its data fields.
_DATA = {
    "card": ((), {}),
    "type": (("schema",), {"schema": {"type": "object"}, "indexed_fields": {"type": "array", "items": _TEXTS}}),
    "loop": ((), {}),
    "link": (("inverseName", "from", "to"), {"inverseName": _TEXT, "from": _END, "to": _END}),
    "relationship": (("inverseName", "from", "to"), {"inverseName": _TEXT, "from": {"type": "object", "required": ["type"]}, "to": {"type": "object", "required": ["type"]}}),
    "view": ((), {"schema": {"type": "object"}, "allOf": _SCHEMAS, "anyOf": _SCHEMAS}),
    "role": (("read",), {"read": {"type": "object"}}),
    "user": ((), {"hash": _TEXT, "roles": _TEXTS, "email": {"type": ["string", "array"]}}),
    "user-settings": ((), {}),
    "authentication-password": ((), {"hash": _TEXT, "actorId": _TEXT}),
    "authentication-oauth": ((), {}),
    "org": ((), {}),
    "session": (("actor",), {"actor": _TEXT, "expiration": {"type": "string", "format": "date-time"}, "scope": {"type": "object"}}),
    "event": (("timestamp", "target", "actor", "payload"), {"timestamp": {"type": "string", "format": "date-time"}, "target": _TEXT, "actor": _TEXT}),
}


def types() -> list[dict]:
    """Type documents for TypeRegistry."""
    out = []
    for slug, (required, fields) in _DATA.items():
        data = {"type": "object", "required": list(required), "properties": fields}
        out.append({"type": "type@1.0.0", "slug": slug, "version": "1.0.0", "data": {"schema": {"type": "object", "required": ["data"], "properties": {"data": data}}}})
    return out


def relationships() -> list[dict]:
    rules = (("has member", "is member of", "org", "user"), ("has settings", "are settings for", "user", "user-settings"), ("is authenticated with", "authenticates", "user", "authentication-password"), ("is attached to", "has attached element", "*", "*"))
    return [{"type": "relationship@1.0.0", "name": n, "slug": f"relationship-{a}-{n.replace(' ', '-')}-{b}".replace("*", "any"), "data": {"inverseName": i, "from": {"type": a}, "to": {"type": b}}} for n, i, a, b in rules]
