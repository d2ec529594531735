"""Views: stored schemas, single or as lists of named parts."""

from __future__ import annotations


def view_schema(contract: dict) -> dict | None:
    """The schema of a view contract: its own, or all of its allOf parts and any of its anyOf parts; None without parts."""
    data = contract.get("data") or {}
    if data.get("schema") is not None:
        return data["schema"]
    every = [p["schema"] for p in data.get("allOf") or []]
    some = [p["schema"] for p in data.get("anyOf") or []]
    if some:
        every.append({"anyOf": some})
    if not every:
        return None
    return every[0] if len(every) == 1 else {"allOf": every}


def resolve(schema: dict) -> dict:
    """A view contract's schema, or the schema itself."""
    if isinstance(schema, dict) and str(schema.get("type", "")).split("@")[0] == "view" and "data" in schema:
        found = view_schema(schema)
        return {} if found is None else found
    return schema
