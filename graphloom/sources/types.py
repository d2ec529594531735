"""Types as documents: their schemas, the Spark types they stand for, and which relationships they allow."""

from __future__ import annotations

from typing import Any

from pyspark.sql import types as T

from ..errors import UnknownCardType, UnknownRelationship

#: What every document must have, and the JSON types of the envelope.
ENVELOPE = {
    "type": "object",
    "required": ["id", "slug", "type", "version", "active", "tags", "markers", "requires", "capabilities", "links", "linked_at", "created_at", "data"],
    "properties": {
        "id": {"type": "string"},
        "slug": {"type": "string", "pattern": "^[a-z0-9-]+$"},
        "type": {"type": "string", "pattern": "^[a-z0-9-]+@[0-9]+(\\.[0-9]+)?(\\.[0-9]+)?"},
        "version": {"type": "string"},
        "active": {"type": "boolean"},
        "name": {"type": ["string", "null"]},
        "loop": {"type": ["string", "null"]},
        "tags": {"type": "array", "items": {"type": "string"}},
        "markers": {"type": "array", "items": {"type": "string"}},
        "requires": {"type": "array", "items": {"type": "object"}},
        "capabilities": {"type": "array", "items": {"type": "object"}},
        "links": {"type": "object"},
        "linked_at": {"type": "object"},
        "created_at": {"type": "string"},
        "updated_at": {"type": ["string", "null"]},
        "data": {"type": "object"},
    },
}

ENVELOPE_TYPE = T.StructType(
    [
        *(T.StructField(n, T.StringType()) for n in ("id", "slug", "type", "version", "name", "loop")),
        T.StructField("active", T.BooleanType()),
        *(T.StructField(n, T.ArrayType(T.StringType())) for n in ("tags", "markers")),
        *(T.StructField(n, T.ArrayType(T.VariantType())) for n in ("requires", "capabilities")),
        T.StructField("linked_at", T.MapType(T.StringType(), T.StringType())),
        *(T.StructField(n, T.StringType()) for n in ("created_at", "updated_at")),
        T.StructField("data", T.VariantType()),
    ]
)


def spark_type(schema: Any) -> T.DataType:
    """The Spark type of what a schema allows: VARIANT where it does not settle on one type."""
    if not isinstance(schema, dict):
        return T.VariantType()
    kinds = schema.get("type")
    kinds = [k for k in ([kinds] if isinstance(kinds, str) else kinds or []) if k != "null"]
    if len(kinds) != 1:
        return T.VariantType()
    kind = kinds[0]
    if kind == "string":
        return T.StringType()
    if kind == "boolean":
        return T.BooleanType()
    if kind == "integer":
        return T.LongType()
    if kind == "number":
        return T.DoubleType()
    if kind == "array":
        return T.ArrayType(spark_type(schema["items"]) if isinstance(schema.get("items"), dict) else T.VariantType())
    if kind == "object" and schema.get("properties"):
        return struct_type(schema)
    return T.VariantType()


def struct_type(schema: dict) -> T.StructType:
    required = set(schema.get("required", ()))
    return T.StructType([T.StructField(n, spark_type(s), n not in required) for n, s in schema.get("properties", {}).items()])


class TypeRegistry:
    """Schemas by slug@version, and the relationships between types."""

    def __init__(self, contracts: list[dict] = (), relationships: list[dict] = ()):
        self.schemas: dict[str, Any] = {}
        self.relationships: list[dict] = []
        for c in contracts:
            self.add_type(c)
        for r in relationships:
            self.add_relationship(r)
        self.first = (dict(self.schemas), list(self.relationships))

    def add_type(self, contract: dict) -> None:
        """From a type document: slug, version and data.schema."""
        self.schemas[f"{contract['slug']}@{contract.get('version', '1.0.0')}"] = {"allOf": [ENVELOPE, contract["data"]["schema"]]}

    def replace_all(self, contracts: list[dict]) -> None:
        """The types and relationships among contracts beside those given at first, of which they replace those of the same name."""
        self.schemas, self.relationships = dict(self.first[0]), list(self.first[1])
        for c in contracts:
            if c["type"].startswith("type@"):
                self.add_type(c)
            else:
                self.add_relationship(c)

    def schema(self, kind: str) -> Any:
        if kind not in self.schemas:
            raise UnknownCardType(kind)
        return self.schemas[kind]

    def data_type(self, kind: str) -> T.DataType:
        return spark_type(self.schema(kind)["allOf"][1].get("properties", {}).get("data"))

    def add_relationship(self, contract: dict) -> None:
        """From a relationship document: name, data.inverseName, data.from.type, data.to.type."""
        d = contract["data"]
        self.relationships.append({"name": contract["name"], "inverse_name": d["inverseName"], "from_type": d["from"]["type"], "to_type": d["to"]["type"]})

    def check_link(self, link: dict) -> None:
        """UnknownRelationship unless some relationship, in either direction, allows the link."""
        d = link["data"]

        def fits(rule: str, own: str) -> bool:
            return rule in ("*", own, own.split("@")[0])

        for r in self.relationships:
            if (r["name"], r["inverse_name"]) == (link["name"], d["inverseName"]) and fits(r["from_type"], d["from"]["type"]) and fits(r["to_type"], d["to"]["type"]):
                return
            if (r["inverse_name"], r["name"]) == (link["name"], d["inverseName"]) and fits(r["to_type"], d["from"]["type"]) and fits(r["from_type"], d["to"]["type"]):
                return
        raise UnknownRelationship(f"{d['from']['type']} {link['name']} {d['to']['type']}")
