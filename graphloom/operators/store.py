"""Writes as DataFrame operations: each takes the documents that are and gives the documents that will be."""

from __future__ import annotations

import re
import uuid
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ElementAlreadyExists, InvalidSlug, SchemaMismatch, UnknownCardType
from ..functions.text import STOP_WORDS
from ..functions.versions import parse_version
from .validate import valid

KEY = ["slug", "version"]
LONGEST_SLUG = 255


def slug_for(kind: str, name: str | None, id_: str) -> str:
    """Type, name without stop words, and the head of the id."""
    words = [w for w in re.sub(r"[^a-z0-9 -]", "", (name or "").lower()).split() if w not in STOP_WORDS]
    return re.sub(r"-{2,}", "-", "-".join([kind.split("@")[0], *words, id_[:7]]))[:LONGEST_SLUG]


def defaults(document: dict, now: datetime | None = None) -> dict:
    """A document with everything the envelope asks for."""
    id_ = document.get("id") or str(uuid.uuid4())
    filled = {"active": True, "version": "1.0.0", "tags": [], "markers": [], "requires": [], "capabilities": [], "links": {}, "linked_at": {}, "data": {}, "name": None, "loop": None, "created_at": (now or datetime.now(UTC)).isoformat(), "updated_at": None}
    out = filled | {k: v for k, v in document.items() if v is not None or k in ("name", "loop", "updated_at")} | {"id": id_}
    out["version"] = str(parse_version(out["version"]))
    if "@" not in out["type"]:
        out["type"] += "@1.0.0"
    out.setdefault("slug", slug_for(out["type"], out["name"], id_))
    return out


def check(document: dict, types: dict[str, Any], permission: Any = True) -> dict:
    """The document with defaults, valid for its type and allowed, or an error."""
    doc = defaults(document)
    if len(doc["slug"]) > LONGEST_SLUG or not re.fullmatch(r"[a-z0-9-]+", doc["slug"]):
        raise InvalidSlug(doc["slug"])
    if doc["type"] not in types:
        raise UnknownCardType(doc["type"])
    if not valid(types[doc["type"]], doc):
        raise SchemaMismatch(f"{doc['slug']} does not fit {doc['type']}")
    if not valid(permission, doc):
        raise SchemaMismatch(f"{doc['slug']} is not allowed")
    return doc


def conflicts(now: DataFrame, new: DataFrame) -> DataFrame:
    """Keys of new that are there already, or twice in new."""
    twice = new.groupBy(*KEY).agg(F.count("*").alias("n")).where("n > 1").select(*KEY)
    return new.join(now.select(*KEY), KEY, "left_semi").select(*KEY).unionByName(twice).distinct()


def insert(now: DataFrame, new: DataFrame) -> DataFrame:
    """now and new together; a slug and version that are there already raise ElementAlreadyExists."""
    found = conflicts(now, new).limit(3).collect()
    if found:
        raise ElementAlreadyExists(", ".join(f"{r.slug}@{r.version}" for r in found))
    return now.unionByName(new, allowMissingColumns=True)


def replace(now: DataFrame, new: DataFrame, at) -> DataFrame:
    """Upsert by slug and version: id, type, links, linked_at and created_at stay as they were, updated_at is set."""
    fixed = [c for c in ("id", "type", "links", "linked_at", "created_at") if c in now.columns]
    old = now.select(*(F.col(c).alias(f"__{c}") for c in [*KEY, *fixed]), F.lit(True).alias("__there"))
    same = [F.col(c) == F.col(f"__{c}") for c in KEY]
    both = new.join(old, same, "left")
    there = F.coalesce("__there", F.lit(False))
    columns = []
    for c in now.columns:
        own = F.col(c) if c in new.columns else F.lit(None).cast(now.schema[c].dataType)
        if c in fixed:
            own = F.when(there, F.col(f"__{c}")).otherwise(own)
        elif c == "updated_at":
            own = F.when(there, F.lit(at).cast(now.schema[c].dataType)).otherwise(own)
        columns.append(own.alias(c))
    kept = now.join(new.select(*(F.col(c).alias(f"__{c}") for c in KEY)), same, "left_anti")
    return kept.unionByName(both.select(*columns))


def deactivate(now: DataFrame, ids: DataFrame) -> DataFrame:
    """Soft deletion: documents with an id among ids (id) are no longer active; no row goes."""
    gone = ids.select(F.col("id").alias("__id"), F.lit(True).alias("__gone")).distinct()
    out = now.join(gone, F.col("id") == F.col("__id"), "left")
    return out.withColumn("active", F.col("active") & F.col("__gone").isNull()).select(*now.columns)


def derived_from_users(users: DataFrame) -> DataFrame:
    """(user_id, kind, slug, id): what the write of a user brings along.

    A settings document always; a password document where data.hash is a hash (begins with $); one for oauth if present.
    The id follows from the slug, so a write that is made again gives the same documents.
    """
    data = users.schema["data"].dataType.names
    has = lambda name, test: test if name in data else F.lit(False)
    kinds = F.array(
        F.lit("user-settings"),
        F.when(has("hash", F.col("data.hash").startswith("$") if "hash" in data else F.lit(False)), "authentication-password"),
        F.when(has("oauth", F.col("data.oauth").isNotNull() if "oauth" in data else F.lit(False)), "authentication-oauth"),
    )
    each = users.select(F.col("id").cast("string").alias("user_id"), "slug", F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("kind"))
    return each.select("user_id", "kind", F.concat_ws("-", "kind", "slug").alias("slug")).withColumn("id", F.sha2("slug", 256))


#: How a user is linked to what its write brings along: verb, inverse verb.
DERIVED_LINKS = {
    "user-settings": ("has settings", "are settings for"),
    "authentication-password": ("is authenticated with", "authenticates"),
    "authentication-oauth": ("is authenticated with", "authenticates"),
}


def derived_documents(users: DataFrame) -> DataFrame:
    """The documents of derived_from_users() and the links from their users: id, slug, type, name, data (as VARIANT).

    Passwords and tokens move from the user's data to the derived document's; write the user's without_secrets().
    """
    found = derived_from_users(users)
    names = users.schema["data"].dataType.names
    secrets = users.select(F.col("id").cast("string").alias("__user"), *(F.col(f"data.{n}").alias(f"__{n}") for n in ("hash", "oauth") if n in names))
    held = found.join(secrets, F.col("user_id") == F.col("__user"))
    value = lambda name: F.to_json(F.struct(F.lit(name).alias("of"), F.col(f"__{name}").alias("value"))) if name in names else F.lit(None)
    data = F.when(F.col("kind") == "authentication-password", F.to_json(F.struct((F.col("__hash") if "hash" in names else F.lit(None)).alias("hash"), F.col("user_id").alias("actorId")))).when(F.col("kind") == "authentication-oauth", value("oauth")).otherwise("{}")
    documents = held.select("id", "slug", F.concat("kind", F.lit("@1.0.0")).alias("type"), F.lit(None).cast("string").alias("name"), F.parse_json(data).alias("data"))
    verb = F.create_map(*(F.lit(x) for kind, (verb, _) in DERIVED_LINKS.items() for x in (kind, verb)))
    inverse = F.create_map(*(F.lit(x) for kind, (_, inverse) in DERIVED_LINKS.items() for x in (kind, inverse)))
    ends = F.struct(inverse[F.col("kind")].alias("inverseName"), F.struct(F.col("user_id").alias("id"), F.lit("user@1.0.0").alias("type")).alias("from"), F.struct("id", F.concat("kind", F.lit("@1.0.0")).alias("type")).alias("to"))
    slug = F.concat(F.lit("link-"), F.col("slug"))
    links = found.select(F.sha2(slug, 256).alias("id"), slug.alias("slug"), F.lit("link@1.0.0").alias("type"), verb[F.col("kind")].alias("name"), F.to_variant_object(ends).alias("data"))
    return documents.unionByName(links)


def without_secrets(users: DataFrame) -> DataFrame:
    """users whose data no longer holds what derived_documents() takes over."""
    left = [n for n in users.schema["data"].dataType.names if n not in ("hash", "oauth")]
    return users.withColumn("data", F.struct(*(F.col(f"data.{n}") for n in left)))
