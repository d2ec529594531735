"""Documents in a folder with sessions on top: validated inserts, replacements and patches, and authorized reads.

Every write is one commit: a folder that holds the documents it changed, put in place by one rename, and rows in the change
log that live queries read.  The table is its last compacted base with, of each changed document, the latest state.  One
writer at a time; readers keep the version they opened.
"""

from __future__ import annotations

import json
import uuid
from collections import OrderedDict
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .engine import Engine
from .errors import NoElement, NoLinkTarget, PermissionsError, SchemaMismatch
from .functions.merge import merged_maps
from .operators import patch as patches
from .operators import store
from .operators.authorization import authorize, permission
from .operators.links import edges_of, linked_at
from .operators.validate import valid
from .sources.types import ENVELOPE_TYPE, TypeRegistry
from .streaming.changes import LinkTree, LiveQuery, _batches, _exists, _put, _write

LINK = "link@1.0.0"
#: seq is the version shifted by so many bits, plus the number of the change in its commit; partitions of a reset are fewer than MOST_PARTITIONS.
VERSION_SHIFT, MOST_PARTITIONS = 40, 1 << 16
#: Rows of a file of documents, so that many tasks read a bulk commit even where a few wrote it.
FILE_ROWS = 1 << 17
#: Documents that a kernel remembers by versioned slug.
REMEMBERED = 1000
#: Active types and relationships.
TYPES = {"type": "object", "required": ["type", "active"], "properties": {"type": {"enum": ["type@1.0.0", "relationship@1.0.0"]}, "active": {"const": True}}}
_PLAIN = [f.name for f in ENVELOPE_TYPE if f.name not in ("requires", "capabilities", "data")]


class ContractStore:
    """The table of documents and its change log in one folder that all nodes share.

    commits/v/documents and commits/v/changes come into being by one rename, so neither is ever there without the other.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def version(self) -> int:
        return max([*_batches(self.spark, f"{self.path}/commits"), *_batches(self.spark, f"{self.path}/base")], default=-1)

    def now(self) -> DataFrame:
        base = max(_batches(self.spark, f"{self.path}/base"), default=-1)
        newer = sorted(v for v in _batches(self.spark, f"{self.path}/commits") if v > base)
        read, there = self.spark.read.schema(ENVELOPE_TYPE), F.col("id").isNotNull()
        if base < 0 and not newer:
            return self.spark.createDataFrame([], ENVELOPE_TYPE)
        # Without a base the first commit is one.
        df = read.parquet(f"{self.path}/base/{base}") if base >= 0 else read.parquet(f"{self.path}/commits/{newer.pop(0)}/documents").where(there)
        if not newer:
            return df
        rows = read.parquet(*(f"{self.path}/commits/{v}/documents" for v in newer))
        changed = rows.select(F.col("id").alias("__id"))
        if len(newer) == 1:
            latest = rows.where(there)
        else:
            # Unlike input_file_name(), the path is a column that filters pass by on their way to the scan.
            seq = F.regexp_extract("_metadata.file_path", "/commits/([0-9]+)/", 1).cast("long")
            rows = rows.withColumn("__seq", seq)
            last = rows.groupBy(F.col("id").alias("__id")).agg(F.max("__seq").alias("__last"))
            latest = rows.join(last, (F.col("id") == F.col("__id")) & (F.col("__seq") == F.col("__last"))).select(*df.columns)
        return df.join(changed, F.col("id") == F.col("__id"), "left_anti").unionByName(latest)

    def commit(self, changed: DataFrame, changes: list[tuple[str, str, str]]) -> None:
        """changed: the new state of each document that changes; changes: (id, op, type)."""
        rows = [(i, *c) for i, c in enumerate(changes)]
        self._commit(changed, self.spark.createDataFrame(rows, "n long, id string, op string, type string").coalesce(1))

    def write(self, documents: DataFrame, op: str = "insert") -> None:
        """A bulk commit of documents of the envelope, without checks."""
        documents = documents.select(*ENVELOPE_TYPE.names)
        self._commit(documents, numbered(documents, op))

    def _commit(self, changed: DataFrame, changes: DataFrame) -> None:
        """changes: n, id, op, type; a change is known by its version and n."""
        v = self.version() + 1
        beside = f"{self.path}/staging/{v}-{uuid.uuid4().hex}"
        changed.write.option("maxRecordsPerFile", FILE_ROWS).parquet(f"{beside}/documents")
        changes.select(F.lit(v).cast("long").alias("version"), "n", (F.shiftleft(F.lit(v).cast("long"), VERSION_SHIFT) + F.col("n")).alias("seq"), "id", "op", "type").write.parquet(f"{beside}/changes")
        _put(self.spark, beside, f"{self.path}/commits/{v}")

    def compact(self) -> None:
        """A new base with all commits so far; older folders stay for readers that have them open."""
        v = self.version()
        if v >= 0:
            _write(self.now(), f"{self.path}/base/{v}")

    def reset(self) -> None:
        """An empty table from now on."""
        self._commit(self.spark.createDataFrame([], ENVELOPE_TYPE), numbered(self.now(), "delete"))
        _write(self.spark.createDataFrame([], ENVELOPE_TYPE), f"{self.path}/base/{self.version()}")

    def changes(self, streaming: bool = False) -> DataFrame:
        reader = self.spark.readStream if streaming else self.spark.read
        return reader.schema("version long, n long, seq long, id string, op string, type string").parquet(f"{self.path}/commits/*/changes")

    def exists(self) -> bool:
        return _exists(self.spark, f"{self.path}/commits")

    def rows(self, documents: list[dict]) -> DataFrame:
        plain = [Row(**{n: d.get(n) for n in _PLAIN}, json=json.dumps({k: d.get(k) for k in ("requires", "capabilities", "data")})) for d in documents]
        fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ENVELOPE_TYPE if f.name in _PLAIN)
        df = self.spark.createDataFrame([tuple(r[n] for n in (*_PLAIN, "json")) for r in plain], f"{fields}, json string").withColumn("j", F.parse_json("json"))
        get = lambda n, kind: F.try_variant_get("j", f"$.{n}", kind).alias(n)
        return df.select(*_PLAIN, get("requires", "array<variant>"), get("capabilities", "array<variant>"), get("data", "variant")).select(*ENVELOPE_TYPE.names)


def numbered(documents: DataFrame, op: str) -> DataFrame:
    """(n, id, op, type): a change for each document, each with a number of its own."""
    rows = documents.select(F.monotonically_increasing_id().alias("n"), "id", F.lit(op).alias("op"), "type")
    return rows.withColumn("n", F.shiftright("n", 33) + F.col("n").bitwiseAND(F.lit((1 << 33) - 1)) * MOST_PARTITIONS)


def enveloped(typed: DataFrame) -> DataFrame:
    """Typed documents in the envelope of a store, their data as VARIANT."""
    given = {"id": F.col("id").cast("string"), "created_at": F.col("created_at").cast("string"), "data": F.to_variant_object("data"), "requires": F.array().cast("array<variant>"), "capabilities": F.array().cast("array<variant>")}
    return typed.select(*((given[f.name] if f.name in given else F.col(f.name) if f.name in typed.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in ENVELOPE_TYPE))


def document(row: Row) -> dict:
    """A row with VARIANT columns as plain JSON values."""
    out = row.asDict(True)
    for k, v in out.items():
        if hasattr(v, "toPython"):
            out[k] = v.toPython()
        elif isinstance(v, list):
            out[k] = [x.toPython() if hasattr(x, "toPython") else x for x in v]
    return {"requires": [], "capabilities": [], "links": {}} | out


class Kernel:
    def __init__(self, contracts: ContractStore, types: TypeRegistry):
        self.contracts, self.types = contracts, types
        #: Documents by versioned slug, and None for those that are missing; writes through this kernel forget what they change.
        self._known: OrderedDict[str, dict | None] = OrderedDict()

    # Reading.

    def links(self) -> DataFrame:
        """Link documents, removed ones too, as edges_of() takes them."""
        links = self.contracts.now().where(F.col("type") == LINK)
        get = lambda path: F.try_variant_get("data", path, "string")
        data = F.struct(get("$.inverseName").alias("inverseName"), F.struct(get("$.from.id").alias("id")).alias("from"), F.struct(get("$.to.id").alias("id")).alias("to"))
        return links.select("id", "name", "active", "created_at", data.alias("data"))

    def engine(self) -> Engine:
        return Engine(self.contracts.spark, self.contracts.now(), edges=edges_of(self.links()))

    def live(self, schema: Any, state: str, emit, actor: dict | None = None) -> LiveQuery:
        """A live query over this store's change log, for what an actor may see."""
        allowed = self.permission(actor)
        tree = LinkTree(lambda: edges_of(self.links().withColumn("active", F.lit(True))), self.links)
        return LiveQuery(self.engine, schema if allowed is None else authorize(schema, allowed), state, emit, tree)

    def follow_types(self, state: str) -> LiveQuery:
        """Keeps the types and relationships of this kernel as the store has them; they are few."""

        def refresh(events: DataFrame, batch: int) -> None:
            if not events.isEmpty():
                found = self.engine().query(TYPES, limit=None).collect()
                self.types.replace_all([document(r) for r in found])

        return self.live(TYPES, state, refresh)

    def permission(self, actor: dict | None, scope: dict | None = None) -> Any:
        """What an actor may see; None is the system itself.

        Roles are the actor's own (role- and its slug) and those in its data; organisations are those that have it as a
        member.
        """
        if actor is None:
            return None
        roles = [f"role-{actor['slug']}", *(r if r.startswith("role-") else f"role-{r}" for r in actor.get("data", {}).get("roles", []))]
        e = self.engine()
        found = [document(r) for r in e.query({"required": ["slug"], "properties": {"slug": {"enum": roles}, "type": {"const": "role@1.0.0"}}}).collect()]
        orgs = e.query({"properties": {"type": {"const": "org@1.0.0"}}, "$$links": {"has member": {"properties": {"id": {"const": actor["id"]}}}}}).select("slug").collect()
        return permission(actor, [r["data"]["read"] for r in found], [o.slug for o in orgs], scope)

    def query(self, schema: Any, actor: dict | None = None, scope: dict | None = None, **options) -> DataFrame:
        return self.engine().query(schema, permission=self.permission(actor, scope), **options)

    def remembered(self, slug: str) -> dict | None:
        """get() for the system itself, of a document that was looked up before without a query."""
        if slug not in self._known:
            if len(self._known) >= REMEMBERED:
                self._known.popitem(last=False)
            self._known[slug] = self.get(slug)
        self._known.move_to_end(slug)
        return self._known[slug]

    def _written(self, changed: DataFrame, changes: list[tuple[str, str, str]], slugs: list[str]) -> None:
        self.contracts.commit(changed, changes)
        # A new version may be the latest one; ends of links change as well.
        if any(kind == LINK for *_, kind in changes):
            self._known.clear()
        for key in [k for k in self._known if k.split("@")[0] in slugs]:
            del self._known[key]

    def get(self, slug: str, actor: dict | None = None) -> dict | None:
        found = self.engine().get_by_slug(slug, permission=self.permission(actor)).limit(1).collect()
        return document(found[0]) if found else None

    # Writing.

    def _checked(self, documents: list[dict], actor: dict | None) -> list[dict]:
        """Documents with defaults, valid for their types, allowed, and links between documents that are there."""
        docs, allowed, ends = [store.defaults(d) for d in documents], self.permission(actor), {}
        for doc in docs:
            if not valid(self.types.schema(doc["type"]), doc):
                raise SchemaMismatch(f"{doc['slug']} does not fit {doc['type']}")
            if allowed is not None and not valid(allowed, doc):
                raise PermissionsError(doc["slug"])
            if doc["type"] == LINK:
                for end in (doc["data"][k] for k in ("from", "to")):
                    end["type"] += "" if "@" in end["type"] else "@1.0.0"
                    ends[end["id"]] = doc["slug"]
        if ends:
            # All ends in one query.
            seen = self.engine().query({"required": ["id"], "properties": {"id": {"enum": list(ends)}}}, permission=allowed, limit=None)
            missing = set(ends) - {r.id for r in seen.select("id").distinct().collect()} - {d["id"] for d in docs}
            if missing:
                raise NoLinkTarget(ends[missing.pop()])
        for doc in docs:
            if doc["type"] == LINK:
                self.types.check_link(doc)
        return docs

    def _with_ends(self, changed: DataFrame, docs: list[dict]) -> DataFrame:
        """changed, and both ends of the links among docs with linked_at; a time that is set stays."""
        rows = [(d["id"], d["name"], True, d["created_at"], (d["data"]["inverseName"], (d["data"]["from"]["id"],), (d["data"]["to"]["id"],))) for d in docs if d["type"] == LINK]
        if not rows:
            return changed
        links = self.contracts.spark.createDataFrame(rows, "id string, name string, active boolean, created_at string, data struct<inverseName:string,from:struct<id:string>,to:struct<id:string>>")
        at = linked_at(links).select(F.col("id").alias("__id"), F.col("linked_at").alias("__at"))
        mine = [d["id"] for d in docs]
        now = self.contracts.now().where(~F.col("id").isin(mine)).unionByName(changed)
        ends = now.join(at, F.col("id") == F.col("__id")).withColumn("linked_at", merged_maps(F.col("linked_at"), F.col("__at"))).select(*changed.columns)
        return changed.join(at, F.col("id") == F.col("__id"), "left_anti").unionByName(ends)

    def insert(self, doc: dict, actor: dict | None = None) -> dict:
        return self.insert_many([doc], actor)[0]

    def insert_many(self, documents: list[dict], actor: dict | None = None) -> list[dict]:
        docs = self._checked(documents, actor)
        new = self.contracts.rows(docs)
        store.insert(self.contracts.now(), new)
        self._written(self._with_ends(new, docs), [(d["id"], "insert", d["type"]) for d in docs], [d["slug"] for d in docs])
        return docs

    def replace(self, doc: dict, actor: dict | None = None) -> dict:
        doc = self._checked([doc], actor)[0]
        same = self.contracts.now().where((F.col("slug") == doc["slug"]) & (F.col("version") == doc["version"]))
        there = self.get(f"{doc['slug']}@{doc['version']}")
        changed = store.replace(same, self.contracts.rows([doc]), datetime.now(UTC).isoformat())
        if there:
            doc = doc | {"id": there["id"]}
        self._written(self._with_ends(changed, [doc]), [(doc["id"], "update" if there else "insert", doc["type"])], [doc["slug"]])
        return self.get(f"{doc['slug']}@{doc['version']}")

    def unsafe_upsert(self, doc: dict) -> dict:
        """replace() by the system itself: the document must fit its type, and no permission is asked for."""
        return self.replace(doc)

    def patch(self, slug: str, operations: list[dict], actor: dict | None = None) -> dict:
        """The document as the actor sees it after all operations; nothing is written if nothing changed."""
        full, seen = self.get(slug), self.get(slug, actor)
        if full is None or seen is None:
            raise NoElement(slug)
        allowed = self.permission(actor)
        new, seen, changed = patches.patched(full, seen, operations, self.types.schema(full["type"]), True if allowed is None else allowed)
        if changed:
            new = new | {"updated_at": datetime.now(UTC).isoformat()}
            self._written(self.contracts.rows([new]), [(full["id"], "update", full["type"])], [full["slug"]])
        return seen
