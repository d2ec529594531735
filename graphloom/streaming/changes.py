"""Live queries: which documents begin to match a schema, change, stop matching or go.

A change log is an append-only table (seq, id, op); documents are read anew for the ids of a batch only.  The seen-set holds
(root, id): the documents a query has given, and with each the linked documents and links it depends on.  It is a log of its
own: every micro-batch adds a folder with the roots it changed, so a batch that is run again gives the same events, and
folders are put together now and then.
"""

from __future__ import annotations

import logging
import time
import uuid
from collections.abc import Callable
from contextlib import contextmanager, nullcontext
from typing import Any

from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..engine import Engine
from ..plans.schema import Schema, contract_types, links_of, parse

log = logging.getLogger(__name__)
SEEN = "root string, id string"
#: Folders of the seen-set after which they are put together.
DELTAS = 32
INSERT, UPDATE, DELETE, UNMATCH = "insert", "update", "delete", "unmatch"


def last_changes(changes: DataFrame) -> DataFrame:
    """One row per id: its last operation and whether it was made in this batch."""
    return changes.groupBy("id").agg(F.max_by("op", "seq").alias("op"), F.max(F.col("op") == INSERT).alias("made"))


def classified(seen: Column, matches: Column, op: Column) -> Column:
    """The event of a document, or null if there is none."""
    return (
        F.when((op == DELETE) & seen, DELETE)
        .when(op == DELETE, None)
        .when(matches & seen, UPDATE)
        .when(matches & (op == INSERT), INSERT)
        .when(matches, UPDATE)
        .when(seen, UNMATCH)
    )


def compare(before: DataFrame, after: DataFrame, key: str = "id") -> DataFrame:
    """(key, event) from two snapshots of rows that match: (key, fingerprint, present).

    present says whether the document still exists at all: if not, it was deleted; else it stopped matching.
    """
    b = before.select(F.col(key).alias("__b"), F.col("fingerprint").alias("__f"))
    a = after.select(F.col(key).alias("__a"), F.col("fingerprint").alias("__g"), "present", "matches")
    both = b.join(a, F.col("__a") == F.col("__b"), "full")
    event = (
        F.when(F.col("__b").isNull() & F.col("matches"), INSERT)
        .when(F.col("__b").isNotNull() & ~F.coalesce("present", F.lit(False)), DELETE)
        .when(F.col("__b").isNotNull() & ~F.col("matches"), UNMATCH)
        .when(F.col("__b").isNotNull() & (F.col("__f") != F.col("__g")), UPDATE)
    )
    return both.select(F.coalesce("__b", "__a").alias(key), event.alias("event")).where("event IS NOT NULL")


def prefiltered(changes: DataFrame, schema: Any) -> DataFrame:
    """The changes that can matter to a schema: those of its types, where it names some and looks at no links."""
    tree = parse(schema)
    types = contract_types(tree)
    if types is None or "type" not in changes.columns or any(links_of(tree)):
        return changes
    return changes.where(F.col("type").isin(sorted(types)))


class LinkTree:
    """Which roots a changed document or link may touch, and on which a root depends.

    edges() gives link_id, from_id, name, to_id of all links, removed ones too: a removed link touches the root it led from.
    stored() is what edges() and the engine's edges are both worked out from, where that takes long.
    """

    def __init__(self, edges: Callable[[], DataFrame], stored: Callable[[], DataFrame] | None = None):
        self.edges, self.stored = edges, stored

    @contextmanager
    def kept(self):
        """Within it the stored links are read once; plans made there find them as they read the same folders."""
        if self.stored is None:
            yield
            return
        links = self.stored().persist()
        try:
            # At once: steps that run side by side would each work them out.
            links.count()
            yield
        finally:
            links.unpersist()

    def _of(self, verb: str) -> DataFrame:
        text = [F.col(c).cast("string").alias(c) for c in ("link_id", "from_id", "to_id")]
        return self.edges().where(F.col("name") == verb).select(*text)

    def roots(self, engine: Engine, tree: Schema, touched: DataFrame) -> DataFrame:
        """(id): documents with a changed link along the schema's verbs, or a link to a changed document that validates
        against the schema of that link: the inverse queries."""
        found = None
        for verb, sub in links_of(tree):
            e = self._of(verb)
            by_link = e.join(touched.select(F.col("id").alias("__c")), F.col("link_id") == F.col("__c"), "left_semi").select(F.col("from_id").alias("id"))
            changed = engine.matching(contract_types(sub), sub, touched)[0].select(F.col("id").cast("string").alias("id"))
            if any(links_of(sub)):
                # What is touched further away counts as changed here.
                changed = changed.unionByName(self.roots(engine, sub, touched))
            by_end = e.join(changed.select(F.col("id").alias("__c")), F.col("to_id") == F.col("__c"), "left_semi").select(F.col("from_id").alias("id"))
            level = by_link.unionByName(by_end)
            found = level if found is None else found.unionByName(level)
        return found.distinct()

    def dependents(self, tree: Schema, roots: DataFrame) -> DataFrame:
        """(root, id): the links and linked documents of roots (root, at), as deep as the schema goes."""
        found = None
        for verb, sub in links_of(tree):
            e = self._of(verb)
            step = roots.join(e, F.col("at") == F.col("from_id"))
            level = step.select("root", F.col("link_id").alias("id")).unionByName(step.select("root", F.col("to_id").alias("id")))
            if any(links_of(sub)):
                level = level.unionByName(self.dependents(sub, step.select("root", F.col("to_id").alias("at"))))
            found = level if found is None else found.unionByName(level)
        return found.distinct()


class LiveQuery:
    """A schema over a growing change log.

    engine() gives the engine on the documents as they are now; state is a folder that all nodes share; emit(df, batch)
    takes each batch's events (id, event).  links: the link tree, for schemas with links.
    """

    def __init__(self, engine: Callable[[], Engine], schema: Any, state: str, emit: Callable[[DataFrame, int], None], links: LinkTree | None = None):
        self.engine, self.schema, self.state, self.emit, self.links = engine, schema, state.rstrip("/"), emit, links
        self.query = None

    def set_schema(self, schema: Any) -> None:
        """What is seen stays seen."""
        self.schema = schema

    # The seen-set: folder 2 * b + 1 holds what batch b changed, 2 * b what was added by hand before it; whole/n all up to n.

    def _seen(self, spark, batch: int) -> DataFrame:
        """(root, id) as they are before a batch."""
        read = spark.read.schema(SEEN)
        whole = max((n for n in _batches(spark, f"{self.state}/whole") if n < 2 * batch + 1), default=-1)
        newer = sorted(n for n in _batches(spark, f"{self.state}/seen") if whole < n < 2 * batch + 1)
        if whole < 0 and not newer:
            return spark.createDataFrame([], SEEN)
        # Without a whole the first folder is one.
        now = read.parquet(f"{self.state}/whole/{whole}" if whole >= 0 else f"{self.state}/seen/{newer.pop(0)}").where("id IS NOT NULL")
        if not newer:
            return now
        rows = read.parquet(*(f"{self.state}/seen/{n}" for n in newer))
        changed = rows.select(F.col("root").alias("__root")).distinct()
        if len(newer) > 1:
            at = F.regexp_extract("_metadata.file_path", "/seen/([0-9]+)/", 1).cast("long")
            rows = rows.withColumn("__at", at)
            changed = rows.groupBy(F.col("root").alias("__root")).agg(F.max("__at").alias("__last"))
            rows = rows.join(changed, (F.col("root") == F.col("__root")) & (F.col("__at") == F.col("__last")))
        latest = rows.where("id IS NOT NULL").select("root", "id")
        return now.join(changed.select("__root"), F.col("root") == F.col("__root"), "left_anti").unionByName(latest)

    def _entries(self, roots: DataFrame) -> DataFrame:
        """Rows of the seen-set for roots (id)."""
        own = roots.select(F.col("id").alias("root"), "id")
        tree = parse(self.schema)
        if self.links is None or not any(links_of(tree)):
            return own
        return own.unionByName(self.links.dependents(tree, own.select("root", F.col("id").alias("at")))).distinct()

    def dataset(self, schema: Any | None = None) -> DataFrame:
        """All that matches now; it counts as seen from the next batch on."""
        spark = self.engine().spark
        found = self.engine().query(schema if schema is not None else self.schema, limit=None).select(F.col("id").cast("string").alias("id"))
        last = max((n for n in _batches(spark, f"{self.state}/seen") if n % 2), default=-1)
        path, entries = f"{self.state}/seen/{last + 1}", self._entries(found)
        if _exists(spark, path):
            entries = entries.unionByName(spark.read.schema(SEEN).parquet(path)).distinct()
        _write(entries, path)
        return found

    def process(self, changes: DataFrame, batch: int) -> None:
        """Events of one micro-batch of changes (seq, id, op and, where known, type)."""
        with self.links.kept() if self.links is not None and any(links_of(parse(self.schema))) else nullcontext():
            events = self._process(changes, batch)
        self._compact(changes.sparkSession, batch)
        self.emit(events, batch)

    def _process(self, changes: DataFrame, batch: int) -> DataFrame:
        spark, engine, tree = changes.sparkSession, self.engine(), parse(self.schema)
        # A batch that is run again starts from the seen-set before it.
        seen = self._seen(spark, batch)
        own = last_changes(prefiltered(changes, self.schema).select("seq", F.col("id").cast("string").alias("id"), "op"))
        touched = own.select("id", "op")
        if self.links is not None and any(links_of(tree)):
            # Roots that depend on what changed, as far as they are seen, and those that a changed document links to now.
            depend = seen.join(own.select(F.col("id").alias("__c")), F.col("id") == F.col("__c"), "left_semi").select(F.col("root").alias("id"))
            more = depend.unionByName(self.links.roots(engine, tree, own.select("id"))).distinct().join(own, "id", "left_anti")
            touched = touched.unionByName(more.select("id", F.lit(UPDATE).alias("op")))
        matching = engine.query(self.schema, limit=None, ids=touched.select("id")).select(F.col("id").cast("string").alias("__m"))
        held = seen.where("root = id").select(F.col("id").alias("__s"))
        rows = touched.join(matching, F.col("id") == F.col("__m"), "left").join(held, F.col("id") == F.col("__s"), "left")
        events = rows.select("id", classified(F.col("__s").isNotNull(), F.col("__m").isNotNull(), F.col("op")).alias("event")).where("event IS NOT NULL")
        path = f"{self.state}/events/{batch}"
        _write(events, path)
        events = spark.read.schema("id string, event string").parquet(path)
        gone = events.where(F.col("event").isin(DELETE, UNMATCH)).select(F.col("id").alias("root"), F.lit(None).cast("string").alias("id"))
        fresh = self._entries(events.where(F.col("event").isin(INSERT, UPDATE)).select("id"))
        _write(gone.unionByName(fresh), f"{self.state}/seen/{2 * batch + 1}")
        return events

    def _compact(self, spark, batch: int) -> None:
        """Puts the seen-set before a batch together once it lies in many folders; what the batch itself needs stays."""
        old = [n for n in _batches(spark, f"{self.state}/seen") if n < 2 * batch]
        if len(old) >= DELTAS:
            _write(self._seen(spark, batch), f"{self.state}/whole/{2 * batch}")
            for n in old:
                _remove(spark, f"{self.state}/seen/{n}")
            for n in _batches(spark, f"{self.state}/whole"):
                if n < 2 * batch:
                    _remove(spark, f"{self.state}/whole/{n}")
            for n in _batches(spark, f"{self.state}/events"):
                if n < batch:
                    _remove(spark, f"{self.state}/events/{n}")

    def start(self, changes: DataFrame, **trigger):
        """A streaming query over a streaming change log."""
        self.query = changes.writeStream.foreachBatch(self.process).option("checkpointLocation", f"{self.state}/checkpoint").trigger(**(trigger or {"availableNow": True})).start()
        return self.query

    def run(self, changes: Callable[[], DataFrame], on: Callable[[str, Exception | None], None] = lambda event, error: None, retries: int = 3, delay: float = 2.0, **trigger) -> None:
        """Runs until the stream ends; on(event, error) hears of error, reconnect and closed.

        After an error the stream starts anew from its checkpoint, so no event is lost or classified otherwise; more than
        retries errors in a row without a batch between them are raised.
        """
        failed, last = 0, -1
        while True:
            query = self.start(changes(), **trigger)
            try:
                query.awaitTermination()
                on("closed", None)
                return
            except StreamingQueryException as error:
                on("error", error)
                done = max(_batches(self.engine().spark, f"{self.state}/checkpoint/commits"), default=-1)
                failed, last = (0 if done > last else failed) + 1, done
                if failed > retries:
                    raise
                log.warning("live query in %s starts anew after: %s", self.state, error)
                time.sleep(delay)
                on("reconnect", None)

    def close(self) -> None:
        if self.query is not None:
            self.query.stop()


def _path(spark, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _exists(spark, path: str) -> bool:
    fs, p = _path(spark, path)
    return fs.exists(p)


def _batches(spark, path: str) -> list[int]:
    fs, p = _path(spark, path)
    return [int(f.getPath().getName()) for f in fs.listStatus(p) if f.getPath().getName().isdigit()] if fs.exists(p) else []


def _remove(spark, path: str) -> None:
    fs, p = _path(spark, path)
    fs.delete(p, True)


def _put(spark, beside: str, path: str) -> None:
    """Renames a folder that is complete to where readers look for it."""
    fs, p = _path(spark, path)
    fs.delete(p, True)
    fs.mkdirs(p.getParent())
    if not fs.rename(_path(spark, beside)[1], p):
        raise OSError(f"cannot put {path} in place")


def _write(df: DataFrame, path: str) -> None:
    """Written beside, then put in place: a batch that stops half-way leaves no half table."""
    beside = f"{path}-{uuid.uuid4().hex}"
    df.write.parquet(beside)
    _put(df.sparkSession, beside, path)


class Dispatcher:
    """Many live queries over one change log: each micro-batch is read once and goes to all of them."""

    def __init__(self):
        self.queries: dict[str, LiveQuery] = {}
        self.query = None

    def attach(self, name: str, live: LiveQuery) -> None:
        self.queries[name] = live

    def detach(self, name: str) -> None:
        self.queries.pop(name, None)

    def process(self, changes: DataFrame, batch: int) -> None:
        changes = changes.persist()
        try:
            for live in list(self.queries.values()):
                live.process(changes, batch)
        finally:
            changes.unpersist()

    def start(self, changes: DataFrame, checkpoint: str, **trigger):
        self.query = changes.writeStream.foreachBatch(self.process).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
        return self.query

    def close(self) -> None:
        if self.query is not None:
            self.query.stop()
