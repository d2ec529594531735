"""The engine: schemas in, DataFrames out."""

from __future__ import annotations

import itertools
import time
from collections import OrderedDict
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import BadResultSetSize, InvalidLimit, InvalidSchema
from .functions.predicates import column
from .functions.values import Typed
from .functions.versions import parse_slug, version_order
from .operators.authorization import authorize
from .operators.links import Verb, below, exists, expand, reachable
from .operators.views import resolve
from .plans.compiler import Compiler
from .plans.schema import Schema, contract_types, links_of, parse, without_mandatory_links
from .plans.selection import render, selection

MOST = 1000
#: A column of stored stems by path, for full-text searches; no part of the documents.
STEMS = "__stems"


def root_of(df: DataFrame) -> Typed:
    """The document as a whole: always there, its fields the columns."""
    stored = {n: F.col(STEMS).getField(n) for n in df.schema[STEMS].dataType.names} if STEMS in df.columns else {}
    root = Typed(None, df.schema, stems=stored)
    root.exists = root.present = lambda: True
    return root


def among(df: DataFrame, ids: DataFrame | None) -> DataFrame:
    """The documents with an id among ids; ids of another type are compared as text."""
    if ids is None:
        return df
    own, wanted = F.col("id"), F.col("__wanted")
    if df.schema["id"].dataType != ids.schema["id"].dataType:
        own, wanted = own.cast("string"), wanted.cast("string")
    return df.join(ids.select(F.col("id").alias("__wanted")), own == wanted, "left_semi")


def together(dfs: list[DataFrame]) -> DataFrame:
    """Documents of several types in one table: their data as VARIANT."""
    parts = [df.withColumn("data", F.parse_json(F.to_json("data"))).withColumn("id", F.col("id").cast("string")) for df in dfs]
    out = parts[0]
    for df in parts[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


class Engine:
    """Queries over documents.

    contracts: one DataFrame of the envelope with `data` (a struct or VARIANT), or one for each type (`slug@version`).
    verbs: how links lead between types; edges: a general edge table (from_id, name, to_id) for all other verbs.
    """

    def __init__(self, spark: SparkSession, contracts: DataFrame | dict[str, DataFrame], verbs: list[Verb] = (), edges: DataFrame | None = None):
        self.spark, self.tables, self.edges = spark, contracts, edges
        self.verbs = {(v.source, v.name): v for v in verbs}
        self._names = itertools.count()
        self._found: OrderedDict[tuple, dict | None] = OrderedDict()

    # Sources.

    def source(self, types: set[str] | None) -> tuple[DataFrame, str | None]:
        """Documents of the types, and the one type if there is only one."""
        if isinstance(self.tables, DataFrame):
            return self.tables, None
        names = sorted(self.tables) if types is None else sorted(t for t in types if t in self.tables)
        if len(names) == 1:
            return self.tables[names[0]], names[0]
        if not names:
            any_table = next(iter(self.tables.values()))
            return any_table.where(F.lit(False)), None
        return together([self.tables[n] for n in names]), None

    def matching(self, types: set[str] | None, schema: Schema, ids: DataFrame | None = None) -> tuple[DataFrame, str | None]:
        """Documents of the types that validate against schema, and the one type if there is only one.

        Several types are filtered one by one, each on its own typed columns, before they become one table.
        """
        names = sorted(t for t in self.tables if types is None or t in types) if isinstance(self.tables, dict) else []
        if len(names) > 1 and not any(links_of(schema)):
            return together([self.filtered(among(self.tables[n], ids), n, schema) for n in names]), None
        df, kind = self.source(types)
        return self.filtered(among(df, ids), kind, schema), kind

    def verb(self, source: str | None, name: str) -> Verb:
        found = self.verbs.get((source, name))
        if found is None and self.edges is not None:
            found = Verb(name, source or "*", "*", edges=self.edges.where(F.col("name") == name))
        if found is None:
            raise InvalidSchema(f"no link {name!r} from {source or 'any type'}")
        return found

    def targets(self, verb: Verb, sub: Schema) -> tuple[DataFrame, str | None]:
        """The documents that a verb may lead to and that validate against sub."""
        return self.matching(contract_types(sub) if verb.target == "*" else {verb.target}, sub)

    # Predicates.

    def filtered(self, df: DataFrame, kind: str | None, schema: Schema) -> DataFrame:
        """The documents of df that validate against schema."""
        flags: list[tuple[str, DataFrame, str]] = []
        outer: dict[str, Column] = {}

        def link(name: str, sub: Schema, inside: bool):
            verb = self.verb(kind, name)
            keys, key = reachable(verb, self.targets(verb, sub)[0])
            if not inside:
                # A name of its own, as the linked documents have columns of the same names.
                name = f"__outer{next(self._names)}"
                outer[name] = F.col(key)
                return exists(keys, name)
            # Subqueries cannot stand in lambdas over elements: a flag is joined on beforehand.
            flags.append((f"__flag{len(flags)}", keys, key))
            return F.col(flags[-1][0]).isNotNull()

        # Mandatory links are semi joins from the start, so that pruning reaches nested columns below them.
        schema, mandatory = without_mandatory_links(schema)
        p = Compiler(link).predicate(schema, root_of(df))
        names = df.columns
        for flag, keys, key in flags:
            own = keys.distinct().select(F.col("__key").alias(f"{flag}key"), F.lit(True).alias(flag))
            df = df.join(own, F.col(key) == F.col(f"{flag}key"), "left")
        if outer:
            df = df.withColumns(outer)
        df = df.where(column(p)).select(*names) if flags or outer else df.where(column(p))
        for name, sub in mandatory:
            verb = self.verb(kind, name)
            keys, key = reachable(verb, self.targets(verb, sub)[0])
            df = df.join(keys, F.col(key) == F.col("__key"), "left_semi")
        return df

    def _fields(self, df: DataFrame, kind: str | None, schema: Schema):
        root = root_of(df)
        # Of a branch of anyOf with a link the rest decides about the fields it adds.
        compiler = Compiler(lambda name, sub, inside: True)
        return root, selection(schema, root, compiler.predicate)

    def projection(self, df: DataFrame, kind: str | None, schema: Schema) -> list[Column]:
        root, fields = self._fields(df, kind, schema)
        if fields.whole is True:
            return [F.col(f"`{c}`") for c in df.columns if c != STEMS]
        out = []
        for name in df.columns:
            if name == STEMS:
                continue
            sub = fields.below.get(name)
            found = render(sub, root.field(name)) if sub else None
            if found is not None:
                out.append(found.alias(name))
        return out

    def order(self, df: DataFrame, sort_by: str | list[str] | None, sort_dir: str = "asc") -> list[Column]:
        """Sort columns; nulls go last either way. A list is one nested path."""
        if sort_by is None:
            return []
        if sort_dir not in ("asc", "desc"):
            raise InvalidSchema(f"sort direction {sort_dir!r}")
        path = [sort_by] if isinstance(sort_by, str) else list(sort_by)
        if path == ["version"]:
            return version_order(F.col("version"), sort_dir == "desc")
        value = Typed(None, df.schema)
        for name in path:
            value = value.field(name)
        if value.column is None:
            return []
        return [c.asc_nulls_last() if sort_dir == "asc" else c.desc_nulls_last() for c in value.sort_keys()]

    # Queries.

    def query(self, schema: Any, *, sort_by=None, sort_dir: str = "asc", skip: int = 0, limit: int | None = MOST, links: dict | None = None, mask: Any = None, permission: Any = None, ids: DataFrame | None = None) -> DataFrame:
        """Documents that validate against schema (or a view contract), with the fields it selects and a struct `links`.

        limit is at most 1000; None lifts it.  ids: only documents with an id among its column id.
        """
        if limit is not None and (isinstance(limit, bool) or not isinstance(limit, int) or not 0 <= limit <= MOST):
            raise InvalidLimit(f"the limit is a whole number from 0 to {MOST}")
        if isinstance(skip, bool) or not isinstance(skip, int) or skip < 0:
            raise InvalidLimit("skip is a whole number of at least 0")
        schema = resolve(schema)
        if mask is not None:
            schema = {"allOf": [schema, mask]}
        if permission is not None:
            schema = authorize(schema, permission)
        tree = parse(schema)
        found, kind = self.matching(contract_types(tree), tree, ids)
        return self._shaped(found, kind, tree, sort_by, sort_dir, skip, limit, links or {})

    def _shaped(self, found: DataFrame, kind, tree: Schema, sort_by, sort_dir, skip, limit, links) -> DataFrame:
        order = self.order(found, sort_by, sort_dir)
        bounded = limit is not None or skip
        if order or bounded:
            found = found.orderBy(*order, F.col("id"))
        if skip:
            found = found.offset(skip)
        if limit is not None:
            found = found.limit(limit)
        wanted: dict[str, list[Schema]] = {}
        for name, sub in links_of(tree):
            wanted.setdefault(name, []).append(sub)
        out = self.projection(found, kind, tree)
        if not wanted:
            return found.select(*out)
        lists = []
        for n, (name, subs) in enumerate(wanted.items()):
            verb = self.verb(kind, name)
            sub = subs[0] if len(subs) == 1 else Schema(None, {"anyOf": tuple(subs)})
            # The limit bounds the parents, so their keys can go to every task.
            parents = found.select(F.col("id").alias("__parent"), F.col(verb.source_column if verb.edges is None else "id").alias("__source"))
            lists.append((name, n, self._linked(verb, F.broadcast(parents) if limit is not None else parents, sub, links.get(name, {}), f"__l{n}", limit is not None)))
        keep = found.withColumn("__parent", F.col("id"))
        for _, _, x in lists:
            keep = keep.join(x, "__parent", "left")
        payloads = [F.coalesce(F.col(f"__l{n}"), F.array().cast(x.schema[f"__l{n}"].dataType)).alias(name) for name, n, x in lists]
        if order or bounded:
            keep = keep.orderBy(*order, F.col("id"))
        return keep.select(*out, F.struct(*payloads).alias("links"))

    def _linked(self, verb: Verb, parents: DataFrame, sub: Schema, options: dict, name: str, bounded: bool) -> DataFrame:
        """bounded: parents are few, so that what hangs below their children is looked for there only."""
        children, kind = self.targets(verb, sub)
        payload = F.struct(*(self.projection(children, kind, sub) or [F.lit(None).alias("id")]))
        order = self.order(children, options.get("sort_by"), options.get("sort_dir", "asc"))
        nested = dict.fromkeys(v for v, _ in links_of(sub))
        if nested:
            # Linked documents of linked documents: their lists are made first, for all children at once.
            payload = F.struct(*self.projection(children, kind, sub), F.col("__links").alias("links"))
            if bounded:
                children = below(verb, parents, children)
            children = self._with_links(children, kind, sub, options.get("links", {}), bounded)
        return expand(verb, parents, children, payload, order, options.get("skip", 0), options.get("limit"), name, bounded)

    def _with_links(self, found: DataFrame, kind, tree: Schema, links: dict, bounded: bool) -> DataFrame:
        out, payloads = found, []
        for n, (name, sub) in enumerate({v: s for v, s in links_of(tree)}.items()):
            verb = self.verb(kind, name)
            parents = found.select(F.col("id").alias("__parent"), F.col(verb.source_column if verb.edges is None else "id").alias("__source"))
            x = self._linked(verb, parents, sub, links.get(name, {}), f"__n{n}", bounded).withColumnRenamed("__parent", f"__p{n}")
            out = out.join(x, F.col("id") == F.col(f"__p{n}"), "left")
            payloads.append(F.coalesce(F.col(f"__n{n}"), F.array().cast(x.schema[f"__n{n}"].dataType)).alias(name))
        return out.withColumn("__links", F.struct(*payloads)).select(*found.columns, "__links")

    def profile(self, schema: Any, **options) -> dict[str, float]:
        """Seconds to compile a query, to run it, and the rows it gave."""
        began = time.perf_counter()
        df = self.query(schema, **options)
        compiled = time.perf_counter()
        rows = df.count()
        return {"compile_s": compiled - began, "query_s": time.perf_counter() - compiled, "rows": rows}

    # Lookups.

    def get_by_id(self, id_: Any, kind: str | None = None, permission: Any = None) -> DataFrame:
        """The document with an id, active or not; at most one row."""
        schema = {"type": "object", "required": ["id"], "properties": {"id": {"const": id_}, **({"type": {"const": kind}} if kind else {})}}
        return self.query(schema, limit=1, permission=permission)

    def get_many(self, ids: list | DataFrame, kind: str | None = None) -> DataFrame:
        """Documents with these ids, few in a list or any number in a column id; missing ones are left out, and no ids give no rows."""
        df, _ = self.source({kind} if kind else None)
        if isinstance(ids, DataFrame):
            return among(df, ids)
        return df.where(F.col("id").isin(ids)) if ids else df.where(F.lit(False))

    def get_by_slug(self, versioned: str, kind: str | None = None, permission: Any = None) -> DataFrame:
        """slug@version, or slug@latest: the newest release, or pre-release if there is no release."""
        slug, version = parse_slug(versioned)
        properties = {"slug": {"const": slug}, **({"type": {"const": kind}} if kind else {})}
        if version is not None:
            properties["version"] = {"const": str(version)}
        return self.query({"type": "object", "required": ["slug", "version"], "properties": properties}, sort_by="version", sort_dir="desc", limit=1, permission=permission)

    def one(self, df: DataFrame) -> dict | None:
        rows = df.limit(2).collect()
        if len(rows) > 1:
            raise BadResultSetSize("more than one document")
        return rows[0].asDict(True) if rows else None

    def cached(self, versioned: str, kind: str | None = None) -> dict | None:
        """get_by_slug through a small cache on the driver that also remembers what is missing."""
        key = (versioned, kind)
        if key not in self._found:
            if len(self._found) >= MOST:
                self._found.popitem(last=False)
            self._found[key] = self.one(self.get_by_slug(versioned, kind))
        self._found.move_to_end(key)
        return self._found[key]

    def forget(self) -> None:
        self._found.clear()
