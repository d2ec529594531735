"""Links between documents: edge tables, link predicates and linked documents in results."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Verb:
    """How a verb leads from a source type to a target type.

    Either along an edge table (from_id, to_id), or directly where a column of one side holds the key of the other: then
    no edge table is read at all.
    """

    name: str
    source: str
    target: str
    source_column: str = "id"
    target_column: str = "id"
    edges: DataFrame | None = None


def edges_of(links: DataFrame) -> DataFrame:
    """Both directions of all active links: (link_id, forward, from_id, name, to_id, created_at).

    links: id, name, active, created_at, data{inverseName, from{id}, to{id}}.
    """
    ways = F.array(
        F.struct(F.lit(True).alias("forward"), F.col("data.from.id").alias("from_id"), F.col("name"), F.col("data.to.id").alias("to_id")),
        F.struct(F.lit(False).alias("forward"), F.col("data.to.id").alias("from_id"), F.col("data.inverseName").alias("name"), F.col("data.from.id").alias("to_id")),
    )
    return links.where("active").select(F.col("id").alias("link_id"), "created_at", F.explode(ways).alias("e")).select("link_id", "e.*", "created_at")


def linked_at(links: DataFrame) -> DataFrame:
    """(id, linked_at): the time of the first link of each verb, by document; removed links count, as a time once set stays."""
    first = edges_of(links.withColumn("active", F.lit(True))).groupBy("from_id", "name").agg(F.min("created_at").alias("at"))
    return first.groupBy(F.col("from_id").alias("id")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "at")))).alias("linked_at"))


def reachable(verb: Verb, children: DataFrame) -> tuple[DataFrame, str]:
    """(keys of sources that have a child, named __key) and the source column they match."""
    if verb.edges is None:
        return children.select(F.col(verb.target_column).alias("__key")), verb.source_column
    e = verb.edges.select(F.col("from_id").alias("__key"), F.col("to_id").alias("__to"))
    c = children.select(F.col("id").alias("__id"))
    return e.join(c, F.col("__to") == F.col("__id")).select("__key"), "id"


def exists(keys: DataFrame, outer: str) -> Column:
    """EXISTS over reachable(): Catalyst makes it a semi, anti or existence join, as its place in the predicate asks.

    outer names a column of the other side; it must not occur below keys.
    """
    return keys.where(F.col("__key") == F.col(outer).outer()).exists()


def expand(verb: Verb, parents: DataFrame, children: DataFrame, payload: Column, order: list[Column], skip: int, limit: int | None, name: str, bounded: bool = False) -> DataFrame:
    """(__parent, name): for each parent its children's payloads in order, from skip on, at most limit; by id without an order.

    parents: __parent (unique) and __source, what the verb matches.  Each (parent, child) counts once.
    bounded: parents are few and broadcast, or children are those of a few already.
    """
    if verb.edges is None:
        children = children.withColumn("__match", F.col(verb.target_column))
        if not bounded:
            # Catalyst moves an EXISTS below the envelope: of children without a parent the stored columns alone are shuffled.
            children = children.where(exists(parents.select(F.col("__source").alias("__key")), "__match"))
        kids = children.withColumn("__payload", payload)
        if not bounded and verb.source_column == "id" and kids.schema["__match"].dataType == parents.schema["__parent"].dataType:
            # What a child holds is its parent's id.
            pairs = kids.withColumn("__parent", F.col("__match"))
        else:
            pairs = parents.join(kids, F.col("__source") == F.col("__match"))
    else:
        kids = children.withColumn("__payload", payload)
        e = verb.edges.select(F.col("from_id").alias("__from"), F.col("to_id").alias("__to")).distinct()
        pairs = parents.join(e, F.col("__source") == F.col("__from")).join(kids, F.col("__to") == F.col("id"))
    if order or skip or limit is not None:
        ranked = pairs.withColumn("__seq", F.row_number().over(Window.partitionBy("__parent").orderBy(*order, F.col("id"))))
        pairs = ranked.where(F.col("__seq") > skip)
        if limit is not None:
            pairs = pairs.where(F.col("__seq") <= skip + limit)
    else:
        # Nothing to rank: the lists are put in order when they are made.
        pairs = pairs.withColumn("__seq", F.col("id"))
    by_place = lambda a, b: F.when(a["__seq"] < b["__seq"], -1).when(a["__seq"] > b["__seq"], 1).otherwise(0)
    lists = F.collect_list(F.struct("__seq", "__payload"))
    # Payloads that cannot be ordered (VARIANT, maps) are compared by place alone.
    lists = F.array_sort(lists) if orderable(pairs.schema["__payload"].dataType) else F.array_sort(lists, by_place)
    return pairs.groupBy("__parent").agg(lists.alias("__all")).select("__parent", F.col("__all.__payload").alias(name))


def below(verb: Verb, parents: DataFrame, children: DataFrame) -> DataFrame:
    """The children that a verb leads to from parents (__source), a few."""
    keys = parents.select(F.col("__source").alias("__up"))
    if verb.edges is None:
        return children.join(F.broadcast(keys), F.col(verb.target_column) == F.col("__up"), "left_semi")
    ends = verb.edges.join(F.broadcast(keys), F.col("from_id") == F.col("__up"), "left_semi").select(F.col("to_id").alias("__to"))
    return children.join(ends, F.col("id") == F.col("__to"), "left_semi")


def orderable(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return all(orderable(f.dataType) for f in kind)
    if isinstance(kind, T.ArrayType):
        return orderable(kind.elementType)
    return not isinstance(kind, T.VariantType | T.MapType)


def illegal(links: DataFrame, relationships: DataFrame) -> DataFrame:
    """Links that no relationship allows, in either direction.

    links: id, name, inverse_name, from_type, to_type (slug@version); relationships: name, inverse_name, from_type,
    to_type, each type versioned, bare or *.
    """
    r = relationships.select(F.col("name").alias("r_name"), F.col("inverse_name").alias("r_inverse"), F.col("from_type").alias("r_from"), F.col("to_type").alias("r_to"))
    both = r.unionByName(r.select(F.col("r_inverse").alias("r_name"), F.col("r_name").alias("r_inverse"), F.col("r_to").alias("r_from"), F.col("r_from").alias("r_to")))
    fits = lambda own, rule: (F.col(rule) == "*") | (F.col(rule) == F.col(own)) | (F.col(rule) == F.substring_index(F.col(own), "@", 1))
    return links.join(both, (F.col("name") == F.col("r_name")) & (F.col("inverse_name") == F.col("r_inverse")) & fits("from_type", "r_from") & fits("to_type", "r_to"), "left_anti")


def dangling(links: DataFrame, contracts: DataFrame) -> DataFrame:
    """Links of which an end is not among contracts (id)."""
    ids = contracts.select(F.col("id").alias("__id"))
    ok = links.join(ids, F.col("from_id") == F.col("__id"), "left_semi").join(ids, F.col("to_id") == F.col("__id"), "left_semi")
    return links.join(ok.select(F.col("id").alias("__ok")), F.col("id") == F.col("__ok"), "left_anti")
