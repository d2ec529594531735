"""Registered queries over the driver's tables, each with the SQL that gives the same rows.

A query's prefix names the keyword or operator it shows: K keywords, J links, L order and limits, P projection, S sources
and sinks, Z authorization, R changes, W windows, V views, D data layout.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..engine import Engine
from ..functions.merge import merged
from ..functions.versions import part
from ..operators import authorization, links, store
from ..operators.links import Verb
from ..operators.present import payloads
from ..operators.views import view_schema
from ..sources import layout
from ..sources.tables import contract, engine, kind, load
from ..streaming import changes
from . import live

QUERIES: dict = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def of(slug: str, data: dict | bool | None = None, required: bool = True, **root) -> dict:
    """A schema for documents of one type, with a schema for their data."""
    schema: dict = {"type": "object", **root, "properties": {"type": {"const": kind(slug)}} | root.get("properties", {})}
    if data is not None:
        schema["properties"]["data"] = data
        if required:
            schema["required"] = ["data", *root.get("required", ())]
    return schema


def props(_required: bool = True, **properties) -> dict:
    return {"type": "object", "properties": properties, **({"required": list(properties)} if _required else {})}


def run(spark: SparkSession, d: str, schema, *columns, **options) -> DataFrame:
    options.setdefault("limit", None)
    return engine(spark, d).query(schema, **options).select(*columns)


def simple(name: str, slug: str, data: dict, columns: list[str], sql: str) -> None:
    """A query that gives data columns of the matching documents."""
    register(name, sql)(lambda spark, d: run(spark, d, of(slug, data), *(f"data.{c}" for c in columns)))


# The flagship.

FLAGSHIP = of("customer", props(c_mktsegment={"const": "BUILDING"}, c_acctbal={"type": "number", "minimum": 5000}), **{"$$links": {"placed order": of("order", props(o_totalprice={"minimum": 300000}))}})


@register("flagship", "SELECT c_custkey AS id, c_name AS name, c_acctbal FROM customer c WHERE c_mktsegment = 'BUILDING' AND c_acctbal >= 5000 AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice >= 300000)")
def flagship(spark: SparkSession, d: str) -> DataFrame:
    return run(spark, d, FLAGSHIP, "id", "name", "data.c_acctbal")


# Keywords on typed columns.

register("k01_true_false", "SELECT n_nationkey AS id, n_name FROM nation WHERE n_nationkey < 5")(
    lambda spark, d: run(spark, d, of("nation", {"anyOf": [False, props(n_nationkey={"allOf": [True, {"exclusiveMaximum": 5}]})]}), "id", "data.n_name")
)
simple("k02_type", "customer", props(c_name={"type": "string"}, c_acctbal={"type": ["number", "null"]}, c_nationkey={"not": {"type": ["boolean", "array", "object"]}}), ["c_custkey"], "SELECT c_custkey FROM customer")
simple("k03_integer", "lineitem", props(l_quantity={"type": "integer", "minimum": 45}, l_extendedprice={"type": "integer"}), ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"], "SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem WHERE l_quantity >= 45 AND l_quantity = floor(l_quantity) AND l_extendedprice = floor(l_extendedprice)")
simple("k04_const", "orders"[:-1], props(o_orderstatus={"const": "P"}), ["o_orderkey", "o_totalprice"], "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'P'")
simple("k05_enum", "customer", props(c_mktsegment={"enum": ["BUILDING", "MACHINERY", 5, None]}), ["c_custkey", "c_mktsegment"], "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
simple("k06_minimum_maximum", "lineitem", props(l_quantity={"minimum": 10, "maximum": 12}, l_discount={"minimum": 0.05}), ["l_orderkey", "l_partkey", "l_quantity", "l_discount"], "SELECT l_orderkey, l_partkey, l_quantity, l_discount FROM lineitem WHERE l_quantity BETWEEN 10 AND 12 AND l_discount >= 0.05::DOUBLE")
simple("k07_exclusive_limits", "part", props(p_size={"exclusiveMinimum": 10, "exclusiveMaximum": 13}), ["p_partkey", "p_size"], "SELECT p_partkey, p_size FROM part WHERE p_size > 10 AND p_size < 13")
simple("k08_multiple_of", "part", props(p_size={"multipleOf": 7}, p_retailprice={"multipleOf": 0.05}), ["p_partkey", "p_size", "p_retailprice"], "SELECT p_partkey, p_size, p_retailprice FROM part WHERE p_size % 7 = 0 AND p_retailprice::DECIMAL(38,10) % 0.05::DECIMAL(38,10) = 0")
simple("k09_length", "part", props(p_name={"minLength": 9, "maxLength": 9}), ["p_partkey", "p_name"], "SELECT p_partkey, p_name FROM part WHERE length(p_name) = 9")
simple("k10_pattern", "customer", props(c_name={"pattern": "0[13]$"}), ["c_custkey", "c_name"], "SELECT c_custkey, c_name FROM customer WHERE regexp_matches(c_name, '0[13]$')")
simple("k11_regexp", "customer", props(c_mktsegment={"regexp": {"pattern": "^(buil|mach)", "flags": "i"}}), ["c_custkey"], "SELECT c_custkey FROM customer WHERE regexp_matches(c_mktsegment, '^(buil|mach)', 'i')")
simple("k12_format", "page", props(url={"format": "uri"}), ["page_id", "url"], r"SELECT page_id, url FROM pages WHERE regexp_full_match(url, '[A-Za-z][A-Za-z0-9+.-]*:([A-Za-z0-9._~:/?#@!$&()*+,;=\[\]''-]|%[0-9A-Fa-f]{2})+')")
simple("k13_format_limits", "order", props(o_orderdate={"format": "date-time", "formatMinimum": "1996-01-01T00:00:00Z", "formatMaximum": "1996-03-31 23:59:59.999+00"}), ["o_orderkey", "o_orderdate"], "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-03-31 23:59:59.999'")
register("k14_properties", "SELECT o_orderkey FROM orders WHERE o_orderpriority <> '1-URGENT' AND o_totalprice >= 400000")(
    lambda spark, d: run(spark, d, of("order", {"properties": {"o_orderpriority": {"not": {"const": "1-URGENT"}}, "absent": False, "o_totalprice": {"minimum": 400000}}}), "data.o_orderkey")
)
register("k15_required", "SELECT c_custkey FROM customer WHERE c_custkey % 2 = 1 AND c_acctbal > 9000")(
    lambda spark, d: sparse(spark, d).query(of("customer", {"type": "object", "required": ["even", "c_acctbal"], "properties": {"c_acctbal": {"exclusiveMinimum": 9000}}}), limit=None).select("data.c_custkey")
)
register("k15_required_missing", "SELECT 1::BIGINT AS id WHERE FALSE")(lambda spark, d: run(spark, d, of("nation", {"required": ["nowhere"]}), F.col("id").cast("long").alias("id")))
register("k14_optional", "SELECT c_custkey FROM customer WHERE c_acctbal > 9000 AND (c_custkey % 2 = 0 OR c_custkey % 4 = 1)")(
    lambda spark, d: sparse(spark, d).query(of("customer", {"properties": {"even": {"const": 1}, "c_acctbal": {"exclusiveMinimum": 9000}}}), limit=None).select("data.c_custkey")
)
simple("k16_additional_properties", "nation", {"additionalProperties": False, **props(n_name={"pattern": "A"}, n_nationkey=True)}, ["n_nationkey", "n_name"], "SELECT n_nationkey, n_name FROM nation WHERE n_name LIKE '%A%'")
register("k17_property_count", "SELECT c_custkey FROM customer WHERE c_custkey % 2 = 1")(
    lambda spark, d: sparse(spark, d).query(of("customer", {"minProperties": 3, "maxProperties": 3}), limit=None).select("data.c_custkey")
)


def sparse(spark: SparkSession, d: str) -> Engine:
    """Customers with a property `even` that every other one lacks: 1 or 3 by key."""
    df = spark.read.parquet(f"{d}/customer.parquet")
    even = F.when(F.col("c_custkey") % 2 == 1, F.col("c_custkey") % 4)
    return Engine(spark, {kind("customer"): contract(df, "customer", F.col("c_custkey"), data=F.struct("c_custkey", "c_acctbal", even.alias("even")))})


# Keywords on arrays: orders with their lines.

BASKET_SQL = "WITH b AS (SELECT l_orderkey AS id, list(l_quantity ORDER BY l_linenumber, l_partkey, l_quantity) AS q, list(l_returnflag ORDER BY l_linenumber, l_partkey, l_quantity) AS f, list({'quantity': l_quantity, 'flag': l_returnflag, 'part': l_partkey}) AS l FROM lineitem GROUP BY 1) "


def baskets(spark: SparkSession, d: str) -> Engine:
    line = F.struct("l_linenumber", "l_partkey", "l_quantity", "l_returnflag")
    lists = spark.read.parquet(f"{d}/lineitem.parquet").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("l"))
    lines = F.transform("l", lambda x: F.struct(x["l_quantity"].alias("quantity"), x["l_returnflag"].alias("flag"), x["l_partkey"].alias("part")))
    data = F.struct(F.col("l.l_quantity").alias("quantities"), F.col("l.l_returnflag").alias("flags"), lines.alias("lines"))
    return Engine(spark, {kind("basket"): contract(lists, "basket", F.col("l_orderkey"), data=data)}, [Verb("is order", kind("basket"), kind("order"))])


def basket(name: str, data: dict, where: str) -> None:
    register(name, BASKET_SQL + f"SELECT id FROM b WHERE {where}")(lambda spark, d: baskets(spark, d).query(of("basket", data), limit=None).select("id"))


basket("k18_item_count", props(quantities={"minItems": 4, "maxItems": 5}), "len(q) BETWEEN 4 AND 5")
basket("k19_items_tuple", props(quantities={"items": [{"minimum": 40}, {"maximum": 10}]}), "q[1] >= 40 AND (len(q) < 2 OR q[2] <= 10)")
basket("k19_items_tuple_closed", props(quantities={"items": [{"minimum": 40}, {"maximum": 10}], "additionalProperties": False}), "q[1] >= 40 AND (len(q) < 2 OR q[2] <= 10) AND len(q) <= 2")
basket("k20_items", props(quantities={"items": {"type": "number", "minimum": 20}}), "len(list_filter(q, lambda x: x < 20)) = 0")
basket("k21_contains", props(lines={"contains": props(quantity={"minimum": 49}, flag={"const": "R"})}), "len(list_filter(l, lambda x: x.quantity >= 49 AND x.flag = 'R')) > 0")
basket("k22_contains_const", props(flags={"contains": {"const": "A"}}), "list_contains(f, 'A')")
basket("k22_contains_const_mismatch", props(flags={"not": {"contains": {"const": 5}}}, quantities={"contains": {"const": 50}}), "list_contains(q, 50)")
basket("k23_contains_search", props(flags={"contains": {"type": "string", "fullTextSearch": {"term": "R"}}}), "list_contains(f, 'R')")

# Logic.

simple("k24_all_of", "part", {"allOf": [props(p_size={"minimum": 40}), props(p_brand={"pattern": "^Brand#1"}), True]}, ["p_partkey"], "SELECT p_partkey FROM part WHERE p_size >= 40 AND p_brand LIKE 'Brand#1%'")
simple("k25_any_of", "part", {"anyOf": [props(p_size={"const": 1}), {"anyOf": [props(p_size={"minimum": 50}), False]}]}, ["p_partkey", "p_size"], "SELECT p_partkey, p_size FROM part WHERE p_size = 1 OR p_size >= 50")
simple("k26_one_of", "part", {"oneOf": [props(p_size={"maximum": 10}), props(p_size={"minimum": 5}), props(p_size={"minimum": 48})]}, ["p_partkey", "p_size"], "SELECT p_partkey, p_size FROM part WHERE (p_size <= 10)::INT + (p_size >= 5)::INT + (p_size >= 48)::INT = 1")
simple("k27_not", "customer", {"not": props(c_mktsegment={"enum": ["BUILDING", "MACHINERY", "FURNITURE"]})}, ["c_custkey"], "SELECT c_custkey FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY', 'FURNITURE')")
simple("k28_if_then_else", "order", {"if": props(o_orderstatus={"const": "F"}), "then": props(o_totalprice={"minimum": 450000}), "else": props(o_totalprice={"maximum": 1500})}, ["o_orderkey"], "SELECT o_orderkey FROM orders WHERE CASE WHEN o_orderstatus = 'F' THEN o_totalprice >= 450000 ELSE o_totalprice <= 1500 END")
simple("k29_annotations", "nation", {"title": "t", "description": "d", "examples": [1], **props(n_regionkey={"const": 3, "title": "x"})}, ["n_nationkey"], "SELECT n_nationkey FROM nation WHERE n_regionkey = 3")
register("k30_links", "SELECT s_suppkey FROM supplier s WHERE EXISTS (SELECT 1 FROM nation n WHERE n.n_nationkey = s.s_nationkey AND n_regionkey = 2)")(
    lambda spark, d: run(spark, d, of("supplier", True, **{"$$links": {"is based in": of("nation", props(n_regionkey={"const": 2}))}}), "data.s_suppkey")
)
simple("k31_full_text_search", "document", props(text={"fullTextSearch": {"term": "license version"}}), ["doc_id"], "SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)\\blicens(e|es|ed|ing|er)\\b') AND regexp_matches(text, '(?i)\\bversions?\\b')")
register("k32_column_text", "SELECT o_orderkey AS id FROM orders WHERE regexp_matches(strftime(o_orderdate, '%Y-%m-%d'), '^1997-0[1-3]')")(
    lambda spark, d: run(spark, d, of("order", properties={"created_at": {"type": "string", "pattern": "^1997-0[1-3]"}}, required=["created_at"]), "id")
)
register("k33_extra_filter", "SELECT c_custkey AS id FROM customer WHERE c_acctbal >= 0 AND c_custkey IN (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'P')")(
    lambda spark, d: run(spark, d, of("customer", props(c_acctbal={"minimum": 0})), "id", ids=spark.read.parquet(f"{d}/orders.parquet").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("id")))
)

# Keywords on VARIANT.

register("v01_variant_minimum", "SELECT event_id AS id FROM events WHERE CAST(json_extract(props, '$.k') AS DOUBLE) >= 50")(
    lambda spark, d: run(spark, d, of("event", props(payload=props(k={"type": "number", "minimum": 50}))), "id")
)
MIXED = "CASE event_id % 6 WHEN 0 THEN '{\"k\":' || event_id % 100 || '}' WHEN 1 THEN '{\"k\":\"' || event_id % 100 || '\"}' WHEN 2 THEN '{\"k\":' || event_id % 100 || '.5}' WHEN 3 THEN '{\"k\":true}' WHEN 4 THEN '{\"k\":null}' ELSE '{\"a\":[1,\"x\",{\"b\":' || event_id % 7 || '}]}' END"


def mixed(spark: SparkSession, d: str) -> Engine:
    """Documents in which k is a number, a text, true, null or missing."""
    df = spark.read.parquet(f"{d}/events.parquet").select("event_id", F.parse_json(F.expr(MIXED)).alias("j"))
    return Engine(spark, {kind("mixed"): contract(df, "mixed", F.col("event_id"), data=F.col("j"))})


def variant(name: str, data: dict, where: str) -> None:
    register(name, f"SELECT event_id AS id FROM events WHERE {where}")(lambda spark, d: mixed(spark, d).query(of("mixed", data), limit=None).select("id"))


variant("v02_variant_guarded_type", props(k={"type": "number", "minimum": 50}), "event_id % 6 IN (0, 2) AND event_id % 100 >= 50")
variant("v03_variant_vacuous", {"required": ["k"], "properties": {"k": {"minimum": 50}}}, "event_id % 6 IN (1, 3, 4) OR (event_id % 6 IN (0, 2) AND event_id % 100 >= 50)")
variant("v04_variant_integer", props(k={"type": "integer"}), "event_id % 6 = 0")
variant("v05_variant_null", props(k={"type": "null"}), "event_id % 6 = 4")
variant("v06_variant_const", props(k={"enum": [10, "61", True]}), "(event_id % 6 = 0 AND event_id % 100 = 10) OR (event_id % 6 = 1 AND event_id % 100 = 61) OR event_id % 6 = 3")
variant("v07_variant_contains", props(a={"contains": props(b={"const": 3})}), "event_id % 6 = 5 AND event_id % 7 = 3")
variant("v08_variant_array_const", props(a={"const": [1, "x", {"b": 2}]}), "event_id % 6 = 5 AND event_id % 7 = 2")
variant("v09_variant_missing", {"not": {"required": ["k"]}}, "event_id % 6 = 5")
variant("v10_variant_sizes", props(a={"minItems": 3, "items": [{"type": "integer"}, {"minLength": 1}, {"maxProperties": 1}]}), "event_id % 6 = 5")
variant("v11_variant_string", props(k={"type": "string", "pattern": "^5"}), "event_id % 6 = 1 AND (event_id % 100)::VARCHAR LIKE '5%'")

# Links.

register("j01_links", "SELECT c_custkey AS id FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_totalprice >= 250000)")(
    lambda spark, d: run(spark, d, of("customer", **{"$$links": {"placed order": of("order", props(o_orderstatus={"const": "P"}, o_totalprice={"minimum": 250000}))}}), "id")
)
register("j02_inverse", "SELECT o_orderkey AS id FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_acctbal > 9500")(
    lambda spark, d: run(spark, d, of("order", **{"$$links": {"was placed by": of("customer", props(c_acctbal={"exclusiveMinimum": 9500}))}}), "id")
)
register("j03_link_in_any_of", "SELECT c_custkey AS id FROM customer WHERE c_acctbal > 9000 OR c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice >= 450000)")(
    lambda spark, d: run(spark, d, of("customer", anyOf=[{"properties": {"data": props(c_acctbal={"exclusiveMinimum": 9000})}}, {"$$links": {"placed order": of("order", props(o_totalprice={"minimum": 450000}))}}]), "id")
)
register("j04_link_in_not", "SELECT o_orderkey AS id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")(
    lambda spark, d: run(spark, d, of("order", **{"not": {"$$links": {"has line": True}}}), "id")
)
register("j05_nested_links", "SELECT r_regionkey AS id, r_name AS name FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 480000)))")(
    lambda spark, d: run(spark, d, of("region", **{"$$links": {"contains nation": of("nation", **{"$$links": {"has customer": of("customer", **{"$$links": {"placed order": of("order", props(o_totalprice={"exclusiveMinimum": 480000}))}})}})}}), "id", "name")
)
register("j06_link_in_items", BASKET_SQL + "SELECT id FROM b JOIN orders ON o_orderkey = id WHERE len(list_filter(q, lambda x: x >= 48)) > 0 AND o_orderstatus = 'F'")(
    lambda spark, d: with_orders(baskets(spark, d), spark, d).query(of("basket", props(quantities={"contains": {"minimum": 48, "$$links": {"is order": of("order", props(o_orderstatus={"const": "F"}))}}})), limit=None).select("id")
)
register("j06_link_in_all_of", "SELECT c_custkey AS id FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")(
    lambda spark, d: run(spark, d, of("customer", allOf=[{"$$links": {"lives in": of("nation", props(n_regionkey={"const": 1}))}}, {"$$links": {"placed order": of("order", props(o_orderstatus={"const": "P"}))}}]), "id")
)
register("j07_optional_links", "SELECT c_custkey AS id, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000) AS n_orders FROM customer")(
    lambda spark, d: run(spark, d, of("customer", anyOf=[{"$$links": {"placed order": of("order", props(o_totalprice={"exclusiveMinimum": 400000}))}}, True]), "id", F.size(F.col("links.`placed order`")).cast("long").alias("n_orders"))
)
register("j08_multiple_verbs", "SELECT n_nationkey AS id, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal > 0) AS n_customers, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 0) AS n_suppliers FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 0) AND n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 0)")(
    lambda spark, d: run(spark, d, of("nation", **{"$$links": {"has customer": of("customer", props(c_acctbal={"exclusiveMinimum": 0})), "has supplier": of("supplier", props(s_acctbal={"exclusiveMinimum": 0}))}}), "id", F.size(F.col("links.`has customer`")).cast("long").alias("n_customers"), F.size(F.col("links.`has supplier`")).cast("long").alias("n_suppliers"))
)
register("j09_same_verb_twice", "SELECT c_custkey AS id, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND (o_orderstatus = 'P' OR o_totalprice > 400000)) AS n_orders FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")(
    lambda spark, d: run(spark, d, of("customer", allOf=[{"$$links": {"placed order": of("order", props(o_orderstatus={"const": "P"}))}}, {"$$links": {"placed order": of("order", props(o_totalprice={"exclusiveMinimum": 400000}))}}]), "id", F.size(F.col("links.`placed order`")).cast("long").alias("n_orders"))
)
register("j10_linked_order_skip_limit", "SELECT c_custkey AS id, array_to_string(list_transform(list_sort(list({'n': n, 'k': o_orderkey})), lambda x: x.k), ',') AS orders FROM (SELECT c_custkey, o_orderkey, row_number() OVER (PARTITION BY c_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_acctbal > 8000) WHERE n BETWEEN 2 AND 4 GROUP BY 1")(
    lambda spark, d: run(spark, d, of("customer", props(c_acctbal={"exclusiveMinimum": 8000}), **{"$$links": {"placed order": of("order")}}), "id", F.array_join(F.transform(F.col("links.`placed order`"), lambda o: o["id"].cast("string")), ",").alias("orders"), links={"placed order": {"sort_by": ["data", "o_totalprice"], "sort_dir": "desc", "skip": 1, "limit": 3}}).where("orders <> ''")
)
register("j11_edge_table", "SELECT e.id, count(DISTINCT e.other) AS n FROM (SELECT c_nationkey AS id, c_custkey AS other FROM customer WHERE c_acctbal > 5000) e GROUP BY 1")(
    lambda spark, d: edge_engine(spark, d).query({"type": "object", "properties": {"type": {"const": kind("nation")}}, "$$links": {"hosts": of("customer", props(c_acctbal={"exclusiveMinimum": 5000}))}}, limit=None).select("id", F.size(F.col("links.hosts")).cast("long").alias("n"))
)
register("j17_illegal_links", "SELECT n_nationkey AS id FROM nation WHERE n_nationkey % 3 = 0")(
    lambda spark, d: links.illegal(
        spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").alias("id"), F.when(F.col("n_nationkey") % 3 == 0, "owns").otherwise("contains").alias("name"), F.lit("is in").alias("inverse_name"), F.lit("region@1.0.0").alias("from_type"), F.lit("nation@1.0.0").alias("to_type")),
        spark.createDataFrame([("is in", "contains", "nation", "*"), ("owns", "is owned by", "*", "*")], "name string, inverse_name string, from_type string, to_type string"),
    ).select("id")
)
register("j18_dangling_links", "SELECT o_orderkey AS id FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")(
    lambda spark, d: links.dangling(spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("from_id"), F.col("o_custkey").alias("to_id")), spark.read.parquet(f"{d}/customer.parquet").where("c_acctbal > 0").select(F.col("c_custkey").alias("id")))
    .select("id")
)
register("j19_membership", "SELECT DISTINCT c_mktsegment AS org FROM customer WHERE c_nationkey = 7")(
    lambda spark, d: Engine(spark, {kind("org"): orgs(spark, d), kind("nation"): load(spark, d, "nation")}, [Verb("has member", kind("org"), kind("nation"), edges=spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_mktsegment").alias("from_id"), F.col("c_nationkey").alias("to_id")))])
    .query(of("org", **{"$$links": {"has member": {"properties": {"id": {"const": 7}}}}}), limit=None)
    .select(F.col("id").alias("org"))
)


def orgs(spark: SparkSession, d: str) -> DataFrame:
    return contract(spark.read.parquet(f"{d}/customer.parquet").select("c_mktsegment").distinct(), "org", F.col("c_mktsegment"))


def with_orders(e: Engine, spark: SparkSession, d: str) -> Engine:
    e.tables = e.tables | {kind("order"): load(spark, d, "orders")}
    return e


def edge_engine(spark: SparkSession, d: str) -> Engine:
    """Nations and customers linked through link documents."""
    c = spark.read.parquet(f"{d}/customer.parquet")
    end = lambda column, slug: F.struct(F.col(column).cast("long").alias("id"), F.lit(kind(slug)).alias("type"))
    docs = c.select(F.col("c_custkey").alias("id"), F.lit("lives in").alias("name"), F.lit(True).alias("active"), F.lit("2024-01-01").cast("timestamp_ntz").alias("created_at"), F.struct(F.lit("hosts").alias("inverseName"), end("c_custkey", "customer").alias("from"), end("c_nationkey", "nation").alias("to")).alias("data"))
    return Engine(spark, {kind("nation"): load(spark, d, "nation"), kind("customer"): load(spark, d, "customer")}, edges=links.edges_of(docs))


# Order, skip, limit.


register("l01_sort_by_path", "SELECT c_custkey AS id, c_acctbal FROM customer ORDER BY c_acctbal, c_custkey LIMIT 20")(lambda spark, d: run(spark, d, of("customer"), "id", "data.c_acctbal", sort_by=["data", "c_acctbal"], limit=20))
register("l02_sort_nulls_last", "SELECT c_custkey FROM (SELECT c_custkey, CASE WHEN c_custkey % 2 = 1 THEN c_custkey % 4 END AS even FROM customer) ORDER BY even DESC NULLS LAST, c_custkey LIMIT 500")(
    lambda spark, d: sparse(spark, d).query(of("customer"), sort_by=["data", "even"], sort_dir="desc", limit=500).select("data.c_custkey")
)
VERSION_SQL = "(p_size % 3)::VARCHAR || '.' || (p_partkey % 11) || '.' || (p_partkey % 7) || CASE WHEN p_partkey % 4 = 0 THEN '-beta' WHEN p_partkey % 4 = 1 THEN '-alpha' ELSE '' END || CASE WHEN p_partkey % 5 = 0 THEN '+b1' ELSE '' END"


def versions(spark: SparkSession, d: str) -> Engine:
    p = spark.read.parquet(f"{d}/part.parquet").withColumn("v", F.expr(VERSION_SQL.replace("::VARCHAR", "").replace("(p_size % 3)", "cast(p_size % 3 as string)")))
    return Engine(spark, {kind("part"): contract(p, "part", F.col("p_partkey")).withColumn("version", F.col("data.v")).withColumn("slug", F.concat(F.lit("part-"), (F.col("id") % 10).cast("string")))})


register("l03_version_sort", f"SELECT p_partkey AS id, {VERSION_SQL} AS version FROM part ORDER BY CASE p_partkey % 4 WHEN 0 THEN 'beta' WHEN 1 THEN 'alpha' ELSE '' END, p_size % 3 DESC, p_partkey % 11 DESC, p_partkey % 7 DESC, CASE WHEN p_partkey % 5 = 0 THEN 'b1' ELSE '' END DESC, p_partkey LIMIT 30")(
    lambda spark, d: versions(spark, d).query(of("part"), sort_by="version", sort_dir="desc", limit=30).select("id", "version")
)
register("l04_json_value_sort", "SELECT event_id AS id FROM events ORDER BY CASE event_id % 6 WHEN 4 THEN 0 WHEN 1 THEN 1 WHEN 0 THEN 2 WHEN 2 THEN 2 WHEN 3 THEN 3 END NULLS LAST, CASE event_id % 6 WHEN 0 THEN event_id % 100 WHEN 2 THEN event_id % 100 + 0.5 END NULLS LAST, CASE event_id % 6 WHEN 1 THEN (event_id % 100)::VARCHAR END NULLS LAST, event_id LIMIT 1000")(
    lambda spark, d: mixed(spark, d).query(of("mixed"), sort_by=["data", "k"], limit=1000).select("id")
)
register("l05_limit", "SELECT o_orderkey AS id FROM orders ORDER BY o_orderkey LIMIT 1000")(lambda spark, d: run(spark, d, of("order"), "id", limit=1000))
register("l06_skip", "SELECT o_orderkey AS id FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 100")(lambda spark, d: run(spark, d, of("order"), "id", sort_by=["data", "o_totalprice"], sort_dir="desc", skip=100, limit=50))
register("l07_limit_after_links", "SELECT c_custkey AS id FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000) ORDER BY c_acctbal DESC, c_custkey LIMIT 10")(
    lambda spark, d: run(spark, d, of("customer", **{"$$links": {"placed order": of("order", props(o_totalprice={"exclusiveMinimum": 450000}))}}), "id", sort_by=["data", "c_acctbal"], sort_dir="desc", limit=10)
)
register("l08_limit_on_groups", "SELECT n_nationkey AS id, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS n FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer) ORDER BY n_nationkey LIMIT 5 OFFSET 2")(
    lambda spark, d: run(spark, d, of("nation", **{"$$links": {"has customer": of("customer")}}), "id", F.size(F.col("links.`has customer`")).cast("long").alias("n"), skip=2, limit=5)
)
register("l09_nested_link_options", "SELECT r.r_regionkey AS id, sum(least((SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey), 2)) ::BIGINT AS n FROM region r JOIN nation ON n_regionkey = r_regionkey WHERE n_nationkey IN (SELECT c_nationkey FROM customer) GROUP BY 1")(
    lambda spark, d: run(spark, d, of("region", **{"$$links": {"contains nation": of("nation", **{"$$links": {"has customer": of("customer")}})}}), "id", F.aggregate(F.col("links.`contains nation`"), F.lit(0).cast("long"), lambda a, n: a + F.size(n["links"]["has customer"])).alias("n"), links={"contains nation": {"links": {"has customer": {"sort_by": "name", "limit": 2}}}})
)
register("w01_row_number_per_parent", "SELECT o_custkey AS id, o_orderkey AS top FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n = 1")(
    lambda spark, d: run(spark, d, of("customer", **{"$$links": {"placed order": of("order")}}), "id", F.col("links.`placed order`")[0]["id"].alias("top"), links={"placed order": {"sort_by": ["data", "o_totalprice"], "sort_dir": "desc", "limit": 1}})
)

# Projection.

register("p01_select_all", "SELECT n_nationkey AS id, 'nation-' || n_nationkey AS slug, 'nation@1.0.0' AS type, '1.0.0' AS version, n_name AS name, n_regionkey FROM nation")(
    lambda spark, d: run(spark, d, of("nation"), "id", "slug", "type", "version", "name", "data.n_regionkey")
)
register("p02_explicit_select", "SELECT n_nationkey AS id, n_name AS name FROM nation")(lambda spark, d: run(spark, d, {"additionalProperties": False, "required": ["id", "name"], "properties": {"type": {"const": kind("nation")}}}, "*").drop("type"))
register("p03_nested_select", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING'")(
    lambda spark, d: run(spark, d, {"additionalProperties": False, "properties": {"type": {"const": kind("customer")}, "data": {"additionalProperties": False, "required": ["c_custkey"], "properties": {"c_mktsegment": {"const": "BUILDING"}}}}}, "data.*")
)
register("p04_branch_select", "SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal END AS c_acctbal, CASE WHEN c_mktsegment = 'MACHINERY' THEN c_name END AS c_name FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")(
    lambda spark, d: run(
        spark,
        d,
        of("customer", additionalProperties=False, data={"additionalProperties": False, "required": ["c_custkey"], "anyOf": [{"required": ["c_acctbal"], "properties": {"c_mktsegment": {"const": "BUILDING"}}}, {"required": ["c_name"], "properties": {"c_mktsegment": {"const": "MACHINERY"}}}]}),
        "data.c_custkey",
        "data.c_acctbal",
        "data.c_name",
    )
)
register("p07_authorized_select", "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'")(
    lambda spark, d: run(spark, d, of("customer", props(c_mktsegment={"const": "BUILDING"})), "data.*", permission={"additionalProperties": False, "properties": {"type": True, "data": {"additionalProperties": False, "properties": {"c_custkey": True}}}})
)
register("p08_linked_payload", "SELECT o_orderkey AS id, count(*) AS n_lines, min(l_linenumber) AS first_line, sum(l_quantity) AS quantity FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_totalprice > 400000 GROUP BY 1")(
    lambda spark, d: run(spark, d, of("order", props(o_totalprice={"exclusiveMinimum": 400000}), **{"$$links": {"has line": of("lineitem")}}), "id", F.col("links.`has line`").alias("l")).select("id", F.size("l").cast("long").alias("n_lines"), F.array_min("l.data.l_linenumber").alias("first_line"), F.aggregate("l.data.l_quantity", F.lit(0.0), lambda a, x: a + x).alias("quantity"))
)
register("p05_deep_merge", "SELECT event_id AS id, CASE WHEN event_id % 2 = 0 THEN CAST(json_extract(props, '$.k') AS BIGINT) ELSE event_id END AS k, event_id % 3 AS m FROM events")(
    lambda spark, d: spark.read.parquet(f"{d}/events.parquet").select("event_id", merged(F.when(F.col("event_id") % 2 == 0, F.parse_json("props")).otherwise(F.parse_json(F.lit("{}"))), F.parse_json(F.format_string('{"k":%d,"o":{"m":%d}}', F.col("event_id"), F.col("event_id") % 3))).alias("v"))
    .select(F.col("event_id").alias("id"), F.try_variant_get("v", "$.k", "bigint").alias("k"), F.try_variant_get("v", "$.o.m", "bigint").alias("m"))
)
register("p09_payloads", "SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%gZ') AS created, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) AS has_lines FROM orders WHERE o_totalprice > 300000")(
    lambda spark, d: payloads(run(spark, d, of("order", props(o_totalprice={"exclusiveMinimum": 300000}), anyOf=[{"$$links": {"has line": {"additionalProperties": False, "required": ["id"]}}}, True]), "id", "created_at", "links"))
    .select(F.get_json_object("payload", "$.id").cast("long").alias("id"), F.get_json_object("payload", "$.created_at").alias("created"), F.get_json_object("payload", "$.links['has line']").isNotNull().alias("has_lines"))
)
register("p10_mask", "SELECT c_custkey AS id FROM customer WHERE c_acctbal > 9000 AND c_nationkey = 3")(
    lambda spark, d: run(spark, d, of("customer", props(c_acctbal={"exclusiveMinimum": 9000})), "id", mask={"properties": {"data": props(c_nationkey={"const": 3})}})
)

# Sources and sinks.

register("s01_scan", "SELECT s_suppkey AS id, s_name AS name FROM supplier")(lambda spark, d: run(spark, d, of("supplier"), "id", "name"))
register("s02_get_by_id", "SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_custkey = 42")(lambda spark, d: engine(spark, d).get_by_id(42, kind("customer")).select("id", "name"))
register("s03_get_by_slug", f"SELECT p_partkey AS id FROM part WHERE p_partkey % 10 = 4 AND p_partkey % 4 NOT IN (0, 1) ORDER BY p_size % 3 DESC, p_partkey % 11 DESC, p_partkey % 7 DESC, CASE WHEN p_partkey % 5 = 0 THEN 'b1' ELSE '' END DESC, p_partkey LIMIT 1")(
    lambda spark, d: versions(spark, d).get_by_slug("part-4@latest", kind("part")).select("id")
)
register("s03_get_by_exact_slug", "SELECT c_custkey AS id FROM customer WHERE c_custkey = 7")(lambda spark, d: engine(spark, d).get_by_slug("customer-7@1.0.0", kind("customer")).select("id"))
register("s04_get_many", "SELECT o_orderkey AS id FROM orders WHERE o_orderkey IN (1, 2, 3, 5, 8, -1)")(lambda spark, d: engine(spark, d).get_many([1, 2, 3, 5, 8, -1], kind("order")).select("id"))
register("s04_get_many_from_table", "SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")(
    lambda spark, d: engine(spark, d).get_many(spark.read.parquet(f"{d}/orders.parquet").where("o_totalprice > 400000").select(F.col("o_custkey").alias("id")), kind("customer")).select("id", "name")
)
register("s05_authorized_get", "SELECT c_custkey AS id FROM customer WHERE c_custkey = 42 AND c_acctbal > -10000")(lambda spark, d: engine(spark, d).get_by_id(42, kind("customer"), {"properties": {"data": props(c_acctbal={"exclusiveMinimum": -10000})}}).select("id"))
register("s06_authorized_get_by_slug", "SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_custkey = 42 AND c_nationkey >= 0")(
    lambda spark, d: engine(spark, d).get_by_slug("customer-42@latest", kind("customer"), {"properties": {"data": props(c_nationkey={"minimum": 0})}}).select("id", "name")
)
register("s09_insert", "SELECT n_nationkey AS id, 'nation-' || n_nationkey AS slug, '1.0.0' AS version, n_name AS name FROM nation UNION ALL SELECT n_nationkey + 100, 'nation-' || (n_nationkey + 100), '1.0.0', 'new' FROM nation")(
    lambda spark, d: store.insert(*insertion(spark, d))
)


def insertion(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    now = load(spark, d, "nation").select("id", "slug", "version", "name")
    return now, now.select((F.col("id") + 100).alias("id"), F.concat(F.lit("nation-"), (F.col("id") + 100).cast("string")).alias("slug"), "version", F.lit("new").alias("name"))


register("s10_replace", "SELECT c_custkey AS id, CASE WHEN c_custkey % 10 = 0 THEN 'new' ELSE c_name END AS name, c_custkey % 10 = 0 AS updated FROM customer")(
    lambda spark, d: store.replace(*replacement(spark, d), "2024-01-01").select("id", "name", F.col("updated_at").isNotNull().alias("updated"))
)


def replacement(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    now = load(spark, d, "customer").select("id", "slug", "version", "type", "name", "created_at", F.lit(None).cast("timestamp_ntz").alias("updated_at"))
    new = now.where("id % 10 = 0").select(F.lit(-1).cast("long").alias("id"), "slug", "version", F.lit("other@1.0.0").alias("type"), F.lit("new").alias("name"))
    return now, new


def link_documents(spark: SparkSession, d: str) -> DataFrame:
    """Orders as links from customer to order; links of finished orders are inactive."""
    o = spark.read.parquet(f"{d}/orders.parquet")
    data = F.struct(F.lit("was placed by").alias("inverseName"), F.struct(F.col("o_custkey").alias("id")).alias("from"), F.struct((F.col("o_orderkey") + 10**9).alias("id")).alias("to"))
    return o.select(F.col("o_orderkey").alias("id"), F.lit("placed").alias("name"), (F.col("o_orderstatus") != "F").alias("active"), F.col("o_orderdate").alias("created_at"), data.alias("data"))


register("s11_edges", "SELECT o_orderkey AS link_id, TRUE AS forward, o_custkey AS from_id, 'placed' AS name, o_orderkey + 1000000000 AS to_id, o_orderdate AS created_at FROM orders WHERE o_orderstatus <> 'F' UNION ALL SELECT o_orderkey, FALSE, o_orderkey + 1000000000, 'was placed by', o_custkey, o_orderdate FROM orders WHERE o_orderstatus <> 'F'")(
    lambda spark, d: links.edges_of(link_documents(spark, d))
)
register("s12_linked_at", "SELECT o_custkey AS id, min(o_orderdate) AS placed FROM orders GROUP BY 1")(lambda spark, d: links.linked_at(link_documents(spark, d)).where("id < 1000000000").select("id", F.col("linked_at")["placed"].alias("placed")))
DERIVED_SQL = """WITH u AS (SELECT c_custkey, 'customer-' || c_custkey AS slug FROM customer),
k AS (SELECT c_custkey, 'user-settings-' || slug AS slug, 'user-settings@1.0.0' AS type, 'has settings' AS verb, 'are settings for' AS inverse, NULL AS hash FROM u
  UNION ALL SELECT c_custkey, 'authentication-password-' || slug, 'authentication-password@1.0.0', 'is authenticated with', 'authenticates', '$2b$x' FROM u WHERE c_custkey % 3 = 0
  UNION ALL SELECT c_custkey, 'authentication-oauth-' || slug, 'authentication-oauth@1.0.0', 'is authenticated with', 'authenticates', NULL FROM u WHERE c_custkey % 5 = 0)
SELECT sha256(slug) AS id, slug, type, NULL::VARCHAR AS name, hash, NULL::VARCHAR AS inverse, NULL::VARCHAR AS from_id, NULL::VARCHAR AS to_id FROM k
UNION ALL SELECT sha256('link-' || slug), 'link-' || slug, 'link@1.0.0', verb, NULL, inverse, c_custkey::VARCHAR, sha256(slug) FROM k"""


@register("s13_derived_documents", DERIVED_SQL)
def derived(spark: SparkSession, d: str) -> DataFrame:
    users = load(spark, d, "customer").withColumn("data", F.struct(F.when(F.col("id") % 3 == 0, "$2b$x").otherwise("PASSWORDLESS").alias("hash"), F.when(F.col("id") % 5 == 0, F.struct(F.lit("t").alias("token"))).alias("oauth")))
    get = lambda path: F.try_variant_get("data", path, "string")
    return store.derived_documents(users).select("id", "slug", "type", "name", get("$.hash").alias("hash"), get("$.inverseName").alias("inverse"), get("$.from.id").alias("from_id"), get("$.to.id").alias("to_id"))


register("s15_soft_delete", "SELECT c_custkey AS id, c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000) AS active FROM customer")(
    lambda spark, d: store.deactivate(load(spark, d, "customer").select("id", "active"), spark.read.parquet(f"{d}/orders.parquet").where("o_totalprice > 450000").select(F.col("o_custkey").alias("id")))
)

# Views and authorization.

VIEW = {"type": "view@1.0.0", "data": {"allOf": [{"name": "balance", "schema": {"properties": {"data": props(c_acctbal={"minimum": 0})}}}, {"name": "type", "schema": of("customer")}], "anyOf": [{"name": "a", "schema": {"properties": {"data": props(c_nationkey={"const": 1})}}}, {"name": "b", "schema": {"properties": {"data": props(c_mktsegment={"const": "FURNITURE"})}}}]}}
register("view_all_any", "SELECT c_custkey AS id FROM customer WHERE c_acctbal >= 0 AND (c_nationkey = 1 OR c_mktsegment = 'FURNITURE')")(lambda spark, d: run(spark, d, VIEW, "id"))
register("view_any", "SELECT n_nationkey AS id FROM nation WHERE n_nationkey = 1 OR n_name LIKE 'F%'")(
    lambda spark, d: run(spark, d, {"allOf": [of("nation"), view_schema({"data": {"anyOf": [{"schema": {"properties": {"id": {"const": 1}}}}, {"schema": {"properties": {"name": {"type": "string", "pattern": "^F"}}}}]}})]}, "id")
)
register("z01_roles", "SELECT c_custkey AS id FROM customer WHERE c_mktsegment = 'BUILDING' OR c_nationkey = 5")(
    lambda spark, d: run(spark, d, of("customer"), "id", permission=authorization.role_schema([{"properties": {"data": props(c_mktsegment={"const": "BUILDING"})}}, {"properties": {"data": props(c_nationkey={"const": 5})}}]))
)
register("z01_no_role", "SELECT 1::BIGINT AS id WHERE FALSE")(lambda spark, d: run(spark, d, of("customer"), "id", permission=authorization.role_schema([])))
MARKED_SQL = "SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN [] WHEN 1 THEN ['user-a'] WHEN 2 THEN ['org-x', 'user-a'] WHEN 3 THEN ['org-y+user-a'] ELSE ['org-y', 'user-a+org-x'] END AS m FROM customer"


def marked(spark: SparkSession, d: str) -> Engine:
    m = F.expr("CASE id % 5 WHEN 0 THEN array() WHEN 1 THEN array('user-a') WHEN 2 THEN array('org-x', 'user-a') WHEN 3 THEN array('org-y+user-a') ELSE array('org-y', 'user-a+org-x') END")
    return Engine(spark, {kind("customer"): load(spark, d, "customer").withColumn("markers", m.cast("array<string>")), kind("nation"): load(spark, d, "nation")}, [v for v in engine(spark, d).verbs.values()])


register("z02_markers", f"SELECT c_custkey AS id FROM ({MARKED_SQL}) WHERE c_custkey % 5 IN (0, 1, 2, 3)")(lambda spark, d: marked(spark, d).query(of("customer"), limit=None, permission=authorization.marker_schema("user-a", ["org-x"])).select("id"))
register("z02_markers_other", f"SELECT c_custkey AS id FROM ({MARKED_SQL}) WHERE c_custkey % 5 = 0")(lambda spark, d: marked(spark, d).query(of("customer"), limit=None, permission=authorization.marker_schema("user-b", ["org-x"])).select("id"))
register("z03_scope", "SELECT c_custkey AS id FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 3")(
    lambda spark, d: run(spark, d, of("customer"), "id", permission=authorization.permission({"slug": authorization.ADMIN, "nation": 3}, [{"properties": {"data": props(c_nationkey={"const": {"$eval": "user.nation"}})}}], [], {"properties": {"data": props(c_mktsegment={"const": "BUILDING"})}}))
)
register("z04_authorized_links", "SELECT n_nationkey AS id, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey AND c_custkey % 5 = 0) AS n FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_custkey % 5 = 0)")(
    lambda spark, d: marked(spark, d).query(of("nation", **{"$$links": {"has customer": of("customer")}}), limit=None, permission=authorization.marker_schema("user-b", [])).select("id", F.size(F.col("links.`has customer`")).cast("long").alias("n"))
)

# Changes.

register("r05_classify_snapshots", "SELECT event, count(*) AS n FROM (SELECT CASE WHEN NOT b AND a THEN 'insert' WHEN b AND gone THEN 'delete' WHEN b AND NOT a THEN 'unmatch' WHEN b AND k % 7 = 0 THEN 'update' END AS event FROM (SELECT o_orderkey AS k, o_totalprice > 200000 AS b, o_orderkey % 11 = 0 AS gone, o_totalprice * (CASE WHEN o_orderkey % 7 = 0 THEN 2 WHEN o_orderkey % 5 = 0 THEN 0.5 ELSE 1 END) > 200000 AND o_orderkey % 11 <> 0 AS a FROM orders)) WHERE event IS NOT NULL GROUP BY 1")(
    lambda spark, d: snapshots(spark, d).groupBy("event").agg(F.count("*").alias("n"))
)


def snapshots(spark: SparkSession, d: str) -> DataFrame:
    """Orders above 200000 before and after some have doubled, halved or gone."""
    o = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("p"))
    factor = F.when(F.col("id") % 7 == 0, 2).when(F.col("id") % 5 == 0, 0.5).otherwise(1)
    before = o.where("p > 200000").select("id", F.lit(0).alias("fingerprint"))
    after = o.where("id % 11 <> 0").withColumn("p", F.col("p") * factor).select("id", F.when(F.col("id") % 7 == 0, 1).otherwise(0).alias("fingerprint"), F.lit(True).alias("present"), (F.col("p") > 200000).alias("matches"))
    return changes.compare(before, after)


@register("r04_prefiltered_changes", "SELECT event_id AS id, CASE WHEN event_type = 'error' THEN 'delete' WHEN event_id % 3 = 0 AND value >= 50 THEN 'update' WHEN event_id % 3 = 0 THEN 'unmatch' WHEN value >= 50 THEN 'insert' END AS event FROM events WHERE event_type IN ('click', 'error') AND NOT (event_type = 'error' AND event_id % 3 <> 0) AND NOT (event_type = 'click' AND event_id % 3 <> 0 AND (value < 50 OR value IS NULL))")
def prefiltered_changes(spark: SparkSession, d: str) -> DataFrame:
    log = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("id"), "value", F.concat("event_type", F.lit("@1.0.0")).alias("type"))
    found = changes.prefiltered(log, {"properties": {"type": {"enum": ["click@1.0.0", "error@1.0.0"]}, "data": props(value={"minimum": 50})}})
    event = changes.classified(F.col("id") % 3 == 0, F.coalesce(F.col("value") >= 50, F.lit(False)), F.when(F.col("type") == "error@1.0.0", "delete").otherwise("insert"))
    return found.select("id", event.alias("event")).where("event IS NOT NULL")


# Layout.

register("d03_stored_lexemes", "SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)\\blicens(e|es|ed|ing|er)\\b')")(
    lambda spark, d: layout.with_lexemes(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"), "text").where(layout.holds("lexemes", "licensed")).select("doc_id")
)

register("d01_version_parts", f"SELECT p_partkey AS id, p_size % 3 AS major, (p_partkey % 11)::INT AS minor, CASE p_partkey % 4 WHEN 0 THEN 'beta' WHEN 1 THEN 'alpha' ELSE '' END AS prerelease FROM part")(
    lambda spark, d: versions(spark, d).query(of("part"), limit=None).select("id", *(part(F.col("version"), p).alias(p) for p in ("major", "minor", "prerelease")))
)
register("d01_types_apart", "SELECT 'customer-' || c_custkey AS slug, c_acctbal AS balance FROM customer WHERE c_acctbal > 5000 UNION ALL SELECT 'supplier-' || s_suppkey, s_acctbal FROM supplier WHERE s_acctbal > 5000")(
    lambda spark, d: stored_types(spark, d).where(F.col("type").isin(kind("customer"), kind("supplier")) & (F.col("data.balance") > 5000)).select("slug", "data.balance")
)
register("d02_indexed_path", "SELECT 'customer-' || c_custkey AS slug FROM customer WHERE c_acctbal BETWEEN 100 AND 900")(
    lambda spark, d: stored_types(spark, d).where((F.col("type") == kind("customer")) & F.col("data.balance").between(100, 900)).select("slug")
)
register("d04_stored_edges", "SELECT n_nationkey AS id, count(*) AS n FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")(
    lambda spark, d: stored_edges(spark, d).join(load(spark, d, "nation").select("id"), F.col("from_id") == F.col("id")).where("name = 'hosts'").groupBy("id").agg(F.count("*").alias("n"))
)


def stored_types(spark: SparkSession, d: str) -> DataFrame:
    """Customers and suppliers in one table, partitioned by type and sorted by balance."""
    each = [load(spark, d, t).select("id", "slug", "type", F.struct(F.col(f"data.{c}").alias("balance")).alias("data")) for t, c in (("customer", "c_acctbal"), ("supplier", "s_acctbal"))]
    path = f"{layout.scratch(spark, 'types')}/contracts"
    layout.write_contracts(each[0].unionByName(each[1]), path, ["data.balance"])
    return spark.read.parquet(path)


def stored_edges(spark: SparkSession, d: str) -> DataFrame:
    path = layout.scratch(spark, "edges")
    table = path.rsplit("/", 1)[1].replace("-", "_")
    layout.write_edges(edge_engine(spark, d).edges, table, 8, f"{path}/edges")
    return spark.table(table)


# Whole numbers that share a double, and formats.

LARGE = 1 << 53


def large(name: str, keyword: dict, where: str) -> None:
    def query(spark: SparkSession, d: str) -> DataFrame:
        text = F.concat(F.lit('{"n":'), (F.col("event_id") % 3 + LARGE).cast("string"), F.lit("}"))
        table = contract(spark.read.parquet(f"{d}/events.parquet").select("event_id"), "large", F.col("event_id"), data=F.parse_json(text))
        return Engine(spark, {kind("large"): table}).query(of("large", props(n=keyword)), limit=None).select("id")

    register(name, f"SELECT event_id AS id FROM events WHERE {where}")(query)


large("k04_const_large", {"const": LARGE + 1}, "event_id % 3 = 1")
large("k05_enum_large", {"enum": [LARGE + 1, LARGE + 2, "x"]}, "event_id % 3 IN (1, 2)")
large("k06_minimum_maximum_large", {"minimum": LARGE + 1, "maximum": LARGE + 1}, "event_id % 3 = 1")
large("k07_exclusive_limits_large", {"exclusiveMinimum": LARGE, "exclusiveMaximum": LARGE + 2}, "event_id % 3 = 1")

#: By format, texts that are of it and texts that are not.
FORMAT_TEXTS = {
    "date-time": (["2024-02-29T12:00:00Z", "2024-01-02 03:04:05.678+01:00"], ["2024-13-01T00:00:00Z", "2024-01-02"]),
    "date": (["2024-02-29"], ["2024-2-9", "2024-02-32"]),
    "time": (["12:00:00Z", "23:59:60.5+01:00"], ["24:00:00Z", "1:2:3"]),
    "email": (["a.b+c@example.org"], ["a@", "@b", "a b@c"]),
    "hostname": (["example.org", "a-b.c"], ["-a.b", "a..b"]),
    "ipv4": (["0.0.0.0", "255.1.20.3"], ["256.1.1.1", "1.2.3"]),
    "ipv6": (["::1", "2001:db8::8a2e:370:7334", "::ffff:1.2.3.4"], ["1::2::3", "12345::"]),
    "uri-reference": (["/a/b?c#d", "http://x.y"], ["a b", "\\"]),
    "uri-template": (["/a/{b}{?c,d:3,e*}", "{+x.y}"], ["/a/{b", "{?c,}"]),
    "json-pointer": (["", "/a~0b/c~1d"], ["a", "/~2"]),
    "uuid": (["6ba7b810-9dad-4bd1-80b4-00c04fd430c8"], ["6ba7b810-9dad-11d1-80b4-00c04fd430c8"]),
}


def _format_rows() -> str:
    """Texts that are of their format, as SQL."""
    rows = [(f, t) for f, (good, _) in FORMAT_TEXTS.items() for t in good]
    return "SELECT * FROM (VALUES " + ", ".join("('{}', '{}')".format(f, t.replace("'", "''")) for f, t in rows) + ") v(format, text)"


@register("k12_formats", _format_rows())
def formats(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for f, (good, bad) in FORMAT_TEXTS.items():
        table = spark.createDataFrame([(i, t) for i, t in enumerate([*good, *bad])], "n long, text string")
        e = Engine(spark, {kind("text"): contract(table, "text", F.col("n"), data=F.struct("text"))})
        found = e.query(of("text", props(text={"format": f})), limit=None).select(F.lit(f).alias("format"), "data.text")
        out = found if out is None else out.unionByName(found)
    return out


@lru_cache(maxsize=1)
def queries() -> dict:
    return QUERIES | live.QUERIES


def oracle_sql() -> dict[str, str]:
    return SQL | live.SQL
