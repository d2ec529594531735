"""Registered queries over a stored table with sessions and live queries: each writes the driver's tables to a store of its own,
changes some documents, and returns what the operator gave."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ElementAlreadyExists, NoLinkTarget, PermissionsError, SchemaMismatch, UnknownCardType
from ..kernel import ContractStore, Kernel, enveloped
from ..sources import builtin
from ..sources.layout import scratch
from ..sources.tables import contract, kind, load
from ..sources.types import TypeRegistry
from ..streaming import changes

QUERIES: dict = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str):
    def add(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return add


def kernel(spark: SparkSession) -> Kernel:
    return Kernel(ContractStore(spark, f"{scratch(spark, 'store')}/table"), TypeRegistry(builtin.types(), builtin.relationships()))


# Documents and their change log.


def renamed(customers: DataFrame) -> DataFrame:
    return customers.where("id % 10 = 0").withColumn("name", F.lit("new"))


@register("r01_change_log", "SELECT 0 AS version, c_custkey::VARCHAR AS id, 'insert' AS op, 'customer@1.0.0' AS type FROM customer UNION ALL SELECT 1, c_custkey::VARCHAR, 'update', 'customer@1.0.0' FROM customer WHERE c_custkey % 10 = 0")
def change_log(spark: SparkSession, d: str) -> DataFrame:
    contracts, customers = kernel(spark).contracts, load(spark, d, "customer")
    contracts.write(enveloped(customers))
    contracts.write(enveloped(renamed(customers)), "update")
    return contracts.changes().select("version", "id", "op", "type")


@register("s10_stored_state", "SELECT c_custkey::VARCHAR AS id, CASE WHEN c_custkey % 10 = 0 THEN 'new' ELSE c_name END AS name FROM customer")
def stored_state(spark: SparkSession, d: str) -> DataFrame:
    contracts, customers = kernel(spark).contracts, load(spark, d, "customer")
    contracts.write(enveloped(customers))
    contracts.compact()
    contracts.write(enveloped(renamed(customers)), "update")
    return contracts.now().select("id", "name")


@register("s16_reset", "SELECT n_nationkey::VARCHAR AS id, 'delete' AS op, FALSE AS there FROM nation")
def reset(spark: SparkSession, d: str) -> DataFrame:
    contracts = kernel(spark).contracts
    contracts.write(enveloped(load(spark, d, "nation")))
    contracts.reset()
    there = contracts.now().select(F.col("id").alias("__id"))
    return contracts.changes().where("op = 'delete'").join(there, F.col("id") == F.col("__id"), "left").select("id", "op", F.col("__id").isNotNull().alias("there"))


@register("s14_json_patch", "SELECT 'card-a' AS slug, '{\"l\":[1,2],\"m\":{\"x\":1},\"n\":5}' AS data")
def json_patch(spark: SparkSession, d: str) -> DataFrame:
    k = kernel(spark)
    k.insert({"type": "card", "slug": "card-a", "data": {"l": [1], "n": 4, "old": {"x": 1}}})
    k.patch("card-a@1.0.0", [{"op": "test", "path": "/data/n", "value": 4}, {"op": "replace", "path": "/data/n", "value": 5}, {"op": "add", "path": "/data/l/-", "value": 2}, {"op": "move", "from": "/data/old", "path": "/data/m"}])
    return k.contracts.now().select("slug", F.to_json("data").alias("data"))


@register("s07_remembered", "SELECT * FROM (VALUES (1, NULL), (2, 4), (3, 5)) v(step, n)")
def remembered(spark: SparkSession, d: str) -> DataFrame:
    """What a cached lookup gives before a document is written, after that, and after a change."""
    k, found = kernel(spark), []
    look = lambda: found.append((len(found) + 1, (k.remembered("card-a@latest") or {"data": {"n": None}})["data"]["n"]))
    look()
    k.insert({"type": "card", "slug": "card-a", "data": {"n": 4}})
    look()
    k.patch("card-a@1.0.0", [{"op": "replace", "path": "/data/n", "value": 5}])
    look()
    return spark.createDataFrame(found, "step int, n int")


@register("z05_write_authorization", "SELECT * FROM (VALUES ('card', 'written'), ('org', 'PermissionsError'), ('nothing', 'UnknownCardType'), ('role', 'SchemaMismatch'), ('again', 'ElementAlreadyExists'), ('link', 'NoLinkTarget')) v(what, outcome)")
def write_authorization(spark: SparkSession, d: str) -> DataFrame:
    k = kernel(spark)
    ann = k.insert({"type": "user", "slug": "user-ann", "data": {"roles": ["writer"]}})
    k.insert({"type": "role", "slug": "role-writer", "data": {"read": {"properties": {"type": {"enum": ["card@1.0.0", "link@1.0.0", "role@1.0.0"]}}}}})
    tries = {
        "card": {"type": "card", "slug": "card-a"},
        "org": {"type": "org", "slug": "org-a"},
        "nothing": {"type": "nothing", "slug": "x"},
        "role": {"type": "role", "slug": "role-a"},
        "again": {"type": "card", "slug": "card-a"},
        "link": {"type": "link", "slug": "link-a", "name": "is attached to", "data": {"inverseName": "has attached element", "from": {"id": "nowhere", "type": "card"}, "to": {"id": "nowhere", "type": "card"}}},
    }
    out = []
    for what, doc in tries.items():
        try:
            k.insert(doc, ann)
            out.append((what, "written"))
        except (ElementAlreadyExists, NoLinkTarget, PermissionsError, SchemaMismatch, UnknownCardType) as error:
            out.append((what, type(error).__name__))
    return spark.createDataFrame(out, "what string, outcome string")


# Live queries: a first batch of all documents, and a second one of what changed.

RICH = {"type": "object", "required": ["data"], "properties": {"type": {"const": kind("customer")}, "data": {"type": "object", "required": ["c_acctbal"], "properties": {"c_acctbal": {"type": "number", "minimum": 5000}}}}}


def changed_customers(spark: SparkSession, d: str) -> tuple[Kernel, DataFrame]:
    """A store of customers, and those that change: balances of every seventh double, of every fifth other one halve."""
    k, customers = kernel(spark), load(spark, d, "customer")
    k.contracts.write(enveloped(customers))
    factor = F.when(F.col("id") % 7 == 0, 2).when(F.col("id") % 5 == 0, 0.5)
    new = customers.withColumn("factor", factor).where("factor IS NOT NULL").withColumn("data", F.col("data").withField("c_acctbal", F.col("data.c_acctbal") * F.col("factor"))).drop("factor")
    return k, enveloped(new)


def second_batch(k: Kernel, query: changes.LiveQuery, new: DataFrame) -> DataFrame:
    """The events of the second batch."""
    query.process(k.contracts.changes().where("version = 0"), 0)
    k.contracts.write(new, "update")
    query.process(k.contracts.changes().where("version = 1"), 1)
    return k.contracts.spark.read.schema("id string, event string").parquet(f"{query.state}/events/1")


CHANGED_SQL = "SELECT c_custkey::VARCHAR AS id, c_acctbal >= 5000 AS b, c_acctbal * (CASE WHEN c_custkey % 7 = 0 THEN 2 ELSE 0.5 END) >= {} AS a FROM customer WHERE c_custkey % 7 = 0 OR c_custkey % 5 = 0"
EVENTS_SQL = "SELECT id, CASE WHEN a THEN 'update' ELSE 'unmatch' END AS event FROM ({}) WHERE a OR b"


@register("r03_live_query", EVENTS_SQL.format(CHANGED_SQL.format(5000)))
def live_query(spark: SparkSession, d: str) -> DataFrame:
    k, new = changed_customers(spark, d)
    return second_batch(k, k.live(RICH, scratch(spark, "live"), lambda df, batch: None), new)


@register("r10_set_schema", EVENTS_SQL.format(CHANGED_SQL.format(8000)))
def set_schema(spark: SparkSession, d: str) -> DataFrame:
    """What the first schema gave stays seen under the second one."""
    k, new = changed_customers(spark, d)
    query = k.live(RICH, scratch(spark, "live"), lambda df, batch: None)
    query.process(k.contracts.changes().where("version = 0"), 0)
    query.set_schema({"allOf": [RICH, {"properties": {"data": {"properties": {"c_acctbal": {"minimum": 8000}}}}}]})
    k.contracts.write(new, "update")
    query.process(k.contracts.changes().where("version = 1"), 1)
    return spark.read.schema("id string, event string").parquet(f"{query.state}/events/1")


@register("r09_dataset", "SELECT 'found' AS what, c_custkey::VARCHAR AS id FROM customer WHERE c_acctbal >= 5000 UNION ALL SELECT 'unmatch', c_custkey::VARCHAR FROM customer WHERE c_acctbal >= 5000 AND c_custkey % 7 <> 0 AND c_custkey % 5 = 0 AND c_acctbal * 0.5 < 5000")
def dataset(spark: SparkSession, d: str) -> DataFrame:
    """All that matches now, and what of it a later batch takes away."""
    k, new = changed_customers(spark, d)
    query = k.live(RICH, scratch(spark, "live"), lambda df, batch: None)
    query.dataset()
    found = query._seen(spark, 0).select(F.lit("found").alias("what"), "id")
    k.contracts.write(new, "update")
    query.process(k.contracts.changes().where("version = 1"), 0)
    gone = spark.read.schema("id string, event string").parquet(f"{query.state}/events/0").where("event = 'unmatch'")
    return found.unionByName(gone.select(F.col("event").alias("what"), "id"))


@register("r02_dispatch", "SELECT CASE WHEN c_acctbal >= 5000 THEN 'rich' ELSE 'poor' END AS name, c_custkey::VARCHAR AS id, 'insert' AS event FROM customer WHERE c_acctbal >= 5000 OR c_acctbal < 0")
def dispatch(spark: SparkSession, d: str) -> DataFrame:
    """One batch for two live queries."""
    k = kernel(spark)
    k.contracts.write(enveloped(load(spark, d, "customer")))
    poor = {"allOf": [{"properties": {"type": {"const": kind("customer")}, "data": {"required": ["c_acctbal"], "properties": {"c_acctbal": {"exclusiveMaximum": 0}}}}, "required": ["data"]}]}
    both = changes.Dispatcher()
    for name, schema in (("rich", RICH), ("poor", poor)):
        both.attach(name, k.live(schema, scratch(spark, name), lambda df, batch: None))
    both.process(k.contracts.changes(), 0)
    out = [spark.read.schema("id string, event string").parquet(f"{q.state}/events/0").select(F.lit(name).alias("name"), "id", "event") for name, q in both.queries.items()]
    return out[0].unionByName(out[1])


# Live queries over links: nations with rich customers.

HOSTS = {"type": "object", "properties": {"type": {"const": kind("nation")}}, "required": ["type"], "$$links": {"hosts": {"properties": {"type": {"const": kind("customer")}, "data": {"required": ["c_acctbal"], "properties": {"c_acctbal": {"minimum": 9000}}}}, "required": ["data"]}}}
HOSTED_SQL = "SELECT c_nationkey, bool_or({touched}) AS touched, bool_or(c_acctbal >= 9000) AS b, bool_or(c_acctbal >= 9000 AND NOT ({gone})) AS a FROM customer GROUP BY 1"
HOSTED_EVENTS_SQL = "SELECT 'n' || c_nationkey AS id, CASE WHEN a THEN 'update' ELSE 'unmatch' END AS event FROM ({}) WHERE touched AND (a OR b)"


def hosted(spark: SparkSession, d: str) -> tuple[Kernel, DataFrame, DataFrame]:
    """A store of nations, customers and their links; its customers and links."""
    k = kernel(spark)
    nations = load(spark, d, "nation").withColumn("id", F.concat(F.lit("n"), F.col("id").cast("string")))
    customers = load(spark, d, "customer")
    end = lambda id_, slug: F.struct(id_.alias("id"), F.lit(kind(slug)).alias("type"))
    ends = F.struct(F.lit("hosts").alias("inverseName"), end(F.col("c_custkey").cast("string"), "customer").alias("from"), end(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")), "nation").alias("to"))
    c = spark.read.parquet(f"{d}/customer.parquet")
    links = contract(c, "link", F.concat(F.lit("l"), F.col("c_custkey").cast("string")), F.lit("lives in"), data=ends)
    customers, links = enveloped(customers), enveloped(links)
    k.contracts.write(enveloped(nations).unionByName(customers).unionByName(links))
    return k, customers, links


@register("r07_removed_links", HOSTED_EVENTS_SQL.format(HOSTED_SQL.format(touched="c_custkey % 3 <> 0", gone="c_custkey % 3 <> 0")))
def removed_links(spark: SparkSession, d: str) -> DataFrame:
    k, _, links = hosted(spark, d)
    gone = links.where("substr(id, 2) % 3 <> 0").withColumn("active", F.lit(False))
    return second_batch(k, k.live(HOSTS, scratch(spark, "live"), lambda df, batch: None), gone)


@register("r08_inverse", HOSTED_EVENTS_SQL.format(HOSTED_SQL.format(touched="c_acctbal >= 9500", gone="c_acctbal >= 9500")))
def inverse(spark: SparkSession, d: str) -> DataFrame:
    """Customers become poor: the nations that host them are looked at."""
    k, customers, _ = hosted(spark, d)
    poor = customers.where(F.try_variant_get("data", "$.c_acctbal", "double") >= 9500).withColumn("data", F.parse_json(F.lit('{"c_acctbal": 0}')))
    return second_batch(k, k.live(HOSTS, scratch(spark, "live"), lambda df, batch: None), poor)


@register("r06_seen_set", "WITH r AS (SELECT DISTINCT c_nationkey AS n FROM customer WHERE c_acctbal >= 9000) SELECT 'n' || n AS root, 'n' || n AS id FROM r UNION ALL SELECT 'n' || n, 'l' || c_custkey FROM r JOIN customer ON c_nationkey = n UNION ALL SELECT 'n' || n, c_custkey::VARCHAR FROM r JOIN customer ON c_nationkey = n")
def seen_set(spark: SparkSession, d: str) -> DataFrame:
    """What the given nations depend on: themselves, their links and the customers behind them."""
    k, *_ = hosted(spark, d)
    query = k.live(HOSTS, scratch(spark, "live"), lambda df, batch: None)
    query.process(k.contracts.changes(), 0)
    return query._seen(spark, 1)
