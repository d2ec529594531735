"""The driver's tables as contracts: typed data, native keys, and links along their key columns."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..engine import Engine
from ..operators.links import Verb

#: Table: type slug, key, name column.
TABLES = {
    "region": ("region", "r_regionkey", "r_name"),
    "nation": ("nation", "n_nationkey", "n_name"),
    "customer": ("customer", "c_custkey", "c_name"),
    "supplier": ("supplier", "s_suppkey", "s_name"),
    "part": ("part", "p_partkey", "p_name"),
    "orders": ("order", "o_orderkey", None),
    "lineitem": ("lineitem", None, None),
    "events": ("event", "event_id", "event_type"),
    "documents": ("document", "doc_id", None),
    "labels": ("label", "doc_id", None),
    "pages": ("page", "page_id", "url"),
    "benchmark": ("benchmark", "item_id", None),
    "conversations": ("message", None, "role"),
    "embeddings": ("embedding", "vec_id", None),
}
CREATED = {"orders": "o_orderdate", "lineitem": "l_shipdate", "events": "ts"}
#: (source, verb, target, source key, target key) and the inverse verb.
LINKS = [
    ("nation", "is in", "region", "data.n_regionkey", "id", "contains nation"),
    ("customer", "lives in", "nation", "data.c_nationkey", "id", "has customer"),
    ("supplier", "is based in", "nation", "data.s_nationkey", "id", "has supplier"),
    ("order", "was placed by", "customer", "data.o_custkey", "id", "placed order"),
    ("lineitem", "is part of", "order", "data.l_orderkey", "id", "has line"),
    ("lineitem", "refers to", "part", "data.l_partkey", "id", "is sold in"),
    ("lineitem", "is supplied by", "supplier", "data.l_suppkey", "id", "supplies"),
    ("label", "is attached to", "document", "id", "id", "has label"),
]
VERSION = "1.0.0"


def kind(slug: str) -> str:
    return f"{slug}@{VERSION}"


def contract(df: DataFrame, slug: str, id_: Column, name: Column | None = None, created: Column | None = None, data: Column | None = None) -> DataFrame:
    """Rows in the envelope; columns that a query does not touch are pruned away."""
    none = F.array().cast("array<string>")
    return df.select(
        id_.alias("id"),
        F.concat(F.lit(f"{slug}-"), id_.cast("string")).alias("slug"),
        F.lit(kind(slug)).alias("type"),
        F.lit(VERSION).alias("version"),
        F.lit(True).alias("active"),
        (name if name is not None else F.lit(None)).cast("string").alias("name"),
        none.alias("tags"),
        none.alias("markers"),
        (created if created is not None else F.lit(None)).cast("timestamp_ntz").alias("created_at"),
        (data if data is not None else F.struct(*df.columns)).alias("data"),
    )


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    slug, key, name = TABLES[table]
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    if table == "conversations":
        id_ = F.concat_ws("-", "conv_id", "turn")
    elif key is None:  # no unique key: the whole row is the identity
        id_ = F.concat(F.hex(F.xxhash64(*df.columns)), F.hex(F.xxhash64(F.lit(1), *df.columns)))
    else:
        id_ = F.col(key)
    data = None
    if table == "events":
        data = F.struct(F.col("ts").alias("timestamp"), F.col("user_id").alias("actor"), "event_type", "value", F.parse_json("props").alias("payload"))
    return contract(df, slug, id_, F.col(name) if name else None, F.col(CREATED[table]) if table in CREATED else None, data)


def verbs() -> list[Verb]:
    out = []
    for source, name, target, source_key, target_key, inverse in LINKS:
        a, b = kind(source), kind(target)
        out += [Verb(name, a, b, source_key, target_key), Verb(inverse, b, a, target_key, source_key)]
    return out


@lru_cache(maxsize=8)
def engine(spark: SparkSession, sf_dir: str) -> Engine:
    return Engine(spark, {kind(slug): load(spark, sf_dir, table) for table, (slug, _, _) in TABLES.items()}, verbs())


def store_variant(df: DataFrame, path: str, column: str = "data") -> DataFrame:
    """df with a JSON text column stored once as shredded VARIANT, so that later reads of paths and filters reach the scan."""
    df.withColumn(column, F.parse_json(column)).write.parquet(path)
    return df.sparkSession.read.parquet(path)
