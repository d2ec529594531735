"""Exact dedup with a heavy-hitter split.

Misra-Gries summaries (one per partition, merged in a tree) name every digest that more than n / (counters + 1) rows can
share.  Those few candidates are counted exactly with map-side combine, and the verified winners - at most `counters`
rows - are broadcast, so that rows of huge groups get their answer without a shuffle.  All other digests meet in an
ordinary shuffle, where no group is larger than n / (counters + 1).
"""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, one_of_each

#: ASCII white space [\x20\x09-\x0D].
SPACES = " \t\n\x0b\x0c\r"
COUNTERS = 256
FAN_IN = 32


def shrink(counts: pd.Series, counters: int) -> pd.Series:
    """The Misra-Gries step: subtract the (counters + 1)-th largest count and keep what stays positive."""
    if len(counts) <= counters:
        return counts
    counts = counts - counts.nlargest(counters + 1).iloc[-1]
    return counts[counts > 0]


def heavy_candidates(digests: DataFrame, column: str, counters: int = COUNTERS, fan_in: int = FAN_IN) -> DataFrame:
    """(column, low): at most `counters` values, among them every one that over n / (counters + 1) rows hold; low bounds its count from below."""

    def local(batches):
        held = pd.Series(dtype="int64")
        for b in batches:
            values = pa.array(b.column(0)).value_counts()
            new = pd.Series(values.field("counts").to_numpy(), index=values.field("values").to_pylist(), dtype="int64")
            held = shrink(held.add(new, fill_value=0).astype("int64"), counters)
        yield pa.RecordBatch.from_arrays([pa.array(held.index.tolist(), pa.binary()), pa.array(held.to_numpy(), pa.int64()), pa.array([TaskContext.get().partitionId()] * len(held), pa.int64())], names=["digest", "low", "part"])

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        held = shrink(pdf.groupby("digest")["low"].sum(), counters)
        return pd.DataFrame({"digest": held.index, "low": held.to_numpy(), "part": int(pdf["part"].iloc[0]) // fan_in})

    schema = "digest binary, low long, part long"
    parts = digests.rdd.getNumPartitions()
    out = digests.select(column).mapInArrow(local, schema)
    while parts > 1:
        out = out.groupBy((F.col("part") / fan_in).cast("long").alias("g")).applyInPandas(merge, schema)
        parts = -(-parts // fan_in)
    return out.select(F.col("digest").alias(column), "low")


def normalised(text) -> F.Column:
    return F.translate(F.coalesce(F.col(text), F.lit("")), SPACES, "")


def decide(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """One row per row of df: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without ASCII white space; null counts as empty.  Of equal texts the row with the most
    code points stays, then the smallest id; a null id loses to any other.  Rows that repeat an id and a text share one
    answer.  An empty table gives no rows; other columns are not looked at.
    """
    rows = cut(df.select(F.col(id_col).alias("doc_id"), F.unhex(F.sha2(normalised(text_col), 256)).alias("digest"), F.length(F.coalesce(F.col(text_col), F.lit(""))).alias("size")))
    total = rows.count()
    best = F.max(F.struct("size", F.bitwise_not("doc_id").alias("rev"))).alias("best")
    found = lambda x: x.groupBy("digest").agg(best, F.count("*").alias("group_size")).select("digest", F.bitwise_not("best.rev").alias("keep_id"), "group_size")
    candidates = heavy_candidates(rows, "digest", counters).select("digest")
    winners = cut(found(rows.join(F.broadcast(candidates), "digest", "left_semi")).where(F.col("group_size") * (counters + 1) > total))
    hot = rows.join(F.broadcast(winners), "digest")
    rest = rows.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    cold = rest.join(found(rest), "digest")
    return hot.unionByName(cold).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with one row of each group of equal texts, the one that decide() keeps; columns and their order stay.

    A row goes by its id and its text: ids may be null or repeat.  Of several rows of that id and text one stays, the
    longest as written.
    """
    decided = cut(decide(df, id_col, text_col).select("doc_id", F.unhex("text_sha256").alias("digest"), "kept"))
    lost = decided.where("not kept").select(F.col("doc_id").alias("__lost_id"), F.col("digest").alias("__lost_digest")).distinct()
    rows = df.withColumn("__digest", F.unhex(F.sha2(normalised(text_col), 256)))
    gone = F.col(id_col).eqNullSafe(F.col("__lost_id")) & (F.col("__digest") == F.col("__lost_digest"))
    left = rows.join(lost.hint("shuffle_hash"), gone, "left_anti")
    repeated = cut(decided.where("kept").groupBy("doc_id", "digest").agg(F.count("*").alias("n")).where("n > 1"))
    if not repeated.isEmpty():
        left = one_of_each(left, repeated, {id_col: "doc_id", "__digest": "digest"}, [F.length(text_col), F.col(text_col)])
    return left.drop("__digest")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decide(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
r AS (SELECT doc_id, text_sha256, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY length(t) DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM r
"""
