"""How documents lie in storage, so that scans read little and joins move little."""

from __future__ import annotations

import tempfile
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..engine import STEMS
from ..functions.predicates import column as column_of
from ..functions.text import lexemes, stored_match


def write_contracts(df: DataFrame, path: str, indexed: list[str] = (), files_per_type: int = 8) -> None:
    """Partitioned by type; within a file sorted by the indexed paths, so that row-group statistics prune."""
    keys = [F.col(p) for p in indexed] or [F.col("slug")]
    salt = F.pmod(F.xxhash64("id"), F.lit(files_per_type))
    df.repartition("type", salt).sortWithinPartitions("type", *keys).write.partitionBy("type").mode("overwrite").parquet(path)


def write_edges(edges: DataFrame, table: str, buckets: int, path: str | None = None) -> None:
    """Bucketed and sorted by from_id: joins along edges need no shuffle of this side."""
    writer = edges.write.bucketBy(buckets, "from_id").sortBy("from_id", "name").mode("overwrite")
    (writer.option("path", path) if path else writer).saveAsTable(table)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that all nodes share, below spark.checkpoint.dir (a temporary one where that is unset in local mode)."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.gettempdir()
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(folder)
    # It goes when the driver ends.
    fs.deleteOnExit(folder)
    return path


def with_lexemes(df: DataFrame, text: str, column: str = "lexemes") -> DataFrame:
    """df with the stems of a text column stored beside it: a search is then array containment, without Python."""

    @F.pandas_udf("array<string>")
    def stems(x: pd.Series) -> pd.Series:
        return x.map(lambda t: sorted(lexemes(t or "")))

    return df.withColumn(column, stems(F.col(text)))


def with_search(df: DataFrame, *paths: str) -> DataFrame:
    """Documents with the stems of their texts at paths (like data.text) stored beside them: searches there need no Python.

    The engine reads the column and never gives it back.
    """
    out = df
    for n, path in enumerate(paths):
        out = with_lexemes(out, path, f"__stems{n}")
    return out.withColumn(STEMS, F.struct(*(F.col(f"__stems{n}").alias(path) for n, path in enumerate(paths)))).select(*df.columns, STEMS)


def holds(column: str, term: str):
    """Whether stored stems hold all of a term's; a term without stems matches nothing."""
    return column_of(stored_match(F.col(column), term))
