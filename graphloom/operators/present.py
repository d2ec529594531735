"""Results as JSON payloads: times in ISO 8601 with Z, link lists that are empty left out, missing fields left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ISO = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def plain(column: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.TimestampType | T.TimestampNTZType):
        return F.date_format(column, ISO)
    if isinstance(kind, T.StructType):
        parts = [plain(column.getField(f.name), f.dataType).alias(f.name) for f in kind]
        return F.when(column.isNotNull(), F.struct(*parts)) if parts else column
    if isinstance(kind, T.ArrayType) and not isinstance(kind.elementType, T.VariantType):
        return F.transform(column, lambda x: plain(x, kind.elementType))
    return column


def payloads(df: DataFrame) -> DataFrame:
    """One column, payload: each row of a query's result as JSON text."""
    columns = []
    for f in df.schema:
        if f.name == "links" and isinstance(f.dataType, T.StructType):
            lists = [F.when(F.size(F.col("links").getField(v.name)) > 0, plain(F.col("links").getField(v.name), v.dataType)).alias(v.name) for v in f.dataType]
            columns.append(F.struct(*lists).alias("links"))
        else:
            columns.append(plain(F.col(f"`{f.name}`"), f.dataType).alias(f.name))
    return df.select(F.to_json(F.struct(*columns)).alias("payload"))
