"""Families of types, row identity and the long form of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bookkeeping column that holds file order; it is no data.
ROW_ID = "_row_id"
_NUMERIC = (T.NumericType,)
_NESTED = (T.ArrayType, T.MapType, T.StructType, T.VariantType)


def data_columns(df: DataFrame, row_id: str | None = ROW_ID) -> list[str]:
    return [c for c in df.columns if c != row_id]


def q(name: str) -> str:
    """A name quoted, so that dots and spaces in it mean nothing."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(q(name))


def columns_of(df: DataFrame, *kinds: type, row_id: str | None = ROW_ID) -> list[str]:
    return [f.name for f in df.schema if f.name != row_id and isinstance(f.dataType, kinds)]


def text_columns(df: DataFrame, row_id: str | None = ROW_ID) -> list[str]:
    return columns_of(df, T.StringType, row_id=row_id)


def numeric_columns(df: DataFrame, row_id: str | None = ROW_ID) -> list[str]:
    """Numbers without booleans."""
    return columns_of(df, *_NUMERIC, row_id=row_id)


def is_nested(kind: T.DataType) -> bool:
    return isinstance(kind, _NESTED)


def comparable(name: str, kind: T.DataType) -> Column:
    """A column as a value that can be grouped and compared: maps and variants as JSON."""
    return F.to_json(col(name)) if isinstance(kind, (T.MapType, T.VariantType)) else col(name)


def with_row_id(df: DataFrame) -> DataFrame:
    """Adds ROW_ID, gapless in the order in which files are read. Sources call this once.

    Rows are numbered within their partition, from where the partitions before it end: the driver gets one count for each
    partition, and sends as many back. A scan deals the same files to the same partitions each time.
    """
    sizes = df.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()
    starts, at = [], 0
    for r in sorted(sizes):
        starts.append((r.p, at))
        at += r.n
    places = df.sparkSession.createDataFrame(starts, "_part int, _start long")
    marked = df.withColumns({"_mark": F.monotonically_increasing_id(), "_part": F.spark_partition_id()})
    number = F.col("_start") + F.col("_mark").bitwiseAND(F.lit((1 << 33) - 1))
    return marked.join(F.broadcast(places), "_part", "left").select(F.coalesce(number, F.lit(0)).alias(ROW_ID), *map(col, df.columns))


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN becomes null once, at ingestion; after that, missing means null."""
    new = {c: F.when(~F.isnan(col(c)), col(c)) for c in columns_of(df, T.FloatType, T.DoubleType)}
    return df.withColumns(new) if new else df


def long_form(df: DataFrame, names: list[str], *keep: str) -> DataFrame:
    """(keep..., name, value): one row per cell, values as text; nested ones as JSON."""
    kinds = {f.name: f.dataType for f in df.schema}
    cells = [F.struct(F.lit(c).alias("name"), (F.to_json(col(c)) if is_nested(kinds[c]) else col(c).cast("string")).alias("value")) for c in names]
    if not cells:
        return df.select(*map(col, keep), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("value")).where("false")
    return df.select(*map(col, keep), F.inline(F.array(*cells)))
