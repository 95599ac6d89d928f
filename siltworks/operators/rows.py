"""Removal of empty, incomplete and duplicate rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ROW_ID, col, comparable, data_columns


def _every_null(df: DataFrame, names: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [col(c).isNull() for c in names], F.lit(True))


def drop_empty_rows(df: DataFrame, row_id: str | None = ROW_ID) -> DataFrame:
    return df.where(~_every_null(df, data_columns(df, row_id)))


def drop_incomplete_rows(df: DataFrame, row_id: str | None = ROW_ID) -> DataFrame:
    return df.where(reduce(lambda a, b: a & b, [col(c).isNotNull() for c in data_columns(df, row_id)], F.lit(True)))


def _keys(df: DataFrame, row_id: str, subset: list[str] | None) -> list[Column]:
    kinds = {f.name: f.dataType for f in df.schema}
    return [comparable(c, kinds[c]).alias(f"k{i}") for i, c in enumerate(subset or data_columns(df, row_id))]


def dedupe_keep_first(df: DataFrame, row_id: str = ROW_ID, subset: list[str] | None = None) -> DataFrame:
    """The first row, by row id, of each set of equal rows; nulls equal nulls.

    The smallest row id of each group is a minimum, which is reduced before the shuffle: a row repeated a billion times
    moves once per task.
    """
    keys = _keys(df, row_id, subset)
    if not keys:
        return df
    if subset is None:
        names = data_columns(df, row_id)
        kinds = {f.name: f.dataType for f in df.schema}
        if not any(isinstance(k, (T.MapType, T.VariantType)) for k in kinds.values()):
            firsts = df.groupBy(*keys).agg(F.min(col(row_id)).alias(row_id))
            return firsts.select(*[col(row_id) if c == row_id else F.col(f"k{names.index(c)}").alias(c) for c in df.columns])
    rest = [F.min_by(col(c), col(row_id)).alias(c) for c in df.columns if c != row_id]
    return df.groupBy(*keys).agg(F.min(col(row_id)).alias(row_id), *rest).select(*map(col, df.columns))


def exact_duplicates(df: DataFrame, row_id: str = ROW_ID, subset: list[str] | None = None) -> DataFrame:
    """All rows but the first of each set of equal ones."""
    firsts = df.groupBy(*_keys(df, row_id, subset)).agg(F.min(col(row_id)).alias(row_id)).select(col(row_id))
    return df.join(firsts, row_id, "left_anti").select(*map(col, df.columns))


def duplicate_count(df: DataFrame, row_id: str | None = ROW_ID) -> DataFrame:
    """One row: rows, duplicate_rows."""
    if not data_columns(df, row_id):
        return df.agg(F.count("*").alias("rows"), F.lit(0).cast("long").alias("duplicate_rows"))
    each = df.groupBy(*_keys(df, row_id or "", None)).agg(F.count("*").alias("n"))
    return each.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"))
