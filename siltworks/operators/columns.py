"""Removal of empty, duplicate and constant columns. Each decides on the driver from one aggregate row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ROW_ID, col, comparable, data_columns


def empty_columns(df: DataFrame, row_id: str | None = ROW_ID) -> list[str]:
    """Columns without a value; of a table without rows, all."""
    names = data_columns(df, row_id)
    if not names:
        return []
    counts = df.agg(*[F.count(col(c)) for c in names]).first()
    return [c for c, n in zip(names, counts, strict=True) if n == 0]


def constant_columns(df: DataFrame, row_id: str | None = ROW_ID) -> list[str]:
    """Columns with at most one distinct value beside nulls."""
    kinds = {f.name: f.dataType for f in df.schema}
    names = data_columns(df, row_id)
    if not names:
        return []
    tests = df.agg(*[F.min(comparable(c, kinds[c])).eqNullSafe(F.max(comparable(c, kinds[c]))) for c in names]).first()
    return [c for c, same in zip(names, tests, strict=True) if same]


def fingerprint_aggregates(df: DataFrame, row_id: str = ROW_ID) -> list[Column]:
    """Per column an order-free hash of (row, value); equal columns have equal ones."""
    values = [comparable(f.name, f.dataType) for f in df.schema if f.name != row_id]
    return [F.bit_xor(F.xxhash64(col(row_id), F.lit(1), v, v.isNull())) for v in values]


def fingerprints(df: DataFrame, row_id: str = ROW_ID) -> dict[str, tuple]:
    """Per column its type and its fingerprint."""
    kinds = {f.name: f.dataType for f in df.schema}
    names = data_columns(df, row_id)
    if not names:
        return {}
    found = df.agg(*fingerprint_aggregates(df, row_id)).first()
    return {c: (kinds[c].simpleString(), x) for c, x in zip(names, found, strict=True)}


def duplicate_groups(df: DataFrame, row_id: str = ROW_ID, marks: dict[str, tuple] | None = None) -> list[list[str]]:
    """Groups of two and more columns with equal values and types, in column order; candidates by fingerprint are verified."""
    by: dict[tuple, list[str]] = {}
    for name, mark in (fingerprints(df, row_id) if marks is None else marks).items():
        by.setdefault(mark, []).append(name)
    kinds = {f.name: f.dataType for f in df.schema}
    pairs = [(g[0], c) for g in by.values() for c in g[1:]]
    if not pairs:
        return []
    same = df.agg(*[F.coalesce(F.bool_and(comparable(a, kinds[a]).eqNullSafe(comparable(b, kinds[b]))), F.lit(True)) for a, b in pairs]).first()
    groups: dict[str, list[str]] = {}
    for (a, b), yes in zip(pairs, same, strict=True):
        if yes:
            groups.setdefault(a, [a]).append(b)
    return list(groups.values())


def duplicate_columns(df: DataFrame, row_id: str = ROW_ID, marks: dict[str, tuple] | None = None) -> list[str]:
    """All but the first of each group; fingerprints that are known save a scan."""
    later = {c for g in duplicate_groups(df, row_id, marks) for c in g[1:]}
    return [c for c in df.columns if c in later]


def without(df: DataFrame, names: list[str]) -> tuple[DataFrame, int]:
    gone = set(names)
    return df.select(*[col(c) for c in df.columns if c not in gone]), len(gone)


def remove_empty_columns(df: DataFrame, row_id: str | None = ROW_ID) -> tuple[DataFrame, int]:
    return without(df, empty_columns(df, row_id))


def remove_constant_columns(df: DataFrame, row_id: str | None = ROW_ID) -> tuple[DataFrame, int]:
    return without(df, constant_columns(df, row_id))


def remove_duplicate_columns(df: DataFrame, row_id: str = ROW_ID) -> tuple[DataFrame, int]:
    return without(df, duplicate_columns(df, row_id))
