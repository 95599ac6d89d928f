"""Semantic column types: by storage type, then by name, then by content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text
from ..functions.headers import type_by_name
from .common import ROW_ID, col, data_columns, is_nested
from .stats import distinct_counts, match_ratio

SEMANTIC = ("numeric", "categorical", "date", "email", "phone", "url", "currency", "percentage", "id", "text", "unknown")
#: Content tests in their order, with the part of values that must pass.
CONTENT = (
    ("date", text.looks_date, 0.70), ("email", text.looks_email, 0.70), ("phone", text.looks_phone, 0.60),
    ("url", text.looks_url, 0.50), ("currency", text.looks_currency, 0.60), ("percentage", text.looks_percent, 0.60),
)


def content_ratio(name: str) -> Column:
    """For a text column, the part of all values that passes each content test, as an aggregate."""
    return F.struct(*[match_ratio(test(col(name)), col(name)).alias(kind) for kind, test, _ in CONTENT])


def by_cardinality(distinct: int, values: int) -> str:
    if not values:
        return "unknown"
    part = distinct / values
    return "categorical" if part < 0.05 or distinct <= 20 else "text" if part > 0.90 else "categorical"


def is_id(values: int, distinct: int, low, high, has_null: bool) -> bool:
    """A dense unique whole-number key: it starts near 1 and ends within ten times the rows."""
    return values >= 2 and not has_null and distinct == values and high <= values * 10 and low <= 100


def dense_keys(df: DataFrame, names: list[str]) -> dict[str, bool]:
    """Which whole-number columns are dense unique keys."""
    facts = df.agg(F.count("*"), *[F.struct(F.count(col(c)), F.min(col(c)), F.max(col(c))) for c in names]).first()
    distinct = {r["column"]: r["distinct"] for r in distinct_counts(df, None, names).collect()}
    return {c: is_id(n, distinct[c], low, high, n < facts[0]) for c, (n, low, high) in zip(names, facts[1:], strict=True)}


def semantic_types(df: DataFrame, row_id: str | None = ROW_ID, distinct: dict[str, int] | None = None) -> dict[str, str]:
    """The semantic type of every column, in column order. One scan beside that for distinct values."""
    kinds = {f.name: f.dataType for f in df.schema}
    out: dict[str, str] = {}
    for c in data_columns(df, row_id):
        if isinstance(kinds[c], (T.DateType, T.TimestampType, T.TimestampNTZType)):
            out[c] = "date"
        elif (named := type_by_name(c)) is not None:
            out[c] = named
        elif is_nested(kinds[c]):
            out[c] = "unknown"
        elif isinstance(kinds[c], (T.FractionalType, T.BooleanType)):
            out[c] = "numeric"
    open_ = [c for c in data_columns(df, row_id) if c not in out]
    if open_:
        wanted = distinct or {r["column"]: r["distinct"] for r in distinct_counts(df, row_id, open_).collect()}
        whole = [c for c in open_ if isinstance(kinds[c], T.IntegralType)]
        strings = [c for c in open_ if isinstance(kinds[c], T.StringType)]
        counts = [F.struct(F.count(col(c)), *([F.min(col(c)), F.max(col(c))] if c in whole else [])) for c in open_]
        facts = df.agg(F.count("*"), *counts, *map(content_ratio, strings)).first()
        rows, found, ratios = facts[0], dict(zip(open_, facts[1:], strict=False)), dict(zip(strings, facts[1 + len(open_) :], strict=True))
        for c in whole:
            n, low, high = found[c]
            out[c] = "id" if n and is_id(n, wanted[c], low, high, n < rows) else "numeric"
        texts = [c for c in open_ if c not in whole]
        for c in texts:
            hit = next((kind for kind, _, least in CONTENT if c in ratios and ratios[c][kind] >= least), None) if found[c][0] else None
            out[c] = hit or by_cardinality(wanted[c], found[c][0])
    return {c: out[c] for c in data_columns(df, row_id)}


def type_groups(types: dict[str, str]) -> dict[str, list[str]]:
    return {kind: [c for c, t in types.items() if t == kind] for kind in SEMANTIC}
