"""Filling of missing values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import AUTO, DROP, UNKNOWN, ZERO
from .common import ROW_ID, col, data_columns, is_nested, long_form, numeric_columns
from .rows import drop_incomplete_rows
from .stats import quantiles

_TIMES = (T.DateType, T.TimestampType, T.TimestampNTZType, T.DayTimeIntervalType)


def missing_per_column(df: DataFrame, row_id: str | None = ROW_ID) -> dict[str, int]:
    names = data_columns(df, row_id)
    return dict(zip(names, df.agg(*[F.count_if(col(c).isNull()) for c in names]).first(), strict=True)) if names else {}


def modes(df: DataFrame, names: list[str]) -> dict[str, str | None]:
    """The most frequent value of each column as text; ties: the least. Counts are summed before the shuffle."""
    if not names:
        return {}
    each = long_form(df, names).where("value IS NOT NULL").groupBy("name", "value").agg(F.count("*").alias("n"))
    top = each.groupBy("name").agg(F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("value"))
    return {r["name"]: r["value"] for r in top.collect()}


def fill(df: DataFrame, strategy: str = AUTO, row_id: str | None = ROW_ID, missing: dict[str, int] | None = None, rows: int | None = None) -> tuple[DataFrame, int]:
    """The filled table and what was affected: cells, or for DROP rows.

    AUTO: median of numbers (integers become doubles), most frequent value of others; a column without values gets 0 or
    'Unknown'. ZERO: 0, as text in text, and nothing in dates. UNKNOWN: 'Unknown', which turns columns with missing
    cells to text. DROP: rows with a missing cell go. Unknown strategies are AUTO. Nested columns stay as they are.
    Who knows `missing` (cells of each column) and the number of rows saves the scans that find them.
    """
    missing = missing_per_column(df, row_id) if missing is None else missing
    kinds = {f.name: f.dataType for f in df.schema}
    if strategy == DROP:
        if not any(missing.values()):
            return df, 0
        kept = drop_incomplete_rows(df, row_id)
        return kept, (df.count() if rows is None else rows) - kept.count()
    todo = [c for c, n in missing.items() if n and not is_nested(kinds[c])]
    new = {}
    if strategy == ZERO:
        for c in todo:
            if not isinstance(kinds[c], _TIMES):
                new[c] = F.coalesce(col(c), F.lit("0" if isinstance(kinds[c], T.StringType) else 0).cast(kinds[c]))
    elif strategy == UNKNOWN:
        new = {c: F.coalesce(col(c).cast("string"), F.lit("Unknown")) for c in todo}
    else:
        numbers = [c for c in todo if c in set(numeric_columns(df, row_id))]
        medians = quantiles(df, numbers, [0.5], most=rows)
        for c in numbers:
            kind = kinds[c] if isinstance(kinds[c], (T.FractionalType,)) else T.DoubleType()
            new[c] = F.coalesce(col(c).cast(kind), F.lit(0.0 if medians[c][0] is None else medians[c][0]).cast(kind))
        others = [c for c in todo if c not in numbers]
        top = modes(df, others)
        for c in others:
            if top.get(c) is None:
                new[c] = F.coalesce(col(c).cast("string"), F.lit("Unknown"))
            else:
                new[c] = F.coalesce(col(c), F.lit(top[c]).cast(kinds[c]))
    return (df.withColumns(new) if new else df), sum(missing[c] for c in new)


__all__ = ["AUTO", "DROP", "UNKNOWN", "ZERO", "fill", "missing_per_column", "modes"]
