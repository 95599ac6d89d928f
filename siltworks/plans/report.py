"""Reports of a cleaning run as text and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import fix_encoding, changed
from ..operators.common import ROW_ID, col, data_columns, text_columns
from ..operators.impute import missing_per_column
from ..operators.rows import duplicate_count

ACTIONS = (
    ("headers_stripped", "headers stripped"), ("encoding_repaired", "cells repaired"), ("spaces_trimmed", "cells trimmed"),
    ("emails_normalized", "emails normalised"), ("phones_normalized", "phones normalised"), ("dates_normalized", "dates normalised"),
    ("empty_rows_removed", "empty rows removed"), ("empty_cols_removed", "empty columns removed"), ("dup_cols_removed", "duplicate columns removed"),
    ("duplicates_removed", "duplicate rows removed"), ("const_cols_removed", "constant columns removed"), ("missing_filled", "missing cells filled"),
    ("missing_dropped_rows", "incomplete rows dropped"), ("headers_snake_cased", "headers renamed"),
)


def text_report(report: dict, filename: str, before: DataFrame | None = None, after: DataFrame | None = None) -> str:
    lines = [f"cleaning of {filename}", f"at {report.get('timestamp', '-')}, fill: {report.get('fill_strategy_used', '-')}", "", "size"]
    size = lambda when: f"  {when:<7}{report.get(f'rows_{when}', 0):>14,} rows {report.get(f'cols_{when}', 0):>6,} columns {report.get(f'missing_count_{when}', 0):>14,} missing cells"
    lines += [size("before"), size("after"), "", "steps"]
    lines += [f"  {report.get(key, 0):>14,} {what}" for key, what in ACTIONS]
    if before is not None and after is not None:
        lines += ["", "columns"]
        old, new = data_columns(before), data_columns(after)
        lines += [f"  - {c}" for c in old if c not in new] + [f"  + {c}" for c in new if c not in old]
    return "\n".join(lines) + "\n"


def comparison(df: DataFrame, report: dict) -> DataFrame:
    """Six rows of metric, before, after; what was removed stands before, with 0 after."""
    rows = [
        ("rows", report["rows_before"], report["rows_after"]), ("columns", report["cols_before"], report["cols_after"]),
        ("missing cells", report["missing_count_before"], report["missing_count_after"]), ("duplicate rows", report["duplicates_removed"], 0),
        ("empty columns", report["empty_cols_removed"], 0), ("duplicate columns", report["dup_cols_removed"], 0),
    ]
    return df.sparkSession.createDataFrame(rows, "metric string, before long, after long")


def before_after(before: DataFrame, after: DataFrame, row_id: str = ROW_ID) -> DataFrame:
    """Rows, columns, missing cells, duplicate rows, repairable cells and estimated bytes of both tables."""
    rows = []
    for df in (before, after):
        n, repeated = duplicate_count(df, row_id).first()
        texts = text_columns(df, row_id)
        broken = df.agg(*[F.count_if(changed(col(c), fix_encoding(col(c)))) for c in texts]).first() if texts else []
        size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
        rows.append((n, len(data_columns(df, row_id)), sum(missing_per_column(df, row_id).values()), repeated, sum(broken), min(int(str(size)), 2**63 - 1)))
    names = ("rows", "columns", "missing cells", "duplicate rows", "repairable cells", "estimated bytes")
    return before.sparkSession.createDataFrame([(m, a, b) for m, a, b in zip(names, *rows, strict=True)], "metric string, before long, after long")


def preview(df: DataFrame, n: int = 10, row_id: str = ROW_ID) -> DataFrame:
    return df.orderBy(col(row_id)).limit(n).drop(row_id)
