"""CSV and Excel output, and safe names."""

from __future__ import annotations

import csv
import io
import re

from pyspark.sql import DataFrame

from ..operators.common import ROW_ID, col
from .excel import write_sheet


def safe_sheet_name(name: str | None, default: str = "Cleaned Data") -> str:
    clean = re.sub(r"[:\\/?*\[\]]", "_", (name or "").strip())[:31]
    return clean or default


def safe_stem(name: str | None, default: str = "data") -> str:
    """A file name without folders, extension and characters that file systems refuse."""
    last = re.split(r"[\\/]", name or "")[-1]
    stem = last.rpartition(".")[0] or last
    clean = re.sub(r"_+", "_", re.sub(r'[<>:"/\\|?*\x00-\x1f]', "_", stem)).strip(" ._")
    return clean or default


def _in_order(df: DataFrame) -> DataFrame:
    return df.orderBy(col(ROW_ID)).drop(ROW_ID) if ROW_ID in df.columns else df


def csv_bytes(df: DataFrame) -> bytes:
    """One file with a byte-order mark and no index. Rows are streamed from the cluster partition by partition."""
    out = io.StringIO()
    rows = _in_order(df)
    w = csv.writer(out, lineterminator="\n")
    w.writerow(rows.columns)
    for r in rows.toLocalIterator():
        w.writerow(["" if x is None else x for x in r])
    return b"\xef\xbb\xbf" + out.getvalue().encode()


def xlsx_bytes(df: DataFrame, sheet: str = "Cleaned Data") -> bytes:
    rows = _in_order(df)
    return write_sheet(rows.columns, (tuple(r) for r in rows.toLocalIterator()), safe_sheet_name(sheet))


def to_bytes(df: DataFrame, kind: str) -> bytes:
    if not isinstance(df, DataFrame):
        raise TypeError("df must be a DataFrame")
    if kind not in ("csv", "xlsx"):
        raise ValueError(f"kind must be csv or xlsx: {kind}")
    return csv_bytes(df) if kind == "csv" else xlsx_bytes(df)


def write_csv(df: DataFrame, path: str) -> None:
    """A folder of CSV files, written by the executors: the way for large tables."""
    df.drop(ROW_ID).write.option("header", True).mode("overwrite").csv(path)
