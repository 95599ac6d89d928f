"""Cleaning of several files, and a ZIP of what comes out."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession

from ..config import CleanOptions, Limits
from ..sources import files, tables
from ..sources.export import csv_bytes, safe_stem, xlsx_bytes
from .pipeline import clean


def clean_files(spark: SparkSession, paths: list[str], options: CleanOptions = CleanOptions(), limits: Limits = Limits()) -> tuple[list[tuple[str, DataFrame, dict]], dict[str, DataFrame], list[str]]:
    """Results (name, table, report), the tables as read by name, and errors; a failing file stops no other.

    Normalisers are off, as types are not reviewed; of a workbook the first sheet is read.
    """
    plain = replace(options, normalize_emails=False, normalize_phones=False, normalize_dates=False)
    results, before, errors = [], {}, []
    for path in paths:
        name = path.rstrip("/").rpartition("/")[2]
        try:
            ok, why = files.validate(spark, path, limits)
            if not ok:
                raise ValueError(why)
            df = tables.load(spark, path, limits=limits)
            if df is None:
                raise ValueError("no table in it")
            before[name] = df
            cleaned, report = clean(df, plain)
            results.append((name, cleaned, report | {"filename": name}))
        except Exception as e:  # one file's failure is a line of the outcome
            errors.append(f"{name}: {str(e).splitlines()[0] if str(e) else type(e).__name__}")
    return results, before, errors


def summary(spark: SparkSession, results: list[tuple[str, DataFrame, dict]]) -> DataFrame:
    """Per file: rows before and after, duplicates, filled cells, and columns removed as empty or duplicate."""
    rows = [(name, r["rows_before"], r["rows_after"], r["duplicates_removed"], r["missing_filled"], r["empty_cols_removed"] + r["dup_cols_removed"]) for name, _, r in results]
    return spark.createDataFrame(rows, "file string, rows_before long, rows_after long, duplicates_removed long, missing_filled long, cols_removed long")


def batch_zip(results: list[tuple[str, DataFrame, dict]], report_fn: Callable[..., str], before_map: dict[str, DataFrame] | None = None) -> bytes:
    """cleaned_X.xlsx, cleaned_X.csv and reports/report_X.txt for each result; stems are made safe and unique.

    report_fn gets (report, name), or with a before_map also the tables before (None if absent) and after.
    """
    if not isinstance(results, (list, tuple)):
        raise TypeError("results: a list of (name, table, report)")
    if not callable(report_fn):
        raise TypeError("report_fn must be callable")
    out, used = io.BytesIO(), set()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for item in results:
            name, df, report = item
            if not isinstance(df, DataFrame) or not isinstance(report, dict):
                raise TypeError("results: a list of (name, table, report)")
            stem = base = safe_stem(name)
            n = 1
            while stem.lower() in used:
                n += 1
                stem = f"{base}_{n}"
            used.add(stem.lower())
            z.writestr(f"cleaned_{stem}.xlsx", xlsx_bytes(df))
            z.writestr(f"cleaned_{stem}.csv", csv_bytes(df))
            said = report_fn(report, name) if before_map is None else report_fn(report, name, before_map.get(name), df)
            z.writestr(f"reports/report_{stem}.txt", said)
    return out.getvalue()


__all__ = ["batch_zip", "clean_files", "summary"]
