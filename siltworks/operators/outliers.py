"""Outliers by quartiles and by z-score. Nothing is deleted."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROW_ID, col, numeric_columns
from .stats import finite, quantiles

LEAST, PREVIEW, DIGITS = 4, 20, 4


def _preview(df: DataFrame, name: str, is_out, row_id: str | None) -> list[float]:
    rows = df.where(is_out)
    rows = rows.orderBy(col(row_id)) if row_id in df.columns else rows
    return [r[0] for r in rows.select(finite(name)).limit(PREVIEW).collect()]


def iqr_bounds(df: DataFrame, names: list[str]) -> dict[str, dict]:
    """Per column its finite values' number, quartiles and bounds; bounds are None below four values."""
    counts = df.agg(*[F.count(finite(c)) for c in names]).first() if names else []
    quarts = quantiles(df, names, [0.25, 0.75])
    out = {}
    for c, n in zip(names, counts, strict=True):
        if n < LEAST:
            out[c] = {"n": n, "lower": None, "upper": None, "iqr": None}
        else:
            q1, q3 = quarts[c]
            iqr = q3 - q1
            out[c] = {"n": n, "lower": q1 - 1.5 * iqr if iqr else q1, "upper": q3 + 1.5 * iqr if iqr else q3, "iqr": iqr}
    return out


def iqr_rows(df: DataFrame, name: str) -> DataFrame:
    """The rows whose value lies strictly outside the bounds."""
    b = iqr_bounds(df, [name])[name]
    return df.where(_outside(name, b))


def _outside(name: str, b: dict):
    v = finite(name)
    return F.lit(False) if not b["iqr"] else (v < b["lower"]) | (v > b["upper"])


def zscore_rows(df: DataFrame, name: str, threshold: float = 3.0) -> DataFrame:
    """The rows whose value is more than `threshold` standard deviations from the mean; none below four values."""
    v = finite(name)
    n, mean, std = df.agg(F.count(v), F.avg(v), F.stddev_samp(v)).first()
    return df.where(F.abs((v - mean) / std) > threshold if n >= LEAST and std else F.lit(False))


def iqr(df: DataFrame, name: str, row_id: str | None = ROW_ID) -> dict:
    """count, lower, upper (4 decimals) and the first 20 values strictly outside. An IQR of 0 has no outliers."""
    b = iqr_bounds(df, [name])[name]
    if b["lower"] is None or not b["iqr"]:
        return {"count": 0, "lower": None if b["lower"] is None else round(b["lower"], DIGITS), "upper": None if b["upper"] is None else round(b["upper"], DIGITS), "values": []}
    is_out = _outside(name, b)
    return {"count": df.where(is_out).count(), "lower": round(b["lower"], DIGITS), "upper": round(b["upper"], DIGITS), "values": _preview(df, name, is_out, row_id)}


def zscore(df: DataFrame, name: str, threshold: float = 3.0, row_id: str | None = ROW_ID) -> dict:
    """count, values, and for four values and more mean and std; a threshold that is no positive number is 3."""
    try:
        threshold = float(threshold)
    except (TypeError, ValueError):
        threshold = 3.0
    if not threshold > 0 or math.isinf(threshold):
        threshold = 3.0
    v = finite(name)
    n, mean, std = df.agg(F.count(v), F.avg(v), F.stddev_samp(v)).first()
    if n < LEAST:
        return {"count": 0, "values": [], "threshold": threshold}
    if not std:
        return {"count": 0, "values": [], "threshold": threshold, "mean": round(mean, DIGITS), "std": 0.0}
    is_out = F.abs((v - mean) / std) > threshold
    return {"count": df.where(is_out).count(), "values": _preview(df, name, is_out, row_id), "threshold": threshold, "mean": round(mean, DIGITS), "std": round(std, DIGITS)}


def iqr_summary(df: DataFrame, names: list[str] | None = None, row_id: str | None = ROW_ID) -> DataFrame:
    """Per numeric column: column, n, lower, upper, outliers. Two scans for all columns."""
    names = names or numeric_columns(df, row_id)
    bounds = iqr_bounds(df, names)
    cells = []
    for c in names:
        b = bounds[c]
        hit = _outside(c, b)
        r = [None if b[k] is None else round(b[k], DIGITS) for k in ("lower", "upper")]
        cells.append(F.struct(F.lit(c).alias("column"), F.lit(b["n"]).cast("long").alias("n"), F.lit(r[0]).cast("double").alias("lower"), F.lit(r[1]).cast("double").alias("upper"), F.count_if(hit).alias("outliers")))
    return df.agg(F.array(*cells).alias("x")).select(F.inline("x"))


def all_outliers(df: DataFrame, row_id: str | None = ROW_ID) -> dict[str, dict]:
    """iqr() of each numeric column that has outliers."""
    some = [r["column"] for r in iqr_summary(df, None, row_id).where("outliers > 0").collect()] if numeric_columns(df, row_id) else []
    return {c: iqr(df, c, row_id) for c in some}
