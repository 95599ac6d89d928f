"""Formatting and small arithmetic of reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BANDS = ((90, "Excellent"), (70, "Good"), (50, "Needs Attention"))
#: Signs of the bands, best first, then of what is below all.
SIGNS = ("🟢", "🟡", "🟠", "🔴")


def clamp(value: float, low: float = 0.0, high: float = 100.0) -> int:
    return int(max(low, min(high, value)))


def clamp_col(value: Column) -> Column:
    return F.floor(F.least(F.greatest(value, F.lit(0.0)), F.lit(100.0)))


def percent(part: float, whole: float) -> float:
    return part / whole * 100.0 if whole > 0 else 0.0


def percent_col(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole * 100.0).otherwise(F.lit(0.0))


def score_label(score: int) -> str:
    return next((name for least, name in BANDS if score >= least), "Poor")


def score_sign(score: int) -> str:
    return next((s for (least, _), s in zip(BANDS, SIGNS, strict=False) if score >= least), SIGNS[-1])


def score_label_col(score: Column) -> Column:
    out = F.when(score >= BANDS[0][0], BANDS[0][1])
    for least, name in BANDS[1:]:
        out = out.when(score >= least, name)
    return out.otherwise("Poor")


def readable_size(n: float) -> str:
    n = max(n, 0)
    for unit, size, form in (("GB", 1 << 30, ".2f"), ("MB", 1 << 20, ".2f"), ("KB", 1 << 10, ".1f")):
        if n >= size:
            return f"{n / size:{form}} {unit}"
    return f"{int(n)} B"


def readable_size_col(n: Column) -> Column:
    v = F.greatest(n, F.lit(0)).cast("double")
    # Java's formats round ties up; these are rounded to even beforehand, as Python does.
    of = lambda size, digits, unit: F.format_string(f"%.{digits}f {unit}", F.bround(v / F.lit(float(size)), digits))
    return F.when(v >= 1 << 30, of(1 << 30, 2, "GB")).when(v >= 1 << 20, of(1 << 20, 2, "MB")).when(v >= 1 << 10, of(1 << 10, 1, "KB")).otherwise(F.format_string("%d B", v.cast("long")))
