"""Data-quality score: completeness, uniqueness, consistency, validity."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.headers import is_key_name
from ..functions.numbers import clamp, percent, score_label, score_sign
from .common import ROW_ID, col, data_columns, text_columns
from .rows import duplicate_count
from .stats import distinct_counts, match_ratio

HIGH, MEDIUM, LOW = "HIGH", "MEDIUM", "LOW"
WEIGHTS = {"completeness": 0.35, "uniqueness": 0.25, "consistency": 0.20, "validity": 0.20}
NEARLY_EMPTY, MUCH_MISSING = 70.0, 15.0
CATEGORICAL, CATEGORICAL_ROWS = 0.05, 50
KEY_UNIQUE, KEY_MISSING = 0.98, 0.01
MIXED_BELOW = 0.90
ISSUE = "severity string, category string, column string, title string, detail string, recommendation string"


@dataclass
class Issue:
    severity: str
    category: str
    column: str | None
    title: str
    detail: str
    recommendation: str


@dataclass
class Report:
    score: int
    categories: dict[str, int]
    issues: list[Issue] = field(default_factory=list)
    key_candidates: list[str] = field(default_factory=list)
    categorical_candidates: list[str] = field(default_factory=list)
    stats: dict = field(default_factory=dict)

    @property
    def label(self) -> str:
        return score_label(self.score)

    @property
    def sign(self) -> str:
        return score_sign(self.score)

    @property
    def high_priority(self) -> list[Issue]:
        return [i for i in self.issues if i.severity == HIGH]

    @property
    def recommendations(self) -> list[str]:
        return list(dict.fromkeys(i.recommendation for i in self.issues))


def analyze(df: DataFrame, row_id: str | None = ROW_ID) -> Report:
    """The report over all values. A table without rows or columns scores 100 throughout."""
    names = data_columns(df, row_id)
    texts = text_columns(df, row_id)
    rows, repeated = duplicate_count(df, row_id).first() if names else (df.count(), 0)
    stats = {"rows": rows, "cols": len(names), "missing_cells": 0, "missing_pct": 0.0, "duplicate_rows": 0, "duplicate_pct": 0.0}
    if not rows or not names:
        return Report(100, dict.fromkeys(WEIGHTS, 100), stats=stats)
    facts = df.agg(
        *[F.count_if(col(c).isNull()) for c in names],
        *[F.struct(match_ratio(text.looks_number(col(c)), col(c)), match_ratio(text.has_date(col(c)), col(c))) for c in texts],
    ).first()
    missing = dict(zip(names, facts[: len(names)], strict=True))
    ratios = dict(zip(texts, facts[len(names) :], strict=True))
    unique = {r["column"]: r["distinct"] for r in distinct_counts(df, row_id).collect()}
    total = sum(missing.values())
    issues: list[Issue] = []

    for c in names:
        part = percent(missing[c], rows)
        if part > NEARLY_EMPTY:
            issues.append(Issue(HIGH, "completeness", c, f"{c} is nearly empty", f"{missing[c]:,} of {rows:,} cells ({part:.1f}%) are missing.", f"Drop {c}, or find its values."))
        elif part > MUCH_MISSING:
            issues.append(Issue(MEDIUM, "completeness", c, f"Much of {c} is missing", f"{missing[c]:,} of {rows:,} cells ({part:.1f}%) are missing.", f"Decide whether to fill, flag or drop what is missing in {c}."))
    if repeated:
        part = percent(repeated, rows)
        issues.append(Issue(HIGH if part > 5.0 else MEDIUM, "uniqueness", None, "Rows repeat", f"{repeated:,} of {rows:,} rows ({part:.1f}%) equal an earlier one.", "Drop repeated rows."))

    lost, categorical = 0.0, []
    for c in texts:
        n = rows - missing[c]
        if not n:
            continue
        numbers, dates = ratios[c]
        if 0 < numbers < MIXED_BELOW:
            lost += 5
            issues.append(Issue(MEDIUM, "consistency", c, f"{c} mixes numbers and text", f"{numbers * 100:.0f}% of its values are numbers.", f"Settle on one kind of value in {c}."))
        elif 0 < dates < MIXED_BELOW:
            lost += 5
            issues.append(Issue(MEDIUM, "consistency", c, f"{c} mixes dates and text", f"{dates * 100:.0f}% of its values hold dates.", f"Bring the dates of {c} to one format."))
        if unique[c] / n < CATEGORICAL and unique[c] > 1 and rows >= CATEGORICAL_ROWS:
            lost += 1
            categorical.append(c)
            issues.append(Issue(LOW, "consistency", c, f"{c} has few values", f"{unique[c]} distinct values in {n:,}.", f"Encode {c} as a category."))

    wrong, keys = 0.0, []
    for c in names:
        n = rows - missing[c]
        if not n:
            continue
        part = unique[c] / n
        if part >= KEY_UNIQUE and missing[c] / rows <= KEY_MISSING and (is_key_name(c) or part == 1.0):
            keys.append(c)
            if unique[c] < n:
                wrong += 10
                issues.append(Issue(HIGH, "validity", c, f"Key {c} has repeats", f"{n - unique[c]:,} values ({percent(n - unique[c], n):.1f}%) repeat.", f"Resolve the repeats before {c} serves as a key."))

    scores = {
        "completeness": clamp(100.0 - percent(total, rows * len(names))),
        "uniqueness": clamp(100.0 - percent(repeated, rows)),
        "consistency": clamp(100.0 - min(lost, 35.0)),
        "validity": clamp(100.0 - min(wrong, 40.0)),
    }
    stats |= {"missing_cells": total, "missing_pct": round(percent(total, rows * len(names)), 2), "duplicate_rows": repeated, "duplicate_pct": round(percent(repeated, rows), 2)}
    order = {HIGH: 0, MEDIUM: 1, LOW: 2}
    issues.sort(key=lambda i: order.get(i.severity, 3))
    overall = clamp(sum(scores[k] * w for k, w in WEIGHTS.items()))
    return Report(overall, scores, issues, keys, categorical, stats)


def issues_table(df: DataFrame, row_id: str | None = ROW_ID) -> DataFrame:
    found = [(i.severity, i.category, i.column, i.title, i.detail, i.recommendation) for i in analyze(df, row_id).issues]
    return df.sparkSession.createDataFrame(found, ISSUE)
