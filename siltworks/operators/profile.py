"""Profile of a table: figures, semantic types, warnings and recommendations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import percent
from .columns import duplicate_groups, fingerprint_aggregates
from .common import ROW_ID, col, data_columns
from .rows import duplicate_count
from .semantic import semantic_types, type_groups
from .stats import distinct_counts, samples


def profile(df: DataFrame, row_id: str = ROW_ID) -> dict:
    """Dataset figures and, per column, dtype, semantic type, missing, missing_pct, unique and sample."""
    names = data_columns(df, row_id)
    rows, repeated = duplicate_count(df, row_id).first() if names else (df.count(), 0)
    # Missing cells and fingerprints in one scan.
    found = df.agg(*[F.count_if(col(c).isNull()) for c in names], *fingerprint_aggregates(df, row_id)).first() if names else []
    missing = dict(zip(names, found, strict=False))
    unique = {r["column"]: r["distinct"] for r in distinct_counts(df, row_id).collect()} if names else {}
    sample = {r["column"]: r["sample"] for r in samples(df, row_id=row_id).collect()} if names else {}
    types = semantic_types(df, row_id, unique)
    groups = type_groups(types)
    kinds = dict(df.dtypes)
    marks = {c: (kinds[c], m) for c, m in zip(names, found[len(names) :], strict=True)}
    total = sum(missing.values())
    out = {
        "rows": rows, "columns": len(names), "missing_count": total, "missing_pct": round(percent(total, rows * len(names)), 2),
        "duplicate_rows": repeated, "duplicate_row_pct": round(percent(repeated, rows), 2),
        "constant_cols": [c for c in names if unique[c] <= 1], "empty_cols": [c for c in names if missing[c] == rows],
        "dup_col_groups": duplicate_groups(df, row_id, marks), "type_groups": groups,
        "col_profiles": {
            c: {"dtype": kinds[c], "semantic": types[c], "missing": missing[c], "missing_pct": round(percent(missing[c], max(rows, 1)), 2), "unique": unique[c], "sample": sample.get(c, [])}
            for c in names
        },
    }
    return out | advice(out)


def advice(p: dict) -> dict:
    """Warnings and recommendations from a profile's figures."""
    found = [
        (p["missing_pct"] > 0, f"{p['missing_pct']}% of all cells are missing", "Fill or drop what is missing"),
        (p["duplicate_rows"] > 0, f"{p['duplicate_rows']:,} rows ({p['duplicate_row_pct']}%) repeat earlier ones", "Drop repeated rows"),
        (p["constant_cols"], f"Constant: {', '.join(p['constant_cols'])}", "Drop constant columns"),
        (p["empty_cols"], f"Without a value: {', '.join(p['empty_cols'])}", "Drop empty columns"),
        (p["dup_col_groups"], f"{len(p['dup_col_groups'])} groups of equal columns", "Keep one column of each group"),
    ]
    names = [(kind, p["type_groups"].get(kind)) for kind in ("email", "date", "phone")]
    return {
        "warnings": [w for yes, w, _ in found if yes],
        "recommendations": [r for yes, _, r in found if yes] + [f"Normalise {kind} columns: {', '.join(cols)}" for kind, cols in names if cols],
    }


def column_table(df: DataFrame, row_id: str = ROW_ID) -> DataFrame:
    """The column profiles as a table: column, dtype, semantic, missing, missing_pct, unique, sample."""
    p = profile(df, row_id)["col_profiles"]
    rows = [(c, x["dtype"], x["semantic"], x["missing"], x["missing_pct"], x["unique"], x["sample"]) for c, x in p.items()]
    return df.sparkSession.createDataFrame(rows, "column string, dtype string, semantic string, missing long, missing_pct double, unique long, sample array<string>")
