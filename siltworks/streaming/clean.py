"""The cell steps of the cleaning pipeline on a stream. They keep no state, so the same expressions serve."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import CleanOptions
from ..operators.common import col, nan_to_null, text_columns
from ..plans.pipeline import cell_steps


def clean_cells(df: DataFrame, options: CleanOptions = CleanOptions()) -> DataFrame:
    """Encoding, white space, emails, phones and dates of a batch or streaming table."""
    df = nan_to_null(df)
    for _, takes, function in cell_steps(options):
        new = {c: function(col(c)) for c in text_columns(df) if takes(c)}
        df = df.withColumns(new) if new else df
    return df


def windowed_counts(events: DataFrame, ts: str, key: str, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Rows and missing cells per window and key, with late rows within the watermark counted."""
    names = [c for c in events.columns if c not in (ts, key)]
    missing = sum((F.col(c).isNull().cast("long") for c in names), F.lit(0).cast("long"))
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), key).agg(F.count("*").alias("rows"), F.sum(missing).alias("missing"))
