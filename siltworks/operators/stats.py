"""Whole-table and whole-column statistics."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ROW_ID, col, data_columns, long_form, numeric_columns

#: Up to this many values an exact percentile keeps a column's distinct values in one buffer; beyond, it narrows brackets.
DIRECT_ROWS = 2_000_000


def finite(name: str):
    """A column as double without nulls, NaN and infinities (which become null)."""
    c = F.expr(f"try_cast(`{name.replace('`', '``')}` AS double)")
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def quantiles(df: DataFrame, names: list[str], probs: list[float], direct_rows: int = DIRECT_ROWS, most: int | None = None) -> dict[str, list[float | None]]:
    """Exact quantiles with linear interpolation of the finite values of each column.

    Small columns take the built-in percentile. A large one would hold all its distinct values in one buffer, so its
    ranks are bracketed by approximate percentiles, and each scan counts what lies below and keeps narrowing, until
    what is left between the bounds is small enough; every scan serves all columns and quantiles at once. Both ways give
    the same values. Where the number of rows is known not to pass `most`, small columns need no count.
    """
    if not names:
        return {}
    cells = df.select(*[finite(c).alias(f"c{i}") for i, c in enumerate(names)])
    if most is not None and most <= direct_rows:
        got = cells.agg(*[F.percentile(f"c{i}", [float(p) for p in probs]) for i in range(len(names))]).first()
        return {c: list(row) if row is not None else [None] * len(probs) for c, row in zip(names, got, strict=True)}
    counts = cells.agg(*[F.count(f"c{i}") for i in range(len(names))]).first()
    out: dict[str, list[float | None]] = {c: [None] * len(probs) for c in names}
    small = [i for i, n in enumerate(counts) if 0 < n <= direct_rows]
    if small:
        got = cells.agg(*[F.percentile(f"c{i}", [float(p) for p in probs]) for i in small]).first()
        for i, row in zip(small, got, strict=True):
            out[names[i]] = list(row)
    large = [i for i, n in enumerate(counts) if n > direct_rows]
    ranks = {(i, r) for i in large for p in probs for r in {int((counts[i] - 1) * p), min(int((counts[i] - 1) * p) + 1, counts[i] - 1)}}
    found = _order_statistics(cells, {(f"c{i}", r): counts[i] for i, r in ranks}, direct_rows) if ranks else {}
    for i in large:
        for k, p in enumerate(probs):
            at = (counts[i] - 1) * p
            low = int(at)
            a, b = found[f"c{i}", low], found[f"c{i}", min(low + 1, counts[i] - 1)]
            out[names[i]][k] = a + (b - a) * (at - low)
    return out


def _order_statistics(cells: DataFrame, wanted: dict[tuple[str, int], int], enough: int) -> dict[tuple[str, int], float]:
    """The value of each (column, rank from 0)."""
    bounds = {k: (float("-inf"), float("inf"), k[1], n) for k, n in wanted.items()}  # above low, up to high: rank within, rows
    out: dict[tuple[str, int], float] = {}
    while bounds:
        keys = sorted(bounds)
        inside = [F.when((F.col(c) > bounds[c, r][0]) & (F.col(c) <= bounds[c, r][1]), F.col(c)) for c, r in keys]
        cuts = cells.agg(*[
            F.percentile(v, F.lit(bounds[k][2] / max(bounds[k][3] - 1, 1))) if bounds[k][3] <= enough
            else F.percentile_approx(v, [max(0.0, bounds[k][2] / bounds[k][3] - 0.001), min(1.0, bounds[k][2] / bounds[k][3] + 0.001)], 10_000)
            for k, v in zip(keys, inside, strict=True)
        ]).first()
        steps = {}
        for k, cut in zip(keys, cuts, strict=True):
            if bounds[k][3] <= enough:
                out[k] = float(cut)
            else:
                steps[k] = cut
        bounds = {k: bounds[k] for k in steps}
        if not bounds:
            break
        keys = sorted(bounds)
        # How many values of the bracket are below, and how many up to, each of the two cuts.
        counts = cells.agg(*[
            F.array(*[F.count_if((F.col(c) > bounds[c, r][0]) & test) for cut in steps[c, r] for test in (F.col(c) < cut, F.col(c) <= cut)])
            for c, r in keys
        ]).first()
        for k, (below_a, upto_a, below_b, upto_b) in zip(keys, counts, strict=True):
            low, high, rank, n = bounds.pop(k)
            a, b = steps[k]
            if rank < below_a:
                bounds[k] = (low, math.nextafter(a, -math.inf), rank, below_a)
            elif rank < upto_a:
                out[k] = float(a)
            elif rank < below_b:
                bounds[k] = (a, math.nextafter(b, -math.inf), rank - upto_a, below_b - upto_a)
            elif rank < upto_b:
                out[k] = float(b)
            else:
                bounds[k] = (b, high, rank - upto_b, n - upto_b)
    return out


def null_profile(df: DataFrame, row_id: str | None = ROW_ID) -> DataFrame:
    """Per column: position, column, rows, missing, missing_pct (2 decimals). One scan."""
    names = data_columns(df, row_id)
    one = df.agg(F.count("*").alias("rows"), *[F.count_if(col(c).isNull()).alias(f"m{i}") for i, c in enumerate(names)])
    cells = [F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"), F.col(f"m{i}").alias("missing")) for i, c in enumerate(names)]
    pct = F.when(F.col("rows") > 0, F.round(F.col("missing") / F.col("rows") * 100, 2)).otherwise(F.lit(0.0))
    return one.select("rows", F.inline(F.array(*cells))).select("position", "column", "rows", "missing", pct.alias("missing_pct"))


def missing_table(df: DataFrame, row_id: str | None = ROW_ID) -> DataFrame:
    """Columns with missing cells, most first."""
    return null_profile(df, row_id).where("missing > 0").select("column", "missing", "missing_pct").orderBy(F.desc("missing"), "column")


def distinct_counts(df: DataFrame, row_id: str | None = ROW_ID, names: list[str] | None = None) -> DataFrame:
    """(column, distinct): exact, without nulls. Cells go through one two-step aggregate, not an Expand per column."""
    names = names or data_columns(df, row_id)
    each = long_form(df, names).where("value IS NOT NULL").groupBy("name", "value").agg(F.lit(1).alias("x"))
    found = each.groupBy("name").agg(F.count("*").alias("n"))
    base = df.sparkSession.createDataFrame([(c,) for c in names], "column string")
    return base.join(found, base["column"] == found["name"], "left").select("column", F.coalesce("n", F.lit(0)).alias("distinct"))


def describe(df: DataFrame, names: list[str] | None = None, digits: int = 3) -> DataFrame:
    """Per numeric column: count, mean, std, min, q25, q50, q75, max. Quartiles are exact."""
    names = names or numeric_columns(df)
    quarts = quantiles(df, names, [0.25, 0.5, 0.75])
    kind = T.StructType([T.StructField("column", T.StringType()), *[T.StructField(x, T.DoubleType()) for x in ("q25", "q50", "q75")]])
    fixed = df.sparkSession.createDataFrame([(c, *quarts[c]) for c in names], kind)
    one = df.agg(*[F.struct(F.lit(c).alias("column"), F.count(col(c)).alias("count"), *[f(finite(c)).alias(x) for x, f in (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))]).alias(f"s{i}") for i, c in enumerate(names)])
    rows = one.select(F.inline(F.array(*[f"s{i}" for i in range(len(names))])))
    return rows.join(F.broadcast(fixed), "column").select(
        "column", "count", *[F.round(x, digits).alias(x) for x in ("mean", "std", "min", "q25", "q50", "q75", "max")]
    )


def samples(df: DataFrame, n: int = 3, width: int = 60, row_id: str = ROW_ID) -> DataFrame:
    """(column, sample): the first n values of each column in row order, cut to a width."""
    cells = long_form(df, data_columns(df, row_id), row_id).where("value IS NOT NULL")
    from pyspark.sql import Window

    first = cells.withColumn("rn", F.row_number().over(Window.partitionBy("name").orderBy(col(row_id)))).where(F.col("rn") <= n)
    got = first.groupBy(F.col("name").alias("column")).agg(F.sort_array(F.collect_list(F.struct("rn", F.substring("value", 1, width).alias("v")))).alias("s"))
    return got.select("column", F.col("s.v").alias("sample"))


def match_ratio(predicate, value):
    """The part of non-null values for which the predicate holds; 0 without any."""
    return F.coalesce(F.avg(F.when(value.isNotNull(), predicate.cast("double"))), F.lit(0.0))
