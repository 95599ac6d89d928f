"""The cleaning pipeline: fixed steps, few passes, an audit report."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from datetime import datetime
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DROP, CleanOptions
from ..functions import text
from ..functions.headers import normalize_headers, strip_headers
from ..operators.columns import duplicate_columns, fingerprint_aggregates, without
from ..operators.common import ROW_ID, col, comparable, data_columns, nan_to_null, text_columns
from ..operators.impute import fill
from ..operators.rows import dedupe_keep_first, drop_empty_rows

STEPS = ("headers", "encoding", "white space", "emails, phones, dates", "empty rows", "empty columns", "duplicate columns", "duplicate rows", "constant columns", "missing values", "snake case")
COUNTERS = (
    "rows_before", "cols_before", "missing_count_before", "rows_after", "cols_after", "missing_count_after", "empty_rows_removed", "duplicates_removed",
    "empty_cols_removed", "dup_cols_removed", "const_cols_removed", "missing_filled", "missing_dropped_rows", "headers_stripped", "headers_snake_cased",
    "encoding_repaired", "spaces_trimmed", "emails_normalized", "phones_normalized", "dates_normalized",
)


def cell_steps(options: CleanOptions) -> list[tuple[str, Callable[[str], bool], Callable]]:
    """(counter, whether a stripped column takes part, function) of the steps on cells, in order."""
    named = lambda cols: (lambda c, s={x.strip() for x in cols}: c in s)
    any_ = lambda c: True
    return [
        x for on, *x in (
            (options.fix_encoding, "encoding_repaired", any_, text.fix_encoding),
            (options.trim_spaces, "spaces_trimmed", any_, text.trim_spaces),
            (options.normalize_emails, "emails_normalized", named(options.email_columns), text.normalize_email),
            (options.normalize_phones, "phones_normalized", named(options.phone_columns), text.normalize_phone),
            (options.normalize_dates, "dates_normalized", named(options.date_columns), lambda c: text.normalize_date(c, options.date_target, options.lenient_dates)),
        ) if on
    ]


def clean(df: DataFrame, options: CleanOptions = CleanOptions(), progress: Callable[[float, str], None] | None = None, row_id: str = ROW_ID) -> tuple[DataFrame, dict]:
    """The cleaned table (with its row id) and the report.

    `df` needs a row id, which sources add; it gives the order for keep-first. Steps on cells and rows are one lazy
    projection and filter; what depends on data is decided in aggregates. The first, over the raw and the cleaned cells,
    has the counters and the empty columns. Then the distinct rows are kept (persisted, so that nothing before is computed
    again), and one aggregate over them has their number, missing cells, constant and equal columns: columns are equal in
    all rows if they are in the distinct ones. The fill adds one for medians and one for modes.
    Counters follow the steps' own tables: missing_filled is the change around the fill alone.
    """
    if not isinstance(df, DataFrame):
        raise TypeError("df must be a DataFrame")
    report: dict = {"timestamp": datetime.now().strftime("%Y-%m-%d %H:%M:%S"), "fill_strategy_used": options.fill} | dict.fromkeys(COUNTERS, 0)

    def tick(done: int) -> None:
        if progress:
            progress(done / len(STEPS), STEPS[done - 1])

    raw = nan_to_null(df)
    names = data_columns(raw, row_id)
    rest, report["headers_stripped"] = strip_headers(raw.select(*map(col, names)))
    table = raw.toDF(*[row_id if c == row_id else rest.columns[names.index(c)] for c in raw.columns])
    tick(1)

    # Each text column's value before and after every step, so that one aggregate counts all changes.
    texts, counted = text_columns(table, row_id), []
    wide = table
    for counter, takes, function in cell_steps(options):
        new = {}
        for c in texts:
            if takes(c):
                new[f"{c}\x00{counter}"] = col(c)
                counted.append((counter, c))
        wide = wide.withColumns(new | {c: function(col(c)) for c in texts if takes(c)})
    cells = data_columns(table, row_id)
    blank = reduce(lambda a, b: a & b, [col(c).isNull() for c in cells], F.lit(True))
    gone = blank if options.remove_empty_rows and cells else F.lit(False)
    last: dict[str, list[str]] = {}
    for counter, c in counted:
        last.setdefault(c, []).append(counter)
    after = {(counter, c): (f"{c}\x00{last[c][last[c].index(counter) + 1]}" if counter != last[c][-1] else c) for counter, c in counted}
    changes = [F.count_if(text.changed(col(f"{c}\x00{counter}"), col(after[counter, c]))) for counter, c in counted]
    first = {c: f"{c}\x00{steps[0]}" for c, steps in last.items()}
    facts = wide.agg(
        F.count("*"), F.count_if(gone), *changes, *[F.count(col(c)) for c in cells], *[F.count_if(col(first.get(c, c)).isNull()) for c in cells]
    ).first()
    report["rows_before"], report["cols_before"] = facts[0], len(cells)
    report["empty_rows_removed"] = facts[1]
    for (counter, _), n in zip(counted, facts[2:], strict=False):
        report[counter] += n
    values = dict(zip(cells, facts[2 + len(counted) :][: len(cells)], strict=True))
    report["missing_count_before"] = sum(facts[2 + len(counted) + len(cells) :])
    tick(4)

    table = wide.select(*[col(c) for c in table.columns])
    if options.remove_empty_rows and cells:
        table = drop_empty_rows(table, row_id)
    tick(5)
    if options.remove_empty_cols:
        table, report["empty_cols_removed"] = without(table, [c for c, n in values.items() if not n])
    tick(6)
    rows = facts[0] - facts[1]
    table = dedupe_keep_first(table, row_id).persist(StorageLevel.MEMORY_AND_DISK)
    names, kinds = data_columns(table, row_id), {f.name: f.dataType for f in table.schema}
    value = {c: comparable(c, kinds[c]) for c in names}
    found = table.agg(
        F.count("*"), *[F.count_if(col(c).isNull()) for c in names], *[F.min(value[c]).eqNullSafe(F.max(value[c])) for c in names], *fingerprint_aggregates(table, row_id)
    ).first()
    kept, k = found[0], len(names)
    missing_of, constant, marks = (dict(zip(names, found[1 + i * k : 1 + (i + 1) * k], strict=True)) for i in range(3))
    if options.remove_dup_cols:
        table, report["dup_cols_removed"] = without(table, duplicate_columns(table, row_id, {c: (kinds[c].simpleString(), m) for c, m in marks.items()}))
    tick(7)
    report["duplicates_removed"] = rows - kept
    tick(8)
    if options.remove_const_cols:
        table, report["const_cols_removed"] = without(table, [c for c in data_columns(table, row_id) if constant[c]])
    tick(9)
    missing_of = {c: missing_of[c] for c in data_columns(table, row_id)}
    missing = sum(missing_of.values())
    report["missing_count_after"] = missing
    if missing:
        table, affected = fill(table, options.fill, row_id, missing_of, kept)
        if options.fill == DROP:
            report["missing_dropped_rows"] = affected
            kept -= affected
            affected = missing
        report["missing_filled"], report["missing_count_after"] = affected, missing - affected
    tick(10)
    if options.snake_case:
        data = data_columns(table, row_id)
        new, report["headers_snake_cased"] = normalize_headers(table.select(*map(col, data)))
        table = table.toDF(*[row_id if c == row_id else new.columns[data.index(c)] for c in table.columns])
    tick(11)
    report["rows_after"], report["cols_after"] = kept, len(data_columns(table, row_id))
    return table, report


def with_semantic_columns(options: CleanOptions, types: dict[str, str]) -> CleanOptions:
    """Options whose e-mail, phone and date columns are those of that semantic type, where the caller named none."""
    of = lambda named, kind: named or tuple(c for c, t in types.items() if t == kind)
    return replace(options, email_columns=of(options.email_columns, "email"), phone_columns=of(options.phone_columns, "phone"), date_columns=of(options.date_columns, "date"))
