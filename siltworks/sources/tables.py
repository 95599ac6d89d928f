"""Loading of CSV and Excel files as typed tables with a row id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Limits, RowLimitExceeded
from ..functions.text import NUMBER, full, strip
from ..operators.common import ROW_ID, col, data_columns, with_row_id
from . import excel
from .files import content, extension

# The texts that mean a missing value.
NA_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def dedupe_header(names: list[str]) -> list[str]:
    """Repeats get .1, .2, ...; blank names `Unnamed: i`."""
    seen: dict[str, int] = {}
    out = []
    for i, n in enumerate(names):
        n = n if n else f"Unnamed: {i}"
        k = seen.get(n, 0)
        seen[n] = k + 1
        out.append(n if not k else f"{n}.{k}")
    return out


def encoding(spark: SparkSession, path: str) -> str:
    """UTF-8 if the whole content is; else Windows-1252, unless a byte that it lacks occurs; else Latin-1."""
    # The text source hands on the bytes of each line as they are; no byte of a UTF-8 sequence ends a line.
    line = F.col("value")
    valid, lacking = spark.read.text(path).agg(
        F.bool_and(F.is_valid_utf8(line)), F.bool_or(F.hex(line.cast("binary")).rlike("^(?:..)*?(?:81|8D|8F|90|9D)"))
    ).first()
    return "ISO-8859-1" if lacking and not valid else "windows-1252" if valid is False else "UTF-8"


def typed(df: DataFrame, row_id: str = ROW_ID) -> DataFrame:
    """Text columns whose values are all whole numbers, numbers or true/false get that type. One scan decides."""
    names = data_columns(df, row_id)
    if not names:
        return df
    whole = r"[-+]?\d{1,18}"
    number = NUMBER + r"|[-+]?\d+\.|[-+]?\.\d+([eE][-+]?\d+)?|[-+]?(inf|Infinity)"
    tests = [F.struct(F.count(col(c)), *[F.count_if(t) for t in (full(strip(col(c)), whole), full(strip(col(c)), number), full(col(c), "[Tt]rue|TRUE|[Ff]alse|FALSE"))]) for c in names]
    votes = df.agg(*tests).first()
    new = {}
    for c, (n, ints, floats, bools) in zip(names, votes, strict=True):
        kind = None if not n else "bigint" if ints == n else "double" if floats == n else "boolean" if bools == n else None
        if kind:
            new[c] = F.expr(f"try_cast(trim(`{c.replace('`', '``')}`) AS {kind})")
    return df.withColumns(new) if new else df


def load_csv(spark: SparkSession, path: str, limits: Limits = Limits()) -> DataFrame | None:
    """A comma-separated file with a header; None if it has no rows or a row has too many fields."""
    code = encoding(spark, path)
    if code == "windows-1252":  # Spark has no such charset by default: read Latin-1, then map the 27 letters
        code = "ISO-8859-1"
        from ..functions.text import CP1252, CP1252_BYTES

        fix = lambda c: F.translate(c, CP1252_BYTES, CP1252)
    else:
        fix = lambda c: c
    options = {"multiLine": True, "encoding": code, "quote": '"', "escape": '"', "mode": "FAILFAST", "maxCharsPerColumn": -1}
    head = spark.read.options(**options).csv(path).limit(1).collect()
    if not head:
        return None
    names = dedupe_header([x or "" for x in head[0]])
    schema = ", ".join(f"`c{i}` string" for i in range(len(names)))
    raw = spark.read.options(header=True, enforceSchema=True, **options).schema(schema).csv(path)
    cells = [fix(F.col(f"c{i}")) for i in range(len(names))]
    df = raw.select(*[F.when(~c.isin(*NA_TOKENS), c).alias(n) for n, c in zip(names, cells, strict=True)])
    if limits.max_rows is not None and df.limit(limits.max_rows + 1).count() > limits.max_rows:
        raise RowLimitExceeded(df.count(), limits.max_rows, path)
    try:
        if df.isEmpty():
            return None
        return typed(with_row_id(df))
    except Exception as e:
        if "MALFORMED_RECORD" in str(e) or "FAILED_READ_FILE" in str(e):
            return None
        raise


def load_excel(spark: SparkSession, path: str, sheet: str | None = None, limits: Limits = Limits()) -> DataFrame | None:
    """A sheet of a workbook, by default the first; its first row is the header."""
    if extension(path) == "xls":
        raise NotImplementedError("legacy .xls workbooks need an optional reader that is not installed")
    try:
        rows = excel.read_sheet(content(spark, path), sheet)
    except (KeyError, ValueError, OSError, excel.zipfile.BadZipFile, excel.ElementTree.ParseError):
        return None
    if len(rows) < 2:
        return None
    if limits.max_rows is not None and len(rows) - 1 > limits.max_rows:
        raise RowLimitExceeded(len(rows) - 1, limits.max_rows, path)
    width = max(map(len, rows))
    names = dedupe_header([str(x) if x is not None else "" for x in [*rows[0], *[None] * (width - len(rows[0]))]])
    data = [(i, *[None if x is None else str(x) for x in r], *[None] * (width - len(r))) for i, r in enumerate(rows[1:])]
    schema = ", ".join([f"`{ROW_ID}` bigint", *[f"`{n.replace('`', '``')}` string" for n in names]])
    return typed(spark.createDataFrame(data, schema))


def load(spark: SparkSession, path: str, sheet: str | None = None, limits: Limits = Limits()) -> DataFrame | None:
    """A table from a .csv, .xlsx or .parquet path; None for other kinds and for files without rows."""
    kind = extension(path)
    if kind == "csv":
        return None if spark.read.text(path).isEmpty() else load_csv(spark, path, limits)
    if kind in ("xlsx", "xls"):
        return load_excel(spark, path, sheet, limits)
    if kind == "parquet":
        return with_row_id(spark.read.parquet(path))
    return None


def sheet_names(spark: SparkSession, path: str) -> list[str]:
    try:
        return excel.sheet_names(content(spark, path)) if extension(path) == "xlsx" else []
    except Exception:  # whatever is wrong with a file, it has no sheets
        return []
