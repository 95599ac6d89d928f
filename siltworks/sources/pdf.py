"""Tables from PDF files. Parsing needs pdfplumber, which is optional; the table logic does not."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Limits
from .files import content

CELLS = "file string, page int, table_index int, method string, row_no int, col_no int, header string, value string"


def headers(first: list | None) -> list[str]:
    """Blank headers become Col_i, repeats h_1, h_2, ..."""
    seen: Counter[str] = Counter()
    out = []
    for i, h in enumerate(first or []):
        name = str(h).strip() if h is not None and str(h).strip() else f"Col_{i + 1}"
        out.append(f"{name}_{seen[name]}" if seen[name] else name)
        seen[name] += 1
    return out


def fit_rows(cells: Column, width: int) -> Column:
    """An array of cells padded with nulls, or cut, to a width."""
    return F.slice(F.concat(F.coalesce(cells, F.array().cast("array<string>")), F.array_repeat(F.lit(None).cast("string"), width)), 1, width)


def raw_table(spark: SparkSession, rows: list[list | None]) -> DataFrame | None:
    """A table from a header and ragged rows; blank rows go; None if nothing is left."""
    if not rows or len(rows) < 2 or not rows[0]:
        return None
    names = headers(rows[0])
    data = [(i, [None if x is None else str(x) for x in r]) for i, r in enumerate(rows[1:]) if r is not None]
    if not data:
        return None
    df = spark.createDataFrame(data, "_row_id bigint, cells array<string>").withColumn("cells", fit_rows(F.col("cells"), len(names)))
    df = df.where(F.exists("cells", lambda x: F.coalesce(F.trim(x) != "", F.lit(False))))
    return None if df.isEmpty() else df.select("_row_id", *[F.get("cells", F.lit(i)).alias(n) for i, n in enumerate(names)])


def empty_result(page: int) -> dict:
    return {"page": page, "table_index": None, "method": "none", "dataframe": None, "rows": 0, "cols": 0}


def page_limit_record(total: int, most: int, path: str) -> dict:
    """What stands for a file with too many pages, of which none is read."""
    return empty_result(0) | {"page": None, "method": "page_limit_exceeded", "total_pages": total, "max_pages": most, "filename": path.rpartition("/")[2]}


def chosen_pages(n: int, selection: str, specific: list | None, limits: Limits) -> list[int] | None:
    """1-based pages to read; None if `all` of them are more than the limit."""
    if selection == "specific":
        return [p for p in (specific or []) if isinstance(p, int) and not isinstance(p, bool) and 1 <= p <= n]
    return None if limits.max_pdf_pages is not None and n > limits.max_pdf_pages else list(range(1, n + 1))


def extract_tables(spark: SparkSession, path: str, selection: str = "all", specific: list[int] | None = None, progress=None, limits: Limits = Limits()) -> list[dict]:
    """Per table: page, table_index, method, dataframe, rows, cols. Tables, else one table, else text lines, else an empty mark."""
    try:
        import pdfplumber
    except ImportError:
        return [empty_result(0) | {"method": "error", "error": "pdfplumber is not installed"}]
    import io

    out: list[dict] = []
    try:
        with pdfplumber.open(io.BytesIO(content(spark, path))) as pdf:
            pages = chosen_pages(len(pdf.pages), selection, specific, limits)
            if pages is None:
                return [page_limit_record(len(pdf.pages), limits.max_pdf_pages, path)]
            for k, number in enumerate(pages):
                if progress:
                    progress((k + 1) / len(pages), f"page {number}")
                page = pdf.pages[number - 1]
                got = [("tables", t) for t in page.extract_tables() or []] or [("table", t) for t in [page.extract_table()] if t]
                found = [(m, df) for m, t in got if (df := raw_table(spark, t)) is not None]
                if not found and (said := page.extract_text()):
                    lines = [(i, x.strip()) for i, x in enumerate(said.splitlines()) if x.strip()]
                    found = [("text", spark.createDataFrame(lines, "_row_id bigint, `Text Content` string"))] if lines else []
                out += [{"page": number, "table_index": i, "method": m, "dataframe": df, "rows": df.count(), "cols": len(df.columns) - 1} for i, (m, df) in enumerate(found)] or [empty_result(number)]
    except Exception as e:  # a broken file is one record
        return [empty_result(0) | {"method": "error", "error": str(e)}]
    return out


def union_with_provenance(tables: list[tuple[DataFrame, int, int, str]]) -> DataFrame | None:
    """All tables under one another with _page, _table and _method; columns that a table lacks are null."""
    out = None
    for df, page, table, method in tables:
        df = df.withColumns({"_page": F.lit(page), "_table": F.lit(table), "_method": F.lit(method)})
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out
