"""Reading and writing of .xlsx workbooks with the standard library, and a Spark data source for them."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterable, Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
MAX_ROWS = 1_048_576
_ILLEGAL = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f]")


def _sheets(z: zipfile.ZipFile) -> list[tuple[str, str]]:
    links = {r.get("Id"): r.get("Target", "") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    out = []
    for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{MAIN}sheet"):
        at = links[s.get(f"{LINK}id")]
        out.append((s.get("name", ""), at.lstrip("/") if at.startswith("/") else f"xl/{at}"))
    return out


def sheet_names(data: bytes) -> list[str]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return [n for n, _ in _sheets(z)]


def _column(ref: str) -> int:
    n = 0
    for c in ref:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


def read_sheet(data: bytes, sheet: str | None = None) -> list[list]:
    """Rows of a sheet, the first by default: text, float, int, bool or None. An unknown sheet is a KeyError."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        sheets = _sheets(z)
        at = dict(sheets)[sheet] if sheet is not None else sheets[0][1]
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{MAIN}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{MAIN}si")]
        rows: list[list] = []
        for row in ElementTree.fromstring(z.read(at)).iter(f"{MAIN}row"):
            place = int(row.get("r", len(rows) + 1)) - 1
            rows += [[] for _ in range(place - len(rows))]
            cells: list = []
            for c in row.iter(f"{MAIN}c"):
                i = _column(c.get("r", "")) if c.get("r") else len(cells)
                cells += [None] * (i - len(cells))
                cells.append(_value(c, shared))
            rows.append(cells)
        while rows and all(x is None for x in rows[-1]):
            rows.pop()
        return rows


def _value(c: ElementTree.Element, shared: list[str]):
    kind, v = c.get("t", "n"), c.find(f"{MAIN}v")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in c.iter(f"{MAIN}t")) or None
    if v is None or v.text is None:
        return None
    if kind == "s":
        return shared[int(v.text)]
    if kind == "b":
        return v.text == "1"
    if kind == "n":
        x = float(v.text)
        return int(x) if x.is_integer() and "e" not in v.text.lower() and abs(x) < 2**53 else x
    return v.text


def write_sheet(names: list[str], rows: Iterable[tuple], sheet: str) -> bytes:
    """A workbook of one sheet. More rows than a sheet takes are a ValueError."""

    def cell(x) -> str:
        if x is None or x != x:
            return "<c/>"
        if isinstance(x, bool):
            return f'<c t="b"><v>{int(x)}</v></c>'
        if isinstance(x, (int, float)) and abs(x) != float("inf"):
            return f"<c><v>{x!r}</v></c>"
        return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(_ILLEGAL.sub("", str(x)))}</t></is></c>'

    def body() -> Iterator[str]:
        yield f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{MAIN[1:-1]}"><sheetData>'
        for i, r in enumerate([tuple(names), *rows] if isinstance(rows, list) else _chain(names, rows)):
            if i >= MAX_ROWS:
                raise ValueError(f"a sheet takes {MAX_ROWS:,} rows")
            yield f"<row>{''.join(map(cell, r))}</row>"
        yield "</sheetData></worksheet>"

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>')
        z.writestr("_rels/.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{LINK[1:-1]}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="{MAIN[1:-1]}" xmlns:r="{LINK[1:-1]}"><sheets><sheet name="{escape(sheet, {chr(34): "&quot;"})}" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{LINK[1:-1]}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        with z.open("xl/worksheets/sheet1.xml", "w", force_zip64=True) as f:
            for part in body():
                f.write(part.encode())
    return out.getvalue()


def _chain(names: list[str], rows: Iterable[tuple]) -> Iterator[tuple]:
    yield tuple(names)
    yield from rows


class XlsxDataSource(DataSource):
    """`spark.read.format("xlsx").option("path", ...)`: cells of one sheet as text, one partition per file."""

    @classmethod
    def name(cls) -> str:
        return "xlsx"

    def _paths(self) -> list[str]:
        return [p for p in self.options.get("path", "").split(",") if p]

    def schema(self) -> str:
        with open(self._paths()[0], "rb") as f:
            head = read_sheet(f.read(), self.options.get("sheet"))[0]
        return ", ".join(f"`{str(n).replace('`', '``')}` string" for n in head)

    def reader(self, schema) -> DataSourceReader:
        return _XlsxReader(self._paths(), self.options.get("sheet"), len(schema.fields))


class _XlsxReader(DataSourceReader):
    def __init__(self, paths: list[str], sheet: str | None, width: int) -> None:
        self.paths, self.sheet, self.width = paths, sheet, width

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.paths]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with open(partition.value, "rb") as f:
            rows = read_sheet(f.read(), self.sheet)
        for r in rows[1:]:
            cells = [None if x is None else str(x) for x in r[: self.width]]
            yield tuple(cells + [None] * (self.width - len(cells)))
