from __future__ import annotations

import io
import zipfile

import pytest

from siltworks.config import CleanOptions, Limits, RowLimitExceeded
from siltworks.operators.common import ROW_ID
from siltworks.plans import batch
from siltworks.plans.report import text_report
from siltworks.sources import excel, export, files, pdf, tables


def write(tmp_path, name, data):
    p = tmp_path / name
    p.write_bytes(data if isinstance(data, bytes) else data.encode())
    return str(p)


def test_csv(spark, tmp_path):
    at = write(tmp_path, "a.csv", '﻿id,name,id,score,ok\n1,"x\ny",2,NA,true\n2,null,3,1.5,FALSE\n')
    df = tables.load(spark, at)
    assert df.columns == [ROW_ID, "id", "name", "id.1", "score", "ok"]
    assert dict(df.dtypes) == {ROW_ID: "bigint", "id": "bigint", "name": "string", "id.1": "bigint", "score": "double", "ok": "boolean"}
    assert [tuple(r) for r in df.orderBy(ROW_ID).collect()] == [(0, 1, "x\ny", 2, None, True), (1, 2, None, 3, 1.5, False)]


def test_csv_odd(spark, tmp_path):
    assert tables.load(spark, write(tmp_path, "h.csv", "a,b\n")) is None
    assert tables.load(spark, write(tmp_path, "e.csv", "")) is None
    assert tables.load(spark, write(tmp_path, "w.csv", "a,b\n1,2,3\n")) is None
    assert tables.load(spark, write(tmp_path, "x.txt", "a,b\n1,2\n")) is None
    latin = tables.load(spark, write(tmp_path, "c.csv", "a,b\ncafé,“hi”\n".encode("cp1252")))
    assert tuple(latin.first())[1:] == ("café", "“hi”")
    with pytest.raises(RowLimitExceeded) as e:
        tables.load(spark, write(tmp_path, "l.csv", "a\n" + "1\n" * 11), limits=Limits(max_rows=10))
    assert e.value.row_count == 11
    assert tables.load(spark, write(tmp_path, "m.csv", "a\n" + "1\n" * 10), limits=Limits(max_rows=10)).count() == 10


def test_excel(spark, tmp_path):
    data = excel.write_sheet(["a", "b", "a"], [(1, "x & <y>", 2.5), (None, "", True)], "S1")
    at = write(tmp_path, "t.xlsx", data)
    assert tables.sheet_names(spark, at) == ["S1"] and tables.sheet_names(spark, write(tmp_path, "bad.xlsx", b"no")) == []
    df = tables.load(spark, at)
    assert df.columns == [ROW_ID, "a", "b", "a.1"] and df.orderBy(ROW_ID).first().b == "x & <y>"
    assert tables.load(spark, at, sheet="none") is None
    with pytest.raises(RowLimitExceeded):
        tables.load(spark, at, limits=Limits(max_rows=1))
    spark.dataSource.register(excel.XlsxDataSource)
    assert spark.read.format("xlsx").option("path", at).schema("a string, b string, c string").load().count() == 2


def test_validate_and_signature(spark, tmp_path):
    a, b = write(tmp_path, "a.csv", "x\n1\n"), write(tmp_path, "b.csv", "x\n2\n")
    assert files.validate(spark, a) == (True, "")
    assert not files.validate(spark, None)[0] and not files.validate(spark, str(tmp_path / "no.csv"))[0]
    assert not files.validate(spark, write(tmp_path, "z.csv", ""))[0] and not files.validate(spark, write(tmp_path, "a.exe", "x"))[0]
    assert not files.validate(spark, a, Limits(max_bytes=2))[0]
    assert files.signature(spark, a, b) == files.signature(spark, b, a) != files.signature(spark, a)


def test_pages():
    assert files.parse_pages(" ") == ("all", []) and files.parse_pages("1, 3,x") == ("specific", [1, 3]) and files.parse_pages("x") == ("specific", [])
    assert pdf.chosen_pages(150, "all", None, Limits(max_pdf_pages=100)) is None
    assert pdf.chosen_pages(150, "specific", [1, 150, 151, 0, "2"], Limits(max_pdf_pages=100)) == [1, 150]
    assert len(pdf.chosen_pages(100, "all", None, Limits(max_pdf_pages=100))) == 100


def test_raw_table(spark, tmp_path):
    assert pdf.headers(["a", None, " a", ""]) == ["a", "Col_2", "a_1", "Col_4"]
    df = pdf.raw_table(spark, [["a", None, "a"], ["1"], ["2", "3", "4", "5"], [None, " "], None])
    assert df.columns == [ROW_ID, "a", "Col_2", "a_1"] and df.count() == 2
    assert pdf.raw_table(spark, [["a"]]) is None and pdf.raw_table(spark, [["a"], [" "]]) is None
    both = pdf.union_with_provenance([(df, 1, 0, "tables"), (spark.createDataFrame([("x",)], "z string"), 2, 0, "text")])
    assert both.count() == 3 and {"_page", "z", "a"} <= set(both.columns)
    got = pdf.extract_tables(spark, write(tmp_path, "no.pdf", b"no"))
    assert isinstance(got, list) and got[0]["method"] == "error"


def test_names():
    assert export.safe_sheet_name("a/b:c*" + "x" * 40) == ("a_b_c_" + "x" * 40)[:31] and export.safe_sheet_name("") == "Cleaned Data"
    assert export.safe_stem("../../etc/pass:wd.csv") == "pass_wd" and export.safe_stem("...") == "data" and export.safe_stem("a__b.xlsx") == "a_b"


def test_batch(spark, tmp_path):
    good = write(tmp_path, "a.csv", "x,y\n1,\n1,\n2,b\n")
    results, before, errors = batch.clean_files(spark, [good, str(tmp_path / "no.csv"), write(tmp_path, "e.csv", "")], CleanOptions())
    assert len(results) == 1 and len(errors) == 2
    assert tuple(batch.summary(spark, results).first()) == ("a.csv", 3, 2, 1, 1, 0)
    twice = [results[0], ("A.xlsx", *results[0][1:])]
    with zipfile.ZipFile(io.BytesIO(batch.batch_zip(twice, text_report, before))) as z:
        assert set(z.namelist()) == {f"{k}{s}{e}" for s in ("a", "A_2") for k, e in (("cleaned_", ".xlsx"), ("cleaned_", ".csv"), ("reports/report_", ".txt"))}
        assert z.read("cleaned_a.csv").startswith(b"\xef\xbb\xbfx,y") and excel.read_sheet(z.read("cleaned_a.xlsx"))[0] == ["x", "y"]
    seen = []
    batch.batch_zip(results, lambda *a: seen.append(len(a)) or "")
    batch.batch_zip(results, lambda *a: seen.append(a[2]) or "", {})
    assert seen == [2, None]
    for wrong in ((1, text_report), (results, "no")):
        with pytest.raises(TypeError):
            batch.batch_zip(*wrong)
    with pytest.raises(ValueError):
        export.to_bytes(results[0][1], "xls")
    with pytest.raises(TypeError):
        export.to_bytes([1], "csv")


def test_page_limit_record():
    got = pdf.page_limit_record(150, 100, "/in/some.pdf")
    assert (got["page"], got["method"], got["total_pages"], got["max_pages"], got["filename"], got["dataframe"], got["rows"]) == (None, "page_limit_exceeded", 150, 100, "some.pdf", None, 0)
