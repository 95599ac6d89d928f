"""Scalar functions against plain Python statements of their rules."""

from __future__ import annotations

import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from siltworks.functions import headers, numbers, text

VALUES = [None, "", "  ", "a  b", " x  y\x1c", "Ana@Example.ORG ", "no mail", "ü@exämple.org", "+1 (555) 010-2030", "none", "٣٤٥", "2024-01-05", "5/1/2024", "13/1/2024", "1/13/2024",
          "Feb 3 2024", "february 3, 2024", "3 Feb 2024", "31-12-2023", "n/a", "24-1-5", "12345", "-3.5e4", "$1,200.50", "45 %", "https://x.org/a", "1 555 0102030"]


def run(spark, f, values=VALUES):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.x for r in df.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def strip(v):
    return v.strip()


def test_trim(spark):
    want = [None if v is None else re.sub(r"\s+", " ", v).strip() or None for v in VALUES]
    assert run(spark, text.trim_spaces) == want


def test_email(spark):
    shape = re.compile(r"[\w._%+-]+@[\w.-]+\.[a-zA-Z]{2,}")
    want = [v if v is None or not shape.fullmatch(v.strip().lower()) else v.strip().lower() for v in VALUES]
    assert run(spark, text.normalize_email) == want
    assert run(spark, text.invalid_email) == [v is not None and not shape.fullmatch(v.strip().lower()) for v in VALUES]


def test_phone(spark):
    def one(v):
        if v is None:
            return None
        d = re.sub(r"[^\d]", "", v.strip())
        return v if not d else ("+" if v.strip().startswith("+") else "") + d

    assert run(spark, text.normalize_phone) == [one(v) for v in VALUES]


@pytest.mark.parametrize("target", ["%Y-%m-%d", "%d/%m/%Y", "%m/%d/%Y", "%d-%m-%Y"])
def test_date(spark, target):
    formats = ["%Y-%m-%d", "%Y/%m/%d", "%d/%m/%Y", "%m/%d/%Y", "%d-%m-%Y", "%B %d, %Y", "%b %d, %Y", "%d %B %Y", "%d %b %Y", "%B %d %Y", "%b %d %Y"]

    def one(v):
        if v is None or not v.strip():
            return None
        for f in formats:
            try:
                return datetime.strptime(v.strip(), f).strftime(target)
            except ValueError:
                pass
        return v

    some = [v for v in VALUES if v is None or " " not in v]
    assert run(spark, lambda c: text.normalize_date(c, target), some) == [one(v) for v in some]


def test_date_lenient(spark):
    assert run(spark, lambda c: text.normalize_date(c, lenient=True), ["Jan 5 2024 10:30", "nope", None]) == ["2024-01-05", "nope", None]


def test_encoding(spark):
    good = ["café", "plain", "日本", None, "Ã"]
    broken = [x.encode().decode("latin-1") for x in ("café", "naïve ñ")] + ["“quoted” – dash".encode().decode("cp1252", "replace")]
    assert run(spark, text.fix_encoding, good) == good
    assert run(spark, text.fix_encoding, broken)[:2] == ["café", "naïve ñ"]
    assert run(spark, text.fix_encoding, ["itâ€™s"]) == ["it’s"]


def test_changed(spark):
    df = spark.createDataFrame([(None, None), ("a", "a"), ("a", None), ("a", "b"), (None, "b")], "x string, y string")
    assert [r.c for r in df.select(text.changed(F.col("x"), F.col("y")).alias("c")).collect()] == [False, False, True, True, True]


def test_shapes(spark):
    of = lambda f: [v for v, x in zip(VALUES, run(spark, f), strict=True) if x]
    assert of(text.looks_number) == ["٣٤٥", "12345", "-3.5e4"]
    assert of(text.looks_url) == ["https://x.org/a"]
    assert of(text.looks_percent) == ["45 %"]
    assert "$1,200.50" in of(text.looks_currency)
    assert {"2024-01-05", "5/1/2024", "Feb 3 2024", "3 Feb 2024"} <= set(of(text.looks_date))
    assert not set(of(text.looks_phone)) & set(of(text.looks_date))
    assert "1 555 0102030" in of(text.looks_phone) or "+1 (555) 010-2030" in of(text.looks_phone)


def test_headers():
    assert headers.snake_case(" First Name ") == "first_name"
    assert headers.snake_case("totalAmount-USD (%)") == "total_amount_usd"
    assert headers.unique(["a", "a", "a_2", "", " "]) == ["a", "a_3", "a_2", "column", "column_2"]
    assert headers.type_by_name("signup_date") == "date"
    assert headers.type_by_name("user_phone") == "phone"
    assert headers.type_by_name("age") is None
    assert headers.is_key_name("order_id") and not headers.is_key_name("idle")


def test_snake_values(spark):
    values = ["First Name", "totalAmount-USD", "  x  ", None]
    assert run(spark, text.snake_case, values) == [None if v is None else headers.snake_case(v) for v in values]


def test_numbers(spark):
    assert [numbers.score_label(x) for x in (100, 90, 89, 70, 50, 49)] == ["Excellent", "Excellent", "Good", "Good", "Needs Attention", "Poor"]
    assert len({numbers.score_sign(x) for x in (95, 75, 55, 5)}) == 4
    assert [numbers.readable_size(x) for x in (-1, 5, 2048, 3 << 20, 5 << 30)] == ["0 B", "5 B", "2.0 KB", "3.00 MB", "5.00 GB"]
    assert numbers.clamp(99.9) == 99 and numbers.percent(1, 0) == 0
    got = spark.createDataFrame([(float(x),) for x in (5, 2048, 3 << 20)], "n double").select(numbers.readable_size_col(F.col("n"))).collect()
    assert [r[0] for r in got] == ["5 B", "2.0 KB", "3.00 MB"]
