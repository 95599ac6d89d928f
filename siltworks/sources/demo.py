"""A small dirty table to try things on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.common import ROW_ID

_ROWS = (
    (1, "Ines", "Varga", "ines.varga@example.org", "+36 1 555 0101", 34, "2024-01-09", "Hungary", 41000, "pays on time"),
    (2, "Inés", "Varga", "INES.VARGA@example.org ", "+36 1 555 0101", 34, "09/01/2024", "Hungary", 41000, "  pays   on time "),
    (3, "Tomas", "Lind", "tomas(at)example", "46 8 555 0102", 29, "Feb 3 2024", "Sweden", 38500, None),
    (4, "Ada", "Okoro", "ada@example.net", "234-1-555-0103", 271, "2024-03-21", "Nigeria", 52000, "age to be checked"),
    (5, "Ada", "Okoro", "ada@example.net", "234-1-555-0103", 271, "2024-03-21", "Nigeria", 52000, "age to be checked"),
    (6, "Bo", None, "bo@example.com", None, 45, "2023-12-30", "Denmark", None, "  "),
    (7, None, None, None, None, None, None, None, None, None),
)


def demo(spark: SparkSession) -> DataFrame:
    schema = f"{ROW_ID} bigint, id bigint, first_name string, last_name string, email string, phone string, age bigint, signup_date string, country string, salary bigint, notes string"
    return spark.createDataFrame([(i, *r) for i, r in enumerate(_ROWS)], schema)
