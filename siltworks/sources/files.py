"""Checks and signatures of files, by Spark's readers only, so that any file system works."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Limits

EXTENSIONS = ("csv", "pdf", "xls", "xlsx")


def extension(name: str) -> str:
    return name.rpartition(".")[2].lower() if "." in name.rpartition("/")[2] else ""


def binary(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.format("binaryFile").load(list(paths))


def content(spark: SparkSession, path: str) -> bytes:
    row = binary(spark, path).select("content").first()
    return bytes(row[0]) if row and row[0] is not None else b""  # empty files may give no row


def validate(spark: SparkSession, path: str | None, limits: Limits = Limits()) -> tuple[bool, str]:
    """Whether a file can be loaded, and why not."""
    if not path:
        return False, "no file"
    if extension(path) not in EXTENSIONS:
        return False, f"not one of {', '.join(EXTENSIONS)}: {path}"
    try:
        size = binary(spark, path).select("length").first()[0]
    except Exception as e:  # missing, unreadable
        return False, f"its size cannot be read: {str(e).splitlines()[0]}"
    if size == 0:
        return False, "the file is empty"
    if limits.max_bytes is not None and size > limits.max_bytes:
        return False, f"{size:,} bytes, more than the limit of {limits.max_bytes:,}"
    return True, ""


def signatures(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, name, length, signature): name, size and the first 16 hex digits of the content's SHA-256."""
    name = F.regexp_extract("path", "[^/]*$", 0)
    return binary(spark, *paths).select("path", name.alias("name"), "length", F.concat_ws("_", name, F.col("length").cast("string"), F.substring(F.sha2("content", 256), 1, 16)).alias("signature"))


def signature(spark: SparkSession, *paths: str) -> str:
    """One signature of several files, whatever their order."""
    if not paths:
        return ""
    return signatures(spark, *paths).agg(F.array_join(F.array_sort(F.collect_list("signature")), "|")).first()[0]


def parse_pages(spec: str | None) -> tuple[str, list[int]]:
    """('all', []) for a blank spec, else ('specific', the whole numbers in it)."""
    if not spec or not spec.strip():
        return "all", []
    return "specific", [int(t) for t in (x.strip() for x in spec.split(",")) if t.isdigit()]
