"""What the operators share: words, materialised tables and ranks over range-sorted rows."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The separators between words: space, and U+0009 to U+000D. `bytes.split()` splits on the same six.
BLANKS = " \t\n\x0b\f\r"
BLANK_CLASS = r"[\x20\x09-\x0D]"


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stripped(text: Column) -> Column:
    """The text without separators at its ends; null is empty."""
    return F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))


def words(text: Column) -> Column:
    """All words of a text as an array; null and blank texts have none."""
    t = stripped(text)
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, f"{BLANK_CLASS}+"))


def n_words(text: Column) -> Column:
    t = stripped(text)
    return F.when(t == "", 0).otherwise(F.size(F.split(t, f"{BLANK_CLASS}+"))).cast("long")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it; where it names none, a local master gets one of its own."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="siltworks-")
        spark.sparkContext.setCheckpointDir(at)
    return at


def settle(df: DataFrame) -> DataFrame:
    """The same rows, in the same partitions and order, read from a reliable checkpoint: lost executors cost no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def settled(df: DataFrame, per: int = 50_000) -> tuple[DataFrame, int]:
    """Like settle(), with the number of rows; read in partitions of some `per` rows, so that few rows make few tasks."""
    out = settle(df)
    n = out.count()
    return out.coalesce(1 + n // per), n


def release(spark: SparkSession) -> None:
    """Lets Spark delete shuffle files that nothing refers to any more, and checkpoints where the session has
    spark.cleaner.referenceTracking.cleanCheckpoints set: the driver's collector finds them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def store(df: DataFrame) -> DataFrame:
    """Like settle(), as a compressed Parquet table, for wide rows; partitions and order may differ when it is read."""
    at = f"{shared_dir(df.sparkSession).rstrip('/')}/siltworks-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def remove(spark: SparkSession, at: str) -> None:
    """Deletes a folder, in whatever file system it is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def discard(*tables: DataFrame) -> None:
    """Deletes tables of store() that no later result is read from."""
    for df in tables:
        for name in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if "/siltworks-" in name:
                remove(df.sparkSession, name)


def plus(df: DataFrame, **columns: str) -> T.StructType:
    """The schema of `df` with more columns."""
    return T.StructType([*df.schema.fields, *(T.StructField(k, T.StructType.fromDDL(f"x {v}")[0].dataType) for k, v in columns.items())])


def ranked(df: DataFrame, *order: Column, weight: str | None = None) -> DataFrame:
    """Range-sorts the rows and adds `pos` (rank from 0) and, for a `weight`, `before` (sum of the weights of all earlier rows).

    Rows are dealt by ranges of the whole sort key, so no group lands in one task as long as the key ends in
    something distinct. The driver gets one row per partition. `order` must not hold nulls that matter: nulls sort first.
    """
    rows = settle(df.repartitionByRange(*order).sortWithinPartitions(*order))
    part = F.spark_partition_id().alias("p")
    sums = rows.groupBy(part).agg(F.count("*").alias("n"), (F.sum(weight) if weight else F.lit(0)).cast("long").alias("w"))
    starts, n, w = {}, 0, 0
    for r in sorted(sums.collect()):
        starts[r.p] = (n, w)
        n, w = n + r.n, w + (r.w or 0)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at, sum_ = starts.get(TaskContext.get().partitionId(), (0, 0))
        for b in batches:
            more = [pa.array(np.arange(at, at + b.num_rows, dtype=np.int64))]
            at += b.num_rows
            if weight:
                w = b.column(weight).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                more.append(pa.array(np.cumsum(w) - w + sum_))
                sum_ += int(w.sum())
            yield pa.RecordBatch.from_arrays([*b.columns, *more], names=[*b.schema.names, "pos", "before"][: b.num_columns + len(more)])

    return rows.mapInArrow(place, plus(rows, pos="long", **({"before": "long"} if weight else {})))
