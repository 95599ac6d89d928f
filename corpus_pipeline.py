"""A corpus pipeline of five operators: quality, near-dedup, secrets, mixing, packing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from siltworks.llm import minhash, mixing, packing, quality, secrets
from siltworks.llm.base import remove, shared_dir

STAGES = [
    ("quality_rules", quality.stage),
    ("near_dedup", minhash.stage),
    ("secret_scan", secrets.stage),
    ("source_mix", mixing.stage),
    ("sequence_packing", packing.stage),
]

#: Signatures, forests and tokenisers are beyond SQL; the tests hold a version of the stages in plain Python against run().
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over `documents`; each result is written to the shared folder as Parquet and read again.

    A result is deleted when the next stage's is written; the last one stays, as it is what is returned.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    top = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(at := f"{top}/{k}-{name}")
        docs = spark.read.parquet(at)
        if k:
            remove(spark, f"{top}/{k - 1}-{STAGES[k - 1][0]}")
    return docs
