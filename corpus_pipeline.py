"""The corpus pipeline: quality rules, exact dedup, near dedup, mixing, encoding."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm import bpe, exact_dedup, mixing, near_dedup, quality
from ledgerloom.llm.shared import Work, shared_root, sweep

STAGES = [
    ("quality_rules", quality.stage),
    ("exact_dedup", exact_dedup.stage),
    ("near_dedup", near_dedup.stage),
    ("mixing", mixing.stage),
    ("bpe", bpe.stage),
]

#: The stages cannot be expressed in SQL (MinHash components, BPE): tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written as Parquet and reread as the next one's docs.

    Every stage has defined results for null, empty, repeated and very long texts, rows without a doc_id or
    sharing one, an empty table and further columns of any name, which all stages but the last keep.
    """
    root = f"{shared_root(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, function) in enumerate(STAGES):
        path, before = f"{root}/{i}-{name}", len(Work.made)
        function(spark, docs, sf_dir).write.mode("overwrite").parquet(path)
        sweep(spark, before)
        docs = spark.read.parquet(path)
    return docs
