"""The corpus pipeline: filter, deduplicate, mix and pack the documents.

Each stage is written as Parquet and read again as the next one's documents, so a stage starts
from a table in the shared folder whatever is lost, and its decisions are final.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.llm.common import clear_written, materialize, written
from quire.llm.jaccard import deduplicate_stage
from quire.llm.mixing import mixing_stage
from quire.llm.packing import packing_stage
from quire.llm.quality import quality_stage
from quire.llm.toxicity import toxicity_stage

#: (name, function of (spark, docs, sf_dir)) in order. All but the last return the columns of documents.
STAGES = [
    ("quality", quality_stage),
    ("toxicity", toxicity_stage),
    ("near_duplicates", deduplicate_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: SQL can express neither the learned models nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir. What a stage has written goes when its output is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    others = set(written())
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
        *done, _ = (f for f in written() if f not in others)
        clear_written(spark, done)
    return STAGES[-1][1](spark, docs, sf_dir)
