"""From documents to token ids: quality rules, near-duplicates, decontamination, secrets, encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from clinigrid.llm.common import documents
from clinigrid.llm.decontamination import decontamination_stage
from clinigrid.llm.pieces import encoding_stage
from clinigrid.llm.quality import quality_stage
from clinigrid.llm.secret_scan import secret_scan_stage
from clinigrid.llm.simhash import near_duplicate_stage
from clinigrid.session import drop_stage, write_stage

# (name, function of (spark, docs, sf_dir)); all but the last return the columns of documents.
STAGES = [
    ("quality_rules", quality_stage),
    ("simhash_near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("secret_scan", secret_scan_stage),
    ("sentencepiece", encoding_stage),
]

# XXH64, compressed sizes and best segmentations are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over all documents, each written as Parquet and read again by the next.

    A stage's table is dropped once the next one is written.
    """
    docs, held = documents(spark, sf_dir), None
    for name, stage in STAGES:
        docs, path = write_stage(stage(spark, docs, sf_dir), name)
        drop_stage(spark, held)
        held = path
    return docs
