"""The corpus pipeline: language ID, exact dedup, near dedup, substring dedup, packing.

Each stage takes (spark, docs, sf_dir) and works on all documents that its predecessor kept; all but the last return the
columns of ``documents``. ``run`` writes what a stage returns as Parquet in the shared folder and rereads it for the next,
so a lost executor costs no more than the stage at hand; what the stage before left is then deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemill.llm import exact_dedup, langid, ngram_join, packing, substring_dedup
from tidemill.llm.common import Scratch, table

STAGES = [
    ("language_id", langid.stage),
    ("exact_dedup", exact_dedup.stage),
    ("ngram_jaccard_join", ngram_join.stage),
    ("substring_dedup", substring_dedup.stage),
    ("packing", packing.stage),
]

#: The language models, exact near-duplicate classes and packing have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the cleaned documents of ``sf_dir``."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
        if before:
            scratch.drop(before)
        before = name
    return docs
