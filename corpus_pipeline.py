"""From documents to packed training sequences, in five stages.

Each stage works on all that its predecessor kept, written as Parquet in the shared
folder and read again; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ringspark.llm import common, lines, mixing, neardup, packing, toxicity
from ringspark.session import ship


def _shipped(stage):
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        return stage(ship(spark), docs, sf_dir)

    return run


STAGES = [
    ("toxicity", _shipped(toxicity.stage)),
    ("line_dedup", _shipped(lines.stage)),
    ("near_dedup", _shipped(neardup.stage)),
    ("mixing", _shipped(mixing.stage)),
    ("packing", _shipped(packing.stage)),
]

#: Hash-bounded chunks, a trained lexicon and token ids have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = common.Scratch(spark, "pipeline")
    docs = common.documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), f"{k}-{name}")
    return docs
