"""The corpus pipeline: bad documents go, repeated lines stay once, near-duplicates stay once, sources are mixed, ids packed.

Each stage takes what the one before it kept, written as Parquet and read again. Every stage states in its module what becomes of
null, empty, very long, tied and repeated rows. Together: without labels, or with labels of one kind, no document goes as bad; a text whose
lines all go becomes empty, and of the texts without words one stays; of repeated rows one stays; null ids stay null to the end; an empty
table gives no rows; columns beyond those of documents pass through up to the packing, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidelog.llm.common import read_table, written
from tidelog.llm.line_dedup import stage_line_dedup
from tidelog.llm.mixing import stage_mixing
from tidelog.llm.packing import stage_packing
from tidelog.llm.quality import stage_quality
from tidelog.llm.simhash import stage_simhash

STAGES = [
    ("quality classifier", stage_quality),
    ("line dedup", stage_line_dedup),
    ("simhash near-dedup", stage_simhash),
    ("source mixing", stage_mixing),
    ("packing", stage_packing),
]

#: The classifier, the fingerprints and the tokenizer have no SQL form; tests/llm/test_pipeline.py follows each stage by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
