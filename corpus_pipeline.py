"""A corpus from raw documents: quality, near-duplicates, decontamination, mixture, shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pulsejobs.llm.decontamination import decontaminate_stage
from pulsejobs.llm.mixing import mixing_stage
from pulsejobs.llm.neardup import near_duplicate_stage
from pulsejobs.llm.quality import quality_stage
from pulsejobs.llm.sharding import shard_stage
from pulsejobs.llm.shared import stage

STAGES = [
    ("quality", quality_stage),
    ("near-duplicates", near_duplicate_stage),
    ("decontamination", decontaminate_stage),
    ("mixing", mixing_stage),
    ("sharding", shard_stage),
]

#: The quality model is trained with floating-point sums that SQL does not repeat; the tests hold the pipeline against its stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of the documents that all stages keep; each stage writes its rows as Parquet, which the next one reads.

    Null texts have no words: the quality model scores them as one empty line,
    they are no near-duplicates and never contaminated. Null ids are kept as
    documents of their own, null sources and languages are categories of the
    mixture. Of rows that repeat an id and a text one stays. Columns besides
    those of documents are handed on up to the last stage, whatever their
    names. Empty documents give an empty result; without labels of both kinds
    no document is rejected for its quality, without benchmark items none is
    contaminated.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
    return docs
