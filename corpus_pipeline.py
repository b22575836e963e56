"""A corpus pipeline over `documents`: five stages, each written as Parquet and read again.

toxicity (documents that the chain rejects go), line dedup (texts lose windows that occur
earlier), near duplicates by the n-gram Jaccard join (one document of each group stays),
benchmark decontamination (contaminated documents go), SentencePiece ids of what is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docloom.llm import decontaminate, linededup, ngramjoin, sentencepieces, toxicity
from docloom.llm.common import materialize, table

STAGES = [
    ("toxicity", toxicity.stage),
    ("line_dedup", linededup.stage),
    ("near_duplicates", ngramjoin.stage),
    ("decontamination", decontaminate.stage),
    ("sentencepiece", sentencepieces.stage),
]

#: A trained model, greedy tiling and BPE segmentation are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
