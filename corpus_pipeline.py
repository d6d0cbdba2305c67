"""The training-data pipeline: from documents to packed sequences.

Each stage takes all that its predecessor kept. All but the last return the columns of documents; the last returns the
pieces of packed sequences. run() writes every stage's result and reads it again, so a lost executor costs a stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from genotiles.llm.contamination import without_contaminated
from genotiles.llm.jaccard_join import JaccardOptions, one_of_each_group
from genotiles.llm.packing import PackingOptions, pack
from genotiles.llm.repeats import shortened
from genotiles.llm.tables import read, written
from genotiles.llm.toxicity import without_toxic
from genotiles.queries.base import Query

TOKENIZER = "byte_bpe_50k.json"
#: Near duplicates: five-word shingles, similarity of 0.8 or more.
NEAR = JaccardOptions(size=5, percent=80)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxic documents go."""
    return without_toxic(docs, read(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return one_of_each_group(docs, NEAR)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that occur again, in any document, are cut out of the texts."""
    return shortened(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return without_contaminated(docs, read(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts become pieces of sequences of at most 2048 tokens."""
    return pack(docs, PackingOptions(public_tokenizers.path(TOKENIZER)))


STAGES = [
    ("toxicity", toxicity), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages),
    ("benchmark", benchmark), ("packing", packing),
]

#: Learned weights and token ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs


QUERY = Query("pipeline", "LLM", run, ORACLE_SQL)
