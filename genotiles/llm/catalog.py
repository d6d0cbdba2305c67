"""Queries of this subpackage over the driver's tables, each with its SQL twin where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from genotiles.llm.contamination import contaminated
from genotiles.llm.conversation_repair import repair_report
from genotiles.llm.graph_search import neighbour_report
from genotiles.llm.interpolated_lm import lm_scores
from genotiles.llm.jaccard_join import linked_documents
from genotiles.llm.packing import PackingOptions, pack
from genotiles.llm.quality_classifier import quality_report
from genotiles.llm.quality_rules import rule_report
from genotiles.llm.repeats import repeat_report
from genotiles.llm.tables import read
from genotiles.llm.token_counts import CountOptions, token_report
from genotiles.llm.tokenizer_alignment import AlignOptions, align_tokenizers
from genotiles.llm.toxicity import toxicity_report
from genotiles.llm.warc import archive_report
from genotiles.queries.base import Query


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op1_interpolated_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(read(spark, sf_dir, "documents"))


def op2_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_report(read(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_report(read(spark, sf_dir, "documents"), CountOptions(public_tokenizers.path("piece_bpe_32k.model")))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op6_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"), PackingOptions(public_tokenizers.path("byte_bpe_50k.json")))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_documents(read(spark, sf_dir, "documents"))


def op11_pruned_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbour_report(read(spark, sf_dir, "embeddings"))


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = (public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return align_tokenizers(read(spark, sf_dir, "documents"), AlignOptions(*files))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_report(read(spark, sf_dir, "conversations"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_report(read(spark, sf_dir, "pages"))


_WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS payload_digest FROM p),
m AS (
    SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) END AS o
    FROM d
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN o <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN o <> page_id THEN o END AS refers_to, true AS intact
FROM m
"""


QUERIES = (
    Query("op1_interpolated_lm", "LLM-1", op1_interpolated_lm, None),
    Query("op2_repeats", "LLM-2", op2_repeats, None),
    Query("op3_token_counts", "LLM-3", op3_token_counts, None),
    Query("op4_quality_rules", "LLM-4", op4_quality_rules, None),
    Query("op5_warc", "LLM-5", op5_warc, _WARC_SQL),
    Query("op6_contamination", "LLM-6", op6_contamination, None),
    Query("op7_packing", "LLM-7", op7_packing, None),
    Query("op8_quality_classifier", "LLM-8", op8_quality_classifier, None),
    Query("op9_jaccard_join", "LLM-9", op9_jaccard_join, None),
    Query("op10_toxicity", "LLM-10", op10_toxicity, None),
    Query("op11_pruned_graph", "LLM-11", op11_pruned_graph, None),
    Query("op12_tokenizer_alignment", "LLM-12", op12_tokenizer_alignment, None),
    Query("op13_conversation_repair", "LLM-13", op13_conversation_repair, None),
)

CATALOG: dict[str, Query] = {query.name: query for query in QUERIES}
