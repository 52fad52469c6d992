"""The ``opN_`` queries over whole tables, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiltgraph.llm import bpe, chat, decontaminate, jaccard, licenses, quality, repeats, topk, toxicity, warc
from quiltgraph.llm.common import held_out, table

Query = Callable[[SparkSession, str], DataFrame]


def default_ranks() -> str:
    """The path of the rank file of the installed public vocabularies."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(table(spark, sf_dir, "documents"), default_ranks())


def op2_bit_sliced_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.predictions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), held_out("doc_id", 5, 0))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_content_addressed_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.page_records(table(spark, sf_dir, "pages"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


#: Parameters of tools: type, and whether they are required.
TOOLS = {"search": {"query": ("string", True), "limit": ("integer", False)}, "calculate": {"expression": ("string", True)}}


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_messages(table(spark, sf_dir, "conversations"), TOOLS)


def op8_run_length_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeat_digests(table(spark, sf_dir, "documents"), least=200)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.predictions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), held_out("doc_id", 4, 2))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link(table(spark, sf_dir, "documents"), width=4, percent=85)


def queries() -> dict[str, Query]:
    found = (op1_byte_bpe, op2_bit_sliced_top_k, op3_toxicity, op4_decontamination, op5_content_addressed_warc, op6_license_scan, op7_chat_format, op8_run_length_dedup, op9_quality, op10_ngram_jaccard_join)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op2_bit_sliced_top_k": topk.TOP_SQL, "op4_decontamination": decontaminate.CONTAMINATION_SQL, "op5_content_addressed_warc": warc.PAGES_SQL, "op7_chat_format": chat.MESSAGES_SQL, "op10_ngram_jaccard_join": jaccard.LINK_SQL}
