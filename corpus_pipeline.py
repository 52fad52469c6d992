"""Documents to tokens: toxicity, near duplicates, repeated passages, benchmark passages, byte-level BPE.

Each stage takes (spark, docs, sf_dir), with the columns of ``documents``, and returns a
DataFrame that is written as Parquet and read again as the next stage's docs. All but
the last return the columns they got.

Defined results, for every stage: a null or empty text is never toxic, near another,
repeated or contaminated, and has no tokens; a null doc_id is kept like any other (of
near copies, only where none has an id). Rows that agree in id and text leave the second
stage once; an id with several texts is as many documents. Texts of any length are read
whole. An empty table gives an empty table, and without labels nothing is toxic. Columns
beyond those of ``documents``, of any name, pass through the first four stages unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiltgraph import ship
from quiltgraph.llm import bpe, decontaminate, jaccard, repeats, toxicity
from quiltgraph.llm.common import drop_path, free_name, scratch_path, table, text_keys
from quiltgraph.llm.queries import default_ranks

TOXIC_AT = 0.5
NEAR_WORDS, NEAR_PERCENT = 5, 80
REPEATED_BYTES = 200
BENCHMARK_WORDS, BENCHMARK_SHARE = 13, 20


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below TOXIC_AT by a classifier fitted to all their labels."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), F.lit(True))
    if not model[0]:  # labels of both classes are missing, so nothing was learned
        return docs
    scored = toxicity.score(docs, model, out="toxic_score")
    return scored.where(F.col(scored.columns[-1]) < TOXIC_AT).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, that with the least id; one without an id only where none has any.

    Rows are told apart by a 64-bit hash of id and text, so those of one id are compared too. Rows
    that agree in both are one row, but for rows without an id and without words, which all stay.
    """
    row, n, own = (free_name(docs, c) for c in ("row_", "n_", "own_"))
    number = F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.col("text").isNull(), "text")
    numbered = docs.withColumn(row, number)
    groups = jaccard.link(numbered.select(F.col(row).alias("doc_id"), "text"), NEAR_WORDS, NEAR_PERCENT)
    ids = numbered.select(F.col(row).alias("row"), F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col(row).alias("row")).alias("order")).distinct()
    member = groups.select(F.col("doc_id").alias("row"), "n_shingles", F.col("component_id").alias("group")).distinct()
    kept = member.join(ids, "row").groupBy("group").agg(F.min("order").alias("kept"), F.max("n_shingles").alias("n")).select(F.col("kept.row").alias(row), F.col("n").alias(n))
    apart = F.when(F.col("doc_id").isNull() & (F.col(n) == 0), F.monotonically_increasing_id()).otherwise(0)
    return numbered.join(kept, row).withColumn(own, apart).dropDuplicates([row, own]).select(docs.columns)


def _with_separators(text: str, spans: list) -> list[tuple[int, int]]:
    """Spans of words in bytes, with the byte before and after, so that they don't run into other words."""
    return [(a - 1, b + 1) for a, b in decontaminate.byte_spans(text, spans)]


def _contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(h, g, hit_spans) of each different text of whose words a BENCHMARK_SHARE-th or more lies in benchmark windows."""
    found = decontaminate.text_hits(docs, table(spark, sf_dir, "benchmark"), BENCHMARK_WORDS)
    hit = decontaminate.n_hit()
    return found.where((hit > 0) & (BENCHMARK_SHARE * hit >= F.col("n_words"))).select("h", "g", "hit_spans")


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their repeated passages; documents of which nothing else is left go.

    Benchmark windows stay, repeated or not, in contaminated texts only: the next stage decides by
    them on whole documents, and drops these, as taking out other repeats only raises their share.
    From all other texts, repeated passages of the benchmark go like any others.
    """
    spared, before = _contaminated(spark, docs, sf_dir).withColumnRenamed("hit_spans", "spared"), free_name(docs, "text_before")
    left = repeats.remove_repeats(docs.withColumn(before, F.col("text")), REPEATED_BYTES, spared=spared, spared_bytes=_with_separators)
    changed = ~F.col("text").eqNullSafe(F.col(before))
    emptied = changed & (F.trim("text") == "")
    return left.where(~emptied).withColumn("n_chars", F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))).select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words less than a BENCHMARK_SHARE-th lies in benchmark windows."""
    h, g = (free_name(docs, c) for c in ("h_", "g_"))
    bad = _contaminated(spark, docs, sf_dir).select(F.col("h").alias(h), F.col("g").alias(g))
    keys = text_keys("text")
    return docs.withColumns({h: keys[0], g: keys[1]}).join(bad, [h, g], "left_anti").select(docs.columns)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (packed 32-bit, little-endian) of each text, checked by decoding them."""
    done = bpe.encode_checked(docs.select("doc_id", "lang", "source", "text"), default_ranks())
    return done.select("doc_id", "lang", "source", F.expr("cast(coalesce(octet_length(ids), 0) div 4 as bigint)").alias("n_tokens"), "ids", "round_trip")


def _shipped(stage):
    """``stage`` in a session whose Python workers can import the package."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        return stage(spark, docs, sf_dir)

    return run


STAGES = [
    ("toxicity", _shipped(drop_toxic)),
    ("ngram_jaccard_join", _shipped(drop_near_duplicates)),
    ("suffix_array_dedup", _shipped(drop_repeats)),
    ("benchmark_decontamination", _shipped(drop_contaminated)),
    ("byte_level_bpe", _shipped(tokenise)),
]

#: Learned scores, 64-bit hashes and byte-pair merges have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs, path = table(spark, sf_dir, "documents"), scratch_path(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{path}/{k}")
        docs = spark.read.parquet(f"{path}/{k}")
        if k:
            drop_path(spark, f"{path}/{k - 1}")
    return docs
