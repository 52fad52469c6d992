"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; one of our own only where that is unset, in a session of one machine."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the cluster shares")
        where = tempfile.mkdtemp(prefix="quilt-shared-")
        spark.conf.set("spark.checkpoint.dir", where)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(where)
    return where


def scratch_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/quilt-{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` read back from a reliable checkpoint, so that lineage ends there."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def read_small_file(spark: SparkSession, path: str) -> bytes:
    """The bytes of one file of known, bounded size (a vocabulary, a model)."""
    if "://" in path:
        return bytes(spark.read.format("binaryFile").load(path).select("content").head()[0])
    with open(path, "rb") as f:
        return f.read()


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, or it with underscores until no column of ``df`` bears the name."""
    have = {c.lower() for c in df.columns}
    while wanted.lower() in have:
        wanted += "_"
    return wanted


def held_out(doc_id: str, folds: int, fold: int):
    """crc32 of the id as text falls in ``fold``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds == fold


def text_keys(text: str) -> list[Column]:
    """Two hashes, h and g, that together tell texts apart."""
    return [F.xxhash64(F.col(text)).alias("h"), F.xxhash64(F.lit("g"), F.col(text)).alias("g")]


def drop_path(spark: SparkSession, path: str) -> None:
    """Removes a scratch folder that nothing reads any more."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def with_group_min(rows: DataFrame, key: str, value: str, out: str, spread: str, salts: int = 64) -> DataFrame:
    """``rows`` with the least ``value`` of their ``key``; ``spread`` deals a hot key's rows to ``salts`` groups.

    The minimum is found by partial aggregates of (key, salt) and goes back to just the
    pairs that occur, so no task gets all rows of a key.
    """
    salted = rows.withColumn("salt_", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    parts = salted.groupBy(key, "salt_").agg(F.min(value).alias("least_"))
    whole = parts.groupBy(key).agg(F.min("least_").alias(out), F.collect_list("salt_").alias("salts_"))
    return salted.join(whole.select(key, out, F.explode("salts_").alias("salt_")), [key, "salt_"], "left").drop("salt_")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of ``edges`` (a, b): root is the least node reachable.

    Alternating large and small stars, each round cut by a checkpoint; the loop ends
    when a round changes nothing. Only two numbers a round come to the driver.
    """
    state = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    before = None
    while True:
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        state = cut(small.where("u <> v").distinct())
        now = state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head()
        if now == before:
            break
        before = now
    roots = state.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
