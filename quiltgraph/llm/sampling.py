"""A bounded, balanced sample of labelled documents, and the classes' true shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LONGEST = 200_000  # characters of a sampled text

def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, train: Column, per_class: int, longest: int = LONGEST) -> tuple[DataFrame, tuple[int, int]]:
    """(y, text) of at most ``per_class`` labelled ids of each class, and how many training ids each class has.

    Texts of more than ``longest`` characters are not fitted to, so that the sample is bounded in bytes too.

    ``train`` is a condition on doc_id. The ids with the smallest hashes are taken, so
    the sample is the same each time. An id with contradicting labels has the larger;
    ids that repeat in ``docs`` bring their smallest text.
    """
    known = (
        labels.where(train & F.col("doc_id").isNotNull() & F.col(label).isin(0, 1))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max(label).cast("int").alias("y"))
    )
    shares = {r.y: r["count"] for r in known.groupBy("y").count().collect()}  # two rows at most
    order = F.xxhash64("doc_id")
    picked = known.where("y = 0").orderBy(order, "doc_id").limit(per_class).unionByName(known.where("y = 1").orderBy(order, "doc_id").limit(per_class))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    sample = texts.where(F.length("text") <= longest).join(F.broadcast(picked), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))  # 2 * per_class rows are broadcast
    return sample.select("doc_id", "y", "text"), (shares.get(0, 0), shares.get(1, 0))


def prior_shift(shares: tuple[int, int], sampled: tuple[int, int]) -> float:
    """What to add to a logit learned on ``sampled`` rows of each class so that it suits ``shares``."""
    import math

    return math.log((shares[1] + 1) / (shares[0] + 1)) - math.log((sampled[1] + 1) / (sampled[0] + 1))
