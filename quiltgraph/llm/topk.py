"""Exact top-k inner products over a bit-sliced index.

Vectors are quantised to integers and packed into blocks of some ``BLOCK`` rows. A
block's index holds, for each attribute, bitmaps over the rows: one for each of the
highest ``SLICES`` bits of the attribute's range in that block. A query's score is
a sum of shifted attributes, so carry-save adders on bitmaps add the slices that the
set bits of the query select (complemented for negative weights) into the slices of
a lower bound of each row's score. The k-th highest bound is read from the most
significant slice downward; rows whose bound plus the largest possible loss reaches
it are scored exactly, and only those.

A block of rows goes to one task, which builds its index once and lets the small blocks
of queries stream past it. Only where blocks are fewer than the session's cores are the
queries dealt to several slices, each with the block and an index of its own.

Defined results: vectors that are null or hold a null or non-finite component take
no part; missing trailing components of shorter vectors count as 0; a query skips
every row with its own vec_id; rows that repeat a (vec_id, vector) are candidates
each, and one query; null vec_ids take no part; ties go to the smaller vec_id;
no rows, no results. Quantised components must fit 32 bits, else Spark's cast raises,
and scores must fit 62 bits, else the search raises.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 16384  # rows of an index block
QUERY_BLOCK = 256
SLICES = 6


def quantised(vector: Column, scale: int) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("int"))


def usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return vector.isNotNull() & F.coalesce(fine, F.lit(False))


class BitSlicedIndex:
    """Bitmaps of the highest bits of each column of ``values``."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        self.ids, self.values = ids, values.astype(np.int64)
        n, dims = values.shape
        self.n, self.words = n, -(-n // 64)
        self.low = self.values.min(axis=0) if n else np.zeros(dims, np.int64)
        above = self.values - self.low
        self.width = np.array([int(x).bit_length() for x in above.max(axis=0)] if n else [0] * dims, np.int64)
        self.dropped = np.maximum(self.width - SLICES, 0)
        self.rows = self._pack(np.ones(n, bool))
        planes, self.of, self.weight = [], [], []
        for d in range(dims):
            for bit in range(int(self.dropped[d]), int(self.width[d])):
                planes.append(self._pack(above[:, d] >> bit & 1))
                self.of.append(d)
                self.weight.append(bit)
        self.of, self.weight = np.array(self.of, np.int64), np.array(self.weight, np.int64)
        plain = np.array(planes, np.uint64).reshape(len(planes), self.words)
        self.planes = np.concatenate([plain, ~plain & self.rows])  # the second half complemented

    def _pack(self, bits: np.ndarray) -> np.ndarray:
        full = np.zeros(self.words * 64, np.uint8)
        full[: self.n] = bits
        return np.packbits(full, bitorder="little").view(np.uint64)

    def _indices(self, bitmap: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))

    def sum_slices(self, query: np.ndarray) -> list[np.ndarray | None]:
        """Slices, least significant first, of sum(|q| * attribute) over the kept bits."""
        size = np.abs(query)[self.of]
        at = np.arange(len(self.of)) + len(self.of) * (query[self.of] < 0)
        chosen: list[list[np.ndarray]] = []
        for a in range(int(size.max(initial=0)).bit_length()):
            use = np.flatnonzero(size >> a & 1)
            weight = self.weight[use] + a
            for w in np.unique(weight).tolist():
                while len(chosen) <= w:
                    chosen.append([])
                chosen[w].append(at[use[weight == w]])
        out: list[np.ndarray | None] = []
        carried: list[np.ndarray] = []
        w = 0
        while w < len(chosen) or carried:
            parts = [self.planes[np.concatenate(chosen[w])]] if w < len(chosen) and chosen[w] else []
            here, carried = [*parts, *carried], []
            pile = np.concatenate(here) if here else np.empty((0, self.words), np.uint64)
            while len(pile) >= 3:
                k = len(pile) // 3
                a, b, c = pile[:k], pile[k : 2 * k], pile[2 * k : 3 * k]
                half = a ^ b
                carried.append((a & b) | (c & half))
                pile = np.concatenate([half ^ c, pile[3 * k :]])
            if len(pile) == 2:
                carried.append((pile[0] & pile[1])[None])
                pile = (pile[0] ^ pile[1])[None]
            out.append(pile[0] if len(pile) else None)
            w += 1
        return out

    def top(self, query: np.ndarray, query_id: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best rows, by score and then by id."""
        query = query.astype(np.int64)
        rows = self.rows
        own = np.flatnonzero(self.ids == query_id)
        if len(own):
            mask = np.ones(self.n, bool)
            mask[own] = False
            rows = rows & self._pack(mask)
        if self.n - len(own) > k:
            slices = self.sum_slices(query)
            sure, open_, bound = np.zeros_like(rows), rows, 0
            for w in range(len(slices) - 1, -1, -1):
                if slices[w] is None:
                    continue
                high = open_ & slices[w]
                if int(np.bitwise_count(sure | high).sum()) >= k:
                    open_, bound = high, bound | 1 << w
                else:
                    sure, open_ = sure | high, open_ & ~slices[w]
            least = bound - int((np.abs(query) * ((1 << self.dropped) - 1)).sum())
            if least > 0:
                above, equal = np.zeros_like(rows), rows
                for w in range(max(len(slices), least.bit_length()) - 1, -1, -1):
                    s = slices[w] if w < len(slices) and slices[w] is not None else np.zeros_like(rows)
                    if least >> w & 1:
                        equal = equal & s
                    else:
                        above, equal = above | (equal & s), equal & ~s
                rows = above | equal
        at = self._indices(rows)
        score = self.values[at] @ query
        best = np.lexsort((self.ids[at], -score))[:k]
        return self.ids[at][best], score[best]


def _pack_blocks(rows: DataFrame, key: str, size: int) -> tuple[DataFrame, int]:
    """One row for each block: its ids and its values as bytes."""
    blocks = max(1, -(-rows.count() // size))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id", kind="stable")
        dims = max((len(x) for x in pdf["v"]), default=0)
        values = np.zeros((len(pdf), dims), np.int32)
        for i, x in enumerate(pdf["v"]):
            values[i, : len(x)] = x
        return pd.DataFrame({key: [pdf[key].iloc[0]], f"{key}_dims": [dims], f"{key}_ids": [pdf["vec_id"].to_numpy(np.int64).tobytes()], f"{key}_values": [values.tobytes()]})

    dealt = rows.withColumn(key, F.pmod(F.xxhash64("vec_id", "v", "salt"), F.lit(blocks)).cast("int"))
    return dealt.drop("salt").groupBy(key).applyInPandas(pack, f"{key} int, {key}_dims int, {key}_ids binary, {key}_values binary"), blocks


def _dealt(blocks: DataFrame, n_blocks: int, queries: DataFrame, slices: int) -> DataFrame:
    """(block, slice, ask, dims, ids, values) in tasks by block and slice, sorted so that a block (ask -1) comes before its queries."""
    packed = lambda key: (F.col(f"{key}_dims").alias("dims"), F.col(f"{key}_ids").alias("ids"), F.col(f"{key}_values").alias("values"))
    numbers = lambda n: F.sequence(F.lit(0), F.lit(n - 1))
    rows = blocks.select("block", F.explode(numbers(slices)).alias("slice"), F.lit(-1).alias("ask"), *packed("block"))
    asks = queries.select(F.explode(numbers(n_blocks)).alias("block"), (F.col("ask") % slices).alias("slice"), "ask", *packed("ask"))
    return rows.unionByName(asks).repartition("block", "slice").sortWithinPartitions("block", "slice", "ask")


def answers(batches: Iterator[pd.DataFrame], k: int) -> Iterator[pd.DataFrame]:
    """The best rows of each block for each of the queries that follow it."""
    index, dims, most = None, 0, 0
    for pdf in batches:
        out = [pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")]
        for r in pdf.itertuples(index=False):
            ids = np.frombuffer(r.ids, np.int64)
            values = np.frombuffer(r.values, np.int32).reshape(len(ids), r.dims)
            if r.ask < 0:
                index, dims, most = BitSlicedIndex(ids, values), r.dims, int(np.abs(values.astype(np.int64)).max(initial=0))
                continue
            if dims * most * int(np.abs(values.astype(np.int64)).max(initial=0)) >= 1 << 62:
                raise ValueError("scores of these vectors don't fit 62 bits")
            for q, v in zip(ids.tolist(), values):
                query = np.zeros(dims, np.int64)
                query[: len(v)] = v[:dims]  # columns that no row has add nothing
                best, scores = index.top(query, q, k)
                out.append(pd.DataFrame({"query_id": q, "vec_id": best, "score": scores}))
        yield pd.concat(out)


def search(df: DataFrame, is_query: Column, k: int = 5, scale: int = 256, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The ``k`` best other rows of ``df`` for each row where ``is_query`` holds."""
    kept = df.where(F.col(vec_id).isNotNull() & usable(F.col(vector)))
    rows = kept.select(F.col(vec_id).cast("long").alias("vec_id"), quantised(F.col(vector), scale).alias("v"), is_query.alias("is_query"), F.monotonically_increasing_id().alias("salt"))
    blocks, n_blocks = _pack_blocks(rows.drop("is_query"), "block", BLOCK)
    asked = rows.where("is_query").dropDuplicates(["vec_id", "v"]).drop("is_query").withColumn("salt", F.lit(0))
    queries, n_queries = _pack_blocks(asked, "ask", QUERY_BLOCK)
    slices = min(n_queries, -(-df.sparkSession.sparkContext.defaultParallelism // n_blocks))
    found = _dealt(blocks, n_blocks, queries, slices).mapInPandas(lambda batches: answers(batches, k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


TOP_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
    CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
