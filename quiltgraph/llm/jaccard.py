r"""N-gram Jaccard join with filters under several global token orders.

A document's set holds the distinct ``width``-word shingles, hashed to 64 bits. Documents
with equal sets are one node. For J >= t a pair must share a token among the first
|x| - ceil(t |x|) + 1 of each set, under any global order. The orders here all put
tokens of frequent buckets last (counted over all documents in a sketch of
bounded size) and differ in how they order the rest. Nodes that share a prefix token
under the first order, and whose sizes agree, are candidates; those whose prefixes
under each of the other orders are disjoint are dropped before verification; the rest are
verified by exact intersection.

Only links between components matter, so a group of nodes that share a token is never
expanded into pairs. First each node meets the least node of its groups, the lead. All
that met a lead are its bundle; any two nodes that share a token are in the bundle of
that token's lead, or one of them is the lead and they have met. Bundles that still span
several components are compared in blocks, where products of incidence matrices apply
the same filters and the exact test to all pairs across components at once, and only
links that join components come out. No link between different components is lost.

Texts travel only for nodes that can still be linked: those that met a lead of a size
that agrees, and those of bundles of two or more.

Defined results: null and empty texts have an empty set and link with nothing; a
null doc_id is reported with a null component; repeated rows and rows that share a
doc_id are documents of their own; texts of any length are read whole; an empty table
gives an empty result. Equal 64-bit hashes count as equal shingles and equal sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiltgraph.llm.common import components, cut, drop_path, scratch_path, with_group_min

FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
ORDER_SEEDS = (0x51ED270B, 0x2545F491, 0x9E6C63D0)  # one for each global order
CHUNK_BITS = 14  # buckets of the sketch that travel together
MOST_BITS = 24  # of the sketch: 16 MB as classes
BLOCK = 256  # nodes of a bundle compared with as many others at a time
COLUMNS = 4096  # of an incidence matrix in memory
HOT_SHARE = 10_000  # a set with a larger share than 1 / this is emitted by one document only

_BASE = 0x9E3779B97F4A7C15
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2 ** 64."""
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            full = np.full(max(n, 1 << 17), base, np.uint64)
            full[0] = 1
            _POWERS[k] = np.cumprod(full, dtype=np.uint64)
    return _POWERS


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each word, by prefix sums of a polynomial."""
    data = np.frombuffer(b" " + text.encode("utf-8", "surrogatepass").translate(FOLD) + b" ", np.uint8)
    blank = (data == 32) | (data - np.uint8(9) < 5)
    start, end = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1, np.flatnonzero(~blank[:-1] & blank[1:]) + 1
    power, inverse = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=sums[1:])
    return mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))


def shingles(text: str | None, width: int) -> np.ndarray:
    """The sorted set of hashed shingles; the whole sequence where words are fewer."""
    h = word_hashes(text) if text else np.zeros(0, np.uint64)
    if not len(h):
        return h
    n = max(1, len(h) - width + 1)
    out = np.full(n, len(h) if len(h) < width else width, np.uint64)
    for j in range(min(width, len(h))):
        out = mix(out * np.uint64(0xD6E8FEB86659FD93) + h[j : j + n])
    return np.unique(out)


def node_of(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def prefix(s: np.ndarray, classes: np.ndarray, order: int, percent: int) -> np.ndarray:
    """The first tokens of a set under an order: rare buckets first, then by a hash of the order's own."""
    p = prefix_length(len(s), percent)
    shift = np.uint64(64 - len(classes).bit_length() + 1)
    rank = classes[(s >> shift).astype(np.int64)].astype(np.uint64) << np.uint64(56) | mix(s ^ np.uint64(ORDER_SEEDS[order])) >> np.uint64(8)
    return s[np.argpartition(rank, p - 1)[:p]]


class Sketch:
    """How often each bucket of tokens occurs, over all documents."""

    def __init__(self, bits: int):
        self.bits, self.count = bits, np.zeros(1 << bits, np.uint32)

    def add(self, s: np.ndarray) -> None:
        np.add.at(self.count, (s >> np.uint64(64 - self.bits)).astype(np.int64), 1)

    def chunks(self) -> Iterator[tuple[int, bytes]]:
        size = 1 << min(CHUNK_BITS, self.bits)
        for k in range(0, 1 << self.bits, size):
            part = self.count[k : k + size]
            if part.any():
                yield k // size, zstandard.compress(part.view(np.uint8).reshape(-1, 4).T.tobytes(), 3)  # byte by byte: the high ones are mostly 0


def _sets_and_counts(docs: DataFrame, width: int, bits: int) -> DataFrame:
    """One pass over (doc_id, text, rid): (doc_id, rid, n, node) of each row, and each task's counts by chunk."""
    names = ["doc_id", "rid", "n", "node", "chunk", "counts"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = Sketch(bits)
        for batch in batches:
            sizes, nodes = [], []
            for x in batch.column(1):
                s = shingles(x.as_py(), width)
                sketch.add(s)
                sizes.append(len(s))
                nodes.append(node_of(s))
            none = [None] * batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array(v, t) for v, t in zip((sizes, nodes, none, none), types[2:]))], names=names)
        for chunk, counts in sketch.chunks():
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((None, None, None, None, chunk, counts), types)], names=names)

    return docs.select("doc_id", "text", "rid").mapInArrow(run, "doc_id long, rid long, n long, node long, chunk int, counts binary")


def _classes(counted: DataFrame, bits: int) -> np.ndarray:
    """The logarithmic class of each bucket's total; at most 2 ** MOST_BITS bytes come to the driver."""
    size = 1 << min(CHUNK_BITS, bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, np.zeros(size, np.int64)

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([np.minimum(4 * np.log2(total + 1), 255).astype(np.uint8).tobytes()], pa.binary())], names=["chunk", "classes"])

        for batch in batches:  # sorted by chunk, so one sum is in memory at a time
            for chunk, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
                if chunk != at:
                    if at is not None:
                        yield done()
                    at, total = chunk, np.zeros(size, np.int64)
                total += np.frombuffer(zstandard.decompress(counts.as_py()), np.uint8).reshape(4, size).T.copy().view(np.uint32)[:, 0]
        if at is not None:
            yield done()

    parts = counted.where("chunk is not null").select("chunk", "counts").repartition("chunk").sortWithinPartitions("chunk")
    out = np.zeros(1 << bits, np.uint8)
    for r in parts.mapInArrow(run, "chunk int, classes binary").collect():
        out[r.chunk * size : (r.chunk + 1) * size] = np.frombuffer(r.classes, np.uint8)
    return out


def _prefix_tokens(docs: DataFrame, width: int, percent: int, classes, hot) -> DataFrame:
    """(token, node) for the prefix of each row's set under the first order."""
    names = ["token", "node"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, speaker = classes.value, hot.value
        for batch in batches:
            tokens, nodes = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                s = shingles(text.as_py(), width)
                if not len(s):
                    continue
                node = node_of(s)
                if speaker.get(node, doc) != doc:
                    continue
                p = prefix(s, table, 0, percent)
                tokens.append(p.view(np.int64))
                nodes.append(np.full(len(p), node))
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in (tokens, nodes)], names=names)

    return docs.mapInArrow(run, "token long, node long")


def _verified(pairs: DataFrame, texts: DataFrame, width: int, percent: int, classes) -> DataFrame:
    """The linked ones among ``pairs`` (a, b) of nodes; ``texts`` has a text for each node."""
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, last, held = classes.value, None, None
        others = range(1, len(ORDER_SEEDS))
        for batch in batches:
            out_a, out_b = [], []
            for a, b, x, y in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("text_a"), batch.column("text_b")):
                if a != last:
                    s = shingles(x.as_py(), width)
                    last, held = a, (s, [prefix(s, table, o, percent) for o in others])
                s = shingles(y.as_py(), width)
                if any(not np.isin(prefix(s, table, o, percent), p).any() for o, p in zip(others, held[1])):
                    continue
                common = len(np.intersect1d(s, held[0], assume_unique=True))
                if 100 * common >= percent * (len(s) + len(held[0]) - common):
                    out_a.append(a)
                    out_b.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])

    return pairs.join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def similar(percent: int, n: str, m: str):
    """Sizes that a pair of this similarity can have."""
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def _shared(tokens: list[np.ndarray]) -> np.ndarray:
    """How many tokens each two of some sets share: products of incidence matrices, some columns at a time."""
    m, flat = len(tokens), np.concatenate(tokens)
    row = np.repeat(np.arange(m), [len(t) for t in tokens])
    _, column, times = np.unique(flat, return_inverse=True, return_counts=True)
    keep = times[column] > 1
    row, column = row[keep], (np.cumsum(times > 1) - 1)[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((m, m), np.float32)
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, [low, low + COLUMNS])
        part = np.zeros((m, COLUMNS), np.float32)
        part[row[a:b], column[a:b] - low] = 1
        out += part @ part.T
    return out


def block_links(nodes: list[int], roots: list[int], sets: list[np.ndarray], classes: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links that join the roots of a block's similar nodes, each only if it joins something new."""
    size, root = np.array([len(s) for s in sets]), np.array(roots)
    low, high = np.minimum.outer(size, size), np.maximum.outer(size, size)
    maybe = np.triu((root[:, None] != root) & (100 * low >= percent * high), 1)
    for o in range(len(ORDER_SEEDS)):
        if not maybe.any():
            return []
        maybe &= _shared([prefix(s, classes, o, percent) for s in sets]) > 0
    if not maybe.any():
        return []
    common = _shared(sets).astype(np.int64)
    maybe &= 100 * common >= percent * (size[:, None] + size - common)
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    out = []
    for i, j in np.argwhere(maybe).tolist():
        x, y = find(roots[i]), find(roots[j])
        if x != y:
            parent[max(x, y)] = min(x, y)
            out.append((nodes[i], nodes[j]))
    return out


def _across(bundles: DataFrame, texts: DataFrame, width: int, percent: int, classes) -> DataFrame:
    """Links between components within ``bundles`` (lead, node, root).

    A bundle is cut into blocks of some BLOCK nodes, each meeting each other block once; blocks
    are cut within a component where that is large, and two blocks of one component don't meet.
    """
    bundles = cut(bundles)
    sizes = cut(bundles.groupBy("lead").agg(F.count(F.lit(1)).alias("size")))
    parts = cut(bundles.groupBy("lead", "root").agg(F.count(F.lit(1)).alias("part")))
    known = bundles.join(parts, ["lead", "root"]).join(sizes, "lead")
    large = F.col("part") > BLOCK
    own = F.when(large, F.col("root")).otherwise(F.lit(0).cast("long"))
    cuts = F.ceil(F.when(large, F.col("part")).otherwise(F.col("size")) / BLOCK)
    placed = cut(known.select("lead", "node", "root", own.alias("own"), F.pmod(F.xxhash64("node", "lead"), cuts).alias("slot")))
    blocks = placed.select("lead", "own", "slot").distinct().select("lead", F.struct("own", "slot").alias("block"))
    others = blocks.select("lead", F.col("block").alias("other"))
    different = (F.col("block") < F.col("other")) & ((F.col("block.own") != F.col("other.own")) | (F.col("block.own") == 0))
    alone = (F.col("block") == F.col("other")) & (F.col("block.own") == 0)
    meetings = blocks.join(others, "lead").where(different | alone)
    sides = cut(meetings.select("lead", F.explode(F.array_distinct(F.array("block", "other"))).alias("side"), F.xxhash64("block", "other").alias("meeting")))
    rows = placed.withColumn("side", F.struct("own", "slot")).join(sides, ["lead", "side"]).select("lead", "meeting", "node", "root").join(texts, "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, at = classes.value, None
        nodes: list[int] = []
        roots: list[int] = []
        sets: list[np.ndarray] = []

        def done() -> pa.RecordBatch:
            found = block_links(nodes, roots, sets, table, percent)
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:  # sorted by meeting, so one at a time is in memory
            for lead, meeting, node, root, text in zip(*(batch.column(c).to_pylist() for c in ("lead", "meeting", "node", "root")), batch.column("text")):
                if (lead, meeting) != at:
                    if at is not None:
                        yield done()
                    at, nodes, roots, sets = (lead, meeting), [], [], []
                nodes.append(node)
                roots.append(root)
                sets.append(shingles(text.as_py(), width))
        if at is not None:
            yield done()

    dealt = rows.select("lead", "meeting", "node", "root", "text").repartition("lead", "meeting").sortWithinPartitions("lead", "meeting", "node")
    return dealt.mapInArrow(run, "a long, b long")


def link(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("rid"))
    bits = min(MOST_BITS, max(12, (64 * docs.count()).bit_length()))

    path = scratch_path(spark, "jaccard")
    _sets_and_counts(docs, width, bits).write.parquet(f"{path}/sets")
    first = spark.read.parquet(f"{path}/sets")
    rows = cut(first.where("chunk is null").select("doc_id", "rid", "n", "node"))
    broadcast = spark.sparkContext.broadcast
    classes = broadcast(_classes(first, bits))
    drop_path(spark, f"{path}/sets")

    count, known = rows.count(), rows.where("n > 0 and doc_id is not null")
    nodes = cut(known.groupBy("node").agg(F.count(F.lit(1)).alias("c"), F.min("n").alias("n"), F.min(F.struct("doc_id", "rid")).alias("speaker")))
    hot = broadcast({r.node: r.doc_id for r in nodes.where(F.col("c") > max(8, count // HOT_SHARE)).select("node", "speaker.doc_id").collect()})  # HOT_SHARE nodes at most
    _prefix_tokens(docs.where("doc_id is not null"), width, percent, classes, hot).write.parquet(f"{path}/tokens")
    tokens = spark.read.parquet(f"{path}/tokens")
    # Aggregates are cut before they are joined: a join of two plain shuffles is split where a key is very common.
    several = F.min("node").alias("lead"), F.max("node").alias("last")
    shared = cut(tokens.groupBy("token").agg(*several).where("lead < last").select("token", "lead"))
    tokens.join(shared, "token").where("node <> lead").select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct().write.parquet(f"{path}/meet")
    drop_path(spark, f"{path}/tokens")
    meet = spark.read.parquet(f"{path}/meet")

    stars = cut(_of_size(meet, nodes, percent))
    bundled = cut(meet.groupBy("a").agg(F.count(F.lit(1)).alias("met")).where("met > 1").select("a"))
    bundles = meet.join(bundled, "a", "left_semi")

    # One text for each node that may be linked, from its least row.
    wanted = stars.select(F.explode(F.array("a", "b")).alias("node")).unionByName(bundles.select(F.col("b").alias("node"))).distinct()
    chosen = cut(nodes.join(wanted, "node", "left_semi").select("node", "speaker.doc_id", "speaker.rid"))
    docs.join(chosen, ["doc_id", "rid"]).dropDuplicates(["doc_id", "rid"]).select("node", "text").write.parquet(f"{path}/texts", compression="zstd")
    texts = spark.read.parquet(f"{path}/texts")

    links = cut(_verified(stars, texts, width, percent, classes))
    roots = components(links)

    # What is left: bundles that still span several components.
    bundles = bundles.select(F.col("a").alias("lead"), F.col("b").alias("node")).join(roots, "node", "left").select("lead", "node", F.coalesce("root", "node").alias("root"))
    open_ = cut(bundles.groupBy("lead").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("lead"))
    more = cut(_across(bundles.join(open_, "lead", "left_semi"), texts, width, percent, classes))
    if not more.isEmpty():
        roots = components(links.unionByName(more))
    drop_path(spark, path)

    own = F.xxhash64(F.lit("empty"), "doc_id")  # without shingles: a component of its own
    keyed = rows.join(roots, "node", "left").select("doc_id", "n", F.when(F.col("n") > 0, F.coalesce("root", "node")).otherwise(own).alias("root"))
    found = with_group_min(keyed, "root", "doc_id", "least", "doc_id")
    component = F.when(F.col("doc_id").isNull() | (F.col("n") == 0), F.col("doc_id")).otherwise(F.col("least"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def _of_size(pairs: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """``pairs`` whose nodes have sizes that could be similar."""
    known = pairs.join(sizes.select(F.col("node").alias("a"), "n"), "a").join(sizes.select(F.col("node").alias("b"), F.col("n").alias("m")), "b")
    return known.where(similar(percent, "n", "m")).select("a", "b")


def brute_force(docs: list[tuple[int, str | None]], width: int, percent: int) -> list[tuple[int, int, int]]:
    """The same rows by comparing all pairs of plain sets, for tests."""
    import re

    sets = []
    for _, text in docs:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall("[^\x20\x09-\x0d]+", low)
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    root = list(range(len(docs)))

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for i, s in enumerate(sets):
        for j in range(i):
            if s and sets[j] and 100 * min(len(s), len(sets[j])) >= percent * max(len(s), len(sets[j])):
                common = len(s & sets[j])
                if 100 * common >= percent * (len(s) + len(sets[j]) - common):
                    a, b = sorted((find(i), find(j)))
                    root[b] = a
    least: dict[int, int] = {}
    for i, (doc, _) in enumerate(docs):
        least[find(i)] = min(least.get(find(i), doc), doc)
    return [(doc, len(sets[i]), least[find(i)]) for i, (doc, _) in enumerate(docs)]


LINK_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END)) AS s FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1
), p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2
), l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)
), e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l
), r AS (SELECT doc_id AS d, doc_id AS c FROM documents UNION SELECT e.y, r.c FROM r JOIN e ON e.x = r.d)
SELECT d AS doc_id, CAST(coalesce(any_value(n), 0) AS BIGINT) AS n_shingles, min(c) AS component_id FROM r LEFT JOIN n ON doc_id = d GROUP BY d
"""
