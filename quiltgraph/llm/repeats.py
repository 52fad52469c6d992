"""Long repeated byte strings, found with a run-length index.

A window is ``least`` consecutive bytes of one text. It is repeated if the same bytes
start anywhere else, in another text or in the same one.

1. Windows are dealt by their minimizer: the leftmost least hash of the ``GRAM``-byte
   strings inside. Consecutive windows with one minimizer are a segment. Equal windows
   have equal minimizers, so a segment whose minimizer occurs once has no repeat.
2. Segments that share a minimizer are compared by a hash of their bytes. Every window of
   a content that occurs twice is repeated.
3. One copy of each content of a minimizer that has several goes to a run-length index of
   a bounded number of contents: the Burrows-Wheeler transform kept as runs, with the text
   positions at the runs' heads and tails and their common prefixes there. Streaming the
   text, matching statistics fall by one from each sample to the next; those of
   ``least`` or more are repeats.
4. Contents of a minimizer that together exceed an index (``INDEXED`` bytes) are dealt again
   by the minimizers of strings twice as long, through the same steps. With strings of
   ``least`` bytes, windows that meet are equal, so this ends.
5. Repeated windows become spans of bytes, merged for each text.

Defined results: null text counts as empty; a text shorter than ``least`` has no window;
repeated rows are texts of their own, so all of a long repeated row is a repeat; rows
with a null doc_id are treated as others; texts of any length are read whole; an
empty table gives an empty result. A polynomial hash of a minimizer and XXH3 of a
segment's bytes, 64 bits each and of different kinds, together count as equal bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiltgraph.llm.common import cut, drop_path, free_name, scratch_path, text_keys

GRAM = 64
CHUNK = 1 << 19  # bytes of a text hashed at a time
INDEXED = 1 << 20  # bytes of contents that one index takes; the last minimizer's come on top

_BASE = 0x9E3779B97F4A7C15
_TABLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of ``base`` and of its inverse modulo 2 ** 64, ``n`` at least."""
    if base not in _TABLES or len(_TABLES[base][0]) < n:
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            full = np.full(max(n, 1 << 16), b, np.uint64)
            full[0] = 1
            out.append(np.cumprod(full, dtype=np.uint64))
        _TABLES[base] = (out[0], out[1])
    return _TABLES[base]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class Hashes:
    """Hashes of any substrings of some bytes, by prefix sums of a polynomial."""

    def __init__(self, data: np.ndarray):
        power, self.inverse = _powers(_BASE, len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=self.sums[1:])

    def all(self, length: int) -> np.ndarray:
        """Of each substring of a length."""
        n = len(self.sums) - length
        return mix((self.sums[length:] - self.sums[:n]) * self.inverse[:n])


def segments(data: np.ndarray, least: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(minimizer, hash of the bytes, first window, number of windows) of each segment of up to 2 ** 20 bytes."""
    gram = min(gram, least)
    grams = Hashes(data).all(gram)
    width = least - gram + 1
    key = grams >> np.uint64(20) << np.uint64(20) | np.arange(len(grams), dtype=np.uint64)
    n = 1
    while 2 * n <= width:
        key = np.minimum(key[:-n], key[n:])
        n *= 2
    if n < width:
        key = np.minimum(key[: len(grams) - width + 1], key[width - n :])
    at = (key & np.uint64((1 << 20) - 1)).astype(np.int64)
    first = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1])
    end = np.append(first[1:], len(at))
    raw = data.tobytes()
    content = np.array([xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(first.tolist(), (end - 1 + least).tolist())], np.uint64)
    return grams[at[first]], content, first, end - first


class RunLengthIndex:
    """A run-compressed Burrows-Wheeler transform of some contents, each ended by its own mark.

    Kept: the runs' symbols and lengths, and for each run the text positions at its head
    and tail with the common prefix of the head with the suffix before it, and of the
    tail with the suffix after it. The suffix array itself is not kept.
    """

    def __init__(self, contents: list[bytes]):
        k = len(contents)
        self.starts = np.cumsum([0, *(len(c) + 1 for c in contents)])
        n = self.n = int(self.starts[-1])
        text = np.frombuffer(b"".join(c + b"\0" for c in contents), np.uint8).astype(np.int64) + k
        text[self.starts[1:] - 1] = np.arange(k)  # marks differ, and are the least
        order, levels = self._sort(text, k + 256)
        last = text[order - 1]  # the symbol before each suffix, cyclically
        edge = np.flatnonzero(last[1:] != last[:-1]) + 1
        head, tail = np.concatenate([[0], edge]), np.append(edge, n) - 1
        self.symbols, self.lengths = last[head], np.diff(np.append(head, n))
        self.head_at, self.tail_at = order[head], order[tail]
        self.head_common = np.concatenate([[0], self._common(levels, text, order[head[1:]], order[head[1:] - 1])])
        self.tail_common = np.append(self._common(levels, text, order[tail[:-1]], order[tail[:-1] + 1]), 0)

    @staticmethod
    def _sort(text: np.ndarray, base: int) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
        """Suffix order by doubling, and the ranks of substrings at each length that it met."""
        n = len(text)
        pack = max(1, 62 // max(1, base.bit_length()))
        key = np.zeros(n, np.int64)
        for j in range(pack):
            key *= base
            key[: n - j] += text[j:]
        levels, length = [], pack
        while True:
            order = np.argsort(key, kind="stable")
            step = np.concatenate([[0], key[order[1:]] != key[order[:-1]]])
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(step)
            levels.append((length, rank))
            if rank[order[-1]] == n - 1:
                return order, levels
            key = rank * (n + 1)
            key[: n - length] += rank[length:] + 1
            length *= 2

    @staticmethod
    def _common(levels, text: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Lengths of the common prefixes of pairs of suffixes."""
        n, out = len(text), np.zeros(len(a), np.int64)
        for length, rank in reversed(levels):
            x, y = a + out, b + out
            same = (x < n) & (y < n)
            same[same] = rank[x[same]] == rank[y[same]]
            out[same] += length
        for _ in range(levels[0][0]):
            x, y = a + out, b + out
            same = (x < n) & (y < n)
            same[same] = text[x[same]] == text[y[same]]
            if not same.any():
                break
            out[same] += 1
        return out

    def matching_statistics(self) -> np.ndarray:
        """For each position, the longest match with any other: samples carried along the text.

        A suffix inside a run has the same neighbour one symbol on, so its common prefix is
        one less than that of the position before.
        """
        out = np.zeros(self.n, np.int64)
        for at, common in ((self.head_at, self.head_common), (self.tail_at, self.tail_common)):
            sample = np.full(self.n, -1, np.int64)
            sample[at] = np.arange(len(at))
            where = np.maximum.accumulate(np.where(sample >= 0, np.arange(self.n), -1))
            known = where >= 0
            value = common[sample[where[known]]] - (np.flatnonzero(known) - where[known])
            out[known] = np.maximum(out[known], value)
        return out

    def repeats(self, least: int) -> list[list[tuple[int, int]]]:
        """For each content, runs [first, last] of offsets where a match of ``least`` begins."""
        long_ = (self.matching_statistics() >= least).astype(np.int8)
        turn = np.diff(long_, prepend=0, append=0)
        begin, end = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1) - 1
        cuts = np.searchsorted(begin, self.starts)
        return [[(int(x - s), int(y - s)) for x, y in zip(begin[a:b], end[a:b])] for s, a, b in zip(self.starts, cuts, cuts[1:])]


RUNS = "array<struct<first:int,last:int>>"
RUNS_ARROW = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))


def _segment_rows(docs: DataFrame, least: int, gram: int) -> DataFrame:
    """(minimizer, content, rid, start, windows) of every segment of ``docs`` (rid, text)."""
    names = ["minimizer", "content", "rid", "start", "windows"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[np.ndarray, ...]] = []
            for rid, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = np.frombuffer(text.as_buffer(), np.uint8) if text.is_valid and len(text.as_buffer()) else np.zeros(0, np.uint8)
                for a in range(0, len(data) - least + 1, CHUNK):
                    m, c, first, count = segments(data[a : a + CHUNK + least - 1], least, gram)
                    out.append((m.view(np.int64), c.view(np.int64), np.full(len(m), rid), first + a, count))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in zip(*out)], names=names)

    return docs.mapInArrow(run, "minimizer long, content long, rid long, start long, windows long")


def _indexed(pieces: DataFrame, least: int) -> DataFrame:
    """(minimizer, content, runs) of the repeated windows among ``pieces`` (minimizer, content, bytes)."""
    names = ["minimizer", "content", "runs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, bytes]] = []
        size = 0

        def done() -> pa.RecordBatch:
            runs = RunLengthIndex([x[2] for x in held]).repeats(least)
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in held], pa.int64()), pa.array([x[1] for x in held], pa.int64()), pa.array([[{"first": a, "last": b} for a, b in r] for r in runs], RUNS_ARROW)], names=names)

        for batch in batches:  # sorted by minimizer: each is whole in one index
            for row in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if size >= INDEXED and row[0] != held[-1][0]:
                    yield done()
                    held, size = [], 0
                held.append(row)
                size += len(row[2])
        if held:
            yield done()

    dealt = pieces.select(*names[:2], "bytes").repartition("minimizer").sortWithinPartitions("minimizer")
    return dealt.mapInArrow(run, f"minimizer long, content long, runs {RUNS}")


def _identified(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    rid = F.xxhash64(F.col(doc_id).cast("string"), F.col(text))
    return docs.withColumn(free_name(docs, "rid"), rid)


def _stored(df: DataFrame, path: str) -> DataFrame:
    """``df`` read back from a compressed table of the shared folder."""
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def repeated_windows(texts: DataFrame, least: int, gram: int, path: str) -> tuple[DataFrame, DataFrame]:
    """(rid, first, last): runs of repeated windows of ``texts`` (rid, text), and those of the texts that share a minimizer."""
    spark = texts.sparkSession
    _segment_rows(texts, least, gram).write.parquet(f"{path}/segments")
    every = spark.read.parquet(f"{path}/segments")
    # Cut, so that the join has a plain shuffle on either side, which Spark splits where a minimizer is very common.
    often = _stored(every.groupBy("minimizer").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("minimizer"), f"{path}/often")
    shared = _stored(every.join(often, "minimizer"), f"{path}/shared")
    drop_path(spark, f"{path}/segments")

    contents = shared.groupBy("minimizer", "content").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("rid", "start", "windows")).alias("one"))
    kinds = contents.groupBy("minimizer").agg(F.count(F.lit(1)).alias("contents"), F.sum(F.col("one.windows") + least - 1).alias("size"))
    contents = _stored(contents.join(kinds, "minimizer"), f"{path}/contents")
    places = shared.dropDuplicates(["rid", "start"])

    # Texts with a shared minimizer are all that is read from here on.
    texts.join(places.select("rid").distinct(), "rid", "left_semi").dropDuplicates(["rid"]).write.parquet(f"{path}/texts")
    near = spark.read.parquet(f"{path}/texts")
    mixed = contents.where("contents > 1").select("minimizer", "content", "size", "one.*")
    pieces = mixed.join(near.select("rid", "text"), "rid").select("minimizer", "content", "size", F.expr(f"substring(cast(text as binary), cast(start as int) + 1, cast(windows as int) + {least - 1})").alias("bytes"))
    pieces = _stored(pieces, f"{path}/pieces")
    fits = F.lit(gram >= least) | (F.col("size") <= INDEXED)
    runs = _stored(_indexed(pieces.where(fits), least), f"{path}/runs")
    if not pieces.where(~fits).isEmpty():
        large = _stored(pieces.where(~fits).select("minimizer", "content", F.monotonically_increasing_id().alias("rid"), F.col("bytes").alias("text")), f"{path}/large")
        found, _ = repeated_windows(large.select("rid", "text"), least, min(2 * gram, least), f"{path}/longer")
        one = F.struct(F.col("first").cast("int").alias("first"), F.col("last").cast("int").alias("last"))
        deeper = large.select("rid", "minimizer", "content").join(found, "rid").groupBy("minimizer", "content").agg(F.collect_list(one).alias("runs"))  # of one segment
        runs = runs.unionByName(_stored(deeper, f"{path}/deeper"))

    whole = F.array(F.struct(F.lit(0).alias("first"), (F.col("windows") - 1).cast("int").alias("last")))
    # One join of two plain shuffles again: a content with very many copies is split.
    verdicts = _stored(contents.select("minimizer", "content", "copies").join(runs, ["minimizer", "content"], "left"), f"{path}/verdicts")
    known = places.join(verdicts, ["minimizer", "content"])
    found = known.select("rid", "start", F.explode(F.when(F.col("copies") > 1, whole).otherwise(F.col("runs"))).alias("run"))
    return found.select("rid", (F.col("start") + F.col("run.first")).alias("first"), (F.col("start") + F.col("run.last")).alias("last")), near


def repeated_spans(docs: DataFrame, least: int = 200) -> tuple[DataFrame, DataFrame, str]:
    """For ``docs`` (rid, text, ...): (rid, spans [start, end) with repeated bytes, unmerged), the rows of those rids, and a scratch folder."""
    path = scratch_path(docs.sparkSession, "repeats")
    found, near = repeated_windows(docs, least, GRAM, path)
    span = F.struct(F.col("first").alias("start"), (F.col("last") + least).alias("end"))
    return found.groupBy("rid").agg(F.collect_list(span).alias("spans")), near, path


def merged(spans: list[dict]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted((x["start"], x["end"]) for x in spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _kept(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for a, b in spans:
        out.append(data[at:a])
        at = b
    out.append(data[at:])
    return b"".join(out)


def repeat_digests(docs: DataFrame, least: int = 200) -> DataFrame:
    """Per document: its bytes, how many and in how many runs are repeats, and the digest of the rest."""
    rows = _identified(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")), "doc_id", "text")
    spans, texts, path = repeated_spans(rows.select("rid", "text"), least)
    names = ["rid", "n_removed", "n_spans", "kept"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for rid, text, found in zip(batch.column("rid").to_pylist(), batch.column("text"), batch.column("spans")):
                s = merged(found.as_py())
                out.append((rid, sum(b - a for a, b in s), len(s), hashlib.sha256(_kept(text.as_buffer().to_pybytes(), s)).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.string()))] if out else [pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.string())], names=names)

    changed = cut(texts.join(spans, "rid").select("rid", "text", "spans").mapInArrow(run, "rid long, n_removed long, n_spans long, kept string"))
    drop_path(docs.sparkSession, path)
    whole = rows.select("doc_id", "rid", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("sha"))
    zero = F.lit(0).cast("long")
    return whole.join(changed, "rid", "left").select("doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("kept", "sha").alias("kept_sha256"))


def without(spans: list[tuple[int, int]], spared: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """What of merged ``spans`` lies outside ``spared``, which may overlap."""
    out, other = [], merged([{"start": a, "end": b} for a, b in spared])
    for a, b in spans:
        for x, y in other:
            if x < b and y > a:
                if x > a:
                    out.append((a, x))
                a = y
        if a < b:
            out.append((a, b))
    return out


def remove_repeats(docs: DataFrame, least: int = 200, doc_id: str = "doc_id", text: str = "text", spared: DataFrame | None = None, spared_bytes: Callable[[str, list], list[tuple[int, int]]] | None = None) -> DataFrame:
    """``docs`` without the repeated bytes of ``text``; a character goes only if all its bytes are repeats.

    ``spared`` has (h, g, spared) for texts, by :func:`text_keys`, in which something stays although
    it repeats; ``spared_bytes`` makes of a text and that value spans [start, end) of bytes.
    """
    marked = _identified(docs, doc_id, text)
    rid = marked.columns[-1]
    spans, texts, path = repeated_spans(marked.select(F.col(rid).alias("rid"), F.coalesce(F.col(text), F.lit("")).alias("text")), least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value, found, kept in zip(*(batch.column(c).to_pylist() for c in ("text", "spans", "spared"))):
                data, s = value.encode(), []
                cut_out = merged(found)
                if kept and spared_bytes:
                    cut_out = without(cut_out, spared_bytes(value, kept))
                for a, b in cut_out:
                    while a < b and data[a] & 0xC0 == 0x80:
                        a += 1
                    while b > a and b < len(data) and data[b] & 0xC0 == 0x80:
                        b -= 1
                    s.append((a, b))
                out.append(_kept(data, s).decode())
            yield pa.RecordBatch.from_arrays([batch.column("rid"), pa.array(out, pa.string())], names=["rid", "text_left"])

    found = texts.join(spans, "rid")
    if spared is None:
        found = found.withColumn("spared", F.lit(None).cast("array<long>"))
    else:
        found = found.select("rid", "text", "spans", *text_keys("text")).join(spared, ["h", "g"], "left")
    changed = cut(found.select("rid", "text", "spans", "spared").mapInArrow(run, "rid long, text_left string"))
    drop_path(docs.sparkSession, path)
    left = marked.join(changed.select(F.col("rid").alias(rid), F.col("text_left").alias(free_name(marked, "text_left"))), rid, "left")
    return left.withColumn(text, F.coalesce(left.columns[-1], text)).select(docs.columns)


def brute_force(docs: list[tuple[int, str | None]], least: int) -> list[tuple]:
    """The digest columns by a count of all windows, for tests."""
    from collections import Counter

    texts = [(t or "").encode() for _, t in docs]
    times = Counter(b[i : i + least] for b in texts for i in range(len(b) - least + 1))
    out = []
    for (doc, _), b in zip(docs, texts):
        s = merged([{"start": i, "end": i + least} for i in range(len(b) - least + 1) if times[b[i : i + least]] > 1])
        out.append((doc, len(b), sum(y - x for x, y in s), len(s), hashlib.sha256(_kept(b, s)).hexdigest()))
    return out
