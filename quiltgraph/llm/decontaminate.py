r"""Benchmark decontamination over a stored positional inverted index.

:func:`build_index` writes the postings of all words of all texts. Texts are gathered in
segments of some ``SEGMENT_BYTES`` (a text is never cut); a row of the index holds the
positions of one term in one segment, as differences in variable-length bytes, and one
row a segment says where its texts begin. Any number of benchmarks can be asked of it.

:func:`hits` reads just the lists of the benchmark's terms. Their counts over the whole
index order each window's terms from the globally rarest on, and each window goes, by a
join on its rarest term, to the segments that hold that term. There its postings, shifted
by the term's offset, are candidate starts; these are intersected with the shifted
postings of the next rarest term, and so on. What is left are exact phrases. For
proximity, all distinct terms of a window must lie within its length and ``slack`` words.
Nothing is broadcast but by Spark's own check of sizes.

Words are runs of digits, letters a-z (A-Z lower-cased) and non-ASCII bytes. Windows
are ``width`` consecutive words of an item; a shorter item is one window.

Defined results: null and empty texts have no words and no hits; items without
words, or with a null item_id, take no part; rows that repeat an item_id are one
item; repeated documents are reported each; texts of any length are indexed whole;
an empty benchmark hits nothing; other columns pass unchanged. Equal texts are told
by two 64-bit hashes, and windows by one among the benchmark's.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiltgraph.llm.common import cut, drop_path, free_name, scratch_path, text_keys

SEGMENT_BYTES = 4 << 20  # text in one index segment
CANDIDATES = 1 << 21  # shifted postings in memory at a time

_KEEP = set(b"0123456789abcdefghijklmnopqrstuvwxyz") | set(range(128, 256))
FOLD = bytes(b if b in _KEEP else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]++"  # the same words, for counting them in the JVM


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split() if text else []


def byte_spans(text: str, spans: list) -> list[tuple[int, int]]:
    """Spans of words ([start, end), as rows of hit_spans) as spans of the text's UTF-8 bytes."""
    blank = np.frombuffer(b" " + text.encode("utf-8", "surrogatepass").translate(FOLD) + b" ", np.uint8) == 32
    start, end = np.flatnonzero(blank[:-1] & ~blank[1:]), np.flatnonzero(~blank[:-1] & blank[1:])
    return [(int(start[x["start"]]), int(end[x["end"] - 1])) for x in spans]


def packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers as bytes of seven bits each, the last without its high bit, and how many bytes each took."""
    size = np.ones(len(values), np.int64)
    for bits in (7, 14, 21, 28):
        size += values >= 1 << bits
    at = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    for k in range(int(size.max(initial=0))):
        has = size > k
        out[at[has] + k] = (values[has] >> (7 * k) & 127) | np.where(size[has] > k + 1, 128, 0)
    return out, size


def unpacked(data: np.ndarray) -> np.ndarray:
    end = np.flatnonzero(data < 128)
    start = np.concatenate([[0], end[:-1] + 1]) if len(end) else end
    out = np.zeros(len(end), np.int64)
    for k in range(int((end - start).max(initial=-1)) + 1):
        has = start + k <= end
        out[has] |= (data[start[has] + k].astype(np.int64) & 127) << (7 * k)
    return out


def segment_rows(texts: list[tuple[str | None, int, int]]) -> tuple[list, np.ndarray, np.ndarray, np.ndarray, bytes]:
    """(terms, counts, bytes of all lists, ends of each in them, row of the texts) of a segment of (text, h, g)."""
    split = [words(t) for t, _, _ in texts]
    sizes = np.array([len(w) for w in split], np.int64)
    total = int(sizes.sum())
    base = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])  # a gap keeps phrases inside a text
    number: defaultdict[bytes, int] = defaultdict(count().__next__)
    ids = np.fromiter(map(number.__getitem__, chain.from_iterable(split)), np.int64, total)
    position = np.arange(total) + np.repeat(np.arange(len(sizes)), sizes)
    order = np.argsort(ids, kind="stable")
    position, counts = position[order], np.bincount(ids, minlength=len(number))
    step = np.diff(position, prepend=0)
    first = np.cumsum(counts) - counts
    step[first] = position[first]
    data, size = packed(step)
    ends = np.cumsum(size)[np.cumsum(counts) - 1] if total else np.zeros(0, np.int64)
    about = np.concatenate([base, sizes, [h for _, h, _ in texts], [g for _, _, g in texts]]).astype(np.int64).tobytes()
    return list(number), counts, data, ends, about


def build_index(docs: DataFrame, path: str, text: str = "text") -> None:
    """Writes the postings of every word of ``docs``: (segment, term, n, postings); a null term has the segment's texts."""
    names, kinds = ["segment", "term", "n", "postings"], [pa.int64(), pa.binary(), pa.int32(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = (TaskContext.get().partitionId() << 32) - 1
        for batch in batches:
            h, g = (batch.column(i).to_pylist() for i in (1, 2))
            held, size = [], 0
            for i, x in enumerate(batch.column(0)):
                held.append((x.as_py(), h[i], g[i]))
                size += len(held[-1][0])
                if size < SEGMENT_BYTES and i + 1 < batch.num_rows:
                    continue
                number += 1
                terms, counts, data, ends, about = segment_rows(held)
                offsets = pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32).tobytes())
                lists = pa.Array.from_buffers(pa.binary(), len(terms), [None, offsets, pa.py_buffer(data.tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array([number], kinds[0]), pa.array([None], kinds[1]), pa.array([len(held)], kinds[2]), pa.array([about], kinds[3])], names=names)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(terms), number)), pa.array(terms, pa.binary()), pa.array(counts.astype(np.int32)), lists], names=names)
                held, size = [], 0

    keyed = docs.where(F.octet_length(text) > 0).select(F.col(text).alias("text"), *text_keys(text))
    keyed.mapInArrow(run, "segment long, term binary, n int, postings binary").write.parquet(path, compression="zstd")


def _windows(bench: DataFrame, width: int, item_id: str, text: str) -> DataFrame:
    """(item, w, terms) of the windows of each item; w is a window's number, by its terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items, found = [], []
            for item, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                w = words(x.as_py())
                for a in range(max(1, len(w) - width + 1) if w else 0):
                    items.append(item)
                    found.append(w[a : a + width])
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(found, pa.list_(pa.binary()))], names=["item", "terms"])

    rows = bench.where(F.col(item_id).isNotNull() & F.col(text).isNotNull()).select(F.col(item_id).cast("string").alias("item"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "item string, terms array<binary>").select("item", F.xxhash64("terms").alias("w"), "terms")


class Postings:
    """The lists of some terms in one segment, as sorted keys of a term's place << 32 | position."""

    def __init__(self, about: bytes, ids: np.ndarray, counts: np.ndarray, data: list[bytes]):
        texts = np.frombuffer(about, np.int64).reshape(4, -1)
        self.base, self.sizes, self.h, self.g = texts
        order = np.argsort(ids, kind="stable")
        self.ids, self.count = ids[order], counts[order]
        step = unpacked(np.frombuffer(b"".join(data[i] for i in order.tolist()), np.uint8))
        self.first = np.cumsum(self.count) - self.count
        total = np.cumsum(step)
        position = total - np.repeat(total[self.first] - step[self.first], self.count) if len(step) else step
        self.keys = np.repeat(np.arange(len(self.ids)), self.count) << 32 | position

    def places(self, ids: np.ndarray) -> np.ndarray:
        """Each term's place here, or -1."""
        at = np.minimum(np.searchsorted(self.ids, ids), max(0, len(self.ids) - 1))
        return np.where(self.ids[at] == ids, at, -1) if len(self.ids) else np.full(len(ids), -1)

    def has(self, term: np.ndarray, position: np.ndarray) -> np.ndarray:
        key = term << 32 | np.maximum(position, 0)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return (position >= 0) & (self.keys[at] == key)

    def text_of(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.base, position, "right") - 1

    def anchors(self, rarest: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Chunks of (window, position of its rarest term)."""
        ends, a = np.cumsum(self.count[rarest]), 0
        while a < len(rarest):
            done = int(ends[a - 1]) if a else 0
            b = max(a + 1, int(np.searchsorted(ends, done + CANDIDATES, "right")))
            n = self.count[rarest[a:b]]
            owner = np.repeat(np.arange(a, b), n)
            at = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.first[rarest[a:b]], n)
            yield owner, self.keys[at] & 0xFFFFFFFF
            a = b

    def phrases(self, terms: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, start) of every occurrence of windows, given as places of terms, the rarest first (-2: none), and offsets."""
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for window, position in self.anchors(terms[:, 0]):
            start = position - offsets[window, 0]
            for j in range(1, terms.shape[1]):
                term = terms[window, j]
                keep = (term < 0) | self.has(np.maximum(term, 0), start + offsets[window, j])
                window, start = window[keep], start[keep]
                if not len(window):
                    break
            found.append((window[start >= 0], start[start >= 0]))
        return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])

    def near(self, terms: np.ndarray, lengths: np.ndarray, slack: int) -> set[tuple[int, int]]:
        """(window, text) where all distinct terms of a window lie within its length plus ``slack`` words."""
        found: set[tuple[int, int]] = set()
        for window, position in self.anchors(terms[:, 0]):
            text, span = self.text_of(position), lengths[window] + slack
            low = np.maximum(position - span + 1, self.base[text])
            high = np.minimum(position + span, self.base[text] + self.sizes[text])
            for j in range(1, terms.shape[1]):  # a posting of each term must be near the rarest's
                term = terms[window, j]
                at = np.minimum(np.searchsorted(self.keys, np.maximum(term, 0) << 32 | low), len(self.keys) - 1)
                keep = (term < 0) | (self.keys[at] >> 32 == term) & ((self.keys[at] & 0xFFFFFFFF) < high)
                window, position, text, span, low, high = (x[keep] for x in (window, position, text, span, low, high))
            for k, p, d, n, a, b in zip(*(x.tolist() for x in (window, position, text, span, low, high))):
                if (k, d) in found:
                    continue
                lists = []
                for t in set(terms[k].tolist()) - {-2}:
                    i, j = np.searchsorted(self.keys, [t << 32 | a, t << 32 | b])
                    lists.append(self.keys[i:j] & 0xFFFFFFFF)
                for s in sorted({max(p - n + 1, a), *(int(x) for y in lists for x in y if x <= p)}):
                    if s + n > p and all(((x >= s) & (x < s + n)).any() for x in lists):
                        found.add((k, d))
                        break
        return found


class _Segment:
    """What a segment's windows have hit so far; windows come in any number of parts."""

    def __init__(self, postings: Postings, slack: int | None):
        self.postings, self.slack = postings, slack
        p = postings
        self.edge = np.zeros(int(p.base[-1] + p.sizes[-1]) + 2, np.int32)
        self.windows: defaultdict[int, set[int]] = defaultdict(set)
        self.near: defaultdict[int, set[int]] = defaultdict(set)

    def ask(self, numbers: np.ndarray, lengths: np.ndarray, ids: np.ndarray, offsets: np.ndarray) -> None:
        """Windows by number; ``ids`` and ``offsets`` of their terms, the rarest first, one after the other."""
        p, width = self.postings, int(lengths.max())
        terms, places = np.full((len(lengths), width), -2), np.zeros((len(lengths), width), np.int64)
        inside = np.arange(width) < lengths[:, None]
        terms[inside], places[inside] = p.places(ids), offsets
        all_here = (terms != -1).all(axis=1)
        numbers, lengths, terms, places = (x[all_here] for x in (numbers, lengths, terms, places))
        if not len(numbers):
            return
        window, start = p.phrases(terms, places)
        np.add.at(self.edge, start, 1)
        np.add.at(self.edge, start + lengths[window], -1)
        for k, d in zip(numbers[window].tolist(), p.text_of(start).tolist()):
            self.windows[d].add(k)
        if self.slack is not None:
            for k, d in p.near(terms, lengths, self.slack):
                self.near[d].add(int(numbers[k]))

    def rows(self) -> list[tuple]:
        """(h, g, n_words, spans, windows, near) of each different text that was hit."""
        p, out = self.postings, {}
        turn = np.diff((np.cumsum(self.edge) > 0).astype(np.int8), prepend=0, append=0)
        begin, end = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
        for d in sorted({*self.windows, *self.near}):
            base = int(p.base[d])
            a, b = np.searchsorted(begin, [base, base + int(p.sizes[d])])
            spans = [{"start": int(x) - base, "end": int(y) - base} for x, y in zip(begin[a:b], end[a:b])]
            out[int(p.h[d]), int(p.g[d])] = (int(p.sizes[d]), spans, sorted(self.windows[d]), sorted(self.near[d]))
        return [(*k, *v) for k, v in out.items()]


SPANS = "array<struct<start:long,end:long>>"


def hits(spark: SparkSession, index: str, bench: DataFrame, width: int = 13, slack: int | None = None, item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(h, g, n_words, hit_spans, items, near_items) of each different text with a hit in the index.

    hit_spans are [start, end) in words, maximal runs; items and near_items (with a
    ``slack``) are sorted ids of items with an exact or a near window in it.
    """
    path = scratch_path(spark, "windows")
    windows = cut(_windows(bench, width, item_id, item_text))
    shapes = windows.select("w", "terms").dropDuplicates(["w"])
    each = cut(shapes.select("w", F.posexplode("terms").alias("offset", "term")))
    postings = spark.read.parquet(index)
    postings.where("term is not null").join(each.select("term").distinct(), "term").write.parquet(path, compression="zstd")
    lists = spark.read.parquet(path)
    times = lists.groupBy("term").agg(F.sum("n").alias("times"))
    ranked = each.join(times, "term", "left").groupBy("w").agg(F.sort_array(F.collect_list(F.struct("times", "offset", "term"))).alias("order"))  # of one window
    asked = ranked.where(F.col("order")[0]["times"].isNotNull()).select("w", F.col("order")[0]["term"].alias("term"), F.col("order.offset").alias("offsets"), F.transform("order.term", lambda t: F.xxhash64(t)).alias("ids"))
    met = lists.select("segment", "term").join(asked, "term").select("segment", F.lit(2).alias("kind"), F.col("w").alias("key"), F.lit(0).alias("n"), F.lit(None).cast("binary").alias("data"), "offsets", "ids")
    none = (F.lit(None).cast("array<int>").alias("offsets"), F.lit(None).cast("array<long>").alias("ids"))
    wanted = met.select("segment").distinct()
    texts = postings.where("term is null").join(wanted, "segment", "left_semi").select("segment", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("key"), "n", F.col("postings").alias("data"), *none)
    known = lists.select("segment", F.lit(1).alias("kind"), F.xxhash64("term").alias("key"), "n", F.col("postings").alias("data"), *none)
    rows = texts.unionByName(known).unionByName(met).repartition("segment").sortWithinPartitions("segment", "kind")
    names = ["h", "g", "n_words", "spans", "windows", "near"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.list_(pa.int64()), pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, about, held, segment = None, None, [], None

        def done() -> pa.RecordBatch:
            found = segment.rows() if segment else []
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], t) for k, t in enumerate(kinds)], names=names)

        for batch in batches:
            order = batch.column(0).to_numpy() * 4 + batch.column(1).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(order)) + 1).tolist(), batch.num_rows] if batch.num_rows else []
            for a, b in zip(edges, edges[1:]):
                part, kind = batch.slice(a, b - a), batch.column(1)[a].as_py()
                if batch.column(0)[a].as_py() != at:
                    if at is not None:
                        yield done()
                    at, about, held, segment = batch.column(0)[a].as_py(), None, [], None
                if kind == 0:
                    about = part.column(4)[0].as_py()
                elif kind == 1:
                    held.append((part.column(2).to_numpy(), part.column(3).to_numpy().astype(np.int64), part.column(4).to_pylist()))
                elif kind == 2:
                    if segment is None:
                        segment = _Segment(Postings(about, np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]), [y for x in held for y in x[2]]), slack)
                        held = []
                    lengths = np.array([len(x) for x in part.column(5)], np.int64)
                    segment.ask(part.column(2).to_numpy(), lengths, part.column(6).flatten().to_numpy(), part.column(5).flatten().to_numpy().astype(np.int64))
        if at is not None:
            yield done()

    found = rows.select("segment", "kind", "key", "n", "data", "offsets", "ids").mapInArrow(run, f"h long, g long, n_words long, spans {SPANS}, windows array<long>, near array<long>")
    one = cut(found.groupBy("h", "g").agg(*(F.first(c).alias(c) for c in names[2:])))  # equal texts have equal rows
    drop_path(spark, path)
    of = windows.select("w", "item").distinct()

    def named(column: str, out: str) -> DataFrame:
        return one.select("h", "g", F.explode(column).alias("w")).join(of, "w").groupBy("h", "g").agg(F.array_sort(F.collect_set("item")).alias(out))

    empty = F.array().cast("array<string>")
    full = one.select("h", "g", "n_words", F.col("spans").alias("hit_spans")).join(named("windows", "items"), ["h", "g"], "left").join(named("near", "near_items"), ["h", "g"], "left")
    return cut(full.select("h", "g", "n_words", "hit_spans", F.coalesce("items", empty).alias("items"), F.coalesce("near_items", empty).alias("near_items")))


def text_hits(docs: DataFrame, bench: DataFrame, width: int = 13, slack: int | None = None, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """:func:`hits` of the texts of ``docs``, over an index that is dropped afterwards."""
    path = scratch_path(docs.sparkSession, "postings")
    build_index(docs, path, text)
    found = hits(docs.sparkSession, path, bench, width, slack, item_id, item_text)
    drop_path(docs.sparkSession, path)
    return found


def n_hit(spans: str = "hit_spans"):
    """How many words lie in some spans."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])


def _matched(docs: DataFrame, found: DataFrame, columns: dict[str, str], text: str) -> DataFrame:
    """``docs`` with n_words and columns of ``found``, under free names."""
    h, g = (free_name(docs, c) for c in ("h_", "g_"))
    names = {c: free_name(docs, c) for c in ("n_words", *columns)}
    keys = text_keys(text)
    right = found.select(F.col("h").alias(h), F.col("g").alias(g), *(F.col(c).alias(names[c]) for c in columns))
    counted = docs.withColumns({h: keys[0], g: keys[1], names["n_words"]: F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")})
    return counted.join(right, [h, g], "left").select(*docs.columns, names["n_words"], *(F.coalesce(F.col(names[c]), F.array().cast(t)).alias(names[c]) for c, t in columns.items()))


def phrase_matches(docs: DataFrame, bench: DataFrame, width: int = 13, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` with n_words, hit_spans ([start, end) in words, maximal runs) and items (sorted ids with a hit)."""
    return _matched(docs, text_hits(docs, bench, width, None, text, item_id, item_text), {"hit_spans": SPANS, "items": "array<string>"}, text)


def proximity_matches(docs: DataFrame, bench: DataFrame, slack: int, width: int = 13, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` with n_words and near_items: items that have a window whose distinct terms all lie within its length plus ``slack`` words."""
    return _matched(docs, text_hits(docs, bench, width, slack, text, item_id, item_text), {"near_items": "array<string>"}, text)


def contamination(docs: DataFrame, bench: DataFrame, width: int = 13, share: int = 20, slack: int = 3) -> DataFrame:
    """Per document the digest columns: hits, items, whether a ``share``-th of its words is hit, and items nearby."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = _matched(rows, text_hits(rows, bench, width, slack), {"hit_spans": SPANS, "items": "array<string>", "near_items": "array<string>"}, "text")
    return found.select("doc_id", "n_words", n_hit().alias("n_hit"), "items", "near_items").select(
        "doc_id", "n_words", "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
        F.size("near_items").cast("long").alias("n_near"),
    )


def brute_force(docs: list[tuple[int, str | None]], bench: list[tuple[object, str | None]], width: int = 13, slack: int = 3) -> list[tuple]:
    """The same digest columns by plain loops, for tests."""
    windows: dict[tuple, set[str]] = {}
    for item, text in bench:
        w = words(text)
        for a in range(max(1, len(w) - width + 1) if w and item is not None else 0):
            windows.setdefault(tuple(w[a : a + width]), set()).add(str(item))
    lengths, out = {len(x) for x in windows}, []
    for doc, text in docs:
        w, hit, items = words(text), set(), set()
        for n in lengths:
            for a in range(len(w) - n + 1):
                if found := windows.get(tuple(w[a : a + n])):
                    hit.update(range(a, a + n))
                    items |= found
        near = set()
        for x, names in windows.items():
            if any(set(x) <= set(w[a : a + len(x) + slack]) for a in range(len(w))):
                near |= names
        out.append((doc, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w), len(near)))
    return out


CONTAMINATION_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL
), i AS (
  SELECT item, least(len(w), 13) AS k, array_to_string(w[a:a + least(len(w), 13) - 1], ' ') AS s
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS a FROM b WHERE len(w) > 0)
), v AS (
  SELECT doc_id, a, k, array_to_string(w[a:a + k - 1], ' ') AS s
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS a FROM d, (SELECT DISTINCT k FROM i))
), h AS (SELECT DISTINCT doc_id, a, k, item FROM v JOIN i USING (k, s)
), o AS (SELECT s, k, list_distinct(string_split(s, ' ')) AS t FROM (SELECT DISTINCT s, k FROM i)
), f AS (SELECT doc_id, p, w[p] AS t FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d)
), c AS (SELECT t, count(*) AS n FROM f GROUP BY 1
), r AS (SELECT s, k, o.t AS t, arg_min(x, (coalesce(n, 0), x)) AS x FROM (SELECT s, k, t, unnest(t) AS x FROM o) o LEFT JOIN c ON c.t = x GROUP BY 1, 2, 3
), q AS (
  SELECT DISTINCT doc_id, s, k FROM (SELECT r.s, r.k, r.t, doc_id, unnest(range(greatest(1, p - r.k - 2), p + 1)) AS a FROM r JOIN f ON f.t = r.x) JOIN d USING (doc_id)
  WHERE list_has_all(w[a:a + k + 2], t)
), z AS (SELECT doc_id, count(DISTINCT item) AS n_near FROM q JOIN i USING (s, k) GROUP BY 1
), n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(a, a + k)) AS p FROM h) GROUP BY 1
), m AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated, coalesce(n_near, 0) AS n_near
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id) LEFT JOIN z USING (doc_id)
"""
