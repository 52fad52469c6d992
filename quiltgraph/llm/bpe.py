"""Byte-level BPE, encoding and decoding.

Pre-tokenisation uses no regular expression. Every code point gets a class; a
symbol is that class with one code point of look-ahead (three for an apostrophe);
a symbol is a function on the eight states of a small automaton. The functions
that compositions of symbols can give form a finite monoid, so a document's
prefix compositions are an associative scan over small integers, run in columns
of blocks. A boundary is where the state that a code point meets can't go on.

Slices between boundaries are merged by rank and kept in a bounded cache. Token
end offsets stay with the ids, and decoding gathers the vocabulary's bytes by them.

Defined results: null text encodes as the empty text; an empty text has no
tokens; repeated rows are encoded each; texts of any length are encoded whole, in
windows that carry the automaton's state; other columns pass unchanged, and an
output column whose name is taken gets an underscore.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import struct
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quiltgraph.llm.common import free_name, read_small_file

# Classes of code points.
LETTER, NUMBER, OTHER, WHITE, SPACE, APOSTROPHE = range(6)
# Symbols: what a code point does, given what follows it.
S_LETTER, S_NUMBER, S_OTHER, S_WHITE_ON, S_WHITE_LAST, S_SPACE_LAST, S_APOS1, S_APOS2 = range(8)
FRESH = 8  # added to the symbol of a text's first code point
# States: what the code points so far have left open.
DONE, IN_LETTER, IN_NUMBER, IN_OTHER, AFTER_SPACE, IN_WHITE, TAIL1, TAIL2 = range(8)

#: The White_Space property of Unicode.
WHITE_SPACE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: The endings after an apostrophe that the pattern splits off.
ONE_LETTER, TWO_LETTERS = "stmd", ("re", "ve", "ll")

WINDOW = 1 << 19  # code points scanned at a time
COLUMN = 256  # length of a block in the scan
CACHE = 1 << 16  # slices in each of a worker's two generations
CACHED_LENGTH = 48
SHORT = 64  # bytes of a slice that is merged by plain lists


def step(state: int, symbol: int) -> tuple[int, bool]:
    """The next state, and whether a token begins at this code point."""
    if symbol >= FRESH:
        return step(DONE, symbol - FRESH)
    if symbol == S_LETTER:
        if state in (TAIL1, TAIL2):
            return (DONE if state == TAIL1 else TAIL1), False
        return IN_LETTER, state not in (IN_LETTER, AFTER_SPACE)
    if symbol == S_NUMBER:
        return IN_NUMBER, state not in (IN_NUMBER, AFTER_SPACE)
    if symbol in (S_OTHER, S_APOS1, S_APOS2):
        if state in (IN_OTHER, AFTER_SPACE):
            return IN_OTHER, False
        return {S_OTHER: IN_OTHER, S_APOS1: TAIL1, S_APOS2: TAIL2}[symbol], True
    if symbol == S_WHITE_ON:
        return IN_WHITE, state != IN_WHITE
    return (AFTER_SPACE if symbol == S_SPACE_LAST else DONE), True


def _monoid():
    """Elements (state -> state), the composition table, each symbol's element, and the boundary table."""
    symbols = [tuple(step(s, x)[0] for s in range(8)) for x in range(2 * FRESH)]
    elements = {tuple(range(8)): 0}
    for f in symbols:
        elements.setdefault(f, len(elements))
    todo = list(elements)
    while todo:
        f = todo.pop()
        for g in symbols:
            h = tuple(g[s] for s in f)
            if h not in elements:
                elements[h] = len(elements)
                todo.append(h)
    table = np.array(list(elements), dtype=np.uint8)
    n = len(elements)
    then = np.empty((n, n), dtype=np.uint16)
    for f, i in elements.items():
        for g, j in elements.items():
            then[i, j] = elements[tuple(g[s] for s in f)]
    first = np.array([[step(s, x)[1] for x in range(2 * FRESH)] for s in range(8)])
    return table, then.ravel(), n, np.array([elements[f] for f in symbols], dtype=np.uint16), first.ravel()


ELEMENTS, THEN, N_ELEMENTS, SYMBOL_ELEMENT, BEGINS = _monoid()


def prefix_compositions(f: np.ndarray) -> np.ndarray:
    """The composition of f[0..i] for each i, by an associative scan over blocks."""
    n = len(f)
    if n <= COLUMN:
        out, acc = np.empty(n, np.uint16), 0
        for i, x in enumerate(f.tolist()):
            acc = int(THEN[acc * N_ELEMENTS + x])
            out[i] = acc
        return out
    blocks = -(-n // COLUMN)
    grid = np.zeros((blocks, COLUMN), np.uint16)  # 0 is the identity
    grid.ravel()[:n] = f
    grid = np.ascontiguousarray(grid.T)
    for j in range(1, COLUMN):
        grid[j] = THEN.take(grid[j - 1].astype(np.int32) * N_ELEMENTS + grid[j])
    before = np.zeros(blocks, np.int32)
    before[1:] = prefix_compositions(grid[-1])[:-1]
    grid = THEN.take(before * N_ELEMENTS + grid)
    return np.ascontiguousarray(grid.T).ravel()[:n]


_CLASSES: np.ndarray | None = None


def classes() -> np.ndarray:
    """The class of each code point."""
    global _CLASSES
    if _CLASSES is None:
        out = np.full(0x110000, OTHER, np.uint8)
        for c in range(0x110000):
            k = unicodedata.category(chr(c))[0]
            if k == "L":
                out[c] = LETTER
            elif k == "N":
                out[c] = NUMBER
        out[WHITE_SPACE] = WHITE
        out[0x20], out[0x27] = SPACE, APOSTROPHE
        _CLASSES = out
    return _CLASSES


_BASE = np.array([S_LETTER, S_NUMBER, S_OTHER, S_WHITE_ON, S_WHITE_ON, S_OTHER], np.uint8)


def symbols(text: str, starts: np.ndarray) -> np.ndarray:
    """The symbols of joined texts that begin at ``starts`` (none empty)."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = classes().take(points)
    is_white = (kind == WHITE) | (kind == SPACE)
    last = np.ones(len(kind), bool)  # white space or an end follows
    last[:-1] = is_white[1:]
    last[starts[1:] - 1] = True
    out = _BASE.take(kind)
    out[(kind == WHITE) & ~last] = S_WHITE_LAST
    out[(kind == SPACE) & ~last] = S_SPACE_LAST
    marks = np.flatnonzero(kind == APOSTROPHE)
    if len(marks):
        ends = np.append(starts[1:], len(kind))[np.searchsorted(starts, marks, "right") - 1]
        for i, end in zip(marks.tolist(), ends.tolist()):
            tail = text[i + 1 : min(i + 3, end)]
            if tail[:1] and tail[0] in ONE_LETTER:
                out[i] = S_APOS1
            elif tail in TWO_LETTERS:
                out[i] = S_APOS2
    out[starts] += FRESH
    return out


def boundaries(text: str, starts: np.ndarray, state: int = DONE) -> tuple[np.ndarray, np.ndarray]:
    """Where tokens begin, and the states after each code point."""
    sym = symbols(text, starts)
    after = ELEMENTS[:, state].take(prefix_compositions(SYMBOL_ELEMENT.take(sym)))
    before = np.empty_like(after)
    before[0], before[1:] = state, after[:-1]
    return np.flatnonzero(BEGINS.take(before.astype(np.int32) * 2 * FRESH + sym)), after


class Vocabulary:
    """Ranks, with a bounded cache of encoded slices; and the bytes of ids, laid end to end."""

    def __init__(self, ranks: bytes):
        pairs = [line.split() for line in ranks.splitlines() if line.strip()]
        self.rank = {base64.b64decode(a): int(b) for a, b in pairs}
        size = max(self.rank.values(), default=-1) + 1
        parts = [b""] * size
        for a, b in self.rank.items():
            parts[b] = a
        self.length = np.array([len(x) for x in parts], np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.length)])[:-1] if size else np.zeros(0, np.int64)
        self.blob = np.frombuffer(b"".join(parts), np.uint8)
        self.parts = parts
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Adjacent pairs joined by lowest rank, leftmost first, in O(n log n)."""
        rank = self.rank
        if piece in rank:
            return [rank[piece]]
        n = len(piece)
        if n <= SHORT:
            return self._merge_short(piece)
        begin_of_next, begin_of_last, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(rank[piece[i : i + 2]], i, i + 2) for i in range(n - 1) if piece[i : i + 2] in rank]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            _, i, e = heapq.heappop(heap)
            j = begin_of_next[i] if alive[i] else n
            if j >= n or end[j] != e:
                continue
            end[i], alive[j], k = e, False, begin_of_next[j]
            begin_of_next[i] = k
            if k < n:
                begin_of_last[k] = i
                if (r := rank.get(piece[i : end[k]])) is not None:
                    heapq.heappush(heap, (r, i, end[k]))
            if (h := begin_of_last[i]) >= 0 and (r := rank.get(piece[h:e])) is not None:
                heapq.heappush(heap, (r, h, e))
        out, i = [], 0
        while i < n:
            out.append(rank[piece[i : end[i]]])
            i = begin_of_next[i]
        return out

    def _merge_short(self, piece: bytes) -> list[int]:
        """The same by plain lists, faster for words."""
        get, none = self.rank.get, 1 << 32
        parts = [piece[i : i + 1] for i in range(len(piece))]
        pairs = [get(a + b, none) for a, b in zip(parts, parts[1:])]
        while pairs and (low := min(pairs)) != none:
            i = pairs.index(low)
            parts[i] += parts.pop(i + 1)
            del pairs[i]
            if i < len(pairs):
                pairs[i] = get(parts[i] + parts[i + 1], none)
            if i:
                pairs[i - 1] = get(parts[i - 1] + parts[i], none)
        return [self.rank[x] for x in parts]

    def encode_slice(self, piece: str) -> bytes:
        """Ids of one slice as little-endian 32-bit integers."""
        got = self.cache.get(piece)
        if got is None:
            got = self.older.get(piece)
            if got is None:
                ids = self.merge(piece.encode("utf-8", "surrogatepass"))
                got = struct.pack(f"<{len(ids)}I", *ids)
            if len(piece) <= CACHED_LENGTH:
                if len(self.cache) >= CACHE:
                    self.cache, self.older = {}, self.cache
                self.cache[piece] = got
        return got

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text; small texts are scanned together, long ones in windows."""
        out: list[bytes] = [b""] * len(texts)
        group, size = [], 0
        for i, text in enumerate(texts):
            if len(text) > WINDOW:
                out[i] = self._encode_long(text)
            elif text:
                group.append(i)
                size += len(text)
                if size >= WINDOW:
                    self._encode_group(texts, group, out)
                    group, size = [], 0
        if group:
            self._encode_group(texts, group, out)
        return out

    def _slices(self, text: str, begin: np.ndarray, end: int) -> list[bytes]:
        cuts = begin.tolist()
        cuts.append(end)
        get, slow = self.cache.get, self.encode_slice  # an older generation's get is only slower
        return [get(p) or slow(p) for p in [text[a:b] for a, b in zip(cuts, cuts[1:])]]

    def _encode_group(self, texts: list[str], group: list[int], out: list[bytes]) -> None:
        text = "".join([texts[i] for i in group])
        starts = np.cumsum([0, *(len(texts[i]) for i in group)])
        begin, _ = boundaries(text, starts[:-1])
        ids = self._slices(text, begin, len(text))
        cuts = np.searchsorted(begin, starts).tolist()
        for i, a, b in zip(group, cuts, cuts[1:]):
            out[i] = b"".join(ids[a:b])

    def _encode_long(self, text: str) -> bytes:
        """Windows overlap by the three code points that a symbol may look at."""
        out, state, at, kept = [], DONE, 0, ""
        while at < len(text):
            part = text[at : at + WINDOW + 3]
            stop = min(WINDOW, len(text) - at)
            sym = symbols(part, np.zeros(1, np.int64))
            if at:
                sym[0] -= FRESH
            sym = sym[:stop]
            after = ELEMENTS[:, state].take(prefix_compositions(SYMBOL_ELEMENT.take(sym)))
            before = np.empty_like(after)
            before[0], before[1:] = state, after[:-1]
            begin = np.flatnonzero(BEGINS.take(before.astype(np.int32) * 2 * FRESH + sym))
            if len(begin):
                if kept or begin[0]:
                    out.append(self.encode_slice(kept + part[: begin[0]]))
                if len(begin) > 1:
                    out += self._slices(part, begin[:-1], int(begin[-1]))
                kept = part[begin[-1] : stop]
            else:
                kept += part[:stop]
            state, at = int(after[-1]), at + stop
        if kept:
            out.append(self.encode_slice(kept))
        return b"".join(out)

    def ends(self, ids: bytes) -> bytes:
        """The byte offset at which each token ends."""
        return np.cumsum(self.length.take(np.frombuffer(ids, "<u4"))).astype("<u8").tobytes()

    def decode(self, ids: bytes, ends: bytes) -> bytes:
        """Bytes gathered from the vocabulary, each token's to the offsets it has."""
        i, e = np.frombuffer(ids, "<u4"), np.frombuffer(ends, "<u8").astype(np.int64)
        parts, out, limit = [], 0, 1 << 16
        for a in range(0, len(i), limit):  # windows bound the memory of the gather
            x, last = i[a : a + limit], e[a : a + limit]
            size = self.length.take(x)
            shift = self.at.take(x) - (last - size - out)
            parts.append(self.blob.take(np.repeat(shift, size) + np.arange(int(last[-1]) - out)).tobytes())
            out = int(last[-1])
        return b"".join(parts)


_VOCABULARIES: dict[int, Vocabulary] = {}


def vocabulary(ranks: bytes) -> Vocabulary:
    """One per worker and rank file."""
    key = hash(ranks)
    if key not in _VOCABULARIES:
        _VOCABULARIES.clear()
        _VOCABULARIES[key] = Vocabulary(ranks)
    return _VOCABULARIES[key]


def _pieces(batch: pa.RecordBatch, text: pa.Array, most: int = 8 << 20) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Parts of a batch of some ``most`` bytes of text, one row at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        base = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + most, "right")))
        yield batch.slice(at, to - at), text.slice(at, to - at)
        at = to


Batches = Iterator[pa.RecordBatch]


def _encoder(ranks: bytes, at: int, names: list[str]) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        v = vocabulary(ranks)
        for whole in batches:
            for batch, column in _pieces(whole, whole.column(at)):
                got = v.encode_all([x or "" for x in column.to_pylist()])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.binary()), pa.array([v.ends(x) for x in got], pa.binary())], names=names)
        v.cache, v.older = {}, {}  # an idle worker keeps the vocabulary only

    return run


def _decoder(ranks: bytes, ids: int, ends: int, names: list[str]) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        v = vocabulary(ranks)
        for whole in batches:
            for batch, _ in _pieces(whole, whole.column(ends)):
                got = [v.decode(a or b"", b or b"") for a, b in zip(batch.column(ids).to_pylist(), batch.column(ends).to_pylist())]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.binary())], names=names)

    return run


def encode(df: DataFrame, ranks_path: str, text: str = "text", ids: str = "ids", ends: str = "ends") -> DataFrame:
    """``df`` with packed 32-bit ids of ``text`` and the 64-bit end offset of each token's bytes."""
    ranks = read_small_file(df.sparkSession, ranks_path)  # fixed size: a vocabulary
    schema = T.StructType([*df.schema.fields, T.StructField(free_name(df, ids), T.BinaryType()), T.StructField(free_name(df, ends), T.BinaryType())])
    return df.mapInArrow(_encoder(ranks, df.columns.index(text), schema.names), schema)


def decode(df: DataFrame, ranks_path: str, ids: str = "ids", ends: str = "ends", decoded: str = "decoded") -> DataFrame:
    """``df`` with the bytes that the ids of :func:`encode` stand for; null ids decode to no bytes."""
    ranks = read_small_file(df.sparkSession, ranks_path)
    schema = T.StructType([*df.schema.fields, T.StructField(free_name(df, decoded), T.BinaryType())])
    return df.mapInArrow(_decoder(ranks, df.columns.index(ids), df.columns.index(ends), schema.names), schema)


def encode_checked(df: DataFrame, ranks_path: str, text: str = "text", ids: str = "ids", check: str = "round_trip") -> DataFrame:
    """``df`` with packed ids of ``text`` and whether they decode to its bytes, in one Python pass."""
    ranks = read_small_file(df.sparkSession, ranks_path)
    schema = T.StructType([*df.schema.fields, T.StructField(free_name(df, ids), T.BinaryType()), T.StructField(free_name(df, check), T.BooleanType())])
    at, kept = df.columns.index(text), len(df.columns)
    inner = [*df.columns, "ids", "ends"]
    encoder, decoder = _encoder(ranks, at, inner), _decoder(ranks, kept, kept + 1, [*inner, "decoded"])

    def run(batches: Batches) -> Batches:
        for batch in decoder(encoder(batches)):
            same = pc.equal(batch.column(kept + 2), pc.fill_null(batch.column(at), "").cast(pa.binary()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: kept + 1], same], names=schema.names)

    return df.mapInArrow(run, schema)


def token_digests(docs: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id with the digests of its ids and of what they decode to, encoded and decoded in one Python pass."""
    ranks = read_small_file(docs.sparkSession, ranks_path)
    names = ["doc_id", "text", "ids", "ends"]
    encoder, decoder = _encoder(ranks, 1, names), _decoder(ranks, 2, 3, [*names, "decoded"])
    digest = lambda column: pa.array([hashlib.sha256(x.as_buffer()).hexdigest() for x in column])

    def run(batches: Batches) -> Batches:
        for batch in decoder(encoder(batches)):
            ids, decoded = batch.column(2), batch.column(4)
            count = pc.divide(pc.binary_length(ids), 4).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), count, digest(ids), digest(decoded)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
