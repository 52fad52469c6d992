"""Each operator on nulls, empty and odd texts, ties, repeats, empty tables and clashing columns, against brute force."""

from __future__ import annotations

import base64
import hashlib
import json
import random
import re

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quiltgraph.llm import bpe, chat, decontaminate, jaccard, licenses, quality, repeats, topk, toxicity, warc
from quiltgraph.llm.common import components, held_out

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
DOCS = "doc_id long, text string"


@pytest.fixture(scope="module")
def vocabulary():
    with open(RANKS, "rb") as f:
        return bpe.Vocabulary(f.read())


@pytest.fixture(scope="module")
def library(vocabulary):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary.rank, special_tokens={})


def packed(library, text):
    return np.array(library.encode_ordinary(text), "<u4").tobytes()


# 1. Byte-level BPE.
@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("abS'sTtlLvreDm  \n\t\r1２9,.!é漢🎉 　"), max_size=60))
def test_bpe_equals_the_library(vocabulary, library, text):
    ids = vocabulary.encode_all([text])[0]
    assert ids == packed(library, text)
    assert vocabulary.decode(ids, vocabulary.ends(ids)) == text.encode()


def test_bpe_windows_carry_the_state(vocabulary, library, monkeypatch):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab's're  \n1,é") for _ in range(rng.randrange(1, 80))) for _ in range(300)]
    monkeypatch.setattr(bpe, "WINDOW", 7)
    assert [vocabulary._encode_long(t) for t in texts] == [packed(library, t) for t in texts]


def test_bpe_long_runs(vocabulary, library):
    for text in ("a" * 5000, " " * 3000 + "x", "=" * 3001, "é" * 2000):
        assert vocabulary.encode_all([text])[0] == packed(library, text)


def test_bpe_rows(spark, library):
    rows = [(1, "Hello  world's\n"), (2, None), (3, ""), (1, "Hello  world's\n")]
    df = spark.createDataFrame([(*r, b"x", 5) for r in rows], DOCS + ", ids binary, ends long")
    got = bpe.token_digests(df, RANKS).collect()
    for r in got:
        text = {1: rows[0][1]}.get(r.doc_id, "")
        ids = packed(library, text)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    assert len(got) == 4 and bpe.token_digests(df.limit(0), RANKS).count() == 0
    assert bpe.encode(df, RANKS).columns == ["doc_id", "text", "ids", "ends", "ids_", "ends_"]
    assert all(r.round_trip for r in bpe.encode_checked(df.select("doc_id", "text"), RANKS).collect())
    both = bpe.decode(bpe.encode(df.select("doc_id", "text"), RANKS), RANKS).collect()
    assert all(bytes(r.decoded).decode() == (r.text or "") for r in both)


# 2. Top-k.
def best(rows, k, scale=256):
    fine = [(i, np.floor(np.array(v, np.float64) * scale).astype(int)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, v in {(i, tuple(v)) for i, v in fine}:
        if q % 50 == 0:
            dot = lambda w: int(sum(a * b for a, b in zip(v, w)))
            scored = sorted((-dot(w), i) for i, w in fine if i != q)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    return sorted(out)


@pytest.mark.parametrize("spread", [1.0, 0.01, 30.0])
def test_top_k(spark, monkeypatch, spread):
    rng = np.random.default_rng(5)
    monkeypatch.setattr(topk, "BLOCK", 40)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 2)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=6) * spread]) for i in range(201)]
    rows += [(300 + i, rows[7][1]) for i in range(30)] + [(500, None), (501, [1.0, None, 2.0]), (550, [float("nan")] * 6), (551, [float("inf")] * 6), (None, [1.0] * 6), (600, [0.5, 0.5]), (650, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("block", F.lit("clash"))
    got = topk.search(df, F.col("vec_id") % 50 == 0)
    assert sorted(map(tuple, got.collect())) == best(rows, 5)
    assert topk.search(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_a_block_is_indexed_once(spark, monkeypatch):
    built = []
    monkeypatch.setattr(topk, "BitSlicedIndex", lambda *a, real=topk.BitSlicedIndex: built.append(1) or real(*a))
    rng = np.random.default_rng(1)
    rows = spark.createDataFrame([(i, rng.integers(-50, 50, 4).tolist(), i) for i in range(90)], "vec_id long, v array<int>, salt long")
    blocks, n_blocks = topk._pack_blocks(rows, "block", 30)
    queries, n_queries = topk._pack_blocks(rows.where("vec_id < 12"), "ask", 3)
    for slices in (1, 2):
        parts = topk._dealt(blocks, n_blocks, queries, slices).rdd.glom().collect()  # a test may look into partitions
        built.clear()
        for part in parts:
            assert [(r.block, r.slice, r.ask) for r in part] == sorted((r.block, r.slice, r.ask) for r in part)
            list(topk.answers(iter([pd.DataFrame(part, columns=["block", "slice", "ask", "dims", "ids", "values"])]), 3))
        assert n_blocks >= 2 and n_queries >= 2 and len(built) == n_blocks * slices


def test_scores_that_overflow_are_refused():
    big = np.full((2, 64), 2**31 - 1, np.int32)
    row = lambda ask: (0, 0, ask, 64, np.array([1, 2], np.int64).tobytes(), big.tobytes())
    with pytest.raises(ValueError, match="62 bits"):
        list(topk.answers(iter([pd.DataFrame([row(-1), row(0)], columns=["block", "slice", "ask", "dims", "ids", "values"])]), 1))


# 3 and 9. Classifiers.
def plain_toxicity(text: str, weights: np.ndarray, bias: float) -> float:
    """The score by a loop over n-grams, each hashed by itself."""
    mask, total, low = (1 << 32) - 1, 0.0, f" {text.lower()} "
    for n in toxicity.ORDERS:
        for i in range(len(low) - n + 1 if text else 0):
            h = ord(low[i])
            for c in low[i + 1 : i + n]:
                h = (h * 0x01000193 + ord(c) * 0x9E3779B1) & mask
            h ^= h >> 15
            total += float(weights[((h * 0x2C1B3C6D + n * 0x85EB) & mask) >> (32 - toxicity.BITS)])
    z = bias + total * toxicity.UNIT / (len(text) + toxicity.SMOOTH)
    return 1 / (1 + np.exp(-z))


def plain_quality(text: str, value: np.ndarray, bias: float) -> float:
    """The score by a loop over words and n-grams, each hashed by itself."""
    mask, wide, found = (1 << 32) - 1, (1 << 64) - 1, []
    data = [32 if c in (32, 9, 10, 11, 12, 13) else c for c in map(ord, f" {text} ")] if text else []

    def spread(h: int, n: int) -> None:
        h ^= h >> 15
        found.append(((h * 0x2C1B3C6D + n * 0x9E37) & mask) >> (32 - quality.BITS))

    for i, c in enumerate(data):
        if c != 32:
            spread(c * 0x85EBCA6B & mask, 1)
        if i + 1 < len(data) and (c != 32 or data[i + 1] != 32):
            spread((c * 0x01000193 + data[i + 1] * 0x9E3779B1) & mask, 2)
        if i + 2 < len(data) and data[i + 1] != 32:
            two = (c * 0x01000193 + data[i + 1] * 0x9E3779B1) & mask
            spread((two * 0x01000193 + data[i + 2] * 0x9E3779B1) & mask, 3)
    words = [w for w in "".join(map(chr, data)).split(" ") if w]
    found += [quality.SAME for v, w in zip(words, words[1:]) if v == w]
    for w in words:
        if w:
            h, power = 0, 1
            for c in w:
                h, power = (h + ord(c) * power) & wide, power * 0x9E3779B97F4A7C15 & wide
            h ^= h >> 31
            found.append((h * 0xBF58476D1CE4E5B9 & wide) >> (64 - quality.BITS))
    return 1 / (1 + np.exp(-(bias + (sum(float(value[i]) for i in found) / len(found) if found else 0.0))))


@pytest.mark.parametrize(("module", "plain"), [(toxicity, plain_toxicity), (quality, plain_quality)])
def test_scores_equal_a_plain_loop(module, plain):
    rng = random.Random(12)
    texts = ["".join(rng.choice("abé漢🎉ZÉ  \n.") for _ in range(rng.randrange(0, 70))) for _ in range(60)] + ["", " ", "x", "one two  three", "on on\non off"]
    numbers = np.random.default_rng(2).normal(size=1 << module.BITS).astype(np.float32) / 1000
    scorer = module.Scorer(numbers, 0.3)
    for text in texts:
        assert abs(scorer.score(text) - plain(text, numbers, 0.3)) < 1e-6


def test_toxicity_fit_is_stationary():
    """At the fitted weights no direction lowers the penalised loss: slopes by plain sums over the texts."""
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["oak", "elm", "ash", "fir"] + (["vile"] if i % 2 else [])) for _ in range(12)) for i in range(30)]
    y = np.array([i % 2 for i in range(30)], np.float64)
    weights, bias = toxicity.fit(texts, y)
    scores = np.array([plain_toxicity(t, weights, bias) for t in texts])
    assert abs((scores - y).mean()) < 10 * toxicity.SLOPE  # the intercept's slope
    assert all(s > 0.5 for s, t in zip(scores, texts) if "vile" in t) and (scores[y == 0] < 0.5).all()


def test_quality_reads_long_texts_in_pieces(monkeypatch):
    text = "word é漢 " * 400
    numbers = np.random.default_rng(3).normal(size=1 << quality.BITS).astype(np.float32)
    whole = quality.Scorer(numbers, 0.0).score(text)
    monkeypatch.setattr(quality, "CHUNK", 50)
    parts = list(quality.pieces(text))
    assert "".join(parts) == text and max(map(len, parts)) <= 50
    assert abs(quality.Scorer(numbers, 0.0).score(text) - whole) < 0.02  # blanks at the cuts are seen twice


@pytest.mark.parametrize("module", [toxicity, quality])
def test_classifiers_with_clashing_columns(spark, module):
    docs, labels = labelled(spark, 40)
    clash = docs.withColumns({"score": F.lit("s"), "held_out": F.lit("h"), "y": F.lit(1), "predicted": F.lit("p")})
    fold = held_out("doc_id", 5, 0)
    assert sorted(map(tuple, module.predictions(clash, labels, fold, "label").collect()), key=str) == sorted(map(tuple, module.predictions(docs, labels, fold, "label").collect()), key=str)
    model = module.train(docs, labels, ~fold, "label")
    assert module.score(clash, model).columns == [*clash.columns, "score_"]
    assert module.predictions(docs.limit(0), labels, fold, "label").count() == 0
    assert {r.score for r in module.predictions(docs, labels.limit(0), fold, "label").collect()} == {0.5}


def test_sample_is_bounded_in_rows_and_characters(spark):
    from quiltgraph.llm.sampling import labelled_sample

    docs, labels = labelled(spark, 60)
    sample, shares = labelled_sample(docs, labels, "label", F.lit(True), 5, longest=150)
    got = sample.collect()
    assert shares == (30, 30) and len(got) <= 10 and all(len(r.text) <= 150 for r in got)


def labelled(spark, n=160):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7)))
    docs, labels = [], []
    for i in range(n):
        words = [word() for _ in range(rng.randrange(20, 60))]
        if i % 2:
            words.insert(rng.randrange(len(words)), "zqxjk vile")
        docs.append((i, " ".join(words)))
        labels.append((i, i % 2))
    docs += [(1000, None), (1001, ""), (1002, "a" * 30), (1000, None), (None, "x y z")]
    return spark.createDataFrame(docs, DOCS), spark.createDataFrame([*labels, (3, None), (None, 1), (5, 7)], "doc_id long, label int")


@pytest.mark.parametrize("module", [toxicity, quality])
def test_classifiers(spark, module):
    docs, labels = labelled(spark)
    fold = held_out("doc_id", 5, 0)
    got = module.predictions(docs, labels, fold, "label", 0.5).collect()
    assert len(got) == 165 and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 1000]
    assert sum(r.predicted == r.doc_id % 2 for r in held) >= 0.85 * len(held)
    none = module.predictions(docs, labels.where("label = 1"), fold, "label", 0.5).collect()
    assert {round(r.score, 3) for r in none} == {1.0}
    assert {r.score for r in module.predictions(docs, labels.limit(0), fold, "label", 0.5).collect()} == {0.5}
    assert module.predictions(docs.limit(0), labels, fold, "label", 0.5).count() == 0


def test_toxicity_chunks_agree(monkeypatch):
    text = "idiot " * 50 + "kind words " * 60
    weights = np.random.default_rng(0).normal(size=1 << toxicity.BITS).astype(np.float32)
    whole = toxicity.Scorer(weights, 0.0).score(text)
    monkeypatch.setattr(toxicity, "CHUNK", 100)
    assert toxicity.Scorer(weights, 0.0).score(text) == pytest.approx(whole, abs=1e-4)


def test_held_out(spark):
    import zlib

    rows = spark.range(200).select("id", held_out("id", 4, 2).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in rows)


# 4. Decontamination.
def test_decontamination(spark, monkeypatch):
    rng = random.Random(2)
    text = lambda n: " ".join(rng.choice(["the", "a", "Éa", "x1", "rare", "of"]) for _ in range(n))
    bench = [(i, text(rng.randrange(1, 12))) for i in range(15)] + [(3, "the the"), (None, "a"), (99, None), (98, " ,. ")]
    docs = [(i, text(rng.randrange(0, 60))) for i in range(60)] + [(70, None), (71, ""), (72, bench[0][1] + "," + bench[1][1]), (72, "A THE")]
    df = spark.createDataFrame(docs, DOCS).withColumn("n_words", F.lit("clash"))
    items = spark.createDataFrame(bench, "item_id long, text string")
    reference = sorted(decontaminate.brute_force(docs, bench, 4))
    assert sorted(map(tuple, decontaminate.contamination(df, items, 4).collect())) == reference
    monkeypatch.setattr(decontaminate, "SEGMENT_BYTES", 100)  # several segments, and texts longer than one
    assert sorted(map(tuple, decontaminate.contamination(df, items, 4).collect())) == reference
    assert not any(r.n_hit for r in decontaminate.contamination(df, items.limit(0)).collect())
    assert decontaminate.contamination(df.limit(0), items).count() == 0


def test_one_index_answers_several_benchmarks(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"w{i % 7} and so on {i}, the end of it") for i in range(50)] + [(60, "x " * 300 + "w1 and so on 1")], DOCS)
    path = str(tmp_path / "index")
    decontaminate.build_index(docs, path)
    stored = spark.read.parquet(path)
    assert stored.where("term = cast('and' as binary)").agg(F.sum("n")).head()[0] == 51
    for text, expected in (("W3 AND so on", 7), ("w1 and so on 1", 2), ("of it the end", 0)):
        bench = spark.createDataFrame([("q", text)], "item_id string, text string")
        found = decontaminate.hits(spark, path, bench).collect()
        assert len(found) == expected and all(r.hit_spans[0].end - r.hit_spans[0].start == len(text.split()) for r in found)


def test_packed_numbers():
    values = np.array([0, 1, 127, 128, 16383, 16384, 2097151, 2097152, (1 << 28) - 1, 1 << 28, (1 << 31) - 1])
    data, size = decontaminate.packed(values)
    assert decontaminate.unpacked(data).tolist() == values.tolist() and size.tolist() == [1, 1, 1, 2, 2, 3, 3, 4, 4, 5, 5]
    assert len(decontaminate.unpacked(decontaminate.packed(values[:0])[0])) == 0


def test_anchors_in_chunks(monkeypatch):
    rng = random.Random(6)
    texts = [(" ".join(rng.choice("abcd") for _ in range(40)), i, i) for i in range(5)]
    terms, counts, data, ends, about = decontaminate.segment_rows(texts)
    lists = [data[a:b].tobytes() for a, b in zip([0, *ends], ends)]
    p = decontaminate.Postings(about, np.arange(len(terms)), counts, lists)
    asked = np.array([[terms.index(b"a"), terms.index(b"b")], [terms.index(b"c"), terms.index(b"c")]])
    whole = [sorted(zip(*(x.tolist() for x in p.phrases(asked, np.array([[0, 1], [0, 1]])))))]
    monkeypatch.setattr(decontaminate, "CANDIDATES", 3)
    assert [sorted(zip(*(x.tolist() for x in p.phrases(asked, np.array([[0, 1], [0, 1]])))))] == whole
    plain = [(k, s) for k, (x, y) in enumerate((("a", "b"), ("c", "c"))) for d, (t, _, _) in enumerate(texts) for s, (u, v) in enumerate(zip(t.split(), t.split()[1:]), 41 * d) if (u, v) == (x, y)]
    assert whole == [sorted(plain)]


def test_proximity(spark):
    df = spark.createDataFrame([(1, "a b c d"), (2, None), (3, "b x c a"), (4, "a x x x x x b")], DOCS)
    items = spark.createDataFrame([(1, "a b"), (2, "c a")], "item_id long, text string")
    got = {r.doc_id: r.near_items for r in decontaminate.proximity_matches(df, items, 1).collect()}
    assert got == {1: ["1", "2"], 2: [], 3: ["2"], 4: []}


# 5. WARC.
def test_warc(spark, tmp_path):
    rows = [(5, "u5", "same"), (3, "u3", "same"), (9, None, "same"), (7, "u\n7", None), (8, "u8", ""), (1, "u1", "é" * 1000), (None, "n", "same"), (None, "m", "alone"), (3, "u3", "same")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1))
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.page_records(df).collect()), key=str)
    sha = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    first = {"same": 3, "": 7, "é" * 1000: 1, "alone": None}
    expected = []
    for page, _, html in rows:
        least = first[html or ""]
        response = page == least
        expected.append((page, len((html or "").encode()), sha(html), "response" if response else "revisit", None if response else least))
    assert got == sorted(expected, key=str)
    path = warc.write_archive(df, str(tmp_path / "w"), least_bytes=100)
    archive = warc.record_bytes(warc.read_archive(spark, path))
    assert all(r.record_type == "response" and r.verified for r in archive.collect())
    assert spark.read.parquet(f"{path}/payloads").count() == 4
    for r in archive.collect():
        head, body = bytes(r.record).split(b"\r\n\r\n", 1)
        assert head.startswith(b"WARC/1.1\r\n") and body == bytes(r.payload) + b"\r\n\r\n" and bytes(r.header) == head + b"\r\n\r\n"
    assert warc.page_records(df.limit(0)).count() == 0


# 6. Licenses.
def test_license_recall_at_any_offset(spark):
    """Templates whole, cut to more than 0.8 and moved by any number of words: all are found, and nothing that lacks 0.8."""
    rng = random.Random(31)
    docs = []
    for i, (name, template) in enumerate(sorted(licenses.TEMPLATES.items())):
        w = template.split()
        for k in range(12):
            keep = w if k % 2 else w[: max(licenses.WORDS, -(-len(w) * 19 // 20))]
            before, after = ([rng.choice(["oak", "elm", "ash"]) for _ in range(rng.randrange(0, 90))] for _ in range(2))
            docs.append((100 * i + k, " ".join([*before, *keep, *after])))
    docs += [(9000 + i, " ".join(t.split()[: len(t.split()) // 2])) for i, t in enumerate(licenses.TEMPLATES.values())]
    got = {(r.doc_id, r.license): r.containment for r in licenses.scan(spark.createDataFrame(docs, DOCS)).collect()}
    assert licenses.brute_force(docs) <= set(got)
    grams = lambda t: {tuple(w[i : i + licenses.WORDS]) for w in [re.findall("[a-z0-9]+", t.lower())] for i in range(len(w) - licenses.WORDS + 1)}
    text = dict(docs)
    assert all(0.8 <= c <= len(grams(licenses.TEMPLATES[name]) & grams(text[d])) / len(grams(licenses.TEMPLATES[name])) + 1e-9 for (d, name), c in got.items())


def test_license_of_a_very_long_text_and_ties(spark):
    notice = licenses.TEMPLATES["CC-BY-4.0-notice"]
    docs = [(1, "oak " * 30_000 + notice + " elm" * 30_000 + " " + notice)]
    got = licenses.scan(spark.createDataFrame(docs, DOCS)).collect()
    assert [(r.license, r.containment, r.first_word) for r in got] == [("CC-BY-4.0-notice", 1.0, 30_000)]  # of equal windows the first


def test_licenses(spark):
    grant = licenses.TEMPLATES["MIT-grant"]
    cut = " ".join(grant.split()[:-6])
    docs = [(1, "x y z. Released under the MIT License. more"), (2, None), (3, ""), (4, "Released under MIT"), (5, "filler " * 500 + cut + " filler" * 90), (6, " ".join(grant.split()[:20])), (7, licenses.TEMPLATES["BSD-grant"].upper() + " " + grant), (7, "nothing"), (None, "Licensed under CC BY-NC 4.0.")]
    df = spark.createDataFrame(docs, DOCS).withColumn("license", F.lit("clash"))
    got = licenses.scan(df)
    assert {(r.doc_id, r.license) for r in got.collect()} == licenses.brute_force(docs)
    one = got.where("doc_id = 1").head()
    assert (one.containment, one.first_word, one.last_word) == (1.0, 3, 7)
    assert licenses.scan(df.limit(0)).count() == 0


# 7. Chat.
def test_chat(spark):
    call = '{"content":"ok","tool_calls":[{"id":"b","name":"search","arguments":{"z":1,"query":{"$ref":"a"}}},{"id":"a","name":"search","arguments":{"query":"q","limit":3}},{"id":"c","name":"other","arguments":{"$ref":"d"}},{"id":"d","name":"other","arguments":{"k":{"$ref":"c"}}}]}'
    rows = [(1, 0, "user", 'hi "x"\n'), (1, 1, "assistant", call), (1, 2, "tool", '{"tool_call_id":"a","content":"r"}'), (2, 0, None, None), (2, 1, "tool", '{"tool_call_id":"zz"}'), (None, None, "assistant", "{bad"), (1, 0, "user", 'hi "x"\n')]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("calls", F.lit(1))
    schemas = {"search": {"query": ("string", True), "limit": ("integer", False)}}
    got = chat.format_messages(df, schemas).collect()
    by = {(r.conv_id, r.turn): r for r in got}
    assert len(got) == 7 and by[1, 0].message == '{"content":"hi \\"x\\"\\n","role":"user"}'
    made = by[1, 1]
    assert (made.n_calls, made.n_linked, made.n_invalid) == (4, 1, 1)
    assert made.message.index('"id":"a"') < made.message.index('"id":"b"')  # b uses a's result
    assert by[1, 2].message == '{"content":"r","role":"tool","tool_call_id":"a"}' and by[1, 2].n_linked == 1
    assert by[2, 1].n_linked == 0 and by[2, 0].message == "{}" and by[None, None].message == '{"content":"{bad","role":"assistant"}'
    level = {r.id: r.level for r in chat.linked_calls(df.select("conv_id", "turn", "role", "text"), schemas).collect()}
    assert level == {"a": 0, "b": 1, "c": None, "d": None}
    chats = {r.conv_id: r.chat for r in chat.conversation_json(chat.format_messages(df.where("conv_id = 2"))).collect()}
    assert chats == {2: '[{},{"role":"tool","tool_call_id":"zz"}]'}
    assert chat.format_messages(df.limit(0)).count() == 0


# 8. Repeats.
def repeated_texts():
    rng = random.Random(4)
    noise = lambda n: "".join(rng.choice("abcdefghij klmno") for _ in range(n))
    shared = noise(60)
    docs = [(i, noise(rng.randrange(0, 90)) + (shared[rng.randrange(0, 20) :] if i % 3 == 0 else "") + noise(20)) for i in range(40)]
    docs += [(100, "ab" * 40), (101, "é" * 35), (102, None), (103, ""), (104, docs[0][1]), (104, docs[0][1]), (None, docs[3][1]), (105, "short")]
    return docs


@pytest.mark.parametrize(("indexed", "gram"), [(1 << 20, 64), (300, 8), (0, 4)])
def test_repeats(spark, monkeypatch, indexed, gram):
    """With small indexes, minimizers of many contents are dealt again by longer strings, up to whole windows."""
    monkeypatch.setattr(repeats, "INDEXED", indexed)
    monkeypatch.setattr(repeats, "GRAM", gram)
    docs = repeated_texts()
    got = repeats.repeat_digests(spark.createDataFrame(docs, DOCS).withColumn("rid", F.lit(1)), 24)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(repeats.brute_force(docs, 24), key=str)


def test_repeats_of_one_minimizer_in_many_contents(spark, monkeypatch):
    """One line in many texts with other words around it, some of them twice: more than an index takes."""
    rng = random.Random(17)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 7)))
    line = " ".join(word() for _ in range(14))
    sides = [" ".join(word() for _ in range(30)) for _ in range(25)]
    docs = [(i, f"{rng.choice(sides)} {line} {rng.choice(sides)}") for i in range(120)] + [(500, None), (501, line)]
    monkeypatch.setattr(repeats, "INDEXED", 2000)
    got = repeats.repeat_digests(spark.createDataFrame(docs, DOCS), 200)
    assert sorted(map(tuple, got.collect())) == sorted(repeats.brute_force(docs, 200))


def test_repeats_at_the_edges_of_chunks(spark, monkeypatch):
    monkeypatch.setattr(repeats, "CHUNK", 64)
    docs = repeated_texts()
    got = []
    for _, text in docs:  # the workers read the module's own CHUNK, so this part runs here
        data = np.frombuffer((text or "").encode(), np.uint8)
        got.append(sum(int(n.sum()) for a in range(0, len(data) - 23, 64) for n in [repeats.segments(data[a : a + 64 + 23], 24)[3]]))
    assert got == [max(0, len((t or "").encode()) - 23) for _, t in docs]


def test_repeats_empty_and_text(spark):
    docs = spark.createDataFrame(repeated_texts(), DOCS).withColumn("rid", F.lit("kept"))
    assert repeats.repeat_digests(docs.limit(0), 24).count() == 0
    left = repeats.remove_repeats(docs, 24)
    assert left.columns == docs.columns and left.count() == docs.count()
    assert {r.text for r in left.where("doc_id = 104").collect()} == {""}


def test_matching_statistics():
    rng = random.Random(9)
    contents = ["".join(rng.choice("ab") for _ in range(rng.randrange(1, 40))).encode() for _ in range(12)]
    index = repeats.RunLengthIndex(contents)
    got = index.matching_statistics()
    assert int(index.lengths.sum()) == index.n and len(index.lengths) <= index.n
    for k, c in enumerate(contents):
        for i in range(len(c)):
            longest = 0
            for j, d in enumerate(contents):
                for s in range(len(d)):
                    if (j, s) != (k, i):
                        n = 0
                        while i + n < len(c) and s + n < len(d) and c[i + n] == d[s + n]:
                            n += 1
                        longest = max(longest, n)
            assert got[index.starts[k] + i] == longest


# 10. Jaccard join.
@pytest.mark.parametrize("block", [256, 3])
def test_jaccard(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rng = random.Random(6)
    base = [[f"w{rng.randrange(400)}" for _ in range(rng.randrange(3, 50))] for _ in range(14)]
    docs = []
    for i in range(110):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(0, 3)):
            w[rng.randrange(len(w))] = f"v{rng.randrange(9)}"
        docs.append((i * 7 % 113, " ".join(w).upper() if i % 5 == 0 else "\t".join(w)))
    docs += [(200, None), (201, ""), (202, " \n "), (203, "one two"), (204, "ONE two"), (205, "x"), (206, "la la la la la la la"), (206, "la la la la la la la")]
    df = spark.createDataFrame(docs, DOCS).withColumn("node", F.lit("clash"))
    for width, percent in ((4, 85), (2, 60)):
        assert sorted(map(tuple, jaccard.link(df, width, percent).collect())) == sorted(jaccard.brute_force(docs, width, percent))
    assert jaccard.link(df.limit(0), 4, 85).count() == 0
    assert [tuple(r) for r in jaccard.link(spark.createDataFrame([(None, "a b c d e")], DOCS), 4, 85).collect()] == [(None, 2, None)]


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (103, 101), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(31)} | {100: 100, 101: 100, 103: 100}


def test_toxicity_reads_wide_characters_to_the_end():
    weights = np.zeros(1 << toxicity.BITS, np.float32)
    weights[toxicity.features("zqxjk")] = 1.0
    long_ = "é" * (toxicity.CHUNK * 3 // 4) + " zqxjk"
    assert toxicity.Scorer(weights, 0.0).score(long_) > 0.9


def test_toxicity_counts_words_on_long_accented_stems():
    rng = random.Random(12)
    parts = ["ré", "eux", "ment", "é", "tre", "ou", "elle", "ê", "ch", "ai"]
    word = lambda: "".join(rng.choice(parts) for _ in range(rng.randrange(2, 5)))

    def text(toxic):
        words = [word() for _ in range(rng.randrange(80, 400))]
        for _ in range(max(4, len(words) // 25) if toxic else rng.randrange(2)):
            words.insert(rng.randrange(len(words)), "réeux" + word())
        return " ".join(words)

    y = np.array([i % 4 == 0 for i in range(600)], float)
    texts = [text(t) for t in y]
    weights, bias = toxicity.fit(texts[:400], y[:400])
    got = np.array([toxicity.Scorer(weights, bias).score(t) >= 0.5 for t in texts[400:]])
    assert got[y[400:] == 1].mean() >= 0.9 and got[y[400:] == 0].mean() <= 0.05


def test_toxicity_counts_each_ngram_once_in_pieces(monkeypatch):
    text = "Ärger réeux 🎉 kind words " * 40
    weights = np.random.default_rng(3).normal(size=1 << toxicity.BITS).astype(np.float32) / toxicity.UNIT
    ids, times = toxicity.counted(text)
    whole = toxicity.Scorer(weights, 0.0).score(text)
    assert 0.01 < whole < 0.99 and times.sum() == sum(len(text) + 3 - n for n in toxicity.ORDERS)
    monkeypatch.setattr(toxicity, "CHUNK", 9)
    assert toxicity.Scorer(weights, 0.0).score(text) == pytest.approx(whole, abs=1e-6)
    assert all((a == b).all() for a, b in zip(toxicity.counted(text), (ids, times)))


def test_chat_links_by_message(spark):
    call = lambda *ids: '{"tool_calls":[' + ",".join(f'{{"id":"{i}","name":"n"}}' for i in ids) + "]}"
    result = lambda i: f'{{"tool_call_id":"{i}","content":"r{i}"}}'
    rows = [(1, 0, "assistant", call("a", "b")), (1, 0, "assistant", call("c")), (1, 1, "tool", result("a")), (1, 1, "tool", result("c")), (1, None, "assistant", call("d")), (1, None, "tool", result("d")), (None, 0, "assistant", call("e")), (None, None, "tool", result("e")), (1, 0, "assistant", call("c"))]
    got = chat.format_messages(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    text = lambda *ids: '{"role":"assistant","tool_calls":[' + ",".join(f'{{"id":"{i}","name":"n"}}' for i in ids) + "]}"
    answer = lambda i: f'{{"content":"r{i}","role":"tool","tool_call_id":"{i}"}}'
    expected = [(1, 0, text("a", "b"), 2, 1), (1, 0, text("c"), 1, 1), (1, 0, text("c"), 1, 1), (1, 1, answer("a"), 0, 1), (1, 1, answer("c"), 0, 1), (1, None, text("d"), 1, 1), (1, None, answer("d"), 0, 1), (None, 0, text("e"), 1, 0), (None, None, answer("e"), 0, 0)]
    assert sorted(((r.conv_id, r.turn, r.message, r.n_calls, r.n_linked) for r in got), key=str) == sorted(expected, key=str)


def plain_messages(messages, schemas):
    """(conv_id, turn, role, message, n_calls, n_linked, n_invalid) of each message by plain loops."""
    dump = lambda x: json.dumps(x, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    kinds = {"string": str, "integer": int, "boolean": bool}

    def parsed(text):
        try:
            found = json.loads(text) if text and text.lstrip().startswith("{") else {}
        except ValueError:
            found = {}
        return found if isinstance(found, dict) else {}

    def invalid(call):
        given = call.get("arguments") or {}
        rules = schemas.get(call.get("name"))
        if rules is None:
            return False
        wrong = any(k not in rules or type(v) is not kinds[rules[k][0]] for k, v in given.items())
        return wrong or any(need and k not in given for k, (_, need) in rules.items())

    calls, answers = {}, {}
    for conv, _, role, text in messages:
        found = parsed(text)
        if role == "assistant" and isinstance(found.get("tool_calls"), list) and conv is not None:
            for call in found["tool_calls"]:
                if call.get("id") is not None:
                    refs = calls.setdefault((conv, call["id"]), set())
                    refs |= {v["$ref"] for v in (call.get("arguments") or {}).values() if isinstance(v, dict)}
        if role == "tool" and found.get("tool_call_id") is not None and conv is not None:
            answers[conv, found["tool_call_id"]] = True
    level = {}
    for _ in range(len(calls) + 1):
        for (conv, i), refs in calls.items():
            inside = [(conv, r) for r in refs if (conv, r) in calls]
            if all(x in level for x in inside):
                level[conv, i] = 1 + max((level[x] for x in inside), default=-1)
    out = []
    for conv, turn, role, text in messages:
        found, is_call = parsed(text), False
        row = {"content": text, "role": role}
        n = linked = wrong = 0
        if role == "assistant" and isinstance(found.get("tool_calls"), list):
            own = [{k: c.get(k) for k in ("arguments", "id", "name") if c.get(k) is not None} for c in found["tool_calls"]]
            is_call = bool(own)
            if own:
                n, linked, wrong = len(own), sum((conv, c.get("id")) in answers for c in own), sum(map(invalid, own))
                placed = sorted((level.get((conv, c.get("id")), 2147483647), k, c) for k, c in enumerate(own))
                row = {k: v for k, v in found.items() if v is not None} | {"role": role, "tool_calls": [c for _, _, c in placed]}
                row.pop("tool_call_id", None)
        if role == "tool" and found.get("tool_call_id") is not None:
            linked = int((conv, found["tool_call_id"]) in calls)
            row = {k: v for k, v in found.items() if v is not None and k != "tool_calls"} | {"role": role}
        assert is_call or n == 0
        out.append((conv, turn, role, dump({k: v for k, v in row.items() if v is not None}), n, linked, wrong))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_chat_equals_plain_loops(spark, seed):
    """Random conversations with calls, results, references, cycles, repeats, clashing turns, nulls and texts that only look like JSON."""
    rng = random.Random(seed)
    schemas = {"search": {"query": ("string", True), "limit": ("integer", False)}, "flag": {"on": ("boolean", True)}}
    ids = [f"c{i}" for i in range(6)]
    value = lambda: rng.choice(["w", 3, True, {"$ref": rng.choice(ids)}])

    def call():
        arguments = {k: value() for k in rng.sample(["query", "limit", "on", "zz"], rng.randrange(0, 3))}
        return {"id": rng.choice([*ids, None]), "name": rng.choice(["search", "flag", "other"]), "arguments": rng.choice([arguments, arguments, None])}

    def text(role):
        if role == "assistant":
            return json.dumps({"tool_calls": [call() for _ in range(rng.randrange(0, 4))], "content": rng.choice(["hi", None]), "extra": rng.choice([None, 7, {"b": 1, "a": [2]}])})
        if role == "tool":
            return json.dumps({"tool_call_id": rng.choice([*ids, "unknown"]), "content": "ok", "z": rng.choice([None, "more"])})
        return rng.choice(["plain", None, "", "{broken", '{"tool_calls": 3}'])

    messages = []
    for _ in range(60):
        role = rng.choice(["assistant", "assistant", "tool", "tool", "user", None])
        messages.append((rng.choice([1, 2, 3, None]), rng.choice([0, 1, 1, 2, None]), role, rng.choice([text(role), text(role), text("user")])))
    messages += messages[:5]
    got = chat.format_messages(spark.createDataFrame(messages, "conv_id long, turn long, role string, text string"), schemas)
    assert sorted(map(tuple, got.collect()), key=str) == plain_messages(messages, schemas)


def test_very_long_texts_and_payloads(spark):
    """Texts far above any buffer: near copies, a page of which most is one line, and a message."""
    rng = random.Random(23)
    long_ = " ".join("".join(rng.choice("abcdef") for _ in range(5)) for _ in range(60_000))
    docs = [(1, long_), (2, long_ + " one more word"), (3, long_[: len(long_) // 2]), (4, "short text of five words")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.link(spark.createDataFrame(docs, DOCS), 4, 85).collect()}
    assert {d: c for d, (_, c) in got.items()} == {1: 1, 2: 1, 3: 3, 4: 4} and got[4][0] == 2
    page = "line of a page\n" * 300_000
    pages = spark.createDataFrame([(1, "u", page), (2, "v", page + "x")], "page_id long, url string, html string")
    assert {(r.page_id, r.payload_bytes, r.record_type) for r in warc.page_records(pages).collect()} == {(1, len(page), "response"), (2, len(page) + 1, "response")}
    message = json.dumps({"tool_calls": [{"id": "a", "name": "n", "arguments": {"x": long_}}]})
    rows = chat.format_messages(spark.createDataFrame([(1, 0, "assistant", message), (1, 1, "user", long_)], "conv_id long, turn long, role string, text string")).collect()
    assert {r.turn: (r.n_calls, long_ in r.message) for r in rows} == {0: (1, True), 1: (0, True)}
