"""The pipeline's stages on planted cases, against what each operator gives by brute force."""

from __future__ import annotations

import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from quiltgraph.llm import bpe, decontaminate, jaccard, queries, repeats

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(rng.randrange(3, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, item, long_item = text(70), text(30), text(55)
    docs = [(i, text(120)) for i in range(60)]
    docs += [(100 + i, text(60) + " zqxjk vile " + text(60)) for i in range(60)]
    docs += [(300, docs[3][1]), (301, docs[4][1] + " extra"), (302, text(50) + " " + passage), (303, text(50) + " " + passage), (304, text(20) + " " + item), (305, None), (306, ""), (None, text(90))]
    docs += [(310 + i, text(40) + " " + long_item + " " + text(20)) for i in range(3)]  # a benchmark passage that recurs
    out = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], COLUMNS).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i >= 100)) for i, _ in docs[:115]], "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame([(1, item), (2, long_item)], "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return out, long_item


def test_stages(spark, folder, tmp_path):
    folder, long_item = folder
    read = lambda name: spark.read.parquet(f"{folder}/{name}.parquet")
    docs, seen = read("documents"), []
    for k, (name, stage) in enumerate(pipeline.STAGES):
        before = [(r.doc_id, r.text) for r in docs.collect()]
        stage(spark, docs, folder).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        after = docs.collect()
        ids = {r.doc_id for r in after}
        if name == "toxicity":
            assert len(ids & set(range(100, 160))) <= 2 and len(ids & set(range(60))) >= 58
        elif name == "ngram_jaccard_join":
            known = [x for x in before if x[0] is not None]
            assert ids - {None} == {d for d, _, c in jaccard.brute_force(known, 5, 80) if d == c}
        elif name == "suffix_array_dedup":
            expected = {d: n for d, _, n, _, _ in repeats.brute_force(before, 200)}
            assert all(expected[310 + i] > 200 for i in range(3))
            left = {r.doc_id: r.text or "" for r in after}
            assert all(f" {long_item} " in left[310 + i] for i in range(3))  # for the next stage to decide by
            assert all(len(dict(before)[i] or "") - len(t) == expected[i] for i, t in left.items() if i not in (310, 311, 312))
            assert expected[302] and expected[303] and next(r for r in after if r.doc_id == 302).n_chars < 600
        elif name == "benchmark_decontamination":
            items = [(r.item_id, r.text) for r in read("benchmark").collect()]
            assert ids == {r[0] for r in decontaminate.brute_force(before, items) if not r[5]} and not ids & {304, 310, 311, 312}
        if name != "byte_level_bpe":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        seen.append(name)
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        v = bpe.Vocabulary(f.read())
    assert seen == [n for n, _ in pipeline.STAGES] and all(r.round_trip for r in after)
    assert {r.doc_id: bytes(r.ids) for r in after} == {d: v.encode_all([t or ""])[0] for d, t in before}


def test_run(spark):
    assert pipeline.run(spark, "/root/testdata/sf0.001").where("not round_trip").count() == 0


def test_every_operator_is_registered():
    assert [int(n[2:].split("_")[0]) for n in queries.queries()] == list(range(1, 11))
    assert set(queries.oracle_sql()) <= set(queries.queries())


def test_one_row_of_each_group_stays(spark):
    rng = random.Random(21)
    text = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(60))
    a, b, c, d = text(), text(), text(), text()
    docs = [(1, a), (1, b), (1, b + " more"), (2, a), (0, b + " less"), (3, c), (None, c), (None, d), (None, d + " end"), (5, ""), (5, ""), (None, ""), (None, ""), (6, None)]
    rows = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in docs], COLUMNS)
    got = sorted(((r.doc_id, r.text) for r in pipeline.drop_near_duplicates(spark, rows, "").collect()), key=str)
    unknown = [t for i, t in got if i is None and t]
    assert len(unknown) == 1 and unknown[0].startswith(d)
    assert [x for x in got if x[0] is not None] == sorted([(0, b + " less"), (1, a), (3, c), (5, ""), (6, None)], key=str)
    assert got.count((None, "")) == 2


def test_odd_tables(spark, folder):
    """Empty tables, and columns whose names the stages use themselves."""
    folder, _ = folder
    read = lambda name: spark.read.parquet(f"{folder}/{name}.parquet")
    names = ["row_", "n_", "own_", "toxic_score", "text_before", "rid", "n_words", "hit_spans", "items", "kept_id", "text_left", "spans"]
    docs = read("documents")
    for name in names:
        docs = docs.withColumn(name, F.col("doc_id"))
    for k, (_, stage) in enumerate(pipeline.STAGES[:4]):
        got = stage(spark, docs, folder)
        rows = got.collect()
        assert got.columns == docs.columns and rows
        assert all(r[name] == r.doc_id for r in rows for name in names)
        assert stage(spark, read("documents").limit(0), folder).count() == 0
    assert pipeline.STAGES[4][1](spark, docs.limit(0), folder).count() == 0


def test_without_labels_nothing_is_toxic(spark, folder, tmp_path):
    folder, _ = folder
    spark.read.parquet(f"{folder}/labels.parquet").where("toxic = 0").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert pipeline.drop_toxic(spark, docs, str(tmp_path)).count() == docs.count()


def test_spared_bytes():
    assert repeats.without([(0, 10), (20, 30)], [(2, 4), (3, 5), (25, 40)]) == [(0, 2), (5, 10), (20, 25)]
    assert repeats.without([(5, 8)], [(0, 20)]) == [] and repeats.without([(5, 8)], []) == [(5, 8)]
    assert decontaminate.byte_spans("É, bc d", [{"start": 0, "end": 1}, {"start": 1, "end": 3}]) == [(0, 2), (4, 8)]


def test_recurring_benchmark_passages_go(spark, tmp_path):
    """They stay only in documents that the next stage drops for them; a passage that occurs once is no repeat."""
    rng = random.Random(34)
    text = lambda n: " ".join("".join(rng.choice("abcdefghijklm") for _ in range(rng.randrange(3, 8))) for _ in range(n))
    twice, once = text(60), text(60)
    small = [(i, f"{text(900)} {twice} {text(600)}") for i in range(2)]  # 60 words of 1560: under a 20th
    large = [(10 + i, f"{text(40)} {twice} {text(20)}") for i in range(2)]
    docs = [*small, *large, (20, f"{text(900)} {once} {text(600)}")]
    spark.createDataFrame([(1, twice), (2, once)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in docs], COLUMNS)
    pipeline.drop_repeats(spark, rows, str(tmp_path)).write.parquet(f"{tmp_path}/left")
    rows = spark.read.parquet(f"{tmp_path}/left")
    left = {r.doc_id: r.text for r in rows.collect()}
    expected = {d: n for d, _, n, _, _ in repeats.brute_force(docs, 200)}
    assert all(twice not in left[i] and len(t) - len(left[i]) == expected[i] > 200 for i, t in small)
    assert all(f" {twice} " in left[i] for i, _ in large) and left[20] == dict(docs)[20]
    assert {r.doc_id for r in pipeline.drop_contaminated(spark, rows, str(tmp_path)).collect()} == {0, 1, 20}
