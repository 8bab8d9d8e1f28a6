"""Null and repeated ids, extra columns that clash with the operators' own names, and many or long benchmark items."""

from __future__ import annotations

import random
import resource
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from portrisk.llm import decontaminate, jaccard_join, line_dedup
from portrisk.llm.words import column_words

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
NAMES = ("score", "lang_pred", "_id", "_key", "id_", "key_", "removed", "kept", "node", "line", "text_key", "want_id", "_text", "row", "n_copies", "domain", "rate")


def sentence(seed: int, n: int = 12) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choices("abcdefghij", k=6)) for _ in range(n))


def docs(spark, rows, extra: bool = False):
    out = spark.createDataFrame([(i, t, "en", "a", len(t or "")) for i, t in rows], DOCS)
    for name in NAMES if extra else ():
        out = out.withColumn(name, F.lit("x"))
    return out


def changed(text: str, at: int = 3) -> str:
    words = text.split(" ")
    words[at] = "other"
    return " ".join(words)


@pytest.mark.parametrize("extra", [False, True])
def test_lines_of_null_and_repeated_ids(spark, extra):
    a, b, c = sentence(1), sentence(2), sentence(3)
    rows = [(None, a), (1, changed(a)), (2, b), (3, changed(b) + "\n" + c), (3, c), (4, None), (4, c)]
    got = sorted(((r.doc_id, r.text) for r in line_dedup.dedup_lines(docs(spark, rows, extra)).collect()), key=repr)
    # Of the equal lines of id 3 at different places the first one stays.
    want = sorted([(None, a), (1, ""), (2, b), (3, ""), (3, c), (4, None), (4, "")], key=repr)
    assert got == want


@pytest.mark.parametrize("extra", [False, True])
def test_one_row_of_each_class_is_kept(spark, extra):
    a, b = sentence(4, 60), sentence(5, 60)
    rows = [(3, a), (3, a), (4, a), (5, changed(a, 30)), (None, b), (None, b), (6, sentence(7, 60)), (7, "")]
    got = jaccard_join.near_duplicates(docs(spark, rows, extra)).collect()
    assert sorted((r.doc_id, r.n_copies) for r in got if r.kept and r.doc_id is not None) == [(3, 3), (6, 1), (7, 1)]
    assert sum(r.kept for r in got if r.doc_id is None) == 1
    left = corpus_pipeline.near_duplicate_stage(spark, docs(spark, rows, extra), SF)
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=repr) == sorted([(3, a), (None, b), (6, sentence(7, 60)), (7, "")], key=repr)


def test_stages_keep_extra_columns(spark):
    rows = corpus_pipeline.table(spark, SF, "documents")
    for name in NAMES:
        rows = rows.withColumn(name, F.lit("x"))
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, rows, SF)
        assert out.columns == rows.columns, name
        assert out.count() > 100


def test_pipeline_against_known_cases(spark, tmp_path):
    """What each stage removes, and what it must keep, on rows of known cases beside the given ones."""
    given = corpus_pipeline.table(spark, SF, "documents").where("length(text) > 300").orderBy("doc_id").limit(60).collect()
    item = corpus_pipeline.table(spark, SF, "benchmark").orderBy("item_id").first().text
    tail = [r.text for r in given if r.lang == "en"]
    rows = [(100_000, "12 34 !?"), (100_001, tail[0]), (100_002, changed(tail[1], 5)), (100_003, tail[2][:200] + " " + item + " " + tail[3][:200])]
    start = corpus_pipeline.table(spark, SF, "documents").where("length(text) > 300").orderBy("doc_id").limit(60).select(*DOCS.replace(" long", "").replace(" string", "").split(", "))
    frame = start.union(docs(spark, rows))
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    assert ids(frame) - ids(corpus_pipeline.language_stage(spark, frame, SF)) == {100_000}
    assert 100_001 in ids(frame) and 100_001 not in ids(corpus_pipeline.near_duplicate_stage(spark, frame, SF))
    leaks = ids(frame) - ids(corpus_pipeline.leak_stage(spark, frame, SF))
    found = {r.doc_id for r in decontaminate.find_leaks(frame, corpus_pipeline.table(spark, SF, "benchmark")).collect()}
    assert 100_003 in leaks and leaks == found


def test_run_returns_documents_with_rates(spark):
    got = corpus_pipeline.run(spark, SF).collect()
    before = {r.doc_id for r in corpus_pipeline.table(spark, SF, "documents").collect()}
    assert got and {r.doc_id for r in got} <= before and len({r.doc_id for r in got}) == len(got) and all(r.n_copies > 0 for r in got)


def planted(n_items: int, size: int = 30):
    r = np.random.default_rng(1)
    items = r.integers(1, 1 << 62, (n_items, size)).astype(np.uint64)
    windows = items[r.integers(0, min(200, n_items), 200)].copy()
    windows[:, 7] = 5
    return decontaminate.ItemIndex(list(items)), windows.ravel()


def search(index, words):
    double = decontaminate.pairs(words)
    hit = np.flatnonzero(decontaminate.member(index.pairs, double))
    sizes = np.zeros(len(double), dtype=np.uint64)
    sizes[hit] = index.sizes[np.searchsorted(index.pairs, double[hit])]
    single = np.concatenate([[0], np.cumsum(decontaminate.member(index.single, words))])
    return index.search(words, np.array([0, len(words)]), single, sizes)


def test_more_items_cost_no_more_per_window():
    took = []
    for n in (200, 8000):
        index, words = planted(n)
        search(index, words)
        start = time.process_time()
        found = search(index, words)
        took.append(time.process_time() - start)
        assert all(d <= index.edits(30) for d, _, _ in found.values()) and len({i for _, i in found}) >= 100
    assert took[1] < 4 * took[0] + 0.2


def test_a_very_long_item_in_bounded_memory():
    words = np.random.default_rng(2).integers(1, 1 << 62, 4000).astype(np.uint64)
    index = decontaminate.ItemIndex([words])
    text = np.concatenate([words[:10], words, words[:10]])
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    assert search(index, text)[0, 0][0] == 0
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 300_000  # kB


def test_word_hashes_of_no_rows():
    hashes, edge = column_words(pa.array([], pa.string()))
    assert len(hashes) == 0 and edge.tolist() in ([], [0])
