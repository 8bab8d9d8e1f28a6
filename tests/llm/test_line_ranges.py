"""Postings of lines in ranges of words, the search in a range, and what leaves a task when candidates are read again."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from portrisk.llm import line_dedup

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def line_sets(spark, rows):
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS).repartition(3)
    counts = spark.sparkContext.broadcast(line_dedup.word_counts(docs))
    return docs, line_dedup._line_sets(docs, counts, 0.8).withColumn("first", F.struct("doc_id", "line"))


def test_ranges_hold_every_posting_once(spark):
    r = random.Random(3)
    rows = [(i if i % 9 else None, "\n".join(" ".join(f"w{r.randint(0, 900)}" for _ in range(r.randint(1, 60))) for _ in range(4))) for i in range(600)]
    sets = line_sets(spark, rows)[1].cache()
    want = [(x.word, x.doc_id, x.line, x.n_at, x.p0, x.p1) for x in line_dedup._postings(sets).collect()]
    hot = np.array(sorted({x[0] for x in want})[:5], dtype=np.int32)
    got, sent = [], 0
    for x in line_dedup._by_range(sets, 16, hot).collect():
        sent += len(x.posts)
        part = pa.ipc.open_stream(x.posts).read_all()
        assert {(w & 0xFFFFFFFF) * 16 >> 32 for w in part["word"].to_pylist()} == {x.range}
        got += zip(*(part[c].to_pylist() for c in ("word", "doc_id", "line", "n_at", "p0", "p1")), strict=True)
    assert sorted(map(repr, got)) == sorted(repr(x) for x in want if x[0] not in hot)
    # A posting was a row of 64 bytes, of which 43 were left by the shuffle's compression.
    assert sent < 40 * len(got)


@pytest.mark.parametrize("similar", [0.8, 0.5])
def test_an_earlier_posting_is_found_where_one_passes(similar):
    r = np.random.default_rng(2)
    for trial in range(60):
        m = int(r.integers(1, 200))
        group, n = np.sort(r.integers(0, 8, m)), r.integers(1, 40, m)
        at = (r.random(m) * np.maximum(1, n * (1 - similar))).astype(np.int64)
        p0, p1, seek = r.integers(0, 64, m) * (trial % 2), r.integers(0, 2, m), r.random(m) < 0.9
        part = pa.table({"n_at": (n.astype(np.int64) << 32) + at, "p0": p0.astype(np.int64), "p1": p1.astype(np.int64)})

        def passes(a, b):
            need = int(np.ceil((n[a] + n[b]) * similar / (1 + similar) - 1e-9))  # noqa: B023
            differ = int(p0[a] ^ p0[b]).bit_count() + int(p1[a] ^ p1[b]).bit_count()  # noqa: B023
            return min(n[a], n[b]) >= similar * max(n[a], n[b]) - 1e-9 and min(n[a] - at[a], n[b] - at[b]) >= need and differ <= n[a] + n[b] - 2 * need  # noqa: B023

        want = {b: max(a) for b in range(m) if seek[b] and (a := [a for a in range(b) if group[a] == group[b] and passes(a, b)])}
        x, y = line_dedup._earlier(part, group, seek, similar)
        assert len(y) == len(want) and dict(zip(y.to_pylist(), x.to_pylist(), strict=True)) == want


def test_only_lines_of_candidates_leave_their_task(spark):
    """Of a document of 50 lines the one that is asked for is sent, in one exchange that serves both sides of the pairs."""
    r = random.Random(4)
    line = lambda: " ".join(f"v{r.randint(0, 10**6)}" for _ in range(12))
    same = line()
    rows = [(i, "\n".join([same + f" x{i}", *(line() for _ in range(50))])) for i in range(20)] + [(None, same)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)
    pairs = spark.createDataFrame([(None, 0, i, 0) for i in range(20)], "a_id long, a_line int, b_id long, b_line int")
    out = line_dedup._verified(docs, pairs, 0.8)
    found = out.collect()
    assert len(found) == 20 and all(x.other.doc_id is None and x.other.line == 0 for x in found)
    assert {x.removed[0] for x in line_dedup.removed_by_document(docs).collect()} == {0}
    none = line_dedup._verified(docs, spark.createDataFrame([(1, 1, 2, 1)], pairs.schema), 0.8).collect()
    assert len(none) == 1 and none[0].other is None
