"""The training-data operators against brute force, round trips and held-out rows, with edge cases."""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from portrisk.llm import decontaminate, host_rules, html_text, jaccard_join, language, licenses, line_dedup, mixing, queries, token_count, toxicity
from portrisk.llm.words import column_words, words_of

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

ODD = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, "   \n\t\n", None, "a", 6), (4, "one", "en", None, 3), (4, "one", "en", None, 3),
    (None, "no id here at all, but words", "en", "a", 20), (5, "x " * 30_000, "en", "a", 60_000), (6, "12 34 !?", "en", "b", 8),
]


def words(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").encode().lower())


def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def test_word_hashes_equal_for_equal_words_only():
    texts = ["Under the MIT", "", None, "the mit. x-y Ünder", "a" * 700 + " mit"]
    hashes, edge = column_words(pa.array(texts))
    assert np.diff(edge).tolist() == [len(words(t)) for t in texts]
    by = {}
    for w, h in zip((w for t in texts for w in words(t)), hashes.tolist(), strict=True):
        assert by.setdefault(w, h) == h
    assert len(set(by.values())) == len(by)


def test_words_do_not_depend_on_blocks(monkeypatch):
    data = np.frombuffer(("ab cde " * 400 + "x" * 900 + " end").encode(), dtype=np.uint8)
    whole = words_of(data, np.array([0, 1000, len(data)]))
    monkeypatch.setattr("portrisk.llm.words.BLOCK", 64)
    parts = words_of(data, np.array([0, 1000, len(data)]))
    assert all((a == b).all() for a, b in zip(whole, parts, strict=True))


def test_tokens_spliced_equal_tokens_of_the_whole():
    own, r = token_count.splicer(token_count.MODEL), random.Random(3)
    for _ in range(300):
        text = "".join(r.choice(["a", "b ", " ", "  ", "\n", "é", "漢", "▁", "<s>", "12", "😀", "the ", "<0x41>"]) for _ in range(r.randint(0, 150)))
        assert own.count(text, r.randint(3, 30), r.randint(1, 9)) == len(own.model.encode(text)), text


def test_token_counts_of_odd_rows(spark):
    rows = token_count.count_tokens(odd(spark), chunk=500, overlap=20).collect()
    own = token_count.splicer(token_count.MODEL).model
    assert sorted((r.n_bytes, r.n_tokens) for r in rows) == sorted((len((t or "").encode()), len(own.encode(t or ""))) for _, t, *_ in ODD)
    assert token_count.count_tokens(empty(spark)).collect() == []


def test_license_base_columns(spark):
    texts = ["Under the MIT License, under the mit\nlicense", "Apache License, Version 2.0; cc-by-nc_4 CC/BY NC", None, "under the mit licenses", "cc_byé nc", *[t for _, t, *_ in ODD]]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan_licenses(df).collect()}
    for i, t in enumerate(texts):
        w = [x.decode() for x in WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or "").encode())]
        at = [(k, label) for phrase, label in licenses.BASE.items() for k in range(len(w)) if w[k: k + len(phrase.split())] == phrase.split()]
        r = got[i]
        assert (r.n_words, r.n_base) == (len(w), len(at))
        assert (r.first_word, r.last_word) == ((min(at)[0], max(at)[0]) if at else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in at})) and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        assert 0 <= r.score <= 1


def test_license_gate_lets_every_separator_through(spark):
    texts = ["cc_by_nc", "_CC BY-NC_", "[cc-by_nc]", "see cc`by__nc.", "_public domain_ this_work_is_in_the_public_domain", "https://scripts.sil.org/OFL", "accuracy by now"]
    got = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        w = [x.decode() for x in words(t)]
        at = [k for k in range(len(w)) if w[k: k + 3] == ["cc", "by", "nc"]]
        assert (got[i].n_words, got[i].n_base, got[i].first_word) == (len(w), len(at), at[0] if at else None), t
    assert [got[i].labels for i in range(len(texts))] == ["cc-by-nc"] * 4 + ["public-domain", "ofl-1.1", ""]


def test_license_suppression(spark):
    text = "Licensed under the Apache License, Version 2.0. Permission is hereby granted, free of charge, to any person obtaining a copy. All rights reserved"
    r = licenses.scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert r.labels == "all-rights-reserved,apache-2,mit"
    spans = [(d.a, d.b) for d in r.detections if d.label == "apache-2"]
    assert spans == [(0, 7)]  # the mention inside the notice is gone
    assert len(licenses.rules()) > 200


def test_language_held_out_accuracy_and_odd_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.learn(docs)
    rows = language.identify(docs, model, ("doc_id", "lang", "text")).where(language.held_out(F.col("doc_id"))).collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.95 * len(rows)
    got = language.identify(odd(spark), model, ("doc_id", "text")).collect()
    assert all((r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or "")) and 0 <= r.score <= 1 for r in got) and len(got) == len(ODD)
    assert {r.lang_pred for r in language.identify(odd(spark), language.learn(empty(spark))).collect()} == {"und"}


def test_lines_against_brute_force(spark):
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)]
    rows = []
    for d in range(60):
        lines = []
        for _ in range(r.randint(0, 5)):
            line = r.choices(vocabulary, k=r.randint(0, 14))
            lines.append(" ".join(line))
        if rows and r.random() < 0.6:  # a near copy of an earlier line
            old = (r.choice(rows)[1] or "").split("\n")[0].split()
            if old:
                old[r.randrange(len(old))] = r.choice(vocabulary)
            lines.append(" ".join(old))
        rows.append((d, "\n".join(lines), "en", "s", 0))
    rows.append((100, None, "en", "s", 0))
    want, seen = {}, []
    for d, text, *_ in rows:
        for i, line in enumerate((text or "").split("\n")):
            w = frozenset(words(line))
            if w:
                if any(len(w & v) >= 0.8 * len(w | v) for v in seen):
                    want.setdefault(d, []).append(i)
                seen.append(w)
    df = spark.createDataFrame(rows, DOCS).repartition(5)
    got = {x.doc_id: x.removed for x in line_dedup.removed_by_document(df).collect()}
    assert got == want
    for x in line_dedup.dedup_lines(df).collect():
        text = dict((a, b) for a, b, *_ in rows)[x.doc_id]
        assert x.text == (None if text is None else "\n".join(v for i, v in enumerate(text.split("\n")) if i not in want.get(x.doc_id, [])))
    assert line_dedup.dedup_lines(odd(spark)).count() == len(ODD) and line_dedup.dedup_lines(empty(spark)).count() == 0


@pytest.mark.parametrize("page, text", [
    ("<nav><a>Home</a></nav><article><h1>T &amp; x</h1><p>One,  two.<br>three<p>Four.</article><footer>f</footer>", "T & x\n\nOne, two. three\n\nFour."),
    ("<body><div class='ad'>buy</div><div><p>A long sentence, with marks. And one more.</p></div><form>q<input></form><script>x<y</script></body>", "A long sentence, with marks. And one more."),
    ("<article><p>Said.</p><section id='comments'><p>Me too.</p></section></article>", "Said."),
    ("plain &lt;text&gt;", "plain <text>"), (None, ""), ("", ""), ("<article><p>cut of", "cut of"), ("<!-- <p>no</p> --><p>yes</p>", "yes"),
])
def test_main_text(page, text):
    assert html_text.main_text(page) == text


def test_leaks_with_edits_and_odd_rows(spark):
    r = random.Random(7)
    items = [(i, " ".join(f"{r.choice('abcdef')}{r.randint(0, 300)}" for _ in range(r.randint(20, 50)))) for i in range(30)] + [(90, None), (91, "")]
    docs, want = [], set()
    for d in range(120):
        w = [f"{r.choice('abcdef')}{r.randint(0, 300)}" for _ in range(200)]
        if d % 2 == 0:
            item = items[r.randrange(30)]
            part = item[1].split()
            for _ in range(r.randint(0, len(part) // 10)):
                k = r.randrange(len(part))
                part[k: k + 1] = r.choice([[], ["zz"], [part[k], "yy"]])
            w[80:80] = part
            want.add((d, item[0]))
        docs.append((d, " ".join(w), "en", "s", 0))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in decontaminate.find_leaks(spark.createDataFrame(docs, DOCS), bench, block_bytes=2000).collect()}
    assert got <= want and len(got) >= 0.97 * len(want)
    assert decontaminate.find_leaks(odd(spark), bench).count() == 0 and decontaminate.find_leaks(empty(spark), bench).count() == 0


def test_leaks_with_a_fifth_of_the_words_edited(spark):
    r = random.Random(13)
    items = [(i, " ".join(f"{r.choice('abcdef')}{r.randint(0, 3000)}" for _ in range(n))) for i, n in enumerate([5, 9, 10, 16, 24, 39, 60, 120] * 12)]
    docs = []
    for i, text in items:
        w, part = [f"q{r.randint(0, 3000)}" for _ in range(60)], text.split()
        for _ in range(len(part) // 5):
            k = r.randrange(len(part))
            part[k: k + 1] = r.choice([[], ["zz"], [part[k], "yy"]])
        w[30:30] = part
        docs.append((i, " ".join(w), "en", "s", 0))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in decontaminate.find_leaks(spark.createDataFrame(docs, DOCS), bench).collect()}
    assert got <= {(i, i) for i, _ in items} and len(got) >= 0.97 * len(items)


def test_nearest_is_the_least_edit_distance():
    r = random.Random(2)
    for _ in range(60):
        item, region = [r.randrange(4) for _ in range(r.randint(1, 6))], [r.randrange(4) for _ in range(r.randint(1, 9))]
        def distance(a, b):
            row = list(range(len(b) + 1))
            for i, x in enumerate(a):
                new = [i + 1]
                for j, y in enumerate(b):
                    new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
                row = new
            return row[-1]
        want = min(distance(item, region[a:b]) for a in range(len(region) + 1) for b in range(a, len(region) + 1))
        got = decontaminate.nearest(np.array(item, dtype=np.uint64), np.array(region, dtype=np.uint64))
        assert got[0] == want == distance(item, region[got[1]: got[1] + got[2]])


def test_toxicity_on_labelled_rows_and_odd_ones(spark):
    docs, marks = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = toxicity.predict(docs, toxicity.learn(docs, marks)).withColumnRenamed("toxic", "said").join(marks, "doc_id").collect()
    assert sum(r.said for r in rows if r.toxic) >= 0.9 * sum(1 for r in rows if r.toxic) and sum(r.said for r in rows if not r.toxic) <= 2
    blank = toxicity.learn(odd(spark), labels(spark))
    assert toxicity.predict(odd(spark), blank).where("NOT toxic").count() == len(ODD) and toxicity.predict(empty(spark), blank).count() == 0


def test_jaccard_join_against_brute_force(spark):
    r = random.Random(11)
    rows, n = [], 0
    for _ in range(40):
        base = [f"v{r.randint(0, 4000)}" for _ in range(r.randint(0, 120))]
        for _ in range(r.choice([1, 1, 2, 5])):
            w = list(base)
            for _ in range(r.randint(0, max(0, len(w) // 60))):
                w[r.randrange(len(w))] = "edit"
            rows.append((n, " ".join(w), "en", "s", 0))
            n += 1
    base = [f"u{i}" for i in range(150)]
    for i in range(330):  # a group larger than a tile and than a small bucket
        w = list(base)
        w[i % 150] = f"e{i}"
        rows.append((n + i, " ".join(w), "en", "s", 0))
    rows.append((n + 400, None, None, None, None))
    def shingle_set(t):
        w = words(t)
        return frozenset(tuple(w[i: i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
    sets = {d: shingle_set(t) for d, t, *_ in rows}
    distinct = list({s for s in sets.values() if s})
    links = {s: sum(1 for v in distinct if v is not s and len(s & v) >= 0.8 * len(s | v)) for s in distinct}
    got = {x.doc_id: x for x in jaccard_join.near_duplicates(spark.createDataFrame(rows, DOCS).repartition(4)).collect()}
    assert len(got) == len(rows)
    right = sum(got[d].n_links == links.get(s, 0) for d, s in sets.items())
    assert right >= 0.99 * len(rows)
    for d, s in sets.items():
        assert got[d].kept == (got[d].class_id == d) and got[d].n_copies == (sum(v == s for v in sets.values()) if s else 1)
    assert jaccard_join.near_duplicates(odd(spark)).count() == len(ODD) and jaccard_join.near_duplicates(empty(spark)).count() == 0


def test_mixing_meets_targets_and_optimum(spark):
    docs, marks = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = mixing.mix_sources(docs, marks).collect()
    n = np.array([r.n_tokens for r in rows], dtype=float)
    p = np.array([[r[f"p_{k}"] for k in mixing.DOMAINS] for r in rows])
    rate, target = np.array([r.rate for r in rows]), np.array([mixing.TARGETS[k] for k in mixing.DOMAINS])
    assert (rate >= 0).all() and np.abs((n[:, None] * p * rate[:, None]).sum(0) / n.sum() - target).max() < 0.01
    w, best = n / n.sum(), np.ones(len(n))
    for _ in range(30_000):  # plain projected gradient over the documents
        best = np.maximum(0, best - 0.9 * mixing.MU * ((best - 1) + p @ ((w[:, None] * p * best[:, None]).sum(0) - target) / mixing.MU))
    assert np.abs(best - rate).max() < 0.02
    assert mixing.mix_sources(odd(spark), labels(spark)).count() == len(ODD) and mixing.mix_sources(empty(spark), labels(spark)).count() == 0


def test_host_rules_on_odd_rows(spark):
    rows = host_rules.host_quality(odd(spark)).collect()
    assert len(rows) == len(ODD) and host_rules.host_quality(empty(spark)).count() == 0
    repeated = next(r for r in rows if r.doc_id == 5)
    assert (repeated.n_words, repeated.n_repeat_words, repeated.base_failed, repeated.kept) == (30_000, 30_000, True, False)


def test_pipeline_stages(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        columns, before = docs.columns, docs.count()
        docs = stage(spark, docs, SF)
        assert docs.columns == columns and 0.5 * before < docs.count() <= before
    assert set(queries.ALL) >= {"pipeline"} and len(queries.ALL) == 14


def test_pipeline_judges_rows_with_equal_and_null_ids(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    r = random.Random(17)
    new = lambda: [f"{r.choice('abcdef')}{r.randint(0, 3000)}" for _ in range(80)]
    a, b, c, item, clean, other = (new() for _ in range(6))
    near = [*a[:79], "edit"]
    b2, leak, null_leak = [*b[:79], "edit"], [*new(), *item], [*new(), *item]
    text = " ".join
    rows = [(3, a), (3, near), (5, clean), (5, a), (7, c), (7, c), (None, b), (None, b2), (None, other), (5, leak), (None, null_leak), (9, item[:1])]
    docs = spark.createDataFrame([(d, text(t), "en", "s", 0) for d, t in rows], DOCS).repartition(3)
    left = lambda df: sorted((x.doc_id or -1, x.text) for x in df.collect())
    key = lambda pairs: sorted((d or -1, text(t)) for d, t in pairs)
    got = left(corpus_pipeline.near_duplicate_stage(spark, docs, ""))
    rest = [(5, clean), (7, c), (None, other), (5, leak), (None, null_leak), (9, item[:1])]
    assert got in [key([*rest, (3, x), (None, y)]) for x in (a, near) for y in (b, b2)]
    spark.createDataFrame([(1, text(item))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    gone = [(5, leak), (None, null_leak)]
    assert left(corpus_pipeline.leak_stage(spark, docs, str(tmp_path))) == key([x for x in rows if x not in gone])


def test_lines_of_a_hot_template_are_dealt_out_without_losing_pairs(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "HOT", 20)
    monkeypatch.setattr(line_dedup, "TILE", 15)
    r = random.Random(23)
    template = [f"t{i}" for i in range(8)]
    lines = [[*template[r.randint(0, 1):], *(f"o{r.randint(0, 400)}" for _ in range(r.randint(0, 3)))] for _ in range(150)]
    lines += [[*template, f"p{i}", f"q{i}"] for i in range(100)]
    for line in lines:
        r.shuffle(line)
    want, seen = set(), []
    for d, line in enumerate(map(frozenset, lines)):
        if any(len(line & v) >= 0.8 * len(line | v) for v in seen):
            want.add(d)
        seen.append(line)
    df = spark.createDataFrame([(d, " ".join(line), "en", "s", 0) for d, line in enumerate(lines)], DOCS).repartition(3)
    assert {x.doc_id for x in line_dedup.removed_by_document(df).collect()} == want
    # One word, sets of ten words that all share it at place 2 (rest 8 of 9 needed): no posting is left to compare.
    posts = spark.range(300).select(F.lit(5).cast("long").alias("word"), F.col("id").alias("doc_id"), F.lit(0).alias("line"), F.lit((10 << 32) + 2).alias("n_at"), F.lit(0).cast("long").alias("p0"), F.lit(0).cast("long").alias("p1"))
    assert line_dedup._placed(posts, 0.8).count() == 0
    # Where pairs are left, no group has all postings.
    assert max(x["count"] for x in line_dedup._placed(posts.withColumn("n_at", F.lit(10 << 32)), 0.8).groupBy("word", "m", "part").count().collect()) < 100
