"""Samples at very large row counts and for hot ids, very long texts, and pages whose paths are told by their ratios."""

from __future__ import annotations

import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from portrisk.llm import html_text, jaccard_join, language, line_dedup, mixing, toxicity
from portrisk.llm.common import cut, sample_limit, sampled

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("n", [3001, 10**6, 10**10, 10**13])
def test_a_sample_keeps_its_size_at_any_number_of_rows(n):
    share = (sample_limit(n, 3000) + (1 << 63)) / 2**64
    assert share * n == pytest.approx(3000, rel=1e-6)


def test_a_sample_of_rows(spark):
    rows = spark.range(200_000)
    assert 2600 < rows.where(sampled(F.col("id"), 200_000, 3000)).count() < 3400
    assert rows.where(sampled(F.col("id"), 200_000, 200_000)).count() == 200_000


def hot(spark, copies: int):
    """Given rows, and one labelled id that is not held out in a third of all rows."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    marks = spark.read.parquet(f"{SF}/labels.parquet")
    one = docs.join(marks.select("doc_id"), "doc_id").where(F.col("lang").isNotNull() & ~language.held_out(F.col("doc_id"))).orderBy("doc_id").limit(1)
    more = one.crossJoin(spark.range(copies)).withColumn("text", F.concat("text", F.lit(" "), F.col("id").cast("string"))).drop("id")
    return docs, docs.union(more), marks


def test_an_id_in_a_third_of_all_rows_counts_once(spark):
    docs, many, marks = hot(spark, 500)
    plain, crowded = language.learn(docs), language.learn(many)
    assert plain.languages == crowded.languages and (plain.table == crowded.table).mean() > 0.999
    a, b = toxicity.learn(docs, marks), toxicity.learn(many, marks)
    assert len(np.setdiff1d(a.features, b.features)) < 0.05 * max(1, len(a.features))
    assert len(set(mixing.learn(docs, marks)[0]) ^ set(mixing.learn(many, marks)[0])) <= 0.1 * mixing.FEATURES


def test_toxicity_of_documents_that_were_not_learned_from(spark):
    docs, marks = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    out = F.pmod(F.xxhash64("doc_id", F.lit("out")), F.lit(3)) == 0
    rows = toxicity.predict(docs, toxicity.learn(docs, marks.where(~out))).withColumnRenamed("toxic", "said").join(marks.where(out), "doc_id").collect()
    bad = [r.said for r in rows if r.toxic == 1]
    assert len(bad) > 100 and sum(bad) >= 0.9 * len(bad) and sum(r.said for r in rows if r.toxic == 0) <= 0.01 * len(rows)


def test_features_of_a_fold_do_not_see_its_rows():
    """Columns that a fold's choice leaves out have no part in its probabilities."""
    r = np.random.default_rng(4)
    y = r.integers(0, 2, (90, 2)).astype(float)
    x = np.hstack([y[:, :1], r.normal(size=(90, 3))]).astype(np.float32)  # the first column is the label itself
    folds, rest, every = np.arange(90) % toxicity.FOLDS, np.arange(1, 4), np.arange(4)
    leaking = toxicity.fit_chain(x, y, folds, [every] * 4)
    blind = toxicity.fit_chain(x, y, folds, [rest] * 3 + [every])
    assert (leaking[0] == blind[0]).all()
    # What the second model learns from: the first one's probabilities.
    other = x.copy()
    other[:, 0] = 0
    assert np.allclose(toxicity.fit_chain(other, y, folds, [rest] * 3 + [rest])[1], toxicity.fit_chain(x, y, folds, [rest] * 3 + [rest])[1])


def test_a_fit_that_does_not_end_raises(spark, monkeypatch):
    monkeypatch.setattr(mixing, "STEPS", 1)
    members = spark.createDataFrame([(10, [0.2, 0.8]), (90, [0.9, 0.1])], "n_tokens long, p array<double>")
    with pytest.raises(RuntimeError, match="optimum"):
        mixing.fit(members, [0.1, 0.9])


@pytest.fixture(scope="module")
def model():
    grams = {lang: np.unique(language.trigrams([text])[0]) for lang, text in (("a", "abc bcd cde def"), ("b", "uvw vwx wxy xyz"))}
    return language.LanguageFilter.build(grams, "a")


@pytest.mark.parametrize("long", ["abc bcd " * 1_250_000, "abcdef" * 1_600_000], ids=["words", "one word"])
def test_a_long_text_after_a_short_one_in_bounded_memory(model, long):
    texts = ["uvw vwx", long, "", None, "xyz"]
    tracemalloc.start()
    got = [x for _, part in language._blocks(texts) for x in zip(*model.decide(part), strict=True)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [lang for lang, _ in got] == ["b", "a", "und", "und", "b"] and peak < 150 * 2**20


def test_pieces_have_the_counts_of_the_whole(model, monkeypatch):
    text = "abc bcd, uvw. " * 500
    whole = model.hits([text])
    monkeypatch.setattr(language, "BLOCK", 100)
    parts = model.hits([text])
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()


PROSE = "<h1>Title</h1><p>A long sentence, with <a href=z>a link</a> and marks. Then one more.</p><p>Second paragraph, not short.</p>"
TEXT = "Title\n\nA long sentence, with a link and marks. Then one more.\n\nSecond paragraph, not short."
LINKS = "<div><ul><li><a href=x>Home</a><li><a href=y>About us</a></ul></div>"


@pytest.mark.parametrize("page, text", [
    (f"<body>{LINKS}<div>{PROSE}</div>{LINKS}</body>", TEXT),  # no article, no names: the ratios decide
    (f"<div class='share-price'>{PROSE}</div>", TEXT), (f"<div class='post side-effects'>{PROSE}</div>", TEXT), (f"<article class='has-sidebar'>{PROSE}</article>", TEXT),
    (f"<div>{PROSE}</div><div class='comment-list'><p>I agree, it is so. Very long, it is, and full of marks.</p></div><div id=site-footer>(c) A, B.</div>", TEXT),
    (f"<article>{PROSE}<article class='comment'><p>Me too, yes.</p></article></article>", TEXT),
    (f"<div class=adBox><p>Buy, now! {'Very long, it is. ' * 99}</p></div><article><p>Short</p></article>", "Short"),
    ("<article><p>" + "Words, and more. " * 4000 + "</p><ul><li>Eggs<li>1</ul></article>", ("Words, and more. " * 4000).strip() + "\n\nEggs\n\n1"),
    ("<p title=\"5\" wide\">Text, here.</p><p data-x='class=ad'>More, too.</p>", "Text, here.\n\nMore, too."),
    ("<nav><a href=x>Home</a></nav><footer>A, b. C.</footer>", ""),
])
def test_main_text_by_ratios(page, text):
    assert html_text.main_text(page) == text


def test_the_ratios_decide_on_given_pages(spark, monkeypatch):
    pages = [r.html for r in spark.read.parquet(f"{SF}/pages.parquet").limit(100).collect()]
    chosen = [html_text.main_text(p) for p in pages]
    monkeypatch.setattr(html_text, "content_paths", lambda nodes, _: {n.path for n in nodes})
    assert sum(html_text.main_text(p) != t for p, t in zip(pages, chosen, strict=True)) > 50


@pytest.mark.parametrize("part", ["<a ", "<a >", '<a b="', "<b></i>", "<iframe>", "<div><li>", "<!--", "<![CDATA["])
def test_a_megabyte_of_tags(part):
    start = time.process_time()
    html_text.main_text(part * ((1 << 20) // len(part)) + '"')
    assert time.process_time() - start < 4


@pytest.mark.parametrize("run", [
    lambda docs: cut(docs),
    lambda docs: jaccard_join.near_duplicates(docs).count(),
    lambda docs: line_dedup.word_counts(docs),
    lambda docs: language.identify(docs, None).count(),
])
def test_batches_of_long_texts_are_bounded(spark, run):
    def batch_bytes(batches):
        for batch in batches:
            yield pa.record_batch([pa.array([batch.nbytes])], names=["n"])

    key, session = "spark.sql.execution.arrow.maxBytesPerBatch", spark.newSession()
    docs = session.range(3000, numPartitions=1).select(F.col("id").alias("doc_id"), F.repeat(F.concat(F.lit("word "), F.col("id").cast("string")), 1000).alias("text"))
    assert session.conf.get(key, None) is None
    run(docs.where("doc_id < 20"))
    sizes = [r.n for r in docs.mapInArrow(batch_bytes, "n long").collect()]
    assert sum(sizes) > 20 << 20 and max(sizes) < 5 << 20
    session.conf.set(key, "1m")
    cut(docs.limit(1))
    assert session.conf.get(key) == "1m"
