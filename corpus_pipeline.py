"""A training corpus from documents: language, lines, near duplicates, leaks, mix.

Each stage takes (spark, docs, sf_dir) and returns a table that is written and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from portrisk.llm import decontaminate, jaccard_join, language, line_dedup, mixing
from portrisk.llm.common import cut, fresh, small, table

#: Share of a text's trigrams that its language must contain.
MIN_LANGUAGE_SCORE = 0.2


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; rejected ones go."""
    columns = docs.columns
    lang, score = fresh(docs, "lang_pred", "score")
    judged = language.identify(docs, language.learn(docs), tuple(columns), (lang, score))
    return judged.where((F.col(lang) != language.UNKNOWN) & (F.col(score) >= MIN_LANGUAGE_SCORE)).select(*columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that match an earlier one; a document left without a word goes."""
    return line_dedup.dedup_lines(docs).where(F.col("text").rlike(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"))


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows under a key of their own: the id and a hash of the text, null ids last. Rows of equal keys are copies."""
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("text_key"))
    return docs.select(key.alias("doc_id"), "text")


def _judged(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """docs joined with a table of distinct keys, null ids too."""
    a, b = fresh(docs, "_id", "_key")
    keys = small(cut(keys.select(F.col("doc_id.id").alias(a), F.col("doc_id.text_key").alias(b)).distinct()))
    return docs.join(keys, F.col("doc_id").eqNullSafe(F.col(a)) & F.xxhash64("text").eqNullSafe(F.col(b)), how).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near duplicates: the one with the least id, and of rows with this id with the least text hash."""
    judged = jaccard_join.near_duplicates(_keyed(docs))
    # Copies with equal ids have equal keys: of such a key one row is kept, or none.
    by_key = cut(judged.groupBy("doc_id").agg(F.max("kept").alias("kept"), F.max("n_copies").alias("n_copies"), F.count(F.lit(1)).alias("rows")))
    left = _judged(docs, by_key.where("NOT kept"), "left_anti")
    again = by_key.where("kept AND n_copies > 1 AND rows > 1")
    return _judged(left, again, "left_anti").union(_judged(left, again, "left_semi").dropDuplicates(["doc_id", "text"]))


def leak_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark item."""
    return _judged(docs, decontaminate.find_leaks(_keyed(docs), table(spark, sf_dir, "benchmark")), "left_anti")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the rate and the number of copies that bring the domains to their target weights; none: gone."""
    mixed = mixing.mix_sources(docs, table(spark, sf_dir, "labels"))
    return mixed.where("n_copies > 0")


STAGES = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("jaccard_join", near_duplicate_stage),
    ("decontamination", leak_stage),
    ("source_mixing", mixing_stage),
]

#: Trained classifiers, edit distances and fitted rates are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs
