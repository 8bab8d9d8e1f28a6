"""Quality rules by host: rule failures of a host's documents, shrunk, decide on the host.

Native: DataFrame functions only. Each document gets its measures in its own row. Failures are
counted by host with map-side sums, so a host with a third of all rows is one row per task.
A beta prior fitted to all hosts by moments shrinks the rates of small hosts to the mean. A host
whose shrunk rate of any rule exceeds HOST_LIMIT is rejected with all its documents.

Edge cases: a null text is an empty one; documents with a null source form one host; repeated
rows are counted as rows; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portrisk.llm.common import cut, let

WINDOW = 5
MIN_WORDS = 10
#: A host goes when its shrunk failure rate of a rule is above this.
HOST_LIMIT = 0.5
#: Pseudo-documents that the prior weighs at most and at least.
PRIOR_RANGE = (2.0, 1000.0)

SPACE = r"[\x20\x09-\x0D]"

#: Rules by name, on the measures of a document.
RULES: dict[str, str] = {
    "base": "n_words < 10 OR 100 * n_repeat_words > 20 * n_words",
    "symbols": "n_words > 0 AND 10 * n_symbols > n_words",
    "dup_lines": "n_lines > 0 AND 10 * n_dup_lines > 3 * n_lines",
    "word_length": "n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 15 * n_words)",
}


def _windows(words: Column) -> Column:
    """A hash of every window of WINDOW words."""
    hashed = F.transform(words, lambda w, i: F.xxhash64(w, *[F.get(words, i + k) for k in range(1, WINDOW)]))
    return F.when(F.size(words) > WINDOW, F.slice(hashed, 1, F.size(words) - (WINDOW - 1))).otherwise(F.array().cast("array<bigint>"))


def _repeated_words(grams: Column) -> Column:
    """Words in windows that the text has twice or more, each word once."""
    def covered(g: Column) -> Column:
        order = F.array_sort(F.transform(F.sequence(F.lit(0), F.size(g) - 1), lambda i: F.struct(F.get(g, i).alias("g"), i.alias("i"))))
        def twin(s: Column, j: Column, k: int) -> Column:
            return F.coalesce(F.get(s, j)["g"] == F.get(s, j + k)["g"], F.lit(False))
        found = let(order, lambda s: F.array_sort(F.transform(
            F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda j: (twin(s, j, -1)) | (twin(s, j, 1))), lambda j: F.get(s, j)["i"])))
        start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
        return F.aggregate(found, start, lambda a, i: F.struct(
            (i + WINDOW).alias("end"), (a["n"] + i + WINDOW - F.greatest(a["end"], i)).alias("n")), lambda a: a["n"])

    return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0)).otherwise(covered(grams)).cast("long")


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """doc_id, host and the measures of every document, in one pass without a shuffle."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    full = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    split = docs.select(
        F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"),
        F.array_remove(F.split(text, SPACE + "+"), "").alias("words"),
        let(full, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("d"))).alias("lines"),
        F.length(F.regexp_replace(text, SPACE + "+", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
    )
    return split.withColumn("grams", _windows(F.col("words"))).select(
        "doc_id", "host", F.size("words").cast("long").alias("n_words"), "word_chars", "n_symbols",
        (F.col("lines.n") - F.col("lines.d")).cast("long").alias("n_dup_lines"), F.col("lines.n").cast("long").alias("n_lines"),
        _repeated_words(F.col("grams")).alias("n_repeat_words"),
    )


def host_rates(measured: DataFrame) -> DataFrame:
    """Per host: documents, failures by rule, shrunk rates and the verdict."""
    fails = [F.sum(F.expr(f"CAST({rule} AS BIGINT)")).alias(f"f_{name}") for name, rule in RULES.items()]
    hosts = measured.groupBy("host").agg(F.count(F.lit(1)).alias("n_docs"), *fails)
    # One row of moments: mean rate over documents, variance of the rates over hosts.
    moments = hosts.agg(*[x for name in RULES for x in (
        (F.sum(f"f_{name}") / F.sum("n_docs")).alias(f"m_{name}"),
        F.var_samp(F.col(f"f_{name}") / F.col("n_docs")).alias(f"v_{name}"))]).first()
    out, worst = hosts, []
    for name in RULES:
        m, v = moments[f"m_{name}"] or 0.0, moments[f"v_{name}"] or 0.0
        weight = m * (1 - m) / v - 1 if v > 0 else PRIOR_RANGE[1]
        weight = min(max(weight, PRIOR_RANGE[0]), PRIOR_RANGE[1])
        out = out.withColumn(f"rate_{name}", (F.col(f"f_{name}") + m * weight) / (F.col("n_docs") + weight))
        worst.append(F.col(f"rate_{name}"))
    return out.withColumn("host_rate", F.greatest(*worst)).withColumn("host_kept", F.col("host_rate") <= HOST_LIMIT)


def host_quality(docs: DataFrame, **cols: str) -> DataFrame:
    """Measures, base verdict, host rate and final verdict of every document."""
    measured = cut(measures(docs, **cols))
    hosts = host_rates(measured).select(F.col("host").alias("h"), "host_rate", "host_kept")
    return measured.join(hosts, F.col("host").eqNullSafe(F.col("h")), "left").select(
        "doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        F.expr(RULES["base"]).alias("base_failed"), "host_rate",
        (~F.expr(RULES["base"]) & F.coalesce("host_kept", F.lit(True))).alias("kept"))
