"""Classifier metrics as aggregates: exact AUC, log-loss, classification report."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from portrisk import config as C
from portrisk.functions.scalar import predicted_label
from portrisk.operators import prefix


def roc_auc(scored: DataFrame, label: str = "churn", score: str = "churn_probability", per_bucket: int = prefix.PER_BUCKET) -> DataFrame:
    """Exact area under the ROC curve, ties counted half; null with a single class.

    Rows collapse to distinct scores first; running counts are local to score
    buckets and one row per bucket finishes the sum.
    """
    counts = scored.groupBy(F.col(score).cast("double").alias("value")).agg(
        F.sum(F.col(label).cast("bigint")).alias("pos"), F.sum(1 - F.col(label).cast("bigint")).alias("neg")
    )
    placed = prefix.in_buckets(counts, [], per_bucket)
    inside = Window.partitionBy("bucket").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    below = F.coalesce(F.sum("neg").over(inside), F.lit(0))
    buckets = (
        placed.withColumn("won", F.col("pos") * (below + F.col("neg") / 2))
        .groupBy("bucket")
        .agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.sum("won").alias("won"))
    )
    wins = F.col("won") + F.col("pos") * prefix.before_bucket("neg", [])
    return (
        buckets.withColumn("wins", wins)
        .agg(F.sum("wins").alias("w"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
        .select((F.col("w") / F.nullif(F.col("p") * F.col("n").cast("double"), F.lit(0.0))).alias("auc"))
    )


def log_loss(scored: DataFrame, label: str = "churn", score: str = "churn_probability", eps: float = 1e-15) -> DataFrame:
    p = F.least(F.greatest(F.col(score), F.lit(eps)), F.lit(1 - eps))
    y = F.col(label)
    return scored.agg(F.avg(-(y * F.ln(p) + (1 - y) * F.ln(1 - p))).alias("log_loss"))


def classification_report(
    scored: DataFrame,
    label: str = "churn",
    score: str = "churn_probability",
    threshold: float = C.CHURN_THRESHOLD,
    names: tuple[str, str] = ("Retain", "Churn"),
) -> DataFrame:
    """Rows Retain, Churn, accuracy, macro avg, weighted avg; a 0/0 ratio counts as 0."""
    y, p = F.col(label).cast("int"), predicted_label(F.col(score), threshold)
    cells = scored.agg(
        *[F.count_if((y == a) & (p == b)).alias(f"c{a}{b}") for a in (0, 1) for b in (0, 1)]
    )

    def ratio(a, b):
        return F.coalesce(a / F.nullif(b.cast("double"), F.lit(0.0)), F.lit(0.0))

    c = {(a, b): F.col(f"c{a}{b}") for a in (0, 1) for b in (0, 1)}
    support = {k: c[k, 0] + c[k, 1] for k in (0, 1)}
    precision = {k: ratio(c[k, k], c[0, k] + c[1, k]) for k in (0, 1)}
    recall = {k: ratio(c[k, k], support[k]) for k in (0, 1)}
    f1 = {k: ratio(2 * c[k, k], support[k] + c[0, k] + c[1, k]) for k in (0, 1)}
    n = support[0] + support[1]
    accuracy = ratio(c[0, 0] + c[1, 1], n)

    def row(name, pr, rc, f, s):
        return F.struct(
            F.lit(name).alias("class"), pr.alias("precision"), rc.alias("recall"), f.alias("f1_score"), s.alias("support")
        )

    def macro(m):
        return (m[0] + m[1]) / 2

    def weighted(m):
        return ratio(m[0] * support[0] + m[1] * support[1], n)

    none = F.lit(None).cast("double")
    rows = F.array(
        row(names[0], precision[0], recall[0], f1[0], support[0]),
        row(names[1], precision[1], recall[1], f1[1], support[1]),
        row("accuracy", none, none, accuracy, n),
        row("macro avg", macro(precision), macro(recall), macro(f1), n),
        row("weighted avg", weighted(precision), weighted(recall), weighted(f1), n),
    )
    return cells.select(F.explode(rows).alias("r")).select("r.*")
