"""Exact stratified split, reproducible from an id.

Rows are ordered by the md5 of their id inside each label.  Because that key is
uniform, fixed-width buckets of it are balanced: per-bucket counts find the buckets
that hold a cut, and only rows of these buckets (about a millionth each) are ranked,
to find the last row before the cut.  All rows are then decided by one comparison.
The rows are written once with their order, so the source is read once, and the table
is not shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from portrisk import config as C
from portrisk.functions.arrays import total
from portrisk.functions.scalar import md5_uniform
from portrisk.session import materialize

BUCKETS = 1 << 20


def stratified_parts(
    rows: DataFrame,
    names: tuple[str, ...] = ("train", "valid", "test"),
    fractions: tuple[float, ...] = (C.TEST_FRACTION, C.TEST_FRACTION),
    key: str = "client_id",
    label: str = "churn",
    salt: str = "",
    out: str = "part",
    buckets: int = BUCKETS,
) -> DataFrame:
    """Add the part name of every row, stratified by a binary label.

    Fractions are taken from the end: the last part gets ceil(f * n) rows, the part
    before it ceil(f * n) of what is left, and so on.  Labels share each remainder in
    proportion, rounded down, and the largest rests get the missing rows.  A row
    without a key is placed by its content.
    """
    order = F.struct(F.col("_u"), F.col(key).alias("key"), F.col("_id"))
    tagged = materialize(
        rows.withColumn("_y", F.coalesce(F.col(label) == 1, F.lit(False)))
        .withColumn("_u", F.coalesce(md5_uniform(key, salt), md5_uniform(F.to_json(F.struct(*rows.columns)), salt)))
        .withColumn("_b", F.floor(F.col("_u") * buckets).cast("int"))
        .withColumn("_id", F.monotonically_increasing_id())  # rows of one key have an order
    )
    per_bucket = tagged.groupBy("_y", "_b").agg(F.count(F.lit(1)).alias("_n"))
    left = per_bucket.groupBy("_y").agg(F.sum("_n").alias("_size"))
    cuts = range(len(fractions))
    for i in reversed(cuts):
        left = _keep(left, fractions[len(fractions) - 1 - i]).withColumn(f"_q{i}", F.col("_size"))
    running = Window.partitionBy("_y").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    counted = per_bucket.withColumn("_before", F.coalesce(F.sum("_n").over(running), F.lit(0)))
    # One row per label value, so two.
    found = (
        counted.join(F.broadcast(left.drop("_size")), "_y")
        .groupBy("_y")
        .agg(*[
            F.min(F.when(F.col("_before") + F.col("_n") >= F.col(f"_q{i}"), F.struct("_b", "_before", f"_q{i}"))).alias(f"_c{i}")
            for i in cuts
        ])
    )
    # The last row before each cut, from the few rows of its bucket.
    at_cut = F.lit(False)
    for i in cuts:
        at_cut = at_cut | (F.col("_b") == F.col(f"_c{i}._b"))
    near = tagged.select("_y", "_b", "_u", key, "_id").join(F.broadcast(found), "_y").where(at_cut)
    near = near.withColumn("_rank", F.row_number().over(Window.partitionBy("_y", "_b").orderBy("_u", key, "_id")))
    last = near.groupBy("_y").agg(*[
        F.max(F.when((F.col("_b") == F.col(f"_c{i}._b")) & (F.col(f"_c{i}._before") + F.col("_rank") <= F.col(f"_c{i}._q{i}")), order)).alias(f"_t{i}")
        for i in cuts
    ])
    ends = found.join(last, "_y").select("_y", *[F.struct(F.col(f"_c{i}._b").alias("b"), F.col(f"_t{i}").alias("t")).alias(f"_e{i}") for i in cuts])
    labels = F.array(*[F.lit(n) for n in names])

    def beyond(i: int):
        same = F.col("_b") == F.col(f"_e{i}.b")
        return F.when(F.when(same, F.coalesce(order > F.col(f"_e{i}.t"), F.lit(True))).otherwise(F.col("_b") > F.col(f"_e{i}.b")), 1).otherwise(0)

    placed = tagged.join(F.broadcast(ends), "_y")
    return placed.select(*rows.columns, F.get(labels, total([beyond(i) for i in cuts])).alias(out))


def stratified_split(
    rows: DataFrame,
    key: str = "client_id",
    label: str = "churn",
    test_fraction: float = C.TEST_FRACTION,
    out: str = "is_test",
) -> DataFrame:
    """Two-way split with a boolean column, true for the test part."""
    parts = stratified_parts(rows, ("train", "test"), (test_fraction,), key, label, out="_part")
    return parts.select(*rows.columns, (F.col("_part") == "test").alias(out))


def _keep(sizes: DataFrame, fraction: float) -> DataFrame:
    """Label sizes after ceil(fraction * n) rows have been taken away in proportion."""
    everything = Window.partitionBy(F.lit(0))
    n = F.sum("_size").over(everything)
    share = F.col("_size") * F.col("_goal") / F.col("_n")
    ranked = (
        sizes.withColumn("_n", n)
        .withColumn("_goal", F.col("_n") - F.ceil(F.round(F.col("_n") * fraction, 9)))
        .withColumn("_floor", F.floor(share))
        .withColumn("_rest", share - F.floor(share))
    )
    missing = F.col("_goal") - F.sum("_floor").over(everything)
    place = F.row_number().over(everything.orderBy(F.desc("_rest"), F.asc("_y")))
    kept = F.col("_floor") + F.when(place <= missing, 1).otherwise(0)
    return ranked.withColumn("_size", kept).drop("_n", "_goal", "_floor", "_rest")
