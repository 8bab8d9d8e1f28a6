"""Range and as-of joins by buckets: no cross join, no window over a whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from portrisk import config as C
from portrisk.operators import prefix


def latest_window(prices: DataFrame, days: int = C.HISTORY_DAYS) -> DataFrame:
    """Rows of the last ``days`` before the newest date, tagged with it as ``as_of``."""
    newest = prices.agg(F.max("date")).scalar()
    return prices.withColumn("as_of", newest).where(F.col("date") > F.date_sub("as_of", days))


def window_by_as_of(prices: DataFrame, as_ofs: DataFrame, days: int = C.HISTORY_DAYS) -> DataFrame:
    """One copy of the rows in ``(as_of - days, as_of]`` per date of ``as_ofs``.

    Each as-of date lists the calendar months its window touches, prices join on
    their month, and the exact range is checked on the few candidates left.
    """
    month = F.trunc("date", "month")
    spans = as_ofs.select("as_of").distinct().select(
        "as_of",
        F.explode(
            F.sequence(
                F.trunc(F.date_sub("as_of", days - 1), "month"),
                F.trunc("as_of", "month"),
                F.expr("interval 1 month"),
            )
        ).alias("_month"),
    )
    return (
        prices.withColumn("_month", month)
        .join(spans, "_month")
        .where((F.col("date") > F.date_sub("as_of", days)) & (F.col("date") <= F.col("as_of")))
        .drop("_month")
    )


#: Left rows that a time bucket should hold.
PER_BUCKET = 1 << 20


def _time(column: str) -> Column:
    return F.col(column).cast("timestamp").cast("double")


def asof_join(left: DataFrame, ts: str, right: DataFrame, valid_from: str, per_bucket: int = PER_BUCKET) -> DataFrame:
    """Attach to each left row the latest right row with ``valid_from <= ts``.

    Both sides are dealt out by time: buckets are cut at quantiles of the left times, each is sorted by time, and the
    last right row is carried along. What a bucket takes over from earlier ones is one more right row at its start, so
    each side is read once and no row is listed per day. A time with many left rows covers several cuts, over which
    its rows are dealt. Left rows older than the first right row, or without a time, come back with nulls; of right
    rows with equal times any one is taken.
    """
    payload = F.struct(valid_from, *[c for c in right.columns if c != valid_from])
    cuts = left.select(_time(ts).alias("t")).where("t IS NOT NULL").agg(prefix.sketch("t").alias("s"))
    cuts = F.coalesce(cuts.select(prefix.boundaries(F.col("s"), per_bucket)).scalar(), F.array().cast("array<double>"))
    low = prefix.bucket_of(F.col("_cuts"), "_t")

    rows = left.select(F.struct(*left.columns).alias("l"), _time(ts).alias("_t"), F.monotonically_increasing_id().alias("_n"), cuts.alias("_cuts"))
    ties = F.size(F.filter("_cuts", lambda c: c == F.col("_t")))
    rows = rows.select((low + F.pmod("_n", F.greatest(ties, F.lit(0)) + 1)).cast("int").alias("bucket"), "_t", "l")

    history = right.select(payload.alias("r"), _time(valid_from).alias("_t"), cuts.alias("_cuts")).where("_t IS NOT NULL")
    history = history.select(low.cast("int").alias("bucket"), "_t", "r", F.size("_cuts").alias("_n_cuts")).repartition("bucket")
    # One row per bucket: its last right row goes on to all buckets up to the next one with a right row.
    last = history.groupBy("bucket").agg(F.max_by(F.struct("_t", "r"), "_t").alias("x"), F.max("_n_cuts").alias("_n_cuts"))
    following = F.lead("bucket").over(Window.orderBy("bucket"))
    last = last.select("x", F.sequence(F.col("bucket") + 1, F.coalesce(following, F.col("_n_cuts"))).alias("to"), "bucket", "_n_cuts")
    carried = last.where(F.col("bucket") < F.col("_n_cuts")).select(F.explode("to").alias("bucket"), "x._t", "x.r")

    no_left = F.lit(None).cast(rows.schema["l"].dataType)
    no_right = F.lit(None).cast(history.schema["r"].dataType)
    both = rows.select("bucket", "_t", "l", no_right.alias("r")).unionByName(
        history.select("bucket", "_t", no_left.alias("l"), "r").unionByName(carried.select("bucket", "_t", no_left.alias("l"), "r")))
    order = Window.partitionBy("bucket").orderBy("_t", F.col("l").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    found = both.select("l", F.last("r", ignorenulls=True).over(order).alias("r")).where("l IS NOT NULL")
    return found.select("l.*", "r.*")
