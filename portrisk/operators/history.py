"""Market snapshots of many dates from one read of the price history.

No price row is copied per snapshot.  The forward fill and the returns of an asset are one running window over its
dates.  The moments of a snapshot's window are a difference of two running sums of daily return products: a window
starts to count at the date where the last of its assets has had a price inside the window, from there on every
date is complete, and the fill over the whole history equals the fill inside the window.

Products are packed triangles in numpy, summed per month, so universes of hundreds of assets cost matrix products
and not thousands of aggregate columns.  What grows with the calendar (dates, months) is small; what grows with
prices is read once and grouped by (date, asset) with map-side combine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from portrisk import config as C
from portrisk.functions.arrays import lower_bound
from portrisk.operators.market import shrink_covariance
from portrisk.session import materialize
from portrisk.sources.prices import asset_prices

#: Dates found by binary search: 2**17 are 350 years.
DATE_STEPS = 17
#: A date before all others, so that every window has a row before it.
BEFORE = "0001-01-01"


def daily_returns(prices: DataFrame, universe=C.UNIVERSE) -> DataFrame:
    """(idx, date, ret, last_row, next_price): one row per date with arrays over the universe, idx 0 before all dates.

    ``ret`` is the percent change of the filled closes (null before the first two, infinite after a zero), ``last_row``
    the newest date up to this one with a row of the asset, ``next_price`` the first date after it with a price.
    """
    closes = asset_prices(prices, universe).groupBy("date", "ord").agg(F.max("close").alias("close"), F.lit(True).alias("here"))
    before = prices.sparkSession.range(1).select(F.lit(BEFORE).cast("date").alias("date"))
    ords = F.explode(F.sequence(F.lit(0), F.lit(len(universe) - 1))).alias("ord")
    cells = closes.select("date").distinct().union(before).select("date", ords).join(closes, ["date", "ord"], "left")
    series = Window.partitionBy("ord").orderBy("date")
    upto = series.rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy("ord").orderBy(F.desc("date")).rowsBetween(Window.unboundedPreceding, -1)
    filled = cells.select(
        "date", "ord",
        F.row_number().over(series).alias("idx"),
        F.last("close", ignorenulls=True).over(upto).alias("now"),
        F.last(F.when(F.col("here"), F.col("date")), ignorenulls=True).over(upto).alias("last_row"),
        F.last(F.when(F.col("close").isNotNull(), F.col("date")), ignorenulls=True).over(after).alias("next_price"),
    ).withColumn("was", F.lag("now").over(series))
    change = F.when(F.col("was") == 0, F.lit(float("inf"))).otherwise(F.col("now") / F.nullif(F.col("was"), F.lit(0.0)) - 1)
    cell = F.struct("ord", F.when(F.col("now").isNotNull(), change).alias("ret"), "last_row", "next_price")
    by_date = filled.groupBy("date").agg((F.first("idx") - 1).alias("idx"), F.array_sort(F.collect_list(cell)).alias("cells"))
    return by_date.select("idx", "date", *[F.col(f"cells.{c}").alias(c) for c in ("ret", "last_row", "next_price")])


def _vectors(ret: np.ndarray) -> np.ndarray:
    """Rows of daily terms: 1, r, the packed triangle of r r', s*s, s*r with s = r'r, and marks of infinite returns."""
    infinite = np.isinf(ret)
    r = np.where(np.isfinite(ret), ret, 0.0)
    i, j = np.triu_indices(r.shape[1])
    s = (r * r).sum(axis=1, keepdims=True)
    return np.hstack([np.ones((len(r), 1)), r, r[:, i] * r[:, j], s * s, s * r, infinite])


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return np.array([[np.nan if x is None else x for x in row] for row in column.to_pylist()], dtype=np.float64)


def _add(total: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A running sum and, as a second row, its rounding errors: differences of sums do not suffer from what lies before both."""
    new = total[0] + x
    part = new - total[0]
    return np.stack([new, total[1] + ((total[0] - (new - part)) + (x - part))])


def _sums(ret: np.ndarray, start: np.ndarray | None = None) -> Iterator[np.ndarray]:
    """Running sums of daily terms, a date at a time."""
    for row in _vectors(ret):
        start = _add(np.zeros((2, len(row))) if start is None else start, row)
        yield start


def _month_total(month: pa.Table) -> pa.Table:
    *_, total = _sums(_matrix(month.sort_by("idx").column("ret")))
    return pa.table({"month": month.column("month").slice(0, 1), "total": pa.array([total.tobytes()])})


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum of all earlier months, for months in order: one vector in memory."""
    total = None
    for batch in batches:
        out = []
        for one in batch.column("total").to_pylist():
            one = np.frombuffer(one).reshape(2, -1)
            total = np.zeros_like(one) if total is None else total
            out.append(total.tobytes())
            total = _add(total, one[0])
            total[1] += one[1]
        yield pa.record_batch([batch.column("month"), pa.array(out, pa.binary())], names=["month", "base"])


def _prefixes(month: pa.Table, wanted: pa.Table) -> pa.Table:
    """Running sums at the wanted dates of a month."""
    found = []
    if len(month) and len(wanted):
        month = month.sort_by("idx")
        dates, base = set(wanted.column("idx").to_pylist()), np.frombuffer(wanted.column("base")[0].as_py()).reshape(2, -1)
        sums = zip(month.column("idx").to_pylist(), _sums(_matrix(month.column("ret")), base), strict=True)
        found = [(idx, now.tobytes()) for idx, now in sums if idx in dates]
    return pa.table({"idx": pa.array([x for x, _ in found], pa.int32()), "sums": pa.array([x for _, x in found], pa.binary())})


def _finish(p: int, trading_days: int):
    names = ("as_of", "status", "n_dates", "n_days", "shrinkage", "mu", "sigma")
    i, j = np.triu_indices(p)

    def one(hi: bytes, lo: bytes, here: list[bool]):
        v, rest = np.frombuffer(hi).reshape(2, -1) - np.frombuffer(lo).reshape(2, -1)
        v = v + rest
        at = np.flatnonzero(here)
        n, v = round(v[0]), v[1:]
        s1, tri, v = v[:p], v[p: p + len(i)], v[p + len(i):]
        ss, sr, infinite = v[0], v[1: 1 + p], v[1 + p:]
        if n < 1:
            return "no_complete_date", n, None, None, None
        if infinite[at].any():
            return "infinite_return", n, None, None, None
        s2 = np.zeros((p, p))
        s2[i, j] = s2[j, i] = tri
        mean = s1[at] / n
        second, m2 = s2[np.ix_(at, at)], mean @ mean
        cov = second / n - np.outer(mean, mean)
        # sum of |x|^4 of centred returns, |x|^2 = s - 2 m'r + m'm
        q4 = ss + 4 * mean @ second @ mean + n * m2 * m2 - 4 * mean @ sr[at] + 2 * m2 * np.trace(second) - 4 * m2 * (mean @ s1[at])
        k, shrunk = shrink_covariance(cov, q4, n)
        mu, sigma = np.zeros(p), np.zeros((p, p))
        mu[at] = trading_days * mean
        sigma[np.ix_(at, at)] = trading_days * shrunk
        return "ok", n, k, mu.tolist(), sigma.tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                done = one(row["hi"], row["lo"], row["present"]) if row["hi"] is not None and row["lo"] is not None else ("no_complete_date", 0, None, None, None)
                status = "insufficient_history" if row["short"] else done[0]
                rest = done[2:] if status == "ok" else (None, None, None)
                values = (row["as_of"], status, row["n_dates"], done[1], *rest)
                kinds = (batch.schema.field("as_of").type, pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.list_(pa.float64())))
                yield pa.record_batch([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=list(names))

    return run


def market_history(
    prices: DataFrame,
    as_ofs: DataFrame,
    universe=C.UNIVERSE,
    days: int = C.HISTORY_DAYS,
    trading_days: int = C.TRADING_DAYS,
    minimum: int = C.MIN_HISTORY_DATES,
) -> DataFrame:
    """The snapshots (columns of ``market_snapshots``) of the windows ``(as_of - days, as_of]`` of all dates of ``as_ofs``.

    A date without a price row in its window has no snapshot.
    """
    p = len(universe)
    panel = materialize(daily_returns(prices, universe))  # one row a date: the prices are read once
    month = F.trunc("date", "month")
    dates = panel.where("idx > 0").agg(F.array_sort(F.collect_list("date"))).scalar()

    def last_upto(day: Column) -> Column:
        return lower_bound(F.col("dates"), F.date_add(day, 1), DATE_STEPS)

    start = F.date_sub("as_of", days)
    windows = as_ofs.select("as_of").where("as_of IS NOT NULL").distinct().withColumn("dates", dates)
    windows = windows.select("as_of", last_upto(F.col("as_of")).alias("b"), last_upto(start).alias("a")).where("b > a")
    ends = panel.select(F.col("idx").alias("b"), "last_row")
    starts = panel.select(F.col("idx").alias("a"), "next_price")
    windows = windows.join(ends, "b").join(starts, "a")
    present = F.transform("last_row", lambda d: F.coalesce(d > F.date_sub("as_of", days), F.lit(False)))
    windows = windows.withColumn("present", present)
    firsts = F.filter(F.transform(F.arrays_zip("present", "next_price"), lambda x: F.when(x["present"], F.struct(x["next_price"].alias("d")))), lambda x: x.isNotNull())
    settled = F.when(F.forall(firsts, lambda x: x["d"].isNotNull()), F.array_max(F.transform(firsts, lambda x: x["d"])))
    windows = windows.withColumn("settled", settled)
    windows = windows.withColumn("dates", dates).select(
        "as_of", "a", "b", "present", (F.col("b") - F.col("a")).cast("long").alias("n_dates"),
        F.when(F.col("settled") <= F.col("as_of"), last_upto(F.col("settled"))).alias("f"))

    rows = panel.where("idx > 0").select(month.alias("month"), "idx", "ret")
    totals = rows.groupBy("month").applyInArrow(_month_total, "month date, total binary")
    bases = totals.repartition(1).sortWithinPartitions("month").mapInArrow(_running, "month date, base binary")  # one row a month
    wanted = windows.select(F.explode(F.array("b", "f")).alias("idx")).where("idx IS NOT NULL").distinct()
    wanted = wanted.join(panel.select("idx", month.alias("month")), "idx").join(bases, "month").select("month", "idx", "base")
    sums = rows.groupBy("month").cogroup(wanted.groupBy("month")).applyInArrow(_prefixes, "idx int, sums binary")
    hi, lo = (sums.select(F.col("idx").alias(k), F.col("sums").alias(name)) for k, name in (("b", "hi"), ("f", "lo")))
    moments = windows.join(hi, "b", "left").join(lo, "f", "left").select(
        "as_of", "n_dates", (F.col("n_dates") < minimum).alias("short"), "present", "hi", "lo")
    schema = "as_of date, status string, n_dates long, n_days long, shrinkage double, mu array<double>, sigma array<array<double>>"
    return moments.mapInArrow(_finish(p, trading_days), schema)


def latest_as_of(prices: DataFrame) -> DataFrame:
    """The newest date of the prices, as the one date of a snapshot."""
    return prices.agg(F.max("date").alias("as_of"))
