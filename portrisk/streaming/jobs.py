"""Structured Streaming jobs: market refresh, drift watch, client scoring.

Batch outputs are written per micro-batch id with overwrite, so a replayed
micro-batch replaces its own output and nothing is counted twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from portrisk import config as C
from portrisk.operators.asof import latest_window
from portrisk.operators.contracts import rejected_clients, valid_clients, with_violations
from portrisk.operators.drift import finish_drift, ks_against, retrain_decision
from portrisk.operators.market import market_snapshots, pd_repair
from portrisk.plans.scoring import predict_and_explain
from portrisk.session import materialize
from portrisk.sources.artifacts import ChurnModel


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


# --- market refresh --------------------------------------------------------------
def daily_closes(ticks: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Tick stream (ts, ticker, price) to one close per ticker and finished day."""
    return (
        ticks.withWatermark("ts", lateness)
        .groupBy(F.window("ts", "1 day"), "ticker")
        .agg(F.max_by("price", F.struct("ts", "price")).alias("close"))
        .select(F.to_date("window.start").alias("date"), "ticker", "close")
    )


def market_refresh(
    ticks: DataFrame, closes_path: str, snapshots_path: str, universe=C.UNIVERSE, lateness: str = "1 day"
) -> DataStreamWriter:
    """Append finished closes, then a snapshot of the last year.

    A refresh whose status is not ``ok`` writes no snapshot row, so readers keep the
    previous one.  Start it with ``trigger(processingTime=SNAPSHOT_TTL)``, or with
    ``availableNow`` from a scheduler.
    """

    def refresh(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return  # no day was finished: no folder
        batch.write.mode("overwrite").partitionBy("year").parquet(f"{closes_path}/batch={batch_id}")
        # The window touches two calendar years at most; other years' files are not listed as input.
        newest = batch.agg(F.max("date")).first()[0]
        closes = batch.sparkSession.read.schema(batch.schema).option("basePath", closes_path).parquet(f"{closes_path}/batch=*")
        recent = closes.where(F.col("year") >= newest.year - 1)
        fresh = pd_repair(market_snapshots(latest_window(recent.select("date", "ticker", "close")), universe)).where("status = 'ok'")
        write_batch(fresh, snapshots_path, batch_id)

    return daily_closes(ticks, lateness).withColumn("year", F.year("date")).writeStream.outputMode("append").foreachBatch(refresh)


# --- drift watch -----------------------------------------------------------------
def windowed_counts(clients: DataFrame, window: str, lateness: str, features) -> DataFrame:
    """(window, feature, value, n_cur) of finished windows; state holds distinct values."""
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])
    return (
        clients.withWatermark("event_time", lateness)
        .select("event_time", F.explode(cells).alias("x"))
        .select("event_time", "x.feature", "x.value")
        .where(F.col("value").isNotNull() & ~F.isnan("value"))
        .groupBy(F.window("event_time", window), "feature", "value")
        .agg(F.count(F.lit(1)).alias("n_cur"))
        .select(F.col("window.start").alias("window_start"), "feature", "value", "n_cur")
    )


def drift_watch(
    clients: DataFrame,
    reference: DataFrame,
    drift_path: str,
    requests_path: str,
    window: str = "1 day",
    lateness: str = "1 hour",
    features=C.MONITORED_FEATURES,
    threshold: float = C.DRIFT_P_VALUE,
) -> DataStreamWriter:
    """Test every finished window against the reference; append drift rows and retrain requests.

    All counts of a window leave the state in one micro-batch, so a window is tested
    exactly once and whole. All windows of a batch are ranked in one pass over the reference's values.
    """
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])
    reference_counts = (
        reference.select(F.explode(cells).alias("x"))
        .select("x.feature", "x.value")
        .where(F.col("value").isNotNull() & ~F.isnan("value"))
        .groupBy("feature", "value")
        .agg(F.count(F.lit(1)).alias("n_ref"))
    )
    reference_counts = materialize(reference_counts)  # read by every batch of a stream that may run for months
    sizes = materialize(reference_counts.groupBy("feature").agg(F.sum("n_ref").alias("all_ref")))

    def test(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        batch.persist()
        windows = batch.select("window_start").distinct()
        names = F.explode(F.array(*[F.lit(f) for f in features])).alias("feature")
        every = windows.select("window_start", names).join(sizes, "feature", "left")
        found = ks_against(reference_counts, batch, ["window_start"]).drop("n_ref")
        stats = every.join(found, ["window_start", "feature"], "left").withColumnRenamed("all_ref", "n_ref").fillna(0, ["n_ref", "n_cur"])
        results = finish_drift(stats, ["window_start"], threshold, C.MIN_DRIFT_SAMPLE, "asymptotic").persist()
        write_batch(results, drift_path, batch_id)
        decisions = retrain_decision(results, ["window_start"]).where("retrain")
        write_batch(decisions, requests_path, batch_id)
        results.unpersist()
        batch.unpersist()

    return windowed_counts(clients, window, lateness, features).writeStream.outputMode("append").foreachBatch(test)


# --- scoring ---------------------------------------------------------------------
def score_stream(
    requests: DataFrame, model: ChurnModel, scores_path: str, rejects_path: str, lateness: str = "1 hour"
) -> DataStreamWriter:
    """Requests (client columns, event_time) to explained scores and a reject table.

    Repeats of (client_id, event_time) inside the watermark are dropped; a request
    without an id counts as a repeat only if every field is equal.  The model's tables are broadcast once, with the
    first batch; call ``model.classifier.close()`` after the stream has ended.
    """
    fields = [c for c in requests.columns if c != "event_time"]
    key = F.coalesce(F.col("client_id").cast("string"), F.to_json(F.struct(*fields)))
    unique = (
        requests.withWatermark("event_time", lateness)
        .withColumn("_key", key)
        .dropDuplicatesWithinWatermark(["_key", "event_time"])
        .drop("_key")
    )

    def score(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        checked = with_violations(batch).persist()
        write_batch(predict_and_explain(valid_clients(checked), model), scores_path, batch_id)
        write_batch(rejected_clients(checked), rejects_path, batch_id)
        checked.unpersist()

    return unique.writeStream.outputMode("append").foreachBatch(score)
