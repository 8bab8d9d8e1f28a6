import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from portrisk import config as C
from portrisk.operators import asof, contracts, drift, market
from portrisk.plans import scoring, training
from portrisk.streaming import jobs

T0 = dt.datetime(2024, 1, 1)


def run(writer, checkpoint):
    q = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    assert q.exception() is None


def stream(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_market_refresh_replays_to_the_batch_result(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = []
    for a in C.UNIVERSE:
        p = 100.0
        for i in range(80):
            for h in (9, 16):
                p *= 1 + rng.normal(0, 0.01)
                rows.append((T0 + dt.timedelta(days=i, hours=h), a.ticker, p))
    ticks = spark.createDataFrame(rows, "ts timestamp, ticker string, price double")
    src = str(tmp_path / "ticks")
    for lo, hi in ((0, 60), (60, 78), (78, 80)):
        part = ticks.where((F.col("ts") >= T0 + dt.timedelta(days=lo)) & (F.col("ts") < T0 + dt.timedelta(days=hi)))
        part.coalesce(1).write.mode("append").parquet(src)
    closes, snaps = str(tmp_path / "closes"), str(tmp_path / "snaps")
    run(jobs.market_refresh(stream(spark, src, ticks.schema), closes, snaps), str(tmp_path / "ck"))
    daily = ticks.groupBy(F.to_date("ts").alias("date"), "ticker").agg(F.max_by("price", "ts").alias("close"))
    seen = spark.read.parquet(closes).select("date", "ticker", "close")
    last = seen.agg(F.max("date")).first()[0]
    assert last >= dt.date(2024, 3, 17)
    assert daily.where(F.col("date") <= last).exceptAll(seen).count() == 0
    newest = spark.read.parquet(snaps).orderBy(F.desc("as_of")).first()
    want = market.market_snapshots(asof.latest_window(daily.where(F.col("date") <= last))).first()
    assert newest.as_of == want.as_of and np.allclose(newest.mu, want.mu)


def test_drift_watch_equals_batch(spark, labelled, tmp_path):
    base = labelled.select("client_id", *C.MONITORED_FEATURES)
    day1 = base.withColumn("event_time", F.lit(T0) + F.expr("make_interval(0,0,0,0,1)"))
    day2 = base.withColumn("account_balance", F.col("account_balance") * 2).withColumn("event_time", F.lit(T0) + F.expr("make_interval(0,0,0,1,1)"))
    flush = base.limit(5).withColumn("event_time", F.lit(T0) + F.expr("make_interval(0,0,0,9)"))
    src = str(tmp_path / "events")
    for part in (day1, day2, flush):
        part.coalesce(1).write.mode("append").parquet(src)
    out, asks = str(tmp_path / "drift"), str(tmp_path / "asks")
    run(jobs.drift_watch(stream(spark, src, day1.schema), base, out, asks), str(tmp_path / "ck"))
    got = {(r.window_start.day, r.feature_name): r for r in spark.read.parquet(out).collect()}
    assert len(got) == 8
    want = {r.feature_name: r for r in drift.drift_results(base, day2).collect()}
    for f in C.MONITORED_FEATURES:
        assert got[1, f].ks_statistic == 0 and not got[1, f].drift_detected
        assert abs(got[2, f].ks_statistic - want[f].ks_statistic) < 1e-12
        assert got[2, f].drift_detected == want[f].drift_detected
    assert [r.window_start.day for r in spark.read.parquet(asks).collect()] == [2]


@pytest.fixture(scope="module")
def model(labelled):
    return training.run_training(labelled, rounds=5, eta=0.2).model


def test_score_stream_equals_batch(spark, folder, model, tmp_path):
    from portrisk.sources import bridge

    raw = bridge.client_raw(spark, folder).withColumn("event_time", F.lit(T0) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("client_id") % 60))
    raw = raw.persist()
    src = str(tmp_path / "requests")
    raw.coalesce(1).write.mode("append").parquet(src)
    raw.where("client_id < 40").coalesce(1).write.mode("append").parquet(src)  # repeats
    good, bad = str(tmp_path / "good"), str(tmp_path / "bad")
    run(jobs.score_stream(stream(spark, src, raw.schema), model, good, bad), str(tmp_path / "ck"))
    got = {r.client_id: (r.churn_probability, tuple(r.risk_drivers)) for r in spark.read.parquet(good).collect()}
    want = scoring.predict_and_explain(contracts.valid_clients(raw), model).collect()
    assert spark.read.parquet(good).count() == len(want)
    assert got == {r.client_id: (r.churn_probability, tuple(r.risk_drivers)) for r in want}
    assert spark.read.parquet(bad).count() == contracts.rejected_clients(raw).count()


def test_scoring_broadcasts_once_for_many_batches(spark, folder, model, monkeypatch):
    """What 50 micro-batches do, without the stream around them."""
    from pyspark import SparkContext

    from portrisk.sources import bridge

    model.classifier.close()
    made = []
    real = SparkContext.broadcast
    monkeypatch.setattr(SparkContext, "broadcast", lambda self, value: made.append(1) or real(self, value))
    clients = bridge.clients(spark, folder)
    plans = [scoring.predict_and_explain(clients.where(F.col("client_id") % 50 == k), model) for k in range(50)]
    assert len(made) == 1
    want = {r.client_id: r.churn_probability for r in scoring.predict_and_explain(clients, model).collect()}
    assert {r.client_id: r.churn_probability for r in plans[7].collect()} == {k: v for k, v in want.items() if k % 50 == 7}
    shared = next(iter(model.classifier._scorers.values())).shared
    model.classifier.close()
    assert not model.classifier._scorers
    with pytest.raises(Exception):
        spark.sparkContext.parallelize([1]).map(lambda _: shared.value).collect()
    plain = {r.client_id: round(r.churn_probability, 4) for r in scoring.predict_clients(clients, model).collect()}
    assert plain.keys() == want.keys() and all(abs(plain[k] - want[k]) < 1e-9 for k in plain)
    model.classifier.close()


def test_refresh_writes_no_folder_for_an_empty_batch(spark, tmp_path):
    import os

    ticks = spark.createDataFrame([(T0 + dt.timedelta(hours=h), "KO", 1.0 + h) for h in range(5)], "ts timestamp, ticker string, price double")
    src = str(tmp_path / "ticks")
    ticks.coalesce(1).write.parquet(src)  # no day is finished
    run(jobs.market_refresh(stream(spark, src, ticks.schema), str(tmp_path / "closes"), str(tmp_path / "snaps")), str(tmp_path / "ck"))
    assert not os.path.exists(str(tmp_path / "closes")) and not os.path.exists(str(tmp_path / "snaps"))
