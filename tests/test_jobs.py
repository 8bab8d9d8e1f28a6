import pytest
from pyspark.sql import functions as F

from portrisk import config as C
from portrisk.operators import asof, market
from portrisk.plans import audit, retrain, scoring, training
from portrisk.sources import artifacts, bridge

QUICK = {"rounds": 8, "eta": 0.2}


@pytest.fixture(scope="module")
def stored(spark, labelled, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("artifacts"))
    return root, training.run_training(labelled, root, **QUICK)


def test_training_writes_everything(spark, labelled, stored):
    root, result = stored
    assert 0.5 < result.auc <= 1 and result.report.count() == 5
    meta = artifacts.load_meta(spark, root)
    assert meta["feature_names"] == list(C.MODEL_FEATURES) and meta["n_features"] == 7
    assert meta["val_auc"] == round(result.auc, 6)
    log = artifacts.read_log(spark, root).collect()
    assert len(log) == 1 and log[0].auc_roc == round(result.auc, 4)
    assert artifacts.load_reference(spark, root).count() == labelled.count()


def test_loaded_model_scores_alike(spark, labelled, stored):
    root, result = stored
    model = artifacts.load_model(spark, root)
    a = scoring.predict_clients(labelled, result.model).select("client_id", "profile", "churn_probability")
    b = scoring.predict_clients(labelled, model).select("client_id", "profile", "churn_probability")
    assert a.exceptAll(b).count() == 0 and b.count() == labelled.count()


def test_missing_artifacts(spark, tmp_path):
    root = str(tmp_path / "none")
    assert artifacts.load_meta(spark, root) == {}
    assert artifacts.read_log(spark, root).count() == 0
    assert artifacts.load_reference(spark, root) is None
    with pytest.raises(FileNotFoundError, match="run the training job"):
        artifacts.load_model(spark, root)


def test_explained_predictions(labelled, stored):
    out = scoring.predict_and_explain(labelled, stored[1].model).collect()
    assert len(out) == labelled.count()
    for r in out:
        assert 0 <= r.churn_probability <= 1 and len(set(r.risk_drivers)) == 2
        assert set(r.risk_drivers) <= set(C.REASONS.values())
        assert r.model_version.endswith(f"(trained {stored[1].model.trained_at[:10]})")


def test_audit_is_clean(labelled, stored):
    for r in audit.monotonicity_audit(labelled, stored[1].model).collect():
        assert r.n_violations == 0 and r.n_pairs == 4 * labelled.count()


def test_allocation_report(spark, folder, labelled, stored):
    snap = market.latest_snapshot(market.market_snapshots(asof.latest_window(bridge.prices(spark, folder)), bridge.BRIDGE_UNIVERSE))
    scored = scoring.predict_clients(labelled, stored[1].model)
    flagged = scored.where("churn_probability > 0.5").count()
    rows = scoring.allocation_report(labelled, stored[1].model, snap)
    sums = rows.groupBy("client_id").agg(F.sum("weight").alias("w")).collect()
    assert len(sums) == flagged and all(abs(r.w - 1) < 1e-6 for r in sums)


def test_drift_gated_retraining(spark, labelled, stored):
    root, first = stored
    calm = retrain.check_and_retrain(labelled, labelled, root, **QUICK)
    assert not calm.retrained and calm.drift.count() == 4
    moved = labelled.withColumn("account_balance", F.col("account_balance") * 3)
    hot = retrain.check_and_retrain(moved, moved, root, **QUICK)
    assert hot.retrained and artifacts.read_log(spark, root).count() == 2
    assert artifacts.load_model(spark, root).trained_at > first.model.trained_at
    newest = artifacts.load_reference(spark, root).agg(F.max("account_balance")).first()[0]
    assert newest == moved.agg(F.max("account_balance")).first()[0]
