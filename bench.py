"""Headline timings at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is run to a no-op sink after one untimed warm-up of the session, so
times include planning and the scan of the source tables.
"""

from __future__ import annotations

import json
import os
import time

from portrisk.catalog import queries as catalog
from portrisk.session import local_session

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

# The model queries come after train_model and reuse its model, as scoring jobs do.
QUERIES = (
    "client_features", "rejected_clients", "asset_bounds", "market_cov", "asof_market_snapshot",
    "drift_ks", "drift_ks_by_cluster", "roc_auc", "stratified_split", "classification_report",
    "portfolio_optimality", "allocation_breakdown", "risk_drivers",
    "train_model", "churn_scores", "shap_values", "predict_and_explain", "client_allocations", "monotonicity_audit",
)


def main() -> None:
    spark = local_session(CPUS, **{"spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    catalog.client_features(spark, FOLDER).limit(1).collect()
    times, rows = {}, {}
    for name in QUERIES:
        start = time.perf_counter()
        if name == "train_model":
            result = catalog.trained(spark, FOLDER)
            rows[name] = result.model.classifier.n_trees
        else:
            catalog.ALL[name](spark, FOLDER).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_query_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(FOLDER.rstrip("/")).removeprefix("sf"),
                "cpus": CPUS,
                "trees": rows.get("train_model"),
                "auc": round(catalog.trained(spark, FOLDER).auc, 6),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
