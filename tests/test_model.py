from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.sql import functions as F

from portrisk import config as C
from portrisk.operators import explain, metrics, segments, split
from portrisk.operators.boosting import MonotoneGBTClassifier, MonotoneGBTModel, best_splits


def sample(spark, n=1500, seed=7):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.uniform(1e3, 2e5, n), rng.uniform(0, 2, n), rng.uniform(0, 1, n), rng.uniform(0, 1.5, n)])
    z = -4 * (x[:, 1] - 0.7) + 4.5 * (x[:, 2] - 0.5) + 3 * (x[:, 3] - 0.6) - 0.5 * (x[:, 0] / 5e4 - 1.5)
    y = rng.random(n) < 1 / (1 + np.exp(-z))
    c = rng.integers(0, 3, n)
    rows = [(i, [*map(float, r), *[float(k == q) for q in range(3)]], int(t), i % 5 == 0) for i, (r, t, k) in enumerate(zip(x, y, c))]
    return spark.createDataFrame(rows, "client_id long, features array<double>, churn int, held boolean").coalesce(1).persist()


@pytest.fixture(scope="module")
def fitted(spark):
    df = sample(spark)
    return df, MonotoneGBTClassifier(rounds=25, eta=0.15, validationCol="held", seed=3).fit(df)


def test_quality_and_early_stopping(fitted):
    df, model = fitted
    auc = metrics.roc_auc(model.score(df.where("held"))).first()[0]
    losses = model.getOrDefault(model.losses)
    assert auc > 0.85 and losses[-1] < losses[0] and model.n_trees == int(np.argmin(losses))
    logged = metrics.log_loss(model.score(df.where("held"))).first()[0]
    assert abs(logged - min(losses)) < 1e-9


def test_monotone(spark, fitted):
    df, model = fitted
    base = df.limit(40)
    for i, sign in enumerate(C.MONOTONE_SIGNS[:4]):
        top = 2e5 if i == 0 else 2.0
        grid = F.explode(F.array(*[F.lit(top * k / 12) for k in range(13)])).alias("v")
        rows = base.select("client_id", "features", grid).withColumn(
            "features", F.transform("features", lambda a, k: F.when(k == i, F.col("v")).otherwise(a))
        )
        pdf = model.score(rows).select("client_id", "v", "margin").toPandas().sort_values(["client_id", "v"])
        steps = pdf.groupby("client_id").margin.diff().dropna()
        assert (sign * steps >= -1e-12).all() and (steps != 0).any()


def expectation(tree, x, known, node=0):
    f = tree["feature"][node]
    if f < 0:
        return tree["value"][node]
    l, r = 2 * node + 1, 2 * node + 2
    if f in known:
        return expectation(tree, x, known, r if x[f] >= tree["threshold"][node] else l)
    cover = tree["cover"]
    return (cover[l] * expectation(tree, x, known, l) + cover[r] * expectation(tree, x, known, r)) / cover[node]


def test_contributions_match_brute_force(fitted):
    df, model = fitted
    trees, n = model.tree_list(), 7
    rows = model.score(df.limit(6), explain=True).collect()
    for row in rows:
        x = row.features
        for i in range(n):
            others = [j for j in range(n) if j != i]
            phi = 0.0
            for size in range(n):
                w = factorial(size) * factorial(n - size - 1) / factorial(n)
                for s in combinations(others, size):
                    phi += w * sum(expectation(t, x, {*s, i}) - expectation(t, x, set(s)) for t in trees)
            assert abs(phi - row.contributions[i]) < 1e-9
        assert abs(sum(row.contributions) + row.base_value - row.margin) < 1e-9


def test_persistence(spark, fitted, tmp_path):
    df, model = fitted
    path = str(tmp_path / "m")
    model.write().overwrite().save(path)
    again = MonotoneGBTModel.load(path)
    a = {r.client_id: r.margin for r in model.score(df).collect()}
    b = {r.client_id: r.margin for r in again.score(df).collect()}
    assert a == b


def test_training_is_repeatable(spark, fitted):
    df, model = fitted
    again = MonotoneGBTClassifier(rounds=25, eta=0.15, validationCol="held", seed=3).fit(df.repartition(5))
    assert again.tree_list() == model.tree_list()


def test_one_class_is_refused(spark):
    df = sample(spark, 50).withColumn("churn", F.lit(1))
    with pytest.raises(ValueError):
        MonotoneGBTClassifier(rounds=2).fit(df)


def test_split_gain_by_hand():
    g = np.array([[[-3.0, 5.0, 0.0]]])
    h = np.array([[[10.0, 20.0, 0.0]]])
    args = (np.array([-np.inf]), np.array([np.inf]), np.array([1]), np.array([True]), 1.5, 5.0)
    gain, f, b, wl, wr, hl, hr, total = best_splits((g, h), *args)
    assert not np.isfinite(gain[0])  # 3/11.5 > -5/21.5 breaks the rising sign
    gain, f, b, wl, wr, *_ = best_splits((g, h), *args[:2], np.array([-1]), *args[3:])
    assert np.isclose(gain[0], 9 / 11.5 + 25 / 21.5 - 4 / 31.5) and np.isclose(wl[0], 3 / 11.5) and np.isclose(wr[0], -5 / 21.5)


@pytest.mark.parametrize(
    "values, expected",
    [
        ([0.5, 0.3, -0.9, 0.1], ["a", "b"]),
        ([0.2, -0.1, -0.9, 0.0], ["a", "c"]),
        ([-0.2, -0.1, -0.9, 0.0], ["c", "a"]),
        ([0.3, 0.3, 0.3, 0.0], ["a", "b"]),
    ],
)
def test_risk_drivers(spark, values, expected):
    df = spark.createDataFrame([(values,)], "v array<double>")
    assert df.select(explain.risk_drivers(F.col("v"), list("abcd"))).first()[0] == expected


def test_driver_texts(spark):
    df = spark.createDataFrame([(["cluster_1", "height"],)], "n array<string>")
    assert df.select(explain.driver_texts(F.col("n"))).first()[0] == [C.REASONS["cluster_1"], "Feature 'height'"]


def test_auc_and_report_against_brute_force(spark):
    rng = np.random.default_rng(2)
    y, p = rng.integers(0, 2, 700), rng.random(700).round(2)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, p)], "churn int, churn_probability double")
    a, b = p[y == 1], p[y == 0]
    want = (a[:, None] > b[None]).mean() + 0.5 * (a[:, None] == b[None]).mean()
    assert abs(metrics.roc_auc(df).first()[0] - want) < 1e-12
    assert metrics.roc_auc(df.where("churn = 1")).first()[0] is None
    rep = {r["class"]: r for r in metrics.classification_report(df).collect()}
    tp, fp, fn = ((p >= 0.5) & (y == 1)).sum(), ((p >= 0.5) & (y == 0)).sum(), ((p < 0.5) & (y == 1)).sum()
    assert np.isclose(rep["Churn"].precision, tp / (tp + fp)) and np.isclose(rep["Churn"].recall, tp / (tp + fn))
    never = metrics.classification_report(df.withColumn("churn_probability", F.lit(0.0))).collect()
    assert never[1].precision == 0 and never[1].f1_score == 0


@pytest.mark.parametrize("n, every", [(101, 3), (250, 7), (10, 2)])
def test_split_sizes(spark, n, every):
    df = spark.range(n).select(F.col("id").alias("client_id"), (F.col("id") % every == 0).cast("int").alias("churn"))
    parts = split.stratified_parts(df).toPandas()
    assert len(parts) == n and parts.client_id.nunique() == n
    n_test = -(-n // 5)
    assert (parts.part == "test").sum() == n_test and (parts.part == "valid").sum() == -(-(n - n_test) // 5)
    rate = df.toPandas().churn.mean()
    test = parts[parts.part == "test"]
    assert abs(test.churn.sum() - rate * len(test)) <= 1.0 + 1e-9
    again = split.stratified_parts(df.repartition(7), buckets=4).toPandas()
    assert dict(zip(parts.client_id, parts.part)) == dict(zip(again.client_id, again.part))


def test_split_keeps_rows_without_id(spark):
    df = spark.range(50).select(F.when(F.col("id") > 20, F.col("id")).alias("client_id"), (F.col("id") % 2).cast("int").alias("churn"), "id")
    assert split.stratified_parts(df).count() == 50


def test_kmeans_finds_blobs(spark):
    rng = np.random.default_rng(4)
    centers = np.array([[0, 0, 0], [5, 5, 0], [-5, 4, 3]])
    x = np.concatenate([rng.normal(c, 0.2, (80, 3)) for c in centers])
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "x0 double, x1 double, x2 double")
    got, cost = segments.fit_kmeans(df, ["x0", "x1", "x2"], restarts=5)
    assert all(np.abs(got - c).sum(1).min() < 0.3 for c in centers) and cost < 80 * 3 * 3 * 0.06


def test_profiles(spark):
    two = spark.createDataFrame([(0, 5.0), (1, 9.0)], "cluster_id int, avg_holding_days double")
    with pytest.raises(ValueError):
        segments.ProfileResolver().fit(two)
    with pytest.raises(Exception, match="expected exactly 3"):
        segments.profile_map(segments.cluster_holding(two)).collect()
    with pytest.raises(RuntimeError):
        segments.ProfileResolverModel().mapping()
    three = two.union(spark.createDataFrame([(2, 1.0)], two.schema))
    model = segments.ProfileResolver().fit(three)
    assert model.mapping() == {2: "aggressive", 0: "balanced", 1: "conservative"}
    odd = spark.createDataFrame([(7,)], "cluster_id int")
    assert model.transform(odd).first().profile == "balanced"


def test_nearest_first_wins(spark):
    df = spark.createDataFrame([(0.0,), (2.0,)], "x double")
    got = [r[0] for r in df.select(segments.nearest([F.col("x")], [[-1.0], [1.0], [3.0]])).collect()]
    assert got == [0, 1]


def test_kmeans_finds_blobs_of_repeated_rows(spark):
    import numpy as np
    from pyspark.sql import functions as F

    from portrisk.operators.segments import fit_kmeans

    points = [(10.0 * b + dx, 5.0 * b + dy) for b in range(3) for dx, dy in ((0.0, 0.0), (0.5, 0.0), (0.0, 0.5), (0.5, 0.5))]
    rows = spark.createDataFrame(points, "x double, y double").withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(2500)))).drop("copy")
    centers, inertia = fit_kmeans(rows, ["x", "y"], k=3)
    best = sum(((np.array(points[4 * b: 4 * b + 4]) - np.mean(points[4 * b: 4 * b + 4], axis=0)) ** 2).sum() for b in range(3)) * 2500
    assert abs(inertia - best) < 1e-6 * best and len(np.unique(centers.round(3), axis=0)) == 3


def test_sibling_histograms_give_the_same_trees(spark, labelled, monkeypatch):
    """With subtraction, without, and with all blocks on disk."""
    import json

    import numpy as np
    from pyspark import StorageLevel
    from pyspark.sql import functions as F

    from portrisk import config as C
    from portrisk.operators import boosting

    rows = labelled.withColumn("features", F.array(*[F.col(c).cast("double") for c in (*C.CHURN_FEATURES, *C.CLUSTER_FEATURES)])).persist()
    fit = lambda: boosting.MonotoneGBTClassifier(rounds=12, subsample=0.9).fit(rows).tree_list()
    fast = fit()
    monkeypatch.setattr(boosting.MonotoneGBTClassifier, "siblings", False)
    plain = fit()
    monkeypatch.setattr(boosting, "STORAGE", StorageLevel.DISK_ONLY)
    disk = fit()
    assert len(fast) == 12 and json.dumps(plain) == json.dumps(disk)
    for a, b in zip(fast, plain):
        assert a["feature"] == b["feature"] and a["threshold"] == b["threshold"]
        assert np.allclose(a["value"], b["value"], atol=1e-9) and np.allclose(a["cover"], b["cover"], atol=1e-6)
    rows.unpersist()


def test_split_of_repeated_and_missing_keys(spark):
    from pyspark.sql import functions as F

    from portrisk.operators import split

    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 50 == 1, None).otherwise(F.col("id")).alias("client_id"), F.col("id").alias("n"),
        (F.col("id") % 5 == 0).cast("int").alias("churn"))
    parts = split.stratified_parts(rows, buckets=64)
    counts = {(r.churn, r.part): r["count"] for r in parts.groupBy("churn", "part").count().collect()}
    assert sum(counts.values()) == 3000 and parts.select("n").distinct().count() == 3000
    assert counts[0, "test"] + counts[1, "test"] == 600 and counts[1, "test"] == 120 and counts[0, "valid"] + counts[1, "valid"] == 480
    assert "materialize" not in parts.columns and parts.columns == ["client_id", "n", "churn", "part"]
    plan = parts._jdf.queryExecution().optimizedPlan().toString()
    assert "Range" not in plan  # the source is read once, when the tagged rows are written


def test_margins_along_a_grid_are_those_of_moved_rows():
    import numpy as np

    from portrisk.operators import explain

    rng = np.random.default_rng(8)
    trees = []
    for depth in (4, 4, 2, 0):
        f = np.full(31, -1)
        f[: 2**depth - 1] = rng.integers(0, 3, 2**depth - 1)
        f[2] = -1  # a leaf above the last level
        trees.append({"feature": f, "threshold": rng.normal(size=31), "value": rng.normal(size=31), "cover": np.ones(31)})
    ensemble = explain.ensemble_tables(trees, 3, 4, False)
    x = rng.normal(size=(500, 3))
    x[7, 1] = np.nan
    moves = [(0, -1.0), (0, 0.0), (0, trees[0]["threshold"][0]), (2, 0.3), (2, 9.0)]
    got = explain.margins_along(x, ensemble, 3, moves)
    for j, (f, v) in enumerate(moves):
        moved = x.copy()
        moved[:, f] = v
        assert np.array_equal(got[j], explain.score_batch(moved, ensemble, 3, False)[:, -1])


def test_one_vector_of_a_pass_reaches_the_driver(spark):
    import numpy as np

    from portrisk.operators import blocks

    sc = spark.sparkContext
    for n in (1, 9, 70):
        sc.setJobGroup(f"vectors-{n}", "")
        got = blocks.sum_partitions(sc.parallelize(range(n), n), lambda it: np.full(5, float(sum(it))))
        sc.setJobGroup("none", "")
        assert got.tolist() == [n * (n - 1) / 2] * 5
        for job in sc.statusTracker().getJobIdsForGroup(f"vectors-{n}"):
            stages = sc.statusTracker().getJobInfo(job).stageIds
            assert sc.statusTracker().getStageInfo(max(stages)).numTasks == 1


def test_blocks_dealt_out_give_the_same_trees(spark, labelled, monkeypatch):
    import numpy as np
    from pyspark.sql import functions as F

    from portrisk import config as C
    from portrisk.operators import boosting

    rows = labelled.withColumn("features", F.array(*[F.col(c).cast("double") for c in (*C.CHURN_FEATURES, *C.CLUSTER_FEATURES)]))
    fit = lambda: boosting.MonotoneGBTClassifier(rounds=6).fit(rows).tree_list()
    tasks = []
    sums = boosting.sum_partitions
    monkeypatch.setattr(boosting, "sum_partitions", lambda rdd, f: tasks.append(rdd.getNumPartitions()) or sums(rdd, f))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")  # blocks of 100 cells
    try:
        whole = fit()
        assert set(tasks) == {1}
        monkeypatch.setattr(boosting, "CELLS_PER_TASK", 100)
        tasks.clear()
        dealt = fit()
        assert set(tasks) == {4}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for a, b in zip(whole, dealt, strict=True):
        assert a["feature"] == b["feature"] and a["threshold"] == b["threshold"] and np.allclose(a["value"], b["value"], atol=1e-9)
