import math
from itertools import combinations

import numpy as np
import pytest

from portrisk.operators import drift


def brute_p(n, m, d):
    lcm = n * m // math.gcd(n, m)
    h, out, total = round(d * lcm), 0, 0
    for c in combinations(range(n + m), n):
        s, i, j, top = set(c), 0, 0, 0
        for k in range(n + m):
            i, j = (i + 1, j) if k in s else (i, j + 1)
            top = max(top, abs(i * (lcm // n) - j * (lcm // m)))
        total += 1
        out += top >= h
    return out / total


@pytest.mark.parametrize("n, m, d", [(5, 5, 0.6), (7, 5, 0.6), (6, 4, 0.5), (5, 7, 1.0), (6, 6, 1 / 6), (8, 3, 0.375)])
def test_exact_p_value(n, m, d):
    assert abs(drift.exact_p_value(d, n, m) - brute_p(n, m, d)) < 1e-12


def test_asymptotic_error_and_size(spark):
    """Within 0.02 of the exact value from 50 values a side on; the same formula for a billion a side."""
    cases = [(m, n, round(z * math.sqrt((m + n) / (m * n)) * math.lcm(m, n)) / math.lcm(m, n)) for m, n in ((50, 60), (120, 700), (500, 3000)) for z in (0.5, 0.8, 1.0, 1.36, 1.63, 2.0)]
    df = spark.createDataFrame([("x", m, n, d) for m, n, d in cases], "feature string, n_ref long, n_cur long, ks_statistic double")
    for r in drift.finish_drift(df, [], 0.05, 5, "asymptotic").collect():
        assert abs(r.p_value - drift.exact_p_value(r.ks_statistic, r.n_ref, r.n_cur)) < 0.02
    huge = spark.createDataFrame([("x", 10**9, 10**9, 1.36 / math.sqrt(5e8))], df.schema.names)
    r = drift.finish_drift(huge, [], 0.05, 5, "asymptotic").first()
    assert abs(r.p_value - 0.0495) < 5e-4 and r.drift_detected and r.p_method == "asymptotic"


def test_unknown_method(spark):
    with pytest.raises(ValueError, match="p_value"):
        drift.drift_results(frame(spark, range(9)), frame(spark, range(9)), ["x"], p_value="auto")


def d_numpy(a, b):
    v = np.unique(np.concatenate([a, b]))
    f = lambda x: np.searchsorted(np.sort(x), v, "right") / len(x)
    return np.abs(f(a) - f(b)).max()


def frame(spark, values):
    return spark.createDataFrame([(None if v is None else float(v),) for v in values], "x double")


def test_statistic_with_ties_and_a_hot_value(spark):
    rng = np.random.default_rng(3)
    a = np.where(rng.random(1500) < 0.35, 7.0, rng.normal(7, 3, 1500).round(1))
    b = rng.normal(7.4, 3, 900).round(1)
    r = drift.drift_results(frame(spark, a), frame(spark, b), ["x"], p_value="exact").first()
    assert abs(r.ks_statistic - d_numpy(a, b)) < 1e-12 and r.p_method == "exact"
    back = drift.drift_results(frame(spark, b), frame(spark, a), ["x"]).first()
    assert abs(back.ks_statistic - r.ks_statistic) < 1e-12


def test_edges(spark):
    same = drift.drift_results(frame(spark, range(9)), frame(spark, range(9)), ["x"]).first()
    assert same.ks_statistic == 0 and same.p_value == 1 and not same.drift_detected
    apart = drift.drift_results(frame(spark, range(9)), frame(spark, range(100, 109)), ["x"]).first()
    assert apart.ks_statistic == 1 and apart.drift_detected
    for values in ([1, 2, 3, 4], [None] * 9, [float("nan")] * 9 + [1, 2]):
        few = drift.drift_results(frame(spark, range(9)), frame(spark, values), ["x"]).first()
        assert few.p_value is None and few.ks_statistic is None and few.drift_detected is False
    five = drift.drift_results(frame(spark, range(9)), frame(spark, range(5)), ["x"]).first()
    assert five.p_value is not None


def test_keyed_equals_single(spark):
    rng = np.random.default_rng(5)
    rows = [(int(k), float(v)) for k, v in zip(rng.integers(0, 3, 900), rng.normal(0, 1, 900))]
    ref = spark.createDataFrame(rows[:500], "g int, x double")
    cur = spark.createDataFrame(rows[500:], "g int, x double")
    keyed = {r.g: r.ks_statistic for r in drift.drift_results(ref, cur, ["x"], ["g"]).collect()}
    for g in range(3):
        a = np.array([v for k, v in rows[:500] if k == g])
        b = np.array([v for k, v in rows[500:] if k == g])
        assert abs(keyed[g] - d_numpy(a, b)) < 1e-12


def test_retrain_threshold(spark):
    df = spark.createDataFrame([("a", False), ("b", True)], "feature_name string, drift_detected boolean")
    assert drift.retrain_decision(df).first().retrain
    assert not drift.retrain_decision(df, minimum=2).first().retrain
    assert not drift.retrain_decision(df.where("not drift_detected")).first().retrain


def segmented(spark, seed=4):
    """Three segments, one with nine tenths of the rows and one in a narrow range."""
    rng = np.random.default_rng(seed)
    rows = [("big", *rng.normal(0, 1, 2).round(3).tolist()) for _ in range(2700)] + [("thin", *rng.normal(0.1, 0.01, 2).round(4).tolist()) for _ in range(200)]
    rows += [("third", *rng.normal(1, 2, 2).round(2).tolist()) for _ in range(100)]
    return spark.createDataFrame(rows, "seg string, x double, y double")


@pytest.mark.parametrize("per_bucket", [1, 12, 1500, 10**6])  # from 4,096 buckets (the finest cut) down to one
def test_segmented_statistic_for_any_number_of_buckets(spark, per_bucket):
    ref, cur = segmented(spark), segmented(spark, 5).where("y < 1.5")
    counts = drift.value_counts(ref, cur, ["x", "y"], ["seg"])
    got = {(r.seg, r.feature): r for r in drift.ks_statistic(counts, ["seg"], per_bucket).collect()}
    one = drift.value_counts(ref, ref.limit(0), ["x", "y"]).select("feature", "value", "n_ref")
    many = drift.value_counts(cur.limit(0), cur, ["x", "y"], ["seg"]).select("seg", "feature", "value", "n_cur")
    against = {(r.seg, r.feature): r for r in drift.ks_against(one, many, ["seg"], per_bucket).collect()}
    a, b = ref.toPandas(), cur.toPandas()
    for seg in ("big", "thin", "third"):
        for f in ("x", "y"):
            mine, his = a[a.seg == seg][f].to_numpy(), b[b.seg == seg][f].to_numpy()
            r = got[seg, f]
            assert abs(r.ks_statistic - d_numpy(mine, his)) < 1e-12 and (r.n_ref, r.n_cur) == (len(mine), len(his))
            r = against[seg, f]
            assert abs(r.ks_statistic - d_numpy(a[f].to_numpy(), his)) < 1e-12 and (r.n_ref, r.n_cur) == (len(a), len(his))


def test_buckets_grow_with_the_distinct_values(spark):
    from pyspark.sql import functions as F

    from portrisk.operators import prefix

    for n, low, high in ((100, 1, 1), (5000, 5, 10), (200_000, 190, 260)):
        rows = spark.range(n).select(F.lit("f").alias("feature"), F.sin("id").alias("value"))
        sizes = [r["count"] for r in prefix.in_buckets(rows, ["feature"], 1000).groupBy("bucket").count().collect()]
        assert low <= len(sizes) <= high and max(sizes) < 2200 and sum(sizes) == n


def test_a_large_segment_is_dealt_out(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        counts = drift.value_counts(segmented(spark), segmented(spark, 5), ["x", "y"], ["seg"])
        plan = drift.ks_statistic(counts, ["seg"], 100)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    import re

    windows = re.findall(r"Window \[sum\(n_(?:ref|cur)#\d+L\) .*?\], \[(.*?)\], \[value", plan)
    assert windows and all(re.fullmatch(r"seg#\d+, feature#\d+, bucket#\d+", w) for w in windows)
    assert re.search(r"hashpartitioning\(seg#\d+, feature#\d+, bucket#\d+", plan)


def test_exact_p_value_of_large_samples():
    """Against the closed form of equal sizes; time and memory follow the band, not the product of the sizes."""
    import time

    n, begun = 400_000, time.time()
    for h in (600, 1100, 4000):
        log = [math.lgamma(n + 1) * 2 - math.lgamma(n - k * h + 1) - math.lgamma(n + k * h + 1) for k in range(1, 60) if k * h <= n]
        closed = 2 * sum((-1) ** k * math.exp(x) for k, x in enumerate(log))
        assert drift.exact_p_value(h / n, n, n) == pytest.approx(closed, rel=1e-7)
    assert drift.exact_p_value(0.05, 2_000_000, 1_999_999) == 0.0  # below any double
    assert time.time() - begun < 60


def test_exact_rows_are_dealt_out(spark):
    rows = spark.createDataFrame([("x", 50, 60, 0.2)], "feature string, n_ref long, n_cur long, ks_statistic double")
    plan = drift.finish_drift(rows, [], 0.05, 5, "exact")._jdf.queryExecution().executedPlan().toString()
    assert "RoundRobinPartitioning" in plan


def test_exact_p_value_of_uneven_samples():
    """Against the walk step by step."""
    for m, n, d in ((700, 311, 0.11), (150, 1201, 0.05), (400, 401, 0.2), (900, 7, 0.4)):
        lcm = math.lcm(m, n)
        h, alive = round(d * lcm), {0: 1.0}
        outside = 0.0
        for k in range(m + n):
            after = {}
            for j, x in alive.items():
                up = (n - j) / (m + n - k)
                for to, y in ((j, x * (1 - up)), (j + 1, x * up)):
                    after[to] = after.get(to, 0.0) + y
            alive = {j: x for j, x in after.items() if abs((k + 1 - j) * (lcm // m) - j * (lcm // n)) < h}
            outside += sum(x for j, x in after.items() if j not in alive)
        assert drift.exact_p_value(h / lcm, m, n) == pytest.approx(outside, rel=1e-11)
