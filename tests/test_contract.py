import math

import pytest
from pyspark.sql import functions as F

from portrisk.functions import scalar as S
from portrisk.operators import contracts
from portrisk.sources.clients import read_clients

GOOD = ["1", "x", "30", "0.4", "0.5", "45000", "0.6", "0.7", "1.2"]
NAMES = ["client_id", "description", *contracts.BOUNDS]


def codes(spark, **changes):
    row = dict(zip(NAMES, GOOD)) | changes
    df = spark.createDataFrame([tuple(row[n] for n in NAMES)], ", ".join(f"{n} string" for n in NAMES))
    return contracts.with_violations(df).first()


@pytest.mark.parametrize(
    "changes, expected",
    [
        ({}, []),
        ({"avg_holding_days": "30.0"}, []),
        ({"avg_holding_days": "30.5"}, ["avg_holding_days:not_integer"]),
        ({"avg_holding_days": "0"}, ["avg_holding_days:below_min"]),
        ({"avg_holding_days": "3650"}, []),
        ({"avg_holding_days": "3651"}, ["avg_holding_days:above_max"]),
        ({"avg_holding_days": None}, ["avg_holding_days:missing"]),
        ({"avg_holding_days": "many"}, ["avg_holding_days:not_numeric"]),
        ({"account_balance": "0"}, ["account_balance:below_min"]),
        ({"account_balance": "Infinity"}, ["account_balance:not_finite"]),
        ({"account_balance": "NaN"}, ["account_balance:not_finite"]),
        ({"market_pain_index": "NaN"}, ["market_pain_index:not_finite"]),
        ({"balance_velocity": "5.0001"}, ["balance_velocity:above_max"]),
        ({"login_freq_drop": "-0.1", "market_pain_index": "2"}, ["market_pain_index:above_max", "login_freq_drop:below_min"]),
        ({"crypto_ratio": "0.5", "tech_stocks_ratio": "0.5"}, []),
        ({"crypto_ratio": "0.500000001", "tech_stocks_ratio": "0.5"}, ["exposure:above_one"]),
        ({"crypto_ratio": "0.9", "tech_stocks_ratio": "0.9", "account_balance": "0"}, ["account_balance:below_min"]),
    ],
)
def test_rules(spark, changes, expected):
    assert codes(spark, **changes).violations == expected


def test_cross_message(spark):
    r = codes(spark, crypto_ratio="0.75", tech_stocks_ratio="0.35")
    assert r.message == "crypto_ratio (0.75) + tech_stocks_ratio (0.35) = 1.10 > 1.0"


def test_valid_and_rejected_partition_the_table(spark, tmp_path):
    path = str(tmp_path / "c.csv")
    with open(path, "w") as fh:
        fh.write("account_balance,avg_holding_days,crypto_ratio,tech_stocks_ratio,balance_velocity,market_pain_index,login_freq_drop\n")
        fh.write("45000,30,0.4,0.5,0.6,0.7,1.2\n45000,30,0.6,0.5,0.6,0.7,1.2\nx,30,0.4,0.5,0.6,0.7,1.2\n")
    df = read_clients(spark, path, "csv")
    good, bad = contracts.valid_clients(df), contracts.rejected_clients(df)
    assert good.count() == 1 and bad.count() == 2
    r = good.first()
    assert r.client_id is None and r.description == "" and r.avg_holding_days == 30
    assert dict(good.dtypes)["avg_holding_days"] == "int"


def test_latent_score_golden(demo):
    got = {r.client_id: r.p for r in demo.select("client_id", S.latent_churn().alias("p")).collect()}
    want = {9001: 0.705785, 9002: 0.004610, 9003: 0.919827, 9004: 0.741734, 9005: 0.848129, 9006: 0.488752, 9007: 0.963385}
    for k, v in want.items():
        assert abs(got[k] - v) < 1e-6


def test_bands_and_flags(spark):
    df = spark.createDataFrame([(0.399999,), (0.4,), (0.5,), (0.7,)], "p double")
    colour, _ = S.risk_band(F.col("p"))
    rows = df.select(colour.alias("c"), S.action_required(F.col("p")).alias("a"), S.predicted_label(F.col("p")).alias("l")).collect()
    assert [r.c for r in rows] == ["green", "orange", "orange", "red"]
    assert [r.a for r in rows] == [False, False, False, True]
    assert [r.l for r in rows] == [0, 0, 1, 1]


def test_version_text():
    assert S.model_version("2024-05-06T07:08:09").endswith("(trained 2024-05-06)")
    assert S.model_version(None).endswith("(trained unknown)")
    assert math.isfinite(1.0)


def test_text_client_id_is_a_violation_not_an_error(spark):
    from portrisk.operators.contracts import rejected_clients, valid_clients

    fine = (6, 0.75, 0.20, 42000.0, 0.62, 0.65, 0.45)
    from portrisk import config as C

    df = spark.createDataFrame([(i, *map(str, fine)) for i in ("9001", "x7", None, "12.0", "1.5")], ["client_id", *C.ALL_FEATURES])
    names = dict(zip(("avg_holding_days", "crypto_ratio", "tech_stocks_ratio", "account_balance", "balance_velocity", "market_pain_index", "login_freq_drop"), fine, strict=True))
    from pyspark.sql import functions as F

    df = df.select("client_id", *[F.lit(str(v)).alias(k) for k, v in names.items()])
    assert sorted(r.client_id or 0 for r in valid_clients(df).collect()) == [0, 12, 9001]
    assert {r.client_id: r.violations for r in rejected_clients(df).collect()} == {"x7": ["client_id:not_integer"], "1.5": ["client_id:not_integer"]}


def test_parts_meet_lines_without_the_driver(spark, tmp_path):
    from portrisk.sources import bridge

    tables = {
        "customer": ("c_custkey long, c_acctbal double", [(1, 10.0), (2, None)]),
        "orders": ("o_orderkey long, o_custkey long, o_orderdate timestamp_ntz, o_totalprice double", []),
        "lineitem": ("l_orderkey long, l_partkey long, l_extendedprice double, l_returnflag string", [(1, 1, 5.0, "R")]),
        "part": ("p_partkey long, p_type string", [(1, "PROMO")]),
    }
    for name, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    raw = bridge.client_raw(spark, str(tmp_path))
    assert raw.count() == 2
    plan = raw._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin [l_partkey" in plan and "BroadcastHashJoin [l_partkey" not in plan
