"""Client tables: CSV or Parquet in, the contract's columns out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from portrisk import config as C


def read_clients(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Unchecked client rows; pass them to the contract operators.

    CSV columns are matched by header name and read as text, so a malformed number
    reaches the contract check instead of turning into a null at parse time.
    """
    if fmt == "csv":
        header = spark.read.option("header", True).csv(path).columns
        schema = T.StructType([T.StructField(c, T.StringType()) for c in header])
        return spark.read.option("header", True).schema(schema).csv(path)
    return spark.read.format(fmt).load(path)


def feature_columns(clients: DataFrame) -> DataFrame:
    """The seven features in model order."""
    return clients.select(*C.ALL_FEATURES)
