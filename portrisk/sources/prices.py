"""Price table readers: long OHLCV tables and the usual wide column layouts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from portrisk import config as C

OHLCV_SCHEMA = T.StructType(
    [
        T.StructField("date", T.DateType()),
        T.StructField("ticker", T.StringType()),
        *[T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close")],
        T.StructField("volume", T.LongType()),
    ]
)
# --- fixed values: price field names of a wide download --------------------------
PRICE_FIELDS = ("Open", "High", "Low", "Close", "Adj Close", "Volume")


def read_ohlcv(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    reader = spark.read.schema(OHLCV_SCHEMA)
    return reader.option("header", True).csv(path) if fmt == "csv" else reader.format(fmt).load(path)


def unpivot_closes(wide: DataFrame, date: str = "date", sep: str = "_") -> DataFrame:
    """Wide prices to long (date, ticker, close).

    Accepts ``Close_T``, ``T_Close``, a single ``Close`` column (its ticker is then
    unknown and named after the first price column), or columns that are tickers
    already.  Raises when columns are field/ticker pairs and none is a close.
    """
    columns = [c for c in wide.columns if c != date]
    closes: dict[str, str] = {}
    paired = False
    for c in columns:
        head, _, tail = c.partition(sep)
        first, _, last = c.rpartition(sep)
        if tail and head in PRICE_FIELDS:
            paired = True
            if head == "Close":
                closes[c] = tail
        elif first and last in PRICE_FIELDS:
            paired = True
            if last == "Close":
                closes[c] = first
    if paired and not closes:
        raise ValueError(f"price columns name fields and tickers but no Close: {columns}")
    if not paired:
        closes = {"Close": columns[0]} if "Close" in columns else {c: c for c in columns}
    narrow = wide.select(F.col(date).alias("date"), *[F.col(f"`{c}`").alias(t) for c, t in closes.items()])
    return narrow.unpivot(["date"], [f"`{t}`" for t in closes.values()], "ticker", "close")


def universe_table(spark: SparkSession, universe=C.UNIVERSE) -> DataFrame:
    return spark.createDataFrame(
        [(a.ord, a.asset, a.ticker, a.kind) for a in universe],
        "ord int, asset string, ticker string, class string",
    )


def asset_prices(prices: DataFrame, universe=C.UNIVERSE) -> DataFrame:
    """Rename tickers to assets and keep the universe only.

    The universe is a constant, so it is a literal map rather than a join and the
    ticker filter reaches the scan.
    """
    def to(values):
        pairs = [F.lit(x) for a in universe for x in (a.ticker, values(a))]
        return F.try_element_at(F.create_map(*pairs), F.col("ticker"))

    keep = [c for c in ("as_of",) if c in prices.columns]
    return prices.where(F.col("ticker").isin(*[a.ticker for a in universe])).select(
        *keep, "date", to(lambda a: a.ord).alias("ord"), to(lambda a: a.asset).alias("asset"),
        F.nanvl(F.col("close").cast("double"), F.lit(None).cast("double")).alias("close"),  # not a number is missing
    )


def missing_assets(prices: DataFrame, universe=C.UNIVERSE) -> DataFrame:
    """Universe rows without a single price row."""
    present = prices.select("ticker").distinct()
    return universe_table(prices.sparkSession, universe).join(present, "ticker", "left_anti")
