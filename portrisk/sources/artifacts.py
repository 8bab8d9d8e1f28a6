"""Model artifacts in versioned folders, the model log and the reference sample.

Layout of ``root``: ``v=<id>/{segments,profiles,classifier,meta}`` and ``log/``.  A
version is complete once its ``meta`` is written, and readers take the newest
complete one, so a half-written training run is never served.  Paths may be on any
file system Spark can reach.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from portrisk import config as C
from portrisk.functions.scalar import model_version
from portrisk.operators.boosting import MonotoneGBTModel
from portrisk.operators.segments import ProfileResolverModel, SegmentEncoderModel

META_SCHEMA = (
    "val_auc double, trained_at string, feature_names array<string>, n_features int, "
    "classifier_path string, segments_path string, profiles_path string"
)
LOG_SCHEMA = T.StructType(
    [
        T.StructField("timestamp", T.StringType()),
        T.StructField("version", T.StringType()),
        T.StructField("auc_roc", T.DoubleType()),
        T.StructField("status", T.StringType()),
    ]
)


@dataclass(frozen=True)
class ChurnModel:
    """The three fitted parts and when they were trained."""

    segments: SegmentEncoderModel
    profiles: ProfileResolverModel
    classifier: MonotoneGBTModel
    trained_at: str | None = None

    @property
    def version(self) -> str:
        return model_version(self.trained_at)


def utc_now() -> str:
    return datetime.now(timezone.utc).isoformat()


def _read_or_none(reader) -> DataFrame | None:
    try:
        return reader()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise


def save_model(spark: SparkSession, model: ChurnModel, root: str, val_auc: float) -> str:
    """Write a new version and return its folder."""
    trained_at = model.trained_at or utc_now()
    folder = f"{root}/v={trained_at.replace(':', '').replace('+', '_')}"
    parts = {"classifier": model.classifier, "segments": model.segments, "profiles": model.profiles}
    for name, part in parts.items():
        part.write().overwrite().save(f"{folder}/{name}")
    names = model.segments.feature_names()
    row = (round(val_auc, 6), trained_at, names, len(names), *[f"{folder}/{n}" for n in parts])
    spark.createDataFrame([row], META_SCHEMA).coalesce(1).write.mode("overwrite").json(f"{folder}/meta")
    return folder


def load_meta(spark: SparkSession, root: str) -> dict:
    """Metadata of the newest complete version; an empty dict if there is none."""
    meta = _read_or_none(lambda: spark.read.schema(META_SCHEMA).json(f"{root}/v=*/meta"))
    row = meta.agg(F.max_by(F.struct(*meta.columns), "trained_at").alias("r")).first() if meta is not None else None
    return row.r.asDict() if row is not None and row.r is not None else {}


def load_model(spark: SparkSession, root: str) -> ChurnModel:
    meta = load_meta(spark, root)
    if not meta:
        raise FileNotFoundError(f"no complete model under '{root}': run the training job first")
    return ChurnModel(
        SegmentEncoderModel.load(meta["segments_path"]),
        ProfileResolverModel.load(meta["profiles_path"]),
        MonotoneGBTModel.load(meta["classifier_path"]),
        meta["trained_at"],
    )


def append_log(spark: SparkSession, root: str, version: str, auc_roc: float, status: str) -> None:
    stamp = F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")
    row = spark.range(1).select(
        stamp.alias("timestamp"),
        F.lit(version).alias("version"),
        F.lit(round(auc_roc, 4)).alias("auc_roc"),
        F.lit(status).alias("status"),
    )
    row.coalesce(1).write.mode("append").json(f"{root}/log")


def read_log(spark: SparkSession, root: str) -> DataFrame:
    log = _read_or_none(lambda: spark.read.schema(LOG_SCHEMA).json(f"{root}/log"))
    log = log if log is not None else spark.createDataFrame([], LOG_SCHEMA)
    return log.orderBy("timestamp")


def write_reference(features: DataFrame, root: str, version: str) -> str:
    """A new reference sample version; older ones stay for running readers."""
    path = f"{root}/reference/v={version.replace(':', '').replace('+', '_')}"
    features.select(*C.ALL_FEATURES).write.mode("overwrite").parquet(path)
    return path


def load_reference(spark: SparkSession, root: str) -> DataFrame | None:
    """Newest reference sample, or None."""
    every = _read_or_none(lambda: spark.read.option("basePath", f"{root}/reference").parquet(f"{root}/reference"))
    if every is None:
        return None
    newest = every.agg(F.max(F.col("v").cast("string"))).first()[0]
    if newest is None:
        return None
    return spark.read.parquet(f"{root}/reference/v={newest}")


def load_or_create_reference(spark: SparkSession, root: str, training: DataFrame) -> DataFrame:
    found = load_reference(spark, root)
    if found is not None:
        return found
    write_reference(training, root, utc_now())
    return load_reference(spark, root)
