"""Training job: three-way split, fit on the train part, evaluate, persist, log.

Every stage is fitted on training rows only; the validation rows choose the number
of boosting rounds and the test rows are used for the report alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from portrisk import config as C
from portrisk.operators.boosting import MonotoneGBTClassifier
from portrisk.operators.metrics import classification_report, log_loss, roc_auc
from portrisk.operators.segments import ProfileResolver, SegmentEncoder
from portrisk.operators.split import stratified_parts
from portrisk.sources import artifacts
from portrisk.sources.artifacts import ChurnModel


@dataclass(frozen=True)
class TrainingResult:
    model: ChurnModel
    auc: float
    log_loss: float
    report: DataFrame
    folder: str | None = None


def fit_model(parts: DataFrame, **boosting) -> ChurnModel:
    """Fit segments, profiles and classifier on rows tagged with ``part``."""
    train = parts.where("part = 'train'")
    segments = SegmentEncoder().fit(train)
    profiles = ProfileResolver().fit(segments.predict_cluster(train))
    rows = segments.transform(parts.where("part in ('train', 'valid')")).withColumn("held", F.col("part") == "valid")
    classifier = MonotoneGBTClassifier(validationCol="held", **boosting).fit(rows)
    return ChurnModel(segments, profiles, classifier, artifacts.utc_now())


def run_training(labelled: DataFrame, root: str | None = None, **boosting) -> TrainingResult:
    """``labelled``: valid client rows with ``client_id`` and a 0/1 ``churn``.

    With ``root`` the model version, the model log and the reference sample are
    written there.
    """
    spark = labelled.sparkSession
    source = labelled.select("client_id", *C.ALL_FEATURES, "churn").persist(StorageLevel.MEMORY_AND_DISK)
    parts = stratified_parts(source).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        model = fit_model(parts, **boosting)
        tested = model.segments.transform(parts.where("part = 'test'"))
        scored = model.classifier.score(tested).select("churn", "churn_probability").persist()
        auc, loss = roc_auc(scored).first()[0], log_loss(scored).first()[0]
        rows = classification_report(scored).collect()  # five rows
        report = spark.createDataFrame(rows, classification_report(scored).schema)
        scored.unpersist()
        folder = None
        if root:
            folder = artifacts.save_model(spark, model, root, auc)
            artifacts.append_log(spark, root, model.version, auc, "Pipeline retrained successfully")
            artifacts.write_reference(source, root, model.trained_at)
    finally:
        parts.unpersist()
        source.unpersist()
    return TrainingResult(model, auc, loss, report, folder)
