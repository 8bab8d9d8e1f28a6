"""Numeric columns as cached numpy blocks, for fits that pass over the data many times.

A DataFrame plan per pass would cost more than the pass; these loops keep one
cached dataset and sum one small fixed-size vector per partition.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import RDD
from pyspark.sql import DataFrame

ROWS_PER_PARTITION = 50_000
FAN_IN = 64


def matrix_blocks(df: DataFrame, n_rows: int) -> RDD:
    """RDD of float64 matrices, one per Arrow batch of the (all numeric) columns.

    Small inputs are pulled together, so that a pass does not cost more in task
    starts than in work.
    """
    width = len(df.columns)

    def pack(batches):
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({"m": [pdf.to_numpy(dtype=np.float64).tobytes()]})

    packed = df.mapInPandas(pack, "m binary").rdd.map(lambda r: np.frombuffer(r.m).reshape(-1, width))
    return packed.coalesce(max(1, min(packed.getNumPartitions(), -(-n_rows // ROWS_PER_PARTITION))))


def sum_partitions(rdd: RDD, partial: Callable[[Iterator], np.ndarray]) -> np.ndarray:
    """Sum of one fixed-size vector per partition, through a tree on the executors: the driver gets one vector.

    Vectors are added in the order of their partitions, so a rerun gives the same digits.
    """
    n = rdd.getNumPartitions()
    vectors = rdd.mapPartitionsWithIndex(lambda i, it: [(i, partial(it))])
    while n > 1:
        n = -(-n // FAN_IN)
        vectors = vectors.map(lambda v: (v[0] // FAN_IN, v)).groupByKey(n).mapValues(_in_order)
    return vectors.first()[1]


def _in_order(vectors) -> np.ndarray:
    return sum(v for _, v in sorted(vectors, key=lambda v: v[0]))
