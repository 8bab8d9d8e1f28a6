"""A small model with given parts, so that SQL can follow the whole scoring path: scaler, centres, profiles, trees.

It goes through the same classes as a trained model. The trees have the monotone signs of the classifier.
"""

from __future__ import annotations

import json

from portrisk import config as C
from portrisk.operators.boosting import MonotoneGBTModel
from portrisk.operators.segments import ProfileResolverModel, SegmentEncoderModel
from portrisk.sources.artifacts import ChurnModel

# --- fixed values: segment scaler and centres, clusters by holding time ------------
MEANS = (230.0, 0.31, 0.49)
STDS = (90.0, 0.08, 0.09)
CENTERS = ((-0.3, -0.5, 0.6), (1.9, -0.4, -0.4), (-0.2, 0.65, -0.6))
BY_HOLDING = (0, 2, 1)

# --- fixed values: trees as (feature, threshold, share going left, left, right) ----
BASE = -0.213
DEPTH = 3
TREES = (
    ("market_pain_index", 0.33, 0.5513,
     ("balance_velocity", 0.99, 0.4537, ("account_balance", 52000.0, 0.4071, 0.3137, 0.1719), ("cluster_0", 0.5, 0.6173, -0.4411, -0.2339)),
     ("login_freq_drop", 0.42, 0.7019, ("balance_velocity", 1.4, 0.7193, 0.3877, 0.0531), ("account_balance", 90000.0, 0.6037, 0.8317, 0.5749))),
    ("account_balance", 68000.0, 0.5011,
     ("login_freq_drop", 0.25, 0.6607, ("market_pain_index", 0.3, 0.3529, -0.1213, 0.2137), ("balance_velocity", 0.8, 0.4127, 0.6619, 0.3413)),
     ("balance_velocity", 1.1, 0.5233, ("cluster_2", 0.5, 0.7027, -0.0719, 0.1427), -0.5237)),
    ("login_freq_drop", 0.6, 0.7541,
     ("balance_velocity", 0.58, 0.2539, 0.2917, ("market_pain_index", 0.4, 0.8039, -0.3527, -0.1129)),
     ("market_pain_index", 0.36, 0.6029, ("account_balance", 40000.0, 0.3049, 0.4729, 0.2837), ("account_balance", 110000.0, 0.7411, 0.7127, 0.4513))),
)


def _heap(tree) -> dict[str, list]:
    """A nested tree in heap order, as the classifier keeps it."""
    n = 2 ** (DEPTH + 1) - 1
    feature, threshold, value, cover = [-1] * n, [0.0] * n, [0.0] * n, [0.0] * n

    def place(node, at: int, rows: float) -> None:
        cover[at] = rows
        if isinstance(node, float):
            value[at] = node
            return
        name, threshold[at], share, left, right = node
        feature[at] = C.MODEL_FEATURES.index(name)
        place(left, 2 * at + 1, rows * share)
        place(right, 2 * at + 2, rows * (1 - share))

    place(tree, 0, 1000.0)
    return {"feature": feature, "threshold": threshold, "value": value, "cover": cover}


def fixed_model() -> ChurnModel:
    return ChurnModel(
        SegmentEncoderModel(list(MEANS), list(STDS), [x for c in CENTERS for x in c]),
        ProfileResolverModel(list(BY_HOLDING)),
        MonotoneGBTModel(json.dumps([_heap(t) for t in TREES]), BASE, C.MODEL_FEATURES, DEPTH, []),
    )
