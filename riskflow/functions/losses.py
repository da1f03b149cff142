"""Per-row and averaged losses as column expressions (MDL-14, MDL-15)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from riskflow.functions.scalars import clip, sigmoid

LOSSES = ("binary_crossentropy", "focal_loss")
MARGIN_EPSILON = 1e-9
SCORE_EPSILON = 1e-7


def check_loss(loss: str, alpha: float = 0.25, gamma: float = 2.0) -> None:
    if loss not in LOSSES:
        raise ValueError(f"loss must be one of {', '.join(LOSSES)}, got {loss!r}")
    if alpha <= 0:
        raise ValueError("alpha must be greater than 0")
    if gamma < 0:
        raise ValueError("gamma must not be negative")


def focal_terms(label: Column, margin: Column, alpha: float = 0.25, gamma: float = 2.0) -> tuple[Column, Column]:
    """Gradient and hessian of the focal loss at a raw margin; alpha weighs both classes alike."""
    check_loss("focal_loss", alpha, gamma)
    p = clip(sigmoid(margin), MARGIN_EPSILON, 1.0 - MARGIN_EPSILON)
    sure = F.when(label == 1, p).otherwise(1.0 - p)
    scale = F.lit(alpha) * F.pow(1.0 - sure, F.lit(gamma))
    gradient = scale * (label - p) * (F.lit(gamma) * sure * F.ln(sure) + sure - 1.0)
    return gradient, scale * p * (1.0 - p)


def cross_entropy(label: Column, score: Column) -> Column:
    p = clip(score, SCORE_EPSILON, 1.0 - SCORE_EPSILON)
    return -(label * F.ln(p) + (1.0 - label) * F.ln(1.0 - p))


def focal_cross_entropy(label: Column, score: Column, gamma: float = 2.0) -> Column:
    p = clip(score, SCORE_EPSILON, 1.0 - SCORE_EPSILON)
    sure = F.when(label == 1, p).otherwise(1.0 - p)
    return -F.pow(1.0 - sure, F.lit(gamma)) * F.ln(sure)


def focal_arrays(label: np.ndarray, margin: np.ndarray, alpha: float = 0.25, gamma: float = 2.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``focal_terms`` at the margins and ``focal_cross_entropy`` of their scores, for arrays inside a task; NaN where a label is missing."""
    with np.errstate(over="ignore"):
        score = 1.0 / (1.0 + np.exp(-margin))
    p = np.clip(score, MARGIN_EPSILON, 1.0 - MARGIN_EPSILON)
    sure = np.where(label == 1, p, 1.0 - p)
    scale = alpha * (1.0 - sure) ** gamma
    gradient = scale * (label - p) * (gamma * sure * np.log(sure) + sure - 1.0)
    q = np.clip(score, SCORE_EPSILON, 1.0 - SCORE_EPSILON)
    sure = np.where(label == 1, q, 1.0 - q)
    return gradient, scale * p * (1.0 - p), np.where(np.isnan(label), np.nan, -((1.0 - sure) ** gamma) * np.log(sure))


def average_loss(loss: str, label: str, score: str, gamma: float = 2.0) -> Column:
    """Aggregate column: mean loss over the rows."""
    check_loss(loss, gamma=gamma)
    if loss == "focal_loss":
        return F.avg(focal_cross_entropy(F.col(label), F.col(score), gamma))
    return F.avg(cross_entropy(F.col(label), F.col(score)))
