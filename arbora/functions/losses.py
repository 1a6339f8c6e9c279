"""Losses and hits over ``logits ARRAY<DOUBLE>`` and a class index ``y``, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def log_softmax(logits: Column) -> Column:
    shifted = F.transform(logits, lambda v: v - F.array_max(logits))
    norm = F.log(F.aggregate(shifted, F.lit(0.0), lambda s, v: s + F.exp(v)))
    return F.transform(shifted, lambda v: v - norm)


def cross_entropy(logits: Column, y: Column, smoothing: float = 0.0, weights: list[float] | None = None) -> dict[str, Column]:
    """``loss`` and ``weight`` of a sample; the weighted mean is sum(loss) / sum(weight)."""
    logp = log_softmax(logits)
    w = F.array(*map(F.lit, map(float, weights))) if weights else F.transform(logits, lambda v: F.lit(1.0))
    own = F.get(w, y)
    smooth = F.aggregate(F.zip_with(logp, w, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v) / F.size(logits)
    return {"loss": -(1 - smoothing) * own * F.get(logp, y) - smoothing * smooth, "weight": own}


def focal_loss(logits: Column, y: Column, gamma: float = 2.0, alpha: float | list[float] | None = None) -> Column:
    """-alpha (1 - p)^gamma log p of the true class; a single alpha is clipped to 0..1."""
    logp = F.get(log_softmax(logits), y)
    base = -F.pow(1 - F.exp(logp), F.lit(float(gamma))) * logp
    if alpha is None:
        return base
    if isinstance(alpha, (int, float)):
        return base * min(max(float(alpha), 0.0), 1.0)
    return base * F.get(F.array(*map(F.lit, map(float, alpha))), y)


def reduce_loss(df: DataFrame, column: str, how: str = "mean") -> DataFrame:
    if how == "none":
        return df
    if how not in ("mean", "sum"):
        raise ValueError(f"unknown reduction {how!r}")
    return df.agg((F.avg if how == "mean" else F.sum)(column).alias(column))


def hit_at(logits: Column, y: Column, k: int) -> Column:
    """Whether the true class is among the k largest logits (ties count as hits)."""
    own = F.get(logits, y)
    return (1 + F.size(F.filter(logits, lambda v: v > own))) <= k


def argmax(logits: Column) -> Column:
    """Index of the largest logit, the first on ties."""
    return (F.array_position(logits, F.array_max(logits)) - 1).cast("int")


def top_k_percent(df: DataFrame, ks: tuple[int, ...] = (1, 5)) -> DataFrame:
    return df.agg(*[(F.avg(hit_at(F.col("logits"), F.col("y"), k).cast("int")) * 100).alias(f"top{k}") for k in ks])
