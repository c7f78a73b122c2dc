"""Fusion of ranked lists, given as rows (modality, id, score). Ties go to the smaller id."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60.0
METHODS = ("rrf", "dbsf", "linear")


def _weight(weights: Mapping[str, float] | None) -> Column:
    """Weight by modality name; 1 where none is given."""
    out = F.lit(1.0)
    for name, w in (weights or {}).items():
        out = F.when(F.col("modality") == name, F.lit(float(w))).otherwise(out)
    return out


def part(lists: DataFrame, method: str, weights: Mapping[str, float] | None = None) -> DataFrame:
    """(modality, id, part): what each row adds to its document's fused score."""
    w = Window.partitionBy("modality")
    if method == "rrf":
        value = 1.0 / (F.lit(RRF_K) + F.row_number().over(w.orderBy(F.col("score").desc(), "id")))
    elif method == "dbsf":
        low, high = F.min("score").over(w), F.max("score").over(w)
        value = (F.col("score") - low) / F.greatest(high - low, F.lit(1e-10)) * _weight(weights)
    elif method == "linear":
        value = F.col("score") * _weight(weights)
    else:
        raise ValueError(f"unknown fusion {method!r}; one of {METHODS}")
    return lists.select("modality", "id", value.alias("part"))


def fuse(lists: DataFrame, k: int, method: str = "rrf", weights: Mapping[str, float] | None = None, modalities: int | None = None) -> DataFrame:
    """(id, score), best k. With one list (modalities 1) its own scores are kept. k of 0 gives no row."""
    if modalities == 1:
        if method not in METHODS:
            raise ValueError(f"unknown fusion {method!r}; one of {METHODS}")
        out = lists.select("id", "score")
    else:
        out = part(lists, method, weights).groupBy("id").agg(F.sum("part").alias("score"))
    return out.orderBy(F.col("score").desc(), "id").limit(max(0, k))
