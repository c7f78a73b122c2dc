"""Maximal marginal relevance: greedy choice of relevant and different rows among a bounded list of candidates."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from korvex.functions.vector import metric_name
from korvex.operators.topk import scores


def choose(vectors: np.ndarray, query: np.ndarray, lam: float, k: int, metric: str = "cosine") -> tuple[list[int], list[float]]:
    """(rows in the order of choice, their values). Among equal values the earlier row is chosen.

    Relevance is the similarity to the query, brought to [0, 1] over all rows; a row loses (s + 1) / 2 for its greatest
    similarity s to a chosen one. lam weighs the first, 1 - lam the second.
    """
    if not len(vectors) or k <= 0:
        return [], []
    s = scores(query[None], vectors, metric)[0]
    relevance = (s - s.min()) / max(s.max() - s.min(), 1e-10)
    near = np.full(len(vectors), -np.inf)
    left = np.ones(len(vectors), bool)
    out, values = [], []
    for n in range(min(k, len(vectors))):
        value = lam * relevance - (1 - lam) * ((near + 1) / 2 if n else 0.0)
        value[~left] = -np.inf
        at = int(np.argmax(np.round(value, 12)))
        out.append(at)
        values.append(float(value[at]))
        left[at] = False
        near = np.maximum(near, scores(vectors[at][None], vectors, metric)[0])
    return out, values


def mmr(candidates: DataFrame, query: Sequence[float], k: int, lam: float = 0.5, metric: str = "cosine", vector_col: str = "vector", clamp: bool = True, order: Sequence[str] = ("pos",)) -> DataFrame:
    """The k chosen rows with all their columns, mmr_score and mmr_rank. Candidates are a list that fits one task (a top-k).

    Rows without vector aren't chosen; if none has one, the first k come back with a null mmr_score. `order` sorts the
    candidates first.
    """
    metric = metric_name(metric)
    lam = min(1.0, max(0.0, lam)) if clamp else lam
    q = np.array(query, np.float64)
    names = list(candidates.columns)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(list(order), kind="stable").reset_index(drop=True)
        ok = pdf[vector_col].notna()
        if not ok.any():
            out = pdf.head(max(0, k)).copy()
            out["mmr_score"] = np.nan
        else:
            have = pdf[ok].reset_index(drop=True)
            at, values = choose(np.stack(have[vector_col].to_numpy()).astype(np.float64), q, lam, k, metric)
            out = have.iloc[at].copy()
            out["mmr_score"] = values
        out["mmr_rank"] = np.arange(1, len(out) + 1)
        return out[[*names, "mmr_score", "mmr_rank"]]

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in candidates.schema.fields)
    return candidates.groupBy().applyInPandas(run, f"{schema}, mmr_score double, mmr_rank int")
