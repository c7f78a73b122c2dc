"""Sparse vectors: an inverted list of (id, token, weight) rows, scored by a join on tokens."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def postings(df: DataFrame, id_col: str = "id", sparse_col: str = "sparse") -> DataFrame:
    """(id, token, weight) of a column struct<indices, values>; zero weights and null vectors are left out.

    Parallel lists of different lengths raise when the row is read.
    """
    s = F.col(sparse_col)
    ok = F.when(F.size(s["indices"]) == F.size(s["values"]), F.arrays_zip(s["indices"].alias("indices"), s["values"].alias("values"))).otherwise(F.raise_error("indices and values differ in length"))
    e = df.where(s.isNotNull()).select(F.col(id_col).alias("id"), F.explode(ok).alias("p"))
    return e.select("id", F.col("p")["indices"].cast("long").alias("token"), F.col("p")["values"].cast("double").alias("weight")).where("weight != 0")


def search(inverted: DataFrame, indices: Sequence[int], values: Sequence[float], k: int) -> DataFrame:
    """(id, score): sums of products over shared tokens, best k, ties by id. Documents without a shared token aren't found."""
    if len(indices) != len(values):
        raise ValueError("indices and values differ in length")
    q: dict[int, float] = {}
    for i, v in zip(indices, values):
        if v:
            q[int(i)] = q.get(int(i), 0.0) + float(v)
    query = inverted.sparkSession.createDataFrame(list(q.items()), "token long, q double")  # the request's own size
    hit = inverted.join(F.broadcast(query), "token").groupBy("id").agg(F.sum(F.col("weight") * F.col("q")).alias("score"))
    return hit.orderBy(F.col("score").desc(), "id").limit(max(0, k))


def stats(inverted: DataFrame) -> DataFrame:
    """(docs, vocabulary)."""
    return inverted.agg(F.countDistinct("id").alias("docs"), F.countDistinct("token").alias("vocabulary"))
