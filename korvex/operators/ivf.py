"""Inverted-file index: rows are stored by nearest centre, and a search reads the centres nearest to the query only."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from korvex.functions.vector import metric_name
from korvex.operators.pq import kmeans
from korvex.operators.topk import MOST_QUERY_VALUES, _vectors, best_of_rows, few_queries, scores, topk_batch


def train(df: DataFrame, lists: int, seed: int = 0, rounds: int = 20, vector_col: str = "vector") -> np.ndarray:
    """Centres, from all rows."""
    return kmeans(df, 1, lists, rounds, seed, vector_col)[0]


def assign(df: DataFrame, centres: np.ndarray, vector_col: str = "vector") -> DataFrame:
    """Adds list, the number of the nearest centre; rows without vector are left out."""

    @F.pandas_udf("int")
    def near(v: pd.Series) -> pd.Series:
        return pd.Series(scores(np.stack(v.to_numpy()).astype(float), centres, "l2").argmax(1).astype(np.int32)) if len(v) else pd.Series([], dtype="int32")

    return df.where(F.col(vector_col).isNotNull()).withColumn("list", near(F.col(vector_col)))


def write(df: DataFrame, centres: np.ndarray, path: str, vector_col: str = "vector") -> None:
    """Rows partitioned by list, so that a search prunes files; each list is written by its own tasks."""
    assign(df, centres, vector_col).repartition("list").write.mode("overwrite").partitionBy("list").parquet(path)


def search(spark: SparkSession, path: str, centres: np.ndarray, queries: Sequence[tuple[object, Sequence[float]]], k: int, probes: int, metric: str = "cosine", id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """(query_id, id, score, rank) among each query's `probes` nearest lists. With all lists probed the result is exact."""
    metric = metric_name(metric)
    table, out = spark.read.parquet(path), None
    wanted: dict[tuple[int, ...], list] = {}
    for q, v in queries:
        near = np.argsort(-scores(np.array([v], float), centres, "l2")[0], kind="stable")[:probes]
        wanted.setdefault(tuple(sorted(near.tolist())), []).append((q, v))
    for lists, own in wanted.items():
        part = topk_batch(table.where(F.col("list").isin(*lists)), own, k, metric, id_col, vector_col)
        out = part if out is None else out.unionByName(part)
    return topk_batch(table, [], k, metric, id_col, vector_col) if out is None else out


def knn_join(df: DataFrame, centres: np.ndarray, k: int, probes: int, metric: str = "cosine", id_col: str = "id", vector_col: str = "vector", block: int = 4096, queries: DataFrame | None = None, most_values: int = MOST_QUERY_VALUES) -> DataFrame:
    """(left_id, right_id, score, rank): the k best rows for every row, or for those of queries, among those of its `probes` nearest lists.

    Queries of at most most_values numbers go to every task, where a row is compared with those that probe its list, and no row
    is shuffled. Otherwise the rows and the queries of a list are dealt to blocks, so no task grows with a list. Null ids
    and vectors are left out; with all lists probed the result is exact.
    """
    metric = metric_name(metric)
    probes = min(probes, len(centres))
    right = _vectors(df, id_col, vector_col)
    left = right if queries is None else _vectors(queries, id_col, vector_col)
    near = lambda v: np.argsort(-scores(v, centres, "l2"), axis=1, kind="stable")[:, :probes]
    size = left.agg(F.coalesce(F.sum(F.size("v")), F.lit(0)).alias("values")).first()["values"]
    if size <= most_values:

        def groups(q: np.ndarray):
            probed = np.zeros((len(q), len(centres)), bool)
            np.put_along_axis(probed, near(q), True, 1)

            def compared(rows: np.ndarray):
                lists = scores(rows, centres, "l2").argmax(1)
                for n in np.unique(lists):
                    asked = np.flatnonzero(probed[:, n])
                    if len(asked):
                        yield np.flatnonzero(lists == n), asked

            return compared

        return few_queries(left, right, k, metric, groups)

    @F.pandas_udf("array<int>")
    def nearest(v: pd.Series) -> pd.Series:
        return pd.Series(list(near(np.stack(v.to_numpy()).astype(float)).astype(np.int32)) if len(v) else [], dtype=object)

    left = left.withColumn("list", F.explode(nearest("v")))
    right = right.select(F.col("id").alias("rid"), F.col("v").alias("rv"), nearest("v")[0].alias("list"))

    def dealt(side: DataFrame, other: DataFrame, id_name: str, own_part: str, other_part: str) -> DataFrame:
        """Each row has a block of its own side, and is there for each block of its list's other side."""
        many = [F.array(*[F.lit(max(1, -(-rows.get(n, 1) // block))) for n in range(len(centres))]) for rows in (counts[id(side)], counts[id(other)])]
        own = side.withColumn(own_part, F.pmod(F.xxhash64(id_name), F.get(many[0], F.col("list"))).cast("int"))
        return own.withColumn(other_part, F.explode(F.sequence(F.lit(0), F.get(many[1], F.col("list")) - 1)))

    counts = {id(d): {r["list"]: r["count"] for r in d.groupBy("list").count().collect()} for d in (left, right)}  # a row for each centre
    x, y = dealt(left, right, "id", "i", "j"), dealt(right, left, "rid", "j", "i")

    def pair(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        a, b, c = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        if len(x) and len(y):
            y = y.sort_values("rid")
            ids, own, r = y["rid"].to_numpy(), x["id"].to_numpy(), np.stack(y["rv"].to_numpy())
            for s in range(0, len(x), 1024):
                got = scores(np.stack(x["v"].to_numpy()[s : s + 1024]), r, metric)
                row, col = best_of_rows(got, ids, k)
                a.append(own[s + row])
                b.append(ids[col])
                c.append(got[row, col])
        return pd.DataFrame({"left_id": np.concatenate(a), "right_id": np.concatenate(b), "score": np.concatenate(c)})

    found = x.groupBy("list", "i", "j").cogroup(y.groupBy("list", "i", "j")).applyInPandas(pair, "left_id long, right_id long, score double")
    w = Window.partitionBy("left_id").orderBy(F.round("score", 12).desc(), "right_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
