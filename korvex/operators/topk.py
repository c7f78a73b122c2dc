"""Exact nearest vectors: each partition scores its rows by a matrix product and passes on its best k for each query only."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from korvex.functions.vector import FLOOR, metric_name

MOST_QUERY_VALUES = 5_000_000  # numbers in the query matrix that may go to every task
SCORES_AT_ONCE, TASKS_A_CORE = 2_000_000, 2


def matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(places of the rows that hold a vector, their values); a null vector is left out, another length raises."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    ok = np.flatnonzero(np.asarray(column.is_valid()))
    kept = column.take(pa.array(ok)) if len(ok) != len(column) else column
    sizes = np.diff(np.asarray(kept.offsets)) if len(kept) else np.zeros(0)
    if (sizes != dim).any():
        raise ValueError(f"vectors of {sorted(set(sizes.tolist()))} numbers, {dim} expected")
    return ok, np.asarray(kept.flatten(), dtype=np.float64).reshape(len(kept), dim)


def scores(queries: np.ndarray, rows: np.ndarray, metric: str) -> np.ndarray:
    """(queries, rows) scores."""
    dot = queries @ rows.T
    if metric == "ip":
        return dot
    q, r = (queries**2).sum(1)[:, None], (rows**2).sum(1)[None]
    if metric == "cosine":
        low = np.sqrt(q.min(initial=1) * r.min(initial=1)) < FLOOR  # else no product of lengths is below it
        return dot / np.maximum(np.sqrt(q * r), FLOOR) if low else dot / np.sqrt(q) / np.sqrt(r)
    out = q + r - 2 * dot
    near = np.nonzero(out < 1e-2 * (q + r))  # differences lose digits there: equal vectors are at distance 0 exactly
    out[near] = ((queries[near[0]] - rows[near[1]]) ** 2).sum(1)
    return -np.sqrt(np.maximum(out, 0))


def best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best by score, ties by id."""
    if k < len(score):
        edge = np.partition(score, len(score) - k)[len(score) - k]
        at = np.flatnonzero(score >= edge - 1e-12)
    else:
        at = np.arange(len(score))
    return at[np.lexsort((ids[at], -np.round(score[at], 12)))][:k]


def topk_batch(df: DataFrame, queries: Sequence[tuple[object, Sequence[float]]], k: int, metric: str = "cosine", id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """(query_id, id, score, rank): the k best rows for each (query_id, vector). Ids are whole numbers or strings.

    k of 0 or no query gives no row; fewer than k vectors give all of them. Null vectors are left out. Queries are
    sent in parts of MOST_QUERY_VALUES numbers.
    """
    metric = metric_name(metric)
    spark = df.sparkSession
    id_type = df.schema[id_col].dataType.simpleString()
    kind = "string" if id_type == "string" else "long"
    qkind = "string" if any(isinstance(q, str) for q, _ in queries) else "long"
    schema = f"query_id {qkind}, id {kind}, score double"
    out = spark.createDataFrame([], schema)
    if k > 0 and len(queries):
        dim = len(queries[0][1])
        step = max(1, MOST_QUERY_VALUES // max(1, dim))
        parts = [queries[s : s + step] for s in range(0, len(queries), step)]
        for n, part in enumerate(parts):
            found = _scan(df, part, k, metric, id_col, vector_col, kind, qkind, schema)
            out = found if n == 0 else out.union(found)
    w = Window.partitionBy("query_id").orderBy(F.round("score", 12).desc(), F.col("id"))
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _scan(df, queries, k, metric, id_col, vector_col, kind, qkind, schema) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(([q for q, _ in queries], np.array([v for _, v in queries], np.float64)))
    at, qt = (pa.string() if x == "string" else pa.int64() for x in (kind, qkind))

    def run(batches):
        names, q = shared.value
        best_ids, best_scores = [[] for _ in names], [[] for _ in names]
        for b in batches:
            ok, rows = matrix(b.column(1), q.shape[1])
            ids = np.array(b.column(0).take(pa.array(ok)).to_pylist(), dtype=object if kind == "string" else np.int64)
            s = scores(q, rows, metric)
            for n in range(len(names)):
                keep = best(s[n], ids, k)
                best_ids[n] += ids[keep].tolist()
                best_scores[n] += s[n][keep].tolist()
                if len(best_ids[n]) > 20 * k:
                    i, x = np.array(best_ids[n], ids.dtype), np.array(best_scores[n])
                    keep = best(x, i, k)
                    best_ids[n], best_scores[n] = i[keep].tolist(), x[keep].tolist()
        for n, name in enumerate(names):
            i, x = np.array(best_ids[n], object if kind == "string" else np.int64), np.array(best_scores[n])
            keep = best(x, i, k) if len(x) else []
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(keep), qt), pa.array(i[keep].tolist() if len(keep) else [], at), pa.array(x[keep] if len(keep) else [], pa.float64())], ["query_id", "id", "score"])

    return df.select(F.col(id_col).cast(kind), F.col(vector_col)).where(F.col(id_col).isNotNull()).mapInArrow(run, schema)


def topk(df: DataFrame, query: Sequence[float], k: int, metric: str = "cosine", id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """(id, score) of the k best rows for one vector."""
    return topk_batch(df, [(0, query)], k, metric, id_col, vector_col).select("id", "score")


def best_of_rows(s: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k best columns of each row, best first, ties by id; ids ascend."""
    k = min(k, s.shape[1])
    if not k or not len(s):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    s = np.round(s, 12)
    edge = np.partition(s, s.shape[1] - k, axis=1)[:, -k, None]
    row, col = np.nonzero(s >= edge)
    order = np.lexsort((col, -s[row, col], row))
    row, col = row[order], col[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], col[place < k]


def _vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    return df.where(F.col(vector_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))


def _join_small(left: DataFrame, right: DataFrame, k: int, metric: str) -> DataFrame:
    """Left rows against the whole right side, sent to the tasks: no shuffle of the right side and no merge."""
    rows = right.orderBy("id").toArrow()
    ids = rows.column("id").to_numpy()
    dim = len(rows.column("v")[0]) if len(ids) else 0
    shared = left.sparkSession.sparkContext.broadcast((ids, matrix(rows.column("v"), dim)[1]))

    def run(batches):
        ids, q = shared.value
        for b in batches:
            own = b.column(0).to_numpy()
            for start in range(0, len(own), step := max(1, 4_000_000 // max(1, len(ids)))) if len(ids) else ():
                x = matrix(b.column(1).slice(start, step), q.shape[1])[1]
                s = scores(x, q, metric)
                row, col = best_of_rows(s, ids, k)
                rank = np.arange(len(row)) - np.searchsorted(row, row) + 1
                yield pa.RecordBatch.from_arrays([pa.array(own[start + row]), pa.array(ids[col]), pa.array(s[row, col]), pa.array(rank.astype(np.int32))], ["left_id", "right_id", "score", "rank"])

    return left.mapInArrow(run, "left_id long, right_id long, score double, rank int")


def _best_so_far(q: np.ndarray, k: int, metric: str, groups: Callable | None = None):
    """(add, rows): add takes a batch of ids and vectors, rows returns (place of the query, id, score) of each query's k best of all batches.

    At most SCORES_AT_ONCE scores are held besides k rows for each query. groups, a function of a batch's vectors, yields the places
    of the rows and of the queries that are compared.
    """
    held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
    least = np.full(len(q), -np.inf)  # what a row must reach to be among the k best of each query

    def merge(new: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
        at, ids, x = (np.concatenate([h, *c]) for h, c in zip(held, zip(*new)))
        order = np.lexsort((ids, -np.round(x, 12), at))
        at, ids, x = at[order], ids[order], x[order]
        place = np.arange(len(at)) - np.searchsorted(at, at)
        last = place == k - 1
        least[at[last]] = np.round(x[last], 12)
        held[:] = [a[place < k] for a in (at, ids, x)]

    def add(ids: np.ndarray, rows: np.ndarray) -> None:
        waiting, size = [], 0
        for own, asked in [(slice(None), np.arange(len(q)))] if groups is None else groups(rows):
            part, part_ids, few = rows[own], ids[own], q[asked]
            order = np.argsort(part_ids, kind="stable")
            part, part_ids = part[order], part_ids[order]
            for a in range(0, len(few), 4096):
                step = max(1, SCORES_AT_ONCE // len(few[a : a + 4096]))
                for b in range(0, len(part), step):
                    s = scores(few[a : a + 4096], part[b : b + step], metric)
                    to = asked[a : a + 4096]
                    if np.isinf(least[to]).any():  # some have no k rows yet
                        row, col = best_of_rows(s, part_ids, k)
                    else:
                        row, col = np.nonzero(s >= least[to][:, None] - 1e-12)
                    waiting.append((to[row], part_ids[b + col], s[row, col]))
                    size += len(row)
                    if size > max(SCORES_AT_ONCE // 4, len(held[0])) or np.isinf(least[to]).any():
                        merge(waiting)
                        waiting, size = [], 0
        if waiting:
            merge(waiting)

    return add, lambda: held


def few_queries(left: DataFrame, right: DataFrame, k: int, metric: str, groups: Callable | None = None) -> DataFrame:
    """(left_id, right_id, score, rank) for sides (id, v), of which the left one may go to every task.

    Each task returns the k best of its rows for each left row. The right side isn't shuffled, and is read in at most
    TASKS_A_CORE tasks a core, so that what they return grows with the left side only. groups(queries) makes what says which of them a row is compared with (see _best_so_far).
    """
    own = left.toArrow()
    names = own.column("id").to_numpy()
    dim = len(own.column("v")[0]) if len(names) else 0
    spark = left.sparkSession
    shared = spark.sparkContext.broadcast((names, matrix(own.column("v"), dim)[1]))

    def run(batches):
        names, q = shared.value
        if not len(names) or k <= 0:
            return
        add, rows = _best_so_far(q, k, metric, groups and groups(q))
        for b in batches:
            add(b.column(0).to_numpy(), matrix(b.column(1), q.shape[1])[1])
        at, ids, x = rows()
        for s in range(0, len(at), 100_000):
            part = slice(s, s + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(names[at[part]]), pa.array(ids[part]), pa.array(x[part])], ["left_id", "right_id", "score"])

    found = right.coalesce(TASKS_A_CORE * spark.sparkContext.defaultParallelism).mapInArrow(run, "left_id long, right_id long, score double")
    w = Window.partitionBy("left_id").orderBy(F.round("score", 12).desc(), "right_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def knn_join(left: DataFrame, right: DataFrame, k: int = 1, metric: str = "cosine", left_id: str = "id", right_id: str = "id", left_vector: str = "vector", right_vector: str = "vector", block: int = 4096, most_values: int = MOST_QUERY_VALUES) -> DataFrame:
    """(left_id, right_id, score, rank): the k best right rows for each left row, both sides of any size.

    The smaller side goes to every task if it has at most most_values numbers. Otherwise rows of both sides are dealt to blocks,
    each pair of blocks is scored by one matrix product in a task, and the best k of each left row are merged; that is
    quadratic work, for which ivf.knn_join is the approximate way. Rows without vector are left out.
    """
    metric = metric_name(metric)
    a, b = _vectors(left, left_id, left_vector), _vectors(right, right_id, right_vector)
    count = lambda d: d.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("v")), F.lit(0)).alias("values")).first()
    size, own = count(b), count(a)
    rows = own["n"]
    if own["values"] <= most_values and own["values"] < size["values"]:
        return few_queries(a, b, k, metric)
    if size["values"] <= most_values:  # few rows are dealt anew, so that all cores have some
        return _join_small(a.repartition(a.sparkSession.sparkContext.defaultParallelism) if rows <= 1_000_000 else a, b, k, metric)
    parts = {"l": max(1, -(-rows // block)), "r": max(1, -(-size["n"] // block))}
    deal = lambda d, own, other, i, j: d.withColumn(i, F.pmod(F.xxhash64("id"), F.lit(parts[own])).cast("int")).withColumn(j, F.explode(F.sequence(F.lit(0), F.lit(parts[other] - 1))))
    x, y = deal(a, "l", "r", "i", "j"), deal(b, "r", "l", "j", "i")

    def pair(x, y):
        import pandas as pd

        y = y.sort_values("id")
        ids, own, out = y["id"].to_numpy(), x["id"].to_numpy(), []
        right = np.stack(y["v"].to_numpy()) if len(y) else None
        for start in range(0, len(x), 1024) if len(y) else ():
            s = scores(np.stack(x["v"].to_numpy()[start : start + 1024]), right, metric)
            row, col = best_of_rows(s, ids, k)
            out.append(pd.DataFrame({"left_id": own[start + row], "right_id": ids[col], "score": s[row, col]}))
        return pd.concat(out) if out else pd.DataFrame({"left_id": np.zeros(0, np.int64), "right_id": np.zeros(0, np.int64), "score": np.zeros(0)})

    found = x.groupBy("i", "j").cogroup(y.groupBy("i", "j")).applyInPandas(pair, "left_id long, right_id long, score double")
    w = Window.partitionBy("left_id").orderBy(F.round("score", 12).desc(), "right_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
