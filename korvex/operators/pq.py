"""Product quantisation: each part of a vector is replaced by the number of its nearest centre."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Codebook:
    """centres: (parts, centres, width)."""

    def __init__(self, centres: np.ndarray):
        self.centres = np.asarray(centres, np.float64)

    @property
    def parts(self) -> int:
        return self.centres.shape[0]

    def size_bytes(self) -> int:
        return int(np.prod(self.centres.shape)) * 4

    def _split(self, vectors: np.ndarray) -> np.ndarray:
        m, _, w = self.centres.shape
        if vectors.shape[1] != m * w:
            raise ValueError(f"vectors of {vectors.shape[1]} numbers, {m * w} expected")
        return vectors.reshape(len(vectors), m, w)

    def encode(self, vectors: np.ndarray) -> np.ndarray:
        """(rows, parts) numbers of the nearest centres; of equally near ones the lowest."""
        x = self._split(np.asarray(vectors, np.float64))
        return np.stack([((x[:, p, None, :] - self.centres[p][None]) ** 2).sum(2).argmin(1) for p in range(self.parts)], 1)

    def table(self, query: Sequence[float]) -> np.ndarray:
        """(parts, centres) squared distances of the query's parts."""
        q = self._split(np.asarray(query, np.float64)[None])[0]
        return ((self.centres - q[:, None, :]) ** 2).sum(2)


def nearest(x: np.ndarray, centres: np.ndarray, most: int = 4096) -> np.ndarray:
    """Number of each row's nearest centre; of equally near ones the lowest."""
    parts = [x[s : s + most] for s in range(0, len(x), most)]
    return np.concatenate([((r**2).sum(1)[:, None] - 2 * r @ centres.T + (centres**2).sum(1)[None]).argmin(1) for r in parts]) if parts else np.zeros(0, np.int64)


def kmeans(df: DataFrame, parts: int, k: int, rounds: int, seed: int, vector_col: str = "vector") -> np.ndarray:
    """(parts, centres, width): Lloyd's rounds over all vectors, in each part of them on its own.

    The first centres are the k distinct vectors of smallest hash. A round assigns rows in tasks, which return sums and counts
    for each part and centre; only these and the centres reach the driver. It ends when no centre moves; centres
    are rounded, as sums differ in the last bits. Fewer rows than k give as many centres as rows.
    """
    v = df.where(F.col(vector_col).isNotNull()).select(F.col(vector_col).cast("array<double>").alias("v")).persist()
    try:
        first = np.array([r["v"] for r in v.distinct().orderBy(F.xxhash64("v", F.lit(seed)), "v").limit(k).collect()])
        if not len(first):
            raise ValueError("no vectors")
        n, dim = len(first) if len(first) == k else v.limit(k).count(), first.shape[1]
        if not dim or dim % parts:
            raise ValueError(f"{dim} numbers don't split into {parts} parts")
        centres = np.resize(first, (n, dim)).reshape(n, parts, dim // parts).transpose(1, 0, 2).copy()
        for _ in range(rounds):
            total, count = _sums(v, centres)
            new = np.round(np.where(count[:, :, None] > 0, total / np.maximum(count, 1)[:, :, None], centres), 12)  # a centre without rows stays
            still = np.array_equal(new, centres)
            centres = new
            if still:
                break
        return centres
    finally:
        v.unpersist()


def _sums(v: DataFrame, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each part and centre, the sum and the number of the rows nearest to it."""
    m, k, w = centres.shape

    def run(batches):
        total, count = np.zeros((m, k, w)), np.zeros((m, k), np.int64)
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["v"].to_numpy()).reshape(len(pdf), m, w)
                for p in range(m):
                    near = nearest(x[:, p], centres[p])
                    np.add.at(total[p], near, x[:, p])
                    count[p] += np.bincount(near, minlength=k)
        at = np.argwhere(count > 0)
        if len(at):
            yield pd.DataFrame({"part": at[:, 0], "centre": at[:, 1], "n": count[count > 0], "x": list(total[count > 0])})

    each = v.mapInPandas(run, "part int, centre int, n long, x array<double>")
    total, count = np.zeros((m, k, w)), np.zeros((m, k), np.int64)
    for r in each.groupBy("part", "centre").agg(F.sum("n").alias("n"), *[F.sum(F.col("x")[i]).alias(f"x{i}") for i in range(w)]).collect():
        count[r["part"], r["centre"]] = r["n"]
        total[r["part"], r["centre"]] = r[3:]
    return total, count


def train(df: DataFrame, parts: int, centres: int = 256, rounds: int = 20, seed: int = 0, vector_col: str = "vector") -> Codebook:
    """k-means in each part, over all rows. Raises if there are fewer rows than centres."""
    if not 1 <= centres <= 256:
        raise ValueError("1 to 256 centres")
    got = kmeans(df, parts, centres, rounds, seed, vector_col)
    if got.shape[1] < centres:
        raise ValueError(f"{got.shape[1]} rows for {centres} centres")
    return Codebook(got)


def encode(df: DataFrame, book: Codebook, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """(id, code array<int>); rows without vector are left out."""

    @F.pandas_udf("array<int>")
    def code(v: pd.Series) -> pd.Series:
        return pd.Series(list(book.encode(np.stack(v.to_numpy())).astype(np.int32))) if len(v) else pd.Series([], dtype=object)

    return df.where(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("id"), code(F.col(vector_col)).alias("code"))


def search(codes: DataFrame, book: Codebook, query: Sequence[float], k: int) -> DataFrame:
    """(id, distance): asymmetric squared distances by table lookups, smallest first, ties by id."""
    t = book.table(query)
    lookup = F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in t])
    terms = F.transform("code", lambda c, p: F.element_at(F.element_at(lookup, p + 1), c + 1))
    return codes.select("id", F.aggregate(terms, F.lit(0.0), lambda a, x: a + x).alias("distance")).orderBy("distance", "id").limit(max(0, k))
