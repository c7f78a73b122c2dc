"""A stored inverted-file index that takes new vectors and deletes: the counterpart of a graph index that is kept up.

Rows (list, id, vector, version, gone) are Parquet in folders by list, and places (id, list, version, gone) tell where the
newest row of an id is. A search reads the lists nearest to the query and leaves out rows that a newer place replaces.
Centres are fitted once, on all vectors of the first table; compact() assigns rows anew and drops what is replaced.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from korvex.functions.vector import metric_name, normalize
from korvex.operators import ivf
from korvex.operators.topk import topk_batch
from korvex.sources.store import exists, folders, remove

MOST_SENT = 50_000  # replaced rows that may go to every task


class IvfIndex:
    """The index at a path; one writer at a time."""

    def __init__(self, spark: SparkSession, path: str, metric: str = "cosine"):
        self.spark, self.path, self.metric = spark, path.rstrip("/"), metric_name(metric)
        self.root = self._newest()

    def _newest(self) -> str:
        done = [int(n.split("=")[1]) for n in folders(self.spark, self.path) if n.startswith("build=") and exists(self.spark, f"{self.path}/{n}/ready/_SUCCESS")]
        return f"{self.path}/build={max(done, default=0)}"

    def create(self, df: DataFrame, lists: int = 16, id_col: str = "id", vector_col: str = "vector") -> None:
        """An index of (id, vector); rows without either are left out."""
        self._build(df.select(F.col(id_col).cast("string").alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).where("id is not null and vector is not null"), lists)

    def _build(self, rows: DataFrame, lists: int) -> None:
        n = int(self.root.rpartition("=")[2])
        before, self.root = self.root, f"{self.path}/build={n + 1}"
        centres = ivf.train(rows, lists)
        self.spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(centres)], "list int, centre array<double>").coalesce(1).write.mode("overwrite").parquet(f"{self.root}/centres")
        self._append(rows)
        self.spark.range(1).write.mode("overwrite").parquet(f"{self.root}/ready")
        if n:
            remove(self.spark, before)

    def centres(self) -> np.ndarray:
        return np.array([r["centre"] for r in self.spark.read.parquet(f"{self.root}/centres").orderBy("list").collect()])

    def _version(self) -> int:
        return (self.spark.read.parquet(f"{self.root}/places").agg(F.max("version")).first()[0] or 0) if exists(self.spark, f"{self.root}/places/_SUCCESS") else 0

    def _append(self, rows: DataFrame) -> int:
        version = self._version() + 1
        found = ivf.assign(rows, self.centres()).withColumn("version", F.lit(version).cast("long"))
        found.repartition("list").write.mode("append").partitionBy("list").parquet(f"{self.root}/rows")
        own = self.spark.read.schema("id string, vector array<double>, version long, list int").parquet(f"{self.root}/rows").where(F.col("version") == version)
        own.select("id", "list", "version", F.lit(False).alias("gone")).write.mode("append").parquet(f"{self.root}/places")
        return version

    def insert(self, df: DataFrame, id_col: str = "id", vector_col: str = "vector") -> int:
        """Adds vectors, or replaces those of the same ids. The rows' version."""
        return self._append(df.select(F.col(id_col).cast("string").alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).where("id is not null and vector is not null"))

    def delete(self, ids: Iterable[str]) -> int:
        """Takes ids out; how many were there."""
        wanted = self.spark.createDataFrame([(str(i),) for i in ids], "id string").distinct()
        there = self._places().join(wanted, "id", "left_semi").where("not gone").select("id").collect()  # at most the ids given
        if there:
            self.spark.createDataFrame([(r["id"], None, self._version() + 1, True) for r in there], "id string, list int, version long, gone boolean").coalesce(1).write.mode("append").parquet(f"{self.root}/places")
        return len(there)

    def _places(self) -> DataFrame:
        """(id, list, version, gone): the newest place of each id."""
        p = self.spark.read.parquet(f"{self.root}/places")
        return p.groupBy("id").agg(F.max_by(F.struct("list", "version", "gone"), "version").alias("x")).select("id", "x.*")

    def _live(self) -> DataFrame:
        """Rows that nothing replaces: without (id, version) pairs that a newer place of the id makes old."""
        p = self.spark.read.parquet(f"{self.root}/places")
        old = p.groupBy("id").agg(F.max("version").alias("newest"), F.count("*").alias("n")).where("n > 1").select("id", "newest")
        rows = self.spark.read.schema("id string, vector array<double>, version long, list int").parquet(f"{self.root}/rows")
        if old.limit(MOST_SENT + 1).count() <= MOST_SENT:
            old = F.broadcast(old)
        return rows.join(old, "id", "left").where("newest is null or version = newest").drop("newest")

    def ids(self) -> DataFrame:
        return self._places().where("not gone").select("id")

    def __len__(self) -> int:
        return self.ids().count()

    def get_vector(self, id: str) -> list[float] | None:
        """The vector of an id, of unit length under cosine; None if it isn't there."""
        place = self.spark.read.parquet(f"{self.root}/places").where(F.col("id") == str(id)).orderBy(F.col("version").desc()).first()
        if place is None or place["gone"]:
            return None
        rows = self.spark.read.schema("id string, vector array<double>, version long, list int").parquet(f"{self.root}/rows")
        row = rows.where((F.col("list") == place["list"]) & (F.col("id") == str(id)) & (F.col("version") == place["version"]))
        return row.select(normalize(F.col("vector")) if self.metric == "cosine" else F.col("vector")).first()[0]

    def search(self, queries: Sequence[tuple[object, Sequence[float]]], k: int, probes: int = 8) -> DataFrame:
        """(query_id, id, score, rank) among each query's nearest lists; exact if all are probed."""
        centres, live = self.centres(), self._live()
        wanted: dict[tuple[int, ...], list] = {}
        for q, v in queries:
            near = np.argsort(-ivf.scores(np.array([v], float), centres, "l2")[0], kind="stable")[:probes]
            wanted.setdefault(tuple(sorted(near.tolist())), []).append((q, v))
        out = None
        for lists, own in wanted.items():
            part = topk_batch(live.where(F.col("list").isin(*lists)), own, k, self.metric)
            out = part if out is None else out.unionByName(part)
        return topk_batch(live, [], k, self.metric) if out is None else out

    def compact(self, lists: int | None = None) -> None:
        """Builds the index anew from what is there, with centres fitted on it."""
        self._build(self._live().select("id", "vector"), lists or len(self.centres()))
