"""Shards: numbered files of vectors by namespace, with what is registered of them.

Rows (namespace, shard, id, vector) are Parquet in folders by namespace and shard. The registry is a log of rows
(namespace, shard, rows, meta, gone, at); the newest of each shard counts.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from korvex.operators import topk
from korvex.operators.routing import HashRing
from korvex.sources.store import exists, folders, remove, to_json

ENTRY = "namespace string, shard long, rows long, meta string, gone boolean, at double"


@dataclass(frozen=True)
class Settings:
    """Bounds of shards and searches that callers don't give themselves."""

    shard_size: int = 10_000
    dim: int = 1024
    top_k: int = 10


@dataclass
class Found:
    """Rows of a search over shards, how many shards were asked, which of them failed and why, and the seconds of each."""

    results: DataFrame
    queried: int
    failed: dict[int, str] = field(default_factory=dict)
    seconds: dict[int, float] = field(default_factory=dict)


class Shards:
    """Shards at a path. One writer a namespace numbers them, from 0."""

    def __init__(self, spark: SparkSession, path: str, settings: Settings = Settings()):
        self.spark, self.path, self.settings = spark, path.rstrip("/"), settings

    # -- registry

    def entries(self) -> DataFrame:
        """(namespace, shard, rows, meta) of registered shards."""
        if not exists(self.spark, f"{self.path}/registry"):
            return self.spark.createDataFrame([], ENTRY).select("namespace", "shard", "rows", "meta")
        rows = self.spark.read.schema(ENTRY).parquet(f"{self.path}/registry")
        return rows.groupBy("namespace", "shard").agg(F.max_by(F.struct("rows", "meta", "gone"), "at").alias("x")).where("not x.gone").select("namespace", "shard", "x.rows", "x.meta")

    def _enter(self, rows: list[tuple]) -> None:
        if rows:
            self.spark.createDataFrame([(*r, time.time()) for r in rows], ENTRY).coalesce(1).write.mode("append").parquet(f"{self.path}/registry")

    def register(self, namespace: str, shard: int, rows: int, meta: Mapping | None = None) -> None:
        self._enter([(namespace, shard, rows, to_json(meta or {}), False)])

    def unregister(self, namespace: str, shard: int) -> bool:
        """Whether the shard was registered. Its file stays until it is deleted."""
        there = self.meta(namespace, shard) is not None
        if there:
            self._enter([(namespace, shard, 0, None, True)])
        return there

    def meta(self, namespace: str, shard: int) -> str | None:
        """What is registered of a shard as JSON, or None."""
        r = self.entries().where((F.col("namespace") == namespace) & (F.col("shard") == shard)).first()
        return None if r is None else r["meta"]

    def list(self, namespace: str) -> list[int]:
        return [r["shard"] for r in self.entries().where(F.col("namespace") == namespace).select("shard").orderBy("shard").collect()]

    def tenants(self) -> list[str]:
        return [r["namespace"] for r in self.entries().select("namespace").distinct().orderBy("namespace").collect()]

    def stats(self) -> DataFrame:
        """(namespaces, shards, rows, names): totals over all namespaces."""
        return self.entries().agg(F.countDistinct("namespace").alias("namespaces"), F.count("*").alias("shards"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.sort_array(F.collect_set("namespace")).alias("names"))

    # -- files

    def upload(self, namespace: str, shard: int, ids: Sequence[str], vectors: Sequence[Sequence[float]], meta: Mapping | None = None) -> int:
        """Writes one shard and registers it; rows written."""
        if len(ids) != len(vectors):
            raise ValueError("as many ids as vectors")
        rows = [(str(i), [float(x) for x in v]) for i, v in zip(ids, vectors)]
        self.spark.createDataFrame(rows, "id string, vector array<float>").coalesce(1).write.mode("overwrite").parquet(self.folder(namespace, shard))
        self.register(namespace, shard, len(rows), meta)
        return len(rows)

    def folder(self, namespace: str, shard: int) -> str:
        return f"{self.path}/data/namespace={namespace}/shard={shard}"

    def fetch(self, namespace: str, shard: int) -> DataFrame:
        """(id, vector) of one shard."""
        return self.spark.read.schema("id string, vector array<float>").parquet(self.folder(namespace, shard))

    def delete(self, namespace: str, shard: int) -> bool:
        """Deletes a shard's file and takes it out of the registry; whether there was one."""
        self.unregister(namespace, shard)
        return remove(self.spark, self.folder(namespace, shard))

    def drop(self, namespace: str) -> bool:
        """Deletes all of a namespace."""
        self._enter([(namespace, s, 0, None, True) for s in self.list(namespace)])
        return remove(self.spark, f"{self.path}/data/namespace={namespace}")

    def files(self, namespace: str) -> list[int]:
        """Numbers of shards that have a file, registered or not."""
        return sorted(int(n.split("=")[1]) for n in folders(self.spark, f"{self.path}/data/namespace={namespace}") if n.startswith("shard="))

    # -- writing

    def bulk_index(self, rows: DataFrame, namespace: str | None = None) -> DataFrame:
        """Writes (id, vector), with namespace if none is named, as shards of shard_size rows, the last one with what is left.

        Returns (namespace, shard, rows) of what was written. Rows are numbered by namespace and task from a table that was
        written first, so no shard depends on how tasks are repeated.
        """
        stage = f"{self.path}/stage/{uuid.uuid4().hex}"
        place = F.monotonically_increasing_id()
        name = F.col("namespace").cast("string") if namespace is None else F.lit(namespace)
        rows.select(name.alias("namespace"), F.col("id").cast("string").alias("id"), F.col("vector").cast("array<float>").alias("vector"), F.shiftright(place, 33).alias("task"), place.alias("row")).write.parquet(stage)
        staged = self.spark.read.parquet(stage).withColumn("n", F.row_number().over(Window.partitionBy("namespace", "task").orderBy("row")) - 1)
        size = staged.groupBy("namespace", "task").agg(F.count("*").alias("c"))
        before = F.coalesce(F.sum("c").over(Window.partitionBy("namespace").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        base = size.select("namespace", "task", before.alias("before")).join(self._next(), "namespace", "left")
        shard = F.floor((F.col("before") + F.col("n")) / self.settings.shard_size) + F.coalesce("first", F.lit(0))
        dealt = staged.join(base, ["namespace", "task"]).select("id", "vector", "namespace", shard.alias("shard"))
        numbered = f"{stage}-numbered"
        dealt.write.parquet(numbered)
        dealt = self.spark.read.parquet(numbered)
        made = dealt.groupBy("namespace", "shard").agg(F.count("*").alias("rows"))
        out, meta = f"{self.path}/registry", to_json({"dim": self.settings.dim})

        def enter(gone: bool) -> float:
            at = time.time()
            made.select("namespace", "shard", "rows", F.lit(meta).alias("meta"), F.lit(gone).alias("gone"), F.lit(at).alias("at")).write.mode("append").parquet(out)
            return at

        enter(True)  # the numbers are taken, though nothing is there yet: a writer that is lost can't leave rows in a later shard
        dealt.repartition("namespace", "shard").write.mode("append").partitionBy("namespace", "shard").parquet(f"{self.path}/data")
        at = enter(False)
        remove(self.spark, stage)
        remove(self.spark, numbered)
        return self.spark.read.schema(ENTRY).parquet(out).where(F.col("at") == at).select("namespace", "shard", "rows")

    def _next(self) -> DataFrame:
        """(namespace, first): the first number that no shard of a namespace has had."""
        if not exists(self.spark, f"{self.path}/registry"):
            return self.spark.createDataFrame([], "namespace string, first long")
        return self.spark.read.schema(ENTRY).parquet(f"{self.path}/registry").groupBy("namespace").agg((F.max("shard") + 1).alias("first"))

    def datasink(self, rows: DataFrame, nodes: Sequence[str], key: str = "id") -> dict:
        """Writes (id, vector) to one namespace a node, by consistent hash of the key. {written, failed, shards_hit}; rows without id or vector fail."""
        good = F.col(key).isNotNull() & F.col("vector").isNotNull()
        made = self.bulk_index(rows.where(good).withColumn("namespace", HashRing(nodes).column(F.col(key)))).agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.countDistinct("namespace").alias("nodes")).first()
        return {"written": made["rows"], "failed": rows.where(~good).count(), "shards_hit": made["nodes"]}

    # -- searching

    def search(self, namespace: str, query: Sequence[float], k: int | None = None, metric: str = "cosine", shards: Iterable[int] | None = None) -> Found:
        """The best k rows over all shards in one job; a shard whose file can't be read is left out and named."""
        asked = self.list(namespace) if shards is None else list(shards)
        good, failed = [], {}
        for s in asked:
            if exists(self.spark, f"{self.folder(namespace, s)}"):
                good.append(s)
            else:
                failed[s] = "no file"
        k = self.settings.top_k if k is None else k
        rows = lambda of: self.spark.read.schema("id string, vector array<float>").option("ignoreCorruptFiles", "false").parquet(*[self.folder(namespace, s) for s in of])
        if not good:
            return Found(self.spark.createDataFrame([], "id string, score double"), len(asked), failed)
        try:
            found = topk.topk(rows(good), query, k, metric).toArrow()
        except Exception:  # noqa: BLE001  find out which
            found = None
            for s in list(good):
                try:
                    rows([s]).agg(F.sum(F.size("vector"))).collect()
                except Exception as e:  # noqa: BLE001
                    good.remove(s)
                    failed[s] = str(e).split("\n")[0][:200]
            if not good:
                return Found(self.spark.createDataFrame([], "id string, score double"), len(asked), failed)
        if found is None:
            found = topk.topk(rows(good), query, k, metric).toArrow()
        return Found(self.spark.createDataFrame(found.to_pandas(), "id string, score double"), len(asked), failed)

    def scan(self, namespace: str, query: Sequence[float], k: int | None = None, metric: str = "cosine") -> Found:
        """As search(), shard by shard, with the seconds that each took."""
        k, best, seconds, failed = self.settings.top_k if k is None else k, None, {}, {}
        asked = self.list(namespace)
        for s in asked:
            t = time.perf_counter()
            one = self.search(namespace, query, k, metric, [s])
            seconds[s] = time.perf_counter() - t
            failed |= one.failed
            best = one.results if best is None else best.unionByName(one.results)
        rows = self.spark.createDataFrame([], "id string, score double") if best is None else best
        return Found(rows.orderBy(F.round("score", 12).desc(), "id").limit(k), len(asked), failed, seconds)


class Buffer:
    """Rows that are added one by one and written as whole shards; flush() writes what is left."""

    def __init__(self, shards: Shards) -> None:
        self.shards = shards
        self.rows: dict[str, list[tuple[str, Sequence[float]]]] = {}

    def add(self, namespace: str, id: str, vector: Sequence[float]) -> list[int]:
        """Numbers of the shards that were written."""
        dim = self.shards.settings.dim
        if len(vector) != dim:
            raise ValueError(f"a vector of {len(vector)} numbers, {dim} expected")
        own = self.rows.setdefault(namespace, [])
        own.append((str(id), vector))
        return self._write(namespace, self.shards.settings.shard_size) if len(own) >= self.shards.settings.shard_size else []

    def flush(self, namespace: str | None = None) -> list[int]:
        return [s for n in ([namespace] if namespace is not None else list(self.rows)) for s in self._write(n, 1)]

    def _write(self, namespace: str, least: int) -> list[int]:
        own, made, size = self.rows.get(namespace, []), [], self.shards.settings.shard_size
        row = self.shards._next().where(F.col("namespace") == namespace).first()
        at = row["first"] if row else 0
        while len(own) >= max(1, least):
            part, own[:] = own[:size], own[size:]
            self.shards.upload(namespace, at, [i for i, _ in part], [np.asarray(v).tolist() for _, v in part])
            made.append(at)
            at += 1
        return made


def route(df: DataFrame, nodes: list[str], key: str = "id") -> DataFrame:
    """Adds node by consistent hash of the key and puts a node's rows together, so that each is written by few tasks."""
    return df.withColumn("node", HashRing(nodes).column(F.col(key))).repartition("node")


def balance(routed: DataFrame) -> DataFrame:
    """(node, rows, share) of routed rows."""
    n = routed.groupBy("node").agg(F.count("*").alias("rows"))
    return n.withColumn("share", F.col("rows") / F.sum("rows").over(Window.partitionBy(F.lit(1))))
