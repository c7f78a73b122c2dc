"""Hybrid search over a table of documents, and the engine that joins it with the store."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from uuid import NAMESPACE_URL, uuid5

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from korvex.functions.vector import metric_name
from korvex.operators import bm25, filters, fusion, mmr, sparse, topk
from korvex.operators.metrics import Counters
from korvex.sources.store import Store, exists, folders, remove


def hybrid_search(
    docs: DataFrame,
    k: int = 10,
    dense: Sequence[float] | None = None,
    sparse_query: tuple[Sequence[int], Sequence[float]] | None = None,
    text: str | None = None,
    method: str = "rrf",
    weights: Mapping[str, float] | None = None,
    tree: Mapping | None = None,
    filter_mode: str = "post",
    metric: str = "cosine",
    text_fields: Sequence[str] = ("text",),
    fetch_k: int | None = None,
    text_index: str | None = None,
) -> DataFrame:
    """(id, score) of the best k documents by any of a vector, a sparse vector and a text query.

    text_index is a stored index of all documents (bm25.write_index); with a filter before the search it isn't used.

    Each list holds its best fetch_k (k if not given); one list keeps its scores, more are fused. filter_mode post keeps
    of the k results those that the filter matches, pre searches matching documents only. Nothing asked, nothing found.
    """
    if filter_mode not in ("pre", "post"):
        raise ValueError("filter_mode is pre or post")
    metric_name(metric)
    n = max(1, k) if fetch_k is None else max(k, fetch_k)
    kept = docs.where(filters.compile_filter(tree, filters.variant(F.col("payload")))) if tree is not None else docs
    base = kept if filter_mode == "pre" else docs
    lists: list[DataFrame] = []
    if dense is not None:
        lists.append(topk.topk(base, dense, n, metric, vector_col="dense").select(F.lit("dense").alias("modality"), "id", "score"))
    if sparse_query is not None:
        lists.append(sparse.search(sparse.postings(base), *sparse_query, n).select(F.lit("sparse").alias("modality"), "id", "score"))
    if text is not None:
        if text_index is not None and base is docs:
            found = bm25.search_stored(docs.sparkSession, text_index, text, n, text_fields)
            lists.append(found.select(F.lit("text").alias("modality"), F.col("id").cast(docs.schema["id"].dataType).alias("id"), "score"))
            text = None
    if text is not None:
        fields = base.select("id", *[F.col("text_fields")[f].alias(f) for f in text_fields])
        lists.append(bm25.search(fields, text, n, text_fields).select(F.lit("text").alias("modality"), "id", "score"))
    if not lists or k <= 0:
        return docs.select("id", F.lit(0.0).alias("score")).limit(0)
    out = fusion.fuse(reduce(DataFrame.unionByName, lists), k, method, weights, len(lists))
    if tree is not None and filter_mode == "post":
        out = out.join(kept.select("id"), "id", "left_semi").orderBy(F.col("score").desc(), "id")
    return out


class Engine:
    """Documents at a path: upsert, delete, search, stats, snapshots. counters (metrics.Counters) has what it did."""

    def __init__(self, spark: SparkSession, path: str, dim: int = 768, metric: str = "cosine", text_fields: Sequence[str] | None = None, counters: Counters | None = None):
        self.spark, self.metric, self.text_fields = spark, metric_name(metric), tuple(text_fields or ("text",))
        self.store, self.counters = Store(spark, path, dim), counters or Counters()

    def upsert(self, id: str, dense=None, sparse_indices=None, sparse_values=None, text_fields=None, payload=None, namespace: str = "default") -> int:
        return self.batch_upsert([{"id": id, "dense": dense, "sparse_indices": sparse_indices, "sparse_values": sparse_values, "text_fields": text_fields, "payload": payload}], namespace)

    def batch_upsert(self, rows, namespace: str = "default") -> int:
        before = self.store.sequence()
        seq = self.store.upsert(rows, namespace)
        self.counters.add("upserts")
        self.counters.add("documents_upserted", seq - before)
        self.counters.set("sequence", seq)
        return seq

    def delete(self, id: str, namespace: str = "default") -> bool:
        self.counters.add("deletes")
        return bool(self.store.delete([id], namespace))

    def commit(self) -> str:
        """Stores the full-text index of a namespace each, as of now. A search uses it until the log goes on."""
        seq = self.store.sequence()
        path = f"{self.store.path}/text/seq={seq}"
        if not exists(self.spark, f"{path}/ready/_SUCCESS"):
            v = self.store.view()
            for namespace in self.store.tenants():
                own = v.where(F.col("namespace") == namespace).select("id", *[F.col("text_fields")[f].alias(f) for f in self.text_fields])
                bm25.write_index(own, f"{path}/{uuid5(NAMESPACE_URL, namespace)}", self.text_fields)
            self.spark.range(1).write.mode("overwrite").parquet(f"{path}/ready")
        for old in folders(self.spark, f"{self.store.path}/text"):
            if old != f"seq={seq}":
                remove(self.spark, f"{self.store.path}/text/{old}")
        return path

    def text_index(self, namespace: str | None) -> str | None:
        """The stored index of a namespace, if it is of the log's end."""
        if namespace is None or not exists(self.spark, f"{self.store.path}/text"):
            return None
        path = f"{self.store.path}/text/seq={self.store.sequence()}"
        own = f"{path}/{uuid5(NAMESPACE_URL, namespace)}"
        return own if exists(self.spark, f"{path}/ready/_SUCCESS") and exists(self.spark, own) else None

    def num_docs(self, namespace: str = "default") -> int:
        """Documents that a text search goes through: those of the stored index if it is of the log's end."""
        path = self.text_index(namespace)
        return bm25.num_docs(self.spark, path) if path else self.store.view(namespace=namespace).count()

    def search(self, dense=None, sparse_indices=None, sparse_values=None, text=None, k: int = 10, namespace: str | None = None, include_payloads: bool = False, include_vectors: bool = False, as_of: int | None = None, fusion: str = "rrf", weights=None, filter=None, filter_mode: str = "post", fetch_k: int | None = None, metric: str | None = None) -> DataFrame:
        if (sparse_indices is None) != (sparse_values is None):
            raise ValueError("sparse indices and values come together")
        with self.counters.timed("search"):
            docs = self.store.view(as_of, namespace)
            q = None if sparse_indices is None else (sparse_indices, sparse_values)
            index = self.text_index(namespace) if text is not None and as_of is None else None
            out = hybrid_search(docs, k, dense, q, text, fusion, weights, filter, filter_mode, metric or self.metric, self.text_fields, fetch_k, index)
            more = ["payload"] * include_payloads + ["dense"] * include_vectors
            return out.join(docs.select("id", *more), "id", "left").orderBy(F.col("score").desc(), "id") if more else out

    def search_stream(self, **request):
        """Results one by one."""
        yield from self.search(**request).toLocalIterator()

    def search_mmr(self, dense, k: int = 10, lam: float = 0.5, fetch_k: int = 50, namespace: str | None = None) -> DataFrame:
        docs = self.store.view(namespace=namespace)
        found = topk.topk(docs, dense, fetch_k, self.metric, vector_col="dense")
        rows = found.join(docs.select("id", "dense"), "id").withColumn("order", -F.col("score"))
        out = mmr.mmr(rows, dense, k, lam, self.metric, "dense", order=("order", "id"))
        return out.select("id", F.col("mmr_score").alias("score"), "mmr_rank")

    def stats(self) -> DataFrame:
        return self.store.stats()

    def snapshot(self) -> int:
        try:
            seq = self.store.snapshot()
        except Exception:
            self.counters.add("snapshots", status="error")
            raise
        self.counters.add("snapshots", status="ok")
        return seq

    def tail(self, from_seq: int = 1) -> DataFrame:
        return self.store.tail(from_seq)
