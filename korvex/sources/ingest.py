"""Files and items into the store: read, extract, write."""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from threading import Lock

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from korvex.functions.extract import content_type, extract_features
from korvex.sources.store import Store


class JobCancelled(Exception):
    """Raised in a job that was cancelled, between two of its batches."""


@dataclass
class Job:
    """Progress of an ingest. Failed items count as completed too; it ends by itself when all are."""

    job_id: str = field(default_factory=lambda: uuid.uuid4().hex)
    status: str = "pending"
    total: int = 0
    completed: int = 0
    failed: int = 0
    stage: str = ""
    errors: Counter = field(default_factory=Counter)

    def set_total(self, total: int) -> None:
        self.total = total

    def set_stage(self, stage: str) -> None:
        self.stage = stage

    def start(self, total: int) -> None:
        self.set_total(total)
        self.status = "running" if total else "completed"

    def advance(self, n: int = 1, failed: int = 0, errors: Iterable[str] = ()) -> None:
        self.completed += n
        self.failed += failed
        self.errors.update(errors)
        if self.status == "running" and self.completed >= self.total:
            self.status = "completed"

    def fail(self, message: str) -> None:
        self.status = "failed"
        self.errors[message] += 1

    def cancel(self) -> bool:
        """Whether there was something to cancel."""
        if self.status in ("completed", "failed", "cancelled"):
            return False
        self.status = "cancelled"
        return True

    @property
    def percent(self) -> float:
        return 100.0 * self.completed / self.total if self.total else 0.0

    def snapshot(self) -> dict:
        return {"job_id": self.job_id, "status": self.status, "total": self.total, "completed": self.completed, "failed": self.failed, "stage": self.stage, "percent": self.percent, "errors": dict(self.errors)}


def files(spark: SparkSession, path: str) -> DataFrame:
    """(id, content, content_type) of all files under a path, of any number; Spark leaves empty files out."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return f.select(F.col("path").alias("id"), "content", content_type(F.col("path")).alias("content_type"))


def ingest(items: DataFrame, extractors: list[str], store: Store, namespace: str = "default", job: Job | None = None) -> Job:
    """Extracts features of items and upserts a document for each, named item:address. Text without a vector is written too.

    A failing item doesn't stop the others.
    """
    job = job or Job()
    job.set_stage("extract")
    features = extract_features(items, extractors).cache()
    try:
        each = features.groupBy("item").agg(F.count("error").alias("bad"), F.min("error").alias("why"))
        seen = each.agg(F.count("*").alias("n"), F.sum((F.col("bad") > 0).cast("long")).alias("bad")).first()
        if job.status == "pending":
            job.start(seen["n"])
        if job.status == "cancelled":
            raise JobCancelled(job.job_id)
        why = [r["why"] for r in each.where("bad > 0").select("why").limit(100).collect()]  # examples for the report
        docs = features.where("error is null").select(
            F.concat_ws(":", "item", "uri").alias("id"),
            F.col("vector").alias("dense"),
            "sparse",
            F.when(F.col("text").isNotNull(), F.create_map(F.lit("text"), "text")).alias("text_fields"),
            F.to_json(F.map_concat("metadata", F.create_map(F.lit("item"), "item", F.lit("feature_uri"), "uri"))).alias("payload"),
            F.lit(namespace).alias("namespace"),
        )
        job.set_stage("write")
        store.upsert(docs, namespace)
    finally:
        features.unpersist()
    job.advance(seen["n"], seen["bad"] or 0, why)
    return job


class Jobs:
    """Ingests that run in threads of the driver, by their id; each works through a folder in batches of files."""

    def __init__(self, store: Store, most_at_once: int = 2) -> None:
        self.store, self.jobs = store, {}
        self._pool = ThreadPoolExecutor(most_at_once)
        self._writes = Lock()  # one writer a store

    def submit(self, path: str, extractors: list[str], namespace: str = "default", batch: int = 10_000) -> Job:
        """Begins an ingest of all files under a path; the job is there at once."""
        job = Job()
        self.jobs[job.job_id] = job, self._pool.submit(self._run, job, path, extractors, namespace, batch)
        return job

    def _run(self, job: Job, path: str, extractors: list[str], namespace: str, batch: int) -> None:
        try:
            items = files(self.store.spark, path)
            job.set_stage("list")
            total = items.select("id").count()
            if job.status == "cancelled":
                return
            job.start(total)
            parts = max(1, -(-total // batch))
            for p in range(parts):
                if job.status == "cancelled":
                    return
                own = items.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == p) if parts > 1 else items
                with self._writes:
                    ingest(own, extractors, self.store, namespace, job)
        except JobCancelled:
            pass
        except Exception as e:  # noqa: BLE001  what went wrong is the job's result
            job.fail(str(e).split("\n")[0])

    def get(self, job_id: str) -> Job | None:
        return self.jobs[job_id][0] if job_id in self.jobs else None

    def wait(self, job_id: str, seconds: float | None = None) -> Job:
        self.jobs[job_id][1].result(seconds)
        return self.jobs[job_id][0]
