"""How extractors are run: what each needs of a task, how many tasks at once, and the items of a batch."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.resource import ExecutorResourceRequests, ResourceProfile, ResourceProfileBuilder, TaskResourceRequests
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from korvex.functions.extract import extract_features

GB = 1 << 30


@dataclass(frozen=True)
class Deployment:
    extractor: str
    least: int
    most: int
    gpus: float
    gigabytes: int
    batch: int
    cpus: int = 1

    def profile(self) -> ResourceProfile:
        """For RDDs' withResources and mapInPandas' profile."""
        executor = ExecutorResourceRequests().memory(f"{self.gigabytes}g").cores(max(1, self.cpus))
        task = TaskResourceRequests().cpus(self.cpus)
        if self.gpus:
            executor, task = executor.resource("gpu", 1), task.resource("gpu", self.gpus)
        return ResourceProfileBuilder().require(executor).require(task).build


DEPLOYMENTS = {
    "asr_model": Deployment("whisper", 0, 3, 0.5, 8, 4),
    "audio_embedder": Deployment("clap", 0, 3, 0.25, 4, 8),
    "face_detector": Deployment("arcface", 1, 5, 0.25, 4, 8),
    "image_embedder": Deployment("siglip", 1, 5, 0.25, 4, 16),
    "image_embedder_clip": Deployment("clip", 0, 3, 0.25, 4, 16),
    "image_embedder_dino": Deployment("dinov2", 0, 3, 0.25, 4, 16),
    "llm_judge": Deployment("e5_large", 0, 2, 1.0, 16, 4, 2),
    "reranker": Deployment("e5_large", 0, 3, 0.25, 4, 16),
    "text_embedder": Deployment("e5_large", 2, 10, 0.0, 2, 64),
    "text_embedder_multilingual": Deployment("bge_m3", 1, 5, 0.0, 4, 32),
    "video_embedder": Deployment("vertex_multimodal", 0, 3, 0.5, 8, 2, 2),
}


def deployment(name: str) -> Deployment:
    if name not in DEPLOYMENTS:
        raise KeyError(f"no deployment {name!r}; there are {sorted(DEPLOYMENTS)}")
    return DEPLOYMENTS[name]


def catalog(spark: SparkSession) -> DataFrame:
    """A row for each deployment."""
    rows = [(n, d.extractor, d.least, d.most, d.gpus, d.gigabytes, d.batch, d.cpus) for n, d in DEPLOYMENTS.items()]
    return spark.createDataFrame(rows, "name string, extractor string, least int, most int, gpus double, gigabytes int, batch int, cpus int")


def run(items: DataFrame, name: str) -> DataFrame:
    """Features of items by a deployment's extractor, in as many tasks as it may have at most and batches of its size."""
    d = deployment(name)
    return extract_features(items.repartition(d.most, F.col("id")), [d.extractor], d.batch)
