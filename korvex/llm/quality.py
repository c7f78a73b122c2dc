"""Operator 9, quality classifier: which of two zstandard dictionaries packs a text better.

One dictionary is trained on text labelled good, one on text labelled bad. A text is cut into blocks of
BLOCK bytes, so that the dictionaries and not the text's own history decide, and every block is packed with
both. score = (packed with bad - packed with good) / larger of the two, in [-1, 1]; a logistic fit on
labelled rows that the dictionaries haven't seen makes it a probability of being good, and the cut is the
quantile of those rows' probabilities that rejects max_good_rejected of the good ones.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

BLOCK = 512


@dataclass(frozen=True)
class QualityModel:
    good: bytes
    bad: bytes
    slope: float
    bias: float
    cut: float
    level: int = 3

    def packers(self) -> tuple[zstandard.ZstdCompressor, zstandard.ZstdCompressor]:
        out = []
        for raw in (self.good, self.bad):
            d = zstandard.ZstdCompressionDict(raw)
            d.precompute_compress(level=self.level)
            out.append(zstandard.ZstdCompressor(level=self.level, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False))
        return out[0], out[1]


def raw_score(text: str | None, good: zstandard.ZstdCompressor, bad: zstandard.ZstdCompressor) -> float:
    """Normalised compressed-size difference of the whole text; 0 for a null or an empty one."""
    if not text:
        return 0.0
    b = text.encode("utf-8", "replace")
    g = w = 0
    for i in range(0, len(b), BLOCK):
        block = b[i : i + BLOCK]
        g += len(good.compress(block))
        w += len(bad.compress(block))
    return (w - g) / max(w, g)


def _dictionary(texts: list[bytes], size: int) -> bytes:
    """A trained dictionary, or a raw one of the text itself where there is too little to train on."""
    blocks = [t[i : i + BLOCK] for t in texts for i in range(0, len(t), BLOCK)]
    try:
        return zstandard.train_dictionary(size, blocks).as_bytes()
    except zstandard.ZstdError:
        return b"".join(blocks)[-size:] or b" " * 8


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Slope and bias, by Newton steps; classes weigh the same."""
    if len(set(y.tolist())) < 2:
        return 1.0, 0.0
    a = np.stack([x, np.ones_like(x)], 1)
    w = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum())
    t = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ t, -30, 30)))
        step = np.linalg.solve((a * (w * p * (1 - p))[:, None]).T @ a + ridge * np.diag([1e-3, 1e-3]), a.T @ (w * (p - y)) + ridge * 1e-3 * t)
        t = t - step
        if abs(step).max() < 1e-9:
            break
    return float(t[0]), float(t[1])


def fit(docs: DataFrame, labels: DataFrame, max_rows_per_class: int = 2000, dictionary_bytes: int = 65536, max_good_rejected: float = 0.01, level: int = 3) -> QualityModel:
    """Train on at most max_rows_per_class labelled documents of each class (a sample by hash of doc_id).

    labels has doc_id and quality (1 good, 0 bad). Null labels, null texts, ids that aren't in docs, and ids that
    are labelled both ways don't count; repeated rows count once. Half of the sample trains the dictionaries,
    the other half the calibration. With no usable row of a class everything is kept.
    """
    marked = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").cast("int").alias("q"), F.max("quality").cast("int").alias("q2")).where("q = q2")
    mine = [marked.where(f"q = {q}").orderBy(*C.sample_order("doc_id")).limit(max_rows_per_class) for q in (0, 1)]
    ids = mine[0].union(mine[1]).select(F.col("doc_id").alias("id"), "q")  # bounded by the parameter, so it may be broadcast
    rows = C.id_text(docs).join(F.broadcast(ids), "id").where("length(text) > 0").select("id", "q", "text").collect()
    by: dict[int, dict[tuple[int, str], bytes]] = {0: {}, 1: {}}
    for r in sorted(rows, key=lambda r: (r["id"], r["text"])):
        by[r["q"]][r["id"], r["text"]] = r["text"].encode("utf-8", "replace")
    texts = {q: list(v.values()) for q, v in by.items()}
    if not texts[0] or not texts[1]:
        return QualityModel(b" " * 8, b" " * 8, 1.0, 0.0, 0.0, level)
    model = QualityModel(_dictionary(texts[1][::2], dictionary_bytes), _dictionary(texts[0][::2], dictionary_bytes), 1.0, 0.0, 0.0, level)
    g, b = model.packers()
    held = {q: texts[q][1::2] or texts[q] for q in texts}
    x = np.array([raw_score(t.decode("utf-8"), g, b) for q in (0, 1) for t in held[q]])
    y = np.array([q for q in (0, 1) for _ in held[q]])
    slope, bias = _logistic(x, y)
    p = 1 / (1 + np.exp(-np.clip(slope * x + bias, -30, 30)))
    return QualityModel(model.good, model.bad, slope, bias, float(min(0.5, np.quantile(p[y == 1], max_good_rejected))), level)


def _scorer(model: QualityModel):
    packers: list = []

    @F.pandas_udf("double")
    def p_good(text: pd.Series) -> pd.Series:
        if not packers:
            packers.extend(model.packers())
        s = np.array([raw_score(t, *packers) for t in text], float)
        return pd.Series(1 / (1 + np.exp(-np.clip(model.slope * s + model.bias, -30, 30))))

    return p_good


def score(docs: DataFrame, model: QualityModel) -> DataFrame:
    """(doc_id, p_good, keep) for every row; an empty or null text can't be judged and is kept (p_good is that of score 0)."""
    d = C.id_text(docs)
    p = d.select(F.col("id").alias("doc_id"), _scorer(model)("text").alias("p_good"), (F.length(F.coalesce("text", F.lit(""))) == 0).alias("blank"))
    return p.select("doc_id", "p_good", (F.col("blank") | (F.col("p_good") >= model.cut)).alias("keep"))


def keep_good(docs: DataFrame, model: QualityModel) -> DataFrame:
    """The rows, with all their columns, that score() keeps."""
    p = C.free_name(docs, "p_good")
    d = docs.withColumn(p, _scorer(model)(F.col("text").cast("string")))
    return d.where((F.length(F.coalesce(F.col("text"), F.lit(""))) == 0) | (F.col(f"`{p}`") >= model.cut)).select(*[F.col(f"`{c}`") for c in docs.columns])


def op9_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    return score(docs, fit(docs, C.table(spark, sf_dir, "labels")))


QUERIES = {"op9_quality_classifier": op9_quality_classifier}
SQL: dict[str, str] = {}
