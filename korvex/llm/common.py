"""Shared pieces of the text operators: tables, hashing, Arrow batches, connected groups.

Conventions that hold for every operator of the subpackage:

* Only the named id and text columns are read; any other column, whatever its name, is ignored
  or (in filtering stages) passed through untouched.
* A null text counts as an empty one; what an empty text gives is stated by each operator.
* A null id is kept as a null id where one row goes in and one comes out, and is left out of
  pairs and groups, which have to name both sides.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from korvex.sources.store import scratch, shared_folder

M1 = np.uint64(0x9E3779B97F4A7C15)
M2 = np.uint64(0xBF58476D1CE4E5B9)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns id and text, and nothing else of the input."""
    return df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that the table doesn't have yet."""
    have = {c.lower() for c in df.columns}
    name = f"__{wanted}"
    while name.lower() in have:
        name += "_"
    return name


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    x = x ^ (x >> np.uint64(31))
    x = x * M2
    return x ^ (x >> np.uint64(29))


def words(text: str | None) -> list[str]:
    """Lower-cased words between white space."""
    return text.lower().split() if text else []


def word_hashes(ws: list[str]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, ws), dtype=np.uint64, count=len(ws))


def ngram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n words, in order; a shorter text has one gram of all its words, an empty one none."""
    if not len(h):
        return h
    n = min(n, len(h))
    out = np.zeros(len(h) - n + 1, np.uint64)
    for i in range(n):
        out = out * M1 + h[i : len(h) - n + 1 + i]
    return mix(out + np.uint64(n))


def gram_set(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct n-gram hashes."""
    return np.unique(ngram_hashes(word_hashes(words(text)), n))


def bounded(sizes: Sequence[int], most: int = 4_000_000) -> Iterator[slice]:
    """Stretches of rows, each ended by the row with which its sizes reach `most`."""
    start = size = 0
    for k, n in enumerate(sizes):
        size += n
        if size >= most:
            yield slice(start, k + 1)
            start, size = k + 1, 0
    if start < len(sizes):
        yield slice(start, len(sizes))


def cut_batches(rows: Iterator[pa.RecordBatch], text: int = 1, most_chars: int = 4_000_000) -> Iterator[tuple[pa.RecordBatch, list]]:
    """(batch, its texts) of Arrow batches, cut so that a piece has bounded text; text is that column's place. No more than a piece becomes Python values."""
    for b in rows:
        for s in bounded(pc.fill_null(pc.utf8_length(b.column(text)), 0).to_pylist(), most_chars):
            part = b.slice(s.start, s.stop - s.start)
            yield part, part.column(text).to_pylist()


def batches(rows: Iterator[pa.RecordBatch], most_chars: int = 4_000_000) -> Iterator[tuple[list, list]]:
    """(ids, texts) of Arrow batches with the columns id and text, cut so that a piece has bounded text."""
    for b, texts in cut_batches(rows, 1, most_chars):
        yield b.column(0).to_pylist(), texts


def list_array(values: np.ndarray, lengths, kind: pa.DataType) -> pa.ListArray:
    """Lists of the given lengths from one flat array."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def checkpointed(df: DataFrame) -> DataFrame:
    """The table with its lineage cut, in the shared folder that the session names (see store.shared_folder)."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """The table written as Parquet in the shared folder, and read again; store.clear_scratch() deletes it."""
    path = scratch(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def small_join(big: DataFrame, small: DataFrame, on: str, how: str, most_rows: int = 50_000) -> DataFrame:
    """A join that sends the small side to all executors if it has at most most_rows rows, and shuffles otherwise."""
    small = checkpointed(small)
    return big.join(F.broadcast(small) if small.count() <= most_rows else small, on, how)


def connected_groups(edges: DataFrame, a: str, b: str, most_rounds: int = 60) -> DataFrame:
    """(node, label): label is the smallest node that an undirected edge list connects with the node.

    Alternating large-star and small-star rounds, each of two shuffles of the remaining edges; the number of
    rounds grows with the logarithm of the longest chain. Null and looping edges are dropped. Raises when
    most_rounds aren't enough, rather than returning a partial result.
    """
    e = checkpointed(edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).distinct())
    mark = _edge_mark(e)
    for _ in range(most_rounds):
        if mark[0] == 0:
            break
        both = e.select(F.col("lo").alias("u"), F.col("hi").alias("v")).union(e.select(F.col("hi").alias("u"), F.col("lo").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("m").alias("lo"), F.col("v").alias("hi")).where("lo < hi").distinct()
        m = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(m, "hi").select(F.col("m").alias("lo"), F.explode(F.array("hi", "lo")).alias("hi")).where("lo < hi").distinct()
        e = checkpointed(small)
        now = _edge_mark(e)
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"groups didn't settle in {most_rounds} rounds")
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("label")).union(e.select(F.col("lo").alias("node"), F.col("lo").alias("label")).distinct())


def _edge_mark(e: DataFrame) -> tuple:
    r = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)")).alias("s")).first()
    return (r["n"], r["s"])


def sample_order(c: str, seed: int = 0) -> list[Column]:
    """Order of a reproducible sample."""
    return [F.xxhash64(F.col(c), F.lit(seed)), F.col(c)]
