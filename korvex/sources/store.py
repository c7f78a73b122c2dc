"""A document store on a change log: Parquet rows (namespace, seq, ts, op, id, dense, sparse, text_fields, payload).

The newest row of each (namespace, id) up to a sequence number is the document; a delete row hides it. One writer a
store assigns sequence numbers, from 1 and without gaps. Files are committed by Spark, so a torn tail can't be read.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DOCUMENT = "namespace string, id string, dense array<float>, sparse struct<indices: array<bigint>, values: array<float>>, text_fields map<string,string>, payload string"
LOG = f"seq bigint, ts timestamp, op string, {DOCUMENT}"
MOST_SENT = 50_000  # keys of a log after a snapshot that may go to every task
COLUMNS = ["namespace", "id", "dense", "sparse", "text_fields", "payload"]


def to_json(value) -> str:
    """JSON of a payload; numbers that JSON lacks become null, anything else unknown its text."""

    def clean(x):
        if isinstance(x, float) and (x != x or x in (float("inf"), float("-inf"))):
            return None
        if isinstance(x, Mapping):
            return {str(k): clean(v) for k, v in x.items()}
        if isinstance(x, (list, tuple)):
            return [clean(v) for v in x]
        return x if x is None or isinstance(x, (bool, int, float, str)) else str(x)

    return json.dumps(clean(value))


def file_system(spark: SparkSession, path: str):
    """(Hadoop path, its file system)."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = file_system(spark, path)
    return fs.exists(p)


def remove(spark: SparkSession, path: str) -> bool:
    """Deletes a folder with all in it; whether there was one."""
    p, fs = file_system(spark, path)
    return bool(fs.delete(p, True))


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none where there is no folder."""
    p, fs = file_system(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, which all executors share.

    Where none is set, one beside the warehouse is used by a local master; on a cluster that raises, as the warehouse
    may be a folder of one machine.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or spark.conf.get("spark.sql.warehouse.dir") + "/checkpoints")
    return sc._jsc.sc().getCheckpointDir().get()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder for a table that is needed in this session only."""
    return f"{shared_folder(spark)}/korvex-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> bool:
    """Deletes what scratch() gave paths for; results that read it must have been written."""
    return remove(spark, f"{shared_folder(spark)}/korvex-{spark.sparkContext.applicationId}")


class Store:
    def __init__(self, spark: SparkSession, path: str, dim: int | None = None):
        self.spark, self.path, self.dim = spark, path.rstrip("/"), dim

    def log(self) -> DataFrame:
        if not exists(self.spark, f"{self.path}/log"):
            return self.spark.createDataFrame([], LOG)
        return self.spark.read.schema(LOG).parquet(f"{self.path}/log")

    def sequence(self) -> int:
        """The last sequence number given, 0 for an empty log."""
        return self.log().agg(F.max("seq")).first()[0] or 0

    def documents(self, rows: Iterable[Mapping] | DataFrame, namespace: str = "default") -> DataFrame:
        """Rows as a table of documents. A mapping has id and any of dense, sparse_indices with sparse_values, text_fields, payload, namespace."""
        if isinstance(rows, DataFrame):
            have = set(rows.columns)
            kinds = dict(x.strip().split(" ", 1) for x in ("namespace string", "id string", "dense array<float>", "sparse struct<indices: array<bigint>, values: array<float>>", "text_fields map<string,string>", "payload string"))
            own = rows.select(*[(F.col(c).cast(t) if c in have else F.lit(namespace if c == "namespace" else None).cast(t)).alias(c) for c, t in kinds.items()])
            refuse = lambda why: F.raise_error(F.lit(why))
            whole = F.col("sparse").isNull() | F.coalesce(F.size("sparse.indices") == F.size("sparse.values"), F.lit(False))
            return own.withColumns({
                "id": F.when(F.col("id").isNull(), refuse("a document needs an id")).otherwise(F.col("id")),
                "namespace": F.coalesce("namespace", F.lit(namespace)),
                "sparse": F.when(~whole, refuse("sparse indices and values come together and are of one length")).otherwise(F.col("sparse")),
            })
        out = []
        for r in rows:
            i, v = r.get("sparse_indices"), r.get("sparse_values")
            if (i is None) != (v is None) or i is not None and len(i) != len(v):
                raise ValueError("sparse indices and values come together and are of one length")
            if r.get("id") is None:
                raise ValueError("a document needs an id")
            dense = r.get("dense")
            if dense is not None and self.dim is not None and len(dense) != self.dim:
                raise ValueError(f"a vector of {len(dense)} numbers, {self.dim} expected")
            out.append((r.get("namespace", namespace), str(r["id"]), [float(x) for x in dense] if dense is not None else None, None if i is None else (list(map(int, i)), list(map(float, v))), r.get("text_fields"), None if r.get("payload") is None else to_json(r["payload"])))
        return self.spark.createDataFrame(out, DOCUMENT)

    def _append(self, docs: DataFrame, op: str) -> int:
        """Two passes: rows with their place are written first, so that numbering is the same if a task is repeated."""
        stage = f"{self.path}/stage/{uuid.uuid4().hex}"
        if self.dim is not None:
            ok = F.col("dense").isNull() | (F.size("dense") == self.dim)
            docs = docs.withColumn("dense", F.when(ok, F.col("dense")).otherwise(F.raise_error(F.lit("a vector of another length"))))
        place = F.monotonically_increasing_id()
        docs.withColumn("part", F.shiftright(place, 33)).withColumn("row", place.bitwiseAND(F.lit((1 << 33) - 1))).write.parquet(stage)
        rows = self.spark.read.parquet(stage)
        at, offsets = self.sequence(), []
        for r in sorted(rows.groupBy("part").count().collect(), key=lambda r: r["part"]):
            offsets.append((r["part"], at))
            at += r["count"]
        if offsets:
            base = self.spark.createDataFrame(offsets, "part long, base long")  # a row for each task of the write
            numbered = rows.join(F.broadcast(base), "part").withColumn("seq", F.col("base") + F.col("row") + 1)
            numbered.select("seq", F.current_timestamp().alias("ts"), F.lit(op).alias("op"), *COLUMNS).write.mode("append").parquet(f"{self.path}/log")
        remove(self.spark, stage)
        return at

    def upsert(self, rows: Iterable[Mapping] | DataFrame, namespace: str = "default") -> int:
        """Adds or replaces documents and returns the last sequence number. Nothing is written if a row is wrong."""
        return self._append(self.documents(rows, namespace), "upsert")

    def delete(self, ids: Iterable[str], namespace: str = "default") -> list[str]:
        """Hides documents and returns the ids that were there."""
        wanted = self.spark.createDataFrame([(namespace, str(i)) for i in ids], "namespace string, id string")
        there = [r["id"] for r in self.view().join(wanted, ["namespace", "id"], "left_semi").select("id").collect()]
        self._append(self.documents(wanted), "delete")
        return sorted(there)

    def view(self, as_of: int | None = None, namespace: str | None = None) -> DataFrame:
        """Documents as they are, or were at a sequence number. From the newest fitting snapshot and the log after it.

        A snapshot's rows are read as they are, without those that the log after it names; only that log is shuffled.
        """
        log, base = self.log(), None
        for s in sorted(self.snapshots(), reverse=True):
            if as_of is None or s <= as_of:
                base = self.spark.read.schema(f"seq bigint, ts timestamp, op string, {DOCUMENT}").parquet(f"{self.path}/snapshots/seq={s}")
                log = log.where(F.col("seq") > s)
                break
        if as_of is not None:
            log = log.where(F.col("seq") <= as_of)
        if namespace is not None:
            log, base = log.where(F.col("namespace") == namespace), base if base is None else base.where(F.col("namespace") == namespace)
        if base is None:
            return latest(log)
        named = log.select("namespace", "id").distinct()
        if named.limit(MOST_SENT + 1).count() <= MOST_SENT:
            named = F.broadcast(named)
        return base.join(named, ["namespace", "id"], "left_anti").select(*log.columns).unionByName(latest(log))

    def get(self, ids: Iterable[str], namespace: str = "default") -> DataFrame:
        """(id, payload) of the documents that are there."""
        return self.view(namespace=namespace).where(F.col("id").isin(*map(str, ids))).select("id", "payload")

    def count(self, namespace: str | None = None) -> int:
        """Documents that have a payload."""
        return self.view(namespace=namespace).where("payload is not null").count()

    def tenants(self) -> list[str]:
        """Names of namespaces with documents, in order."""
        return [r["namespace"] for r in self.view().select("namespace").distinct().orderBy("namespace").collect()]

    def snapshots(self) -> list[int]:
        """Sequence numbers of snapshots that were written whole."""
        names = folders(self.spark, f"{self.path}/snapshots")
        return [int(n.split("=")[1]) for n in names if exists(self.spark, f"{self.path}/snapshots/{n}/_SUCCESS")]

    def snapshot(self) -> int:
        """Writes the documents as they are; later views start there. Returns its sequence number."""
        s = self.sequence()
        self.view().select("seq", "ts", F.lit("upsert").alias("op"), *COLUMNS).write.mode("overwrite").parquet(f"{self.path}/snapshots/seq={s}")
        return s

    def restore(self, seq: int) -> DataFrame:
        """Documents of a snapshot without the log after it."""
        if seq not in self.snapshots():
            raise ValueError(f"no snapshot {seq}; there are {sorted(self.snapshots())}")
        return self.spark.read.parquet(f"{self.path}/snapshots/seq={seq}")

    def tail(self, from_seq: int = 1) -> DataFrame:
        """Log rows from a sequence number on, that one included, in order."""
        return self.log().where(F.col("seq") >= from_seq).orderBy("seq")

    def stats(self) -> DataFrame:
        """For each namespace: documents with each part, vocabulary of sparse tokens, dimension, and the last sequence number."""
        v = self.view()
        size = v.groupBy("namespace").agg(
            F.count("*").alias("documents"),
            F.count("dense").alias("dense"),
            F.count("sparse").alias("sparse"),
            F.count("text_fields").alias("texts"),
            F.count("payload").alias("payloads"),
            F.max(F.size("dense")).alias("dim"),
        )
        words = v.select("namespace", F.explode("sparse.indices").alias("t")).groupBy("namespace").agg(F.countDistinct("t").alias("vocabulary"))
        last = self.log().groupBy("namespace").agg(F.max("seq").alias("seq"))
        return size.join(words, "namespace", "left").join(last, "namespace", "left").fillna(0, ["vocabulary"])

    def catalog(self) -> DataFrame:
        """(namespace, documents) of each namespace, and their total under a null namespace."""
        return self.view().rollup("namespace").agg(F.count("*").alias("documents"))


def latest(rows: DataFrame, keys: tuple[str, ...] = ("namespace", "id")) -> DataFrame:
    """The newest row of each key that isn't a delete."""
    w = Window.partitionBy(*keys).orderBy(F.col("seq").desc())
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1 and op <> 'delete'").drop("__n")


def all_stats(stores: Mapping[str, Store]) -> DataFrame:
    """Stats of several stores under their names; one that can't be read gives a row with its error."""
    out = None
    for name, s in stores.items():
        try:
            rows = s.stats().withColumn("error", F.lit(None).cast("string"))
            rows.isEmpty()  # what can't be read fails here
        except Exception as e:  # noqa: BLE001
            rows = s.spark.createDataFrame([(None,) * 8 + (0, str(e).split("\n")[0])], "namespace string, documents long, dense long, sparse long, texts long, payloads long, dim int, seq long, vocabulary long, error string")
        rows = rows.withColumn("store", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("no store is named")
    return out


def random_vectors(spark: SparkSession, n: int, dim: int, seed: int = 0) -> DataFrame:
    """(id, vector): n unit vectors of Gaussian direction."""
    from korvex.functions.vector import normalize

    raw = F.array(*[F.randn(seed + k) for k in range(dim)])
    return spark.range(n).select(F.format_string("vec_%08d", "id").alias("id"), raw.alias("v")).select("id", normalize(F.col("v")).alias("vector"))
