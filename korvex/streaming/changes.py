"""The change log as a stream, and a table of newest documents kept from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from korvex.sources.store import LOG, exists, folders, remove


def changes(spark: SparkSession, path: str, from_seq: int = 1, files_per_trigger: int | None = None) -> DataFrame:
    """Log rows of a store as they are committed, from a sequence number on, that one included."""
    r = spark.readStream.schema(LOG)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    return r.parquet(f"{path}/log").where(F.col("seq") >= from_seq)


def keep_latest(stream: DataFrame, target: str, checkpoint: str, buckets: int = 16) -> DataStreamWriter:
    """Merges each micro-batch into a table of the newest row of each key, delete rows included.

    Keys are dealt to buckets. A batch writes the buckets that it touches to a folder of its number, and then a list of
    where each bucket stands; so repeating a batch after a failure gives the same table. What only lists before the last
    one name is deleted. A batch that doesn't find the list before it raises.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = _places(spark, target, number - 1) if number else {}
        rows = batch.select(*_fields()).withColumn("bucket", F.pmod(F.xxhash64("namespace", "id"), F.lit(buckets)).cast("int"))
        rows = rows.persist()
        touched = [r["bucket"] for r in rows.select("bucket").distinct().collect()]  # at most one row a bucket
        old = _read(spark, target, {b: v for b, v in before.items() if b in touched})
        newest = old.unionByName(rows).groupBy("bucket", "namespace", "id").agg(F.max_by(F.struct(*_fields()), "seq").alias("x")).select("bucket", "x.*")
        newest.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{target}/version={number}")
        now = before | dict.fromkeys(touched, number)
        spark.createDataFrame([(b, v) for b, v in now.items()], "bucket int, version long").coalesce(1).write.mode("overwrite").parquet(f"{target}/list={number}")
        rows.unpersist()
        needed = {number, *before.values(), *now.values()}
        for name in folders(spark, target):
            kind, _, n = name.partition("=")
            if kind == "list" and int(n) < number - 1 or kind == "version" and int(n) not in needed:
                remove(spark, f"{target}/{name}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)


def _fields() -> list[str]:
    return ["seq", "ts", "op", "namespace", "id", "dense", "sparse", "text_fields", "payload"]


def _places(spark: SparkSession, target: str, number: int) -> dict[int, int]:
    """The version that each bucket stands in, by the list of a batch."""
    if not exists(spark, f"{target}/list={number}/_SUCCESS"):
        raise RuntimeError(f"{target} has no list of batch {number}, though there was one: rows before it would be lost")
    return {r["bucket"]: r["version"] for r in spark.read.schema("bucket int, version long").parquet(f"{target}/list={number}").collect()}


def _read(spark: SparkSession, target: str, places: dict[int, int]) -> DataFrame:
    """(LOG, bucket) of buckets."""
    out = spark.createDataFrame([], f"{LOG}, bucket int")
    for v in sorted(set(places.values())):
        own = spark.read.schema(f"{LOG}, bucket int").option("basePath", f"{target}/version={v}").parquet(*[f"{target}/version={v}/bucket={b}" for b, x in places.items() if x == v])
        out = out.unionByName(own)
    return out


def current(spark: SparkSession, target: str) -> DataFrame:
    """The newest documents that keep_latest wrote."""
    done = [int(n.split("=")[1]) for n in folders(spark, target) if n.startswith("list=") and exists(spark, f"{target}/{n}/_SUCCESS")]
    rows = _read(spark, target, _places(spark, target, max(done))) if done else spark.createDataFrame([], f"{LOG}, bucket int")
    return rows.where("op <> 'delete'").drop("bucket")  # one row a key
