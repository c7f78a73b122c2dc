"""Retrieval pipelines: a list of named stages over a result list.

Results are a table (id, score, payload JSON, vector, pos); pos is the place in the list. A result list is bounded by
the top_k of the search that made it, which is why stages may order it as a whole.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from korvex.operators import filters, mmr, topk
from korvex.plans.engine import hybrid_search
from korvex.sources import store

RESULT = "id string, score double, payload string, vector array<double>, pos bigint"


@dataclass
class Context:
    """What stages work on: documents to search, other namespaces to enrich from, the results and what stages say of them.

    text_index is a stored index of the documents (bm25.write_index), if there is one.
    """

    docs: DataFrame
    results: DataFrame
    others: Mapping[str, DataFrame] = field(default_factory=dict)
    metadata: dict = field(default_factory=dict)
    text_fields: Sequence[str] = ("text",)
    text_index: str | None = None


Stage = Callable[[Context, Mapping], DataFrame]
STAGES: dict[str, Stage] = {}


def register_stage(name: str) -> Callable[[Stage], Stage]:
    """Makes a function (context, parameters) -> results a stage."""

    def add(f: Stage) -> Stage:
        STAGES[name] = f
        return f

    return add


def placed(df: DataFrame, *order: Column) -> DataFrame:
    """pos anew, from 0, by the given order and then the old pos or id."""
    w = Window.partitionBy(F.lit(1)).orderBy(*order, *(["pos"] if "pos" in df.columns else ["id"]))
    return df.withColumn("pos", F.row_number().over(w).cast("long") - 1)


def listed(results: DataFrame) -> DataFrame:
    """A result list that is read several times: written in the shared folder, so that its search is run once."""
    path = store.scratch(results.sparkSession, "results")
    results.write.parquet(path)
    return results.sparkSession.read.schema(results.schema).parquet(path)


def payload() -> Column:
    return filters.variant(F.col("payload"))


def text_of(name: str) -> Column:
    """A payload field as text; null where it is missing, "None" where it is null, as in the list of groups."""
    v = filters.get(payload(), name)
    k = F.schema_of_variant(v)
    b = F.try_variant_get(v, "$", "boolean")
    return F.when(v.isNull(), F.lit(None)).when(k == "VOID", F.lit("None")).when(k == "BOOLEAN", F.when(b, "True").otherwise("False")).when(k == "STRING", F.try_variant_get(v, "$", "string")).otherwise(F.to_json(v))


def number_of(name: str) -> Column:
    """A field as a number: score, or a payload field that is a number, a boolean or a number in text."""
    v = filters.get(payload(), name)
    own = F.coalesce(filters._loose_number(v), F.when(F.schema_of_variant(v) == "STRING", F.trim(F.try_variant_get(v, "$", "string")).try_cast("double")))
    return F.coalesce(F.col("score"), F.lit(0.0)) if name == "score" else own


@register_stage("feature_search")
def feature_search(ctx: Context, p: Mapping) -> DataFrame:
    i, v = p.get("sparse_indices"), p.get("sparse_values")
    found = hybrid_search(ctx.docs, p.get("top_k", 50), p.get("dense_vector"), None if i is None else (i, v), p.get("text_query"), p.get("fusion", "rrf"), p.get("weights"), p.get("filter"), p.get("filter_mode", "post"), text_fields=ctx.text_fields, text_index=ctx.text_index)
    kept = ctx.docs.select(F.col("id").cast("string").alias("id"), "payload" if p.get("include_payloads", True) else F.lit(None).cast("string").alias("payload"), F.col("dense").cast("array<double>").alias("vector"))
    out = found.select(F.col("id").cast("string").alias("id"), "score").join(kept, "id", "left")
    return placed(out, F.col("score").desc()).select("id", "score", "payload", "vector", "pos")


@register_stage("attribute_filter")
def attribute_filter(ctx: Context, p: Mapping) -> DataFrame:
    return ctx.results.where(filters.compile_conditions(p.get("conditions", []), payload(), p.get("logic", "and")))


@register_stage("sort_relevance")
def sort_relevance(ctx: Context, p: Mapping) -> DataFrame:
    s = F.coalesce("score", F.lit(0.0))
    return placed(ctx.results, s.desc() if p.get("order", "desc") == "desc" else s.asc())


@register_stage("sort_attribute")
def sort_attribute(ctx: Context, p: Mapping) -> DataFrame:
    """Numbers before texts (a mix doesn't fail), missing values last or first whatever the order."""
    if not p.get("field"):
        return ctx.results
    n, t, down = number_of(p["field"]), text_of(p["field"]), p.get("order", "asc") == "desc"
    v = filters.get(payload(), p["field"])
    none = v.isNull() | (F.schema_of_variant(v) == "VOID")
    first = p.get("missing", "last") == "first"
    order = [none.desc() if first else none.asc()]
    order += [n.desc_nulls_last(), F.when(n.isNull(), t).desc_nulls_last()] if down else [n.asc_nulls_last(), F.when(n.isNull(), t).asc_nulls_last()]
    return placed(ctx.results, *order)


@register_stage("sample")
def sample(ctx: Context, p: Mapping) -> DataFrame:
    """head, tail or random (by md5 of id and seed); n of 0 gives no row with each; another method changes nothing."""
    n, method = max(0, p.get("n", 10)), p.get("method", "head")
    if method == "head":
        return ctx.results.orderBy("pos").limit(n)
    if method == "tail":
        return ctx.results.orderBy(F.col("pos").desc()).limit(n)
    if method == "random":
        key = F.md5(F.concat("id", F.lit("|"), F.lit(str(p.get("seed")))))
        return placed(ctx.results.orderBy(key, "id").limit(n).drop("pos").withColumn("pos", F.lit(0).cast("long")), key)
    return ctx.results


@register_stage("group_by")
def group_by(ctx: Context, p: Mapping) -> DataFrame:
    """The first top_k_per_group of each value, groups in the order they first appear; metadata groups has their sizes after that."""
    if not p.get("field"):
        return ctx.results
    key = F.coalesce(text_of(p["field"]), F.lit("__none__"))
    d = ctx.results.withColumn("__key", key)
    w = Window.partitionBy("__key")
    d = d.withColumn("__n", F.row_number().over(w.orderBy("pos"))).withColumn("__first", F.min("pos").over(w)).where(F.col("__n") <= p.get("top_k_per_group", 3))
    ctx.metadata["groups"] = d.groupBy(F.col("__key").alias("group")).agg(F.count("*").alias("count"))
    return placed(d, F.col("__first")).drop("__key", "__n", "__first")


@register_stage("aggregate")
def aggregate(ctx: Context, p: Mapping) -> DataFrame:
    """count counts all results; sum and avg are 0 and min and max null without a number. Results stay. Unknown operations don't count."""
    cols = []
    for o in p.get("operations", []):
        op, name = o.get("op"), o.get("field", "score")
        x, alias = number_of(name), o.get("alias") or f"{o.get('op')}_{o.get('field', 'score')}"
        made = {"count": F.count(F.lit(1)), "sum": F.coalesce(F.sum(x), F.lit(0.0)), "avg": F.coalesce(F.avg(x), F.lit(0.0)), "min": F.min(x), "max": F.max(x)}.get(op)
        if made is not None:
            cols.append(made.alias(alias))
    ctx.metadata["aggregations"] = ctx.results.agg(*cols) if cols else None
    return ctx.results


@register_stage("mmr")
def mmr_stage(ctx: Context, p: Mapping) -> DataFrame:
    if not p.get("dense_vector"):
        return ctx.results
    out = mmr.mmr(ctx.results, p["dense_vector"], p.get("k", 10), p.get("lambda", 0.5), "cosine", "vector", clamp=False)
    return out.withColumn("pos", F.col("mmr_rank").cast("long") - 1).drop("mmr_rank")


@register_stage("document_enrich")
def document_enrich(ctx: Context, p: Mapping) -> DataFrame:
    """Puts fields of the nearest document of another namespace, and its score, into the payload under names with a prefix.

    vector_field names a list of numbers in the payload to search by, in place of the row's vector. Of top_k matches
    the best one counts. A field that is there already is replaced. Rows without a vector, and all rows where no
    namespace is named or it has no vectors, stay as they are.
    """
    if not p.get("target_namespace"):
        return ctx.results
    other, prefix = ctx.others[p["target_namespace"]], p.get("prefix", "enriched_")
    results = listed(ctx.results)
    name = p.get("vector_field", "dense_vector")
    by = F.col("vector") if name == "dense_vector" else F.try_variant_get(filters.get(payload(), name), "$", "array<double>")
    left = results.select("pos", by.alias("vector")).where(F.size("vector") > 0)
    right = other.where(F.col("dense").isNotNull()).select("id", F.col("dense").cast("array<double>").alias("dense"), "payload").withColumn("rid", F.xxhash64("id"))
    best = topk.knn_join(left, right, 1, "cosine", "pos", "rid", "vector", "dense")
    found = best.select(F.col("left_id").alias("pos"), F.col("right_id").alias("rid"), F.col("score").alias("__score")).join(right.select("rid", F.col("payload").alias("__payload")), "rid").drop("rid")
    wanted = list(p.get("attach_fields", []))

    @F.pandas_udf("string")
    def merged(own: pd.Series, theirs: pd.Series, score: pd.Series) -> pd.Series:
        out = []
        for a, b, x in zip(own, theirs, score):
            if x is None or x != x:
                out.append(a)
                continue
            mine, got = (json.loads(t) if t else {} for t in (a, b))
            got = got if isinstance(got, dict) else {}
            mine = mine if isinstance(mine, dict) else {}
            out.append(json.dumps(mine | {f"{prefix}{k}": got[k] for k in (wanted or got) if k in got} | {f"{prefix}score": x}))
        return pd.Series(out, dtype=object)

    out = results.join(found, "pos", "left")
    return out.withColumn("payload", merged("payload", "__payload", "__score")).select(*results.columns)


@register_stage("rerank")
def rerank(ctx: Context, p: Mapping) -> DataFrame:
    """The first top_k, by a scorer (a Column of the results) if there is one."""
    d = ctx.results if p.get("scorer") is None else placed(ctx.results.withColumn("score", p["scorer"]), F.col("score").desc())
    return d if p.get("top_k") is None else d.orderBy("pos").limit(max(0, p["top_k"]))


@register_stage("llm_filter")
def llm_filter(ctx: Context, p: Mapping) -> DataFrame:
    """Rows that a predicate (a Column of the results) accepts; all without one."""
    return ctx.results if p.get("predicate") is None else ctx.results.where(p["predicate"])


@dataclass
class Outcome:
    results: DataFrame
    metadata: dict
    stages: list[dict]
    cancelled: bool = False


def execute(pipeline: Sequence[Mapping], ctx: Context, cancelled: Callable[[], bool] = lambda: False) -> Outcome:
    """Runs [{"stage": name, "params": {...}}] as one plan; nothing is read before the results are, but by document_enrich, which writes the list that it gets. An unknown stage raises."""
    for s in pipeline:
        if s["stage"] not in STAGES:
            raise ValueError(f"unknown stage {s['stage']!r}; one of {sorted(STAGES)}")
    done = []
    for s in pipeline:
        if cancelled():
            return Outcome(ctx.results, ctx.metadata, done, True)
        t = time.perf_counter()
        ctx.results = STAGES[s["stage"]](ctx, s.get("params", {}))
        done.append({"stage": s["stage"], "ms": (time.perf_counter() - t) * 1000})
    return Outcome(ctx.results, ctx.metadata, done)


def execute_streaming(pipeline: Sequence[Mapping], ctx: Context, cancelled: Callable[[], bool] = lambda: False) -> Iterator[dict]:
    """Events: stage_complete with its count for each stage, then done, cancelled or error. Each stage runs as it is asked for."""
    n, held = 0, None
    for s in pipeline:
        if cancelled():
            yield {"event": "cancelled", "stages_executed": n}
            return
        t = time.perf_counter()
        try:
            if s["stage"] not in STAGES:
                raise ValueError(f"unknown stage {s['stage']!r}")
            ctx.results = STAGES[s["stage"]](ctx, s.get("params", {})).cache()
            count = ctx.results.count()
            if held is not None:  # the next stage's results are kept by now
                held.unpersist()
            held = ctx.results
        except Exception as e:  # noqa: BLE001
            yield {"event": "error", "stage": s["stage"], "message": str(e)}
            return
        n += 1
        yield {"event": "stage_complete", "stage": s["stage"], "count": count, "ms": (time.perf_counter() - t) * 1000}
    yield {"event": "done", "stages_executed": n, "results": ctx.results, "metadata": ctx.metadata}


def start(docs: DataFrame, **more) -> Context:
    """A context with no results yet."""
    return Context(docs, docs.sparkSession.createDataFrame([], RESULT), **more)
