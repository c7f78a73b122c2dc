"""Edge cases that the tables don't hold."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from korvex.functions import extract, vector
from korvex.operators import bm25, filters, fusion, ivf, mmr, pq, routing, sparse, topk
from korvex.plans import engine, pipeline
from korvex.sources import ingest, store


def vecs(spark, rows):
    return spark.createDataFrame(rows, "id long, vector array<float>")


def test_zero_and_null_vectors_ties_and_k(spark):
    d = vecs(spark, [(3, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (4, None)])
    assert [tuple(r) for r in topk.topk(d, [1.0, 0.0], 5).collect()] == [(1, 1.0), (3, 1.0), (2, 0.0)]
    assert topk.topk(d, [1.0, 0.0], 0).count() == 0 and topk.topk(d.limit(0), [1.0, 0.0], 3).count() == 0
    with pytest.raises(Exception, match="expected"):
        topk.topk(d, [1.0, 0.0, 0.0], 1).collect()
    with pytest.raises(ValueError):
        vector.metric_name("hamming")


def test_blocks_of_the_join_agree(spark):
    r = np.random.default_rng(1).normal(size=(60, 4)).tolist()
    d = vecs(spark, list(enumerate(r)))
    a, b = (sorted(map(tuple, topk.knn_join(d, d, 3, block=n).select("left_id", "right_id", "rank").collect())) for n in (7, 1000))
    assert a == b
    c = ivf.train(d, 6)
    assert sorted(map(tuple, ivf.knn_join(d, c, 3, 6, block=5).select("left_id", "right_id", "rank").collect())) == a


def test_sparse(spark):
    d = spark.createDataFrame([(1, ([0, 2], [1.0, 0.5])), (2, ([2], [2.0])), (3, ([9], [1.0])), (4, None)], "id long, sparse struct<indices: array<bigint>, values: array<float>>")
    p = sparse.postings(d)
    assert [tuple(r) for r in sparse.search(p, [0, 2, 5], [1.0, 0.5, 0.0], 5).collect()] == [(1, 1.25), (2, 1.0)]
    with pytest.raises(ValueError):
        sparse.search(p, [1], [], 5)


def test_fusion(spark):
    lists = spark.createDataFrame([("a", "x", 0.9), ("a", "y", 0.1), ("b", "y", 3.0)], "modality string, id string, score double")
    rrf = {r["id"]: r["score"] for r in fusion.fuse(lists, 5).collect()}
    assert rrf["y"] == pytest.approx(1 / 62 + 1 / 61) and rrf["x"] == pytest.approx(1 / 61)
    dbsf = {r["id"]: r["score"] for r in fusion.fuse(lists, 5, "dbsf").collect()}
    assert dbsf == {"x": 1.0, "y": 0.0}  # a list of one row scores 0
    assert fusion.fuse(lists, 5, "linear", {"b": 0.5}).first()["score"] == pytest.approx(1.6)
    assert fusion.fuse(lists, 0).count() == 0
    with pytest.raises(ValueError):
        fusion.fuse(lists, 5, "max")


PAYLOADS = [{"a": 1}, {"a": 1.0}, {"a": True}, {"a": "1"}, {"a": None}, {}, {"a": [1, "x"]}, {"a": {"x": 2}}]


def kept(spark, column):
    d = spark.createDataFrame([(n, json.dumps(p)) for n, p in enumerate(PAYLOADS)] + [(8, None)], "n int, p string").withColumn("v", filters.variant(F.col("p")))
    return [r["n"] for r in d.where(column(F.col("v"))).orderBy("n").collect()]


@pytest.mark.parametrize(
    "tree, want",
    [
        ({"field": "a", "op": "eq", "value": 1}, [0]),
        ({"field": "a", "op": "eq", "value": 1.0}, [1]),
        ({"field": "a", "op": "eq", "value": True}, [2]),
        ({"field": "a", "op": "eq", "value": None}, [4]),
        ({"field": "a", "op": "ne", "value": 1}, [1, 2, 3, 4, 5, 6, 7]),
        ({"field": "a", "op": "gte", "value": 1}, [0, 1]),
        ({"not": {"field": "a", "op": "gt", "value": 0}}, [2, 3, 4, 5, 6, 7]),
        ({"field": "a", "op": "in", "value": [1, "1"]}, [0, 3]),
        ({"and": []}, [0, 1, 2, 3, 4, 5, 6, 7]),
        ({"or": []}, []),
        (None, [0, 1, 2, 3, 4, 5, 6, 7, 8]),
    ],
)
def test_strict_filters(spark, tree, want):
    assert kept(spark, lambda v: filters.compile_filter(tree, v)) == want


@pytest.mark.parametrize(
    "op, value, want",
    [("eq", 1, [0, 1, 2]), ("ne", 1, [3, 6, 7]), ("gte", "1", [0, 1, 2, 3]), ("contains", "x", [6, 7]), ("contains", 1, [6]), ("in", [1], [0, 1, 2]), ("near", 1, [])],
)
def test_loose_filters(spark, op, value, want):
    assert kept(spark, lambda v: filters.compile_conditions([{"field": "a", "op": op, "value": value}], v)) == want


def test_wrong_filters(spark):
    with pytest.raises(ValueError):
        filters.compile_filter({"field": "a", "op": "like"}, F.lit(None))
    with pytest.raises(ValueError):
        filters.compile_filter({"xor": []}, F.lit(None))
    assert kept(spark, lambda v: filters.compile_filter({"and": [{"xor": []}, {"field": "a", "op": "eq", "value": "1"}]}, v, strict=False)) == [3]


def test_bm25_language(spark):
    d = spark.createDataFrame([(1, "a b c"), (2, "b a"), (3, "c a b a b"), (4, None), (5, "a a a")], "id long, text string")
    ids = lambda q: sorted(r["id"] for r in bm25.search(d, q, 10).collect())
    assert ids('"a b"') == [1, 3] and ids("c OR (b AND NOT c)") == [1, 2, 3] and ids("+a -c") == [2, 5] and ids('"a a"') == [5] and ids("") == [] and ids("zz") == []
    with pytest.raises(ValueError):
        bm25.parse('"a')
    with pytest.raises(ValueError):
        bm25.parse("(a")


def greedy(v, q, lam, k):
    cos = lambda a, b: a @ b / max(np.sqrt((a @ a) * (b @ b)), 1e-10)
    s = np.array([cos(q, x) for x in v])
    rel, out = (s - s.min()) / max(s.max() - s.min(), 1e-10), []
    while len(out) < min(k, len(v)):
        value = [-9 if i in out else lam * rel[i] - (1 - lam) * (max((cos(v[i], v[o]) + 1) / 2 for o in out) if out else 0) for i in range(len(v))]
        out.append(int(np.argmax(np.round(value, 12))))
    return out


def test_mmr_against_a_loop(spark):
    v = np.random.default_rng(3).normal(size=(12, 5))
    d = spark.createDataFrame([(n, x.tolist(), n) for n, x in enumerate(v)], "id long, vector array<double>, pos long")
    q = [1.0, 0.5, 0.0, 0.0, -1.0]
    for lam in (0.0, 0.4, 1.0):
        assert [r["id"] for r in mmr.mmr(d, q, 5, lam).orderBy("mmr_rank").collect()] == greedy(v, np.array(q), lam, 5)
    none = d.withColumn("vector", F.lit(None).cast("array<double>"))
    assert [r["id"] for r in mmr.mmr(none, q, 2).orderBy("pos").collect()] == [0, 1]


def test_quantiser_against_numpy(spark):
    x = np.random.default_rng(5).uniform(-0.5, 0.5, (60, 8))
    d = vecs(spark, list(enumerate(x.tolist())))
    book = pq.train(d, 2, 8, 10)
    codes = {r["id"]: r["code"] for r in pq.encode(d, book).collect()}
    for i, v in enumerate(x.astype(np.float32).astype(float)):
        assert codes[i] == [int(((book.centres[p] - v[p * 4 : p * 4 + 4]) ** 2).sum(1).argmin()) for p in range(2)]
    assert book.size_bytes() == 2 * 8 * 4 * 4
    with pytest.raises(ValueError):
        pq.train(d, 3)


def test_centres_of_all_vectors(spark):
    """More rows than the 100,000 and 50,000 that training once stopped at: a round gives the means of all of them."""
    x = np.random.default_rng(9).uniform(-1, 1, (101_000, 4)).round(3)
    d = spark.createDataFrame(pd.DataFrame({"vector": x.tolist()}), "vector array<double>").repartition(8)
    for train, shape in ((lambda n: pq.train(d, 2, 3, n).centres, (2, 3, 2)), (lambda n: ivf.train(d, 3, rounds=n)[None], (1, 3, 4))):
        before, after = train(0), train(1)
        assert before.shape == after.shape == shape
        for p, (c, got) in enumerate(zip(before, after)):
            own = x[:, p * shape[2] : (p + 1) * shape[2]]
            near = ((own[:, None] - c[None]) ** 2).sum(2).argmin(1)
            assert np.allclose(got, [own[near == k].mean(0) for k in range(3)], rtol=0, atol=1e-6)


def test_ring():
    r = routing.HashRing(["a", "b", "c"])
    before = {k: r.get_node(str(k)) for k in range(500)}
    r.remove("b")
    assert all(r.get_node(str(k)) == n for k, n in before.items() if n != "b")
    assert sorted(r.get_nodes("x", 5)) == ["a", "c"] and routing.HashRing().get_node("x") is None


def test_store(spark, tmp_path):
    e = engine.Engine(spark, str(tmp_path / "s"), 2)
    assert e.upsert("x", [1.0, 0.0], [1], [0.5], {"text": "red fox"}, {"color": "red"}) == 1
    assert e.batch_upsert([{"id": "y", "dense": [0.0, 1.0], "payload": {"color": "blue"}}, {"id": "z", "text_fields": {"text": "blue fox"}}]) == 3
    assert [r["id"] for r in e.search(dense=[1.0, 0.0], k=1).collect()] == ["x"]
    assert sorted(r["id"] for r in e.search(text="fox").collect()) == ["x", "z"]
    assert [r["id"] for r in e.search(dense=[0.0, 1.0], k=2, filter={"field": "color", "op": "eq", "value": "red"}).collect()] == ["x"]
    assert e.search().count() == 0
    snap = e.snapshot()
    e.upsert("x", [0.0, 1.0])
    assert e.delete("y") and not e.delete("nobody")
    assert e.search(text="red").count() == 0  # the newest row replaces the whole document
    assert sorted(r["id"] for r in e.store.view().collect()) == ["x", "z"]
    assert sorted(r["id"] for r in e.store.restore(snap).collect()) == ["x", "y", "z"]
    assert sorted(r["id"] for r in e.store.view(as_of=2).collect()) == ["x", "y"]
    assert [r["seq"] for r in e.tail(3).collect()] == list(range(3, e.store.sequence() + 1))
    at = e.store.sequence()
    with pytest.raises(ValueError):
        e.upsert("w", [1.0])
    assert e.store.sequence() == at
    assert e.stats().first()["documents"] == 2
    assert store.to_json({"a": float("nan"), "b": object}).startswith('{"a": null')


def docs(spark):
    rows = [(str(n), [float(n), 1.0], {"text": f"fox {'red ' * n}"}, json.dumps(p)) for n, p in enumerate([{"c": "a", "p": 3}, {"c": "b", "p": "2"}, {"c": "a"}, {"p": None}])]
    return spark.createDataFrame(rows, "id string, dense array<float>, text_fields map<string,string>, payload string")


def test_pipeline(spark):
    search = {"stage": "feature_search", "params": {"dense_vector": [1.0, 0.0], "top_k": 10}}
    go = lambda *s: pipeline.execute([search, *s], pipeline.start(docs(spark)))
    ids = lambda o: [r["id"] for r in o.results.orderBy("pos").collect()]
    assert ids(go()) == ["3", "2", "1", "0"]
    assert ids(go({"stage": "sort_attribute", "params": {"field": "p"}})) == ["1", "0", "3", "2"]
    assert ids(go({"stage": "sort_attribute", "params": {"field": "p", "order": "desc", "missing": "first"}})) == ["3", "2", "0", "1"]
    assert ids(go({"stage": "sample", "params": {"method": "tail", "n": 0}})) == []
    g = go({"stage": "group_by", "params": {"field": "c", "top_k_per_group": 1}})
    assert ids(g) == ["3", "2", "1"] and {r["group"]: r["count"] for r in g.metadata["groups"].collect()} == {"__none__": 1, "a": 1, "b": 1}
    a = go({"stage": "aggregate", "params": {"operations": [{"op": "count"}, {"op": "sum", "field": "p"}, {"op": "max", "field": "c"}, {"op": "odd"}]}})
    assert a.metadata["aggregations"].first().asDict() == {"count_score": 4, "sum_p": 5.0, "max_c": None}
    assert pipeline.execute([search], pipeline.start(docs(spark)), lambda: True).cancelled
    with pytest.raises(ValueError):
        go({"stage": "nothing"})
    events = list(pipeline.execute_streaming([search, {"stage": "rerank", "params": {"top_k": 2}}], pipeline.start(docs(spark))))
    assert [e["event"] for e in events] == ["stage_complete", "stage_complete", "done"] and events[1]["count"] == 2 and events[2]["stages_executed"] == 2
    assert list(pipeline.execute_streaming([{"stage": "nothing"}], pipeline.start(docs(spark))))[0]["event"] == "error"


def test_features(spark, tmp_path):
    assert extract.parts_of("korvex://Clip@v2/Image_1") == {"extractor": "Clip", "version": "v2", "feature_type": "Image_1"}
    assert extract.address("clip", 2, "image") == "korvex://clip@v2/image"
    for wrong in ("korvex://clip/image", "korvex://clip@2/image", "x korvex://clip@v2/image", "korvex://clip@v2/image\n"):
        with pytest.raises(ValueError):
            extract.parts_of(wrong)
    with pytest.raises(RuntimeError):
        extract.get_extractor("clip")
    (tmp_path / "in").mkdir()
    for n, text in {"a.txt": "one two", "b.md": "x", "empty.txt": ""}.items():
        (tmp_path / "in" / n).write_text(text)
    s = store.Store(spark, str(tmp_path / "store"), 64)
    job = ingest.ingest(ingest.files(spark, str(tmp_path / "in")), ["hashing"], s)
    assert (job.status, job.total, job.failed) == ("completed", 2, 0) and s.view().count() == 2
