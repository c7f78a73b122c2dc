"""Operator 2, n-gram Jaccard join: MinHash banding, then verification on full n-gram sets.

Every text becomes the set of its word n-grams. Equal sets are one node, named by its smallest document id; copies are
counted and never gathered in one row. BANDS bands of ROWS MinHash values are chosen so that a pair at the threshold
meets in some band with probability target_recall at least, at the largest ROWS (the fewest false candidates) that
MOST_HASHES allows. Nodes are shuffled on band hashes, and all pairs of a band that their sizes allow are candidates; no
band is capped, but one with more than BLOCK nodes is cut into blocks, and each pair of blocks is joined by itself.

To verify, each candidate's full set has to meet its partners' once. Candidates are gathered by connected group,
so that a set is shuffled once however many partners it has; a group larger than BLOCK nodes is cut into blocks, and
each pair of blocks is a task, so no task grows with the size of a group.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

NGRAM, THRESHOLD, RECALL, MOST_HASHES, BLOCK = 3, 0.5, 0.995, 128, 1500


def choose_bands(threshold: float, recall: float, most: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): the largest rows for which as many bands as the recall needs fit into most hashes; rows 1 if none does."""
    if not 0 < threshold <= 1 or not 0 < recall < 1:
        raise ValueError("threshold must be in (0, 1] and recall in (0, 1)")
    for rows in range(most, 0, -1):
        p = threshold**rows
        bands = 1 if p >= 1 else math.ceil(math.log(1 - recall) / math.log1p(-p))
        if rows == 1 or bands * rows <= most:
            return bands, rows
    raise AssertionError


def _hashes(k: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(seed)
    return r.integers(1, 2**63, k, dtype=np.uint64) | np.uint64(1), r.integers(0, 2**63, k, dtype=np.uint64)


def band_hashes(sets: list[np.ndarray], bands: int, rows: int) -> np.ndarray:
    """(texts, bands) hashes; none of the sets may be empty."""
    mul, add = _hashes(bands * rows)
    flat = np.concatenate(sets)
    start = np.cumsum([0, *[len(s) for s in sets[:-1]]])
    out = np.zeros((len(sets), bands), np.uint64)
    for b in range(bands):
        h = np.full(len(sets), b + 1, np.uint64)
        for k in range(b * rows, b * rows + rows):
            h = C.mix(h * C.M1 + np.minimum.reduceat((flat ^ add[k]) * mul[k], start))
        out[:, b] = h
    return out


def _sets(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """(id, fp, n, bands): one row for each document whose n-gram set isn't empty; fp tells sets apart."""

    def run(batches):
        for ids, texts in C.batches(batches):
            own = [(i, s) for i, s in ((i, C.gram_set(t, n)) for i, t in zip(ids, texts) if i is not None) if len(s)]
            hashes = band_hashes([s for _, s in own], bands, rows) if own else np.zeros((0, bands), np.uint64)
            yield pa.RecordBatch.from_arrays(
                [pa.array([i for i, _ in own], pa.int64()), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for _, s in own], pa.binary()), pa.array([len(s) for _, s in own], pa.int32()), C.list_array(hashes.ravel().view(np.int64), [bands] * len(own), pa.int64())],
                ["id", "fp", "n", "bands"],
            )

    each = C.id_text(docs).mapInArrow(run, "id long, fp binary, n int, bands array<long>")
    return each.groupBy("id").agg(F.min_by(F.struct("fp", "n", "bands"), "fp").alias("x")).select("id", "x.*")


def _candidates(nodes: DataFrame, threshold: float, block: int) -> DataFrame:
    """Distinct (a, b), a < b, of the nodes that share a band and whose sizes allow the threshold."""
    e = nodes.select(F.explode("bands").alias("h"), "node", "n")
    hot = e.groupBy("h").agg(F.ceil(F.count("*") / block).cast("int").alias("parts")).where("parts > 1")
    dealt = C.small_join(e, hot, "h", "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    dealt = dealt.select("h", "node", "n", "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("o")).select("h", F.least("own", "o").alias("i"), F.greatest("own", "o").alias("j"), "node", "n", "own")
    x, y = (dealt.withColumnsRenamed({"node": v, "n": f"n{v}", "own": f"own_{v}"}) for v in ("a", "b"))
    once = (F.col("own_a") != F.col("own_b")) | (F.col("i") == F.col("j"))
    fits = F.least("na", "nb") >= F.greatest("na", "nb") * (threshold - 1e-9)
    return x.join(y, ["h", "i", "j"]).where((F.col("a") < F.col("b")) & once & fits).select("a", "b").distinct()


def _verify(docs: DataFrame, pairs: DataFrame, n: int, threshold: float, block: int) -> DataFrame:
    """(a, b, jaccard) of the pairs that reach the threshold; pairs are checkpointed."""
    groups = C.connected_groups(pairs, "a", "b")
    sizes = groups.groupBy("label").agg(F.count("*").alias("size"))
    nodes = C.checkpointed(groups.join(sizes, "label").select("node", "label", F.ceil(F.col("size") / block).cast("int").alias("nb")))
    shares = max(1, -(-nodes.count() // block))
    place = lambda c: F.pmod(F.xxhash64(c), F.col("nb")).cast("int")
    key = F.when(F.col("nb") == 1, F.pmod(F.xxhash64("label"), F.lit(shares))).otherwise(F.col("label") + shares)
    routed = pairs.join(nodes, pairs["a"] == nodes["node"]).select(key.alias("g"), F.least(place("a"), place("b")).alias("i"), F.greatest(place("a"), place("b")).alias("j"), "a", "b")

    def run(batches):
        for b, texts in C.cut_batches(batches):
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in (2, 3, 4)], b.column(0), pa.array([C.gram_set(t, n).tobytes() for t in texts], pa.binary())], ["g", "nb", "at", "node", "grams"])

    d = C.id_text(docs)
    own = d.join(nodes, d["id"] == nodes["node"]).select("id", "text", key.alias("g"), "nb", place("node").alias("at"))
    sets = own.mapInArrow(run, "g long, nb int, at int, node long, grams binary")
    sets = sets.select("g", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("o"), "at", "node", "grams").select("g", F.least("at", "o").alias("i"), F.greatest("at", "o").alias("j"), "node", "grams")

    def check(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        own: dict[int, np.ndarray] = {}
        for node, g in zip(left["node"], left["grams"]):
            g = np.frombuffer(g, np.uint64)
            if node not in own or xxhash.xxh3_128_digest(g.tobytes()) < xxhash.xxh3_128_digest(own[node].tobytes()):
                own[node] = g
        p = right[right["a"].isin(own.keys()) & right["b"].isin(own.keys())].sort_values("a")
        if not len(p):
            return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64), "jaccard": np.zeros(0)})
        names = list(own)
        number = {x: k for k, x in enumerate(names)}
        size = np.array([len(own[x]) for x in names])
        total, ids = np.unique(np.concatenate([own[x] for x in names]), return_inverse=True)
        begin = np.concatenate([[0], np.cumsum(size)])
        a, b = p["a"].map(number).to_numpy(), p["b"].map(number).to_numpy()
        shared, mark = np.zeros(len(p), np.int64), np.zeros(len(total), bool)
        cut = np.concatenate([[0], np.flatnonzero(np.diff(a)) + 1, [len(a)]])
        for s, e in zip(cut[:-1], cut[1:]):
            mine = ids[begin[a[s]] : begin[a[s] + 1]]
            mark[mine] = True
            for lo in range(s, e, 256):
                part = b[lo : min(e, lo + 256)]
                got = np.concatenate([mark[ids[begin[x] : begin[x + 1]]] for x in part])
                shared[lo : lo + len(part)] = np.add.reduceat(got, np.concatenate([[0], np.cumsum(size[part])[:-1]]), dtype=np.int64)
            mark[mine] = False
        j = shared / (size[a] + size[b] - shared)
        ok = j >= threshold - 1e-12
        return pd.DataFrame({"a": p["a"].to_numpy()[ok], "b": p["b"].to_numpy()[ok], "jaccard": j[ok]})

    return sets.groupBy("g", "i", "j").cogroup(routed.groupBy("g", "i", "j")).applyInPandas(check, "a long, b long, jaccard double")


def _nodes_and_pairs(docs: DataFrame, threshold: float, n: int, recall: float, block: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes (node, copies), the other documents of a node (id, node), and the nodes' pairs (a, b, jaccard)."""
    bands, rows = choose_bands(threshold, recall)
    sets = C.checkpointed(_sets(docs, n, bands, rows))
    nodes = C.checkpointed(sets.groupBy("fp").agg(F.min("id").alias("node"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("bands").alias("bands")))
    copies = sets.select("id", "fp").join(nodes.where("copies > 1").select("fp", "node"), "fp").where("id != node").select("id", "node")
    pairs = C.checkpointed(_candidates(nodes, threshold, block))
    return nodes.select("node", "copies"), C.checkpointed(copies), C.checkpointed(_verify(docs, pairs, n, threshold, block))


def join_similar(docs: DataFrame, threshold: float = THRESHOLD, n: int = NGRAM, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """(doc_a, doc_b, jaccard), doc_a < doc_b: pairs of documents whose n-gram sets reach the threshold.

    Documents of equal sets are paired with the smallest of them only, which stands for them in all other pairs. Texts
    without a word (null, empty, white space) and null ids are in no pair; a text of fewer than n words is one n-gram.
    Rows that repeat an id are one document; if their texts differ, the set with the smallest hash counts. Pairs of
    equal sets have jaccard 1 and are found exactly; of the others each is found with probability recall or more.
    """
    _, copies, pairs = _nodes_and_pairs(docs, threshold, n, recall, block)
    same = copies.select(F.col("node").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("jaccard"))
    return pairs.unionByName(same).select(F.least("a", "b").alias("doc_a"), F.greatest("a", "b").alias("doc_b"), "jaccard")


def similar_classes(docs: DataFrame, threshold: float = THRESHOLD, n: int = NGRAM, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """(doc_id, class_id, n_links): a row for each document that reaches the threshold with another one.

    class_id is the smallest document that such pairs connect with it, and n_links the number of documents it reaches
    the threshold with, copies included. Which rows count, and what is found, is as in join_similar.
    """
    nodes, copies, pairs = _nodes_and_pairs(docs, threshold, n, recall, block)
    groups = C.connected_groups(pairs, "a", "b")
    both = pairs.select(F.col("a").alias("node"), F.col("b").alias("other")).union(pairs.select("b", "a"))
    links = both.join(nodes.select(F.col("node").alias("other"), "copies"), "other").groupBy("node").agg(F.sum("copies").alias("links"))
    each = nodes.join(groups, "node", "left").join(links, "node", "left").where("copies > 1 or label is not null")
    own = C.checkpointed(each.select("node", F.coalesce("label", "node").alias("class_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")))
    rest = copies.join(own, "node").select("id", "class_id", "n_links")
    return own.union(rest).withColumnRenamed("node", "doc_id")


def keep_one(docs: DataFrame, threshold: float = THRESHOLD, n: int = NGRAM, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """The rows, with all their columns, of the smallest document id of each group that pairs connect.

    Documents in no pair stay, also those with a null id or no word. Rows that share an id stay or go together.
    """
    _, copies, pairs = _nodes_and_pairs(docs, threshold, n, recall, block)
    late = C.connected_groups(pairs, "a", "b").where("node != label").select("node")
    key = C.free_name(docs, "gone")
    gone = copies.select("id").union(late).withColumnRenamed("id", key)
    return docs.join(gone, docs["doc_id"].cast("long") == gone[key], "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def op2_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return similar_classes(C.table(spark, sf_dir, "documents"))


QUERIES = {"op2_ngram_jaccard_join": op2_ngram_jaccard_join}
SQL = {
    "op2_ngram_jaccard_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(ws) - 2, 1) + 1), lambda i: array_to_string(ws[i:i + 2], ' '))) AS gram FROM w WHERE len(ws) > 0),
s AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS MATERIALIZED (SELECT x, y FROM p JOIN s u ON u.doc_id = x JOIN s v ON v.doc_id = y WHERE shared / CAST(u.n + v.n - shared AS DOUBLE) >= 0.5 - 1e-12),
c AS (SELECT DISTINCT x AS doc_id, x AS label FROM e UNION SELECT e.y, c.label FROM c JOIN e ON e.x = c.doc_id),
m AS (SELECT doc_id, min(label) AS class_id FROM c GROUP BY doc_id),
l AS (SELECT x AS doc_id, count(*) AS n_links FROM e GROUP BY x)
SELECT doc_id, class_id, n_links FROM m JOIN l USING (doc_id)
"""
}
