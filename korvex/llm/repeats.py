"""Where passages of at least `words` words stand again: how operators 5 and 8 bring passages together.

An index of all of a corpus is never in one place. Instead:

1. Documents of equal word sequence are one; the smallest id stands for them.
2. Every stretch of `words` words has an anchor: its k-gram of smallest hash. Equal stretches have equal anchors, so
   a stretch that repeats has an anchor that stands in two places. One anchor in about 20 words is shuffled.
3. Texts with such anchors are read again. Runs of stretches whose anchors repeat go, as word numbers, to the group of
   the smallest document that holds the anchor, whether the stretches themselves repeat or not.
4. The operator decides, in each group, which stretches stand earlier in the order of document and place.

A group with more anchors than most_in_part is split by document; each part has the reference's (smallest document's)
runs too, and what isn't found in these is compared across the parts by the hash of each stretch. Nothing is
sampled or capped. Words are told apart by 32 bits of their hash, anchors by 63.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

WORDS, ANCHOR = 50, 10
MOST_IN_PART = 5_000  # anchors, of about 20 stretches each, that one part of a group has
FEW_WORDS = 200_000  # words of groups that an operator gets at once, if they are small


@dataclass
class Group:
    """Runs of word numbers in the order of document and place. Of a split group, only the first `reference` runs are compared with."""

    first: int
    part: int
    parts: int
    doc: list[int] = field(default_factory=list)
    start: list[int] = field(default_factory=list)
    runs: list[np.ndarray] = field(default_factory=list)

    @property
    def reference(self) -> int:
        return len(self.runs) if self.parts == 1 else sum(d == self.first for d in self.doc)

    @property
    def size(self) -> int:
        return sum(map(len, self.runs))


#: Of each run of each group, for every stretch the number of the first run with an earlier place of it, or -1.
Decide = Callable[[list[Group], int], list[list[np.ndarray]]]


def spaced(text: str | None) -> list[str]:
    """Words between white space, as they are."""
    return text.split() if text else []


def anchors_of(h: np.ndarray, words: int, k: int) -> np.ndarray:
    """Of each stretch of `words` words, where its anchor begins (the leftmost k-gram of smallest hash)."""
    if len(h) < words:
        return np.zeros(0, np.int64)
    g = C.ngram_hashes(h, k)
    return np.lib.stride_tricks.sliding_window_view(g, words - k + 1).argmin(1) + np.arange(len(h) - words + 1)


def _even(h: np.ndarray) -> np.ndarray:
    return h & ~np.uint64(1)


def _anchored(docs: DataFrame, words: int, k: int) -> DataFrame:
    """(id, fp, n, hashes): anchors of each document, one row an id. The lowest bit of a hash tells whether it stands in two places of it."""

    def run(rows):
        for ids, texts in C.batches(rows):
            fp, n, flat, size = [], [], [], []
            for t in texts:
                h = C.word_hashes(spaced(t))
                at = np.unique(anchors_of(h, words, k))
                g, c = np.unique(_even(C.ngram_hashes(h, k)[at]), return_counts=True) if len(at) else (np.zeros(0, np.uint64), np.zeros(0, int))
                flat.append(g | (c > 1).astype(np.uint64))
                fp.append(xxhash.xxh3_128_digest(h.tobytes()))
                n.append(len(h))
                size.append(len(g))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(fp, pa.binary()), pa.array(n, pa.int32()), C.list_array(np.concatenate(flat).view(np.int64), size, pa.int64())], ["id", "fp", "n", "hashes"])

    each = C.id_text(docs).where("id is not null").mapInArrow(run, "id long, fp binary, n int, hashes array<long>").where(F.col("n") >= words)
    return each.groupBy("id").agg(F.min_by(F.struct("fp", "n", "hashes"), "fp").alias("x")).select("id", "x.*")


def candidate_runs(docs: DataFrame, words: int = WORDS, k: int = ANCHOR, most_in_part: int = MOST_IN_PART) -> tuple[DataFrame, DataFrame]:
    """Copies (doc, first, n) of whole documents, and the runs (first, parts, part, doc, start, tokens) of step 3."""
    base = C.checkpointed(_anchored(docs, words, k))
    one = base.groupBy("fp").agg(F.min("id").alias("first"), F.count("*").alias("c")).where("c > 1").drop("c")
    same = C.checkpointed(base.select("id", "fp", "n").join(one, "fp").where("id != first").select(F.col("id").alias("doc"), "first", "n"))
    own = base.join(same.select(F.col("doc").alias("id")), "id", "left_anti").select(F.explode("hashes").alias("x"), F.col("id").alias("doc"))
    rows = own.select(F.col("x").bitwiseAND(F.lit(-2)).alias("h"), "doc", F.col("x").bitwiseAND(F.lit(1)).alias("more"))
    repeated = C.checkpointed(rows.groupBy("h").agg(F.min("doc").alias("first"), (F.count("*") + F.sum("more")).alias("c")).where("c > 1"))
    sizes = repeated.groupBy("first").agg(F.sum("c").alias("c"), F.count("*").alias("own"))
    hot = sizes.select("first", F.ceil(F.col("c") / F.greatest(F.lit(most_in_part), F.col("own") * 4)).cast("int").alias("parts")).where("parts > 1")
    known = C.small_join(repeated.select("h", "first"), hot, "first", "left").select("h", "first", F.coalesce("parts", F.lit(1)).alias("parts"))
    wanted = rows.select("h", "doc").join(known, "h").groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("h", "first", "parts"))).alias("hs"))

    def cut(rows):
        for b in rows:
            first, parts, doc, start, tokens = [], [], [], [], []
            for i, t, fp, hs in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3)):
                h = C.word_hashes(spaced(t))
                if xxhash.xxh3_128_digest(h.tobytes()) != fp:
                    continue
                own, ref, split = (np.asarray(hs.values.field(x)) for x in ("h", "first", "parts"))
                g = _even(C.ngram_hashes(h, k)).view(np.int64)[anchors_of(h, words, k)]
                x = np.minimum(np.searchsorted(own, g), len(own) - 1)
                at = np.flatnonzero(own[x] == g)
                x, low = x[at], h.astype(np.uint32)
                edge = np.concatenate([[0], np.flatnonzero((np.diff(at) != 1) | (np.diff(ref[x]) != 0)) + 1, [len(at)]])
                for s, e in zip(edge[:-1], edge[1:]) if len(at) else ():
                    first.append(int(ref[x[s]]))
                    parts.append(int(split[x[s]]))
                    doc.append(i)
                    start.append(int(at[s]))
                    tokens.append(low[at[s] : at[e - 1] + words].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(first, pa.int64()), pa.array(parts, pa.int32()), pa.array(doc, pa.int64()), pa.array(start, pa.int32()), pa.array(tokens, pa.binary())], ["first", "parts", "doc", "start", "tokens"])

    d = C.id_text(docs)
    marked = wanted.join(base.select("id", "fp"), wanted["doc"] == base["id"]).drop("id")
    runs = d.join(marked, d["id"] == marked["doc"]).select("id", "text", "fp", "hs").mapInArrow(cut, "first long, parts int, doc long, start int, tokens binary")
    mine = F.when(F.col("doc") == F.col("first"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(F.pmod(F.xxhash64("doc"), F.col("parts")).cast("int")))
    return same, runs.select("first", "parts", F.explode(mine).alias("part"), "doc", "start", "tokens")


def _groups(rows: Iterator[pa.RecordBatch], few_words: int) -> Iterator[list[Group]]:
    """Groups of sorted rows, several small ones at once. A row that stands twice counts once."""
    now: Group | None = None
    ready: list[Group] = []
    size = 0
    for b in rows:
        tokens = b.column(5)
        for k, (first, parts, part, doc, start) in enumerate(zip(*[b.column(c).to_pylist() for c in range(5)])):
            if now is None or (now.first, now.part) != (first, part):
                if now is not None:
                    ready.append(now)
                    size += now.size
                    if size >= few_words:
                        yield ready
                        ready, size = [], 0
                now = Group(first, part, parts)
            if not now.doc or (now.doc[-1], now.start[-1]) != (doc, start):
                now.doc.append(doc)
                now.start.append(start)
                now.runs.append(np.frombuffer(tokens[k].as_py(), np.uint32))
    if now is not None:
        yield [*ready, now]


def _edges(at: np.ndarray) -> Iterator[tuple[int, int]]:
    """(first, last) of each run of consecutive numbers."""
    if len(at):
        cut = np.flatnonzero(np.diff(at) != 1)
        yield from zip(at[np.concatenate([[0], cut + 1])].tolist(), at[np.append(cut, len(at) - 1)].tolist())


def spans(docs: DataFrame, decide: Decide, words: int = WORDS, k: int = ANCHOR, most_in_part: int = MOST_IN_PART) -> DataFrame:
    """(doc_id, start_word, end_word, first_doc): maximal spans whose every stretch of `words` words stands earlier too.

    Earlier is in a smaller document, or further to the front of the same one. first_doc is the document with the
    earliest place of the span's first stretch.
    """
    same, runs = candidate_runs(docs, words, k, most_in_part)

    def run(rows):
        for groups in _groups(rows, FEW_WORDS):
            doc, start, end, first, key = [], [], [], [], []
            for g, decided in zip(groups, decide(groups, words)):
                for i, s, tokens, of in zip(g.doc, g.start, g.runs, decided):
                    if i == g.first and g.part:
                        continue
                    for a, b in _edges(np.flatnonzero(of >= 0)):
                        doc.append(i)
                        start.append(s + a)
                        end.append(s + b + words)
                        first.append(g.doc[of[a]])
                        key.append(None)
                    if g.parts > 1 and i != g.first:
                        at = np.flatnonzero(of < 0)
                        doc += [i] * len(at)
                        start += (at + s).tolist()
                        end += (at + s + words).tolist()
                        first += [i] * len(at)
                        key += C.ngram_hashes(tokens.astype(np.uint64), words)[at].view(np.int64).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(first, pa.int64()), pa.array(key, pa.int64())], ["doc", "s", "e", "first", "key"])

    ordered = runs.repartition("first", "part").sortWithinPartitions("first", "part", "doc", "start")
    found = C.checkpointed(ordered.mapInArrow(run, "doc long, s int, e int, first long, key long"))
    left = found.where("key is not null").select("key", F.struct("doc", "s").alias("at"), "e")
    least = left.groupBy("key").agg(F.min("at").alias("least"), F.count("*").alias("c")).where("c > 1")
    across = left.join(least, "key").where("at > least").select("at.doc", "at.s", "e", F.col("least.doc").alias("first"))
    found = found.where("key is null").select("doc", "s", "e", "first").unionByName(across)
    w = Window.partitionBy("doc").orderBy("s", "e")
    before = found.withColumn("far", F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    island = before.withColumn("island", F.sum(F.when(F.col("s") <= F.col("far"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    merged = C.checkpointed(island.groupBy("doc", "island").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.min_by("first", "s").alias("first")).drop("island"))
    head = merged.where("s = 0").select(F.col("doc").alias("first"), F.col("first").alias("earlier"))
    copies = same.join(head, "first", "left").select("doc", F.lit(0).alias("s"), F.col("n").alias("e"), F.coalesce("earlier", "first").alias("first"))
    out = merged.select("doc", "s", "e", "first").unionByName(copies)
    return out.select(F.col("doc").alias("doc_id"), F.col("s").cast("long").alias("start_word"), F.col("e").cast("long").alias("end_word"), F.col("first").alias("first_doc"))


def remove(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows, with all their columns, without the words of the spans; a null text stays null."""
    import re

    word = re.compile(r"\S+")
    name, key = C.free_name(docs, "spans"), C.free_name(docs, "key")
    g = found.groupBy(F.col("doc_id").alias(key)).agg(F.sort_array(F.collect_list(F.struct("start_word", "end_word"))).alias(name))

    @F.pandas_udf("string")
    def without(text: pd.Series, cuts: pd.Series) -> pd.Series:
        out = []
        for t, c in zip(text, cuts):
            if t is not None and c is not None:
                at, last, keep = [m.span() for m in word.finditer(t)], 0, []
                for x in c:
                    a, b = (x["start_word"], x["end_word"]) if isinstance(x, dict) else (x[0], x[1])
                    if b <= len(at):
                        keep.append(t[last : at[a][0]])
                        last = at[b - 1][1]
                t = "".join(keep) + t[last:]
            out.append(t)
        return pd.Series(out, dtype=object)

    j = docs.join(g, docs["doc_id"].cast("long") == g[key], "left")
    return j.select(*[F.when(F.col(name).isNull(), docs[c]).otherwise(without(docs[c].cast("string"), F.col(name))).alias(c) if c == "text" else docs[c] for c in docs.columns])


#: The spans in SQL.
SPANS_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, unnest(range(0, len(ws) - 49)) AS pos, ws FROM w WHERE len(ws) >= 50),
h AS (SELECT doc_id, pos, md5(array_to_string(ws[pos + 1:pos + 50], ' ')) AS h FROM s),
m AS (SELECT doc_id, pos, row_number() OVER p AS r, first_value(doc_id) OVER p AS first_doc FROM h WINDOW p AS (PARTITION BY h ORDER BY doc_id, pos)),
d AS (SELECT doc_id, pos, first_doc FROM m WHERE r > 1),
e AS (SELECT *, CASE WHEN pos <= lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) + 50 THEN 0 ELSE 1 END AS fresh FROM d),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM e)
SELECT doc_id, min(pos) AS start_word, max(pos) + 50 AS end_word, arg_min(first_doc, pos) AS first_doc FROM i GROUP BY doc_id, island
"""
