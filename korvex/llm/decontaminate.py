"""Operator 3, benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment on words.

A first pass counts, over all documents, in how many of them each n-gram of the benchmark stands. Of every item the
rarest n-grams are its seeds, as many as it takes for any copy at the threshold to hold one (see shared). A second
pass looks for seeds in whole texts; where one stands among as many n-grams of the item as such a copy has, the words
around it are aligned with the item (match +1, mismatch and gap -1), and the best score divided by the item's length
is the score. So the result is that of aligning every item with every whole text.

The n-grams have at most NGRAM words, and fewer where copies at the threshold needn't share one of that length: at
0.5 a word put in after every second leaves no trigram, but half of the pairs. An item of fewer than NGRAM words has
one n-gram of all its words, so that it is found whole only.

The benchmark's grams are sent to every task as long as there are at most MOST_WORDS words of it; a larger
benchmark is cut into parts of that size that are searched one after the other, so nothing that is sent grows.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

NGRAM, SEEDS, THRESHOLD, MOST_WORDS = 3, 8, 0.5, 400_000
_WORD = re.compile(r"\w+")


def tokens(text: str | None) -> list[str]:
    """Lower-cased runs of word characters."""
    return _WORD.findall(text.lower()) if text else []


def least_score(size: int, threshold: float) -> int:
    """The smallest alignment score that reaches the threshold for an item of `size` words."""
    return max(1, math.ceil(threshold * size - 1e-9))


def shared(size: int, threshold: float, n: int) -> int:
    """How many of an item's n-grams every alignment at the threshold holds unchanged, at least.

    m matches and e errors score m - e, and the errors part the matches into e + 1 runs at most, each with n - 1
    n-grams fewer than matches: m - (n - 1)(e + 1) n-grams, where e is at most m - score and m at most size.
    """
    least = least_score(size, threshold)
    return least if n == 1 else (2 - n) * size + (n - 1) * (least - 1)


def gram_length(size: int, threshold: float, n: int) -> int:
    """The longest n-grams, of n words at most, of which a copy at the threshold must hold one."""
    return next(q for q in range(n, 0, -1) if shared(size, threshold, q) >= 1)


@dataclass
class Index:
    """Items as word numbers (0 is any other word), and where each n-gram code stands in them."""

    ids: list[int]
    vocab: dict[str, int]
    items: list[np.ndarray]
    n: int
    codes: np.ndarray  # sorted
    first: np.ndarray  # of each code, its places begin here
    place_item: np.ndarray
    place_at: np.ndarray

    def numbers(self, ws: list[str]) -> np.ndarray:
        g = self.vocab.get
        return np.fromiter((g(w, 0) for w in ws), np.int64, len(ws))

    def hits(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in the text, number of the code) of each n-gram of the index in the text."""
        n = self.n
        if len(w) < n or not len(self.codes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        known = w > 0
        ok = known[: len(w) - n + 1].copy()
        for i in range(1, n):
            ok &= known[i : len(w) - n + 1 + i]
        at = np.flatnonzero(ok)
        code = _codes(w, at, n, len(self.vocab))
        k = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        hit = self.codes[k] == code
        return at[hit], k[hit]


def _codes(w: np.ndarray, at: np.ndarray, n: int, size: int) -> np.ndarray:
    """Exact while (size + 1) ** n fits 63 bits, else a hash whose false matches the alignment turns down."""
    code = np.zeros(len(at), np.uint64)
    for i in range(n):
        code = code * np.uint64(size + 1) + w[at + i].astype(np.uint64) if (size + 1) ** n < 2**63 else C.mix(code * C.M1 + w[at + i].astype(np.uint64) + np.uint64(1))
    return code


def index_of(rows: list[tuple[int, str]], n: int = NGRAM) -> Index:
    """Index of (item_id, text). Items of fewer than n words have no n-gram; null ids and texts don't count."""
    texts = [(i, tokens(t)) for i, t in rows if i is not None and t]
    texts = [(i, t) for i, t in texts if len(t) >= n]
    vocab: dict[str, int] = {}
    items = [np.array([vocab.setdefault(x, len(vocab) + 1) for x in t], np.int64) for _, t in texts]
    code = [_codes(w, np.arange(len(w) - n + 1), n, len(vocab)) for w in items]
    flat = np.concatenate(code) if code else np.zeros(0, np.uint64)
    item = np.repeat(np.arange(len(items)), [len(c) for c in code])
    at = np.concatenate([np.arange(len(c)) for c in code]) if code else np.zeros(0, np.int64)
    order = np.argsort(flat, kind="stable")
    codes, first = np.unique(flat[order], return_index=True)
    return Index([i for i, _ in texts], vocab, items, n, codes, np.append(first, len(flat)), item[order], at[order])


def rare_seeds(ix: Index, df: np.ndarray, least: int = SEEDS, threshold: float = THRESHOLD) -> np.ndarray:
    """Mask of the index's places that are seeds: of each item the rarest by document count, ties by code.

    All places but one fewer than a copy at the threshold shares, so that it can't consist of the others only.
    """
    keep = np.zeros(len(ix.place_item), bool)
    code = np.repeat(np.arange(len(ix.codes)), np.diff(ix.first))
    order = np.lexsort((code, df[code], ix.place_item))
    start = 0
    for stop in np.append(np.flatnonzero(np.diff(ix.place_item[order])) + 1, len(order)) if len(order) else []:
        own = order[start:stop]
        size = len(ix.items[ix.place_item[own[0]]])
        keep[own[: max(least, len(own) - shared(size, threshold, ix.n) + 1)]] = True
        start = stop
    return keep


def align(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Best local alignment score of each row pair: a (rows, la) padded with -1, b (rows, lb) padded with -2."""
    n, lb = b.shape
    step = np.arange(lb + 1, dtype=np.int32)
    h = np.zeros((n, lb + 1), np.int32)
    best = np.zeros(n, np.int32)
    for i in range(a.shape[1]):
        t = np.zeros_like(h)
        np.maximum(h[:, :-1] + np.where(b == a[:, i : i + 1], 1, -1), h[:, 1:] - 1, out=t[:, 1:])
        np.maximum(t, 0, out=t)
        h = np.maximum.accumulate(t + step, axis=1) - step
        np.maximum(best, h.max(1), out=best)
    return best


def _pad(rows: list[np.ndarray], fill: int) -> np.ndarray:
    out = np.full((len(rows), max(map(len, rows))), fill, np.int64)
    for r, x in zip(out, rows):
        r[: len(x)] = x
    return out


class Finder:
    def __init__(self, ix: Index, seeds: np.ndarray, threshold: float = THRESHOLD):
        self.ix, self.seeds, self.threshold = ix, seeds, threshold
        self.held = np.unique(ix.place_item * len(ix.codes) + np.repeat(np.arange(len(ix.codes)), np.diff(ix.first)))

    def windows(self, w: np.ndarray) -> list[tuple[int, int, int]]:
        """(item number, first word, end) of the stretches of a text to align: seeds on about one diagonal share one.

        An alignment at the threshold has at most size - least_score gaps, and lies within so many words of its seeds.
        """
        ix = self.ix
        at, k = ix.hits(w)
        if not len(at):
            return []
        count = ix.first[k + 1] - ix.first[k]
        place = np.repeat(ix.first[k], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        pos = np.repeat(at, count)
        ok = self.seeds[place]
        place, pos = place[ok], pos[ok]
        item, diagonal = ix.place_item[place], pos - ix.place_at[place]
        out: list[tuple[int, int, int]] = []
        last = None
        for x in np.lexsort((diagonal, item)).tolist():
            i, d = int(item[x]), int(diagonal[x])
            size = len(ix.items[i])
            slack = size - least_score(size, self.threshold)
            if last and last[0] == i and d - last[2] <= slack and d - last[1] <= size:
                last[2] = d
            else:
                last = [i, d, d]
                out.append(last)  # type: ignore[arg-type]
        found = []
        for i, lo, hi in out:
            size = len(ix.items[i])
            slack = size - least_score(size, self.threshold)
            a, b = max(0, lo - slack), min(len(w), hi + size + slack)
            inside = i * len(ix.codes) + k[np.searchsorted(at, a) : np.searchsorted(at, b - ix.n, side="right")]
            own = self.held[np.minimum(np.searchsorted(self.held, inside), len(self.held) - 1)] == inside
            if own.sum() >= shared(size, self.threshold, ix.n):
                found.append((i, a, b))
        return found

    def scores(self, texts: list[list[str]]) -> list[tuple[int, int, float]]:
        """(text number, item number, score) of all pairs of cut texts and items that share a seed and may reach the threshold."""
        jobs = []
        for t, ws in enumerate(texts):
            w = self.ix.numbers(ws)
            jobs += [(t, i, w[a:b]) for i, a, b in self.windows(w)]
        jobs.sort(key=lambda j: (len(self.ix.items[j[1]]), len(j[2])))
        best: dict[tuple[int, int], float] = {}
        for s in range(0, len(jobs), 1000):
            part = jobs[s : s + 1000]
            got = align(_pad([self.ix.items[i] for _, i, _ in part], -1), _pad([w for _, _, w in part], -2))
            for (t, i, _), x in zip(part, got.tolist()):
                best[t, i] = max(best.get((t, i), 0.0), x / len(self.ix.items[i]))
        return [(t, i, x) for (t, i), x in best.items()]


def document_counts(docs: DataFrame, indexes: list[Index]) -> list[np.ndarray]:
    """In how many rows each n-gram of each index stands; one pass over the rows."""
    begin = np.cumsum([0, *(len(ix.codes) for ix in indexes)])

    def run(rows):
        for _, texts in C.batches(rows):
            n = np.zeros(begin[-1], np.int64)
            for t in texts:
                ws = tokens(t)
                for ix, b in zip(indexes, begin):
                    n[b + np.unique(ix.hits(ix.numbers(ws))[1])] += 1
            k = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(n[k], pa.int64())], ["k", "n"])

    out = np.zeros(begin[-1], np.int64)
    for r in C.id_text(docs).mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect():  # of the benchmark's n-grams
        out[r["k"]] = r["n"]
    return [out[b:e] for b, e in zip(begin[:-1], begin[1:])]


def finders(docs: DataFrame, benchmark: DataFrame, n: int = NGRAM, least: int = SEEDS, most_words: int = MOST_WORDS, threshold: float = THRESHOLD) -> list[list[Finder]]:
    """For each part of the benchmark, one Finder for each length of n-grams."""
    items = C.id_text(benchmark, "item_id").where("id is not null and length(text) > 0")
    total = items.select(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    parts = max(1, -(-total // most_words))
    out = []
    for p in range(parts):
        own = items.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == p).distinct().collect()
        by_length: dict[int, list] = {}
        for r in sorted((r["id"], r["text"]) for r in own):
            if size := len(tokens(r[1])):
                by_length.setdefault(size if size < n else gram_length(size, threshold, n), []).append(r)
        indexes = [index_of(rows, q) for q, rows in sorted(by_length.items())]
        counts = document_counts(docs, indexes) if indexes else []
        out.append([Finder(ix, rare_seeds(ix, df, least, threshold), threshold) for ix, df in zip(indexes, counts)])
    return out


def _scores(own: list[Finder], texts: list[str | None]) -> list[tuple[int, int, float]]:
    """(text number, item id, score) by all Finders of a part."""
    cut = [tokens(t) for t in texts]
    return [(t, f.ix.ids[i], x) for f in own for t, i, x in f.scores(cut)]


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, n: int = NGRAM) -> DataFrame:
    """(doc_id, item_id, score): a row for each document row and item whose best alignment scores at least threshold.

    Null and empty texts match nothing. A null document id stays null; repeated rows give repeated results. An item
    that stands in the benchmark twice with the same text is one; with another text, the results of both are given.
    """

    def search(own: list[Finder]) -> DataFrame:
        def run(rows):
            for ids, texts in C.batches(rows):
                got = [(ids[t], i, x) for t, i, x in _scores(own, texts) if x >= threshold]
                d, i, x = zip(*got) if got else ([],) * 3
                yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(i, pa.int64()), pa.array(x, pa.float64())], ["doc_id", "item_id", "score"])

        return C.id_text(docs).mapInArrow(run, "doc_id long, item_id long, score double")

    return reduce(DataFrame.union, map(search, finders(docs, benchmark, n, threshold=threshold)))


def keep_clean(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, n: int = NGRAM) -> DataFrame:
    """The rows, with all their columns, that no benchmark item matches; null and empty texts stay."""
    for own in finders(docs, benchmark, n, threshold=threshold):
        name = C.free_name(docs, "contaminated")
        docs = docs.withColumn(name, _hit(own, threshold)(F.col("text").cast("string"))).where(~F.col(name)).select(*[F.col(f"`{c}`") for c in docs.columns])
    return docs


def _hit(own: list[Finder], threshold: float):
    @F.pandas_udf("boolean")
    def hit(text: pd.Series) -> pd.Series:
        out = np.zeros(len(text), bool)
        for s in C.bounded([len(t or "") for t in text]):  # the words of a whole batch would take hundreds of MB
            for t, _, x in _scores(own, text.iloc[s].tolist()):
                out[s.start + t] |= x >= threshold
        return pd.Series(out)

    return hit


def op3_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    return contaminated(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"))


QUERIES = {"op3_benchmark_decontamination": op3_benchmark_decontamination}
SQL: dict[str, str] = {}
