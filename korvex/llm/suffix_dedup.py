"""Operator 8, suffix-array dedup: threshold-bounded interval expansion on a Burrows-Wheeler transform.

The passages of one or more groups (see repeats.py) are joined with distinct ends and sorted by suffix. On their
Burrows-Wheeler transform, intervals of suffixes that share L words are extended backward by one word, breadth first,
which gives the intervals that share L + 1; so common prefixes become known in the order of their length. It stops at
the threshold: suffixes that are still in one interval share at least so many words, and all but the earliest of an
interval stand earlier too.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from . import common as C
from . import repeats as R


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a sequence whose last number is the smallest and unique, by doubling."""
    rank = np.unique(t, return_inverse=True)[1].astype(np.int64)
    n, k = len(t), 1
    while True:
        second = np.zeros(n, np.int64)
        second[: n - k] = rank[k:] + 1
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        s = key[order]
        new = np.empty(n, np.int64)
        new[order] = np.concatenate([[0], np.cumsum(s[1:] != s[:-1])])
        rank = new
        if rank[order[-1]] == n - 1:
            return order
        k *= 2


def intervals(t: np.ndarray, sa: np.ndarray, least: int) -> np.ndarray:
    """For each place of the suffix array, whether its suffix begins another interval than the one before: they share fewer than `least` numbers."""
    bwt = t[sa - 1]
    back = np.argsort(bwt, kind="stable")  # back[j]: the row whose backward step leads to row j
    a, b = back[:-1], back[1:]
    parted = np.ones(len(t), bool)
    parted[1:] = bwt[a] != bwt[b]  # rows that differ in their first number
    pending = np.flatnonzero(~parted)  # rows whose common prefix isn't known yet
    for _ in range(least - 1):
        if not len(pending):
            break
        segment = np.cumsum(parted)
        cut = segment[back[pending]] != segment[back[pending - 1]]
        parted = parted.copy()
        parted[pending[cut]] = True
        pending = pending[~cut]
    return parted


def decide(groups: list[R.Group], words: int) -> list[list[np.ndarray]]:
    """See repeats.Decide. The groups share one transform; their words are kept apart by the group's number."""
    runs = [r for g in groups for r in g.runs]
    size = np.array([len(r) for r in runs])
    group = np.repeat(np.arange(len(groups)), [len(g.runs) for g in groups])
    number = np.concatenate([np.arange(len(g.runs)) for g in groups])
    usable = np.concatenate([np.arange(len(g.runs)) < g.reference for g in groups])
    names = np.unique(np.concatenate(runs).astype(np.uint64) | np.repeat(group, size).astype(np.uint64) << np.uint64(32), return_inverse=True)[1] + len(runs)
    t = np.empty(len(names) + len(runs), np.int64)
    end = np.cumsum(size + 1) - 1
    t[end] = np.arange(len(runs))[::-1]
    inside = np.ones(len(t), bool)
    inside[end] = False
    t[inside] = names
    sa = suffix_array(t)
    segment = np.empty(len(t), np.int64)
    segment[sa] = np.cumsum(intervals(t, sa, words)) - 1
    many = size - words + 1
    owner = np.repeat(np.arange(len(runs)), many)
    begin = np.cumsum(many) - many
    at = np.repeat(end - size, many) + np.arange(many.sum()) - np.repeat(begin, many)
    ok = usable[owner]
    first = np.full(len(t), len(t), np.int64)
    first[segment[at[ok]][::-1]] = at[ok][::-1]  # the last to be put there is the earliest place
    whose = np.full(len(t) + 1, -1, np.int64)
    whose[at] = number[owner]
    earliest = first[segment[at]]
    flat = np.where(earliest < at, whose[earliest], -1)
    parts = iter(np.split(flat, begin[1:]))
    return [[next(parts) for _ in g.runs] for g in groups]


def duplicate_spans(docs: DataFrame, words: int = R.WORDS) -> DataFrame:
    """(doc_id, start_word, end_word, first_doc): maximal spans of words to remove, words counted from 0 between white space.

    A span is one whose every stretch of `words` words also stands in a document with a smaller id, or earlier in the
    same one. Texts of fewer words (also null and empty ones) and null ids have none. Rows that repeat an id are one
    document; if their texts differ, the one with the smallest hash counts.
    """
    return R.spans(docs, decide, words)


def op8_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    return duplicate_spans(C.table(spark, sf_dir, "documents"))


QUERIES = {"op8_suffix_array_dedup": op8_suffix_array_dedup}
SQL = {"op8_suffix_array_dedup": R.SPANS_SQL}
