"""Operator 5, substring dedup: suffix automata of reference shards, and documents streamed through them.

A reference shard is a group of passages (see repeats.py) in the order of document and place. A shard's passages are
streamed through the suffix automaton of those before them, which gives at each word the length of the longest match
that ends there (matching statistics). Where that reaches the threshold the words stand earlier too; other words
extend the automaton. Of a shard that is split, the automaton of the first document's passages goes to every part and
isn't extended. Maximal spans of words that stand earlier are what removal takes out.

The automata go with the shards rather than to every task: all of them together grow with the corpus, and each is
bounded by a part's size.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
from pyspark.sql import DataFrame

from . import common as C
from . import repeats as R


class Automaton:
    """Suffix automaton of passages of numbers. seen is where a state first ended, counted over all passages."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.seen, self.last, self.size = [-1], [0], [-1], 0, 0

    def add(self, x: int) -> None:
        nxt, link, length, seen = self.next, self.link, self.length, self.seen
        p, at = self.last, self.size
        self.size += 1
        if x in nxt[p]:  # what the passage says so far stands in an earlier one
            q = nxt[p][x]
            self.last = q if length[p] + 1 == length[q] else self._divide(p, x, q)
            return
        cur = self.last = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[p] + 1)
        seen.append(at)
        while p >= 0 and x not in nxt[p]:
            nxt[p][x] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][x]
            link[cur] = q if length[p] + 1 == length[q] else self._divide(p, x, q)

    def _divide(self, p: int, x: int, q: int) -> int:
        """A state for what both the state p, after x, and longer strings of q end with."""
        nxt, link = self.next, self.link
        c = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        self.length.append(self.length[p] + 1)
        self.seen.append(self.seen[q])
        while p >= 0 and nxt[p].get(x) == q:
            nxt[p][x] = c
            p = link[p]
        link[q] = c
        return c

    def end(self) -> None:
        """A passage ends: the next one begins at the root, so that no match crosses."""
        self.last = 0


class Stream:
    """Passages of one shard, one after the other."""

    def __init__(self, words: int) -> None:
        self.a, self.words = Automaton(), words
        self.begins: list[int] = []
        self.owner: list[int] = []

    def passage(self, number: int, tokens: np.ndarray, extend: bool) -> np.ndarray:
        """For each stretch the number of the passage that holds it first, or -1; with extend, stretches that nothing holds are put in."""
        a, words = self.a, self.words
        nxt, link, length, seen = a.next, a.link, a.length, a.seen
        t = tokens.tolist()
        out = np.full(len(t) - words + 1, -1, np.int64)
        state = size = 0
        is_open = False
        for i, x in enumerate(t):
            while state and x not in nxt[state]:
                state = link[state]
                size = length[state]
            if x in nxt[state]:
                state = nxt[state][x]
                size += 1
            else:
                size = 0
            if size >= words:
                at = state
                while length[link[at]] >= words:
                    at = link[at]
                out[i - words + 1] = self.owner[bisect_right(self.begins, seen[at]) - 1]
                is_open = False
            elif extend and i + 1 >= words:
                if is_open:
                    a.add(x)
                else:
                    a.end()
                    self.begins.append(a.size)
                    self.owner.append(number)
                    for y in t[i - words + 1 : i + 1]:
                        a.add(y)
                    is_open = True
                state = link[a.last]  # the longest end of the words so far that stands elsewhere
                size = length[state]
        return out


def decide(groups: list[R.Group], words: int) -> list[list[np.ndarray]]:
    """See repeats.Decide."""
    out = []
    for g in groups:
        s, own = Stream(words), []
        same: dict[bytes, int] = {}
        for k, run in enumerate(g.runs):
            before = same.setdefault(run.tobytes(), k)
            if before == k:
                own.append(s.passage(k, run, k < g.reference))
            else:  # equal to a run that has been through
                own.append(np.where(own[before] < 0, before, own[before]) if before < g.reference else own[before])
        out.append(own)
    return out


def duplicate_spans(docs: DataFrame, words: int = R.WORDS) -> DataFrame:
    """(doc_id, start_word, end_word, first_doc): maximal spans of words to remove, words counted from 0 between white space.

    A span is one whose every stretch of `words` words also stands in a document with a smaller id, or earlier in the
    same one. Texts of fewer words (also null and empty ones) and null ids have none. Rows that repeat an id are one
    document; if their texts differ, the one with the smallest hash counts.
    """
    return R.spans(docs, decide, words)


def op5_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return duplicate_spans(C.table(spark, sf_dir, "documents"))


QUERIES = {"op5_substring_dedup": op5_substring_dedup}
SQL = {"op5_substring_dedup": R.SPANS_SQL}
