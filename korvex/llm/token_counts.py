"""Operator 1, token counts: the exact token count of every prefix of a text, by prefix dynamic programming.

For byte-level BPE the encoding of a prefix ends with the one token t for which the pair (last token of the
prefix without t, t) encodes to itself; so count[i] = count[i - len(t)] + 1. The tokens that a prefix ends with come
from an automaton of the vocabulary. This is done within each piece that the vocabulary's pattern cuts, for the new
pieces of a batch in sorted order, and kept by piece. Cutting a text short changes the pieces before the cut in two
places only, which are put right: a run of white space, whose last character otherwise belongs to the next piece,
and the contractions of three characters.

prefix_deltas has, for each character, by how much the count changes with it: a first byte of 1 or 2 gives the
width of the signed little-endian steps that follow. Their running sum answers how many tokens any prefix has and
where to cut for a budget, without encoding again.
"""

from __future__ import annotations

import base64
import re
import sys
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BUDGETS = (512, 2048)
MOST_KEPT, MOST_PAIRS, MOST_CHARS = 1_000_000, 2_000_000, 64
_EXACT = regex.compile(PATTERN)
#: The same cuts, faster, for texts without the characters that the two engines class differently.
_FAST = re.compile(r" ?[^\W\d_]+|'(?:[stmd]|re|ve|ll)| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_SPACES = re.compile(r"\s{2,}(?=\S)")


@lru_cache(1)
def _odd() -> np.ndarray:
    """Of each character, whether the two engines class it differently."""
    cat = [unicodedata.category(chr(i)) for i in range(sys.maxunicode + 1)]
    out = np.array([c in ("Nl", "No", "Cn", "Cs") or c[0] == "L" and not chr(i).isalpha() for i, c in enumerate(cat)])
    out[0x1C:0x20] = True
    return out


def cut(text: str) -> list[str]:
    """The pieces that the vocabulary's pattern cuts."""
    odd = _odd()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)].any()
    return (_EXACT if odd else _FAST).findall(text)


class PrefixCounter:
    """Counts by a vocabulary file of ranks. Pieces, pairs and steps of the automaton are kept over all texts, each up to a bound.

    A state of the automaton is the longest end of what was read that begins a token; ends has the tokens that what
    was read ends with, longest first. Neighbours in sorted order share the dynamic programme of their common prefix.
    """

    def __init__(self, path: str = RANKS):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("prefix-counts", pat_str=PATTERN, mergeable_ranks=self.ranks, special_tokens={})
        self.token = {v: k for k, v in self.ranks.items()}
        names = sorted({t[:k] for t in self.ranks for k in range(len(t) + 1)})
        self.names, self.state = names, {x: k for k, x in enumerate(names)}
        self.ends: list[tuple[tuple[int, int], ...] | None] = [None] * len(names)
        self.goto: dict[int, int] = {}
        self.pairs: dict[int, bool] = {}
        self.kept: dict[str, bytes | array] = {}

    def fits(self, a: int, b: int) -> bool:
        """Whether token b right after token a stays as it is."""
        if len(self.pairs) > MOST_PAIRS:
            self.pairs.clear()
        r = self.pairs[a << 32 | b] = self.encoding._encode_single_piece(self.token[a] + self.token[b]) == [a, b]
        return r

    def follow(self, at: int, byte: int) -> int:
        """The state after one more byte."""
        if len(self.goto) > MOST_PAIRS:
            self.goto.clear()
        name = self.names[at] + bytes([byte])
        while name not in self.state:
            name = name[1:]
        to = self.goto[at << 8 | byte] = self.state[name]
        if self.ends[to] is None:
            own = ((k, self.ranks.get(name[-k:])) for k in range(len(name), 0, -1))
            self.ends[to] = tuple((k, t) for k, t in own if t is not None)
        return to

    def piece_steps(self, pieces: list[str]) -> list[bytes | array]:
        """Steps of the count at each character of each piece, as bytes; as an array where a step is too large for one."""
        raw = [s.encode("utf-8", "replace") for s in pieces]
        out: list[bytes | array] = [b""] * len(raw)
        longest = max(map(len, raw), default=0) + 1
        states, last, count = [self.state[b""]] * longest, [0] * longest, [0] * longest
        goto, pairs, ends, before = self.goto.get, self.pairs.get, self.ends, b""
        for x in sorted(range(len(raw)), key=raw.__getitem__):
            b = raw[x]
            n = len(b)
            done = 0
            for done, (p, q) in enumerate(zip(b, before)):  # noqa: B007
                if p != q:
                    break
            else:
                done = min(n, len(before))
            before, at = b, states[done]
            for i in range(done + 1, n + 1):
                to = goto(at << 8 | b[i - 1])
                at = states[i] = self.follow(at, b[i - 1]) if to is None else to
                for k, t in ends[at]:  # type: ignore[union-attr]
                    if k == i:
                        last[i], count[i] = t, 1
                        break
                    j = i - k
                    r = pairs(last[j] << 32 | t)
                    if r or r is None and self.fits(last[j], t):
                        last[i], count[i] = t, count[j] + 1
                        break
            out[x] = _steps(pieces[x], b, count[: n + 1])
        return out

    def piece(self, s: str) -> bytes | array:
        return self.piece_steps([s])[0]

    def total(self, s: str) -> int:
        return sum(array("b", p) if isinstance(p := self.piece(s), bytes) else p)

    def learn(self, texts: Iterable[str | None]) -> list[list[str]]:
        """Pieces of each text; steps of all but long ones are kept from now on."""
        cuts = [cut(t) if t else [] for t in texts]
        new = {p for c in cuts for p in c if p not in self.kept and len(p) < MOST_CHARS}
        if len(self.kept) + len(new) > MOST_KEPT:
            self.kept.clear()
            new = {p for c in cuts for p in c if len(p) < MOST_CHARS}
        new_pieces = list(new)
        self.kept.update(zip(new_pieces, self.piece_steps(new_pieces)))
        return cuts

    def steps(self, text: str | None) -> np.ndarray:
        """Change of the count at each character."""
        return next(self.steps_of([text]))

    def steps_of(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        for text, pieces in zip(texts, self.learn(texts)):
            if not text:
                yield np.zeros(0, np.int8)
                continue
            got = list(map(self.kept.get, pieces))
            if None in got:
                got = [self.piece(p) if g is None else g for p, g in zip(pieces, got)]
            try:
                d = np.frombuffer(b"".join(got), np.int8)  # type: ignore[arg-type]
            except TypeError:
                d = np.concatenate([np.frombuffer(g, np.int8) if isinstance(g, bytes) else np.array(g) for g in got])
            if m := list(_SPACES.finditer(text)):
                d = d.astype(np.int16)
                for x in m:
                    run, e = x.group(), x.end()
                    more = self.total(run) - self.total(run[:-1]) - self.total(run[-1])
                    d[e - 1] += more
                    d[e] -= more
            yield d


def _steps(s: str, b: bytes, count: list[int]) -> bytes | array:
    if s in ("'re", "'ve", "'ll"):
        count[2] = 2
    if len(b) != len(s):
        ends = np.flatnonzero((np.frombuffer(b + b"\0", np.uint8) & 0xC0) != 0x80).tolist()
        count = [count[e] for e in ends]
    step = [y - x for x, y in zip(count, count[1:])]
    try:
        return array("b", step).tobytes()
    except OverflowError:
        return array("h", step)


@lru_cache(2)
def counter(path: str = RANKS) -> PrefixCounter:
    return PrefixCounter(path)


def pack(d: np.ndarray) -> bytes:
    small = not len(d) or (d.min() >= -128 and d.max() <= 127)
    return b"\1" + d.astype("<i1").tobytes() if small else b"\2" + d.astype("<i2").tobytes()


def prefix_counts(packed: bytes) -> np.ndarray:
    """Tokens of each prefix, from no character to all of them."""
    d = np.frombuffer(packed, "<i1" if packed[0] == 1 else "<i2", offset=1)
    return np.concatenate([[0], np.cumsum(d, dtype=np.int64)])


def longest_prefix(counts: np.ndarray, budget: int) -> int:
    """Characters of the longest prefix that has at most budget tokens."""
    if counts[-1] <= budget:
        return len(counts) - 1
    return int(np.flatnonzero(counts <= budget)[-1]) if budget >= 0 else 0


def count_tokens(docs: DataFrame, ranks_path: str = RANKS, budgets: tuple[int, ...] = BUDGETS) -> DataFrame:
    """(doc_id, n_chars, n_tokens, prefix_deltas, keep_<budget>...) for every row.

    keep_<budget> is the length of the longest prefix within the budget. A null or an empty text has 0 of each.
    """

    def run(rows):
        c = counter(ranks_path)
        for ids, texts in C.batches(rows, 8_000_000):
            n, total, packed, keep = [], [], [], [[] for _ in budgets]
            for d in c.steps_of(texts):
                p = np.zeros(len(d) + 1, np.int32)
                np.cumsum(d, out=p[1:])
                n.append(len(d))
                total.append(int(p[-1]))
                packed.append(pack(d))
                for k, b in zip(keep, budgets):
                    k.append(longest_prefix(p, b))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(total, pa.int64()), pa.array(packed, pa.binary()), *[pa.array(k, pa.int64()) for k in keep]], ["doc_id", "n_chars", "n_tokens", "prefix_deltas", *[f"keep_{b}" for b in budgets]])

    return C.id_text(docs).mapInArrow(run, "doc_id long, n_chars long, n_tokens long, prefix_deltas binary" + "".join(f", keep_{b} long" for b in budgets))


def tokens_of_prefix(counts: DataFrame, chars: str, out: str = "prefix_tokens") -> DataFrame:
    """Adds the token count of the first `chars` characters of each row; more than there are count as all, null gives null."""

    @F.pandas_udf("long")
    def at(packed: pd.Series, k: pd.Series) -> pd.Series:
        res = []
        for p, x in zip(packed, k):
            c = prefix_counts(p) if p is not None and x == x and x is not None else None
            res.append(None if c is None else int(c[min(max(int(x), 0), len(c) - 1)]))
        return pd.Series(res, dtype="Int64")

    return counts.withColumn(out, at(F.col("prefix_deltas"), F.col(chars).cast("long")))


def op1_token_counts(spark, sf_dir: str) -> DataFrame:
    return count_tokens(C.table(spark, sf_dir, "documents"))


QUERIES = {"op1_token_counts": op1_token_counts}
SQL: dict[str, str] = {}
