"""Operator 7, SentencePiece encoding and decoding with seeded merge-dropout.

Encoding follows the BPE rules of a SentencePiece model with byte fallback: the text, with spaces as U+2581 and one
in front, is cut where a U+2581 follows something else (no piece of such a model crosses that point, which load()
checks), and each word is merged from an agenda of neighbouring pieces, best score and then leftmost first. A
candidate merge is skipped for good when a keyed hash of its place in the word falls under the dropout rate. The key is
a hash of the seed, the document id and the word's place in the text, so each occurrence of a word is merged on its own;
only without dropout are results of words kept. The same seed always gives the same pieces; dropout 0 gives exactly the
library's encoding. Whatever is skipped, the pieces decode to the text: a literal U+2581 is written as bytes.
"""

from __future__ import annotations

import re
import zlib
from array import array
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
MOST_KEPT = 800_000
_CUT = re.compile(r" *[^ ]+| +")
_NEVER = (1 << 31) - 1
_CHARS = 1 << 17  # ids of characters without a piece begin here
_PAD = (1 << 21) - 1
_ALL = (1 << 64) - 1
_WIDTHS = (8, 12, 16, 24, 48)


@dataclass
class Pieces:
    """Scores and ids of a model, and the words encoded so far without dropout."""

    ids: dict[str, int]
    rank: dict[str, int]
    raw: list[bytes]
    byte_ids: list[int]
    by_rank: np.ndarray
    char_id: np.ndarray
    pair_key: np.ndarray  # hash table of pairs of ids, -1 where a place is free
    pair_rank: np.ndarray
    kept: dict = field(default_factory=dict)

    @property
    def code(self) -> str:
        return "H" if len(self.raw) < 65536 else "i"


@lru_cache(4)
def load(path: str = MODEL) -> Pieces:
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    names = [sp.id_to_piece(i) for i in range(n)]
    plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    byte_ids = [0] * 256
    raw = [b""] * n
    for i in range(n):
        if sp.is_byte(i):
            byte_ids[int(names[i][1:-1], 16)] = i
            raw[i] = bytes([int(names[i][1:-1], 16)])
    for i in plain:
        raw[i] = names[i].replace(SPACE, " ").encode()
        if SPACE in names[i].lstrip(SPACE):
            raise ValueError(f"piece {names[i]!r} crosses a word; this model needs another cut")
    order = sorted(plain, key=lambda i: (-sp.get_score(i), i))
    ids, rank = {names[i]: i for i in plain}, {names[i]: r for r, i in enumerate(order)}
    char_id = np.arange(0x110000, dtype=np.int64) + _CHARS
    for x, i in ids.items():
        if len(x) == 1:
            char_id[ord(x)] = i
    char_id[32] = char_id[ord(SPACE)]
    pairs = {}
    for x, r in rank.items():
        for k in range(1, len(x)):
            a, b = (ids.get(y, ord(y) + _CHARS if len(y) == 1 else None) for y in (x[:k], x[k:]))
            if a is not None and b is not None:
                pairs[a << 21 | b] = r
    return Pieces(ids, rank, raw, byte_ids, np.array(order, np.int64), char_id, *_pair_table(pairs))


def _place(key: np.ndarray, size: int) -> np.ndarray:
    """First place of each key in a table of `size` places, a power of two."""
    return (key.astype(np.uint64) * C.M1 >> np.uint64(65 - size.bit_length())).astype(np.int64)


def _pair_table(pairs: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Keys and ranks by place, at least four places a pair; a key whose place is taken goes to the next free one."""
    size = 1 << (4 * len(pairs) + 4).bit_length()
    keys, ranks = np.full(size, -1, np.int64), np.full(size, _NEVER, np.int32)
    for (k, r), at in zip(pairs.items(), _place(np.fromiter(pairs, np.int64, len(pairs)), size).tolist()):
        while keys[at] >= 0:
            at = (at + 1) % size
        keys[at], ranks[at] = k, r
    return keys, ranks


def pair_ranks(p: Pieces, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rank of the piece that each pair of ids merges to, or _NEVER."""
    key, size = a << 21 | b, len(p.pair_key)
    at = _place(key, size)
    found = p.pair_key[at]
    out = np.where(found == key, p.pair_rank[at], np.int32(_NEVER))
    left = np.nonzero((found != key) & (found >= 0))
    key, at = key[left], at[left]
    while len(key):
        at = (at + 1) % size
        found = p.pair_key[at]
        hit = found == key
        out[tuple(x[hit] for x in left)] = p.pair_rank[at[hit]]
        on = ~hit & (found >= 0)
        key, at, left = key[on], at[on], tuple(x[on] for x in left)
    return out


@lru_cache(64)
def skip_table(seed: int, variant: int, dropout: float) -> bytes:
    """Hash table keyed by seed and variant: 1 at a place where a candidate is skipped. A candidate's place is its hash."""
    if not dropout:
        return bytes(65536)
    x = C.mix(C.mix(np.arange(65536, dtype=np.uint64) * C.M1 + np.uint64(C.xxhash.xxh64_intdigest(f"{seed}|{variant}"))))
    return ((x >> np.uint64(32)) < np.uint64(dropout * 2**32)).astype(np.uint8).tobytes()


@dataclass
class Occurrence:
    """Skips of one occurrence of a word: used where a skip table is."""

    key: int
    limit: int  # of 2 ** 32

    def skips(self, i: int, j: int, k: int) -> bool:
        x = (self.key + (i * 7919 + j * 104729 + k * 1299709) * int(C.M1)) & _ALL
        x = (x ^ (x >> 31)) * int(C.M2) & _ALL
        return ((x ^ (x >> 29)) >> 32) < self.limit


def _skipper(word: str, table: bytes | Occurrence):
    """Whether the candidate of (its place, the right piece's, its end) is skipped."""
    if isinstance(table, Occurrence):
        return table.skips
    w = zlib.crc32(word.encode("utf-8", "replace"))
    return lambda i, j, k: table[(w ^ (i * 7919 + j * 104729 + k * 1299709)) & 65535]


def merge_word(word: str, p: Pieces, table: bytes | Occurrence) -> list[str]:
    """Pieces of one word (spaces written U+2581) under a skip table or an occurrence's skips."""
    if len(word) > 48:
        return _merge_long(list(word), p, table)
    s = list(word)
    get = p.rank.get
    skips = _skipper(word, table)
    at = list(range(len(s) + 1))
    c = []
    for i in range(len(s) - 1):
        r = get(word[i : i + 2])
        c.append(_NEVER if r is None or skips(i, i + 1, i + 2) else r)
    while c:
        best = min(c)
        if best == _NEVER:
            break
        i = c.index(best)
        s[i] += s[i + 1]
        del s[i + 1], at[i + 1], c[i]
        if i < len(c):
            r = get(s[i] + s[i + 1])
            c[i] = _NEVER if r is None or skips(at[i], at[i + 1], at[i + 2]) else r
        if i:
            r = get(s[i - 1] + s[i])
            c[i - 1] = _NEVER if r is None or skips(at[i - 1], at[i], at[i + 1]) else r
    return s


def _merge_long(s: list[str], p: Pieces, table: bytes | Occurrence) -> list[str]:
    """The same by a heap and linked neighbours, for long words."""
    import heapq

    n = len(s)
    skips = _skipper("".join(s), table)
    nxt, prv, end, alive = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
    heap: list[tuple[int, int, int, int]] = []

    def push(i: int) -> None:
        j = nxt[i]
        if j < n and (r := p.rank.get(s[i] + s[j])) is not None and not skips(i, j, end[j]):
            heapq.heappush(heap, (r, i, j, end[j]))

    for i in range(n - 1):
        push(i)
    while heap:
        _, i, j, e = heapq.heappop(heap)
        if not (alive[i] and alive[j] and nxt[i] == j and end[j] == e and end[i] == j):
            continue
        s[i] += s[j]
        alive[j] = False
        end[i], nxt[i] = e, nxt[j]
        if nxt[i] < n:
            prv[nxt[i]] = i
        push(i)
        if prv[i] >= 0:
            push(prv[i])
    return [x for x, ok in zip(s, alive) if ok]


def word_ids(word: str, p: Pieces, table: bytes | Occurrence) -> list[int]:
    """Ids of one word as it stands in the text, its leading spaces included. A literal U+2581 takes part in no merge."""
    out: list[int] = []
    for k, part in enumerate(word.split(SPACE)):
        if k:
            out += [p.byte_ids[b] for b in SPACE.encode()]
        if part:
            for piece in merge_word(part.replace(" ", SPACE), p, table):
                i = p.ids.get(piece)
                if i is None:
                    out += [p.byte_ids[b] for b in piece.encode("utf-8", "replace")]
                else:
                    out.append(i)
    return out


def merge_batch(words: list[str], p: Pieces, table: bytes, of: np.ndarray | None = None, keys: np.ndarray | None = None, limit: int = 0) -> list[bytes]:
    """Packed ids of each of many words; see merge_flat."""
    ids, count = merge_flat(words, p, table, of, keys, limit)
    end = np.cumsum(count)
    return [ids[s:e].tobytes() for s, e in zip((end - count).tolist(), end.tolist())]


def merge_flat(words: list[str], p: Pieces, table: bytes, of: np.ndarray | None = None, keys: np.ndarray | None = None, limit: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Ids of many words, one after the other, and how many each has; the same as word_ids one by one.

    With keys, those of occurrences: occurrence x is of word of[x] and skips by keys[x] and limit, in place of the table.
    A round takes the best candidate of every word that has any; neighbours are linked by position.
    """
    of = np.arange(len(words)) if of is None else of
    counts = np.zeros(len(of), np.int64)
    done: list[tuple[np.ndarray, np.ndarray]] = []  # occurrences and their ids
    single: list[tuple[int, array]] = []
    sizes = np.array([len(w) if SPACE not in w else 1 << 30 for w in words], np.int64)
    skip, low = np.frombuffer(table, np.uint8), 0

    def thinned(r, w, i, j, k):
        place = i * 7919 + j * 104729 + k * 1299709
        if keys is None:
            return np.where(skip[(w ^ place) & 65535] == 1, np.int32(_NEVER), r)
        return np.where((C.mix(w + place.astype(np.uint64) * C.M1) >> np.uint64(32)) < np.uint64(limit), np.int32(_NEVER), r)

    for width in _WIDTHS:
        fits = (sizes > low) & (sizes <= width)
        distinct, which = np.flatnonzero(fits), np.flatnonzero(fits[of])
        low = width
        if not len(which):
            continue
        own = [words[i] for i in distinct]
        text = np.full((len(own), row := width + 1), _PAD, np.int64)
        text[np.arange(row) < sizes[distinct][:, None]] = p.char_id[np.frombuffer("".join(own).encode("utf-32-le", "surrogatepass"), np.uint32)]
        pairs = pair_ranks(p, text[:, :-2], text[:, 1:-1])
        at = (np.cumsum(fits) - 1)[of[which]]  # of each occurrence, its row of text
        crc = keys[which] if keys is not None else np.fromiter((zlib.crc32(w.replace(" ", SPACE).encode("utf-8", "replace")) for w in own), np.int64, len(own))[at]
        n, size, sym = len(which), sizes[of[which]], text[at]
        alive = np.arange(row) < size[:, None]
        nxt = np.minimum(np.arange(1, row + 1, dtype=np.int32), size[:, None].astype(np.int32))
        prv = np.tile(np.arange(-1, row - 1, dtype=np.int32), (n, 1))
        best = np.full((n, width), _NEVER, np.int32)
        i = np.arange(width - 1)
        best[:, :-1] = thinned(pairs[at], crc[:, None], i, i + 1, i + 2)
        sym, nxt, prv, best = sym.ravel(), nxt.ravel(), prv.ravel(), best.reshape(-1)
        rows, live = np.arange(n), alive.reshape(-1)
        while len(rows):
            top = best.reshape(n, width)[rows]
            i = top.argmin(1)
            r = top[np.arange(len(rows)), i]
            ok = r < _NEVER
            rows, i, r = rows[ok], i[ok], r[ok]
            base, flat, w = rows * row, rows * width, crc[rows]
            j = nxt[base + i]
            k = nxt[base + j]
            m = p.by_rank[r]
            sym[base + i] = m
            nxt[base + i] = k
            prv[base + k] = i
            live[base + j] = False
            best[(flat + j)[j < width]] = _NEVER
            best[flat + i] = thinned(pair_ranks(p, m, sym[base + k]), w, i, k, nxt[base + k])
            h = prv[base + i]
            left = h >= 0
            h, base, flat = h[left], base[left], flat[left]
            best[flat + h] = thinned(pair_ranks(p, sym[base + h], m[left]), w[left], h, i[left], k[left])
        live = live.reshape(n, row)
        ids, count = sym.reshape(n, row)[live], live.sum(1)
        odd = np.zeros(n, bool)
        odd[np.searchsorted(np.cumsum(count), np.flatnonzero(ids >= _CHARS), side="right")] = True
        if odd.any():
            parts = np.split(ids[np.repeat(odd, count)], np.cumsum(count[odd])[:-1])
            single += [(q, _with_bytes(x.tolist(), p)) for q, x in zip(which[odd].tolist(), parts)]
            which, ids, count = which[~odd], ids[np.repeat(~odd, count)], count[~odd]
        counts[which] = count
        done.append((which, ids))
    for q in np.flatnonzero(sizes[of] > _WIDTHS[-1]).tolist():
        single.append((q, array(p.code, word_ids(words[of[q]], p, table if keys is None else Occurrence(int(keys[q]), limit)))))
    for q, x in single:
        counts[q] = len(x)
    begin = np.cumsum(counts) - counts
    out = np.empty(int(counts.sum()), p.code)
    for which, ids in done:
        count = counts[which]
        out[np.arange(len(ids)) + np.repeat(begin[which] - (np.cumsum(count) - count), count)] = ids
    for q, x in single:
        out[begin[q] : begin[q] + len(x)] = x
    return out, counts


def _with_bytes(ids: list[int], p: Pieces) -> array:
    """The ids, with the bytes of characters that have no piece."""
    out = array(p.code)
    for i in ids:
        if i < _CHARS:
            out.append(i)
        else:
            out.extend(p.byte_ids[b] for b in chr(i - _CHARS).replace(" ", SPACE).encode("utf-8", "replace"))
    return out


def occurrence_keys(doc_id: int | None, n: int, seed: int) -> np.ndarray:
    """Key of each of a document's n words."""
    base = np.uint64(((seed * 0x9E3779B97F4A7C15) ^ ((doc_id or 0) * 0xD6E8FEB86659FD93)) & _ALL)
    return C.mix(C.mix(np.arange(n, dtype=np.uint64) * C.M1 + base))


def encode_batch(texts: list[str | None], p: Pieces, doc_ids: list[int | None], seed: int = 0, dropout: float = 0.1) -> list[np.ndarray]:
    """Id arrays of texts; an empty one for a null or an empty text."""
    cut = [_CUT.findall(" " + t) if t else [] for t in texts]
    flat = [w for ws in cut for w in ws]
    if dropout:
        number = {w: n for n, w in enumerate(dict.fromkeys(flat))}
        of = np.fromiter(map(number.__getitem__, flat), np.int64, len(flat))
        keys = np.concatenate([occurrence_keys(i, len(ws), seed) for i, ws in zip(doc_ids, cut)]) if cut else np.zeros(0, np.uint64)
        ids, count = merge_flat(list(number), p, b"", of, keys, int(dropout * 2**32))
        end = np.concatenate([[0], np.cumsum(count)])[np.cumsum([0, *map(len, cut)])].tolist()
        return [ids[s:e] for s, e in zip(end[:-1], end[1:])]
    else:
        if len(p.kept) > MOST_KEPT:
            p.kept.clear()
        new = list(set(flat).difference(p.kept))
        p.kept.update(zip(new, merge_batch(new, p, skip_table(0, 0, 0.0))))
        packed = list(map(p.kept.__getitem__, flat))
    end = np.cumsum([len(ws) for ws in cut]).tolist()
    return [np.frombuffer(b"".join(packed[e - len(ws) : e]), p.code) for e, ws in zip(end, cut)]


def encode_ids(text: str | None, p: Pieces, doc_id: int | None = 0, seed: int = 0, dropout: float = 0.1) -> np.ndarray:
    return encode_batch([text], p, [doc_id], seed, dropout)[0]


def decode_ids(ids, p: Pieces) -> str:
    """The text of a list of ids; the space in front that encoding added goes. Unknown bytes become U+FFFD."""
    raw = b"".join(map(p.raw.__getitem__, ids.tolist() if isinstance(ids, np.ndarray) else ids))
    return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


def encode_documents(docs: DataFrame, seed: int = 0, dropout: float = 0.1, model_path: str = MODEL) -> DataFrame:
    """(doc_id, piece_ids, n_pieces, n_chars, lossless) for every row: lossless tells whether piece_ids, decoded, give the text back.

    A null or an empty text has no pieces, 0 characters and is lossless.
    """

    def run(rows):
        p = load(model_path)
        for ids, texts in C.batches(rows, 1_000_000):
            flat, n, chars, ok = [], [], [], []
            for t, a in zip(texts, encode_batch(texts, p, ids, seed, dropout)):
                flat.append(a)
                n.append(len(a))
                chars.append(len(t or ""))
                ok.append(decode_ids(a, p) == (t or ""))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), C.list_array(np.concatenate(flat).astype(np.int32) if flat else np.zeros(0, np.int32), n, pa.int32()), pa.array(n, pa.int64()), pa.array(chars, pa.int64()), pa.array(ok, pa.bool_())],
                ["doc_id", "piece_ids", "n_pieces", "n_chars", "lossless"],
            )

    return C.id_text(docs).mapInArrow(run, "doc_id long, piece_ids array<int>, n_pieces long, n_chars long, lossless boolean")


def decode_documents(encoded: DataFrame, model_path: str = MODEL) -> DataFrame:
    """(doc_id, text) from (doc_id, piece_ids); null ids give an empty text."""

    @F.pandas_udf("string")
    def text(ids: pd.Series) -> pd.Series:
        p = load(model_path)
        return pd.Series([decode_ids([] if x is None else x, p) for x in ids], dtype=object)

    return encoded.select(F.col("doc_id"), text("piece_ids").alias("text"))


def op7_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return encode_documents(C.table(spark, sf_dir, "documents"))


QUERIES = {"op7_sentencepiece": op7_sentencepiece}
SQL: dict[str, str] = {}
