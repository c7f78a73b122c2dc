"""Operator 10, document fingerprints: one-permutation MinHash with optimal densification and packed low-order bits.

Each distinct word n-gram of a text is hashed once; the high bits pick one of BINS bins and the bin keeps its
smallest hash. An empty bin copies a bin that isn't empty, found by a hash of (bin, attempt) that is the same for
all texts, so that equal sets agree everywhere. Of each bin the lowest BITS bits are stored. Two texts that share
nothing agree in 1 of 2**BITS bins by chance, which estimate() takes out: (share - C) / (1 - C), C = 2**-BITS.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

NGRAM, BINS, BITS = 3, 256, 4
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def signatures(sets: list[np.ndarray], bins: int = BINS) -> np.ndarray:
    """Bin minima of each set of hashes after densification; a row of an empty set stays all ones. bins is a power of 2."""
    if bins < 2 or bins & (bins - 1):
        raise ValueError("bins must be a power of 2")
    shift = np.uint64(64 - bins.bit_length() + 1)
    sizes = [len(s) for s in sets]
    out = np.full(len(sets) * bins, _EMPTY)
    h = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    if len(h):
        at = np.repeat(np.arange(len(sets)), sizes) * bins + (h >> shift).astype(np.int64)
        np.minimum.at(out, at, h & ((np.uint64(1) << shift) - np.uint64(1)))
    out = out.reshape(len(sets), bins)
    full = out != _EMPTY
    doc, gap = np.nonzero(~full & full.any(1)[:, None])
    sparse, attempt = out.copy(), 1
    while len(doc):
        pick = (C.mix(C.mix(gap.astype(np.uint64) * C.M1 + np.uint64(attempt))) >> shift).astype(np.int64)
        ok = full[doc, pick]
        out[doc[ok], gap[ok]] = sparse[doc[ok], pick[ok]]
        doc, gap, attempt = doc[~ok], gap[~ok], attempt + 1
    return out


def pack(sig: np.ndarray, bits: int = BITS) -> list[bytes]:
    low = (sig[:, :, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
    return [r.tobytes() for r in np.packbits(low.astype(np.uint8).reshape(len(sig), -1), axis=1)]


def unpack(packed: bytes, bins: int = BINS, bits: int = BITS) -> np.ndarray:
    return np.unpackbits(np.frombuffer(packed, np.uint8))[: bins * bits].reshape(bins, bits) @ (1 << np.arange(bits))


def estimate(a: bytes | None, b: bytes | None, bins: int = BINS, bits: int = BITS) -> float | None:
    """Jaccard similarity by two fingerprints, chance agreement taken out and cut to [0, 1]; null where either is null."""
    if a is None or b is None:
        return None
    chance = 2.0**-bits
    return float(min(1.0, max(0.0, ((unpack(a, bins, bits) == unpack(b, bins, bits)).mean() - chance) / (1 - chance))))


def fingerprint(docs: DataFrame, n: int = NGRAM, bins: int = BINS, bits: int = BITS) -> DataFrame:
    """(doc_id, n_grams, filled_bins, fingerprint) for every row.

    A null or an empty text, or one of white space only, has 0 n-grams and a null fingerprint; a text of fewer than n
    words is one n-gram. Repeated rows give repeated results.
    """

    def run(rows):
        for ids, texts in C.batches(rows):
            sets = [C.gram_set(t, n) for t in texts]
            packed = pack(signatures(sets, bins), bits)
            shift = np.uint64(64 - bins.bit_length() + 1)
            filled = [len(np.unique(s >> shift)) for s in sets]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(filled, pa.int64()), pa.array([p if len(s) else None for p, s in zip(packed, sets)], pa.binary())], ["doc_id", "n_grams", "filled_bins", "fingerprint"])

    return C.id_text(docs).mapInArrow(run, "doc_id long, n_grams long, filled_bins long, fingerprint binary")


def compare(pairs: DataFrame, a: str, b: str, out: str = "similarity", bins: int = BINS, bits: int = BITS) -> DataFrame:
    """Adds the estimated similarity of two fingerprint columns, as estimate() has it; null where either is null. bins * bits is a multiple of 8."""

    width, chance = bins * bits // 8, 2.0**-bits

    @F.pandas_udf("double")
    def sim(x: pd.Series, y: pd.Series) -> pd.Series:
        ok = (x.notna() & y.notna()).to_numpy()
        got = np.full(len(x), np.nan)
        p, q = (np.frombuffer(b"".join(c[ok]), np.uint8).reshape(-1, width) for c in (x, y))
        for s in range(0, len(p), 4096):
            differ = np.unpackbits(p[s : s + 4096] ^ q[s : s + 4096], axis=1).reshape(-1, bins, bits).any(2)
            got[np.flatnonzero(ok)[s : s + 4096]] = np.clip((1 - differ.mean(1) - chance) / (1 - chance), 0, 1)
        return pd.Series(got).astype("Float64").where(ok, None)

    return pairs.withColumn(out, sim(F.col(a), F.col(b)))


def op10_document_fingerprints(spark, sf_dir: str) -> DataFrame:
    return fingerprint(C.table(spark, sf_dir, "documents"))


QUERIES = {"op10_document_fingerprints": op10_document_fingerprints}
SQL: dict[str, str] = {}
