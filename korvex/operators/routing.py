"""Consistent hashing on MD5 with virtual nodes, as a Python object and as a Column."""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _hex(x: str) -> str:
    return hashlib.md5(x.encode()).hexdigest()  # noqa: S324


class HashRing:
    def __init__(self, nodes: Sequence[str] = (), virtual: int = 128):
        self.virtual, self.nodes = virtual, set()
        self._ring: list[tuple[str, str]] = []
        for n in nodes:
            self.add(n)

    def add(self, node: str) -> None:
        if node not in self.nodes:
            self.nodes.add(node)
            for i in range(self.virtual):
                bisect.insort(self._ring, (_hex(f"{node}:{i}"), node))

    def remove(self, node: str) -> None:
        self.nodes.discard(node)
        self._ring = [x for x in self._ring if x[1] != node]

    def get_nodes(self, key: str, n: int = 1) -> list[str]:
        """The first n different nodes at or after the key's place, around the ring; fewer if there are fewer."""
        out: list[str] = []
        at = bisect.bisect_left(self._ring, (_hex(key), ""))
        for k in range(len(self._ring)):
            node = self._ring[(at + k) % len(self._ring)][1]
            if node not in out:
                out.append(node)
                if len(out) >= n:
                    break
        return out[:n]

    def get_node(self, key: str) -> str | None:
        return (self.get_nodes(key) or [None])[0]

    def column(self, key: Column) -> Column:
        """The node of each key, null for a null one: a binary search of the ring for a batch of hashes at once."""
        if not self._ring:
            return F.lit(None).cast("string")
        places = np.array([h for h, _ in self._ring])
        names = np.array([n for _, n in self._ring], dtype=object)

        @F.pandas_udf("string")
        def owner(digest: pd.Series) -> pd.Series:
            at = np.searchsorted(places, digest.fillna("").to_numpy(dtype=places.dtype)) % len(places)
            return pd.Series(names[at]).where(digest.notna().to_numpy(), None)

        return owner(F.md5(key.cast("string").cast("binary")))
