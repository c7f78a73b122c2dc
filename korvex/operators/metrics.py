"""Latency figures and totals, and counters of what an engine did."""

from __future__ import annotations

import time
from collections import defaultdict
from collections.abc import Iterator
from contextlib import contextmanager
from threading import Lock

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

EDGES = (0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0)


class Counters:
    """Counts, gauges and histograms of seconds by name and labels; text() has them in the exposition format that scrapers read."""

    def __init__(self, prefix: str = "korvex") -> None:
        self.prefix, self._lock = prefix, Lock()
        self._counts: dict[tuple[str, tuple], float] = defaultdict(float)
        self._gauges: dict[tuple[str, tuple], float] = {}
        self._seconds: dict[tuple[str, tuple], list[float]] = {}

    def add(self, name: str, n: float = 1, **labels: str) -> None:
        with self._lock:
            self._counts[name, tuple(sorted(labels.items()))] += n

    def set(self, name: str, value: float, **labels: str) -> None:
        with self._lock:
            self._gauges[name, tuple(sorted(labels.items()))] = value

    def observe(self, name: str, seconds: float, **labels: str) -> None:
        with self._lock:
            row = self._seconds.setdefault((name, tuple(sorted(labels.items()))), [0.0] * (len(EDGES) + 2))
            for k, edge in enumerate(EDGES):
                row[k] += seconds <= edge
            row[-2] += 1
            row[-1] += seconds

    def get(self, name: str, **labels: str) -> float:
        key = (name, tuple(sorted(labels.items())))
        return self._gauges.get(key, self._counts.get(key, 0.0))

    @contextmanager
    def timed(self, name: str) -> Iterator[None]:
        """Counts what is done and its seconds, by whether it went well."""
        began, status = time.perf_counter(), "error"
        try:
            yield
            status = "ok"
        finally:
            self.add(f"{name}_requests", status=status)
            self.observe(f"{name}_seconds", time.perf_counter() - began, status=status)

    def text(self) -> str:
        def line(name: str, labels: tuple, value: float, suffix: str = "") -> str:
            quoted = ",".join(f'{k}="{v}"' for k, v in labels)
            return f"{self.prefix}_{name}{suffix}{'{' + quoted + '}' if quoted else ''} {value:g}"

        out = []
        with self._lock:
            for kind, rows, suffix in (("counter", self._counts, "_total"), ("gauge", self._gauges, "")):
                for name in sorted({n for n, _ in rows}):
                    out.append(f"# TYPE {self.prefix}_{name}{suffix} {kind}")
                    out += [line(n, labels, v, suffix) for (n, labels), v in sorted(rows.items()) if n == name]
            for name in sorted({n for n, _ in self._seconds}):
                out.append(f"# TYPE {self.prefix}_{name} histogram")
                for (n, labels), row in sorted(self._seconds.items()):
                    if n == name:
                        out += [line(n, (*labels, ("le", f"{e:g}")), row[k], "_bucket") for k, e in enumerate(EDGES)]
                        out += [line(n, (*labels, ("le", "+Inf")), row[-2], "_bucket"), line(n, labels, row[-1], "_sum"), line(n, labels, row[-2], "_count")]
        return "\n".join(out) + "\n"


def latest_percentiles(df: DataFrame, value: str, order: str, newest: int = 1000) -> DataFrame:
    """(n, p50, p99, avg) over the newest rows by `order`: values at places n // 2 and int(0.99 n) of the sorted list, not between two."""
    last = df.where(F.col(value).isNotNull()).select(F.col(value).alias("v"), F.col(order).alias("o")).orderBy(F.col("o").desc(), "v").limit(newest)
    n = F.count("*").over(Window.partitionBy(F.lit(1)))
    ranked = last.select("v", (F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("v")) - 1).alias("i"), n.alias("n"))
    at = lambda e: F.max(F.when(F.col("i") == e, F.col("v")))
    return ranked.agg(F.count("*").alias("n"), at(F.floor(F.col("n") / 2)).alias("p50"), at(F.least(F.floor(F.col("n") * 0.99), F.col("n") - 1)).alias("p99"), F.avg("v").alias("avg"))


def summary(df: DataFrame, value: str, accuracy: int | None = None) -> DataFrame:
    """(p50, p90, p99, low, high, mean), percentiles between values.

    Exact percentiles hold every distinct value once in one task. With accuracy they are approximate: the place of each
    is off by at most 1 / accuracy of the rows, in memory of a fixed size.
    """
    at = F.array(F.lit(0.5), F.lit(0.9), F.lit(0.99))
    p = F.percentile(value, at) if accuracy is None else F.percentile_approx(value, at, F.lit(accuracy))
    return df.agg(p.alias("p"), F.min(value).alias("low"), F.max(value).alias("high"), F.avg(value).alias("mean")).select(F.col("p")[0].alias("p50"), F.col("p")[1].alias("p90"), F.col("p")[2].alias("p99"), "low", "high", "mean")
