"""Operator 6, secret scans: two character Markov models and their log-likelihood ratio.

One model is trained on random strings, one on ordinary identifiers; both from labelled samples (string, label).
In every run of LEAST or more characters of the alphabets that keys are written in, the stretch with the largest sum
of log-likelihood ratios, random against ordinary, is reported when that sum outweighs the odds against a stretch being
random: PRIOR, or what held-out ordinary samples reach, if that is more. So length counts as evidence and a key beside
ordinary words is found; the rest of the run is searched in the same way, and a part within the stretch that is ordinary
by the same odds divides it.

The samples are made by a fixed seed. Words of documents that are labelled good can be added as ordinary ones (fit_on):
the closer these are to the texts, the shorter the keys that can be told from words.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

LEAST = 8  # characters, of which seven steps can't outweigh PRIOR if they are fewer
PRIOR = 11.5  # log of 100,000 to 1
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-="
_CODE = np.full(256, len(ALPHABET), np.uint8)
for _i, _c in enumerate(ALPHABET):
    _CODE[ord(_c)] = _i
STATES = len(ALPHABET) + 1
RUN = r"[A-Za-z0-9+/_\-=]{%d,}" % LEAST
_SIGNS = len(ALPHABET) - 5  # codes from here on aren't letters or digits

_WORDS = """get set user account password token session index value count buffer stream reader writer config manager handler
request response client server database table column query result error message event listener factory builder context
service provider controller model view template default parent child node element list array string number integer float
double boolean object class interface abstract static final public private protected internal external local remote global
name type size length width height start stop begin end first last next previous current total average minimum maximum
create delete update insert select remove replace append prepare execute validate convert transform serialize parse format
encode decode encrypt decrypt compress expand import export upload download connect disconnect open close read write flush
the of and to in for is on that with as was by this are from which have not will can their other than when there
information development government international understanding representation communication organisation responsibility
verantwortung entwicklung gesellschaft wissenschaft geschwindigkeit bundesregierung verbindung sicherheit einstellung
und der die das nicht eine einen werden haben keit heit lich schaft ung isch ver ent zer auf aus bei
developpement gouvernement information environnement connaissance organisation responsable particulierement ment tion eau aux
que les des pour dans une est pas sur par plus desarrollo informacion gobierno conocimiento universidad administracion
cion mente ado aba que los las del para con una por internacional comunicacion responsabilidad http https www example com
org net html index page images static assets content article category product search login profile settings home about
test data file path folder directory main module package version release build target source output input temp cache log""".split()


def labelled_samples(n: int = 4000, seed: int = 7) -> list[tuple[str, int]]:
    """n random strings (label 1) and n ordinary identifiers (label 0), by a fixed seed; n is the bound of the training set."""
    r = random.Random(seed)
    kinds = ["0123456789abcdef", "0123456789ABCDEF", ALPHABET[:62], ALPHABET[:62], ALPHABET[:62] + "+/", ALPHABET[:62] + "_-", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", ALPHABET[:26] + ALPHABET[52:62], "abcdefghijklmnopqrstuvwxyz0123456789"]
    out: list[tuple[str, int]] = []
    for _ in range(n):
        abc = r.choice(kinds)
        out.append(("".join(r.choice(abc) for _ in range(r.choice([8, 10, 12, 16, 18, 20, 24, 32, 40, 48, 64, 88]))), 1))
        how, text = r.randrange(7), ""
        least = r.choice([LEAST, 12, 16, 16])
        while len(text) < least:
            w = r.choice(_WORDS)
            w = [w, w.capitalize(), w.upper(), w, w.capitalize(), w, w][how]
            text += ["", "", "_", "_", "-", "-", "/"][how] * bool(text) + w
        if r.random() < 0.25:
            text += r.choice(["", "_", "-"]) + str(r.randrange(r.choice([10, 100, 3000])))
        out.append((text, 0))
        if r.random() < 0.1:
            out.append(("".join(r.choice("0123456789") for _ in range(r.randrange(LEAST, 30))), 0))
    return out


@dataclass(frozen=True)
class MarkovPair:
    """llr[a, b]: log-likelihood ratio of character b after a. cut: what the sum of a stretch must exceed."""

    llr: np.ndarray
    cut: float

    def steps(self, s: str) -> np.ndarray:
        k = codes(s)
        return self.llr[k[:-1], k[1:]]

    def best(self, x: np.ndarray) -> tuple[int, int, float]:
        """(first, end, sum) of the stretch of steps with the largest sum; the shortest and leftmost of several."""
        if not len(x):
            return 0, 0, 0.0
        total = np.concatenate([[0.0], np.cumsum(x)])
        least = np.minimum.accumulate(total[:-1])
        end = int((total[1:] - least).argmax())
        first = end - int(total[: end + 1][::-1].argmin())
        return first, end + 1, float(total[end + 1] - total[first])


def codes(s: str) -> np.ndarray:
    return _CODE[np.frombuffer(s.encode("latin-1", "replace"), np.uint8)]


def fit(samples: list[tuple[str, int]], max_false_positives: float = 0.001, prior: float = PRIOR) -> MarkovPair:
    """First-order models with add-half smoothing. The cut lets max_false_positives of the held-out ordinary samples pass, and is prior at least.

    Null strings and labels other than 0 and 1 don't count. With no sample of a class nothing is reported.
    """
    use = [(s, y) for s, y in samples if s and y in (0, 1)]
    if len({y for _, y in use}) < 2:
        return MarkovPair(np.zeros((STATES, STATES)), float("inf"))
    counts = np.full((2, STATES, STATES), 0.5)
    for s, y in use[0::2] + use[1::4]:
        k = codes(s)
        np.add.at(counts[y], (k[:-1], k[1:]), 1)
    p = np.log(counts / counts.sum(2, keepdims=True))
    m = MarkovPair(p[1] - p[0], prior)
    ordinary = [m.best(m.steps(s))[2] for s, y in use[3::4] if y == 0] or [0.0]
    return MarkovPair(m.llr, max(prior, float(np.quantile(ordinary, 1 - max_false_positives))))


def ordinary_words(docs: DataFrame, labels: DataFrame, most_rows: int = 400, most_words: int = 20_000) -> list[tuple[str, int]]:
    """Ordinary samples: distinct runs of documents labelled good, as they are and in capitals. At most most_rows documents and most_words runs, by hash."""
    ids = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("id")).distinct().orderBy(*C.sample_order("id")).limit(most_rows)
    runs = C.id_text(docs).join(F.broadcast(ids), "id").select(F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("w")).distinct()
    words = sorted(r["w"] for r in runs.orderBy(*C.sample_order("w")).limit(most_words).collect())
    return [(x, 0) for w in words for x in (w, w.upper())]


def fit_on(docs: DataFrame, labels: DataFrame, most_rows: int = 400, most_words: int = 20_000) -> MarkovPair:
    """A model of the made samples and of ordinary_words."""
    samples = labelled_samples() + ordinary_words(docs, labels, most_rows, most_words)
    random.Random(7).shuffle(samples)
    return fit(samples)


@lru_cache(1)
def default_model() -> MarkovPair:
    return fit(labelled_samples())


def _stretches(k: np.ndarray, model: MarkovPair) -> Iterator[tuple[int, int, float]]:
    """(start, end, score) of the secrets in the codes of one run, in no order."""
    todo = [(0, len(k))]
    while todo:
        a, b = todo.pop()
        if b - a < LEAST:
            continue
        first, end, total = model.best(model.llr[k[a : b - 1], k[a + 1 : b]])
        if total <= model.cut:
            continue
        p, q, less = model.best(-model.llr[k[a + first : a + end], k[a + first + 1 : a + end + 1]])
        if less > model.cut:  # what is as surely ordinary parts two secrets
            todo += [(a, a + first + p + 1), (a + first + q, b)]
            continue
        first, end = a + first, a + end + 1
        low, high = first, end  # to the ends of words of letters and digits, or without them where less than half of one is in it
        while low > a and k[low - 1] < _SIGNS:
            low -= 1
        while high < b and k[high] < _SIGNS:
            high += 1
        signs = np.flatnonzero(k[low:high] >= _SIGNS)
        if len(signs):
            head, tail = low + int(signs[0]), low + int(signs[-1]) + 1
            first = low if 2 * (head - first) >= head - low and head > low else head
            end = high if 2 * (end - tail) >= high - tail and high > tail else tail
        else:
            first, end = low, high
        while k[first] >= _SIGNS:
            first += 1
        while k[end - 1] >= _SIGNS and k[end - 1] != STATES - 2:
            end -= 1
        while end < b and k[end] == STATES - 2:
            end += 1
        yield first, end, total
        todo += [(a, first), (end, b)]


def find(texts: list[str | None], model: MarkovPair, most_chars: int = 2_000_000) -> list[tuple[int, int, int, float]]:
    """(text number, start, end, score) of each secret, in order. Texts are joined up to most_chars at once; a longer one is by itself."""
    out, start, size = [], 0, 0
    for n, t in enumerate(texts):
        size += len(t or "") + 1
        if size > most_chars or n == len(texts) - 1:
            out += _find(texts[start : n + 1], start, model)
            start, size = n + 1, 0
    return out


def _find(texts: list[str | None], number: int, model: MarkovPair) -> list[tuple[int, int, int, float]]:
    """Runs whose positive steps alone don't reach the cut are passed over."""
    k = codes(" ".join(t or "" for t in texts))
    inside = np.concatenate([[False], k < STATES - 1, [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    edge = edge.reshape(-1, 2)[edge[1::2] - edge[::2] >= LEAST]
    if not len(edge):
        return []
    up = np.append(np.maximum(model.llr, 0).astype(np.float32)[k[:-1], k[1:]], np.float32(0))
    likely = np.add.reduceat(up, (edge - [0, 1]).ravel())[::2] > model.cut - 0.01
    begin = np.cumsum([0, *(len(t or "") + 1 for t in texts)])
    out = []
    for s, e in edge[likely].tolist():
        n = int(np.searchsorted(begin, s, side="right")) - 1
        out += [(number + n, s + x - int(begin[n]), s + y - int(begin[n]), score) for x, y, score in _stretches(k[s:e], model)]
    return sorted(out)


def spans(text: str | None, model: MarkovPair) -> list[tuple[int, int, float]]:
    """(start, end, score) of each secret, in characters; none in a null or an empty text."""
    return [x[1:] for x in find([text], model)]


def scan(docs: DataFrame, model: MarkovPair | None = None) -> DataFrame:
    """(doc_id, start, end, secret, score): a row for each secret; score is the log-likelihood ratio of its best stretch.

    Null and empty texts have none. Repeated rows give repeated results; a null id stays null. Of equal stretches of a run
    the leftmost is taken first, which changes neither what is found nor its score.
    """
    model = model or default_model()

    def run(rows):
        for ids, texts in C.batches(rows):
            got = [(ids[n], a, b, texts[n][a:b], s) for n, a, b, s in find(texts, model)]
            i, a, b, t, s = zip(*got) if got else ([],) * 5
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(t, pa.string()), pa.array(s, pa.float64())], ["doc_id", "start", "end", "secret", "score"])

    return C.id_text(docs).mapInArrow(run, "doc_id long, start long, end long, secret string, score double")


def redact(docs: DataFrame, model: MarkovPair | None = None, mark: str = "[SECRET]") -> DataFrame:
    """All rows and columns, with each secret in text replaced by mark and n_chars, if there is one, put right; a null text stays null."""
    model = model or default_model()

    @F.pandas_udf("string")
    def clean(text: pd.Series) -> pd.Series:
        out = text.tolist()
        for n, a, b, _ in reversed(find(out, model)):
            out[n] = out[n][:a] + mark + out[n][b:]
        return pd.Series(out, dtype=object)

    name = C.free_name(docs, "clean")
    new = docs.withColumn(name, clean(F.col("text").cast("string")))
    put = {"text": F.col(name), "n_chars": F.when(F.col("text").isNull() | (F.col("text") == F.col(name)), F.col("n_chars")).otherwise(F.length(name)) if "n_chars" in docs.columns else None}
    return new.select(*[put[c].alias(c) if c in put else F.col(f"`{c}`") for c in docs.columns])


def op6_secret_scans(spark, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    return scan(docs, fit_on(docs, C.table(spark, sf_dir, "labels")))


QUERIES = {"op6_secret_scans": op6_secret_scans}
SQL: dict[str, str] = {}
