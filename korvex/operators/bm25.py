"""Full-text search: a small query language, scored by BM25.

Documents are searched as they are, in one pass for the statistics and one for the scores, or by a stored index: rows
of a token with the documents that hold it and its places in them, in folders by token, so that a search reads the rows of
its own words only.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

K1, B, LONGEST = 1.2, 0.75, 40
MOST_TOKENS = 2_000_000  # that a task that writes an index gathers
_TOKEN = re.compile(r"[^\W_]+")


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits of at most LONGEST bytes; none for null."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return F.filter(found, lambda x: F.octet_length(x) <= LONGEST)


@dataclass
class Node:
    """Leaf: words (more than one is a phrase). Otherwise kind is and, or, with must, should and never as parts."""

    words: tuple[str, ...] = ()
    must: list[Node] = field(default_factory=list)
    should: list[Node] = field(default_factory=list)
    never: list[Node] = field(default_factory=list)


def parse(query: str) -> Node:
    """Terms are joined by OR; AND, OR, NOT, +must, -never, "a phrase" and ( ) are understood. AND binds closer than OR.

    A parenthesis or quote that isn't closed raises.
    """
    lex = re.findall(r'"[^"]*"|[()]|[+-](?=\S)|[^\s()"]+|"', query)
    if '"' in lex:
        raise ValueError("a quote isn't closed")
    at = 0

    def peek() -> str | None:
        return lex[at] if at < len(lex) else None

    def unit() -> Node:
        nonlocal at
        x = lex[at]
        at += 1
        if x == "(":
            n = either()
            if peek() != ")":
                raise ValueError("a parenthesis isn't closed")
            at += 1
            return n
        words = tuple(_TOKEN.findall(x.lower()))
        if x.startswith('"') or len(words) < 2:
            return Node(words=words)
        return Node(words=words)  # a-b is a phrase of its parts

    def signed() -> tuple[str, Node]:
        nonlocal at
        x = peek()
        if x in ("+", "-", "NOT"):
            at += 1
            if peek() in (None, ")"):
                raise ValueError(f"nothing follows {x}")
            return ("must" if x == "+" else "never"), unit()
        return "should", unit()

    def both() -> tuple[str, Node]:
        nonlocal at
        parts = [signed()]
        while peek() == "AND":
            at += 1
            parts.append(signed())
        if len(parts) == 1:
            return parts[0]
        return "should", Node(must=[n for s, n in parts if s != "never"], never=[n for s, n in parts if s == "never"])

    def either() -> Node:
        nonlocal at
        n = Node()
        while peek() not in (None, ")"):
            if peek() == "OR":
                at += 1
                continue
            s, x = both()
            getattr(n, s).append(x)
        return n

    root = either()
    if at < len(lex):
        raise ValueError("a parenthesis isn't open")
    return root


def _leaves(n: Node, out: list[tuple[str, ...]]) -> list[tuple[str, ...]]:
    if n.words and n.words not in out:
        out.append(n.words)
    for x in (*n.must, *n.should, *n.never):
        _leaves(x, out)
    return out


def _count(toks: Column, words: tuple[str, ...]) -> Column:
    """How often a word or a phrase stands in the tokens."""
    if len(words) == 1:
        return F.size(F.filter(toks, lambda x: x == words[0]))
    spaced = F.concat(F.lit(" "), F.array_join(toks, "  "), F.lit(" "))  # every token with spaces of its own
    return F.regexp_count(spaced, F.lit(f"(?= {'  '.join(words)} )"))


def index(docs: DataFrame, fields: Sequence[str] = ("text",), id_col: str = "id") -> DataFrame:
    """Tokenised documents (id, one token array a field), to be stored and searched many times."""
    return docs.select(F.col(id_col).alias("id"), *[tokens(F.col(f).cast("string")).alias(f"tokens_{f}") for f in fields])


def search_index(ix: DataFrame, query: str, k: int, fields: Sequence[str] = ("text",)) -> DataFrame:
    """(id, score) of the best k matches, ties by id; a document's score is the sum over its fields. No word, no match."""
    root = parse(query)
    leaves = _leaves(root, [])
    if not leaves or k <= 0:
        return _nothing(ix)
    words = sorted({w for x in leaves for w in x})
    tf = ix.select("id", *[F.size(f"tokens_{f}").cast("double").alias(f"dl{i}") for i, f in enumerate(fields)], *[_count(F.col(f"tokens_{f}"), w).alias(f"tf{i}_{n}") for i, f in enumerate(fields) for n, w in enumerate(leaves)])
    counts = [F.sum(F.array_contains(f"tokens_{f}", w).cast("long")).alias(f"df{i}_{m}") for i, f in enumerate(fields) for m, w in enumerate(words)]
    st = ix.agg(F.count("*").alias("n"), *[F.avg(F.size(f"tokens_{f}")).alias(f"avg{i}") for i, f in enumerate(fields)], *counts).first()
    df = {(i, w): st[f"df{i}_{m}"] for i in range(len(fields)) for m, w in enumerate(words)}
    return _rank(tf, root, leaves, st["n"], [st[f"avg{i}"] for i in range(len(fields))], df, k) if st["n"] else _nothing(ix)


def _nothing(ix: DataFrame) -> DataFrame:
    return ix.sparkSession.createDataFrame([], f"id {ix.schema['id'].dataType.simpleString()}, score double")


def _rank(tf: DataFrame, root: Node, leaves: list[tuple[str, ...]], n: int, average: list[float], df: dict[tuple[int, str], int], k: int) -> DataFrame:
    """The best k of (id, dl<field>, tf<field>_<leaf>), by the number of documents, the fields' mean lengths and the words' document counts."""
    number = {w: x for x, w in enumerate(leaves)}
    fields = range(len(average))

    def leaf_score(i: int, w: tuple[str, ...]) -> Column:
        t = F.col(f"tf{i}_{number[w]}").cast("double")
        idf = sum(math.log(1 + (n - d + 0.5) / (d + 0.5)) for d in (df.get((i, x), 0) for x in w))
        return F.lit(idf) * t * (K1 + 1) / (t + K1 * (1 - B + B * F.col(f"dl{i}") / max(average[i] or 0.0, 1e-9)))

    def hit(x: Node) -> Column:
        if x.words:
            out = F.lit(False)
            for i in fields:
                out = out | (F.col(f"tf{i}_{number[x.words]}") > 0)
            return out
        if not x.must and not x.should:
            return F.lit(False)
        out = F.lit(True)
        for y in x.must:
            out = out & hit(y)
        if x.should and not x.must:
            some = F.lit(False)
            for y in x.should:
                some = some | hit(y)
            out = out & some
        for y in x.never:
            out = out & ~hit(y)
        return out

    def score(x: Node) -> Column:
        out = F.lit(0.0)
        if x.words:
            for i in fields:
                out = out + leaf_score(i, x.words)
            return out
        for y in (*x.must, *x.should):
            out = out + F.when(hit(y), score(y)).otherwise(0.0)
        return out

    return tf.where(hit(root)).select("id", score(root).alias("score")).orderBy(F.col("score").desc(), "id").limit(k)


def bucket_of(token: str, buckets: int) -> int:
    """The folder of a token, as Spark's xxhash64 of it says."""
    h = xxhash.xxh64_intdigest(token.encode(), 42)
    return (h - (1 << 64) if h >> 63 else h) % buckets


def _blocks(ids: pa.Array, lists: pa.Array, field: str) -> pa.RecordBatch:
    """A row for each token of these documents: its documents in their order, their lengths, counts, where their places start, and places."""
    flat = lists.flatten()
    words = flat.dictionary_encode()
    lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int32)
    number = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
    place = np.arange(len(flat), dtype=np.int32) - np.repeat((np.cumsum(lengths, dtype=np.int64) - lengths).astype(np.int32), lengths)
    code = words.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(code, kind="stable")  # documents and places ascend within a token
    code, number, place = code[order], number[order], place[order]
    new = np.ones(len(code), bool)
    new[1:] = (code[1:] != code[:-1]) | (number[1:] != number[:-1])
    start = np.flatnonzero(new)
    own = number[start]
    first = np.flatnonzero(np.diff(code[start], prepend=-1))  # of each token, among pairs of token and document
    cut = np.append(first, len(start)).astype(np.int32)
    at = np.append(start, len(code)).astype(np.int32)[cut]
    listed = lambda values, ends: pa.ListArray.from_arrays(pa.array(ends), values)
    counts = np.diff(start, append=len(code)).astype(np.int32)
    columns = [words.dictionary.take(pa.array(code[start[first]])), pa.array([field] * len(first), pa.string()), pa.array(np.diff(cut)), pa.array(np.diff(at))]
    columns += [listed(ids.take(pa.array(own)), cut), listed(pa.array(lengths[own]), cut), listed(pa.array(counts), cut)]
    columns += [listed(pa.array((start - np.repeat(at[:-1], np.diff(cut))).astype(np.int32)), cut), listed(pa.array(place), at)]
    return pa.RecordBatch.from_arrays(columns, ["token", "field", "documents", "tokens", "ids", "lengths", "counts", "starts", "places"])


def write_index(docs: DataFrame, path: str, fields: Sequence[str] = ("text",), id_col: str = "id", buckets: int = 16, rows_in_file: int = 5_000_000, most_tokens: int = MOST_TOKENS) -> None:
    """Stores postings in folders by token, and the fields' totals, at a path, in place of what is there.

    Each task writes what its own documents hold, without a shuffle. It gathers documents of most_tokens tokens, or one that
    is longer, and makes a row of each token in them: (bucket, token, field, documents, tokens, ids, lengths, counts, starts, places).
    """
    kind = docs.schema[id_col].dataType
    name = "string" if kind.simpleString() == "string" else "bigint"
    docs = docs.where(F.col(id_col).isNotNull())
    spark = docs.sparkSession

    def run(batches):
        def rows():
            t = pa.Table.from_batches(held).combine_chunks()
            for i, f in enumerate(fields):
                out = _blocks(*(t.column(c).combine_chunks() for c in (0, 1 + i)), f)
                for s in range(0, out.num_rows, 1000):
                    yield out.slice(s, 1000)

        held, size = [], 0
        for b in batches:
            n = sum(pc.list_value_length(b.column(1 + i)).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(len(fields)))
            start = 0
            while start < len(n):
                stop = min(len(n), start + 1 + int(np.searchsorted(np.cumsum(n[start:]), most_tokens - size)))
                held.append(b.slice(start, stop - start))
                size += int(n[start:stop].sum())
                start = stop
                if size >= most_tokens:
                    yield from rows()
                    held, size = [], 0
        if held:
            yield from rows()

    tokenised = index(docs, fields, id_col).select(F.col("id").cast(name), *[f"tokens_{f}" for f in fields])
    schema = f"token string, field string, documents int, tokens int, ids array<{name}>, lengths array<int>, counts array<int>, starts array<int>, places array<int>"
    found = tokenised.mapInArrow(run, schema).withColumn("bucket", F.pmod(F.xxhash64("token"), F.lit(buckets)).cast("int"))
    found.sortWithinPartitions("bucket", "token").write.mode("overwrite").option("maxRecordsPerFile", rows_in_file).partitionBy("bucket").parquet(f"{path}/postings")
    sizes = {r["field"]: r["n"] for r in spark.read.schema(schema).parquet(f"{path}/postings").groupBy("field").agg(F.sum("tokens").alias("n")).collect()}
    n = docs.count()
    spark.createDataFrame([(f, n, sizes.get(f, 0), buckets) for f in fields], "field string, documents long, tokens long, buckets int").coalesce(1).write.mode("overwrite").parquet(f"{path}/totals")


def search_stored(spark: SparkSession, path: str, query: str, k: int, fields: Sequence[str] = ("text",)) -> DataFrame:
    """As search(), by a stored index: the rows of the query's words are read, and gathered by document."""
    root = parse(query)
    leaves = _leaves(root, [])
    words = sorted({w for x in leaves for w in x})
    totals = {r["field"]: r for r in spark.read.parquet(f"{path}/totals").where(F.col("field").isin(*fields)).collect()}
    if missing := sorted(set(fields) - set(totals)):
        raise ValueError(f"the index has no field {missing}")
    n = totals[fields[0]]["documents"]
    if not n or not any(totals[f]["tokens"] for f in fields):
        return spark.createDataFrame([], "id string, score double")
    p = spark.read.parquet(f"{path}/postings")
    if not leaves or k <= 0:
        return spark.createDataFrame([], f"id {p.schema['ids'].dataType.elementType.simpleString()}, score double")
    buckets = sorted({bucket_of(w, totals[fields[0]]["buckets"]) for w in words})
    p = p.where(F.col("bucket").isin(*buckets) & F.col("token").isin(*words) & F.col("field").isin(*fields))
    df = {(fields.index(r["field"]), r["token"]): r["n"] for r in p.groupBy("field", "token").agg(F.sum("documents").alias("n")).collect()}  # of the query's words
    spelled = {w for x in leaves if len(x) > 1 for w in x}  # only their places are read
    parts = {"id": "ids[i]", "length": "lengths[i]", "count": "counts[i]"} | ({"places": f"CASE WHEN token IN ({', '.join(repr(w) for w in sorted(spelled))}) THEN slice(places, starts[i] + 1, counts[i]) END"} if spelled else {})
    p = p.select("field", "token", F.explode(F.expr(f"transform(sequence(0, documents - 1), i -> struct({', '.join(f'{e} AS {c}' for c, e in parts.items())}))")).alias("x")).select("field", "token", "x.*")
    own = lambda f, w, c: F.when((F.col("field") == f) & (F.col("token") == w), F.col(c))
    aggs = [F.coalesce(F.max(F.when(F.col("field") == f, F.col("length"))), F.lit(0)).cast("double").alias(f"dl{i}") for i, f in enumerate(fields)]
    aggs += [F.coalesce(F.max(own(f, w, "count")), F.lit(0)).alias(f"n{i}_{m}") for i, f in enumerate(fields) for m, w in enumerate(words)]
    aggs += [F.coalesce(F.first(own(f, w, "places"), ignorenulls=True), F.array().cast("array<int>")).alias(f"p{i}_{m}") for i, f in enumerate(fields) for m, w in enumerate(words) if w in spelled]

    def count(i: int, leaf: tuple[str, ...]) -> Column:
        if len(leaf) == 1:
            return F.col(f"n{i}_{words.index(leaf[0])}")
        places = [F.col(f"p{i}_{words.index(w)}") for w in leaf]

        def follows(x: Column) -> Column:
            out = F.lit(True)
            for step, c in enumerate(places[1:], 1):
                out = out & F.array_contains(c, x + step)
            return out

        return F.size(F.filter(places[0], follows))

    tf = p.groupBy("id").agg(*aggs).select("id", *[f"dl{i}" for i in range(len(fields))], *[count(i, w).alias(f"tf{i}_{m}") for i in range(len(fields)) for m, w in enumerate(leaves)])
    return _rank(tf, root, leaves, n, [totals[f]["tokens"] / n for f in fields], df, k)


def num_docs(spark: SparkSession, path: str) -> int:
    """Documents of a stored index."""
    r = spark.read.parquet(f"{path}/totals").first()
    return r["documents"] if r else 0


def search(docs: DataFrame, query: str, k: int, fields: Sequence[str] = ("text",), id_col: str = "id") -> DataFrame:
    return search_index(index(docs, fields, id_col), query, k, fields)
