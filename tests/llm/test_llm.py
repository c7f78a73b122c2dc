"""The ten text operators and the pipeline against brute force, round trips and held-out rows; edge cases of each."""

import random
import re

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from korvex.llm import common as C
from korvex.llm import decontaminate, fingerprints, jaccard_join, license_scan, pieces, quality, queries, repeats, secret_scan, substring_dedup, suffix_dedup, token_counts
from tests.conftest import SF

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, at int, h long"


def make(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), "x", 1, 2) for i, t in zip(ids, texts)], SCHEMA)


def sf_texts():
    return {i: t for i, t in duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()}


ODD = [None, "", " \n\t ", "word", "a b", "é" * 50, "中文 字符 🙂 ▁ \x00 \x1c x", "the same text here", "the same text here", "long " * 60_000]


@pytest.fixture(scope="module")
def odd(spark):
    return make(spark, [*ODD, "row without an id", "repeated id", "repeated id"], [*range(len(ODD)), None, 50, 50]).cache()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, name):
    d = duckdb.connect()
    d.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    mine, theirs = queries.queries()[name](spark, SF).toPandas(), d.sql(queries.oracle_sql()[name]).df()
    c = sorted(mine.columns)
    assert c == sorted(theirs.columns) and sorted(mine[c].values.tolist()) == sorted(theirs[c].values.tolist())


def test_every_operator_has_a_query():
    assert {n.split("_")[0] for n in queries.queries()} == {f"op{n}" for n in range(1, 11)}


ONE_EACH = {
    "tokens": token_counts.count_tokens, "licences": license_scan.scan, "secrets": secret_scan.scan, "pieces": pieces.encode_documents, "prints": fingerprints.fingerprint,
    "pairs": jaccard_join.join_similar, "classes": jaccard_join.similar_classes, "spans": substring_dedup.duplicate_spans, "spans2": suffix_dedup.duplicate_spans, "kept": jaccard_join.keep_one, "redacted": secret_scan.redact,
}


@pytest.mark.parametrize("name", ONE_EACH)
def test_empty_tables(odd, name):
    assert ONE_EACH[name](odd.limit(0)).count() == 0


def test_empty_tables_of_the_others(spark, odd):
    b, y = spark.createDataFrame([], "item_id long, text string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert decontaminate.contaminated(odd, b).count() == 0 and decontaminate.keep_clean(odd, b).count() == odd.count()
    assert decontaminate.contaminated(odd.limit(0), spark.createDataFrame([(1, "a b c d")], b.schema)).count() == 0
    m = quality.fit(odd, y)
    assert quality.keep_good(odd, m).count() == odd.count() and quality.score(odd.limit(0), m).count() == 0


# 1


@pytest.mark.parametrize("text", ["", "it's  we're   'llama's\n\n  x", "don''t 12345 ½² ٣٤ naïve", "  \t\n a", "日本語テキスト 🙂🙂 é", "x" * 300, "'re 've'll \x1c\x1d y", "==== ---- !!!???  "])
def test_prefix_counts_are_exact(text):
    c = token_counts.counter()
    d = np.concatenate([[0], np.cumsum(c.steps(text), dtype=int)])
    assert d.tolist() == [len(c.encoding.encode_ordinary(text[:i])) for i in range(len(text) + 1)]
    assert token_counts.prefix_counts(token_counts.pack(c.steps(text))).tolist() == d.tolist()


def test_prefix_counts_of_the_table(spark):
    rows = token_counts.op1_token_counts(spark, SF).collect()
    texts, c = sf_texts(), token_counts.counter()
    r = random.Random(1)
    assert len(rows) == len(texts)
    for x in rows:
        t, n = texts[x["doc_id"]], token_counts.prefix_counts(x["prefix_deltas"])
        assert x["n_tokens"] == n[-1] == len(c.encoding.encode_ordinary(t)) and x["n_chars"] == len(t)
        for k in [r.randrange(len(t) + 1) for _ in range(3)]:
            assert n[k] == len(c.encoding.encode_ordinary(t[:k]))
        assert n[x["keep_512"]] <= 512 and (x["keep_512"] == len(t) or (n[x["keep_512"] + 1 :] > 512).all())


def test_token_counts_of_odd_rows(odd):
    rows = token_counts.count_tokens(odd).collect()
    assert len(rows) == odd.count() and [r["n_tokens"] for r in rows if r["doc_id"] in (0, 1)] == [0, 0]
    got = token_counts.tokens_of_prefix(token_counts.count_tokens(odd).where("doc_id = 7").withColumn("k", F.lit(8)), "k").first()
    assert got["prefix_tokens"] == len(token_counts.counter().encoding.encode_ordinary("the same"))


# 2


def jaccards(texts, n=3):
    s = {i: {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} for i, t in texts.items() if (w := (t or "").lower().split())}
    return {(a, b): len(s[a] & s[b]) / len(s[a] | s[b]) for a in s for b in s if a < b and s[a] & s[b]}


def test_chosen_bands():
    for t in (0.3, 0.5, 0.8, 1.0):
        b, r = jaccard_join.choose_bands(t, 0.99)
        assert 1 - (1 - t**r) ** b >= 0.99


def test_pairs_across_blocks(spark):
    r = random.Random(4)
    base = [str(r.randrange(500)) for _ in range(60)]
    texts = {}
    for i in range(90):
        w = list(base)
        for _ in range(1 + r.randrange(7)):
            w[r.randrange(60)] = f"n{r.randrange(9999)}"
        texts[i] = " ".join(w)
    want = {k for k, j in jaccards(texts).items() if j >= 0.5}
    got = {(x["doc_a"], x["doc_b"]) for x in jaccard_join.join_similar(make(spark, list(texts.values())), block=16).collect()}
    assert got <= want and len(got) >= 0.9 * len(want) and len(want) > 1000


def test_pairs_of_odd_rows(odd):
    got = {(r["doc_a"], r["doc_b"]) for r in jaccard_join.join_similar(odd).collect()}
    assert got == {(7, 8)}
    assert {tuple(r) for r in jaccard_join.similar_classes(odd).collect()} == {(7, 7, 1), (8, 7, 1)}
    kept = jaccard_join.keep_one(odd)
    assert kept.columns == odd.columns and sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == [*[(False, i) for i in range(10) if i != 8], (False, 50), (False, 50), (True, 0)]


@pytest.mark.parametrize("block", [jaccard_join.BLOCK, 4])
def test_classes_against_brute_force(spark, block):
    """Copies, near copies and chains of them; blocks that cut bands and groups."""
    r = random.Random(9)
    texts = {}
    for i in range(60):
        base = [f"{i % 12}w{k}" for k in range(30)]
        if i % 5:
            base[r.randrange(30)] = f"x{i}"
        texts[i] = " ".join(base)
    near = [k for k, j in jaccards(texts).items() if j >= 0.5]
    links = {i: {b if a == i else a for a, b in near if i in (a, b)} for i in texts}
    label = dict(zip(texts, texts))
    for _ in texts:
        label = {i: min([label[i], *(label[x] for x in links[i])]) for i in texts}
    want = {(i, label[i], len(x)) for i, x in links.items() if x}
    assert {tuple(x) for x in jaccard_join.similar_classes(make(spark, list(texts.values())), recall=0.9999, block=block).collect()} == want and len(want) > 50


# 3


def smith_waterman(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (1 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    return h.max()


def test_alignment_against_a_loop():
    r = np.random.default_rng(2)
    for _ in range(30):
        a, b = r.integers(1, 5, 12), r.integers(1, 5, 20)
        assert decontaminate.align(a[None], b[None])[0] == smith_waterman(a, b)


def test_contamination_against_full_alignment(spark):
    r = random.Random(8)
    word = lambda: f"w{r.randrange(3000)}"
    items = {i: [word() for _ in range(r.randrange(10, 40))] for i in range(12)}
    docs, want = [], set()
    for n in range(60):
        w = [word() for _ in range(r.randrange(0, 200))]
        if n % 3 == 0:
            x = list(items[n % 12])
            for _ in range(len(x) // 8):
                x[r.randrange(len(x))] = word()
            at = r.randrange(len(w) + 1)
            w[at:at] = x
        docs.append(" ".join(w))
    for n, t in enumerate(docs):
        want |= {(n, i) for i, x in items.items() if smith_waterman(x, t.split()) / len(x) >= 0.5}
    b = spark.createDataFrame([(i, " ".join(x)) for i, x in items.items()] + [(90, None), (91, ""), (None, "a b c")], "item_id long, text string")
    d = make(spark, docs)
    assert {(x["doc_id"], x["item_id"]) for x in decontaminate.contaminated(d, b).collect()} == want and len(want) >= 20
    kept = decontaminate.keep_clean(d, b)
    assert kept.columns == d.columns and {x["doc_id"] for x in kept.collect()} == set(range(60)) - {n for n, _ in want}


@pytest.mark.parametrize("threshold", [0.5, 0.3, 0.9])
def test_contamination_of_heavily_edited_copies(spark, threshold):
    """Copies that leave few or no trigrams, each the only version of its item, one of them many times."""
    items = {i: [f"i{i}w{k}" for k in range(size)] for i, size in enumerate([40, 40, 20, 38, 59, 40, 40, 3, 11, 40])}
    x = lambda i, every: [f"x{i}{k}" if k % every == every - 1 else w for k, w in enumerate(items[i])]
    put_in = lambda ws, every: [y for k, w in enumerate(ws) for y in ([w, f"y{k}"] if k % every == every - 1 else [w])]
    edited = [x(0, 5), x(1, 4), x(2, 5), x(3, 5), x(4, 5), put_in(items[5], 2), items[6][:20], items[7][:2], put_in(items[8], 3), x(9, 40)]
    docs = [["before"] * 40 + w + ["after"] * 40 for w in [*edited, *[edited[0]] * 30]]
    score = lambda i, w: smith_waterman(items[i], w) / len(items[i])
    want = {(n, i): s for n, w in enumerate(docs) for i in items if (s := score(i, w)) >= threshold}
    d, b = make(spark, [" ".join(w) for w in docs]), spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]): r["score"] for r in decontaminate.contaminated(d, b, threshold).collect()} == pytest.approx(want)
    assert len(want) >= (39 if threshold < 0.9 else 1)


def test_contamination_of_odd_rows(spark):
    """Items of one and two words, found whole only; null ids, repeated rows and a very long text with a hit."""
    b = spark.createDataFrame([(1, "Zanzibar"), (2, "blue whale"), (3, "..."), (4, " ".join(f"w{k}" for k in range(30)))], "item_id long, text string")
    hit = " ".join(f"w{k}" for k in range(2, 30))
    d = make(spark, ["the blue car and a whale", "a blue, WHALE in zanzibar", hit, hit, "long " * 60_000 + hit, None, ""], [0, 1, None, None, 4, 5, 6])
    got = sorted((x["doc_id"] or -1, x["item_id"], round(x["score"], 6)) for x in decontaminate.contaminated(d, b).collect())
    assert got == [(-1, 4, round(28 / 30, 6))] * 2 + [(1, 1, 1.0), (1, 2, 1.0), (4, 4, round(28 / 30, 6))]
    assert sorted(x["doc_id"] for x in decontaminate.keep_clean(d, b).collect()) == [0, 5, 6]


# 4


def test_licences():
    m = license_scan.default_model()
    held = license_scan.training_rows(60, seed=99)
    assert sum(m.predict(p)[0] == f for p, f, _ in held) / len(held) > 0.93
    unknown = [p for p, f, _ in held if f == license_scan.UNKNOWN]
    assert sum(m.predict(p)[0] == license_scan.UNKNOWN for p in unknown) / len(unknown) > 0.97
    text = "Some words.\nReleased under the MIT License.\nlicence of the driver"
    n, a, b, family, p, s = license_scan.licences(text, m)[0]
    assert (n, text[a:b], family) == (1, "Released under the MIT License.", "MIT") and s == 1.0 and license_scan.licences(None, m) == []


def test_licences_of_templates_that_training_has_not_seen():
    """By a model without a third of the wordings of each family and of the unknown ones."""
    rows = license_scan.training_rows()
    m = license_scan.fit([r for r in rows if r[2] % 3], folds=2)
    held = [r for r in rows if r[2] % 3 == 0]
    known = [m.predict(p)[0] for p, f, _ in held if f != license_scan.UNKNOWN]
    right = np.mean([m.predict(p)[0] == f for p, f, _ in held if f != license_scan.UNKNOWN])
    false = np.mean([m.predict(p)[0] != license_scan.UNKNOWN for p, f, _ in held if f == license_scan.UNKNOWN])
    print("held-out templates", right, np.mean([k != license_scan.UNKNOWN for k in known]), false)
    assert right > 0.7 and false < 0.02


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies"""


def test_wrapped_licences(spark):
    """A wrapped paragraph is one row; so are repeated rows, each, and rows without an id."""
    text = f"A tale of two cities.\n\n{MIT}\n\nThe end."
    assert [[text[a:b] for a, b in p] for p in license_scan.paragraphs(text)] == [["A tale of two cities."], MIT.split("\n"), ["The end."]]
    d = make(spark, [text, text, text, None, ""], [1, 1, None, 2, 3])
    rows = [(r["doc_id"] or 0, r["paragraph"], text[r["start"] : r["end"]], r["family"], r["confirmed"]) for r in license_scan.scan(d).collect()]
    assert sorted(rows) == [(0, 1, MIT, "MIT", True), (1, 1, MIT, "MIT", True), (1, 1, MIT, "MIT", True)]
    mixed = "this long line goes on and on without an end so it is taken for wrapped\n" * 12 + "Released under the MIT License."
    assert {("Released under the MIT License." in mixed[a:b], f) for _, a, b, f, _, _ in license_scan.licences(mixed, license_scan.default_model())} == {(True, "MIT")}


def test_licences_against_brute_force(spark):
    """Every paragraph scored by all its n-grams, without the look-up of words that have a weight."""
    m, want = license_scan.default_model(), []

    def score(part):
        t = license_scan._TOKEN.findall(part.lower())
        g = {w for w in t if w not in license_scan._STOP} | {f"{a} {b}" for a, b in zip(t, t[1:]) if not {a, b} <= license_scan._STOP}
        z = (m.bias + sum((m.weights[x] for x in sorted(g) if x in m.weights), np.zeros(len(m.bias)))) / m.temperature
        q = np.exp(z) / np.exp(z).sum()
        k = int(q.argmax())
        return (m.families[k], round(float(q[k]), 6)) if q[k] >= m.cut and m.families[k] != license_scan.UNKNOWN else None

    for i, text in sf_texts().items():
        for n, lines in enumerate(license_scan.paragraphs(text)):
            whole = (lines[0][0], lines[-1][1])
            for a, b in [whole] if score(text[slice(*whole)]) else lines:
                if x := score(text[a:b]):
                    want.append((i, n, a, b, *x))
    got = [(r["doc_id"], r["paragraph"], r["start"], r["end"], r["family"], round(r["probability"], 6)) for r in license_scan.op4_license_scans(spark, SF).collect()]
    assert sorted(got) == sorted(want) and len(got) > 3


def test_licences_of_odd_rows(odd):
    assert license_scan.scan(odd).count() == 0


# 5 and 8


def brute_spans(texts, words):
    ws = {i: (t or "").split() for i, t in texts.items()}
    first = {}
    for i in sorted(ws):
        for p in range(len(ws[i]) - words + 1):
            first.setdefault(tuple(ws[i][p : p + words]), (i, p))
    out = set()
    for i, w in ws.items():
        hit = [p for p in range(len(w) - words + 1) if first[tuple(w[p : p + words])] < (i, p)]
        while hit:
            end, k = hit[0] + words, 0
            while k + 1 < len(hit) and hit[k + 1] <= end:
                k += 1
                end = hit[k] + words
            out.add((i, hit[0], end, first[tuple(w[hit[0] : hit[0] + words])][0]))
            hit = hit[k + 1 :]
    return out


def repeating_texts():
    r = random.Random(6)
    passage = [[str(r.randrange(50)) for _ in range(r.randrange(10, 40))] for _ in range(6)]
    texts = {}
    for i in range(50):
        w = []
        for _ in range(r.randrange(5)):
            w += [str(r.randrange(50)) for _ in range(r.randrange(15))] + passage[r.randrange(6)]
        texts[i] = " ".join(w)
    texts[50] = texts[49] = texts[3]
    texts[51] = "a b c " * 20  # its own repeats only
    texts[52] = " ".join([*passage[0][:9], "x", *passage[1], "y", *passage[1]])
    return texts


@pytest.mark.parametrize("most", [repeats.MOST_IN_PART, 3])
@pytest.mark.parametrize("op", [substring_dedup, suffix_dedup])
def test_spans_against_brute_force(spark, op, most):
    texts = repeating_texts()
    d = make(spark, list(texts.values()))
    found = repeats.spans(d, op.decide, 12, 4, most)
    got = {tuple(x) for x in found.collect()}
    assert got == brute_spans(texts, 12) and len(got) > 30 and (51, 3, 60, 51) in got
    cut = {x["doc_id"]: x["text"] for x in repeats.remove(d, found).collect()}
    for i, t in texts.items():
        gone = {p for j, a, b, _ in got if j == i for p in range(a, b)}
        assert cut[i].split() == [w for p, w in enumerate(t.split()) if p not in gone]


@pytest.mark.parametrize("op", [substring_dedup, suffix_dedup])
def test_the_operator_decides_the_spans(spark, op):
    """Candidates hold stretches that don't repeat: taking all of them for copies gives another result."""
    d = make(spark, list(repeating_texts().values()))
    everything = lambda groups, words: [[np.zeros(len(r) - words + 1, np.int64) for r in g.runs] for g in groups]
    words = lambda decide: sum(x["end_word"] - x["start_word"] for x in repeats.spans(d, decide, 12, 4).collect())
    assert words(everything) > 1.2 * words(op.decide)


def test_decisions_agree():
    """Small alphabets, so that runs hold their own and each other's stretches, in whole and in split groups."""
    r = np.random.default_rng(5)
    for n in range(60):
        runs = [r.integers(0, 3, r.integers(6, 60)).astype(np.uint32) for _ in range(8)]
        runs[5] = runs[2]
        g = [repeats.Group(0, 0, parts, [0, 0, 1, 2, 3, 4, 5, 6], list(range(8)), runs) for parts in (1, 2)]
        a, b = substring_dedup.decide(g, 6), suffix_dedup.decide(g, 6)
        assert all(x.tolist() == y.tolist() for p, q in zip(a, b) for x, y in zip(p, q))
        first = {}
        for k, x in enumerate(runs):
            for p in range(len(x) - 5):
                assert a[0][k][p] == first.get(tuple(x[p : p + 6]), -1)
                first.setdefault(tuple(x[p : p + 6]), k)


@pytest.mark.parametrize("op", [substring_dedup, suffix_dedup])
def test_spans_of_odd_rows(spark, op):
    long = " ".join(map(str, range(80)))
    d = make(spark, [None, "", long, long, "a " + long, long, long], [0, 1, 2, 3, 4, None, 2])
    assert {tuple(x) for x in op.duplicate_spans(d).collect()} == {(3, 0, 80, 2), (4, 1, 81, 2)}


# 6


def test_secrets():
    m = secret_scan.default_model()
    held = secret_scan.labelled_samples(1500, seed=1234)
    found = lambda y: np.mean([bool(secret_scan.spans(s, m)) for s, k in held if k == y])
    assert found(1) > 0.9 and found(0) < 0.01
    key = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"
    assert [(a, b) for a, b, _ in secret_scan.spans(f'token = "{key}"!', m)] == [(9, 49)]
    assert secret_scan.fit([("abc", 1), (None, 0)]).cut == float("inf")


def best_stretch(x):
    """(first, end, sum) by all pairs, the shortest and leftmost of the largest."""
    return max(((a, b, float(x[a:b].sum())) for a in range(len(x)) for b in range(a + 1, len(x) + 1)), key=lambda y: (round(y[2], 9), y[0] - y[1], -y[0]))


def test_best_stretches_against_all_pairs():
    m, r = secret_scan.default_model(), random.Random(2)
    for _ in range(40):
        s = "".join(r.choice(["ab", "the", "Xq9", "-", "/", "7f", "Z", "word"]) for _ in range(14))
        a, b, total = m.best(m.steps(s))
        assert total == pytest.approx(best_stretch(m.steps(s))[2]) and total == pytest.approx(float(m.steps(s)[a:b].sum()))


def test_short_secrets_and_keys_in_runs(spark):
    """Random strings of 8 characters and more; keys behind identifiers and in paths; ordinary texts."""
    docs, labels = C.table(spark, SF, "documents"), C.table(spark, SF, "labels")
    m, r = secret_scan.fit_on(docs, labels), random.Random(3)
    abc = secret_scan.ALPHABET[:62]
    rate = {n: np.mean([bool(secret_scan.spans("".join(r.choice(abc) for _ in range(n)), m)) for _ in range(300)]) for n in (8, 10, 12, 15, 16)}
    assert rate[8] > 0.5 and rate[10] > 0.8 and rate[12] > 0.9 and rate[15] > 0.97 and rate[16] > 0.97
    key = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"
    for s in (f"https/www/example/user/profile/{key}", f"connection_manager_password_{key}", f"{key}/documentation/and/more/of/the/text"):
        assert [s[a:b] for a, b, _ in secret_scan.spans(s, m)] == [key]
    two = f"{key}/ordinary/identifier/between/{key[::-1]}"
    assert [two[a:b] for a, b, _ in secret_scan.spans(two, m)] == [key, key[::-1]]


def test_secrets_of_the_table_against_brute_force(spark):
    """The best stretch of every run by all pairs, on the table's texts with keys put in; and the query on the table."""
    docs, labels, r = C.table(spark, SF, "documents"), C.table(spark, SF, "labels"), random.Random(4)
    m, want, got = secret_scan.fit_on(docs, labels), {}, {}
    key = lambda n: "".join(r.choice(secret_scan.ALPHABET[:62]) for _ in range(n))
    texts = {i: (t or "")[:1500] + (f" {key(10 + i % 30)} word/{key(12)}-and-more" if i % 4 == 0 else "") for i, t in list(sf_texts().items())[:120]}
    runs = {i: [x.span() for x in re.finditer(secret_scan.RUN, t)] for i, t in texts.items()}
    for i, t in texts.items():
        for a, b in runs[i]:
            if (s := best_stretch(m.steps(t[a:b]))[2]) > m.cut:
                want[i, a] = round(s, 6)
    for x in secret_scan.scan(make(spark, list(texts.values()), list(texts)), m).collect():
        at = next((x["doc_id"], a) for a, b in runs[x["doc_id"]] if a <= x["start"] < x["end"] <= b)
        got[at] = max(got.get(at, 0), round(x["score"], 6))
        assert texts[x["doc_id"]][x["start"] : x["end"]] == x["secret"]
    assert got == want and len(got) > 30
    table = [(x["doc_id"], x["start"], x["end"]) for x in secret_scan.op6_secret_scans(spark, SF).collect()]
    assert sorted(table) == sorted((i, a, b) for i, t in sf_texts().items() for a, b, _ in secret_scan.spans(t, m))


def test_secrets_of_odd_rows(spark, odd):
    key = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"
    d = make(spark, [key, key, key, None, "", "long " * 60_000 + key], [1, 1, None, 2, 3, 4])
    assert sorted((r["doc_id"] or 0, r["start"], r["secret"]) for r in secret_scan.scan(d).collect()) == [(0, 0, key), (1, 0, key), (1, 0, key), (4, 300_000, key)]
    assert secret_scan.scan(odd).count() == 0


def test_redaction(spark, odd):
    key = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"
    d = make(spark, [f"a {key} b {key}", None, "plain"])
    out = {r["doc_id"]: r for r in secret_scan.redact(d).collect()}
    assert out[0]["text"] == "a [SECRET] b [SECRET]" and out[0]["n_chars"] == 21 and out[1]["text"] is None and out[2]["n_chars"] == 5
    assert secret_scan.redact(odd).count() == odd.count() and secret_scan.redact(odd).columns == odd.columns


# 7


def test_pieces_without_dropout_are_the_library_s():
    p, sp = pieces.load(), sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    for t in [*list(sf_texts().values())[:60], "naïve 日本語 🙂 x", "a  b   c", "w" * 100]:
        assert pieces.encode_ids(t, p, dropout=0.0).tolist() == sp.encode(t)


@pytest.mark.parametrize("text", [t for t in ODD if t])
def test_pieces_round_trip(text):
    p = pieces.load()
    one = [pieces.encode_ids(text, p, 3, seed, 0.3).tolist() for seed in (1, 1, 2)]
    assert one[0] == one[1] and all(pieces.decode_ids(x, p) == text for x in one)


def test_batched_merges_are_those_of_single_words():
    p, t = pieces.load(), pieces.skip_table(5, 1, 0.2)
    words = sorted({w for x in list(sf_texts().values())[:40] for w in pieces._CUT.findall(" " + x)})
    assert pieces.merge_batch(words, p, t) == [np.array(pieces.word_ids(w, p, t), p.code).tobytes() for w in words]


def test_pair_table_of_any_size():
    for n in (0, 1, 3, 50, 200_000):
        r = np.random.default_rng(n)
        pairs = {int(k): v for v, k in enumerate(r.integers(0, 1 << 42, n))}
        keys, ranks = pieces._pair_table(pairs)
        p = pieces.Pieces({}, {}, [], [], *[np.zeros(0, np.int64)] * 2, keys, ranks)
        ask = np.concatenate([np.fromiter(pairs, np.int64, len(pairs)), r.integers(0, 1 << 42, 1000)])
        assert pieces.pair_ranks(p, ask >> 21, ask & pieces._PAD).tolist() == [pairs.get(k, pieces._NEVER) for k in ask.tolist()]


def test_dropout_of_each_occurrence():
    p = pieces.load()
    text = " ".join(["internationalisation"] * 3000)
    got = pieces.encode_ids(text, p, 7, 1, 0.2)
    assert (got == pieces.encode_ids(text, p, 7, 1, 0.2)).all() and len(got) != len(pieces.encode_ids(text, p, 8, 1, 0.2))
    words = pieces._CUT.findall(" " + text)
    keys = pieces.occurrence_keys(7, len(words), 1)
    one = pieces.merge_batch(words[:1], p, b"", np.zeros(len(words), np.int64), keys, int(0.2 * 2**32))
    assert b"".join(one) == got.tobytes() and len(set(one)) > 100 and len(set(one[:64])) > 10
    skips = [pieces.Occurrence(int(k), int(0.2 * 2**32)).skips(i, i + 1, i + 2) for k in keys for i in range(10)]
    assert 0.19 < np.mean(skips) < 0.21


def test_batched_merges_of_occurrences():
    p, limit = pieces.load(), int(0.2 * 2**32)
    words = sorted({w for x in [*list(sf_texts().values())[:20], *ODD] if x for w in pieces._CUT.findall(" " + x)})
    of = np.tile(np.arange(len(words)), 2)
    keys = pieces.occurrence_keys(None, len(of), 4)
    want = [np.array(pieces.word_ids(words[x], p, pieces.Occurrence(int(k), limit)), p.code).tobytes() for x, k in zip(of, keys)]
    assert pieces.merge_batch(words, p, b"", of, keys, limit) == want


def test_pieces_of_tables(spark, odd):
    rows = pieces.op7_sentencepiece(spark, SF).collect()
    assert len(rows) == len(sf_texts()) and all(r["lossless"] for r in rows)
    e = pieces.encode_documents(odd)
    assert e.where("not lossless").count() == 0
    back = {r["doc_id"]: r["text"] for r in pieces.decode_documents(e).collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(ODD))


# 9


def labelled(spark):
    r = random.Random(3)
    good, bad = "the river runs past old stone houses and quiet gardens where people talk".split(), "BUY!!! cheap pills click $$$ now FREE winner casino bonus 0000 xx".split()
    texts = [" ".join(r.choice(good if i % 2 else bad) for _ in range(120)) for i in range(300)]
    return make(spark, texts), spark.createDataFrame([(i, i % 2, 0) for i in range(200)] + [(5, 0, 0), (None, 1, 0), (7, None, None)], "doc_id long, quality int, toxic int")


def test_quality_of_held_out_rows(spark, odd):
    d, y = labelled(spark)
    m = quality.fit(d, y)
    rows = [r for r in quality.score(d, m).collect() if r["doc_id"] >= 200]
    assert np.mean([r["keep"] == (r["doc_id"] % 2 == 1) for r in rows]) > 0.95
    kept = quality.keep_good(odd, m)
    assert kept.columns == odd.columns and {0, 1} <= {r["doc_id"] for r in kept.collect()}
    assert quality.score(odd, m).count() == odd.count()


def test_quality_against_single_blocks(spark):
    """Every score of the table, packed block by block with dictionaries made anew; null ids and repeated rows."""
    import zstandard

    docs = C.table(spark, SF, "documents")
    m = quality.fit(docs, C.table(spark, SF, "labels"))

    def packed(block, raw):
        return len(zstandard.ZstdCompressor(level=m.level, dict_data=zstandard.ZstdCompressionDict(raw), write_checksum=False, write_content_size=False, write_dict_id=False).compress(block))

    def p(text):
        b = text.encode()
        blocks = [b[k : k + quality.BLOCK] for k in range(0, len(b), quality.BLOCK)]
        g, w = (sum(packed(x, raw) for x in blocks) for raw in (m.good, m.bad))
        return 1 / (1 + np.exp(-(m.slope * (w - g) / max(w, g) + m.bias)))

    texts = {i: t for i, t in sf_texts().items() if t and len(t) < 3000}
    got = {r["doc_id"]: r for r in quality.op9_quality_classifier(spark, SF).collect()}
    assert len(got) == len(sf_texts()) and len(texts) > 100
    for i, t in list(texts.items())[:120]:
        assert got[i]["p_good"] == pytest.approx(p(t), abs=1e-9) and got[i]["keep"] == (got[i]["p_good"] >= m.cut)
    t = next(iter(texts.values()))
    rows = sorted((r["doc_id"] or 0, round(r["p_good"], 9), r["keep"]) for r in quality.score(make(spark, [t, t, t, None, ""], [1, 1, None, 2, 3]), m).collect())
    same = (round(p(t), 9), p(t) >= m.cut)
    assert rows[:3] == [(0, *same), (1, *same), (1, *same)] and [r[2] for r in rows[3:]] == [True, True] and rows[3][1] == rows[4][1]


# 10


def test_fingerprints_estimate_jaccard():
    r = random.Random(2)
    for share in (0.0, 0.3, 0.8, 1.0):
        got = []
        for _ in range(20):
            a = [r.random() for _ in range(400)]
            b = [x if r.random() < share else r.random() for x in a]
            sets = [np.unique(C.ngram_hashes(C.word_hashes(list(map(str, x))), 1)) for x in (a, b)]
            p = fingerprints.pack(fingerprints.signatures(sets))
            want = len(np.intersect1d(*sets)) / len(np.union1d(*sets))
            got.append(fingerprints.estimate(*p) - want)
        assert abs(np.mean(got)) < 0.04 and np.std(got) < 0.08


def test_densification_fills_every_bin_alike():
    s = [np.array([5, 2**63 + 7], np.uint64), np.array([], np.uint64), np.array([5, 2**63 + 7], np.uint64)]
    out = fingerprints.signatures(s, 64)
    assert (out[0] == out[2]).all() and (out[0] != fingerprints._EMPTY).all() and (out[1] == fingerprints._EMPTY).all()


def test_fingerprints_of_odd_rows(odd):
    rows = {r["doc_id"]: r for r in fingerprints.fingerprint(odd).collect()}
    assert rows[0]["fingerprint"] is None and rows[2]["n_grams"] == 0 and rows[7]["fingerprint"] == rows[8]["fingerprint"] and len(rows[7]["fingerprint"]) == 128


def test_fingerprints_against_brute_force(spark):
    """Bins, densification and packing of the table's documents, one hash at a time."""
    bins, bits, mask = fingerprints.BINS, fingerprints.BITS, (1 << 64) - 1

    def mix(x):
        x ^= x >> 31
        x = x * int(C.M2) & mask
        return x ^ (x >> 29)

    def one(text):
        least = {}
        for h in C.gram_set(text, fingerprints.NGRAM).tolist():
            least[h >> 56] = min(least.get(h >> 56, mask), h & ((1 << 56) - 1))
        if not least:
            return None
        out = []
        for b in range(bins):
            at, attempt = b, 0
            while at not in least:
                attempt += 1
                at = mix(mix((b * int(C.M1) + attempt) & mask)) >> 56
            out.append(format(least[at] & (2**bits - 1), f"0{bits}b")[::-1])
        whole = "".join(out)
        return len(least), bytes(int(whole[k : k + 8], 2) for k in range(0, len(whole), 8))

    got = {r["doc_id"]: r for r in fingerprints.op10_document_fingerprints(spark, SF).collect()}
    texts = sf_texts()
    assert set(got) == set(texts)
    for i, t in texts.items():
        want = one(t)
        assert (got[i]["filled_bins"], bytes(got[i]["fingerprint"])) == want if want else got[i]["fingerprint"] is None


def test_compared_fingerprints(spark):
    a = " ".join(map(str, range(300)))
    d = make(spark, [a, a, a.replace("17 ", "x "), " ".join(map(str, range(900, 1200))), None], [1, None, 3, 4, 5])
    p = fingerprints.fingerprint(d)
    rows = p.select(F.col("doc_id").alias("a"), F.col("fingerprint").alias("x")).crossJoin(p.select(F.col("doc_id").alias("b"), F.col("fingerprint").alias("y")))
    got = {(r["a"], r["b"]): r["similarity"] for r in fingerprints.compare(rows, "x", "y").collect()}
    assert got[1, None] == 1.0 and got[1, 3] > 0.85 and got[1, 4] < 0.15 and got[1, 5] is None and got[5, 5] is None


# pipeline


def groups(pairs):
    up = {}

    def root(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for a, b in sorted(pairs):
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return {x for x in up if root(x) != x}


def test_pipeline_against_brute_force(spark):
    texts = sf_texts()
    docs = C.table(spark, SF, "documents")
    m = quality.fit(docs, C.table(spark, SF, "labels"))
    good, bad = m.packers()
    p = lambda t: 1 / (1 + np.exp(-np.clip(m.slope * quality.raw_score(t, good, bad) + m.bias, -30, 30)))
    left = {i: t for i, t in texts.items() if p(t) >= m.cut}
    late = groups({k for k, j in jaccards(left).items() if j >= 0.5})
    left = {i: t for i, t in left.items() if i not in late}
    items = [decontaminate.tokens(t) for (t,) in duckdb.sql(f"SELECT text FROM '{SF}/benchmark.parquet'").fetchall()]

    def leaked(t):
        w = decontaminate.tokens(t)
        grams = {tuple(w[k : k + 3]) for k in range(len(w) - 2)}
        return any(smith_waterman(x, w) / len(x) >= 0.5 for x in items if sum(tuple(x[k : k + 3]) in grams for k in range(len(x) - 2)) >= 1 and set(x) & set(w))

    left = {i: t for i, t in left.items() if not leaked(t)}
    secret = secret_scan.fit_on(docs.where(F.col("doc_id").isin(list(left))), C.table(spark, SF, "labels"))
    want = {}
    for i, t in left.items():
        for a, b, _ in reversed(secret_scan.spans(t, secret)):
            t = t[:a] + "[SECRET]" + t[b:]
        want[i] = t
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(got) == set(want)
    model = pieces.load()
    assert all(pieces.decode_ids(got[i]["piece_ids"], model) == t and got[i]["lossless"] and got[i]["n_chars"] == len(t) for i, t in want.items())


def test_pipeline_stages_pass_all_columns_and_odd_rows(spark, odd, tmp_path):
    docs = odd
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == odd.columns
    assert {0, 1, 2, 7, 50} <= {r["doc_id"] for r in docs.collect()} and docs.where("doc_id = 8").count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()
    assert all(f(spark, odd.limit(0), SF).count() == 0 for _, f in corpus_pipeline.STAGES)


def test_words_of_a_whole_batch_are_not_held(spark, monkeypatch):
    ix = decontaminate.index_of([(1, "alpha beta gamma delta epsilon")], 2)
    own = [decontaminate.Finder(ix, np.ones(len(ix.place_item), bool))]
    texts = [None, "", *["word " * 80_000] * 24, "x alpha beta gamma delta epsilon y", None, "alpha beta"]
    scores, held = decontaminate._scores, []
    monkeypatch.setattr(decontaminate, "_scores", lambda own, part: held.append(sum(len(t or "") for t in part)) or scores(own, part))
    assert np.flatnonzero(decontaminate._hit(own, 0.5).func(pd.Series(texts, dtype=object))).tolist() == [26]
    assert max(held) < 4_500_000 and sum(held) == sum(len(t or "") for t in texts)


def test_cut_batches():
    b = pa.RecordBatch.from_pydict({"id": list(range(7)), "text": ["é" * 3, None, "", "ab", "c" * 9, "d", "🙂"]})
    got = [(p.column(0).to_pylist(), t) for p, t in C.cut_batches(iter([b, b.slice(0, 0)]), 1, 5)]
    assert got == [([0, 1, 2, 3], ["ééé", None, "", "ab"]), ([4], ["c" * 9]), ([5, 6], ["d", "🙂"])] == list(C.batches(iter([b]), 5))


def test_connected_groups(spark):
    e = spark.createDataFrame([(n, n + 1) for n in range(40)] + [(100, 101), (7, 7), (None, 3)], "a long, b long")
    got = {r["node"]: r["label"] for r in C.connected_groups(e, "a", "b").collect()}
    assert got == {**{n: 0 for n in range(41)}, 100: 100, 101: 100}
