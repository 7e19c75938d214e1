"""Operators 11 to 13 against brute force, a dense solver, held-out labels and SQL."""

import math
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import classifier, search, whitening

DATA = "/root/testdata/sf0.01"


def test_contexts_are_window_sums(monkeypatch):
    r = random.Random(1)
    texts = [" ".join(r.choice(["a", "b!", "!!", "Cc.", "é|"]) for _ in range(r.randrange(12))) for _ in range(40)] + ["x" * 3_000_000 + " y"]
    b, bounds = classifier.pieces([t.encode() for t in texts])
    assert np.diff(bounds).tolist() == [len(re.findall(r"[^\W_]+|[^\w\s]+", t)) for t in texts]
    monkeypatch.setattr(classifier, "SLICE", 7)
    sums, counts = np.zeros((classifier.BUCKETS + 1, classifier.DIMS), np.int64), np.zeros(classifier.BUCKETS + 1, np.int64)
    classifier.contexts(b, bounds, sums, counts)
    want, index = np.zeros_like(sums), classifier.index_vectors()
    for begin, end in zip(bounds[:-1], bounds[1:], strict=True):
        for i in range(begin, end):
            for j in range(max(begin, i - classifier.WINDOW), min(end, i + classifier.WINDOW + 1)):
                want[b[i]] += index[b[j]] * (i != j)
    assert (sums[:-1] == want[:-1]).all() and counts.sum() == len(b)


def test_pooled_reads_whole_texts(monkeypatch):
    vectors = np.random.RandomState(3).randn(classifier.BUCKETS, classifier.DIMS).astype(np.float32)
    texts = [b"", b"one", b"a b c d e f g h " * 9, b"a a a a a"]
    monkeypatch.setattr(classifier, "SHORT", 5)
    got = classifier.pooled(texts, vectors)
    for text, row in zip(texts, got, strict=True):
        v = vectors[classifier.pieces([text])[0]].astype(float)
        if not len(v):
            assert not row.any()
            continue
        steps = np.sqrt((np.diff(v, axis=0) ** 2).sum(axis=0) / max(len(v) - 1, 1))
        assert np.allclose(row, np.hstack([v.mean(axis=0), v.std(axis=0), steps / (v.std(axis=0) + 0.05)]), atol=2e-3)


def test_network_is_calibrated():
    r = np.random.RandomState(5)
    x = r.randn(4000, classifier.INPUTS)
    p = 1 / (1 + np.exp(-(x[:, 0] * 1.5 + x[:, 1] * x[:, 2])))
    y = (r.rand(4000) < p).astype(float)
    net = classifier.fit(x[:3000], y[:3000])
    q = net.probability(x[3000:])
    assert np.mean((q - y[3000:]) ** 2) < np.mean((y.mean() - y[3000:]) ** 2) * 0.85 and abs(q.mean() - y[3000:].mean()) < 0.05
    assert np.allclose(classifier.fit(x[:4], y[:4]).probability(x[:1]), (y[:4].sum() + 1) / 6)  # too few: the smoothed share


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")
def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    vectors = classifier.word_vectors(classifier.context_sums(docs))
    rows = classifier.classify(docs, vectors, classifier.train(docs, labels, vectors))
    assert rows.count() == docs.count()
    got = rows.filter("held_out").join(labels, "doc_id").select("score", "predicted", "quality").toPandas()
    good, bad = got.score[got.quality == 1].to_numpy(), got.score[got.quality == 0].to_numpy()
    assert np.mean(good[:, None] > bad) > 0.97 and (got.predicted == got.quality).mean() > 0.93


def test_classifier_cases(spark, docs):
    rows, labels = docs(), spark.createDataFrame([(3, 1, "x"), (5, 0, "x"), (5, 1, "x"), (6, None, "x"), (None, 1, "x"), (11, 0, "x")], "doc_id long, quality int, text string")
    assert sorted(tuple(r) for r in classifier.sample(labels).collect() if r.doc_id not in (3, 11)) == ([(5, 1)] if not spark.range(1).select(classifier.held_out(F.lit(5))).first()[0] else [])
    vectors = classifier.word_vectors(classifier.context_sums(rows))
    for known in (labels, labels.limit(0)):
        got = classifier.classify(rows, vectors, classifier.train(rows, known, vectors)).collect()
        assert len(got) == rows.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
        assert len({r.score for r in got if r.doc_id in (0, 1, 2)}) == 1 and [r.held_out for r in got if r.doc_id is None] == [True]
        assert len({r.score for r in got if r.doc_id == 11}) == 1
    none = rows.limit(0)
    vectors = classifier.word_vectors(classifier.context_sums(none))
    assert classifier.classify(none, vectors, classifier.train(none, labels, vectors)).count() == 0
    # several labels of one document count once, and no more than the bound are drawn
    many = spark.range(5000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))
    n = classifier.sample(many, 1000).count()
    assert 500 < n <= 1000 and classifier.sample(many.unionByName(many)).count() == classifier.sample(many).count()


def dense(x):
    u = np.unique(x, axis=0)
    n, s = len(u), u.sum(axis=0)
    a = u - s / n
    values, vectors = np.linalg.eigh(a.T @ a / n)
    return n, s, values[::-1], vectors[:, ::-1], a


def test_whitening_equals_a_dense_solver(spark):
    r = np.random.RandomState(2)
    data = (r.randn(300, 12) @ np.diag(np.linspace(3, 0.2, 12))).round(3)
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(data)] + [(7, [float(v) for v in data[0]])] * 40 + [(None, [float(v) for v in data[1]])]
    rows += [(900, None), (901, []), (902, [1.0]), (903, [None] * 12), (904, [float("nan")] * 12), (905, [math.inf] + [0.0] * 11), (906, [1e300] + [0.0] * 11)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("clash") for c in ("x", "n", "k", "data", "component")})
    got = whitening.whitened(df.repartition(5)).toPandas()
    x = np.floor(256 * data).astype(int)
    n, s, values, vectors, a = dense(x)
    assert len(got) == 4 * 341 and set(got.n) == {n} and got.identity_error.max() < 1e-12 and got.vec_id.isna().sum() == 4
    for c in range(4):
        own = got[(got.component == c + 1) & got.vec_id.notna()].drop_duplicates("vec_id").set_index("vec_id").loc[range(300)]
        want = (x - s / n) @ vectors[:, c] / np.sqrt(values[c])
        sign = np.sign(want @ own.whitened)
        keep = np.arange(300) != 7  # 7 stands for two vectors
        assert np.abs(own.whitened * sign - want)[keep].max() < 1e-9 and abs(own.explained.iloc[0] / (values[c] / values.sum()) - 1) < 1e-12
        assert (own.deviation == ((n * x - s) ** 2).sum(axis=1))[keep].all()


def test_whitening_of_little_rank(spark):
    """Equal eigenvalues, fewer of them than components, one vector, none."""
    run = lambda rows: whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    corners = [(2 * i + (s < 0), [s * 1.0 * (i == j) for j in range(6)]) for i in range(6) for s in (1, -1)]
    got = run(corners).toPandas()
    assert len(got) == 48 and np.allclose(got.explained, 1 / 6) and got.identity_error.max() < 1e-12
    line = run([(i, [float(i), 2.0 * i, 0.0]) for i in range(9)]).toPandas()
    assert len(line) == 9 and set(line.component) == {1} and np.allclose(line.explained, 1) and np.allclose(sorted(abs(line.whitened)), sorted(abs(np.arange(9) - 4) / math.sqrt(20 / 3)))
    assert run([(1, [1.0, 2.0]), (2, [1.0, 2.0])]).count() == 0 and run([]).count() == 0 and run([]).columns == got.columns.tolist()
    far = run([(1, [2.0**44, 0.0]), (2, [0.0, 1.0]), (3, [5.0, 5.0])]).toPandas()
    assert far[far.vec_id == 1].deviation.isna().all() and far[far.vec_id == 2].deviation.isna().all()


def ranked(docs, queries, k=50):
    """Brute force: item_id, rank, doc_id, score."""
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    found = [(i, words(t)) for i, t in docs]
    n_all, total = sum(1 for _, w in found if w), sum(len(w) for _, w in found)
    df = {}
    for _, w in found:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    out = []
    for item, text in queries:
        own = {t: math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[t] + 1))) for t in set(words(text)) if t in df}
        scores = []
        for doc_id, w in found:
            m = 50 + 50 * len(w) * n_all // total if w else 0
            s = sum(v * (10**9 * w.count(t) // (1000 * w.count(t) + 20 * m)) for t, v in own.items() if t in w)
            scores += [(-s, doc_id is None, doc_id or 0, doc_id)] if s > 0 else []
        out += [(item, rank, x[3], -x[0]) for rank, x in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("shard_bytes", [1, 3000, 1 << 20])
def test_search_equals_brute_force(spark, shard_bytes):
    r = random.Random(shard_bytes)
    common, rare = ["alpha", "Beta", "GAMMA", "delta9", "é中"], [f"w{i}" for i in range(300)]
    docs = [(i if i % 17 else None, ", ".join(r.choice(common) if r.random() < 0.7 else r.choice(rare) for _ in range(r.randrange(1, 60)))) for i in range(500)]
    docs += [(600, None), (601, "  --"), (602, docs[3][1]), (603, docs[3][1]), (604, "alpha " * 4000), (605, docs[3][1])]
    queries = [(1, "alpha beta GAMMA"), (2, "w1 w2 w3 W3 alpha"), (2, "w1 w2 w3 W3 alpha"), (3, None), (4, "?!"), (5, "nothere"), (None, "é中 w7"), (6, " ".join(rare) + " beta"), (7, docs[3][1])]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3).withColumns({c: F.lit("clash") for c in ("place", "rank", "ids", "terms", "item_id")})
    q = spark.createDataFrame(queries, "item_id long, text string").withColumn("doc_id", F.lit(1))
    for k, block in ((50, 1 << 20), (3, 40)):
        got = search.search(d, q, k, block, shard_bytes)
        assert sorted((tuple(x) for x in got.collect()), key=repr) == ranked(docs, queries, k)
    assert search.search(d.limit(0), q).count() == 0 and search.search(d, q.limit(0)).columns == ["item_id", "rank", "doc_id", "score"]


def test_search_skips_documents():
    """With a rare term's accumulators the long list alone brings no candidates."""
    long, short = (np.arange(100_000, dtype=np.int32), np.full(100_000, 5, np.int64)), (np.arange(0, 100_000, 500, dtype=np.int32), np.full(200, 900, np.int64))
    best, plain = search.Best(50), search.Best(50)
    ids = np.arange(100_000, dtype=np.int64)[::-1].copy()
    assert search.search_shard([long, short], 100_000, ids, best) <= 200
    plain.add(np.where(np.arange(100_000) % 500 == 0, 905, 5), ids)
    assert (best.scores == plain.scores).all() and (best.ids == plain.ids).all()
