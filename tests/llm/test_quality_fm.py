import itertools
import zlib

import numpy as np

from tracewell.llm import quality_fm as q


def test_sum_of_squares_identity():
    rng = np.random.default_rng(0)
    fm = q.FactorisationMachine(0.3, rng.standard_normal(q.N_FEATURES), rng.standard_normal((q.N_FEATURES, 4)))
    rows = [(rng.choice(1000, k, replace=False), rng.standard_normal(k)) for k in (1, 5, 9)]
    for (i, x), got in zip(rows, fm.raw(rows), strict=True):
        pairs = sum(fm.v[a] @ fm.v[b] * x[m] * x[n] for (m, a), (n, b) in itertools.combinations(enumerate(i), 2))
        assert abs(got - (0.3 + fm.w[i] @ x + pairs)) < 1e-8


def test_learns_and_keeps_odd_rows(spark):
    rng = np.random.default_rng(1)
    good = [" ".join("".join(rng.choice(list("abcdefg"), 5)) for _ in range(40)) for _ in range(150)]
    bad = ["!!! ".join("".join(rng.choice(list("ABCDEFG"), 5)) for _ in range(40)) for _ in range(150)]
    rows = [(i, t) for i, t in enumerate(x for p in zip(good, bad, strict=True) for x in p)]
    odd = [(500, None), (501, ""), (501, ""), (None, "x"), (502, "word " * 30000)]
    docs = spark.createDataFrame([(d, t, 0.5) for d, t in rows + odd], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(300)] + [(500, None, 1), (None, 1, 0), (777, 1, 0)], "doc_id long, quality int, toxic int")
    got = q.quality(docs, labels).collect()
    assert len(got) == len(rows) + len(odd)
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    tested = [r for r in got if r.held_out and r.doc_id < 300]
    assert np.mean([r.predicted == 1 - r.doc_id % 2 for r in tested]) > 0.95


def test_no_labels_and_empty(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert [(r.score, r.predicted) for r in q.quality(docs, labels).collect()] == [(0.5, 1)]
    assert q.quality(docs.where("false"), labels).collect() == []


def test_whole_score_by_a_naive_loop():
    texts = [" ".join(f"w{(7 * i + j * j) % 31}" for j in range(5 + i % 9)) + ("!!!" if i % 2 else ".") for i in range(60)]
    fm = q.train([q.features(t) for t in texts], [i % 2 for i in range(60)], epochs=2)
    for text in [*texts[:5], "", "never seen w3 w4!"]:
        indices, values = q.features(text)
        z = float(fm.w0)
        for a, x in zip(indices, values, strict=True):
            z += float(fm.w[a]) * float(x)
        for (a, x), (b, y) in itertools.combinations(zip(indices, values, strict=True), 2):
            z += sum(float(s) * float(t) for s, t in zip(fm.v[a], fm.v[b], strict=True)) * float(x) * float(y)
        assert abs(fm.score([(indices, values)])[0] - 1 / (1 + np.exp(-z))) < 1e-5


def test_driver_rows_are_bounded_when_ids_repeat(spark, monkeypatch):
    docs = spark.createDataFrame([(i % 2, f"text {i}", 1) for i in range(200)] + [(i, "t", 1) for i in range(2, 20)], "doc_id long, text string, h int")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)] * 3, "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(q, "train", lambda rows, labels: seen.append(labels) or q.FactorisationMachine())
    q.fit(docs, labels, train_rows=4)
    assert sorted(seen[0]) == [0, 0, 1, 1]
