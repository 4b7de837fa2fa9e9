import numpy as np

from tracewell.llm.mixing import mix


def targets(sizes, weights=(3, 1, 2), budget=1.5, repeats=2):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, free, left = {}, set(names), budget * sum(sizes.values())
    while free:
        level = left / sum(w[s] for s in free)
        full = {s for s in free if level * w[s] > repeats * sizes[s]}
        if not full:
            return out | {s: level * w[s] for s in free}
        out |= {s: float(repeats * sizes[s]) for s in full}
        left -= sum(repeats * sizes[s] for s in full)
        free -= full
    return out


def test_targets_and_taken_words(spark):
    rng = np.random.default_rng(5)
    rows = [(i, "w " * int(rng.integers(1, 60)), [None, "b", "a", "é", "hot", "hot", "hot"][int(rng.integers(0, 7))], "x") for i in range(4000)]
    rows += [(4000, None, "b", "x"), (4001, "", "empty", "x"), (None, "a b", "hot", "x"), (5, rows[5][1], rows[5][2], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size string")
    got = mix(docs).collect()
    assert len(got) == len(rows)
    size, taken, want = {}, {}, {}
    for r in got:
        size[r.source] = size.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        want[r.source] = r.target
        assert r.taken in (0, r.size, 2 * r.size)
    expected = targets(size)
    for s in size:
        assert abs(want[s] - expected[s]) < 1e-6 * max(1, expected[s])
        assert abs(taken[s] - want[s]) <= 121
        assert all(r.source_size == size[s] for r in got if r.source == s)
    assert sum(taken.values()) <= 1.5 * sum(size.values())
    key = lambda rs: sorted((r.doc_id or -1, r.source or "", r.taken) for r in rs)
    assert key(got) == key(mix(docs.repartition(7)).collect())


def test_empty_and_wordless(spark):
    assert mix(spark.createDataFrame([], "doc_id long, text string, source string")).collect() == []
    got = mix(spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")).collect()
    assert [(r.size, r.taken, r.target) for r in got] == [(0, 0, 0.0)] * 2
