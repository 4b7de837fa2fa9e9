import numpy as np
import pytest

from tracewell.llm import ann


def brute(rows, every, k):
    out = {}
    good = {i: np.array(v, np.float32).astype(np.float64) for i, v in rows if i is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    for q, a in good.items():
        if q % every == 0:
            near = sorted((-(a @ b) / (np.sqrt(a @ a) * np.sqrt(b @ b)), i) for i, b in good.items() if i != q and len(b) == len(a))
            out[q] = near[:k]
    return out


def recall(got, want):
    hit = total = 0
    for q, near in want.items():
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [m[0] for m in mine] == list(range(1, len(near) + 1))
        total += len(near)
        hit += len({m[1] for m in mine} & {i for _, i in near})
    return hit / max(1, total)


@pytest.mark.parametrize("shard_rows", [ann.SHARD_ROWS, 400])
def test_recall_against_brute_force(spark, monkeypatch, shard_rows):
    monkeypatch.setattr(ann, "SHARD_ROWS", shard_rows)
    if shard_rows == 400:
        monkeypatch.setattr(ann, "SEEN_BYTES", 2000)
        monkeypatch.setattr(ann, "BLOCK_ROWS", 8)
    rng = np.random.default_rng(4)
    centers = rng.standard_normal((10, 24))
    rows = [(i, (centers[i % 10] + 0.7 * rng.standard_normal(24)).tolist()) for i in range(1500)]
    rows += [(2000 + i, rows[0][1]) for i in range(300)]
    rows += [(3000, None), (3050, [0.0] * 24), (3100, [float("nan")] * 24), (3150, [None] * 24), (3200, []), (None, rows[1][1]), (3250, [1.0, 2.0]), (3300, [2.0, 1.0]), (3301, [2.0, 1.0])]
    frame = spark.createDataFrame([(i, v, 1.0) for i, v in [*rows, rows[5]]], "vec_id long, embedding array<float>, score double").repartition(5)
    got = ann.nearest(frame, every=50).collect()
    want = brute(rows, 50, 5)
    assert {r.query_id for r in got} == {q for q, near in want.items() if near}
    assert recall(got, want) >= 0.95
    for q in (0, 2050, 3300):
        mine = sorted((r.rank, r.vec_id) for r in got if r.query_id == q)
        assert [i for _, i in mine] == [i for _, i in want[q]]
    for r in got:
        score = {i: -s for s, i in brute([x for x in rows if x[0] in (r.query_id, r.vec_id)], 50, 5)[r.query_id]}
        assert abs(score[r.vec_id] - r.score) < 1e-12


def test_few_rows(spark):
    frame = spark.createDataFrame([(50, [1.0, 0.0]), (51, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in ann.nearest(frame).collect()] == [(50, 1, 51, 0.0)]
    assert ann.nearest(frame.where("false")).collect() == []


def test_recall_over_several_shards_of_hard_vectors(spark, monkeypatch):
    monkeypatch.setattr(ann, "SHARD_ROWS", 4000)
    rng = np.random.default_rng(9)
    x = rng.standard_normal((12_000, 32)).astype(np.float32)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(4)
    got = ann.nearest(frame, every=50).collect()
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1)[:, None]
    near = unit[::50] @ unit.T
    near[np.arange(240), np.arange(0, 12_000, 50)] = -2
    want = {50 * i: set(np.argsort(-row)[:5].tolist()) for i, row in enumerate(near)}
    assert sum(r.vec_id in want[r.query_id] for r in got) / 1200 >= 0.95 and len(got) == 1200
