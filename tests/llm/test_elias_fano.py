import numpy as np
import pytest

from tracewell.llm.elias_fano import ABSENT, EliasFano, Level, Trie


@pytest.mark.parametrize("n,top", [(0, 1), (1, 1), (1, 1 << 63), (5, 3), (1000, 700), (3000, 1 << 60), (3000, 1 << 20)])
def test_sequence(n, top):
    rng = np.random.default_rng(n)
    values = np.sort(rng.integers(0, top, n, dtype=np.uint64))
    s = EliasFano.build(values)
    s = EliasFano.load(s.arrays("x"), "x")
    assert (s.access(np.arange(n)) == values).all()
    x = np.concatenate([values, values + np.uint64(1), rng.integers(0, top + 2, 500, dtype=np.uint64), [0, (1 << 64) - 1]]).astype(np.uint64)
    at, equal = s.successor(x)
    assert (at == np.searchsorted(values, x)).all()
    assert (equal == np.isin(x, values)).all()
    if n == 3000 and top == 1 << 20:
        assert s.nbytes() < n * 2.2


def test_levels_and_trie():
    rng = np.random.default_rng(1)
    contexts = np.unique(rng.integers(0, 1 << 64, 300, dtype=np.uint64))
    grown = lambda n, top: np.unique(rng.integers(0, top, int(n)))
    words = [grown(k, 1 << 32) for k in rng.integers(0, 20, len(contexts))]
    befores = [grown(k, 1 << 32) for k in rng.integers(0, 6, len(contexts))]
    triples = [[grown(rng.integers(0, 5), len(w)) if len(w) else np.zeros(0, np.int64) for _ in b] for w, b in zip(words, befores, strict=True)]
    flat = [t for ts in triples for t in ts]
    levels = {"words": Level.build([len(w) for w in words], np.concatenate(words)), "befores": Level.build([len(b) for b in befores], np.concatenate(befores)), "triples": Level.build([len(t) for t in flat], np.concatenate(flat))}
    plain = {"totals": rng.integers(0, 1000, len(contexts)), "p2": rng.integers(0, 255, sum(map(len, words))).astype(np.uint8), "rest": rng.integers(0, 255, sum(map(len, befores))).astype(np.uint8), "p3": rng.integers(0, 255, sum(map(len, flat))).astype(np.uint8)}
    trie = Trie.load(Trie(EliasFano.build(contexts), levels, plain).arrays())
    truth = {}
    k2 = k1 = k3 = 0
    for c, w, b, ts in zip(contexts.tolist(), words, befores, triples, strict=True):
        for x in w.tolist():
            truth[c, x] = plain["p2"][k2]
            k2 += 1
        for x, t in zip(b.tolist(), ts, strict=True):
            truth[c, x, None] = plain["rest"][k1]
            k1 += 1
            for place in t.tolist():
                truth[c, x, int(w[place])] = plain["p3"][k3]
                k3 += 1
    asked = np.concatenate([contexts[::2], rng.integers(0, 1 << 64, 40, dtype=np.uint64)])
    mine = dict(zip(contexts.tolist(), zip(words, befores, strict=True), strict=True))
    ws, bs, n_places, places = [], [], [], []
    for c in asked.tolist():
        w, b = mine.get(c, ((), ()))
        offset = sum(map(len, ws))
        ws.append(np.array([*list(w)[::2], 5, 7], np.int64))
        bs.append(np.array([*list(b), 9], np.int64))
        for _ in bs[-1]:
            some = rng.permutation(len(ws[-1]))[:3]
            n_places.append(len(some))
            places += (some + offset).tolist()
    counts, p2, rest, p3 = trie.find(asked, np.array([len(w) for w in ws]), np.concatenate(ws), np.array([len(b) for b in bs]), np.concatenate(bs), np.array(n_places), np.array(places))
    totals = dict(zip(contexts.tolist(), plain["totals"].tolist(), strict=True))
    assert counts.tolist() == [totals.get(c, 0) for c in asked.tolist()]
    assert p2.tolist() == [truth.get((c, x), ABSENT) for c, w in zip(asked.tolist(), ws, strict=True) for x in w.tolist()]
    assert rest.tolist() == [truth.get((c, x, None), ABSENT) for c, b in zip(asked.tolist(), bs, strict=True) for x in b.tolist()]
    all_words = np.concatenate(ws).tolist()
    keys = [(c, x) for c, b in zip(asked.tolist(), bs, strict=True) for x in b.tolist()]
    want = [truth.get((*k, all_words[i]), ABSENT) for k, i in zip([k for k, n in zip(keys, n_places, strict=True) for _ in range(n)], places, strict=True)]
    assert p3.tolist() == want and len(set(want)) > 20
