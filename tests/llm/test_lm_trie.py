import collections
import math
import random
import re
import zlib

import pytest

from tracewell.llm import lm_trie

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    return [*WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")), None]


def held(d):
    return d is not None and zlib.crc32(str(d).encode()) % 7 == 2


def grams(texts, n):
    return collections.Counter(tuple(padded[i : i + n]) for t in texts for padded in [["<s>"] * (n - 1) + t] for i in range(len(t)))


def brute(train, docs, order=3):
    """By (id, text): held_out, n_tokens, n_known, N, base score, score of the model of that order."""
    train = [tokens(t) for _, t in train]
    c = {n: grams(train, n) for n in (1, 2, 3)}
    before = {n: collections.Counter() for n in (2, 3)}
    for n in (2, 3):
        for g, k in c[n].items():
            before[n][g[:-1]] += k
    total, types = sum(c[1].values()), len(c[1])
    out = {}
    for d, text in docs:
        t = tokens(text)
        base, score = 0.0, 0.0
        for u, v, w in zip(["<s>", "<s>", *t][: len(t)], ["<s>", *t][: len(t)], t, strict=True):
            p = (c[1][w,] + 1) / (total + types + 1)
            base += math.log10(p)
            for n, share, mu in ((2, lm_trie.SHARE2, lm_trie.MU2), (3, lm_trie.SHARE3, lm_trie.MU3))[: order - 1]:
                k = before[n][(u, v)[3 - n :]]
                p = ((1 - share) * c[n][(u, v, w)[3 - n :]] + (mu + share * k) * p) / (k + mu)
            score += math.log10(p)
        out[d, text] = (held(d), len(t), sum(c[1][w,] > 0 for w in t), total, base, score)
    return out


def make():
    rng = random.Random(2)
    vocabulary = ["the", "The", "of", "é", "a.", *(f"w{i}" for i in range(80))]
    docs = [(i, " ".join(rng.choices(vocabulary, [30, 10, 20, 5, 5] + [1] * 80, k=rng.randint(0, 80)))) for i in range(90)]
    docs += [(200, None), (201, ""), (202, " \t"), (203, "unseen words only zzz"), (204, "the"), (None, "the of"), (5, docs[5][1]), (5, "the of the of w1")]
    return docs, rng


def compare(got, want, n):
    assert len(got) == n
    for r, key in got:
        w = want[key]
        assert tuple(r)[1:5] == w[:4]
        assert abs(r.base_score - w[4]) < 1e-9 * max(1, abs(w[4]))
        assert abs(r.score - w[5]) < 0.01 * abs(w[5]) + 0.005 * w[1] + 0.02  # 8-bit codes


def keyed(got, docs):
    """Rows with their (id, text): rows of one id by their length."""
    texts = collections.defaultdict(dict)
    for d, t in docs:
        texts[d][len(tokens(t))] = t
    return [(r, (r.doc_id, texts[r.doc_id][r.n_tokens])) for r in got]


@pytest.mark.parametrize("small", [False, True])
def test_against_brute_force(spark, monkeypatch, small):
    if small:
        for name, value in (("BLOCK_TOKENS", 500), ("SHARD_TOKENS", 700), ("PART_TOKENS", 60), ("MOST_KEY", 0)):
            monkeypatch.setattr(lm_trie, name, value)
    docs, _ = make()
    frame = spark.createDataFrame([(d, t, 0) for d, t in docs], "doc_id long, text string, tokens int").repartition(3)
    got = keyed(lm_trie.score_texts(frame).collect(), docs)
    train = [(d, t) for d, t in docs if not held(d)]
    compare(got, brute(train, docs), len(docs))
    out = [(r, *(brute(train, docs, n)[k][5] for n in (1, 2, 3))) for r, k in got if r.held_out and r.n_known][:3]
    assert all(len({round(x, 6) for x in o[1:]}) == 3 for o in out)


def test_third_order_is_better_on_held_out_texts():
    rng = random.Random(3)
    follow = {(a, b): rng.sample(range(12), 2) for a in range(12) for b in range(12)}
    docs = []
    for i in range(150):
        words = [rng.randrange(12), rng.randrange(12)]
        while len(words) < 40:
            words.append(rng.choice(follow[tuple(words[-2:])]))
        docs.append((i, " ".join(f"w{x}" for x in words)))
    train, tested = [(d, t) for d, t in docs if not held(d)], [(d, t) for d, t in docs if held(d)]
    by_order = [sum(x[5] for x in brute(train, tested, n).values()) for n in (1, 2, 3)]
    assert by_order[0] < by_order[1] < by_order[2] * 1.2


@pytest.mark.parametrize("part", [50, 10**6])
def test_kept_tries_score_other_texts(spark, tmp_path, monkeypatch, part):
    monkeypatch.setattr(lm_trie, "PART_TOKENS", part)
    docs, rng = make()
    kept = f"file://{tmp_path}"
    lm_trie.score_texts(spark.createDataFrame(docs, "doc_id long, text string"), keep=kept).collect()
    others = [(2 + 7 * i, " ".join(rng.choices(["the", "of", "w1", "w2", "new"], k=rng.randint(0, 30)))) for i in range(20)]
    got = keyed(lm_trie.score_texts(spark.createDataFrame(others, "doc_id long, text string"), model=kept).collect(), others)
    compare(got, brute([(d, t) for d, t in docs if not held(d)], others), len(others))


def test_very_long_texts(spark, monkeypatch):
    monkeypatch.setattr(lm_trie, "BLOCK_TOKENS", 5000)
    rng = random.Random(1)
    docs = [(0, " ".join(rng.choices("abcdefgh", k=40_000))), (1, "x" * 300_000), (2, "a b"), (3, "a " * 20_000)]
    got = keyed(lm_trie.score_texts(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)).collect(), docs)
    compare(got, brute([x for x in docs if not held(x[0])], docs), 4)


def test_empty_and_untrained(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert lm_trie.score_texts(docs).collect() == []
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    (r,) = lm_trie.score_texts(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).collect()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (True, 3, 0, 0, 0.0, 0.0)
