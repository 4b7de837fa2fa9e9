import hashlib
import random
import re

import pytest

from tracewell.llm import decontam

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items, window=10):
    w, hit, ids, longest = words(text), set(), set(), (0, 0)
    for item_id, t in items:
        v = words(t)
        m = min(window, len(v))
        for o in range(len(v) - m + 1 if v else 0):
            for p in range(len(w) - m + 1):
                if w[p : p + m] == v[o : o + m]:
                    hit |= set(range(p, p + m))
                    ids |= {item_id} - {None}
                    n = m
                    while p + n < len(w) and o + n < len(v) and w[p + n] == v[o + n] and len(v) >= window:
                        n += 1
                    longest = max(longest, (n, -p))
    return len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest(), bool(hit), longest[0], -longest[1]


@pytest.mark.parametrize("block", [decontam.BLOCK_CHARS, 120])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(decontam, "BLOCK_CHARS", block)
    monkeypatch.setattr(decontam, "SHARD_WORDS", 300)
    rng = random.Random(3)
    vocabulary = ["the", "of", "Été", "a1", "x", "y"]
    item = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(11, 30)))) for i in range(12)]
    item += [(100, "rare Words"), (101, None), (102, "!!"), (None, "nullid word"), (7, item[3][1]), (200, item[4][1])]
    docs = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 60))), "s") for i in range(60)]
    docs += [(60 + i, f"Q {rng.choice(item)[1] or ''}, and; {rng.choice(item)[1] or ''}\nend RARE-wORDS", "s") for i in range(30)]
    docs += [(90, None, "s"), (91, "", "s"), (92, "nullid word", "s"), (1, docs[1][1], "s"), (None, item[0][1], "s")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, item_id string").repartition(3)
    bench = spark.createDataFrame(item, "item_id long, text string")
    got = decontam.contamination(frame, bench).collect()
    assert len(got) == len(docs)
    want = {}
    for doc_id, text, _ in docs:
        want[doc_id] = brute(text, item)
    for r in got:
        assert tuple(r)[1:] == want[r.doc_id]
    kept = decontam.remove_contaminated(frame, bench)
    assert kept.columns == frame.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, t, _ in docs if not want[d][4])


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert decontam.contamination(docs.where("false"), bench).collect() == []
    assert [r.n_hit for r in decontam.contamination(docs, bench.where("false")).collect()] == [0]
    assert decontam.remove_contaminated(docs, bench.where("false")).count() == 1


def test_very_long_texts_and_ids_that_are_no_numbers(spark, monkeypatch):
    monkeypatch.setattr(decontam, "SHARD_WORDS", 1000)
    rng = random.Random(5)
    passage = [f"p{i}" for i in range(40)]
    long = [rng.choice("abcdefgh") for _ in range(60_000)]
    long[30_000:30_040] = passage
    texts = [" ".join(long), None, " ".join(passage[:12]), "short", " ".join(passage[5:] * 500), ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").coalesce(1)
    items = [("b-1", " ".join(passage)), ("a/2", " ".join(passage[:10])), ("10", "nothing like it"), ("x" * 50, " ".join(["zz"] * 50_000))]
    got = {r.doc_id: r for r in decontam.contamination(docs, spark.createDataFrame(items, "item_id string, text string")).collect()}
    assert len(got) == len(texts)
    for d, t in enumerate(texts):
        assert (got[d].n_words, got[d].n_items, got[d].contaminated) == (len(words(t)), {0: 2, 2: 2, 4: 1}.get(d, 0), d in (0, 2, 4))
    assert (got[0].n_hit, got[0].longest, got[0].longest_at) == (40, 40, 30_000) and got[4].n_hit == 35 * 500
    assert got[0].items_sha256 == hashlib.sha256(b"a/2,b-1").hexdigest()
