import random

import pytest

from tracewell.llm import common, line_dedup


def brute(rows, min_words):
    """rows: (doc_id, text) in order; gives the cleaned texts."""
    symbols, starts, ends = [], [], []
    for k, (_, text) in enumerate(rows):
        lines = text.split("\n") if text else []
        starts.append(len(symbols))
        symbols += lines
        ends += [starts[-1] + len(lines)] * len(lines)
    gone = set()
    for i in range(len(symbols)):
        best = 0
        for e in range(i):
            n = 0
            while i + n < ends[i] and e + n < ends[e] and symbols[i + n] == symbols[e + n]:
                n += 1
            best = max(best, n)
        if best and sum(len(x.split()) for x in symbols[i : i + best]) >= min_words:
            gone |= set(range(i, i + best))
    out = []
    for k, (_, text) in enumerate(rows):
        n = len(text.split("\n")) if text else 0
        mine = range(starts[k], starts[k] + n)
        out.append((n, sum(p in gone for p in mine), "\n".join(symbols[p] for p in mine if p not in gone) if any(p in gone for p in mine) else text))
    return out


@pytest.mark.parametrize("parts", [1, 7])
def test_against_brute_force(spark, parts, monkeypatch):
    if parts == 7:  # very common lines, pairs and texts
        monkeypatch.setattr(common, "HOT_ROWS", 2)
        monkeypatch.setattr(common, "HOT_KEYS", 10**9)
    rng = random.Random(parts)
    vocabulary = ["a b c", "a", "", "long line of words here", "x y", "common line one two"]
    docs = []
    for i in range(60):
        if docs and rng.random() < 0.4:
            other = rng.choice(docs)[1].split("\n")
            k = rng.randrange(len(other))
            lines = [*rng.choices(vocabulary, k=rng.randint(0, 3)), *other[k : k + rng.randint(1, 9)], *rng.choices(vocabulary, k=rng.randint(0, 3))]
        else:
            lines = [rng.choice(vocabulary) if rng.random() < 0.5 else f"unique {rng.random()}" for _ in range(rng.randint(1, 12))]
        docs.append((i, "\n".join(lines)))
    docs += [(100, None), (101, ""), (102, docs[5][1]), (103, "\n"), (104, "\n\n")]
    frame = spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, text string, n_lines int").repartition(3)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    coalesce = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = line_dedup.dedup_lines(frame).orderBy("doc_id").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
    assert [(r.n_lines, r.n_removed, r.text) for r in got] == brute(docs, line_dedup.MIN_WORDS)


def test_repeated_rows_nulls_and_empty(spark):
    text = "one two three four five\nsix"
    frame = spark.createDataFrame([(1, text), (1, text), (None, text)], "doc_id long, text string")
    got = line_dedup.dedup_lines(frame).collect()
    assert [(r.doc_id, r.n_removed) for r in got if r.n_removed == 0] == [(None, 0)]
    assert sorted(r.text for r in got) == ["", "", text]
    assert line_dedup.dedup_lines(frame.where("false")).collect() == []


def test_very_long_texts(spark):
    run = "\n".join(f"a line of the run {i}" for i in range(20_000))
    texts = [run, "own line\n" + run + "\nlast one of its own", "w " * 200_000, "start\n" + "w " * 200_000, "same old line again here\n" * 30_000]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in line_dedup.dedup_lines(frame).collect()}
    assert [got[d].n_removed for d in range(5)] == [0, 20_000, 0, 1, 29_999]
    assert got[1].text == "own line\nlast one of its own" and got[3].text == "start" and got[0].text == run
    assert got[4].text == "same old line again here\n"
