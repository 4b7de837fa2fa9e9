import collections
import random
import re

from tracewell.llm import common, near_dup

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(docs, percent=85):
    """(n_shingles, component_id) of each (id, text) row."""
    sets = {(d, t): shingles(t) for d, t in docs if d is not None}
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(sets, key=lambda k: (k[0], str(k[1])))
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)), key=lambda k: (k[0], str(k[1])))
                root[y] = x
    return {k: (len(sets[k]), find(k)[0]) for k in sets}


def make(rng):
    word = lambda: "".join(rng.choices("abcdeé", k=4))
    docs = []
    for _ in range(25):
        docs.append((len(docs), " ".join(word() for _ in range(rng.randint(1, 120)))))
    for base in (docs[3][1], docs[7][1], " ".join(word() for _ in range(150))):
        for _ in range(20):
            w = base.split()
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(len(w))] = word()
            docs.append((len(docs), " ".join(w)))
    w = docs[-1][1].split()  # a chain: neighbours are linked, its ends are not
    for _ in range(15):
        w = [*w[3:], word(), word(), word()]
        docs.append((len(docs), " \t".join(w).upper()))
    passage = " ".join(word() for _ in range(40))  # shared, but not enough to link
    docs += [(len(docs) + i, passage + " " + " ".join(word() for _ in range(25))) for i in range(25)]
    docs += [(1000, None), (1001, ""), (1002, "  \n"), (1003, "one two"), (1004, "One  TWO"), (-5, docs[0][1])]
    return docs


def check(spark, docs):
    rows = [(d, t, "s", 1) for d, t in docs] + [(1003, "one two", "s", 1), (None, "one two", "s", 1), (None, None, "s", 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, component_id string, digest int").repartition(3)
    got = near_dup.near_duplicates(frame).collect()
    want = brute(docs)
    assert len(got) == len(rows)
    mine = collections.Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got if r.doc_id is not None)
    assert mine == collections.Counter((d, *want[d, t], d == want[d, t][1]) for d, t, *_ in rows if d is not None)
    assert all(r.component_id is None and r.kept and r.first for r in got if r.doc_id is None)
    firsts = collections.Counter(r.component_id for r in {(r.doc_id, r.mark): r for r in got if r.first and r.doc_id is not None and r.n_shingles}.values())
    assert firsts == dict.fromkeys({c for n, c in want.values() if n}, 1) or len(docs) != len({d for d, _ in docs})
    return got


def test_against_brute_force(spark):
    check(spark, make(random.Random(11)))


def test_ids_with_several_texts_are_linked_by_each(spark):
    docs = make(random.Random(12))
    docs += [(7, docs[20][1]), (7, docs[3][1] + " x"), (3, "words of its own that nothing else has at all"), (90, docs[40][1])]
    got = check(spark, docs)
    assert {r.component_id for r in got if r.doc_id == 3} == {3}
    assert sum(r.first for r in got if r.doc_id == 3) == 2


def test_hot_buckets_and_hubs(spark, monkeypatch):
    for name, value in (("HOT_ROWS", 3), ("HOT_KEYS", 10_000_000)):
        monkeypatch.setattr(common, name, value)
    monkeypatch.setattr(near_dup, "PAIRS_PER_PART", 4)
    monkeypatch.setattr(near_dup, "ROWS_PER_PART", 3)
    docs = make(random.Random(13))
    check(spark, docs + [(2000 + i, docs[3][1]) for i in range(200)] + [(1003, docs[3][1])])


def test_very_long_texts(spark):
    rng = random.Random(4)
    long = [str(rng.randrange(1000)) for _ in range(200_000)]
    docs = [(1, " ".join(long)), (2, " ".join([*long[:-30], "x"])), (3, " ".join(long[:150_000])), (4, "a " * 100_000)]
    got = near_dup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {1: 1, 2: 1, 3: 3, 4: 4} and {r.n_shingles for r in got if r.doc_id == 4} == {1}


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 200), (310, 300), (305, 310)]
    got = dict(near_dup.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)} | {300: 300, 305: 300, 310: 300}


def test_empty_table(spark):
    assert near_dup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def group(rng, n):
    """An origin, n copies that link with it and n that link with nothing, all of one length and in the same buckets."""
    words = [f"w{i}" for i in range(300)]

    def copy(edits):
        w = list(words)
        for at in rng.sample(range(0, 300, 6), edits):
            w[at] = f"e{rng.randrange(6)}-{at}"
        return " ".join(w)

    return [(0, " ".join(words))] + [(1 + i, copy(rng.randint(2, 4))) for i in range(n)] + [(1 + n + i, copy(rng.randint(6, 9))) for i in range(n)]


def test_rows_do_not_grow_with_the_square_of_a_group(spark, monkeypatch):
    made, keep = {}, near_dup.stored

    def counted(df, name):
        out = keep(df, name)
        made[name] = max(made.get(name, 0), out.count())
        return out

    monkeypatch.setattr(near_dup, "stored", counted)
    docs = group(random.Random(21), 60)
    got = near_dup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), percent=85).collect()
    want = brute(docs)
    assert {r.doc_id: r.component_id for r in got} == {d: want[d, t][1] for d, t in docs}
    assert len({r.component_id for r in got}) > 40  # most of those that link with nothing the origin reaches
    assert made["dup-open"] == len(docs)
    assert made.get("dup-rest", 0) < 2 * len(docs)  # of 60 * 60 that meet in buckets
