import time
import zlib

import numpy as np

from tracewell.llm import langid


def make(n, seed):
    rng = np.random.default_rng(seed)
    syllables = {"aa": ["ka", "ti", "mo"], "bb": ["über", "sch", "eit"], "cc": ["ción", "ñe", "lla"]}
    rows = []
    for i in range(n):
        lang = ["aa", "bb", "cc"][i % 3]
        rows.append((i, " ".join("".join(rng.choice(syllables[lang], 3)) for _ in range(int(rng.integers(2, 40)))), lang))
    return rows


def test_held_out_accuracy_and_odd_texts(spark):
    rows = make(400, 0)
    odd = [(900, None, "aa"), (901, "123 !!", "bb"), (902, "", None), (903, "kati moka", None), (None, "schüber eit", "bb"), (0, rows[0][1], "aa"), (904, "½ ² ① Ⅷ ٣ _", "aa"), (905, "\u0301\u20dd", "bb"), (906, "1²kati½moka", "aa"), (907, "katimo tika " * 20_000, "aa")]
    docs = spark.createDataFrame([(*r, "s") for r in rows + odd], "doc_id long, text string, lang string, score string")
    got = langid.languages(docs).collect()
    assert len(got) == len(rows) + len(odd)
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.lang_pred in {"aa", "bb", "cc", "und"}
        assert (r.lang_pred == "und") == (r.doc_id in (900, 901, 902, 904, 905))
    true = {i: x for i, _, x in rows}
    tested = [r for r in got if r.held_out and r.doc_id in true]
    assert np.mean([r.lang_pred == true[r.doc_id] for r in tested]) > 0.97
    assert np.mean([r.accepted for r in tested]) > 0.9
    assert {r.doc_id: r.lang_pred for r in got}[906] == {r.doc_id: r.lang_pred for r in got}[907] == "aa"


def test_whole_score_by_a_naive_loop():
    rows = make(60, 5)
    counts = [np.unique(np.array(langid.subwords(t), np.int32), return_counts=True) for _, t, _ in rows]
    m = langid.train(counts, [x for *_, x in rows])
    for _, text, _ in make(12, 6):
        total, n = [0.0] * langid.DIM, 0
        for word in text.lower().split():
            marked = f"<{word}>"
            grams = [marked, *(marked[i : i + k] for k in langid.NGRAMS for i in range(len(marked) - k + 1))]
            for g in grams:
                row = m.embeddings[zlib.crc32(g.encode()) % (1 << langid.BITS)]
                total = [a + float(b) for a, b in zip(total, row, strict=True)]
                n += 1
        z = [sum(t / n * float(w) for t, w in zip(total, m.weights[k], strict=True)) + float(m.bias[k]) for k in range(len(m.languages))]
        e = [np.exp((x - max(z)) / m.temperature) for x in z]
        best = max(range(len(z)), key=z.__getitem__)
        lang, score, _ = m.predict(text)
        assert lang == m.languages[best] and abs(score - e[best] / sum(e)) < 1e-4


def test_sample_is_bounded_and_repeats_count_once(spark, monkeypatch):
    rows = [(1, "kati moka", "aa")] * 500 + make(90, 3)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    seen = []
    monkeypatch.setattr(langid, "train", lambda rows, labels: seen.append(labels))
    langid.fit(docs, rows_per_language=10)
    assert {x: seen[0].count(x) for x in set(seen[0])} == {"aa": 10, "bb": 10, "cc": 10}


def test_word_sums_equal_the_average():
    rng = np.random.default_rng(2)
    m = langid.Model(["x", "y"], rng.standard_normal((1 << langid.BITS, langid.DIM)), rng.standard_normal((2, langid.DIM)), rng.standard_normal(2))
    text = "Hola, que TAL hola;ciudad 12 é"
    ids = langid.subwords(text)
    assert np.allclose(m.raw(text), m.embeddings[ids].mean(axis=0) @ m.weights.T + m.bias)


def test_new_words_cost_less_than_hashing_them_one_by_one():
    rng = np.random.default_rng(8)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyzäöüéñ"))
    text = " ".join("".join(rng.choice(letters, n)) for n in rng.integers(3, 12, 20_000).tolist())
    m = langid.Model(["x", "y"], rng.standard_normal((1 << langid.BITS, langid.DIM)), rng.standard_normal((2, langid.DIM)), np.zeros(2))
    m.predict("wärm up")
    spent = []
    for run in (m.predict, langid.subwords):
        at = time.process_time()
        run(text)
        spent.append(time.process_time() - at)
    assert spent[0] < spent[1] / 2


def test_hashes_of_many_texts_are_those_of_each(monkeypatch):
    odd = ["", None, "a", "Hola, que TAL hola;ciudad 12 é", "ΌΣΟΣ ΣΑΣ. Σ", "İSTANBUL ǅ ß", "e\u0301a ½x² _a_b_ Ⅷ", "漢字かな交じり文、テスト", "𐐀𐐁𐐂 𝒜𝓑 \U0001f600b\U00020000\U00020001c", "\ud800x\udfff", "<a> <<b>>c", "é" * 23 + " " + "é" * 24 + " " + "é" * 25 + "x " + "ab" * 300, "x" * 45 + " " + "x" * 46 + " " + "x" * 47, "\U0010ffff", "aé漢𐐀" * 9, "- 1 -", "ab\u00a0cd\u2028ef\x1cgh"]
    rng = np.random.default_rng(4)
    letters = list("aé漢𐐀ſΣ .1'")
    odd += ["".join(rng.choice(letters, n)) for n in rng.integers(0, 60, 200).tolist()]
    for block in (1, 7, 64, langid.BLOCK):
        monkeypatch.setattr(langid, "BLOCK", block)
        for texts in (odd, [odd[3]], [], [None], ["abc"]):
            got = [[] for _ in texts]
            for found, text, at in langid.hashes(texts):
                for k, part in zip(text.tolist(), np.split(found, at[1:]), strict=True):
                    got[k] += part[part != langid.NONE].tolist()
            assert [sorted(g) for g in got] == [sorted(langid.subwords(t or "")) for t in texts]


def test_a_long_word_sums_without_loss():
    rng = np.random.default_rng(9)
    e, w = rng.standard_normal((1 << langid.BITS, langid.DIM)).astype(np.float32), rng.standard_normal((2, langid.DIM)).astype(np.float32)
    text = "katié" * 60_000
    share = np.bincount(langid.subwords(text), minlength=1 << langid.BITS) / len(langid.subwords(text))
    assert np.allclose(langid.Model(["x", "y"], e, w, np.zeros(2)).raw(text), share @ (e.astype(float) @ w.T.astype(float)), rtol=0, atol=1e-9)


def test_more_languages_than_dimensions():
    rng = np.random.default_rng(6)
    n = langid.DIM + 3
    m = langid.Model([f"l{k:02d}" for k in range(n)], rng.standard_normal((1 << langid.BITS, langid.DIM)), rng.standard_normal((n, langid.DIM)), rng.standard_normal(n), 1.5, 0.4)
    texts = ["Hola, que TAL", None, "über ciudad 12 é", "--"]
    lang, score, accepted = m.predict_all(texts)
    for k, t in enumerate(texts):
        ids = langid.subwords(t or "")
        p = langid.softmax((m.embeddings[ids].mean(axis=0) @ m.weights.T + m.bias)[None] / 1.5)[0] if ids else None
        assert lang[k] == (m.languages[int(p.argmax())] if ids else "und") and np.isclose(score[k], p.max() if ids else 0)
        assert accepted[k] == bool(ids and p.max() >= 0.4)


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in langid.languages(docs).collect()] == [("und", 0.0)]
    assert langid.languages(docs.where("false")).collect() == []
