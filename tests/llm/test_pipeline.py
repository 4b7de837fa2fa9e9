import random

from pyspark.sql import functions as F

import corpus_pipeline
from tracewell.llm.mixing import mix


def test_stages_against_what_they_say(spark, tmp_path):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    clean = [(i, " ".join(word() for _ in range(80)) + ".", "en", f"s{i % 3}", 1) for i in range(90)]
    junk = [(100 + i, "!!! ".join(word().upper() for _ in range(80)), "en", "s0", 1) for i in range(60)]
    copies = [(200 + i, clean[i][1] + " more", "en", "s1", 1) for i in range(10)] + [(300, clean[0][1], "en", "s1", 1)]
    bench = [(1, " ".join(word() for _ in range(20)))]
    leaks = [(400, clean[50][1][:200] + " " + " ".join(word() for _ in range(40)) + " " + bench[0][1], "en", "s2", 1)]
    rows = clean + junk + copies + leaks
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    d = str(tmp_path)
    spark.createDataFrame(rows, schema).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(r[0], int(r[0] not in range(100, 200)), 0) for r in clean + junk], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    ids = [{r[0] for r in rows}]
    frames = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, frames[-1], d)
        assert out.columns == docs.columns
        out.write.parquet(f"{d}/{k}")
        frames.append(spark.read.parquet(f"{d}/{k}"))
        ids.append({r.doc_id for r in frames[-1].collect()})
    assert ids[1] == ids[0] - {r[0] for r in junk}
    assert ids[2] == ids[1] - {r[0] for r in copies}
    assert ids[3] == ids[2] - {400}
    counts = {}
    for r in frames[4].collect():
        counts[r.doc_id] = counts.get(r.doc_id, 0) + 1
    assert counts == {r.doc_id: r.copies for r in mix(frames[3]).collect() if r.copies}
    last = corpus_pipeline.STAGES[-1][1](spark, frames[4], d).collect()
    assert sorted(r.doc_id for r in last) == sorted(d for d, n in counts.items() for _ in range(n))
    assert sorted((r.doc_id, r.n_tokens) for r in corpus_pipeline.run(spark, d).collect()) == sorted((r.doc_id, r.n_tokens) for r in last)


def test_repeated_ids_and_null_ids(spark):
    rows = [(1, "a b c", 0), (1, "a b c", 0), (1, "a b c", 1), (1, "x y z", 0), (None, "a b c", 0), (2, None, 0), (2, None, 0), (3, "A b c", 0), (4, "x y z ", 0), (5, "of its own", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int").withColumns({c: F.lit(5) for c in ("h", "row", "copies", "component_id", "kept", "mark", "first", "score", "copy")})
    got = corpus_pipeline.near_duplicates(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted((str(r.doc_id), str(r.text)) for r in got.collect()) == [("1", "a b c"), ("1", "x y z"), ("2", "None"), ("5", "of its own"), ("None", "a b c")]


def test_empty_documents_and_clashing_names(spark, tmp_path):
    d = str(tmp_path)
    schema = "doc_id long, text string, lang string, source string, row double, copies int, score int"
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    for rows in ([], [(None, None, None, None, None, None, None), (1, "w " * 5000, "en", None, 0.0, 1, 1), (2, "", None, "s", None, 2, 2)]):
        docs = spark.createDataFrame(rows, schema)
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, d)
            out.write.parquet(f"{d}/{len(rows)}-{k}")
            docs = spark.read.parquet(f"{d}/{len(rows)}-{k}")
            assert k == len(corpus_pipeline.STAGES) - 1 or docs.columns == schema.replace(" long", "").replace(" string", "").replace(" double", "").replace(" int", "").split(", ")
        assert docs.count() == (1 if rows else 0)  # texts without words are never taken
