"""Queries and operators do the whole job: inputs beyond the sizes at which earlier versions stopped."""

import datetime as dt
import json
import random

from tests.engine.test_behaviour import records, rel
from tracewell.operators import commit, federation, traverse
from tracewell.plans.queries import QUERIES
from tracewell.plans.schema import RELATION
from tracewell.streaming import jobs


def events(spark, tmp_path, n):
    rows = [(k, dt.datetime(2024, 1, 1), k % 7, ("view", "error")[k % 2], '{"k": 1}') for k in range(n)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, props string").write.parquet(f"{tmp_path}/events.parquet")
    return str(tmp_path)


def test_every_event_is_normalised(spark, tmp_path):
    got = QUERIES["commit_normalise"](spark, events(spark, tmp_path, 700)).collect()
    assert {(r["index"], r.tags, r.importance, r.entity_type) for r in got} == {(k, ("VIEW|scope", "ERROR|scope")[k % 2], min(1.0, k % 10 / 5), ("view", "error")[k % 2]) for k in range(700)}
    assert len(got) == 700


def test_every_answer_is_validated(spark, tmp_path):
    got = QUERIES["extraction_validate"](spark, events(spark, tmp_path, 3100)).collect()
    assert sorted((r.event_id, r.thought_type, r.content, r.importance) for r in got) == [(k, "Finding", ("view", "error")[k % 2], 1.0) for k in range(0, 3100, 3)]


def test_whole_texts_are_searched_and_slugged(spark, tmp_path):
    texts = ["a" * 300 + " Freiheit", "b" * 58 + "heit", "heit", "nothing", "a" * 300 + " b"]
    rows = [(k, t, "de", "s") for k, t in enumerate(texts, 1)] + [(k, "heit", "de", "s") for k in range(10, 30)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.updated_at for r in QUERIES["skill_search"](spark, str(tmp_path)).collect()}
    assert found == {1, 2, 3, *range(10, 30)} - {18, 27}  # every ninth is revoked
    slugs = {r.doc_id: r.slug for r in QUERIES["skill_slug"](spark, str(tmp_path)).collect()}
    assert slugs[1] == "a" * 300 + "-freiheit" and slugs[5] == "a" * 300 + "-b"


def test_closure_of_a_long_chain(spark):
    rows = [{"relations": [rel("ContinuesFrom", f"r{k - 1}")] if k else []} for k in range(100)]
    r = records(spark, rows).coalesce(1)
    assert {x.id for x in traverse.closure(r, r.where("index = 99")).collect()} == {f"r{k}" for k in range(100)}


def test_closure_where_walks_are_many(spark, monkeypatch):
    """Dense links in a cycle: walks of one length soon outnumber links, and the rest goes link by link."""
    monkeypatch.setattr(traverse, "MOST_WALKS", 2)
    rng = random.Random(1)
    links = {k: sorted({rng.randrange(40) for _ in range(3)} | {(k + 1) % 40}) for k in range(40)}
    links |= {k: [k + 1] for k in range(40, 59)} | {59: []}
    rows = [{"refs": [j for j in links[k] if j != k]} for k in range(60)]
    r = records(spark, rows).coalesce(1)
    got = {x.id for x in traverse.closure(r, r.where("index in (0, 40)")).where("target = 'r0'").collect()}
    assert got == {f"r{k}" for k in range(40)}
    assert traverse.closure(r, r.where("index = 40")).count() == 20


def test_ancestors_of_a_long_line(spark):
    rows = [(f"{k}", 0, [rel("BranchesFrom", "g", f"{k - 1}")] if k else []) for k in range(71)]
    got = federation.ancestors(spark.createDataFrame(rows, f"chain_key string, index bigint, relations array<{RELATION}>").coalesce(1)).collect()
    assert sorted((int(r.chain_key), int(r.ancestor), r.distance) for r in got) == [(k, a, k - a) for k in range(71) for a in range(k)]


def test_fan_out_reaches_every_hook(spark, tmp_path):
    log = str(tmp_path / "sent")
    hooks = [(f"n{k}", f"other{k}", []) for k in range(10_000)] + [("all", None, []), ("chain", "c", []), ("type", None, ["Plan", "Plan"]), ("both", "c", ["Idea", "Plan", None]), ("none", "c", ["Goal"])]
    hooks = spark.createDataFrame(hooks, "url string, chain_key string, types array<string>").coalesce(1)
    schema = "chain_key string, index bigint, id string, thought_type string, content string"
    spark.createDataFrame([("c", 0, "a", "Plan", ""), ("c", 1, "b", "Idea", ""), ("d", 0, "e", "Plan", ""), ("c", 2, "f", None, "")], schema).coalesce(1).write.parquet(str(tmp_path / "in"))

    def send(url, body):
        with open(log, "a") as f:
            f.write(f"{url}:{json.loads(body)['id']}\n")
        return True

    q = jobs.fan_out(jobs.log_stream(spark, str(tmp_path / "in"), schema), hooks, send, str(tmp_path / "ck"))
    q.processAllAvailable()
    q.stop()
    assert sorted(open(log).read().split()) == sorted(["all:a", "all:b", "all:e", "all:f", "chain:a", "chain:b", "chain:f", "type:a", "type:e", "both:a", "both:b"])


def test_inflected_copies_are_duplicates(spark, tmp_path):
    texts = ["she went running home", "other words entirely", "she go run home", "", "go goes"]
    r = records(spark, [{"content": t} for t in texts])
    want = [(2, 4 / 5, "r0")]  # she, went, go, run, home against she, go, run, home
    got = [(x["index"], x.similarity, x.supersedes) for x in commit.recent_duplicates(r, 0.6).collect()]
    assert got == want and commit.recent_duplicates(r, 0.6, words=commit.plain_words()).collect() == []
    r.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = jobs.log_stream(spark, str(tmp_path / "in"), r.schema)
    q = jobs.dedup(stream, 0.6).writeStream.outputMode("append").format("memory").queryName("stems_t").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(x["index"], x.similarity, x.supersedes) for x in spark.table("stems_t").collect()] == want


def test_stems_in_batch_and_stream_agree(spark):
    data = "/root/testdata/sf0.001"
    batch, stream = ({(r.chain_key, r["index"], r.similarity) for r in QUERIES[n](spark, data).collect()} for n in ("near_duplicate_jaccard", "stream_dedup"))
    assert batch == stream and batch


def test_rare_terms_have_statistics(spark, tmp_path):
    rows = [(k, f"common rare{k}", "en", "s") for k in range(3)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.term: r.df for r in QUERIES["postings_stats"](spark, str(tmp_path)).collect()}
    assert got == {"common": 3, "rare0": 1, "rare1": 1, "rare2": 1}
