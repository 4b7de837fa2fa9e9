import json

from pyspark.sql import functions as F

from tracewell.sources import extraction, files, markdown
from tracewell.streaming import jobs


def test_jsonl_and_log_round_trip(spark, tmp_path):
    src = tmp_path / "log.jsonl"
    src.write_text("\n".join([json.dumps({"chain_key": "c", "index": i, "content": f"t{i}", "agent_id": "a"}) for i in range(4)] + ["", "{broken"]))
    log = files.read_jsonl(spark, str(src))
    assert log.count() == 4
    files.write_log(log, str(tmp_path / "log"))
    back = files.open_log(spark, str(tmp_path / "log"), "c")
    assert sorted(r.content for r in back.collect()) == ["t0", "t1", "t2", "t3"]
    assert "PartitionFilters: [isnotnull(chain_key" in back._jdf.queryExecution().executedPlan().toString()
    files.migrate(spark, str(src), str(tmp_path / "new"))
    assert files.open_log(spark, str(tmp_path / "new")).where("length(hash) = 64").count() == 4


def test_backup(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.txt").write_text("one")
    files.backup(spark, str(tmp_path / "d"), str(tmp_path / "b"))
    assert files.restore(spark, str(tmp_path / "b"), str(tmp_path / "r")).collect() == []
    (tmp_path / "b" / "a.txt").write_text("two")
    (tmp_path / "b" / ".a.txt.crc").unlink(missing_ok=True)  # else the file system itself refuses to read it
    assert [tuple(r) for r in files.restore(spark, str(tmp_path / "b"), str(tmp_path / "r2")).collect()] == [("a.txt", "changed")]


def test_markdown(spark):
    r = spark.createDataFrame([("c", 0, "a", "Plan", "Audit", "do it (now)", 0.85, 0.9, ["t1", "t2"]), ("c", 1, "a", "Goal", "Memory", "not shown", 0.5, None, [])], "chain_key string, index bigint, agent_id string, thought_type string, role string, content string, importance double, confidence double, tags array<string>")
    (row,) = markdown.export(r).collect()
    line = "- [#0] Plan: do it (now) (agent a; role Audit; importance 0.85; confidence 0.90; tags t1, t2)"
    assert row.markdown == f"# MEMORY\n\nGenerated from `c` with 2 thought(s).\n\n## Constraints And Decisions\n\n{line}\n\n"
    got = markdown.parse(spark.createDataFrame([(x,) for x in row.markdown.split("\n") + ["- [#1] Nonsense: x (agent a)"]], "value string")).collect()
    assert [(x.old_index, x.thought_type, x.content, x.agent_id, x.role, x.importance, x.confidence, x.tags) for x in got] == [(0, "Plan", "do it (now)", "a", "Audit", 0.85, 0.9, ["t1", "t2"])]


def test_extraction(spark):
    texts = spark.createDataFrame([(1, "x"), (2, "y")], "k int, text string")
    got = extraction.extract(texts, lambda t: json.dumps({"thoughts": [{"thought_type": "Idea", "content": f" {t} ", "importance": -3}, {"thought_type": "No", "content": "z"}]}) if t == "x" else "nothing").collect()
    assert [(r.k, r.thought_type, r.content, r.importance, r.confidence, r.tags) for r in got] == [(1, "Idea", "x", 0.0, None, [])]


def _stream(spark, tmp_path):
    schema = "chain_key string, index bigint, id string, agent_id string, thought_type string, content string"
    for k in range(2):
        rows = [("c", 2 * k + j, f"r{2 * k + j}", "a" if j else "b", "Plan" if j else "Idea", "same words here" if k + j != 1 else f"other x{k}y{j} z{k}{j}") for j in range(2)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return jobs.log_stream(spark, str(tmp_path / "in"), schema, 1)


def _drain(df, name, mode, tmp_path):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"ck-{name}")).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def test_running_registries(spark, tmp_path):
    s = _stream(spark, tmp_path)
    assert {(r.agent_id, r.n, r.last_index) for r in _drain(jobs.running_agents(s), "agents_t", "complete", tmp_path).collect()} == {("a", 2, 3), ("b", 2, 2)}
    assert {r.term: r.df for r in _drain(jobs.running_terms(s), "terms_t", "complete", tmp_path).collect()}["same"] == 2
    assert [(r.n_docs, r.tokens) for r in _drain(jobs.running_lengths(s), "lengths_t", "complete", tmp_path).collect()] == [(4, 12)]


def test_dedup_keeps_state(spark, tmp_path):
    got = _drain(jobs.dedup(_stream(spark, tmp_path), 0.9), "dedup_t", "append", tmp_path).collect()
    assert [(r["index"], r.supersedes) for r in got] == [(3, "r0")]


def test_fan_out_retries(spark, tmp_path):
    log = str(tmp_path / "sent")
    hooks = spark.createDataFrame([("u1", None, ["Plan"]), ("u2", "other", [])], "url string, chain_key string, types array<string>")

    def send(url, body):
        with open(log, "a") as f:
            f.write(url + "\n")
        return False

    q = jobs.fan_out(_stream(spark, tmp_path), hooks, send, str(tmp_path / "ck"), attempts=2, backoff=0.0)
    q.processAllAvailable()
    q.stop()
    assert open(log).read().split() == ["u1"] * 4


def test_vectors_of_a_stream(spark, tmp_path):
    s = _stream(spark, tmp_path).withColumns({"tags": F.array().cast("array<string>"), "concepts": F.array().cast("array<string>")})
    q = jobs.append_vectors(s, str(tmp_path / "v"), str(tmp_path / "ckv"))
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(str(tmp_path / "v")).where("size(vector) = 256").count() == 4
