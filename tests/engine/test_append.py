"""Appending to logs: one batch, groups of a stream, replay, older formats."""

import datetime as dt
import json
import uuid

import pytest
from pyspark.sql import functions as F

from tracewell.operators import commit, lifecycle, skills, vector
from tracewell.sources import binary, files
from tracewell.streaming import jobs
from tests.engine.test_behaviour import records, rel

INPUT = "chain_key string, seq int, agent_id string, thought_type string, content string, tags array<string>, refs array<bigint>"


def batch(spark, rows):
    return spark.createDataFrame([(c, k, "a", "Idea", text, [" T ", "t"], refs) for k, (c, text, refs) in enumerate(rows)], INPUT)


def test_append(spark, tmp_path):
    path, seen = str(tmp_path / "log"), []
    files.append(spark, path, batch(spark, [("c", "alpha beta gamma", []), ("d", "alpha beta gamma", []), ("c", "other words", [0])]))
    again = files.append(spark, path, batch(spark, [("c", "alpha betas gamma", [1]), ("c", "new thing", [])]), threshold=0.9, on_append=lambda rows: seen.append(rows.count()))
    assert seen == [2]
    log = {(r.chain_key, r["index"]): r for r in files.open_log(spark, path, checked=True).collect()}
    assert sorted(log) == [("c", 0), ("c", 1), ("c", 2), ("c", 3), ("d", 0)]
    ids = {k: r.id for k, r in log.items()}
    assert {(x.kind, x.target_id) for x in log["c", 2].relations} == {("References", ids["c", 1]), ("Supersedes", ids["c", 0])}
    assert all(x.valid_at is not None for r in log.values() for x in r.relations) and log["c", 0].tags == ["T"]
    assert log["c", 3].prev_hash == log["c", 2].hash and log["c", 2].prev_hash == log["c", 1].hash
    report = {r.chain_key: r for r in commit.head_report(files.open_log(spark, path)).collect()}
    assert (report["c"].n, report["c"].head_hash, report["c"].latest, report["c"].ok) == (4, log["c", 3].hash, "new thing", True)
    assert again.count() == 2


def test_append_refuses_refs_to_nothing(spark, tmp_path):
    path = str(tmp_path / "log")
    with pytest.raises(ValueError, match="c#0"):
        files.append(spark, path, batch(spark, [("c", "x", [5])]))
    assert not files.exists(spark, path)


def test_opening_a_broken_chain(spark, tmp_path):
    rows = commit.chain_hashes(records(spark, [{"content": f"t{i}"} for i in range(5)]))
    files.write_log(files.upgrade(rows.withColumn("content", F.when(F.col("index") == 2, "changed").otherwise(F.col("content")))), str(tmp_path / "log"))
    with pytest.raises(ValueError, match="from 2"):
        files.open_log(spark, str(tmp_path / "log"), checked=True)


def test_groups_of_a_stream_are_written_once(spark, tmp_path):
    path, ck, groups = str(tmp_path / "log"), str(tmp_path / "ck"), []
    for k in range(3):
        batch(spark, [("c", f"text {k} {j}", []) for j in range(2)]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = jobs.log_stream(spark, str(tmp_path / "in"), INPUT, 1)
    q = jobs.commit_stream(stream, path, ck, "0 seconds", on_append=lambda rows: groups.append(rows.count()))
    jobs.flush(q)
    q.stop()
    assert sum(groups) == 6
    log = files.open_log(spark, path, checked=True)
    assert sorted(r["index"] for r in log.collect()) == list(range(6))
    (tmp_path / "ck-groups" / "2" / "_DONE").unlink()  # as if the driver had died between writing and marking
    (tmp_path / "ck" / "commits" / "2").unlink()
    (tmp_path / "ck" / "commits" / ".2.crc").unlink(missing_ok=True)
    q = jobs.commit_stream(jobs.log_stream(spark, str(tmp_path / "in"), INPUT, 1), path, ck, "0 seconds")
    jobs.flush(q)
    q.stop()
    assert sorted(r["index"] for r in files.open_log(spark, path, checked=True).collect()) == list(range(6))


def test_versions_and_archive(spark, tmp_path):
    src = tmp_path / "log.jsonl"
    rows = [{"index": 0, "content": "old", "hash": "h0", "schema_version": 1}, {"index": 1, "content": "older", "hash": "h1"}, {"index": 2, "content": "new", "hash": "h2", "schema_version": 3, "role": "Audit"}]
    src.write_text("\n".join(json.dumps({"chain_key": "c", "agent_id": "a"} | r) for r in rows))
    got = files.read_jsonl(spark, str(src), with_version=True).orderBy("index").collect()
    assert [(r.found_version, r.schema_version, r.hash, r.role) for r in got] == [(1, 3, "", "Memory"), (0, 3, "", "Memory"), (3, 3, "h2", "Audit")]
    files.migrate(spark, str(src), str(tmp_path / "new"))
    assert not src.exists() and (tmp_path / "log.jsonl-archive").exists()
    assert files.open_log(spark, str(tmp_path / "new"), checked=True).count() == 3


def full(**more):
    now = dt.datetime(2024, 5, 1, 12, 30, 15, 250000, tzinfo=dt.timezone.utc)
    relation = {"kind": "Supports", "target_id": str(uuid.UUID(int=5)), "chain_key": "other", "valid_at": now, "invalid_at": None}
    return {
        "schema_version": 3, "id": str(uuid.UUID(int=7)), "index": 70_000, "timestamp": now, "session_id": None, "agent_id": "ä", "signing_key_id": "k", "thought_signature": b"\0\xff", "thought_type": "Goal", "role": "Audit",
        "content": "x" * 300, "confidence": 0.25, "importance": 0.5, "tags": ["a", ""], "concepts": [], "refs": [0, 250, 251, 1 << 40], "relations": [relation], "entity_type": "e", "source_episode": None, "prev_hash": "p", "hash": "h",
    } | more


def test_binary_records():
    row = full()
    assert binary.decode(binary.encode(row)) == row | {"found_version": 3}
    data = binary.encode(row)
    assert data[0] == 3 and data[1] == 16 and data[18] == 252  # version, length of the id, a number of four bytes
    with pytest.raises(ValueError):
        binary.decode(data[:40])


def payload_without(data_row, fields):
    """A payload as older versions wrote it: some fields are not there."""
    old = binary.FIELDS
    binary.FIELDS = tuple(f for f in old if f[0] not in fields)
    try:
        return binary.encode(data_row)
    finally:
        binary.FIELDS = old


def test_binary_logs_of_all_versions(spark, tmp_path):
    later = ("entity_type", "source_episode")
    old_relation = binary.RELATION_FIELDS
    try:
        binary.RELATION_FIELDS = old_relation[:2]
        first = payload_without(full(schema_version=0, index=0), later)
        binary.RELATION_FIELDS = old_relation[:3]
        second = payload_without(full(schema_version=2, index=1), later)
    finally:
        binary.RELATION_FIELDS = old_relation
    third = payload_without(full(index=2), later)
    for name, parts in (("one", [first, second, third, binary.encode(full(index=3))]), ("two", [binary.encode(full(index=0))] * 1)):
        (tmp_path / f"{name}.bin").write_bytes(b"".join(len(p).to_bytes(8, "little") + p for p in parts) + b"\1\2")
    got = binary.read_binary(spark, str(tmp_path)).orderBy("chain_key", "index").collect()
    assert [(r.chain_key, r["index"], r.found_version, r.hash, r.entity_type, r.relations[0].chain_key) for r in got] == [("one", 0, 0, "", None, None), ("one", 1, 2, "h", None, "other"), ("one", 2, 3, "h", None, "other"), ("one", 3, 3, "h", "e", "other"), ("two", 0, 3, "h", "e", "other")]
    assert got[3].timestamp == dt.datetime(2024, 5, 1, 12, 30, 15, 250000) and got[3].thought_signature == b"\0\xff"


def test_sidecars(spark, tmp_path):
    r = records(spark, [{"content": f"words {i}"} for i in range(4)])
    side = vector.Sidecars(spark, str(tmp_path / "side"))
    state = lambda: [(x.provider, x.enabled, x.n, x.status) for x in side.status(r).collect()]
    assert state() == [("local", True, 0, "Missing")]
    side.sync("local", r.where("index < 2"))
    assert state() == [("local", True, 2, "StaleCount")]
    side.disable("local")
    side.sync("local", r)
    assert state() == [("local", False, 2, "StaleCount")]
    side.enable("local")
    side.sync("local", r)
    assert state() == [("local", True, 4, "Fresh")]
    side.rebuild("local", r.where("index = 0"))
    assert side.table("local").count() == 1
    bad = vector.Provider("bad", "1", 3, lambda c: F.array(F.lit(1.0), F.lit(float("nan")), F.lit(0.0)))
    with pytest.raises(Exception, match="finite"):
        vector.build_sidecar(r, bad).collect()


def test_document_forms(spark):
    text = "---\nname: X\ntags: [a, b]\n---\n\n# One\nbody\n\n## Two\nmore\n"
    docs = spark.createDataFrame([(1, text), (2, "x" * ((1 << 20) + 1)), (3, None)], "k int, text string")
    got = {r.k: r.doc for r in skills.parsed(docs).collect()}
    assert got[1].meta == {"name": "X", "tags": "a, b"} and [(s.level, s.heading, s.body) for s in got[1].sections] == [(1, "One", "body"), (2, "Two", "more")]
    assert got[2].warnings == ["document is over 1 MB"] and got[3].sections == []
    once = skills.parsed(docs.where("k = 1"))
    for form in ("markdown", "json"):
        back = skills.parsed(skills.rendered(once, form=form).drop("doc"), form=form).first().doc
        assert [tuple(s) for s in back.sections] == [tuple(s) for s in got[1].sections] and back.meta["name"] == "X"
    (wrong,) = skills.parsed(spark.createDataFrame([("no json",)], "text string"), form="json").collect()
    assert wrong.doc.warnings == ["no JSON document"]


def test_document_versions(spark):
    texts = spark.createDataFrame([("s", 0, "# A\none\n"), ("s", 1, "# A\ntwo\n"), ("t", 0, "x")], "skill_id string, version bigint, text string")
    stored = skills.migrate(texts)
    assert {r.skill_id: (r.versions, r.problem) for r in skills.manifest(stored).collect()} == {"s": (2, None), "t": (1, None)}
    assert {r.skill_id: r.problem for r in skills.manifest(stored.where("version = 1")).collect()} == {"s": "versions are missing or repeated"}
    (diff,) = skills.diffs(texts, 0, 1).collect()
    assert diff.skill_id == "s" and "-one" in diff.diff and "+two" in diff.diff
    events = spark.createDataFrame([("s", 5, "Deprecated", "old"), ("t", 5, "Revoked", "bad")], "skill_id string, seq int, status string, reason string")
    uploads = spark.createDataFrame([("s", 6), ("t", 6), ("u", 1)], "skill_id string, seq int")
    assert {r.skill_id: (r.status, r.reason) for r in skills.status_of(events, uploads).collect()} == {"s": ("Active", None), "t": ("Revoked", "bad"), "u": ("Active", None)}
    assert {r.skill_id: r.status for r in skills.with_status(spark.createDataFrame([("s", "?"), ("v", "?")], "skill_id string, status string"), events).collect()} == {"s": "Deprecated", "v": "Active"}
    got = {r.skill_id: r for r in skills.read(stored, skills.status_of(events)).collect()}
    assert (got["s"].version, got["s"].sections[0].body, got["s"].warnings, got["s"].intact) == (1, "two", ["deprecated: old"], True)
    assert skills.read(stored, skills.status_of(events), version=0).where("skill_id = 's'").first().sections[0].body == "one"


def test_signed_uploads(spark):
    agents = spark.createDataFrame([("a", [("k1", b"one", None), ("k2", b"two", dt.datetime(2024, 1, 1))]), ("b", [])], "agent_id string, public_keys array<struct<key_id:string,public_key_bytes:binary,revoked_at:timestamp>>")
    rows = [("a", "t", "k1", b"one:t"), ("a", "t", "k1", b"two:t"), ("a", "t", "k2", b"two:t"), ("a", "t", None, None), ("b", "t", None, None), ("c", "t", None, None)]
    uploads = spark.createDataFrame(rows, "agent_id string, text string, key_id string, signature binary").coalesce(1)
    got = skills.accept_uploads(uploads, agents, lambda key, text, sign: sign == key + b":" + text).collect()
    assert sorted((r.agent_id, str(r.key_id), r.accepted, str(r.refusal)) for r in got) == [("a", "None", False, "unsigned"), ("a", "k1", False, "wrong signature"), ("a", "k1", True, "None"), ("a", "k2", False, "unknown key"), ("b", "None", True, "None"), ("c", "None", True, "None")]


def test_transport(spark):
    from tracewell.operators import graph

    r = records(spark, [{}, {"relations": [rel("DerivedFrom", "r0")]}])
    seeds = spark.createDataFrame([(1, "c", "r1")], "query_id int, chain_key string, id string")
    (row,) = lifecycle.graph_json(graph.expand(seeds, graph.adjacency(r))).collect()
    assert json.loads(row.json) == {"nodes": [{"depth": 1, "node": "r0", "path": ["r1", "r0"], "hops": [{"direction": "out", "relations": ["derived_from"], "node": "r0"}]}], "truncated": False}
    signed = json.loads(r.withColumn("session_id", F.lit(None).cast("string")).where("index = 1").select(commit.signable()).first()[0])
    assert list(signed)[:6] == ["schema_version", "agent_id", "session_id", "thought_type", "role", "content"] and signed["relations"][0]["kind"] == "DerivedFrom"
