"""Small fixtures for behaviour that the driver's tables do not show."""

import collections
import datetime as dt
import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracewell.functions.stem import stem
from tracewell.functions.text import query_terms, slug, tokens
from tracewell.functions.vectors import cosine, embed_text
from tracewell.operators import commit, federation, filters, graph, lexical, lifecycle, ranking, registry, skills, temporal, traverse, vector
from tracewell.plans.schema import RELATION, upgrade

REC = f"chain_key string, index bigint, id string, agent_id string, thought_type string, role string, content string, importance double, confidence double, tags array<string>, concepts array<string>, refs array<bigint>, relations array<{RELATION}>"


def rel(kind, target, chain=None):
    return (kind, target, chain, None, None)


def records(spark, rows):
    full = []
    for i, r in enumerate(rows):
        d = {"chain_key": "c", "index": i, "id": f"r{r.get('index', i)}", "agent_id": "a", "thought_type": "FactLearned", "role": "Memory", "content": "", "importance": 0.5, "confidence": None, "tags": [], "concepts": [], "refs": [], "relations": []} | r
        full.append(tuple(d[f.split()[0]] for f in REC.split(", ") if f.split()[0] in d))
    return spark.createDataFrame(full, REC)


def test_tokens_stems_lemmas_slugs(spark):
    row = spark.createDataFrame([("Tape-deck Reel_n2; Left+Right Öl नम", "we went AND went")], "a string, q string").select(tokens(F.col("a")).alias("t"), query_terms(F.col("q")).alias("q"), slug(F.lit("--Ünï code 2!")).alias("s"), slug(F.lit("!!")).alias("n")).first()
    assert row.t[:7] == ["tape", "deck", "reel", "n2", "left", "right", "öl"]
    assert row.q == ["we", "went", "go", "and"]
    assert (row.s, row.n) == ("n-code-2", "skill")
    known = {"expansion": "expans", "consistently": "consist", "hopping": "hop", "hoping": "hope", "ponies": "poni", "national": "nation", "skies": "sky", "dying": "die", "happily": "happili", "generously": "generous", "cry": "cri", "succeed": "succeed", "controlling": "control", "at": "at"}
    assert {w: stem(w) for w in known} == known


def bm25_rows(spark, rows, texts, **kw):
    q = spark.createDataFrame(list(enumerate(texts)), "query_id int, text string")
    return lexical.bm25(q, records(spark, rows), ("content", "tags", "concepts", "agent_id"), **({"stemmed": False} | kw))


def test_bm25_values_and_repeats(spark):
    rows = [{"content": "sqlite index bm25"}, {"content": "other words"}, {"content": "bm25 bm25 ranking"}]
    got = {(r.query_id, r["index"]): r.lexical for r in bm25_rows(spark, rows, ["bm25", "bm25 BM25"]).collect()}
    idf, avg = math.log((3 - 2 + 0.5) / (2 + 0.5) + 1), 8 / 3
    want = lambda tf, n: idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / avg))
    for q in (0, 1):
        assert got[q, 0] == pytest.approx(want(1, 3)) and got[q, 2] == pytest.approx(want(2, 3))
    assert len(got) == 4


def test_document_frequency_gate(spark):
    rows = [{"content": f"common text {i}"} for i in range(25)] + [{"content": "z", "tags": ["common"]}]
    assert bm25_rows(spark, rows, ["common"]).count() == 0
    loose = lexical.CUTOFFS | {"tags": 1.0}
    assert [r["index"] for r in bm25_rows(spark, rows, ["common"], cutoffs=loose).collect()] == [25]
    assert bm25_rows(spark, rows[:19], ["common"]).count() == 19


def test_irregular_and_stemmed_queries(spark):
    rows = [{"content": "they go home"}, {"content": "running expansions"}]
    assert [r["index"] for r in bm25_rows(spark, rows, ["went"]).collect()] == [0]
    assert bm25_rows(spark, rows, ["run expansion"]).count() == 0
    q = spark.createDataFrame([(0, "run expansion"), (1, "went homes")], "query_id int, text string")
    got = lexical.bm25(q, records(spark, rows), ("content",)).collect()  # stems unless said otherwise
    assert {(r.query_id, r["index"], tuple(r.matched_terms)) for r in got} == {(0, 1, ("expans", "run")), (1, 0, ("go", "home"))}
    assert [r["index"] for r in bm25_rows(spark, rows, ["run expansion"], stemmed=True).collect()] == [1]


def test_filters(spark):
    r = records(spark, [{"tags": ["Alpha"], "thought_type": "Plan"}, {"tags": ["beta"]}, {"content": "ALPHA here", "confidence": 0.9}, {"agent_id": "x"}])
    ids = lambda q, agents=None: sorted(x["index"] for x in filters.apply(r, q, agents).collect())
    assert ids(filters.Query(tags_any=[" ALPH", " "])) == [0]
    assert ids(filters.Query(tags_any=[" "])) == []
    assert ids(filters.Query(min_confidence=0.1)) == [2]
    assert ids(filters.Query(types=["FactLearned"], limit=2)) == [2, 3]
    agents = spark.createDataFrame([("c", "x", "Xavier", "Owner", "likes tea", ["zed"]), ("d", "a", "Zed", "owner", "alpha", ["zed"])], "chain_key string, agent_id string, display_name string, owner string, description string, aliases array<string>")
    for needle in ("alpha", "xAvier", "owner", "TEA", "zed"):
        assert ids(filters.Query(text_contains=needle), agents) == ([0, 2] if needle == "alpha" else [3])
    assert ids(filters.Query(agent_names=["ZED"]), agents) == [3] == ids(filters.Query(agent_owners=["owner"]), agents)
    assert ids(filters.Query(text_contains=" alpha")) == [] and ids(filters.Query(text_contains="alpha")) == [0, 2]
    assert [x["index"] for x in filters.related_to_concept(records(spark, [{"concepts": ["Deep Sea"]}, {}, {"concepts": ["sea"]}]), "SEA", 1).collect()] == [2]
    with pytest.raises(ValueError):
        filters.Query(types=["x"] * 101).validate()
    a, b = filters.time_window(dt.datetime(2024, 1, 1), 2, "seconds")
    assert (b - a) == dt.timedelta(seconds=2, microseconds=999_999)


def test_paging(spark):
    r = records(spark, [{} for _ in range(5)])
    got = lambda *a: [(x["index"], x.has_more) for x in traverse.page(r, *a).orderBy("page_rank").collect()]
    assert got(1, True, False, 2) == [(2, True), (3, True)]
    assert got(3, False, True, 10) == [(3, False), (2, False), (1, False), (0, False)]
    assert got(None) == []
    assert traverse.anchor_index(r, "head") == 4 and traverse.anchor_index(r, "id", "nope") is None
    with pytest.raises(ValueError):
        traverse.page(r, 0, size=0)


def test_adjacency_merges_and_keeps_dangling(spark):
    r = records(spark, [{}, {"refs": [0, 9], "relations": [rel("DerivedFrom", "r0"), rel("Supports", "gone"), rel("BranchesFrom", "r0", "other")]}])
    got = {(x.dst, x.dst_chain): (x.kinds, x.by_ref) for x in graph.adjacency(r).collect()}
    assert got == {("r0", None): (["DerivedFrom"], True), ("gone", None): (["Supports"], False), ("r0", "other"): (["BranchesFrom"], False)}
    (merged,) = [x for x in graph.adjacency(r).collect() if x.dst == "r0" and x.dst_chain is None]
    assert [(p.way, p.ref, p.kind) for p in merged.provenances] == [(0, 0, None), (1, None, "DerivedFrom")]
    near = {x.node: [(n.next_chain, n.id, n.direction) for n in x.neighbours] for x in graph.neighbours(graph.adjacency(r)).where("node = 'r1'").collect()}
    assert near == {"r1": [("", "gone", "out"), ("", "r0", "out"), ("other", "r0", "out")]}


def test_remote_nodes_are_visited_but_not_given(spark):
    r = records(spark, [{"relations": [rel("Supports", "r1", "other"), rel("Supports", "r2")]}, {"id": "r1"}, {"relations": [rel("DerivedFrom", "r1", "c")]}])
    seeds = spark.createDataFrame([(1, "c", "r0")], "query_id int, chain_key string, id string")
    got = {x.node: (x.depth, x.truncated, [(h.direction, h.kinds, h.node) for h in x.hops]) for x in graph.expand(seeds, graph.adjacency(r), 3).collect()}
    assert got == {"r2": (1, False, [("out", ["Supports"], "r2")]), "r1": (2, False, [("out", ["Supports"], "r2"), ("out", ["DerivedFrom"], "r1")])}
    small = graph.expand(seeds, graph.adjacency(r), 3, max_visited=2).collect()  # r2 comes first, the remote r1 is over the budget
    assert [(x.node, x.truncated) for x in small] == [("r2", True)]


def naive_bfs(arcs, seed, depth, most):
    seen, queue, out = {seed}, collections.deque([(seed, 0)]), {}
    while queue:
        node, d = queue.popleft()
        if d == depth:
            continue
        for _, nxt in sorted(arcs.get(node, [])):
            if nxt in seen:
                continue
            if len(seen) >= most:
                return out, True
            seen.add(nxt)
            out[nxt] = d + 1
            queue.append((nxt, d + 1))
    return out, False


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9)), min_size=3, max_size=16), st.integers(2, 6))
def test_expansion_against_naive(spark, pairs, most):
    edges = sorted({(a, b) for a, b in pairs if a != b})
    rows = [{"relations": [rel("Supports", f"r{b}") for a, b in edges if a == i]} for i in range(10)]
    r = records(spark, rows)
    arcs = collections.defaultdict(list)
    for a, b in edges:
        arcs[f"r{a}"].append((0, f"r{b}"))
        arcs[f"r{b}"].append((1, f"r{a}"))
    seeds = spark.createDataFrame([(1, "c", "r0"), (1, "c", "r5")], "query_id int, chain_key string, id string")
    got = graph.expand(seeds, graph.adjacency(r), 3, most, include_seeds=True).collect()
    for seed in ("r0", "r5"):
        want, cut = naive_bfs(arcs, seed, 3, most)
        mine = {x.node: x.depth for x in got if x.seed == seed and x.depth}
        assert mine == want
        assert {x.truncated for x in got if x.seed == seed} == {cut}
        assert all(x.path[0] == seed and x.path[-1] == x.node and len(x.path) == x.depth + 1 for x in got if x.seed == seed)


def test_two_seeds_support(spark):
    r = records(spark, [{}, {}, {"relations": [rel("DerivedFrom", "r0"), rel("Corrects", "r1")]}])
    seeds = spark.createDataFrame([(1, "c", "r0"), (1, "c", "r1")], "query_id int, chain_key string, id string")
    (hit,) = graph.graph_hits(graph.expand(seeds, graph.adjacency(r)), seeds).collect()
    assert (hit.id, hit.seed_paths, hit.depth, hit.graph, hit.relation, hit.seed_support) == ("r2", 2, 1, 1.0, 0.5, 0.2)


def test_cohesion_and_fusion(spark):
    rows = [(1, "c", i, f"r{i}", 0.5, None, lex, 0.0, 0.0, 0.0, 0.0, 40) for i, lex in ((0, 4.0), (1, 1.0), (6, 1.0), (12, 1.0), (13, 1.0), (14, 6.0), (40, 0.5))]
    hits = ranking.additive(spark.createDataFrame(rows, "query_id int, chain_key string, index bigint, id string, importance double, confidence double, lexical double, vector double, graph double, relation double, seed_support double, newest bigint"))
    got = {r["index"]: r.cohesion for r in ranking.cohesion(hits).collect()}
    assert got[1] == pytest.approx(1.2 * (1 - 1 / 12)) and got[6] == pytest.approx(0.6) and got[13] == pytest.approx(1.2 * (1 - 1 / 12))
    assert got[14] == got[40] == 0 and got[0] == 0
    fused = {r["index"]: r for r in ranking.rrf(ranking.cohesion(hits), rerank_k=2).collect()}
    assert fused[14].rrf == pytest.approx(1 / 61) and fused[40].rrf == 0 and fused[40].total == pytest.approx(0.5 + 0.05 + 0.0)
    assert fused[0].rrf == pytest.approx(1 / 62 + 2 / 61)
    best = ranking.best(ranking.cohesion(hits), 2, 1).orderBy("rank").collect()
    assert [b["rank"] for b in best] == [2, 3] and best[0].total_candidates == 7


def test_vectors(spark):
    v = spark.createDataFrame([("d", [0.5, 0.5]), ("b", [1.0, 0.0]), ("a", [0.5, 0.5]), ("z", [0.0, 1.0]), ("bad", [1.0]), ("zero", [0.0, 0.0])], "thought_id string, vector array<float>")
    q = spark.createDataFrame([(1, [1.0, 0.2])], "query_id int, query_vector array<float>")
    assert [r.thought_id for r in vector.cosine_top_k(q, v, 3).orderBy("rank").collect()] == ["b", "a", "d"]
    nulls = v.select("thought_id", cosine(F.col("vector"), F.array(F.lit(1.0), F.lit(0.0))).alias("c")).where("c is null").collect()
    assert {r.thought_id for r in nulls} == {"bad", "zero"}
    e = embed_text("Graph memory GRAPH")
    assert len(e) == 256 and abs(sum(x * x for x in e) - 1) < 1e-5 and e == embed_text("graph MEMORY graph") and embed_text("")[0] == 1.0


def test_point_in_time(spark):
    r = records(spark, [{}, {"relations": [rel("Supersedes", "r0")]}, {}])
    at = lambda i: sorted(x["index"] for x in temporal.as_of(r, upto=i).collect())
    assert at(0) == [0] and at(1) == [1] and at(2) == [1, 2]
    assert [x.id for x in temporal.invalidated(r).collect()] == ["r0"]


def test_commit(spark):
    rows = [("c", 0, [" A", "a", " "], [], 7.0, -1.0, [0], [("Supports", "x", None, None, None)] * 2), ("c", 1, [], ["B", "b "], None, None, [10], [])]
    rows = [(*r, i) for i, r in zip(("n5", "n6"), rows, strict=True)]
    log = spark.createDataFrame([("c", 0, "old0"), ("c", 4, "old4"), ("d", 9, "d9")], "chain_key string, index bigint, id string")
    when = dt.datetime(2024, 5, 1)
    got = commit.normalise(spark.createDataFrame(rows, f"chain_key string, seq int, tags array<string>, concepts array<string>, importance double, confidence double, refs array<bigint>, relations array<{RELATION}>, id string"), log, F.lit(when)).orderBy("index").collect()
    assert [r["index"] for r in got] == [5, 6]
    assert got[0].tags == ["A"] and got[1].concepts == ["B"] and got[0].importance == 1.0 and got[0].confidence == 0.0 and got[1].importance == 0.5
    assert [(x.kind, x.target_id, x.valid_at) for x in got[0].relations] == [("Supports", "x", when), ("References", "old0", when)] and [r.bad_refs for r in got] == [False, True]


def test_duplicates_of_recent_records(spark):
    text = "alpha beta gamma delta"
    rows = [{"content": f"u{i} v{i} w{i}"} for i in range(70)]
    rows[3] = rows[66] = rows[69] = {"content": text}
    got = {r["index"]: (r.similarity, r.supersedes) for r in commit.recent_duplicates(records(spark, rows), 0.9).collect()}
    assert got == {66: (1.0, "r3"), 69: (1.0, "r66")}


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.integers(0, 5), st.sampled_from(["content", "agent_id", "hash"]))
def test_tampering_is_found(spark, at, column):
    r = commit.chain_hashes(records(spark, [{"content": f"t{i}"} for i in range(6)]))
    assert commit.verify(r).first().ok
    bad = r.withColumn(column, F.when(F.col("index") == at, F.concat(column, F.lit("x"))).otherwise(F.col(column)))
    row = commit.verify(bad).first()
    assert not row.ok and row.first_bad == at


def test_federation(spark):
    hits = spark.createDataFrame([(1, "a", 0, "x", 5, 1.0), (1, "b", 1, "x", 2, 3.0), (1, "b", 1, "y", 5, 2.0)], "query_id int, chain_key string, chain_pos int, id string, index bigint, total double")
    assert [(r.id, r.chain_key) for r in federation.federated(hits).orderBy("rank").collect()] == [("x", "b"), ("y", "b")]
    assert [(r.id, r.chain_key) for r in federation.federated(hits, first_chain_wins=True).orderBy("rank").collect()] == [("y", "b"), ("x", "a")]
    rrf = {r.id: r.rrf for r in federation.federated_rrf(hits).collect()}
    assert rrf["x"] == pytest.approx(2 / 61) and rrf["y"] == pytest.approx(1 / 62)
    s = spark.createDataFrame([("alice-bot", 1), ("bob", 1), ("123", 1)], "agent_id string, n bigint")
    t = spark.createDataFrame([("alice", 5), ("bob", 2), ("zz", 9)], "agent_id string, n bigint")
    assert {r.source_agent: r.target_agent for r in federation.map_agents(s, t).collect()} == {"alice-bot": "alice", "bob": "bob", "123": "zz"}


def test_ancestors_stop_at_cycles(spark):
    rows = [(c, 0, [rel("BranchesFrom", "g", p)]) for c, p in (("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"))]
    got = federation.ancestors(spark.createDataFrame(rows, f"chain_key string, index bigint, relations array<{RELATION}>")).collect()
    assert {(r.chain_key, r.ancestor, r.distance) for r in got if r.chain_key == "d"} == {("d", "a", 1), ("d", "b", 2), ("d", "c", 3)}


def test_registry_history(spark):
    events = spark.createDataFrame([("c", "a", 1, "Ann", None), ("c", "a", 2, "Anna", "o"), ("c", "a", 3, "Ann", "p")], "chain_key string, agent_id string, seq int, display_name string, owner string")
    r = registry.names_over_time(events).first()
    assert (r.display_name, list(r.aliases), r.owner) == ("Ann", ["Anna"], "o")
    assert registry.latest(events, ["agent_id"]).first().seq == 3


def test_skills():
    text = "---\nname: X\ntags: [a, b]\n---\n# One\nbody\n\n## Two\nmore"
    doc = skills.parse_markdown(text)
    assert doc["meta"] == {"name": "X", "tags": ["a", "b"]}
    assert [(s["level"], s["heading"], s["body"]) for s in doc["sections"]] == [(1, "One", "body"), (2, "Two", "more")]
    assert skills.parse_markdown(skills.render_markdown(doc)) == doc
    with pytest.raises(ValueError):
        skills.parse_markdown("x" * (skills.MOST_BYTES + 1))
    assert "+new" in skills.unified("old\n", "new\n")


@settings(max_examples=60, deadline=None)
@given(st.text(), st.text())
def test_delta_round_trip(a, b):
    assert skills.patch(a, skills.delta(a, b)) == b


def test_upgrade_fills_defaults(spark):
    row = upgrade(spark.createDataFrame([("c", 0, "x", None)], "chain_key string, index bigint, content string, tags array<string>")).first()
    assert (row.role, row.importance, row.tags, row.relations, row.schema_version) == ("Memory", 0.5, [], [], 3)


def test_lifecycle(spark):
    r = records(spark, [{}, {"chain_key": "d", "agent_id": "b"}])
    chains = spark.createDataFrame([("c", "a"), ("new", "a")], "chain_key string, agent_id string")
    assert [(x.chain_key, x.thought_type, x.role) for x in lifecycle.bootstrap(chains, r, "hello").collect()] == [("new", "Summary", "Checkpoint")]
    assert [x.importance for x in lifecycle.retrospective(spark.createDataFrame([(None,), (0.2,)], "importance double")).collect()] == [0.7, 0.2]
    with pytest.raises(ValueError):
        lifecycle.copy_agent(r, "a", "d", "c")
    assert [x["index"] for x in lifecycle.copy_agent(r.withColumn("index", F.lit(0).cast("bigint")), "a", "c", "d").collect()] == [1]
    assert [x["index"] for x in lifecycle.copy_agent(r, "a", "c", "nothing there").collect()] == [0]
    assert lifecycle.deregister(r, "c").count() == 1
    b = spark.createDataFrame([(1, "c", "x", 2.0), (1, "c", "y", 3.0), (1, "c", "z", 1.0)], "query_id int, chain_key string, seed string, lexical double")
    assert [(x.seed, x.total) for x in lifecycle.page_bundles(b, 1, 1).collect()] == [("x", 3)]
    assert spark.range(1).select(lifecycle.kind_label(F.lit("ContinuesFrom"))).first()[0] == "continues_from"


def test_many_terms_score_as_few_do(spark, monkeypatch):
    rows = [{"content": "running runs of tapes", "tags": ["Run", "tape"]}, {"content": ""}, {"content": "no", "tags": ["runner"]}, {"content": None, "tags": None}]
    show = lambda stemmed: sorted((r.query_id, r["index"], round(r.lexical, 9), tuple(r.matched_terms), tuple(r.match_sources)) for r in bm25_rows(spark, rows, ["run tape", "no", ""], stemmed=stemmed).collect())
    few = [show(True), show(False)]
    assert len(few[0]) == 2 and few[0] != few[1]
    monkeypatch.setattr(lexical, "SENT_TERMS", 1)
    assert [show(True), show(False)] == few


def test_numbers_go_on_over_ranges(spark):
    from tracewell.operators.storage import numbered

    rows = spark.range(0, 500, 1, 7).select((F.col("id") % 3).alias("k"), (F.col("id") * 7919 % 500).alias("o"))
    got = numbered(rows, ["k"], ["o"], "n").collect()
    for k in range(3):
        mine = sorted((r.o, r.n) for r in got if r.k == k)
        assert [n for _, n in mine] == list(range(len(mine)))
    assert numbered(rows.where("false"), ["k"], ["o"], "n").collect() == []


def test_changes_of_agents(spark):
    when = dt.datetime(2024, 2, 3)
    rows = [
        ("c", "a", 1, "upsert", "Ann", "o", None, None, None, None, None, None), ("c", "a", 3, "upsert", "Anna", "p", "tall", None, None, None, None, None), ("c", "a", 2, "alias", None, None, None, "annie", None, None, None, None),
        ("c", "a", 4, "add_key", None, None, None, None, "k", "ed25519", b"x", when), ("c", "a", 5, "revoke_key", None, None, None, None, "k", None, None, when), ("c", "a", 6, "add_key", None, None, None, None, "k2", "ed25519", b"y", when),
        ("c", "a", 7, "disable", None, None, None, None, None, None, None, None), ("d", "a", 1, "describe", None, None, "other", None, None, None, None, None),
    ]
    got = {(r.chain_key, r.agent_id): r for r in registry.changed(spark.createDataFrame(rows, registry.CHANGE)).collect()}
    a = got["c", "a"]
    assert (a.display_name, a.owner, a.description, a.aliases, a.status) == ("Anna", "o", "tall", ["annie", "Ann"], "disabled")
    assert [(k.key_id, k.revoked_at) for k in a.public_keys] == [("k", when), ("k2", None)] and got["d", "a"].description == "other"
    with pytest.raises(Exception, match="no such change"):
        registry.changed(spark.createDataFrame([("c", "a", 1, "explode")], "chain_key string, agent_id string, seq bigint, kind string")).collect()
