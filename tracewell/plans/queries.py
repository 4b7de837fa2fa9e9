"""Queries of the engine over the driver's tables, and DuckDB SQL for the same rows where SQL can say it."""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions.lemmas import LEMMAS
from ..functions.stem import stem
from ..functions.text import slug
from ..functions.vectors import hashed_embedding
from ..operators import commit, federation, filters, graph, lexical, lifecycle, ranking, registry, skills, temporal, traverse, vector
from ..operators.storage import cut, new_folder
from ..sources import extraction, markdown
from . import schema as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: Query texts for ranked retrieval: rare and common words of four languages, one without a word.
TEXTS = [(1, "thing resh edition oneden"), (2, "the of and idiot"), (3, "Über heit ungkeit einer"), (4, "ción quell osos"), (5, "eaux pour mentoi la"), (6, "trash worthless erster thing"), (7, "thinoner atre resh thing"), (8, " ?! ")]
TOK = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"
#: Endings that the made-up prose of the tables adds to words, one after the other.
ENDINGS = ("e", "s", "es", "ed", "er", "ing", "ly", "ion")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def texts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TEXTS, "query_id int, text string")


def query_stems(text: str) -> list[str]:
    """What a text is searched by: stems of its words and of their irregular base forms."""
    words = re.findall(r"[^\W_]+", text.lower())
    return list(dict.fromkeys(stem(w) for word in words for w in (word, LEMMAS.get(word, word))))


def stem_table() -> list[tuple[str, str]]:
    """(word, stem) of every word that is a query's stem with up to three endings and is stemmed to it."""
    bases = sorted({t for _, text in TEXTS for t in query_stems(text)})
    ends = {"".join(e) for n in range(4) for e in itertools.product(ENDINGS, repeat=n)}
    return [(b + e, b) for b in bases for e in sorted(ends) if stem(b + e) == b]


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)


TEXTS_SQL = f"q(query_id, text) AS (VALUES {_values(TEXTS)})"
STEMS_SQL = f"stems(word, term) AS (VALUES {_values(stem_table())}), qt(query_id, term) AS (VALUES {_values((i, t) for i, text in TEXTS for t in query_stems(text))})"


def bm25_sql(source: str, fields: tuple[str, ...], chain: str = "'doc'", stemmed: bool = True) -> str:
    """CTEs q, qt, tok, stats and lex: the scores of all texts."""
    text = {"content": "content", "tags": "array_to_string(tags, ' ')", "concepts": "array_to_string(concepts, ' ')", "agent_id": "agent_id", "registry": "registry"}
    score = {f: f"CASE WHEN tf_{f} > 0 AND NOT (n >= 20 AND df / n > {lexical.CUTOFFS[f]}) THEN {lexical.WEIGHTS[f]} * ln((n - df + 0.5) / (df + 0.5) + 1) * tf_{f} * 2.2 / (tf_{f} + 1.2 * (0.25 + 0.75 * l_{f} / greatest(a_{f}, 1.0))) ELSE 0 END" for f in fields}
    exploded = " UNION ALL ".join(f"SELECT chain, idx, unnest(t_{f}) AS word, '{f}' AS f FROM tok" for f in fields)
    words = f"SELECT chain, idx, stems.term, f FROM ({exploded}) JOIN stems USING (word)" if stemmed else f"SELECT chain, idx, word AS term, f FROM ({exploded}) WHERE word IN (SELECT term FROM qt)"
    terms = STEMS_SQL if stemmed else f"qt AS (SELECT DISTINCT query_id, unnest({TOK.format('text')}) AS term FROM q)"
    return f"""{TEXTS_SQL}, {terms},
    tok AS (SELECT {chain} AS chain, idx, {", ".join(f"{TOK.format(text[f])} AS t_{f}" for f in fields)} FROM {source}),
    stats AS (SELECT chain, count(*)::DOUBLE AS n, {", ".join(f"avg(len(t_{f})) AS a_{f}" for f in fields)} FROM tok GROUP BY chain),
    lens AS (SELECT chain, idx, {", ".join(f"len(t_{f}) AS l_{f}" for f in fields)} FROM tok),
    tf AS (SELECT chain, idx, term, {", ".join(f"sum(CASE WHEN f = '{f}' THEN 1 ELSE 0 END)::DOUBLE AS tf_{f}" for f in fields)} FROM ({words}) GROUP BY ALL),
    df AS (SELECT chain, term, count(*)::DOUBLE AS df FROM tf GROUP BY ALL),
    sc AS (SELECT query_id, chain, idx, term, {", ".join(f"{s} AS s_{f}" for f, s in score.items())} FROM tf JOIN df USING (chain, term) JOIN stats USING (chain) JOIN lens USING (chain, idx) JOIN qt USING (term)),
    lex AS (SELECT query_id, chain, idx, sum({" + ".join(f"s_{f}" for f in fields)}) AS lexical, array_to_string(list_sort(list(DISTINCT term)), ' ') AS matched_terms,
                   concat_ws(' ', {", ".join(f"CASE WHEN max(s_{f}) > 0 THEN '{f}' END" for f in fields)}) AS match_sources
            FROM sc WHERE {" + ".join(f"s_{f}" for f in fields)} > 0 GROUP BY ALL)"""


CONTENT, FOUR, FIVE = ("content",), ("content", "tags", "concepts", "agent_id"), lexical.FIELDS
ORACLE_TOP = "SELECT query_id, idx AS doc_id, round(lexical, 6) AS lexical FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY lexical DESC, idx) AS r FROM lex) WHERE r <= 10"


def _doc_hits(spark, d, fields, **how):
    """Hits of the texts in the documents, and the number of each as doc_id."""
    agents = S.document_agents(spark, d) if "registry" in fields else None
    return lexical.bm25(texts(spark), S.document_records(spark, d), fields, agents, **how).withColumn("doc_id", F.col("index"))


@query(f"WITH {S.DOC}, {bm25_sql('doc', CONTENT)} {ORACLE_TOP}")
def bm25_content_top10(spark, d):
    return lexical.top_k(_doc_hits(spark, d, CONTENT), "lexical", 10, F.asc("index")).select("query_id", "doc_id", F.round("lexical", 6).alias("lexical"))


@query(f"WITH {S.DOC}, {bm25_sql('doc', CONTENT, stemmed=False)} {ORACLE_TOP}")
def bm25_plain_words(spark, d):
    """bm25_content_top10 of words as they are."""
    return lexical.top_k(_doc_hits(spark, d, CONTENT, lemmas=False, stemmed=False), "lexical", 10, F.asc("index")).select("query_id", "doc_id", F.round("lexical", 6).alias("lexical"))


@query(f"WITH {S.DOC}, {bm25_sql('doc', FIVE)} SELECT query_id, idx AS doc_id, round(lexical, 6) AS lexical FROM lex")
def bm25_multifield(spark, d):
    return _doc_hits(spark, d, FIVE).select("query_id", "doc_id", F.round("lexical", 6).alias("lexical"))


@query(f"WITH {S.DOC}, {bm25_sql('doc', FIVE)} SELECT query_id, idx AS doc_id, matched_terms, match_sources FROM lex")
def match_sources(spark, d):
    return _doc_hits(spark, d, FIVE).select("query_id", "doc_id", F.array_join("matched_terms", " ").alias("matched_terms"), F.array_join("match_sources", " ").alias("match_sources"))


@query(f"WITH {S.DOC}, {bm25_sql('doc', CONTENT)} SELECT query_id, idx AS doc_id, round(lexical, 6) AS lexical FROM lex WHERE idx IN (SELECT idx FROM doc WHERE list_contains(tags, 'en') AND importance >= 0.5)")
def bm25_candidates(spark, d):
    some = S.document_records(spark, d).where(F.array_contains("tags", "en") & (F.col("importance") >= 0.5)).select("chain_key", "index")
    return _doc_hits(spark, d, CONTENT, candidates=some).select("query_id", "doc_id", F.round("lexical", 6).alias("lexical"))


EVENT_TEXTS = [(1, "click error"), (2, "views"), (3, "signup purchases")]


@query(f"""WITH {S.EVT}, qt(query_id, term) AS (VALUES {_values((i, t) for i, text in EVENT_TEXTS for t in query_stems(text))}),
tok AS (SELECT idx, list_transform({TOK.format("content")}, lambda t: CASE t WHEN 'purchase' THEN 'purchas' ELSE t END) AS t FROM evt), one AS (SELECT count(*)::DOUBLE AS n, avg(len(t)) AS a FROM tok),
df AS (SELECT term, count(*)::DOUBLE AS df FROM tok, (SELECT DISTINCT term FROM qt) WHERE list_contains(t, term) GROUP BY term),
lex AS (SELECT query_id, idx, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * len(t) / greatest(a, 1.0)))) AS lexical FROM tok, one, qt JOIN df USING (term) WHERE list_contains(t, term) AND NOT (n >= 20 AND df / n > 0.3) GROUP BY ALL)
SELECT query_id, id, round(lexical, 6) AS lexical, r::INT AS rank, total FROM (SELECT query_id, id, lexical, row_number() OVER (PARTITION BY query_id ORDER BY lexical DESC, importance DESC, coalesce(confidence, 0) DESC, ts DESC, idx DESC) AS r, count(*) OVER (PARTITION BY query_id) AS total FROM lex JOIN evt USING (idx)) WHERE r BETWEEN 6 AND 30""")
def lexical_search(spark, d):
    """Ranks 6 to 30 in the five-key order; scores of events tie often."""
    q = spark.createDataFrame(EVENT_TEXTS, "query_id int, text string")
    found = lexical.search(q, S.event_records(spark, d), k=25, offset=5, fields=CONTENT)
    return found.select("query_id", "id", F.round("lexical", 6).alias("lexical"), "rank", "total")


@query(f"WITH {S.DOC} SELECT term, count(*) AS df FROM (SELECT DISTINCT idx, unnest({TOK.format('content')}) AS term FROM doc) GROUP BY term")
def postings_stats(spark, d):
    posts = lexical.postings(lexical.field_tokens(S.document_records(spark, d), CONTENT), CONTENT)
    return lexical.document_frequency(posts).select("term", "df")


@query(f"WITH {S.DOC}, t AS (SELECT DISTINCT idx, unnest({TOK.format('content')}) AS term FROM doc), n AS (SELECT count(*)::DOUBLE AS n FROM doc) SELECT term, round(count(*) / max(n), 6) AS share, round(ln((max(n) - count(*) + 0.5) / (count(*) + 0.5) + 1), 6) AS idf FROM t, n GROUP BY term HAVING count(*) / max(n) > 0.3")
def df_gate_terms(spark, d):
    posts = cut(lexical.postings(lexical.field_tokens(S.document_records(spark, d), CONTENT), CONTENT))
    df = lexical.document_frequency(posts).join(lexical.corpus_stats(lexical.lengths(posts, CONTENT), CONTENT), "chain_key")
    return df.where((F.col("n_docs") >= lexical.GATE_FROM) & (F.col("df") / F.col("n_docs") > lexical.CUTOFFS["content"])).select("term", F.round(F.col("df") / F.col("n_docs"), 6).alias("share"), F.round(lexical.idf(F.col("n_docs"), F.col("df")), 6).alias("idf"))


# Filters


def _ids(df: DataFrame) -> DataFrame:
    return df.select("id", "index")


def _filter_sql(where: str) -> str:
    return f"WITH {S.EVT}, {S.AGENTS} SELECT evt.id, evt.idx AS \"index\" FROM evt LEFT JOIN agents USING (agent_id) WHERE {where}"


def _events(spark, d, **kw):
    return _ids(filters.apply(S.event_records(spark, d), filters.Query(**kw), S.event_agents(spark, d)))


@query(_filter_sql("thought_type IN ('Decision', 'Mistake') AND (list_contains(list_transform(tags, lambda t: contains(lower(t), 'urch')), true) OR list_contains(list_transform(tags, lambda t: contains(lower(t), 'sess')), true))"))
def filter_types_tags(spark, d):
    return _events(spark, d, types=["Decision", "Mistake"], tags_any=[" URCH ", "", "sess"])


@query(_filter_sql("list_contains(list_transform(concepts, lambda t: contains(lower(t), 'k1')), true) AND agent_id IN ('3', '7', '11')"))
def filter_concepts_agents(spark, d):
    return _events(spark, d, concepts_any=["K1"], agent_ids=["3", "7", "11"])


@query(_filter_sql("contains(lower(content), 'team3') OR contains(lower(coalesce(display_name, '') || chr(10) || coalesce(owner, '') || chr(10) || coalesce(alias, '')), 'team3') OR contains(lower(evt.agent_id), 'team3')"))
def filter_text_contains(spark, d):
    return _events(spark, d, text_contains="Team3")


@query(_filter_sql("lower(display_name) = 'user 3' OR lower(alias) = 'u7'"))
def filter_agent_names(spark, d):
    return _events(spark, d, agent_names=["user 3", "U7"])


@query(_filter_sql("lower(owner) IN ('team1', 'team4')"))
def filter_agent_owners(spark, d):
    return _events(spark, d, agent_owners=["TEAM1", "team4"])


@query(_filter_sql("ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts <= TIMESTAMP '2024-01-06 00:00:00.999999'"))
def filter_time_window(spark, d):
    since, until = filters.time_window(datetime(2024, 1, 5), 86_400, "seconds")
    return _events(spark, d, since=since, until=until)


@query(_filter_sql("importance >= 0.5 AND confidence >= 0.4 AND entity_type = 'click'"))
def filter_scores_entity(spark, d):
    return _events(spark, d, min_importance=0.5, min_confidence=0.4, entity_type="click")


@query(_filter_sql("source_episode = 'ep7' AND list_contains(list_transform(tags, lambda t: contains(lower(t), 'scope:user')), true)"))
def filter_episode_scope(spark, d):
    return _events(spark, d, source_episode="ep7", scope="user")


@query(_filter_sql("thought_type = 'Mistake'") + ' ORDER BY evt.idx DESC LIMIT 25')
def filter_newest_tail(spark, d):
    return _events(spark, d, types=["Mistake"], limit=25)


# Lookup, traversal, listing


@query(f"WITH {S.EVT} SELECT id, idx AS \"index\", row_number() OVER (ORDER BY idx)::INT AS page_rank, true AS has_more, last(id) OVER (ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS next_cursor, first(id) OVER (ORDER BY idx) AS previous_cursor FROM (SELECT * FROM evt WHERE idx >= 100 AND thought_type = 'Finding' ORDER BY idx LIMIT 20) ORDER BY idx")
def traverse_forward_page(spark, d):
    evt = S.event_records(spark, d)
    return traverse.page(evt.where("thought_type = 'Finding'"), traverse.anchor_index(evt, "id", "evt:100"), True, True, 20).select("id", "index", "page_rank", "has_more", "next_cursor", "previous_cursor")


@query(f"WITH {S.EVT} SELECT id, idx AS \"index\", row_number() OVER (ORDER BY idx DESC)::INT AS page_rank, true AS has_more FROM evt WHERE idx < (SELECT max(idx) FROM evt) ORDER BY idx DESC LIMIT 15")
def traverse_backward_page(spark, d):
    evt = S.event_records(spark, d)
    return traverse.page(evt, traverse.anchor_index(evt, "head"), False, False, 15).select("id", "index", "page_rank", "has_more")


@query(f"WITH {S.EVT}, t AS (SELECT count(*) AS total FROM evt) SELECT id, idx AS \"index\", total, ceil(total / 30.0)::BIGINT AS pages FROM evt, t ORDER BY idx DESC LIMIT 30 OFFSET 60")
def listing_page(spark, d):
    return traverse.listing(S.event_records(spark, d), 3, 30).select("id", "index", "total", "pages")


@query(f"WITH {S.CONV}, r AS (SELECT *, row_number() OVER (PARTITION BY chain_key, agent_id ORDER BY idx DESC) AS k FROM conv) SELECT chain_key, agent_id, count(*) AS n, string_agg('[#' || idx || '] ' || thought_type || ': ' || content, chr(10) ORDER BY idx) AS context FROM r WHERE k <= 2 GROUP BY ALL")
def recent_context_by_agent(spark, d):
    return traverse.recent_context(S.conversation_records(spark, d), 2, per_agent=True)


@query(f"WITH {S.CONV} SELECT chain_key, arg_min(id, idx) AS genesis_id, arg_max(id, idx) AS head_id, count(*) AS count FROM conv GROUP BY chain_key")
def genesis_and_head(spark, d):
    return traverse.genesis_and_head(S.conversation_records(spark, d))


@query(f"WITH {S.CONV} SELECT id, content FROM conv WHERE chain_key = '7' AND idx = 1")
def point_lookup(spark, d):
    return traverse.lookup(S.conversation_records(spark, d), chain_key="7", index=1).select("id", "content")


EDGES_SQL = f"""{S.CONV}, rel AS (
  SELECT chain_key, id AS src, md5('conv:' || conv_id || ':' || (turn - 1)) AS dst, 'ContinuesFrom' AS kind FROM conv WHERE turn > 0
  UNION ALL SELECT chain_key, id, md5('conv:' || conv_id || ':' || (turn - 2)), 'Corrects' FROM conv WHERE turn % 5 = 4
  UNION ALL SELECT c.chain_key, c.id, z.id, NULL FROM conv c JOIN conv z ON z.chain_key = c.chain_key AND z.idx = 0 WHERE c.turn > 2),
edges AS (SELECT chain_key, src, dst, string_agg(DISTINCT kind, ' ' ORDER BY kind) AS kinds, bool_or(kind IS NULL) AS by_ref, count(DISTINCT coalesce(kind, ''))::INT AS n_sources FROM rel GROUP BY ALL),
arcs AS (SELECT chain_key, src AS node, dst AS next, kinds FROM edges UNION ALL SELECT chain_key, dst, src, kinds FROM edges)"""
REACH_SQL = f"""{EDGES_SQL}, s AS (SELECT chain_key, id AS seed FROM conv WHERE turn = 3),
d1 AS (SELECT DISTINCT s.chain_key, seed, next AS node FROM s JOIN arcs a ON a.chain_key = s.chain_key AND a.node = seed WHERE next <> seed),
d2 AS (SELECT DISTINCT d1.chain_key, seed, next AS node FROM d1 JOIN arcs a ON a.chain_key = d1.chain_key AND a.node = d1.node WHERE next <> seed),
reach AS (SELECT *, 1 AS depth FROM d1 UNION ALL SELECT d2.*, 2 FROM d2 WHERE NOT EXISTS (SELECT 1 FROM d1 WHERE d1.seed = d2.seed AND d1.node = d2.node))"""


@query(f"WITH RECURSIVE {EDGES_SQL}, c(chain_key, target, id) AS (SELECT chain_key, id, id FROM conv WHERE turn = 5 UNION SELECT c.chain_key, c.target, e.dst FROM c JOIN edges e ON e.chain_key = c.chain_key AND e.src = c.id JOIN conv v ON v.id = e.dst) SELECT * FROM c")
def context_closure(spark, d):
    conv = S.conversation_records(spark, d)
    return traverse.closure(conv, conv.where("index = 5"))


@query(f"""WITH RECURSIVE {EDGES_SQL}, c(chain_key, target, id) AS (SELECT chain_key, id, id FROM conv WHERE turn = 5 UNION SELECT c.chain_key, c.target, e.dst FROM c JOIN edges e ON e.chain_key = c.chain_key AND e.src = c.id JOIN conv v ON v.id = e.dst)
SELECT c.chain_key, c.target, string_agg('[#' || idx || '] ' || thought_type || ': ' || content, chr(10) ORDER BY idx) AS prompt FROM c JOIN conv v ON v.id = c.id GROUP BY ALL""")
def bootstrap_prompt(spark, d):
    conv = S.conversation_records(spark, d)
    return lifecycle.bootstrap_prompt(traverse.closure(conv, conv.where("index = 5")), conv)


LINKS = 500


@query(f"WITH RECURSIVE n AS (SELECT range AS i FROM range({LINKS})), c(target, i) AS (SELECT {LINKS - 1}, {LINKS - 1} UNION SELECT target, i - 1 FROM c WHERE i > 0) SELECT 'long' AS chain_key, 'r' || target AS target, 'r' || i AS id FROM c")
def closure_of_a_long_chain(spark, d):
    """Everything that the last of 500 records, each a continuation of the one before, leads to."""
    i = F.col("index")
    rows = spark.range(LINKS).select(F.lit("long").alias("chain_key"), F.col("id").alias("index")).withColumn("id", F.concat(F.lit("r"), i.cast("string")))
    rel = F.when(i > 0, F.array(S.relation(F.lit("ContinuesFrom"), F.concat(F.lit("r"), (i - 1).cast("string"))))).otherwise(F.array().cast(f"array<{S.RELATION}>"))
    rows = rows.withColumns({"refs": F.array().cast("array<bigint>"), "relations": rel})
    return traverse.closure(rows, rows.where(i == LINKS - 1))


@query(f"WITH {S.DOC}, stems(word, term) AS (VALUES {_values(r for r in stem_table() if r[1] == 'resh')}) SELECT idx AS \"index\", count(*)::INT AS tf FROM (SELECT idx, unnest({TOK.format('content')}) AS word FROM doc) JOIN stems USING (word) GROUP BY idx")
def term_postings(spark, d):
    return lifecycle.term_postings(S.document_records(spark, d), "Reshes!").select("index", "tf")


@query(f"WITH {S.CONV}, t AS (SELECT max(idx) AS top FROM conv WHERE chain_key = '8') SELECT '8' AS chain_key, top + row_number() OVER (ORDER BY idx) AS \"index\", 'copied' AS agent_id, content FROM conv, t WHERE chain_key = '7' AND agent_id = 'user'")
def copy_agent(spark, d):
    conv = S.conversation_records(spark, d).where("chain_key in ('7', '8')").select("chain_key", "index", F.when((F.col("chain_key") == "7") & (F.col("agent_id") == "user"), "copied").otherwise(F.col("agent_id")).alias("agent_id"), "content")
    return lifecycle.copy_agent(conv, "copied", "7", "8")


@query(f"WITH {S.CONV}, t AS (SELECT chain_key, count(*) AS n FROM conv GROUP BY chain_key) SELECT chain_key, chain_key::INT % 3 = 0 AS fresh FROM t")
def index_freshness(spark, d):
    conv = S.conversation_records(spark, d)
    third = F.col("chain_key").cast("int") % 3
    meta = conv.groupBy("chain_key").agg(F.count("*").alias("n"), F.max_by("id", "index").alias("head_id")).where(third < 2).select("chain_key", F.lit(lifecycle.NORMALIZER).alias("normalizer"), F.when(third == 1, F.col("n") - 1).otherwise(F.col("n")).alias("n"), "head_id")
    return lifecycle.index_freshness(meta, conv)


# Graph


@query(f"WITH {EDGES_SQL} SELECT chain_key, src, dst, coalesce(kinds, '') AS kinds, by_ref, n_sources AS sources FROM edges")
def graph_edges(spark, d):
    return graph.adjacency(S.conversation_records(spark, d)).select("chain_key", "src", "dst", F.array_join("kinds", " ").alias("kinds"), "by_ref", F.size("provenances").alias("sources"))


def _expansion(spark, d):
    conv = S.conversation_records(spark, d)
    seeds = conv.where("index = 3").select(F.lit(1).alias("query_id"), "chain_key", "id", F.lit(1.0).alias("lexical"))
    return conv, seeds, graph.expand(seeds, graph.adjacency(conv))


@query(f"WITH {REACH_SQL} SELECT chain_key, seed, node, depth FROM reach")
def graph_bfs_depth2(spark, d):
    return _expansion(spark, d)[2].select("chain_key", "seed", "node", "depth")


@query(f"WITH {REACH_SQL} SELECT r.chain_key, r.node, round(max(CASE WHEN contains(kinds, 'ContinuesFrom') THEN 0.6 WHEN contains(kinds, 'Corrects') THEN 0.5 ELSE 0 END), 6)::DOUBLE AS relation FROM reach r JOIN edges a ON a.chain_key = r.chain_key AND (a.src = r.seed AND a.dst = r.node) WHERE depth = 1 GROUP BY ALL")
def graph_relation_score(spark, d):
    conv, seeds, _ = _expansion(spark, d)
    out = graph.expand(seeds, graph.adjacency(conv), max_depth=1, direction="out")
    return out.select("chain_key", "node", F.round(graph.relation_score(F.col("kinds"), F.col("depth")), 6).alias("relation"))


@query(f"WITH {EDGES_SQL}, s AS (SELECT chain_key, id AS seed FROM conv WHERE turn IN (1, 3, 4)), d1 AS (SELECT DISTINCT s.chain_key, seed, next AS node FROM s JOIN arcs a ON a.chain_key = s.chain_key AND a.node = seed WHERE next NOT IN (SELECT seed FROM s)) SELECT chain_key, node AS id, count(*) AS seed_paths, round(least(count(*) - 1, 5) * 0.2, 6)::DOUBLE AS seed_support FROM d1 GROUP BY ALL")
def graph_seed_support(spark, d):
    conv = S.conversation_records(spark, d)
    seeds = conv.where("index in (1, 3, 4)").select(F.lit(1).alias("query_id"), "chain_key", "id")
    hits = graph.graph_hits(graph.expand(seeds, graph.adjacency(conv), max_depth=1), seeds)
    return hits.select("chain_key", "id", "seed_paths", F.round("seed_support", 6).alias("seed_support"))


@query(f"WITH {REACH_SQL} SELECT s.chain_key, s.seed, coalesce(string_agg(depth || ':' || idx, ' ' ORDER BY depth, idx), '') AS support FROM s LEFT JOIN reach r ON r.seed = s.seed LEFT JOIN conv c ON c.id = r.node WHERE r.node IS NULL OR c.id IS NOT NULL GROUP BY ALL")
def context_bundles(spark, d):
    conv, seeds, found = _expansion(spark, d)
    item = lambda x: F.concat(x["depth"].cast("string"), F.lit(":"), x["index"].cast("string"))
    return graph.bundles(seeds, found, conv).select("chain_key", "seed", F.array_join(F.transform("support", item), " ").alias("support"))


# Vectors


def _vectors(spark, d):
    v = spark.read.parquet(f"{d}/embeddings.parquet").select(F.concat(F.lit("v"), F.lpad(F.col("vec_id").cast("string"), 9, "0")).alias("thought_id"), "vec_id", F.col("embedding").alias("vector"))
    return v, v.where("vec_id % 97 = 0").select(F.col("vec_id").alias("query_id"), F.col("vector").alias("query_vector"))


COSINE_SQL = "c AS (SELECT q.vec_id AS query_id, 'v' || lpad(v.vec_id::VARCHAR, 9, '0') AS thought_id, list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score FROM embeddings v, embeddings q WHERE q.vec_id % 97 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, thought_id)::INT AS rank FROM c)"


@query(f"WITH {COSINE_SQL} SELECT query_id, thought_id, round(score, 6) AS score, rank FROM r WHERE rank <= 10")
def cosine_topk(spark, d):
    v, q = _vectors(spark, d)
    return vector.cosine_top_k(q, v, 10).select("query_id", "thought_id", F.round("score", 6).alias("score"), "rank")


@query(f"WITH {COSINE_SQL} SELECT query_id, thought_id, round(score, 6) AS score, rank FROM r WHERE rank <= 20 AND score >= 0.3")
def cosine_min_score(spark, d):
    v, q = _vectors(spark, d)
    return vector.cosine_top_k(q, v, 20, min_score=0.3).select("query_id", "thought_id", F.round("score", 6).alias("score"), "rank")


@query(f"WITH {COSINE_SQL} SELECT query_id, thought_id, round(greatest(CASE WHEN score >= 0.04 AND rank <= 256 THEN score * 0.5 END, CASE WHEN score * 0.9 >= 0.04 AND rank <= 256 THEN score * 0.9 * 0.3 END), 6) AS vector FROM r WHERE rank <= 256 AND score >= 0.04")
def vector_fusion(spark, d):
    v, q = _vectors(spark, d)
    hits = vector.cosine_top_k(q, v, vector.CANDIDATES)
    three = [hits.select("query_id", F.lit(m).alias("model_id"), "thought_id", (F.col("score") * k).alias("score")) for m, k in (("fresh", 1.0), ("stale", 0.9), ("other", 2.0))]
    state = spark.createDataFrame([("fresh", "Fresh"), ("stale", "StaleHead"), ("other", "ModelMismatch")], "model_id string, status string")
    return vector.fused_signal(three[0].unionByName(three[1]).unionByName(three[2]), state).select("query_id", "thought_id", F.round("vector", 6).alias("vector"))


@query("SELECT label % 3 AS model, count(*) AS n, CASE WHEN label % 3 = 1 THEN 'ModelMismatch' WHEN count(*) <> 100 THEN 'StaleCount' ELSE 'Fresh' END AS status FROM embeddings GROUP BY label % 3")
def sidecar_freshness(spark, d):
    meta = spark.read.parquet(f"{d}/embeddings.parquet").groupBy((F.col("label") % 3).alias("model")).agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("dim"))
    meta = meta.select("model", "n", "dim", F.lit("c").alias("chain_key"), F.when(F.col("model") == 1, "x").otherwise("m").alias("model_id"), F.lit("v1").alias("version"), F.lit("h").alias("head_hash"))
    return vector.freshness(meta, "c", "m", "v1", 64, 100, "h").select("model", "n", "status")


@query("SELECT count(*) AS n, count(DISTINCT vec_id) = count(*) AS unique_ids, coalesce(bool_and(vec_id > before), true) AS ordered, true AS intact, count(*) = 0 AS changed_intact FROM (SELECT vec_id, lag(vec_id) OVER () AS before FROM embeddings)")
def sidecar_integrity(spark, d):
    """The table as it is against its own digest, and with one vector changed."""
    v = _vectors(spark, d)[0].withColumnRenamed("vec_id", "index")
    known = vector.digest(v)
    changed = v.withColumn("vector", F.when(F.col("index") == 1, F.array(F.lit(0.5).cast("float"))).otherwise(F.col("vector")))
    other = vector.integrity(changed, known).select(F.col("intact").alias("changed_intact"))
    return vector.integrity(v, known).select("n", "unique_ids", "ordered", "intact").crossJoin(F.broadcast(other))  # one row with one row


QUERY_VECTOR_SQL = f"WITH {S.CONV}, c AS (SELECT id, content, [len(content)::DOUBLE, len(replace(content, 'e', ''))::DOUBLE, 40.0::DOUBLE] AS v FROM conv WHERE agent_id = 'user'), q AS (SELECT query_id, [len(text)::DOUBLE, len(replace(text, 'e', ''))::DOUBLE, 40.0::DOUBLE] AS v FROM (VALUES {_values(TEXTS[:3])}) t(query_id, text)), s AS (SELECT query_id, id, list_cosine_similarity(c.v, q.v) AS score FROM c, q), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM s) SELECT query_id, id AS thought_id, round(score, 6) AS score, rank FROM r WHERE rank <= 10 AND score >= 0.995"


@query(QUERY_VECTOR_SQL)
def query_vector(spark, d):
    """Vector search with a filter and a provider of three numbers; the fourth text is blank."""

    @F.pandas_udf("array<float>")
    def shape(texts_: pd.Series) -> pd.Series:
        return texts_.map(lambda t: [float(len(t)), float(len(t.replace("e", ""))), 40.0])

    provider = vector.Provider("shape", "v1", 3, shape)
    conv = S.conversation_records(spark, d)
    side = vector.build_sidecar(conv, provider, text=F.col("content"))
    q = spark.createDataFrame([*TEXTS[:3], (9, "  ")], "query_id int, text string")
    fit = filters.apply(conv, filters.Query(agent_ids=["user"])).select(F.col("id").alias("thought_id"))
    return vector.query_vector(q, side, provider, k=10, min_score=0.995, allowed=fit).select("query_id", "thought_id", F.round("score", 6).alias("score"), "rank")


@query()
def hashed_text_embedding(spark, d):
    return S.conversation_records(spark, d).select("id", hashed_embedding(F.col("content")).alias("vector"))


@query(f"WITH {S.EVT} SELECT id, content || chr(10) || 'Concepts: ' || array_to_string(concepts, ', ') || chr(10) || 'Tags: ' || array_to_string(tags, ', ') || chr(10) || 'Agent: ' || agent_id AS text FROM evt")
def embedding_text(spark, d):
    return S.event_records(spark, d).select("id", vector.embedding_text(F.col("content"), F.col("concepts"), F.col("tags"), F.col("agent_id")).alias("text"))


# Ranking

RANKED_SQL = f"""WITH {S.DOC}, {bm25_sql('doc', FIVE)}, cand AS (SELECT query_id, d.* FROM doc d, q),
ranked AS (SELECT c.query_id, c.idx, c.tags, c.importance, c.confidence, l.lexical, CASE WHEN l.lexical > 0 THEN l.lexical * (importance - 0.5) * 0.3 ELSE (importance - 0.5) * 0.1 END AS imp,
  coalesce(confidence, 0) * 0.1 AS conf, idx / greatest((SELECT max(idx) FROM doc), 1)::DOUBLE * 0.05 AS recency FROM cand c JOIN lex l USING (query_id, idx)),
tot AS (SELECT *, lexical + imp + conf + recency AS total FROM ranked)"""


def _ranked(spark, d, allowed=None):
    return ranking.combine(S.document_records(spark, d), cut(_doc_hits(spark, d, FIVE)), allowed=allowed)


@query(f"{RANKED_SQL} SELECT query_id, idx AS doc_id, round(total, 6) AS total FROM tot WHERE list_contains(tags, 'de') AND importance >= 0.3")
def ranked_filtered(spark, d):
    """Totals of hits that fit a filter: statistics and recency stay those of the whole chain."""
    fit = filters.apply(S.document_records(spark, d), filters.Query(tags_any=["de"], min_importance=0.3)).select("chain_key", "index")
    return _ranked(spark, d, fit).select("query_id", F.col("index").alias("doc_id"), F.round("total", 6).alias("total"))


@query(f"WITH {S.DOC} SELECT 1 AS query_id, idx AS doc_id, round((importance - 0.5) * 0.1 + coalesce(confidence, 0) * 0.1 + idx / greatest((SELECT max(idx) FROM doc), 1)::DOUBLE * 0.05, 6) AS total FROM doc")
def ranked_without_text(spark, d):
    docs = S.document_records(spark, d)
    return ranking.combine(docs, queries=spark.createDataFrame([(1,)], "query_id int")).select("query_id", F.col("index").alias("doc_id"), F.round("total", 6).alias("total"))


@query(f"{RANKED_SQL} SELECT query_id, idx AS doc_id, round(total, 6) AS total, r::INT AS rank, n AS total_candidates FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY total DESC, lexical DESC, importance DESC, coalesce(confidence, 0) DESC, idx DESC) AS r, count(*) OVER (PARTITION BY query_id) AS n FROM tot) WHERE r <= 20")
def ranked_additive_total(spark, d):
    return ranking.best(_ranked(spark, d), 20).select("query_id", F.col("index").alias("doc_id"), F.round("total", 6).alias("total"), "rank", "total_candidates")


COHESION_SQL = f"""{RANKED_SQL}, near AS (SELECT *, max(CASE WHEN lexical >= 3 THEN idx END) OVER (PARTITION BY query_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS b,
  min(CASE WHEN lexical >= 3 THEN idx END) OVER (PARTITION BY query_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS a FROM tot),
coh AS (SELECT *, CASE WHEN lexical < 5 AND least(idx - b, a - idx) BETWEEN 1 AND 12 THEN 1.2 * (1 - least(idx - b, a - idx) / 12.0::DOUBLE) ELSE 0 END AS cohesion FROM near)"""


@query(f"{COHESION_SQL} SELECT query_id, idx AS doc_id, round(cohesion, 6) AS cohesion, round(total + cohesion, 6) AS total FROM coh")
def session_cohesion(spark, d):
    return ranking.cohesion(_ranked(spark, d)).select("query_id", F.col("index").alias("doc_id"), F.round("cohesion", 6).alias("cohesion"), F.round("total", 6).alias("total"))


@query(f"""{COHESION_SQL}, rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY lexical DESC, idx) AS r1, row_number() OVER (PARTITION BY query_id ORDER BY idx) AS r2 FROM coh),
f AS (SELECT *, (CASE WHEN r1 <= 50 THEN 1.0::DOUBLE / (60 + r1) ELSE 0 END) + 2 * (CASE WHEN r2 <= 50 THEN 1.0::DOUBLE / (60 + r2) ELSE 0 END) AS rrf FROM rk)
SELECT query_id, idx AS doc_id, round(rrf, 6) AS rrf, round(CASE WHEN r1 <= 50 OR r2 <= 50 THEN rrf + imp + conf + recency + cohesion ELSE total + cohesion END, 6) AS total FROM f""")
def rrf_three_list(spark, d):
    hits = ranking.rrf(ranking.cohesion(_ranked(spark, d)))
    return hits.select("query_id", F.col("index").alias("doc_id"), F.round("rrf", 6).alias("rrf"), F.round("total", 6).alias("total"))


@query()
def ranked_hybrid_graph(spark, d):
    """All signals at once: lexical, hashed vectors, graph from the 20 best lexical hits, cohesion, fusion."""
    conv = S.conversation_records(spark, d)
    q = texts(spark)
    lex = cut(lexical.bm25(q, conv, FOUR))
    vec = vector.fused_signal(vector.query_vector(q, vector.build_sidecar(conv), k=vector.CANDIDATES).withColumn("model_id", F.lit("hashed")), spark.createDataFrame([("hashed", "Fresh")], "model_id string, status string"))
    ids = conv.select("chain_key", "index", "id")
    seeds = cut(lexical.top_k(lex, "lexical", 20, F.asc("chain_key"), F.asc("index")).join(ids, ["chain_key", "index"]).select("query_id", "chain_key", "id", "lexical"))
    links = graph.graph_hits(graph.expand(seeds, graph.adjacency(conv)), seeds)
    rows = ranking.rrf(ranking.cohesion(ranking.combine(conv, lex, vec, links)))
    return ranking.best(rows, 10).select("query_id", "chain_key", "index", "rank", F.round("total", 6).alias("total"), "total_candidates")


@query(f"WITH {S.DOC}, {bm25_sql('doc', CONTENT)}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY lexical DESC, idx) AS r FROM lex), gold AS (SELECT query_id, arg_min(idx, idx) AS idx FROM lex GROUP BY query_id), b AS (SELECT g.query_id, r.r FROM gold g LEFT JOIN r ON r.query_id = g.query_id AND r.idx = g.idx) SELECT round(avg((r <= 5)::INT), 6) AS r_5, round(avg((r <= 10)::INT), 6) AS r_10, round(avg((r <= 20)::INT), 6) AS r_20 FROM b")
def recall_at_k(spark, d):
    hits = cut(_doc_hits(spark, d, CONTENT).select("query_id", F.col("index").alias("id"), "lexical"))
    gold = hits.groupBy("query_id").agg(F.min("id").alias("id"))
    ranked = lexical.top_k(hits, "lexical", 20, F.asc("id"))
    return registry.recall_at(ranked, gold).select(*[F.round(c, 6).alias(c) for c in ("r_5", "r_10", "r_20")])


# Time, duplicates, integrity


@query(f"WITH {EDGES_SQL}, past AS (SELECT * FROM conv WHERE idx <= 4) SELECT chain_key, id FROM past WHERE id NOT IN (SELECT dst FROM rel r JOIN past p ON p.id = r.src WHERE kind = 'Corrects')")
def as_of_candidates(spark, d):
    return temporal.as_of(S.conversation_records(spark, d), upto=4).select("chain_key", "id")


@query(f"WITH {EDGES_SQL} SELECT DISTINCT chain_key, dst AS id FROM rel WHERE kind = 'Corrects'")
def invalidated_set(spark, d):
    return temporal.invalidated(S.conversation_records(spark, d))


@query(f"""WITH {S.CONV}, w AS (SELECT chain_key, idx, id, list_distinct({TOK.format('content')}) AS w FROM conv), p AS (
  SELECT a.chain_key, a.idx, b.id AS old, b.idx AS old_idx, len(list_intersect(a.w, b.w))::DOUBLE / len(list_distinct(list_concat(a.w, b.w))) AS s FROM w a JOIN w b ON a.chain_key = b.chain_key AND b.idx < a.idx AND b.idx >= a.idx - 64 WHERE len(a.w) > 0 AND len(b.w) > 0)
SELECT chain_key, idx AS "index", round(s, 6) AS similarity, old AS supersedes FROM (SELECT *, row_number() OVER (PARTITION BY chain_key, idx ORDER BY s DESC, old_idx) AS r FROM p WHERE s >= 0.05) WHERE r = 1""")
def near_duplicate_words(spark, d):
    """near_duplicate_jaccard of words as they are."""
    return commit.recent_duplicates(S.conversation_records(spark, d), 0.05, words=commit.plain_words()).withColumn("similarity", F.round("similarity", 6))


@query()
def near_duplicate_jaccard(spark, d):
    return commit.recent_duplicates(S.conversation_records(spark, d), 0.05).withColumn("similarity", F.round("similarity", 6))


@query(f"WITH {S.CONV}, t AS (SELECT chain_key, count(*) AS n, max(idx) AS top FROM conv GROUP BY chain_key) SELECT chain_key, n, n <= 3 AS ok, CASE WHEN n > 3 THEN 3 END AS first_bad FROM t")
def verify_chain(spark, d):
    chained = commit.chain_hashes(S.conversation_records(spark, d))
    broken = chained.withColumn("content", F.when(F.col("index") == 3, F.concat("content", F.lit("."))).otherwise(F.col("content")))
    return commit.verify(broken)


@query(f"""WITH {S.EVT} SELECT idx AS "index", trim(upper(entity_type)) || '|scope' AS tags, least(1.0, importance * 2)::DOUBLE AS importance, entity_type,
CASE WHEN idx % 10 = 0 THEN 'Supports:x' ELSE '' END || CASE WHEN idx > 0 THEN ' References:evt:' || (idx - 1) ELSE '' END || CASE WHEN idx > 40 THEN ' References:evt:' || (idx // 3) ELSE '' END AS relations, idx % 100 = 7 AS bad_refs FROM evt""")
def commit_normalise(spark, d):
    """Every event as it would be appended after event 0 to 9 are in the log."""
    evt = S.event_records(spark, d).withColumns({"seq": F.col("index"), "importance": F.col("importance") * 2, "entity_type": F.concat(F.lit(" "), F.col("entity_type"), F.lit(" "))})
    evt = evt.withColumn("tags", F.array(F.upper("entity_type"), F.trim("entity_type"), F.lit(" "), F.lit("scope"), F.lit("SCOPE")))
    i = F.col("index")
    evt = evt.withColumn("refs", F.array_sort(F.array_compact(F.array(F.when(i > 40, F.floor(i / 3)), F.when(i > 0, i - 1), F.when(i > 0, i - 1), F.when(i % 100 == 7, i + 5)))))
    evt = evt.withColumn("relations", F.when(i % 10 == 0, F.array(S.relation(F.lit("Supports"), F.lit("x")), S.relation(F.lit("Supports"), F.lit("x")))).otherwise(F.array().cast(f"array<{S.RELATION}>")))
    done, log = evt.where("index >= 10"), evt.where("index < 10")
    made = commit.normalise(log).unionByName(commit.normalise(done, log.select("chain_key", "index", "id")))
    order = F.sort_array(F.transform("relations", lambda r: F.struct((r["kind"] == "References").alias("later"), (-F.regexp_extract(r["target_id"], r"(\d+)$", 1).try_cast("bigint")).alias("back"), F.concat(r["kind"], F.lit(":"), r["target_id"]).alias("t"))))
    text = F.concat_ws("", F.transform(order, lambda x: F.concat(F.when(x["later"], " ").otherwise(""), x["t"])))
    dated = F.forall("relations", lambda r: r["valid_at"].isNotNull())
    return made.where(dated).select("index", F.array_join("tags", "|").alias("tags"), F.round("importance", 6).alias("importance"), "entity_type", text.alias("relations"), "bad_refs")


@query(f"WITH {S.CONV}, t AS (SELECT chain_key, count(*) AS n, max(idx) AS head_index, arg_max(id, idx) AS head_id, arg_max(content, idx) AS latest FROM conv GROUP BY chain_key) SELECT *, true AS ok FROM t")
def head_report(spark, d):
    return commit.head_report(commit.chain_hashes(S.conversation_records(spark, d))).select("chain_key", "n", "head_index", "head_id", "latest", "ok")


# Registries, catalog


@query(f"WITH {S.CONV} SELECT chain_key, count(*) AS n, count(DISTINCT agent_id) AS agents, arg_max(id, idx) AS head_id FROM conv GROUP BY chain_key")
def chain_summary(spark, d):
    return federation.catalog(S.conversation_records(spark, d))


@query(f"WITH {S.EVT}, {S.AGENTS} SELECT agent_id, count(*) AS n, min(idx) AS first_index, max(idx) AS last_index, any_value(display_name) AS display_name, any_value(owner) AS owner FROM evt JOIN agents USING (agent_id) GROUP BY agent_id")
def agent_counts(spark, d):
    return registry.agent_counts(S.event_records(spark, d), S.event_agents(spark, d)).drop("chain_key")


TWO_AGENTS = """two AS (SELECT user_id % 2 || '' AS chain_key, event_id AS idx, (user_id % 10) || '' AS agent_id, event_type FROM events),
names AS (SELECT DISTINCT chain_key, agent_id, CASE WHEN agent_id::INT % 3 > 0 THEN 'Name ' || (agent_id::INT * 7 % 10) || ' in ' || chain_key END AS display_name, 'Team' || chain_key AS owner FROM two)"""


def _two_chains(spark, d):
    """The events dealt out to two chains in which the same ten agent ids are different agents, and their registry."""
    e = spark.read.parquet(f"{d}/events.parquet")
    n = F.col("user_id") % 10
    rows = e.select((F.col("user_id") % 2).cast("string").alias("chain_key"), F.col("event_id").alias("index"), F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("id"), n.cast("string").alias("agent_id"), F.col("event_type").alias("content"), F.array().cast("array<string>").alias("tags"), F.array().cast("array<string>").alias("concepts"))
    twice = rows.unionByName(rows.withColumn("chain_key", F.when(F.col("chain_key") == "0", "1").otherwise("0")))
    agents = twice.select("chain_key", "agent_id").distinct()
    k = F.col("agent_id").cast("int")
    named = agents.select("chain_key", "agent_id", F.when(k % 3 > 0, F.concat(F.lit("Name "), (k * 7 % 10).cast("string"), F.lit(" in "), "chain_key")).alias("display_name"), F.concat(F.lit("Team"), "chain_key").alias("owner"), F.lit(None).cast("string").alias("description"), F.array().cast("array<string>").alias("aliases"))
    return twice, named


TWO_SQL = TWO_AGENTS.replace("FROM events)", "FROM events UNION ALL SELECT (1 - user_id % 2) || '', event_id, (user_id % 10) || '', event_type FROM events)", 1)


@query(f"WITH {TWO_SQL} SELECT chain_key, agent_id, n, first_index, last_index, display_name, owner, row_number() OVER (PARTITION BY chain_key ORDER BY lower(coalesce(display_name, agent_id)), lower(agent_id))::INT AS place FROM (SELECT chain_key, agent_id, count(*) AS n, min(idx) AS first_index, max(idx) AS last_index FROM two GROUP BY ALL) JOIN names USING (chain_key, agent_id)")
def agents_of_all_chains(spark, d):
    """Agents of two chains with equal ids, with live counts, in the order of their names."""
    return registry.listing(*_two_chains(spark, d))


@query(f"WITH {TWO_SQL} SELECT chain_key, idx AS \"index\" FROM two JOIN names USING (chain_key, agent_id) WHERE display_name = 'Name 7 in 1' UNION ALL SELECT chain_key, idx FROM two JOIN names USING (chain_key, agent_id) WHERE owner = 'Team0' AND contains(lower(coalesce(display_name, '')), 'name 4')")
def filter_agents_of_two_chains(spark, d):
    rows, agents = _two_chains(spark, d)
    one = filters.apply(rows, filters.Query(agent_names=["name 7 IN 1"]), agents)
    two = filters.apply(rows, filters.Query(agent_owners=["team0"], text_contains="Name 4"), agents)
    return one.unionByName(two).select("chain_key", "index")


@query(f"WITH {S.EVT} SELECT entity_type, min(idx) AS first_index, max(idx) AS last_index, count(*) AS n FROM evt GROUP BY entity_type")
def entity_type_registry(spark, d):
    return registry.entity_types(S.event_records(spark, d)).drop("chain_key")


@query(f"WITH {S.EVT} SELECT agent_id, array_to_string(list_sort(list(DISTINCT thought_type)), ',') AS types, array_to_string(list_sort(list_distinct(flatten(list(tags)))), ',') AS tags FROM evt GROUP BY agent_id")
def touched_sets(spark, d):
    return registry.touched(S.event_records(spark, d), "agent_id").select("agent_id", F.array_join("types", ",").alias("types"), F.array_join("tags", ",").alias("tags"))


@query(f"WITH {S.EVT}, {S.AGENTS} SELECT idx AS \"index\", display_name AS agent_name, owner AS agent_owner, importance FROM evt JOIN agents USING (agent_id)")
def record_json(spark, d):
    j = registry.project(S.event_records(spark, d), S.event_agents(spark, d))
    t = F.from_json("json", "agent_name string, agent_owner string, importance double")
    return j.select("index", t["agent_name"].alias("agent_name"), t["agent_owner"].alias("agent_owner"), t["importance"].alias("importance"))


# Federation


def _chains(spark, d):
    docs = S.document_records(spark, d).withColumns({"chain_key": F.col("source"), "id": F.md5(F.col("content").cast("binary"))})
    hits = lexical.bm25(texts(spark), docs, CONTENT, lemmas=False).withColumnRenamed("lexical", "total")
    return hits.join(docs.select("chain_key", "index", "id"), ["chain_key", "index"]).withColumn("chain_pos", F.regexp_extract("chain_key", r"(\d+)$", 1).cast("int"))


FED_SQL = f"WITH {S.DOC}, {bm25_sql('doc', CONTENT, 'source')}, h AS (SELECT query_id, l.chain, l.idx, md5(content) AS id, regexp_extract(l.chain, '(\\d+)$', 1)::INT AS pos, lexical AS total FROM lex l JOIN doc ON doc.idx = l.idx)"


@query(f"{FED_SQL}, one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, id ORDER BY total DESC, pos, idx) AS r FROM h) WHERE r = 1) SELECT query_id, chain AS chain_key, id, idx AS \"index\", round(total, 6) AS total, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY total DESC, idx, id) AS rank FROM one) WHERE rank <= 10")
def federated_dedupe(spark, d):
    return federation.federated(_chains(spark, d), 10).select("query_id", "chain_key", "id", "index", F.round("total", 6).alias("total"), "rank")


@query(f"{FED_SQL} SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + r)), 6) AS rrf FROM (SELECT *, row_number() OVER (PARTITION BY query_id, chain ORDER BY total DESC, idx) AS r FROM h) GROUP BY ALL")
def federated_rrf(spark, d):
    return federation.federated_rrf(_chains(spark, d)).withColumn("rrf", F.round("rrf", 6))


@query("WITH RECURSIVE p AS (SELECT DISTINCT conv_id AS c, conv_id // 2 AS p FROM conversations WHERE conv_id > 0), a(c, p, n) AS (SELECT c, p, 1 FROM p UNION ALL SELECT a.c, p.p, n + 1 FROM a JOIN p ON p.c = a.p) SELECT c::VARCHAR AS chain_key, p::VARCHAR AS ancestor, n AS distance FROM a")
def ancestor_chains(spark, d):
    first = spark.read.parquet(f"{d}/conversations.parquet").select("conv_id").distinct()
    parent = F.floor(F.col("conv_id") / 2).cast("string")
    rel = F.when(F.col("conv_id") > 0, F.array(S.relation(F.lit("BranchesFrom"), F.lit("genesis"), parent))).otherwise(F.array().cast(f"array<{S.RELATION}>"))
    return federation.ancestors(first.select(F.col("conv_id").cast("string").alias("chain_key"), F.lit(0).alias("index"), rel.alias("relations")))


@query(f"""WITH RECURSIVE {S.CONV}, {bm25_sql('conv', CONTENT, 'chain_key')},
par AS (SELECT DISTINCT conv_id AS c, conv_id // 2 AS p FROM conversations WHERE conv_id > 0), anc(c, p, n) AS (SELECT c, p, 1 FROM par UNION ALL SELECT anc.c, par.p, n + 1 FROM anc JOIN par ON par.c = anc.p),
asked AS (SELECT query_id, (11 + query_id)::VARCHAR AS chain_key, 0 AS pos FROM q UNION ALL SELECT query_id, p::VARCHAR, n FROM q JOIN anc ON anc.c = 11 + query_id),
newest AS (SELECT chain_key, max(idx) AS newest FROM conv GROUP BY chain_key),
tot AS (SELECT l.query_id, a.pos, l.chain, l.idx, v.id, l.lexical, v.importance, lexical + lexical * (importance - 0.5) * 0.3 + CASE WHEN newest = 0 THEN 0.05 ELSE l.idx / greatest(newest, 1)::DOUBLE * 0.05 END AS total FROM lex l JOIN asked a ON a.query_id = l.query_id AND a.chain_key = l.chain JOIN conv v ON v.chain_key = l.chain AND v.idx = l.idx JOIN newest n ON n.chain_key = l.chain),
per AS (SELECT *, row_number() OVER (PARTITION BY query_id, chain ORDER BY total DESC, lexical DESC, importance DESC, idx DESC) AS r FROM tot)
SELECT query_id, chain AS chain_key, id, round(total, 6) AS total, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY total DESC, idx, id) AS rank FROM per WHERE r <= 9) WHERE rank BETWEEN 2 AND 9""")
def ranked_with_ancestors(spark, d):
    """Each text in its chain and all chains that one branched from: ranks 2 to 9."""
    conv, q = S.conversation_records(spark, d), texts(spark)
    first = conv.select("chain_key").distinct()
    k = F.col("chain_key").cast("int")
    start = first.select("chain_key", F.lit(0).alias("index"), F.when(k > 0, F.array(S.relation(F.lit("BranchesFrom"), F.lit("genesis"), F.floor(k / 2).cast("string")))).otherwise(F.array().cast(f"array<{S.RELATION}>")).alias("relations"))
    asked = q.withColumn("chain_key", (F.lit(11) + F.col("query_id")).cast("string"))
    return federation.ranked_over_ancestors(asked, conv, federation.ancestors(start), k=8, offset=1, fields=CONTENT).select("query_id", "chain_key", "id", F.round("total", 6).alias("total"), "rank")

@query("""WITH s AS (SELECT c_mktsegment AS a, list_distinct(string_split(c_mktsegment, '')) AS c FROM customer GROUP BY ALL), t AS (SELECT p_brand AS b, count(*) AS n, list_distinct(string_split(p_brand, '')) AS c FROM part GROUP BY ALL),
m AS (SELECT a, b, n, len(list_intersect(s.c, t.c))::DOUBLE / len(list_distinct(list_concat(s.c, t.c))) AS j FROM s, t)
SELECT a AS source_agent, b AS target_agent, round(j, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY (a = b) DESC, j DESC, n DESC, b DESC) AS r FROM m) WHERE r = 1""")
def merge_agent_mapping(spark, d):
    count = lambda t, c: spark.read.parquet(f"{d}/{t}.parquet").groupBy(F.col(c).alias("agent_id")).agg(F.count("*").alias("n"))
    return federation.map_agents(count("customer", "c_mktsegment"), count("part", "p_brand")).withColumn("similarity", F.round("similarity", 6))


@query(f"WITH {S.CONV} SELECT 'all' AS chain_key, agent_id, 1000 + row_number() OVER (ORDER BY idx) - 1 AS \"index\", content FROM conv WHERE chain_key = '7'")
def merge_chain(spark, d):
    conv = S.conversation_records(spark, d).where("chain_key = '7'")
    own = conv.groupBy("agent_id").agg(F.count("*").alias("n"))
    return federation.merge_chain(conv, federation.map_agents(own, own), "all", 1000).select("chain_key", "agent_id", "index", "content")


# Versioned documents


def _skills(spark, d):
    """Documents as skills: the whole text is the body of their one section."""
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return docs.select(
        F.concat(F.lit("skill-"), F.col("doc_id").cast("string")).alias("skill_id"), F.concat(F.lit("Skill "), "source").alias("name"), F.concat(F.lit("in "), "lang").alias("description"), F.array("lang").alias("tags"), F.array(F.upper("lang")).alias("triggers"), F.array().cast("array<string>").alias("warnings"),
        F.array(F.struct(F.lit(1).alias("level"), F.col("source").alias("heading"), F.col("text").alias("body"))).alias("sections"), F.col("doc_id").alias("updated_at"), F.when(F.col("doc_id") % 9 == 0, "Revoked").otherwise("Active").alias("status"),
        F.concat(F.lit("u"), (F.col("doc_id") % 7).cast("string")).alias("uploader_id"), F.concat(F.lit("User "), (F.col("doc_id") % 7).cast("string")).alias("uploader_name"), F.concat(F.lit("Team"), (F.col("doc_id") % 3).cast("string")).alias("uploader_owner"), F.when(F.col("doc_id") % 2 == 0, "markdown").otherwise("json").alias("format"), F.lit(1).alias("schema_version"),
    )


@query("SELECT 'skill-' || doc_id AS skill_id, doc_id AS updated_at FROM documents WHERE lang = 'de' AND doc_id % 9 <> 0 AND (contains(lower('Skill ' || source), 'heit') OR contains(lower(text), 'heit'))")
def skill_search(spark, d):
    return skills.search(_skills(spark, d), tags=["DE"], statuses=["active"], text="HEIT").select("skill_id", "updated_at")


@query("SELECT 'skill-' || doc_id AS skill_id, doc_id AS updated_at FROM documents WHERE doc_id % 7 IN (1, 3) AND doc_id % 3 = 1 AND doc_id % 2 = 0 AND doc_id BETWEEN 20 AND 700 ORDER BY doc_id DESC LIMIT 15")
def skill_search_newest(spark, d):
    """The 15 newest by uploader, owner, format, schema and time."""
    return skills.search(_skills(spark, d), uploader_ids=["U1", "u3"], uploader_owners=["TEAM1"], formats=["Markdown"], schemas=[1], since=20, until=700, limit=15).select("skill_id", "updated_at")


@query("SELECT doc_id, CASE WHEN s = '' THEN 'skill' ELSE s END AS slug FROM (SELECT doc_id, trim(regexp_replace(lower(regexp_replace(text, '[^A-Za-z0-9]+', '-', 'g')), '-+', '-', 'g'), '-') AS s FROM documents)")
def skill_slug(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", slug(F.col("text")).alias("slug"))


@query("SELECT 'skill-' || conv_id AS skill_id, max(turn) AS version, count(*) AS sections, arg_max(text, turn) AS last_body, CASE WHEN conv_id % 4 = 1 THEN 'Deprecated' WHEN conv_id % 4 = 2 THEN 'Revoked' ELSE 'Active' END AS status, true AS intact FROM conversations WHERE NOT contains(text, chr(10)) GROUP BY conv_id")
def skill_read(spark, d):
    """Newest version of every conversation as a document: a heading for each turn, its text below. Every fourth was deprecated, every fourth revoked, one of them before its last upload."""
    turns = spark.read.parquet(f"{d}/conversations.parquet").where(~F.contains("text", F.lit("\n"))).select(F.concat(F.lit("skill-"), F.col("conv_id").cast("string")).alias("skill_id"), "conv_id", "turn", F.concat(F.lit("# Turn "), F.col("turn").cast("string"), F.lit("\n"), "text", F.lit("\n")).alias("part"))
    w = Window.partitionBy("conv_id").orderBy("turn")
    versions = skills.upload(turns.select("skill_id", F.col("turn").alias("version"), F.array_join(F.collect_list("part").over(w), "\n").alias("text")))
    last = turns.groupBy("skill_id", "conv_id").agg(F.max("turn").alias("top"))
    four = F.col("conv_id") % 4
    events = last.where(four > 0).select("skill_id", (F.col("top") * 10 + F.when(four == 3, -5).otherwise(5)).alias("seq"), F.when(four == 2, "Revoked").otherwise("Deprecated").alias("status"), F.lit("said so").alias("reason"))
    uploads = turns.select("skill_id", (F.col("turn") * 10).alias("seq"))
    got = skills.read(versions, skills.status_of(events, uploads))
    return got.select("skill_id", "version", F.size("sections").alias("sections"), F.element_at("sections", -1)["body"].alias("last_body"), "status", "intact")


@query("SELECT 'skill-' || conv_id AS skill_id, turn AS version, string_agg(text, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn) AS text, true AS intact FROM conversations")
def skill_reconstruct(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    texts_ = spark.read.parquet(f"{d}/conversations.parquet").select(F.concat(F.lit("skill-"), F.col("conv_id").cast("string")).alias("skill_id"), F.col("turn").alias("version"), F.array_join(F.collect_list("text").over(w), "\n").alias("text"))
    return skills.reconstruct(skills.upload(texts_))


# Import and export

LINE_SQL = "'- [#' || idx || '] ' || thought_type || ': ' || content || ' (agent ' || agent_id || '; importance ' || printf('%.2f', importance) || CASE WHEN confidence IS NOT NULL THEN printf('; confidence %.2f', confidence) ELSE '' END || '; tags ' || array_to_string(tags, ', ') || ')'"


@query(f"WITH {S.EVT} SELECT idx AS \"index\", CASE thought_type WHEN 'UserTrait' THEN 'Identity' WHEN 'Decision' THEN 'Constraints And Decisions' WHEN 'Mistake' THEN 'Corrections' WHEN 'Finding' THEN 'Knowledge' ELSE 'Execution State' END AS section, {LINE_SQL} AS line FROM evt")
def markdown_lines(spark, d):
    return markdown.lines(S.event_records(spark, d)).select("index", "section", "line")


@query(f"WITH {S.EVT} SELECT idx AS old_index, thought_type, content, agent_id, 'Memory' AS role, round(importance, 2) AS importance, printf('%.2f', confidence)::DOUBLE AS confidence, array_to_string(tags, ', ') AS tags FROM evt")
def markdown_import(spark, d):
    text = markdown.lines(S.event_records(spark, d)).select(F.col("line").alias("value")).unionByName(spark.createDataFrame([("## Identity",), ("- broken line",), ("",)], "value string"))
    return markdown.parse(text).withColumn("tags", F.array_join("tags", ", "))


@query(f"""WITH {S.CONV}, l AS (SELECT chain_key, idx, CASE thought_type WHEN 'FactLearned' THEN 1 WHEN 'Constraint' THEN 2 ELSE 4 END AS k, CASE thought_type WHEN 'FactLearned' THEN 'Knowledge' WHEN 'Constraint' THEN 'Constraints And Decisions' ELSE 'Open Threads' END AS section, {LINE_SQL.replace("confidence", "NULL::DOUBLE")} AS line FROM conv),
s AS (SELECT chain_key, k, '## ' || section || chr(10) || chr(10) || string_agg(line, chr(10) ORDER BY idx) || chr(10) || chr(10) AS t FROM l GROUP BY chain_key, k, section), n AS (SELECT chain_key, count(*) AS n FROM conv GROUP BY chain_key)
SELECT s.chain_key, '# MEMORY' || chr(10) || chr(10) || 'Generated from `' || s.chain_key || '` with ' || max(n) || ' thought(s).' || chr(10) || chr(10) || string_agg(t, '' ORDER BY k) AS markdown FROM s JOIN n USING (chain_key) GROUP BY s.chain_key""")
def markdown_export(spark, d):
    return markdown.export(S.conversation_records(spark, d))


@query("SELECT event_id, 'Finding' AS thought_type, trim(event_type) AS content, 1.0::DOUBLE AS importance FROM events WHERE event_id % 3 = 0")
def extraction_validate(spark, d):
    return _validated(spark.read.parquet(f"{d}/events.parquet"))


def _validated(events: DataFrame) -> DataFrame:
    one = F.to_json(F.struct(F.array(F.struct(F.when(F.col("event_id") % 3 == 0, "Finding").otherwise("Nonsense").alias("thought_type"), F.concat(F.lit(" "), "event_type").alias("content"), F.lit(7.5).alias("importance")), F.struct(F.lit("Idea").alias("thought_type"), F.lit("  ").alias("content"), F.lit(0.1).alias("importance"))).alias("thoughts")))
    answers = events.select("event_id", F.when(F.col("event_id") % 3 == 1, "no json").otherwise(one).alias("answer"))
    return extraction.validate(answers).select("event_id", "thought_type", "content", "importance")


# Streams: files of the table as a stream, drained into a table in the shared folder


def _drain(df: DataFrame, name: str, key: list[str] | None = None) -> DataFrame:
    """What a stream gives, from a Parquet table; with a key, of each key the row of the last batch."""
    folder = new_folder(df.sparkSession, name)

    def write(rows: DataFrame, batch: int) -> None:
        rows.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{folder}/out/part={batch}")

    q = df.writeStream.outputMode("update" if key else "append").foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    try:
        q.awaitTermination()
    finally:
        q.stop()
    out = df.sparkSession.read.schema(StructType([*df.schema.fields, StructField("batch", LongType())])).parquet(f"{folder}/out/*")
    return (registry.latest(out, key, "batch") if key else out).drop("batch")


def _conversation_stream(spark, d):
    """The conversation table read as a stream."""
    table = f"{d}/conversations.parquet"
    raw = spark.readStream.schema(spark.read.parquet(table).schema).parquet(f"{d}/conversations.parq*")
    return raw.select(F.col("conv_id").cast("string").alias("chain_key"), F.col("role").alias("agent_id"), F.col("turn").cast("bigint").alias("index"), F.col("text").alias("content"), F.concat_ws(":", "conv_id", "turn").alias("id"))


@query("SELECT conv_id::VARCHAR AS chain_key, role AS agent_id, count(*) AS n, min(turn) AS first_index, max(turn) AS last_index FROM conversations GROUP BY ALL")
def stream_registry(spark, d):
    from ..streaming import jobs

    return _drain(jobs.running_agents(_conversation_stream(spark, d)), "stream-registry", ["chain_key", "agent_id"])


@query(f"SELECT conv_id::VARCHAR AS chain_key, term, count(*) AS df FROM (SELECT DISTINCT conv_id, turn, unnest({TOK.format('text')}) AS term FROM conversations) GROUP BY ALL")
def stream_terms(spark, d):
    from ..streaming import jobs

    return _drain(jobs.running_terms(_conversation_stream(spark, d), stemmed=False), "stream-terms", ["chain_key", "term"])


@query(f"""WITH w AS (SELECT conv_id, turn, list_distinct({TOK.format('text')}) AS w FROM conversations), p AS (
  SELECT a.conv_id, a.turn, b.turn AS old, len(list_intersect(a.w, b.w))::DOUBLE / len(list_distinct(list_concat(a.w, b.w))) AS s FROM w a JOIN w b ON a.conv_id = b.conv_id AND b.turn < a.turn AND b.turn >= a.turn - 64 WHERE len(a.w) > 0 AND len(b.w) > 0)
SELECT conv_id::VARCHAR AS chain_key, turn AS "index", round(s, 6) AS similarity, conv_id || ':' || old AS supersedes FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY s DESC, old) AS r FROM p WHERE s >= 0.05) WHERE r = 1""")
def stream_dedup_words(spark, d):
    """stream_dedup of words as they are."""
    from ..streaming import jobs

    return _drain(jobs.dedup(_conversation_stream(spark, d), 0.05, words=commit.plain_words()), "stream-dedup").withColumn("similarity", F.round("similarity", 6))


@query()
def stream_dedup(spark, d):
    from ..streaming import jobs

    return _drain(jobs.dedup(_conversation_stream(spark, d), 0.05), "stream-dedup").withColumn("similarity", F.round("similarity", 6))
