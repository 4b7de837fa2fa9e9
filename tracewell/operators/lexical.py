"""Multi-field BM25 over many queries at once, on stems.

Records are read and cut into words once: their words meet the terms of all queries where they are, up to SENT_TERMS
of them, and what does not match is only counted; more terms are joined. That leaves one row for each record and query
term it holds, and one with the number of its other words; lengths, averages, document frequencies and scores all come from this small table,
which is stored. Terms that occur in too many documents of a chain are gated out on the term table, before scoring.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import counted, query_terms, stems, tokens
from .storage import cut

#: Parameters, fields, their weights, and the share of documents beyond which a term is too common in a field.
K1, B = 1.2, 0.75
FIELDS = ("content", "tags", "concepts", "agent_id", "registry")
WEIGHTS = {"content": 1.0, "tags": 1.6, "concepts": 1.4, "agent_id": 1.5, "registry": 1.1}
CUTOFFS = {"content": 0.30, "tags": 0.30, "concepts": 0.30, "agent_id": 0.70, "registry": 0.60}
GATE_FROM = 20
DOC = ("chain_key", "index")
#: Distinct query terms up to this number are sent to the records; more are joined like any table.
SENT_TERMS = 200_000


def field_tokens(records: DataFrame, fields: Sequence[str] = FIELDS, agents: DataFrame | None = None, stemmed: bool = False) -> DataFrame:
    """chain_key, index and an array of tokens (or their stems) t_<field> for each field. Registry: names of the record's agent in its chain."""
    if "registry" in fields and agents is not None:
        names = F.concat_ws(" ", "display_name", "owner", "description", F.array_join("aliases", " "))
        records = records.join(agents.select("chain_key", "agent_id", names.alias("registry_text")), ["chain_key", "agent_id"], "left")
    text = {"content": F.col("content"), "tags": F.array_join("tags", " "), "concepts": F.array_join("concepts", " "), "agent_id": F.col("agent_id"), "registry": F.col("registry_text") if agents is not None else F.lit(None).cast("string")}
    made = {f: tokens(text[f]) for f in fields}
    return records.select(*DOC, *[(stems(t) if stemmed else t).alias(f"t_{f}") for f, t in made.items()])


def postings(docs: DataFrame, fields: Sequence[str], terms: DataFrame | None = None) -> DataFrame:
    """chain_key, index, term, tf_<field>: one row per document and term (of `terms`, if given); one with a null term for a document's other words, or for one without words."""
    tag = lambda k: lambda t: F.struct(F.lit(k).alias("k"), t.alias("term"))
    tagged = F.concat(*[F.transform(f"t_{f}", tag(k)) for k, f in enumerate(fields)])
    rows = docs.select(*DOC, F.explode_outer(tagged).alias("p")).select(*DOC, F.col("p.k").alias("k"), F.col("p.term").alias("term"))
    if terms is not None:
        known = terms.select("term").distinct().withColumn("wanted", F.lit(True))
        rows = rows.join(known, "term", "left").withColumn("term", F.when(F.col("wanted"), F.col("term")))
    tf = [F.coalesce(F.sum((F.col("k") == k).cast("bigint")), F.lit(0)).alias(f"tf_{f}") for k, f in enumerate(fields)]
    return rows.groupBy(*DOC, "term").agg(*tf)


def matches(docs: DataFrame, fields: Sequence[str], terms: list[str], stemmed: bool = True) -> DataFrame:
    """What postings() gives of docs (with plain tokens) for a list of terms; words are counted where they are, and only counts move."""
    count = counted(terms, stemmed)
    counts = docs.select(*DOC, *[count(f"t_{f}").alias(f"c_{f}") for f in fields])
    tag = lambda k: lambda c: F.struct(F.lit(k).alias("k"), c["term"].alias("term"), c["n"].alias("n"))
    tagged = F.concat(*[F.transform(f"c_{f}", tag(k)) for k, f in enumerate(fields)])
    rows = counts.select(*DOC, F.explode(tagged).alias("p")).select(*DOC, "p.*")
    return rows.groupBy(*DOC, "term").agg(*[F.sum(F.when(F.col("k") == k, F.col("n")).otherwise(0)).alias(f"tf_{f}") for k, f in enumerate(fields)])


def lengths(posts: DataFrame, fields: Sequence[str]) -> DataFrame:
    """chain_key, index, len_<field> of every document."""
    return posts.groupBy(*DOC).agg(*[F.sum(f"tf_{f}").alias(f"len_{f}") for f in fields])


def corpus_stats(lens: DataFrame, fields: Sequence[str]) -> DataFrame:
    """chain_key, n_docs, avg_<field>: lengths averaged over all documents, empty ones included."""
    return lens.groupBy("chain_key").agg(F.count("*").alias("n_docs"), *[F.avg(f"len_{f}").alias(f"avg_{f}") for f in fields])


def idf(n: Column, df: Column) -> Column:
    return F.log((n - df + 0.5) / (df + 0.5) + 1)


def field_score(f: str) -> Column:
    tf = F.col(f"tf_{f}")
    length = 1 - B + B * F.col(f"len_{f}") / F.greatest(F.col(f"avg_{f}"), F.lit(1.0))
    return F.when(tf > 0, F.col("idf") * tf * (K1 + 1) / (tf + K1 * length)).otherwise(0.0)


def document_frequency(posts: DataFrame) -> DataFrame:
    """chain_key, term, df: documents that hold the term in any field."""
    return posts.where("term is not null").groupBy("chain_key", "term").agg(F.count("*").alias("df"))


def terms_of(queries: DataFrame, lemmas: bool = True, stemmed: bool = True) -> DataFrame:
    """query_id, term: distinct words of each text, widened by base forms of irregular ones, as stems."""
    words = query_terms(F.col("text")) if lemmas else F.array_distinct(tokens(F.col("text")))
    return queries.select("query_id", F.explode(stems(words) if stemmed else words).alias("term")).distinct()


def bm25(queries: DataFrame, records: DataFrame, fields: Sequence[str] = FIELDS, agents: DataFrame | None = None, candidates: DataFrame | None = None, cutoffs: dict[str, float] = CUTOFFS, lemmas: bool = True, stemmed: bool = True) -> DataFrame:
    """query_id, chain_key, index, lexical, matched_terms, match_sources of documents that score above 0.

    queries: query_id, text. Terms are stems, of queries also those of irregular base forms, unless switched off.
    Statistics are those of the whole chain; `candidates` (chain_key, index, and query_id if it differs by query) only
    restricts what is scored. A query without tokens scores nothing. matched_terms are the terms as they were compared.
    """
    terms = cut(terms_of(queries, lemmas, stemmed))
    wanted = [r["term"] for r in terms.select("term").distinct().limit(SENT_TERMS + 1).collect()]  # SENT_TERMS + 1 at most
    if len(wanted) <= SENT_TERMS:
        posts = cut(matches(field_tokens(records, fields, agents), fields, sorted(wanted), stemmed))
    else:
        posts = cut(postings(field_tokens(records, fields, agents, stemmed), fields, terms))
    lens = lengths(posts, fields)
    frequencies = document_frequency(posts).join(corpus_stats(lens, fields), "chain_key").withColumn("idf", idf(F.col("n_docs"), F.col("df")))
    common = lambda f: (F.col("n_docs") >= GATE_FROM) & (F.col("df") / F.col("n_docs") > cutoffs[f])
    frequencies = frequencies.select("chain_key", "term", "idf", *[f"avg_{f}" for f in fields], *[(~common(f)).alias(f"open_{f}") for f in fields])
    frequencies = frequencies.where(" or ".join(f"open_{f}" for f in fields))
    met = posts.where("term is not null").join(frequencies, ["chain_key", "term"]).join(lens, list(DOC)).join(terms, "term")
    if candidates is not None:
        met = met.join(candidates, [c for c in ("query_id", *DOC) if c in candidates.columns], "left_semi")
    scores = {f: F.when(F.col(f"open_{f}"), F.lit(WEIGHTS[f]) * field_score(f)).otherwise(0.0) for f in fields}
    met = met.select("query_id", *DOC, "term", *[s.alias(f"s_{f}") for f, s in scores.items()])
    total = sum((F.col(f"s_{f}") for f in fields), F.lit(0.0))
    found = met.withColumn("s", total).where("s > 0").groupBy("query_id", *DOC).agg(F.sum("s").alias("lexical"), F.sort_array(F.collect_set("term")).alias("matched_terms"), *[F.max(F.col(f"s_{f}") > 0).alias(f"m_{f}") for f in fields])
    sources = F.array_compact(F.array(*[F.when(F.col(f"m_{f}"), F.lit(f)) for f in fields]))
    return found.select("query_id", *DOC, "lexical", "matched_terms", sources.alias("match_sources"))


def top_k(hits: DataFrame, score: str, k: int, *ties: Column, keys: Sequence[str] = ("query_id",)) -> DataFrame:
    """The k best of each query, score descending, then the tie columns; k rows of each partition move at most."""
    w = Window.partitionBy(*keys).orderBy(F.desc(score), *ties)
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def lexical_order() -> list[Column]:
    """Score, importance, confidence (none: 0), timestamp, index, all descending; equal indexes of several chains by chain."""
    return [F.desc("lexical"), F.desc("importance"), F.coalesce("confidence", F.lit(0.0)).desc(), F.desc_nulls_last("timestamp"), F.desc("index"), F.asc("chain_key")]


def search(queries: DataFrame, records: DataFrame, k: int = 10, offset: int = 0, **how) -> DataFrame:
    """Ranks offset + 1 to offset + k of each query in the lexical order, with the number of all hits; how: as of bm25."""
    hits = bm25(queries, records, **how)
    totals = hits.groupBy("query_id").agg(F.count("*").alias("total"))
    rows = hits.join(records.select(*DOC, "id", "importance", "confidence", "timestamp"), list(DOC))
    w = Window.partitionBy("query_id").orderBy(*lexical_order())
    return rows.withColumn("rank", F.row_number().over(w)).where((F.col("rank") <= offset + k) & (F.col("rank") > offset)).join(totals, "query_id")
