"""Point lookup, anchored paging, tails and transitive closure over one or many chains."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import cut

#: Walks of one length are kept up to this many for each link.
MOST_WALKS = 16


def lookup(records: DataFrame, **key) -> DataFrame:
    """Records by id, hash or index (equality; pushed to the scan)."""
    for name, value in key.items():
        records = records.where(F.col(name) == value)
    return records


def genesis_and_head(records: DataFrame) -> DataFrame:
    """chain_key, genesis_id, head_id, count: first and last record of every chain."""
    return records.groupBy("chain_key").agg(F.min_by("id", "index").alias("genesis_id"), F.max_by("id", "index").alias("head_id"), F.count("*").alias("count"))


def anchor_index(records: DataFrame, anchor: str, value=None) -> int | None:
    """Index of an anchor: id, hash, index, genesis or head. None if there is no such record."""
    if anchor in ("genesis", "head"):
        row = records.agg((F.min if anchor == "genesis" else F.max)("index").alias("i")).first()
    else:
        row = records.where(F.col(anchor) == value).agg(F.min("index").alias("i")).first()
    return row["i"]


def page(records: DataFrame, at: int | None, forward: bool = True, include_anchor: bool = False, size: int = 10) -> DataFrame:
    """Up to `size` records from an index on, in the order of travel, with page_rank, has_more and the cursors of the page.

    next_cursor and previous_cursor are the ids of the page's last and first record. No anchor: empty.
    """
    if size < 1:
        raise ValueError("a page holds a record at least")
    if at is None:
        none = F.lit(None).cast("string")
        return records.limit(0).withColumns({"page_rank": F.lit(1), "has_more": F.lit(False), "next_cursor": none, "previous_cursor": none})
    i = F.col("index")
    ahead = (i > at if forward else i < at) | (F.lit(include_anchor) & (i == at))
    found = records.where(ahead).orderBy(i.asc() if forward else i.desc()).limit(size + 1)
    w = Window.orderBy(i.asc() if forward else i.desc())  # over size + 1 rows
    found = found.withColumn("page_rank", F.row_number().over(w)).withColumn("has_more", F.max("page_rank").over(Window.partitionBy()) > size)
    found = found.where(F.col("page_rank") <= size)
    every = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return found.withColumns({"next_cursor": F.last("id").over(every), "previous_cursor": F.first("id").over(every)})


def recent_context(records: DataFrame, n: int = 12, per_agent: bool = False) -> DataFrame:
    """The last n records of every chain (or of every agent in it) as text lines."""
    keys = ["chain_key", "agent_id"] if per_agent else ["chain_key"]
    w = Window.partitionBy(*keys).orderBy(F.desc("index"))
    line = F.format_string("[#%d] %s: %s", F.col("index"), F.col("thought_type"), F.col("content"))
    tail = records.withColumn("r", F.row_number().over(w)).where(F.col("r") <= n).withColumn("line", line)
    return tail.groupBy(*keys).agg(F.count("*").alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("index", "line"))), lambda x: x["line"]), "\n").alias("context"))


def listing(records: DataFrame, page_no: int, per_page: int, newest_first: bool = True) -> DataFrame:
    """One page of a listing with total and page count."""
    total = records.agg(F.count("*").alias("total"))
    rows = records.orderBy(F.desc("index") if newest_first else F.asc("index")).offset((page_no - 1) * per_page).limit(per_page)
    return rows.crossJoin(F.broadcast(total)).withColumn("pages", F.ceil(F.col("total") / per_page))  # one row on the right


def edges_within(records: DataFrame) -> DataFrame:
    """(chain_key, src, dst): refs and relations inside a chain, by id; dangling ones are dropped."""
    ids = records.select("chain_key", F.col("id").alias("dst"), F.col("index").alias("ref"))
    by_ref = records.select("chain_key", F.col("id").alias("src"), F.explode("refs").alias("ref")).join(ids, ["chain_key", "ref"]).select("chain_key", "src", "dst")
    by_id = records.select("chain_key", F.col("id").alias("src"), F.explode("relations").alias("r")).where(F.col("r.chain_key").isNull()).select("chain_key", "src", F.col("r.target_id").alias("dst"))
    return by_ref.unionByName(by_id.join(ids.select("chain_key", "dst"), ["chain_key", "dst"], "left_semi")).distinct()


def closure(records: DataFrame, targets: DataFrame, keep=None) -> DataFrame:
    """(chain_key, target, id): everything reachable from the targets (chain_key, id) over refs and relations, themselves included.

    Walks double with each round, so a chain of n links takes log2(n) rounds; the walks of one length are kept while they
    are no more than MOST_WALKS times the links, from then on rounds go link by link. Ends when a round finds nothing new.
    """
    keep = keep or cut
    edges = walks = keep(edges_within(records.join(targets.select("chain_key").distinct(), "chain_key", "left_semi")))
    seen = frontier = keep(targets.select("chain_key", F.col("id").alias("target"), "id").distinct())
    n_edges, doubling = edges.count(), True
    while True:
        start = seen if doubling else frontier
        nxt = start.withColumnRenamed("id", "src").join(walks, ["chain_key", "src"]).select("chain_key", "target", F.col("dst").alias("id")).distinct()
        found = keep(nxt.join(seen, ["chain_key", "target", "id"], "left_anti"))
        if not found.take(1):
            return seen
        seen, frontier = keep(seen.unionByName(found)), found
        if doubling:
            into, out = walks.groupBy("chain_key", F.col("dst").alias("id")).agg(F.count("*").alias("n")), walks.groupBy("chain_key", F.col("src").alias("id")).agg(F.count("*").alias("m"))
            size = into.join(out, ["chain_key", "id"]).agg(F.sum(F.col("n") * F.col("m"))).first()[0] or 0
            if size <= MOST_WALKS * n_edges:
                walks = keep(walks.select("chain_key", "src", F.col("dst").alias("mid")).join(walks.select("chain_key", F.col("src").alias("mid"), "dst"), ["chain_key", "mid"]).select("chain_key", "src", "dst").distinct())
            else:
                doubling, walks, frontier = False, edges, seen
