"""Approximate nearest neighbours by cosine: a robust-pruned directed graph for each shard, beam-searched by each query.

Equal vectors are one node that keeps its k + 1 smallest ids, so copies cost nothing and ties come out right. Nodes go to
shards of about SHARD_ROWS by a hash. A shard's graph is built by inserting nodes in batches: a greedy search from the
medoid proposes neighbours, and pruning with a relaxed distance (ALPHA) keeps a diverse few; edges back are pruned the
same way. Each index is one file in the shared folder. Queries are packed into blocks, also files; a task takes
(shard, block) pairs, one shard's in a row, and the best k of every pair are merged. A query visits a few thousand nodes
of a shard, however many it holds, so shards are as large as a task builds in about a minute. Scores are computed in double precision from the original
vectors.
"""

from __future__ import annotations

import io
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import file_system, new_folder, publish, ship, stored

SHARD_ROWS, BLOCK_ROWS = 1 << 15, 1024
#: Bytes of the marks of visited nodes that a search holds at once.
SEEN_BYTES = 1 << 26
DEGREE, BEAM, ALPHA, BATCH = 40, 80, 1.2, 512
SEARCH_BEAM = 128


def beam_search(x, graph, start: int, q, beam: int):
    """(ids, distances) of the `beam` nearest nodes found for each row of q, by distance; unused places: -1 and infinity.

    x and q are unit vectors. Queries are taken in parts, so that the marks of visited nodes fit SEEN_BYTES whatever the
    number of nodes.
    """
    import numpy as np

    step = max(1, SEEN_BYTES // max(1, len(x)))
    parts = [_search_part(x, graph, start, q[i : i + step], beam) for i in range(0, max(1, len(q)), step)]
    return tuple(np.concatenate(p) for p in zip(*parts, strict=True))


def _search_part(x, graph, start: int, q, beam: int):
    import numpy as np

    n_q = len(q)
    ids = np.full((n_q, beam), -1, np.int64)
    dist = np.full((n_q, beam), np.inf, np.float32)
    todo = np.full((n_q, beam), np.inf, np.float32)  # distances of nodes that are not expanded yet
    ids[:, 0], dist[:, 0] = start, 2 - 2 * (q @ x[start])
    todo[:, 0] = dist[:, 0]
    seen = np.zeros((n_q, len(x)), bool)
    seen[:, start] = True
    active = np.arange(n_q)
    while len(active):
        at = todo[active].argmin(axis=1)
        has = todo[active, at] < np.inf
        active, at = active[has], at[has]
        if not len(active):
            break
        node = ids[active, at]
        todo[active, at] = np.inf
        near = graph[node].astype(np.int64)
        bad = near < 0
        near[bad] = start  # seen from the outset
        bad |= seen[active[:, None], near]
        seen[active[:, None], near] = True
        d = 2 - 2 * np.einsum("qkd,qd->qk", x[near], q[active])
        d[bad] = np.inf
        all_d = np.concatenate([dist[active], d], axis=1)
        best = np.argpartition(all_d, beam - 1, axis=1)[:, :beam]
        dist[active] = np.take_along_axis(all_d, best, 1)
        ids[active] = np.take_along_axis(np.concatenate([ids[active], np.where(bad, -1, near)], axis=1), best, 1)
        todo[active] = np.take_along_axis(np.concatenate([todo[active], d], axis=1), best, 1)
    order = np.argsort(dist, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)


def robust_prune(x, points, candidates, degree: int, alpha: float):
    """For each point up to `degree` of its candidates (-1: none): the nearest, then of those left that no kept one covers.

    A kept neighbour k covers a candidate c if alpha * |k - c| <= |point - c|.
    """
    import numpy as np

    candidates = np.where(candidates == points[:, None], -1, candidates)
    candidates = np.sort(candidates, axis=1)[:, ::-1]
    twice = np.zeros_like(candidates, bool)
    twice[:, 1:] = candidates[:, 1:] == candidates[:, :-1]
    alive = (candidates >= 0) & ~twice
    v = x[np.maximum(candidates, 0)]
    d = ((v - x[points][:, None, :]) ** 2).sum(axis=2)
    sq = (v * v).sum(axis=2)
    between = np.maximum(sq[:, :, None] + sq[:, None, :] - 2 * (v @ v.transpose(0, 2, 1)), 0)
    out = np.full((len(points), degree), -1, np.int32)
    rows = np.arange(len(points))
    for k in range(degree):
        pick = np.where(alive, d, np.inf).argmin(axis=1)
        ok = alive[rows, pick]
        if not ok.any():
            break
        out[ok, k] = candidates[ok, pick[ok]]
        alive &= ~(alpha * alpha * between[rows, pick] <= d) | ~ok[:, None]
        alive[rows, pick] = False
    return out


def build_graph(x, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA, seed: int = 0):
    """(graph, medoid) over unit vectors x; graph holds `degree` neighbours of each node, -1 for none."""
    import numpy as np

    n = len(x)
    graph = np.full((n, degree), -1, np.int32)
    medoid = int(((x - x.mean(axis=0)) ** 2).sum(axis=1).argmin())
    order = np.random.default_rng(seed).permutation(n)
    order = order[order != medoid]
    at, size = 0, 1
    while at < len(order):
        points = order[at : at + size]
        at, size = at + size, min(BATCH, 2 * size)
        found, _ = beam_search(x, graph, medoid, x[points], beam)
        graph[points] = robust_prune(x, points, found, degree, alpha)
        source = np.repeat(points, degree)
        target = graph[points].ravel()
        new = (target >= 0) & ~(graph[target] == source[:, None]).any(axis=1)
        source, target = source[new], target[new]
        by = np.argsort(target, kind="stable")
        source, target = source[by], target[by]
        nodes, first, count = np.unique(target, return_index=True, return_counts=True)
        had = (graph[nodes] >= 0).sum(axis=1)  # lists have no gaps
        room = np.repeat(had + count <= degree, count)
        place = np.repeat(had - first, count) + np.arange(len(target))
        graph[target[room], place[room]] = source[room]
        full = had + count > degree  # only lists that overflow are pruned
        nodes, first, count = nodes[full], first[full], count[full]
        for lo in range(0, len(nodes), BATCH):
            some = slice(lo, lo + BATCH)
            width = int(count[some].max())
            more = np.full((len(nodes[some]), width), -1, np.int64)
            for i, (f, c) in enumerate(zip(first[some], count[some], strict=True)):
                more[i, :c] = source[f : f + c]
            graph[nodes[some]] = robust_prune(x, nodes[some], np.concatenate([graph[nodes[some]], more], axis=1), degree, alpha)
    return graph, medoid


def search_shard(index: dict, q, q_ids, k: int, beam: int):
    """(query ids, ids, scores): the k best rows of the shard for each query, its own id left out."""
    import numpy as np

    x = index["vectors"].astype(np.float64)
    x_norm, q_norm = np.sqrt((x * x).sum(axis=1)), np.sqrt((q * q).sum(axis=1))
    unit = (x / x_norm[:, None]).astype(np.float32)
    found, _ = beam_search(unit, index["graph"], int(index["medoid"]), (q / q_norm[:, None]).astype(np.float32), beam)
    at = np.maximum(found, 0)
    score = np.stack([(x[a] * v).sum(axis=1) for a, v in zip(at, q, strict=True)]) / (x_norm[at] * q_norm[:, None])
    ids = index["ids"][at]  # queries, beam, k + 1
    ids = np.where((found < 0)[:, :, None] | (ids == q_ids[:, None, None]), np.iinfo(np.int64).max, ids).reshape(len(q), -1)
    flat = np.repeat(score, index["ids"].shape[1], axis=1)
    flat = np.where(ids == np.iinfo(np.int64).max, -np.inf, flat)
    order = np.lexsort((ids, -flat), axis=1)[:, :k]
    ids, flat = np.take_along_axis(ids, order, 1), np.take_along_axis(flat, order, 1)
    ok = flat > -np.inf
    return np.repeat(q_ids, ok.sum(axis=1)), ids[ok], flat[ok]


def _save(folder: str, name: str, **arrays) -> None:
    import numpy as np

    fs, root = file_system(folder)
    data = io.BytesIO()
    np.savez(data, **arrays)
    temp = f"{root}/{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(temp) as out:
        out.write(data.getbuffer())
    publish(fs, temp, f"{root}/{name}")


def _load(folder: str, name: str) -> dict:
    import numpy as np

    fs, root = file_system(folder)
    with fs.open_input_file(f"{root}/{name}") as source:
        with np.load(io.BytesIO(source.read())) as data:
            return dict(data)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) of rows with an id and a vector that is finite and not zero."""
    e = F.col("embedding")
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.cast("array<float>").alias("embedding")).where(F.col("vec_id").isNotNull() & e.isNotNull() & F.coalesce(fine, F.lit(False)))


def nearest(vectors: DataFrame, every: int = 50, k: int = 5, beam: int = SEARCH_BEAM) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows of each row whose vec_id is divisible by `every`.

    vectors has vec_id and embedding; other columns are not read. Nearest first by cosine, ties by the smaller vec_id; a
    row is not its own neighbour, fewer rows than k are all returned. Rows with null id, null or zero vector or one with
    a null or non-finite component take no part. Only vectors of equal length are compared. Repeated rows count once;
    rows with one id and different vectors are candidates each, never for their own id, and as queries each finds its k
    nearest, of which the best k stay. Empty table: no rows.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = usable(vectors)
    first = Window.partitionBy("embedding").orderBy("vec_id")
    nodes = rows.distinct().withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1)
    nodes = stored(nodes.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).withColumn("dim", F.size("embedding")), "ann-nodes")
    folder = new_folder(spark, "ann")
    by_dim = {r["dim"]: r["n"] for r in nodes.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    shards = {d: -(-n // SHARD_ROWS) for d, n in by_dim.items()}
    spread = F.lit(0)
    for d, s in shards.items():
        spread = F.when(F.col("dim") == d, F.pmod(F.xxhash64("embedding"), F.lit(s))).otherwise(spread)

    def build(key, part):
        import numpy as np
        import pyarrow as pa

        d, shard = (v.as_py() for v in key)
        x = np.array(part["embedding"].combine_chunks().flatten(), np.float32).reshape(-1, d)
        lists = part["ids"].to_pylist()
        order = np.argsort([i[0] for i in lists])
        ids = np.full((len(lists), k + 1), np.iinfo(np.int64).max, np.int64)
        for row, j in enumerate(order):
            ids[row, : len(lists[j])] = lists[j]
        x = x[order]
        unit = x.astype(np.float64)
        unit /= np.sqrt((unit * unit).sum(axis=1))[:, None]
        graph, medoid = build_graph(unit.astype(np.float32))
        _save(folder, f"index-{d}-{shard}.npz", vectors=x, ids=ids, graph=graph, medoid=np.array(medoid))
        return pa.table({"dim": pa.array([d], pa.int32()), "shard": [shard], "n": [len(x)]})

    built = nodes.withColumn("shard", spread.cast("long")).groupBy("dim", "shard").applyInArrow(build, "dim int, shard long, n long").collect()
    queries = rows.where(F.col("vec_id") % every == 0).distinct().withColumn("dim", F.size("embedding"))
    queries = queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(sum(by_dim.values()) * 2 // (every * BLOCK_ROWS) + 1)))

    def pack(key, part):
        import numpy as np
        import pyarrow as pa

        d, block = (v.as_py() for v in key)
        x = np.array(part["embedding"].combine_chunks().flatten(), np.float32).reshape(-1, d)
        _save(folder, f"queries-{d}-{block}.npz", vectors=x, ids=part["vec_id"].to_numpy())
        return pa.table({"dim": pa.array([d], pa.int32()), "block": [block]})

    packed = queries.groupBy("dim", "block").applyInArrow(pack, "dim int, block long").collect()
    schema = "query_id long, vec_id long, score double"
    # A row for each shard and each block came back; their pairs are numbered here and made where they are worked on.
    plan, n_pairs = [], 0
    for d in sorted(by_dim):
        mine, blocks = sorted(r["shard"] for r in built if r["dim"] == d), sorted(b["block"] for b in packed if b["dim"] == d)
        plan.append((n_pairs, d, mine, blocks))
        n_pairs += len(mine) * len(blocks)
    if not n_pairs:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    shared = spark.sparkContext.broadcast(plan)  # as many names as there are shards and blocks

    def search(batches):
        import numpy as np
        import pyarrow as pa

        held, index = None, None
        for batch in batches:
            for i in batch.column(0).to_pylist():
                first, d, mine, blocks = next(p for p in reversed(shared.value) if p[0] <= i and p[2] and p[3])
                shard, block = mine[(i - first) // len(blocks)], blocks[(i - first) % len(blocks)]
                if held != (d, shard):
                    held, index = (d, shard), _load(folder, f"index-{d}-{shard}.npz")
                q = _load(folder, f"queries-{d}-{block}.npz")
                a, b, c = search_shard(index, q["vectors"].astype(np.float64), q["ids"], k, beam)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(c)], names=["query_id", "vec_id", "score"])

    found = spark.range(0, n_pairs, 1, min(n_pairs, 10_000)).mapInArrow(search, schema)
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
