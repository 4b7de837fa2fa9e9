"""Quality classifier: a factorisation machine over hashed words, structure statistics and length metadata.

score = sigmoid(w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)): all pairwise interactions in
time linear in the features, by the sum-of-squares identity. Trained by Adagrad in numpy on the driver on a bounded
sample of labelled rows; scored where the documents are, without a shuffle.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship, slices

#: Buckets of hashed words; statistics follow them.
WORD_BITS = 16
RANK = 8
#: Labelled rows that training looks at, at most: half of them of either label if there are enough.
TRAIN_ROWS = 8000
EPOCHS = 6
LEVELS = (0.5, 1.5, 2.5, 3.5, 4.5, 5.5, 6.5, 7.5, 8.5, 10.0, 12.0)
CACHE_WORDS = 150_000
_BUCKETS: dict[str, int] = {}
_CLASSES = [re.compile(p) for p in (r"[A-Z]", r"[0-9]", r"[!?]", r"[#$%&*|@^~<>{}\[\]\\=+_]", r"[.,;:]", r"\n", r"[^\x00-\x7f]", r"https?://|www\.")]
N_STATS = len(_CLASSES) + 10


def statistics(text: str, words: list[str]) -> list[float]:
    """Shares and logarithms in about 0 to 1 that describe a text's shape and length."""
    import math

    n, k = max(1, len(text)), max(1, len(words))
    shares = [min(1.0, 8 * sum(1 for _ in c.finditer(text)) / n) for c in _CLASSES]
    lines = text.split("\n")
    lengths = [len(w) for w in words] or [0]
    mean = sum(lengths) / len(lengths)
    return [
        *shares,
        math.log1p(len(text)) / 12, math.log1p(len(words)) / 12, math.log1p(len(lines)) / 8,
        len(set(words)) / k, len({*lines}) / max(1, len(lines)), min(1.0, mean / 16),
        min(1.0, max(lengths) / 64), sum(w.isupper() for w in words) / k,
        sum(not w[-1].isalnum() and w[-1] not in ".,;:" for w in words) / k, sum(not any(map(str.isalnum, w)) for w in words) / k,
    ]


def features(text: str | None):
    """(indices, values): distinct word buckets with 1 / sqrt(count of them), then statistics; null counts as empty."""
    import numpy as np

    text = text or ""
    words = text.split()
    if len(_BUCKETS) > CACHE_WORDS:
        _BUCKETS.clear()
    ids = set()
    for w in set(words):
        h = _BUCKETS.get(w)
        if h is None:
            h = _BUCKETS[w] = zlib.crc32(w.lower().strip(".,;:").encode("utf-8", "surrogatepass")) & ((1 << WORD_BITS) - 1)
        ids.add(h)
    base = 1 << WORD_BITS
    stats = statistics(text, words)
    bands = [base + N_STATS + j * (len(LEVELS) + 1) + sum(s * 12 > x for x in LEVELS) for j, s in enumerate(stats)]
    indices = np.array([*sorted(ids), *range(base, base + N_STATS), *bands], np.int32)
    values = np.concatenate([np.full(len(ids), 1 / max(1, len(ids)) ** 0.5), stats, np.full(N_STATS, 0.5)])
    return indices, values.astype(np.float32)


N_FEATURES = (1 << WORD_BITS) + N_STATS * (len(LEVELS) + 2)


@dataclass
class FactorisationMachine:
    w0: float = 0.0
    w: object = None
    v: object = None

    def raw(self, rows) -> object:
        """Linear plus pairwise part of (indices, values) rows."""
        import numpy as np

        if not rows:
            return np.zeros(0)
        ends = np.cumsum([len(r[0]) for r in rows])[:-1]
        starts = np.concatenate([[0], ends])
        i, x = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
        vx = self.v[i] * x[:, None]
        total = np.add.reduceat(vx, starts, axis=0)
        squares = np.add.reduceat(vx * vx, starts, axis=0)
        return self.w0 + np.add.reduceat(self.w[i] * x, starts) + 0.5 * (total * total - squares).sum(axis=1)

    def score(self, rows):
        import numpy as np

        return 1 / (1 + np.exp(-np.clip(self.raw(rows).astype(np.float64), -30, 30)))


def train(rows: list, labels: list[int], rank: int = RANK, epochs: int = EPOCHS, seed: int = 1, rate: float = 0.1, l2: float = 1e-5) -> FactorisationMachine:
    """Adagrad over batches of 64; either label weighs the same in total. One label only: its constant score; none: 0.5."""
    import numpy as np

    rng = np.random.default_rng(seed)
    y = np.array(labels, np.float32)
    fm = FactorisationMachine(0.0, np.zeros(N_FEATURES, np.float32), (rng.standard_normal((N_FEATURES, rank)) * 0.02).astype(np.float32))
    n1, n0 = float(y.sum()), float(len(y) - y.sum())
    if not n1 or not n0:
        fm.w0 = 0.0 if not len(y) else 5.0 if n1 else -5.0
        fm.v[:] = 0
        return fm
    weight = np.where(y > 0, len(y) / (2 * n1), len(y) / (2 * n0)).astype(np.float32)
    gw, gv, g0 = np.full(N_FEATURES, 1e-2, np.float32), np.full((N_FEATURES, rank), 1e-2, np.float32), 1e-2
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), 64):
            part = order[at : at + 64]
            some = [rows[k] for k in part]
            sizes = np.array([len(r[0]) for r in some])
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            i, x = np.concatenate([r[0] for r in some]), np.concatenate([r[1] for r in some])
            v = fm.v[i]
            vx = v * x[:, None]
            total = np.add.reduceat(vx, starts, axis=0)
            raw = fm.w0 + np.add.reduceat(fm.w[i] * x, starts) + 0.5 * (total * total - np.add.reduceat(vx * vx, starts, axis=0)).sum(axis=1)
            slope = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y[part]) * weight[part] / len(part)
            each = np.repeat(slope, sizes)
            used, back = np.unique(i, return_inverse=True)
            dw = np.bincount(back, each * x, len(used)).astype(np.float32) + l2 * fm.w[used]
            dv_each = (each * x)[:, None] * (np.repeat(total, sizes, axis=0) - vx)
            dv = np.stack([np.bincount(back, dv_each[:, f], len(used)) for f in range(rank)], axis=1).astype(np.float32) + l2 * fm.v[used]
            gw[used] += dw * dw
            gv[used] += dv * dv
            d0 = float(slope.sum())
            g0 += d0 * d0
            fm.w[used] -= rate * dw / np.sqrt(gw[used])
            fm.v[used] -= rate * 0.5 * dv / np.sqrt(gv[used])
            fm.w0 -= rate * d0 / g0**0.5
    return fm


def held_out(doc_id: Column, parts: int, which: int) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(parts)) == which, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, parts: int = 3, which: int = 1, label: str = "quality") -> FactorisationMachine:
    """Learns labels.<label> (0 or 1; others and nulls are left out) from rows outside the held-out part.

    Of either label up to train_rows / 2 rows are taken, in the order of a hash of doc_id: a bounded sample of labelled
    rows. Their features, not their texts, come to the driver. A doc_id with several labels counts with each, one with
    several texts with the smallest of them, so no more than train_rows rows arrive however often ids repeat.
    """
    ship(docs.sparkSession)
    known = labels.where(F.col(label).isin(0, 1) & ~held_out(F.col("doc_id"), parts, which)).select(F.col("doc_id").alias("id"), F.col(label).cast("int").alias("y"), F.xxhash64("doc_id", F.lit("sample")).alias("h")).distinct()
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}  # two rows at most
    some = None
    for y in sorted(counts):  # the smallest hashes of either label, found by merging heads of partitions
        head = known.where(F.col("y") == y).orderBy("h", "id").limit(train_rows // 2)
        some = head if some is None else some.unionByName(head)
    if some is None:
        return train([], [])

    def run(batches):
        import pyarrow as pa

        for b in batches:
            rows = [features(t) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([r[0] for r in rows], pa.list_(pa.int32())), pa.array([r[1] for r in rows], pa.list_(pa.float32()))], names=["h", "y", "i", "x"])

    texts = docs.select(F.col("doc_id").alias("id"), "text").join(F.broadcast(some.select("id").distinct()), "id", "left_semi").groupBy("id").agg(F.min("text").alias("text"))
    joined = texts.join(F.broadcast(some), "id").select("h", "y", "text")
    import numpy as np

    got = joined.mapInArrow(run, "h long, y int, i array<int>, x array<float>").toArrow().sort_by([("h", "ascending"), ("y", "ascending")])
    rows = [(np.asarray(i.values, np.int32), np.asarray(x.values, np.float32)) for i, x in zip(got["i"], got["x"], strict=True)]
    return train(rows, got["y"].to_pylist())


def score(docs: DataFrame, model: FactorisationMachine, name: str = "score") -> DataFrame:
    """docs with a column `name`: 0 to 1, higher: label 1 likelier. Null and empty texts are scored by their statistics."""
    ship(docs.sparkSession)
    if name in docs.columns:
        raise ValueError(f"there is a column {name} already")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    column, names = docs.columns.index("text"), [*docs.columns, name]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch, column, 256):
                s = shared.value.score([features(t) for t in part.column(column).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(s, pa.float64())], names=names)

    from pyspark.sql.types import DoubleType, StructField, StructType

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted (1 if score >= 0.5): one row per row of docs.

    Null doc_id: not held out. No usable label: every score is 0.5. Empty table: no rows. labels, lang, source and doc_id
    are not inputs of a score.
    """
    scored = score(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
