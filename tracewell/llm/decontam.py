"""Benchmark decontamination with suffix arrays of the training documents.

Each task turns its documents into word ids of the benchmark's vocabulary (0 for all other words and for document ends:
nothing that holds a 0 can match), cuts them into shards of SHARD_WORDS, sorts every suffix of a shard that starts with
a known word by prefix doubling, and binary-searches every window of every test suffix in it. The ranges found give all
places of a match; places that continue each other on one diagonal give the longest verbatim match. Documents never move:
the job has no shuffle, and a task holds one shard at a time. The benchmark is sent to the tasks in blocks of BLOCK_CHARS
at most, whatever its size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import alnum_words, ship, steady

WINDOW = 10
SHARD_WORDS = 500_000
BLOCK_CHARS = 32_000_000


class TestIndex:
    """Distinct windows of a block of test items. An item of fewer words than a window is one window; without words, none."""

    __test__ = False

    def __init__(self, items: Iterable[tuple[str | None, str | None]], window: int = WINDOW):
        import numpy as np

        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        by_words: dict[bytes, tuple[object, list[str | None]]] = {}
        for item_id, text in items:
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in alnum_words(text)], dtype=np.int64)
            if len(ids):
                by_words.setdefault(ids.tobytes(), (ids, []))[1].append(item_id)
        texts = [v[0] for v in by_words.values()]
        #: Ids of the items that consist of the k-th text.
        self.owners = [sorted({i for i in v[1] if i is not None}) for v in by_words.values()]
        #: For each length: distinct windows, and for each of them the (text, offset) pairs it occurs at.
        self.by_length: dict[int, tuple[object, object, object, object]] = {}
        for m in sorted({min(window, len(t)) for t in texts}):
            rows = [(np.lib.stride_tricks.sliding_window_view(t, m), k) for k, t in enumerate(texts) if min(window, len(t)) == m]
            flat = np.concatenate([r for r, _ in rows])
            text_of = np.concatenate([np.full(len(r), k) for r, k in rows])
            offset = np.concatenate([np.arange(len(r)) for r, _ in rows])
            distinct, back = np.unique(flat, axis=0, return_inverse=True)
            order = np.argsort(back.ravel(), kind="stable")
            starts = np.searchsorted(back.ravel()[order], np.arange(len(distinct) + 1))
            self.by_length[m] = (distinct, text_of[order], offset[order], starts)

    def encode(self, text: str | None):
        import numpy as np

        words = alnum_words(text)
        get = self.vocabulary.get
        return np.fromiter((get(w, 0) for w in words), np.int64, len(words))


def suffix_array(seq, depth: int):
    """Positions of seq with a positive id, sorted by their next `depth` ids at least; prefix doubling. 0 sorts first."""
    import numpy as np

    at = np.flatnonzero(seq)
    rank = np.concatenate([seq, np.zeros(1, seq.dtype)])
    order, h = np.argsort(rank[at], kind="stable"), 1
    while h < depth and len(at):
        second = rank[np.minimum(at + h, len(seq))]
        key = (rank[at] << 32) | second
        order = np.argsort(key)
        in_order = key[order]
        new = np.cumsum(np.concatenate([[1], in_order[1:] != in_order[:-1]]))
        rank = np.zeros(len(seq) + 1, np.int64)
        rank[at[order]] = new
        if len(new) and new[-1] == len(new):
            break
        h *= 2
    return at[order]


def find(seq, suffixes, windows):
    """For each row of windows, the range [low, high) of suffixes that start with it: binary search, all rows at once."""
    import numpy as np

    m = windows.shape[1]
    padded = np.concatenate([seq, np.zeros(m, seq.dtype)])
    rows = np.arange(len(windows))

    def bound(upper: bool):
        low, high = np.zeros(len(windows), np.int64), np.full(len(windows), len(suffixes), np.int64)
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                return low
            mid = (low[open_] + high[open_]) // 2
            there = padded[suffixes[mid][:, None] + np.arange(m)]
            mine = windows[rows[open_]]
            differ = there != mine
            first = differ.argmax(axis=1)
            k = np.arange(len(open_))
            same = ~differ[k, first]
            less = np.where(same, upper, there[k, first] < mine[k, first])
            low[open_[less]] = mid[less] + 1
            high[open_[~less]] = mid[~less]

    return bound(False), bound(True)


def shard_matches(encoded: list, index: TestIndex) -> Iterator[tuple[int, object, list[str], int, int]]:
    """(document, hit mask, ids of items, longest match, its place) of each document of the shard that has a match."""
    import numpy as np

    if not encoded or not index.by_length:
        return
    seq = np.concatenate([x for e in encoded for x in (e, np.zeros(1, np.int64))])
    starts = np.concatenate([[0], np.cumsum([len(e) + 1 for e in encoded])])
    suffixes = suffix_array(seq, max(index.by_length))
    found = []
    for m, (windows, text_of, offset, at) in index.by_length.items():
        low, high = find(seq, suffixes, windows)
        n = high - low
        if not n.any():
            continue
        w = np.repeat(np.arange(len(windows)), n)
        place = suffixes[np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]
        many = (at[1:] - at[:-1])[w]
        which = np.repeat(at[w] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
        found.append((np.repeat(place, many), np.full(len(which), m), text_of[which], offset[which]))
    if not found:
        return
    place, length, text, offset = (np.concatenate([f[i] for f in found]) for i in range(4))
    doc = np.searchsorted(starts, place, "right") - 1
    order = np.lexsort((offset, place - offset, text, doc))
    place, length, text, offset, doc = (x[order] for x in (place, length, text, offset, doc))
    edges = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1], [True]]))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        d = int(doc[a])
        local, size, t, o = place[a:b] - starts[d], length[a:b], text[a:b], offset[a:b]
        step = np.zeros(len(encoded[d]) + 1, np.int64)
        np.add.at(step, local, 1)
        np.add.at(step, local + size, -1)
        mask = np.cumsum(step[:-1]) > 0
        joins = np.concatenate([[False], (t[1:] == t[:-1]) & (local[1:] - o[1:] == local[:-1] - o[:-1]) & (o[1:] == o[:-1] + 1)])
        run = np.flatnonzero(~joins)
        lengths = np.diff(np.concatenate([run, [len(joins)]])) - 1 + size[run]
        best = int(np.lexsort((local[run], -lengths))[0])
        items = sorted({i for k in np.unique(t) for i in index.owners[k]})
        yield d, mask, items, int(lengths[best]), int(local[run][best])


def _blocks(benchmark: DataFrame, window: int) -> Iterator[object]:
    """Broadcast test indexes, each over BLOCK_CHARS of text at most (or one longer item)."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text"), F.coalesce(F.length("text"), F.lit(0)).alias("n"))
    total = items.agg(F.sum("n")).first()[0] or 0
    n = total // BLOCK_CHARS * 2 + 1
    for k in range(n):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).select("item_id", "text")
        yield spark.sparkContext.broadcast(TestIndex(part.toLocalIterator(), window))


def _shards(batches, column: int, index: TestIndex):
    """(batches, encoded texts) whenever SHARD_WORDS have come together, and at the end; a longer text is a shard of its own."""
    held, encoded, words = [], [], 0
    for batch in batches:
        first = 0
        for at in range(batch.num_rows):
            text = index.encode(batch.column(column)[at].as_py())
            if encoded and words + len(text) > SHARD_WORDS:
                if at > first:
                    held.append(batch.slice(first, at - first))
                yield held, encoded
                held, encoded, words, first = [], [], 0, at
            encoded.append(text)
            words += len(text)
        held.append(batch.slice(first, batch.num_rows - first))
    if encoded:
        yield held, encoded


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, longest, longest_at: one row per row of docs.

    docs has doc_id and text, benchmark item_id and text; other columns are not read. Words are runs of ASCII letters
    (A-Z lower-cased), digits and non-ASCII characters. A word is hit if it lies in an occurrence of a window: `window`
    consecutive words of an item, or a whole item of fewer. Null or empty text has no words: no hits, and an item without
    words has no window. Ids of items may be of any type and are listed as strings. An item whose id is null can hit but
    is not listed; an id given twice counts once. Texts of any length are taken whole. No item:
    items_sha256 of the empty string. longest is the longest run that an item and the document share (0 without a hit),
    longest_at its first word's number (the earliest of equals). Empty tables: no rows, or no hits.
    """
    spark = docs.sparkSession
    ship(spark)
    base = steady(docs.select("doc_id", "text"), "contamination-input").select("doc_id", "text", F.monotonically_increasing_id().alias("row_key"))
    id_type = base.schema["doc_id"].dataType.simpleString()
    schema = f"row_key long, doc_id {id_type}, n_words long, hits binary, items array<string>, longest long, longest_at long"

    def search(index):
        def run(batches):
            import numpy as np
            import pyarrow as pa

            for held, encoded in _shards(batches, 1, index.value):
                n = len(encoded)
                hits, items, longest, place = [b""] * n, [[]] * n, [0] * n, [0] * n
                for d, mask, ids, size, at in shard_matches(encoded, index.value):
                    hits[d], items[d], longest[d], place[d] = np.packbits(mask).tobytes(), ids, size, at
                at = 0
                for part in held:
                    k = slice(at, at + part.num_rows)
                    at += part.num_rows
                    yield pa.RecordBatch.from_arrays([part.column(2), part.column(0), pa.array([len(e) for e in encoded[k]], pa.int64()), pa.array(hits[k], pa.binary()), pa.array(items[k], pa.list_(pa.string())), pa.array(longest[k], pa.int64()), pa.array(place[k], pa.int64())], names=["row_key", "doc_id", "n_words", "hits", "items", "longest", "longest_at"])

        return run

    parts = [base.mapInArrow(search(index), schema) for index in _blocks(benchmark, window)]
    found = parts[0].select("row_key", "doc_id", "n_words", F.array("hits").alias("hits"), "items", "longest", "longest_at")
    if len(parts) > 1:  # as many rows for each document as there are blocks
        every = parts[0]
        for p in parts[1:]:
            every = every.unionByName(p)
        best = F.max(F.struct("longest", (-F.col("longest_at")).alias("back")))
        found = every.groupBy("row_key").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.collect_list("hits").alias("hits"), F.flatten(F.collect_list("items")).alias("items"), best.alias("best"))
        found = found.select("row_key", "doc_id", "n_words", "hits", "items", F.col("best.longest").alias("longest"), (-F.col("best.back")).alias("longest_at"))

    def count(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            n_hit, n_items, sums = [], [], []
            for hits, items in zip(b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                hits = [np.frombuffer(h, np.uint8) for h in hits if h]
                n_hit.append(int(np.bitwise_count(np.bitwise_or.reduce(hits)).sum()) if hits else 0)
                ids = sorted(set(items))
                n_items.append(len(ids))
                sums.append(hashlib.sha256(",".join(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array(n_hit, pa.int64()), pa.array(n_items, pa.int64()), pa.array(sums), pa.array([x > 0 for x in n_hit]), b.column(5), b.column(6)], names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest", "longest_at"])

    return found.mapInArrow(count, f"doc_id {id_type}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest long, longest_at long")


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs, all columns, without the rows that hold a window of the benchmark; rows without words stay."""
    ship(docs.sparkSession)
    column = docs.columns.index("text")

    def keep(index):
        def run(batches):
            import pyarrow as pa

            for held, encoded in _shards(batches, column, index.value):
                bad = {d for d, *_ in shard_matches(encoded, index.value)}
                at = 0
                for part in held:
                    yield part.filter(pa.array([i not in bad for i in range(at, at + part.num_rows)], pa.bool_()))
                    at += part.num_rows

        return run

    for index in _blocks(benchmark, window):
        docs = docs.mapInArrow(keep(index), docs.schema)
    return docs
