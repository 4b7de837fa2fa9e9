"""Line dedup: a suffix array over line ids by distributed prefix doubling; later copies of repeated runs go.

All lines get one global position, in the order of doc_id; copies of whole texts are settled by their hashes. Lines that occur once can be in no repeat, so the suffix array
holds the others; a suffix ends where its stretch of them, or its document, ends. Each doubling joins every suffix with
the rank of the one 2^k lines on, counts equal pairs, and ranks them by a global running sum over a range-sorted table.
Whatever is very common (a line, a pair of ranks, a whole text) meets its rows by broadcast, not in one task.
Neighbours in the finished array are compared with the ranks of all rounds, which gives the longest common prefixes.
In the intervals these span, each suffix needs the nearest neighbour with a smaller position on either side: the longer
of the two common prefixes is the longest run that starts there and occurred before. Parts of the array are scanned in
parallel; what one part hands to the next is a stair of at most one entry for each distinct length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import join_counted, ship, slices, steady, stored

MIN_WORDS = 5
#: Bits of a position that number the lines of a document; the others number documents.
LINE_BITS = 28


def _lines(text: str | None) -> list[str]:
    return text.split("\n") if text else []


def running_sum(df: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """df with `before`: the sum of value over all rows before it in the order, whose keys are distinct; and `part`."""
    parts = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()), name)
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.groupBy("part").agg(F.sum(value).alias("s")).select("part", F.coalesce(F.sum("s").over(upto), F.lit(0)).alias("offset"))  # a row for each part
    within = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn("local", F.coalesce(F.sum(value).over(within), F.lit(0))).join(F.broadcast(offsets), "part").withColumn("before", F.col("local") + F.col("offset")).drop("local", "offset")


def _later_copies(docs: DataFrame) -> DataFrame:
    """row_key of rows whose whole text an earlier row has, by two 64-bit hashes: all they hold occurred before."""
    marks = docs.where(F.length("text") > 0).select("doc_id", "row_key", F.xxhash64(F.lit(1), "text").alias("a"), F.xxhash64(F.lit(2), "text").alias("b"))
    marks = stored(marks, "line-texts")
    first = stored(marks.groupBy("a", "b").agg(F.min(F.struct("doc_id", "row_key")).alias("first"), F.count("*").alias("n")).where("n > 1"), "line-firsts")
    return stored(join_counted(marks, first, ["a", "b"]).where(F.col("row_key") != F.col("first.row_key")).select("row_key"), "line-copies")


def _line_table(docs: DataFrame, copies: DataFrame) -> DataFrame:
    """(row_key, pos, j, h): every line's hash, with a position that grows with document and line; later copies of whole texts are left out."""
    order = running_sum(docs.select("doc_id", "row_key", F.lit(1).alias("one")), ["doc_id", "row_key"], "one", "line-docs").select("row_key", F.col("before").alias("document"))
    order = order.join(copies, "row_key", "left_anti")

    def run(batches):
        import pyarrow as pa
        import xxhash

        for batch in batches:
            for part in slices(batch, 1):
                keys, numbers, hashes = [], [], []
                for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    lines = _lines(text)
                    if len(lines) >> LINE_BITS:
                        raise ValueError("a document has too many lines")
                    for j, line in enumerate(lines):
                        keys.append(key)
                        numbers.append(j)
                        hashes.append(xxhash.xxh3_64_intdigest(line.encode("utf-8", "surrogatepass")) - (1 << 63))
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(numbers, pa.int64()), pa.array(hashes, pa.int64())], names=["row_key", "j", "h"])

    lines = docs.select("row_key", "text").mapInArrow(run, "row_key long, j long, h long")
    return lines.join(order, "row_key").select("row_key", (F.shiftleft("document", LINE_BITS) + F.col("j")).alias("pos"), F.col("j"), "h")


def suffix_array(lines: DataFrame) -> DataFrame:
    """(pos, ranks, rem) of the suffixes that start with a line that occurs more than once.

    ranks[k] orders suffixes by their first 2^k lines; rem is the number of lines up to the suffix's end.
    """
    twice = stored(lines.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), "line-classes")
    first = stored(running_sum(twice, ["h"], "n", "line-ranks").select("h", "n", F.col("before").alias("rank")), "line-ranks")
    live = join_counted(lines, first, ["h"]).select("row_key", "pos", "rank")
    stretch = Window.partitionBy("row_key").orderBy("pos")
    live = live.withColumn("stretch", F.col("pos") - F.row_number().over(stretch))
    last = Window.partitionBy("row_key", "stretch")
    live = stored(live.select("pos", (F.max("pos").over(last) - F.col("pos") + 1).alias("rem"), F.array("rank").alias("ranks")), "line-suffixes")
    classes, h = twice.count(), 1
    while classes:
        after = live.select((F.col("pos") - h).alias("pos"), F.col("ranks")[F.size("ranks") - 1].alias("second"))
        both = live.withColumn("first", F.col("ranks")[F.size("ranks") - 1]).join(after, "pos", "left").withColumn("second", F.when(F.col("rem") > h, F.col("second")).otherwise(-1))
        both = stored(both, "line-pairs")
        pairs = stored(running_sum(both.groupBy("first", "second").agg(F.count("*").alias("n")), ["first", "second"], "n", "line-order").select("first", "second", "n", F.col("before").alias("rank")), "line-named")
        now = pairs.count()
        if now == classes:
            return live
        live = stored(join_counted(both, pairs, ["first", "second"]).select("pos", "rem", F.array_append("ranks", F.col("rank")).alias("ranks")), "line-suffixes")
        classes, h = now, 2 * h
    return live


def _neighbours(suffixes: DataFrame) -> DataFrame:
    """(part, seq, pos, lcp): the suffix array in order, cut into parts, with the common prefix with the suffix before."""
    order = suffixes.select("pos", F.col("ranks")[F.size("ranks") - 1].alias("rank")).withColumn("one", F.lit(1))
    order = stored(running_sum(order, ["rank", "pos"], "one", "line-array").select("part", F.col("before").alias("seq"), "pos"), "line-array")
    inside = order.withColumn("prev", F.lag("pos").over(Window.partitionBy("part").orderBy("seq")))
    ends = order.groupBy("part").agg(F.max(F.struct("seq", "pos"))["pos"].alias("last")).select("part", F.lag("last").over(Window.orderBy("part")).alias("before"))  # a row for each part
    pairs = stored(inside.join(F.broadcast(ends), "part").select("part", "seq", "pos", F.coalesce("prev", "before").alias("prev"), F.lit(0).cast("long").alias("lcp"), F.lit(True).alias("open")), "line-lcp")
    levels = suffixes.select("pos", "ranks", "rem")
    done = None
    while True:
        closed = pairs.where("not open or prev is null")
        done = closed if done is None else done.unionByName(closed)
        pairs = pairs.where("open and prev is not null")
        if not pairs.take(1):
            return done.select("part", "seq", "pos", "lcp")
        here = levels.select(F.col("pos").alias("a"), F.col("ranks").alias("ranks_a"), F.col("rem").alias("rem_a"))
        there = levels.select(F.col("pos").alias("b"), F.col("ranks").alias("ranks_b"), F.col("rem").alias("rem_b"))
        met = pairs.withColumn("a", F.col("pos") + F.col("lcp")).withColumn("b", F.col("prev") + F.col("lcp")).join(here, "a").join(there, "b")
        same = F.size(F.filter(F.zip_with("ranks_a", "ranks_b", lambda x, y: x == y), lambda x: x))
        step = F.when(same > 0, F.least(F.pow(F.lit(2), same - 1).cast("long"), F.col("rem_a"), F.col("rem_b"))).otherwise(0)
        pairs = stored(met.withColumn("step", step).select("part", "seq", "pos", "prev", (F.col("lcp") + F.col("step")).alias("lcp"), ((F.col("step") > 0) & (F.col("step") < F.least("rem_a", "rem_b"))).alias("open")), "line-lcp")


def scan(pos: list[int], link: list[int], carry: list[tuple[int, int]]):
    """For each suffix the longest common prefix with an earlier-scanned one of smaller position.

    link[i]: common prefix of i and the one scanned before it. carry: what earlier parts left, (position, common prefix
    with their last suffix), both rising; the last has no bound. Also gives what this part, with its carry, leaves.
    """
    stack = [(p, carry[k - 1][1] if k else 0) for k, (p, _) in enumerate(carry)]
    best = []
    for p, c in zip(pos, link, strict=True):
        if not c:
            stack.clear()
        while stack and stack[-1][0] > p:
            c = min(c, stack.pop()[1])
        best.append(c if stack else 0)
        stack.append((p, c if stack else 0))
    left, reach = [], 1 << 62
    for p, c in reversed(stack):
        if not reach:
            break
        if left and left[-1][1] == reach:
            left[-1] = (p, reach)  # reaches as far and comes earlier
        else:
            left.append((p, reach))
        reach = min(reach, c)
    return best, left[::-1]


def join_stairs(carry: list[tuple[int, int]], lowest: int, own: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The stair after a part: what came in, cut to the part's lowest link, below what the part leaves by itself."""
    out: list[tuple[int, int]] = []
    for p, reach in [(p, min(r, lowest)) for p, r in carry if min(r, lowest)] + own:
        while out and out[-1][0] > p:
            out.pop()
        if not out or out[-1][1] < reach:
            out.append((p, reach))
    return out


def repeats(array: DataFrame) -> DataFrame:
    """(pos, size): the longest run of lines from pos on that also starts at an earlier position; 0 is left out."""

    def links(table):
        table = table.sort_by("seq")
        return table["pos"].to_pylist(), table["lcp"].to_pylist()

    def stairs(key, table):
        import pyarrow as pa

        pos, lcp = links(table)
        rows = []
        for back in (False, True):
            p, c = (pos[::-1], [0, *lcp[:0:-1]]) if back else (pos, [0, *lcp[1:]])
            rows.append([x for pair in scan(p, c, [])[1] for x in pair])
        return pa.table({"part": pa.array([key[0].as_py()], pa.int64()), "first": [lcp[0]], "lowest": [min(lcp[1:], default=1 << 62)], "right": pa.array([rows[0]], pa.list_(pa.int64())), "left": pa.array([rows[1]], pa.list_(pa.int64()))})

    array = array.withColumn("part", F.col("part").cast("long"))
    made = sorted(array.groupBy("part").applyInArrow(stairs, "part long, first long, lowest long, right array<long>, left array<long>").collect(), key=lambda r: r["part"])  # a row for each part
    pairs = lambda flat: list(zip(flat[::2], flat[1::2], strict=True))
    before, after, carry = {}, {}, []
    for r in made:
        before[r["part"]] = carry
        carry = join_stairs(carry, min(r["first"], r["lowest"]), pairs(r["right"]))
    carry, following = [], 0
    for r in reversed(made):
        after[r["part"]] = (carry, following)
        carry = join_stairs(carry, min(following, r["lowest"]), pairs(r["left"]))
        following = r["first"]
    shared = array.sparkSession.sparkContext.broadcast((before, after))  # stairs of parts

    def run(key, table):
        import numpy as np
        import pyarrow as pa

        pos, lcp = links(table)
        before, after = (x[key[0].as_py()] for x in shared.value)
        up, _ = scan(pos, lcp, before)
        down, _ = scan(pos[::-1], [after[1], *lcp[:0:-1]], after[0])
        size = np.maximum(up, down[::-1])
        keep = size > 0
        return pa.table({"pos": pa.array(np.array(pos)[keep]), "size": pa.array(size[keep], pa.int64())})

    return array.groupBy("part").applyInArrow(run, "pos long, size long")


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, n_lines, n_removed, words_removed, text: one row per row of docs (doc_id, text; others are not read).

    Lines are what "\\n" separates, compared as they are. Occurrences are ordered by doc_id (null first), then row, then
    line. For every line the longest run of lines from it on that also starts at an earlier place is found; if it has
    min_words words or more, all its lines go, so the first copy of everything stays. Shorter repeats stay. Null and
    empty texts have no lines and stay as they are; a text whose lines all go becomes empty. Repeated rows are copies of
    the first. Empty table: no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = steady(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "line-input")
    base = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row_key"))
    copies = _later_copies(base)
    lines = stored(_line_table(base, copies), "lines")
    found = repeats(_neighbours(suffix_array(lines)))
    at = found.join(lines.select("pos", "row_key", "j"), "pos").groupBy("row_key").agg(F.collect_list(F.struct("j", "size")).alias("runs"))  # as many as a document has lines
    at = at.unionByName(copies.select("row_key", F.array(F.struct(F.lit(0).cast("long").alias("j"), F.lit(-1).cast("long").alias("size"))).alias("runs")))  # all lines

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            out = {c: [] for c in ("n_lines", "n_removed", "words_removed", "text")}
            for text, runs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                lines = _lines(text)
                words = np.array([len(x.encode("utf-8", "surrogatepass").split()) for x in lines], np.int64)
                upto = np.concatenate([[0], np.cumsum(words)])
                cover = np.zeros(len(lines) + 1, np.int64)
                for r in runs or []:
                    a, b = r["j"], r["j"] + r["size"] if r["size"] >= 0 else len(lines)
                    if upto[b] - upto[a] >= min_words:
                        cover[a] += 1
                        cover[b] -= 1
                gone = np.cumsum(cover[:-1]) > 0
                kept = text if not gone.any() else "\n".join(x for x, g in zip(lines, gone, strict=True) if not g)
                for c, v in zip(out, (len(lines), int(gone.sum()), int(words[gone].sum()), kept), strict=True):
                    out[c].append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(out[c], pa.int64()) for c in list(out)[:3]), pa.array(out["text"], pa.string())], names=["doc_id", *out])

    return base.join(at, "row_key", "left").select("doc_id", "text", "runs").mapInArrow(run, "doc_id long, n_lines long, n_removed long, words_removed long, text string")
