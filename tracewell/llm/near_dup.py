"""MinHash near-duplicate detection with tensored banding.

Two small collections of SIDE half-keys of HALF minhashes each are computed per document; each pair of one half-key of
either collection is the key of a table. SIDE * SIDE tables of 2 * HALF minhashes thus cost 2 * SIDE * HALF minhashes,
about the square root. A pair at similarity J meets in some table with probability (1 - (1 - J^HALF)^SIDE)^2: 0.9997 at
0.85 with the defaults, and documents of a group usually have many pairs that can link them.

Documents with equal shingle sets form a class first and only the smallest of each is looked at further. In each bucket
every member is compared with the smallest one (a star). Where that leaves a bucket in several components, shingles that
only one of these documents has are counted: what is left of either set bounds the intersection, and pairs that cannot
reach the threshold are never made. A second star is drawn around the member with the least of its own, its hub, and at
last the pairs of members in different components that can still be linked are made from what their sets hold beside
those of the hub: two sets without a shingle in common there have no more in common than the smaller of their parts in
the hub, and if that does not reach, only members with such a shingle in common are compared. Large groups thus cost one
comparison for each member and table, while no candidate pair that could still join two components goes unverified. Links
are confirmed on full shingle sets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_counted, ship, slices, space_words, stored, tidy
from .line_dedup import running_sum

SHINGLE = 5
SIDE, HALF = 9, 3
SEED = 20240607
#: Candidate ids up to this number are broadcast to find their texts; more are shuffled.
BROADCAST_IDS = 1_000_000
#: Pairs that are verified with one copy of the text that they have in common; and rows of a hub that meet all others together.
PAIRS_PER_PART, ROWS_PER_PART = 64, 256
MIX1, MIX2 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def shingle_set(text: str | None):
    """Sorted distinct 64-bit hashes of the 5-word shingles; with fewer words, of the whole sequence; none without words."""
    import numpy as np
    import xxhash

    words = space_words(text)
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < SHINGLE:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    a = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(a) - SHINGLE + 1
    h = np.full(n, SHINGLE, np.uint64)
    for k in range(SHINGLE):
        h = (h ^ a[k : k + n]) * np.uint64(MIX1)
        h ^= h >> np.uint64(29)
    h *= np.uint64(MIX2)
    return np.unique(h ^ (h >> np.uint64(32)))


def half_keys(shingles, side: int, half: int):
    """2 * side half-keys: minhashes by multiply-shift, folded `half` at a time."""
    import numpy as np

    rng = np.random.default_rng(SEED)
    n = 2 * side * half
    a = rng.integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 1 << 63, n, dtype=np.uint64)
    mins = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 1024):  # fits the processor's caches
        x = shingles[at : at + 1024]
        for k in range(n):
            m = (((x * a[k]) ^ b[k]) >> np.uint64(1)).min()
            if m < mins[k]:
                mins[k] = m
    out = np.arange(2 * side, dtype=np.uint64)
    for k in range(half):
        out = (out ^ mins.reshape(2 * side, half)[:, k]) * np.uint64(MIX1)
        out ^= out >> np.uint64(31)
    return out.astype(np.int64)


def _sketches(docs: DataFrame, side: int, half: int) -> DataFrame:
    """doc_id, mark (hash of the text), n_shingles, digest of the set, and the half-keys of documents that have shingles."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import xxhash

        for batch in batches:
            for part in slices(batch, 1):
                sizes, digests, keys = [], [], []
                for text in part.column(1).to_pylist():
                    s = shingle_set(text)
                    sizes.append(len(s))
                    digests.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                    keys.append(half_keys(s, side, half) if len(s) else np.zeros(0, np.int64))
                ends = np.cumsum([0, *map(len, keys)])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(keys)))], names=["doc_id", "mark", "n_shingles", "digest", "halves"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("mark")).mapInArrow(run, "doc_id long, mark long, n_shingles long, digest binary, halves array<long>")


def _texts(ids: DataFrame, reps: DataFrame, docs: DataFrame) -> DataFrame:
    """(id, text) of the classes in ids: the text of the row that stands for each."""
    wanted = reps.join(ids, "id", "left_semi")
    few = ids.count() <= BROADCAST_IDS
    rows = docs.select(F.col("doc_id").cast("long").alias("rep_doc"), "text")
    met = rows.join(F.broadcast(wanted) if few else wanted, "rep_doc").where(F.xxhash64("text") == F.col("rep_mark"))
    return met.groupBy("id").agg(F.min("text").alias("text"))  # rows that repeat id and text


def _side_by_side(pairs: DataFrame, reps: DataFrame, docs: DataFrame) -> DataFrame:
    """(a, text_a, b, text_b) for pairs (a, b) of classes.

    a may stand in any number of pairs: those are dealt out in parts of PAIRS_PER_PART, each with its own copy of a's
    text. b is in a few pairs only.
    """
    ids = stored(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "dup-ids")
    texts = stored(_texts(ids, reps, docs), "dup-texts")
    counts = stored(pairs.groupBy("a").agg(F.count("*").alias("n")).withColumn("parts", F.ceil(F.col("n") / PAIRS_PER_PART)), "dup-parts")
    left = texts.withColumnRenamed("text", "text_a").join(counts.select(F.col("a").alias("id"), "parts"), "id").select(F.col("id").alias("a"), "text_a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    dealt = join_counted(pairs, counts, ["a"]).select("a", "b", F.pmod(F.xxhash64("b"), "parts").alias("part"))
    return dealt.join(right, "b").join(left, ["a", "part"]).select("a", "text_a", "b", "text_b")


def _verified(pairs: DataFrame, reps: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of classes whose full shingle sets satisfy 100 * intersection >= percent * union."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        last, mine = None, None
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ok = []
                for a, ta, tb in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(3).to_pylist(), strict=True):
                    if last is None or a != last:
                        last, mine = a, shingle_set(ta)
                    other = shingle_set(tb)
                    common = len(np.intersect1d(mine, other, assume_unique=True))
                    ok.append(100 * common >= percent * (len(mine) + len(other) - common))
                keep = pa.array(ok, pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2)], names=["a", "b"]).filter(keep)

    return _side_by_side(pairs, reps, docs).mapInArrow(run, "a long, b long")


def _beside(pairs: DataFrame, reps: DataFrame, docs: DataFrame) -> DataFrame:
    """(hub, rep, common, others) for pairs (a, b) of a hub and a class: how many shingles they share, and those of b alone."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        last, mine = None, None
        for batch in batches:
            for part in slices(batch, 3, 256):
                common, others = [], []
                for a, ta, tb in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(3).to_pylist(), strict=True):
                    if last is None or a != last:
                        last, mine = a, shingle_set(ta)
                    other = shingle_set(tb)
                    others.append(np.setdiff1d(other, mine, assume_unique=True).astype(np.int64))
                    common.append(len(other) - len(others[-1]))
                ends = np.cumsum([0, *map(len, others)])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(common, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(others)))], names=["hub", "rep", "common", "others"])

    return _side_by_side(pairs, reps, docs).mapInArrow(run, "hub long, rep long, common long, others array<long>")


def _lone_shingles(ids: DataFrame, reps: DataFrame, docs: DataFrame) -> DataFrame:
    """(rep, alone): the shingles of each class of ids that occur in no other of them; classes without such are left out."""
    texts = _texts(ids.withColumnRenamed("rep", "id"), reps, docs)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch, 1, 256):
                sets = [shingle_set(t) for t in part.column(1).to_pylist()]
                reps = np.repeat(part.column(0).to_numpy(), [len(s) for s in sets])
                yield pa.RecordBatch.from_arrays([pa.array(reps), pa.array(np.concatenate(sets).astype(np.int64))], names=["rep", "h"])

    found = texts.mapInArrow(run, "rep long, h long").groupBy("h").agg(F.min("rep").alias("rep"), F.count("*").alias("n")).where("n = 1")
    return found.groupBy("rep").agg(F.collect_list("h").alias("alone"))


def _still_possible(at_hubs: DataFrame, able: DataFrame, classes: DataFrame, reps: DataFrame, docs: DataFrame, side: int, percent: int) -> DataFrame | None:
    """Pairs (a, b) of classes of different components, one of them not in that of their hub, that can still be linked; None if no class is outside.

    at_hubs: hub, hub_c, rep, n_shingles, c, once for each hub and class that meet in a bucket; able: rep and the
    shingles that are in no other class (`alone`), which no pair shares. Of a pair x, y with the
    hub h, the intersection is at most min(|x & h|, |y & h|) and what x and y share beside h. Pairs that share nothing
    there are made only if the first alone reaches, and only if they meet in a bucket; of the others, what they share is counted.
    """
    outside = F.col("c") != F.col("hub_c")
    hubs = at_hubs.groupBy("hub").agg(F.count("*").alias("n"), F.count_if(outside).alias("outside"), F.min("n_shingles").alias("least")).where("outside > 0 and n > 1")
    hubs = stored(hubs, "dup-outside")
    if not hubs.take(1):
        return None
    still = stored(join_counted(at_hubs, hubs, ["hub"]).drop("n", "outside"), "dup-still")
    beside = _beside(still.select(F.col("hub").alias("a"), F.col("rep").alias("b")), reps, docs)
    beside = beside.join(still, ["hub", "rep"]).join(able.select("rep", "alone"), "rep")
    still = stored(beside.withColumn("others", F.when(F.col("alone").isNull(), F.col("others")).otherwise(F.array_except("others", "alone"))).drop("alone"), "dup-beside")
    tidy(still.sparkSession)

    def reaches(most: Column, n: Column, m: Column) -> Column:
        return most * (100 + percent) >= (n + m) * percent

    def met(rows: DataFrame, counts: DataFrame, keys: list[str], more: list[str]) -> DataFrame:
        """Pairs x, y of rows with equal keys, x outside the hub's component; counts: n rows of each of the keys, `outside` of them outside."""
        dealt = join_counted(rows, stored(counts.withColumn("parts", F.ceil(F.col("outside") / ROWS_PER_PART)), "dup-parts"), keys)
        left = dealt.where(outside).select(*keys, F.pmod(F.xxhash64("rep"), "parts").alias("part"), F.col("rep").alias("x"), F.col("n_shingles").alias("n_x"), F.col("common").alias("common_x"), F.col("c").alias("cx"), *[F.col(k).alias(f"{k}_x") for k in more])
        right = dealt.select(*keys, "hub_c", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.col("rep").alias("y"), F.col("n_shingles").alias("n_y"), F.col("common").alias("common_y"), F.col("c").alias("cy"), *[F.col(k).alias(f"{k}_y") for k in more])
        return left.join(right, [*keys, "part"]).where("cx <> cy and (cy = hub_c or x < y)")

    in_hub = F.least("common_x", "common_y")
    near = still.drop("others").where(reaches(F.col("common"), F.col("n_shingles"), F.col("least")) | ~outside)
    near = stored(near.join(classes.select(F.col("id").alias("rep"), "halves"), "rep"), "dup-inner")
    counts = near.groupBy("hub").agg(F.count("*").alias("n"), F.count_if(outside).alias("outside")).where("outside > 0")
    overlap = [F.arrays_overlap(F.slice("halves_x", at, side), F.slice("halves_y", at, side)) for at in (1, side + 1)]
    inner = stored(met(near, counts, ["hub"], ["halves"]).where(reaches(in_hub, F.col("n_x"), F.col("n_y"))).where(overlap[0] & overlap[1]).select("x", "y"), "dup-inner")
    tidy(still.sparkSession)

    shared = stored(still.withColumn("h", F.explode("others")).drop("others"), "dup-tokens")
    counts = shared.groupBy("hub", "h").agg(F.count("*").alias("n"), F.count_if(outside).alias("outside")).where("outside > 0 and n > 1")
    shared = stored(join_counted(shared, stored(counts.select("hub", "h", "n", "outside"), "dup-shared"), ["hub", "h"]).drop("n", "outside"), "dup-tokens")
    own = shared.groupBy("hub", "rep").agg(F.count("*").alias("own"))
    shared = stored(shared.join(own, ["hub", "rep"]).where(reaches(F.col("common") + F.col("own"), F.col("n_shingles"), F.col("least")) | ~outside), "dup-tokens")
    counts = shared.groupBy("hub", "h").agg(F.count("*").alias("n"), F.count_if(outside).alias("outside")).where("outside > 0 and n > 1")
    pairs = met(shared, counts, ["hub", "h"], ["own"]).where(reaches(in_hub + F.least("own_x", "own_y"), F.col("n_x"), F.col("n_y")))
    pairs = pairs.groupBy("hub", "x", "y", "n_x", "n_y", "common_x", "common_y").agg(F.count("*").alias("beside")).where(reaches(in_hub + F.col("beside"), F.col("n_x"), F.col("n_y"))).select("x", "y")
    return stored(inner.unionByName(pairs).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "dup-rest")


def components(edges: DataFrame, name: str = "dup") -> DataFrame:
    """(id, component) of every node of edges (a, b); component is the smallest id reachable. Alternating stars.

    Each round points nodes at the smallest neighbour (large star), then neighbours at the smallest of themselves (small
    star), until nothing changes; every node ends at the smallest of its component. Rounds are logarithmic in practice.
    """
    edges = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}-edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = stored(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), f"{name}-low")  # a table, so that joins on hubs can be split
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        edges = stored(small, f"{name}-edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if before == now:
            return edges.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("id"), "component").unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
        before = now


def _classes(rows: DataFrame) -> DataFrame:
    """One row for each distinct set: digest, n_shingles, halves, n (rows), rep_doc, rep_mark (smallest doc_id and its text's hash), id.

    id grows with rep_doc; it is rep_doc itself unless one doc_id stands for several sets.
    """
    some = rows.where("doc_id is not null and n_shingles > 0").groupBy("digest", "n_shingles")
    made = some.agg(F.min(F.struct("doc_id", "mark")).alias("r"), F.first("halves").alias("halves"), F.count("*").alias("n"))
    made = stored(made.select("digest", "n_shingles", "halves", "n", F.col("r.doc_id").alias("rep_doc"), F.col("r.mark").alias("rep_mark")), "dup-classes")
    if not made.groupBy("rep_doc").agg(F.count("*").alias("k")).where("k > 1").take(1):
        return made.withColumn("id", F.col("rep_doc"))
    numbered = running_sum(made.select("rep_doc", "digest", F.lit(1).alias("one")), ["rep_doc", "digest"], "one", "dup-numbers")
    return stored(made.join(numbered.select("digest", F.col("before").alias("id")), "digest"), "dup-classes")


def near_duplicates(docs: DataFrame, percent: int = 85, side: int = SIDE, half: int = HALF) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, mark, first: one row per row of docs (doc_id, text; other columns are not read).

    Words are runs without ASCII white space, A-Z lower-cased; a document's set is its distinct 5-word shingles, or the
    whole sequence if it has fewer words. Null, empty and blank texts have an empty set and link with nothing. Rows are
    linked if 100 * intersection >= percent * union; component_id is the smallest doc_id reachable and kept marks the
    rows it names. Rows that share a doc_id but not the text are rows of their own, each linked by its own set. mark is
    the xxhash64 of the text, and `first` is true for the rows of one (doc_id, mark) of each component only, so these and
    one of their repeats are what deduplication keeps. A row with null doc_id is never linked and has a null component,
    kept and first. Empty table: no rows.
    """
    ship(docs.sparkSession)
    rows = stored(_sketches(docs, side, half), "dup-sketches")
    classes = _classes(rows)
    reps = classes.select("id", "rep_doc", "rep_mark")
    left, right = F.slice("halves", 1, side), F.slice("halves", side + 1, side)
    keys = F.flatten(F.transform(left, lambda x: F.transform(right, lambda y: F.xxhash64(x, y))))
    members = classes.select(F.col("id").alias("rep"), "n_shingles", F.explode(keys).alias("key"))
    smallest = F.min(F.struct("rep", F.col("n_shingles").alias("n")))
    buckets = stored(members.groupBy("key").agg(smallest.alias("c"), F.count("*").alias("n")).where("n > 1").select("key", F.col("c.rep").alias("center"), F.col("c.n").alias("center_n"), "n"), "dup-buckets")
    met = join_counted(members, buckets, ["key"]).where("rep <> center")

    def possible(n: Column, m: Column) -> Column:
        return F.least(n, m) * 100 >= F.greatest(n, m) * percent

    stars = stored(met.where(possible(F.col("n_shingles"), F.col("center_n"))).select(F.col("center").alias("a"), F.col("rep").alias("b")).distinct(), "dup-stars")
    links = stored(_verified(stars, reps, docs, percent), "dup-links")
    tidy(docs.sparkSession)
    first = stored(components(links), "dup-first")
    tidy(docs.sparkSession)
    # What stars can miss: pairs of a bucket in different components, one of them not in that of the bucket's smallest.
    wide = buckets.where("n > 2").join(first.select(F.col("id").alias("center"), F.col("component").alias("cc")), "center", "left").select("key", "center", F.coalesce("cc", "center").alias("center_c"), "n")
    labelled = classes.select(F.col("id").alias("rep"), "n_shingles", "halves").join(first.withColumnRenamed("id", "rep"), "rep", "left")
    labelled = stored(labelled.select("rep", "n_shingles", "halves", F.coalesce("component", "rep").alias("c")), "dup-labelled")  # before a class has a row for each of its tables
    inside = join_counted(labelled.select("rep", "n_shingles", "c", F.explode(keys).alias("key")), stored(wide, "dup-wide"), ["key"])
    inside = stored(inside.select("key", "rep", "n_shingles", "center", "center_c", "c"), "dup-inside")
    split = stored(inside.groupBy("key").agg(F.count("*").alias("n"), F.max(F.col("c") != F.col("center_c")).alias("open")).where("open").select("key", "n"), "dup-split")
    inside = join_counted(inside, split, ["key"]).drop("n")
    opened = stored(inside.select("rep", "n_shingles").distinct(), "dup-open")
    able = opened.join(_lone_shingles(opened.select("rep"), reps, docs), "rep", "left").withColumn("shared", F.col("n_shingles") - F.when(F.col("alone").isNull(), 0).otherwise(F.size("alone")))
    able = stored(able.where(F.col("shared") * 100 >= F.col("n_shingles") * percent).select("rep", "shared", "alone"), "dup-shared")
    inside = stored(inside.join(able.drop("alone"), "rep").drop("center_c"), "dup-able")

    def reachable(n: Column, n_shared: Column, m: Column, m_shared: Column) -> Column:
        most = F.least(n_shared, m_shared)  # no pair has more in common
        return most * 100 >= (n + m - most) * percent

    # A second star around the member with the least of its own: of a group of edited copies, the one nearest to their origin.
    best = F.max(F.struct((F.col("shared") / F.col("n_shingles")).alias("share"), (-F.col("rep")).alias("o"), F.col("rep").alias("hub"), F.col("n_shingles").alias("m"), F.col("shared").alias("m_shared"), F.col("c").alias("hub_c")))
    hubs = stored(inside.groupBy("key").agg(best.alias("hub"), F.count("*").alias("n")).select("key", "hub.hub", "hub.m", "hub.m_shared", "hub.hub_c", "n"), "dup-hubs")
    at_hubs = join_counted(inside, hubs, ["key"]).where("rep <> center and rep <> hub")  # the center has been compared with all of the bucket
    at_hubs = stored(at_hubs.select("hub", "m", "m_shared", "hub_c", "rep", "n_shingles", "shared", "c").distinct(), "dup-hubbed")
    near = at_hubs.where("c <> hub_c").where(reachable(F.col("n_shingles"), F.col("shared"), F.col("m"), F.col("m_shared")))
    near = stored(near.select(F.col("hub").alias("a"), F.col("rep").alias("b")), "dup-near")
    if near.take(1):
        links = stored(links.unionByName(_verified(near, reps, docs, percent)), "dup-links")
        first = stored(components(links), "dup-second")
    tidy(docs.sparkSession)
    of_hubs = at_hubs.select("hub").distinct().join(first.withColumnRenamed("id", "hub"), "hub", "left").select("hub", F.coalesce("component", "hub").alias("hub_c"))
    of_reps = at_hubs.select("rep").distinct().join(first.withColumnRenamed("id", "rep"), "rep", "left").select("rep", F.coalesce("component", "rep").alias("c"))
    counted = at_hubs.groupBy("hub").agg(F.count("*").alias("n")).join(of_hubs, "hub")
    at_hubs = join_counted(at_hubs.select("hub", "rep", "n_shingles"), stored(counted, "dup-hubs"), ["hub"]).drop("n").join(of_reps, "rep")
    more = _still_possible(stored(at_hubs, "dup-hubbed"), able, classes, reps, docs, side, percent)
    if more is not None and more.take(1):
        links = stored(links.unionByName(_verified(more, reps, docs, percent)), "dup-links")
        first = stored(components(links), "dup-all")
    tidy(docs.sparkSession)
    names = first.groupBy("component").agg(F.count("*").alias("n")).join(reps.select(F.col("id").alias("component"), F.col("rep_doc").alias("component_id")), "component")
    named = join_counted(first, stored(names, "dup-names"), ["component"]).select("id", "component", "component_id")
    of_class = classes.join(named, "id", "left").select("digest", "n", "rep_doc", "rep_mark", F.coalesce("component_id", "rep_doc").alias("component_id"), F.coalesce(F.col("component") == F.col("id"), F.lit(True)).alias("leads"))
    linked = join_counted(rows.where("doc_id is not null and digest is not null").drop("halves", "n_shingles").withColumnRenamed("digest", "of"), stored(of_class.join(classes.select("digest", "n_shingles"), "digest").withColumnRenamed("digest", "of"), "dup-of"), ["of"])
    out = linked.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"), "mark", (F.col("leads") & (F.col("doc_id") == F.col("rep_doc")) & (F.col("mark") == F.col("rep_mark"))).alias("first"))
    alone = rows.where("doc_id is null or digest is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"), "mark", F.lit(True).alias("first"))
    return out.unionByName(alone)
