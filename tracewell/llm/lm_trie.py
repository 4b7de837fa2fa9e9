"""Language-model scoring with a trie of n-grams up to order 3 in Elias-Fano levels, spread over shards by context.

p(w | u v) = ((1 - SHARE3) c(u v w) + (MU3 + SHARE3 c(u v)) p(w | v)) / (c(u v) + MU3), and p(w | v) likewise from c(v w)
and p1(w), which is add-one smoothed; where a context never occurred, the lower order stands. Each sums to 1 over w.

Texts are cut into blocks of BLOCK_TOKENS, which tasks write as files of word ids. Each block asks the shard of a word v
for its count, for the words after v, the words u before v, and the words after each u v, all of them distinct and along
with their training counts. The shard adds the counts of all blocks up and builds its trie: contexts, monotone pointers,
successors relative to their context (after u v they are told by their place among the successors of v), probabilities
as 8-bit codes; maps it into memory, and answers every block by successor search. Where a folder is given the tries stay
there, and other texts can be scored with them later.

What moves are distinct n-grams of blocks, so an n-gram however frequent is one row of each block. A word v that holds
much of the text is dealt out: the words after it to one set of shards, the pairs u v to another, as many of them as its
count asks for. Words are 64-bit hashes; inside a context, they are told apart by 32 bits of theirs.
"""

from __future__ import annotations

import io
import uuid
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import file_system, new_folder, publish, ship, space_words, stored, tidy

MU2, SHARE2, MU3, SHARE3 = 16.0, 0.5, 1.0, 0.2
BLOCK_TOKENS, SHARD_TOKENS = 1_000_000, 750_000
#: Shards are served in so many rounds, so that only a part of all requests is on disk at once.
ROUNDS = 2
#: Words of more training tokens than this are dealt out in parts of about as many; the MOST_HEAVY most frequent of them at most.
PART_TOKENS, MOST_HEAVY = 500_000, 1_000_000
END, BEGIN = 1, 2  # hashes of no word: those get bit 2 set, parts of dealt-out words do not
WORD_BIT = 4
#: The square of a code, scaled, is -log10 p: the smallest p that codes tell apart is 10 ** -DEPTH. 255: absent.
DEPTH, ABSENT = 10.0, 255
MOST_KEY = 1 << 62
SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def word_hashes(words: list[bytes]):
    import numpy as np
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)) | np.uint64(WORD_BIT)


def _write(folder: str, name: str, data: bytes) -> None:
    fs, root = file_system(folder)
    temp = f"{root}/{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(temp) as out:
        out.write(data)
    publish(fs, temp, f"{root}/{name}")


def _save(folder: str, name: str, **arrays) -> None:
    import numpy as np
    import zstandard

    data = io.BytesIO()
    np.savez(data, **arrays)
    _write(folder, name, zstandard.ZstdCompressor(level=1).compress(data.getbuffer()))


def _load(folder: str, name: str) -> dict:
    import numpy as np
    import zstandard

    fs, root = file_system(folder)
    with fs.open_input_file(f"{root}/{name}") as source, np.load(io.BytesIO(zstandard.ZstdDecompressor().decompress(source.read()))) as data:
        return dict(data)


def _blocks(docs: DataFrame, folder: str, parts: int, which: int, learn: bool) -> DataFrame:
    """Writes blocks, and the words of each with their training counts beside it; gives (block, tokens, train_tokens) for each."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        task, held, n, k = TaskContext.get().partitionId(), [], 0, 0

        def flush():
            hashes = np.concatenate([h for h, _, _ in held])
            sizes = np.array([len(h) for h, _, _ in held])
            held_out = np.array([o for _, _, o in held])
            train = ~held_out if learn else np.zeros(len(held), bool)
            there = np.array([d is not None for _, d, _ in held])
            ids = np.array([d or 0 for _, d, _ in held], np.int64)
            vocabulary, tokens = np.unique(np.concatenate([np.array([BEGIN], np.uint64), hashes]), return_inverse=True)
            tokens = tokens[1:].astype(np.int32)
            counts = np.bincount(tokens[np.repeat(train, sizes)], minlength=len(vocabulary))
            counts[np.searchsorted(vocabulary, BEGIN)] = train.sum()
            name = f"block-{task:07d}-{k:05d}"
            _save(folder, name, tokens=tokens, sizes=sizes, train=train, held_out=held_out, ids=ids, there=there)
            _save(folder, f"{name}-words", vocabulary=vocabulary, counts=counts)
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(tokens)], pa.int64()), pa.array([int(sizes[train].sum())], pa.int64())], names=["block", "tokens", "train_tokens"])

        for batch in batches:
            for at in range(batch.num_rows):
                doc_id, text = batch.column(0)[at].as_py(), batch.column(1)[at].as_py()
                held.append((np.append(word_hashes(space_words(text)), np.uint64(END)), doc_id, doc_id is not None and zlib.crc32(str(doc_id).encode()) % parts == which))
                n += len(held[-1][0])
                if n >= BLOCK_TOKENS:
                    yield flush()
                    held, n, k = [], 0, k + 1
        if held:
            yield flush()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "block string, tokens long, train_tokens long")


def _dealt(blocks: DataFrame, folder: str, n_blocks: int):
    """(hash, training count, parts) of the words that are dealt out, by hash; MOST_HEAVY at most.

    A word of more than PART_TOKENS has PART_TOKENS / n_blocks or more in some block: only such counts are added up to find
    the words, then those words are counted in full.
    """
    import numpy as np

    least = max(1, PART_TOKENS // n_blocks)

    def counted(pick):
        def run(batches):
            import pyarrow as pa

            for batch in batches:
                for name in batch.column(0).to_pylist():
                    words = _load(folder, f"{name}-words")
                    some = pick(words["vocabulary"], words["counts"])
                    yield pa.RecordBatch.from_arrays([pa.array(words["vocabulary"][some].astype(np.int64)), pa.array(words["counts"][some].astype(np.int64))], names=["h", "n"])

        return blocks.select("block").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"), F.count("*").alias("k"))

    # What a word has in blocks where it is rare is less than `least` each.
    likely = counted(lambda vocabulary, counts: counts >= least).where(F.col("n") + (n_blocks - F.col("k")) * (least - 1) > PART_TOKENS)
    found = likely.orderBy(F.desc("n"), "h").limit(MOST_HEAVY - 1).select("h").toArrow()["h"].to_numpy()
    heavy = np.unique(np.append(found.astype(np.int64), BEGIN).astype(np.uint64))
    if len(heavy) < 2:
        every = counted(lambda vocabulary, counts: vocabulary == BEGIN)
    else:
        shared = blocks.sparkSession.sparkContext.broadcast(heavy)  # 8 bytes for each of MOST_HEAVY
        every = counted(lambda vocabulary, counts: np.isin(vocabulary, shared.value))
    sums = every.select("h", "n").toArrow()
    order = np.argsort(sums["h"].to_numpy().astype(np.uint64))
    heavy, counts = sums["h"].to_numpy().astype(np.uint64)[order], sums["n"].to_numpy()[order]
    kept = (counts > PART_TOKENS) | (heavy == BEGIN)
    return heavy[kept], counts[kept], -(-np.maximum(counts[kept], 1) // PART_TOKENS)


def _mix(a, b):
    """Hash of two numbers, without the bit that words have."""
    import numpy as np

    x = (a ^ (b.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (x ^ (x >> np.uint64(32))) & np.uint64(~WORD_BIT & (1 << 64) - 1) | np.uint64(BEGIN)


class Grams:
    """Distinct n-grams of a block, by context, and which of them each token ends.

    A context is a word, or a part of a dealt-out one: `ids`, the vocabulary first. pairs (context, next word), befores
    (context, word before it) and triples (one of befores, one of pairs) are sorted; pair, before and triple say which
    one a token has.
    """

    def __init__(self, block: dict, dealt):
        import numpy as np

        self.block = block
        vocabulary, tokens, sizes = block["vocabulary"], block["tokens"].astype(np.int64), block["sizes"]
        heavy, totals, parts = dealt
        n, width = len(tokens), len(vocabulary)
        begin = int(np.searchsorted(vocabulary, BEGIN))
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        one, two = np.concatenate([[begin], tokens[:-1]]), np.concatenate([[begin, begin], tokens[:-2]])[:n]
        one[starts] = two[starts] = begin
        second = starts[sizes > 1] + 1
        two[second] = begin
        at = np.minimum(np.searchsorted(heavy, vocabulary), len(heavy) - 1)
        self.is_dealt = heavy[at] == vocabulary
        self.totals = np.where(self.is_dealt, totals[at], 0)
        hot = np.flatnonzero(self.is_dealt[one])
        many = parts[at][one[hot]].astype(np.uint64)
        by_next = _mix(vocabulary[one[hot]], 2 * ((vocabulary[tokens[hot]] >> np.uint64(8)) % many))
        by_before = _mix(vocabulary[one[hot]], 2 * ((vocabulary[two[hot]] >> np.uint64(8)) % many) + np.uint64(1))
        extra, first = np.unique(np.concatenate([by_next, by_before]), return_index=True)
        self.ids = np.concatenate([vocabulary, extra])
        self.total_of_extra = self.totals[one[hot]][first % max(1, len(hot))] if len(hot) else np.zeros(0, np.int64)
        after, before = one.copy(), one.copy()
        after[hot], before[hot] = width + np.searchsorted(extra, by_next), width + np.searchsorted(extra, by_before)

        keys = np.concatenate([after * width + tokens, before[hot] * width + tokens[hot]])
        pairs, which = np.unique(keys, return_inverse=True)
        self.pair, of_before = which[:n], which[:n].copy()
        of_before[hot] = which[n:]
        self.pair_context, self.pair_word = np.divmod(pairs, width)
        # Sorted by context, word before and pair, triples follow each other, and so do befores.
        key = before * width + two
        if (width + len(extra)) * width * len(pairs) > MOST_KEY:  # a block of a text of many millions of words
            key = np.unique(key, return_inverse=True)[1]
        key = key * len(pairs) + of_before
        order = np.argsort(key)
        key = key[order]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        first = order[new]
        self.triple = np.empty(n, np.int64)
        self.triple[order] = np.cumsum(new) - 1
        self.triple_pair = of_before[first]
        start = np.concatenate([[True], np.diff(before[first] * width + two[first]) != 0])
        self.triple_before = np.cumsum(start) - 1
        self.before = self.triple_before[self.triple]
        self.before_context, self.before_word = before[first[start]], two[first[start]]
        self.one = one

    def counts(self):
        """Training counts of pairs and triples; pairs that only carry triples have none."""
        import numpy as np

        train = np.repeat(self.block["train"], self.block["sizes"])
        return np.bincount(self.pair[train], minlength=len(self.pair_context)), np.bincount(self.triple[train], minlength=len(self.triple_before))

    def by_shard(self, n_shards: int):
        """(shard, contexts, pairs, befores, triples) for each shard: indices of its contexts and of all that hangs on them, in turn."""
        import numpy as np

        shard = ((self.ids >> np.uint64(20)) % np.uint64(n_shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        n = len(self.ids)
        pairs_of, befores_of = np.bincount(self.pair_context, minlength=n), np.bincount(self.before_context, minlength=n)
        triples_of = np.bincount(self.before_context[self.triple_before], minlength=n)
        lists = [_ranges(np.concatenate([[0], np.cumsum(k)[:-1]])[order], k[order]) for k in (pairs_of, befores_of, triples_of)]
        edges = np.concatenate([[0], np.flatnonzero(np.diff(shard[order])) + 1, [n]])
        ends = [np.concatenate([[0], np.cumsum(k[order])])[edges] for k in (pairs_of, befores_of, triples_of)]
        for i, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
            yield int(shard[order[a]]), order[a:b], *(x[e[i] : e[i + 1]] for x, e in zip(lists, ends, strict=True)), pairs_of, befores_of


def _ranges(starts, sizes):
    """starts[0], starts[0] + 1, ... of as many as sizes[0], then those of the next."""
    import numpy as np

    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


def _requests(blocks: DataFrame, folder: str, dealt, n_shards: int, turn: int) -> DataFrame:
    """(shard, block, blob) rows: what a block asks of a shard of this round, with its counts."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import zstandard

        zstd = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                g = Grams(_load(folder, name) | _load(folder, f"{name}-words"), dealt)
                totals = np.concatenate([g.block["counts"], g.total_of_extra])
                first, begins = np.searchsorted(g.pair_context, np.arange(len(g.ids))), np.zeros(len(g.ids), np.int64)
                pair_counts, triple_counts = g.counts()
                low = (g.block["vocabulary"] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                triples_of = np.bincount(g.triple_before, minlength=len(g.before_context))
                out = {"shard": [], "block": [], "blob": []}
                for shard, contexts, pairs, befores, triples, pairs_of, befores_of in g.by_shard(n_shards):
                    if shard % ROUNDS != turn:
                        continue
                    begins[contexts] = np.cumsum(pairs_of[contexts]) - pairs_of[contexts]
                    place = g.triple_pair[triples]
                    own = g.pair_context[place]
                    place = place - first[own] + begins[own]  # among the pairs of the request
                    arrays = (g.ids[contexts], totals[contexts].astype(np.int64), pairs_of[contexts].astype(np.uint32), befores_of[contexts].astype(np.uint32), low[g.pair_word[pairs]], pair_counts[pairs].astype(np.uint32), low[g.before_word[befores]], triples_of[befores].astype(np.uint32), place.astype(np.uint32), triple_counts[triples].astype(np.uint32))
                    head = np.array([len(contexts), len(pairs), len(befores), len(triples)], np.uint32)
                    for c, x in zip(out, (shard, name, zstd.compress(b"".join(x.tobytes() for x in (head, *arrays)))), strict=True):
                        out[c].append(x)
                yield pa.RecordBatch.from_pydict({"shard": pa.array(out["shard"], pa.int64()), "block": out["block"], "blob": pa.array(out["blob"], pa.binary())})

    return blocks.select("block").mapInArrow(run, "shard long, block string, blob binary")


class Request:
    def __init__(self, blob: bytes):
        import numpy as np
        import zstandard

        raw = zstandard.ZstdDecompressor().decompress(blob)
        n, m, k, t = np.frombuffer(raw, np.uint32, 4).tolist()
        at = 16
        names = (("ids", np.uint64, n), ("totals", np.int64, n), ("many_pairs", np.uint32, n), ("many_befores", np.uint32, n), ("words", np.uint32, m), ("pair_counts", np.uint32, m), ("befores", np.uint32, k), ("many_triples", np.uint32, k), ("places", np.uint32, t), ("triple_counts", np.uint32, t))
        for name, kind, size in names:
            x = np.frombuffer(raw, kind, size, at)
            at += x.nbytes
            setattr(self, name, x if name == "ids" else x.astype(np.int64))


class Asked:
    """What all blocks ask of a shard, each n-gram once; context, pair, before and triple say which one a place of a request names."""

    def __init__(self, requests: list[Request]):
        import numpy as np

        joined = lambda name: np.concatenate([getattr(r, name) for r in requests])
        self.ids, self.context = np.unique(joined("ids"), return_inverse=True)
        self.is_word = (self.ids & np.uint64(WORD_BIT) > 0) | (self.ids <= BEGIN)
        added = joined("totals")
        rows = self.is_word[self.context]
        self.totals = np.bincount(self.context[rows], added[rows], len(self.ids)).astype(np.int64)
        self.totals[self.context[~rows]] = added[~rows]  # parts come with the whole word's count

        pairs, self.pair = np.unique(np.repeat(self.context, joined("many_pairs")) << 32 | joined("words"), return_inverse=True)
        self.pair_context, self.words = pairs >> 32, pairs & 0xFFFFFFFF
        self.pair_counts = np.bincount(self.pair, joined("pair_counts"), len(pairs)).astype(np.int64)
        befores, self.before = np.unique(np.repeat(self.context, joined("many_befores")) << 32 | joined("befores"), return_inverse=True)
        self.before_context, self.befores = befores >> 32, befores & 0xFFFFFFFF
        offsets = np.cumsum([0, *(len(r.words) for r in requests)])
        places = self.pair[np.concatenate([r.places + o for r, o in zip(requests, offsets, strict=False)])]
        triples, self.triple = np.unique(np.repeat(self.before, joined("many_triples")) * max(1, len(pairs)) + places, return_inverse=True)
        self.triple_before, self.triple_pair = np.divmod(triples, max(1, len(pairs)))
        self.triple_counts = np.bincount(self.triple, joined("triple_counts"), len(triples)).astype(np.int64)

    def build(self):
        """The trie of the shard from the counts of all blocks, and how many words occur in training texts."""
        import numpy as np

        from .elias_fano import EliasFano, Level, Trie

        n = len(self.ids)
        types = int(((self.totals > 0) & self.is_word & (self.ids != BEGIN)).sum())
        live = self.triple_counts > 0
        counts, of_before, of_pair = self.triple_counts[live], self.triple_before[live], self.triple_pair[live]
        after_before = np.bincount(of_before, counts, len(self.befores))
        kept = self.pair_counts > 0
        kept[of_pair] = True
        place = np.cumsum(kept) - 1
        pairs_of = np.bincount(self.pair_context[kept], minlength=n)
        begin = np.cumsum(pairs_of) - pairs_of
        there = after_before > 0
        number = np.cumsum(there) - 1
        levels = {
            "words": Level.build(pairs_of, self.words[kept]),
            "befores": Level.build(np.bincount(self.before_context[there], minlength=n), self.befores[there]),
            "triples": Level.build(np.bincount(number[of_before], minlength=int(there.sum())), place[of_pair] - begin[self.pair_context[of_pair]]),
        }
        plain = {
            "totals": self.totals,
            "p2": log_codes(((1 - SHARE2) * self.pair_counts / (self.totals[self.pair_context] + MU2))[kept]),
            "rest": np.round(MU3 / (after_before[there] + MU3) * 254).astype(np.uint8),
            "p3": log_codes((1 - SHARE3) * counts / (after_before[of_before] + MU3)),
        }
        return Trie(EliasFano.build(self.ids), levels, plain), types

    def find(self, trie):
        """(counts, p2, rest, p3) of what is asked, in its order; without a trie nothing is there."""
        import numpy as np

        if trie is None:
            return np.zeros(len(self.ids), np.int64), *(np.full(len(x), ABSENT, np.uint8) for x in (self.words, self.befores, self.triple_pair))
        many = [np.bincount(x, minlength=k) for x, k in ((self.pair_context, len(self.ids)), (self.before_context, len(self.ids)), (self.triple_before, len(self.befores)))]
        return trie.find(self.ids, many[0], self.words, many[1], self.befores, many[2], self.triple_pair)


def log_codes(p):
    """8-bit codes of probabilities, finer towards 1; 0 is absent."""
    import numpy as np

    x = np.minimum(-np.log10(np.where(p > 0, p, 1.0)) / DEPTH, 1)
    return np.where(p > 0, np.round((ABSENT - 1) * np.sqrt(x)), ABSENT).astype(np.uint8)


def of_codes():
    """What the 256 codes stand for."""
    import numpy as np

    return np.append(10.0 ** (-DEPTH * (np.arange(ABSENT) / (ABSENT - 1)) ** 2), 0.0)


def _serve(requests: DataFrame, folder: str, learn: bool, keep: bool) -> DataFrame:
    """(block, shard, types, answer): counts of the contexts asked for, and the codes of their n-grams."""

    def run(key, table):
        import pyarrow as pa
        import zstandard

        shard = key[0].as_py()
        requests = [Request(b) for b in table["blob"].to_pylist()]
        asked, types = Asked(requests), 0
        if learn:
            trie, types = asked.build()
            name = f"trie-{shard:07d}" if keep else f"trie-{shard:07d}-{uuid.uuid4().hex}"  # of this try alone
            _write_trie(folder, name, trie)
            del trie
        else:
            name = f"trie-{shard:07d}"
        trie = _map_trie(folder, name)
        if not keep:
            fs, root = file_system(folder)
            fs.delete_file(f"{root}/{name}")  # what is mapped stays readable
        found = asked.find(trie)
        which = (asked.context, asked.pair, asked.before, asked.triple)
        at, answers, zstd = [0, 0, 0, 0], [], zstandard.ZstdCompressor(level=1)
        for r in requests:
            sizes = (len(r.ids), len(r.words), len(r.befores), len(r.places))
            answers.append(zstd.compress(b"".join(x[w[a : a + k]].tobytes() for x, w, a, k in zip(found, which, at, sizes, strict=True))))
            at = [a + k for a, k in zip(at, sizes, strict=True)]
        n = len(answers)
        return pa.table({"block": table["block"], "shard": pa.array([shard] * n, pa.int64()), "types": pa.array([types] + [0] * (n - 1), pa.int64()), "answer": pa.array(answers, pa.binary())})

    return requests.groupBy("shard").applyInArrow(run, "block string, shard long, types long, answer binary")


def _write_trie(folder: str, name: str, trie) -> None:
    """One raw file: a header of names, types and sizes, then the arrays, each at a multiple of 64 bytes."""
    import json

    import numpy as np

    arrays = {k: np.ascontiguousarray(v) for k, v in trie.arrays().items()}
    head = json.dumps([[k, v.dtype.str, len(v)] for k, v in arrays.items()]).encode()
    out = [len(head).to_bytes(8, "little") + head]
    at = len(out[0])
    for v in arrays.values():
        out.append(b"\0" * (-at % 64) + v.tobytes())
        at += len(out[-1])
    _write(folder, name, b"".join(out))


def _map_trie(folder: str, name: str):
    """The trie over a memory map of its file; in a store that cannot be mapped, over its bytes. None if there is none."""
    import json
    import mmap

    import numpy as np
    from pyarrow import fs as pafs

    from .elias_fano import Trie

    fs, root = file_system(folder)
    path = f"{root}/{name}"
    if fs.get_file_info(path).type != pafs.FileType.File:
        return None
    if isinstance(fs, pafs.LocalFileSystem):
        with open(path, "rb") as f:
            data = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
    else:
        with fs.open_input_file(path) as f:
            data = f.read()
    n = int.from_bytes(data[:8], "little")
    arrays, at = {}, 8 + n
    for k, kind, size in json.loads(data[8 : 8 + n]):
        at += -at % 64
        arrays[k] = np.frombuffer(data, np.dtype(kind), size, at)
        at += arrays[k].nbytes
    return Trie.load(arrays)


def _scores(answers: DataFrame, folder: str, dealt, n_shards: int, total: int, types: int) -> DataFrame:
    def run(key, table):
        import numpy as np
        import pyarrow as pa
        import zstandard

        name = key[0].as_py()
        g = Grams(_load(folder, name) | _load(folder, f"{name}-words"), dealt)
        counts = np.zeros(len(g.ids), np.int64)
        codes = [np.full(len(x), ABSENT, np.uint8) for x in (g.pair_context, g.before_context, g.triple_before)]
        blobs = dict(zip(table["shard"].to_pylist(), table["answer"].to_pylist(), strict=True))
        zstd = zstandard.ZstdDecompressor()
        for shard, contexts, *lists, _, _ in g.by_shard(n_shards):
            raw = zstd.decompress(blobs[shard])
            counts[contexts] = np.frombuffer(raw, np.int64, len(contexts))
            at = 8 * len(contexts)
            for code, some in zip(codes, lists, strict=True):
                code[some] = np.frombuffer(raw, np.uint8, len(some), at)
                at += len(some)
        values = of_codes()
        left = np.append(np.arange(ABSENT) / 254.0, 1.0)
        vocabulary, tokens, one = g.block["vocabulary"], g.block["tokens"], g.one
        of_word = np.where(vocabulary == BEGIN, 0, counts[: len(vocabulary)])
        as_context = np.where(g.is_dealt, g.totals, of_word)
        base = np.log10((of_word + 1) / (total + types + 1))
        c = as_context[one]
        p2 = values[codes[0]][g.pair] + (MU2 + SHARE2 * c) / (c + MU2) * 10.0 ** base[tokens]
        rest = left[codes[1]][g.before]
        p3 = values[codes[2]][g.triple] + (SHARE3 * (1 - rest) + rest) * p2
        starts = np.concatenate([[0], np.cumsum(g.block["sizes"])[:-1]])
        sums = [np.add.reduceat(x, starts) for x in (base[tokens], np.log10(p3), (of_word[tokens] > 0).astype(np.int64))]
        return pa.table({"doc_id": pa.array(g.block["ids"], pa.int64(), mask=~g.block["there"]), "held_out": pa.array(g.block["held_out"]), "n_tokens": pa.array(g.block["sizes"], pa.int64()), "n_known": sums[2], "train_tokens": pa.array([total] * len(starts), pa.int64()), "base_score": sums[0], "score": sums[1]})

    return answers.groupBy("block").applyInArrow(run, SCHEMA)


def score_texts(docs: DataFrame, parts: int = 7, which: int = 2, keep: str | None = None, model: str | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row per row of docs (doc_id, text).

    Training texts are those whose crc32(doc_id as text) mod `parts` is not `which`; a null doc_id is a training text.
    Tokens are runs without ASCII white space, A-Z lower-cased, then one end; null counts as empty and has the end alone.
    base_score sums log10((c + 1) / (N + V + 1)) over the tokens, score log10 p of the model. Repeated rows are texts of
    their own. No training text: c, N and V are 0. Empty table: no rows. A text of any length is scored whole.

    keep: URI of a folder, shared by driver and executors, in which the tries stay. model: such a folder; then nothing is
    learned, and docs are scored with the counts that were.
    """
    import json

    import numpy as np

    spark = docs.sparkSession
    ship(spark)
    folder = new_folder(spark, "lm")
    blocks = stored(_blocks(docs, folder, parts, which, model is None), "lm-blocks")
    sums = blocks.agg(F.sum("tokens").alias("tokens"), F.sum("train_tokens").alias("total"), F.count("*").alias("n")).first()
    n = int(sums["n"])
    if model is not None:
        fs, root = file_system(model)
        with fs.open_input_file(f"{root}/model.json") as source:
            known = json.loads(source.read())
        dealt = tuple(np.array(known[k], kind) for k, kind in (("heavy", np.uint64), ("counts", np.int64), ("parts", np.int64)))
        n_shards, total, types = known["n_shards"], known["total"], known["types"]
    elif n:
        dealt, n_shards, total = _dealt(blocks, folder, n), int(sums["tokens"]) // SHARD_TOKENS + 4, int(sums["total"])
    if not n:
        return spark.createDataFrame([], SCHEMA)
    blocks = blocks.select("block").repartition(min(n, 10_000), "block")
    answers = None
    for turn in range(ROUNDS):
        made = stored(_serve(_requests(blocks, folder, dealt, n_shards, turn), model or keep or folder, model is None, bool(model or keep)), "lm-answers")
        answers = made if answers is None else answers.unionByName(made)
        tidy(spark)
    if model is None:
        types = int(answers.agg(F.sum("types")).first()[0])
    if keep is not None and model is None:
        state = {"heavy": dealt[0].tolist(), "counts": dealt[1].tolist(), "parts": dealt[2].tolist(), "n_shards": n_shards, "total": total, "types": types}
        _write(keep, "model.json", json.dumps(state).encode())
    return _scores(answers.drop("types"), folder, dealt, n_shards, total, types)
