"""Token-ID files: one zstandard frame per document, a directory frame, and a trailing seek table with checksums.

A shard is a run of independent zstandard frames in the public seekable layout: data frames, then a skippable frame
(magic 0x184D2A5E) with compressed size, decompressed size and the low half of the XXH64 of the content for each frame,
then the frame count, a descriptor byte (128: checksums present) and the magic 0x8F92EAB1. A document longer than
FRAME_IDS takes several frames. The last data frame is the directory: ids of documents, their token counts and frames.
Any zstandard tool decompresses a shard; a reader of ours fetches only the frames of the documents asked for.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import file_system, new_folder, publish, ship, slices, steady_scan

SKIPPABLE, SEEKABLE, CHECKED = 0x184D2A5E, 0x8F92EAB1, 128
FRAME_IDS = 1 << 20
#: Words that a worker remembers; those met later are encoded each time they come in a batch.
CACHE_WORDS = 1_200_000
READ_BYTES = 4 << 20
#: Bytes of input files that a shard is made of, at most about; small inputs have as many shards as the session has partitions.
SHARD_BYTES = 128 << 20


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Ids of a text as bytes. Words between ASCII white space are encoded once and remembered.

    Exact for tokenizers that drop white space and never join across it, as this one; special tokens hold none.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks already use the cores
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.known: dict[bytes, bytes] = {}

    def _encode_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word. Many words go through the tokenizer as one text; offsets tell whose each id is."""
        import numpy as np

        out = []
        for at in range(0, len(words), 200):
            some = [w.decode("utf-8", "replace") for w in words[at : at + 200]]
            found = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
            ids = np.array(found.ids, dtype=self.dtype)
            starts = np.fromiter((o[0] for o in found.offsets), np.int64, len(ids))
            ends = (np.searchsorted(starts, np.cumsum([0, *(len(w) + 1 for w in some)])) * ids.itemsize).tolist()
            raw = ids.tobytes()
            out += [raw[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        return out

    def encode(self, texts: Sequence[str | None]) -> list[bytes]:
        known = self.known
        split = [(t or "").encode("utf-8", "surrogatepass").split() for t in texts]
        found = [list(map(known.get, words)) for words in split]
        gaps = [[i for i, v in enumerate(f) if v is None] if None in f else [] for f in found]
        fresh = list({split[d][i] for d, gap in enumerate(gaps) for i in gap})
        new = dict(zip(fresh, self._encode_words(fresh), strict=True))
        for d, gap in enumerate(gaps):
            for i in gap:
                found[d][i] = new[split[d][i]]
        if len(known) + len(new) <= CACHE_WORDS:  # frequent words come early
            known.update(new)
        return [b"".join(f) for f in found]


class ShardWriter:
    """Writes one shard to a binary file object."""

    def __init__(self, out, dtype: str, level: int = 3):
        import zstandard

        self.out, self.width, self.dtype = out, int(dtype[-1]), dtype
        self.zstd = zstandard.ZstdCompressor(level=level)
        self.seek: list[tuple[int, int, int]] = []
        self.docs: list[tuple[int | None, int, int]] = []
        self.n_ids = 0

    def _frame(self, raw: bytes) -> None:
        import xxhash

        packed = self.zstd.compress(raw)
        self.out.write(packed)
        self.seek.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))

    def add(self, doc_id: int | None, raw: bytes) -> None:
        step = FRAME_IDS * self.width
        parts = [raw[i : i + step] for i in range(0, len(raw), step)] or [b""]
        for part in parts:
            self._frame(part)
        self.docs.append((doc_id, len(raw) // self.width, len(parts)))
        self.n_ids += len(raw) // self.width

    def close(self) -> None:
        import numpy as np

        ids = np.array([d[0] or 0 for d in self.docs], dtype="<i8")
        there = np.array([d[0] is not None for d in self.docs], dtype="u1")
        counts = np.array([d[1] for d in self.docs], dtype="<u8")
        frames = np.array([d[2] for d in self.docs], dtype="<u4")
        self._frame(struct.pack("<4sBQ", b"TWD1", self.width, len(ids)) + ids.tobytes() + there.tobytes() + counts.tobytes() + frames.tobytes())
        table = b"".join(struct.pack("<III", *x) for x in self.seek) + struct.pack("<IBI", len(self.seek), CHECKED, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)


class ShardReader:
    """Opens a shard (a random-access file with read_at(n, offset) and size()) by its seek table and directory."""

    def __init__(self, source):
        import numpy as np
        import zstandard

        self.source, self.zstd = source, zstandard.ZstdDecompressor()
        end = source.size()
        n, flags, magic = struct.unpack("<IBI", source.read_at(9, end - 9))
        if magic != SEEKABLE or flags != CHECKED:
            raise ValueError("not a shard with a checked seek table")
        entries = np.frombuffer(source.read_at(12 * n, end - 9 - 12 * n), dtype="<u4").reshape(n, 3)
        self.packed, self.raw, self.sums = (entries[:, i].astype("u8") for i in range(3))
        self.offsets = np.concatenate([[0], np.cumsum(self.packed)]).astype("i8")
        head = self.frame(n - 1, source.read_at(int(self.packed[-1]), int(self.offsets[n - 1])))
        tag, self.width, k = struct.unpack_from("<4sBQ", head)
        if tag != b"TWD1":
            raise ValueError("no directory frame")
        at = 13
        self.ids = np.frombuffer(head, "<i8", k, at)
        self.there = np.frombuffer(head, "u1", k, at + 8 * k).astype(bool)
        self.counts = np.frombuffer(head, "<u8", k, at + 9 * k).astype("i8")
        self.first = np.concatenate([[0], np.cumsum(np.frombuffer(head, "<u4", k, at + 17 * k))]).astype("i8")
        self.dtype = f"<u{self.width}"

    def frame(self, i: int, packed: bytes) -> bytes:
        import xxhash

        raw = self.zstd.decompress(packed, max_output_size=max(1, int(self.raw[i])))
        if len(raw) != self.raw[i] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.sums[i]:
            raise ValueError(f"frame {i} does not match its checksum")
        return raw

    def document(self, k: int):
        """Ids of the k-th document; only its frames are read."""
        import numpy as np

        a, b = int(self.first[k]), int(self.first[k + 1])
        block = self.source.read_at(int(self.offsets[b] - self.offsets[a]), int(self.offsets[a]))
        return np.frombuffer(self._join(a, b, block), self.dtype)

    def _join(self, a: int, b: int, block) -> bytes:
        base = int(self.offsets[a])
        return b"".join(self.frame(i, block[int(self.offsets[i]) - base : int(self.offsets[i + 1]) - base]) for i in range(a, b))

    def documents(self) -> Iterator[tuple[int | None, object]]:
        """All (doc_id, ids) in order, reading about READ_BYTES at a time."""
        import numpy as np

        k = 0
        while k < len(self.ids):
            j = max(k + 1, int(np.searchsorted(self.offsets[self.first], self.offsets[self.first[k]] + READ_BYTES, "right")) - 1)
            j = min(j, len(self.ids))
            base = int(self.offsets[self.first[k]])
            block = self.source.read_at(int(self.offsets[self.first[j]]) - base, base)
            for d in range(k, j):
                a, b = int(self.first[d]), int(self.first[d + 1])
                part = block[int(self.offsets[a]) - base : int(self.offsets[b]) - base]
                yield (int(self.ids[d]) if self.there[d] else None), np.frombuffer(self._join(a, b, part), self.dtype)
            k = j


def write_token_files(docs: DataFrame, folder: str | None = None, tokenizer: str | None = None, end_id: int = 2) -> tuple[str, list[tuple[str, int, int]]]:
    """Encodes whole texts, appends end_id to each, writes shards in ascending doc_id order.

    Gives the folder and (path, documents, ids) of each shard in order. Null text counts as empty: the end id alone.
    Null doc_id comes first; rows with the same doc_id follow each other in the order of a hash of their text. Empty
    table: no shard. A shard is written under a name of its own and then renamed, so a task that runs twice does no harm.
    """
    spark = docs.sparkSession
    ship(spark)
    folder = folder or new_folder(spark, "tokens")
    path = tokenizer or tokenizer_path()

    def write(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        fs, root = file_system(folder)
        name = f"{root}/tokens-{shard:06d}.zst"
        temp = f"{name}.{uuid.uuid4().hex}"
        writer = out = None
        n = 0
        encoder = _encoder(path)
        tail = end_id.to_bytes(int(encoder.dtype[-1]), "little")
        for batch in batches:
            for part in slices(batch, 1, 512):
                if writer is None:
                    out = fs.open_output_stream(temp)
                    writer = ShardWriter(out, encoder.dtype)
                for doc_id, raw in zip(part.column(0).to_pylist(), encoder.encode(part.column(1).to_pylist()), strict=True):
                    writer.add(doc_id, raw + tail)
                    n += 1
        if writer is not None:
            writer.close()
            out.close()
            publish(fs, temp, name)
            yield pa.RecordBatch.from_pydict({"shard": [shard], "path": [name], "n_docs": [n], "n_ids": [writer.n_ids]})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), F.xxhash64("text").alias("h"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if steady_scan(docs):  # the size of files is known without reading them
        n = max(n, int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) // SHARD_BYTES + 1)
    rows = rows.repartitionByRange(n, F.col("doc_id"), F.col("h")).sortWithinPartitions("doc_id", "h")
    made = rows.select("doc_id", "text").mapInArrow(write, "shard long, path string, n_docs long, n_ids long").collect()  # a row for each shard
    return folder, [(r["path"], r["n_docs"], r["n_ids"]) for r in sorted(made, key=lambda r: r["shard"])]


_ENCODERS: dict[str, WordEncoder] = {}


def _encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def read_token_files(spark, folder: str, shards: Sequence[tuple[str, int, int]]) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read back from the shards in order; a shard is a task."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not shards:
        return spark.createDataFrame([], schema)
    starts, total = [], 0
    for s in shards:
        starts.append(total)
        total += s[2]
    where = [(p, a) for (p, _, _), a in zip(shards, starts, strict=True)]

    def read(batches):
        import pyarrow as pa

        fs, _ = file_system(folder)
        for batch in batches:
            for k in batch.column(0).to_pylist():
                path, at = where[k]
                out = {"doc_id": [], "start": [], "n_tokens": [], "ids_crc32": []}
                with fs.open_input_file(path) as source:
                    for doc_id, ids in ShardReader(source).documents():
                        for c, v in zip(out, (doc_id, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())), strict=True):
                            out[c].append(v)
                        at += len(ids)
                yield pa.RecordBatch.from_pydict({c: pa.array(v, pa.int64()) for c, v in out.items()})

    return spark.range(0, len(where), 1, len(where)).mapInArrow(read, schema)


def token_output(docs: DataFrame, folder: str | None = None, tokenizer: str | None = None, end_id: int = 2) -> DataFrame:
    """Writes token files and describes every document from what was read back."""
    folder, shards = write_token_files(docs, folder, tokenizer, end_id)
    return read_token_files(docs.sparkSession, folder, shards)
