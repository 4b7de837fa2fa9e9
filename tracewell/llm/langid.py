"""Language identification: averaged hashed subword embeddings, a linear softmax, SGD in numpy, calibrated rejection.

A word of letters stands for itself and its character n-grams, each hashed into a table of embeddings; a text is the
average of them all, and a linear layer with softmax gives the languages. Because that is linear, a trained model sums
the class logits of hashes. Hashes of many texts are taken at once: CRC-32 is linear too, so that of an n-gram is the xor
of what its characters add by the number of bytes after them. A temperature fitted on held-back training rows calibrates
the probability, and answers below the fitted threshold are rejected.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass
from functools import cache, lru_cache

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ship, slices, stored
from .quality_fm import held_out

UNKNOWN = "und"
BITS, DIM = 15, 16
NGRAMS = (2, 3, 4)
#: Training rows of each language, at most (those with the smallest hashes of doc_id and text), and of all; whole texts are used.
ROWS_PER_LANGUAGE, TRAIN_ROWS = 600, 60_000
#: Share of correct answers that rejection may lose on the rows held back for calibration.
LOST = 0.01
#: Characters that are hashed at once (more if a word is longer), and bytes of a word that are hashed beside those of others.
BLOCK, WORD_BYTES = 1 << 16, 48
ALNUM = re.compile(r"[^\W\d_]+")
MASK = (1 << BITS) - 1
#: In arrays of hashes: no n-gram.
NONE = 1 << BITS


def letter_runs(text: str) -> list[str]:
    """Maximal runs of letters (Unicode categories L*). Number signs such as fractions are word characters to `re`, but no letters."""
    out = []
    for run in ALNUM.findall(text):
        if run.isalpha():
            out.append(run)
        else:
            out += "".join(c if c.isalpha() else " " for c in run).split()
    return out


def subwords(chunk: str) -> list[int]:
    """Hashes of the words of a chunk and of their n-grams with word marks; lower-cased. What `hashes` gives for many texts, one by one."""
    out = []
    for word in letter_runs(chunk.lower()):
        marked = f"<{word}>"
        out.append(zlib.crc32(marked.encode("utf-8", "surrogatepass")) & MASK)
        for n in NGRAMS:
            out += [zlib.crc32(marked[i : i + n].encode("utf-8", "surrogatepass")) & MASK for i in range(len(marked) - n + 1)]
    return out


@cache
def letter_table(bits: int):
    """Whether each code point of so many bits is a letter."""
    import numpy as np

    return np.array([chr(c).isalpha() for c in range(min(1 << bits, 0x110000))])


@cache
def crc_tables():
    """CRC-32 by byte, and the hashes of runs of zero bytes."""
    import numpy as np

    crc = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        crc = (crc >> 1) ^ np.where(crc & 1, np.uint32(0xEDB88320), np.uint32(0))
    return crc, np.array([zlib.crc32(bytes(n)) & MASK for n in range(4 * max(NGRAMS) + 1)], np.uint16)


@lru_cache(1 << 16)
def shares(c: int) -> tuple[int, ...]:
    """What a letter or mark, code point c, adds to a hash, by the number of bytes after it; last, its own number of bytes."""
    raw = chr(c).encode()
    return (*((zlib.crc32(raw + bytes(n)) ^ zlib.crc32(bytes(len(raw) + n))) & MASK for n in range(4 * max(NGRAMS) - 3)), len(raw))


def word_hashes(marked):
    """Hashes of all words in an array of code points that is made of <word><word> and so on."""
    import numpy as np

    crc, raw = crc_tables()[0], marked.tobytes().decode("utf-32-le").encode()
    octets = np.frombuffer(raw, np.uint8)
    starts, ends = np.flatnonzero(octets == ord("<")), np.flatnonzero(octets == ord(">")) + 1
    sizes = np.minimum(ends - starts, WORD_BYTES)
    order = np.argsort((WORD_BYTES - sizes).astype(np.uint8), kind="stable")  # longest first
    at, state = starts[order], np.full(len(order), 0xFFFFFFFF, np.uint32)
    for longer in len(order) - np.cumsum(np.bincount(sizes))[:-1]:  # words of more bytes than were taken so far
        part = state[:longer]
        part[:] = crc.take((part ^ octets.take(at[:longer])) & 255) ^ (part >> 8)
        at[:longer] += 1
    out = np.empty(len(order), np.intp)
    out[order] = ~state & MASK
    for k in np.flatnonzero(ends - starts > WORD_BYTES).tolist():
        out[k] = zlib.crc32(raw[starts[k] : ends[k]]) & MASK
    return out


def blocks(letter):
    """Bounds of blocks of BLOCK characters or less that cut no word, given what is a letter (the last is none); a longer word is in one block."""
    import numpy as np

    at, size = 0, len(letter)
    while at < size:
        end = at + BLOCK
        if end < size:
            other = np.flatnonzero(~letter[at:end])
            end = at + int(other[-1]) + 1 if len(other) else end + int(np.argmin(letter[end:]))
        yield at, min(end, size)
        at = end


def hashes(texts: list[str | None]):
    """The subwords of many texts, block by block: hashes, numbers of the texts in the block, and where the hashes of each begin.

    Each block gives its words, then its n-grams of each n, where NONE stands for an n-gram that would leave its word.
    """
    import numpy as np

    low = [t.lower() if t else "" for t in texts]
    upto = np.cumsum([len(t) + 1 for t in low])  # a space after each
    points = np.frombuffer(" ".join([*low, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    del low
    if not len(points):
        return
    is_letter, zeros, pad = letter_table(int(points.max()).bit_length()), crc_tables()[1], max(NGRAMS) - 1
    letters, code = is_letter.take(points), np.zeros(max(128, len(is_letter)), np.intp)
    for begin, end in blocks(letters):
        letter = letters[begin:end]
        edge = np.flatnonzero(np.diff(letter, prepend=False, append=False))
        starts, sizes = edge[::2], edge[1::2] - edge[::2]
        if not len(starts):
            continue
        last = np.cumsum(sizes + 2) - 1  # of each word, with its marks
        first, n = last - sizes - 1, int(last[-1]) + 1
        inner = np.ones(n + pad, bool)
        inner[first] = inner[last] = inner[n:] = False
        marked = np.full(n + pad, ord(">"), np.uint32)
        marked[first], marked[inner] = ord("<"), points[begin:end][letter]
        text = np.searchsorted(upto, starts + begin, "right")  # of each word
        at = np.flatnonzero(np.diff(text, prepend=-1))
        text, first = text[at], first[at]
        yield word_hashes(marked[:n]), text, at
        alphabet = np.flatnonzero(np.bincount(marked))
        code[alphabet] = np.arange(len(alphabet))
        rows = np.array([shares(c) for c in alphabet.tolist()], np.uint16)
        own = code.take(marked)
        size = rows[:, -1].astype(np.intp).take(own)
        own *= rows.shape[1]
        rows = rows.ravel()
        ended = marked == ord(">")
        # Of the n characters from each place on: what they add to a hash, bytes after the first, whether a word ends before the last
        share, after, over = rows.take(own), np.zeros(len(own), np.intp), np.zeros(len(own), bool)
        for k in range(2, max(NGRAMS) + 1):
            m = len(own) - k + 1
            after = after[1:] + size[1 : m + 1]
            share = rows.take(own[:m] + after) ^ share[1:]
            over = over[:m] | ended[k - 2 : k - 2 + m]
            if k in NGRAMS:
                found = (share[:n] ^ zeros.take(after[:n] + size[:n])).astype(np.intp)
                found[over[:n]] = NONE
                yield found, text, first


@dataclass
class Model:
    languages: list[str]
    embeddings: object
    weights: object
    bias: object
    temperature: float = 1.0
    threshold: float = 0.0

    def __post_init__(self):
        import numpy as np

        # Of each hash its logits, or its embedding where that is shorter; 0 for no n-gram
        table, self.spread = np.asarray(self.embeddings, np.float64), np.asarray(self.weights, np.float64).T
        if len(self.languages) <= table.shape[1]:
            table, self.spread = table @ self.spread, None
        self.columns = [np.append(c, 0.0) for c in table.T]

    def __getstate__(self):
        return (self.languages, self.embeddings, self.weights, self.bias, self.temperature, self.threshold)

    def __setstate__(self, state):
        self.__init__(*state)

    def sums(self, texts: list[str | None]):
        """Class logits of texts before the temperature, and how many subwords each has; only the bias without a letter."""
        import numpy as np

        total, counts = np.zeros((len(self.columns), len(texts))), np.zeros(len(texts), np.int64)
        for found, text, at in hashes(texts):
            counts[text] += np.add.reduceat(found != NONE, at, dtype=np.int64)
            for k, column in enumerate(self.columns):
                total[k, text] += np.add.reduceat(column.take(found), at)
        mean = (total / np.maximum(counts, 1)).T
        return (mean if self.spread is None else mean @ self.spread) + self.bias, counts

    def raw(self, text: str | None):
        """Class logits before the temperature; None without a letter."""
        z, counts = self.sums([text])
        return z[0] if counts[0] else None

    def predict_all(self, texts: list[str | None]):
        """Languages, calibrated probabilities and whether accepted. Without a letter, or with nothing learned: und, 0, not accepted."""
        import numpy as np

        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
        z, counts = self.sums(texts)
        p = softmax(z / self.temperature)
        best = np.where(counts > 0, p.argmax(axis=1), -1)
        score = np.where(counts > 0, p.max(axis=1), 0.0)
        return [*map([*self.languages, UNKNOWN].__getitem__, best.tolist())], score, (counts > 0) & (score >= self.threshold)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, calibrated probability, accepted of one text."""
        lang, score, accepted = self.predict_all([text])
        return lang[0], float(score[0]), bool(accepted[0])


def softmax(z):
    import numpy as np

    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(rows: list[tuple[object, object]], labels: list[str], seed: int = 3, epochs: int = 5, rate: float = 0.5, batch: int = 32) -> Model:
    """SGD with a falling rate over texts given as distinct subword ids and their counts; every tenth row is kept for calibration."""
    import numpy as np

    languages = sorted(set(labels))
    code = {x: k for k, x in enumerate(languages)}
    rng = np.random.default_rng(seed)
    n_classes = len(languages)
    e = (rng.uniform(-1, 1, (1 << BITS, DIM)) / DIM).astype(np.float32)
    w, b = np.zeros((n_classes, DIM), np.float32), np.zeros(n_classes, np.float32)
    some = [(i, (c / c.sum()).astype(np.float32), code[y]) for (i, c), y in zip(rows, labels, strict=True) if len(i)]
    if not some:
        return Model([], e, w, b)
    kept = some[::10] if len(some) >= 50 else some
    used = [r for i, r in enumerate(some) if i % 10] if len(some) >= 50 else some
    freq = np.bincount([y for *_, y in used], minlength=n_classes).astype(np.float32)
    balance = len(used) / (n_classes * np.maximum(freq, 1))
    steps, at_step = epochs * ((len(used) + batch - 1) // batch), 0
    for _ in range(epochs):
        order = rng.permutation(len(used))
        for at in range(0, len(order), batch):
            part = [used[k] for k in order[at : at + batch]]
            sizes = np.array([len(r[0]) for r in part])
            ids, share = np.concatenate([r[0] for r in part]), np.concatenate([r[1] for r in part])
            y = np.array([r[2] for r in part])
            mean = np.add.reduceat(e[ids] * share[:, None], np.concatenate([[0], np.cumsum(sizes)[:-1]]), axis=0)
            p = softmax(mean @ w.T + b)
            p[np.arange(len(y)), y] -= 1
            p *= np.minimum(balance[y], 10)[:, None] / len(y)
            lr = rate * (1 - at_step / steps)
            at_step += 1
            back = (p @ w) * len(y)
            w -= lr * 10 * (p.T @ mean)
            b -= lr * p.sum(axis=0)
            where, inverse = np.unique(ids, return_inverse=True)
            each = np.repeat(back, sizes, axis=0) * share[:, None]
            step = np.stack([np.bincount(inverse, each[:, d], len(where)) for d in range(DIM)], axis=1)
            e[where] -= (lr * 20 * step).astype(np.float32)
    model = Model(languages, e, w, b)
    z = np.array([x @ e[i] @ w.T + b for i, x, _ in kept], np.float64)
    y = np.array([c for *_, c in kept])
    grid = np.geomspace(0.05, 20, 60)
    loss = [-np.log(np.maximum(softmax(z / t)[np.arange(len(y)), y], 1e-12)).mean() for t in grid]
    model.temperature = float(grid[int(np.argmin(loss))])
    p = softmax(z / model.temperature)
    right = np.sort(p.max(axis=1)[p.argmax(axis=1) == y])
    model.threshold = float(right[int(LOST * len(right))]) if len(right) else 0.0
    return model


def fit(docs: DataFrame, parts: int = 4, which: int = 2, rows_per_language: int = ROWS_PER_LANGUAGE) -> Model:
    """Learns lang from text, from rows with both and outside the held-out part.

    Training takes a bounded sample: rows_per_language rows of each language (all of a rarer one; fewer of each if that
    would be over TRAIN_ROWS), those with the smallest hashes of doc_id and text; rows that repeat both count once. Only
    hashes are ranked, and only the chosen texts move. They are turned into counts of subword ids before they come to the
    driver.
    """
    ship(docs.sparkSession)
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"), parts, which))
    known = known.select("lang", "text", F.xxhash64("doc_id", "text", F.lit("language sample")).alias("h"))
    counts = stored(known.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")), "languages")
    n_languages = counts.count()
    most = max(1, min(rows_per_language, TRAIN_ROWS // max(1, n_languages)))
    share = F.shiftrightunsigned("h", 24) / F.lit(float(1 << 40))  # in 0 to 1; about 4 * most rows of a language pass
    likely = known.select("lang", "h").join(F.broadcast(counts) if n_languages <= TRAIN_ROWS else counts, "lang").where(share * F.col("n") <= 4 * most).select("lang", "h").distinct()
    first = Window.partitionBy("lang").orderBy(F.shiftrightunsigned("h", 24), "h")
    chosen = likely.withColumn("r", F.row_number().over(first)).where(F.col("r") <= most).select("lang", "h")  # TRAIN_ROWS at most
    some = known.join(F.broadcast(chosen), ["lang", "h"], "left_semi").groupBy("lang", "h").agg(F.first("text").alias("text"))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for b in slices(batch, 2, 4096):
                parts = [[np.zeros(0, np.intp)] for _ in range(b.num_rows)]
                for found, text, at in hashes(b.column(2).to_pylist()):
                    for k, ids in zip(text.tolist(), np.split(found, at[1:]), strict=True):
                        parts[k].append(ids[ids != NONE])
                rows = [np.unique(np.concatenate(p).astype(np.int32), return_counts=True) for p in parts]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([r[0] for r in rows], pa.list_(pa.int32())), pa.array([r[1] for r in rows], pa.list_(pa.int64()))], names=["lang", "h", "ids", "counts"])

    got = some.select("lang", "h", "text").mapInArrow(run, "lang string, h long, ids array<int>, counts array<long>").toArrow()
    got = got.sort_by([("h", "ascending"), ("lang", "ascending")])
    rows = [(i.values.to_numpy(), c.values.to_numpy()) for i, c in zip(got["ids"], got["counts"], strict=True)]
    return train(rows, got["lang"].to_pylist())


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, accepted for each row of docs (doc_id, text); see Model.predict for odd texts."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch, 1, 4096):
                lang, score, accepted = shared.value.predict_all(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(accepted, pa.bool_())], names=["doc_id", "lang_pred", "score", "accepted"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, accepted boolean")


def languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, accepted: one row per row of docs.

    lang, source and doc_id are not inputs of a prediction. Null text or no letter: `und` with score 0. Nothing to learn
    from: `und` for all. Null doc_id: not held out. Empty table: no rows.
    """
    found = predict(docs, fit(docs))
    return found.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score", "accepted")
