import io
import zlib

import numpy as np
import pytest
import zstandard
from tokenizers import Tokenizer

from tracewell.llm import token_files as tf


class Bytes:
    def __init__(self, data):
        self.data = data

    def size(self):
        return len(self.data)

    def read_at(self, n, at):
        return self.data[at : at + n]


def test_files_hold_what_the_tokenizer_gives(spark):
    rows = [(3, "Café  and\tNAÏVE x!!\n<|endoftext|> a1b2", "x"), (1, "", "x"), (2, None, "x"), (None, "it's  \u00a0 e \u0301", "x"), (2, "again it's", "x"), (9, "long " * 5000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = [tuple(r) for r in tf.token_output(docs).orderBy("start").collect()]
    tok = Tokenizer.from_file(tf.tokenizer_path())
    ids = {t: [*tok.encode(t or "", add_special_tokens=False).ids, 2] for _, t, _ in rows}
    assert [g[0] for g in got] == [None, 1, 2, 2, 3, 9]
    at = 0
    for doc_id, start, n, crc in got:
        assert start == at
        assert (n, crc) in {(len(v), zlib.crc32(np.array(v, dtype="<u4").tobytes())) for d, t, _ in rows if d == doc_id for v in [ids[t]]}
        at += n


def test_empty_table(spark):
    assert tf.token_output(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_frames_are_independent_and_checked(monkeypatch):
    monkeypatch.setattr(tf, "FRAME_IDS", 10)
    out = io.BytesIO()
    writer = tf.ShardWriter(out, "<u2")
    docs = {7: np.arange(35, dtype="<u2"), 8: np.arange(1, dtype="<u2"), None: np.arange(10, dtype="<u2")}
    for k, v in docs.items():
        writer.add(k, v.tobytes())
    writer.close()
    data = out.getvalue()
    reader = tf.ShardReader(Bytes(data))
    assert [(k, v.tolist()) for k, v in reader.documents()] == [(k, v.tolist()) for k, v in docs.items()]
    assert reader.document(0).tolist() == docs[7].tolist()
    assert reader.document(1).tolist() == [0]
    plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read()
    assert plain.startswith(docs[7].tobytes())
    torn = bytearray(data)
    torn[int(reader.offsets[1]) - 3] ^= 1
    with pytest.raises((ValueError, zstandard.ZstdError)):
        tf.ShardReader(Bytes(bytes(torn))).document(0)
