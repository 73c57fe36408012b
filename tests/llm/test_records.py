import zlib

import numpy as np
import pyarrow as pa
import pytest
from fixtures import documents, frame

from chainweave.llm import records, tokens

ODD = [None, "", " ", "a  b", " a", "a ", "\n", "x\n y", "日本 語", "<|endoftext|> a", "it's 12² foo_bar  \n\n z", "é—…€ x y", "a\tb c", "don't we'll\n'tis", " x", "a\x1cb"]


def plain_ids(texts):
    t = tokens.load()
    return [t.encode(x or "", add_special_tokens=False).ids + [0] for x in texts]


def test_encoder_equals_the_library():
    texts = ODD + [d[1] for d in documents()] + ODD[::-1]
    offsets, ids = tokens.Encoder().encode(pa.array(texts, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == plain_ids(texts)


def test_encoder_forgets_without_harm(monkeypatch):
    monkeypatch.setattr(tokens, "MEMORY", 50)
    monkeypatch.setattr(tokens, "CHARS_AT_ONCE", 900)
    texts = ODD + [d[1] for d in documents()]
    offsets, ids = tokens.Encoder().encode(pa.array(texts, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == plain_ids(texts)


def test_files_round_trip(spark, tmp_path):
    rows = documents()
    folder, index = records.write(frame(spark, rows, extra=("shard", "length")), str(tmp_path))
    got = records.with_starts(records.read(spark, folder), index).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i or 0))
    of = {}
    for (i, text, *_), ids in zip(rows, plain_ids([r[1] for r in rows])):
        of.setdefault(i, []).append(ids)
    at = 0
    for r in got:
        assert r.start == at and any(len(x) == r.n_tokens and zlib.crc32(np.array(x, "<u4").tobytes()) == r.ids_crc32 for x in of[r.doc_id])
        at += r.n_tokens
    for e in index.collect()[::5]:
        doc_id, ids = records.read_at(folder, e.shard, e.offset, e.length)
        assert doc_id == e.doc_id and ids in of[e.doc_id]


def test_damage_is_noticed():
    good = records.frame(records.payload(7, np.array([1, 70_000, 3], np.uint32)))
    data, end = records.unframed(good)
    assert end == len(good) and records.unpacked(data)[1].tolist() == [1, 70_000, 3]
    for k in range(len(good)):
        bad = bytearray(good)
        bad[k] ^= 1
        with pytest.raises(ValueError):
            records.unframed(bytes(bad))
    with pytest.raises(ValueError):
        records.unframed(good[:-1])


def test_empty(spark, tmp_path):
    folder, index = records.write(frame(spark, []), str(tmp_path))
    assert index.count() == 0 and records.read(spark, folder).count() == 0


def test_letters_between_blanks_are_one_piece():
    """They go to the model without being cut up, and are remembered once."""
    text = "Ein Wort, zwei W\u00f6rter it's \u00aa\u00ba \u00b5m 4th e\u20ac a-b ~ x"
    encoder = tokens.Encoder()
    _, ids = encoder.encode(pa.array([text]))
    assert ids.tolist() == [*tokens.load().encode(text, add_special_tokens=False).ids, 0]
    assert " zwei" in encoder.chunks and not {" zwei", " W\u00f6rter", "Ein"} & set(encoder.pieces)
