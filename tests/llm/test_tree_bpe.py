import hashlib
import random

import pytest

from chainweave.llm import common, queries, tokens, tree_bpe
from fixtures import documents, frame


@pytest.fixture(scope="module")
def library():
    return tokens.load(tree_bpe.DEFAULT_TOKENIZER)


def texts():
    r = random.Random(3)
    letters = "abcXYZ'sTre \t\n\x0b\x0c\x1c\x1d\x85\xa0 é́éΣςİǅK日本\U0001f389#$%123٣²<|endoftext|>ſß​\xad\x00"
    out = ["".join(r.choice(letters) for _ in range(r.randint(0, 40))) for _ in range(1500)]
    return out + ["<|endoftext|>a<|startoftext|> b<|END|>", "x" * 3000, "don't I'VE we'll 's", "", "aaa" + "!" * 900 + "é" * 999]


def test_as_the_library(library):
    coder, all_texts = tree_bpe.Coder(), texts()
    got = coder.encode_all([x.encode() for x in all_texts])
    for text, ids in zip(all_texts, got):
        want = library.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == want
        assert coder.decode(ids).decode() == library.decode(want, skip_special_tokens=False)


def test_trees_in_step_and_alone_agree():
    coder, r = tree_bpe.Coder(), random.Random(8)
    pieces = ["".join(r.choice("etaoinshrdlu") for _ in range(r.randint(1, 64))) for _ in range(400)]
    assert [list(memoryview(x).cast("I")) for x in coder.pieces(pieces)] == [coder.piece(x) for x in pieces]


def test_tree_root_is_the_leftmost_least():
    r = random.Random(2)
    keys = [r.randrange(9) * 50 + k for k in range(37)]
    tree = tree_bpe.PairTree(list(keys), 10_000)
    for _ in range(300):
        k = r.randrange(37)
        keys[k] = r.choice([10_000, r.randrange(9) * 50 + k])
        tree.put(k, keys[k])
        assert tree.least() == min(keys)


@pytest.mark.parametrize("memory", (64_000_000, 0))
def test_operator(spark, monkeypatch, tmp_path, library, memory):
    monkeypatch.setattr(tree_bpe, "MEMORY_BYTES", memory)
    monkeypatch.setattr(common, "SLICE_BYTES", 4000)
    df = frame(spark, extra=("ids", "n_tokens"))
    rows = [(i, library.encode(t or "", add_special_tokens=False).ids) for i, t, *_ in documents()]
    encoded = tree_bpe.encode(df, keep=("lang",))
    assert sorted(map(str, ((r.doc_id, r.ids) for r in encoded.collect()))) == sorted(map(str, rows))
    decoded = [(r.doc_id, r.decoded) for r in tree_bpe.decode(encoded).collect()]
    assert sorted(map(str, decoded)) == sorted(str((i, library.decode(x, skip_special_tokens=False))) for i, x in rows)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = [(i, len(x), sha(" ".join(map(str, x))), sha(library.decode(x, skip_special_tokens=False))) for i, x in rows]
    got = queries.QUERIES["op13_tree_bpe"](spark, str(tmp_path))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert tree_bpe.digests(df.limit(0)).collect() == []
