import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from govlake.llm import token_store as ts

from .helpers import awkward_rows, frame

FILE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(FILE)


def test_pieces_give_the_ids_of_whole_texts(plain):
    encoder = ts.Encoder(open(FILE, encoding="utf-8").read())
    texts = [r[1] or "" for r in awkward_rows()]
    texts += ["a  b", "a   b", "a \n b", " a", "a ", "  ", "a\tb c", "it's we'll 's", "1 22 a1 !? ...", "x y z", "x\x1cy z", "a 　 b", "日本 語 テスト", "a\r\n b", "word<|endoftext|> word"]
    assert encoder.by_piece
    for _ in range(2):
        for t, got in zip(texts, encoder.encode_all(texts), strict=True):
            assert np.frombuffer(got, encoder.dtype).tolist() == plain.encode(t, add_special_tokens=False).ids, repr(t)


def test_odd_joints(plain, monkeypatch):
    import random

    monkeypatch.setattr(ts, "TOGETHER", 3)
    encoder, rng = ts.Encoder(open(FILE, encoding="utf-8").read()), random.Random(4)
    marks = ["", ",", ".", "\n", "\n\n", "'s", "!?", " ", "9", "\t", "é", ".\nThe", "<|endoftext|>", "\x85", "\n\n\n", "\nx"]
    texts = [" ".join(rng.choice("ab the qu on".split()) + rng.choice(marks) + rng.choice(marks) for _ in range(rng.randrange(12))) for _ in range(600)]
    for i in range(0, len(texts), 20):
        for t, got in zip(texts[i : i + 20], encoder.encode_all(texts[i : i + 20]), strict=True):
            assert np.frombuffer(got, encoder.dtype).tolist() == plain.encode(t, add_special_tokens=False).ids, repr(t)


def test_crc_of_pieces():
    rng = np.random.default_rng(1)
    parts = [rng.integers(0, 2**32, n, dtype=np.uint32).astype("<u4") for n in (1, 5, 300, 1, 70_000)]
    after = np.array([sum(map(len, parts[i + 1 :])) for i in range(len(parts))])
    crcs = np.array([zlib.crc32(p.tobytes()) for p in parts])
    assert np.bitwise_xor.reduce(ts.moved_crc(crcs, after)) == zlib.crc32(np.concatenate(parts).tobytes())


def test_store_against_brute_force(spark, plain):
    rows = awkward_rows()
    store = ts.write_store(frame(spark, rows), FILE)
    got = sorted(ts.read_documents(store).collect(), key=lambda r: r.start)
    ids = {repr(r[0]) + repr(r[1]): [*plain.encode(r[1] or "", add_special_tokens=False).ids, 0] for r in rows}
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda x: (x is not None, x or 0))
    start = 0
    for r in got:
        assert r.start == start
        start += r.n_tokens
    expected = sorted((repr(r[0]), len(x := ids[repr(r[0]) + repr(r[1])]), zlib.crc32(np.array(x, "<u4").tobytes())) for r in rows)
    assert sorted((repr(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == expected
    whole = {(repr(r.doc_id), tuple(r.ids)) for r in ts.reconstruct(store).collect()}
    assert whole == {(repr(r[0]), tuple(ids[repr(r[0]) + repr(r[1])])) for r in rows}
    chunks = store.chunks.select("key").collect()
    assert len(chunks) == len({bytes(c.key) for c in chunks})


def test_shared_passages_are_stored_once(spark):
    rng = np.random.default_rng(2)
    body = " ".join(f"w{x}" for x in rng.integers(0, 10**6, 6000))
    rows = [(i, f"start {i} " + body + f" end {i}", None, None, 0, 0, 0, True, 0) for i in range(20)]
    store = ts.write_store(frame(spark, rows), FILE)
    stored = store.chunks.selectExpr("sum(length(data))").first()[0]
    whole = ts.read_documents(store).selectExpr("sum(n_tokens)").first()[0] * store.width
    assert stored < whole / 8


def test_empty_table(spark):
    store = ts.write_store(frame(spark, []), FILE)
    assert ts.read_documents(store).collect() == [] and store.manifest.collect() == []


def test_damage_is_found(spark):
    store = ts.write_store(frame(spark, awkward_rows()[:20]), FILE)
    bad = ts.TokenStore(spark, store.path, store.id_type, 4)  # another width: other ids
    with pytest.raises(Exception, match="length|match|multiple"):
        ts.read_documents(bad).collect()


def test_marks_look_at_the_last_ids_only():
    ids = np.random.default_rng(8).integers(0, 50_000, 40_000).astype("<u2")
    gear = ts._GEAR[ids.astype(np.int64)]
    slow = sum(np.concatenate([np.zeros(k, np.uint64), gear[: len(gear) - k] << np.uint64(k)]) for k in range(ts.SPAN))
    assert ts._marks(ids).tolist() == (np.flatnonzero((slow >> np.uint64(ts.SPAN + 8)) & np.uint64((1 << ts.CUT_BITS) - 1) == 0) + 1).tolist()


def test_known_words_and_their_renewal(plain, monkeypatch):
    import random

    monkeypatch.setattr(ts, "KNOWN_WORDS", 50)
    encoder, rng = ts.Encoder(open(FILE, encoding="utf-8").read()), random.Random(5)
    for _ in range(12):
        texts = [" ".join(rng.choice(["ab", "ünd", "x1y"]) + rng.choice("pqrstu") * rng.randrange(4) + rng.choice(["", ",", "\n"]) + rng.choice(["", "z"]) for _ in range(30)) for _ in range(rng.randrange(1, 4))]
        for t, got in zip(texts, encoder.encode_all(texts), strict=True):
            assert np.frombuffer(got, encoder.dtype).tolist() == plain.encode(t, add_special_tokens=False).ids, repr(t)
        assert len(encoder.known) == len(encoder.sizes) and int(encoder.sizes.sum()) == len(encoder.pool)
