import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from diffloom.llm import bpe, tokenbin

RANKS, WORDS = P.path("byte_bpe_50k.tiktoken"), P.path("word_bpe_49k.json")


def sample(n=60):
    rng = random.Random(1)
    words = ["the", "Don't", "we're", "über", "naïve", "x1", "123", "日本語", "…", "a-b", "#!", "foo\nbar", "<|endoftext|>", "é"]
    return [" ".join(rng.choice(words) for _ in range(rng.randint(0, 300))) + rng.choice(["", " ", "\n\n", "  "]) for _ in range(n)]


def test_safe_cuts_give_the_whole_text_s_ids():
    enc = bpe.encoding(RANKS, P.PATTERN)
    for text in sample():
        assert bpe.encode(enc, text, 40) == enc.encode_ordinary(text)
        assert bpe.decode(enc, bpe.encode(enc, text, 40)) == text.encode()


def test_long_runs_encode_and_decode():
    enc = bpe.encoding(RANKS, P.PATTERN)
    runs = [" " * 9000, "\n" * 5000 + " " * 5000, "日本語の文章" * 12_000, "привет" * 12_000, "a\u2003" * 30_000, "x、y。" * 30_000, "!?" * 40_000, "é's" * 30_000, "\x1c \x1d" * 20_000]
    for run in runs:
        for text in (run, f"a{run}", f"{run}b", f"a {run} b", f"{run}{run[:7]}.", f"1{run}'s"):
            assert bpe.encode(enc, text) == enc.encode_ordinary(text)
    for text in (" " * 5_000_000 + "x", "x" + "\n" * 5_000_000, "\u3000\t " * 1_000_000, "日本" * 1_000_000, "д" * 2_000_000):
        ids = bpe.encode(enc, text)
        assert bpe.decode(enc, ids) == text.encode()
    assert bpe.encode(enc, " " * 500_000 + "x y") == enc.encode_ordinary(" " * 500_000 + "x y")


def test_byte_bpe_rows(spark, docs_of, odd_rows, no_rows):
    import tiktoken

    texts = [*sample(20), None, ""]
    enc = bpe.encoding(RANKS, P.PATTERN)
    assert isinstance(enc, tiktoken.Encoding)
    rows = bpe.encode_documents(docs_of(texts), RANKS, P.PATTERN).orderBy("doc_id").collect()
    for r, text in zip(rows, texts):
        ids = enc.encode_ordinary(text or "")
        assert r.token_ids == ids and r.n_tokens == len(ids) and r.round_trip
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    odd = bpe.encode_documents(odd_rows, RANKS, P.PATTERN, keep_ids=False).collect()
    assert len(odd) == 10 and all(r.round_trip for r in odd)
    assert bpe.encode_documents(no_rows, RANKS, P.PATTERN).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 70_000), st.integers(0, 2**63 - 1)), max_size=400), st.integers(1, 200))
def test_simple8b_round_trip(values, block):
    values = np.array(values, np.uint64)
    payload, offsets, escapes = tokenbin.pack(values, block)
    assert (tokenbin.unpack(payload, escapes) == values).all() and len(payload) % 8 == 0
    ends = [*offsets[1:], len(payload) // 8]
    for k, (a, b) in enumerate(zip(offsets, ends)):  # every block decodes alone
        assert (tokenbin.unpack(payload, escapes, a, b) == values[k * block : (k + 1) * block]).all()


def test_simple8b_packs_small_ids_densely():
    assert len(tokenbin.pack(np.zeros(6000, np.uint64))[0]) == 800
    assert len(tokenbin.pack(np.full(400, 30_000, np.uint64))[0]) == 800


def test_word_encoder_equals_the_library():
    from tokenizers import Tokenizer
    import pyarrow as pa

    whole = Tokenizer.from_file(WORDS)
    a = "a"
    for _ in range(11):  # two words that any polynomial hash modulo 2**64 takes for one
        a += a.translate({97: 98, 98: 97})
    texts = sample() + ["see <|endoftext|> here", "a<|startoftext|>b", "<|ENDOFTEXT|> <|", f"{a} x", f"{a.translate({97: 98, 98: 97})} x {a}", "İstanbul DŽ ǆ", "é é ẛ̣", "a b c", "", "\tx"]
    encoder = tokenbin.WordEncoder(whole, keep=50)
    got = [part for ids, sizes in encoder.encode(pa.array(texts)) for part in np.split(ids, np.cumsum(sizes)[:-1])]
    assert [list(g) for g in got] == [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]


def test_token_files(spark, docs_of, odd_rows, no_rows, tmp_path):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(WORDS)
    texts = sample(200)
    random.Random(2).shuffle(texts)
    rows = [(i * 3, t) for i, t in enumerate(texts)]
    random.Random(3).shuffle(rows)
    got = tokenbin.round_trip(docs_of(rows).repartition(7), WORDS, str(tmp_path / "f"), ).orderBy("doc_id").collect()
    at = 0
    for r, (doc_id, text) in zip(got, sorted(rows)):
        ids = whole.encode(text, add_special_tokens=False).ids + [1]
        assert (r.doc_id, r.start, r.n_tokens) == (doc_id, at, len(ids)) and r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    odd = tokenbin.round_trip(odd_rows, WORDS, str(tmp_path / "odd")).collect()
    assert len(odd) == 10 and sum(r.doc_id is None for r in odd) == 1 and next(r for r in odd if r.doc_id == 1).n_tokens == 1
    assert tokenbin.round_trip(no_rows, WORDS, str(tmp_path / "none")).count() == 0
    kept = tokenbin.read_token_files(spark, str(tmp_path / "f"), keep_ids=True).filter("doc_id = 0").first()
    assert kept.token_ids[-1] == 1


def test_equal_hashes_go_through_the_library(monkeypatch):
    import pyarrow as pa
    from tokenizers import Tokenizer

    from diffloom.llm import textscan

    monkeypatch.setattr(textscan, "hash_words", lambda data, start, size, key=0: (size % 3).astype(np.uint64))
    whole, texts = Tokenizer.from_file(WORDS), sample()
    got = [part for ids, sizes in tokenbin.WordEncoder(whole).encode(pa.array(texts)) for part in np.split(ids, np.cumsum(sizes)[:-1])]
    assert [list(g) for g in got] == [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]


def test_a_block_decodes_alone(spark, docs_of, tmp_path):
    tokenbin.write_token_files(docs_of([(i, t) for i, t in enumerate(sample(400))]).coalesce(1), WORDS, str(tmp_path / "f"))
    whole = tokenbin.read_token_files(spark, str(tmp_path / "f"), keep_ids=True).orderBy("start").collect()
    ids, n = [i for r in whole for i in r.token_ids], 0
    for row in spark.read.parquet(str(tmp_path / "f")).orderBy("shard", "segment").collect():
        ends = [*row.block_offsets[1:], len(row.payload) // 8]
        for k in reversed(range(len(ends))):  # in any order
            at = n + k * tokenbin.BLOCK
            got = tokenbin.unpack(bytes(row.payload), row.escapes, row.block_offsets[k], ends[k])
            assert got.tolist() == ids[at : min(at + tokenbin.BLOCK, n + row.n_ids)]
        n += row.n_ids
    assert n == len(ids) > 2 * tokenbin.BLOCK


@pytest.mark.parametrize("value", [2**60, 2**62, 2**64 - 1])
def test_escapes(value):
    payload, _, escapes = tokenbin.pack(np.array([1, value, 2], np.uint64))
    assert [int(v) for v in tokenbin.unpack(payload, escapes)] == [1, value, 2]
