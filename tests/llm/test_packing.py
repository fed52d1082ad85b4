import functools
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sluice.llm import packing as P
from sluice.llm import tokencount, tokens
from tests.conftest import SF

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "  ", " \n", "a", "Zé", "\x1c", "\x85", "\xa0", "<|endoftext|>", "<|ENDOFTEXT|>", "'s", "1", "́", "İ", "\r\n", "\t", ".", "日本", "　"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(ODD), max_size=12).map("".join))
def test_chunks_encode_as_the_whole_text_does(text):
    for path, chunks in ((WORD, tokens.blank_chunks), (BYTE, tokens.space_chunks)):
        encode = tokens.encoder(path, chunks, list)
        assert sum(encode([text])[0], []) == _tokenizer(path).encode(text, add_special_tokens=False).ids


@functools.cache
def _tokenizer(path):
    return Tokenizer.from_file(path)


def test_memo_starts_anew_at_its_limit():
    encode = tokens.Encoder(BYTE, tokens.space_chunks, len, memo=3)
    for text in ("a b c d e", "f g h", "a b"):
        assert sum(encode([text])[0]) == len(_tokenizer(BYTE).encode(text).ids)


def test_plan_uses_up_the_histogram_with_little_padding():
    rng = np.random.default_rng(1)
    for n in (0, 1, 50, 30_000):
        lengths = np.minimum(4096, rng.lognormal(6, 1.2, n).astype(int) + 1)
        count = np.bincount(lengths, minlength=4097)
        used, sequences = np.zeros(4097, int), 0
        for pattern, times in P.plan(count):
            assert times > 0 and sum(a * c for a, c in pattern) <= 4096
            sequences += times
            for a, c in pattern:
                used[a] += c * times
        assert (used == count).all()
        assert n < 1000 or lengths.sum() / (4096 * sequences) > 0.98


def test_solution_is_non_negative_and_close():
    lengths, copies = np.array([[1, 3, 0], [2, 0, 0]]), np.array([[1, 1, 0], [2, 0, 0]])
    x = P.solve(lengths, copies, np.array([0, 5, 8, 5]))
    assert np.allclose(x, [5, 4], atol=0.05)


def _check(rows, texts):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for i, text in texts.items():
        ids = _tokenizer(WORD).encode(text or "", add_special_tokens=False).ids + [2]
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids)) and r.length > 0
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    padding = 0
    for s in by_sequence.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
        padding += 4096 - at
    return padding / (4096 * max(1, len(by_sequence)))


def test_intervals_place_every_piece_once():
    rng = np.random.default_rng(3)
    dense = np.zeros(4097, np.int64)
    dense[1:] = rng.integers(0, 400, 4096)
    short = np.zeros(4097, np.int64)
    short[[1, 2, 3, 1000]] = 9000, 70_000, 5, 2
    for count in (dense, short):
        rows = P.intervals(P.plan(count))
        assert len(rows) <= P.most_intervals(4096)
        got, spans = np.zeros(4097, np.int64), {}
        for length, low, high, copies, first, base in rows:
            assert low == got[length] and (high - low) % copies == 0  # ranks follow each other without a gap
            got[length] = high
            for sequence in (first, first + (high - low) // copies - 1):
                spans.setdefault(sequence, set()).add((base, length * copies))
        assert (got == count).all()
        for parts in spans.values():
            at = 0
            for base, size in sorted(parts):
                assert base == at
                at += size
            assert at <= 4096
    assert len(P.intervals(P.plan(short))) < 20  # equal copies are one row


def test_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert _check(P.op10_nnls_packing(spark, SF).collect(), texts) < 0.05


def test_edges(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "w " * 9000, "x"), (None, "a b", "x"), (4, "<|endoftext|> X́ y", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = P.packed(docs, WORD).collect()
    _check(got, {i: t for i, t, _ in rows})
    assert P.packed(docs.union(docs), WORD).count() == 2 * len(got)
    assert P.packed(docs.limit(0), WORD).count() == 0


def test_token_cache(spark):
    import tempfile

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in tokencount.op4_token_cache(spark, SF).collect():
        n = len(_tokenizer(BYTE).encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len(texts[r.doc_id].encode()), n > 512)
    cache = f"{tempfile.mkdtemp(prefix='spark-')}/cache"
    rows = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "x " * 50_000)]
    docs = spark.createDataFrame([(*r, "y") for r in rows], "doc_id long, text string, digest string")
    for _ in range(2):
        got = tokencount.count_tokens(docs, cache, BYTE).collect()
        assert sorted(r.n_tokens for r in got) == sorted(len(_tokenizer(BYTE).encode(t or "").ids) for _, t in rows)
    assert spark.read.parquet(cache).count() == 3  # the second run met no miss
    assert tokencount.count_tokens(docs.limit(0), cache, BYTE).count() == 0


def test_words_are_split_at_the_six_blanks_only():
    assert tokens.blank_chunks("a\x1cb c") == [w.encode() for w in re.split(r"[\x20\x09-\x0D]+", "a\x1cb c")]


@pytest.mark.parametrize("text", ["a  b", " a", "a ", "a \n b", "x\n\ny z"])
def test_space_chunks_keep_the_text(text):
    assert "".join(tokens.space_chunks(text)) == text


@pytest.mark.parametrize("memo", [4, 1000])
def test_blank_encoder_gives_the_ids_of_whole_texts(memo):
    texts = ["", " ", "A <|endoftext|> B", "<|STARTOFTEXT|>x", "É ß  ß\x0b\x0cKK", "a\x1cb\x85c d", "x" * 5000, "\x00 a", "a\x01b \x01 c", "\x01", *(f"Word{k} re.&&& {k}" for k in range(300))]
    want = [tokens.pack16(e.ids) for e in _tokenizer(WORD).encode_batch(texts, add_special_tokens=False)]
    encode = tokens.BlankEncoder(WORD, memo)
    assert encode(texts) == want and encode(texts[::-1]) == want[::-1] and encode([]) == []
