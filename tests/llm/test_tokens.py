"""Packing and token files: exact against the tokenizers library, round trips, odd rows."""

import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm import packing, tokenfile
from lectern.llm.plans import op1_pack, op4_token_file
from lectern.llm.tokens import WordEncoder, default_tokenizer, encoder
from lectern.session import read_table
from tests.llm.conftest import ODD

SF = "/root/testdata/sf0.001"


def ids_of(text, end):
    return [*encoder(default_tokenizer()).tok.encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab .,\n\t!'s1é𝄞　\xa0\x1c\x85 <|endoftext|>", max_size=30))
def test_word_encoder_equals_library(text):
    enc = encoder(default_tokenizer())
    assert np.frombuffer(enc.encode_many([text])[0], enc.dtype).tolist() == enc.tok.encode(text, add_special_tokens=False).ids


def test_word_encoder_restarts_its_cache(monkeypatch):
    monkeypatch.setattr("lectern.llm.tokens.MAX_WORDS", 10)
    enc, rnd = WordEncoder(default_tokenizer()), random.Random(1)
    for _ in range(50):
        texts = [" ".join(rnd.choice(["alpha", "béta,", "x\ny", "q.", "", "Zz's"]) + str(rnd.random()) for _ in range(9)) for _ in range(3)]
        got = enc.encode_many(texts)
        assert [np.frombuffer(g, enc.dtype).tolist() for g in got] == [enc.tok.encode(t, add_special_tokens=False).ids for t in texts]


def check_pieces(rows, texts, max_len=1024):
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert sorted(by, key=str) == sorted(texts, key=str)
    for doc_id, pieces in by.items():
        ids = ids_of(texts[doc_id], 0)
        pieces.sort(key=lambda r: r.start)
        at = 0
        for p in pieces:
            assert p.start == at and p.doc_tokens == len(ids) and p.offset == 0
            assert p.length & (p.length - 1) == 0 and p.length <= max_len
            assert p.ids_crc32 == crc(ids[at:at + p.length])
            at += p.length
        assert at == len(ids)
        assert [p.length for p in pieces] == sorted([p.length for p in pieces], reverse=True)
    seq = sorted(rows, key=lambda r: r.sequence_id)
    assert [r.sequence_id for r in seq] == list(range(len(rows)))  # dense: one piece per sequence
    assert [r.length for r in seq] == sorted([r.length for r in seq], reverse=True)  # buckets of equal length


def test_op1_against_library(spark):
    texts = {r.doc_id: r.text for r in read_table(spark, SF, "documents").collect()}
    check_pieces(op1_pack(spark, SF).collect(), texts)


def test_pack_is_deterministic_across_partitionings(spark, docs):
    rows = [(i, f"word{i} " * (i * 37 % 900)) for i in range(60)]
    a = sorted(map(tuple, packing.pack(docs(rows).repartition(7)).select("doc_id", "start", "length", "sequence_id").collect()))
    b = sorted(map(tuple, packing.pack(docs(rows).coalesce(1)).select("doc_id", "start", "length", "sequence_id").collect()))
    assert a == b


def test_pack_odd_rows(spark, clash, docs):
    got = packing.pack(clash(ODD)).collect()
    want = [(d, p) for d, t, *_ in ODD for p in packing.cut_lengths(np.array([len(ids_of(t, 0))]), 1024)[1].tolist()]
    assert sorted([(r.doc_id, r.length) for r in got], key=str) == sorted(want, key=str)
    assert sorted(r.sequence_id for r in got) == list(range(len(got)))
    assert packing.pack(docs([])).count() == 0
    with pytest.raises(ValueError):
        packing.pack(docs([]), max_len=1000)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 1 << 40), max_size=700))
def test_elias_fano_round_trip(values):
    values.sort()
    ef = tokenfile.EliasFano.encode(np.array(values, np.uint64))
    back, end = tokenfile.EliasFano.from_bytes(b"zz" + ef.to_bytes(), 2)
    assert end == 2 + len(ef.to_bytes())
    assert back.decode().tolist() == values
    for i in range(0, len(values), 13):
        assert back.select(i) == values[i]
    if len(values) > 300:  # near-minimal: well under a 64-bit table
        assert len(ef.low) + len(ef.high) < len(values) * (45 - len(values).bit_length() + 3) / 8 + 9


def test_block_gives_single_documents():
    ids = [np.arange(n, dtype="<u2") for n in (1, 5, 0, 700)]
    block = tokenfile.Block(tokenfile.write_block([-4, 0, 0, 9], ids))
    assert [(d, x.tolist()) for d, x in map(block.doc, range(4))] == [(-4, [0]), (0, [0, 1, 2, 3, 4]), (0, []), (9, list(range(700)))]
    with pytest.raises(ValueError):
        tokenfile.Block(b"none")


def expected_file(rows):
    at, out = 0, []
    for doc_id, text in rows:
        ids = ids_of(text, 2)
        out.append((doc_id, at, len(ids), crc(ids)))
        at += len(ids)
    return out


def test_op4_against_library(spark):
    rows = sorted((r.doc_id, r.text) for r in read_table(spark, SF, "documents").collect())
    assert sorted(map(tuple, op4_token_file(spark, SF).collect())) == expected_file(rows)


def test_token_file_odd_rows(spark, clash, docs, tmp_path):
    tokenfile.write_token_file(clash(ODD), f"{tmp_path}/a", block_ids=50)
    got = sorted(((r.doc_id, r.start, r.n_tokens, zlib.crc32(r.ids)) for r in tokenfile.read_token_file(spark, f"{tmp_path}/a").collect()), key=lambda r: r[1])
    rows = sorted(((d, t) for d, t, *_ in ODD), key=lambda r: (r[0] is not None, r[0] or 0))
    assert got == expected_file(rows)
    tokenfile.write_token_file(docs([]), f"{tmp_path}/b")
    assert tokenfile.read_token_file(spark, f"{tmp_path}/b").count() == 0
