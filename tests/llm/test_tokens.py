"""Encoding, decoding and packing against the libraries themselves."""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from survloom.llm import bpe, packing, tokens

ODD = ["", " ", "  ", "\n\n a  b\t c ", " lead", "trail ", "naïve café", "数据 🙂🙂", "a b   c", "<|endoftext|> it's", "x" * 3000, "word " * 4000, "I'll\r\n 12 345!?"]


@pytest.fixture(scope="module")
def reference():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        ranks = tokens.read_ranks(file.read())
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def from_ranks():
    return tokens.load(bpe.from_rank_file())


def cached(model):
    encoder = tokens.CachedEncoder(tokens.tokenizers_encoder(model), tokens.packed)
    return lambda texts: [np.frombuffer(b"".join(x), "<u4").tolist() for x in encoder(texts)]


def test_ids_are_those_of_the_rank_library(reference, from_ranks):
    assert cached(from_ranks)(ODD) == [reference.encode_ordinary(t) for t in ODD]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab é\n\t.'1  数🙂,T")), max_size=30), max_size=4))
def test_pieces_never_change_the_ids(reference, from_ranks, texts):
    assert cached(from_ranks)(texts) == [reference.encode_ordinary(t) for t in texts]


def test_a_full_cache_starts_anew(reference, from_ranks, monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_PIECES", 2)
    texts = ["one two three four", "two five", "one two"]
    encode = cached(from_ranks)
    assert [encode([t])[0] for t in texts] == [reference.encode_ordinary(t) for t in texts]


def test_both_engines_agree_on_the_json_file():
    serialised, pattern = packing.tokenizer_file()
    model = tokens.load(serialised)
    want = [tokens.packed(model.encode(t, add_special_tokens=False).ids) for t in ODD]
    assert tokens.rank_encoder(model, pattern)(ODD) == want


def test_offsets_of_split_characters(spark, from_ranks):
    df = spark.createDataFrame([(1, "é🙂 a"), (2, None), (3, "")], "doc_id long, text string")
    rows = {r.doc_id: r for r in bpe.decode(bpe.encode(df, bpe.from_rank_file()), bpe.from_rank_file()).collect()}
    assert bytes(rows[1].decoded).decode() == "é🙂 a"
    decoder = tokens.Decoder(from_ranks)
    first, character = decoder.offsets(np.array(rows[1].ids))
    data = "é🙂 a".encode()
    assert rows[1].offsets == character.tolist()
    assert [len(data[:b].decode(errors="ignore")) for b in first] == character.tolist()
    assert rows[2].ids == [] and rows[3].ids == [] and bytes(rows[3].decoded) == b""


def test_digests(spark, reference):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate([*ODD, None])], "doc_id long, text string, ids string")
    rows = {r.doc_id: r for r in bpe.round_trip_digests(df, bpe.from_rank_file()).collect()}
    for i, text in enumerate([*ODD, ""]):
        ids = reference.encode_ordinary(text)
        want = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
        assert (rows[i].n_tokens, rows[i].ids_sha256, rows[i].decoded_sha256) == want
    assert bpe.round_trip_digests(df.limit(0), bpe.from_rank_file()).count() == 0


def check_packing(rows, wanted):
    """Every id in one piece, sequences gapless and within the window; returns the padding."""
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    sequences, pieces = defaultdict(list), defaultdict(list)
    for row in rows:
        sequences[row.sequence_id].append(row)
        pieces[row.doc_id].append(row)
    for doc_id, text in wanted.items():
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for row in sorted(pieces[doc_id], key=lambda r: r.start):
            assert row.start == at and row.doc_tokens == len(ids)
            at += row.length
            assert zlib.crc32(ids[row.start : at].tobytes()) == row.ids_crc32
        assert at == len(ids)
    padding = 0
    for parts in sequences.values():
        at = 0
        for row in sorted(parts, key=lambda r: r.offset):
            assert row.offset == at
            at += row.length
        assert 0 < at <= packing.WINDOW
        padding += 0 if at & (at - 1) == 0 else packing.WINDOW - at
    return padding


@pytest.mark.parametrize("shard", [3, 1024])
def test_packing_is_whole_and_tight(spark, monkeypatch, shard):
    monkeypatch.setattr(packing, "SHARD_TAILS", shard)
    texts = dict(enumerate([*ODD, None, *(f"topic{i % 3} " * (50 + 17 * i) for i in range(40))]))
    df = spark.createDataFrame([(i, t, "e", 1) for i, t in texts.items()], "doc_id long, text string, extra string, shard int")
    padding = check_packing(packing.pack(df, *packing.tokenizer_file()).collect(), texts)
    if shard == 1024:
        assert padding < packing.WINDOW


def test_packing_of_repeats_nulls_and_nothing(spark):
    df = spark.createDataFrame([(1, "same words here")] * 50 + [(None, None)] * 3, "doc_id long, text string")
    rows = packing.pack(df, *packing.tokenizer_file()).collect()
    assert sum(r.length for r in rows if r.doc_id == 1) == 50 * 4 and sum(r.length for r in rows if r.doc_id is None) == 3
    assert packing.pack(df.limit(0), *packing.tokenizer_file()).count() == 0


def test_neighbours_of_a_seed_come_first():
    words = [np.array(x) for x in ([1, 2, 3], [7, 8, 9], [1, 2, 4], [7, 8, 5])]
    index = packing._Index(words, np.ones(10), 3.0)
    cut = list(packing._fill([3, 3, 3, 3], index, 6))
    windows = defaultdict(list)
    for tail, _, _, window, _ in cut:
        windows[window].append(tail)
    assert windows == {0: [0, 2], 1: [1, 3]}
