import zlib

import helpers
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from roentgrid.llm import bestfit, packing, tokens

TEXTS = helpers.awkward(["<|endoftext|> in a text", "it's  we'll\n  x", " lead", "trail ", "a\n b \n c", "1 22 333 $$ %% ñ É"])


@pytest.fixture(scope="module")
def full():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids_of(full, text):
    return [*full.encode(text or "", add_special_tokens=False).ids, 1]


ALPHABET = [*"ab'sZ é\n\t1$ 漢  ", "<|endoftext|>", "<|endoftext", "|>"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(ALPHABET), max_size=40).map("".join))
def test_words_encode_like_whole_texts(text):
    whole = tokens.encoder().full.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(tokens.encoder()(text), "<u2").tolist() == whole


def test_added_tokens_have_their_own_id(full):
    assert np.frombuffer(tokens.encoder()("a <|endoftext|> b<|endoftext|>"), "<u2").tolist().count(50256) == 2
    assert ids_of(full, "<|endoftext|>") == [50256, 1]


def test_concat_and_cut_is_exact(spark, full):
    ids = [None, *range(1, len(TEXTS) - 1), 1]  # a null id and a repeated one
    pieces = packing.concat_and_cut(helpers.documents(spark, TEXTS, ids), window=64).collect()
    digests = packing.piece_digests(packing.concat_and_cut(helpers.documents(spark, TEXTS, ids), window=64)).collect()
    assert sorted(zlib.crc32(p["ids"]) for p in pieces) == sorted(d["ids_crc32"] for d in digests)
    pieces.sort(key=lambda p: (p["sequence_id"], p["offset"]))
    # Gapless: every place of the stream is taken once and no piece crosses a window.
    at = 0
    for p in pieces:
        assert p["sequence_id"] * 64 + p["offset"] == at and 0 < p["length"] and p["offset"] + p["length"] <= 64
        assert len(p["ids"]) == 4 * p["length"]
        at += p["length"]
    stream = np.frombuffer(b"".join(p["ids"] for p in pieces), "<u4").tolist()
    docs, begin = [], 0
    for p in pieces:
        if p["start"] == 0:
            docs.append((p["doc_id"], stream[begin : begin + p["doc_tokens"]]))
            begin += p["doc_tokens"]
    assert begin == len(stream)
    assert sorted(docs, key=str) == sorted(((i, ids_of(full, t)) for i, t in zip(ids, TEXTS, strict=True)), key=str)


def test_empty_table(spark):
    docs = helpers.documents(spark, [None]).where("doc_id < 0")
    assert packing.concat_and_cut(docs).count() == 0
    assert bestfit.best_fit_matrices(docs).count() == 0


def test_best_fit_rows_hold_all_documents(spark, full):
    docs = helpers.documents(spark, TEXTS)
    rows = bestfit.with_position_ids(bestfit.best_fit_matrices(docs, window=128, shard_tokens=4096), 128).collect()
    assert len({r["sequence_id"] for r in rows}) == len(rows)
    parts = {}
    for r in rows:
        ids, cut = np.frombuffer(r["ids"], "<u2"), r["cu_seqlens"]
        assert len(ids) == 128 and cut[-1] == r["n_tokens"] and (ids[r["n_tokens"] :] == 0).all()
        for doc, start, a, b in zip(r["doc_ids"], r["doc_starts"], cut[:-1], cut[1:], strict=True):
            parts.setdefault(doc, {})[start] = ids[a:b].tolist()
            assert r["position_ids"][a:b] == list(range(b - a))
        assert len(r["position_ids"]) == 128
    for doc, text in enumerate(TEXTS):
        assert sum((parts[doc][s] for s in sorted(parts[doc])), []) == ids_of(full, text)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60))
def test_best_fit_takes_the_least_room(lengths):
    rows = bestfit.best_fit(lengths, 40)
    assert sorted(i for row in rows for i in row) == list(range(len(lengths)))
    # The same by looking at every open row.
    room, expected = [], 0
    for n in sorted(lengths, reverse=True):
        fits = [r for r in room if r >= n]
        if fits:
            room.remove(min(fits))
            room.append(min(fits) - n)
        else:
            room.append(40 - n)
            expected += 1
    assert len(rows) == expected and all(sum(lengths[i] for i in row) <= 40 for row in rows)
