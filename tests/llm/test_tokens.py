"""Byte-level BPE, token files: exact round trips and agreement with the libraries."""

import hashlib
import zlib
from types import SimpleNamespace

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from factweave.llm import bpe, storage, tokenfile

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
WORDS = P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def codec():
    return bpe.codec(RANKS, P.PATTERN)


@pytest.fixture(scope="module")
def library(codec):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})


TEXTS = ["", "a", " ", "  a", "a  b", "\n \n a", "x" * 3000, "ab" * 40_000, "́e é", "a   b\x1c c", "it's  we'll\t\tdon't", "日本語 漢字", "1234 5 six  ", " ,a", "a ", "\x1c a \x1d", "a\x85 b", " a b", "<|endoftext|> a"]


def test_bpe_agrees_with_library(codec, library):
    for text, ids in zip(TEXTS, codec.encode_batch(TEXTS)):
        assert ids.tolist() == library.encode_ordinary(text), text[:20]
        assert codec.decode(ids) == text.encode()
        assert codec.decimal(ids) == ",".join(map(str, ids.tolist())).encode()


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60), st.text(alphabet="ab \n'st,é", max_size=60))
def test_bpe_any_text(codec, library, a, b):
    for text, ids in zip([a, b], codec.encode_batch([a, b])):
        assert ids.tolist() == library.encode_ordinary(text)


def test_single_and_batched_trees_agree(codec):
    pieces = [bytes(w, "utf-8") for w in ("antidisestablishment", "zzzzzzzzzz", "qxqxqxq", "hello", "éèêé", "ab" * 30)]
    assert [np.array(codec.encode_piece(p), "<u4").tobytes() for p in pieces] == codec.encode_pieces(pieces)


def test_bpe_frame(spark, odd, empty, library):
    rows = bpe.encode_documents(odd, RANKS, P.PATTERN).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in odd.collect()}
    assert len(rows) == odd.count()
    for r in rows:
        ids = library.encode_ordinary(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids"]) == (len(ids), ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
    assert bpe.encode_documents(empty, RANKS, P.PATTERN).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60), st.text(alphabet="ab \n'sT,é5́\x1c", max_size=60))
def test_word_encoder_agrees_with_library(a, b):
    own, library = tokenfile.encoder(WORDS), Tokenizer.from_file(WORDS)
    assert own.fits
    texts = [a, b, f"{a}<|endoftext|>{b}", f"{b} <|startoftext|>\n<|ENDOFTEXT|>{a}", "ΟΔΟΣ. ΟΔΟΣ İI ÀÖ× ÿß µ"]
    for text, raw in zip(texts, own.encode(texts)):
        assert np.frombuffer(raw, own.type).tolist() == library.encode(text, add_special_tokens=False).ids


def test_token_file(spark, odd, empty, tmp_path):
    library = Tokenizer.from_file(WORDS)
    docs = odd.select("doc_id", "text")
    dictionary = tokenfile.train_dictionary(docs, WORDS)
    shards = tokenfile.write(docs, WORDS, 2, dictionary).cache()
    rows = sorted(tokenfile.read(shards, dictionary).collect(), key=lambda r: r["start"])
    expected = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["text"] is not None, r["text"] or "") for r in docs.collect()))
    start = 0
    assert len(rows) == len(expected)
    for r, (known, doc_id, _, text) in zip(rows, expected):
        ids = [*library.encode(text, add_special_tokens=False).ids, 2]
        assert r["doc_id"] == (doc_id if known else None)
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    tokenfile.export(shards, dictionary, str(tmp_path / "out"))
    assert len(list((tmp_path / "out").glob("*.ids"))) == shards.count()
    assert tokenfile.round_trip(empty, WORDS, 2).count() == 0


def test_shard_refuses_another_dictionary():
    blob = tokenfile.pack([b""], [1], [0], 2, b"")
    with pytest.raises(ValueError):
        tokenfile.Shard(blob, b"other")
    with pytest.raises(ValueError):
        tokenfile.Shard(b"nonsense" * 10, b"")


def test_reading_shards_drops_the_encoder():
    storage.held("token file", "some path", lambda: "an encoder")
    list(tokenfile._reading(SimpleNamespace(value=b""))(iter([])))
    assert storage._held["name"] == ("token shards", None) and storage._held["value"] is None


def test_old_state_goes_before_new_state_is_made(monkeypatch):
    storage.held("one", None, lambda: "old")
    seen = []
    monkeypatch.setattr(storage, "_trim", lambda: seen.append(dict(storage._held)))
    assert storage.held("two", None, lambda: seen.append("made") or "new") == "new"
    assert seen == [{}, "made", {"value": "new", "name": ("two", None)}]
