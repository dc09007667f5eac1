import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from textloom.llm import bpe, codec


@pytest.fixture(scope="module")
def vocabulary(tokenizer_path):
    return bpe.Vocabulary(tokenizer_path)


@pytest.fixture(scope="module")
def library(tokenizer_path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path)


def ids_of(library, text):
    return np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_lookahead_bounds_every_change(vocabulary):
    """Tokens that end further from a prefix's end than the look-ahead stay, whatever follows."""
    rng = random.Random(5)
    parts = [t for t in vocabulary.ids if t.isalpha()]
    for _ in range(60):
        text = b"".join(rng.choice(parts) for _ in range(200))
        cut = rng.randrange(len(text) // 2, len(text))
        whole, prefix = vocabulary.merge(text), vocabulary.merge(text[:cut])
        ends = lambda ids: set(np.cumsum([len(vocabulary.bytes_of[i]) for i in ids]).tolist())
        stable = cut - vocabulary.lookahead
        assert {e for e in ends(prefix) if e <= stable} == {e for e in ends(whole) if e <= stable}


@pytest.mark.parametrize("fast", [False, True])
def test_encoder_equals_library(vocabulary, library, fast):
    encoder = bpe.StreamingEncoder(vocabulary, bpe.fast_merge(vocabulary) if fast else None)
    rng = random.Random(1)
    alphabet = "abc  \n\t'streé中̀²½1290_-!?\U0001f600\x1c\x85\xa0٠Ⅳ"
    texts = ["", " ", "  ", "a" * 9000, " " * 5000 + "x", "ab" * 4000, "'" * 2500, "<|endoftext|>", "x<|endoftext|> y  <|endoftext|>", "don't we'll I'd", " " + "a" * 20_000 + " " + "b" * 20_000]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(80))) for _ in range(400)]
    for text in texts:
        assert b"".join(encoder.encode(text)) == ids_of(library, text), text[:50]


def test_small_blocks_equal_library(vocabulary, library, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK_CHARS", 40)
    monkeypatch.setattr(bpe, "BLOCK_BYTES", 64)
    encoder = bpe.StreamingEncoder(vocabulary)
    rng = random.Random(2)
    parts = [t.decode() for t in vocabulary.ids if t.isalpha() and t.isascii()]
    for text in ["".join(rng.choice(parts) for _ in range(300)) for _ in range(20)] + ["some words, and  more\n\n of them. " * 20]:
        assert b"".join(encoder.encode(text)) == ids_of(library, text)


@pytest.mark.parametrize("run", ["a", "ab1", "é", "中", "!", " ", "\n", "\x1c", "7", "'", " \u2003"])
def test_runs_without_a_break_take_constant_memory(vocabulary, library, monkeypatch, run):
    """Chunks stay small however long the run is, and the ids are those of the whole."""
    monkeypatch.setattr(bpe, "BLOCK_CHARS", 500)
    monkeypatch.setattr(bpe, "BLOCK_BYTES", 256)
    encoder = bpe.StreamingEncoder(vocabulary, bpe.fast_merge(vocabulary))
    for before, after in (("", ""), ("x ", " y"), ("'s", "'ll z"), ("\n", "\n\n"), ("1 ", "2")):
        text = before + run * (20_000 // len(run)) + after
        chunks = list(encoder.encode(text))
        assert b"".join(chunks) == ids_of(library, text)
        assert max(map(len, chunks)) < 4 * 4000


@settings(max_examples=100, deadline=None)
@given(text=st.text(alphabet=st.sampled_from("aé中1 \n\t'!\x1c\xa0s"), max_size=400))
def test_any_run_in_small_blocks(vocabulary, library, text):
    chars, size = bpe.BLOCK_CHARS, bpe.BLOCK_BYTES
    bpe.BLOCK_CHARS, bpe.BLOCK_BYTES = 4, 330
    try:
        assert b"".join(bpe.StreamingEncoder(vocabulary).encode(text)) == ids_of(library, text)
    finally:
        bpe.BLOCK_CHARS, bpe.BLOCK_BYTES = chars, size


@settings(max_examples=100, deadline=None)
@given(text=st.text(max_size=60))
def test_round_trip(vocabulary, library, text):
    encoder, decoder = bpe.StreamingEncoder(vocabulary), bpe.StreamingDecoder(vocabulary)
    ids = np.frombuffer(b"".join(encoder.encode(text)), "<u4").tolist()
    assert ids == library.encode(text, add_special_tokens=False).ids
    assert "".join(decoder.push([i]) for i in ids) + decoder.end() == text


def test_decoder_replaces_broken_characters(vocabulary, library):
    ids = [vocabulary.single[0xE4], vocabulary.single[0xB8], vocabulary.ids[b"a"], vocabulary.single[0xC3]]
    decoder = bpe.StreamingDecoder(vocabulary)
    assert decoder.push(ids) + decoder.end() == library.decode(ids, skip_special_tokens=False)


def test_codec(documents, library, tokenizer_path):
    rows = [(1, None, "a"), (2, "", "a"), (3, "two words", "b"), (3, "two words", "b"), (None, "x", None), (4, "long " * 20_000, "c")]
    out = {r.doc_id: r for r in codec.encode_and_decode(documents(rows), tokenizer_path).collect()}
    assert out[1].n_tokens == out[2].n_tokens == 0
    for i, t in ((3, "two words"), (4, "long " * 20_000), (None, "x")):
        raw = ids_of(library, t)
        assert (out[i].n_tokens, out[i].ids_sha256, out[i].decoded_sha256) == (len(raw) // 4, hashlib.sha256(raw).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    assert codec.encode_and_decode(documents([]), tokenizer_path).count() == 0
    ids = codec.encode(documents(rows[:3]), tokenizer_path).orderBy("doc_id").collect()
    assert ids[0].token_ids is None and ids[1].token_ids == [] and ids[2].token_ids == library.encode("two words").ids
