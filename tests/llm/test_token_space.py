"""White space that the memo of words must not take, against the plain tokenizer."""

import itertools
import zlib

import numpy as np
import pytest
from cases import frame

from tableinsight.llm import catalog, token_store


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(catalog.tokenizer_path())


def test_other_white_space_is_encoded_whole(tokenizer):
    encode = token_store.Encoder(catalog.tokenizer_path())
    assert encode.apart
    spaces = ["\t", "\r", " ", " ", "\u0085", "\x1c", "\v", "\n", " "]
    texts = ["a\tb\tc\n\n", "a\tb\n\nc", "x\r\ny\n\n 2024", "a b\n\n 2024 c", "a\tb\tc\n\n\n", "\na\tb", "a b ", " a\rb"]
    texts += [f"a{x}b{y}{z} c{x}d" for x, y, z in itertools.product(spaces, repeat=3)]
    for text, ids in zip(texts, encode(texts), strict=True):
        assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_stored_ids_are_those_of_the_unaltered_tokenizer(spark, tokenizer):
    texts = ["<|endoftext|> z", "one<|endoftext|>two words\nthree", "plain words", "<|endoftext|>", "a <|endoftext|> b\n\nc"]
    docs = frame(spark, [(i, t, "xx", "s", 1) for i, t in enumerate(texts)])
    found = token_store.read_tokens(token_store.write_tokens(docs, catalog.tokenizer_path())).collect()
    at = 0
    for r, text in zip(sorted(found), texts, strict=True):
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 0], dtype="<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_words_are_learned_as_places_in_one_array(tokenizer):
    """No array a word: direct words first, then whole lines with their line ends."""
    encode = token_store.Encoder(catalog.tokenizer_path())
    words = [b"\nfirst", b" plain", b" marked,", b" caf\xc3\xa9", b"\n2024.", b"bare", b" x1y", b" Zwei;"]
    ids, at, size = encode._encode(words)
    for word, a, n in zip(words, at, size, strict=True):
        assert ids[a : a + n].tolist() == tokenizer.encode(word.decode(), add_special_tokens=False).ids, word
