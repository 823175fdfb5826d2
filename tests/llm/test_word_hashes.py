"""Words that simple hashes confuse are told apart: equal bytes, not equal sums."""

import zlib

import numpy as np
import pyarrow as pa
from cases import frame, prose

from tableinsight.llm import bytetext, catalog, near_dup, token_store


def thue_morse(n: int) -> tuple[str, str]:
    """A word over a and b, and its complement: sums of powers modulo 2^64 agree on long ones."""
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_hashes_differ():
    for n in (32, 512, 1024, 2048, 4096):
        texts = next(bytetext.slices(pa.array(thue_morse(n))))
        found = bytetext.words(texts)
        assert found.hashes[0] != found.hashes[1]
        first, second = bytetext.exact_hashes(texts.data, found.starts, found.ends)
        assert first[0] != first[1] and second[0] != second[1]
    same = bytetext.words(next(bytetext.slices(pa.array(["x" * 100, "X" * 100, "y" * 100])))).hashes
    assert same[0] == same[1] != same[2]


def test_tokens_and_classes_of_such_words(spark):
    from tokenizers import Tokenizer

    one, other = thue_morse(2048)
    tail = prose(60)
    docs = [(0, f"{one} {tail}", "xx", "s", 0), (1, f"{other} {tail}", "xx", "s", 0), (2, one, "xx", "s", 0), (3, other, "xx", "s", 0)]
    tokenizer = Tokenizer.from_file(catalog.tokenizer_path())
    blocks = token_store.write_tokens(frame(spark, docs), catalog.tokenizer_path())
    for r in token_store.read_tokens(blocks).collect():
        ids = np.array([*tokenizer.encode(docs[r.doc_id][1], add_special_tokens=False).ids, 0], dtype="<u4")
        assert (r.n_tokens, r.ids_crc32) == (len(ids), zlib.crc32(ids.tobytes()))
    keys = {r.doc_id: bytes(r.key) for r in near_dup.near_duplicates(frame(spark, docs)).collect()}
    assert len(set(keys.values())) == 4


def test_words_that_share_a_hash_are_encoded_whole(monkeypatch):
    """No hash is trusted: where two words meet in one, texts go to the tokenizer as they are."""
    encoder = token_store.Encoder(catalog.tokenizer_path(), marks_are_text=False)
    texts = ["alpha beta gamma", "alpha beta\ngamma delta", "omega beta"]
    expected = [encoder._ids(t).tolist() for t in texts]

    def short(data, starts, ends):
        sizes = (ends - starts).astype(np.uint64)
        return sizes, data[starts].astype(np.uint64) * np.uint64(1000) + data[ends - 1]

    monkeypatch.setattr(bytetext, "exact_hashes", short)
    for _ in range(2):
        assert [ids.tolist() for ids in encoder(texts)] == expected
