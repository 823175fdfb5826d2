"""Token store by exact round trip; line dedup against brute force."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from cases import awkward, frame, prose, same

from tableinsight.llm import bytetext, catalog, line_runs, token_store


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(catalog.tokenizer_path())
    found.encode_special_tokens = True
    return found


def expected_tokens(tokenizer, rows):
    out, at = [], 0
    for doc_id, text in sorted(((r[0], r[1] or "") for r in rows), key=lambda r: (r[0] is not None, r)):
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 0], dtype="<u4")
        out.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


@pytest.mark.parametrize("clash", [False, True])
def test_tokens_come_back_as_encoded(spark, tokenizer, clash):
    rows = awkward()
    blocks = token_store.write_tokens(frame(spark, rows, clash), catalog.tokenizer_path(), block_tokens=5000)
    found = [tuple(r) for r in token_store.read_tokens(blocks).collect()]
    assert sorted(found, key=lambda r: r[1]) == expected_tokens(tokenizer, rows)


def test_one_token_is_read_without_the_rest(spark, tokenizer):
    rows = awkward()
    blocks = token_store.write_tokens(frame(spark, rows), catalog.tokenizer_path(), block_tokens=3000).cache()
    shard = blocks.agg({"shard": "min"}).first()[0]
    text = sorted(((r[0], r[1] or "") for r in rows), key=lambda r: (r[0] is not None, r))
    ids = [i for _, t in text for i in [*tokenizer.encode(t, add_special_tokens=False).ids, 0]]
    size = blocks.filter(blocks.shard == shard).selectExpr("sum(element_at(ends, -1))").first()[0]
    for at in (0, 1, 77, size - 1):
        assert token_store.token_at(blocks, shard, at) == ids[at]
    assert token_store.token_at(blocks, shard, size) is None


def test_no_documents(spark):
    docs = frame(spark, [])
    assert token_store.read_tokens(token_store.write_tokens(docs, catalog.tokenizer_path())).count() == 0
    assert line_runs.dedup_lines(docs).count() == 0


def test_codes_of_every_width():
    ids = np.array([0, 1, 255, 256, 65535, 65536, 2**24, 2**32 - 1, 7] * 40, dtype=np.uint32)
    coded = token_store.Coded.of(ids)
    places = np.random.default_rng(1).permutation(len(ids))
    assert (coded.read(places) == ids[places]).all()
    assert len(coded.levels) == 4


def test_encoder_forgets_and_goes_on(monkeypatch, tokenizer):
    monkeypatch.setattr(token_store, "MEMO_WORDS", 30)
    encode = token_store.Encoder(catalog.tokenizer_path())
    assert encode.apart and encode.direct
    texts = [prose(50) for _ in range(5)] + ["a  b", "\n", "x \n y", "<|endoftext|> z", "it's, don't!", ""]
    for text, ids in zip(texts, encode(texts), strict=True):
        assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def expected_lines(rows, least_docs=3, least_chars=20):
    space = line_runs.SPACE

    def key(line):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(space))

    holders = defaultdict(list)
    for n, (doc_id, text, *_) in enumerate(rows):
        for k in {key(x) for x in (text or "").split("\n")}:
            if len(k) >= least_chars:
                holders[k].append((doc_id is not None, doc_id, n))
    out = []
    for doc_id, text, *_ in rows:
        lines = (text or "").split("\n")
        kept = []
        for x in lines:
            own = holders.get(key(x), [])
            if len(own) < least_docs or max((o[:2] for o in own), key=lambda o: (o[0], o[1] or 0))[1] == doc_id:
                kept.append(x)
        digest = hashlib.sha256("\n".join(kept).encode()).hexdigest()
        out.append((doc_id, len(lines), len(lines) - len(kept), digest))
    return sorted(out, key=repr)


def line_rows(n=40):
    common = ["This line is in many documents, more or less.", "another line that comes again and again",
              "short", "Ébène and ÀÉÎ stay as they are, long enough"]
    rows = awkward()
    for i in range(n):
        lines = [prose(9).replace("\n", " "), common[i % 4], "\t" + common[(i + 1) % 4].upper() + " \r", ""]
        rows.append((100 + i, "\n".join(lines), "xx", "s", 1))
    return rows


@pytest.mark.parametrize(("batches", "fanout", "clash"), [(1, 2, False), (5, 2, True), (4, 3, False)])
def test_lines_match_brute_force(spark, batches, fanout, clash):
    rows = line_rows()
    found = line_runs.dedup_lines(frame(spark, rows, clash), batches=batches, fanout=fanout).collect()
    got = [(r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256(r.kept.encode()).hexdigest()) for r in found]
    assert sorted(got, key=repr) == expected_lines(rows)


def test_runs_mark_keys_seen_before_and_compact(spark):
    runs = line_runs.LineRuns(fanout=2)
    first = runs.add(spark.createDataFrame([(b"a", 1, 9), (b"b", 2, 8)], "key binary, n long, owner long"))
    second = runs.add(spark.createDataFrame([(b"b", 1, 5), (b"c", 1, 4)], "key binary, n long, owner long"))
    assert {bytes(r.key): r.first for r in first.collect()} == {b"a": True, b"b": True}
    assert {bytes(r.key): r.first for r in second.collect()} == {b"b": False, b"c": True}
    assert [len(x) for x in runs.levels] == [0, 1]
    merged = {bytes(r.key): (r.n, r.owner) for r in runs.merged().collect()}
    assert merged == {b"a": (1, 9), b"b": (3, 8), b"c": (1, 4)}


def test_reruns_agree(spark):
    docs = frame(spark, line_rows())
    assert same(line_runs.dedup_lines(docs), line_runs.dedup_lines(docs))


def test_word_hashes_follow_the_words():
    import pyarrow as pa

    texts = ["Abc, déf abc", None, "", "x" * 50 + " y", "ÀB àb"]
    (part,) = bytetext.slices(pa.array(texts))
    found = bytetext.words(part)
    assert found.bounds.tolist() == [0, 3, 3, 3, 5, 7]
    assert found.hashes[0] == found.hashes[2] != found.hashes[1]
    assert found.hashes[5] != found.hashes[6]
    assert [p.first for p in bytetext.slices(pa.array(texts), most=10)] == [0, 1, 3, 4]
