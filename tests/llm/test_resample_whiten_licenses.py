"""Importance resampling, whitening and licence scans against brute force and on awkward input."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from cases import awkward, frame, prose

from tableinsight.llm import importance, licenses, whitening

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(LOWER))


# Importance resampling


def runs(text: str | None) -> list[int]:
    w = words(text)
    return [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def expected_draw(docs: list[tuple], target: list[str | None], percent: int) -> list[tuple]:
    s, t = Counter(), Counter()
    for d in docs:
        s.update(runs(d[1]))
    for text in target:
        t.update(runs(text))
    n_s, n_t = s.total() + 10_000, t.total() + 10_000
    gain = [math.floor(1000 * math.log((t[b] + 1) * n_s / ((s[b] + 1) * n_t))) for b in range(10_000)]
    rows = []
    for d in docs:
        found = runs(d[1])
        h = int(hashlib.sha256(f"42:{'' if d[0] is None else d[0]}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in found)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append((d[0], len(words(d[1])), len(found), weight, score))
    fit = [r for r in rows if r[1] >= 20]
    fit.sort(key=lambda r: (-r[4], r[0] is None, r[0], r[2]))
    k = percent * len(fit) // 100
    rank = [(*r, i + 1 if i < k else None) for i, r in enumerate(fit)]
    return sorted(rank + [(*r, None) for r in rows if r[1] < 20], key=repr)


@pytest.mark.parametrize("percent", [5, 50, 100])
def test_resampling_matches_brute_force(spark, percent):
    docs = awkward() + [(100 + i, prose(15 + i % 9), "xx", "s", 1) for i in range(60)]
    target = [prose(40), None, "", docs[0][1]]
    benchmark = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    found = importance.resample(frame(spark, docs, clash=True), benchmark, percent=percent)
    assert sorted(map(tuple, found.collect()), key=repr) == expected_draw(docs, target, percent)


def test_resampling_of_nothing(spark):
    empty = frame(spark, [])
    assert importance.resample(empty, empty).collect() == []
    docs = frame(spark, [(1, prose(30), None, None, 0)])
    assert importance.resample(docs, empty, percent=100).first()["rank"] == 1


def test_windows_end_between_words():
    text = (prose(300) + " " + "x" * 5000 + " " + "\t\n.,;" * 90 + "Ünd END").encode()
    for most in (1, 7, 64, 1 << 20):
        parts = list(importance.windows(text, most))
        assert [w.decode() for p in parts for w in p] == words(text.decode())
        places = [b for _, found in importance._buckets(text, 3, 10_000, most) for b in found]
        assert Counter(places) == Counter(runs(text.decode()))


def test_likely_documents_are_drawn(spark):
    random.seed(3)
    alike = [" ".join(random.choice(["red", "green", "blue"]) for _ in range(40)) for _ in range(20)]
    other = [prose(40) for _ in range(180)]
    docs = frame(spark, [(i, t, None, None, 0) for i, t in enumerate(alike + other)])
    target = frame(spark, [(0, "red green blue " * 5000, None, None, 0)])
    ranked = importance.resample(docs, target, percent=10)
    ids = {r.doc_id for r in importance.drawn(docs, ranked).collect()}
    assert ids == set(range(20))


# Whitening


def vectors(spark, rows, kind="float"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, n string, component string")


def expected_white(rows: list[tuple], k: int = 16):
    x = np.floor(64 * np.array([r[1] for r in rows], dtype=np.float64)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    centred = fit - s / n
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1][:k], v[:, ::-1][:, :k]
    return n, (x - s / n) @ v / np.sqrt(e), ((n * x - s) ** 2).sum(axis=1), e / (centred**2).sum() * n


@pytest.mark.parametrize("bands", [1, 1 << 16])
def test_whitening_matches_numpy(spark, monkeypatch, bands):
    monkeypatch.setattr(whitening, "BLOCK_BYTES", 8 * 24 * 20)  # several blocks, and bands of one
    rng = np.random.default_rng(1)
    data = (rng.standard_normal((150, 24)) * np.linspace(1, 3, 24)).astype(np.float32)
    rows = [(i, v.tolist(), "c", "c") for i, v in enumerate(data)] + [(500 + i, data[7].tolist(), "c", "c") for i in range(40)]
    bad = [(900, None, "", ""), (901, [None] * 24, "", ""), (902, [float("nan")] * 24, "", ""),
           (903, [float("inf")] * 24, "", ""), (904, [1.0] * 3, "", ""), (905, [], "", ""), (906, [3e38] * 24, "", "")]
    found = whitening.whiten(vectors(spark, rows + bad), band_blocks=bands).toPandas()
    n, white, deviation, explained = expected_white(rows)
    found = found.sort_values(["vec_id", "component"])
    assert found.vec_id.tolist() == [r[0] for r in rows for _ in range(16)]
    assert (found.n == n).all() and n == 150
    assert found.deviation.tolist() == np.repeat(deviation, 16).tolist()
    got = found.whitened.to_numpy().reshape(-1, 16)
    assert np.abs(got * np.sign((got * white).sum(axis=0)) - white).max() < 1e-9
    assert np.allclose(found.explained.to_numpy()[:16], explained, rtol=1e-9)
    assert found.identity_error.nunique() == 1 and found.identity_error.iloc[0] < 1e-9


def test_whitening_of_little(spark):
    assert whitening.whiten(vectors(spark, [])).collect() == []
    assert whitening.whiten(vectors(spark, [(1, [1.0, 2.0], "", ""), (2, [1.0, 2.0], "", "")])).collect() == []
    found = whitening.whiten(vectors(spark, [(1, [1.0, 2.0], "", ""), (None, [3.0, 2.0], "", "")])).collect()
    assert {(r.vec_id, r.component, abs(round(r.whitened, 9))) for r in found} == {(1, 1, 1.0), (None, 1, 1.0)}
    assert all(r.explained == pytest.approx(1.0) for r in found)


def test_a_deviation_beyond_a_long_is_null():
    assert whitening._squares(np.array([[1, 2], [3, 4]])) == [5, 25]
    assert whitening._squares(np.array([[1 << 31, 1 << 31], [1 << 32, 0], [3, 4]])) == [None, None, 25]
    assert whitening._squares(np.array([[3037000499, 0]])) == [3037000499**2]


# Licences


def expected_base(text: str | None):
    w, places = words(text), []
    for t in licenses.PHRASES:
        p = t.words.split()
        places += [(i, t.label) for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
    at = [i for i, _ in places]
    return len(w), len(at), min(at, default=None), max(at, default=None), sorted({label for _, label in places})


LICENCE_TEXTS = [
    "Under the MIT License.", "mit-License MIT\nLICENSE mit license", "GNU General Public", "gnu General. Public, License",
    "Licensed under CC BY-NC 4.0.", "acc by", "cc byx", "the Apache  License", "permit license " * 30, "cc by " * 700,
]


def test_base_phrases_match_brute_force(spark):
    docs = awkward() + [(200 + i, t, None, None, 0) for i, t in enumerate(LICENCE_TEXTS)]
    docs += [(300, prose(25_000) + " mit license " + prose(25_000) + " CC-BY", None, None, 0), docs[-1], docs[-1]]
    found = licenses.scan(frame(spark, docs, clash=True)).collect()
    got = [(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in found]
    assert sorted(got, key=repr) == sorted([(d[0], *expected_base(d[1])) for d in docs], key=repr)
    assert all(set(r.base_labels) <= set(r.labels) and 0 <= r.score <= 1 for r in found)


def test_changed_notices_are_found_and_prose_is_not(spark):
    notice = next(t for t in licenses.NOTICES if t.label == "bsd").words.split()
    random.seed(9)
    texts = {"whole": notice, "put in": notice[:8] + ["really"] + notice[8:], "left out": notice[:10] + notice[12:],
             "changed": [*notice[:6], "other", *notice[7:]], "torn": notice[:5], "shuffled": random.sample(notice, len(notice))}
    docs = [(i, f"{prose(50)} {' '.join(t).title()} {prose(50)}", None, None, 0) for i, t in enumerate(texts.values())]
    found = {r.doc_id: r for r in licenses.scan(frame(spark, docs)).collect()}
    labels = [found[i].labels for i in range(len(texts))]
    assert labels == [["bsd"]] * 4 + [[]] * 2
    assert found[0].score == 1.0 and 0.6 <= found[1].score < 1.0
    span = found[0].spans[0]
    before = words(docs[0][1])
    assert before[span["first"] : span["last"]] == notice


def test_collisions_of_hashes_are_no_hits(spark, monkeypatch):
    true, docs = licenses._hashed, frame(spark, [(1, "Tim esnecil, mit license", None, None, 0)])
    template = (licenses.Template("a", "mit license", True),)
    assert licenses.scan(docs, template).first().n_base == 1
    monkeypatch.setattr(licenses, "_hashed", lambda words, k: true(["tim", "esnecil"], k))
    assert licenses.scan(docs, template).first().n_base == 0  # met by hash, but the words differ


def test_licences_of_nothing(spark):
    assert licenses.scan(frame(spark, [])).collect() == []
    with pytest.raises(ValueError, match="words"):
        licenses.template_runs(spark, (licenses.Template("a", "one", True),))
