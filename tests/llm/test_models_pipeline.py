"""Language and toxicity on held-out documents; the pipeline against its parts."""

import math
import random
import zlib

import numpy as np
import pytest
from cases import SYLLABLES, awkward, frame, same
from pyspark.sql import functions as F

import corpus_pipeline
from tableinsight.llm import catalog, language, toxicity
from tableinsight.llm.common import fold, read, stored

SF = "/root/testdata/sf0.01"


def held(doc_id, folds, which):
    return zlib.crc32(str(doc_id).encode()) % folds == which


def text_of(seed, syllables, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n))


AA, BB = ["ba", "do", "ku", "zi"], ["eln", "ost", "urr", "ég"]


@pytest.fixture(scope="module")
def two_languages(spark):
    rows = [(i, text_of(i, AA if i % 2 else BB, 60), "aa" if i % 2 else "bb", "s", 1) for i in range(80)]
    return language.learn(frame(spark, rows))


def test_language_of_held_out_documents(spark):
    found = catalog.queries()["op1_language"](spark, SF).join(read(spark, SF, "documents"), "doc_id")
    rows = found.collect()
    assert len(rows) == read(spark, SF, "documents").count()
    for r in rows:
        assert r.held_out == held(r.doc_id, 4, 2)
        assert 0 <= r.score <= 1
    out = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == r.lang for r in out) >= 0.95 * len(out)


def test_mixtures_have_their_shares(spark, two_languages):
    rows = [
        (1, text_of(901, AA, 120), None, None, 1),
        (2, text_of(902, AA, 90) + " " + text_of(903, BB, 30), None, None, 1),
        (3, text_of(904, AA, 30) + "\n" + text_of(905, BB, 90), None, None, 1),
    ]
    found = {r.doc_id: r for r in language.identify(frame(spark, rows, clash=True), two_languages).collect()}
    assert [m.lang for m in found[1].mixture] == ["aa"] and found[1].score == 1.0
    for i, (top, share) in {2: ("aa", 0.75), 3: ("bb", 0.75)}.items():
        assert found[i].lang_pred == top and abs(found[i].score - share) < 0.05
        assert math.isclose(sum(m.share for m in found[i].mixture), 1, abs_tol=1e-6)


def test_awkward_texts_have_a_language_or_none(spark, two_languages):
    found = language.identify(frame(spark, awkward(), clash=True), two_languages)
    rows = found.collect()
    assert len(rows) == len(awkward())
    unknown = {r.doc_id for r in rows if r.lang_pred == "und"}
    assert {2, 3, 4, 5} <= unknown and not unknown & {0, 1, 6, 7, 10}
    assert all(r.score == 0 and not r.mixture for r in rows if r.lang_pred == "und")
    assert same(found, language.identify(frame(spark, awkward(), clash=True), two_languages))
    nothing = language.learn(frame(spark, []))
    assert {r.lang_pred for r in language.identify(frame(spark, awkward()), nothing).collect()} == {"und"}
    assert language.identify(frame(spark, []), two_languages).count() == 0


def test_trigram_chances_add_up():
    counts = np.zeros(language.SYMBOLS**3, dtype=np.int64)
    counts[np.random.default_rng(0).integers(0, len(counts), 500)] = 3
    total = np.exp(language.smoothed(counts).astype(float)).reshape(-1, language.SYMBOLS).sum(axis=1)
    assert np.allclose(total, 1, atol=1e-4)


def toxic_rows(n=600):
    rng = random.Random(11)
    rows, labels, bad = [], [], {}
    for i in range(n):
        sentences = [text_of(1000 * i + k, SYLLABLES, 9) for k in range(rng.randint(1, 12))]
        toxic = rng.random() < 0.3
        if toxic:
            at = rng.randrange(len(sentences))
            sentences[at] += " " + rng.choice(["grobian", "Lump", "schurkerei", "schurkisch"]) + " dazu"
            bad[i] = at
        rows.append((i, ". ".join(sentences) + ".", "xx", "s", 1))
        labels.append((i, 1, int(toxic)))
    return rows, labels, bad


def test_toxic_documents_and_sentences(spark):
    rows, labels, bad = toxic_rows()
    docs = frame(spark, rows, clash=True)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.learn(docs.filter(fold(F.col("doc_id"), 3) != 1), marks)
    found = toxicity.scored(docs.select("doc_id", "text"), model).collect()
    out = [r for r in found if held(r.doc_id, 3, 1)]
    assert all(0 <= r._score <= 1 for r in found)
    assert sum((r._score >= 0.7) == (r.doc_id in bad) for r in out) >= 0.95 * len(out)
    hits = [r for r in out if r.doc_id in bad and r._score >= 0.7]
    assert sum(bad[r.doc_id] in r._sentences for r in hits) >= 0.95 * len(hits)
    left = toxicity.reject(docs, model)
    assert left.columns == docs.columns
    assert {r.doc_id for r in left.collect()} == {r.doc_id for r in found if r._score < 0.7}


def test_awkward_texts_have_a_toxicity(spark):
    rows, labels, _ = toxic_rows(120)
    kind = "doc_id long, toxic int"
    marks = [(i, t) for i, _, t in labels] + [(None, 1), (5, None), (7, 1), (7, 0)]
    model = toxicity.learn(frame(spark, rows + awkward(), clash=True), spark.createDataFrame(marks, kind))
    found = toxicity.scored(frame(spark, awkward()), model).collect()
    assert len(found) == len(awkward())
    assert {r._score for r in found if not (r.text or "").strip()} == {model.score({})}
    none = toxicity.learn(frame(spark, rows), spark.createDataFrame([(1, 0)], kind))
    assert {r._score for r in toxicity.scored(frame(spark, rows), none).collect()} == {0.0}
    empty = toxicity.learn(frame(spark, []), spark.createDataFrame([], kind))
    assert toxicity.scored(frame(spark, []), empty).count() == 0


def test_toxicity_query(spark):
    found = catalog.queries()["op8_toxicity"](spark, SF).collect()
    labels = {r.doc_id: r.toxic for r in read(spark, SF, "labels").collect()}
    assert len(found) == read(spark, SF, "documents").count()
    for r in found:
        assert r.held_out == held(r.doc_id, 3, 1) and r.predicted == int(r.score >= 0.7)
    clean = [r for r in found if labels.get(r.doc_id) == 0]
    assert sum(r.predicted for r in clean) <= 0.02 * len(clean)
    toxic = [r for r in found if labels.get(r.doc_id) == 1 and r.held_out]
    assert sum(r.predicted for r in toxic) >= 0.5 * len(toxic)


def test_noisy_or_learns_which_term_it_was():
    rng = np.random.default_rng(12)
    bags = []
    for _ in range(400):
        bag = [[int(x)] for x in rng.integers(1, 6, rng.integers(0, 5))]
        toxic = rng.random() < 0.4
        bags.append((int(toxic), bag + [[0]] if toxic else bag))
    weights, bias, leak = toxicity.fit(bags, 6)
    model = toxicity.Model(np.zeros(6, np.uint64), weights, bias, leak)
    assert model.chances({0: np.array([0])})[0] > 0.7
    assert all(model.chances({0: np.array([k])})[0] < 0.1 for k in range(1, 6))


def test_pipeline_is_its_stages(spark):
    docs = read(spark, SF, "documents")
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stored(stage(spark, docs, SF), name)
        assert docs.columns == names and dict(docs.dtypes) == dict(before.dtypes), name
        ids = {r.doc_id for r in before.select("doc_id").collect()}
        assert {r.doc_id for r in docs.select("doc_id").collect()} <= ids
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    whole = corpus_pipeline.run(spark, SF)
    assert same(last, whole)
    assert last.count() == docs.count()


def test_pipeline_takes_awkward_documents(spark, tmp_path):
    tables = {
        "documents": frame(spark, awkward(), clash=True),
        "labels": spark.createDataFrame([(0, 1), (1, 0), (None, None)], "doc_id long, toxic int"),
        "benchmark": spark.createDataFrame([(1, "one two"), (None, None)], "item_id long, text string"),
    }
    for clash in (True, False):
        folder = tmp_path / str(clash)
        for name, table in tables.items():
            (table if clash else table.limit(0)).write.parquet(f"{folder}/{name}.parquet")
        found = corpus_pipeline.run(spark, str(folder)).collect()
        assert bool(found) == clash
