"""Classes of large groups around a hub or a shared passage against brute force."""

import random
from collections import defaultdict
from pathlib import Path

from cases import frame
from test_passages_vectors import near_classes

from tableinsight.llm import components, near_dup
from tableinsight.llm.common import scratch


def some_words(n, rng):
    return ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(n)]


def found_classes(spark, docs):
    classes = defaultdict(list)
    for r in near_dup.near_duplicates(frame(spark, docs)).collect():
        classes[bytes(r.class_key)].append(r.doc_id)
    return sorted((sorted(m, key=repr) for m in classes.values()), key=lambda m: [repr(v) for v in m])


def test_copies_around_a_hub_are_one_class(spark):
    rng = random.Random(31)
    base = some_words(200, rng)
    docs = [(0, " ".join(base), "xx", "s", 1)]
    for i in range(1, 150):
        copy = list(base)
        for at in rng.sample(range(10, 190, 10), 3):
            copy[at] = some_words(1, rng)[0]
        docs.append((i, " ".join(copy), "xx", "s", 1))
    expected = near_classes(docs)
    assert len(expected) == 1
    assert found_classes(spark, docs) == expected


def test_pairs_within_a_shared_passage_are_all_found(spark):
    rng = random.Random(32)
    passage, docs = some_words(60, rng), []
    for i in range(700):
        own = some_words(36, rng)
        twin = list(own)
        for at in (7, 20):  # ten of 92 shingles are other ones: 82 / 102
            twin[at] = some_words(1, rng)[0]
        docs += [(2 * i + k, " ".join(passage + w), "xx", "s", 1) for k, w in enumerate((own, twin))]
    # Two of different pairs share the passage and no more: 56 / 128.
    assert found_classes(spark, docs) == sorted(
        ([2 * i, 2 * i + 1] for i in range(700)), key=lambda m: [repr(v) for v in m]
    )


def test_no_pair_of_a_large_bucket_is_lost(spark, monkeypatch):
    """One tuple of one label, which most take from a shared passage, and no longer tuples."""
    rng = random.Random(33)
    passage, docs = some_words(200, rng), []
    for i in range(40):
        own = some_words(36, rng)
        for k in range(3):
            twin = list(own)
            for at in ((7, 20), (13, 29), (3, 24))[k]:
                twin[at] = some_words(1, rng)[0]
            docs.append((3 * i + k, " ".join(passage + twin), "xx", "s", 1))
    monkeypatch.setattr(near_dup, "LEVELS", ())
    classes = defaultdict(list)
    for r in near_dup.near_duplicates(frame(spark, docs), sketches=1, least=1).collect():
        classes[r.class_id].append(r.doc_id)
    assert all(len({d // 3 for d in m}) == 1 for m in classes.values())
    assert sum(len(m) == 3 for m in classes.values()) > 20  # the others share no tuple


def test_a_large_group_around_the_similarity_is_as_by_brute_force(spark):
    rng = random.Random(34)
    base, docs = some_words(100, rng), []
    for i in range(160):
        copy = list(base)
        for at in rng.sample(range(3, 97), 3):
            copy[at] = some_words(1, rng)[0]
        docs.append((i, " ".join(copy), "xx", "s", 1))
    assert found_classes(spark, docs) == near_classes(docs)


def test_only_what_the_result_reads_stays_on_disk(spark):
    rng = random.Random(35)
    base, docs = some_words(100, rng), []
    for i in range(30):
        copy = list(base)
        copy[3 * i] = some_words(1, rng)[0]
        docs.append((i, " ".join(copy), "xx", "s", 1))
    with scratch(spark) as written:
        found = near_dup.near_duplicates(frame(spark, docs))
        left = sorted(Path(p).name.rsplit("-", 1)[0] for p in written if Path(p).exists())
        assert left == ["near-sketches", "near-state"]
        assert {r.class_id for r in found.collect()} == {0}


def test_components_across_small_forests(spark, monkeypatch):
    """Whatever a task joins beforehand, nothing is lost between tasks."""
    monkeypatch.setattr(components, "FOREST_EDGES", 3)
    chain = [(i, i + 1) for i in range(40)] + [(200 - i, 200) for i in range(1, 40)] + [(7, 7), (300, 300)]
    random.Random(36).shuffle(chain)
    rows = spark.createDataFrame(chain, "a long, b long").repartition(9)
    roots = {r.node: r.root for r in components.components(rows).collect()}
    assert roots == {i: 0 for i in range(41)} | {i: 161 for i in range(161, 201)}


def test_rounds_take_few_shuffles(spark):
    """A stage that reads a shuffle has as many tasks as partitions, however small its tables are."""
    rng = random.Random(37)
    base, docs = some_words(100, rng), []
    for i in range(120):
        copy = list(base)
        for at in rng.sample(range(3, 97), 3):
            copy[at] = some_words(1, rng)[0]
        docs.append((i, " ".join(copy), "xx", "s", 1))
    held = {"spark.sql.shuffle.partitions": "50", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    context = spark.sparkContext
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        context.setJobGroup("near-rounds", "near-rounds")
        assert found_classes(spark, docs) == near_classes(docs)
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    told = context.statusTracker()
    stages = {s for job in told.getJobIdsForGroup("near-rounds") for s in told.getJobInfo(job).stageIds}
    ran = [info for s in stages if (info := told.getStageInfo(s)) and info.numCompletedTasks]
    assert len(ran) <= 115  # 144 with state, sizes and distinct pairs shuffled apart
