"""Decontamination, near-duplicates and nearest vectors against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from cases import TEXTS, awkward, frame, prose, same, word
from pyspark.sql import functions as F

from tableinsight.llm import catalog, decontaminate, near_dup, vector_index
from tableinsight.llm.components import components

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def passages(docs, items, size=10):
    windows = defaultdict(set)
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            windows[tuple(w[i : i + size])].add(item)
    out = []
    for doc_id, text, *_ in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if (own := windows.get(tuple(w[i : i + n]))) is not None:
                    hit.update(range(i, i + n))
                    found |= {str(x) for x in own if x is not None}
        out.append((doc_id, len(w), len(hit), len(found), sorted(found), bool(hit)))
    return sorted(out, key=repr)


def contaminated():
    rng = random.Random(2)
    items = [(i, prose(rng.choice([14, 30, 60]))) for i in range(30)]
    items += [(30, items[0][1]), (31, None), (32, "..."), (33, "lone pair"), (None, prose(12)), (34, items[1][1]),
              (35, "a b " * 12), (9, prose(11))]
    docs = awkward()
    for i in range(60):
        w = prose(rng.randint(5, 90)).split(" ")
        for _ in range(rng.randint(0, 3)):
            source = words(items[rng.randrange(len(items))][1])
            at = rng.randint(0, max(0, len(source) - 12))
            cut = [x.upper() for x in source[at : at + rng.choice([4, 9, 10, 25])]]
            place = rng.randint(0, len(w))
            w[place:place] = cut
        docs.append((300 + i, ", ".join(w), "xx", "s", 1))
    docs += [(500, "A b a B a b " * 6, "", "", 1), (501, " ".join(t for _, t in items if t), "", "", 1)]
    return docs, items


@pytest.mark.parametrize(("options", "clash"), [({}, True), ({"block_chars": 700}, False), ({"size": 3}, False)])
def test_passages_match_brute_force(spark, options, clash, monkeypatch):
    docs, items = contaminated()
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("n_words", F.lit("clash"))
    found = decontaminate.contamination(frame(spark, docs, clash), bench, **options).drop("spans").collect()
    got = sorted(((r[0], r[1], r[2], r[3], list(r[4]), r[5]) for r in found), key=repr)
    assert got == passages(docs, items, options.get("size", 10))


def test_cut_documents_hold_no_passage(spark):
    docs, items = contaminated()
    items = [x for x in items if len(words(x[1])) >= 10]
    bench = spark.createDataFrame(items, "item_id long, text string")
    before = frame(spark, docs, clash=True)
    after = decontaminate.cut_passages(before, bench)
    assert after.columns == before.columns and dict(after.dtypes) == dict(before.dtypes)
    left = [(r.doc_id, r.text) for r in after.collect()]
    assert len(left) == len(docs)
    clean = {repr(r[0]) for r in passages(docs, items) if not r[5]}
    untouched = Counter((i, t) for i, t, *_ in docs if repr(i) in clean)
    assert not untouched - Counter(left)
    assert sum(r[2] for r in passages(left, items)) == 0


def test_empty_benchmark_and_documents(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    docs = frame(spark, awkward())
    assert not any(r.contaminated for r in decontaminate.contamination(docs, bench).collect())
    full = spark.createDataFrame([(1, prose(20))], "item_id long, text string")
    assert decontaminate.contamination(frame(spark, []), full).count() == 0


def test_index_ranks_searches_and_locates():
    rng = np.random.default_rng(3)
    runs = [rng.integers(1, 6, rng.integers(1, 40)) for _ in range(60)] + [np.full(300, 2)]
    text = np.concatenate([np.append(r, 0) for r in runs])
    index = decontaminate.FmIndex(text, 5, sample=7)
    phrases = rng.integers(1, 6, (50, 4))
    lengths = rng.integers(1, 5, 50)
    low, high = index.search(phrases, lengths)
    for p, n, a, b in zip(phrases, lengths, low, high, strict=True):
        want = [i for i in range(len(text) - n + 1) if (text[i : i + n] == p[4 - n :]).all()]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def shingle_labels(text):
    w, seen, out = words(text), Counter(), []
    for i in range(max(1, len(w) - 4) if w else 0):
        s = tuple(w[i : i + 5])
        out.append((s, seen[s]))
        seen[s] += 1
    return out


def alignment(a, b):
    """Longest common subsequence of labels by the full table, over all labels of both."""
    row = np.zeros(len(b) + 1, dtype=int)
    for x in a:
        fresh = row.copy()
        for j, y in enumerate(b):
            fresh[j + 1] = row[j] + 1 if x == y else max(fresh[j], row[j + 1])
        row = fresh
    return row[-1] / (len(a) + len(b) - row[-1])


def edited(text, changes, rng):
    w = text.split()
    for _ in range(changes):
        i = rng.randrange(len(w))
        kind = rng.random()
        if kind < 0.4:
            w[i] = word()
        elif kind < 0.7:
            w.insert(i, word())
        else:
            del w[i]
    return " ".join(w)


def test_similarity_is_the_alignment():
    rng = random.Random(4)
    for _ in range(60):
        base = prose(60).replace("\n", " ")
        a, b = shingle_labels(base), shingle_labels(edited(base, rng.randint(0, 3), rng))
        names = {}
        packed = [np.array([names.setdefault(x, len(names)) for x in s], dtype="<u4") for s in (a, b)]
        full = alignment(a, b)
        found = near_dup.in_order(*packed, 0.8)
        assert (found >= 0.8 - 1e-9) == (full >= 0.8 - 1e-9)
        if full >= 0.8:
            assert abs(found - full) < 1e-9


def near_rows():
    rng = random.Random(6)
    docs = awkward()
    n = 1000
    for _ in range(25):
        base = prose(rng.randint(60, 160))
        for copy in range(rng.randint(1, 4)):
            docs.append((n, base if copy == 1 else edited(base, copy, rng), "xx", "s", 1))
            n += 1
    chain = prose(150)  # each step is near to the last, the ends are not near to each other
    for _ in range(7):
        docs.append((n, chain, "xx", "s", 1))
        chain = edited(chain, 2, rng)
        n += 1
    hot = prose(100)
    for i in range(150):
        docs.append((n + i, f"{word()} {hot}" if i % 2 else hot.upper(), "xx", "s", 1))
    return docs


def near_classes(docs):
    keys = []
    for doc_id, text, *_ in docs:
        w = words(text)
        keys.append(("w", *w) if w else ("n", doc_id) if text is None else ("t", text))
    nodes = list(dict.fromkeys(keys))
    parent = {k: k for k in nodes}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    labels = {k: shingle_labels(" ".join(k[1:])) for k in nodes if k[0] == "w"}
    held, common = defaultdict(list), Counter()
    for k, own in labels.items():
        for s in own:
            for other in held[s]:
                common[other, k] += 1
            held[s].append(k)
    n_links = Counter()
    for (a, b), n in common.items():
        x, y = labels[a], labels[b]
        if n / (len(x) + len(y) - n) < 0.8 - 1e-9:
            continue
        names = {}
        p, q = (np.array([names.setdefault(s, len(names)) for s in z], dtype="<u4") for z in (x, y))
        if near_dup.in_order(p, q, 0.8) >= 0.8 - 1e-9:
            parent[find(a)] = find(b)
            n_links[a] += 1
    members = defaultdict(list)
    for (doc_id, *_), k in zip(docs, keys, strict=True):
        members[find(k)].append(doc_id)
    return sorted((sorted(m, key=repr) for m in members.values()), key=lambda m: [repr(v) for v in m])


@pytest.mark.parametrize("clash", [False, True])
def test_near_classes_match_brute_force(spark, clash):
    docs = near_rows()
    found = near_dup.near_duplicates(frame(spark, docs, clash)).collect()
    classes = defaultdict(list)
    for r in found:
        classes[bytes(r.class_key)].append(r.doc_id)
        assert r.class_id is None or r.doc_id is None or r.class_id <= r.doc_id
    key = lambda x: [repr(v) for v in x]
    assert sorted((sorted(m, key=repr) for m in classes.values()), key=key) == near_classes(docs)
    for r in found:
        assert r.n_class == len(classes[bytes(r.class_key)])


def test_one_of_each_class_stays(spark):
    docs = near_rows()
    left = near_dup.one_of_each(frame(spark, docs, clash=True))
    rows = left.collect()
    assert len(rows) == len(near_classes(docs))
    kept = Counter(r.doc_id for r in rows)
    for members in near_classes(docs):
        named = [m for m in members if m is not None]
        assert kept[min(named) if named else None] >= 1
    assert near_dup.one_of_each(frame(spark, [])).count() == 0
    assert same(near_dup.near_duplicates(frame(spark, docs)), near_dup.near_duplicates(frame(spark, docs)))


def test_components_of_chains_and_stars(spark):
    rng = random.Random(7)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 300)] + [(500, 500)]
    names = list(range(600))
    rng.shuffle(names)
    rows = spark.createDataFrame([(names[a], names[b]) for a, b in links], "a long, b long")
    roots = {r.node: r.root for r in components(rows).collect()}
    assert {roots[names[i]] for i in range(61)} == {min(names[:61])}
    assert {roots[names[100 + i]] for i in range(300)} == {min(names[100:400])}
    assert len(roots) == 361


def exact_nearest(rows, k=20):
    good = [(i, np.array(v, dtype=float)) for i, v in rows
            if i is not None and v and len(v) == 8 and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    out = {}
    for q, v in good:
        if q % 20 == 0:
            scores = sorted((-float((v * w).sum()), i) for i, w in good if i != q)
            out[q] = [(i, -s) for s, i in scores[:k]]
    return out


def vector_rows(n=900):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(12, 8))
    rows = [(i, (centres[i % 12] + 0.4 * rng.normal(size=8)).astype(np.float32).tolist()) for i in range(n)]
    rows += [(n + i, rows[40][1]) for i in range(400)]  # a third is one vector
    bad = [None, [], [0.0] * 8, [1.0] * 7 + [None], [1.0] * 7 + [float("nan")], [float("inf")] * 8, [1.0, 2.0]]
    return rows + [(20_000 + 20 * i, v) for i, v in enumerate(bad)] + [(None, rows[0][1])]


def test_vectors_are_found(spark):
    rows = vector_rows()
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns(
        {c: F.lit("clash") for c in ("v", "i", "j", "rank", "score", "pack", "label")}
    )
    found = defaultdict(list)
    for r in vector_index.search(vectors, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        found[r.query_id].append((r.vec_id, r.score))
        assert r["rank"] == len(found[r.query_id])
    exact = exact_nearest(rows)
    assert set(found) == set(exact)
    recall = []
    values = dict(rows)
    for q, near in exact.items():
        recall.append(len({i for i, _ in near} & {i for i, _ in found[q]}) / len(near))
        for i, s in found[q]:
            assert s == float((np.array(values[q], float) * np.array(values[i], float)).sum())
        assert found[q] == sorted(found[q], key=lambda x: (-x[1], x[0]))
    assert np.mean(recall) >= 0.9
    assert found[40][0] == exact[40][0]


@pytest.mark.parametrize("kind", ["lengths", "clusters", "clusters and lengths"])
def test_largest_inner_products_whatever_the_lengths(spark, kind):
    """Lengths that vary by factors, few tight clusters, both: the nearest are those of largest product."""
    rng = np.random.default_rng(12)
    v = rng.normal(size=(2000, 32))
    if "clusters" in kind:
        v = rng.normal(size=(15, 32))[rng.integers(0, 15, 2000)] + 0.2 * v
    v /= np.linalg.norm(v, axis=1)[:, None]
    if "lengths" in kind:
        v *= rng.lognormal(sigma=1.0, size=2000)[:, None]
    vectors = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    found = defaultdict(set)
    for r in vector_index.search(vectors, F.col("vec_id") % 20 == 0).collect():
        found[r.query_id].add(r.vec_id)
    recall = []
    for q in range(0, 2000, 20):
        scores = v @ v[q]
        scores[q] = -np.inf
        recall.append(len(found[q] & set(np.argsort(-scores)[:20].tolist())) / 20)
    assert np.mean(recall) >= 0.9


def test_few_and_no_vectors(spark):
    kind = "vec_id long, embedding array<float>"
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (20, [0.0, 1.0])], kind)
    found = [tuple(r) for r in vector_index.search(few, F.col("vec_id") % 20 == 0, share=1.0).collect()]
    assert sorted(found) == [(0, 1, 1, 0.5), (0, 2, 20, 0.0), (20, 1, 1, 0.5), (20, 2, 0, 0.0)]
    assert vector_index.search(spark.createDataFrame([], kind), F.lit(True)).count() == 0
    assert vector_index.search(spark.createDataFrame([(0, [1.0])], kind), F.lit(True)).count() == 0


def test_cells_come_by_distance():
    rng = np.random.default_rng(9)
    d1, d2 = rng.random(9), rng.random(7)
    cells = vector_index.visit(d1, d2, [1.0] * 63, 63)
    sums = [d1[c // 7] + d2[c % 7] for c in cells]
    assert sorted(cells) == list(range(63)) and sums == sorted(sums)


def test_queries_over_whole_tables(spark):
    sf = "/root/testdata/sf0.001"
    bench = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    found = catalog.queries()["op9_decontaminate"](spark, sf).collect()
    digest = lambda items: hashlib.sha256(",".join(items).encode()).hexdigest()
    assert sorted(tuple(r) for r in found) == sorted(
        (*r[:4], digest(r[4]), r[5]) for r in passages(docs, bench)
    )
    near = catalog.queries()["op5_near_dup"](spark, sf)
    assert near.count() == len(docs)
    assert near.filter("kept").count() == len(near_classes(docs))
    assert TEXTS
