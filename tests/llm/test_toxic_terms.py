"""Rare but certain terms beside thousands of stronger ones."""

import random

from cases import frame

from tableinsight.llm import toxicity


def test_a_rare_term_counts_beside_thousands_of_stronger_ones(spark):
    rng = random.Random(41)
    letters = "abcdefghijklmnopqrstuvwxyz"
    strong = ["".join(rng.choice(letters) for _ in range(9)) for _ in range(700)]
    clean = ["".join(rng.choice(letters) for _ in range(4)) for _ in range(300)]
    filler = lambda: " ".join(rng.sample(clean, 12))
    rows, labels = [], []
    for i in range(1700):
        toxic = i < 700
        own = rng.sample(strong, 40) if i < 680 else ["zwrk"] if toxic else []
        rows.append((i, filler() + " " + " ".join(own) + ".", "xx", "s", 1))
        labels.append((i, int(toxic)))
    model = toxicity.learn(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int"))
    held_out = [(9000, filler() + " zwrk.", "xx", "s", 1), (9001, filler() + ".", "xx", "s", 1)]
    scores = {r.doc_id: r._score for r in toxicity.scored(frame(spark, held_out), model).collect()}
    assert scores[9000] >= toxicity.THRESHOLD > scores[9001]
