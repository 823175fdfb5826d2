"""Awkward documents every operator must take: nulls, empty and long texts, repeats, clashing names."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

_random = random.Random(5)
SYLLABLES = ["ka", "lo", "mi", "ren", "tus", "vae", "ü", "nor", "shi", "é"]


def word() -> str:
    return "".join(_random.choice(SYLLABLES) for _ in range(_random.randint(1, 4)))


def prose(words: int, per_line: int = 12) -> str:
    out = [word() for _ in range(words)]
    return "\n".join(" ".join(out[i : i + per_line]) + "." for i in range(0, words, per_line))


LONG = prose(30_000)
TEXTS = [
    prose(80), prose(200), "", None, "...!!!", " \t\n ", LONG, "one", "Ünïcode \U0001f600 text\n\n\nend ",
    "  two  spaces\n \nand\ttabs ", prose(6),
]


def awkward() -> list[tuple]:
    rows = [(i, t, "xx" if i % 2 else "yy", f"s{i % 3}", len(t or "")) for i, t in enumerate(TEXTS)]
    rows += [rows[0], rows[0], rows[3], (50, TEXTS[0], None, None, 1), (51, TEXTS[1], "xx", None, None)]
    rows += [(None, TEXTS[1], "yy", "s1", 3), (None, None, None, None, None), (None, "", "xx", "s2", 0)]
    return rows


def frame(spark: SparkSession, rows: list[tuple], clash: bool = False) -> DataFrame:
    docs = spark.createDataFrame(rows, SCHEMA)
    if clash:
        names = ["size", "target", "score", "key", "start", "shard", "kept", "spans", "rank", "_text",
                 "_id", "_key", "_score", "_spans", "_row", "_n", "class_id", "toxic", "held_out", "taken"]
        docs = docs.withColumns({n: F.lit(f"clash-{n}") for n in names})
    return docs


def same(left: DataFrame, right: DataFrame) -> bool:
    order = sorted(left.columns)
    key = lambda r: repr(r)
    return sorted(map(tuple, left.select(order).collect()), key=key) == sorted(
        map(tuple, right.select(order).collect()), key=key
    )
