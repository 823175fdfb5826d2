"""Find licence wording in documents by voting on diagonals.

Method. Templates are word sequences with a label: short phrases, which must stand whole, and longer
notices, which may be quoted with words changed, left out or put in. A task gives the rolling hashes
of every run of k words of a document (k small for phrases, larger for notices), each with its place
and its bytes. Spark joins them all to the template positions that have the same hash, and the words
of a pair that meets are compared, so a collision is no hit. A hit votes for the diagonal document
place minus template place. Votes are counted by diagonal; diagonals of one template at most
``SLACK`` apart, in order, merge to a span, as a word put in or left out moves what follows by one.
A span is verified by the share of its template's runs that it holds, each counted once: all of them
on one diagonal for a phrase, ``COVER`` for a notice. Scores are the largest verified share.

The templates' runs are broadcast if there are at most ``BROADCAST_RUNS``, else both sides are
shuffled by hash. Documents are told apart by id and a digest of their text; rows with both equal
are counted once and repeated at the end, so many copies weigh no more than one. Hits travel without
texts, and what one group holds is bounded by the words of one document.

Defined results. A null or wordless text has no words, no label and score 0. Null ids are kept.
Repeated rows return repeated rows. A document may hold a template many times; its label appears
once. A template of fewer words than k of its kind is an error. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tableinsight.llm import bytetext
from tableinsight.llm.common import in_arrow, stored

PHRASE_RUN, NOTICE_RUN = 2, 3  # words in one rolling hash
SLACK = 4  # words by which neighbouring diagonals of one span may differ
COVER = 0.6
BROADCAST_RUNS = 1 << 20


@dataclass(frozen=True)
class Template:
    label: str
    words: str
    phrase: bool = False

    @property
    def run(self) -> int:
        return PHRASE_RUN if self.phrase else NOTICE_RUN


# The phrases and their labels.
PHRASES = (
    Template("gpl", "gnu general public license", True),
    Template("apache", "apache license", True),
    Template("cc-by", "cc by", True),
    Template("mit", "mit license", True),
)

# Notices as the licences' own texts ask for them or begin.
NOTICES = (
    Template("apache-2.0", "licensed under the apache license version 2 0"),
    Template("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    Template("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    Template("mit-notice", "released under the mit license"),
    Template("mit-notice", "licensed under the mit license"),
    Template("gpl-notice", "this work is licensed under the gnu general public license"),
    Template("gpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license"),
    Template("cc-by-nc", "licensed under cc by nc 4 0"),
    Template("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license"),
    Template("unlicense", "this is free and unencumbered software released into the public domain"),
    Template("proprietary", "all rights reserved no part of this publication may be reproduced"),
)
TEMPLATES = PHRASES + NOTICES

_RUNS = "array<struct<h: bigint, k: int, p: int, a: int, b: int>>"


def runs_of(texts: DataFrame, sizes: tuple[int, ...]) -> DataFrame:
    """``doc_id, data, digest, n_words, runs``: for each size k the hash, place and bytes of every run of k words."""
    kinds = dict(texts.dtypes)
    struct = pa.struct([("h", pa.int64()), ("k", pa.int32()), ("p", pa.int32()), ("a", pa.int32()), ("b", pa.int32())])

    def roll(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("data").cast(pa.large_binary()).view(pa.large_string())
            for texts in bytetext.slices(column):
                yield rolled(batch.slice(texts.first, len(texts)), texts)

    def rolled(batch: pa.RecordBatch, texts: bytetext.Texts) -> pa.RecordBatch:
        words = bytetext.words(texts)
        counts = np.diff(words.bounds)
        n_out = np.zeros(len(texts), dtype=np.int64)
        parts = []
        for k in sizes:
            held = np.maximum(counts - k + 1, 0)
            doc = np.repeat(np.arange(len(texts)), held)
            first = np.cumsum(held) - held
            place = np.arange(int(held.sum())) - first[doc]
            at = words.bounds[:-1][doc] + place
            h = np.zeros(len(at), dtype=np.uint64)
            for j in range(k):
                h = bytetext.mixed(h * np.uint64(3) + words.hashes[at + j]) if j else words.hashes[at]
            start = texts.offsets[:-1][doc]
            parts.append((doc, h, np.full(len(at), k), place, words.starts[at] - start, words.ends[at + k - 1] - start))
            n_out += held
        doc = np.concatenate([p[0] for p in parts])
        order = np.argsort(doc, kind="stable")
        fields = [np.concatenate([p[i] for p in parts])[order] for i in range(1, 6)]
        runs = pa.StructArray.from_arrays(
            [pa.array(fields[0].view(np.int64))] + [pa.array(f.astype(np.int32)) for f in fields[1:]], fields=list(struct)
        )
        ends = np.concatenate(([0], np.cumsum(n_out))).astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("data"), batch.column("digest"), pa.array(counts.astype(np.int64)),
             pa.ListArray.from_arrays(pa.array(ends), runs)],
            names=["doc_id", "data", "digest", "n_words", "runs"],
        )

    data = F.coalesce("text", F.lit("")).cast("binary")
    given = texts.select("doc_id", data.alias("data"), F.sha2(data, 256).alias("digest"))
    return in_arrow(given, roll, f"doc_id {kinds['doc_id']}, data binary, digest string, n_words long, runs {_RUNS}")


def _hashed(words: list[str], k: int) -> list[int]:
    """The rolling hashes of a template, as documents have them."""
    texts = next(bytetext.slices(pa.array([" ".join(words)])))
    h = bytetext.words(texts).hashes
    out = h[: len(h) - k + 1]
    for j in range(1, k):
        out = bytetext.mixed(out * np.uint64(3) + h[j : len(h) - k + 1 + j])
    return out.view(np.int64).tolist()


def template_runs(spark: SparkSession, templates: tuple[Template, ...]) -> DataFrame:
    """``template, t_h, t_p, t_k, t_words``: every run of every template and its place; -1 stands for any document."""
    rows = [(-1, 0, 0, 0, "")]
    for number, t in enumerate(templates):
        words = t.words.split()
        if len(words) < t.run:
            raise ValueError(f"a template needs {t.run} words: {t.words!r}")
        rows += [
            (number, h, at, t.run, " ".join(words[at : at + t.run])) for at, h in enumerate(_hashed(words, t.run))
        ]
    frame = spark.createDataFrame(rows, "template int, t_h long, t_p int, t_k int, t_words string")
    return F.broadcast(frame) if len(rows) <= BROADCAST_RUNS else frame


def _words(data: Column) -> Column:
    """The words of some bytes, joined by one space."""
    lowered = F.translate(data.cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = F.regexp_extract_all(lowered, F.lit(r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"))
    return F.array_join(found, " ")


def hits(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """``doc_id, digest, n_words, template, diagonal, t_p, copies``: template runs found, and one row with
    template -1 for the document itself. ``copies`` counts equal rows."""
    spark = docs.sparkSession
    sizes = tuple(sorted({t.run for t in templates}))
    rolled = runs_of(docs, sizes)
    itself = F.array(F.struct(
        F.lit(0).cast("long").alias("h"), *[F.lit(0).alias(f) for f in "kpab"]
    ))
    runs = rolled.select("doc_id", "data", "digest", "n_words", F.inline(F.concat(itself, "runs")))
    positions = template_runs(spark, templates)
    met = runs.join(positions, (F.col("h") == F.col("t_h")) & (F.col("k") == F.col("t_k")))
    said = F.expr("substring(data, a + 1, b - a)")
    equal = met.filter((F.col("template") < 0) | (_words(said) == F.col("t_words")))
    return equal.groupBy(
        "doc_id", "digest", "n_words", "template", (F.col("p") - F.col("t_p")).alias("diagonal"), "t_p"
    ).agg(F.count("*").alias("copies"))


def spans(found: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """``doc_id, digest, template, first, last, share``: verified spans of words, ``last`` not included."""
    spark = found.sparkSession
    known = F.broadcast(spark.createDataFrame(  # one row a template
        [(i, t.phrase, t.run, len(t.words.split()) - t.run + 1) for i, t in enumerate(templates)],
        "template int, phrase boolean, run int, runs int",
    ))
    place = F.col("diagonal") + F.col("t_p")
    votes = found.filter("template >= 0").groupBy("doc_id", "digest", "template", "diagonal").agg(
        F.collect_set("t_p").alias("held"), F.min(place).alias("low"), F.max(place).alias("high")
    ).join(known, "template")
    line = Window.partitionBy("doc_id", "digest", "template").orderBy("diagonal")
    apart = F.col("diagonal") - F.lag("diagonal").over(line)
    fresh = F.coalesce(F.col("phrase") | (apart > SLACK), F.lit(True)).cast("int")
    merged = votes.withColumn("_fresh", fresh).withColumn("_span", F.sum("_fresh").over(line)).groupBy(
        "doc_id", "digest", "template", "_span", "phrase", "run", "runs"
    ).agg(
        F.array_distinct(F.flatten(F.collect_list("held"))).alias("held"),
        F.min("low").alias("first"), (F.max("high") + F.col("run")).alias("last"),
    )
    share = F.size("held") / F.col("runs")
    whole = F.when(F.col("phrase"), share == 1.0).otherwise(share >= COVER)
    return merged.filter(whole).select("doc_id", "digest", "template", "first", "last", share.alias("share"))


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """``doc_id, n_words, spans, labels, base_labels, n_base, first_word, last_word, score`` of every document.

    ``spans`` has label, first and last word and share of every verified span, in order. The base
    columns are those of the phrases.
    """
    spark = docs.sparkSession
    found = stored(hits(docs, templates), "licence-hits")
    names = F.broadcast(spark.createDataFrame(  # one row a template
        [(i, t.label, t.phrase) for i, t in enumerate(templates)], "template int, label string, phrase boolean"
    ))
    named = spans(found, templates).join(names, "template").select(
        "doc_id", "digest", F.lit(None).cast("long").alias("n_words"), F.lit(None).cast("long").alias("copies"),
        F.struct("first", "last", "label", "phrase", "share").alias("span"),
    )
    empty = F.lit(None).cast(named.schema["span"].dataType)
    own = found.filter("template < 0").select("doc_id", "digest", "n_words", "copies", empty.alias("span"))
    whole = own.unionByName(named).groupBy("doc_id", "digest").agg(
        F.max("n_words").alias("n_words"), F.max("copies").alias("copies"),
        F.sort_array(F.collect_list("span")).alias("spans"),
    )
    base = F.filter("spans", lambda s: s["phrase"])

    def labels(of: Column) -> Column:
        return F.array_sort(F.array_distinct(F.transform(of, lambda s: s["label"])))

    firsts = F.transform(base, lambda s: s["first"].cast("long"))
    shares = F.array_max(F.transform("spans", lambda s: s["share"]))
    out = whole.select(
        "doc_id", "n_words", "spans", labels(F.col("spans")).alias("labels"), labels(base).alias("base_labels"),
        F.size(base).cast("long").alias("n_base"), F.array_min(firsts).alias("first_word"),
        F.array_max(firsts).alias("last_word"), F.coalesce(shares, F.lit(0.0)).alias("score"),
        F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("_copy"),
    )
    return out.drop("_copy")
