"""Mix sources to target weights: seats for equal blocks of words by Sainte-Lague quotients.

Method. The words of all documents form ``B`` blocks of equal size. Sources receive blocks by the
highest quotients target / (2k + 1). Each source is dealt over seeded shards, and its blocks are
apportioned again over them by shard size, so every shard has an integer quota. Inside a shard the
documents stand in a seeded order and the quota takes whole passes, then the leading blocks.

Defined results. A null or blank text has size 0 and is never taken. A null source is a source of
its own and comes last. Rows that repeat a doc_id are documents of their own; if also their sizes
agree they are interchangeable. No rows in, no rows out; if all sizes are 0, targets are 0.
Columns other than doc_id, text and source are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tableinsight.llm.common import packed, stored, unpacked, with_length

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
CAP = 3
BLOCK_WORDS = 64
LEAST_BLOCKS_PER_SOURCE = 256
SHARD_WORDS = 1 << 20
MOST_SHARDS = 1 << 16  # per source: the windows over shards stay bounded
SEED = 20


def seeded(*parts: Column) -> Column:
    """A hexadecimal digest of the seed and the values, for a reproducible shuffle."""
    return F.md5(F.concat_ws("|", F.lit(str(SEED)), *[p.cast("string") for p in parts]).cast("binary"))


def apportion(parties: DataFrame, group: str, party: str, votes: str, seats: str) -> DataFrame:
    """Adds integer ``quota``: the seats of each group by Sainte-Lague, ties to the smaller party.

    The final divisor lies between V / (N + n/2) and V / (N - n/2) for n parties, N seats and V
    votes. What the larger divisor grants is settled; only the few quotients between the two are
    ranked, about four per party, instead of one per seat.
    """
    in_group = W.partitionBy(group)
    total, n = F.sum(votes).over(in_group), F.count(F.lit(1)).over(in_group)
    low = F.when(total > 0, F.col(votes) * (F.col(seats) - n / 2) / total).otherwise(0.0)
    high = F.when(total > 0, F.col(votes) * (F.col(seats) + n / 2) / total).otherwise(0.0)
    bounds = parties.select(
        group, party, votes, seats,
        F.greatest(F.floor(low + 0.5) - 1, F.lit(0)).cast("long").alias("settled"),
        (F.floor(high + 0.5) + 1).cast("long").alias("most"),
    )
    open_seats = F.col(seats) - F.sum("settled").over(in_group)
    quotient = F.col(votes) / (2 * F.col("k") + 1)
    by_rank = W.partitionBy(group).orderBy(F.desc("quotient"), F.asc(party), F.asc("k"))
    won = (
        bounds.withColumn("open", open_seats)
        .withColumn("k", F.explode(F.sequence("settled", F.greatest("settled", "most"))))
        .filter(F.col(votes) > 0)
        .withColumn("quotient", quotient)
        .withColumn("place", F.row_number().over(by_rank))
        .filter(F.col("place") <= F.col("open"))
        .groupBy(group, party)
        .agg(F.count(F.lit(1)).alias("won"))
    )
    return (
        bounds.join(won, [group, party], "left")
        .select(group, party, votes, (F.col("settled") + F.coalesce("won", F.lit(0))).alias("quota"))
    )


def source_targets(per_source: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """Targets of (source, source_size) rows: shares by weight, none above ``cap`` sizes.

    Capping and resharing ends at one water level: sorted by cap / weight, the first source whose
    cap reaches the level of those not yet capped fixes it. All windows are over one row per source.
    """
    ordered = W.orderBy(F.col("source").asc_nulls_last())
    turn = F.array(*[F.lit(w) for w in weights])
    rows = per_source.withColumn("sid", F.row_number().over(ordered)).withColumn(
        "weight", F.element_at(turn, ((F.col("sid") - 1) % len(weights) + 1).cast("int"))
    ).withColumn("most", F.col("source_size") * cap)
    by_ratio = W.orderBy(F.col("most") / F.col("weight"), "sid")
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy()
    level = (
        F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0))
    ) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    rows = rows.withColumn("level", level)
    holds = F.col("most") / F.col("weight") >= F.col("level")
    final = F.min(F.when(holds, F.struct(F.col("most") / F.col("weight"), "sid", "level"))).over(everything)
    share = F.coalesce(final["level"], F.lit(0.0)) * F.col("weight")
    return rows.select(
        "sid", "source", "source_size",
        F.least(F.col("most").cast("double"), share).alias("target"),
    )


def mix(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    cap: int = CAP,
    block_words: int = BLOCK_WORDS,
    shard_words: int = SHARD_WORDS,
) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, passes (whole copies the mix takes),
    part (leading words of one more copy) and taken = passes * size + part."""
    sized = stored(
        docs.select(
            "doc_id", F.col("source").cast("string").alias("source"),
            F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        ),
        "mix-sizes",
    )
    everything = W.partitionBy()
    targets = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, cap)
    words, sources = F.sum("source_size").over(everything), F.count(F.lit(1)).over(everything)
    blocks = F.least(
        words, F.greatest(F.ceil(words / block_words), LEAST_BLOCKS_PER_SOURCE * sources)
    ).cast("long")
    planned = stored(
        targets.withColumn("blocks", blocks)
        .withColumn("block", F.coalesce(words / F.nullif("blocks", F.lit(0)), F.lit(0.0)))
        .withColumn("all", F.lit(0)),
        "mix-sources",
    )
    seats = apportion(planned, "all", "sid", "target", "blocks").select("sid", F.col("quota").alias("seats"))
    shards_of = F.greatest(
        F.lit(1), F.least(F.ceil(F.col("source_size") / shard_words), F.lit(MOST_SHARDS))
    )
    sources_plan = stored(
        planned.join(seats, "sid").withColumn("shards", shards_of.cast("long")), "mix-seats"
    )
    draw = F.conv(F.substring(seeded(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 8), 16, 10)
    placed = sized.withColumnRenamed("source", "own_source").join(
        sources_plan, F.col("own_source").eqNullSafe(F.col("source"))
    ).withColumn("shard", draw.cast("long") % F.col("shards"))
    per_shard = placed.groupBy("sid", "shard", "seats", "block").agg(F.sum("size").alias("shard_size"))
    quotas = apportion(per_shard, "sid", "shard", "shard_size", "seats").join(
        sources_plan.select("sid", "block"), "sid"
    )
    wanted = F.least(F.round(F.col("quota") * F.col("block")).cast("long"), F.col("shard_size") * cap)
    passes = F.when(F.col("shard_size") > 0, F.expr("wanted div shard_size")).otherwise(F.lit(0))
    quotas = stored(
        quotas.withColumn("wanted", wanted).withColumn("passes", passes.cast("long")).select(
            "sid", "shard", "passes",
            (F.col("wanted") - F.col("passes") * F.col("shard_size")).alias("rest"),
        ),
        "mix-quotas",
    )
    seeded_order = W.partitionBy("sid", "shard").orderBy(
        seeded(F.lit("order"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), "doc_id", "size"
    ).rowsBetween(W.unboundedPreceding, -1)
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("ahead")))
    return (
        placed.withColumn("ahead", F.coalesce(F.sum("size").over(seeded_order), F.lit(0)))
        .join(quotas, ["sid", "shard"])
        .withColumn("part", part)
        .select(
            "doc_id", "source", "size", "source_size", "target", "passes", "part",
            (F.col("passes") * F.col("size") + F.col("part")).alias("taken"),
        )
    )


def mixed_documents(docs: DataFrame, **options: object) -> DataFrame:
    """The mix as documents: each row as often as whole passes take it, and once more cut to its
    leading words where a pass ends in it. ``n_chars``, where there is one, follows a cut text.

    Documents meet their plan by id, source and size; rows that agree in all three are numbered.
    """
    keys = ["_id", "_source", "_size"]

    def keyed(frame: DataFrame, size: Column, number: str, *order: str) -> DataFrame:
        frame = frame.withColumns({
            "_id": F.coalesce(F.col("doc_id").cast("string"), F.lit("none")),
            "_source": F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("none")),
            "_size": size,
        })
        return frame.withColumn(number, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))

    plan = keyed(mix(docs, **options), F.col("size"), "_m", "passes", "part")
    plan = plan.filter("taken > 0").select(*keys, "_m", F.col("passes").alias("_passes"), F.col("part").alias("_part"))
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    pieces = F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))
    whole = F.array_repeat(F.col("text"), F.col("_passes").cast("int"))
    cut = F.when(
        F.col("_part") > 0,
        F.array(F.array_join(F.slice(pieces, F.lit(1), F.col("_part").cast("int")), "")),
    ).otherwise(F.array().cast("array<string>"))
    rows = packed(docs, "doc_id", "text", "source")
    taken = keyed(rows, size, "_n", "text").join(plan, keys).filter(F.col("_n") - F.col("_m") == 0)
    taken = taken.withColumn("_copy", F.explode(F.concat(whole, cut)))
    changed = F.col("_copy") != F.col("text")
    own = {"text": F.col("_copy"), "doc_id": F.col("doc_id"), "source": F.col("source")}
    return unpacked(taken, docs, own | with_length(docs, changed, F.col("_copy")))
