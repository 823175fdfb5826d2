"""Records of CSV files with line breaks inside quotes, read in blocks of a file.

A quote opens a field at the start of a line or after a delimiter and closes it where it is not
doubled; any other quote is text. So a line takes the state at its start (no field open, or one) to
a state at its end, and lines, blocks and files compose: of each line it is known where it leads
from either state, a block is followed for both, and the few blocks of a file settle which one
holds. Nothing is read from the start of a file to its end, and no file is in one task: lines meet
by block, and only the lines of a record with line breaks meet by record.

Lines end at a line feed; a carriage return before it belongs to the end of the record, or to the
text of an open field. A blank line outside quotes is no record. A field left open at the end of a
file ends there.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

QUOTE = '"'
_BOM = "﻿"


def text_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``path, block, line, value``: lines in order within a block of a file."""
    value = F.when(F.col("value").startswith(_BOM), F.expr("substring(value, 2)")).otherwise(F.col("value"))
    return spark.read.option("lineSep", "\n").text(paths).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"), value.alias("value"),
    )


def filled() -> Column:
    return F.length(F.trim(F.col("value"), F.lit(" \t\r"))) > 0


def _outside(text: Column, starts: str) -> tuple[Column, Column]:
    """A line without its quoted fields, doubled quotes being gone already, and whether one stays open."""
    closed = F.regexp_replace(text, starts + '"[^"]*"', "$1x")
    opened = closed.rlike(starts + '"')
    return F.when(opened, F.regexp_replace(closed, "(?s)" + starts + '".*$', "$1")).otherwise(closed), opened


def with_quotes(lines: DataFrame, delimiters: list[str]) -> DataFrame:
    """Adds where a line leads from either state (``to_closed``, ``to_open``: 1 if a field is open at
    its end) and what of it is outside quotes (``out_closed``, ``out_open``)."""
    starts = "(^|[" + "".join(re.escape(d) for d in delimiters) + "])"
    plain = ~F.col("value").contains(QUOTE)
    single = F.replace("value", F.lit(QUOTE * 2), F.lit(""))
    out_closed, opened = _outside(single, starts)
    inside = ~single.contains(QUOTE)  # nothing closes the open field
    out_open, reopened = _outside(F.regexp_replace(single, '^[^"]*"', "x"), starts)
    return lines.withColumns({
        "to_closed": F.when(plain, 0).otherwise(opened.cast("int")),
        "to_open": F.when(plain | inside, 1).otherwise(reopened.cast("int")),
        "out_closed": F.when(plain, F.col("value")).otherwise(out_closed),
        "out_open": F.when(plain | inside, F.lit("")).otherwise(out_open),
    })


def _followed(rows: DataFrame, *order: str) -> DataFrame:
    """Adds ``after_closed`` and ``after_open``: the state after each row of its group from either state before
    the group. A row either keeps the state, turns it, or sets it whatever it was."""
    line = Window.partitionBy(*order[:-1]).orderBy(order[-1])
    sets = F.col("to_closed") == F.col("to_open")
    turns = ((F.col("to_closed") == 1) & (F.col("to_open") == 0)).cast("int")
    counted = rows.withColumn("_turns", F.sum(turns).over(line)).withColumn(
        "_set", F.last(F.when(sets, F.struct(F.col("to_closed").alias("v"), F.col("_turns").alias("t"))), True).over(line)
    )
    known = (F.col("_set.v") + F.col("_turns") - F.col("_set.t")) % 2
    return counted.withColumns({
        f"after_{name}": F.coalesce(known, (F.lit(start) + F.col("_turns")) % 2).cast("int")
        for name, start in (("closed", 0), ("open", 1))
    }).drop("_turns", "_set")


def block_states(lines: DataFrame) -> DataFrame:
    """``path, block, start, ahead, ends, open_at_end``: state at the start of each block, records
    that end before and in it, state at its end. A row a block, from narrow rows a line."""
    narrow = lines.select("path", "block", "line", "to_closed", "to_open", filled().alias("filled"))
    followed = _followed(narrow, "path", "block", "line")
    blocks = followed.groupBy("path", "block").agg(
        F.count_if(F.col("filled") & (F.col("after_closed") == 0)).alias("ends_closed"),
        F.count_if(F.col("filled") & (F.col("after_open") == 0)).alias("ends_open"),
        F.max_by("after_closed", "line").alias("to_closed"), F.max_by("after_open", "line").alias("to_open"),
    )
    settled = _followed(blocks, "path", "block")  # a file starts closed
    order = Window.partitionBy("path").orderBy("block")
    start = F.coalesce(F.lag("after_closed").over(order), F.lit(0))
    ends = F.when(F.col("start") == 1, F.col("ends_open")).otherwise(F.col("ends_closed"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    return settled.withColumn("start", start).withColumn("ends", ends).select(
        "path", "block", "start", F.coalesce(F.sum("ends").over(before), F.lit(0)).alias("ahead"),
        "ends", F.col("after_closed").alias("open_at_end"),
    )


def record_counts(lines: DataFrame) -> DataFrame:
    """``path, n``: records of each file, the header among them."""
    last = F.max_by("open_at_end", "block")
    return block_states(lines).groupBy("path").agg((F.sum("ends") + last).alias("n"))


def in_records(lines: DataFrame) -> DataFrame:
    """The lines that are part of a record, with ``record`` (its number in the file, from 0), ``open`` (a
    field is open at the start of the line) and ``closes`` (none is at its end)."""
    placed = lines.join(block_states(lines).select("path", "block", "start", "ahead"), ["path", "block"])
    followed = _followed(placed, "path", "block", "line")
    after = F.when(F.col("start") == 1, F.col("after_open")).otherwise(F.col("after_closed"))
    order = Window.partitionBy("path", "block").orderBy("line")
    ends = (filled() & (F.col("after") == 0)).cast("int")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    return followed.withColumn("after", after).select(
        *lines.columns,
        (F.col("ahead") + F.coalesce(F.sum(ends).over(before), F.lit(0))).alias("record"),
        (F.coalesce(F.lag("after").over(order), F.col("start")) == 1).alias("open"), (F.col("after") == 0).alias("closes"),
    ).filter(F.col("open") | filled())


def _joined(order: str) -> Column:
    parts = F.sort_array(F.collect_list(F.struct(order, "value")))
    return F.array_join(F.transform(parts, lambda p: p["value"]), "\n").alias("text")


def within_blocks(lines: DataFrame) -> DataFrame:
    """``path, block, record, text, whole``: what a block holds of each record, put together where the
    lines of the block are. Only what is not whole moves once more, to meet by record."""
    whole = F.bool_or(~F.col("open")) & F.bool_or("closes")
    return lines.groupBy("path", "block", "record").agg(_joined("line"), whole.alias("whole"))


def records(spark: SparkSession, paths: list[str], delimiters: list[str], encoding: str = "UTF-8") -> DataFrame:
    """``path, record, text``: each record whole, line breaks in fields as they are in the file."""
    lines = in_records(with_quotes(text_lines(spark, paths), delimiters)).select(
        "path", "block", "line", "record", "open", "closes",
        (F.col("value") if encoding == "UTF-8" else F.decode(F.col("value").cast("binary"), encoding)).alias("value"),
    )
    within = within_blocks(lines)
    across = within.filter(~F.col("whole")).withColumnRenamed("text", "value").groupBy("path", "record").agg(_joined("block"))
    text = F.when(F.col("text").endswith("\r"), F.expr("substring(text, 1, length(text) - 1)")).otherwise(F.col("text"))
    return within.filter("whole").select("path", "record", "text").unionByName(across).withColumn("text", text)
