"""Text jobs: packing paragraphs into chunks and finding JSON in prose."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableinsight.functions.parsing import has_text, stripped
from tableinsight.names import col

# Chunk size, fence pattern and the fields asked for in answers.
MAX_CHUNK_CHARS = 700
FENCED_JSON = r"(?s)```(?:json)?\s*(\{.*?\})\s*```"
FRAMING_SCHEMA = (
    "metric_definition string, business_question string, comparison_period string, "
    "assumptions array<string>"
)
RECOMMENDATIONS_SCHEMA = (
    "recommendations array<struct<title: string, description: string, impact: string, "
    "feasibility: string, timeline: string>>"
)

_BRACES = r"(?s)\{.*\}"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _doublings(n: Column) -> Column:
    """1, 2, 4 and so on up to n."""
    return F.transform(F.sequence(F.lit(0), F.floor(F.log2(n)).cast("int")), lambda k: F.pow(F.lit(2), k).cast("int"))


def _prefix_sums(values: Column, steps: Column) -> Column:
    """0 and the sums of the first 1, 2, ... values, by adding what lies 1, 2, 4, ... places before."""
    def add(sums: Column, step: Column) -> Column:
        return F.transform(sums, lambda v, i: v + F.coalesce(F.get(sums, i - step), F.lit(0)))

    return F.aggregate(steps, F.concat(F.array(F.lit(0)), values), add)


def _chunk_starts(sums: Column, steps: Column, max_chars: int) -> Column:
    """Numbers of the paragraphs that begin a chunk.

    For every paragraph a search in the sums finds where the next chunk begins if one begins there.
    These jumps, taken 1, 2, 4, ... at a time, lead from the first paragraph to all that begin one.
    """
    n = F.size(sums) - 1

    def following(v: Column, i: Column) -> Column:
        last = F.aggregate(
            F.reverse(steps), i,
            lambda at, step: F.when(F.get(sums, at + step) <= v + max_chars, at + step).otherwise(at),
        )
        return F.least(n, F.greatest(i + 1, last))

    def twice(state: Column, step: Column) -> Column:
        jump = state["jump"]
        further = F.filter(F.transform(state["starts"], lambda i: F.get(jump, i)), lambda i: i < n)
        on = F.struct(
            F.concat(state["starts"], further).alias("starts"), F.transform(jump, lambda i: F.get(jump, i)).alias("jump")
        )
        return F.when(F.get(jump, F.lit(0)) < n, on).otherwise(state)  # the last jumps led to the end

    first = F.struct(F.array(F.lit(0)).alias("starts"), F.transform(sums, following).alias("jump"))
    return F.aggregate(steps, first, twice, lambda s: s["starts"])


def chunk_array(text: Column, max_chars: int = MAX_CHUNK_CHARS) -> Column:
    """Whole paragraphs packed greedily up to ``max_chars`` (line breaks not counted).

    A longer paragraph is a chunk of its own; text without any paragraph is one empty chunk. The
    work is n log n in the number of paragraphs: each is cut out of the text once.
    """
    def pack(paragraphs: Column) -> Column:
        lengths = F.transform(paragraphs, lambda p: F.length(p))
        return _let(_doublings(F.size(paragraphs)), lambda steps: _let(
            _prefix_sums(lengths, steps), lambda sums: _let(
                _chunk_starts(sums, steps, max_chars), lambda starts: F.transform(starts, lambda s, k: F.array_join(
                    F.slice(paragraphs, s + 1, F.coalesce(F.get(starts, k + 1), F.size(paragraphs)) - s), "\n"
                ))
            )
        ))

    def chunks(paragraphs: Column) -> Column:
        all_fit = F.length(F.array_join(paragraphs, "")) <= max_chars
        return F.when(all_fit, F.array(F.array_join(paragraphs, "\n"))).otherwise(pack(paragraphs))

    return _let(F.filter(F.split(text, "\n"), has_text), chunks)


def chunk_text(df: DataFrame, key: str, text: str, max_chars: int = MAX_CHUNK_CHARS) -> DataFrame:
    """``(key, chunk_no, chunk)`` for every document; no shuffle, any document length."""
    chunks = F.posexplode(chunk_array(col(text), max_chars)).alias("chunk_no", "chunk")
    return df.where(col(text).isNotNull()).select(col(key), chunks)


def extract_json(df: DataFrame, text: str, schema: str) -> DataFrame:
    """Add ``strategy`` (fenced, whole, braces or none), the JSON text ``raw`` and ``parsed``.

    Each candidate is parsed once, and only if those before it failed; the fields come from that
    parse. The parser overlooks what follows a value, so a candidate stands in a list before its own
    digest: if that is not the second entry, the text was not one value.
    """

    def accepted(strategy: str, candidate: Column) -> Column:
        listed = F.concat(F.lit("["), candidate, F.lit(',"'), F.md5(candidate), F.lit('"]'))
        return _let(F.try_parse_json(listed), lambda value: F.when(
            F.try_variant_get(value, "$[1]", "string") == F.md5(candidate),
            F.struct(F.lit(strategy).alias("strategy"), candidate.alias("raw"), value.alias("value")),
        ))

    whole = F.col("__whole")
    fenced = F.nullif(F.regexp_extract(whole, FENCED_JSON, 1), F.lit(""))
    braces = F.nullif(F.regexp_extract(whole, _BRACES, 0), F.lit(""))
    chosen = F.coalesce(accepted("fenced", fenced), accepted("whole", whole), accepted("braces", braces))
    return (
        df.withColumn("__whole", stripped(col(text)))
        .withColumn("__chosen", chosen)
        .withColumns({
            "strategy": F.coalesce("__chosen.strategy", F.lit("none")),
            "raw": F.col("__chosen.raw"),
            "parsed": F.try_variant_get("__chosen.value", "$[0]", f"struct<{schema}>"),
        })
        .drop("__chosen", "__whole")
    )


def parse_rate(extracted: DataFrame) -> DataFrame:
    """Answers per strategy."""
    return extracted.groupBy("strategy").agg(F.count(F.lit(1)).alias("n"))
