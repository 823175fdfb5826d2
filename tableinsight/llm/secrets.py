"""Find secrets: fixed patterns, and windows of high entropy in key-like strings.

Method. Runs of key characters are candidates. A window slides over each candidate; its Shannon
entropy follows from the sum of c log2 c over the character counts, and each step changes only the
counts of the character that enters and the one that leaves. Hexadecimal and base64 strings have
thresholds of their own. An allow-list suppresses candidates that are plain words, paths or known
placeholders; it never touches what the fixed patterns found.

Everything is built-in functions on one row; nothing is shuffled.

Defined results. A null text counts as empty. Repeated rows keep their rows. No rows in, no rows
out. Columns other than doc_id and text are ignored. Positions count code points, ends exclusive.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed patterns of the query: kind, pattern, least length of which group.
ASSIGN = (
    r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
BASE_KINDS = (("assign", ASSIGN, 1, 8), ("access", ACCESS, 0, 16), ("hex", HEX, 0, 32))

WINDOW = 20
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
# Character classes: kind, what the whole candidate looks like, alphabet, bits a character from which
# a window counts. No attainable entropy of a window lies on a threshold.
CLASSES = (
    ("hex_entropy", r"^[0-9A-Fa-f]+$", "0123456789abcdef", 3.05),
    ("key_entropy", r"^", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", 3.85),
)
ALLOWED = (
    r"^[A-Z]?[a-z]+$",  # a word
    r"^[A-Z]+$",
    # Paths, identifiers and rules: words of two letters and more, or one letter before a separator.
    # The group gives nothing back, so a match of any length needs no stack.
    r"^(?:[A-Z]?[a-z]{2,}|[A-Z]{2,}|[A-Za-z](?:[/_=-]|$)|[/_=-])*+$",
    r"^[0-9_=/+-]+$",  # numbers and dates
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"EXAMPLE(?:KEY)?$",  # keys of manuals end so; a path through a folder of examples does not
)
_UNIT = 10**9  # x log2 x as integers: steps add up exactly
_BLOCK = 256


def _xlogx(x: int) -> int:
    return round(_UNIT * x * math.log2(x)) if x > 1 else 0


def _starts(lengths: str) -> str:
    """SQL for the running sum before each element of an array column, in blocks so that the work
    stays near linear in its length."""
    inside = (
        "aggregate(x, named_struct('s', 0L, 'a', cast(array() as array<bigint>)), "
        "(p, v) -> named_struct('s', p.s + v, 'a', concat(p.a, array(p.s))))"
    )
    return (
        f"transform(transform(sequence(0, (size({lengths}) - 1) div {_BLOCK}), "
        f"b -> slice({lengths}, b * {_BLOCK} + 1, {_BLOCK})), x -> {inside})"
    )


def _with_spans(frame: DataFrame, name: str, pattern: str) -> DataFrame:
    """Adds ``name``: array of (start, end, found) of all matches, leftmost and not overlapping.

    The pieces between matches and the matches themselves alternate, so positions are running sums.
    """
    quoted = F.lit(pattern)
    blocks, sums = f"{name}_blocks", f"{name}_sums"
    frame = frame.withColumn(name, F.regexp_extract_all("text", quoted, F.lit(0)))
    pieces = F.when(F.size(name) > 0, F.split("text", pattern, -1)).otherwise(F.array().cast("array<string>"))
    steps = F.zip_with(
        F.slice(pieces, F.lit(1), F.size(name)), F.col(name),
        lambda p, m: F.char_length(p) + F.char_length(m),
    )
    frame = frame.withColumn(f"{name}_steps", F.transform(steps, lambda x: x.cast("bigint")))
    frame = frame.withColumn(blocks, F.expr(_starts(f"{name}_steps")))
    ahead = (
        f"aggregate({blocks}, named_struct('s', 0L, 'a', cast(array() as array<bigint>)), "
        "(p, b) -> named_struct('s', p.s + b.s, 'a', concat(p.a, array(p.s)))).a"
    )
    frame = frame.withColumn(sums, F.expr(ahead))
    frame = frame.withColumn(
        sums, F.expr(f"flatten(transform({blocks}, (b, i) -> transform(b.a, v -> v + {sums}[i])))")
    )
    ends = F.zip_with(F.col(sums), F.col(f"{name}_steps"), lambda a, b: a + b)
    frame = frame.withColumn(
        name,
        F.zip_with(ends, F.col(name), lambda e, m: F.struct(
            (e - F.char_length(m)).alias("start"), e.alias("end"), m.alias("found")
        )),
    )
    return frame.drop(blocks, sums, f"{name}_steps")


def _entropy_span(string: str, alphabet: str, bits: float) -> str:
    """SQL: (from, to) of the windows of an array column of characters that reach the threshold."""
    table = ", ".join(f"{_xlogx(x)}L" for x in range(WINDOW + 1))
    most = math.floor(_UNIT * WINDOW * (math.log2(WINDOW) - bits))
    places = f"transform({string}, c -> locate(c, '{alphabet}') - 1)"
    enter, leave = "z.x[i]", f"if(i >= {WINDOW}, z.x[i - {WINDOW}], -1)"
    grown = (
        f"transform(a.counts, (v, k) -> v + if(k = {enter}, 1, 0) - if(k = {leave}, 1, 0))"
    )
    f = f"array({table})"
    moved = (
        f"a.sum + if({enter} = {leave}, 0L, "
        f"{f}[a.counts[{enter}] + 1] - {f}[a.counts[{enter}]]"
        f" + if(i >= {WINDOW}, {f}[a.counts[{leave}] - 1] - {f}[a.counts[{leave}]], 0L))"
    )
    hit = f"i >= {WINDOW - 1} and ({moved}) <= {most}L"
    return (
        f"transform(array(named_struct('x', {places})), z -> aggregate(sequence(0, size(z.x) - 1), "
        f"named_struct('counts', array_repeat(0, {len(alphabet)}), 'sum', 0L, "
        "'from', cast(null as int), 'to', cast(null as int)), (a, i) -> named_struct("
        f"'counts', {grown}, 'sum', {moved}, "
        f"'from', if({hit}, coalesce(a.from, i - {WINDOW - 1}), a.from), "
        f"'to', if({hit}, i + 1, a.to)), a -> named_struct('from', a.from, 'to', a.to)))[0]"
    )


def _enough(pattern: str, group: int, least: int) -> Callable[[Column], Column]:
    def test(m: Column) -> Column:
        value = F.regexp_extract(m["found"], pattern, group) if group else m["found"]
        return F.char_length(value) >= least

    return test


def _as_spans(found: Column, rank: int, kind: str) -> Column:
    return F.transform(found, lambda m: F.struct(
        m["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), m["end"].alias("end")
    ))


def find_secrets(docs: DataFrame, allowed: Sequence[str] = ALLOWED) -> DataFrame:
    """Per document: doc_id, spans (start, rank, kind, end) in order; ranks under 3 are the fixed patterns."""
    frame = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    kinds: list[Column] = []
    for rank, (kind, pattern, group, least) in enumerate(BASE_KINDS):
        # Runs of hexadecimal digits are everywhere; those of the least length are the same spans.
        scan = pattern[:-1] + "{%d,}" % least if kind == "hex" else pattern
        frame = _with_spans(frame, kind, scan)

        kinds.append(_as_spans(F.filter(F.col(kind), _enough(pattern, group, least)), rank, kind))
    frame = _with_spans(frame, "candidates", CANDIDATE)
    plain = "|".join(f"(?:{p})" for p in allowed)
    if plain:
        frame = frame.withColumn("candidates", F.filter("candidates", lambda m: ~m["found"].rlike(plain)))
    for rank, (kind, looks, alphabet, bits) in enumerate(CLASSES, len(BASE_KINDS)):
        others = [c[1] for c in CLASSES[: rank - len(BASE_KINDS)]]
        mine = f"m.found rlike r'{looks}'" + "".join(f" and not m.found rlike r'{o}'" for o in others)
        low = "lower(m.found)" if alphabet == alphabet.lower() else "m.found"
        letters = f"filter(split({low}, ''), c -> c <> '')"
        found = (
            f"filter(transform(filter(candidates, m -> {mine}), m -> named_struct('at', m.start, 'hit', "
            f"{_entropy_span(letters, alphabet, bits)})), m -> m.hit.from is not null)"
        )
        windows = F.transform(F.expr(found), lambda m: F.struct(
            (m["at"] + m["hit"]["from"]).alias("start"), (m["at"] + m["hit"]["to"]).alias("end")
        ))
        kinds.append(_as_spans(windows, rank, kind))
    return frame.select("doc_id", F.array_sort(F.concat(*kinds)).alias("spans"))


def _is(rank: int) -> Callable[[Column], Column]:
    return lambda r: r == rank


def joined(spans: Column) -> Column:
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))),
        ",",
    )


def digest(found: DataFrame) -> DataFrame:
    """The columns of the query from the spans."""
    base = F.filter("spans", lambda s: s["rank"] < len(BASE_KINDS))
    ranks = F.transform("spans", lambda s: s["rank"])
    counts = [
        F.size(F.filter(ranks, _is(rank))).cast("long").alias(f"n_{kind}")
        for rank, (kind, *_) in enumerate(BASE_KINDS)
    ]
    return found.select(
        "doc_id", *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )
