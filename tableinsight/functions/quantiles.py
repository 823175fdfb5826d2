"""Exact quantiles of many columns without bringing a column to one task.

A mergeable sketch brackets each wanted rank; rows are then counted against the bracket, which
shrinks geometrically until the values left inside are few enough to rank directly. Every round
is one column-pruned scan that returns a few numbers per column. The sketch only proposes
brackets: exact counts decide, so its error never reaches the result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIRECT_VALUES = 1_000_000
_GRID = 128
_SKETCH_SIZE = 1000
_UNDER = float("-inf")


@dataclass(frozen=True)
class Bracket:
    """Values lo..hi of one column, thought to hold the 0-based ``rank``."""

    column: int
    rank: int
    lo: float
    hi: float
    rows: float
    outer_lo: float
    outer_hi: float


def as_doubles(values: list[Column]) -> list[Column]:
    """The values as doubles named ``c0``, ``c1`` …; NaN counts as missing."""
    doubles = [v.cast("double") for v in values]
    return [F.when(~F.isnan(v), v).alias(f"c{i}") for i, v in enumerate(doubles)]


def grid_of(value: Column) -> Column:
    """Sketched quantiles at equal steps; NULL when there are no values."""
    steps = F.array(*[F.lit(i / _GRID) for i in range(_GRID + 1)])
    sketch = F.kll_sketch_agg_double(value, F.lit(_SKETCH_SIZE))
    return F.when(F.count(value) > 0, F.kll_sketch_get_quantile_double(sketch, steps))


def wanted_ranks(n: int, p: float) -> tuple[int, int, float]:
    """Ranks on both sides of the linear-interpolation position, and the weight of the upper one."""
    position = p * (n - 1)
    low = math.floor(position)
    return low, min(low + 1, n - 1), position - low


def _bracket(column, rank, offset, inside, grid, lo, hi) -> Bracket:
    cell = int((rank - offset) / max(inside - 1, 1) * _GRID)
    left, right = cell - 1, cell + 2
    new_lo = lo if left <= 0 else max(lo, grid[left])
    new_hi = hi if right >= _GRID else min(hi, grid[right])
    return Bracket(column, rank, new_lo, new_hi, inside * 3 / _GRID, lo, hi)


def _narrow(values: DataFrame, brackets: list[Bracket], found: dict) -> list[Bracket]:
    """One counting scan: settle the ranks that sit on a bracket end, narrow the others."""
    spans = list(dict.fromkeys((b.column, b.lo, b.hi) for b in brackets))
    counts = []
    for i, (c, lo, hi) in enumerate(spans):
        v = F.col(f"c{c}")
        between = (v > lo) & (v < hi)
        counts += [
            F.count_if(v < lo).alias(f"below{i}"),
            F.count_if(v == lo).alias(f"at_lo{i}"),
            F.count_if(between).alias(f"inside{i}"),
            F.count_if((v == hi) & (v > lo)).alias(f"at_hi{i}"),
            grid_of(F.when(between, v)).alias(f"grid{i}"),
        ]
    row = values.agg(*counts).first()
    left = []
    for b in brackets:
        i = spans.index((b.column, b.lo, b.hi))
        offset = row[f"below{i}"] + row[f"at_lo{i}"]
        inside = row[f"inside{i}"]
        if b.rank < row[f"below{i}"]:
            left.append(Bracket(b.column, b.rank, b.outer_lo, b.lo, math.inf, b.outer_lo, b.lo))
        elif b.rank < offset:
            found[b.column, b.rank] = b.lo
        elif b.rank < offset + inside:
            left.append(_bracket(b.column, b.rank, offset, inside, row[f"grid{i}"], b.lo, b.hi))
        elif b.rank < offset + inside + row[f"at_hi{i}"]:
            found[b.column, b.rank] = b.hi
        else:
            left.append(Bracket(b.column, b.rank, b.hi, b.outer_hi, math.inf, b.hi, b.outer_hi))
    return left


def _rank(values: DataFrame, brackets: list[Bracket], found: dict) -> list[Bracket]:
    """Rank the few distinct values left inside each bracket; a missed rank goes back to narrowing."""
    spans = list(dict.fromkeys((b.column, b.lo, b.hi) for b in brackets))
    keys = []
    for i, (c, lo, hi) in enumerate(spans):
        v = F.col(f"c{c}")
        # All values under a bracket share one key, so their number comes from the same scan.
        key = F.when(v < lo, F.lit(_UNDER)).when(v <= hi, v)
        keys.append(F.struct(F.lit(i).alias("span"), key.alias("v")))
    counted = (
        values.select(F.explode(F.array(*keys)).alias("key"))
        .select("key.span", "key.v")
        .where(F.col("v").isNotNull())
        .groupBy("span", "v")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    upto = F.sum("n").over(Window.partitionBy("span").orderBy("v"))
    ranked = counted.select("span", "v", (upto - F.col("n")).alias("first"), upto.alias("next"))
    wanted = F.lit(False)
    for b in brackets:
        i = spans.index((b.column, b.lo, b.hi))
        wanted = wanted | (
            (F.col("span") == i) & (F.col("first") <= b.rank) & (F.col("next") > b.rank)
        )
    hits = ranked.where(wanted).collect()  # at most one row per wanted rank
    missed = []
    for b in brackets:
        i = spans.index((b.column, b.lo, b.hi))
        value = next((h.v for h in hits if h.span == i and h.first <= b.rank < h.next), None)
        if value is None or not b.lo <= value <= b.hi:
            missed.append(b)
        else:
            found[b.column, b.rank] = value
    return missed


def order_statistics(
    values: DataFrame,
    ranks: dict[int, set[int]],
    bounds: dict[int, tuple[int, float, float]],
    direct_values: int = DIRECT_VALUES,
) -> dict[tuple[int, int], float]:
    """Value at each 0-based rank of columns ``c0`` …; ``bounds`` is (n, min, max) per column."""
    found: dict[tuple[int, int], float] = {}
    todo = []
    if ranks:
        sketches = [grid_of(F.col(f"c{c}")).alias(f"grid{c}") for c in ranks]
        grids = values.agg(*sketches).first()
        for c, wanted in ranks.items():
            n, lo, hi = bounds[c]
            todo += [_bracket(c, r, 0, n, grids[f"grid{c}"], lo, hi) for r in sorted(wanted)]
    while todo:
        wide = [b for b in todo if b.rows > direct_values and b.lo < b.hi]
        if wide:
            ready = [b for b in todo if b not in wide]
            todo = ready + _narrow(values, wide, found)
        else:
            missed = _rank(values, todo, found)
            todo = _narrow(values, missed, found) if missed else []
    return found


def interpolate(found: dict, column: int, n: int, p: float) -> float | None:
    if not n:
        return None
    low, high, weight = wanted_ranks(n, p)
    a, b = found[column, low], found[column, high]
    return a if weight == 0 or a == b else a + (b - a) * weight
