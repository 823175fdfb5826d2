from collections import deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from tableinsight.operators.anomaly import _range_of, arrival_decisions, trailing_zscore
from tableinsight.operators.approvals import resolve, unknown_decisions


def _scores(spark, values, **options):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i int, v double")
    return arrival_decisions(df, "v", ["i"], **options).orderBy("i").collect()


def test_too_few_and_constant(spark):
    rows = _scores(spark, [100, 102])
    assert [r.reason for r in rows] == ["pas_assez_de_donnees"] * 2
    rows = _scores(spark, [100] * 6)
    assert rows[-1].reason == "pas_de_variance"
    assert [r.should_run for r in rows] == [True, True, False, False, False, False]


@pytest.mark.parametrize("last, direction", [(1000, "hausse"), (1, "baisse")])
def test_jump(spark, last, direction):
    row = _scores(spark, [100] * 10 + [last])[-1]
    assert row.anomaly and row.direction == direction and row.severite == "elevee"


def test_normal_series(spark):
    row = _scores(spark, [100, 102, 98, 101, 99, 103, 97, 100, 102, 99, 101])[-1]
    assert not row.anomaly and row.severite == "faible"


def test_sixth_arrival_can_trigger(spark):
    rows = _scores(spark, [100] * 5 + [100000])
    assert [r.should_run for r in rows] == [True, True, False, False, False, True]
    assert rows[-1].z_score == 2.2361


def _brute(values, size=12):
    window, result = deque(maxlen=size), []
    for v in values:
        window.append(v)
        std = np.std(window)
        defined = len(window) >= 3 and std > 0
        result.append(round(float((v - np.mean(window)) / std), 4) if defined else None)
    return result


def test_brute_force_agrees(spark):
    rng = np.random.default_rng(11)
    values = [int(v) for v in rng.integers(0, 50, 200)] + [7] * 15
    batch = [r.z_score for r in _scores(spark, values)]
    assert batch == pytest.approx(_brute(values), abs=1.01e-4)


@pytest.mark.parametrize("ranges", [1, 2, 7, 400])
def test_ranges_equal_one_window(spark, ranges):
    """A hot series over many ranges, short ones beside it, gaps and missing values."""
    df = spark.range(1500).select(
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 5 != 0, F.concat(F.lit("s"), F.col("id") % 50))
        .alias("s"),
        "id",
        F.when(F.col("id") % 11 != 0, ((F.col("id") * 7919) % 1013).cast("double")).alias("v"),
    )
    found = trailing_zscore(df, "v", ["id"], ["s"], ranges=ranges)
    series = {}
    for r in df.orderBy("id").collect():
        series.setdefault(r.s, []).append((r.id, r.v))
    expected = {}
    for rows in series.values():
        for i, (key, v) in enumerate(rows):
            window = [x for _, x in rows[max(0, i - 11) : i + 1] if x is not None]
            std = np.std(window) if len(window) >= 3 else 0
            expected[key] = float((v - np.mean(window)) / std) if std and v is not None else None
    assert {r.id: r.z_score for r in found.collect()} == pytest.approx(expected, abs=1.01e-4)
    assert found.columns == ["s", "id", "v", "reason", "anomaly", "moyenne", "ecart_type", "z_score",
                             "direction", "severite"]


@pytest.mark.parametrize("borders", [[], [5], [1, 2, 4], list(range(0, 400, 3))])
def test_ranges_by_bisection(spark, borders):
    """As many borders as are below the value, none below a missing one; the work grows with their bits."""
    values = [None, -1, 0, 1, 2, 3, 4, 5, 6, 200, 399, 1000]
    df = spark.createDataFrame([(v,) for v in values], "v int").select("v", _range_of(F.col("v"), borders).alias("p"))
    assert [tuple(r) for r in df.collect()] == [(v, 0 if v is None else sum(b < v for b in borders)) for v in values]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lambda") < 40


def test_dates_and_times_are_dealt_by_a_sketch(spark):
    days = spark.range(300).select(
        F.expr("date_add(DATE '2020-01-01', CAST(id AS INT))").alias("d"),
        F.expr("timestamp_micros(id * 1000001)").alias("t"), ((F.col("id") * 7919) % 101).cast("double").alias("v"),
    )
    one = {r.d: r.z_score for r in trailing_zscore(days, "v", ["d"], ranges=1).collect()}
    for order in ("d", "t"):
        found = trailing_zscore(days, "v", [order], ranges=9)
        assert {r.d: r.z_score for r in found.collect()} == one


def test_text_and_date_orders(spark):
    df = spark.range(60).select(F.format_string("k%03d", "id").alias("k"), F.lit(1.0).alias("v"))
    assert {r.reason for r in trailing_zscore(df, "v", ["k"], ranges=5).where("k > 'k002'").collect()} == {
        "pas_de_variance"
    }
    assert trailing_zscore(df.limit(0), "v", ["k"]).count() == 0


def test_approvals(spark):
    runs = spark.createDataFrame([("a", "pending"), ("b", "pending"), ("c", "approved")], "run_id string, status string")
    decisions = spark.createDataFrame(
        [("a", "rejected", 2), ("a", "approved", 1), ("z", "approved", 1)],
        "run_id string, decision string, decided_at int",
    )
    assert {r.run_id: r.status for r in resolve(runs, decisions).collect()} == {
        "a": "approved", "b": "pending", "c": "approved",
    }
    assert [r.run_id for r in unknown_decisions(runs, decisions).collect()] == ["z"]
