import numpy as np
import pytest
from pyspark.mllib.linalg import Vectors
from pyspark.mllib.stat import Statistics
from pyspark.sql import functions as F

from tableinsight import names
from tableinsight.functions import chisq, columns
from tableinsight.functions.chisq import uniform_statistic, upper_tail
from tableinsight.functions.keys import compact_key, null_in, row_groups
from tableinsight.operators.inspection import duplicate_stats
from tableinsight.operators.profile import (
    describe,
    describe_numbers,
    profile_report,
    profile_table,
)

# Chi-squared critical values at 0.05 for 1 to 29 degrees of freedom.
CRITICAL_VALUES = [
    3.841459, 5.991465, 7.814728, 9.487729, 11.070498, 12.591587, 14.067140, 15.507313,
    16.918978, 18.307038, 19.675138, 21.026070, 22.362032, 23.684791, 24.995790, 26.296228,
    27.587112, 28.869299, 30.143527, 31.410433, 32.670573, 33.924438, 35.172462, 36.415029,
    37.652484, 38.885139, 40.113272, 41.337138, 42.556968,
]


def test_tail_is_five_percent_at_the_critical_values(spark):
    rows = list(enumerate(CRITICAL_VALUES, 1))
    df = spark.createDataFrame(rows, "df int, x double")
    tails = [r[0] for r in df.select(upper_tail(F.col("x"), F.col("df"))).collect()]
    assert tails == pytest.approx([0.05] * 29, abs=1e-6)


def test_tail_at_the_ends(spark):
    df = spark.createDataFrame(
        [(0.0, 3), (1e9, 3), (199.0, 1), (250.0, 200), (30.0, 15)], "x double, df int"
    )
    zero, huge, large, many, middle = [
        r[0] for r in df.select(upper_tail(F.col("x"), F.col("df"))).collect()
    ]
    assert (zero, huge) == (1.0, 0.0)
    assert 0 <= large < 1e-12
    assert many == pytest.approx(0.00955, abs=1e-3)
    assert middle == pytest.approx(0.01192, abs=1e-5)


def test_statistic_and_tail_match_mllib(spark):
    rng = np.random.default_rng(7)
    for k in (2, 3, 8, 30):
        counts = [int(n) for n in rng.integers(900, 1100, k)]
        expected = Statistics.chiSqTest(Vectors.dense(counts))
        df = spark.createDataFrame([(n,) for n in counts], "n bigint").agg(
            uniform_statistic(F.count("n"), F.sum("n"), F.sum(F.col("n") * F.col("n"))).alias("x"),
            F.count("n").alias("k"),
        )
        row = df.select("x", upper_tail(F.col("x"), F.col("k") - 1).alias("p")).first()
        assert row.x == pytest.approx(expected.statistic, abs=1e-9)
        assert row.p == pytest.approx(expected.pValue, abs=1e-9)


def test_statistic_does_not_cancel_for_huge_counts(spark):
    n = 10**12
    df = spark.createDataFrame([(n,), (n + 2,)], "n bigint").agg(
        uniform_statistic(
            F.count("n"), F.sum("n"), F.sum(F.col("n").cast("decimal(19,0)") * F.col("n"))
        ).alias("x")
    )
    assert df.first().x == pytest.approx(2 / (n + 1), rel=1e-9)


def test_names():
    assert names.quote("a`b") == "`a``b`"
    assert names.table_name("/tmp/my file-1.csv") == "my_file_1"
    assert names.unique(["a", "A", "a"]) == ["a", "A_2", "a_3"]


@pytest.mark.parametrize(
    "name, found",
    [("customer_id", True), ("ID", True), ("id_client", True), ("paid", False), ("idea", False)],
)
def test_id_pattern(spark, name, found):
    df = spark.createDataFrame([(1,)], [name])
    assert (columns.id_column(df) == name) == found


def test_dimensions_skip_id_and_dates(spark):
    df = spark.sql(
        "SELECT 1 AS x_id, current_date() AS d, 'a' AS update_kind, " +
        ", ".join(f"{i} AS c{i}" for i in range(8))
    )
    assert columns.dimension_columns(df, "x_id")[:6] == [f"c{i}" for i in range(6)]


def test_long_text_keys_are_narrow_and_exact(spark):
    long, other = "x" * 5000, "x" * 4999 + "y"
    digest = spark.sql(f"SELECT sha2('{long}', 256)").first()[0]
    values = [long, long, other, digest, "", None, None]
    df = spark.createDataFrame([(v,) for v in values], "t string")
    keys = [r[0] for r in df.select(compact_key(F.col("t"), df.schema["t"].dataType)).collect()]
    assert [keys.count(k) for k in keys] == [values.count(v) for v in values]
    assert max(len(k) for k in keys if k) == 64


def test_row_digests_tell_rows_apart(spark):
    rows = [
        ("a", "bc", 0.0, [1, None]), ("ab", "c", 0.0, [1, None]), ("a", "bc", -0.0, [1, None]),
        (None, "-", 1.0, None), ("-", None, 1.0, None), ("", None, float("nan"), []), ("", None, float("nan"), []),
        ("a", "bc", 0.0, [1]), ("1:x", "", 2.0, None), ("1:x1:", None, 2.0, None),
    ]
    df = spark.createDataFrame(rows, "a string, b string, c double, d array<int>")
    counts = sorted(r.n for r in row_groups(df, []).collect())
    assert counts == [1, 1, 1, 1, 1, 1, 2, 2]
    nulls = row_groups(df, []).where(null_in(1)).agg(F.sum("n")).first()[0]
    assert nulls == 4


def test_only_the_digest_is_shuffled(spark):
    plan = duplicate_stats(spark.range(9).selectExpr("id", "id * 2 AS other", "'t' AS text"))
    text = plan._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in text.split("\n") if "hashpartitioning" in line]
    assert exchanges and not any("hashpartitioning(id" in x or "hashpartitioning(t" in x for x in exchanges)


def test_describe_without_numbers_dates_or_text(spark):
    assert describe(spark.sql("SELECT true AS flag"))["text"].collect() == []


@pytest.mark.parametrize("direct_values", [1_000_000, 60])
def test_quantiles_match_brute_force(spark, direct_values):
    """Hot values, ties next to the wanted rank, few values, NULL and NaN; also when many
    narrowing rounds are forced."""
    rng = np.random.default_rng(3)
    n = 30_000
    hot = np.where(rng.random(n) < 1 / 3, 7.0, rng.normal(0, 1e6, n))
    edge = np.concatenate([np.full(n // 2, 1.0), np.full(n - n // 2, 2.0)])
    heavy = np.exp(rng.normal(0, 30, n))
    df = spark.createDataFrame(
        [
            (float(a), float(b), float(c), float(i % 3), None if i % 5 else float("nan") if i % 2 else float(i))
            for i, (a, b, c) in enumerate(zip(hot, edge, heavy))
        ],
        "hot double, edge double, heavy double, few double, gaps double",
    ).repartition(8)
    gaps = np.array([float(i) for i in range(n) if i % 5 == 0 and i % 2 == 0])
    expected = {"hot": hot, "edge": edge, "heavy": heavy, "few": np.arange(n) % 3, "gaps": gaps}
    for row in describe_numbers(df, direct_values).collect():
        values = expected[row.column_name]
        assert row["count"] == len(values)
        assert [row.p25, row.p50, row.p75] == pytest.approx(
            list(np.quantile(values, [0.25, 0.5, 0.75])), rel=1e-12
        )
        assert row.std == pytest.approx(values.std(ddof=1))


def test_profile_of_empty_and_null_columns(spark):
    df = spark.createDataFrame([(None, None, "a")], "x double, y bigint, z string")
    rows = {r.column_name: r for r in profile_table(df).collect()}
    assert (rows["x"].median, rows["x"].n_nulls, rows["z"].n_nulls) == (None, 1, 0)
    assert rows["y"].column_type == "BIGINT"
    assert profile_table(df.limit(0)).count() == 3


def test_describe_falls_back_to_text(spark):
    df = spark.createDataFrame([("Paris",), ("Lyon",), ("Paris",)], "ville string")
    (row,) = describe(df)["text"].collect()
    assert (row["count"], row.unique, row.top, row.freq) == (3, 2, "Paris", 2)
    assert set(describe(spark.sql("SELECT 1 AS a, current_date() AS d"))) == {"numbers", "dates"}


def test_profile_report(spark):
    """Golden numbers of a column with the values 1 to 60."""
    df = spark.range(1, 61).select(F.col("id").alias("customer_id"), F.lit("web").alias("platform"))
    report = profile_report(df)
    assert (report["total_lignes"], report["doublons"]) == (60, 0)
    number, text = report["profiling"]
    assert (number["min"], number["max"], number["mediane"]) == (1, 60, 30.5)
    assert number["ecart_type"] == pytest.approx(17.464249, abs=1e-6)
    assert text == {"colonne": "platform", "type": "VARCHAR", "valeurs_manquantes": 0}


def test_tail_of_many_degrees_agrees_with_the_series(spark):
    """Both forms just where one takes over from the other."""
    k = 9_990
    df = spark.createDataFrame([(float(k + d), k) for d in (-300, -50, 0, 80, 200, 400)], "x double, k int")
    near = df.select(
        chisq.upper_tail(F.col("x"), F.col("k")).alias("series"),
        chisq._normal_tail(F.col("x"), F.col("k")).alias("normal"),
    )
    for r in near.collect():
        assert r.series == pytest.approx(r.normal, abs=2e-5)
