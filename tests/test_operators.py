from collections import Counter
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tableinsight.operators import joins
from tableinsight.operators.drivers import NO_FINDING_TEXT, driver_analysis, findings
from tableinsight.operators.inspection import (
    date_ranges,
    duplicate_stats,
    inspect_table,
    inspection_summary,
    validation_checks,
)
from tableinsight.operators.profile import describe_text
from tableinsight.operators.joins import (
    JoinConfigurationError,
    spec_errors,
    JoinStep,
    diagnose_join,
    join_tables,
    joined_row_count,
)
from tableinsight.operators.metric import entity_metric, top_entities
from tableinsight.operators.neutralize import neutralize_formulas
from tableinsight.operators.reconcile import reconcile_numbers
from tableinsight.plans import catalog
from tableinsight.plans.analyze import analyze, analyze_joined

MONDAY = date(2024, 1, 1)


@pytest.fixture(scope="module")
def retention(spark):
    """40 customers, ten in each of four weeks."""
    rows = [
        (i + 1, MONDAY + timedelta(weeks=i // 10), ("web", "mobile")[i % 2], ("EU", "US", "APAC", "EU")[i % 4])
        for i in range(40)
    ]
    return spark.createDataFrame(
        rows, "customer_id bigint, activity_date date, platform string, region string"
    )


@pytest.fixture(scope="module")
def catalogue(spark):
    """No id, no date: products with forty distinct prices."""
    rows = [("ABCD"[i % 4], i, ("Nord", "Sud")[i % 2]) for i in range(40)]
    return spark.createDataFrame(rows, "produit string, prix bigint, region string")


def test_inspect(retention):
    profile = inspect_table(retention)
    assert (profile.row_count, profile.duplicate_count, profile.null_counts) == (40, 0, {})
    assert profile.id_column == "customer_id" and not profile.needs_aggregation
    assert profile.date_range == {"activity_date": ("2024-01-01", "2024-01-22")}


def test_inspect_counts_nulls_and_duplicate_groups(spark):
    nulls = spark.createDataFrame([(1.0, "x"), (2.0, None), (None, "z")], "a double, b string")
    assert inspect_table(nulls).null_counts == {"a": 1, "b": 1}
    rows = spark.createDataFrame([(1, "x"), (1, "x"), (1, "x"), (2, None), (2, None)], "cnt int, n string")
    stats = duplicate_stats(rows).first()
    assert (stats.row_count, stats.duplicate_groups, stats.excess_rows) == (5, 2, 3)
    assert inspect_table(rows).duplicate_count == 2


def test_inspect_empty_table(retention):
    empty = inspect_table(retention.limit(0))
    assert (empty.row_count, empty.duplicate_count, empty.null_counts) == (0, 0, {})
    assert empty.date_range == {"activity_date": (None, None)}
    assert date_ranges(retention.limit(0)).first()["min"] is None


def test_inspect_without_id_or_date(catalogue):
    row = inspection_summary(catalogue).first()
    assert (row.id_column, row.date_columns, row.row_count) == (None, "", 40)


def test_large_table_flag(spark):
    assert inspect_table(spark.range(10_001)).needs_aggregation


def test_weekly_metric(retention):
    metric = entity_metric(retention)
    assert [r.value for r in metric.frame.collect()] == [10, 10, 10, 10]
    assert metric.label == "Évolution hebdomadaire (entités distinctes, sur activity_date)"


def test_metric_without_date_or_id(catalogue):
    metric = entity_metric(catalogue)
    assert metric.frame.first().value == 40
    assert metric.label == "Total (lignes), aucune colonne date détectée"


def test_null_weeks_come_last(spark):
    df = spark.createDataFrame([(1, None), (2, MONDAY), (2, MONDAY)], "user_id int, day date")
    assert [tuple(r) for r in entity_metric(df).frame.collect()] == [(MONDAY, 1), (None, 1)]


def test_hostile_headers_stay_names(spark):
    hostile = "1) as total FROM data UNION SELECT secret FROM other -- x_id"
    df = spark.createDataFrame([(1, "a"), (2, "a"), (2, "b")], [hostile, "we`ird.\"name"])
    assert inspect_table(df).id_column == hostile
    assert entity_metric(df).frame.first().value == 2
    counts = {r.category: r.n for r in driver_analysis(df).breakdown.collect()}
    assert counts == {"a": 2, "b": 1}
    assert {r.check: r.result for r in validation_checks(df).collect()}["total_entites"] == "2"


def test_top_entities(spark):
    df = spark.createDataFrame([(i % 7,) for i in range(20)], ["user_id"])
    assert [tuple(r) for r in top_entities(df, "user_id", 3).collect()] == [(0, 3), (1, 3), (2, 3)]


def _pairs(spark, counts: dict[str, int]):
    """One row per category and customer; customers overlap between categories."""
    rows = [(i + 1, category) for category, n in counts.items() for i in range(n)]
    return spark.createDataFrame(rows, "customer_id bigint, d string")


@pytest.mark.parametrize(
    "counts, chi2, p, significant",
    [
        ({"web": 27, "mobile": 24, "desktop": 9}, 9.3, 0.0096, True),
        ({"EU": 25, "APAC": 19, "US": 16}, 2.1, 0.3499, False),
        ({"free": 27, "pro": 21, "enterprise": 12}, 5.7, 0.0578, False),
        ({"mobile": 95, "web": 5}, 81.0, 0.0, True),
        ({"a": 50, "b": 50}, 0.0, 1.0, False),
    ],
)
def test_driver_golden_numbers(spark, counts, chi2, p, significant):
    test = driver_analysis(_pairs(spark, counts)).tests.first()
    assert (test.chi2, test.p_value, test.significant) == (chi2, p, significant)
    assert test.n_categories == len(counts)


def test_drivers_skip_fail_and_isolate(spark, catalogue):
    result = driver_analysis(catalogue, None, ["produit", "prix", "phantom"], max_categories=30)
    status = {r.dimension: (r.status, r.n_categories) for r in result.tests.collect()}
    assert status == {"produit": ("tested", 4), "prix": ("skipped", 40), "phantom": ("error", None)}
    assert {r.dimension for r in result.breakdown.collect()} == {"produit"}


def test_nothing_is_left_out_unless_asked(spark):
    """Nine dimensions, some with many categories: all tested and broken down."""
    columns = [F.col("id").alias("user_id")]
    columns += [(F.col("id") % (7 * i + 2)).cast("string").alias(f"d{i}") for i in range(9)]
    df = spark.range(4000).select(*columns)
    result = driver_analysis(df)
    tests = {r.dimension: r for r in result.tests.collect()}
    assert {d: r.n_categories for d, r in tests.items()} == {f"d{i}": 7 * i + 2 for i in range(9)}
    assert {r.status for r in tests.values()} == {"tested"}
    assert result.breakdown.count() == sum(7 * i + 2 for i in range(9))
    cut = {r.dimension: r.status for r in driver_analysis(df, max_dimensions=2).tests.collect()}
    assert [cut[f"d{i}"] for i in range(9)] == ["tested"] * 2 + ["left_out"] * 7


def test_wide_dimension_is_counted_exactly(spark):
    df = spark.range(5000).select(
        F.col("id").alias("user_id"),
        F.concat(F.lit("x" * 80), (F.col("id") % 777).cast("string")).alias("comment"),
        F.when(F.col("id") % 3 > 0, "a").alias("kind"),
    )
    result = driver_analysis(df, max_categories=30)
    status = {r.dimension: (r.status, r.n_categories) for r in result.tests.collect()}
    assert status == {"comment": ("skipped", 777), "kind": ("tested", 2)}
    assert {r.category: r.n for r in result.breakdown.collect()} == {"a": 3333, None: 1667}


def test_single_category_is_untested(spark):
    df = spark.createDataFrame([("a",), ("a",)], ["kind"])
    test = driver_analysis(df).tests.first()
    assert (test.status, test.chi2, test.significant) == ("untested", None, None)


def test_breakdown_ignores_row_order(retention):
    a = driver_analysis(retention).breakdown.collect()
    b = driver_analysis(retention.orderBy(F.rand(1))).breakdown.collect()
    assert a == b and {r.n for r in a if r.dimension == "platform"} == {20}


def test_findings_print_decimals(spark):
    rows = [("a", "tested", p, False) for p in (0.0005, 0.0, 1.0, 0.05, 0.2395)]
    tests = spark.createDataFrame(rows, "dimension string, status string, p_value double, significant boolean")
    found = [r.finding.split("p=")[1].split(" ")[0] for r in findings(tests).collect()]
    assert found == ["0.0005", "0.0", "1.0", "0.05", "0.2395"]


def test_findings_text(retention):
    texts = {r.finding for r in findings(driver_analysis(retention).tests).collect()}
    assert "platform : p=1.0 (non significatif)" in texts
    assert NO_FINDING_TEXT == "Aucune observation disponible."


def test_validation(spark, retention):
    checks = {r.check: (r.result, r.passed) for r in validation_checks(retention).collect()}
    assert checks == {
        "total_entites": ("40", True),
        "plage_dates": ("2024-01-01 .. 2024-01-22", True),
        "doublons": ("0", True),
    }
    doubled = retention.union(retention)
    failed = {r.check: r.passed for r in validation_checks(doubled, "ghost").collect()}
    assert failed == {"total_entites": False, "plage_dates": True, "doublons": False}


@pytest.fixture(scope="module")
def trio(spark):
    commandes = [(i + 1, i % 10 + 1, i % 5 + 1, MONDAY + timedelta(days=i), i) for i in range(40)]
    return {
        "commandes": spark.createDataFrame(
            commandes,
            "id bigint, client_id_ref bigint, produit_id_ref bigint, date_commande date, montant bigint",
        ),
        "clients": spark.createDataFrame(
            [(i + 1, f"c{i}", ("premium", "standard")[i % 2]) for i in range(10)],
            "id bigint, nom string, segment string",
        ),
        "produits": spark.createDataFrame(
            [(i + 1, "AB"[i % 2]) for i in range(5)], "id bigint, categorie string"
        ),
    }


def _step(file, file_column, on_file, on_column, how="inner"):
    return {"file": file, "file_column": file_column, "on_file": on_file, "on_column": on_column, "how": how}


TRIO_SPEC = {
    "root": "commandes",
    "joins": [
        _step("clients", "id", "commandes", "client_id_ref"),
        _step("produits", "id", "commandes", "produit_id_ref", "LEFT"),
    ],
}


def test_join_trio(trio):
    joined = join_tables(trio, TRIO_SPEC)
    assert joined.columns[0] == "commandes__id" and joined.columns[-1] == "produits__categorie"
    assert inspect_table(joined).id_column == "commandes__id"
    diagnosis = diagnose_join(trio, TRIO_SPEC).first()
    assert (diagnosis.row_count, diagnosis.status, diagnosis.warning) == (40, "ok", None)


def test_analyze_joined(trio):
    result = analyze_joined(trio, TRIO_SPEC)
    assert sum(r.value for r in result.metric.frame.collect()) == 40
    assert result.join_diagnosis.first().status == "ok"
    assert set(result.tables()) >= {"metric", "drivers", "driver_tests", "validation"}


@pytest.mark.parametrize(
    "spec, error",
    [
        ({"root": "nope"}, "root"),
        ({"root": "clients", "joins": [_step("produits", "id", "commandes", "id")]}, "before"),
        ({"root": "clients", "joins": [_step("produits", "id", "clients", "id", "full")]}, "unsupported"),
        ({"root": "clients", "joins": [_step("produits", "id", "clients", "id")]}, "outside"),
        ({"root": "clients", "joins": [_step("ghost", "id", "clients", "id")]}, "not among"),
    ],
)
def test_bad_specs(trio, spec, error):
    with pytest.raises(ValueError, match=error):
        join_tables(trio, spec)


def test_all_faults_of_a_spec(spark, trio):
    """Nothing is raised: each fault is a row, and a spec without any has no rows."""
    bad = {"root": "nowhere", "joins": [_step("clients", "nom", "commandes", "date_commande", "outer"), _step("x", "a", "y", "b")]}
    faults = [(r.position, r.fault) for r in spec_errors(spark, trio, bad).collect()]
    assert faults[:2] == [(-1, "unknown_root"), (0, "not_yet_joined")]
    assert {(0, "join_kind"), (0, "key_types"), (1, "unknown_table"), (1, "not_yet_joined")} <= set(faults)
    assert sum(f == "outside_tree" for _, f in faults) == len(set(trio) - {"clients", "x"})



def test_incomparable_keys(trio):
    pair = {k: trio[k] for k in ("commandes", "clients")}
    spec = {"root": "commandes", "joins": [_step("clients", "nom", "commandes", "date_commande")]}
    with pytest.raises(JoinConfigurationError) as error:
        join_tables(pair, spec)
    assert "date" in error.value.detail


def test_left_keeps_unmatched_rows_and_nulls(spark):
    a = spark.createDataFrame([(1,), (2,), (3,), (None,)], "id int")
    b = spark.createDataFrame([(1, "x"), (2, "y"), (None, "z")], "a_id int, v string")
    for how, n in (("left", 4), ("inner", 2)):
        spec = {"root": "a", "joins": [_step("b", "a_id", "a", "id", how)]}
        assert join_tables({"a": a, "b": b}, spec).count() == n
        assert joined_row_count({"a": a, "b": b}, spec).first().row_count == n


def test_five_table_star(spark):
    tables = {"root": spark.range(1, 11)}
    steps = []
    for i in range(4):
        tables[f"t{i}"] = spark.range(1, 11).select(F.col("id").alias("ref"), F.lit(i).alias("valeur"))
        steps.append(_step(f"t{i}", "ref", "root", "id"))
    assert join_tables(tables, {"root": "root", "joins": steps}).count() == 10


@pytest.mark.parametrize("hows", [("inner", "inner", "left"), ("left", "left", "inner"),
                                  ("left", "inner", "left"), ("inner", "left", "left")])
def test_row_count_without_joining_equals_the_join(spark, hows):
    """Chains and branches with repeated, missing and NULL keys."""
    def keyed(seed, n, m):
        return spark.range(n).select(
            F.when(F.col("id") % 9 > 0, (F.col("id") * seed) % m).alias("p"),
            ((F.col("id") * (seed + 2)) % (m + 3)).alias("q"),
        )

    tables = {"a": keyed(3, 60, 7), "b": keyed(5, 30, 11), "c": keyed(7, 20, 13), "d": keyed(2, 15, 5)}
    spec = {"root": "a", "joins": [
        _step("b", "p", "a", "q", hows[0]), _step("c", "q", "b", "q", hows[1]),
        _step("d", "p", "c", "p", hows[2]),
    ]}
    assert joined_row_count(tables, spec).first().row_count == join_tables(tables, spec).count()


def test_join_diagnosis_of_unrelated_and_exploding_keys(spark):
    meteo = spark.createDataFrame([(f"v{i}",) for i in range(15)], ["ville"])
    films = spark.createDataFrame([(f"f{i}",) for i in range(10)], ["titre"])
    spec = {"root": "meteo", "joins": [_step("films", "titre", "meteo", "ville")]}
    row = diagnose_join({"meteo": meteo, "films": films}, spec).first()
    assert (row.row_count, row.largest_source, row.status) == (0, 15, "empty")
    same = {"meteo": meteo.withColumn("ville", F.lit("x")), "films": films.withColumn("titre", F.lit("x"))}
    row = diagnose_join(same, spec).first()
    assert (row.row_count, row.status) == (150, "explosion")


def test_reconcile(spark):
    trusted = spark.createDataFrame([(10.0,), (20.0,), (30.0,)], ["v"])
    good = reconcile_numbers(trusted, spark.createDataFrame([("20 %",), ("10,00",), ("text",)], ["t"]))
    assert good.summary.first().passed and good.inconsistencies.count() == 0
    bad = reconcile_numbers(trusted, spark.createDataFrame([(999999.0, 0.001)], ["v", "w"]))
    assert not bad.summary.first().passed
    assert [r.value for r in bad.inconsistencies.collect()] == [999999.0]


def test_neutralize(spark):
    values = ['=HYPERLINK("x")', "+1+1", "@cmd", "-2", "\ttab", "Alice", None]
    df = spark.createDataFrame([(v, 1) for v in values], "`=nom` string, n int")
    safe = neutralize_formulas(df)
    assert safe.columns == ["'=nom", "n"]
    assert [r[0] for r in safe.collect()] == ["'" + v for v in values[:5]] + ["Alice", None]


def test_analyze(retention):
    result = analyze(retention)
    assert result.inspection.first().row_count == 40
    assert {r.dimension for r in result.drivers.tests.collect()} == {"platform", "region"}


def test_nested_and_variant_columns_can_be_inspected(spark):
    df = spark.sql(
        "SELECT id % 2 AS k, array(1) AS a, map('x', 1) AS m, struct(1 AS s) AS t, "
        "parse_json('{\"v\": 1}') AS v, binary('b') AS b FROM range(4)"
    )
    assert inspect_table(df).duplicate_count == 2


def test_long_text_ids_and_approximate_counts(spark):
    df = spark.range(300).select(
        F.concat(F.lit("u" * 100), F.col("id") % 30).alias("user_id"), F.lit("a").alias("kind")
    )
    assert entity_metric(df).frame.first().value == 30
    assert driver_analysis(df).breakdown.first().n == 30
    assert entity_metric(df, approximate=True).frame.first().value == pytest.approx(30, abs=2)


def test_hot_entity_and_category(spark):
    """One user, one category and one repeated row hold a third of all rows."""
    df = spark.range(9000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("user_id"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("c"), F.col("id") % 5)).alias("kind"),
    )
    counts = {r.category: r.n for r in driver_analysis(df).breakdown.collect()}
    assert counts == {"hot": 1, **{f"c{i}": 1200 for i in range(5)}}
    stats = duplicate_stats(df).first()
    assert (stats.duplicate_groups, stats.excess_rows) == (1, 2999)


def test_join_diagnosis_counts_beyond_64_bits(spark):
    """Key counts of four billion on both sides, put in as weights."""
    big = spark.createDataFrame([(1, 4_000_000_000)], "key int, n bigint")
    root = big.select(F.col("key").alias("c0"), F.col("n").cast("decimal(38,0)").alias("w"))
    side = big.select("key", F.col("n").cast("decimal(38,0)").alias("w"))
    steps = [JoinStep("b", "key", "a", "key", "inner")]
    rows = joins._weights("a", {"a": root, "b": side}, {"a": steps, "b": []})
    assert rows.first().w == 16 * 10**18
    vast = side.select("key", F.lit("9" * 38).cast("decimal(38,0)").alias("w"))
    assert joins._weights("a", {"a": root, "b": vast}, {"a": steps, "b": []}).first().w == int("9" * 38)


def test_describe_long_texts(spark):
    """The most frequent value, the smallest of those equally frequent, whatever they begin with."""
    same = "p" * 64
    columns = {
        "long": [same + "b", same + "a", same + "b", same + "a", "q", None],
        "short": [same, same + "a", same, same + "a", "z", "z"],
        "every": [same + "c", same + "d", "zz", "é" * 90, "", same],
        "none": [None] * 6,
    }
    df = spark.createDataFrame(list(zip(*columns.values())), ", ".join(f"{c} string" for c in columns))
    found = {r.column_name: (r["count"], r.unique, r.top, r.freq) for r in describe_text(df).collect()}
    assert found == {
        "long": (5, 3, same + "a", 2), "short": (6, 3, same, 2), "every": (6, 6, "", 1),
    }
    plan = spark.createDataFrame([(same + "a",)], "t string")
    assert describe_text(plan).first().top == same + "a"


def test_categories_are_counted_where_their_entity_is(spark, monkeypatch):
    """Entities of few rows meet once; those of many rows, and rows without one, are not brought together."""
    monkeypatch.setattr("tableinsight.operators.drivers.LARGE_ENTITY_ROWS", 5)
    rows = [(i % 40, f"c{i % 7}" if i % 11 else None, float(i % 3)) for i in range(160)]
    rows += [(500, f"c{i % 9}", float(i % 4)) for i in range(60)] + [(None, f"n{i % 2}", 9.0) for i in range(30)]
    df = spark.createDataFrame(rows, "id long, kind string, size double")
    found = driver_analysis(df, "id", ["kind", "size"]).breakdown
    expected = {("kind", k): set() for _, k, _ in rows} | {("size", str(s)): set() for _, _, s in rows}
    for i, kind, size in rows:
        for key in (("kind", kind), ("size", str(size))):
            expected[key] |= {i} - {None}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert {(r.dimension, r.category): r.n for r in found.collect()} == {k: len(v) for k, v in expected.items()}
    # Pairs move with their entity only in the part that is not brought together.
    moved = [x for x in plan.split("\n") if "Exchange hashpartitioning(slot" in x and "entity" in x]
    assert "REPARTITION_BY_NUM" in plan and len(moved) == 1


def test_all_dimensions_of_a_table_are_tested(spark, tmp_path):
    """Prices are a dimension too, however many there are; only the entity and dates are none."""
    orders, price = F.col("id") % 400, F.when(F.col("id") % 9 > 0, F.col("id") % 700 + 0.25)
    texts = [F.lit("R").alias("l_returnflag"), (F.col("id") % 2).cast("string").alias("l_linestatus")]
    numbers = [F.col("id") % n for n in (200, 10, 7, 50, 11, 9)]
    names = ["l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_tax"]
    numbers = [c.alias(name) for c, name in zip(numbers, names)]
    lineitem = spark.range(3000).select(
        orders.alias("l_orderkey"), *numbers, price.alias("l_extendedprice"), *texts,
        F.timestamp_seconds("id").alias("l_shipdate"),
    )
    lineitem.write.parquet(f"{tmp_path}/lineitem.parquet")
    found = {r.dimension: r for r in catalog.driver_all_dimensions(spark, str(tmp_path)).collect()}
    assert set(found) == set(lineitem.columns) - {"l_orderkey", "l_shipdate"}
    pairs = {(i % 400, i % 700 if i % 9 else None) for i in range(3000)}
    counts = Counter(p for _, p in pairs).values()
    expected = sum(counts) / len(counts)
    chi2 = round(sum((n - expected) ** 2 / expected for n in counts), 3)
    tested = found["l_extendedprice"]
    assert (tested.status, tested.n_categories, tested.chi2) == ("tested", 701, chi2)
