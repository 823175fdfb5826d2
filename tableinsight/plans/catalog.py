"""Named queries over the test tables, one per operator."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tableinsight.functions.text import (
    FRAMING_SCHEMA,
    RECOMMENDATIONS_SCHEMA,
    chunk_text,
    extract_json,
    parse_rate,
)
from tableinsight.operators import approvals
from tableinsight.operators.anomaly import arrival_decisions, trailing_zscore
from tableinsight.operators.clean import Cleaned, clean
from tableinsight.operators.drivers import driver_analysis, findings, significant_drivers
from tableinsight.operators.inspection import (
    date_ranges,
    deduplicate,
    duplicate_stats,
    inspection_summary,
    null_counts,
    validation_checks,
)
from tableinsight.operators.joins import diagnose_join, join_tables, source_row_counts, spec_errors
from tableinsight.operators.metric import entity_metric, top_entities
from tableinsight.operators.neutralize import neutralize_formulas
from tableinsight.operators.profile import (
    describe_dates,
    describe_numbers,
    describe_text,
    profile_table,
)
from tableinsight.operators.reconcile import reconcile_numbers
from tableinsight.plans.analyze import analyze, analyze_joined, write_report
from tableinsight.plans.file_flow import process_files
from tableinsight.plans.guard import run_read_only
from tableinsight.plans.sql_checks import SQL_CHECKS
from tableinsight.session import fresh_path
from tableinsight.sources.csv import CSV_WRITE, read_csv, read_csv_robust
from tableinsight.sources.export import write_cleaned
from tableinsight.sources.files import csv_row_counts, file_row_counts
from tableinsight.streaming.detector import decisions
from tableinsight.streaming.gate import ArrivalGate, read_file

Query = Callable[[SparkSession, str], DataFrame]

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tables(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    return {name: table(spark, sf_dir, name) for name in names}


def _step(file: str, file_column: str, on_file: str, on_column: str, how: str = "inner") -> dict:
    return {
        "file": file, "file_column": file_column, "on_file": on_file, "on_column": on_column,
        "how": how,
    }


# -- metric -----------------------------------------------------------------------------------


def weekly_metric(spark, sf_dir):
    return entity_metric(table(spark, sf_dir, "events"), "user_id").frame


def weekly_rows(spark, sf_dir):
    return entity_metric(table(spark, sf_dir, "orders"), None).frame


def metric_total(spark, sf_dir):
    return entity_metric(table(spark, sf_dir, "part"), "p_partkey").frame


def joined_weekly_metric(spark, sf_dir):
    """The flagship: a join tree, then the weekly metric over its prefixed columns."""
    joined = join_tables(
        tables(spark, sf_dir, "orders", "customer"),
        {"root": "orders", "joins": [_step("customer", "c_custkey", "orders", "o_custkey")]},
    )
    return entity_metric(joined, "orders__o_custkey", "orders__o_orderdate").frame


def topk_entities(spark, sf_dir):
    return top_entities(table(spark, sf_dir, "events"), "user_id").select(
        F.col("entity").alias("user_id"), "n"
    )


# -- drivers ----------------------------------------------------------------------------------


def _events_with_bucket(spark, sf_dir) -> DataFrame:
    bucket = F.floor(F.col("value") / 50).cast("string")
    return table(spark, sf_dir, "events").withColumn("value_bucket", bucket)


def driver_breakdown(spark, sf_dir):
    events = _events_with_bucket(spark, sf_dir)
    return driver_analysis(events, "user_id", ["event_type", "value_bucket"]).breakdown


def driver_auto(spark, sf_dir):
    """Dimensions chosen by position and type, as for a table nobody has described."""
    orders = table(spark, sf_dir, "orders")
    return driver_analysis(orders, "o_orderkey", max_dimensions=6, max_categories=30).tests.select(
        "dimension", "status", "n_categories", "chi2", "p_value", "significant"
    )


def _tests(spark, sf_dir) -> DataFrame:
    part = driver_analysis(table(spark, sf_dir, "part"), None, ["p_brand", "p_type"]).tests
    documents = driver_analysis(table(spark, sf_dir, "documents"), None, ["lang", "source"]).tests
    return part.unionByName(documents)


def driver_chi2(spark, sf_dir):
    return _tests(spark, sf_dir).select(
        "dimension", "n_categories", "chi2", "p_value", "significant"
    )


def driver_all_dimensions(spark, sf_dir):
    """Every dimension of a table, however many categories it has, tested."""
    return driver_analysis(table(spark, sf_dir, "lineitem"), "l_orderkey").tests.select(
        "dimension", "status", "n_categories", "chi2", "p_value", "significant"
    )


def driver_errors(spark, sf_dir):
    """A missing column fails alone; a limit leaves its mark."""
    part = driver_analysis(
        table(spark, sf_dir, "part"), None, ["p_type", "no_such", "p_brand", "p_size"], max_dimensions=3
    )
    return part.tests.select("dimension", "status", "n_categories", "chi2", "error")


def driver_skipped(spark, sf_dir):
    part = driver_analysis(
        table(spark, sf_dir, "part"), None, ["p_size", "p_brand"], max_categories=30
    )
    return part.tests.select("dimension", "status", "n_categories")


def driver_significant(spark, sf_dir):
    return significant_drivers(_tests(spark, sf_dir)).select("dimension", "n_categories", "chi2")


def driver_findings(spark, sf_dir):
    return findings(_tests(spark, sf_dir))


# -- inspection, profile, validation ----------------------------------------------------------


def _labelled_documents(spark, sf_dir) -> DataFrame:
    return join_tables(
        tables(spark, sf_dir, "documents", "labels"),
        {"root": "documents", "joins": [_step("labels", "doc_id", "documents", "doc_id", "left")]},
    )


def inspect_dates(spark, sf_dir):
    return date_ranges(table(spark, sf_dir, "events"))


def inspect_nulls(spark, sf_dir):
    return null_counts(_labelled_documents(spark, sf_dir))


def inspect_summary(spark, sf_dir):
    return inspection_summary(table(spark, sf_dir, "events"))


def inspect_summary_joined(spark, sf_dir):
    return inspection_summary(_labelled_documents(spark, sf_dir))


def duplicate_groups(spark, sf_dir):
    documents = duplicate_stats(table(spark, sf_dir, "documents"), ["text"])
    events = duplicate_stats(table(spark, sf_dir, "events"), ["user_id", "event_type"])
    return documents.withColumn("source", F.lit("documents")).unionByName(
        events.withColumn("source", F.lit("events"))
    )


def dedup_rows(spark, sf_dir):
    return deduplicate(table(spark, sf_dir, "documents").select("text", "lang"))


def profile_numeric(spark, sf_dir):
    profile = profile_table(table(spark, sf_dir, "lineitem")).where("min IS NOT NULL")
    rounded = [F.round(c, 6).alias(c) for c in ("min", "max", "mean", "median", "stddev")]
    return profile.select("column_name", *rounded)


def profile_bigint(spark, sf_dir):
    """Bounds of integers that a DOUBLE cannot hold."""
    big = table(spark, sf_dir, "orders").select(
        (F.col("o_orderkey") + 9007199254740992).alias("key"),
        (F.col("o_orderkey").cast("decimal(30,3)") + F.lit("123456789012345678901.125").cast("decimal(30,3)")).alias("amount"),
    )
    return profile_table(big).select("column_name", "min_exact", "max_exact")


def profile_columns(spark, sf_dir):
    profile = profile_table(table(spark, sf_dir, "customer"))
    return profile.select("column_name", "column_type", "n_nulls")


def describe_numeric(spark, sf_dir):
    described = describe_numbers(table(spark, sf_dir, "customer"))
    rounded = [
        F.round(c, 6).alias(c) for c in ("mean", "std", "min", "p25", "p50", "p75", "max")
    ]
    return described.select("column_name", "count", *rounded)


def describe_datetime(spark, sf_dir):
    described = describe_dates(table(spark, sf_dir, "events"))
    bounds = [F.col(c).cast("string").alias(c) for c in ("min", "max")]
    quartiles = [F.unix_seconds(c).alias(c) for c in ("p25", "p50", "p75")]
    return described.select("column_name", "count", *bounds, *quartiles)


def describe_categories(spark, sf_dir):
    return describe_text(table(spark, sf_dir, "orders"))


def describe_texts(spark, sf_dir):
    """Long texts beside short ones; copies make a text the most frequent."""
    return describe_text(table(spark, sf_dir, "documents").drop("doc_id", "n_chars"))


def validation(spark, sf_dir):
    return validation_checks(table(spark, sf_dir, "events"), "user_id")


# -- joins ------------------------------------------------------------------------------------


def join_inner(spark, sf_dir):
    joined = join_tables(
        tables(spark, sf_dir, "orders", "customer"),
        {"root": "orders", "joins": [_step("customer", "c_custkey", "orders", "o_custkey")]},
    )
    return joined.select("orders__o_orderkey", "customer__c_name", "customer__c_mktsegment")


def join_left(spark, sf_dir):
    return _labelled_documents(spark, sf_dir).select(
        "documents__doc_id", "labels__quality", "labels__toxic"
    )


def joined_prefix(spark, sf_dir):
    return join_tables(
        tables(spark, sf_dir, "nation", "region", "supplier"),
        {
            "root": "supplier",
            "joins": [
                _step("nation", "n_nationkey", "supplier", "s_nationkey"),
                _step("region", "r_regionkey", "nation", "n_regionkey"),
            ],
        },
    )


_STAR = {
    "root": "lineitem",
    "joins": [
        _step("orders", "o_orderkey", "lineitem", "l_orderkey"),
        _step("customer", "c_custkey", "orders", "o_custkey"),
        _step("nation", "n_nationkey", "customer", "c_nationkey"),
        _step("part", "p_partkey", "lineitem", "l_partkey", "left"),
    ],
}


def join_tree(spark, sf_dir):
    joined = join_tables(
        tables(spark, sf_dir, "lineitem", "orders", "customer", "nation", "part"), _STAR
    )
    return joined.groupBy(
        F.col("nation__n_name").alias("nation"), F.col("part__p_type").alias("part_type")
    ).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("lineitem__l_quantity").alias("quantity"),
        F.count_distinct("customer__c_custkey").alias("customers"),
    )


def join_diagnosis(spark, sf_dir):
    t = tables(spark, sf_dir, "orders", "customer", "part", "supplier", "lineitem", "nation")
    cases = {
        "healthy": ("orders", "customer", "c_custkey", "o_custkey"),
        "empty": ("customer", "part", "p_name", "c_name"),
        "exploding": ("customer", "supplier", "s_nationkey", "c_nationkey"),
    }
    rows = []
    for name, (root, file, file_column, on_column) in cases.items():
        spec = {"root": root, "joins": [_step(file, file_column, root, on_column)]}
        rows.append(diagnose_join({n: t[n] for n in (root, file)}, spec).withColumn("case", F.lit(name)))
    star = diagnose_join(tables(spark, sf_dir, "lineitem", "orders", "customer", "nation", "part"), _STAR)
    rows.append(star.withColumn("case", F.lit("star")))
    return reduce(DataFrame.unionByName, rows).select(
        "case", "row_count", "largest_source", "status"
    )


# -- reconciliation ---------------------------------------------------------------------------


def _reconciled(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    shifted = F.when(F.col("o_orderstatus") == "P", F.col("o_totalprice") + 0.25)
    trusted = orders.select("o_totalprice")
    checked = orders.select(F.coalesce(shifted, "o_totalprice").alias("o_totalprice"))
    return reconcile_numbers(trusted, checked)


def reconcile_values(spark, sf_dir):
    return _reconciled(spark, sf_dir).inconsistencies


def reconcile_summary(spark, sf_dir):
    return _reconciled(spark, sf_dir).summary


# -- cleaning ---------------------------------------------------------------------------------


def raw_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a careless export would have them: text everywhere, blanks, copies, empty rows."""
    key = F.col("o_orderkey")
    blank_every = F.when(key % 7 == 0, "   ")
    rows = table(spark, sf_dir, "orders").select(
        F.lpad(key.cast("string"), 9, "0").alias(" code "),
        F.concat(F.lit("  "), F.col("o_custkey").cast("string"), F.lit(" ")).alias("customer"),
        F.replace(
            F.col("o_totalprice").cast("decimal(12,2)").cast("string"), F.lit("."), F.lit(",")
        ).alias("amount"),
        F.date_format("o_orderdate", "dd/MM/yyyy").alias("order_date"),
        F.coalesce(blank_every, F.concat(F.lit("\t"), "o_orderpriority", F.lit("  "))).alias(
            "priority"
        ),
        F.lit(None).cast("string").alias("unused"),
    )
    copies = rows.where(F.col(" code ").endswith("5"))
    empty = rows.where(F.col(" code ").endswith("3")).select(
        *[F.lit(None).cast("string").alias(c) for c in rows.columns]
    )
    return rows.unionByName(copies).unionByName(empty)


def _cleaned(spark, sf_dir) -> Cleaned:
    return clean(raw_orders(spark, sf_dir))


def clean_trim(spark, sf_dir):
    return _cleaned(spark, sf_dir).frame.select("code", "priority")


def clean_empty_rows(spark, sf_dir):
    cleaned = _cleaned(spark, sf_dir)
    frame = cleaned.frame
    return frame.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("code").isNull()).alias("n_empty"),
    ).withColumn("columns", F.lit(",".join(frame.columns)))


def clean_decimal(spark, sf_dir):
    return _cleaned(spark, sf_dir).frame.select("code", "amount")


def clean_numeric(spark, sf_dir):
    return _cleaned(spark, sf_dir).frame.select("code", "customer")


def clean_dates(spark, sf_dir):
    return _cleaned(spark, sf_dir).frame.select(
        "code", F.col("order_date").cast("date").alias("order_date")
    )


def clean_report(spark, sf_dir):
    report = _cleaned(spark, sf_dir).report
    joined = [
        F.array_join(c, ",").alias(c)
        for c in (
            "columns_converted_decimal", "columns_converted_numeric", "columns_converted_date"
        )
    ]
    return report.select(
        "original_rows", "original_cols", "final_rows", "final_cols", "empty_rows_removed",
        "duplicates_removed", *joined,
        F.array_join(F.map_keys("missing_values"), ",").alias("missing_columns"),
        F.get(F.map_values("missing_values"), F.lit(0)).alias("missing_count"),
    )


# -- untrusted text ---------------------------------------------------------------------------


def _risky_parts(spark, sf_dir) -> DataFrame:
    risky = F.when(F.col("p_partkey") % 7 == 0, F.concat(F.lit("="), "p_name"))
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.coalesce(risky, "p_name").alias("=label"), "p_brand"
    )


def neutralize(spark, sf_dir):
    return neutralize_formulas(_risky_parts(spark, sf_dir))


def hostile_header(spark, sf_dir):
    renamed = table(spark, sf_dir, "events").withColumnRenamed("user_id", 'a.b`"x_id')
    return entity_metric(renamed.drop("event_id")).frame


# -- anomalies --------------------------------------------------------------------------------

_SPIKE_DAY = "2024-01-20"
_SCORES = ("reason", "anomaly", "moyenne", "ecart_type", "z_score", "direction", "severite")


def _daily_events(spark, sf_dir, *series: str) -> DataFrame:
    """Events per day, with one day made ten times as busy; at most one row per series and day."""
    day = F.to_date("ts").alias("day")
    daily = table(spark, sf_dir, "events").groupBy(*series, day).agg(
        F.count(F.lit(1)).alias("n")
    )
    spiked = F.when(F.col("day") == F.lit(_SPIKE_DAY).cast("date"), F.col("n") * 10)
    return daily.withColumn("n", F.coalesce(spiked, "n"))


def zscore_daily(spark, sf_dir):
    daily = _daily_events(spark, sf_dir)
    return trailing_zscore(daily, "n", ["day"]).select("day", "n", *_SCORES)


def zscore_by_type(spark, sf_dir):
    daily = _daily_events(spark, sf_dir, "event_type")
    scored = trailing_zscore(daily, "n", ["day"], ["event_type"])
    return scored.select("event_type", "day", "n", *_SCORES)


def zscore_long_series(spark, sf_dir):
    """Row-level series, cut into ranges so that a long one spans many tasks."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    scored = trailing_zscore(
        orders, "o_totalprice", ["o_orderkey"], ["o_orderstatus"]
    )
    return scored.select("o_orderkey", "o_orderstatus", "reason", "anomaly", "z_score", "direction")


def _arrivals(spark, sf_dir) -> DataFrame:
    return arrival_decisions(_daily_events(spark, sf_dir), "n", ["day"])


def arrival_gate(spark, sf_dir):
    return _arrivals(spark, sf_dir).select("day", "n", "reason", "anomaly", "z_score", "should_run")


def _runs(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Runs of the gate, and decisions for the odd days plus one for a run that never was."""
    day = F.date_format("day", "yyyy-MM-dd")
    triggered = _arrivals(spark, sf_dir).where("should_run")
    runs = triggered.select(
        F.concat(F.lit("stream-"), day).alias("run_id"), "n", F.lit("pending").alias("status")
    )
    odd = F.dayofmonth("day") % 2 == 1
    decided = triggered.where(odd | (F.col("day") == F.lit(_SPIKE_DAY).cast("date")))
    decisions = decided.select(
        F.concat(F.lit("stream-"), day).alias("run_id"),
        F.when(odd, "approved").otherwise("rejected").alias("decision"),
        F.lit("2024-02-01 00:00:00").cast("timestamp").alias("decided_at"),
    )
    stray = decisions.where("decision = 'rejected'").withColumn(
        "run_id", F.concat("run_id", F.lit("-late"))
    )
    return runs, decisions.unionByName(stray)


def approval_resolution(spark, sf_dir):
    return approvals.resolve(*_runs(spark, sf_dir))


def approval_unknown(spark, sf_dir):
    return approvals.unknown_decisions(*_runs(spark, sf_dir)).select("run_id", "decision")


def stream_gate(spark, sf_dir):
    """The streaming gate over the table files themselves, as if they had just arrived."""
    gate = ArrivalGate(
        spark, sf_dir, state_dir=fresh_path(spark, "gate"), require_approval=True, max_files=1000
    )
    gate.run_available()
    return gate.decisions().select(
        F.substring_index("path", "/", -1).alias("file"), "n", "reason", "anomaly", "should_run"
    )


def _move(spark, source: str, target: str, modified: int | None = None) -> None:
    """The one data file Spark wrote into a folder moves to a place and time of its own."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(source).getFileSystem(spark._jsc.hadoopConfiguration())
    (found,) = [s.getPath() for s in fs.globStatus(path(f"{source}/part-*"))]
    fs.mkdirs(path(target).getParent())
    fs.rename(found, path(target))
    if modified is not None:
        fs.setTimes(path(target), modified * 1000, -1)


def _watched_days(spark, sf_dir, first: str = "") -> str:
    """A watched folder with one CSV of events for each day, the spike's rows ten times, in order of days."""
    day = F.date_format("ts", "yyyy-MM-dd")
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", day.alias("day"))
    events = events.filter(F.col("day") > first).withColumn(
        "_copy", F.explode(F.sequence(F.lit(1), F.when(F.col("day") == _SPIKE_DAY, 10).otherwise(1)))
    ).drop("_copy")
    folder = fresh_path(spark, "watched")
    days = [r.day for r in events.select("day").distinct().orderBy("day").collect()]  # one row a file
    events.repartition(len(days), "day").write.partitionBy("day").options(**CSV_WRITE).csv(f"{folder}/staged")
    for i, name in enumerate(days):
        suffix = "CSV" if i % 2 else "csv"
        _move(spark, f"{folder}/staged/day={name}", f"{folder}/in/{name}.{suffix}", 1_700_000_000 + 60 * i)
    return f"{folder}/in"


def _day_of(path: str) -> Column:
    return F.regexp_extract(path, r"/(\d{4}-\d\d-\d\d)[._]", 1).cast("date").alias("day")


_BAD_DAY = "2024-01-02"


def _users_by_type(spark, path: str, folder: str) -> None:
    if _BAD_DAY in path:
        raise ValueError("refused for the sake of the other runs")
    read_file(spark, path).groupBy("event_type").agg(
        F.count_distinct("user_id").alias("n_users")
    ).write.mode("overwrite").parquet(f"{folder}/types")


def stream_runs(spark, sf_dir):
    """Arrivals decided on and analysed together; one analysis fails, the others deliver."""
    folder = _watched_days(spark, sf_dir)
    gate = ArrivalGate(spark, folder, state_dir=fresh_path(spark, "gate"), max_files=1000, analysis=_users_by_type)
    gate.run_available()
    delivered = spark.read.parquet(f"{gate.deliverables_dir}/*/types").groupBy(
        _day_of("_metadata.file_path")
    ).agg(F.sum("n_users").alias("n_users"))
    outcomes = gate.outcomes().select(_day_of("path"), "status", "error")
    return gate.decisions().select(_day_of("path"), "n", "reason", "should_run").join(outcomes, "day", "left").join(
        delivered, "day", "left"
    )


def stream_history(spark, sf_dir):
    """A gate that starts with the counts of earlier days decides the later ones as if it had seen all."""
    folder = _watched_days(spark, sf_dir, first="2024-01-12")
    earlier = _daily_events(spark, sf_dir).where("day <= DATE '2024-01-12'")
    history = earlier.select(F.col("day").cast("timestamp").alias("modified"), "n")
    gate = ArrivalGate(
        spark, folder, state_dir=fresh_path(spark, "gate"), require_approval=True, max_files=1000, history=history
    )
    gate.run_available()
    return gate.decisions().select(_day_of("path"), "n", "reason", "anomaly", "z_score", "should_run")


def stream_unreadable(spark, sf_dir):
    """Files that cannot be read are told apart with a reason and leave no trace in the decisions."""
    folder = fresh_path(spark, "watched")
    table(spark, sf_dir, "nation").coalesce(1).write.options(**CSV_WRITE).csv(f"{folder}/a")
    table(spark, sf_dir, "region").coalesce(1).write.json(f"{folder}/b")
    table(spark, sf_dir, "supplier").select(F.col("s_name").alias("value")).coalesce(1).write.text(f"{folder}/c")
    table(spark, sf_dir, "region").coalesce(1).write.parquet(f"{folder}/d")
    targets = {"a": "nation.csv", "b": "region.json", "c": "supplier.parquet", "d": "region.PARQUET"}
    for source, name in targets.items():
        _move(spark, f"{folder}/{source}", f"{folder}/in/{name}")
    gate = ArrivalGate(spark, f"{folder}/in", state_dir=fresh_path(spark, "gate"), require_approval=True, max_files=10)
    gate.run_available()
    decided = gate.decisions().select("path", F.lit(True).alias("decided"))
    reasons = gate.unreadable().select("path", F.col("error").isNotNull().alias("told"))
    return gate.arrivals().join(decided, "path", "left").join(reasons, "path", "left").select(
        F.substring_index("path", "/", -1).alias("file"), "n", "status",
        F.coalesce("decided", F.lit(False)).alias("decided"), F.coalesce("told", F.lit(False)).alias("told"),
    )


def stream_deliverables(spark, sf_dir):
    """What an automatic run leaves behind, named after its file: the weekly metric and the tests."""
    folder = fresh_path(spark, "watched")
    table(spark, sf_dir, "events").drop("props").coalesce(1).write.parquet(f"{folder}/staged")  # one arriving file
    _move(spark, f"{folder}/staged", f"{folder}/in/events.parquet")
    gate = ArrivalGate(spark, f"{folder}/in", state_dir=fresh_path(spark, "gate"))
    gate.run_available()
    name = F.regexp_extract("_metadata.file_path", r"/([^/]+)_[0-9a-f]{64}/", 1).alias("file")
    metric = spark.read.parquet(f"{gate.deliverables_dir}/*/metric").select(
        name, F.col("week").cast("string").alias("item"), F.col("value").cast("bigint").alias("value")
    )
    tests = spark.read.parquet(f"{gate.deliverables_dir}/*/drivers").where("dimension = 'event_type'").select(
        name, F.col("category").alias("item"), F.col("n").cast("bigint").alias("value")
    )
    return metric.unionByName(tests)


def join_spec_errors(spark, sf_dir):
    """Every fault of a join tree at once, as rows."""
    names = ("orders", "customer", "nation", "region", "part")
    tables = {name: table(spark, sf_dir, name) for name in names}
    joins = [
        ("customer", "orders", "c_custkey", "o_custkey", "inner"), ("customer", "orders", "c_custkey", "o_custkey", "left"),
        ("nation", "customer", "n_nationkey", "c_name", "inner"), ("region", "nation", "r_regionkey", "n_missing", "outer"),
        ("supplier", "lineitem", "s_suppkey", "l_suppkey", "inner"),
    ]
    keys = ("file", "on_file", "file_column", "on_column", "how")
    spec = {"root": "orders", "joins": [dict(zip(keys, j, strict=True)) for j in joins]}
    found = spec_errors(spark, tables, spec).select("position", "fault", "subject")
    sizes = source_row_counts(tables).select(F.col("source").alias("subject"), "n")
    return found.join(sizes, "subject", "left")


# -- files, text ------------------------------------------------------------------------------


def file_counts(spark, sf_dir):
    paths = [f"{sf_dir}/{name}.parquet" for name in TABLES]
    return file_row_counts(spark, paths).select(
        F.substring_index("path", "/", -1).alias("file"), "n"
    )


def csv_roundtrip(spark, sf_dir):
    """Cleaned export of the part table, then loaded with inferred types."""
    folder = fresh_path(spark, "csv")
    (path,) = write_cleaned({"part.csv": table(spark, sf_dir, "part")}, folder)
    return read_csv(spark, path)


def csv_robust(spark, sf_dir):
    """A semicolon export in Latin-1, read back with encoding and delimiter found."""
    path = fresh_path(spark, "csv-latin1")
    documents = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    named = documents.withColumn("note", F.concat(F.lit("é"), "lang"))
    named.write.option("header", True).option("sep", ";").option("encoding", "ISO-8859-1").csv(path)
    frame, encoding = read_csv_robust(spark, path)
    return frame.groupBy("lang", "note").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("n_chars").cast("bigint")).alias("n_chars")
    ).withColumn("encoding", F.lit(encoding))


def csv_quoted(spark, sf_dir):
    """Semicolon files with commas in every name and line breaks in every note, dialect found."""
    path = fresh_path(spark, "csv-quoted")
    docs = table(spark, sf_dir, "documents")
    name = F.concat(F.upper("source"), F.lit(", "), "lang")
    note = F.concat(F.lit('"1, 2"\n'), F.col("text"), F.lit(",\n\n;, end"))
    docs.select("doc_id", name.alias("name"), note.alias("note")).write.options(**CSV_WRITE).option("sep", ";").csv(path)
    frame, _ = read_csv_robust(spark, path)
    return frame.select(F.col("doc_id").cast("bigint").alias("doc_id"), "name", "note")


def _awkward_texts(spark, sf_dir) -> DataFrame:
    """Document texts between quotes, separators, line breaks, backslashes and edge spaces."""
    text = F.concat(F.lit('  "a", \\" ;\t'), "text", F.lit('\n\\n""\\  '))
    return table(spark, sf_dir, "documents").select("doc_id", text.alias("text"), "lang")


def csv_texts(spark, sf_dir):
    """Whole texts written and read again, to the character."""
    path = fresh_path(spark, "csv-texts")
    _awkward_texts(spark, sf_dir).write.options(**CSV_WRITE).csv(path)
    return read_csv(spark, path)


def csv_folder(spark, sf_dir):
    """One table in two files of different encodings, accents right before the separator."""
    path = fresh_path(spark, "csv-mixed")
    documents = table(spark, sf_dir, "documents")
    plain = documents.where("doc_id % 2 = 0").select("doc_id", F.lit("cafe").alias("note"), "n_chars")
    latin = documents.where("doc_id % 2 = 1").select("doc_id", F.lit("café").alias("note"), "n_chars")
    for part, encoding in ((plain, "UTF-8"), (latin, "ISO-8859-1")):
        part.write.mode("append").option("sep", ";").option("encoding", encoding).option("header", True).csv(path)
    frame, encoding = read_csv_robust(spark, path)
    return frame.groupBy("note").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("n_chars").cast("bigint")).alias("n_chars")
    ).withColumn("encoding", F.lit(encoding))


def csv_record_counts(spark, sf_dir):
    """Records counted without parsing are the rows a reader finds."""
    path = fresh_path(spark, "csv-counted")
    _awkward_texts(spark, sf_dir).write.options(**CSV_WRITE).csv(path)
    counted = csv_row_counts(spark, [path]).agg(F.sum("n").alias("n"))
    return counted.select(F.lit("counted").alias("how"), "n").unionByName(
        read_csv(spark, path).agg(F.count(F.lit(1)).alias("n")).select(F.lit("read").alias("how"), "n")
    )


def file_flow(spark, sf_dir):
    """Several exports cleaned, described and written; one that is missing fails alone."""
    folder = fresh_path(spark, "incoming")
    raw_orders(spark, sf_dir).write.options(**CSV_WRITE).csv(f"{folder}/orders.csv")
    table(spark, sf_dir, "part").write.options(**CSV_WRITE).csv(f"{folder}/part.csv")
    files = [f"{folder}/{n}.csv" for n in ("orders", "missing", "part")]
    return process_files(spark, files, fresh_path(spark, "processed")).select(
        F.element_at(F.split("file", "/"), -1).alias("file"), "status", "n_rows", "n_columns"
    )


def stream_decisions(spark, sf_dir):
    """Daily counts as a stream of arrivals in a fixed order; the batch SQL decides the same."""
    folder = fresh_path(spark, "arrivals")
    daily = _daily_events(spark, sf_dir).select(
        F.lit("events").alias("source"), F.col("day").cast("string").alias("path"),
        F.col("day").cast("timestamp").alias("modified"), "n", F.lit(0).cast("bigint").alias("batch_id"),
    )
    daily.repartition(1).write.parquet(f"{folder}/in")  # one small arrival file, one row a day
    stream = spark.readStream.schema(daily.schema).parquet(f"{folder}/in")

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch_id={batch_id}")

    decisions(stream).writeStream.foreachBatch(keep).option(
        "checkpointLocation", f"{folder}/checkpoint"
    ).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out").select(
        F.col("path").cast("date").alias("day"), "n", "reason", "anomaly", "z_score", "should_run"
    )


def join_sources(spark, sf_dir):
    """Rows per source that go with a joined analysis."""
    spec = {"root": "documents", "joins": [_step("labels", "doc_id", "documents", "doc_id", "left")]}
    analysis = analyze_joined(tables(spark, sf_dir, "documents", "labels"), spec)
    analysis.release()
    return analysis.join_sources


def report_tables(spark, sf_dir):
    """A whole report written, then its metric and test tables read back."""
    analysis = analyze(
        _events_with_bucket(spark, sf_dir), "user_id", dimensions=["event_type", "value_bucket"]
    )
    folder = fresh_path(spark, "report")
    paths = write_report(analysis, folder, "events", {}, "")
    metric = spark.read.parquet(paths["metric"]).select(
        F.lit("metric").alias("part"), F.col("week").cast("string").alias("item"), "value"
    )
    drivers = spark.read.parquet(paths["drivers"]).select(
        F.lit("drivers").alias("part"),
        F.concat_ws("=", F.col("dimension").cast("string"), "category").alias("item"),
        F.col("n").alias("value"),
    )
    return metric.unionByName(drivers)


def chunk_documents(spark, sf_dir):
    return chunk_text(table(spark, sf_dir, "documents"), "doc_id", "text")


def chunk_sizes(spark, sf_dir):
    chunks = chunk_text(table(spark, sf_dir, "documents"), "doc_id", "text")
    return chunks.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_chunks"), F.max(F.length("chunk")).alias("max_length")
    )


def _answers(spark, sf_dir) -> DataFrame:
    """Event properties wrapped the ways a chatty writer wraps JSON."""
    props, kind = F.col("props"), F.col("event_id") % 6
    fence, line = F.lit("```"), F.lit("\n")
    answer = (
        F.when(kind == 0, props)
        .when(kind == 1, F.concat(fence, F.lit("json"), line, props, line, fence))
        .when(kind == 2, F.concat(F.lit("Here it is: "), props, F.lit(" - done")))
        .when(kind == 3, F.concat(F.lit("Sure.\n"), fence, line, props, line, fence))
        .when(kind == 4, F.concat(F.lit("broken {"), props))
        .otherwise(F.lit("no answer"))
    )
    return table(spark, sf_dir, "events").select("event_id", answer.alias("answer"))


def json_extract(spark, sf_dir):
    extracted = extract_json(_answers(spark, sf_dir), "answer", "k bigint")
    return extracted.select("event_id", "strategy", F.col("parsed.k").alias("k"))


def json_extract_rate(spark, sf_dir):
    return parse_rate(extract_json(_answers(spark, sf_dir), "answer", "k bigint"))


def json_fields(spark, sf_dir):
    """Answers in the two structures the analysis asks for, built from conversation turns."""
    turns = table(spark, sf_dir, "conversations").where("text IS NOT NULL")
    framing = F.to_json(F.struct(F.col("text").alias("business_question")))
    advice = F.to_json(
        F.struct(F.array(F.struct(F.col("role").alias("title"))).alias("recommendations"))
    )
    wrapped = turns.select(
        "conv_id", "turn",
        F.concat(F.lit("Answer:\n```json\n"), framing, F.lit("\n```")).alias("framing"),
        advice.alias("advice"),
    )
    framed = extract_json(wrapped, "framing", FRAMING_SCHEMA).select(
        "conv_id", "turn", "advice",
        F.col("parsed.business_question").alias("business_question"),
    )
    advised = extract_json(framed, "advice", RECOMMENDATIONS_SCHEMA)
    title = F.get(F.col("parsed.recommendations"), F.lit(0))["title"]
    return advised.select("conv_id", "turn", "business_question", title.alias("title"))


# -- guarded SQL ------------------------------------------------------------------------------


def _guarded(sql: str) -> Query:
    used = [name for name in TABLES if re.search(rf"\b{name}\b", sql)]

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        for name in used:
            table(spark, sf_dir, name).createOrReplaceTempView(name)
        return run_read_only(spark, sql)

    return query


def queries() -> dict[str, Query]:
    own: list[Query] = [
        weekly_metric, weekly_rows, metric_total, joined_weekly_metric, topk_entities,
        driver_breakdown, driver_auto, driver_all_dimensions, driver_errors, driver_chi2,
        driver_skipped, driver_significant,
        driver_findings, inspect_dates, inspect_nulls, inspect_summary, inspect_summary_joined,
        duplicate_groups, dedup_rows, profile_numeric, profile_bigint, profile_columns, describe_numeric,
        describe_datetime, describe_categories, describe_texts, validation, join_inner, join_left, joined_prefix,
        join_tree, join_diagnosis, reconcile_values, reconcile_summary, clean_trim,
        clean_empty_rows, clean_decimal, clean_numeric, clean_dates, clean_report, neutralize,
        hostile_header, zscore_daily, zscore_by_type, zscore_long_series, arrival_gate,
        approval_resolution, approval_unknown, stream_gate, stream_runs, stream_history,
        stream_unreadable, stream_deliverables, join_spec_errors, file_counts, csv_roundtrip, csv_robust, csv_quoted,
        csv_texts, csv_folder, csv_record_counts, file_flow, stream_decisions, join_sources,
        report_tables, chunk_documents, chunk_sizes, json_extract, json_extract_rate, json_fields,
    ]
    named = {query.__name__: query for query in own}
    guarded = {name: _guarded(check.spark) for name, check in SQL_CHECKS.items()}
    whole = {"guarded_sql_full": _guarded("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem")}
    return named | guarded | whole
