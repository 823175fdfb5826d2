"""The catalog queries in plain SQL, for checking results against another engine."""

from __future__ import annotations

from tableinsight.plans.catalog import TABLES
from tableinsight.plans.sql_checks import SQL_CHECKS

_LINEITEM_NUMBERS = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
    "l_discount", "l_tax",
]
_CUSTOMER = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]

_LABELLED = """
  SELECT d.doc_id AS documents__doc_id, d.text AS documents__text, d.lang AS documents__lang,
         d.source AS documents__source, d.n_chars AS documents__n_chars,
         l.doc_id AS labels__doc_id, l.quality AS labels__quality, l.toxic AS labels__toxic
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id"""


def _union(parts: list[str]) -> str:
    return " UNION ALL ".join(parts)


def _shares(table: str, dimension: str, value: str = "count(*)") -> str:
    return (
        f"SELECT '{dimension}' AS dimension, CAST({dimension} AS VARCHAR) AS category, "
        f"{value} AS n FROM {table} GROUP BY 2"
    )


def _tests(counts: str, limit: int | None = None) -> str:
    """Per dimension: categories, statistic, and the tail as one minus terms from log-gamma."""
    term = "exp((k1 / 2.0 + i) * ln(x / 2) - x / 2 - lgamma(k1 / 2.0 + i + 1))"
    tested = f"n_categories <= {limit}" if limit else "TRUE"
    return f"""
    WITH counts AS ({counts}),
    expected AS (SELECT dimension, n, avg(n) OVER (PARTITION BY dimension) AS e FROM counts),
    sums AS (SELECT dimension, count(*) AS n_categories, count(*) - 1 AS k1,
                    sum((n - e) * (n - e) / e) AS x FROM expected GROUP BY dimension),
    tails AS (
      SELECT *, CASE WHEN NOT ({tested}) THEN NULL WHEN x = 0 THEN 1.0
               WHEN x > k1 + 20 * sqrt(2 * k1) + 400 THEN 0.0
               ELSE abs(1 - list_sum([{term} FOR i IN range(0, CAST(x AS BIGINT) + 200)])) END AS tail
      FROM sums),
    tests AS (
      SELECT dimension, n_categories,
             CASE WHEN {tested} THEN 'tested' ELSE 'skipped' END AS status,
             CASE WHEN {tested} THEN round(x, 3) END AS chi2,
             round(tail, 4) AS p_value, tail < 0.05 AS significant
      FROM tails)"""


_FOUR_TESTS = _tests(
    _union(
        [
            _shares("part", "p_brand"), _shares("part", "p_type"),
            _shares("documents", "lang"), _shares("documents", "source"),
        ]
    )
)

_BUCKETED = """SELECT 'event_type' AS dimension, event_type AS category, user_id FROM events
  UNION ALL SELECT 'value_bucket', CAST(CAST(floor(value / 50) AS BIGINT) AS VARCHAR), user_id
  FROM events"""


def _profile(column: str) -> str:
    stats = {
        "min": f"min({column})", "max": f"max({column})", "mean": f"avg({column})",
        "median": f"median({column})", "stddev": f"stddev_samp({column})",
    }
    rounded = ", ".join(f"round(CAST({e} AS DOUBLE), 6) AS {n}" for n, e in stats.items())
    return f"SELECT '{column}' AS column_name, {rounded} FROM lineitem"


def _description(column: str) -> str:
    stats = {
        "mean": f"avg({column})", "std": f"stddev_samp({column})", "min": f"min({column})",
        "p25": f"quantile_cont({column}, 0.25)", "p50": f"quantile_cont({column}, 0.5)",
        "p75": f"quantile_cont({column}, 0.75)", "max": f"max({column})",
    }
    rounded = ", ".join(f"round(CAST({e} AS DOUBLE), 6) AS {n}" for n, e in stats.items())
    return f'SELECT \'{column}\' AS column_name, count({column}) AS "count", {rounded} FROM customer'


def _categories(column: str, table: str = "orders") -> str:
    return f"""SELECT '{column}' AS column_name, CAST(sum(n) AS BIGINT) AS "count",
      count(*) AS "unique", arg_min(v, (-n, v)) AS top, max(n) AS freq
      FROM (SELECT {column} AS v, count(*) AS n FROM {table} WHERE {column} IS NOT NULL GROUP BY 1) t"""


def _diagnosis(case: str, rows: str, sources: list[str]) -> str:
    largest = "greatest(" + ", ".join(f"(SELECT count(*) FROM {s})" for s in sources) + ")"
    return f"""SELECT '{case}' AS "case", row_count, largest_source,
      CASE WHEN row_count = 0 THEN 'empty' WHEN row_count > 3 * largest_source THEN 'explosion'
           ELSE 'ok' END AS status
      FROM (SELECT ({rows}) AS row_count, {largest} AS largest_source) t"""


_RECONCILED = """
  WITH trusted AS (SELECT DISTINCT round(o_totalprice, 2) AS value FROM orders),
  checked AS (SELECT DISTINCT round(CASE WHEN o_orderstatus = 'P' THEN o_totalprice + 0.25
                                    ELSE o_totalprice END, 2) AS value FROM orders),
  bad AS (SELECT value FROM checked WHERE value NOT IN (SELECT value FROM trusted)
          AND abs(value) > 0.01)"""

# What cleaning makes of the careless export; the copies and the empty rows are gone.
_CODE = "lpad(CAST(o_orderkey AS VARCHAR), 9, '0')"
_PRIORITY = "CASE WHEN o_orderkey % 7 <> 0 THEN o_orderpriority END"


def _scores(order: str, series: str = "") -> str:
    over = f"OVER ({'PARTITION BY ' + series if series else ''} ORDER BY {order} ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)"
    return f"""
    stats AS (SELECT *, count(v) {over} AS c, avg(v) {over} AS m, stddev_pop(v) {over} AS s
              FROM series_values),
    z AS (SELECT *, CASE WHEN c >= 3 AND s > 0 THEN (v - m) / s END AS z FROM stats),
    scored AS (
      SELECT *, CASE WHEN c < 3 THEN 'pas_assez_de_donnees' WHEN s = 0 THEN 'pas_de_variance' END AS reason,
             coalesce(abs(z) > 2, false) AS anomaly,
             CASE WHEN z IS NOT NULL THEN round(m, 4) END AS moyenne,
             CASE WHEN z IS NOT NULL THEN round(s, 4) END AS ecart_type,
             round(z, 4) AS z_score,
             CASE WHEN z > 0 THEN 'hausse' WHEN z IS NOT NULL THEN 'baisse' END AS direction,
             CASE WHEN abs(z) > 3 THEN 'elevee' WHEN abs(z) > 2 THEN 'moyenne'
                  WHEN z IS NOT NULL THEN 'faible' END AS severite
      FROM z)"""


def _daily(series: str = "") -> str:
    head = f"{series}, " if series else ""
    keys = f"{head}CAST(ts AS DATE)"
    return f"""WITH series_values AS (
      SELECT {head}day, n, CAST(n AS DOUBLE) AS v FROM (
        SELECT {head}CAST(ts AS DATE) AS day,
               CASE WHEN CAST(ts AS DATE) = DATE '2024-01-20' THEN count(*) * 10
                    ELSE count(*) END AS n
        FROM events GROUP BY {keys}) d),"""


_SCORES = "reason, anomaly, moyenne, ecart_type, z_score, direction, severite"
_RUNS = f"""{_daily()} {_scores("day")},
  runs AS (SELECT 'stream-' || strftime(day, '%Y-%m-%d') AS run_id, day, n FROM scored
           WHERE anomaly OR reason = 'pas_assez_de_donnees')"""

_CHUNKED = r"""
  WITH RECURSIVE paragraphs AS (
    SELECT doc_id, p, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS i
    FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS p,
                 generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) t
    WHERE regexp_matches(p, '\S')),
  packed AS (
    SELECT doc_id, i, p, length(p) AS size, 0 AS chunk_no FROM paragraphs WHERE i = 1
    UNION ALL
    SELECT n.doc_id, n.i, n.p,
           CASE WHEN c.size + length(n.p) > 700 THEN length(n.p) ELSE c.size + length(n.p) END,
           CASE WHEN c.size + length(n.p) > 700 THEN c.chunk_no + 1 ELSE c.chunk_no END
    FROM packed c JOIN paragraphs n ON n.doc_id = c.doc_id AND n.i = c.i + 1),
  chunks AS (
    SELECT doc_id, chunk_no, string_agg(p, chr(10) ORDER BY i) AS chunk FROM packed
    GROUP BY doc_id, chunk_no
    UNION ALL
    SELECT doc_id, 0, '' FROM documents WHERE text IS NOT NULL AND NOT regexp_matches(text, '\S'))"""

_ANSWERS = r"""
  WITH answers AS (
    SELECT event_id, CASE event_id % 6 WHEN 0 THEN props
      WHEN 1 THEN '```json' || chr(10) || props || chr(10) || '```'
      WHEN 2 THEN 'Here it is: ' || props || ' - done'
      WHEN 3 THEN 'Sure.' || chr(10) || '```' || chr(10) || props || chr(10) || '```'
      WHEN 4 THEN 'broken {' || props ELSE 'no answer' END AS answer FROM events),
  found AS (
    SELECT event_id, answer,
      nullif(regexp_extract(answer, '(?s)```(?:json)?\s*(\{.*?\})\s*```', 1), '') AS fenced,
      nullif(regexp_extract(answer, '(?s)\{.*\}', 0), '') AS braces FROM answers),
  chosen AS (
    SELECT event_id,
      CASE WHEN coalesce(json_valid(fenced), false) THEN 'fenced' WHEN json_valid(answer) THEN 'whole'
           WHEN coalesce(json_valid(braces), false) THEN 'braces' ELSE 'none' END AS strategy,
      CASE WHEN coalesce(json_valid(fenced), false) THEN fenced WHEN json_valid(answer) THEN answer
           WHEN coalesce(json_valid(braces), false) THEN braces END AS raw FROM found)"""

_STAR_JOIN = """lineitem JOIN orders ON o_orderkey = l_orderkey
  JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
  LEFT JOIN part ON p_partkey = l_partkey"""


def oracle_sql() -> dict[str, str]:
    sql = {
        "weekly_metric": """SELECT CAST(date_trunc('week', ts) AS DATE) AS week,
            count(DISTINCT user_id) AS value FROM events GROUP BY 1""",
        "weekly_rows": """SELECT CAST(date_trunc('week', o_orderdate) AS DATE) AS week,
            count(*) AS value FROM orders GROUP BY 1""",
        "metric_total": "SELECT count(DISTINCT p_partkey) AS value FROM part",
        "joined_weekly_metric": """SELECT CAST(date_trunc('week', o_orderdate) AS DATE) AS week,
            count(DISTINCT o_custkey) AS value
            FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1""",
        "topk_entities": """SELECT user_id, count(*) AS n FROM events GROUP BY user_id
            ORDER BY n DESC, user_id LIMIT 5""",
        "driver_breakdown": f"""WITH long AS ({_BUCKETED}),
            counts AS (SELECT dimension, category, count(DISTINCT user_id) AS n
                       FROM long GROUP BY dimension, category)
            SELECT dimension, category, n FROM counts""",
        "driver_auto": _tests(
            _union(
                [
                    _shares("orders", c, "count(DISTINCT o_orderkey)")
                    for c in ("o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
                ]
            ),
            limit=30,
        )
        + " SELECT dimension, status, n_categories, chi2, p_value, significant FROM tests",
        "driver_all_dimensions": _tests(
            _union(
                [
                    _shares("lineitem", c, "count(DISTINCT l_orderkey)")
                    for c in ("l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                              "l_discount", "l_tax", "l_returnflag", "l_linestatus")
                ]
            )
        )
        + " SELECT dimension, status, n_categories, chi2, p_value, significant FROM tests",
        "driver_errors": _tests(_union([_shares("part", "p_type"), _shares("part", "p_brand")]))
        + """ SELECT dimension, status, n_categories, chi2, CAST(NULL AS VARCHAR) AS error FROM tests
            UNION ALL SELECT 'no_such', 'error', NULL, NULL, 'column no_such not found'
            UNION ALL SELECT 'p_size', 'left_out', NULL, NULL, NULL""",
        "guarded_sql_full": "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem",
        "driver_chi2": _FOUR_TESTS
        + " SELECT dimension, n_categories, chi2, p_value, significant FROM tests",
        "driver_skipped": """SELECT dimension, CASE WHEN n_categories > 30 THEN 'skipped'
            ELSE 'tested' END AS status, n_categories FROM (
              SELECT 'p_size' AS dimension, count(DISTINCT p_size) AS n_categories FROM part
              UNION ALL SELECT 'p_brand', count(DISTINCT p_brand) FROM part) t""",
        "driver_significant": _FOUR_TESTS
        + " SELECT dimension, n_categories, chi2 FROM tests WHERE significant",
        "driver_findings": _FOUR_TESTS
        + """ SELECT dimension, dimension || ' : p=' || CAST(CAST(p_value AS DOUBLE) AS VARCHAR)
            || CASE WHEN significant THEN ' (significatif)' ELSE ' (non significatif)' END AS finding
            FROM tests""",
        "inspect_dates": """SELECT 'ts' AS column_name, CAST(min(ts) AS VARCHAR) AS min,
            CAST(max(ts) AS VARCHAR) AS max FROM events""",
        "inspect_nulls": f"""WITH joined AS ({_LABELLED}) SELECT * FROM ("""
        + _union(
            [
                f"SELECT '{c}' AS column_name, count(*) - count({c}) AS n_nulls FROM joined"
                for c in ("documents__doc_id", "documents__text", "documents__lang",
                          "documents__source", "documents__n_chars", "labels__doc_id",
                          "labels__quality", "labels__toxic")
            ]
        )
        + ") t WHERE n_nulls > 0",
        "inspect_summary": """SELECT count(*) AS row_count, 6 AS n_columns,
            (SELECT count(*) FROM (SELECT 1 FROM events GROUP BY event_id, ts, user_id, event_type,
               value, props HAVING count(*) > 1) g) AS duplicate_groups,
            0 AS n_columns_with_nulls, 'event_id' AS id_column, 'ts' AS date_columns,
            count(*) > 10000 AS needs_aggregation FROM events""",
        "inspect_summary_joined": f"""WITH joined AS ({_LABELLED})
            SELECT count(*) AS row_count, 8 AS n_columns,
            (SELECT count(*) FROM (SELECT * FROM joined GROUP BY ALL HAVING count(*) > 1) g)
              AS duplicate_groups,
            CAST(count(*) > count(labels__doc_id) AS INTEGER) * 3 AS n_columns_with_nulls,
            'documents__doc_id' AS id_column, '' AS date_columns,
            count(*) > 10000 AS needs_aggregation FROM joined""",
        "duplicate_groups": _union(
            [
                f"""SELECT '{source}' AS source, CAST(sum(n) AS BIGINT) AS row_count,
                count(*) FILTER (n > 1) AS duplicate_groups,
                CAST(sum(n - 1) AS BIGINT) AS excess_rows
                FROM (SELECT count(*) AS n FROM {source} GROUP BY {keys}) g"""
                for source, keys in (("documents", "text"), ("events", "user_id, event_type"))
            ]
        ),
        "dedup_rows": "SELECT DISTINCT text, lang FROM documents",
        "profile_numeric": _union([_profile(c) for c in _LINEITEM_NUMBERS]),
        "profile_columns": _union(
            [
                f"SELECT '{c}' AS column_name, any_value(typeof({c})) AS column_type, "
                f"count(*) - count({c}) AS n_nulls FROM customer"
                for c in _CUSTOMER
            ]
        ),
        "describe_numeric": _union([_description(c) for c in ("c_custkey", "c_nationkey", "c_acctbal")]),
        "describe_datetime": """SELECT 'ts' AS column_name, count(ts) AS "count",
            CAST(min(ts) AS VARCHAR) AS min, CAST(max(ts) AS VARCHAR) AS max,
            CAST(floor(quantile_cont(epoch_us(ts), 0.25) / 1000000) AS BIGINT) AS p25,
            CAST(floor(quantile_cont(epoch_us(ts), 0.5) / 1000000) AS BIGINT) AS p50,
            CAST(floor(quantile_cont(epoch_us(ts), 0.75) / 1000000) AS BIGINT) AS p75 FROM events""",
        "describe_categories": _union([_categories(c) for c in ("o_orderstatus", "o_orderpriority")]),
        "describe_texts": _union([_categories(c, "documents") for c in ("text", "lang", "source")]),
        "validation": """SELECT 'total_entites' AS "check",
              CAST(count(DISTINCT user_id) AS VARCHAR) AS result, true AS passed FROM events
            UNION ALL SELECT 'plage_dates',
              CAST(min(ts) AS VARCHAR) || ' .. ' || CAST(max(ts) AS VARCHAR), true FROM events
            UNION ALL SELECT 'doublons', CAST(count(*) AS VARCHAR), count(*) = 0 FROM (
              SELECT 1 FROM events GROUP BY event_id, ts, user_id, event_type, value, props
              HAVING count(*) > 1) g""",
        "join_inner": """SELECT o_orderkey AS orders__o_orderkey, c_name AS customer__c_name,
            c_mktsegment AS customer__c_mktsegment
            FROM orders JOIN customer ON c_custkey = o_custkey""",
        "join_left": f"""SELECT documents__doc_id, labels__quality, labels__toxic
            FROM ({_LABELLED}) t""",
        "joined_prefix": """SELECT n_nationkey AS nation__n_nationkey, n_name AS nation__n_name,
            n_regionkey AS nation__n_regionkey, r_regionkey AS region__r_regionkey,
            r_name AS region__r_name, s_suppkey AS supplier__s_suppkey,
            s_name AS supplier__s_name, s_nationkey AS supplier__s_nationkey,
            s_acctbal AS supplier__s_acctbal
            FROM supplier JOIN nation ON n_nationkey = s_nationkey
            JOIN region ON r_regionkey = n_regionkey""",
        "join_tree": f"""SELECT n_name AS nation, p_type AS part_type, count(*) AS n,
            sum(l_quantity) AS quantity, count(DISTINCT c_custkey) AS customers
            FROM {_STAR_JOIN} GROUP BY n_name, p_type""",
        "join_diagnosis": _union(
            [
                _diagnosis(
                    "healthy", "SELECT count(*) FROM orders JOIN customer ON c_custkey = o_custkey",
                    ["orders", "customer"],
                ),
                _diagnosis(
                    "empty", "SELECT count(*) FROM customer JOIN part ON p_name = c_name",
                    ["customer", "part"],
                ),
                _diagnosis(
                    "exploding",
                    """SELECT CAST(coalesce(sum(c.n * s.n), 0) AS BIGINT) FROM
                    (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1) c JOIN
                    (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) s
                    ON c.k = s.k""",
                    ["customer", "supplier"],
                ),
                _diagnosis(
                    "star", f"SELECT count(*) FROM {_STAR_JOIN}",
                    ["lineitem", "orders", "customer", "nation", "part"],
                ),
            ]
        ),
        "reconcile_values": f"{_RECONCILED} SELECT value FROM bad",
        "reconcile_summary": f"""{_RECONCILED} SELECT
            (SELECT count(*) FROM trusted) AS trusted_count,
            (SELECT count(*) FROM checked) AS checked_count,
            (SELECT count(*) FROM bad) AS inconsistency_count,
            (SELECT count(*) FROM bad) = 0 AS passed""",
        "clean_trim": f"SELECT {_CODE} AS code, {_PRIORITY} AS priority FROM orders",
        "clean_empty_rows": """SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS n_empty,
            'code,customer,amount,order_date,priority' AS columns FROM orders""",
        "clean_decimal": f"SELECT {_CODE} AS code, o_totalprice AS amount FROM orders",
        "clean_numeric": f"SELECT {_CODE} AS code, o_custkey AS customer FROM orders",
        "clean_dates": f"SELECT {_CODE} AS code, CAST(o_orderdate AS DATE) AS order_date FROM orders",
        "clean_report": """SELECT
            count(*) + count(*) FILTER (o_orderkey % 10 = 5) + count(*) FILTER (o_orderkey % 10 = 3)
              AS original_rows,
            6 AS original_cols, count(*) AS final_rows, 5 AS final_cols,
            count(*) FILTER (o_orderkey % 10 = 3) AS empty_rows_removed,
            count(*) FILTER (o_orderkey % 10 = 5) AS duplicates_removed,
            'amount' AS columns_converted_decimal,
            'customer,amount' AS columns_converted_numeric,
            'order_date' AS columns_converted_date, 'priority' AS missing_columns,
            count(*) FILTER (o_orderkey % 7 = 0) AS missing_count FROM orders""",
        "neutralize": """SELECT p_partkey, p_brand, CASE WHEN p_partkey % 7 = 0
            THEN '''=' || p_name ELSE p_name END AS "'=label" FROM part""",
        "hostile_header": """SELECT CAST(date_trunc('week', ts) AS DATE) AS week,
            count(DISTINCT user_id) AS value FROM events GROUP BY 1""",
        "zscore_daily": f"{_daily()} {_scores('day')} SELECT day, n, {_SCORES} FROM scored",
        "zscore_by_type": f"""{_daily("event_type")} {_scores("day", "event_type")}
            SELECT event_type, day, n, {_SCORES} FROM scored""",
        "zscore_long_series": f"""WITH series_values AS (
              SELECT o_orderkey, o_orderstatus, o_totalprice AS v FROM orders),
            {_scores("o_orderkey", "o_orderstatus")}
            SELECT o_orderkey, o_orderstatus, reason, anomaly, z_score, direction FROM scored""",
        "arrival_gate": f"""{_daily()} {_scores("day")} SELECT day, n, reason, anomaly, z_score,
            anomaly OR coalesce(reason = 'pas_assez_de_donnees', false) AS should_run
            FROM scored""",
        "stream_runs": f"""{_daily()} {_scores("day")}, delivered AS (
              SELECT day, CAST(sum(u) AS BIGINT) AS n_users FROM (
                SELECT CAST(ts AS DATE) AS day, event_type, count(DISTINCT user_id) AS u FROM events GROUP BY 1, 2) t
              GROUP BY day),
            decided AS (SELECT day, n, reason,
              anomaly OR coalesce(reason = 'pas_assez_de_donnees', false) AS should_run FROM scored)
            SELECT day, n, reason, should_run,
              CASE WHEN should_run THEN CASE WHEN day = DATE '2024-01-02' THEN 'failed' ELSE 'done' END END AS status,
              CASE WHEN should_run AND day = DATE '2024-01-02' THEN 'refused for the sake of the other runs' END AS error,
              CASE WHEN should_run AND day <> DATE '2024-01-02' THEN n_users END AS n_users
            FROM decided JOIN delivered USING (day)""",
        "stream_history": f"""{_daily()} {_scores("day")} SELECT day, n, reason, anomaly, z_score,
            anomaly OR coalesce(reason = 'pas_assez_de_donnees', false) AS should_run
            FROM scored WHERE day > DATE '2024-01-12'""",
        "stream_unreadable": """SELECT 'nation.csv' AS file, count(*) AS n, 'counted' AS status, true AS decided,
              false AS told FROM nation
            UNION ALL SELECT 'region.json', count(*), 'counted', true, false FROM region
            UNION ALL SELECT 'region.PARQUET', count(*), 'counted', true, false FROM region
            UNION ALL SELECT 'supplier.parquet', NULL, 'unreadable', false, true""",
        "stream_deliverables": """SELECT 'events' AS file, CAST(CAST(date_trunc('week', ts) AS DATE) AS VARCHAR) AS item,
              count(DISTINCT event_id) AS value FROM events GROUP BY 2
            UNION ALL SELECT 'events', event_type, count(DISTINCT event_id) FROM events GROUP BY 2""",
        "join_spec_errors": """SELECT f.position, f.fault, f.subject, s.n FROM (VALUES
              (1, 'joined_twice', 'customer'), (2, 'key_types', 'nation.n_nationkey = customer.c_name'),
              (3, 'join_kind', 'outer'), (3, 'no_column', 'nation.n_missing'), (4, 'unknown_table', 'supplier'),
              (4, 'not_yet_joined', 'lineitem'), (-1, 'outside_tree', 'part')) AS f(position, fault, subject)
            LEFT JOIN (SELECT 'customer' AS subject, count(*) AS n FROM customer
              UNION ALL SELECT 'part', count(*) FROM part) s ON s.subject = f.subject""",
        "approval_resolution": f"""{_RUNS} SELECT run_id, n,
            CASE WHEN day(day) % 2 = 1 THEN 'approved' WHEN day = DATE '2024-01-20' THEN 'rejected'
                 ELSE 'pending' END AS status FROM runs""",
        "approval_unknown": f"""{_RUNS} SELECT run_id || '-late' AS run_id,
            'rejected' AS decision FROM runs WHERE day = DATE '2024-01-20'""",
        "file_counts": _union(
            [f"SELECT '{t}.parquet' AS file, count(*) AS n FROM {t}" for t in TABLES]
        ),
        "csv_roundtrip": """SELECT p_partkey, p_name, p_brand, p_type,
            CAST(p_size AS BIGINT) AS p_size, p_retailprice FROM part""",
        "csv_robust": """SELECT lang, 'é' || lang AS note, count(*) AS n,
            CAST(sum(n_chars) AS BIGINT) AS n_chars, 'latin-1' AS encoding
            FROM documents GROUP BY lang""",
        "profile_bigint": """SELECT 'key' AS column_name,
            CAST(min(o_orderkey + 9007199254740992) AS VARCHAR) AS min_exact,
            CAST(max(o_orderkey + 9007199254740992) AS VARCHAR) AS max_exact FROM orders
            UNION ALL SELECT 'amount',
            CAST(min(o_orderkey + CAST('123456789012345678901.125' AS DECIMAL(30,3))) AS VARCHAR),
            CAST(max(o_orderkey + CAST('123456789012345678901.125' AS DECIMAL(30,3))) AS VARCHAR) FROM orders""",
        "csv_quoted": """SELECT doc_id, upper(source) || ', ' || lang AS name,
            '"1, 2"' || chr(10) || text || ',' || chr(10) || chr(10) || ';, end' AS note FROM documents""",
        "csv_texts": r"""SELECT doc_id, '  "a", \" ;' || chr(9) || text || chr(10) || '\n""\  ' AS text,
            lang FROM documents""",
        "csv_folder": """SELECT CASE WHEN doc_id % 2 = 0 THEN 'cafe' ELSE 'café' END AS note,
            count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS n_chars, 'latin-1' AS encoding
            FROM documents GROUP BY 1""",
        "csv_record_counts": """SELECT 'counted' AS how, count(*) AS n FROM documents
            UNION ALL SELECT 'read', count(*) FROM documents""",
        "file_flow": """SELECT 'orders.csv' AS file, 'ok' AS status,
            (SELECT count(*) FROM orders) AS n_rows, 5 AS n_columns
            UNION ALL SELECT 'missing.csv', 'erreur', NULL, NULL
            UNION ALL SELECT 'part.csv', 'ok', (SELECT count(*) FROM part), 6""",
        "join_sources": """SELECT 'documents' AS source, count(*) AS n FROM documents
            UNION ALL SELECT 'labels', count(*) FROM labels""",
        "report_tables": f"""WITH long AS ({_BUCKETED})
            SELECT 'metric' AS part, CAST(CAST(date_trunc('week', ts) AS DATE) AS VARCHAR) AS item,
                   count(DISTINCT user_id) AS value FROM events GROUP BY 2
            UNION ALL SELECT 'drivers', dimension || '=' || category, count(DISTINCT user_id)
            FROM long GROUP BY dimension, category""",
        "chunk_documents": f"{_CHUNKED} SELECT doc_id, chunk_no, chunk FROM chunks",
        "chunk_sizes": f"""{_CHUNKED} SELECT doc_id, count(*) AS n_chunks,
            max(length(chunk)) AS max_length FROM chunks GROUP BY doc_id""",
        "json_extract": f"""{_ANSWERS} SELECT event_id, strategy,
            CAST(json_extract_string(raw, '$.k') AS BIGINT) AS k FROM chosen""",
        "json_extract_rate": f"""{_ANSWERS} SELECT strategy, count(*) AS n FROM chosen
            GROUP BY strategy""",
        "json_fields": """SELECT conv_id, turn, text AS business_question, role AS title
            FROM conversations WHERE text IS NOT NULL""",
    }
    sql["stream_decisions"] = sql["arrival_gate"]
    return sql | {name: check.other or check.spark for name, check in SQL_CHECKS.items()}
