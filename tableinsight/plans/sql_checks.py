"""SELECT statements that exercise the guarded SQL entry point, one per kind of query.

``spark`` is run through the guard. ``other`` is the same query where another SQL dialect spells
it differently.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class SqlCheck:
    spark: str
    other: str | None = None


_STATUS = "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY "

SQL_CHECKS = {
    "guarded_sql": SqlCheck(
        """SELECT o_orderstatus, count(*) AS n, count(DISTINCT o_custkey) AS customers
        FROM orders GROUP BY o_orderstatus;"""
    ),
    "sql_group_by_all": SqlCheck(
        "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL"
    ),
    "sql_rollup": SqlCheck(_STATUS + "ROLLUP (o_orderstatus, o_orderpriority)"),
    "sql_cube": SqlCheck(_STATUS + "CUBE (o_orderstatus, o_orderpriority)"),
    "sql_grouping_sets": SqlCheck(
        _STATUS + "GROUPING SETS ((o_orderstatus), (o_orderpriority), ())"
    ),
    "sql_rank": SqlCheck(
        """SELECT c_nationkey, rnk, count(*) AS n, max(placed) AS most FROM (
          SELECT c_nationkey, placed, rank() OVER (PARTITION BY c_nationkey ORDER BY placed DESC) AS rnk
          FROM (SELECT c_nationkey, c_custkey, count(*) AS placed
                FROM customer JOIN orders ON c_custkey = o_custkey
                GROUP BY c_nationkey, c_custkey) per_customer) ranked
        WHERE rnk <= 3 GROUP BY c_nationkey, rnk"""
    ),
    "sql_running_sum": SqlCheck(
        """SELECT event_type, day, CAST(sum(n) OVER (PARTITION BY event_type ORDER BY day
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS running
        FROM (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n
              FROM events GROUP BY event_type, CAST(ts AS DATE)) d"""
    ),
    "sql_lag": SqlCheck(
        """SELECT day, n, n - lag(n) OVER (ORDER BY day) AS change
        FROM (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY CAST(ts AS DATE)) d"""
    ),
    "sql_union": SqlCheck(
        "SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier"
    ),
    "sql_intersect": SqlCheck(
        "SELECT c_nationkey AS nation FROM customer INTERSECT SELECT s_nationkey FROM supplier"
    ),
    "sql_except": SqlCheck(
        "SELECT n_nationkey AS nation FROM nation EXCEPT SELECT s_nationkey FROM supplier"
    ),
    "sql_semi": SqlCheck(
        """SELECT c_mktsegment, count(*) AS n FROM customer c
        WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey
                      AND o.o_orderpriority = '1-URGENT') GROUP BY c_mktsegment"""
    ),
    "sql_anti": SqlCheck(
        """SELECT c_mktsegment, count(*) AS n FROM customer c
        WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey
                          AND o.o_orderpriority = '1-URGENT') GROUP BY c_mktsegment"""
    ),
    "sql_full_outer": SqlCheck(
        """SELECT l.quality, count(*) AS n, count(d.doc_id) AS with_text
        FROM documents d FULL OUTER JOIN labels l ON d.doc_id = l.doc_id GROUP BY l.quality"""
    ),
    "sql_range_join": SqlCheck(
        """SELECT band, count(*) AS n FROM customer
        JOIN (VALUES ('debt', -1000.0, 0.0), ('low', 0.0, 3000.0), ('mid', 3000.0, 7000.0),
                     ('high', 7000.0, 100000.0)) AS b(band, lo, hi)
          ON c_acctbal >= lo AND c_acctbal < hi GROUP BY band"""
    ),
    "sql_scalar_strings": SqlCheck(
        """SELECT upper(substr(p_name, 1, 4)) AS head, replace(p_brand, 'Brand#', 'B') AS brand,
             length(concat(p_name, '-', p_type)) AS len, count(*) AS n
        FROM part WHERE lower(p_type) LIKE '%o%' GROUP BY 1, 2, 3 HAVING count(*) > 2"""
    ),
    "sql_scalar_dates": SqlCheck(
        """SELECT year(o_orderdate) AS y, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS q,
             count(*) AS n, CAST(min(o_orderdate) AS DATE) AS first_day
        FROM orders GROUP BY 1, 2"""
    ),
    "sql_scalar_math": SqlCheck(
        """SELECT l_returnflag, round(avg(abs(l_discount - 0.05)), 6) AS spread,
             round(sqrt(max(l_extendedprice)), 6) AS root, max(CAST(floor(l_tax * 100) AS BIGINT)) AS tax
        FROM lineitem GROUP BY l_returnflag"""
    ),
    "sql_json": SqlCheck(
        """SELECT event_type, sum(CAST(get_json_object(props, '$.k') AS BIGINT)) AS total
        FROM events GROUP BY event_type""",
        """SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total
        FROM events GROUP BY event_type""",
    ),
    "sql_correlated": SqlCheck(
        """SELECT p_brand, count(*) AS n FROM part p
        WHERE p_retailprice > (SELECT avg(q.p_retailprice) FROM part q WHERE q.p_brand = p.p_brand)
        GROUP BY p_brand"""
    ),
    "sql_cte": SqlCheck(
        """WITH sizes AS (SELECT l_orderkey, count(*) AS lines FROM lineitem GROUP BY l_orderkey),
             spread AS (SELECT lines, count(*) AS n FROM sizes GROUP BY lines)
        SELECT lines, n FROM spread"""
    ),
}
