from concurrent.futures import ThreadPoolExecutor

import pytest

from tableinsight.functions.text import FRAMING_SCHEMA, chunk_text, extract_json, parse_rate
from tableinsight.plans.guard import (
    QueryRefused,
    ensure_plain_tree,
    ensure_read_only,
    guarded_session,
    run_read_only,
    try_query,
)
from tableinsight.plans.sql_checks import SQL_CHECKS
from tableinsight.sources.catalog import health_check, table_schema


def _chunks(spark, text, **options):
    df = spark.createDataFrame([(1, text)], "doc_id int, text string")
    return [r.chunk for r in chunk_text(df, "doc_id", "text", **options).orderBy("chunk_no").collect()]


LIMIT = 700


@pytest.mark.parametrize(
    "text",
    [
        "", " \n\t\n", "single", "a\n\nb", "q" * 1900, "q" * 1900 + "\nshort\n" + "y" * 699,
        "\n".join("p" * (i * 41 % 390) for i in range(90)), "é" * 350 + "\n" + "ü" * 350 + "\nz",
        " \nend \n  indented", "w" * 701, "w" * 700 + "\nv",
    ],
)
def test_chunks(spark, text):
    """Nothing is lost, no chunk of several paragraphs is too long, none could take the next one."""
    chunks = _chunks(spark, text)
    paragraphs = [c.split("\n") for c in chunks]
    filled = [p for p in text.split("\n") if p.strip()]
    if not filled:
        assert chunks == [""]
        return
    assert [p for own in paragraphs for p in own] == filled
    size = [sum(map(len, own)) for own in paragraphs]
    assert all(n <= LIMIT for n, own in zip(size, paragraphs) if len(own) > 1)
    assert all(n + len(after[0]) > LIMIT for n, after in zip(size, paragraphs[1:]))


def test_small_chunks(spark):
    assert _chunks(spark, "aa\nbb\ncc", max_chars=4) == ["aa\nbb", "cc"]


ANSWERS = {
    '{"k": 1}': ("whole", 1),
    '```json\n{"k": 2}\n```': ("fenced", 2),
    'Sure:\n```\n{"k": 3}\n```\nBye': ("fenced", 3),
    'Here: {"k": 4}': ("braces", 4),
    '{"k": 5} and that is all': ("braces", 5),
    '```json\n{broken}\n``` {"k": 6}': ("none", None),
    'two {"k": 7} and {"k": 8}': ("none", None),
    "nothing here": ("none", None),
    "1, 2": ("none", None),
    "[1, 2]": ("whole", None),
    '{"k": 9}] and [{"k": 1}': ("none", None),
    '1], "x"] {"k": 1} ["': ("braces", 1),
    '{"k": 1}, "c4ca4238a0b923820dcc509a6f75849b"] [': ("braces", 1),
    '{"k": "many"}': ("whole", None),
    '{"k": null, "l": 2}': ("whole", None),
}


def test_json(spark):
    df = spark.createDataFrame([(a,) for a in ANSWERS], ["answer"])
    extracted = extract_json(df, "answer", "k bigint")
    found = {r.answer: (r.strategy, r.parsed.k if r.parsed else None) for r in extracted.collect()}
    assert found == ANSWERS
    assert {r.strategy: r.n for r in parse_rate(extracted).collect()}["fenced"] == 2


def test_one_parse_for_each_candidate(spark):
    """Fields come from the parse that found the strategy; nothing is parsed again."""
    df = spark.createDataFrame([(a,) for a in ANSWERS], ["answer"])
    extracted = extract_json(df, "answer", "k bigint").select("strategy", "raw", "parsed")
    plan = extracted._jdf.queryExecution().executedPlan().toString()
    assert plan.count("parseJson(") == 3 and "from_json" not in plan


@pytest.mark.parametrize("n", [2_000, 20_000])
def test_many_paragraphs(spark, n):
    """Each paragraph a chunk of its own, or a few to a chunk."""
    for size in (690, 30):
        paragraphs = [chr(97 + i % 26) * (size - i % 7) for i in range(n)]
        expected, room = [], 0
        for p in paragraphs:
            if expected and room + len(p) <= LIMIT:
                expected[-1] += "\n" + p
                room += len(p)
            else:
                expected.append(p)
                room = len(p)
        assert _chunks(spark, "\n".join(paragraphs)) == expected


def test_json_fields(spark):
    df = spark.createDataFrame([('{"business_question": "why", "assumptions": ["a", "b"]}',)], ["t"])
    parsed = extract_json(df, "t", FRAMING_SCHEMA).first().parsed
    assert (parsed.business_question, parsed.assumptions, parsed.metric_definition) == ("why", ["a", "b"], None)


@pytest.mark.parametrize(
    "sql",
    ["SELECT 1", "  select 1;", "WITH t AS (SELECT 1 AS a) SELECT a FROM t", "DESCRIBE t", "SHOW TABLES",
     "EXPLAIN SELECT 1", "SELECT * FROM a JOIN b USING (k)", "SELECT transform(array(1), x -> x + 1)",
     "SELECT add_months(d, 1) AS refreshed FROM t"],
)
def test_accepted(sql):
    assert ensure_read_only(sql) == sql.strip().rstrip(";")


@pytest.mark.parametrize(
    "sql",
    ["DROP TABLE t", "SELECT 1; SELECT 2", "INSERT INTO t VALUES (1)", "UPDATE t SET a = 1", "delete from t",
     "COPY t TO 'f'", "WITH x AS (SELECT 1) INSERT INTO t SELECT * FROM x", "SELECT 'load'", "PRAGMA x",
     "SELECT ';'", "SELECT reflect('java.lang.System', 'exit')", "SELECT java_method('a', 'b')",
     "SELECT TRANSFORM(a) USING 'cat' FROM t", "EXPLAIN TRUNCATE TABLE t", "EXPLAIN MERGE INTO t USING s ON 1=1",
     "WITH a AS (SELECT 1) MERGE INTO t USING a", "", "  -- SELECT"],
)
def test_refused(sql):
    with pytest.raises(QueryRefused):
        ensure_read_only(sql)


@pytest.mark.parametrize(
    "sql",
    ["SELECT TRANSFORM(a) USING /* x */ 'cat' FROM t", "SELECT TRANSFORM(a) USING -- x\n 'cat' FROM t",
     "SELECT TRANSFORM(a) USING r'cat' FROM t", "SELECT * FROM (SELECT TRANSFORM(a) USING 'cat' AS (b) FROM t)",
     "SELECT 'USING (' , TRANSFORM(a) USING R\"cat\" FROM t"],
)
def test_no_way_to_a_program(sql):
    with pytest.raises(QueryRefused):
        ensure_read_only(sql)


def test_results_are_whole_unless_asked(spark):
    spark.range(5000).createOrReplaceTempView("many")
    assert run_read_only(spark, "SELECT id FROM many").count() == 5000
    assert run_read_only(spark, "SELECT id FROM many", limit=7).count() == 7
    assert run_read_only(spark, "SHOW TABLES").count() >= 1
    cut, whole = try_query(spark, "SELECT id FROM many", 7), try_query(spark, "SELECT id FROM many", 5000)
    assert (cut.frame.count(), cut.more, whole.frame.count(), whole.more) == (7, True, 5000, False)


@pytest.mark.parametrize(
    "query",
    ["SELECT * FROM parquet.`{}`", "WITH a AS (SELECT * FROM parquet.`{}`) SELECT * FROM a",
     "SELECT (SELECT max(id) FROM parquet.`{}`) AS m", "EXPLAIN SELECT * FROM parquet.`{}`",
     "SELECT id FROM many WHERE id IN (SELECT id FROM json.`{}`)", "SELECT * FROM many JOIN text.`{}` USING (id)"],
)
def test_files_cannot_be_named_in_from(spark, tmp_path, query):
    spark.range(3).createOrReplaceTempView("many")
    spark.range(3).write.parquet(str(tmp_path / "p"))
    result = try_query(spark, query.format(tmp_path / "p"))
    assert not result.ok and result.error.startswith("Requête refusée : ")
    assert spark.conf.get("spark.sql.runSQLOnFiles") == "true"
    assert try_query(spark, "SELECT * FROM default.many").error.startswith("Erreur SQL: ")


COMPUTED = [
    "SELECT * FROM {}", "WITH a AS (SELECT * FROM {}) SELECT * FROM a", "SELECT (SELECT max(id) FROM {}) AS m",
    "SELECT * FROM many WHERE id IN (SELECT id FROM {})", "EXPLAIN SELECT * FROM {}", "DESCRIBE QUERY SELECT * FROM {}",
    "SELECT * FROM many UNION ALL SELECT id FROM {}", "SELECT * FROM (SELECT * FROM many CROSS JOIN {}) x",
    "WITH a AS (WITH b AS (SELECT * FROM {}) SELECT * FROM b) SELECT count(*) FROM a",
    "SELECT max(id) FILTER (WHERE EXISTS (SELECT 1 FROM {})) FROM many", "SELECT id FROM many LATERAL JOIN {}",
]


@pytest.mark.parametrize("query", COMPUTED)
@pytest.mark.parametrize("name", ["'parquet.`{}`'", "'par' || 'quet.`' || '{}`'", "lower('PARQUET.') || '`{}`'"])
def test_names_cannot_be_computed(spark, tmp_path, query, name):
    """A file named in IDENTIFIER is refused wherever it stands, in one piece or in several."""
    spark.range(3).createOrReplaceTempView("many")
    path = str(tmp_path / "p")
    spark.range(3).write.parquet(path)
    sql = query.format(f"IDENTIFIER({name.format(path)})")
    result = try_query(spark, sql)
    assert not result.ok
    if "LATERAL JOIN" not in sql:  # which does not parse
        assert result.error.startswith("Requête refusée : ")


@pytest.mark.parametrize(
    "sql",
    ["SELECT IDENTIFIER('ref' || 'lect')('java.lang.System', 'lineSeparator')", "SELECT IDENTIFIER('id') FROM many",
     "SELECT * FROM many WHERE IDENTIFIER('i' || 'd') = 1", "DESCRIBE IDENTIFIER('many')"],
)
def test_functions_and_columns_cannot_be_computed(spark, sql):
    spark.range(3).createOrReplaceTempView("many")
    assert try_query(spark, sql).error.startswith("Requête refusée : ")


def test_the_walk_takes_all_plain_queries(spark):
    for check in SQL_CHECKS.values():
        ensure_plain_tree(spark, ensure_read_only(check.spark))


def test_the_session_of_a_query_holds_by_itself(spark, tmp_path):
    """What passed text and tree would still meet no file and no JVM function; the caller's session has both."""
    path = str(tmp_path / "p")
    spark.range(3).write.parquet(path)
    spark.range(3).createOrReplaceTempView("many")
    spark.udf.register("one_more", lambda v: v + 1, "long")
    spark.read.parquet(path).createOrReplaceTempView("of_owner")
    inner = guarded_session(spark)
    for sql in (f"SELECT * FROM parquet.`{path}`", "SELECT reflect('java.lang.Math', 'abs', -1)",
                "SELECT java_method('java.lang.Math', 'abs', -1)", "SELECT try_reflect('java.lang.Math', 'abs', -1)"):
        with pytest.raises(Exception, match="TABLE_OR_VIEW_NOT_FOUND|UNRESOLVED_ROUTINE"):
            inner.sql(sql).collect()
        assert spark.sql(sql).count()
    assert [r[0] for r in run_read_only(spark, "SELECT one_more(id) FROM of_owner ORDER BY 1").collect()] == [1, 2, 3]


def test_callers_do_not_disturb_each_other(spark, tmp_path):
    path = str(tmp_path / "p")
    spark.range(5).write.parquet(path)
    spark.range(7).createOrReplaceTempView("many")

    def call(i: int) -> bool:
        if i % 3 == 0:
            return try_query(spark, "SELECT count(*) AS n FROM many").frame.first().n == 7
        if i % 3 == 1:
            return not try_query(spark, f"SELECT * FROM IDENTIFIER('parquet.`{path}`')").ok
        return spark.sql(f"SELECT count(*) AS n FROM parquet.`{path}`").first().n == 5  # the owner's own way

    with ThreadPoolExecutor(6) as pool:
        assert all(pool.map(call, range(24)))


def test_try_query_reports(spark):
    assert try_query(spark, "SELECT 1 AS a").frame.first().a == 1
    assert try_query(spark, "DROP TABLE x").error.startswith("Requête refusée : ")
    assert try_query(spark, "SELECT missing_column").error.startswith("Erreur SQL: ")


def test_catalog(spark):
    spark.range(1).createOrReplaceTempView("one_row")
    health = health_check(spark)
    assert health.status == "healthy" and "one_row" in health.tables and health.version == spark.version
    assert [tuple(r) for r in table_schema(spark, "one_row").collect()] == [("id", "BIGINT")]
