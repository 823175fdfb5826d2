"""Read-only SQL from untrusted callers.

Three layers, each enough for what it covers. The text must be one statement of a reading kind and
free of refused words. The parsed statement is walked whole (plans, expressions, subqueries, common
table expressions, statements inside EXPLAIN): names computed by IDENTIFIER, external programs,
functions that run JVM code and relations of a format and a path are refused. What is left runs in
a session of its own, a copy of the caller's with its views and functions, in which a path is not a
table and those functions do not exist; a view that the owner makes of files is made of a frame.
The caller's session is never touched, so callers do not disturb each other.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from py4j.java_gateway import JavaObject
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

# Accepted first words, refused words and answer prefixes.
START_WORDS = ["SELECT", "WITH", "DESCRIBE", "SHOW", "EXPLAIN"]
BLOCKED_WORDS = [
    "INSERT", "UPDATE", "DELETE", "DROP", "CREATE", "ALTER", "ATTACH", "DETACH", "COPY",
    "EXPORT", "IMPORT", "CALL", "PRAGMA", "INSTALL", "LOAD", "SET", "VACUUM", "CHECKPOINT",
]
REFUSED = "Requête refusée : "
SQL_ERROR = "Erreur SQL: "

# Spark functions that run arbitrary JVM code, and the clause that runs a shell command.
SPARK_BLOCKED_WORDS = ["reflect", "try_reflect", "java_method"]
SPARK_STATEMENTS = [
    "MERGE", "TRUNCATE", "REFRESH", "CACHE", "UNCACHE", "ADD", "ANALYZE", "MSCK", "REPAIR",
]
# Conditions of the session guarded statements run in.
SESSION_CONF = {"spark.sql.runSQLOnFiles": "false"}


def _words(words: list[str]) -> str:
    return r"\b(?:" + "|".join(words) + r")\b"


_START = re.compile(r"\s*" + _words(START_WORDS), re.IGNORECASE)
_BLOCKED = re.compile(_words(BLOCKED_WORDS + SPARK_BLOCKED_WORDS), re.IGNORECASE)
# USING introduces the columns of a join; before anything else it starts an external program.
_SCRIPT = re.compile(r"\bUSING\b(?!\s*\()", re.IGNORECASE)
_COMMENT = re.compile(r"/\*.*?\*/|--[^\n]*", re.DOTALL)
# EXPLAIN, WITH and the like may lead into a statement of these kinds.
_STATEMENT = re.compile(r"(?:^|\bEXPLAIN\b[\w\s]*?|\))\s*" + _words(SPARK_STATEMENTS), re.IGNORECASE)

# Classes of the parsed tree that end a walk: nothing that reads is below them.
_LEAVES = {"Literal", "UnresolvedAttribute", "UnresolvedStar", "UnresolvedNamespace"}
_COMPUTED_NAMES = {"PlanWithUnresolvedIdentifier", "ExpressionWithUnresolvedIdentifier"}
_NAMED = {"UnresolvedRelation", "UnresolvedTable", "UnresolvedView", "UnresolvedTableOrView"}


class QueryRefused(ValueError):
    """The text is not one plain read statement."""


@dataclass(frozen=True)
class QueryResult:
    ok: bool
    frame: DataFrame | None
    error: str | None
    more: bool = False  # whether a limit asked for left rows out


def ensure_read_only(sql: str) -> str:
    """Return the statement without its trailing semicolons, or raise ``QueryRefused``."""
    statement = sql.strip().rstrip(";")
    if ";" in statement:
        raise QueryRefused("only one statement per call")
    if not _START.match(statement):
        raise QueryRefused("only " + "/".join(START_WORDS) + " statements")
    if _BLOCKED.search(statement) or _STATEMENT.search(statement):
        raise QueryRefused("the statement writes, changes a schema or runs code")
    if _SCRIPT.search(_COMMENT.sub(" ", statement)) or _SCRIPT.search(statement):
        raise QueryRefused("the statement starts an external program")
    return statement


def _inside(value: JavaObject, kind: str, product: JavaObject) -> Iterator[object]:
    """What a Scala value holds: elements of a collection, fields of a case class or tree node."""
    if kind.startswith("scala.collection."):
        if "Map" in kind.rsplit(".", 1)[-1]:
            value = value.toSeq()
        for i in range(value.size()):
            yield value.apply(i)
    elif kind.startswith(("scala.", "org.apache.spark.sql.")) and product.isInstance(value):
        for i in range(value.productArity()):
            yield value.productElement(i)


def _nodes(spark: SparkSession, tree: JavaObject) -> Iterator[tuple[str, JavaObject]]:
    """Every plan and expression of a parsed statement with the name of its class, however nested."""
    product = spark._jvm.java.lang.Class.forName("scala.Product")
    todo: list[object] = [tree]
    while todo:
        value = todo.pop()
        if not isinstance(value, JavaObject):
            continue  # text, a number, a flag or nothing
        kind = value.getClass().getName()
        name = kind.rsplit(".", 1)[-1]
        if kind.startswith("org.apache.spark.sql."):
            yield name, value
        if name not in _LEAVES and not kind.startswith("org.apache.spark.sql.types."):
            todo.extend(_inside(value, kind, product))


def _parts(names: JavaObject) -> list[str]:
    return [str(names.apply(i)) for i in range(names.size())]


def ensure_plain_tree(spark: SparkSession, statement: str) -> None:
    """Refuse what the parsed statement may not hold. A name of several parts is
    ``database.table`` or ``format.path``; only databases and catalogs pass."""
    parsed = spark._jsparkSession.sessionState().sqlParser().parsePlan(statement)
    for name, node in _nodes(spark, parsed):
        if name in _COMPUTED_NAMES:
            raise QueryRefused("names must be written out, not computed by IDENTIFIER")
        if "ScriptTransformation" in name:
            raise QueryRefused("the statement starts an external program")
        if name == "UnresolvedFunction" and (called := _parts(node.nameParts())[-1]).lower() in SPARK_BLOCKED_WORDS:
            raise QueryRefused(f"{called} runs code")
        if name in _NAMED:
            first, *rest = _parts(node.multipartIdentifier())
            if rest and not (spark.catalog.databaseExists(first) or first in _catalogs(spark)):
                raise QueryRefused(f"{first} is no database; files cannot be named in a query")


def _catalogs(spark: SparkSession) -> set[str]:
    return {c.name for c in spark.catalog.listCatalogs()}


def guarded_session(spark: SparkSession) -> SparkSession:
    """A copy of the session, views and functions included, that reads no paths and calls no JVM code."""
    copy = spark._jsparkSession.cloneSession()
    functions = copy.sessionState().functionRegistry()
    identifier = spark._jvm.org.apache.spark.sql.catalyst.FunctionIdentifier
    for name in SPARK_BLOCKED_WORDS:
        functions.dropFunction(identifier(name))
    for key, value in SESSION_CONF.items():
        copy.conf().set(key, value)
    return SparkSession(spark.sparkContext, copy)


def run_read_only(spark: SparkSession, sql: str, limit: int | None = None) -> DataFrame:
    """The guarded query, whole unless a limit is asked for; the limit is part of the plan."""
    statement = ensure_read_only(sql)
    ensure_plain_tree(spark, statement)
    result = guarded_session(spark).sql(statement)
    return result if limit is None else result.limit(limit)


def try_query(spark: SparkSession, sql: str, limit: int | None = None) -> QueryResult:
    """As ``run_read_only``, but refusals and errors come back as text, and with a limit ``more``
    says whether rows were left out."""
    try:
        frame = run_read_only(spark, sql)
        if limit is None:
            return QueryResult(True, frame, None)
        more = frame.limit(limit + 1).count() > limit
        return QueryResult(True, frame.limit(limit), None, more)
    except QueryRefused as refusal:
        return QueryResult(False, None, f"{REFUSED}{refusal}")
    except PySparkException as error:
        return QueryResult(False, None, f"{SQL_ERROR}{error}")
