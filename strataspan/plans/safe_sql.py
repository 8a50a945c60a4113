"""A door for foreign SQL: one read-only query over known tables with known functions.

Spark's own parser reads the statement; what it may hold is decided on the parsed plan,
so quoting, aliases, comments and nesting make no difference. Spatial functions are
registered with the session, and joins on a spatial predicate become joins on grid cells.
Casts to geometry and geography say nothing here and are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from ..functions import spatial_sql
from . import spatial_joins

MAX_ROWS = 1000
# Kinds of plan nodes that a read-only query is made of.
NODES = {
    "Project", "Filter", "Join", "LateralJoin", "Aggregate", "Sort", "GlobalLimit", "LocalLimit", "Offset", "Distinct", "SubqueryAlias", "UnresolvedSubqueryColumnAliases",
    "UnresolvedRelation", "UnresolvedInlineTable", "OneRowRelation", "Union", "Except", "Intersect", "UnresolvedHaving", "WithWindowDefinition", "UnresolvedWith", "Window",
}
FUNCTIONS = set(
    """abs acos array array_contains asin atan atan2 avg ceil ceiling coalesce concat concat_ws contains cos count date date_format date_trunc day dayofweek
    degrees endswith exp extract first floor greatest hour ifnull initcap instr isnan isnotnull isnull last lcase least left length like ln log log10 lower lpad ltrim
    max max_by mean median min min_by minute month named_struct nullif percentile pi pmod position pow power quarter radians regexp_extract regexp_like replace
    reverse right round row_number rank dense_rank lag lead ntile rpad rtrim second sign sin size split sqrt startswith stddev struct substr substring sum tan to_date
    to_timestamp trim try_divide ucase upper variance when year""".split()
) | set(spatial_sql.PUBLIC)


class Rejected(ValueError):
    """A statement that the door doesn't let through."""


def _seq(jvm_seq) -> Iterator:
    return (jvm_seq.apply(i) for i in range(jvm_seq.size()))


def _kind(node) -> str:
    return node.getClass().getSimpleName().rstrip("$")


def _walk(spark: SparkSession, plan, names: set[str]) -> None:
    kind = _kind(plan)
    if kind not in NODES:
        raise Rejected(f"not allowed here: {kind}")
    if kind == "UnresolvedRelation":
        parts = list(_seq(plan.multipartIdentifier()))
        if len(parts) != 1 or parts[0].lower() not in names:
            raise Rejected(f"unknown table: {'.'.join(parts)}")
    inner = names
    if kind == "UnresolvedWith":
        inner = set(names)
        for pair in _seq(plan.cteRelations()):
            _walk(spark, pair.productElement(1), inner)
            inner.add(pair.productElement(0).lower())
    for child in _seq(plan.children()):
        _walk(spark, child, inner)
    for expression in _seq(plan.expressions()):
        _expression(spark, expression, inner)


def _expression(spark: SparkSession, e, names: set[str]) -> None:
    if _kind(e) == "UnresolvedFunction":
        parts = [p.lower() for p in _seq(e.nameParts())]
        if len(parts) != 1 or parts[0] not in FUNCTIONS:
            raise Rejected(f"unknown function: {'.'.join(parts)}")
    if spark._jvm.java.lang.Class.forName("org.apache.spark.sql.catalyst.expressions.PlanExpression").isInstance(e):
        _walk(spark, e.plan(), names)
    for child in _seq(e.children()):
        _expression(spark, child, names)


_CASTS = re.compile(r"""('(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.|"")*"|`[^`]*`|--[^\n]*|/\*.*?\*/)|::\s*geo(?:graphy|metry)\b(?:\s*\([^)]*\))?|\b(st_setsrid)(?=\s*\()""", re.I | re.S)


def _parse(spark: SparkSession, sql: str):
    """The parsed plan; quoted text and comments are kept as they are. Spark has a function
    ST_SetSRID of its own, over other values, so statements' calls get another name."""
    try:
        return spark._jsparkSession.sessionState().sqlParser().parsePlan(_CASTS.sub(lambda m: m[1] or ("st_with_srid" if m[2] else ""), sql.strip()).rstrip(";").rstrip())
    except Exception as error:
        raise Rejected(f"not one readable statement: {str(error).splitlines()[0]}") from error


def check(spark: SparkSession, sql: str, tables: list[str], allow_with: bool = True):
    """The parsed plan; raises ``Rejected`` unless ``sql`` is one query over ``tables``."""
    plan = _parse(spark, sql)
    if not allow_with and _kind(plan) == "UnresolvedWith":
        raise Rejected("starts with WITH")
    _walk(spark, plan, {t.lower() for t in tables})
    return plan


def run(spark: SparkSession, sql: str, tables: list[str], limit: int = MAX_ROWS) -> DataFrame:
    """The query's first ``limit`` rows."""
    return spatial_joins.run(spark, check(spark, sql, tables)).limit(min(limit, MAX_ROWS))


def answer(spark: SparkSession, sql: str, tables: list[str]) -> dict:
    """Columns and rows, or the error as data."""
    try:
        df = run(spark, sql, tables)
        return {"columns": df.columns, "rows": [tuple(r) for r in df.collect()], "error": ""}
    except Exception as error:
        return {"columns": [], "rows": [], "error": str(error).splitlines()[0]}
