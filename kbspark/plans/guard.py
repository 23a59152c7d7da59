"""A read-only guard: Spark parses the statement, and only plans of allowed parts pass."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

from pyspark.errors import ParseException
from pyspark.sql import SparkSession

#: The parts of a parsed plan that read and never write, run or look at files. Whatever is not named here is refused.
NODES = {
    "Project", "Filter", "Aggregate", "Sort", "Join", "LateralJoin", "SubqueryAlias", "GlobalLimit", "LocalLimit", "Offset", "Distinct", "Union", "Intersect", "Except", "Generate", "Pivot", "UnresolvedPivot", "Unpivot",
    "WithWindowDefinition", "OneRowRelation", "UnresolvedRelation", "UnresolvedWith", "UnresolvedHaving", "UnresolvedSubqueryColumnAliases", "UnresolvedOrderByAll",
}
#: Functions that make rows, allowed in LATERAL VIEW.
GENERATORS = {"explode", "explode_outer", "posexplode", "posexplode_outer", "inline", "inline_outer", "stack"}
#: Parts that may stand within a statement but not be it.
INNER = {"Union", "Intersect", "Except", "UnresolvedRelation"}
#: Functions that a statement may call.
FUNCTIONS = {
    "count", "sum", "avg", "mean", "min", "max", "round", "floor", "ceil", "ceiling", "abs", "sign", "power", "sqrt", "ln", "exp", "greatest", "least", "coalesce", "nullif", "ifnull", "if", "case",
    "lower", "upper", "trim", "ltrim", "rtrim", "length", "char_length", "substring", "substr", "left", "right", "concat", "concat_ws", "replace", "position", "split_part", "lpad", "rpad", "like", "ilike", "regexp_like", "between", "isnull", "isnotnull",
    "year", "month", "day", "quarter", "week", "hour", "minute", "second", "date_trunc", "date_part", "extract", "to_date", "date", "date_add", "date_sub", "datediff", "date_diff", "date_format", "months_between", "add_months", "last_day",
    "row_number", "rank", "dense_rank", "percent_rank", "cume_dist", "ntile", "lag", "lead", "first_value", "last_value", "nth_value", "first", "last", "any_value", "count_if", "bool_and", "bool_or",
    "stddev", "stddev_samp", "stddev_pop", "variance", "var_samp", "var_pop", "corr", "median", "percentile", "percentile_cont", "percentile_disc", "mode", "string_agg", "listagg", "array_agg", "grouping", "grouping_id", "cube", "rollup",
    "cast", "bigint", "int", "double", "decimal", "string", "mod", "div", "make_date", "size", "array_contains", "struct", "array", "named_struct", "to_json",
}


class Verdict(NamedTuple):
    """Whether a statement may run; if not, why, and the kind of reason for metrics. `text` is what was checked, and the only text to run."""

    ok: bool
    reason: str = ""
    category: str = ""
    text: str = ""


def plain_statement(sql: str) -> str:
    """A statement without the code fence that models put around it (with `sql` or nothing behind the opening) and without a last semicolon."""
    fenced = re.fullmatch(r"\s*```(?:sql)?[ \t]*\n(.*?)\s*```\s*", sql, re.DOTALL | re.IGNORECASE)
    return (fenced[1] if fenced else sql).strip().rstrip(";").strip()


def _each(seq) -> Iterator:
    it = seq.iterator()
    while it.hasNext():
        yield it.next()


def _expressions(expression) -> Iterator:
    yield expression
    for child in _each(expression.children()):
        yield from _expressions(child)


def _plans(plan) -> Iterator[tuple[object, list]]:
    """Every part of a plan with its expressions: children, common tables, and subqueries in expressions."""
    own = [e for x in _each(plan.expressions()) for e in _expressions(x)]
    yield plan, own
    for child in _each(plan.children()):
        yield from _plans(child)
    if plan.nodeName() == "UnresolvedWith":
        for named in _each(plan.cteRelations()):
            yield from _plans(named._2())
    for e in own:
        if e.getClass().getSimpleName() in ("ScalarSubquery", "ListQuery", "Exists", "LateralSubquery"):
            yield from _plans(e.plan())


def check(spark: SparkSession, sql: str, views: set[str]) -> Verdict:
    """Whether `sql` is one SELECT over `views` with allowed parts and functions only; with the text that was looked at."""
    text = plain_statement(sql)
    if not text:
        return Verdict(False, "empty statement", "empty")
    try:
        root = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    except ParseException as error:
        return Verdict(False, f"cannot be parsed: {str(error).splitlines()[0]}", "syntax")
    parts = list(_plans(root))
    known = {v.lower() for v in views}
    top = root
    while top.nodeName() in ("GlobalLimit", "LocalLimit", "Offset", "Sort", "UnresolvedWith", "UnresolvedOrderByAll", "Distinct"):
        top = top.child()
    for part, _ in parts:
        if part.nodeName() == "UnresolvedWith":
            known |= {named._1().lower() for named in _each(part.cteRelations())}
    if top.nodeName() in INNER:
        return Verdict(False, f"the statement is no SELECT but {top.nodeName()}", "not_select")
    for part, expressions in parts:
        name = part.nodeName()
        if name not in NODES:
            return Verdict(False, f"{name} is not allowed", "forbidden_node")
        if name == "UnresolvedRelation":
            table = part.tableName().replace("`", "").lower()
            if part.isStreaming():
                return Verdict(False, f"{table} as a stream is not allowed", "forbidden_node")
            if table not in known:
                return Verdict(False, f"unknown table {table}", "forbidden_table")
        for e in expressions:
            if e.getClass().getSimpleName() == "UnresolvedFunction":
                called = ".".join(_each(e.nameParts())).lower()
                if called not in FUNCTIONS:
                    return Verdict(False, f"function {called} is not allowed", "forbidden_function")
            if e.getClass().getSimpleName() == "UnresolvedGenerator" and e.name().unquotedString().lower() not in GENERATORS:
                return Verdict(False, f"function {e.name().unquotedString()} is not allowed", "forbidden_function")
    return Verdict(True, text=text)


def denied_columns(spark: SparkSession, sql: str, denied: set[str]) -> set[str]:
    """The denied columns that a statement over complete views refers to or gives, under any alias; whole rows count."""
    if not denied:
        return set()
    plan = spark.sql(sql)._jdf.queryExecution().analyzed()
    wanted = {d.lower() for d in denied}
    found = {a.name().lower() for a in _each(plan.output())} & wanted

    def walk(node) -> None:
        for x in _each(node.expressions()):
            for e in _expressions(x):
                if e.getClass().getSimpleName() == "AttributeReference" and e.name().lower() in wanted and node.nodeName() not in ("Relation", "LogicalRelation", "View"):
                    found.add(e.name().lower())
                if e.getClass().getSimpleName() in ("ScalarSubquery", "ListQuery", "Exists", "LateralSubquery"):
                    walk(e.plan())
        if node.nodeName() in ("SubqueryAlias", "View") and next(iter(_each(node.children()))).nodeName() == "View":
            return
        for child in _each(node.children()):
            if child.nodeName() != "View":
                walk(child)

    walk(plan)
    return found
