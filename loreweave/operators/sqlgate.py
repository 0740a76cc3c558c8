"""Read-only SQL over named tables: what a query may be is decided by its plan, not by its text."""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping
from typing import Any

from py4j.java_gateway import JavaObject, is_instance_of
from pyspark.sql import DataFrame, SparkSession

from loreweave.model import QUERY_LIMIT, RESULT_BYTES

#: Catalyst's names of the operators that a parsed query may have.
OPERATORS = frozenset("""
    Aggregate Deduplicate Distinct Except Filter Generate GlobalLimit Intersect Join LateralJoin LocalLimit LocalRelation Offset OneRowRelation Pivot Project
    Sample Sort SubqueryAlias Union UnresolvedHaving UnresolvedHint UnresolvedInlineTable UnresolvedPivot UnresolvedRelation UnresolvedSubqueryColumnAliases
    UnresolvedTableValuedFunction UnresolvedTVFAliases UnresolvedWith Unpivot Window WithWindowDefinition
""".split())
#: What an analysed query may read besides the named tables.
LEAVES = frozenset("CTERelationRef LocalRelation OneRowRelation Range UnionLoopRef".split())
#: Functions that give rows and can be named in FROM or LATERAL VIEW.
TABLE_FUNCTIONS = frozenset("explode explode_outer inline inline_outer json_tuple posexplode posexplode_outer range stack variant_explode variant_explode_outer".split())
#: Functions that call any method of the JVM, and expressions that do so or take names from values.
CALLS = frozenset("java_method reflect try_reflect".split())
#: Functions that tell where on the server a row's file lies.
PLACES = frozenset("input_file_block_length input_file_block_start input_file_name".split())
CALLING = frozenset("CallMethodViaReflection ExpressionWithUnresolvedIdentifier TryReflect".split())


def _all(seq: JavaObject) -> list[Any]:
    return [seq.apply(i) for i in range(seq.size())]


def _parts(spark: SparkSession, plan: JavaObject, whole: Any = lambda _: False) -> Iterator[tuple[bool, str, JavaObject]]:
    """Operators and expressions of a plan and its subqueries: whether it is an operator, class name and object.

    What is below an operator for which ``whole`` holds isn't looked at.
    """
    is_a = lambda x, name: is_instance_of(spark._sc._gateway, x, f"org.apache.spark.sql.catalyst.{name}")
    todo = [plan]
    while todo:
        x = todo.pop()
        operator = is_a(x, "plans.logical.LogicalPlan")
        yield operator, x.getClass().getSimpleName(), x
        if operator:
            if not whole(x):
                todo += _all(x.children()) + _all(x.innerChildren()) + _all(x.expressions())
        else:
            todo += _all(x.children())
            if is_a(x, "expressions.PlanExpression"):
                todo.append(x.plan())


def _check_parsed(spark: SparkSession, plan: JavaObject) -> None:
    """Before analysis, which may already evaluate constants."""
    catalyst = spark._jvm.org.apache.spark.sql.catalyst
    builtin = catalyst.analysis.FunctionRegistry.builtin()
    for operator, kind, x in _parts(spark, plan):
        if operator and kind not in OPERATORS:
            raise ValueError(f"Only queries are allowed, and they can't use {kind}")
        if not operator and kind in CALLING:
            raise ValueError(f"Queries can't use {kind}")
        if kind == "UnresolvedRelation" and x.multipartIdentifier().size() > 1:
            raise ValueError(f"Only tables of the knowledge base can be read, without a prefix: {'.'.join(_all(x.multipartIdentifier()))}")
        if kind in ("UnresolvedFunction", "UnresolvedTableValuedFunction", "UnresolvedGenerator"):
            name = [x.name().funcName()] if kind == "UnresolvedGenerator" else _all(x.nameParts() if kind == "UnresolvedFunction" else x.name())
            known = len(name) == 1 and (name[0].lower() in TABLE_FUNCTIONS or (kind == "UnresolvedFunction" and builtin.functionExists(catalyst.FunctionIdentifier(name[0]))))
            if not known or name[0].lower() in CALLS | PLACES:
                raise ValueError(f"Queries can't call {'.'.join(name)}")


def _check_analysed(spark: SparkSession, plan: JavaObject) -> None:
    """Only the named tables, as temporary views of a session that has no others, and constants are read."""
    named = lambda x: x.getClass().getSimpleName() == "View" and x.isTempView()
    for operator, kind, x in _parts(spark, plan, named):
        if not operator and kind in CALLING:
            raise ValueError(f"Queries can't use {kind}")
        if operator and not named(x) and not x.children().size() and kind not in LEAVES:
            raise ValueError(f"Only tables of the knowledge base can be read; found {kind}")


def _limited(plan: JavaObject) -> bool:
    """Whether the query itself, not one inside it, has a LIMIT."""
    while plan.getClass().getSimpleName() == "UnresolvedWith":
        plan = plan.child()
    return plan.getClass().getSimpleName() == "GlobalLimit"


def _moved(df: DataFrame, to: SparkSession) -> DataFrame:
    """The same plan in another session."""
    plan = df._jdf.queryExecution().analyzed()
    return DataFrame(to._jvm.org.apache.spark.sql.classic.Dataset.ofRows(to._jsparkSession, plan), to)


def gated_sql(spark: SparkSession, sql: str, tables: Mapping[str, DataFrame], cap: int | None = QUERY_LIMIT) -> DataFrame:
    """One query over the given tables, at most ``cap`` rows unless it has a LIMIT of its own.

    It is parsed and analysed in a session of its own, in which these tables are the only views: settings, views and tables
    of the caller's session can't be read or changed. Commands, scripts, files by path, other tables, functions that are
    not built in, and those that call the JVM or tell paths are refused.
    """
    own = spark.newSession()
    for k, v in spark.conf.getAll.items():
        if k.startswith("spark.sql.") and own.conf.isModifiable(k):
            own.conf.set(k, v)
    own.conf.set("spark.sql.runSQLOnFiles", "false")
    text = sql.strip().rstrip(";").strip()
    parsed = own._jsparkSession.sessionState().sqlParser().parsePlan(text)
    _check_parsed(own, parsed)
    for name, df in tables.items():
        _moved(df, own).createOrReplaceTempView(name)
    df = own.sql(text)
    _check_analysed(own, df._jdf.queryExecution().analyzed())
    df = _moved(df, spark)
    return df if cap is None or _limited(parsed) else df.limit(cap)


def rows_of(df: DataFrame) -> list[dict[str, Any]]:
    """Rows as dicts, if they are not too large as JSON."""
    out, held = [], 2
    for r in df.toLocalIterator():
        out.append(r.asDict(recursive=True))
        held += len(json.dumps(out[-1], default=str, ensure_ascii=False).encode()) + 1
        if held > RESULT_BYTES:
            raise ValueError(f"The rows take more than {RESULT_BYTES} bytes as JSON; ask for fewer")
    return out
