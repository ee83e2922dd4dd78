"""Guarded read-only SQL and dotted key paths."""

from __future__ import annotations

import json
import re
import threading
import uuid
from collections.abc import Iterable, Iterator

from py4j.java_gateway import JavaObject, is_instance_of
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import udtf

DEADLINE_S, MOST_COLUMNS, MOST_ROWS, MOST_BYTES, MOST_VALUE = 5, 64, 500, 4 << 20, 8 << 20
FIRST_WORDS = {"select", "with", "explain"}
#: Built-in functions that reach outside the tables: code, files, the session's user, the host.
DENIED = {
    "reflect", "java_method", "try_reflect", "input_file_name", "input_file_block_start", "input_file_block_length", "read_files", "python_worker_logs",
    "current_user", "user", "session_user", "current_catalog", "current_schema", "current_database", "version",
}
#: Node classes of a parsed read. Any other node (commands, writes, script transforms, names made at run time) is refused.
READS = {
    "UnresolvedRelation", "UnresolvedInlineTable", "ResolvedInlineTable", "LocalRelation", "OneRowRelation", "Project", "Filter", "Aggregate", "UnresolvedHaving", "Sort", "GlobalLimit",
    "LocalLimit", "LimitAll", "Offset", "Distinct", "Deduplicate", "Union", "Intersect", "Except", "Join", "LateralJoin", "AsOfJoin", "SubqueryAlias", "UnresolvedSubqueryColumnAliases",
    "UnresolvedWith", "WithWindowDefinition", "Generate", "UnresolvedTableValuedFunction", "UnresolvedTVFAliases", "Pivot", "UnresolvedPivot", "Unpivot", "Sample", "UnresolvedHint",
    "ExplainCommand", "UnresolvedSubqueryColumnAliases$", "Window", "Range", "View", "PipeExpression", "PipeOperator",
}
#: Conditions of a session that a query's own session takes over.
_CARRIED = ["spark.sql.shuffle.partitions", "spark.sql.session.timeZone", "spark.sql.ansi.enabled", "spark.sql.adaptive.enabled"]


class SqlRefused(ValueError):
    """The statement isn't a single read of the projection, or goes beyond a limit."""


def without_leading_comments(sql: str) -> str:
    return re.sub(r"^(?:\s+|--[^\n]*(?:\n|$)|/\*.*?\*/)+", "", sql, flags=re.S)


def _each_of(at) -> Iterator:
    while at.hasNext():
        yield at.next()


def _each(java_seq) -> Iterator:
    return _each_of(java_seq.iterator())


def _names(java_seq) -> list[str]:
    return [str(x) for x in _each(java_seq)]


class _Walk:
    """Checks every node and every expression of a parsed plan, wherever they stand: all fields of all nodes are followed."""

    def __init__(self, spark: SparkSession, functions: set[str], relations: set[str]):
        self.gateway, self.functions, self.relations = spark.sparkContext._gateway, functions, relations
        self.sorts: dict[str, str] = {}

    def sort(self, x) -> str:
        """plan, expression, many (a collection, an option, a tuple) or other."""
        name = x.getClass().getName()
        if name not in self.sorts:
            catalyst = "org.apache.spark.sql.catalyst."
            is_a = lambda c: is_instance_of(self.gateway, x, c)
            self.sorts[name] = (
                "plan" if is_a(catalyst + "plans.logical.LogicalPlan")
                else "expression" if is_a(catalyst + "expressions.Expression")
                else "many" if is_a("scala.collection.IterableOnce")
                else "product" if is_a("scala.Product") else "other"
            )
        return self.sorts[name]

    def visit(self, x) -> None:
        if not isinstance(x, JavaObject):
            return
        sort = self.sort(x)
        if sort == "many":
            for y in _each(x):
                self.visit(y)
            return
        if sort == "other":
            return
        if sort == "plan":
            self.plan(x)
        elif sort == "expression":
            self.expression(x)
        for y in _each_of(x.productIterator()):
            self.visit(y)

    def plan(self, node) -> None:
        kind = node.getClass().getSimpleName()
        if kind not in READS:
            raise SqlRefused(f"Only reads are allowed ({kind})")
        if kind == "UnresolvedRelation":
            parts = _names(node.multipartIdentifier())
            if len(parts) != 1 or parts[0].lower() not in self.relations:
                raise SqlRefused(f"no table {'.'.join(parts)}")
        elif kind == "UnresolvedTableValuedFunction":
            self.function(_names(node.name()))
        elif kind == "UnresolvedWith":
            self.relations |= {str(common._1()).lower() for common in _each(node.cteRelations())}

    def expression(self, e) -> None:
        kind = e.getClass().getSimpleName()
        if kind == "UnresolvedFunction":
            self.function(_names(e.nameParts()))
        elif kind == "UnresolvedGenerator":
            place = e.name().database()
            self.function([*([str(place.get())] if place.isDefined() else []), str(e.name().funcName())])
        elif kind == "UnresolvedAttribute" and [x.lower() for x in _names(e.nameParts())][-1] in DENIED:
            raise SqlRefused(f"{e.name()} isn't available")
        elif re.search("WithUnresolvedIdentifier|Reflect|InputFile|CurrentUser", kind):
            raise SqlRefused(f"{kind} isn't available")

    def function(self, parts: list[str]) -> None:
        name, place = parts[-1].lower(), [p.lower() for p in parts[:-1]]
        if place not in ([], ["builtin"], ["system", "builtin"], ["session"], ["system", "session"]) or name in DENIED or name not in self.functions:
            raise SqlRefused(f"function {'.'.join(parts)} isn't available")


def check(spark: SparkSession, sql: str, tables: Iterable[str] = ()) -> str:
    """The statement without leading comments, if it may run over the tables and the session's functions."""
    sql = without_leading_comments(sql).rstrip().rstrip(";")
    word = re.match(r"\w+", sql)
    if not word or word[0].lower() not in FIRST_WORDS:
        raise SqlRefused("Only SELECT, WITH and EXPLAIN statements are allowed")
    state = spark._jsparkSession.sessionState()
    try:
        plan = state.sqlParser().parsePlan(sql)
    except Exception as e:
        raise SqlRefused(f"not a single valid statement: {str(e).splitlines()[0]}") from None
    known = {str(f.funcName()).lower() for registry in (state.functionRegistry(), state.tableFunctionRegistry()) for f in _each(registry.listFunction())}
    _Walk(spark, known, {t.lower() for t in tables}).visit(plan)
    return sql


def frame(spark: SparkSession, views: dict[str, DataFrame], sql: str) -> DataFrame:
    """The result of a checked statement, in a session of its own that holds only the views."""
    own = spark.newSession()
    for key in _CARRIED:
        own.conf.set(key, spark.conf.get(key))
    own.conf.set("spark.sql.runSQLOnFiles", "false")
    udtf.register(own)
    sql = check(own, sql, views)
    for name, df in views.items():
        DataFrame(_moved(df, own), own).createOrReplaceTempView(name)
    return own.sql(sql)


def run(spark: SparkSession, views: dict[str, DataFrame], sql: str, deadline: float = DEADLINE_S) -> dict:
    """{rows, truncated}: cancelled at the deadline; of columns of one name the last stands."""
    df = frame(spark, views, sql)
    context, names = spark.sparkContext, df.columns
    if len(names) > MOST_COLUMNS:
        raise SqlRefused(f"more than {MOST_COLUMNS} columns")
    df = df.toDF(*(f"c{i}" for i in range(len(names))))
    shown = [F.concat(F.lit("<blob len="), F.octet_length(c).cast("string"), F.lit(">")).alias(c) if kind == "binary" else F.col(c) for c, kind in df.dtypes]
    tag, late, over = f"quillspark-sql-{uuid.uuid4().hex}", threading.Event(), threading.Event()

    def watch() -> None:
        over.wait(deadline)
        while not over.is_set():  # again and again: the next job of a query may begin just after
            late.set()
            context.cancelJobsWithTag(tag)
            over.wait(0.2)

    guard = threading.Thread(target=watch, daemon=True)
    context.setInterruptOnCancel(True)
    context.addJobTag(tag)
    guard.start()
    try:
        got = [r[0] for r in df.select(*shown).limit(MOST_ROWS + 1).select(F.to_json(F.struct(*df.columns))).collect()]
    except Exception as e:
        if late.is_set():
            raise SqlRefused(f"the query took more than {deadline:g} s") from None
        raise SqlRefused(str(e).splitlines()[0]) from None
    finally:
        over.set()
        context.removeJobTag(tag)
        context.setInterruptOnCancel(False)
    if any(len(x) > MOST_VALUE for x in got) or sum(map(len, got[:MOST_ROWS])) > MOST_BYTES:
        raise SqlRefused(f"the result is larger than {MOST_BYTES} bytes")
    rows = []
    for x in map(json.loads, got[:MOST_ROWS]):
        rows.append({name: x.get(f"c{i}") for i, name in enumerate(names)})
    return {"rows": rows, "truncated": len(got) > MOST_ROWS}


def _moved(df: DataFrame, own: SparkSession):
    """The same plan in another session."""
    return own._jvm.org.apache.spark.sql.classic.Dataset.ofRows(own._jsparkSession, df._jdf.queryExecution().logical())
