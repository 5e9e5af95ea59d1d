"""Guarded SQL: queries of a user over tables given by name, judged on Spark's own plans.

Nothing is told from the wording. The parsed plan is walked before anything is
looked up, so that no other table, file or function is ever touched; then the
analysed plan, in which columns have identities. Whatever node is not known to
be harmless is refused.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator, Sequence

from py4j.java_gateway import JavaObject
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

#: What a guarded query may call, by kind.
AGGREGATES = {"any_value", "avg", "bool_and", "bool_or", "count", "count_if", "listagg", "max", "max_by", "median", "min", "min_by", "stddev", "sum", "variance"}
WINDOWS = {"dense_rank", "first_value", "lag", "last_value", "lead", "ntile", "rank", "row_number"}
SCALARS = {"abs", "between", "cast", "ceil", "coalesce", "concat", "floor", "greatest", "if", "least", "nullif", "round", "sign", "try_cast", "try_divide"}
TEXTS = {"contains", "endswith", "initcap", "left", "length", "lower", "lpad", "regexp_extract", "regexp_like", "replace", "right", "split_part", "startswith", "substr", "trim", "upper"}
DATES = {"add_months", "current_date", "date_add", "date_format", "date_trunc", "datediff", "day", "extract", "last_day", "make_date", "month", "months_between", "quarter", "to_date", "year"}
CALLS = AGGREGATES | WINDOWS | SCALARS | TEXTS | DATES

#: Nodes of parsed plans that may stand in a query.
PLANS = {"Aggregate", "Distinct", "Except", "Filter", "GlobalLimit", "Intersect", "Join", "LocalLimit", "Offset", "OneRowRelation", "PipeOperator", "Project", "Sort", "SubqueryAlias", "Union", "UnresolvedHaving", "UnresolvedRelation", "UnresolvedSubqueryColumnAliases", "UnresolvedWith", "WithWindowDefinition"}
#: Expressions of parsed plans: names, literals, operators, and what writes a window or an order.
EXPRESSIONS = {
    "Add", "Alias", "And", "CaseWhen", "Cast", "Concat", "CurrentRow$", "Divide", "EqualNullSafe", "EqualTo", "Exists", "GreaterThan", "GreaterThanOrEqual", "ILike", "In", "InSubquery", "IntegralDivide", "IsNotNull", "IsNull", "LessThan", "LessThanOrEqual",
    "Like", "LikeAll", "LikeAny", "ListQuery", "Literal", "Multiply", "Not", "NotLikeAll", "NotLikeAny", "Or", "RLike", "Remainder", "RowFrame$", "RangeFrame$", "ScalarSubquery", "SortOrder", "SpecifiedWindowFrame", "StringTrim", "Substring", "Subtract", "UnaryMinus", "UnaryPositive",
    "UnboundedFollowing$", "UnboundedPreceding$", "UnresolvedAlias", "UnresolvedAttribute", "UnresolvedFunction", "UnresolvedOrdinal", "UnresolvedStar", "UnresolvedWindowExpression", "UnspecifiedFrame$", "WindowExpression", "WindowSpecDefinition",
}
JOINS = {"Inner", "LeftOuter", "RightOuter", "FullOuter", "LeftSemi", "LeftAnti"}
SUMMING = {"Average", "CentralMomentAgg", "Median", "Percentile", "StddevSamp", "Sum", "VarianceSamp"}


class Refused(ValueError):
    """A query that the guard does not run."""


def _each(seq: JavaObject) -> Iterator[JavaObject]:
    it = seq.iterator()
    while it.hasNext():
        yield it.next()


def _kind(node: JavaObject) -> str:
    return node.getClass().getSimpleName()


def _inner_plan(expression: JavaObject) -> JavaObject | None:
    """The plan of a subquery expression."""
    return expression.plan() if _kind(expression) in ("Exists", "ListQuery", "ScalarSubquery") else None


class _Parsed:
    """A walk over a parsed plan."""

    def __init__(self, tables: Sequence[str]):
        self.tables = {t.lower() for t in tables}

    def plan(self, node: JavaObject, named: frozenset[str] = frozenset()) -> None:
        """named: what WITH has defined around the node."""
        kind = _kind(node)
        if kind not in PLANS:
            raise Refused(f"{kind} is not allowed")
        if kind == "UnresolvedRelation":
            parts = list(_each(node.multipartIdentifier()))
            if len(parts) != 1 or parts[0].lower() not in self.tables | named:
                raise Refused(f"{'.'.join(parts)} is not one of the tables")
        if kind == "UnresolvedWith":
            if node.allowRecursion():
                raise Refused("WITH RECURSIVE is not allowed")
            for relation in _each(node.cteRelations()):
                self.plan(relation._2(), named)
                named |= {relation._1().lower()}
            return self.plan(node.child(), named)
        if kind == "Join":
            self.join(node)
        for e in _each(node.expressions()):
            self.expression(e, named)
        for child in _each(node.children()):
            self.plan(child, named)

    def join(self, node: JavaObject) -> None:
        how = node.joinType().toString()
        used = how.startswith("UsingJoin(")
        if (how[len("UsingJoin(") :].split(",")[0] if used else how) not in JOINS:
            raise Refused(f"a join of the kind {how} is not allowed")
        if not used and node.condition().isEmpty():
            raise Refused("tables are joined with ON or USING; a join without is a cross join")

    def expression(self, e: JavaObject, named: frozenset[str]) -> None:
        kind = _kind(e)
        if kind not in EXPRESSIONS:
            raise Refused(f"{kind} is not allowed")
        if kind == "UnresolvedFunction":
            name = ".".join(_each(e.nameParts())).lower()
            if name not in CALLS:
                raise Refused(f"the function {name} is not allowed")
        inner = _inner_plan(e)
        if inner is not None:
            self.plan(inner, named)
        for child in _each(e.children()):
            self.expression(child, named)


class _Analysed:
    """A walk over an analysed plan, from its leaves: which columns hold values of a running balance."""

    def __init__(self, tables: Sequence[str], balances: Sequence[str]):
        self.tables, self.balances = {t.lower() for t in tables}, {b.lower() for b in balances}
        self.held: set[int] = set()  # identities of such columns
        self.defined: dict[int, list[bool]] = {}  # of WITH's tables, by column

    def plan(self, node: JavaObject) -> None:
        kind = _kind(node)
        if kind == "View":
            if node.desc().identifier().table().lower() not in self.tables:
                raise Refused(f"{node.desc().identifier().table()} is not one of the tables")
            self.held |= {a.exprId().id() for a in _each(node.output()) if a.name().lower() in self.balances}
            return
        children = list(_each(node.children()))
        if not children and kind not in ("OneRowRelation", "CTERelationRef"):
            raise Refused(f"{kind} is not one of the tables")
        for child in children:
            self.plan(child)
        if kind == "CTERelationDef":
            self.defined[node.id()] = self.columns(node)
        elif kind == "CTERelationRef":
            self.mark(node, self.defined[node.cteId()])
        elif kind in ("Union", "Except", "Intersect"):
            self.mark(node, [any(x) for x in zip(*map(self.columns, children))])
        for e in _each(node.expressions()):
            self.expression(e)

    def columns(self, node: JavaObject) -> list[bool]:
        return [a.exprId().id() in self.held for a in _each(node.output())]

    def mark(self, node: JavaObject, flags: list[bool]) -> None:
        self.held |= {a.exprId().id() for a, held in zip(_each(node.output()), flags) if held}

    def expression(self, e: JavaObject) -> bool:
        """Whether the value comes from a running balance."""
        kind, inner = _kind(e), _inner_plan(e)
        held = kind == "AttributeReference" and e.exprId().id() in self.held
        if inner is not None:
            self.plan(inner)
            held |= any(self.columns(inner))
        parts = [self.expression(child) for child in _each(e.children())]
        held |= any(parts)
        if held and kind in SUMMING:
            raise Refused("a running balance isn't added up")
        if kind == "Alias" and held:
            self.held.add(e.exprId().id())
        return held and kind not in ("Count", "RowNumber", "Rank", "DenseRank", "IsNull", "IsNotNull")


def check(spark: SparkSession, sql: str, tables: Sequence[str]) -> None:
    """Raises Refused for what isn't one query over the tables given, with listed functions only. Looks nothing up."""
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except (PySparkException, Py4JJavaError) as e:
        raise Refused(f"the query is not read: {e}") from e
    _Parsed(tables).plan(plan)


def guarded(spark: SparkSession, sql: str, views: dict[str, DataFrame], balances: Sequence[str] = ()) -> DataFrame:
    """The query's rows, in a session of its own that knows the views only; Refused if the guard says so.

    Joins that no condition holds together are refused by the planner of that
    session. A column of ``balances``, or what is made of it, may not be added up.
    """
    check(spark, sql, list(views))
    own = spark.newSession()
    own.conf.set("spark.sql.crossJoin.enabled", "false")
    of = spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows
    for name, df in views.items():
        DataFrame(of(own._jsparkSession, df._jdf.queryExecution().analyzed()), own).createOrReplaceTempView(name)
    out = own.sql(sql)
    _Analysed(list(views), balances).plan(out._jdf.queryExecution().analyzed())
    return out


def run(spark: SparkSession, sql: str, views: dict[str, DataFrame], most: int = 25, balances: Sequence[str] = (), seconds: float = 30.0) -> tuple[list, bool]:
    """The first rows of a guarded query, and whether there are more. It is cancelled after the seconds given; the caller's job group stays."""
    out = guarded(spark, sql, views, balances)
    sc, group = spark.sparkContext, uuid.uuid4().hex
    names = ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel")
    was = {n: sc.getLocalProperty(n) for n in names}
    timer = threading.Timer(seconds, lambda: sc.cancelJobGroup(group))
    sc.setJobGroup(group, "guarded query", interruptOnCancel=True)
    try:
        timer.start()
        rows = out.limit(most + 1).collect()
    finally:
        timer.cancel()
        for n, value in was.items():
            sc.setLocalProperty(n, value)
    return rows[:most], len(rows) > most
