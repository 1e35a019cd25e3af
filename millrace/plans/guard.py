"""Read-only SQL over registered views, whole or with a row cap that says whether it cut."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Plan nodes of queries; whatever else the parser gives is no query.
NODES = frozenset(
    "Project Filter Aggregate Join Sort GlobalLimit LocalLimit Offset Distinct Union Intersect Except SubqueryAlias UnresolvedRelation UnresolvedWith UnresolvedInlineTable "
    "OneRowRelation WithWindowDefinition UnresolvedHaving Generate Window LateralJoin UnresolvedSubqueryColumnAliases UnresolvedTableValuedFunction UnresolvedHint Pivot Unpivot "
    "Deduplicate UnionLoop UnionLoopRef LocalRelation".split()
)
#: Expressions that the parser gives for those; others are refused, too.
EXPRESSIONS = frozenset(
    "UnresolvedAttribute UnresolvedStar UnresolvedFunction UnresolvedAlias UnresolvedExtractValue UnresolvedNamedLambdaVariable UnresolvedOrdinal UnresolvedGenerator Alias MultiAlias AttributeReference Literal LambdaFunction "
    "And Or Not EqualTo EqualNullSafe LessThan LessThanOrEqual GreaterThan GreaterThanOrEqual In InSubquery Between IsNull IsNotNull IsTrue IsFalse Like ILike LikeAll LikeAny NotLikeAll NotLikeAny RLike "
    "CaseWhen If Coalesce Cast TryCast Add Subtract Multiply Divide IntegralDivide Remainder UnaryMinus UnaryPositive BitwiseAnd BitwiseOr BitwiseXor BitwiseNot Concat CreateNamedStruct CreateStruct "
    "SortOrder WindowExpression UnresolvedWindowExpression WindowSpecDefinition WindowSpecReference SpecifiedWindowFrame UnspecifiedFrame UnboundedPreceding UnboundedFollowing CurrentRow "
    "ScalarSubquery Exists ListQuery LateralSubquery NamedParameter PosParameter Substring StringTrim StringTrimLeft StringTrimRight StringLocate Overlay Extract TimestampAdd TimestampDiff "
    "CurrentDate CurrentTimestamp GroupingSets Cube Rollup FunctionTableSubqueryArgumentExpression".split()
)
#: Functions by their groups in Spark's own list; what is in no such group reaches outside the tables or tells of the session.
GROUPS = frozenset(f"{g}_funcs" for g in "agg array bitwise collection conditional conversion datetime generator hash json lambda map math predicate string struct window".split())
PLAIN, TABLE_FUNCTIONS = frozenset({"typeof", "monotonically_increasing_id", "uuid"}), frozenset("explode explode_outer posexplode posexplode_outer inline inline_outer stack json_tuple range".split())


def _each(seq) -> Iterator:
    it = seq.iterator()
    while it.hasNext():
        yield it.next()


class _Walk:
    """Why a parsed plan may not run."""

    def __init__(self, spark: SparkSession):
        jvm = spark._jvm.org.apache.spark.sql.catalyst
        self.registry, self.name = jvm.analysis.FunctionRegistry.builtin(), lambda n: jvm.FunctionIdentifier(n, spark._jvm.scala.Option.apply(None))

    def plan(self, plan, names: frozenset[str]) -> Iterator[str]:
        """names: views and common table expressions that may be read here."""
        kind = plan.getClass().getSimpleName().rstrip("$")
        if kind not in NODES:
            yield f"only queries may run, not {kind}"
            return
        if kind == "UnresolvedWith":  # a definition sees those before it, and itself if it is recursive
            for t in _each(plan.cteRelations()):
                alias = str(t._1()).lower()
                yield from self.plan(t._2(), names | {alias} if plan.allowRecursion() else names)
                names = names | {alias}
            for p in _each(plan.children()):
                yield from self.plan(p, names)
            return
        if kind == "UnresolvedRelation":
            parts = [str(p).lower() for p in _each(plan.multipartIdentifier())]
            if len(parts) != 1 or parts[0] not in names:
                yield f"no such view: {'.'.join(parts)}"
        if kind == "UnresolvedTableValuedFunction":
            parts = [str(p).lower() for p in _each(plan.name())]
            if len(parts) != 1 or parts[0] not in TABLE_FUNCTIONS:
                yield f"function {'.'.join(parts)} may not be called"
        for e in _each(plan.expressions()):
            yield from self.expression(e, names)
        for below in (plan.children(), plan.innerChildren()):
            for p in _each(below):
                yield from self.plan(p, names)

    def expression(self, e, names: frozenset[str]) -> Iterator[str]:
        kind = e.getClass().getSimpleName().rstrip("$")
        if kind not in EXPRESSIONS:
            yield f"{kind} may not be used"
            return
        if kind == "UnresolvedFunction":
            parts = [str(p).lower() for p in _each(e.nameParts())]
            known = self.registry.lookupFunction(self.name(parts[0])) if len(parts) == 1 else None
            if not (known and known.isDefined() and (known.get().getGroup() in GROUPS or parts[0] in PLAIN)):
                yield f"function {'.'.join(parts)} may not be called"
        if hasattr(e, "plan") and kind in ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery", "FunctionTableSubqueryArgumentExpression"):
            yield from self.plan(e.plan(), names)
        if kind == "InSubquery":
            yield from self.expression(e.query(), names)
        for child in _each(e.children()):
            yield from self.expression(child, names)


def refusal(spark: SparkSession, sql: str) -> str | None:
    """Why a statement may not run; None if it may. Spark's own parser decides what it is; every node and expression of its plan has to be a query's."""
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as e:  # noqa: BLE001
        return f"not a statement: {str(e).splitlines()[0]}"
    views = frozenset(t.name.lower() for t in spark.catalog.listTables() if t.isTemporary)
    return next(_Walk(spark).plan(plan, views), None)


def guarded(spark: SparkSession, sql: str, max_rows: int | None = None, args: dict | list | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, cut): the statement's rows, at most max_rows if given, in its own order; cut has one row, whether there were more (`truncated`).

    Nothing runs before either is used, and nothing passes through the driver; a row beyond the cap is looked for, so a result of just
    as many rows isn't cut.
    """
    if why := refusal(spark, sql):
        raise PermissionError(why)
    rows = spark.sql(sql, args=args) if args else spark.sql(sql)
    if max_rows is None:
        return rows, spark.range(1).select(F.lit(False).alias("truncated"))
    most = max(1, max_rows)
    return rows.limit(most), rows.limit(most + 1).agg((F.count("*") > most).alias("truncated"))
