"""Ad-hoc SQL over the graph's views, read-only.

A query is read three times before it runs: as it is written, where it may name the graph's views only; as it is
analysed, where it may hold listed steps and listed expressions only; and as it is optimised, where its joins must
follow the graph. All of that happens in a session of its own over views without rows, so that nothing of the
caller's session, its functions, tables or settings, can be reached or run.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from skillgrid.operators import topology
from skillgrid.operators.topology import Lineage, kind_of, members
from skillgrid.sources.graph import GraphContext

MAX_ROWS = 25
ATTEMPTS = 2
#: What a statement may be written with, beyond STEPS.
WRITTEN = frozenset(("UnresolvedRelation", "UnresolvedWith", "UnresolvedHaving", "UnresolvedSubqueryColumnAliases", "UnresolvedInlineTable", "Aggregate", "WithWindowDefinition", "UnresolvedOrderBy", "UnresolvedGenerator"))
#: What an analysed query may be made of. A view is not looked into: its owner chose what it reads.
STEPS = frozenset((
    "Project", "Filter", "Aggregate", "Join", "LateralJoin", "Sort", "GlobalLimit", "LocalLimit", "Offset", "Distinct", "Deduplicate", "Union", "Intersect", "Except", "Window", "Generate", "Expand",
    "Pivot", "Unpivot", "SubqueryAlias", "WithCTE", "CTERelationDef", "CTERelationRef", "View", "OneRowRelation", "LocalRelation", "ResolvedHint",
))
#: What its expressions may be made of; anything else, foreign code above all, is refused.
EXPRESSIONS = frozenset(
    """
    AttributeReference OuterReference Alias MultiAlias Literal Cast NamedLambdaVariable LambdaFunction VariableReference GetStructField GetArrayItem GetMapValue
    EqualTo EqualNullSafe LessThan LessThanOrEqual GreaterThan GreaterThanOrEqual And Or Not In InSet InSubquery ListQuery Exists ScalarSubquery LateralSubquery IsNull IsNotNull IsNaN Between
    Coalesce Nvl NullIf If CaseWhen Greatest Least NullIfZero ZeroIfNull NaNvl
    Add Subtract Multiply Divide IntegralDivide Remainder Pmod UnaryMinus UnaryPositive Abs Round BRound Floor Ceil RoundFloor RoundCeil Sqrt Cbrt Pow Exp Log Log10 Log2 Logarithm Signum
    TryAdd TrySubtract TryMultiply TryDivide TryMod TryEval
    Lower Upper InitCap Length OctetLength Substring Left Right Concat ConcatWs StringTrim StringTrimLeft StringTrimRight StringTrimBoth StringReplace StringTranslate StringLPad StringRPad StringInstr StringLocate StringSplit SplitPart
    Like LikeAll LikeAny NotLikeAll NotLikeAny RLike Contains ContainsExpressionBuilder StartsWith EndsWith RegExpReplace RegExpExtract RegExpCount Reverse
    Year Quarter Month WeekOfYear DayOfMonth DayOfWeek WeekDay DayOfYear Hour Minute Second TruncDate TruncTimestamp DateAdd DateSub DateDiff AddMonths MonthsBetween LastDay NextDay MakeDate DateFormatClass ParseToDate ParseToTimestamp GetTimestamp
    Extract DatePart DatePartExpressionBuilder DateAddYMInterval DateAddInterval TimestampAddYMInterval TimeAdd TimestampAddInterval SubtractDates SubtractTimestamps TimestampAdd TimestampDiff DatetimeSub CurrentDate CurrentTimestamp Now LocalTimestamp
    AggregateExpression Count CountIf Sum Average Min Max MinBy MaxBy First Last AnyValue Mode Median Percentile PercentileCont PercentileDisc ApproximatePercentile HyperLogLogPlusPlus StddevSamp StddevPop VarianceSamp VariancePop Corr BoolAnd BoolOr
    CollectList CollectSet ListAgg Grouping GroupingID TryAverage TrySum
    WindowExpression WindowSpecDefinition SpecifiedWindowFrame UnspecifiedFrame$ CurrentRow$ UnboundedPreceding$ UnboundedFollowing$ RowFrame$ RangeFrame$ RowNumber Rank DenseRank PercentRank CumeDist NTile Lag Lead NthValue SortOrder
    CreateArray CreateNamedStruct Size ArrayContains ArrayJoin ArrayDistinct ArraySize ArrayMin ArrayMax ElementAt SortArray ArraySort Slice ArrayTransform ArrayFilter ArrayExists ArrayForAll Explode PosExplode PivotFirst
    """.split()
)
#: Matching and folding of text, which generated queries leave to the resolution of names.
MATCHING = frozenset(("Like", "LikeAll", "LikeAny", "NotLikeAll", "NotLikeAny", "RLike", "Contains", "StartsWith", "EndsWith", "StringInstr", "StringLocate", "RegExpExtract", "RegExpCount"))
FOLDING = frozenset(("Lower", "Upper", "InitCap", "StringTranslate", "RegExpReplace", "StringReplace", "Reverse"))


class Rejected(ValueError):
    """The query isn't one that may run; the message says why."""


def _parts(e: object) -> list[object]:
    """An expression's operands; of one that Spark replaces by another, those it is written with."""
    try:
        return list(members(e.parameters()))
    except Exception:  # has none
        return list(members(e.children()))


class Guard:
    """Checks queries over a graph's views, which it registers under a prefix in the graph's session. A guard is made
    once for a graph."""

    def __init__(self, g: GraphContext, prefix: str = "") -> None:
        self.spark = g.oferta.sparkSession
        self.views = {(prefix + name).lower() for name in g.frames()}
        g.register(prefix)
        self._empty = topology.shadow_session(g)
        topology.shadow(g, self._empty).register(prefix)

    def _written(self, query: str) -> None:
        """One statement that names the graph's views, its own subqueries and no function that makes rows."""
        try:
            plan = self._empty._jsparkSession.sessionState().sqlParser().parsePlan(query)
        except Exception as e:
            raise Rejected(next((x for x in str(e).splitlines() if x.strip()), "it can't be read")) from None
        self._named(plan, frozenset())

    def _named(self, plan: object, own: frozenset[str]) -> None:
        name = plan.nodeName()
        if name == "UnresolvedWith":
            found = [(c._1().lower(), c._2()) for c in members(plan.cteRelations())]
            for alias, inner in found:
                self._named(inner, own)  # a recursive one would name itself, which is refused here
                own |= {alias}
        elif name == "UnresolvedRelation":
            parts = [x.lower() for x in members(plan.multipartIdentifier())]
            if len(parts) != 1 or not ({*parts} & (self.views | own)):
                raise Rejected(f"{'.'.join(parts)} isn't a view of the graph")
        elif name not in STEPS and name not in WRITTEN:
            raise Rejected(f"a query may not use {name}")
        for inner in members(plan.subqueries()):
            self._named(inner, own)
        for child in members(plan.children()):
            self._named(child, own)

    def _analysed(self, plan: object) -> None:
        if (name := plan.nodeName()) not in STEPS:
            raise Rejected(f"a query may not use {name}")
        todo = list(members(plan.expressions()))
        while todo:
            e = todo.pop()
            if (kind := kind_of(e)) not in EXPRESSIONS:
                raise Rejected(f"a query may not use {kind}")
            todo += _parts(e)
        for inner in members(plan.subqueries()):
            self._analysed(inner)
        if name != "View":
            for child in members(plan.children()):
                self._analysed(child)

    def checked(self, query: str, args: dict[str, object] | None = None, limit: int = MAX_ROWS, generated: bool = False) -> DataFrame:
        """The query's rows, at most `limit`. It must be one statement that reads, over the graph's views, made of
        STEPS and EXPRESSIONS; its joins must go along the graph's relations and have keys unless one side has few
        rows. Values are bound, never spliced. A `generated` query must also pass lint()."""
        self._written(query)
        statement = f"SELECT * FROM (\n{query}\n) LIMIT {int(limit)}"
        try:
            seen = self._empty.sql(statement, args=args or {})
        except (ParseException, AnalysisException) as e:
            raise Rejected(str(e).splitlines()[0]) from None
        self._analysed(seen._jdf.queryExecution().analyzed())
        wrong = topology.faults(seen) + (lint(seen) if generated else [])
        if wrong:
            raise Rejected("; ".join(wrong))
        rows = self.spark.sql(statement, args=args or {})
        self._analysed(rows._jdf.queryExecution().analyzed())  # the caller's session may have functions of its own
        return rows

    def answered(self, question: str, schema: str, generate: Callable[[str, str, str | None], str], limit: int = MAX_ROWS) -> DataFrame:
        """The rows of the SQL that generate(question, schema, last error) writes, which may try again once."""
        error: str | None = None
        for _ in range(ATTEMPTS):
            try:
                return self.checked(generate(question, schema, error), limit=limit, generated=True)
            except Rejected as e:
                error = str(e)
        raise Rejected(error or "no query")


def _raw_name(lineage: Lineage, e: object) -> bool:
    return any(c.endswith("_nombre") for _, c in lineage.expression(e).columns)


def lint(df: DataFrame) -> list[str]:
    """What generated SQL should not do, over a shadow: search in names or show them folded, which is the resolution's
    work, and show anything but plain values."""
    out = [f"{f.name} isn't a plain value" for f in df.schema.fields if isinstance(f.dataType, T.ArrayType | T.MapType | T.StructType)]
    lineage = Lineage(topology.optimised(df))
    folded: set[int] = set()
    for node in lineage.nodes:
        for top in members(node.expressions()):
            todo = [top]
            while todo:
                e = todo.pop()
                kind = kind_of(e)
                if kind in MATCHING and _raw_name(lineage, e):
                    out.append("names are searched")
                if kind_of(top) == "Alias" and ((kind in FOLDING and _raw_name(lineage, e)) or (kind == "AttributeReference" and e.exprId().id() in folded)):
                    folded.add(top.exprId().id())
                todo += members(e.children())
    shown = {a.exprId().id() for a in members(topology.optimised(df).output())}
    if folded & shown:
        out.append("a folded name is shown")
    return list(dict.fromkeys(out))
