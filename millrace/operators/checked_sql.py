"""SQL steps: one SELECT over named inputs, checked on Spark's own parse tree.

The check walks the parsed plan before anything is analysed or run. It allows a list of plan nodes
and a list of functions, so commands, file paths, table functions, scripts and JVM calls are all
refused for not being listed.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from millrace.errors import InvalidInput
from millrace.functions.dialect import RENAMED, prepare_session, spark_pattern
from millrace.functions.expressions import MAX_EXPRESSION

# The functions a SQL step may call, as users write them.
AGGREGATES = """count sum min max avg mean median stddev variance count_distinct
    approx_count_distinct first last list string_agg""".split()
SCALARS = """abs round ceil floor coalesce nullif cast try_cast upper lower trim ltrim rtrim length
    substring substr replace concat concat_ws left right lpad rpad reverse contains starts_with
    ends_with position strlen year month day hour minute second date_part date_trunc date_diff
    datediff now current_date strftime strptime greatest least sign power pow sqrt exp ln log mod
    row_number rank dense_rank lag lead sum_over ifnull if case typeof to_json json_extract""".split()
SCHEMAS = ("", "main", "memory", "temp")
MAX_QUERY = 100_000

# Names Spark itself gives to operators its parser reads as functions, plus the names this module
# puts in their place.
_SPARK_SPELLINGS = ("and", "or", "not", "startswith", "endswith", "octet_length", "listagg",
                    "collect_list", "date_format", "to_timestamp", "get_json_object", "try_divide",
                    "grouping", "grouping_id")

ALLOWED_FUNCTIONS = frozenset([*AGGREGATES, *SCALARS, *_SPARK_SPELLINGS, *RENAMED.values()])

# Plan nodes a SELECT is made of.
_NODES = frozenset(
    """Project Filter Join Aggregate Sort GlobalLimit LocalLimit Offset Distinct SubqueryAlias
    UnresolvedSubqueryColumnAliases UnresolvedWith UnresolvedHaving
    WithWindowDefinition UnresolvedRelation UnresolvedInlineTable OneRowRelation LocalRelation
    Union Intersect Except LateralJoin""".split()
)
# Expressions a SELECT's text may parse to: names, literals, operators, predicates, casts, CASE, calls (whose names are checked),
# windows, grouping and subqueries. A kind that isn't listed is refused, so a call can't hide in one that is new or rare.
_EXPRESSIONS = frozenset(
    """UnresolvedAttribute AttributeReference UnresolvedStar UnresolvedStarExceptOrReplace UnresolvedAlias Alias
    UnresolvedOrdinal Literal UnresolvedExtractValue CreateNamedStruct
    Add Subtract Multiply Divide Remainder IntegralDivide UnaryMinus UnaryPositive BitwiseAnd BitwiseOr BitwiseXor BitwiseNot
    And Or Not EqualTo EqualNullSafe LessThan LessThanOrEqual GreaterThan GreaterThanOrEqual
    In InSubquery ListQuery ScalarSubquery Exists IsNull IsNotNull Like ILike LikeAll LikeAny NotLikeAll NotLikeAny RLike
    CaseWhen Cast Concat UnresolvedFunction StringTrim StringTrimLeft StringTrimRight StringTrimBoth StringLocate Substring
    TimestampAdd TimestampDiff SortOrder UnresolvedWindowExpression WindowExpression WindowSpecDefinition
    SpecifiedWindowFrame UnspecifiedFrame$ CurrentRow$ UnboundedPreceding$ UnboundedFollowing$ RowFrame$ RangeFrame$
    Rollup Cube GroupingSets""".split()
)
# Those that a formula over one row can't have.
_NOT_IN_FORMULAS = frozenset("""ScalarSubquery Exists ListQuery InSubquery UnresolvedExtractValue UnresolvedStar UnresolvedStarExceptOrReplace
    WindowExpression UnresolvedWindowExpression WindowSpecDefinition SpecifiedWindowFrame UnspecifiedFrame$ CurrentRow$ UnboundedPreceding$
    UnboundedFollowing$ RowFrame$ RangeFrame$ Rollup Cube GroupingSets SortOrder""".split())
# What runs code of its own, wherever analysis may have put it.
_FOREIGN = frozenset("CallMethodViaReflection TryReflect PythonUDF ScalaUDF HiveSimpleUDF HiveGenericUDF".split())
_SET_OPERATIONS = frozenset({"Union", "Intersect", "Except"})
_WRAPPERS = frozenset({"UnresolvedWith", "Sort", "GlobalLimit", "LocalLimit", "Offset", "Distinct"})


def _items(seq):
    return [seq.apply(i) for i in range(seq.size())]


def _text(option):
    return option.get() if option.isDefined() else None


def _expressions(node):
    stack = _items(node.expressions())
    if node.getClass().getSimpleName() == "WithWindowDefinition":
        stack.extend(_items(node.windowDefinitions().values().toSeq()))
    while stack:
        expression = stack.pop()
        yield expression
        stack.extend(_items(expression.children()))


def _plan_nodes(plan):
    """Every plan node of a SELECT, subqueries and CTE bodies included, with the CTE names it may read; anything
    else is refused. A CTE's body sees the names before it, not its own."""
    stack = [(plan, frozenset())]
    while stack:
        node, visible = stack.pop()
        kind = node.getClass().getSimpleName()
        if kind not in _NODES:
            raise InvalidInput(f"{node.nodeName()} is not part of a SELECT over the inputs")
        yield node, visible
        if kind == "UnresolvedWith":
            for cte in _items(node.cteRelations()):
                stack.append((cte._2(), visible))
                visible |= {cte._1().lower()}
        else:
            stack.extend((inner, visible) for inner in _items(node.innerChildren()))
        stack.extend((child, visible) for child in _items(node.children()))


_WHOLE_TYPES = frozenset({"tinyint", "smallint", "int", "bigint"})
_A_NUMBER = re.compile(r"\s*-?[0-9]+\s*")
_NON_ZERO = re.compile(r"[0-9.]*[1-9][0-9.]*")
_HAS_NULL_ORDER = re.compile(r"\bnulls\s+(first|last)\s*$", re.IGNORECASE)
_OPEN = re.compile(r"\s*\(")


class _Edits:
    """Changes to a text at the positions the parser reports: ranges replaced, ranges wrapped."""

    def __init__(self, text: str):
        self.text, self.replaced, self.wrapped = text, {}, []

    def span(self, node) -> tuple[int, int] | None:
        start, stop = _text(node.origin().startIndex()), _text(node.origin().stopIndex())
        return None if start is None or stop is None else (start, stop + 1)

    def replace(self, start: int, stop: int, by: str) -> None:
        self.replaced[start] = (stop, by)

    def wrap(self, span: tuple[int, int], before: str, after: str) -> None:
        if (span, before, after) not in self.wrapped:
            self.wrapped.append((span, before, after))

    def rename(self, span: tuple[int, int], name: str, by: str) -> None:
        """Replace the function name a call begins with, and its parenthesis if `by` brings one."""
        start = span[0]
        if self.text[start:start + len(name)].lower() == name:
            end = start + len(name)
            self.replace(start, _OPEN.match(self.text, end).end() if by.endswith(("(", " ")) else end, by)

    def made(self) -> str:
        size = lambda w: w[0][1] - w[0][0]
        opens = sorted(self.wrapped, key=size, reverse=True)
        closes = opens[::-1]
        out, at = [], 0
        while at <= len(self.text):
            out += [after for span, _, after in closes if span[1] == at]
            out += [before for span, before, _ in opens if span[0] == at]
            if at in self.replaced:
                at, by = self.replaced[at]
                out.append(by)
            else:
                out.append(self.text[at:at + 1])
                at += 1
        return "".join(out)


def _respell(expression, kind: str, edits: _Edits) -> None:
    """One dialect for steps and formulas, where Spark's differs: NULL for a zero divisor, NULLs last in any
    order, casts to whole numbers that round, lists that keep NULLs, texts cut from place 0, and functions under their
    written names."""
    span = edits.span(expression)
    if span is None:
        return

    def from_place(start, size) -> None:
        """Place 0 lies before the first character, so one character less is left."""
        start, size = edits.span(start), edits.span(size)
        if start and size:
            place = edits.text[slice(*start)]
            if not (_A_NUMBER.fullmatch(place) and int(place)):
                edits.wrap(size, "(", f") - CAST(({place}) = 0 AS INT)")

    if kind in ("Divide", "Remainder", "IntegralDivide"):
        divisor = edits.span(expression.right())
        if divisor and not _NON_ZERO.fullmatch(edits.text[slice(*divisor)]):
            edits.wrap(divisor, "nullif(", ", 0)")
    elif kind == "SortOrder":
        if not _HAS_NULL_ORDER.search(edits.text[slice(*span)]):
            edits.wrap(span, "", " NULLS LAST")
    elif kind == "Cast":
        inner = edits.span(expression.child())
        if inner and str(expression.dataType().simpleString()) in _WHOLE_TYPES and not _A_NUMBER.fullmatch(edits.text[slice(*inner)]):
            cast = "TRY_CAST" if str(expression.evalMode()) == "TRY" else "CAST"
            edits.wrap(inner, f"round({cast}(", " AS DECIMAL(38, 18)))")
    elif kind == "Substring":
        from_place(expression.pos(), expression.len())
    elif kind == "UnresolvedFunction":
        name, given = _items(expression.nameParts())[-1].lower(), _items(expression.arguments())
        literal = lambda e: str(e.toString()) if e.getClass().getSimpleName() == "Literal" else None
        if name == "count_distinct":
            edits.rename(span, name, "count(DISTINCT ")
        elif name in ("substring", "substr") and len(given) == 3:
            from_place(given[1], given[2])
        elif name == "list" and len(given) == 1 and edits.span(given[0]):
            edits.rename(span, name, "collect_list")
            edits.wrap(edits.span(given[0]), "named_struct('v', ", ")")
            edits.wrap(span, "(", ").v")
        elif name == "to_json" and len(given) == 1:
            edits.rename(span, name, "nullif(regexp_replace(to_json(array(")
            edits.wrap(span, "", "), '^.|.$', ''), 'null')")
        elif name in ("strftime", "strptime") and len(given) == 2 and literal(given[1]) is not None and edits.span(given[1]):
            edits.rename(span, name, "date_format" if name == "strftime" else "to_timestamp")
            edits.replace(*edits.span(given[1]), '"' + spark_pattern(literal(given[1])).replace("\\", "\\\\").replace('"', '\\"') + '"')
        elif name == "date_part" and len(given) == 2 and (literal(given[0]) or "").lower() in ("dow", "dayofweek"):
            edits.wrap(span, "(", " - 1)")
        elif name in RENAMED:
            edits.rename(span, name, RENAMED[name])


def _check_functions(node, edits: _Edits) -> None:
    for expression in _expressions(node):
        kind = expression.getClass().getSimpleName()
        if kind == "UnresolvedFunction":
            parts = _items(expression.nameParts())
            if len(parts) > 1 or parts[-1].lower() not in ALLOWED_FUNCTIONS:
                raise InvalidInput(f"function {'.'.join(parts)!r} is not allowed in a SQL step")
        elif kind not in _EXPRESSIONS:
            raise InvalidInput(f"{kind} is not allowed in a SQL step")
        _respell(expression, kind, edits)


def _parser(spark: SparkSession):
    return spark._jsparkSession.sessionState().sqlParser()


# DuckDB-style quoted unit, which Spark's grammar refuses before any check can run.
_QUOTED_UNIT = re.compile(r"\b(date_diff|datediff)\s*\(\s*'(\w+)'\s*,", re.IGNORECASE)


def _spell(query: str) -> str:
    return _QUOTED_UNIT.sub(lambda m: f"{RENAMED['date_diff']}('{m.group(2)}',", query)


def check_sql(spark: SparkSession, query: str, inputs: list[str]) -> str:
    """Raise InvalidInput unless `query` is one SELECT over `inputs`; return it in Spark spelling."""
    if not query or len(query) > MAX_QUERY:
        raise InvalidInput("the query is empty or too long")
    text = _spell(query.strip().rstrip(";"))
    try:
        plan = _parser(spark).parsePlan(text)
    except Exception as error:
        raise InvalidInput("the SQL could not be parsed") from error
    top = plan
    while top.getClass().getSimpleName() in _WRAPPERS:
        top = top.child()
    if top.getClass().getSimpleName() in _SET_OPERATIONS:
        raise InvalidInput("a set operation may not be the top-level statement")
    allowed = {name.lower() for name in inputs}
    edits = _Edits(text)
    for node, visible in list(_plan_nodes(plan)):
        if node.getClass().getSimpleName() == "UnresolvedRelation":
            parts = _items(node.multipartIdentifier())
            schema = parts[0].lower() if len(parts) == 2 else ""
            if len(parts) > 2 or schema not in SCHEMAS or parts[-1].lower() not in (allowed if schema else allowed | visible):
                raise InvalidInput(f"{'.'.join(parts)!r} is not an input of this step")
            if len(parts) == 2:
                edits.replace(*edits.span(node), f"`{parts[-1]}`")
        _check_functions(node, edits)
    return edits.made()


def sql_step(inputs: list[DataFrame], query: str) -> DataFrame:
    """Run a checked SELECT over `in_1`, `in_2`, … in a session of its own."""
    if not inputs:
        raise InvalidInput("a SQL step needs at least one input")
    spark = inputs[0].sparkSession
    names = [f"in_{i}" for i in range(1, len(inputs) + 1)]
    text = check_sql(spark, query, names)
    session = prepare_session(spark)
    for name, frame in zip(names, inputs):
        _view(session, frame, name)
    out = session.sql(text)
    # The inputs may hold any code their makers ran; what the query adds above them may not.
    _refuse_foreign(out, {frame._jdf.queryExecution().analyzed().hashCode() for frame in inputs})
    return out


def _refuse_foreign(df: DataFrame, inputs: set[int]) -> None:
    stack = [df._jdf.queryExecution().analyzed()]
    while stack:
        node = stack.pop()
        if node.hashCode() in inputs:
            continue
        waiting = _items(node.expressions())
        while waiting:
            expression = waiting.pop()
            kind = expression.getClass().getSimpleName()
            if kind in _FOREIGN:
                raise InvalidInput(f"{kind} is not allowed in a SQL step")
            if hasattr(expression, "plan") and kind in ("ScalarSubquery", "ListQuery", "Exists"):
                stack.append(expression.plan())
            waiting.extend(_items(expression.children()))
        stack.extend(_items(node.children()))


def _view(session: SparkSession, frame: DataFrame, name: str) -> None:
    """Register `frame` in `session` only, whichever session it was built in."""
    plan = frame._jdf.queryExecution().analyzed()
    dataset = session._jvm.org.apache.spark.sql.classic.Dataset.ofRows(session._jsparkSession, plan)
    DataFrame(dataset, session).createOrReplaceTempView(name)


def checked_expression(df: DataFrame, expression: str) -> Column:
    """A SQL expression string over the columns of `df`, in the dialect of SQL steps: same scalar functions, a zero
    divisor gives NULL, no subquery and no window."""
    if not expression or len(expression) > MAX_EXPRESSION:
        raise InvalidInput("the expression is empty or too long")
    try:
        parsed = _parser(df.sparkSession).parseExpression(expression)
    except Exception as error:
        raise InvalidInput("the expression has a syntax error") from error
    stack, edits = [parsed], _Edits(expression)
    while stack:
        node = stack.pop()
        kind = node.getClass().getSimpleName()
        if kind not in _EXPRESSIONS or kind in _NOT_IN_FORMULAS:
            raise InvalidInput(f"{kind} is not allowed in an expression")
        if kind == "UnresolvedFunction":
            parts = _items(node.nameParts())
            if len(parts) > 1 or parts[0].lower() not in ALLOWED_FUNCTIONS - set(AGGREGATES):
                raise InvalidInput(f"function {'.'.join(parts)!r} is not allowed")
        if kind == "UnresolvedAttribute":
            name = ".".join(_items(node.nameParts()))
            if name.lower() not in {c.lower() for c in df.columns}:
                raise InvalidInput(f"unknown column {name!r}")
        _respell(node, kind, edits)
        stack.extend(_items(node.children()))
    return F.expr(edits.made())
