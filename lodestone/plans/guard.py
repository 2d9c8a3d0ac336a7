"""Governed SQL: a statement is checked on Spark's own parsed plan, bounded, then run.

Nothing here parses SQL: Spark does, and the checks walk the plan it returns, which may hold listed
nodes alone. A name without a schema must be that of a CTE in whose scope it stands. Only what the plan
can't tell any more is looked up in the text (several statements, SELECT INTO).
"""

from __future__ import annotations

import re
import threading
import time
from dataclasses import dataclass, field
from datetime import date
from decimal import Decimal

from pyspark.errors import ParseException
from pyspark.sql import DataFrame, SparkSession

from .reporting import VIEWS

# The functions a statement may call, and plan nodes that stand for operators.
FUNCTIONS = ("count", "sum", "avg", "min", "max")
BLOCKED_FUNCTIONS = ("copy", "dblink", "lo_export", "lo_import", "pg_read_file", "pg_sleep", "pg_write_file")
OPERATORS = ("between", "and", "or", "not", "in", "like", "ilike", "||", "concat", "=", "<", ">", "<=", ">=", "<>", "+", "-", "*", "/", "%", "isnull", "isnotnull")
# expressions and plans that a statement may be made of; all others are refused. Row values share their node with struct() and are refused with it
EXPRESSIONS = (
    "Literal", "UnresolvedAttribute", "UnresolvedAlias", "Alias", "UnresolvedFunction", "UnresolvedStar", "SortOrder", "ScalarSubquery", "InSubquery", "ListQuery",
    "And", "Or", "Not", "In", "IsNull", "IsNotNull", "Like", "ILike", "LikeAny", "LikeAll", "NotLikeAny", "NotLikeAll", "RLike",
    "EqualTo", "EqualNullSafe", "GreaterThan", "GreaterThanOrEqual", "LessThan", "LessThanOrEqual",
    "Add", "Subtract", "Multiply", "Divide", "IntegralDivide", "Remainder", "UnaryMinus", "UnaryPositive", "Concat", "BitwiseAnd", "BitwiseOr", "BitwiseXor", "BitwiseNot",
    "WindowExpression", "UnresolvedWindowExpression", "WindowSpecDefinition", "SpecifiedWindowFrame", "UnspecifiedFrame$", "CurrentRow$", "UnboundedPreceding$", "UnboundedFollowing$",
    "GroupingSets", "Rollup", "Cube",
)
PLANS = (
    "Project", "Aggregate", "Filter", "UnresolvedHaving", "Distinct", "Sort", "GlobalLimit", "LocalLimit", "LimitAll", "Offset", "Join", "Union", "Intersect", "Except",
    "SubqueryAlias", "UnresolvedSubqueryColumnAliases", "UnresolvedWith", "WithWindowDefinition", "UnresolvedRelation", "OneRowRelation", "UnresolvedHint",
)
SAMPLED = ("UnresolvedRelation", "SubqueryAlias", "Join", "OneRowRelation")  # a limit right above one of these is TABLESAMPLE (n ROWS)
INLINE = ("UnresolvedInlineTable", "ResolvedInlineTable", "LocalRelation", "Range")
ROOTS = ("Project", "Aggregate", "Filter", "UnresolvedHaving", "Distinct", "Sort", "GlobalLimit", "LocalLimit", "Offset", "UnresolvedWith", "WithWindowDefinition", "LimitAll", "SubqueryAlias", "UnresolvedHint")
DEFAULT_LIMIT, MAX_LIMIT = 100, 200
MESSAGES = {
    "EMPTY_SQL": "SQL must not be empty",
    "MULTI_STATEMENT": "Only one SQL statement is allowed",
    "PARSE_ERROR": "The statement can't be parsed",
    "NON_SELECT_STATEMENT": "Only SELECT statements are allowed",
    "SELECT_INTO": "SELECT INTO is not allowed",
    "BLOCKED_STATEMENT": "Statements that change data or objects are not allowed",
    "SELECT_STAR": "Columns must be named one by one",
    "SCHEMA_REQUIRED": "Views must be named with their schema",
    "NON_REPORTING_SCHEMA": "Only the reporting schema may be read",
    "TABLE_NOT_ALLOWED": "This view may not be read",
    "BLOCKED_FUNCTION": "This function is blocked",
    "FUNCTION_NOT_ALLOWED": "This function or operation is not allowed",
    "INVALID_LIMIT": "LIMIT must be a positive whole number",
}


@dataclass
class Guarded:
    sql: str
    violations: list[str] = field(default_factory=list)
    limit: int = DEFAULT_LIMIT
    rewritten: bool = False

    @property
    def valid(self) -> bool:
        return not self.violations

    @property
    def messages(self) -> list[tuple[str, str]]:
        return [(code, MESSAGES[code]) for code in self.violations]


def _statements(sql: str) -> list[str]:
    """The text split at semicolons outside quotes and comments."""
    parts = re.findall(r"(?:'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`|--[^\n]*|/\*.*?\*/|[^;])+", sql, re.S)
    return [p for p in parts if re.sub(r"--[^\n]*|/\*.*?\*/", "", p, flags=re.S).strip()]


def _seq(items) -> list:
    return [items.apply(i) for i in range(items.size())]


def _kids(node, inside: frozenset[str]) -> list[tuple]:
    """Plans and expressions right below a plan or expression, each with the names of CTEs that it sees."""
    name = node.getClass().getSimpleName()
    if name == "UnresolvedWith":
        out = []
        for relation in _seq(node.cteRelations()):  # a relation sees those before it, and itself if it recurs
            own = {str(relation._1()).lower()}
            out.append((relation._2(), inside | own if node.allowRecursion() else inside))
            inside |= own
        return [*out, *((k, inside) for k in _seq(node.children()))]
    if name in INLINE:
        return []  # refused as a table, whatever it holds
    below = _seq(node.children())
    if _is("LogicalPlan", node):
        below += _seq(node.expressions())
    elif _is("PlanExpression", node):
        below.append(node.plan())
    return [(k, inside) for k in below if k is not None]


_KINDS: dict[tuple[str, str], bool] = {}


def _is(kind: str, node) -> bool:
    """Whether a node's class or one above it has this simple name; known by class once asked."""
    c = node.getClass()
    key = kind, c.getName()
    if key not in _KINDS:
        while c is not None and c.getSimpleName() != kind:
            c = c.getSuperclass()
        _KINDS[key] = c is not None
    return _KINDS[key]


def _walk(node):
    """Every node below and the names of CTEs it sees."""
    stack = [(node, frozenset())]
    while stack:
        x, inside = stack.pop()
        yield x, inside
        stack += _kids(x, inside)


def validate(spark: SparkSession, sql: str, schema: str = "reporting", views: tuple[str, ...] = tuple(VIEWS), functions: tuple[str, ...] = FUNCTIONS, blocked: tuple[str, ...] = BLOCKED_FUNCTIONS, default_limit: int = DEFAULT_LIMIT, max_limit: int = MAX_LIMIT) -> Guarded:
    """Violations of a statement, all of them; those of its syntax end the check. It needs a classic session, whose parser it asks."""
    if not 1 <= default_limit <= max_limit:
        raise ValueError("limits must be 1 <= default_limit <= max_limit")
    out = Guarded(sql.strip(), limit=default_limit)
    parts = _statements(out.sql)
    if not parts:
        out.violations.append("EMPTY_SQL")
        return out
    if len(parts) > 1:
        out.violations.append("MULTI_STATEMENT")
        return out
    out.sql = parts[0].strip()
    bare = re.sub(r"'(?:[^'\\]|\\.|'')*'", "''", out.sql)
    if re.search(r"(?is)^\s*select\b.*\binto\s+\w+", bare):
        out.violations.append("SELECT_INTO")
        return out
    try:
        root = spark._jsparkSession.sessionState().sqlParser().parsePlan(out.sql)
    except ParseException:
        out.violations.append("PARSE_ERROR")
        return out
    top, kind = root, root.getClass().getSimpleName()
    limit = None
    while kind in ROOTS and kind not in ("Project", "Aggregate", "Filter"):
        if kind == "GlobalLimit":
            limit = top.limitExpr()
        below = top.children()
        if not below.size():
            break
        top = below.apply(0)
        kind = top.getClass().getSimpleName()
    found: list[str] = []
    if kind not in ("Project", "Aggregate", "Filter"):
        found.append("NON_SELECT_STATEMENT")
    for n, names in _walk(root):
        c = n.getClass().getSimpleName()
        plan = _is("LogicalPlan", n)
        if plan and re.search(r"Command$|^(InsertInto|DeleteFrom|Update|Merge|Create|Drop|Alter|Replace|Truncate|SetCatalog)", c):
            found.append("BLOCKED_STATEMENT")
        elif c == "UnresolvedStar":
            found.append("SELECT_STAR")
        elif c == "UnresolvedRelation":
            name = [str(x).lower() for x in _seq(n.multipartIdentifier())]
            if len(name) == 1:
                if name[0] not in names:
                    found.append("SCHEMA_REQUIRED")
            elif len(name) != 2 or name[0] != schema:
                found.append("NON_REPORTING_SCHEMA")
            elif name[1] not in views or n.isStreaming():
                found.append("TABLE_NOT_ALLOWED")
        elif c == "UnresolvedFunction":
            name = str(n.nameParts().apply(n.nameParts().size() - 1)).lower()
            if name in blocked:
                found.append("BLOCKED_FUNCTION")
            elif name not in functions and name not in OPERATORS:
                found.append("FUNCTION_NOT_ALLOWED")
        elif c in INLINE:
            found.append("TABLE_NOT_ALLOWED")
        elif found[:1] == ["NON_SELECT_STATEMENT"]:
            pass  # its own nodes are no select's
        elif c not in (PLANS if plan else EXPRESSIONS) or c == "UnresolvedAttribute" and str(n.name()).lower() in ("current_date", "current_timestamp", "current_user", "user"):
            found.append("FUNCTION_NOT_ALLOWED")
        elif c == "LocalLimit" and n.children().apply(0).getClass().getSimpleName() in SAMPLED:
            found.append("FUNCTION_NOT_ALLOWED")
    if limit is not None:
        text = str(limit.toString())
        if limit.getClass().getSimpleName() != "Literal" or not text.isdigit() or int(text) < 1:
            found.append("INVALID_LIMIT")
        else:
            out.limit = min(int(text), max_limit)
            out.rewritten = int(text) > max_limit
    else:
        out.rewritten = True
    out.violations = list(dict.fromkeys(found))
    return out


def bounded(spark: SparkSession, guarded: Guarded, schema: str = "reporting") -> DataFrame:
    """The statement's rows, at most its limit. The views are this session's `reporting_<view>`."""
    if not guarded.valid:
        raise PermissionError(", ".join(guarded.violations))
    # literals and comments stay as they are; names may stand in backticks
    named = re.compile(rf"('(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|--[^\n]*|/\*.*?\*/)|(?<![\w`.])`?{re.escape(schema)}`?\s*\.\s*(?:`(\w+)`|(\w+))", re.I | re.S)
    return spark.sql(named.sub(lambda m: m[1] or f"{schema}_{m[2] or m[3]}", guarded.sql)).limit(guarded.limit)


def plain(value):
    """A result's value as JSON has it: whole decimals as int, others as float, dates and times in ISO form."""
    if isinstance(value, Decimal):
        return int(value) if value == value.to_integral_value() else float(value)
    return value.isoformat() if isinstance(value, date) else value


def execute(spark: SparkSession, guarded: Guarded, timeout_s: float = 5.0, shown: int = 20) -> dict:
    """executed_sql, columns, rows (at most the limit), row_count, a preview and latency_ms; the job is cancelled after the timeout."""
    began = time.monotonic()
    context, group = spark.sparkContext, f"guarded-{id(guarded)}"
    timer = threading.Timer(timeout_s, lambda: context.cancelJobGroup(group))
    context.setJobGroup(group, "governed statement", interruptOnCancel=True)
    timer.start()
    try:
        df = bounded(spark, guarded)
        rows = [{k: plain(v) for k, v in r.asDict().items()} for r in df.collect()]
    finally:
        timer.cancel()
        context.setLocalProperty("spark.jobGroup.id", None)
    return {"executed_sql": guarded.sql, "latency_ms": int((time.monotonic() - began) * 1000), "columns": df.columns, "rows": rows, "row_count": len(rows), "preview": rows[:shown]}
