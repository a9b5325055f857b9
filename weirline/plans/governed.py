"""SQL text of an analyst, run on what they may see and on nothing else.

Spark's own parser tells which relations a text names, wherever they stand: joins,
subqueries, common table expressions. Each is looked up in the rules by its full name
and stands for a view of the part its reader may see. The views live in a session made
for the query, so the text can name no view of anyone else's. Only nodes of a query are
let through; a command, a path, a stream or a table in another version is refused.

What Spark's analyzer then made of the text is walked once more: every leaf must be one
of the views or hold no stored data. So a name that was resolved to anything else, for
whatever reason, denies the query instead of answering it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Mapping

from py4j.java_gateway import JavaObject, is_instance_of
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from weirline.operators.governance import AccessDenied, AccessRules, govern_as_view

_QUERY_NODES = frozenset(
    """
    Aggregate Deduplicate Distinct Except Expand Filter Generate GlobalLimit Intersect Join LateralJoin LocalLimit
    LocalRelation Offset OneRowRelation PipeOperator Pivot Project Sample Sort SubqueryAlias Tail Union UnresolvedHaving
    UnresolvedHint UnresolvedInlineTable UnresolvedRelation UnresolvedSubqueryColumnAliases UnresolvedTVFAliases
    UnresolvedTableValuedFunction UnresolvedWith Unpivot Window WithWindowDefinition
    """.split()
)
_LEAVES_WITHOUT_DATA = frozenset({"CTERelationRef", "LocalRelation", "OneRowRelation", "Range"})
#: Expressions that reach beyond the rows given: any Java method, and the files underneath.
_REFUSED_EXPRESSIONS = frozenset(
    """
    CallMethodViaReflection InputFileBlockLength InputFileBlockStart InputFileName PythonUDF ScalaUDF TryReflect
    """.split()
)


def run_governed(
    spark: SparkSession, rules: AccessRules, principal: str, text: str, names: Mapping[str, str] | None = None
) -> DataFrame:
    """The result of a query on the tables it names, as the principal may see them.

    Tables go by ``database.table``, or by their last name if they are in the current
    database or in ``names``, which gives full names by lower-case last names.
    """
    names = names or {}
    text = text.strip()
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    _require_query(plan, principal)
    session = _session_like(spark)
    views: dict[str, str] = {}
    edits: dict[tuple[int, int], str] = {}
    qualified: set[tuple[str, ...]] = set()
    defined = {n.lower() for node in _nodes(plan) for n in _names_of_expressions(node)}

    def view_of(parts: list[str], view: str) -> None:
        table = ".".join(parts)
        if parts[:-1] == ["spark_catalog"] or len(parts) > 3 or any("." in p for p in parts):
            raise AccessDenied(f"{principal} has no SELECT on {table}")
        try:
            govern_as_view(session, rules, principal, table, view)
        except AnalysisException as error:
            # Whether there is such a table is not for everyone to know.
            raise AccessDenied(f"{principal} has no SELECT on {table}") from error
        views[view] = table

    for node, parent in _with_parents(plan):
        if node.getClass().getSimpleName() != "UnresolvedRelation":
            continue
        if node.isStreaming():
            raise AccessDenied(f"{principal} may read tables, not streams")
        parts = _strings(node.multipartIdentifier())
        if len(parts) == 1:
            name = parts[0].lower()
            full = names.get(name, f"{spark.catalog.currentDatabase()}.{name}")
            if name in views:
                continue
            try:
                view_of(full.split("."), name)
            except AccessDenied:
                if name not in defined:
                    raise
            continue
        parts = [p.lower() for p in parts]
        view = next((v for v, t in views.items() if t == ".".join(parts) and v.startswith("governed_")), None)
        if view is None:
            view = f"governed_{uuid.uuid4().hex}"
            view_of(parts, view)
        start, stop = _place(node)
        named = parent is not None and parent.getClass().getSimpleName() == "SubqueryAlias"
        after_table = text[:start].split()[-1:] and text[:start].split()[-1].upper() == "TABLE"
        if named or after_table:
            edits[start, stop] = _quoted(view)
        else:
            qualified.add(tuple(parts))
            edits[start, stop] = f"{_quoted(view)} AS {_quoted(parts[-1])}"
    # Columns by database, table and name go by table and name: the database is not the view's.
    for expression in (e for node in _nodes(plan) for e in _expressions(node)):
        kind = expression.getClass().getSimpleName()
        if kind == "UnresolvedAttribute":
            parts = _strings(expression.nameParts())
        elif kind == "UnresolvedStar" and expression.target().isDefined():
            parts = [*_strings(expression.target().get()), "*"]
        else:
            continue
        for table in qualified:
            if len(parts) > len(table) and tuple(p.lower() for p in parts[: len(table)]) == table:
                kept = [*parts[len(table) - 1 : -1], parts[-1]]
                edits[_place(expression)] = ".".join(p if p == "*" else _quoted(p) for p in kept)
    result = session.sql(_edited(text, edits))
    _require_views_only(result, set(views), principal)
    return result


def _session_like(spark: SparkSession) -> SparkSession:
    """A session without temporary views, with the settings of this one."""
    session = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if key.startswith("spark.sql.") and session.conf.isModifiable(key):
            session.conf.set(key, value)
    return session


def _require_query(plan: JavaObject, principal: str) -> None:
    for node in _nodes(plan):
        kind = node.getClass().getSimpleName()
        if kind not in _QUERY_NODES:
            raise AccessDenied(f"{principal} may run queries; {kind} is none")


def _require_views_only(df: DataFrame, views: set[str], principal: str) -> None:
    def inside(node: JavaObject) -> bool:
        return node.getClass().getSimpleName() != "View" or node.desc().identifier().table().lower() not in views

    for node in _nodes(df._jdf.queryExecution().analyzed(), inside):
        kind = node.getClass().getSimpleName()
        if kind == "View":
            if inside(node):
                raise AccessDenied(f"{principal} has no SELECT on {node.desc().identifier().unquotedString()}")
            continue
        if node.children().isEmpty() and kind not in _LEAVES_WITHOUT_DATA:
            raise AccessDenied(f"{principal} may not read {kind}")
        for expression in _expressions(node):
            if expression.getClass().getSimpleName() in _REFUSED_EXPRESSIONS:
                raise AccessDenied(f"{principal} may not use {expression.prettyName()}")


# Spark's trees. Their nodes are the JVM's; a walk of a query's text is a few dozen of them.


def _each(sequence: JavaObject) -> Iterator[JavaObject]:
    found = sequence.iterator()
    while found.hasNext():
        yield found.next()


def _strings(sequence: JavaObject) -> list[str]:
    return list(_each(sequence))


def _expressions(node: JavaObject) -> Iterator[JavaObject]:
    """The expressions of a node, with those inside them."""
    waiting = list(_each(node.expressions()))
    while waiting:
        expression = waiting.pop()
        yield expression
        waiting.extend(_each(expression.children()))


def _is(value: JavaObject, name: str) -> bool:
    from pyspark import SparkContext

    return is_instance_of(SparkContext._gateway, value, name)


def _with_parents(
    plan: JavaObject, descend: Callable[[JavaObject], bool] = lambda node: True
) -> Iterator[tuple[JavaObject, JavaObject | None]]:
    waiting: list[tuple[JavaObject, JavaObject | None]] = [(plan, None)]
    while waiting:
        node, parent = waiting.pop()
        yield node, parent
        if not descend(node):
            continue
        waiting.extend((c, node) for c in _each(node.children()))
        waiting.extend((c, node) for c in _each(node.innerChildren()) if _is(c, f"{_CATALYST}.plans.logical.LogicalPlan"))
        for expression in _expressions(node):
            if _is(expression, f"{_CATALYST}.expressions.PlanExpression"):
                waiting.append((expression.plan(), None))


_CATALYST = "org.apache.spark.sql.catalyst"


def _nodes(plan: JavaObject, descend: Callable[[JavaObject], bool] = lambda node: True) -> Iterator[JavaObject]:
    return (node for node, _ in _with_parents(plan, descend))


def _names_of_expressions(node: JavaObject) -> list[str]:
    """The names that a node with common table expressions defines."""
    if node.getClass().getSimpleName() != "UnresolvedWith":
        return []
    return [relation._1() for relation in _each(node.cteRelations())]


def _place(node: JavaObject) -> tuple[int, int]:
    """Where a node stands in the text: its first sign, and the one behind its last."""
    origin = node.origin()
    return origin.startIndex().get(), origin.stopIndex().get() + 1


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _edited(text: str, edits: Mapping[tuple[int, int], str]) -> str:
    for (start, stop), new in sorted(edits.items(), reverse=True):
        text = text[:start] + new + text[stop:]
    return text
