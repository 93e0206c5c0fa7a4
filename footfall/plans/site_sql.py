"""A tenant's own read-only SQL. The query sees the usual table names, but in a session of its own
where each name is a view of that tenant's rows; values are bound, never pasted into the text. What a query
may do is decided on Spark's own plans of it, before and after names are resolved, by lists of what is allowed."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession

ROW_CAP = 1000
MAX_LENGTH = 20_000
#: Groups of built-in functions, as Spark documents them. Not among them: misc (Java methods, file names, users,
#: versions, errors), XML, files of other formats.
FUNCTION_GROUPS = frozenset([
    "agg_funcs", "array_funcs", "bitwise_funcs", "collection_funcs", "conditional_funcs", "conversion_funcs", "datetime_funcs",
    "generator_funcs", "hash_funcs", "json_funcs", "lambda_funcs", "map_funcs", "math_funcs", "predicate_funcs", "sketch_funcs",
    "string_funcs", "struct_funcs", "url_funcs", "variant_funcs", "window_funcs"])
#: Allowed functions of other groups.
FUNCTIONS = frozenset(["typeof", "bitmap_bit_position", "bitmap_bucket_number"])
#: What a resolved plan may be made of.
OPERATORS = frozenset([
    "Project", "Filter", "Aggregate", "Join", "Sort", "GlobalLimit", "LocalLimit", "Offset", "Distinct", "Deduplicate", "Union",
    "Intersect", "Except", "SubqueryAlias", "Window", "Expand", "Generate", "LateralJoin", "AsOfJoin", "Sample", "Pivot",
    "Unpivot", "WithCTE", "CTERelationDef", "CTERelationRef", "OneRowRelation", "LocalRelation", "View"])
#: Packages of Spark's own expressions, and those of them that run other code than their own.
EXPRESSIONS = "org.apache.spark.sql.catalyst."
FOREIGN_CODE = frozenset(["CallMethodViaReflection", "TryReflect", "ScalaUDF", "ScalaUDAF", "ScalaAggregator", "PythonUDF", "PythonUDAF",
                          "PythonUDTF", "UserDefinedExpression", "InputFileName", "InputFileBlockStart", "InputFileBlockLength"])
_VARIABLE = re.compile(r"\{\{\s*([a-zA-Z_][a-zA-Z0-9_]*)\s*\}\}")


def template_variables(text: str) -> list[str]:
    """Names used as {{name}}, in order of first use."""
    return list(dict.fromkeys(_VARIABLE.findall(text)))


def _items(sequence: JavaObject) -> list:
    return [sequence.apply(k) for k in range(sequence.size())]


def _class(node: JavaObject) -> str:
    return node.getClass().getName()


def _is_plan(node: JavaObject) -> bool:
    return not _class(node).startswith(f"{EXPRESSIONS}expressions.") and hasattr(node, "expressions") and hasattr(node, "resolveOperators")


def _nodes(plan: JavaObject, below: Callable[[JavaObject], bool]) -> Iterator[tuple[bool, JavaObject]]:
    """(is it an operator, node) of a plan, its sub-queries and expressions. `below`: whether to look under an operator."""
    open_ = [(True, plan)]
    while open_:
        is_operator, node = open_.pop()
        yield is_operator, node
        if is_operator:
            if not below(node):
                continue
            open_ += [(True, c) for c in _items(node.children())]
            open_ += [(False, e) for e in _items(node.expressions())]
            open_ += [(True, c) for c in _items(node.innerChildren())]
        else:
            open_ += [(False, c) for c in _items(node.children())]


def _check_parsed(session: SparkSession, parsed: JavaObject, tables: set[str]) -> None:
    """Names as written: only the given tables (or names that exist nowhere, such as those of WITH), only allowed
    functions, and no names that are computed. Refused before Spark looks them up, so that not even an error tells
    about them."""
    catalog = session._jsparkSession.sessionState().catalog()
    identifier = session._jvm.org.apache.spark.sql.catalyst.FunctionIdentifier
    for _, node in _nodes(parsed, lambda _: True):
        kind = _class(node).rsplit(".", 1)[-1]
        if "UnresolvedIdentifier" in kind:
            raise PermissionError("names can't be computed")
        if kind == "UnresolvedRelation":
            parts = list(map(str, _items(node.multipartIdentifier())))
            if len(parts) > 1 or parts[0].lower() not in tables and session.catalog.tableExists(parts[0]):
                raise PermissionError(f"{'.'.join(parts)} is not one of the tables {', '.join(sorted(tables))}")
        elif kind in ("UnresolvedFunction", "UnresolvedTableValuedFunction", "UnresolvedGenerator"):
            name = node.name() if kind == "UnresolvedGenerator" else node.nameParts() if kind == "UnresolvedFunction" else node.name()
            parts = [name.funcName()] if kind == "UnresolvedGenerator" else list(map(str, _items(name)))
            function = parts[-1].lower()
            if len(parts) > 1:
                raise PermissionError(f"function {'.'.join(parts)} is not allowed")
            known = identifier(function)
            if not catalog.functionExists(known):
                continue  # Spark's own error names it
            about = catalog.lookupFunctionInfo(known)
            if function not in FUNCTIONS and (about.getSource() != "built-in" or about.getGroup() not in FUNCTION_GROUPS):
                raise PermissionError(f"function {function} is not allowed")


def _check_resolved(resolved: JavaObject, tables: set[str]) -> None:
    """All rows come from the tenant's views, and nothing runs other code than Spark's."""
    for is_operator, node in _nodes(resolved, lambda n: not _class(n).endswith(".View")):
        kind = _class(node).rsplit(".", 1)[-1].rstrip("$")
        if is_operator:
            if kind not in OPERATORS:
                raise PermissionError(f"{kind} is not allowed")
            if kind == "View" and not (node.isTempView() and node.desc().identifier().database().isEmpty()
                                       and node.desc().identifier().table().lower() in tables):
                raise PermissionError(f"{node.desc().identifier().toString()} is not one of the tables {', '.join(sorted(tables))}")
        elif kind in FOREIGN_CODE or not _class(node).startswith(EXPRESSIONS):
            raise PermissionError(f"{kind} is not allowed")


def site_sql(
    spark: SparkSession, text: str, site_id: str,
    open_tables: Callable[[SparkSession], dict[str, DataFrame]],
    variables: dict[str, object] | None = None, row_cap: int = ROW_CAP, explain: bool = False,
) -> DataFrame:
    """Run `text` over the tenant's rows, at most `row_cap` of them. `open_tables` opens the tables
    by name in the session it is given. {{name}} becomes a bound parameter: {{site_id}} is the
    tenant, names without a value are NULL. With `explain` the plan comes back, as one row, and nothing is run.

    The text can only read: it runs as a sub-query, where Spark's parser takes neither commands nor a second
    statement. Files can't be named as tables, and no table but the given ones can be read."""
    if len(text) > MAX_LENGTH:
        raise ValueError(f"the query has more than {MAX_LENGTH} characters")
    session = spark.newSession()
    session.conf.set("spark.sql.runSQLOnFiles", "false")
    for key in ("spark.sql.session.timeZone", "spark.sql.ansi.enabled", "spark.sql.shuffle.partitions"):
        session.conf.set(key, spark.conf.get(key))
    tables = open_tables(session)
    names = {name.lower() for name in tables}
    given = {**(variables or {}), "site_id": site_id}
    args = {name: given.get(name) for name in template_variables(text)}
    query = "SELECT * FROM (\n" + _VARIABLE.sub(r":\1", text).rstrip().rstrip(";") + "\n) AS _query"
    _check_parsed(session, session._jsparkSession.sessionState().sqlParser().parsePlan(query), names)
    for name, table in tables.items():
        table.filter(table["site_id"] == site_id).createOrReplaceTempView(name)
    found = session.sql(query, args=args)
    _check_resolved(found._jdf.queryExecution().analyzed(), names)
    capped = found.limit(row_cap)
    if explain:
        return session.createDataFrame([(capped._jdf.queryExecution().toString(),)], "plan string")
    return capped
