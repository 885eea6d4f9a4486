"""Definitions inside Python source text.

The only Python-worker code of the library. Both functions are Arrow-batched
and receive nothing but the source column; only names and line numbers come back, and
everything around them (bodies, pairing, normalising, comparing) stays in the JVM. A source
that is too deep for the parser is read by ``source_scan`` instead.
"""

from __future__ import annotations

import ast
from collections import deque
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from taskmine.functions import source_scan

FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)
UNREADABLE = object()
STATEMENTS = (ast.stmt, ast.excepthandler, ast.match_case)
# types as objects: a DDL string could not be read before a session exists
DEFINITIONS = ArrayType(StringType())
ELEMENTS = ArrayType(StructType([
    StructField("code_type", StringType()), StructField("name", StringType()),
    StructField("start", IntegerType()), StructField("end", IntegerType()),
]))


def _tree(source):
    """Syntax tree, None when the text is no Python, UNREADABLE when it is too deep for the parser."""
    if not source:
        return None
    try:
        return ast.parse(source)
    except (SyntaxError, ValueError) as error:
        # the parser's own limits come as syntax errors too
        return UNREADABLE if "too many nested" in str(error) or "too complex" in str(error) else None
    except (RecursionError, MemoryError):
        return UNREADABLE


def _inner_statements(node):
    """Statements directly inside a node, in source order; expressions hold no definitions."""
    for field in node._fields:
        value = getattr(node, field, None)
        if isinstance(value, list):
            for child in value:
                if isinstance(child, STATEMENTS):
                    yield child


# The same file text recurs from commit to commit, so a worker remembers the last few.
@lru_cache(maxsize=256)
def list_definitions(source) -> list[str] | None:
    """Dotted paths of plain ``def``/``class`` reached through bodies of such only, sorted.

    None where parser and scanner give up: that says nothing about the definitions.
    """
    tree = _tree(source)
    if tree is UNREADABLE:
        try:
            return source_scan.definitions(source)
        except source_scan.Broken:
            return None
    if tree is None:
        return []
    found, pending = set(), [("", node) for node in tree.body]
    while pending:
        prefix, node = pending.pop()
        if isinstance(node, (ast.FunctionDef, ast.ClassDef)):
            path = prefix + node.name
            found.add(path)
            pending.extend((path + ".", child) for child in node.body)
    return sorted(found)


@lru_cache(maxsize=256)
def list_elements(source) -> list[dict] | None:
    """Classes, functions outside classes, and methods, each with its first span; None where parser and scanner give up.

    One breadth-first walk carries the enclosing class names, so a file costs one
    pass however many elements it holds. Decorators are not part of a span.
    """
    tree = _tree(source)
    if tree is UNREADABLE:
        try:
            return [dict(zip(("code_type", "name", "start", "end"), one)) for one in source_scan.elements(source)]
        except source_scan.Broken:
            return None
    if tree is None:
        return []
    classes, functions, inside, methods = {}, {}, {}, []
    queue = deque([(tree, ())])
    while queue:
        node, owners = queue.popleft()
        below = owners
        if isinstance(node, ast.ClassDef):
            classes.setdefault(node.name, node)
            methods.extend((node.name, item.name) for item in node.body if isinstance(item, FUNCTIONS))
            below = owners + (node.name,)
        elif isinstance(node, FUNCTIONS):
            if not owners:
                functions.setdefault(node.name, node)
            for owner in owners:
                inside.setdefault((owner, node.name), node)
        queue.extend((child, below) for child in _inner_statements(node))

    def element(code_type, name, node):
        return {"code_type": code_type, "name": name, "start": node.lineno - 1, "end": node.end_lineno}

    out = [element("class", name, node) for name, node in classes.items()]
    out += [element("function", name, node) for name, node in functions.items()]
    out += [element("method", ".".join(key), inside[key]) for key in dict.fromkeys(methods)]
    return out


def candidate(source: Column) -> Column:
    """Source worth parsing: text without either keyword is not even sent to a worker."""
    return F.when(source.contains("def") | source.contains("class"), source)


@F.pandas_udf(DEFINITIONS)
def definitions(source: pd.Series) -> pd.Series:
    return source.map(list_definitions)


@F.pandas_udf(ELEMENTS)
def spans(source: pd.Series) -> pd.Series:
    return source.map(list_elements)


def with_elements(rows: DataFrame, sources: dict[str, Column]) -> DataFrame:
    """Adds the elements (code_type, name, start, end, body) of each source under its name; null where none can be listed.

    Bodies are cut out of the lines here, so they never leave the JVM.
    """
    spanned = rows.select("*", *[spans(candidate(source)).alias(f"_spans_{name}") for name, source in sources.items()],
                          *[F.split(candidate(source), "\n", -1).alias(f"_lines_{name}") for name, source in sources.items()])

    def whole(name: str) -> Column:
        lines = F.col(f"_lines_{name}")

        def with_body(one: Column) -> Column:
            body = F.array_join(F.slice(lines, one["start"] + 1, one["end"] - one["start"]), "\n")
            return F.struct(*[one[field].alias(field) for field in ("code_type", "name", "start", "end")],
                            F.when(one["end"] <= F.size(lines), body).otherwise("").alias("body"))

        return F.transform(f"_spans_{name}", with_body).alias(name)

    return spanned.select(*rows.columns, *[whole(name) for name in sources])
