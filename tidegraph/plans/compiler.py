"""Algebra to DataFrame. The plan is declarative: Catalyst and adaptive execution choose the rest."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.terms import compare
from ..operators import graph
from .algebra import Filter, Join, Node, Pattern, Union


def predicate(e: tuple) -> Column:
    """A two-valued condition: leaves are never null."""
    if e[0] == "or":
        return predicate(e[1]) | predicate(e[2])
    if e[0] == "and":
        return predicate(e[1]) & predicate(e[2])
    if e[0] == "not":
        return ~predicate(e[1])
    if e[0] == "bound":
        return F.col(f"`{e[1]}`").isNotNull()
    sides = [F.col(f"`{x[1]}`") if x[0] == "var" else x[1] for x in e[2:]]
    return compare(e[1], *sides)


def _leaves(node: Node) -> list[Node]:
    """The parts of a chain of joins, in order."""
    return [*_leaves(node.left), *_leaves(node.right)] if type(node) is Join else [node]


def _stars(parts: list[Node]) -> list[list[Node]]:
    """Parts with patterns on one subject variable put together, where the predicates are different constants."""
    out: list[list[Node]] = []
    at: dict[str, list[Node]] = {}
    for part in parts:
        if isinstance(part, Pattern) and graph.is_variable(part.terms[0]) and not graph.is_variable(part.terms[1]):
            group = at.get(part.terms[0])
            if group is not None and all(part.terms[1] != x.terms[1] for x in group):
                group.append(part)
                continue
            group = at[part.terms[0]] = [part]
        else:
            group = [part]
        out.append(group)
    return out


def compile_plan(node: Node, triples, window: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Bindings of ``node`` over ``triples`` (a DataFrame or a view). ``window`` adds ``win_id``; without it all is one window.

    ``window`` is applied to each pattern's matches only, so copies for overlapping windows are made
    of what the constants leave. Where windows go by time, a star of patterns on a view's key is one pass
    over its rows, whose facts have one time.
    """
    keys = ["win_id"] if window else []
    if isinstance(node, Pattern):
        return graph.pattern(triples, node.terms, window)
    if isinstance(node, Filter):
        return compile_plan(node.child, triples, window).where(predicate(node.expression))
    if type(node) is Join:
        whole = not isinstance(triples, DataFrame) and (window is None or getattr(window, "by_time", False))
        done, rows = None, None
        for group in _stars(_leaves(node)) if whole else [[x] for x in _leaves(node)]:
            found = graph.star(triples, [x.terms for x in group], window) if len(group) > 1 else None
            for part, table in [(group[0], found)] if found is not None else [(x, compile_plan(x, triples, window)) for x in group]:
                loose = part.loose() if rows is None else done | part.loose()
                rows, done = table if rows is None else graph.join(rows, table, keys, loose), loose
        return rows
    left, right = (compile_plan(n, triples, window) for n in (node.left, node.right))
    if isinstance(node, Union):
        return graph.union(left, right)
    loose = node.left.loose() | node.right.loose()
    return graph.left_join(left, right, keys, loose)


def relevant(node: Node) -> Column | None:
    """A condition that all triples meet that can match a pattern of ``node``; None if all can."""
    if not isinstance(node, Pattern):
        tests = [relevant(n) for n in ((node.child,) if isinstance(node, Filter) else (node.left, node.right))]
        return None if any(t is None for t in tests) else reduce(lambda a, b: a | b, tests)
    tests = [F.col(c) == t for c, t in zip("spo", node.terms, strict=True) if not graph.is_variable(t)]
    return reduce(lambda a, b: a & b, tests) if tests else None


__all__ = ["compile_plan", "predicate", "relevant"]
