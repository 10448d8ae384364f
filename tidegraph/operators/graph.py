"""Pattern, join, left join and union of binding tables.

A binding table has the window key columns (``keys``: ``win_id``, or none for an unwindowed evaluation)
and one nullable string column a variable. Null is unbound and equals null in a join; where neither
side can be unbound a plain equality is used, which gives Spark the cheaper keys.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def is_variable(term: str) -> bool:
    return term[0] in "?_"


def column(term: str) -> str:
    """A variable's column name: without its question mark; blank nodes keep theirs."""
    return term[1:] if term[0] == "?" else term.replace(":", "")


def pattern(triples, terms: tuple[str, str, str], window: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Triples that match the constants, one column a variable; ``window`` comes after the filter.

    ``triples``: a DataFrame, or a view that finds its rows by the constants. A variable that occurs
    twice asks for equality; no variable at all gives one row a match.
    """
    found: dict[str, str] = {}
    test = []
    view = not isinstance(triples, DataFrame)
    for place, term in zip("spo", terms, strict=True):
        if not is_variable(term):
            if not view:
                test.append(F.col(place) == term)
        elif column(term) in found:
            test.append(F.col(place) == F.col(found[column(term)]))
        else:
            found[column(term)] = place
    rows = triples.match(*(None if is_variable(t) else t for t in terms)) if view else triples
    rows = rows.where(reduce(lambda a, b: a & b, test)) if test else rows
    rows = window(rows) if window else rows
    return rows.select(*(["win_id"] if window else []), *(F.col(p).alias(v) for v, p in found.items()))


def star(view, patterns: list[tuple[str, str, str]], window: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame | None:
    """Patterns on one subject variable with different constant predicates as one pass over a view's rows.

    None where the view cannot: it has no key, or lacks a predicate.
    """
    rows = view.star({p: None if is_variable(o) else o for _, p, o in patterns})
    if rows is None:
        return None
    found, test = {column(patterns[0][0]): "s"}, []
    for i, (_, _, term) in enumerate(patterns):
        if is_variable(term):
            if column(term) in found:
                test.append(F.col(f"o{i}") == F.col(found[column(term)]))
            else:
                found[column(term)] = f"o{i}"
    rows = rows.where(reduce(lambda a, b: a & b, test)) if test else rows
    rows = window(rows) if window else rows
    return rows.select(*(["win_id"] if window else []), *(F.col(c).alias(v) for v, c in found.items()))


def _pair(left: DataFrame, right: DataFrame, keys: list[str], loose: set[str]):
    shared = [c for c in left.columns if c in right.columns and c not in keys]
    renamed = right.toDF(*(f"_r_{c}" for c in right.columns))
    tests = [F.col(k) == F.col(f"_r_{k}") for k in keys]
    tests += [F.col(c).eqNullSafe(F.col(f"_r_{c}")) if c in loose else F.col(c) == F.col(f"_r_{c}") for c in shared]
    out = [F.col(c) for c in left.columns] + [F.col(f"_r_{c}").alias(c) for c in right.columns if c not in left.columns]
    return renamed, tests, out


def join(left: DataFrame, right: DataFrame, keys: list[str], loose: set[str] = frozenset()) -> DataFrame:
    """Natural join on all shared variables; without any, the product inside each window."""
    renamed, tests, out = _pair(left, right, keys, loose)
    if not tests:
        warnings.warn("two parts of a pattern share no variable and there is no window: their whole product is made", stacklevel=2)
        return left.crossJoin(renamed).select(*out)
    return left.join(renamed, reduce(lambda a, b: a & b, tests), "inner").select(*out)


def left_join(left: DataFrame, right: DataFrame, keys: list[str], loose: set[str] = frozenset()) -> DataFrame:
    """All rows of ``left``, with the matches' variables or nulls."""
    renamed, tests, out = _pair(left, right, keys, loose)
    return left.join(renamed, reduce(lambda a, b: a & b, tests, F.lit(True)), "left").select(*out)


def union(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of both, aligned by name; what a side lacks is unbound."""
    return left.unionByName(right, allowMissingColumns=True)
