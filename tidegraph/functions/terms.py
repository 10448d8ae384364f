"""RDF terms as strings in N-Triples form: type tags, numeric values, comparison.

A term's identity is its lexical form (that is what joins use); FILTER compares by type. Comparison
is two-valued: unbound operands, operands of different types, and dates or booleans give false,
``!=`` included.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Local names of datatypes that compare as numbers.
NUMERIC = ("integer", "int", "short", "long", "byte", "float", "double", "decimal", "nonNegativeInteger", "positiveInteger", "nonPositiveInteger", "negativeInteger", "unsignedInt", "unsignedLong", "unsignedShort", "unsignedByte", "USD")
_TYPE = r'"\^\^<?[^<>"]*[#/]'
_PATTERNS = (("num", rf"{_TYPE}(?:{'|'.join(NUMERIC)})>$"), ("datetime", rf"{_TYPE}(?:date|dateTime)>$"), ("bool", rf"{_TYPE}boolean>$"))
_OPS = {"=": "__eq__", "!=": "__ne__", "<": "__lt__", "<=": "__le__", ">": "__gt__", ">=": "__ge__"}


def kind(c: Column) -> Column:
    """'uri', 'num', 'str', 'datetime', 'bool' or 'bnode'; null for an unbound term."""
    out = F.when(c.isNull(), F.lit(None)).when(c.startswith("<"), "uri").when(c.startswith("_:"), "bnode")
    for name, pattern in _PATTERNS:
        out = out.when(c.rlike(pattern), name)
    return out.otherwise("str")


def number(c: Column) -> Column:
    """A numeric literal's value as a double, null if it has none."""
    return F.regexp_extract(c, '^"([^"]*)"', 1).try_cast("double")


def text_value(c: Column) -> Column:
    """A string literal's quoted value, without language tag or datatype."""
    return F.regexp_extract(c, r'^("(?:[^"\\]|\\.)*")', 1)


def constant_kind(term: str) -> str:
    if term.startswith("<"):
        return "uri"
    return next((name for name, p in _PATTERNS if re.search(p, term)), "str")


def compare(op: str, left: Column | str | float, right: Column | str | float) -> Column:
    """Operands are columns of terms, constant terms in N-Triples form, or plain numbers."""
    ops = [left, right]
    kinds = [None if isinstance(x, Column) else "num" if isinstance(x, (int, float)) else constant_kind(x) for x in ops]
    columns = [x if isinstance(x, Column) else F.lit(x) for x in ops]

    def as_(k: str) -> Column:
        """The comparison where both are of kind k."""
        sides = []
        for x, own, c in zip(ops, kinds, columns, strict=True):
            plain = isinstance(x, (int, float))
            sides.append((F.lit(float(x)) if plain else number(c)) if k == "num" else text_value(c) if k == "str" else c)
        test = getattr(sides[0], _OPS[op])(sides[1])
        for own, c in zip(kinds, columns, strict=True):
            if own is None and not (k == "uri" and op == "=" and set(kinds) != {None}):  # equal to an IRI: is one
                test = test & (c.startswith("<") if k == "uri" else kind(c) == k)
        return F.coalesce(test, F.lit(False))

    known = {k for k in kinds if k}
    if len(known) == 2 or known & {"datetime", "bool"}:
        return F.lit(False)
    if known:
        return as_(known.pop())
    return as_("uri") | as_("num") | as_("str")
