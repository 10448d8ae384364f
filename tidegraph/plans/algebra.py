"""The algebra of graph patterns. Variables keep the order of their first occurrence."""

from __future__ import annotations

from dataclasses import dataclass

from ..operators.graph import column, is_variable


class Node:
    def variables(self) -> list[str]:
        raise NotImplementedError

    def loose(self) -> set[str]:
        """Variables that can be unbound."""
        return set()


def _merged(a: list[str], b: list[str]) -> list[str]:
    return [*a, *(v for v in b if v not in a)]


@dataclass(frozen=True)
class Pattern(Node):
    terms: tuple[str, str, str]

    def variables(self):
        return list(dict.fromkeys(column(t) for t in self.terms if is_variable(t)))


@dataclass(frozen=True)
class Join(Node):
    left: Node
    right: Node

    def variables(self):
        return _merged(self.left.variables(), self.right.variables())

    def loose(self):
        return self.left.loose() | self.right.loose()


@dataclass(frozen=True)
class LeftJoin(Join):
    def loose(self):
        return super().loose() | (set(self.right.variables()) - set(self.left.variables()))


@dataclass(frozen=True)
class Union(Join):
    def loose(self):
        return super().loose() | (set(self.left.variables()) ^ set(self.right.variables()))


@dataclass(frozen=True)
class Filter(Node):
    child: Node
    expression: tuple

    def variables(self):
        return self.child.variables()

    def loose(self):
        return self.child.loose()
