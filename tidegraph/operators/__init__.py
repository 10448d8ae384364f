"""Graph-pattern operators and windows as DataFrame transformations."""

from .graph import join, left_join, pattern, star, union
from .windows import CountWindow, TimeWindow

__all__ = ["CountWindow", "TimeWindow", "join", "left_join", "pattern", "star", "union"]
