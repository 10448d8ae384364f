"""The engine: registered streams and queries, bounded (``run_batch``) or continuous (``start``)."""

from .engine import StreamEngine

__all__ = ["StreamEngine"]
