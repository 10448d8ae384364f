"""Triple sources: N-Triples lines with timestamps, views over tables, generated workloads."""

from .ntriples import read_ntriples, read_ntriples_stream, settled, with_seq, write_ntriples
from .views import TripleView, events_view, orders_view, triples_events, triples_orders, triples_static

__all__ = ["TripleView", "events_view", "orders_view", "read_ntriples", "read_ntriples_stream", "settled", "triples_events", "triples_orders", "triples_static", "with_seq", "write_ntriples"]
