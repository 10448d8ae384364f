"""Triple views over the star-schema tables, and the same views as DuckDB SQL.

A view knows how its terms are made from columns, so that a pattern reads only the rows and facts that can
match: a constant subject or object becomes a condition on the column it comes from, which reaches the scan,
a constant predicate leaves only its facts, and patterns on one subject are one pass where it is a key.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

INTEGER = "http://www.w3.org/2001/XMLSchema#integer"
_WHOLE = ("tinyint", "smallint", "int", "bigint")


@dataclass(frozen=True)
class Term:
    """A term made of a column (or an expression, which no constant can be traced back through)."""

    prefix: str
    value: str | Column
    suffix: str

    def column(self) -> Column:
        value = F.col(self.value) if isinstance(self.value, str) else self.value
        return F.concat(F.lit(self.prefix), value.cast("string"), F.lit(self.suffix))

    def equals(self, table: DataFrame, constant: str) -> Column:
        """Where the term is ``constant``."""
        inner = constant[len(self.prefix) : len(constant) - len(self.suffix)]
        if constant != f"{self.prefix}{inner}{self.suffix}":
            return F.lit(False)
        kind = dict(table.dtypes).get(self.value) if isinstance(self.value, str) else None
        if kind == "string":
            return F.col(self.value) == inner
        if kind in _WHOLE:
            fits = inner.removeprefix("-").isascii() and inner.removeprefix("-").isdigit() and str(int(inner)) == inner and abs(int(inner)) < 1 << 63
            return F.col(self.value) == int(inner) if fits else F.lit(False)
        return self.column() == constant


def iri(kind: str, value: str | Column) -> Term:
    return Term(f"<http://ex/{kind}/", value, ">")


def cents(column: str) -> Term:
    """An integer literal: a hundred times the column, rounded."""
    return Term('"', F.round(F.col(column) * 100).cast("long"), f'"^^<{INTEGER}>')


class TripleView:
    """Facts (predicate, object) of each row of ``table``; ``seq`` numbers them in order of ``number``.

    ``key``: no two rows have the same subject.
    """

    def __init__(self, table: DataFrame, subject: Term, facts: dict[str, Term], ts_ms: Column, number: Column, key: bool = False):
        self.source, self.subject, self.key = table, subject, key
        self.facts = {f"<http://ex/{p}>": o for p, o in facts.items()}
        self.ts_ms, self.number = ts_ms, number

    def match(self, s: str | None = None, p: str | None = None, o: str | None = None) -> DataFrame:
        """s, p, o, ts_ms, seq of the triples with these constants (None: any), without a shuffle."""
        rows = self.source if s is None else self.source.where(self.subject.equals(self.source, s))
        facts = [(j, name, term) for j, (name, term) in enumerate(self.facts.items()) if p in (None, name)]
        if o is not None and facts:
            tests = [term.equals(self.source, o) for _, _, term in facts]
            rows = rows.where(reduce(lambda a, b: a | b, tests))
        row = [self.subject.column().alias("s"), self.ts_ms.alias("ts_ms"), (self.number * len(self.facts)).alias("_n")]
        if len(facts) == 1:
            j, name, term = facts[0]
            return rows.select(row[0], F.lit(name).alias("p"), term.column().alias("o"), row[1], (self.number * len(self.facts) + j).alias("seq"))
        many = [F.struct(F.lit(j).alias("j"), F.lit(name).alias("p"), term.column().alias("o")) for j, name, term in facts]
        if not many:
            return self.match().where(F.lit(False))
        spread = rows.select(*row, F.explode(F.array(*many)).alias("f")).select("s", "f.p", "f.o", "ts_ms", (F.col("_n") + F.col("f.j")).alias("seq"))
        return spread if o is None else spread.where(F.col("o") == o)

    def clock(self) -> DataFrame:
        """ts_ms and seq of all triples."""
        many = F.explode(F.array(*map(F.lit, range(len(self.facts))))).alias("j")
        rows = self.source.select(self.ts_ms.alias("ts_ms"), (self.number * len(self.facts)).alias("_n"), many)
        return rows.select("ts_ms", (F.col("_n") + F.col("j")).alias("seq"))

    def star(self, terms: dict[str, str | None]) -> DataFrame | None:
        """s, ts_ms and o0, o1, ... of rows that have all predicates of ``terms`` with these objects (None: any).

        None where that is not a row of the table: the subject is no key or a predicate is not the view's.
        """
        if not self.key or not set(terms) <= set(self.facts):
            return None
        tests = [self.facts[p].equals(self.source, o) for p, o in terms.items() if o is not None]
        rows = self.source.where(reduce(lambda a, b: a & b, tests)) if tests else self.source
        return rows.select(self.subject.column().alias("s"), self.ts_ms.alias("ts_ms"), *(self.facts[p].column().alias(f"o{i}") for i, p in enumerate(terms)))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _millis(column: str) -> Column:
    return F.unix_millis(F.col(column).cast("timestamp"))


def events_view(spark: SparkSession, sf_dir: str) -> TripleView:
    """User, type and value (cents) of each event, in order of events."""
    facts = {"user": iri("user", "user_id"), "type": iri("type", "event_type"), "value": cents("value")}
    return TripleView(_table(spark, sf_dir, "events"), iri("event", "event_id"), facts, _millis("ts"), F.col("event_id"), key=True)


def orders_view(spark: SparkSession, sf_dir: str) -> TripleView:
    """Customer, status and price (cents) of each order; days tie, so ``seq`` is by key only."""
    facts = {"customer": iri("customer", "o_custkey"), "status": iri("status", "o_orderstatus"), "price": cents("o_totalprice")}
    return TripleView(_table(spark, sf_dir, "orders"), iri("order", "o_orderkey"), facts, _millis("o_orderdate"), F.col("o_orderkey"), key=True)


def triples_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_view(spark, sf_dir).match()


def triples_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders_view(spark, sf_dir).match()


def triples_static(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer -> nation -> region, region names, and for nations of region 0 a flag; time 0."""
    c, n, r = (_table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    zero = F.lit(0).cast("long")
    part = lambda d, s, p, o: d.select(s.column().alias("s"), F.lit(f"<http://ex/{p}>").alias("p"), o.column().alias("o"), zero.alias("ts_ms"), zero.alias("seq"))
    out = part(c, iri("customer", "c_custkey"), "nation", iri("nation", "c_nationkey"))
    out = out.unionByName(part(n, iri("nation", "n_nationkey"), "region", iri("region", "n_regionkey")))
    out = out.unionByName(part(r, iri("region", "r_regionkey"), "name", Term('"', "r_name", '"')))
    even = (F.col("n_nationkey") - F.col("n_nationkey") % 2).cast("string")
    return out.unionByName(part(n.where("n_regionkey = 0"), iri("nation", "n_nationkey"), "knows", iri("nation", even)))


#: The views for DuckDB, as common table expressions named ``tr``.
EVENTS_SQL = f"""ev AS (SELECT *, epoch_us(ts)//1000 AS t FROM events),
tr AS MATERIALIZED (SELECT '<http://ex/event/'||event_id||'>' AS s, '<http://ex/user>' AS p, '<http://ex/user/'||user_id||'>' AS o, t AS ts_ms, 3*event_id AS seq FROM ev
 UNION ALL SELECT '<http://ex/event/'||event_id||'>', '<http://ex/type>', '<http://ex/type/'||event_type||'>', t, 3*event_id+1 FROM ev
 UNION ALL SELECT '<http://ex/event/'||event_id||'>', '<http://ex/value>', '"'||CAST(round(value*100) AS BIGINT)||'"^^<{INTEGER}>', t, 3*event_id+2 FROM ev)"""
ORDERS_SQL = f"""tr AS (SELECT '<http://ex/order/'||o_orderkey||'>' AS s, '<http://ex/customer>' AS p, '<http://ex/customer/'||o_custkey||'>' AS o, 3*o_orderkey AS seq FROM orders
 UNION ALL SELECT '<http://ex/order/'||o_orderkey||'>', '<http://ex/status>', '<http://ex/status/'||o_orderstatus||'>', 3*o_orderkey+1 FROM orders
 UNION ALL SELECT '<http://ex/order/'||o_orderkey||'>', '<http://ex/price>', '"'||CAST(round(o_totalprice*100) AS BIGINT)||'"^^<{INTEGER}>', 3*o_orderkey+2 FROM orders)"""
STATIC_SQL = """st AS (SELECT '<http://ex/customer/'||c_custkey||'>' AS s, '<http://ex/nation>' AS p, '<http://ex/nation/'||c_nationkey||'>' AS o FROM customer
 UNION ALL SELECT '<http://ex/nation/'||n_nationkey||'>', '<http://ex/region>', '<http://ex/region/'||n_regionkey||'>' FROM nation
 UNION ALL SELECT '<http://ex/region/'||r_regionkey||'>', '<http://ex/name>', '"'||r_name||'"' FROM region
 UNION ALL SELECT '<http://ex/nation/'||n_nationkey||'>', '<http://ex/knows>', '<http://ex/nation/'||(n_nationkey - n_nationkey % 2)||'>' FROM nation WHERE n_regionkey = 0)"""
