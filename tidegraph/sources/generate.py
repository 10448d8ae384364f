"""Seeded workload generators and stream transforms, all distributed (``spark.range``).

Numbers come from whole-number arithmetic and order from MD5, so that SQL anywhere can make the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .ntriples import settled, with_seq
from .views import INTEGER

#: The constants that workload queries look for.
SELECT_OBJECT, JOIN_SUBJECT, LITERAL_SUBJECT = 90001, 80001, 124


def iri(c: Column) -> Column:
    return F.concat(F.lit("<http://example.org/int/"), c.cast("string"), F.lit(">"))


def integer(c: Column) -> Column:
    return F.concat(F.lit('"'), c.cast("string"), F.lit(f'"^^<{INTEGER}>'))


def modular(spark: SparkSession, n: int, m: int) -> DataFrame:
    """Row i: s = i, p = 2i, o = 5i, each modulo m; one a second."""
    i = F.col("id")
    return spark.range(n).select(iri(i % m).alias("s"), iri(i * 2 % m).alias("p"), iri(i * 5 % m).alias("o"), ((i + 1) * 1000).alias("ts_ms"), i.alias("seq"))


def append_timestamps(triples: DataFrame) -> DataFrame:
    """ts_ms = line number (from 1) times 1000, in the order of the input."""
    rows = with_seq(settled(triples.drop("seq", "ts_ms")))
    return rows.withColumn("ts_ms", (F.col("seq") + 1) * 1000)


def shuffle_key(seed: int) -> Column:
    return F.md5(F.concat_ws(" ", "s", "p", "o", F.lit(str(seed))))


def dedup_shuffle(triples: DataFrame, seed: int) -> DataFrame:
    """Distinct (s, p, o) in a random order that the seed decides."""
    return triples.select("s", "p", "o").distinct().orderBy(shuffle_key(seed), "s", "p", "o")


def first_rows(triples: DataFrame, n: int, seed: int) -> DataFrame:
    """The first n of the distinct triples in the seed's order, by arrival rank: no task sees them all."""
    return with_seq(settled(dedup_shuffle(triples, seed))).where(F.col("seq") < n).select("s", "p", "o")


#: The prime 2**31 - 1 and the summands of three quadratic rounds modulo it.
PRIME, ROUNDS = 2147483647, (48271, 1103515245, 742938285)


def uniform(i: Column, seed: int, salt: int, limit: int) -> Column:
    """A number below ``limit`` for each i >= 0."""
    x = (i % PRIME * 48271 + (seed * 69621 + salt * 16807 + 1) % PRIME) % PRIME
    for by in ROUNDS:
        x = (x * ((x + by) % PRIME) + by) % PRIME
    return x % limit


def _drawn(spark: SparkSession, n: int, limit: int, seed: int, salt: int, s: Column | None = None, o: Column | None = None) -> DataFrame:
    """n distinct triples, uniform below ``limit`` but for ``s`` and ``o`` where given."""
    room = limit ** (3 - (s is not None) - (o is not None))
    if room < n:
        raise ValueError("there are fewer distinct triples than asked for")
    have = 2 * n + 100 if room > 4 * n else 40 * n + 1000
    i = F.col("id")
    cols = [iri(uniform(i, seed, salt + k, limit)) for k in range(3)]
    cols = [s if s is not None else cols[0], cols[1], o if o is not None else cols[2]]
    return first_rows(spark.range(have).select(*(c.alias(x) for c, x in zip(cols, "spo", strict=True))), n, seed)


def _shuffled(parts: list[DataFrame], seed: int) -> DataFrame:
    """All parts, which have no triple in common, in one random order, one a second."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return append_timestamps(dedup_shuffle(rows, seed))


def random_triples(spark: SparkSession, n: int, limit: int, seed: int) -> DataFrame:
    """n distinct uniform triples below ``limit``, shuffled, one a second."""
    return _shuffled([_drawn(spark, n, limit, seed, 0)], seed)


def select_workload(spark: SparkSession, k: int, store: int, seed: int, limit: int = 20000) -> DataFrame:
    """k of ``store`` distinct rows have the object that select queries look for; the rest is uniform below ``limit``."""
    hit = iri(F.lit(SELECT_OBJECT))
    return _shuffled([_drawn(spark, k, limit, seed, 10, o=hit), _drawn(spark, store - k, limit, seed, 0)], seed)


def join_workload(spark: SparkSession, k: int, store: int, limit: int, seed: int) -> DataFrame:
    """k of ``store`` rows have the sought object, k the sought subject, one row both; the rest is uniform below ``limit``."""
    s, o = iri(F.lit(JOIN_SUBJECT)), iri(F.lit(SELECT_OBJECT))
    both = _drawn(spark, 1, limit, seed, 30, s=s, o=o)
    return _shuffled([both, _drawn(spark, k - 1, limit, seed, 10, o=o), _drawn(spark, k - 1, limit, seed, 20, s=s), _drawn(spark, store - 2 * k + 1, limit, seed, 0)], seed)


def filter_workload(spark: SparkSession, k: int, store: int, seed: int, limit: int = 2000) -> DataFrame:
    """k of ``store`` rows have an integer object in [0, 3000); the rest is uniform below ``limit``."""
    i = F.col("id")
    number = integer(uniform(i, seed, 19, 3000))
    return _shuffled([_drawn(spark, k, limit, seed, 10, o=number), _drawn(spark, store - k, limit, seed, 0)], seed)


def pad(triples: DataFrame, target: int, seed: int, limit: int = 500) -> DataFrame:
    """Random rows without timestamps up to ``target`` rows."""
    more = max(0, target - triples.count())
    cols = [iri(uniform(F.col("id"), seed, k, limit)).alias(c) for k, c in enumerate("spo")]
    return triples.select("s", "p", "o").unionByName(triples.sparkSession.range(more).select(*cols))


def inject_literals(triples: DataFrame, every: int, seed: int) -> DataFrame:
    """Each ``every``-th row (by seq) gets the subject 124 and an integer object from 1 to 20."""
    hit = F.col("seq") % every == 0
    n = uniform(F.col("seq"), seed, 5, 20) + 1
    return triples.withColumn("s", F.when(hit, iri(F.lit(LITERAL_SUBJECT))).otherwise(F.col("s"))).withColumn("o", F.when(hit, integer(n)).otherwise(F.col("o")))


__all__ = ["append_timestamps", "dedup_shuffle", "filter_workload", "first_rows", "inject_literals", "join_workload", "modular", "pad", "random_triples", "select_workload"]
