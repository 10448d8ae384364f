"""Windows over a bounded stream: every triple gets the ids of its windows, all in one plan.

Time windows: with t0 the first arrival's time, window k holds t0 + k*step <= ts < t0 + k*step + range.
Fired are all k that a later arrival proves complete; then one partial window follows unless the last
arrival itself fired one (``final_partial='reference'``), or always, or never. ``mode='arrival'`` fires at
most one window an arrival, so that windows lag behind after a gap in time.

``prepare`` reads the stream's ends once, for all patterns of a query; what it returns adds ``win_id``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

POLICIES = ("reference", "always", "never")


@dataclass(frozen=True)
class Assigner:
    """Adds ``win_id`` to triples. ``by_time``: from ``ts_ms`` alone."""

    assign: Callable[[DataFrame], DataFrame]
    by_time: bool = False

    def __call__(self, triples: DataFrame) -> DataFrame:
        return self.assign(triples)


_NOTHING = Assigner(lambda t: t.withColumn("win_id", F.lit(None).cast("long")).where(F.lit(False)), True)


def floor_div(x: Column, by: int) -> Column:
    """Whole-number division that rounds down."""
    return F.call_function("div", x - F.pmod(x, F.lit(by)), F.lit(by))


@dataclass(frozen=True)
class CountWindow:
    """Tumbling windows of n arrivals; the last may be smaller."""

    n: int

    def prepare(self, clock: DataFrame) -> Assigner:
        return Assigner(lambda t: t.withColumn("win_id", F.expr(f"seq div {self.n}")))


@dataclass(frozen=True)
class TimeWindow:
    range_ms: int
    step_ms: int
    final_partial: str = "reference"
    mode: str = "event"

    def __post_init__(self):
        if self.range_ms <= 0 or self.step_ms <= 0:
            raise ValueError("range and step must be positive")
        if self.final_partial not in POLICIES or self.mode not in ("event", "arrival"):
            raise ValueError("unknown window policy")

    def fired(self, t: int, t0: int) -> int:
        """Windows complete when time t arrives."""
        return 0 if t - t0 < self.range_ms else (t - t0 - self.range_ms) // self.step_ms + 1

    def reported(self, done: int, idle: bool) -> int:
        """The largest window reported at the end, after ``done`` complete ones; ``idle``: the last arrival fired none."""
        return done if self.final_partial == "always" or self.final_partial == "reference" and idle else done - 1

    def prepare(self, clock: DataFrame) -> Assigner:
        """``clock``: ts_ms and seq of all arrivals of the stream, seq without gaps."""
        if self.mode == "arrival":
            return self._arrival(clock)
        at = F.struct("seq", "ts_ms")
        # the last two arrivals have an even and an odd number
        even, odd = (F.max(F.when(F.col("seq") % 2 == k, at)) for k in (0, 1))
        first, *ends = clock.agg(F.min_by("ts_ms", "seq"), even, odd).first()
        if first is None:
            return _NOTHING
        ends = [e.ts_ms for e in sorted(e for e in ends if e is not None)]
        done = self.fired(ends[-1], first)
        return self.between(first, 0, self.reported(done, len(ends) == 1 or done == self.fired(ends[0], first)))

    def between(self, t0: int, first: int, last: int) -> Assigner:
        """Windows ``first`` to ``last`` of a stream that begins at ``t0``."""
        w, s = self.range_ms, self.step_ms

        def assign(triples: DataFrame) -> DataFrame:
            since = F.col("ts_ms") - F.lit(t0).cast("long")
            at_step = floor_div(since, s)
            if s >= w:  # windows do not overlap: no copies
                rows = triples.withColumn("win_id", at_step).where(since - at_step * s < w)
                return rows.where((F.col("win_id") >= first) & (F.col("win_id") <= last))
            low = F.greatest(F.lit(first).cast("long"), floor_div(since - F.lit(w), s) + 1)
            high = F.least(at_step, F.lit(last).cast("long"))
            return triples.where((since >= 0) & (low <= high)).withColumn("win_id", F.explode(F.sequence(low, high)))

        return Assigner(assign, True)

    def _arrival(self, clock: DataFrame, block: int = 100_000) -> Assigner:
        """Firings up to row i: m(i) = i + min over j <= i of (c(j) - j), c(j) the windows due at row j.

        The running minimum is taken inside blocks of ``seq``, then over the blocks of a superblock, then over
        superblocks (one row for ``block`` squared arrivals). Row j is in windows m(j) .. ceil((ts - t0 + 1) / step) - 1.
        """
        t0, end = clock.agg(F.min_by("ts_ms", "seq"), F.max("seq")).first()
        if t0 is None:
            return _NOTHING
        w, s = self.range_ms, self.step_ms
        ceil_div = lambda x: -floor_div(-x, s)
        due = F.greatest(F.lit(0).cast("long"), ceil_div(F.col("ts_ms") - F.lit(t0) + F.lit(1 - w))) - F.col("seq")
        rows = clock.select("seq", due.alias("_due"), F.expr(f"seq div {block}").alias("_b"), F.expr(f"seq div {block * block}").alias("_c"))
        is_last = F.col("seq") == end
        before_last, at_last = rows.agg(F.min(F.when(~is_last, F.col("_due"))), F.min(F.when(is_last, F.col("_due")))).first()
        done = end + (at_last if before_last is None else min(before_last, at_last))
        last = self.reported(done, before_last is None or done == end - 1 + before_last)

        earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
        lows = rows.groupBy("_c", "_b").agg(F.min("_due").alias("_low"))
        tops = lows.groupBy("_c").agg(F.min("_low").alias("_top")).select("_c", F.min("_top").over(earlier(Window.orderBy("_c"))).alias("_far"))
        near = lows.select("_c", "_b", F.min("_low").over(earlier(Window.partitionBy("_c").orderBy("_b"))).alias("_near"))
        before = near.join(tops, "_c").select("_b", F.least("_far", "_near").alias("_before"))
        inside = F.min("_due").over(Window.partitionBy("_b").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
        made = rows.select("seq", "_b", inside.alias("_in")).join(before, "_b").select("seq", (F.col("seq") + F.least("_in", "_before")).alias("_m"))

        def assign(triples: DataFrame) -> DataFrame:
            high = F.least(ceil_div(F.col("ts_ms") - F.lit(t0) + F.lit(1)) - 1, F.lit(last).cast("long"))
            return triples.join(made, "seq").where(F.col("_m") <= high).withColumn("win_id", F.explode(F.sequence(F.col("_m"), high))).drop("_m")

        return Assigner(assign)
