"""StreamEngine: streams by IRI, queries by name; batch evaluation and Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.windows import Assigner, CountWindow
from ..plans import Query, compile_plan, parse, relevant

Sink = Callable[[DataFrame, int], None]


def _project(rows: DataFrame, query: Query, first: list[str]) -> DataFrame:
    names = query.projection if query.projection is not None else query.where.variables()
    return rows.select(*first, *(F.col(f"`{v}`") for v in names))


class StreamEngine:
    def __init__(self, spark: SparkSession):
        self.spark, self.streams, self.queries = spark, {}, {}

    def register_stream(self, iri: str, triples) -> None:
        """``triples``: a DataFrame s, p, o, ts_ms (and seq, the contiguous arrival rank, for bounded ones), or a view."""
        self.streams[iri] = triples

    def register_query(self, name: str, text: str, final_partial: str = "reference", mode: str = "event") -> Query:
        self.queries[name] = parse(text, final_partial, mode)
        return self.queries[name]

    def stream_of(self, query: Query):
        """The stream a query names, or the only one there is."""
        if query.stream in self.streams:
            return self.streams[query.stream]
        if len(self.streams) == 1:
            return next(iter(self.streams.values()))
        raise KeyError(f"no stream {query.stream}")

    def run_query(self, query: Query) -> DataFrame:
        """All windows of a bounded stream: win_id and the projected variables."""
        triples = self.stream_of(query)
        clock = triples.select("ts_ms", "seq") if isinstance(triples, DataFrame) else triples.clock()
        return _project(compile_plan(query.where, triples, query.window.prepare(clock)), query, ["win_id"])

    def run_batch(self) -> dict[str, DataFrame]:
        """Results of all registered queries; each has its own windows."""
        return {name: self.run_query(q) for name, q in self.queries.items()}

    def sql(self, text: str, **policy) -> DataFrame:
        return self.run_query(parse(text, **policy))

    def found(self, text: str, **policy) -> DataFrame:
        """Number of results of each window that has any."""
        return self.sql(text, **policy).groupBy("win_id").agg(F.count("*").alias("found"))

    def match(self, text: str) -> DataFrame:
        """The pattern over the whole stream as one table, windows ignored."""
        query = parse(text)
        return _project(compile_plan(query.where, self.stream_of(query)), query, [])

    def start(self, name: str, sink: Sink, t0_ms: int, checkpoint: str, delay_ms: int = 0, trigger: dict | None = None) -> StreamingQuery:
        """Runs a query over an unbounded stream; ``sink(results, batch)`` gets windows as they close.

        Time windows start at ``t0_ms`` and close when a triple ``delay_ms`` after their end has come; triples
        that come later are in no closed window. Count windows need ``seq`` from the source and close when they have
        all their rows. ``checkpoint``: a folder that driver and executors share; it keeps the triples that a pattern
        of the query can match and open windows still need. At the end of a stream, ``flush`` reports what is open.
        """
        query = self.queries[name]
        run = _CountRun(query, sink, checkpoint) if isinstance(query.window, CountWindow) else _TimeRun(query, sink, checkpoint, t0_ms, delay_ms)
        writer = self.stream_of(query).writeStream.foreachBatch(run.batch)
        return writer.option("checkpointLocation", f"{checkpoint}/stream").trigger(**(trigger or {"processingTime": "1 second"})).start()

    def flush(self, name: str, sink: Sink, t0_ms: int, checkpoint: str) -> None:
        """Reports the windows that are open after the stream of ``start`` has ended, as ``final_partial`` has it."""
        query = self.queries[name]
        run = _CountRun(query, sink, checkpoint) if isinstance(query.window, CountWindow) else _TimeRun(query, sink, checkpoint, t0_ms, 0)
        run.flush(self.spark)


class _Run:
    """What is common: a small table of numbers for each batch, so that a batch that is run again starts from the same."""

    def __init__(self, query: Query, sink: Sink, checkpoint: str):
        self.query, self.sink, self.folder = query, sink, checkpoint

    def save(self, spark: SparkSession, number: int, schema: str, row: tuple) -> None:
        spark.createDataFrame([row], schema).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/state/batch={number}")

    def load(self, spark: SparkSession, number: int, schema: str):
        return spark.read.schema(schema).parquet(f"{self.folder}/state/batch={number}").first()

    def newest(self, spark: SparkSession) -> int | None:
        try:
            return spark.read.parquet(f"{self.folder}/state").agg(F.max("batch")).first()[0]
        except Exception as e:  # no batch has come
            if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
                return None
            raise

    def report(self, rows: DataFrame, window: Callable[[DataFrame], DataFrame], number: int) -> None:
        self.sink(_project(compile_plan(self.query.where, rows, window), self.query, ["win_id"]), number)


class _TimeRun(_Run):
    """Each batch's triples are a part of their own, which is read while a window that needs it is open."""

    STATE = "last long, previous long, fired long, parts array<struct<number:int,until:long>>, unused array<int>"
    TRIPLES = "s string, p string, o string, ts_ms long"
    MANY = 64  # parts are put together beyond this number

    def __init__(self, query: Query, sink: Sink, checkpoint: str, t0_ms: int, delay_ms: int):
        super().__init__(query, sink, checkpoint)
        self.t0, self.delay = t0_ms, delay_ms

    def batch(self, batch: DataFrame, number: int) -> None:
        spark, window = batch.sparkSession, self.query.window
        last = previous = None
        fired, parts = 0, []
        if number:
            last, previous, fired, parts, unused = self.load(spark, number - 1, self.STATE)
            parts = [tuple(p) for p in parts]
            self._remove(spark, unused)
        timed = batch.where(F.col("ts_ms") >= self.t0).select("s", "p", "o", "ts_ms")
        ends = [r.ts_ms for r in timed.select("ts_ms").orderBy(F.desc("ts_ms")).limit(2).collect()]
        tops = sorted((x for x in (*ends, last, previous) if x is not None), reverse=True)
        if not ends:
            self.save(spark, number, self.STATE, (last, previous, fired, parts, []))
            return
        need = relevant(self.query.where)
        kept = timed if need is None else timed.where(need)
        if window.step_ms > window.range_ms:  # what lies in no window is not kept
            kept = kept.where(F.pmod(F.col("ts_ms") - F.lit(self.t0), F.lit(window.step_ms)) < window.range_ms)
        kept.write.mode("overwrite").parquet(self._part(number))
        parts = [*parts, (number, ends[0])]
        closed = max(fired, window.fired(tops[0] - self.delay, self.t0))
        if closed > fired:
            self.report(self._rows(spark, parts), window.between(self.t0, fired, closed - 1), number)
        start, had = self.t0 + closed * window.step_ms, parts
        parts = [p for p in parts if p[1] >= start]
        if len(parts) > self.MANY:
            self._rows(spark, parts).where(F.col("ts_ms") >= start).write.mode("overwrite").parquet(self._part(-number))
            parts = [(-number, max(p[1] for p in parts))]
        unused = [p[0] for p in had if p not in parts]  # removed when the next batch shows that this one is done
        self.save(spark, number, self.STATE, (tops[0], tops[1] if len(tops) > 1 else None, closed, parts, unused))

    def flush(self, spark: SparkSession) -> None:
        number = self.newest(spark)
        if number is None:
            return
        last, previous, fired, parts, _ = self.load(spark, number, self.STATE)
        if last is None:
            return
        window = self.query.window
        done = window.fired(last, self.t0)
        end = window.reported(done, previous is None or done == window.fired(previous, self.t0))
        if end >= fired:
            self.report(self._rows(spark, [tuple(p) for p in parts]), window.between(self.t0, fired, end), number + 1)

    def _remove(self, spark: SparkSession, numbers: list[int]) -> None:
        for n in numbers:
            path = spark._jvm.org.apache.hadoop.fs.Path(self._part(n))
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

    def _part(self, number: int) -> str:
        return f"{self.folder}/kept/{number}"

    def _rows(self, spark: SparkSession, parts: list[tuple[int, int]]) -> DataFrame:
        reader = spark.read.schema(self.TRIPLES)
        return reader.parquet(*(self._part(n) for n, _ in parts)) if parts else spark.createDataFrame([], self.TRIPLES)


class _CountRun(_Run):
    """Open windows' rows go from batch to batch."""

    STATE, ROWS = "rows long", "s string, p string, o string, seq long"

    def batch(self, batch: DataFrame, number: int) -> None:
        spark, n = batch.sparkSession, self.query.window.n
        rows = batch.select("s", "p", "o", F.col("seq").cast("long"))
        if number > 0:
            rows = rows.unionByName(spark.read.schema(self.ROWS).parquet(f"{self.folder}/open/{number - 1}"))
        rows = rows.withColumn("win_id", F.expr(f"seq div {n}"))
        rows.write.mode("overwrite").parquet(f"{self.folder}/now/{number}")
        rows = spark.read.schema(rows.schema).parquet(f"{self.folder}/now/{number}")
        full = rows.groupBy("win_id").agg(F.count("*").alias("c")).where(F.col("c") == n).select("win_id")
        rows.join(full, "win_id", "left_anti").select("s", "p", "o", "seq").write.mode("overwrite").parquet(f"{self.folder}/open/{number}")
        self.report(rows.join(full, "win_id").select("win_id", "s", "p", "o"), Assigner(lambda t: t), number)
        self.save(spark, number, self.STATE, (0,))

    def flush(self, spark: SparkSession) -> None:
        number = self.newest(spark)
        if number is not None:
            rows = spark.read.schema(self.ROWS).parquet(f"{self.folder}/open/{number}")
            self.report(rows, self.query.window.prepare(rows), number + 1)


__all__ = ["StreamEngine"]
