"""Lines ``<s> <p> <o> . ts`` as triples (s, p, o, ts_ms, ts); literals may hold blanks."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_TERM = r'(<[^>]*>|_:\S+|"(?:[^"\\]|\\.)*"(?:@[A-Za-z0-9-]+|\^\^\S+)?|\S+)'
LINE = rf"^\s*{_TERM}\s+{_TERM}\s+{_TERM}\s*\.\s*(\d+)?\s*$"
#: Milliseconds of the unit in which a source's lines give their time.
UNITS = {"ms": 1, "s": 1000}


def _parse(line: Column, unit: str) -> list[Column]:
    parts = [F.nullif(F.regexp_extract(line, LINE, i), F.lit("")) for i in range(1, 5)]
    ts = parts[3].try_cast("long") * UNITS[unit]
    return [*(c.alias(n) for c, n in zip(parts, "spo")), ts.alias("ts_ms"), F.timestamp_millis(ts).alias("ts")]


def parse_lines(lines: DataFrame, col: str = "value", unit: str = "ms") -> DataFrame:
    """Triples of a column of lines; lines that are not triples are left out. ``unit`` of the time: ms or s."""
    return lines.where(F.col(col).rlike(LINE)).select(*_parse(F.col(col), unit))


def read_ntriples(spark: SparkSession, path: str, seq: bool = True, unit: str = "ms") -> DataFrame:
    """Triples of text files; lines that are not triples are left out. ``seq``: with arrival ranks."""
    df = parse_lines(spark.read.text(path), unit=unit)
    return with_seq(df) if seq else df


def read_ntriples_stream(spark: SparkSession, path: str, unit: str = "ms") -> DataFrame:
    """The same as a stream of new files in a folder."""
    return parse_lines(spark.readStream.text(path), unit=unit)


def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder that driver and executors share: in ``spark.checkpoint.dir``, or for a local master without it on this machine."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if top is None:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = tempfile.mkdtemp(prefix="tidegraph-")
        atexit.register(shutil.rmtree, top, ignore_errors=True)
    return f"{top.rstrip('/')}/tidegraph/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """``df`` as a checkpoint, for rows whose places a second evaluation might change (after a shuffle)."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(work_folder(df.sparkSession, "checkpoints"))
    return df.checkpoint()


def with_seq(df: DataFrame) -> DataFrame:
    """Contiguous arrival ranks from 0 in the order of the input's partitions, without a global sort.

    ``df`` is evaluated twice and has to give the same partitions, as files do; make it ``settled`` where
    it does not. The driver sees one count for each partition.
    """
    marked = df.withColumn("_id", F.monotonically_increasing_id())
    part, rank = F.shiftright("_id", 33), F.col("_id").bitwiseAND((1 << 33) - 1)
    counts = sorted((r[0], r[1]) for r in marked.groupBy(part.alias("p")).count().collect())
    starts, total = [], 0
    for p, n in counts:
        starts.append((p, total))
        total += n
    table = df.sparkSession.createDataFrame(starts, "_part long, _start long")
    joined = marked.withColumn("_part", part).join(F.broadcast(table), "_part")
    return joined.withColumn("seq", F.col("_start") + rank).drop("_id", "_part", "_start")


def write_ntriples(triples: DataFrame, path: str, unit: str = "ms") -> None:
    """Triples as lines with timestamps, in files by arrival."""
    at = F.expr(f"ts_ms div {UNITS[unit]}")
    triples.select(F.format_string("%s %s %s . %d", "s", "p", "o", at).alias("value")).write.text(path)
