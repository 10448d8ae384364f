"""What the operators share: a folder all executors see, schema helpers, Arrow plumbing."""

from __future__ import annotations

import atexit
import ctypes
import os
import shutil
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What every worker reads as white space between words: space and \x09 to \x0d.
BLANKS = b" \t\n\r\x0b\x0c"

_own_dir: str | None = None


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under ``spark.checkpoint.dir``, which driver and executors share.

    Where it is unset, a folder of this machine serves a local master (as in tests); on a cluster, whose
    executors could not see that, it is an error.
    """
    global _own_dir
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if _own_dir is None:
            _own_dir = tempfile.mkdtemp(prefix="tidegraph-")
            atexit.register(shutil.rmtree, _own_dir, ignore_errors=True)
        top = f"file://{_own_dir}"
    return f"{top.rstrip('/')}/tidegraph/{name}-{uuid.uuid4().hex}"


#: Spark removes the shuffle files of a query that has ended, not only when its plan is collected as garbage.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path, was = shared_dir(spark, name), spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEAN, was) if was is not None else spark.conf.unset(_CLEAN)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def forget(*tables: DataFrame) -> None:
    """Removes tables made by ``written`` that no later step reads."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t._written)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def local_path(uri: str) -> str | None:
    """The path of a ``file:`` URI or plain path, else None."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return uri if uri.startswith("/") else None


def filesystem(uri: str):
    """(pyarrow file system, path in it) for a shared-folder URI."""
    from pyarrow import fs

    local = local_path(uri)
    return (fs.LocalFileSystem(), local) if local else fs.FileSystem.from_uri(uri)


def arrow_type(t: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(t)


def let(value: Column, use) -> Column:
    """``use(value)`` with the value made once, however often ``use`` refers to it or looks it up from a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(sizes: Column) -> Column:
    """The sum of all earlier elements, for each element of an array of int.

    In pieces of the square root of the array's size: an aggregate that grows an array copies it at each step.
    """

    def before(xs: Column) -> Column:
        zero = F.struct(F.lit(0).alias("sum"), F.array().cast("array<int>").alias("all"))
        return F.aggregate(xs, zero, lambda acc, x: F.struct((acc["sum"] + x).alias("sum"), F.concat(acc["all"], F.array(acc["sum"])).alias("all")), lambda acc: acc["all"])

    def cut(xs: Column) -> Column:
        each = F.ceil(F.sqrt(F.size(xs))).cast("int")
        return F.when(F.size(xs) > 0, F.transform(F.sequence(F.lit(1), F.size(xs), each), lambda i: F.slice(xs, i, each))).otherwise(F.array().cast("array<array<int>>"))

    def joined(pieces: Column) -> Column:
        totals = F.transform(pieces, lambda p: F.aggregate(p, F.lit(0), lambda acc, x: acc + x))
        return F.flatten(F.zip_with(pieces, before(totals), lambda p, start: F.transform(before(p), lambda x: x + start)))

    return let(sizes, lambda xs: let(cut(xs), joined))


def least_hash(total: int, wanted: int, bits: int = 30) -> int:
    """A bound for a hash of ``bits`` bits: of ``total`` rows about ``wanted`` are below it, and hardly ever fewer."""
    return 1 << bits if total <= wanted else int((1 << bits) * min(1.0, (wanted + 6 * wanted**0.5 + 10) / total)) + 1


def free_name(taken: list[str], name: str) -> str:
    """``name``, or ``name_1``, ... : a column name that clashes with none (case ignored)."""
    low, out, k = {x.lower() for x in taken}, name, 0
    while out.lower() in low:
        k += 1
        out = f"{name}_{k}"
    return out


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of at most ``rows`` rows in this session, which bounds a worker's memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def tidy(run):
    """A mapInArrow function that gives its worker's free memory back at the end of a task.

    Workers are used again for later stages, so what allocators keep would add up.
    """

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library: nothing to trim
                pass

    return tidied


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once, for clusters where it is not installed."""
    small_batches(spark)
    sc = spark.sparkContext
    if getattr(sc, "_tidegraph_shipped", False):
        return
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    base = os.path.join(tempfile.mkdtemp(prefix="tidegraph-zip-"), "tidegraph")
    made = shutil.make_archive(base, "zip", os.path.dirname(here), os.path.basename(here))
    sc.addPyFile(made)
    sc._tidegraph_shipped = True
