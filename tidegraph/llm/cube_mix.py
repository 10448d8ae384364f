"""Mixing sources to target weights by balanced sampling with the cube method.

Each source has a target number of words; a document's expected number of copies is its source's target
over its size. The whole part is taken for sure. The fraction is an inclusion probability, and the
cube method turns these into 0 or 1 while each source's sums over documents of probability and of
probability times words stay what they were: three open documents have a direction in which both
sums stand still, the null space of the constraints; moving along it until one probability
becomes 0 or 1 settles that document, and the next takes its place (flight). At the end at most two
stay open, and those and ``LAND`` documents of a source held back for it are settled so that the words
come nearest to the target (landing, by trying all ways).

Sources are dealt into blocks of about ``BLOCK`` documents by a hash of the id, so a source with a third
of all rows is many blocks; a block streams through with a few open documents in memory. Short documents
come first, and ``LAND`` of a block do not fly: the longest of each power of two in size, and the longest of
all where these are fewer, so that their sums lie close over a wide range whether many or few are to be
taken. What a source's blocks leave open (``LAND`` + 2 each at most) is dealt into fewer blocks until the
source has one, which lands: each source by itself, whatever the sizes of the others.

The driver gets one row for each source. Results depend on the rows alone, not on how they are dealt:
equal sizes go by a hash of the id, then of the whole row, and only equal rows can change places.

Defined results: null text has size 0; null source is a source of its own, the last; a source without
words has target 0; repeated rows are documents of their own; an empty table gives an empty result;
extra columns of any name stay.
"""

from __future__ import annotations

import math
import random
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, small_batches, tidy, written

BLOCK = 4096
LAND = 14  # documents that wait for the landing, beside the two that the flight leaves
WORD = r"[^\x20\x09-\x0D]+"
_EPS = 1e-9


def targets(sizes: dict[str | None, int], weights: tuple[float, ...] = (1, 2, 3), share: float = 1.0, most: float = 3.0) -> dict[str | None, float]:
    """Words to take from each source: ``share`` of all by weight, at most ``most`` times its size.

    What a source cannot take is dealt again by weight to those below their limit.
    """
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, out, open_ = share * sum(sizes.values()), {}, list(order)
    while open_:
        total = sum(weight[s] for s in open_)
        part = {s: left * weight[s] / total for s in open_}
        full = [s for s in open_ if part[s] > most * sizes[s]]
        if not full:
            return out | part
        for s in full:
            out[s] = float(most * sizes[s])
            left -= out[s]
        open_ = [s for s in open_ if s not in out]
    return out


class Flight:
    """The cube's flight for one block: at most three documents are open at a time.

    ``hold`` documents do not fly but wait for the landing: of documents that come by rising size, the
    last of each power of two, and the last of all where these are fewer.
    """

    def __init__(self, seed: str, hold: int = 0):
        self.random, self.hold = random.Random(seed), hold
        self.open: list[list] = []  # [probability, size, handle]
        self.queue: deque = deque()

    def waiting(self) -> list:
        return [*self.open, *self.queue]

    def _step(self, settled: list) -> bool:
        """Moves along the null space once; False if there is no direction left."""
        p = self.open
        if len(p) >= 3:
            a, b, c = p[0][1], p[1][1], p[2][1]
            u = (b - c, c - a, a - b) if not a == b == c else (1, -1, 0)
        elif len(p) == 2 and p[0][1] == p[1][1]:
            u = (1, -1)
        else:
            return False
        up = min((1 - x[0]) / d if d > 0 else x[0] / -d for x, d in zip(p, u, strict=False) if d)
        down = min(x[0] / d if d > 0 else (1 - x[0]) / -d for x, d in zip(p, u, strict=False) if d)
        step = up if self.random.random() * (up + down) < down else -down
        for x, d in zip(p, u, strict=False):
            x[0] += step * d
        rest = []
        for x in p:
            if x[0] < _EPS or x[0] > 1 - _EPS:
                settled.append((x[2], round(x[0])))
            else:
                rest.append(x)
        if len(rest) == len(p):  # rounding kept all off the faces: settle the nearest
            x = min(p, key=lambda x: min(x[0], 1 - x[0]))
            settled.append((x[2], round(x[0])))
            rest = [y for y in p if y is not x]
        self.open = rest
        return True

    def add(self, probability: float, size: int, handle) -> list:
        """Documents settled by one more: (handle, 0 or 1)."""
        settled: list = []
        self.queue.append([probability, size, handle])
        if len(self.queue) > self.hold:
            powers = [max(1, x[1]).bit_length() for x in self.queue]
            i = next((i for i in range(self.hold) if powers[i] == powers[i + 1]), 0)
            self.open.append(self.queue[i])
            del self.queue[i]
        while len(self.open) >= 3:
            self._step(settled)
        return settled

    def close(self) -> list:
        settled: list = []
        while self._step(settled):
            pass
        return settled

    def land(self) -> list:
        """Settles what is open or held with the words nearest to their expectation."""
        left = self.waiting()
        if not left:
            return []
        p, x = np.array([u[0] for u in left]), np.array([u[1] for u in left], float)
        take = np.arange(1 << len(left))[:, None] >> np.arange(len(left)) & 1
        best = np.lexsort((np.abs(take.sum(1) - p.sum()), np.abs(take @ x - p @ x)))[0]
        self.open, self.queue = [], deque()
        return [(u[2], int(v)) for u, v in zip(left, take[best], strict=True)]


def fewer_blocks(b: int, block: int) -> int:
    """Blocks for what a source's ``b`` blocks leave open: half at most, so that one is reached."""
    return max(1, min(b // 2, -(-(LAND + 2) * b // block)))


def _fly(rows: DataFrame, block: str, size: str, prob: str, copies: str, blocks_col: str, level: int) -> DataFrame:
    """Rows with ``prob`` moved: settled ones have ``copies`` raised by 0 or 1 and a null ``prob``.

    A source whose ``blocks_col`` is 1 lands, so all its rows are settled.
    """
    names, schema = rows.columns, rows.schema
    ib, is_, ip, ic, in_ = (names.index(x) for x in (block, size, prob, copies, blocks_col))

    def run(batches):
        flight, key, last, kept = None, None, False, {}  # kept: open documents' rows

        def row_of(table, prob_value, add):
            cols = list(table.columns)
            cols[ip] = pa.array([prob_value], pa.float64())
            cols[ic] = pa.array([cols[ic][0].as_py() + add], pa.int64())
            return pa.RecordBatch.from_arrays(cols, names=names)

        def finish():
            done = flight.close()
            if last:
                done += flight.land()
            out = [row_of(kept.pop(h), None, add) for h, add in done if h in kept]
            out += [row_of(kept.pop(x[2]), x[0], 0) for x in flight.waiting()]
            return out

        number = 0
        for b in batches:
            blocks, sizes, probs, counts = (b.column(i).to_pylist() for i in (ib, is_, ip, in_))
            add = np.zeros(b.num_rows, np.int64)
            here, late = {}, []
            for i, (k, s, p) in enumerate(zip(blocks, sizes, probs, strict=True)):
                if k != key:
                    if flight is not None:
                        done = flight.close() + (flight.land() if last else [])
                        still = {x[2]: x[0] for x in flight.waiting()}
                        for h, v in done:
                            if h in here:
                                add[here.pop(h)] = v
                            else:
                                late.append(row_of(kept.pop(h), None, v))
                        for h, v in still.items():
                            row = kept.pop(h) if h in kept else b.slice(here[h], 1)
                            late.append(row_of(row, v, 0))
                            if h in here:
                                add[here.pop(h)] = -1
                    flight, key, last = Flight(f"{level}|{k}", LAND), k, counts[i] == 1
                number += 1
                here[number] = i
                for h, v in flight.add(p, s, number):
                    if h in here:
                        add[here.pop(h)] = v
                    else:
                        late.append(row_of(kept.pop(h), None, v))
            for x in flight.waiting() if flight else ():
                if x[2] in here:
                    i = here.pop(x[2])
                    kept[x[2]] = b.take(pa.array([i]))
                    add[i] = -1
            out = np.flatnonzero(add >= 0)
            cols = list(b.columns)
            cols[ip] = pa.nulls(b.num_rows, pa.float64())
            cols[ic] = pa.array(cols[ic].to_numpy() + add)
            yield pa.RecordBatch.from_arrays(cols, names=names).take(pa.array(out))
            yield from late
        if flight is not None:
            yield from finish()

    return rows.mapInArrow(tidy(run), schema)


def with_copies(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", size_col: str | None = None, weights: tuple[float, ...] = (1, 2, 3), share: float = 1.0, most: float = 3.0, block: int = BLOCK, names: tuple[str, str, str, str] = ("size", "source_size", "target", "copies")) -> DataFrame:
    """All rows of ``docs`` with their size in words, their source's size and target, and copies to take.

    ``size_col``: an existing column with sizes, else words of ``text_col`` are counted. The added
    columns' ``names`` get a number where ``docs`` has them.
    """
    spark = docs.sparkSession
    size, source_size, target, copies = (free_name(docs.columns, n) for n in names)
    blk, prob, order, src_col, blocks_col = (free_name(docs.columns, n) for n in ("_cube_block", "_cube_prob", "_cube_order", "_cube_src", "_cube_blocks"))
    sized = docs.withColumn(size, F.col(size_col).cast("long") if size_col else F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long"))
    found = sized.groupBy(source_col).agg(F.sum(size).alias("s"), F.count("*").alias("n")).collect()
    sizes = {r[0]: r["s"] for r in found}
    goal = targets(sizes, weights, share, most)
    table = []
    for r in found:
        each = min(most, goal[r[0]] / r["s"]) if r["s"] else 0.0
        whole = math.floor(each + _EPS)
        table.append((r[0], r["s"], float(goal[r[0]]), int(whole), max(0.0, each - whole) if each - whole > _EPS else 0.0, max(1, -(-r["n"] // block))))
    about = spark.createDataFrame(table, T.StructType([T.StructField(src_col, T.StringType()), T.StructField(source_size, T.LongType()), T.StructField(target, T.DoubleType()), T.StructField(copies, T.LongType()), T.StructField(prob, T.DoubleType()), T.StructField(blocks_col, T.LongType())]))
    # One row for each source; the join is broadcast only where Spark finds the table small.
    rows = sized.join(about, F.col(source_col).eqNullSafe(F.col(src_col)))
    salt = F.xxhash64(F.col(id_col), F.col(size), F.lit(17))
    rows = rows.withColumn(blk, F.to_json(F.struct(F.col(src_col).alias("s"), F.pmod(salt, F.col(blocks_col)).alias("b")))).withColumn(order, salt).drop(src_col)

    # rows that tie in all else, as those of equal id and size but different text, go by a hash of the row
    whole = F.xxhash64(*(F.to_json(c) if "map<" in kind else F.col(c) for c, kind in docs.dtypes))

    result = rows.where(F.col(prob) == 0)
    open_ = rows.where(F.col(prob) > 0)
    n_blocks, level = max((t[5] for t in table), default=1), 0
    while True:
        last = n_blocks == 1
        dealt = open_.repartition(blk).sortWithinPartitions(F.col(blk), F.col(size), order, id_col, whole)
        moved = _fly(dealt, blk, size, prob, copies, blocks_col, level)
        if last:
            result = result.unionByName(moved)
            break
        moved = written(moved, "cube")
        result = result.unionByName(moved.where(F.col(prob).isNull()))
        n_blocks, level = fewer_blocks(n_blocks, block), level + 1
        src, b = F.get_json_object(blk, "$.s"), F.col(blocks_col)
        fewer = F.greatest(F.lit(1), F.least(F.floor(b / 2), F.ceil(b * (LAND + 2) / block))).cast("long")
        open_ = moved.where(F.col(prob).isNotNull()).withColumn(blocks_col, fewer)
        open_ = open_.withColumn(blk, F.to_json(F.struct(src.alias("s"), F.pmod(F.xxhash64(F.col(order), F.lit(level)), b).alias("b"))))
    return result.drop(blk, prob, order, blocks_col)


def op10_cube_mix(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sized = written(docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("words")), "cube-sizes")
    mixed = with_copies(sized, size_col="words")
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: each row as many times as the mix takes it."""
    small_batches(spark)
    mixed = with_copies(docs, names=("_cube_size", "_cube_source_size", "_cube_target", "_cube_copies"))
    many = mixed.columns[-1]
    return mixed.where(F.col(many) > 0).withColumn(free_name(mixed.columns, "_cube_each"), F.explode(F.sequence(F.lit(1), F.col(many).cast("int")))).select(*docs.columns)
