"""MinHash near-duplicates by a signature-coordinate inverted join, confirmed on full shingle sets.

1. Every text's set of word shingles gets a size, a 128-bit key and a short signature. Texts with equal
   sets are one class; all later work is on classes.
2. A class of which fewer than ``screen_least`` of ``SCREEN`` signature coordinates occur elsewhere has
   no partner (chance of error below 1e-5 at any threshold, below 1e-8 at 0.85) and is done. At thresholds
   too low for such a count no class is screened; below 13 % the join itself is not safe and is refused.
3. The rest get ``M`` coordinates and are posted under coordinate-value pairs. Two sets at the threshold
   collide in at least ``T`` of ``M`` coordinates (error below 1e-7 a pair), so with the values in order
   of rising frequency they meet under one of each one's first ``M - T + 1`` (the prefix); a frequent
   value is skipped by every class that has enough rare ones, so copies of one text with many
   different changes do not meet.
4. Round 1 counts the collisions of each member of a posting list with the list's leader, keeps ``T`` or more
   and confirms them on full sets: a list of alike texts becomes a star, not all its pairs. Round 2 merges
   the lists whose members are still in different components: a member merges the lists of its rarest
   ``M - T + 1`` coordinates, which gives counts; members whose count cannot reach ``T`` any more are
   skipped, and the long lists of the other coordinates are probed for the rest. Pairs of ``T`` collisions in
   different components are confirmed where they meet, on the full sets as bit sets of the block's shingles, and
   a block returns a spanning forest of its links: rows are in proportion to members, not to pairs.
5. Components of the confirmed links name the groups.

Nothing is capped: a long list becomes pairs of blocks of about ``BLOCK``, but for pairs inside one component, and
equal lists are looked at once. Sizes that go to the driver are counts.

Defined results: null or wordless texts are empty and linked with nothing; repeated rows share a group;
a null id never names a group unless all its members' are null; ids that occur twice are told apart by
their sets; an empty table gives an empty result; extra columns are not read. The pipeline stage tells
rows by id and text, so rows that share an id are judged apart, null ids too, and of repeated rows one stays.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, free_name, small_batches, tidy, written
from .graph import components, pieces
from .rolling import LOWER, Prefix, U, mix, text_chunks

SCREEN, SCREEN_LEAST, M = 32, 13, 128
BLOCK = 1024
_rng = np.random.default_rng(7)
_MULT = _rng.integers(1, 2**63, M, dtype=np.uint64) * U(2) + U(1)
_ADD = _rng.integers(1, 2**63, M, dtype=np.uint64)
_PLACE = _rng.integers(1, 2**63, 64, dtype=np.uint64) * U(2) + U(1)
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[32, 9, 10, 11, 12, 13]] = True


def threshold_matches(similarity: float, m: int = M, sigmas: float = 5.5) -> int:
    """Collisions that two sets at ``similarity`` reach but for a chance of ``sigmas`` deviations."""
    return max(1, int(similarity * m - sigmas * (m * similarity * (1 - similarity)) ** 0.5))


def screen_least(similarity: float, error: float = 1e-5) -> int:
    """Coordinates of SCREEN, SCREEN_LEAST at most, that a set with a partner at ``similarity`` shares but for a chance of ``error``."""
    least, below = 0, (1 - similarity) ** SCREEN
    while least < SCREEN_LEAST and below <= error:
        least += 1
        below += comb(SCREEN, least) * similarity**least * (1 - similarity) ** (SCREEN - least)
    return least


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of all texts end to end, their offsets).

    Words are runs of bytes other than space and \\x09-\\x0d, with A-Z lower-cased; a text of fewer
    than ``width`` words is one shingle, one without words has none.
    """
    n = len(offsets) - 1
    solid = ~_SEPARATOR[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    start = solid.copy()
    start[1:] &= ~solid[:-1] | edge[1:-1]
    end = solid.copy()
    end[:-1] &= ~solid[1:] | edge[1:-1]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    words = mix(Prefix(data, LOWER).of(s, e) + (e - s).astype(np.uint64) * _PLACE[63])
    first = np.searchsorted(s, offsets)  # first word of each text
    per = np.diff(first)
    total = np.zeros(max(len(words) - width + 1, 0), np.uint64)
    for j in range(width):
        total += words[j : j + len(total)] * _PLACE[j]
    total = mix(total)
    sets, sizes = [], np.zeros(n, np.int64)
    for i in range(n):
        if per[i] >= width:
            u = np.unique(total[first[i] : first[i + 1] - width + 1])
        elif per[i]:
            u = mix(np.array([(words[first[i] : first[i + 1]] * _PLACE[8 : 8 + per[i]]).sum() + U(per[i])], np.uint64))
        else:
            continue
        sets.append(u)
        sizes[i] = len(u)
    return np.concatenate(sets) if sets else np.zeros(0, np.uint64), np.concatenate([[0], np.cumsum(sizes)])


def signatures(flat: np.ndarray, offsets: np.ndarray, m: int) -> np.ndarray:
    """m minima (uint32) for each set that is not empty."""
    starts = offsets[:-1][np.diff(offsets) > 0]
    out = np.empty((len(starts), m), np.uint32)
    for c in range(m):
        out[:, c] = np.minimum.reduceat((flat ^ _ADD[c]) * _MULT[c] >> U(32), starts) if len(starts) else 0
    return out


def set_keys(flat: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """128 bits for each set that is not empty, equal for equal sets."""
    starts = offsets[:-1][np.diff(offsets) > 0]
    if not len(starts):
        return []
    a = np.add.reduceat(mix(flat), starts)
    b = np.bitwise_xor.reduceat(mix(flat ^ U(0xA5A5A5A5DEADBEEF)) * _PLACE[62], starts)
    return [x.tobytes() for x in np.column_stack([a, b])]


def most_apart(a, b, percent: int):
    """Largest symmetric difference of sets of sizes a and b that 100 * inter >= percent * union allows."""
    return (a + b) * (100 - percent) // (100 + percent)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Each row's id and text with a 128-bit hash of both."""
    digest = F.sha2(F.col(text_col).cast("binary"), 256)
    return docs.select(F.col(id_col).alias("_i"), F.col(text_col).alias("_t"), F.xxhash64(digest, F.col(id_col)).alias("k1"), F.xxhash64(F.lit(1), digest, F.col(id_col)).alias("k2"))


def _describe(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, k1 long, k2 long, n_shingles long, key binary, sig binary"

    def run(batches):
        for b in batches:
            for row, data, offsets in text_chunks(b.column(1)):
                flat, at = shingle_sets(data, offsets, width)
                sizes = np.diff(at)
                full = np.flatnonzero(sizes)
                keys, sigs = [None] * len(sizes), [None] * len(sizes)
                for i, k, s in zip(full.tolist(), set_keys(flat, at), signatures(flat, at, SCREEN), strict=True):
                    keys[i], sigs[i] = k, s.tobytes()
                yield pa.RecordBatch.from_arrays([*(b.column(j).slice(row, len(sizes)) for j in (0, 2, 3)), pa.array(sizes), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary())], names=[id_col, "k1", "k2", "n_shingles", "key", "sig"])

    return _keyed(docs, id_col, text_col).mapInArrow(tidy(run), schema)


def _tokens(sigs: DataFrame, m: int, keep: str, kind: str) -> DataFrame:
    """One row (token, keep) for each of the m coordinates of column ``sig``."""

    def run(batches):
        place = np.arange(m, dtype=np.uint64) * U(0x9E3779B97F4A7C15)
        for b in batches:
            for i in range(0, b.num_rows, 2048):
                part = b.slice(i, 2048)
                s = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint32).reshape(-1, m)
                token = mix(s.astype(np.uint64) * U(0xD6E8FEB86659FD93) + place)
                yield pa.RecordBatch.from_arrays([pa.array(token.ravel().view(np.int64)), part.column(0).take(pa.array(np.repeat(np.arange(part.num_rows), m)))], names=["token", keep])

    return sigs.select(keep, "sig").mapInArrow(tidy(run), f"token long, {keep} {kind}")


def _nodes(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """Full sets and signatures of the classes in ``wanted`` (k1, k2 of one row, key), numbered (nid)."""

    def run(batches):
        task, count = TaskContext.get().partitionId() << 36, 0
        for b in batches:
            for row, data, offsets in text_chunks(b.column(0)):
                flat, at = shingle_sets(data, offsets, width)
                sizes = np.diff(at)
                full = np.flatnonzero(sizes)
                rows = []
                for i, k, s in zip(full.tolist(), set_keys(flat, at), signatures(flat, at, M), strict=True):
                    rows.append((task + count, k, int(sizes[i]), s.tobytes(), flat[at[i] : at[i + 1]].tobytes()))
                    count += 1
                cols = list(zip(*rows, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["nid", "key", "n", "sig", "elements"])

    rows = _keyed(docs, id_col, text_col).join(wanted.select("k1", "k2"), ["k1", "k2"])
    nodes = written(rows.select("_t").mapInArrow(tidy(run), "nid long, key binary, n long, sig binary, elements binary"), "minhash-nodes")
    # rows whose id and text are both repeated make several nodes of a class: the least one stays
    again = nodes.groupBy("key").agg(F.count("*").alias("c"), F.min("nid").alias("nid")).where("c > 1")
    if again.isEmpty():
        return nodes
    gone = nodes.join(again.select("key", F.col("nid").alias("first")), "key").where("nid <> first").select("nid")
    return written(nodes.join(gone, "nid", "left_anti"), "minhash-nodes")


def merge_lists(sig: np.ndarray, comp: np.ndarray, size: np.ndarray, left: np.ndarray, right: np.ndarray, least: int, percent: int):
    """Pairs (i, j) of rows of ``sig`` that collide in ``least`` coordinates or more, in different components.

    i is in ``left``, j in ``right``; where both are one block, i < j. Each coordinate's values are posting lists.
    """
    n, m = sig.shape
    prefix = m - least + 1
    order = np.argsort(sig, axis=0, kind="stable")  # a coordinate's posting lists end to end
    value = np.take_along_axis(sig, order, 0)
    new = np.ones((n, m), bool)
    new[1:] = value[1:] != value[:-1]
    number = np.arange(n)[:, None]
    first = np.maximum.accumulate(np.where(new, number, 0), axis=0)
    stop = np.minimum.accumulate(np.where(np.append(new[1:], np.ones((1, m), bool), 0), number + 1, n)[::-1], axis=0)[::-1]
    begin, end = np.empty((n, m), np.int64), np.empty((n, m), np.int64)
    np.put_along_axis(begin, order, first, 0)
    np.put_along_axis(end, order, stop, 0)
    lists = np.ascontiguousarray(order.T)
    same = np.array_equal(left, right)
    other = np.zeros(n, bool)
    other[right] = True
    out = []
    for i in left.tolist():
        by = np.argsort(end[i] - begin[i], kind="stable")  # the short lists first
        head, rest = by[:prefix], by[prefix:]
        merged = np.concatenate([lists[c, a:b] for c, a, b in zip(head.tolist(), begin[i, head].tolist(), end[i, head].tolist(), strict=True)])
        count = np.bincount(merged, minlength=n)
        may = (count > 0) & other & (comp != comp[i]) & (abs(size - size[i]) <= most_apart(size, size[i], percent))
        if same:
            may[: i + 1] = False
        j = np.flatnonzero(may)
        have = count[j]
        for part in np.array_split(rest, 4):  # skip those that cannot reach the threshold any more
            keep = have + len(rest) >= least
            j, have = j[keep], have[keep]
            if not len(j):
                break
            have = have + (sig[np.ix_(j, part)] == sig[i, part]).sum(axis=1)
            rest = rest[len(part) :]
        out += [(i, x) for x in j[have >= least].tolist()]
    return out


def linked(pairs: np.ndarray, elements: list[np.ndarray], percent: int, slab: int | None = None) -> np.ndarray:
    """True for those of ``pairs`` (rows) whose full sets reach the similarity.

    Shingles that several rows have are numbered, and rows are bit sets of ``slab`` numbers at a time, by
    default so many that the rows have 2^24 of them together.
    """
    slab = slab or max(64, (1 << 24) // max(1, len(elements)))
    size = np.array([len(e) for e in elements], np.int64)
    owner = np.repeat(np.arange(len(size)), size)
    flat = np.concatenate(elements) if len(elements) else np.zeros(0, np.uint64)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.ones(len(flat), bool)
    new[1:] = flat[1:] != flat[:-1]
    shared = ~(new & np.append(new[1:], True))
    owner, number = owner[shared], np.cumsum(new[shared]) - 1
    inter = np.zeros(len(pairs), np.int64)
    top = int(number[-1]) + 1 if len(number) else 0
    for low in range(0, top, slab):
        i, j = np.searchsorted(number, (low, low + slab))
        width = min(slab, top - low)
        cells = np.zeros((len(size), -(-width // 64) * 64), bool)
        cells[owner[i:j], number[i:j] - low] = True
        bits = np.packbits(cells, axis=1).view(np.uint64)
        step = max(1, (1 << 20) // bits.shape[1])
        for at in range(0, len(pairs), step):
            a, b = pairs[at : at + step, 0], pairs[at : at + step, 1]
            inter[at : at + step] += np.bitwise_count(bits[a] & bits[b]).sum(axis=1, dtype=np.int64)
    union = size[pairs[:, 0]] + size[pairs[:, 1]] - inter
    return 100 * inter >= percent * union


def forest(pairs: np.ndarray, comp: np.ndarray) -> np.ndarray:
    """Those of ``pairs`` (rows) that join components not yet joined by earlier ones."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    keep = []
    for k, (a, b) in enumerate(zip(comp[pairs[:, 0]].tolist(), comp[pairs[:, 1]].tolist(), strict=True)):
        a, b = find(a), find(b)
        if a != b:
            parent[a] = b
            keep.append(k)
    return pairs[keep]


def _merged(lists: DataFrame, nodes: DataFrame, percent: int) -> tuple[DataFrame, ...]:
    """Links between components that the posting lists (token, nid) hold, enough for all; and the tables they come from.

    Components with over ``BLOCK`` members in a list have blocks of their own, which do not meet each other.
    """
    rows = lists.join(nodes.select("nid", "comp"), "nid")
    per = rows.groupBy("token", "comp").agg(F.count("*").alias("c"))
    small = per.where(F.col("c") <= BLOCK).groupBy("token").agg(F.ceil(F.sum("c") / BLOCK).alias("bins"))
    per = per.join(small, "token", "left").withColumn("many", F.when(F.col("c") > BLOCK, F.ceil(F.col("c") / BLOCK)))
    mine = F.struct(F.when(F.col("many").isNotNull(), F.col("comp")).alias("own"), F.when(F.col("many").isNotNull(), F.pmod(F.xxhash64("nid"), F.col("many"))).otherwise(F.pmod(F.xxhash64("comp"), F.col("bins"))).alias("bin"))
    placed = written(rows.join(per.select("token", "comp", "many", "bins"), ["token", "comp"]).select("token", "nid", mine.alias("block")), "minhash-blocks")
    blocks = placed.select("token", "block").distinct()
    apart = F.col("lo.own").isNull() | (F.col("lo.own") != F.coalesce("hi.own", F.lit(-1)))  # two blocks, or one of small components
    pairs = blocks.withColumnRenamed("block", "lo").join(blocks.withColumnRenamed("block", "hi"), "token").where((F.col("lo") <= F.col("hi")) & apart)
    pairs = written(pairs, "minhash-block-pairs")
    sides = [placed.join(pairs.withColumn("block", F.col(x)).where(F.lit(x == "lo") | (F.col("lo") != F.col("hi"))), ["token", "block"]) for x in ("lo", "hi")]
    dealt = sides[0].unionByName(sides[1]).join(nodes.select("nid", "comp", "sig", "elements"), "nid")
    dealt = dealt.select("token", F.xxhash64("lo").alias("a"), F.xxhash64("hi").alias("b"), (F.col("block") == F.col("lo")).alias("left"), (F.col("block") == F.col("hi")).alias("right"), "nid", "comp", "sig", "elements")
    dealt = dealt.repartition("token", "a", "b").sortWithinPartitions("token", "a", "b", "nid")
    least = threshold_matches(percent / 100)

    def run(batches):
        held, key = [], None

        def close():
            if len({r[3] for r in held}) < 2:
                return None
            left, right, nid, comp, sig, sets = zip(*held, strict=True)
            nid, comp = np.array(nid), np.array(comp)
            sets = [np.frombuffer(x, np.uint64) for x in sets]
            table = np.frombuffer(b"".join(sig), np.uint32).reshape(-1, M)
            pairs = merge_lists(table, comp, np.array([len(x) for x in sets]), np.flatnonzero(left), np.flatnonzero(right), least, percent)
            pairs = np.array(pairs, np.int64).reshape(-1, 2)
            pairs = forest(pairs[linked(pairs, sets, percent)], comp)
            ends = np.sort(nid[pairs], axis=1)
            return pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], names=["a", "b"])

        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns]
            for k, row in zip(zip(*cols[:3], strict=True), zip(*cols[3:], strict=True), strict=True):
                if k != key:
                    if held and (out := close()) is not None:
                        yield out
                    held, key = [], k
                held.append(row)
        if held and (out := close()) is not None:
            yield out

    return dealt.mapInArrow(tidy(run), "a long, b long").distinct(), placed, pairs


def _colliding(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs whose signatures collide in the threshold's number of coordinates or more."""
    least = threshold_matches(percent / 100)
    sig = nodes.select("nid", "sig", "n")
    both = pairs.join(sig.withColumnsRenamed({"nid": "a", "sig": "sa", "n": "na"}), "a").join(sig.withColumnsRenamed({"nid": "b", "sig": "sb", "n": "nb"}), "b")

    def run(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint32).reshape(-1, M) for i in (2, 3))
            n, o = (batch.column(i).to_numpy() for i in (4, 5))
            good = ((x == y).sum(axis=1) >= least) & (abs(n - o) <= most_apart(n, o, percent))
            yield batch.select([0, 1]).filter(pa.array(good))

    return both.select("a", "b", "sa", "sb", "na", "nb").mapInArrow(tidy(run), "a long, b long")


def _confirm(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets reach the similarity."""
    sets = nodes.select("nid", "elements")
    both = pairs.join(sets.withColumnsRenamed({"nid": "a", "elements": "ea"}), "a").join(sets.withColumnsRenamed({"nid": "b", "elements": "eb"}), "b")

    def run(batches):
        for batch in batches:
            good = []
            for x, y in zip(*(batch.column(i).to_pylist() for i in (2, 3)), strict=True):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.concatenate([p, q])
                both.sort(kind="stable")
                inter = int((both[1:] == both[:-1]).sum())
                good.append(100 * inter >= percent * (len(p) + len(q) - inter))
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    return both.select("a", "b", "ea", "eb").mapInArrow(tidy(run), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85, width: int = 5) -> DataFrame:
    """Per row of ``docs``: id, ``n_shingles``, ``component_id``, ``kept``."""
    if not 13 <= percent <= 100:
        raise ValueError("percent must be from 13 to 100: below, pairs at the threshold may collide nowhere")
    about = written(_describe(docs, id_col, text_col, width), "minhash-docs")
    classes = written(about.where("key is not null").groupBy("key").agg(F.min(id_col).alias("rep"), F.min(F.struct("k1", "k2")).alias("row"), F.first("sig").alias("sig")).coalesce(pieces(about.count())), "minhash-classes")
    wanted, least = classes.select("row.k1", "row.k2"), screen_least(percent / 100)
    if least:
        # classes go by 64 bits here: two of equal bits would only let both through
        short = _tokens(classes.select(F.xxhash64("key").alias("k"), "sig"), SCREEN, "k", "long")
        shared = short.groupBy("token").agg(F.count("*").alias("c")).where("c > 1").select("token")
        near = short.join(shared, "token", "left_semi").groupBy("k").agg(F.count("*").alias("c")).where(F.col("c") >= least)
        wanted = classes.select("row.k1", "row.k2", F.xxhash64("key").alias("k")).join(near, "k").select("k1", "k2")
    nodes = _nodes(docs, wanted, id_col, text_col, width)

    matches = threshold_matches(percent / 100)
    prefix = M - matches + 1
    tokens = written(_tokens(nodes, M, "nid", "long"), "minhash-tokens")
    counts = tokens.groupBy("token").agg(F.count("*").alias("c")).where("c > 1")
    order = tokens.join(counts, "token").groupBy("nid").agg(F.array_sort(F.collect_list(F.struct("c", "token"))).alias("t"))  # at most M each
    room = F.greatest(F.lit(0), F.lit(prefix - M) + F.size("t"))
    many = pieces(nodes.count())
    posted = written(order.select("nid", F.explode(F.slice("t", F.lit(1), room)).alias("t")).select("nid", F.col("t.token").alias("token")).coalesce(many), "minhash-posted")
    forget(tokens)
    lead = F.min(F.struct(F.xxhash64("nid").alias("h"), F.col("nid").alias("lead")))
    lists = posted.groupBy("token").agg(F.count("*").alias("c"), F.sum(F.xxhash64("nid").cast("decimal(20,0)")).alias("s"), F.bit_xor(F.xxhash64("nid", F.lit(1))).alias("x"), lead.alias("l")).where("c > 1")
    once = lists.groupBy("c", "s", "x").agg(F.min(F.struct("token", "l.lead")).alias("t"))  # equal lists are looked at once
    lists = written(posted.join(once.select("t.token", "t.lead", "c"), "token"), "minhash-lists")
    forget(posted)

    star = lists.where("nid <> lead").select(F.least("nid", "lead").alias("a"), F.greatest("nid", "lead").alias("b")).distinct()
    links = written(_confirm(_colliding(star, nodes, percent), nodes, percent), "minhash-links")
    roots = components(links)
    merged = nodes.join(roots.withColumnRenamed("node", "nid"), "nid", "left").withColumn("comp", F.coalesce("root", "nid"))
    # of a list of two the only pair has been counted
    open_ = written(lists.where("c > 2").join(merged.select("nid", "comp"), "nid").groupBy("token").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1").select("token").coalesce(many), "minhash-open")  # so that a frequent value's join can be split
    left = written(lists.join(open_, "token", "left_semi").select("token", "nid"), "minhash-open-lists")
    forget(lists)
    if not left.isEmpty():
        found, *tables = _merged(left, merged, percent)
        more = written(found, "minhash-links")
        forget(*tables)
        if not more.isEmpty():
            roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))
    forget(left)

    named = nodes.select("key", F.col("nid").alias("node")).join(roots, "node")
    by_class = classes.select("key", "rep").join(named.select("key", "root"), "key", "left")
    group = by_class.where("root is not null").groupBy("root").agg(F.min("rep").alias("low"))
    final = by_class.join(group, "root", "left").select("key", F.coalesce("low", "rep").alias("component_id"))
    out = about.select(id_col, "n_shingles", "key").join(final, "key", "left")
    out = out.withColumn("component_id", F.when(F.col("key").isNull(), F.col(id_col)).otherwise(F.col("component_id")))
    return out.select(id_col, "n_shingles", "component_id", F.col(id_col).eqNullSafe(F.col("component_id")).alias("kept"))


def op9_minhash_join(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage(spark, docs: DataFrame, sf_dir: str, percent: int = 80) -> DataFrame:
    """Pipeline stage: of each group of near-duplicates the row of the smallest id stays (five words, 0.8).

    Rows without words all stay. Of rows with the same id and text, one whose JSON is least stays.
    """
    small_batches(spark)
    row = free_name(docs.columns, "_row")
    id_ = F.col("doc_id")
    rows = docs.withColumn(row, F.struct(id_.isNull().alias("none"), id_.alias("id"), F.xxhash64("text").alias("h")))
    groups = written(near_duplicates(rows, id_col=row, percent=percent), "minhash-rows")
    gone = groups.where(~F.col("kept")).select(row).distinct()
    again = groups.where(F.col("kept") & (F.col("n_shingles") > 0)).groupBy(row).agg(F.count("*").alias("c")).where("c > 1").select(row)
    if again.isEmpty():
        return rows.join(gone, row, "left_anti").select(*docs.columns)
    single = rows.join(gone.unionByName(again), row, "left_anti").select(*docs.columns)
    whole = F.struct(*docs.columns)
    one = rows.join(again, row, "left_semi").groupBy(row).agg(F.min_by(whole, F.to_json(whole)).alias(row + "_one"))
    return single.unionByName(one.select(row + "_one.*"))
