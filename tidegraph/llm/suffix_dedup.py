"""Repeated byte strings across and inside documents, by a sparse suffix array.

All strings of ``length`` bytes that start at two places or more are found, and the bytes they cover
removed. Sorting every suffix of a corpus would shuffle each byte ``length`` times; so:

1. Anchors. Of the ``length - ANCHOR + 1`` substrings of ``ANCHOR`` bytes in a string, the one with the
   least fingerprint (the leftmost of equals) is its anchor. Equal strings have equal anchors at equal
   offsets, and consecutive strings mostly share one, so about one suffix in seventy, the one at the
   anchor, stands for all. Its leading token is the fingerprint of the anchor, its context what its
   strings span.
2. First sort, all suffixes: sampled splitters range-partition them by leading token, context and place,
   so a frequent token is many buckets. Each bucket sorts by multikey quicksort and compares neighbours:
   suffixes of equal context are repeats of each other, a token that occurs once has none. One suffix of
   each context of the other tokens goes on; a token at the edge of a bucket, which may go on in the
   next, always does.
3. Second sort, of those, by text: the same by leading token and the text right of the anchor. Each bucket
   sorts the right texts and the reversed texts left of the anchors by multikey quicksort over tokens of eight
   bytes. Two strings with the anchor at offset d are equal if their neighbours in between have ``length - d``
   bytes in common in the one order and d in the other, which the bytes decide.
4. Across boundaries: a string with the anchor at offset d has equals in other buckets only if it has ``length -
   d`` bytes to the right in common with the first or last suffix of its bucket. Suffixes with such strings are
   sorted once more, in the order of the left texts, and compared as before; of them only strings that have d bytes in
   common with the first or last of that bucket are left, each different one once. Those are
   range-partitioned by fingerprint and neighbours from different buckets compared.
5. Spans are merged and cut from each document.

Step 2 compares contexts and step 4 strings by 128-bit fingerprints (two bases). A bucket is read in pieces
between leading tokens; a token that fills a piece is cut there, as at a boundary, so memory is bounded
whatever the key. Rows go by a 128-bit hash of id and text.

Defined results: null and empty texts have no bytes; strings never cross documents; repeated rows are repeats
of each other; rows that share an id are told apart by their text; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, tidy, written
from .rolling import BASE_2, TABLE_2, Prefix, U, mix, text_chunks

ANCHOR = 64
_POS = 20  # low bits of a minimum's key that hold its place
KEY = "k1 long, k2 long"


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values, by doubling."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = np.minimum(x[:-step], x[step:])
        have += step
    return x


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = 200):
    """(text, anchor, first string, number of strings, leading token, two halves of the context's fingerprint).

    Places are in ``data``. Each row stands for a run of consecutive strings with one anchor.
    """
    strings = len(data) - length + 1
    none = (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),) * 3
    if strings <= 0:
        return none
    prefix = Prefix(data)
    finger = mix(prefix.every(ANCHOR))
    width = length - ANCHOR + 1
    best = np.empty(strings, np.int64)
    piece = (1 << _POS) - width
    for at in range(0, strings, piece):
        part = finger[at : at + piece + width - 1]
        low = _sliding_min(part >> U(_POS) << U(_POS) | np.arange(len(part), dtype=np.uint64), width)
        best[at : at + piece] = (low & U((1 << _POS) - 1)).astype(np.int64)[: strings - at] + at
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:strings]
    inside = np.arange(strings) + length <= offsets[1:][text]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | (best[1:] != best[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(begin)
    if not len(first):
        return none
    stop = inside.copy()
    stop[:-1] &= ~inside[1:] | begin[1:]
    n = np.flatnonzero(stop) - first + 1
    anchor = best[first]
    lead = finger[anchor] ^ U(0x2545F4914F6CDD1D)
    shape = ((anchor - first).astype(np.uint64) << U(32)) + n.astype(np.uint64)
    c1, c2 = (mix(p.of(first, first + n + length - 1) ^ mix(shape)) for p in (prefix, Prefix(data, TABLE_2, BASE_2)))
    return text[first], anchor, first, n, lead, c1, c2


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Each row's id and text with a 128-bit hash of both."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    digest = F.sha2(text.cast("binary"), 256)
    return docs.select(F.col(id_col).alias("_i"), text.alias("_t"), F.xxhash64(digest, F.col(id_col)).alias("k1"), F.xxhash64(F.lit(1), digest, F.col(id_col)).alias("k2"))


def _anchor_rows(docs: DataFrame, id_col: str, text_col: str, length: int) -> DataFrame:
    names = ["k1", "k2", "lead", "c1", "c2", "at", "lo", "n"]

    def run(batches):
        for b in batches:
            for row, data, offsets in text_chunks(b.column(0)):
                text, anchor, first, n, *prints = anchors(data, offsets, length)
                start = offsets[:-1][text]
                pick = pa.array(row + text)
                yield pa.RecordBatch.from_arrays([b.column(1).take(pick), b.column(2).take(pick), *(pa.array(x.view(np.int64)) for x in prints), *(pa.array(x.astype(np.int32)) for x in (anchor - start, first - start, n))], names=names)

    rows = _keyed(docs, id_col, text_col).where(F.octet_length("_t") >= length)
    return rows.select("_t", "k1", "k2").mapInArrow(tidy(run), f"{KEY}, lead long, c1 long, c2 long, at int, lo int, n int")


def multikey_quicksort(tokens: np.ndarray, run: np.ndarray) -> np.ndarray:
    """Order of rows of ``tokens`` (rows x depth, uint64) by ``run``, then token by token.

    The three-way quicksort of strings, one step for all open runs at a time: each run takes the median of
    three of its tokens at its depth as pivot and falls apart into less, equal and greater; equals go on
    at the next token, runs of one row are done.
    """
    order = np.argsort(run, kind="stable")
    group = run[order]
    place = np.arange(len(order))
    depth = np.zeros(len(order), np.int64)
    while True:
        first = np.ones(len(place), bool)
        first[1:] = group[1:] != group[:-1]
        alone = first & np.append(first[1:], True)
        open_ = ~alone & (depth < tokens.shape[1])
        if not open_.any():
            return order
        place, group, depth = place[open_], group[open_], depth[open_]
        start = np.flatnonzero(first[open_])
        size = np.diff(np.append(start, len(place)))
        rows = order[place]
        value = tokens[rows, depth]
        a, b, c = value[start], value[start + size // 2], value[start + size - 1]
        pivot = np.repeat(np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c)), size)
        side = (value >= pivot).astype(np.int64) + (value > pivot)
        group = np.repeat(np.arange(len(start)), size) * 3 + side
        by = np.argsort(group, kind="stable")
        order[place] = rows[by]
        group, depth = group[by], (depth + (side == 1))[by]


def common_bytes(tokens: np.ndarray, order: np.ndarray, run: np.ndarray) -> np.ndarray:
    """Bytes that each row has in common with the one before it in ``order``; -1 at the start of a run."""
    out = np.full(len(order), -1, np.int64)
    at = np.flatnonzero(run[order[1:]] == run[order[:-1]]) + 1
    out[at] = 0
    for k in range(tokens.shape[1]):
        x = tokens[order[at], k] ^ tokens[order[at - 1], k]
        out[at] += sum((x < U(1 << 8 * j)).astype(np.int64) for j in range(8))
        at = at[x == 0]
        if not len(at):
            break
    return out


def _pieces(batches, lead: int, weight, most: int):
    """Tables of about ``most`` (sum of ``weight`` of a batch) of rows that are sorted by column ``lead``.

    Yields (table, whether its first token may have begun before, whether its last may go on after).
    """
    held, have, before = [], 0, True
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        have += weight(b)
        if have < most:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        tokens = table.column(lead).to_numpy()
        cut = int(np.searchsorted(tokens, tokens[-1]))  # the last token may go on
        if cut:
            yield table.slice(0, cut), before, False
            before, held = False, table.slice(cut).combine_chunks().to_batches()
            have = sum(map(weight, held))
        else:
            yield table, True, True
            before, held, have = True, [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks(), before, True


def _runs(lead: np.ndarray) -> np.ndarray:
    new = np.ones(len(lead), np.int64)
    new[1:] = lead[1:] != lead[:-1]
    return np.cumsum(new) - 1


def _first_sort(found: DataFrame, most: int) -> DataFrame:
    """Of suffixes with a repeat and of those to be sorted by text: place, ``done`` (is a repeat), ``on`` (goes on)."""
    ranged = found.repartitionByRange("lead", "c1", "c2", F.xxhash64("k1", "at")).sortWithinPartitions("lead")

    def run(batches):
        for table, before, after in _pieces(batches, 2, lambda b: b.num_rows, most):
            tokens = np.column_stack([table.column(i).to_numpy().view(np.uint64) for i in (3, 4)])
            lead = _runs(table.column(2).to_numpy())
            order = multikey_quicksort(tokens, lead)
            tokens, lead = tokens[order], lead[order]
            new = np.ones(len(order), bool)
            new[1:] = (lead[1:] != lead[:-1]) | (tokens[1:] != tokens[:-1]).any(axis=1)
            many = ~(new & np.append(new[1:], True))
            contexts = np.bincount(lead, new)
            contexts[0] += before
            contexts[-1] += after
            on = new & (contexts[lead] > 1)
            keep = many | on
            pick = table.take(pa.array(order[keep]))
            token = pa.array(pick.column(2).to_numpy(), mask=~on[keep])
            yield pa.RecordBatch.from_arrays([*(pick.column(i).combine_chunks() for i in (0, 1)), token, *(pick.column(i).combine_chunks() for i in (5, 6, 7)), pa.array(many[keep]), pa.array(on[keep])], names=["k1", "k2", "lead", "at", "lo", "n", "done", "on"])

    return ranged.mapInArrow(tidy(run), f"{KEY}, lead long, at int, lo int, n int, done boolean, on boolean")


def _texts(data: np.ndarray, start: np.ndarray, size: np.ndarray, width: int, step: int) -> np.ndarray:
    """Tokens of eight bytes of the texts from ``start``, forward (step 1) or backward (-1), zeros after ``size``."""
    wide = -(-width // 8) * 8
    at = np.arange(wide)
    where = start[:, None] + step * at
    inside = at < size[:, None]
    return np.where(inside, data[np.where(inside, where, 0)], 0).astype(np.uint8).view(">u8").astype(np.uint64)


def _sides(at, lo, n, contexts: list[bytes], length: int):
    """Contexts end to end, the anchors' places there, and tokens of the texts right and left of them."""
    sizes = np.array([len(c) for c in contexts], np.int64)
    data = np.frombuffer(b"".join(contexts), np.uint8)
    anchor = np.cumsum(sizes) - sizes + at - lo
    right = _texts(data, anchor, length - (at - lo - n + 1), length, 1)
    left = _texts(data, anchor - 1, at - lo, length - ANCHOR, -1)
    return data, anchor, (right, left)


def repeats_by_text(lead, at, lo, n, since, texts, length: int):
    """For each anchor offset d the classes of equal strings: yields (d, rows in class order, where classes start).

    Rows are numbers of suffixes; those of equal ``lead`` are adjacent. A row's strings begin at offset ``since``.
    """
    most, least = at - lo, np.maximum(at - lo - n + 1, since)  # offsets of the anchor in its strings
    run = _runs(lead)
    orders = [multikey_quicksort(t, run) for t in texts]
    shared = [common_bytes(t, o, run) for t, o in zip(texts, orders, strict=True)]
    group = np.empty((2, len(run)), np.int64)
    for d in range(length - ANCHOR + 1):
        rows = np.flatnonzero((least <= d) & (d <= most))
        if not len(rows):
            continue
        for g, o, c, need in zip(group, orders, shared, (length - d, d), strict=True):
            g[o] = np.cumsum(c < need)
        key = group[0][rows] * (len(run) + 1) + group[1][rows]
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        yield d, rows[order], new


def _edges(tokens: np.ndarray, lead: np.ndarray, before: bool, after: bool) -> np.ndarray:
    """Bytes that each row, in sorted order, has in common with what may stand before and after the piece; -1 if its token ends here."""
    out = np.full(len(lead), -1, np.int64)
    for edge, at in ((before, 0), (after, len(lead) - 1)):
        if edge:
            rows = np.flatnonzero(lead == lead[at])
            common, open_ = np.zeros(len(rows), np.int64), np.ones(len(rows), bool)
            for k in range(tokens.shape[1]):
                x = tokens[rows, k] ^ tokens[at, k]
                common += open_ * sum((x < U(1 << 8 * j)).astype(np.int64) for j in range(8))
                open_ &= x == 0
            out[rows] = np.maximum(out[rows], common)
    return out


def _second_sort(suffixes: DataFrame, length: int, most: int, right: bool) -> DataFrame:
    """Spans of repeated strings of ``suffixes``, by text, and what is to be compared across boundaries.

    Buckets are in the order of the right texts or of the reversed left ones. What goes on are suffixes with
    the offsets from which their strings do (``since``), or, after the left order, strings (``f1``, ``f2``).
    """
    side = F.substring("ctx", F.col("at") - F.col("lo") + 1, F.lit(length)) if right else F.col("rev")
    ranged = suffixes.repartitionByRange("lead", side, F.xxhash64("k1", "at")).sortWithinPartitions("lead", side)
    ranged = ranged.select("k1", "k2", "lead", "at", "lo", "n", "done", "since", "ctx")
    far = length - ANCHOR
    names = ["k1", "k2", "lo", "hi"] + (["lead", "at", "n", "done", "since", "ctx", "rev"] if right else ["f1", "f2", "done"])
    more = "lead long, at int, n int, done boolean, since int, ctx binary, rev binary" if right else "f1 long, f2 long, done boolean"
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int32(), pa.binary(), pa.binary()] if right else [pa.int64(), pa.int64(), pa.bool_()]

    def row(table, rows, *columns):
        pick = table.take(pa.array(rows))
        return pa.RecordBatch.from_arrays([pick.column(0).combine_chunks(), pick.column(1).combine_chunks(), *columns], names=names)

    def run(batches):
        for table, before, after in _pieces(batches, 2, lambda b: b.nbytes, most):
            lead, at, lo, n = (table.column(i).to_numpy().astype(np.int64) for i in range(2, 6))
            done = table.column(6).to_numpy(zero_copy_only=False)
            since, contexts = table.column(7).to_numpy().astype(np.int64), table.column(8).to_pylist()
            data, anchor, texts = _sides(at, lo, n, contexts, length)
            common = _edges(texts[0 if right else 1], lead, before, after)
            hit = np.zeros((len(lead), far + 3), bool)  # a place's string d is column far - d + 1
            passed = []
            for d, rows, new in repeats_by_text(lead, at, lo, n, since, texts, length):
                again = ~(new & np.append(new[1:], True))
                hit[rows[again & ~done[rows]], far - d + 1] = True
                if not right:
                    one = np.flatnonzero(new & (common[rows] >= d))
                    passed.append((rows[one], np.full(len(one), d), again[one] | done[rows[one]]))
            step = np.diff(hit.astype(np.int8), axis=1)
            (i, s), (_, e) = np.nonzero(step == 1), np.nonzero(step == -1)
            # column c + 1 is the string that starts far - c bytes before the anchor
            low, high = (at[i] - far + s).astype(np.int32), (at[i] - far + e - 1 + length).astype(np.int32)
            yield row(table, i, pa.array(low), pa.array(high), *(pa.nulls(len(i), k) for k in kinds))
            if right:
                start = np.maximum(length - common, at - lo - n + 1)
                i = np.flatnonzero((common >= 0) & (start <= at - lo))
                rev = [contexts[j][: at[j] - lo[j]][::-1] for j in i.tolist()]
                pick = table.take(pa.array(i))
                yield row(table, i, pick.column(4).combine_chunks(), pa.nulls(len(i), pa.int32()), *(pick.column(j).combine_chunks() for j in (2, 3, 5, 6)), pa.array(start[i].astype(np.int32)), pick.column(8).combine_chunks(), pa.array(rev, pa.binary()))
            elif passed:
                i, d, settled = (np.concatenate(x) for x in zip(*passed, strict=True))
                start = anchor[i] - d
                f1, f2 = (mix(p.of(start, start + length)) for p in (Prefix(data), Prefix(data, TABLE_2, BASE_2)))
                low = (at[i] - d).astype(np.int32)
                yield row(table, i, pa.array(low), pa.array(low + np.int32(length)), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)), pa.array(settled))

    return ranged.mapInArrow(tidy(run), f"{KEY}, lo int, hi int, {more}")


def _across(strings: DataFrame) -> DataFrame:
    """Spans of strings that occur in several buckets and are not settled in theirs. A string comes once from a bucket."""
    ranged = strings.repartitionByRange("f1", "f2").sortWithinPartitions("f1", "f2").select("f1", "f2", "k1", "k2", "lo", "hi", "done")

    def run(batches):
        rest = None
        for b in chain(batches, (None,)):
            held = [x for x in (rest, b) if x is not None and x.num_rows]
            if not held:
                continue
            table = pa.Table.from_batches(held)
            f1, f2 = table.column(0).to_numpy(), table.column(1).to_numpy()
            new = np.ones(len(f1), bool)
            new[1:] = (f1[1:] != f1[:-1]) | (f2[1:] != f2[:-1])
            end = len(f1) if b is None else int(np.flatnonzero(new)[-1])  # the last string may go on
            again = ~(new & np.append(new[1:], True)) & ~table.column(6).to_numpy(zero_copy_only=False)
            again[end:] = False
            yield from table.select([2, 3, 4, 5]).filter(pa.array(again)).combine_chunks().to_batches()
            rest = None if end == len(f1) else table.slice(end).combine_chunks().to_batches()[0]

    return ranged.mapInArrow(tidy(run), f"{KEY}, lo int, hi int")


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, piece_rows: int = 400_000, piece_bytes: int = 6_000_000) -> DataFrame:
    """(k1, k2, lo, hi): byte ranges covered by strings of ``length`` bytes that start elsewhere too.

    k1 and k2 are the row's hash. A bucket is sorted in pieces of ``piece_rows`` suffixes, or ``piece_bytes`` of text.
    """
    if length <= ANCHOR:
        raise ValueError(f"length must be over {ANCHOR}")
    found = written(_anchor_rows(docs, id_col, text_col, length), "suffix-anchors")
    places = written(_first_sort(found, piece_rows), "suffix-places")
    forget(found)
    # The texts go to their suffixes, not all texts to all: one row of places for each document.
    each = places.where("on").groupBy("k1", "k2").agg(F.collect_set(F.struct("lead", "at", "lo", "n", "done")).alias("s"))
    texts = _keyed(docs, id_col, text_col).join(each, ["k1", "k2"]).select("k1", "k2", F.encode("_t", "UTF-8").alias("b"), F.explode("s").alias("s"))
    context = F.substring("b", F.col("s.lo") + 1, F.col("s.n") + length - 1)
    suffixes = written(texts.select("k1", "k2", "s.*", F.lit(0).alias("since"), context.alias("ctx")), "suffix-contexts")
    by_right = written(_second_sort(suffixes, length, piece_bytes, True), "suffix-right")
    forget(suffixes)
    by_left = written(_second_sort(by_right.where("ctx is not null"), length, piece_bytes, False), "suffix-left")
    across = _across(by_left.where("f1 is not null"))
    spans = places.where("done").select("k1", "k2", "lo", (F.col("lo") + F.col("n") + length - 1).alias("hi"))
    for more in (by_right.where("ctx is null"), by_left.where("f1 is null"), across):
        spans = spans.unionByName(more.select("k1", "k2", "lo", "hi"))
    return spans


def cut(raw: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, list[tuple[int, int]]]:
    """What is left of ``raw``, and the merged spans (touching ones are one run)."""
    merged: list[list[int]] = []
    for lo, hi in sorted(spans):
        if merged and lo <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], hi)
        else:
            merged.append([lo, hi])
    left, at = [], 0
    for lo, hi in merged:
        left.append(raw[at:lo])
        at = hi
    left.append(raw[at:])
    return b"".join(left), [tuple(x) for x in merged]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, **pieces) -> DataFrame:
    """Per row of ``docs``: id, n_bytes, n_removed, n_spans, kept (binary: the bytes that stay)."""
    spans = repeated_spans(docs, id_col, text_col, length, **pieces)
    by_text = spans.groupBy("k1", "k2").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))
    rows = _keyed(docs, id_col, text_col).join(by_text, ["k1", "k2"], "left").select("_i", "_t", "spans")
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 1000):
                part = b.slice(i, 1000)
                out = []
                for text, spans in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    raw = text.encode("utf-8", "surrogatepass")
                    left, merged = cut(raw, [(x["lo"], x["hi"]) for x in spans or ()])
                    out.append((len(raw), len(raw) - len(left), len(merged), left))
                cols = list(zip(*out, strict=True)) or [()] * 4
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True))], names=[id_col, "n_bytes", "n_removed", "n_spans", "kept"])

    return rows.mapInArrow(tidy(run), f"{id_col} {kind}, n_bytes long, n_removed long, n_spans long, kept binary")


def op8_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
