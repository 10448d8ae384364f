"""Byte-level BPE encoding and decoding by replaying merges over a corpus of words.

The distinct new words of a block of documents lie end to end in flat arrays. An inverted index leads from
a token pair to the word positions where it stands; pairs are taken in order of their merge's rank from a
heap, and each merge touches only its two neighbours, whose new pairs enter the index. A pair of a lower
rank that a merge brings about goes first in its word, and pairs that make the same token go from left to
right, as in a word-by-word encoder. Words met before are remembered within a bound, so a task replays each
new word once; blocks are bounded, and nothing is shuffled or collected.

Defined results: null text is empty and has no ids; repeated rows are encoded alike; extra columns stay.
"""

from __future__ import annotations

import base64
import hashlib
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, tidy
from .rolling import text_chunks
from .units import Units

_BLANK = r"\t-\r \x85\xa0  -     　"


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class MergeReplay:
    """Replays the merges of ``ranks``; a position is an index into the words of a corpus laid end to end."""

    MANY = 16  # pairs at fewer places are merged one by one

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {v: k for k, v in ranks.items()}
        self.single = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        self.pair: dict[int, int] = {}

    def rank(self, key: int) -> int:
        """The rank of the merge of a pair (first << 32 | second), -1 if there is none."""
        got = self.pair.get(key)
        if got is None:
            if len(self.pair) > 300_000:
                self.pair.clear()
            got = self.pair[key] = self.ranks.get(self.token[key >> 32] + self.token[key & 0xFFFFFFFF], -1)
        return got

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words end to end, and each one's first. A word that is itself a token is that token."""
        whole = [self.ranks.get(w, -1) for w in words]
        n_of = np.array([len(w) if r < 0 else 1 for w, r in zip(words, whole, strict=True)], np.int64)
        raw = np.frombuffer(b"\0".join([w if r < 0 else b"\0" for w, r in zip(words, whole, strict=True)]), np.uint8)
        first = np.concatenate([[0], np.cumsum(n_of + 1)])[:-1] + 1  # a -1 stands before each word and after the last
        n = len(raw) + 2
        sym = np.full(n, -1, np.int64)
        sym[1:-1] = self.single[raw]
        sym[first[1:] - 1] = -1
        known = np.flatnonzero(np.array(whole, np.int64) >= 0)
        sym[first[known]] = np.array(whole, np.int64)[known]
        word = np.repeat(np.arange(len(words) + 1), np.diff(np.concatenate([[0], first - 1, [n]])))
        if len(words):
            self._replay(sym, word)
        out = np.flatnonzero(sym >= 0)
        return sym[out].astype(np.uint32), np.searchsorted(out, first)

    def _replay(self, sym: np.ndarray, word: np.ndarray) -> None:
        """Merges in place: a merged pair is its token at the first place and -2 at the second."""
        n = len(sym)
        nxt, prv = np.arange(1, n + 1), np.arange(-1, n - 1)
        at_sym, at_nxt, at_prv, at_word = map(memoryview, (sym, nxt, prv, word))
        index: dict[int, np.ndarray | list[int]] = {}  # from a pair to the places where it stands or stood
        heap: list[tuple[int, int]] = []  # (rank, pair) of the pairs in the index
        rank = self.rank

        def post(keys: np.ndarray, places: np.ndarray) -> None:
            """The pairs ``keys`` now stand at ``places``."""
            if not len(keys):
                return
            order = np.argsort(keys, kind="stable")
            keys, places = keys[order], places[order]
            cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
            cuts = [0, *cuts.tolist(), len(keys)]
            there = places.tolist()
            for key, i, j in zip(keys[cuts[:-1]].tolist(), cuts, cuts[1:], strict=False):
                if key in index:
                    index[key] += there[i:j]
                elif (r := rank(key)) >= 0:
                    index[key] = there[i:j]
                    heappush(heap, (r, key))

        def post_one(a: int, b: int, p: int) -> int:
            """The pair (a, b) now stands at p: its rank."""
            if a < 0 or b < 0:
                return -1
            key = a << 32 | b
            at, r = index.get(key), rank(key)
            if at is not None:
                at.append(p)
            elif r >= 0:
                index[key] = [p]
                heappush(heap, (r, key))
            return r

        def merge_each(r: int, places: list[tuple[int, int]]) -> None:
            """Places of one or more words in order, each with the pair that makes token r."""
            waiting: set[int] = set()
            for p, key in places:
                q = at_nxt[p]
                if at_sym[p] != key >> 32 or q >= n or at_sym[q] != key & 0xFFFFFFFF:
                    continue  # a neighbour's merge took it
                if waiting and at_word[p] in waiting:
                    post_one(at_sym[p], at_sym[q], p)
                    continue
                at_sym[p], at_sym[q] = r, -2
                after, before = at_nxt[q], at_prv[p]
                at_nxt[p], at_prv[after] = after, p
                if 0 <= post_one(r, at_sym[after], p) < r:
                    waiting.add(at_word[p])
                if 0 <= post_one(at_sym[before], r, before) < r:
                    waiting.add(at_word[p])

        solid = np.flatnonzero((sym[:-1] >= 0) & (sym[1:] >= 0))
        post(sym[solid] << 32 | sym[solid + 1], solid)
        while heap:
            r, key = heappop(heap)
            places = index.pop(key)
            if (heap and heap[0][0] == r) or len(places) < self.MANY:
                pairs = [(p, key) for p in places]
                while heap and heap[0][0] == r:  # other pairs make the same token: the leftmost goes first
                    other = heappop(heap)[1]
                    pairs += [(p, other) for p in index.pop(other)]
                pairs.sort()
                merge_each(r, pairs)
                continue
            p = np.unique(places)
            q = nxt[p]
            good = sym[p] == key >> 32
            good[good] = sym[q[good]] == key & 0xFFFFFFFF
            p, q, w = p[good], q[good], word[p[good]]
            twice = np.zeros(len(p), bool)
            twice[1:] = w[1:] == w[:-1]
            twice[:-1] |= twice[1:]
            if twice.any():  # several places in a word: one after the other
                later = [(x, key) for x in p[twice].tolist()]
                p, q = p[~twice], q[~twice]
            else:
                later = []
            sym[p], sym[q] = r, -2
            after, before = nxt[q], prv[p]
            nxt[p], prv[after] = after, p
            a, b = sym[before], sym[after]
            left, right = a >= 0, b >= 0
            post(np.concatenate([a[left] << 32 | r, r << 32 | b[right]]), np.concatenate([before[left], p[right]]))
            if later:
                merge_each(r, later)


class Codec:
    """Encodes and decodes texts; remembers units within a bound."""

    def __init__(self, ranks_path: str, pattern: str, limit: int = 1 << 20):
        self.replay = MergeReplay(load_ranks(ranks_path))
        inside = pattern.replace(r"[^\s", rf"[^{_BLANK}").replace(r"\S", f"[^{_BLANK}]").replace(r"\s", f"[{_BLANK}]")
        self.find = regex.compile(inside).findall
        self.units = Units(self._units, limit)
        size = max(self.replay.token) + 1
        self.bytes_of = [self.replay.token.get(i, b"") for i in range(size)]

    def _units(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units that are not remembered: their distinct words are the corpus of one replay."""
        number: dict[str, int] = {}
        put = number.setdefault
        words, count = [], []
        for u in units:
            found = self.find(u.decode("utf-8", "surrogatepass"))
            words += [put(w, len(number)) for w in found]
            count.append(len(found))
        ids, first = self.replay.encode_words([w.encode("utf-8", "surrogatepass") for w in number])
        size = np.diff(np.append(first, len(ids)))
        many = size[words]
        stop = np.cumsum(many)
        flat = ids[np.repeat(first[words] - (stop - many), many) + np.arange(int(stop[-1]) if len(stop) else 0)]
        ends = np.concatenate([[0], stop])[np.concatenate([[0], np.cumsum(count)]).astype(np.int64)]
        return flat, np.diff(ends)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts between ``offsets`` of UTF-8 ``data``, end to end, and each text's place among them."""
        return self.units.encode(data, offsets)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))


_codecs: dict[tuple[str, str, int], Codec] = {}


def codec(ranks_path: str, pattern: str, limit: int = 1 << 20) -> Codec:
    key = (ranks_path, pattern, limit)
    if key not in _codecs:
        _codecs[key] = Codec(*key)
    return _codecs[key]


def encode(docs: DataFrame, ranks_path: str, pattern: str, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", with_ids: bool = True, limit: int = 1 << 20, chunk: int = 1 << 22) -> DataFrame:
    """``keep`` columns and, of every whole text, n_tokens, ids_sha256 and decoded_sha256 (digests of the
    little-endian 32-bit ids and of the bytes that they decode to), and ``ids`` (binary) if asked for. A worker remembers up to ``limit`` units and has ``chunk`` bytes of
    text, or one text, in hand."""
    schema = docs.select(*keep).schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    schema = schema.add("ids", "binary") if with_ids else schema

    def run(batches):
        c = codec(ranks_path, pattern, limit)
        for b in batches:
            for row, data, offsets in text_chunks(b.column(0), chunk):
                flat, at = c.encode(data, offsets)
                ids = [flat[i:j] for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                digests = [[hashlib.sha256(f(x)).hexdigest() for x in ids] for f in (np.ndarray.tobytes, c.decode)]
                cols = [*(x.slice(row, len(ids)) for x in b.columns[1:]), pa.array(np.diff(at)), *(pa.array(d, pa.string()) for d in digests)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array([x.tobytes() for x in ids], pa.binary())] if with_ids else cols, names=schema.fieldNames())

    return docs.select(F.col(text_col).alias("_text_of_ids"), *keep).mapInArrow(tidy(run), schema)


def op7_bpe_replay(spark, sf_dir: str, ranks_path: str | None = None) -> DataFrame:
    import public_tokenizers as P

    where = ranks_path or P.path("byte_bpe_multi_50k.tiktoken")
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), where, P.PATTERN, with_ids=False)


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: each kept document's ids, with number and digests. Workers come from other stages
    and remember less here and take fewer texts at once, to leave room for what those have loaded."""
    small_batches(spark)
    import public_tokenizers as P

    return encode(docs, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN, keep=("doc_id", "lang", "source", "n_chars"), limit=1 << 18, chunk=1 << 20)
