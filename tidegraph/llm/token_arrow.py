"""Token ids as Arrow files of equal-length sequences.

``write_tokens`` range-partitions documents by id, encodes each range in id order and writes it as one
Arrow IPC file (a shard): record batches of ``fixed_size_list[length]`` of tokens (uint16
where all ids fit, else uint32) and of masks (bits). Only a shard's last sequence is padded (mask 0). The index
table says for each document its shard, the offset in it and its length, so a reader maps a shard and
slices any sequence or document without copying or decoding.

A shard is written under a temporary name and renamed, so a task that is run again replaces it whole.
Memory is one Arrow batch of texts and ``per_batch`` sequences.

Defined results: strings of special tokens inside a text give those tokens, as the library's plain call does
(``specials_as_text`` makes them ordinary text); null text gives the end id alone; null ids come first; rows that share an id stand in
order of a hash of their text; an empty table gives shards without sequences and an empty index.
"""

from __future__ import annotations

import os
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import filesystem, local_path, shared_dir, tidy, written
from .rolling import text_chunks
from .units import Units

_known: dict[tuple[str, bool], Units] = {}


def units_of(path: str, specials_as_text: bool = False) -> Units:
    """The worker's encoder of a tokenizers file: strings of special tokens give their ids, as the library
    does by itself, or are ordinary text."""
    key = (path, specials_as_text)
    if key not in _known:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; the library's threads would spin
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = specials_as_text
        added = [x.content.encode() for x in t.get_added_tokens_decoder().values() if not (specials_as_text and x.special)]

        def many(units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
            ids = [e.ids for e in t.encode_batch_fast([u.decode("utf-8", "surrogatepass") for u in units], add_special_tokens=False)]
            return np.fromiter(chain.from_iterable(ids), np.uint32), np.fromiter(map(len, ids), np.int64, len(ids))

        _known[key] = Units(many, whole=tuple(added))
    return _known[key]


def shard_schema(length: int, kind: type) -> pa.Schema:
    return pa.schema([("tokens", pa.list_(pa.from_numpy_dtype(kind), length)), ("mask", pa.list_(pa.bool_(), length))])


def id_type(tokenizer: str) -> type:
    """The smallest of uint16 and uint32 that holds all ids of a tokenizers file."""
    from tokenizers import Tokenizer

    return np.uint16 if Tokenizer.from_file(tokenizer).get_vocab_size() <= 1 << 16 else np.uint32


class ShardWriter:
    """Streams ids into one file; ``close`` pads, ends the file and gives it its name."""

    def __init__(self, uri: str, length: int, per_batch: int, kind: type):
        self.where, self.path = filesystem(uri)
        self.where.create_dir(self.path.rpartition("/")[0], recursive=True)
        task = TaskContext.get()
        self.part = f"{self.path}.{task.taskAttemptId() if task else 0}.tmp"
        self.length, self.size, self.held, self.n_held, self.total = length, length * per_batch, [], 0, 0
        self.kind, self.file_schema = kind, shard_schema(length, kind)
        self.out = self.where.open_output_stream(self.part)
        self.file = pa.ipc.new_file(self.out, self.file_schema)

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids.astype(self.kind))
        self.n_held += len(ids)
        self.total += len(ids)
        if self.n_held >= self.size:
            whole = np.concatenate(self.held)
            at = 0
            while len(whole) - at >= self.size:
                self._batch(whole[at : at + self.size], self.size)
                at += self.size
            self.held, self.n_held = [whole[at:]], len(whole) - at

    def _batch(self, ids: np.ndarray, n: int) -> None:
        mask = np.zeros(len(ids), bool)
        mask[:n] = True
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, mask)]
        self.file.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.file_schema))

    def close(self) -> None:
        if self.n_held:
            whole = np.concatenate(self.held)
            padded = np.zeros(-(-len(whole) // self.length) * self.length, self.kind)
            padded[: len(whole)] = whole
            self._batch(padded, len(whole))
        self.file.close()
        self.out.close()
        self.where.move(self.part, self.path)


class ShardReader:
    """Random access to a shard's ids: a view of the mapped file where it is on this machine."""

    def __init__(self, uri: str):
        local = local_path(uri)
        where, path = filesystem(uri)
        self.file = pa.ipc.open_file(pa.memory_map(local) if local else where.open_input_file(path))
        self.length = self.file.schema.field("tokens").type.list_size
        self.n = self.file.num_record_batches
        self.size = self.file.get_batch(0).num_rows * self.length if self.n else 1
        self.at, self.values = -1, None

    def batch(self, k: int) -> np.ndarray:
        if k != self.at:
            b = self.file.get_batch(k)
            ids = b.column(0).flatten().to_numpy()
            n = len(ids) if k < self.n - 1 else b.column(1).flatten().true_count
            self.at, self.values = k, ids[:n]
        return self.values

    def slice(self, start: int, n: int) -> np.ndarray:
        """Ids ``start`` to ``start + n`` of the shard."""
        parts, k, at = [], start // self.size, start % self.size
        while n > 0:
            part = self.batch(k)[at : at + n]
            if not len(part):
                raise ValueError("the shard ends before the document does")
            parts.append(part)
            n -= len(part)
            k, at = k + 1, 0
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, self.values.dtype if self.values is not None else np.uint32)


def shard_uri(folder: str, k: int) -> str:
    return f"{folder}/shard-{k:06d}.arrow"


def shards_of(docs: DataFrame, text_col: str, shard_bytes: int) -> int:
    """Files of about ``shard_bytes`` of text each, one at least."""
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return max(1, -(-size // shard_bytes))


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, length: int = 2048, per_batch: int = 64, shards: int | None = None, shard_bytes: int = 1 << 28, specials_as_text: bool = False) -> DataFrame:
    """Writes the shards into ``folder`` (a URI all executors see); returns the index as a written table.

    Without ``shards`` there is one for each ``shard_bytes`` of text, or one for each shuffle partition if that is more.
    """
    spark = docs.sparkSession
    shards = shards or max(int(spark.conf.get("spark.sql.shuffle.partitions")), shards_of(docs, text_col, shard_bytes))
    kind = id_type(tokenizer)
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("shard", T.IntegerType()), T.StructField("at", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def run(batches):
        k = TaskContext.get().partitionId()
        out = ShardWriter(shard_uri(folder, k), length, per_batch, kind)
        encoder = units_of(tokenizer, specials_as_text)
        for b in batches:
            for row, data, offsets in text_chunks(b.column(1), 1 << 22):
                flat, at = encoder.encode(data, offsets, end=end_id)
                starts, sizes = out.total + at[:-1], np.diff(at)
                out.add(flat)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(row, len(sizes)), pa.array([k] * len(sizes), pa.int32()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64())], names=schema.fieldNames())
        out.close()

    ranged = docs.select(id_col, F.col(text_col).alias("_text")).repartitionByRange(shards, id_col, F.xxhash64("_text")).sortWithinPartitions(id_col, F.xxhash64("_text"))
    return written(ranged.mapInArrow(tidy(run), schema), "token-index")


def read_documents(index: DataFrame, folder: str, id_col: str = "doc_id") -> DataFrame:
    """Each document's ids from the shards: its place among all ids, their number and checksum.

    The driver adds up one number for each shard; texts and ids stay on the executors.
    """
    spark = index.sparkSession
    totals = sorted((r.shard, r.n) for r in index.groupBy("shard").agg(F.sum("n_tokens").alias("n")).collect())
    bases, total = [], 0
    for k, n in totals:
        bases.append((k, total))
        total += n
    schema = T.StructType([*index.schema.fields, T.StructField("ids_crc32", T.LongType())])

    def run(batches):
        at, reader = -1, None
        for b in batches:
            sums = []
            for k, start, n in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                if k != at:
                    at, reader = k, ShardReader(shard_uri(folder, k))
                sums.append(zlib.crc32(np.ascontiguousarray(reader.slice(start, n), "<u4")))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sums, pa.int64())], names=schema.fieldNames())

    base = spark.createDataFrame(bases, "shard int, base long")
    return index.mapInArrow(tidy(run), schema).join(F.broadcast(base), "shard").select(id_col, (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", "shard")


def op3_token_arrow(spark, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = shared_dir(spark, "token-shards")
    index = write_tokens(docs, folder, tokenizer or public_tokenizers.path("byte_bpe_50k.json"))
    return read_documents(index, folder)
