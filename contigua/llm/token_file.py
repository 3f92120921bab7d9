"""Operator 1: token ids in binary shards with Elias-Fano document boundaries.

A shard file holds, one after another: the ids (2 or 4 bytes each, little-endian), the documents' ids (8 bytes each,
with a bit for null), the Elias-Fano parts of the n + 1 boundaries, and a footer (JSON, its length in the last 8
bytes). No table of 64-bit offsets is stored: boundary i is (select1(i) - i) << low_bits | low(i).
"""

from __future__ import annotations

import json
import uuid
import zlib
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens
from .common import shared_dir

MAGIC = "contigua-tokens-1"
SAMPLE = 64
#: Characters of a text by which rows of the same id are dealt; bytes of ids that a reader takes at once.
HEAD, SPAN = 64, 4 << 20
#: Ids that are worth a reading task of their own.
IDS_A_TASK = 4 << 20


@dataclass
class EliasFano:
    """A non-decreasing sequence of non-negative integers in about 2 + log2(universe / n) bits each."""

    n: int
    low_bits: int
    low: np.ndarray
    high: np.ndarray
    samples: np.ndarray

    @staticmethod
    def encode(values: np.ndarray) -> EliasFano:
        """values: int64, non-decreasing; may be empty or hold repeats."""
        n = len(values)
        top = int(values[-1]) + 1 if n else 1
        bits = max(0, (top // max(n, 1)).bit_length() - 1)
        low = values & ((1 << bits) - 1)
        packed = np.packbits(((low[:, None] >> np.arange(bits)) & 1).astype(np.uint8).ravel(), bitorder="little") if bits else np.zeros(0, np.uint8)
        ones = (values >> bits) + np.arange(n)
        unary = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        unary[ones] = 1
        return EliasFano(n, bits, packed, np.packbits(unary, bitorder="little"), ones[::SAMPLE].astype(np.uint32))

    def _ones(self, first: int, count: int) -> np.ndarray:
        """Places of the set bits number first to first + count - 1, found from the sample before them."""
        if not count:
            return np.zeros(0, np.int64)
        block = first // SAMPLE
        begin = int(self.samples[block]) // 8
        last = (first + count - 1) // SAMPLE + 1
        end = int(self.samples[last]) // 8 + 1 if last < len(self.samples) else len(self.high)
        found = np.flatnonzero(np.unpackbits(self.high[begin:end], bitorder="little")) + begin * 8
        skip = int(np.searchsorted(found, self.samples[block])) + first - block * SAMPLE
        return found[skip : skip + count]

    def slice(self, first: int, count: int) -> np.ndarray:
        """Values number first to first + count - 1; reads only the words that hold them."""
        high = self._ones(first, count) - np.arange(first, first + count)
        if not self.low_bits:
            return high
        start = first * self.low_bits
        raw = np.unpackbits(self.low[start // 8 : -(-(start + count * self.low_bits) // 8)], bitorder="little")
        raw = raw[start % 8 : start % 8 + count * self.low_bits].reshape(count, self.low_bits).astype(np.int64)
        return (high << self.low_bits) | (raw << np.arange(self.low_bits)).sum(axis=1)

    def select(self, i: int) -> int:
        return int(self.slice(i, 1)[0])


def write_shards(docs: DataFrame, tokenizer: str, out: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = tokens.END_ID) -> DataFrame:
    """Writes docs to shards under out (any address that pyarrow.fs takes, s3a as s3) in ascending id order; returns the manifest.

    Manifest: shard (its number, in order), path, n_docs, n_ids. An attempt of a task writes a file of its own name,
    and only a finished attempt has a row in the manifest: lost executors leave unread files, no wrong ones. Null ids
    come first, rows with the same id in the order of their texts; null text is an empty text: the end id alone. An
    empty table gives an empty manifest. Other columns are not read.
    """
    ordered = (
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        # The beginning of the text parts rows of one id, or of none, without their whole texts being sampled.
        .repartitionByRange(F.col("doc_id"), F.substring("text", 1, HEAD))
        .sortWithinPartitions("doc_id", "text")
    )

    def write(batches):
        encoder = tokens.load(tokenizer)
        shard = TaskContext.get().partitionId()
        where, root = _file_system(out)
        where.create_dir(root, recursive=True)
        path = f"{root}/shard-{shard:06d}-{uuid.uuid4().hex}.tok"
        doc_ids, ends, total = [], array("q", [0]), 0
        end = np.array([end_id], "<u4").tobytes()
        sink = None
        for batch in batches:
            if batch.num_rows and sink is None:
                sink = where.open_output_stream(path)
            doc_ids += batch.column(0).to_pylist()
            for text in batch.column(1):
                raw = encoder.ids(text.as_py()) + end
                total += len(raw) // 4
                ends.append(total)
                sink.write(np.frombuffer(raw, "<u4").astype("<u2").tobytes() if encoder.width == 2 else raw)
        if sink is None:
            return
        bounds = EliasFano.encode(np.frombuffer(ends, np.int64))
        ids = np.array([0 if d is None else d for d in doc_ids], "<i8")
        nulls = np.packbits(np.array([d is None for d in doc_ids], np.uint8), bitorder="little")
        parts, at = {}, total * encoder.width
        for name, part in (("doc_ids", ids), ("nulls", nulls), ("low", bounds.low), ("high", bounds.high), ("samples", bounds.samples.astype("<u4"))):
            raw = part.tobytes()
            sink.write(raw)
            parts[name] = [at, len(raw)]
            at += len(raw)
        footer = json.dumps({"magic": MAGIC, "width": encoder.width, "n_docs": len(ids), "n_ids": total, "low_bits": bounds.low_bits, "parts": parts}).encode()
        sink.write(footer + len(footer).to_bytes(8, "little"))
        sink.close()
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int64()), "path": [path], "n_docs": pa.array([len(ids)], pa.int64()), "n_ids": pa.array([total], pa.int64())})

    fields = "shard long, path string, n_docs long, n_ids long"
    # A row for each task comes to the driver, not a file for each: a file costs an executor processes of the system.
    return docs.sparkSession.createDataFrame(ordered.mapInArrow(write, fields).collect(), fields)


def _file_system(address: str) -> tuple[fs.FileSystem, str]:
    """The file system of an address and the path on it; Spark's names for a store are the store's."""
    for spark_name, name in (("s3a://", "s3://"), ("s3n://", "s3://"), ("wasbs://", "abfs://"), ("abfss://", "abfs://")):
        if address.startswith(spark_name):
            address = name + address[len(spark_name) :]
    return fs.FileSystem.from_uri(address)


class Shard:
    """One shard file, opened for reading by document number."""

    def __init__(self, out: str, path: str) -> None:
        where, _ = _file_system(out)
        self.file = where.open_input_file(path)
        size = self.file.size()
        length = int.from_bytes(self.file.read_at(8, size - 8), "little")
        head = json.loads(self.file.read_at(length, size - 8 - length))
        if head["magic"] != MAGIC:
            raise ValueError(f"{path} is no token shard")
        self.n_docs, self.n_ids, self.width = head["n_docs"], head["n_ids"], head["width"]
        part = lambda name, kind: np.frombuffer(self.file.read_at(head["parts"][name][1], head["parts"][name][0]), kind)
        self.doc_ids = part("doc_ids", "<i8")
        self.nulls = np.unpackbits(part("nulls", np.uint8), bitorder="little")[: self.n_docs].astype(bool)
        self.bounds = EliasFano(self.n_docs + 1, head["low_bits"], part("low", np.uint8), part("high", np.uint8), part("samples", "<u4"))

    def ids(self, first: int, count: int) -> np.ndarray:
        """Ids number first to first + count - 1 of the shard, as unsigned 32-bit integers."""
        raw = self.file.read_at(count * self.width, first * self.width)
        return np.frombuffer(raw, f"<u{self.width}").astype("<u4")

    def several(self, bounds: np.ndarray):
        """The ids of each document between consecutive bounds, read in spans of some megabytes; a longer one by itself."""
        i = 0
        while i + 1 < len(bounds):
            end = max(i + 1, int(np.searchsorted(bounds, bounds[i] + SPAN // self.width, side="right")) - 1)
            span = self.ids(int(bounds[i]), int(bounds[end] - bounds[i]))
            for k in range(i, end):
                yield span[int(bounds[k] - bounds[i]) : int(bounds[k + 1] - bounds[i])]
            i = end

    def document(self, i: int) -> np.ndarray:
        begin, end = self.bounds.slice(i, 2)
        return self.ids(int(begin), int(end - begin))


def read_shards(spark: SparkSession, manifest: DataFrame, out: str, *, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, shard[, ids]) of every document in the shards, in files' own order.

    start counts the ids of all documents before it, over all shards. The manifest (a row for each writing task) is
    all that the driver sees. Small shards share a reading task. ids are an array column, for users who want them back.
    """
    rows = sorted((r.shard, r.path, r.n_ids) for r in manifest.collect())
    placed, base = [], 0
    for shard, path, n_ids in rows:
        placed.append((shard, path, base))
        base += n_ids
    shards = spark.createDataFrame(placed, "shard long, path string, base long")
    if len(placed) > 1:
        tasks = max(spark.sparkContext.defaultParallelism, -(-base // IDS_A_TASK))
        # From one partition, so that they are dealt out evenly.
        shards = shards.coalesce(1).repartition(min(len(placed), tasks))

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(out, row["path"])
                for first in range(0, shard.n_docs, 4096):
                    count = min(4096, shard.n_docs - first)
                    bounds = shard.bounds.slice(first, count + 1)
                    step: list[list] = [[], []]
                    for ids in shard.several(bounds):
                        step[0].append(zlib.crc32(ids.tobytes()))
                        if with_ids:
                            step[1].append(ids)
                    named = {
                        "doc_id": pa.array(shard.doc_ids[first : first + count], pa.int64(), mask=shard.nulls[first : first + count]),
                        "start": pa.array(bounds[:-1] + row["base"], pa.int64()),
                        "n_tokens": pa.array(np.diff(bounds), pa.int64()),
                        "ids_crc32": pa.array(step[0], pa.int64()),
                        "shard": pa.array([row["shard"]] * count, pa.int64()),
                    }
                    if with_ids:
                        named["ids"] = pa.array(step[1], pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_pydict(named)

    return shards.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, shard long" + ", ids array<long>" * with_ids)


def token_round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Writes docs to shards in the shared folder and reads them back."""
    spark = docs.sparkSession
    out = shared_dir(spark, "tokens")
    return read_shards(spark, write_shards(docs, tokenizer, out), out)
