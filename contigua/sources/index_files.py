"""Index files of one piece: the order of the reads (.sai, text) and the run-length encoded transform (.bwt, binary)."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dna
from .text import numbered_lines

#: Fixed values of the formats: the first number of both, the header's layout, bits of a run's length.
MAGIC = 0xCACA
BWT_HEADER = "<HQQQi"
COUNT_BITS = 5


def _streamed(spark: SparkSession, blobs: DataFrame, path: str, head: bytes) -> None:
    """Writes head, then the blobs in the order of their table, to one file: a partition at a time passes the driver."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(head))
        for row in blobs.toLocalIterator():
            out.write(bytearray(row.blob))
    finally:
        out.close()


def _blobs(df: DataFrame, order: list[str], encode) -> DataFrame:
    """(blob) of df in order: encode makes one of each batch."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_pydict({"blob": pa.array([encode(batch)], pa.binary())})

    return df.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, "blob binary")


def write_sai(ranks: DataFrame, path: str) -> None:
    """(read_idx, rank) of whole reads as text: the magic, how many twice, then a line "read_idx 0" for each in order."""
    n = ranks.count()
    rows = _blobs(ranks.select("rank", "read_idx"), ["rank"], lambda b: "".join(f"{i} 0\n" for i in b.column(1).to_pylist()).encode())
    _streamed(ranks.sparkSession, rows, path, f"{MAGIC}\n{n}\n{n}\n".encode())


def read_sai(spark: SparkSession, path: str) -> DataFrame:
    """(read_idx, pos, rank) of the entries of a file, in their order; refuses any other file."""
    lines = numbered_lines(spark, path)
    head = [r.value for r in lines.where("line_no < 3").orderBy("line_no").collect()]
    if len(head) < 3 or head[0] != str(MAGIC):
        raise ValueError(f"{path} is no index of reads")
    parts = F.split("value", " ")
    return lines.where("line_no >= 3").select(parts[0].cast("long").alias("read_idx"), parts[1].cast("int").alias("pos"), (F.col("line_no") - 3).alias("rank"))


def write_bwt(runs: DataFrame, n_reads: int, path: str) -> None:
    """runs (run_idx, part, symbol, len): a header, then a byte for each run, symbol above length."""
    sums = runs.agg(F.coalesce(F.sum("len"), F.lit(0)).alias("n"), F.count("*").alias("runs")).first()

    def encode(batch: pa.RecordBatch) -> bytes:
        symbol = np.array([dna.ALPHABET.index(s) for s in batch.column(2).to_pylist()], np.uint8)
        return (symbol << COUNT_BITS | batch.column(3).to_numpy().astype(np.uint8)).tobytes()

    rows = _blobs(runs.select("run_idx", "part", "symbol", "len"), ["run_idx", "part"], encode)
    _streamed(runs.sparkSession, rows, path, struct.pack(BWT_HEADER, MAGIC, n_reads, sums.n, sums.runs, 0))


def read_bwt(spark: SparkSession, path: str) -> tuple[int, int, DataFrame]:
    """(reads, symbols, runs (run_no, symbol, len)) of a file below 2 GB; refuses any other file."""
    files = spark.read.format("binaryFile").load(path)
    size = struct.calcsize(BWT_HEADER)
    head = bytes(files.select(F.substring("content", 1, size).alias("h")).first().h)
    if len(head) < size or struct.unpack(BWT_HEADER, head)[0] != MAGIC:
        raise ValueError(f"{path} is no transform")
    _, n_reads, n, n_runs, _ = struct.unpack(BWT_HEADER, head)
    letters = np.array(list(dna.ALPHABET))

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for content in batch.column(0):
                raw = np.frombuffer(content.as_buffer(), np.uint8, n_runs, size)
                for at in range(0, len(raw), 1 << 16):
                    part = raw[at : at + (1 << 16)]
                    yield pa.RecordBatch.from_pydict({"run_no": pa.array(at + np.arange(len(part))), "symbol": pa.array(letters[part >> COUNT_BITS]), "len": pa.array((part & ((1 << COUNT_BITS) - 1)).astype(np.int32))})

    return n_reads, n, files.select("content").mapInArrow(run, "run_no long, symbol string, len int")
