"""What several operators share: the shared folder, cut lineage, key-aligned batches, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir, which all executors reach; unset, a temporary one, in local mode alone."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}/contigua-shared"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Rows of a few numbers that are worth a file of their own.
ROWS_A_FILE = 20_000


def materialise(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """df, written as Parquet to the shared folder and read again: lineage is cut and lost executors cost nothing.

    rows says that no more than so many rows of some numbers come: they go to as few files as that asks for, instead of
    one for each shuffle partition.
    """
    spark = df.sparkSession
    path = shared_dir(spark, name)
    (df if rows is None else df.coalesce(max(1, -(-rows // ROWS_A_FILE)))).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_mod(col: str, modulus: int):
    """crc32 of the id as text, modulo modulus; null ids count as an empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % modulus


def empty_if_null(col: str):
    return F.coalesce(F.col(col), F.lit(""))


def aligned(batches: Iterator[pa.RecordBatch], key: str, at_least: int = 200_000) -> Iterator[pa.Table]:
    """Tables of whole groups from batches that are sorted by key; holds at_least rows and one group at most."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < at_least:
            continue
        table = pa.Table.from_batches(held)
        keys = table.column(key).to_numpy()
        cut = int(np.searchsorted(keys, keys[-1], side="left"))
        if cut:
            yield table.slice(0, cut)
            rest = table.slice(cut)
            held, rows = rest.to_batches(), rest.num_rows
    if held:
        yield pa.Table.from_batches(held)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node that the edges reach, for each node that has an edge.

    Contraction: each round maps every node to its best neighbour (itself included) and rewrites the edges, so that
    stars vanish in one round and any other shape shrinks by a constant factor. The order is by id in even rounds
    (the stars that the callers send point to their smallest member) and by a hash that changes in odd ones (a long
    chain in id order can't last). Everything is a minimum with partial sums or a join that Spark may split; each
    round is written to the shared folder. Null ends and loops are ignored; no edges give no rows.
    """
    spark = edges.sparkSession
    live = (
        edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b"))
        .where("a <> b")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )
    live = materialise(live, "cc-edges")
    maps: list[DataFrame] = []
    round_no = 0
    while n := live.count():
        rank = (lambda c: F.col(c)) if round_no % 2 == 0 else (lambda c, r=round_no: F.xxhash64(F.col(c), F.lit(r)))
        both = live.select(F.col("a").alias("v"), F.col("b").alias("u")).union(live.select(F.col("b").alias("v"), F.col("a").alias("u")))
        ranked = both.select("v", F.struct(rank("u").alias("r"), F.col("u").alias("u")).alias("x"))
        best = ranked.groupBy("v").agg(F.min("x").alias("x")).select("v", F.least("x", F.struct(rank("v").alias("r"), F.col("v").alias("u")))["u"].alias("to"))
        best = materialise(best, "cc-map", 2 * n)
        maps.append(best)
        moved = (
            live.join(best.select(F.col("v").alias("a"), F.col("to").alias("to_a")), "a")
            .join(best.select(F.col("v").alias("b"), F.col("to").alias("to_b")), "b")
            .where("to_a <> to_b")
            .select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b"))
        )
        live = materialise(moved.distinct(), "cc-edges", n)
        round_no += 1
    if not maps:
        return spark.createDataFrame([], T.StructType([T.StructField("node", T.LongType()), T.StructField("component", T.LongType())]))
    # Later maps are smaller: compose from the last one back, then name each component by its smallest node.
    nodes = maps[0].count()
    total = maps[-1].select(F.col("v").alias("m"), F.col("to").alias("root"))
    for best in reversed(maps[:-1]):
        total = best.join(total, F.col("to") == F.col("m"), "left").select(F.col("v").alias("m"), F.coalesce("root", "to").alias("root"))
    if len(maps) > 1:
        total = materialise(total, "cc-total", nodes)
    # Written, so that the join has a plain exchange on either side: Spark can then split the partition of a giant root.
    smallest = materialise(total.groupBy("root").agg(F.min("m").alias("least")), "cc-smallest", nodes)
    # A root that never moved is no row of the map of the round that made it a root, but its own first row has it.
    return total.join(smallest, "root").select(F.col("m").alias("node"), F.least("least", "root").alias("component"))
