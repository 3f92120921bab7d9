"""Operator 10: near-duplicate vectors by iterative quantisation and multi-index Hamming tables.

A rotation learned on a bounded sample turns unit vectors into balanced binary codes. Substrings of the code are the
keys of tables: as long as log2 of the number of vectors, so that a bucket holds few by chance whatever the input, and as
many as it takes to let simulated pairs at the threshold meet. A vector is filed under its substring and under those with
one of its least certain bits flipped, so two vectors meet if a substring differs in no bit, one or two of them. In the
buckets, pairs with close codes are rescored with the original vectors in double precision.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import aligned, components, materialise
from .simhash import _join_sets, dealt

THRESHOLD = 0.9
SAMPLE = 20_000
ROUNDS = 50
BITS, PROBES = 64, 4
#: Substrings have CROWD bits less than the number of vectors, so that a bucket holds some 2 ** CROWD of them, but some at least.
SHORTEST_PART, LONGEST_PART, CROWD, MAX_TABLES = 16, 40, 9, 64
#: As many tables are taken as let this share of simulated pairs at the threshold meet; codes further apart than all but
#: this share of such pairs aren't rescored.
MEETING, FURTHER = 0.97, 0.002
#: A bucket holds at most so many rows, or is dealt in blocks; a fixed size, whatever the input.
HOT_ROWS, BLOCK = 4096, 2048


def _rotated(v: np.ndarray, seed: int, rounds: int) -> np.ndarray:
    """The rotation of the columns of v with the least quantisation error: signs and Procrustes by turns (ITQ)."""
    rotation, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((v.shape[1], v.shape[1])))
    for _ in range(rounds):
        u, _, w = np.linalg.svd(np.where(v @ rotation >= 0, 1.0, -1.0).T @ v)
        rotation = (u @ w).T
    return rotation


def _pairs_at(x: np.ndarray, cosine: float) -> np.ndarray:
    """For each unit vector another at that cosine, in a random direction."""
    if x.shape[1] < 2:
        return x.copy()
    across = np.random.default_rng(17).standard_normal(x.shape)
    across -= (across * x).sum(axis=1, keepdims=True) * x
    across /= np.maximum(np.linalg.norm(across, axis=1, keepdims=True), 1e-12)
    return cosine * x + np.sqrt(1 - cosine**2) * across


@dataclass(frozen=True)
class Codes:
    """mean and projection (dimensions, BITS) of the codes; substrings of width bits begin at offsets of the ring of bits."""

    mean: np.ndarray
    projection: np.ndarray
    width: int
    offsets: tuple[int, ...]
    far: int

    @staticmethod
    def fit(x: np.ndarray, n: int | None = None, threshold: float = THRESHOLD, rounds: int = ROUNDS) -> Codes:
        """From a sample x of the n unit vectors: principal axes, a learned rotation, and tables for the threshold.

        With fewer dimensions than bits several rotations, from starts of their own, stand side by side.
        """
        mean = x.mean(axis=0)
        centred = x - mean
        _, axes = np.linalg.eigh(centred.T @ centred)
        axes = axes[:, ::-1][:, : min(BITS, x.shape[1])]
        v = centred @ axes
        several = -(-BITS // v.shape[1])
        turned = np.concatenate([axes @ _rotated(v, 11 + k, rounds if k < 8 else 1) for k in range(several)], axis=1)[:, :BITS]
        width = min(LONGEST_PART, max(SHORTEST_PART, int(n or len(x)).bit_length() - CROWD))
        some = x[: min(len(x), 4000)]
        plain = Codes(mean, turned, width, (0,), BITS)
        a, b = plain.encode(some), plain.encode(_pairs_at(some, threshold))
        apart = np.sort(np.bitwise_count(a ^ b))
        far = int(apart[int((1 - FURTHER) * (len(apart) - 1))])
        at = 4
        while True:
            tables = tuple(round(t * BITS / at) for t in range(at))
            found = Codes(mean, turned, width, tables, far)
            ma, mb = found.mask(some), found.mask(_pairs_at(some, threshold))
            if at >= MAX_TABLES or (found.first_key(a, ma, b, mb) >= 0).mean() >= MEETING:
                return found
            at += 2

    def values(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.projection

    def encode(self, x: np.ndarray) -> np.ndarray:
        """Codes as uint64."""
        return np.packbits(self.values(x) >= 0, axis=1, bitorder="little").view("<u8").astype(np.uint64).ravel()

    def mask(self, x: np.ndarray) -> np.ndarray:
        """(n, tables) as uint64: the PROBES least certain bits of each substring, by their place in it."""
        size = np.abs(self.values(x))
        out = np.zeros((len(x), len(self.offsets)), np.uint64)
        for t, offset in enumerate(self.offsets):
            part = size[:, (offset + np.arange(self.width)) % BITS]
            least = np.argpartition(part, PROBES, axis=1)[:, :PROBES].astype(np.uint64)
            out[:, t] = np.bitwise_or.reduce(np.uint64(1) << least, axis=1)
        return out

    def part(self, x: np.ndarray, t: int) -> np.ndarray:
        """Substring t: bits from its offset on, round the ring."""
        at = self.offsets[t]
        turned = (x >> np.uint64(at)) | (x << np.uint64(BITS - at)) if at else x
        return turned & np.uint64((1 << self.width) - 1)

    def keys(self, code: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(key, row) of all that each row is filed under; a key is table << LONGEST_PART | substring."""
        rows = np.arange(len(code))
        keys, own = [], []
        for t in range(len(self.offsets)):
            part, left, table = self.part(code, t), mask[:, t].copy(), np.uint64(t << LONGEST_PART)
            keys.append(part | table)
            own.append(rows)
            for _ in range(PROBES):
                bit = left & (~left + np.uint64(1))
                left ^= bit
                keys.append((part ^ bit) | table)
                own.append(rows)
        return np.concatenate(keys).astype(np.int64), np.concatenate(own)

    def first_key(self, code_a, mask_a, code_b, mask_b) -> np.ndarray:
        """One key of the first table in which both of a pair are filed under a common one; -1 if there is none.

        It is the substring itself where they are equal there, else the least common key: any task that holds both
        finds the same, so a pair counts once.
        """
        none = np.int64(1) << np.int64(62)
        out = np.full(len(code_a), -1, np.int64)
        for t in range(len(self.offsets)):
            a, b, fa, fb = self.part(code_a, t), self.part(code_b, t), mask_a[:, t], mask_b[:, t]
            d = a ^ b
            low = d & (~d + np.uint64(1))
            high = d ^ low
            count = np.bitwise_count(d)
            found = np.full(len(d), none)
            take = lambda cond, key, found: np.where(cond, np.minimum(found, key.astype(np.int64)), found)
            found = take(count == 0, a, found)
            one = count == 1
            found = take(one & (d & fb != 0), a, found)
            found = take(one & (d & fa != 0), b, found)
            two = count == 2
            found = take(two & (low & fa != 0) & (high & fb != 0), a ^ low, found)
            found = take(two & (high & fa != 0) & (low & fb != 0), a ^ high, found)
            fresh = (out < 0) & (found != none)
            out = np.where(fresh, (np.int64(t) << np.int64(LONGEST_PART)) | found, out)
        return out


def _given(column: pa.Array) -> np.ndarray:
    """The vectors of a list column whose lists are of one length, as they were given."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    """Unit vectors in double precision."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def bucket_links(codes: Codes, table: pa.Table, threshold: float, kind: np.dtype) -> pa.RecordBatch | None:
    """Partial link counts and sets of a table sorted by bucket: (cid, links, root) of each row's class that has a link."""
    bucket, key, cid, n, block, pair = (table.column(c).to_numpy() for c in ("bucket", "key", "cid", "n", "block", "pair"))
    raw = table.column("vector").combine_chunks()
    x = _unit(np.frombuffer(b"".join(raw.to_pylist()), kind).reshape(len(key), -1))
    code = table.column("code").to_numpy().view(np.uint64)
    mask = np.frombuffer(b"".join(table.column("mask").to_pylist()), np.uint64).reshape(len(key), -1)
    own, at = np.unique(cid, return_inverse=True)
    parent, links = np.arange(len(own)), np.zeros(len(own))
    first = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
    left = np.repeat(np.append(first[1:], len(key)), np.diff(np.append(first, len(key)))) - np.arange(len(key))
    # Of a pair of different blocks only pairs across them count: either block has a task of its own.
    high = ((np.sqrt(8.0 * np.maximum(pair - 1, 0) + 1) - 1) // 2).astype(np.int64)
    across = (pair > 0) & (np.maximum(pair - 1, 0) - high * (high + 1) // 2 != high)
    rows, step = np.flatnonzero(left > 1), 1
    while len(rows):
        for k in range(0, len(rows), 65536):
            i = rows[k : k + 65536]
            j = i + step
            close = np.bitwise_count(code[i] ^ code[j]) <= codes.far
            close &= ~across[i] | (block[i] != block[j])
            i, j = i[close], j[close]
            hit = np.einsum("ij,ij->i", x[i], x[j]) >= threshold
            i, j = i[hit], j[hit]
            if not len(i):
                continue
            once = codes.first_key(code[i], mask[i], code[j], mask[j]) == key[i]
            i, j = i[once], j[once]
            links += np.bincount(at[i], weights=n[j], minlength=len(own)) + np.bincount(at[j], weights=n[i], minlength=len(own))
            _join_sets(parent, at[i], at[j])
        step += 1
        rows = rows[left[rows] > step]
    some = links > 0
    if not some.any():
        return None
    return pa.RecordBatch.from_pydict({"cid": own[some], "links": links[some].astype(np.int64), "root": own[parent[some]]})


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, *, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row.

    Null, empty and zero vectors and those with null or non-finite components link with nothing, nor do vectors of
    different lengths; those of each length have an index of their own. Equal vectors are one class with a weight, so
    copies are counted without being paired. A row without id counts as a link of others; its component is the smallest id that
    links reach, null if there is none, and it is kept only where that is null. An empty table gives no rows.
    """
    floats = vectors.schema[vector_col].dataType.simpleString() == "array<float>"
    kind = np.dtype(np.float32 if floats else np.float64)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<float>" if floats else "array<double>").alias("v"))
    finite = F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    good = (F.size("v") > 0) & F.coalesce(finite, F.lit(False)) & F.exists("v", lambda e: e != 0)
    good = F.coalesce(good, F.lit(False))
    # A vector alone of its length has nothing to link with.
    lengths = [r.d for r in rows.where(good).groupBy(F.size("v").alias("d")).count().where("count > 1").orderBy("d").collect()]
    linked = [_of_length(rows, good & (F.size("v") == d), threshold, kind) for d in lengths]
    usable = good & F.size("v").isin(lengths)
    rest = rows.where(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    for found in linked:
        rest = found.union(rest)
    return rest


def _of_length(rows: DataFrame, usable, threshold: float, kind: np.dtype) -> DataFrame:
    """near_duplicates() of the usable rows, which are vectors of one length."""
    grouped = rows.where(usable).groupBy("v").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"))
    # Written once: the number of a class is the same wherever it is read.
    classes = materialise(grouped.withColumn("cid", F.monotonically_increasing_id()), "itq-classes")
    count = classes.count()
    # The smallest hashes; only vectors with low ones are ordered, some three times as many as are taken.
    h = F.pmod(F.xxhash64("v"), F.lit(1 << 40))
    low = int(min(1.0, 3 * SAMPLE / max(1, count)) * (1 << 40))
    drawn = classes.select("v").where(h < low).orderBy(h, "v").limit(SAMPLE).toArrow().column(0)
    codes = Codes.fit(_unit(_given(drawn.combine_chunks())), count, threshold)

    def filed(batch: pa.RecordBatch):
        x = _given(batch.column(batch.schema.get_field_index("v")))
        unit = _unit(x)
        code, mask = codes.encode(unit), codes.mask(unit)
        return x, code, mask, *codes.keys(code, mask)

    def to_keys(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                yield pa.RecordBatch.from_pydict({"key": filed(batch.slice(at, 2000))[3]})

    def to_rows(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                x, code, mask, key, own = filed(part)
                cid, n = (part.column(part.schema.get_field_index(c)).to_numpy() for c in ("cid", "n"))
                bytes_of = lambda a: pa.array([r.tobytes() for r in a], pa.binary()).take(pa.array(own))  # noqa: B023, E731
                yield pa.RecordBatch.from_pydict({"key": key, "cid": cid[own], "n": n[own], "code": code[own].view(np.int64), "mask": bytes_of(mask), "vector": bytes_of(x)})

    def to_links(batches):
        for part in aligned(batches, "bucket", 100_000):
            found = bucket_links(codes, part, threshold, kind)
            if found is not None:
                yield found

    index = classes.select("v", "cid", "n").mapInArrow(to_rows, "key long, cid long, n long, code long, mask binary, vector binary")
    sizes = classes.select("v").mapInArrow(to_keys, "key long").groupBy("key").agg(F.count("*").alias("m")).where(F.col("m") > HOT_ROWS)
    hot = materialise(sizes.select("key", F.ceil(F.col("m") / BLOCK).cast("long").alias("blocks")), "itq-hot", count // 64)
    if hot.limit(1).count():
        index = dealt(index, hot, F.xxhash64("cid")).withColumn("bucket", F.xxhash64("key", "pair"))
    else:
        index = index.withColumns({"block": F.lit(0).cast("long"), "pair": F.lit(0).cast("long"), "bucket": F.col("key")})
    found = index.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(to_links, "cid long, links long, root long")
    found = materialise(found, "itq-links")
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    linked = components(found.select(F.col("cid").alias("a"), F.col("root").alias("b")))
    named = classes.join(links, "cid", "left").join(linked, F.col("cid") == F.col("node"), "left")
    named = materialise(named.select("v", "least", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "cid").alias("component")), "itq-named")
    # Written, so that Spark can split the partition of a giant component in the join.
    smallest = materialise(named.groupBy("component").agg(F.min("least").alias("component_id")), "itq-smallest", count)
    of_class = named.join(smallest, "component").select("v", "n_links", "component_id")
    return rows.where(usable).join(of_class, "v").select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"))
