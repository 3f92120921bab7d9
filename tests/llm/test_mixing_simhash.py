import math
import random
import re
from hashlib import md5
from itertools import combinations

import duckdb
import numpy as np
import pytest
import xxhash

from contigua.llm import common, mixing, simhash

from .conftest import awkward_rows, prose


def test_mix_equals_sql(documents, spark):
    docs = documents.where("doc_id is not null").toPandas()  # noqa: F841
    con = duckdb.connect()
    con.register("documents", docs)
    want = con.sql(mixing.ORACLE).fetchall()
    got = mixing.mix(documents.where("doc_id is not null")).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_targets():
    sizes = {"a": 10, "b": 1000, "c": 500}
    weights = {"a": 1, "b": 2, "c": 3}
    total, capped, level = 1510, set(), 0
    while True:
        rest = total - sum(3 * sizes[s] for s in capped)
        level = rest / sum(w for s, w in weights.items() if s not in capped)
        over = {s for s in sizes if s not in capped and level * weights[s] > 3 * sizes[s]}
        if not over:
            break
        capped |= over
    pytest.level = {s: min(3 * sizes[s], level * weights[s]) for s in sizes}


def test_water_filling(spark):
    rows = [(i, " ".join(["w"] * n), s) for i, (s, n) in enumerate([("a", 10), ("b", 1000), ("c", 500)])]
    test_targets()
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    for r in got:
        assert math.isclose(r.target, pytest.level["abc"[r.doc_id]])
        assert r.taken <= 3 * r.size and r.source_size == r.size


def test_mix_edges(documents, no_documents, clashing):
    rows = mixing.mix(documents).collect()
    assert len(rows) == len(awkward_rows())
    assert all(r.size == len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for r in rows for i, t, *_ in awkward_rows() if i is not None and i == r.doc_id)
    assert mixing.mix(no_documents).count() == 0
    mixed = mixing.mixed_documents(clashing)
    assert mixed.columns == clashing.columns
    assert mixed.count() == sum(r.copies for r in rows)


def test_rows_are_taken_in_the_order_of_their_keys(spark):
    """A source that is taken in part: its documents with the smallest keys, from the md5 of their ids."""
    rows = [(i, "w x y", "b") for i in range(200)] + [(1000 + i, "v " * 40, "a") for i in range(40)]
    got = [r for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect() if r.source_size == 600]
    key = lambda i: -math.log((int(md5(str(i).encode()).hexdigest()[:12], 16) + 0.5) / 2**48) / 0.25
    copies = [r.copies for r in sorted(got, key=lambda r: key(r.doc_id))]
    assert copies == sorted(copies, reverse=True)


@pytest.mark.parametrize("same", [0, 1, 150, 600])
def test_equal_rows_share_the_border(spark, same):
    """Rows without id and equal rows are taken as far as the words go: no key is too frequent for that."""
    rows = [(None, "one two three", "a")] * same + [(None, "one " * (1 + i % 7), "a") for i in range(200)] + [(i, "word " * (i % 9), "a") for i in range(100)] + [(5000 + i, "long text " * 20, "b") for i in range(100)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = mixing.mix(table).collect()
    assert len(got) == len(rows)
    for size in {r.source_size for r in got}:
        own = [r for r in got if r.source_size == size]
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(r.size for r in own)
    held = sum(r.copies for r in got)
    assert mixing.mixed_documents(table).count() == held
    con = duckdb.connect()
    con.register("documents", table.toArrow())
    assert sorted(map(tuple, got), key=str) == sorted(con.sql(mixing.ORACLE).fetchall(), key=str)


@pytest.mark.parametrize("scale", [0.001, 1.0, 1000.0])
def test_no_cell_holds_many_documents(spark, scale):
    """Whatever the weights, cells of the key are narrow: a four-hundredth of a source at most, here of 20,000 rows."""
    from pyspark.sql import functions as F

    docs = spark.range(20_000).selectExpr("id as doc_id", "'a b' as text", "'s' as source")
    cells = mixing._sized(docs, ["doc_id"], F.lit(scale)).groupBy("_cell").count().agg(F.max("count")).first()[0]
    assert cells < 50


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def plain_components(prints, ids):
    least = list(range(len(ids)))
    for i, j in combinations(range(len(ids)), 2):
        if bin(prints[i] ^ prints[j]).count("1") <= 4:
            a, b = least[i], least[j]
            least = [min(a, b) if x in (a, b) else x for x in least]
    best = {}
    for x, i in zip(least, ids, strict=True):
        if i is not None:
            best[x] = min(best.get(x, i), i)
    return [best.get(x) for x in least]


def near_rows():
    rng, rows = random.Random(1), []
    for g in range(12):
        base = prose(g, 200).split()
        for k in range(8):
            words = list(base)
            for _ in range(k):
                words[rng.randrange(len(words))] = "other"
            rows.append((g * 10 + k, " ".join(words)))
    return rows + [(i, t) for i, t, *_ in awkward_rows() if i is None or i > 49]


def test_near_duplicates_equal_brute_force(spark):
    rows = [(None if i is None else i + 1000 * (i > 49 and k > 95), t) for k, (i, t) in enumerate(near_rows())]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    prints = [plain_fingerprint(t) for _, t in rows]
    want = sorted(zip([i for i, _ in rows], [f"{p:016x}" for p in prints], plain_components(prints, [i for i, _ in rows]), strict=True), key=str)
    assert sorted(map(tuple, got), key=str) == want


def test_links_connect_what_brute_force_links(spark, monkeypatch):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    prints = [int(b) for b in base]
    for b in base[:20]:
        for _ in range(30):
            x = int(b)
            for bit in rng.choice(64, rng.integers(1, 6), replace=False):
                x ^= 1 << int(bit)
            prints.append(x)
    prints = sorted(set(prints))
    frame = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long")
    want = plain_components(prints, list(range(len(prints))))
    for rows, block in ((4096, 2048), (8, 4)):  # the second deals hot buckets in blocks
        monkeypatch.setattr(simhash, "HOT_ROWS", rows)
        monkeypatch.setattr(simhash, "BLOCK", block)
        found = {r.node: r.component for r in common.components(simhash.links(frame)).collect()}
        groups = {}
        for p, w in zip(prints, want, strict=True):
            s = p - (1 << 64) if p >> 63 else p
            groups.setdefault(w, set()).add(found.get(s, s))
        assert all(len(g) == 1 for g in groups.values())
        assert len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_keep_one(clashing, no_documents):
    kept = simhash.keep_one(clashing)
    assert kept.columns == clashing.columns
    ids = [r.doc_id for r in kept.collect()]
    found = simhash.near_duplicates(clashing).collect()
    components = {r.component_id for r in found if r.component_id is not None}
    assert sorted(i for i in ids if i is not None) == sorted(components)
    assert sum(i is None for i in ids) == len({r.fingerprint for r in found if r.component_id is None})
    assert simhash.keep_one(no_documents).count() == 0
    assert simhash.near_duplicates(no_documents).count() == 0


@pytest.mark.parametrize("shape", ["path", "star", "random", "ring"])
def test_components(spark, shape):
    rng = random.Random(4)
    edges = {"path": [(i, i + 1) for i in range(60)], "star": [(99, i) for i in range(60)], "ring": [(i, (i + 1) % 30) for i in range(30)], "random": [(rng.randrange(80), rng.randrange(80)) for _ in range(60)]}[shape]
    least = {v: v for e in edges for v in e if e[0] != e[1]}
    for _ in least:
        for a, b in edges:
            if a != b:
                least[a] = least[b] = min(least[a], least[b])
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == least
