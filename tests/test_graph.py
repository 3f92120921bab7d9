import random

import pytest
from pyspark.sql import functions as F

from contigua.cli import COMMANDS, parsed
from contigua.functions import dna
from contigua.graph import clean, features, model, paths
from contigua.operators import overlap
from contigua.plans import assemble
from contigua.sources import asqg

from .test_reads import frame, genome, rc, tiles

VERTEX = "id string, seq string, coverage long, barcodes array<struct<bx:string,n:bigint>>"
HALF = "edge_key string, half int, src string, dst string, dir int, twin_dir int, overlap int"


def make(spark, seqs, ties, coverage=None, barcodes=None):
    """ties: (a, end of a, b, end of b, overlap); an end is 0 for the sequence's end, 1 for its start."""
    rows = [(n, s, (coverage or {}).get(n, 1), (barcodes or {}).get(n, [])) for n, s in seqs.items()]
    halves = [x for k, (a, d, b, e, n) in enumerate(ties) for x in ((f"e{k:02d}", 0, a, b, d, e, n), (f"e{k:02d}", 1, b, a, e, d, n))]
    return model.Graph(spark.createDataFrame(rows, VERTEX), spark.createDataFrame(halves, HALF))


def plain(size, seed=0):
    return {f"v{i}": genome(size, seed + i) for i in range(12)}


def chain(g, cuts, size):
    """Sequences cut from g at the given places, and how each overlaps the next."""
    return {f"v{i}": g[c : c + size] for i, c in enumerate(cuts)}, [(f"v{i}", 0, f"v{i + 1}", 1, size - (cuts[i + 1] - c)) for i, c in enumerate(cuts[:-1])]


@pytest.mark.parametrize("n", [1, 2, 3, 17])
def test_a_chain_is_one_contig(spark, n):
    g = genome(200, n)
    seqs, ties = chain(g, list(range(0, 6 * n, 6)), 20)
    found = paths.contigs(make(spark, seqs, ties)).collect()
    assert [(r.id, r.n_reads, r.seq) for r in found] == [("v0", n, g[: 6 * (n - 1) + 20])] or found[0].seq == rc(g[: 6 * (n - 1) + 20])


def test_turned_members(spark):
    g = genome(80, 2)
    seqs, ties = chain(g, [0, 8, 16, 24], 20)
    seqs["v1"], seqs["v3"] = rc(seqs["v1"]), rc(seqs["v3"])
    flip = lambda v, d: 1 - d if v in ("v1", "v3") else d
    graph = make(spark, seqs, [(a, flip(a, d), b, flip(b, e), n) for a, d, b, e, n in ties])
    assert model.violations(graph).count() == 0
    (r,) = paths.contigs(graph).collect()
    assert r.seq in (g[:44], rc(g[:44])) and r.coverage == 4


def test_a_ring_opens_at_its_smallest_member(spark):
    g = genome(40, 3)
    ring = g + g
    seqs = {f"v{i}": ring[c : c + 20] for i, c in enumerate(range(0, 40, 8))}
    ties = [(f"v{i}", 0, f"v{(i + 1) % 5}", 1, 12) for i in range(5)]
    (r,) = paths.contigs(make(spark, seqs, ties)).collect()
    assert r.id == "v0" and r.n_reads == 5 and r.seq == ring[:52]


def plain_contigs(vertices, arcs):
    """Merges linear arcs one by one; canonical sequences of the chains."""
    out, into = {}, {}
    for a, b, n in arcs:
        out.setdefault(a, []).append((b, n))
        into.setdefault(b, []).append(a)
    nxt = {a: t[0] for a, t in out.items() if len(t) == 1 and len(into[t[0][0]]) == 1 and t[0][0][0] != a[0]}
    back = {b: a for a, (b, _) in nxt.items()}
    found = []
    for v in vertices:
        for r in (False, True):
            if (v, r) in back:
                continue
            at, seq, seen = (v, r), rc(vertices[v]) if r else vertices[v], 1
            while at in nxt:
                at, n = nxt[at]
                seq += (rc(vertices[at[0]]) if at[1] else vertices[at[0]])[n:]
                seen += 1
            found.append(min(seq, rc(seq)))
    return sorted(set(found))


@pytest.mark.parametrize("seed", range(4))
def test_contigs_by_brute_force(spark, seed):
    seqs = tiles(seed, n=140, size=20, count=18)
    df = frame(spark, seqs)
    graph = model.build(df, overlap.string_graph(df, 8)).cut()
    arcs = [((r.src, r.src_rc), (r.dst, r.dst_rc), r.overlap) for r in paths.arcs(graph).collect()]
    want = plain_contigs({f"r{i:03d}": s for i, s in enumerate(seqs)}, arcs)
    got = paths.contigs(graph).collect()
    assert sorted({min(r.seq, rc(r.seq)) for r in got}) == want
    assert sum(r.coverage for r in got) == len(seqs)
    simple = paths.simplify(graph)
    assert model.violations(simple).count() == 0
    assert paths.linear_arcs(simple).count() == 0
    assert {r.seq for r in simple.vertices.collect()} == {r.seq for r in got}


def test_tips_and_statistics(spark):
    s = plain(30)
    graph = make(spark, {k: s[k] for k in ("v0", "v1", "v2", "v3", "v4")}, [("v0", 0, "v1", 1, 9), ("v1", 0, "v2", 1, 9), ("v1", 0, "v3", 1, 9)], {"v3": 9})
    assert model.statistics(graph).first().asDict() == {"vertices": 5, "edges": 6, "islands": 1, "tips": 3, "monobranch": 1, "dibranch": 0, "simple": 4}
    after, gone = clean.trim(graph, 40)
    assert {r.id for r in gone.collect()} == {"v0", "v2", "v3", "v4"} and after.half_edges.count() == 0
    assert {r.id for r in clean.tips(graph, 40, 2).collect()} == {"v0", "v2", "v4"}
    assert clean.tips(graph, 20).count() == 0


def test_a_loop_is_unrolled(spark):
    g = genome(70, 5)
    u, v = g[:20], g[10:40] + g[:10]
    graph = make(spark, {"u": u, "v": v, "w": "T" * 5 + u[:10]}, [("u", 0, "v", 1, 10), ("v", 0, "u", 1, 10), ("w", 0, "u", 1, 10)])
    after, gone = clean.unroll_loops(graph)
    assert [r.id for r in gone.collect()] == ["v"]
    seqs = {r.id: r for r in after.vertices.collect()}
    assert seqs["u"].seq == u + v[10:] + u[10:] and seqs["u"].coverage == 2
    assert model.violations(after).count() == 0


def test_max_overlap(spark):
    s = plain(100)
    ties = [("v0", 0, "v1", 1, 50), ("v0", 0, "v2", 1, 40), ("v0", 0, "v3", 1, 48), ("v4", 0, "v2", 1, 30)]
    graph = make(spark, {k: s[k] for k in ("v0", "v1", "v2", "v3", "v4")}, ties)
    keys = lambda **k: {r.edge_key for r in clean.weaker_overlaps(graph, 5, genome=1_000_000, **k).collect()}
    assert keys() == {"e01", "e03"}
    assert keys(careful=True) == set()  # either is best seen from its other end
    assert clean.weaker_overlaps(graph, 5).count() == 0  # no vertex is unique in a genome that large


def test_chimera(spark):
    s = plain(100)
    ties = [("v0", 0, "v1", 1, 30), ("v0", 0, "v2", 1, 30), ("v1", 0, "v3", 1, 30), ("v4", 0, "v3", 1, 30)]
    graph = make(spark, {k: s[k] for k in ("v0", "v1", "v2", "v3", "v4")}, ties, {"v2": 9, "v4": 1})
    assert {r.id for r in clean.chimeras(graph, 100).collect()} == {"v1"}
    assert clean.chimeras(graph, 99).count() == 0


def test_barcodes(spark):
    s = plain(100)
    b = {"v0": [("a", 1), ("a", 5), ("b", 2)], "v1": [("a", 0), ("a", 3), ("a", 9), ("c", 1)], "v2": [("b", 1)]}
    graph = make(spark, {k: s[k] for k in ("v0", "v1", "v2")}, [("v0", 0, "v1", 1, 30), ("v0", 0, "v2", 1, 30)], {"v0": 3}, b)
    row = features.barcode_counters(graph, spark.createDataFrame([("v0", "v1")], "x string, y string")).first()
    assert tuple(row)[2:] == (3, 4, 2, 3, 1, 1, 1)
    assert {r.edge_key for r in clean.unlinked(graph, 50, 2).collect()} == {"e01"}
    table = features.edge_features(graph)
    assert table.count() == 2 and len(features.FEATURES) == 46 and table.columns[4:] == list(features.FEATURES)


def test_trees_and_labels(spark):
    s = plain(100)
    graph = make(spark, {k: s[k] for k in ("v0", "v1", "v2")}, [("v0", 0, "v1", 1, 30), ("v0", 0, "v2", 1, 40)])
    where = spark.createDataFrame([("v0", "100=", "c", 0), ("v1", "100=", "c", 70), ("v2", "99=1X", "c", 60)], "id string, cigar string, chr string, pos long")
    label = {r.edge_key: r.label for r in features.labels(graph, where).collect()}
    assert label == {"e00": 1, "e01": 0}
    reference = spark.createDataFrame([("AA" + s["v0"] + s["v2"][40:] + "C",)], "seq string")
    assert {r.edge_key for r in features.labels(graph, where, reference).where("label = 1").collect()} == {"e00", "e01"}
    table = features.edge_features(graph).join(features.labels(graph, where), ["edge_key", "half"])
    many = table.union(table).union(table).union(table)
    got = features.votes(features.edge_features(graph), features.fit_bag(many, 3)).collect()
    assert len(got) == 2 and all(0 <= r.votes <= 3 for r in got)


def test_walks_and_pairs(spark):
    g = genome(400, 6)
    names = [f"p{i // 2}/{i % 2 + 1}" for i in range(8)]
    seqs = {n: g[20 * i : 20 * i + 50] for i, n in enumerate(names)}
    graph = make(spark, seqs, [(names[i], 0, names[i + 1], 1, 30) for i in range(7)])
    root = spark.createDataFrame([("p1/1",)], "id string")
    got = {(r.id, r.distance) for r in paths.walks(graph, root, 40).collect()}
    assert got == {("p1/2", 20), ("p2/1", 40), ("p0/2", -20), ("p0/1", -40)}
    assert tuple(paths.insert_size(paths.insert_sizes(graph)).first()) == (4, 20, 0)
    links = paths.paired_links(graph, 40, 10)
    assert ("p0/1", "p1/1", 40) in {tuple(r) for r in links.collect()}
    assert tuple(paths.insert_size(paths.insert_sizes(make(spark, {"x": g}, []))).first()) == (0, 500, 100)
    near = paths.khop(graph, root, 2)
    assert {(r.id, r.hop) for r in near.collect()} == {("p1/1", 0), ("p1/2", 1), ("p0/2", 1), ("p2/1", 2), ("p0/1", 2)}
    assert paths.subgraph(graph, root, 1).half_edges.count() == 4


def test_direct_links(spark):
    links = spark.createDataFrame([("a", "b", 1), ("b", "c", 1), ("a", "c", 2), ("a", "d", 1)], "src string, dst string, distance long")
    assert {(r.src, r.dst) for r in paths.direct_links(links).collect()} == {("a", "b"), ("b", "c"), ("a", "d")}


def test_caps_and_contained(spark):
    s = plain(100)
    graph = make(spark, {k: s[k] for k in ("v0", "v1", "v2")}, [("v0", 0, "v1", 1, 30), ("v0", 0, "v2", 1, 40)])
    assert {r.edge_key for r in model.cap_edges(graph, 1).half_edges.collect()} == {"e01"}
    edges = spark.createDataFrame([("a", "b", 0, 9, 10, 3, 12, 30, 0, 0), ("a", "c", 5, 9, 10, 0, 4, 10, 0, 0)], "id0 string, id1 string, s0 int, e0 int, l0 int, s1 int, e1 int, l1 int, is_rc int, num_diff int")
    assert [r.id for r in model.contained_ids(edges).collect()] == ["a"]
    assert model.half_edges_of(edges).count() == 2
    twice = make(spark, {"a": "ACGG", "b": "CCGT", "c": "TTTT"}, [])
    assert [r.id for r in clean.identical(twice).collect()] == ["b"]


def test_n50(spark):
    df = spark.createDataFrame([("A" * n,) for n in (10, 20, 30, 40)], "seq string")
    assert tuple(paths.contig_statistics(df).first()) == (4, 100, 40, 30, 20)
    assert paths.contig_statistics(df.limit(0)).first().n_contigs == 0


def test_assembly_restores_a_genome(spark):
    g = genome(400, 9)
    seqs = [g[i : i + 40] for i in range(0, 361, 5)]
    seqs = [rc(s) if i % 3 == 0 else s for i, s in enumerate(seqs)]
    df = frame(spark, seqs)
    done = assemble.assemble(model.build(df, overlap.string_graph(df, 15)), assemble.Options(min_branch_length=30))
    (r,) = done.contigs.collect()
    assert r.seq in (g, rc(g)) and r.coverage == len(seqs)
    paired = assemble.assemble(model.build(df, overlap.string_graph(df, 15)), assemble.Options(pairs=True, min_branch_length=30))
    assert paired.contigs.count() == 1


def test_asqg_round_trip(spark, tmp_path):
    df = frame(spark, tiles(1, n=140, size=20, count=16))
    graph = model.build(df, overlap.string_graph(df, 8)).cut()
    asqg.write(graph, str(tmp_path / "g"), overlap=8, input="x.fa")
    head, vertices, edges = asqg.read(spark, str(tmp_path / "g"))
    assert tuple(head.select("VN", "OL", "IN").first()) == (1, 8, "x.fa")
    back = asqg.load(spark, str(tmp_path / "g"))
    key = ["src", "dst", "dir", "twin_dir", "overlap"]
    assert sorted(map(tuple, back.half_edges.select(*key).collect())) == sorted(map(tuple, graph.half_edges.select(*key).collect()))
    assert {tuple(r) for r in back.vertices.select("id", "seq", "coverage").collect()} == {tuple(r) for r in graph.vertices.select("id", "seq", "coverage").collect()}
    assert asqg.graphviz_lines(back).count() == vertices.count() + edges.count()
    with pytest.raises(ValueError):
        model.build(df.where("read_idx < 1"), edges, strict=True)


def test_asqg_tags(spark, tmp_path):
    (tmp_path / "g").write_text("HT\tVN:i:1\nVT\ta\tACGT\tSS:i:0\tCR:i:3\tBX:Z:x!2,y\nVT\tb\tGTAA\nED\ta b 2 3 4 0 1 4 0 0\tCG:Z:2=\n")
    _, v, e = asqg.read(spark, str(tmp_path / "g"))
    rows = {r.id: r for r in v.collect()}
    assert rows["a"].coverage == 3 and [tuple(b) for b in rows["a"].barcodes] == [("x", 2), ("y", 1)] and rows["b"].barcodes == []
    assert e.first().cigar == "2="
    (tmp_path / "bad").write_text("XX\tq\n")
    with pytest.raises(Exception, match="unknown record"):
        asqg.read(spark, str(tmp_path / "bad"))[2].collect()


def test_command_line(tmp_path):
    for name in COMMANDS:
        assert parsed([name, "in"]).command == name
    (tmp_path / "c.ini").write_text("[overlap]\nmin-overlap = 33\nexhaustive = true\n")
    a = parsed(["overlap", "in", "--config", str(tmp_path / "c.ini")])
    assert (a.min_overlap, a.exhaustive) == (33, True)
    assert parsed(["overlap", "in", "--config", str(tmp_path / "c.ini"), "--min-overlap", "50"]).min_overlap == 50


def test_commands_run(spark, tmp_path):
    from contigua.cli import main

    g = genome(300, 12)
    (tmp_path / "r.fa").write_text("".join(f">r{i:02d}\n{g[i * 5 : i * 5 + 50]}\n" for i in range(51)))
    main(["preprocess", str(tmp_path / "r.fa"), "-o", str(tmp_path / "pp")])
    main(["rmdup", str(tmp_path / "pp"), "-o", str(tmp_path / "rm")])
    main(["overlap", str(tmp_path / "rm.kept.fa"), "-o", str(tmp_path / "g"), "--min-overlap", "20"])
    main(["assemble", str(tmp_path / "g"), "-o", str(tmp_path / "asm"), "--min-branch-length", "40"])
    from contigua.sources import fastx

    (r,) = fastx.read_fasta(spark, str(tmp_path / "asm-contigs.fa")).collect()
    assert r.seq in (g, rc(g)) or len(r.seq) == 300
    assert spark.range(1).select(dna.canonical(F.lit(r.seq)) == dna.canonical(F.lit(g))).first()[0]
