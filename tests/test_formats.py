"""Index files, alignment, links, colours, extensions, walking the transform, placement, simulated reads."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from contigua.cli import main
from contigua.functions import align, links
from contigua.graph import features, model, paths
from contigua.operators import index
from contigua.sources import asqg, fastx, index_files, simulate

from .test_graph import make
from .test_reads import genome, rc


def reads_of(spark, seqs):
    return spark.createDataFrame([(i, s) for i, s in enumerate(seqs)], "read_idx long, seq string")


def test_index_files_round_trip(spark, tmp_path):
    reads = reads_of(spark, ["ACGT", "ACTGA", "CTGANA".replace("N", "C"), "A" * 70, "ACGT"])
    found = index.suffixes(reads)
    ranks, runs = index.read_ranks(found), index.runs(found)
    sai, bwt = f"{tmp_path}/x.sai", f"{tmp_path}/x.bwt"
    index_files.write_sai(ranks, sai)
    index_files.write_bwt(runs, 5, bwt)
    text = (tmp_path / "x.sai").read_text().split("\n")
    assert text[:3] == ["51914", "5", "5"] and text[3].split(" ")[1] == "0"
    in_order = lambda df: [r.read_idx for r in df.orderBy("rank").collect()]
    assert in_order(index_files.read_sai(spark, sai)) == in_order(ranks)
    raw = (tmp_path / "x.bwt").read_bytes()
    n_runs = runs.count()
    assert raw[:2] == b"\xca\xca" and len(raw) == 30 + n_runs and max(b & 31 for b in raw[30:]) == 31
    n, symbols, again = index_files.read_bwt(spark, bwt)
    want = [(r.symbol, r.len) for r in runs.orderBy("run_idx", "part").collect()]
    assert (n, symbols) == (5, found.count())
    assert [(r.symbol, r.len) for r in again.orderBy("run_no").collect()] == want
    for read in (index_files.read_sai, index_files.read_bwt):
        with pytest.raises(ValueError):
            read(spark, bwt if read is index_files.read_sai else sai)


def test_runs_of_a_known_string(spark):
    """The golden string AAACGGGTA as runs."""
    rows = [(i, c) for i, c in enumerate("AAACGGGTA")]
    found = index.runs(spark.createDataFrame(rows, "rank long, bwt_char string")).orderBy("run_idx").collect()
    assert [(r.symbol, r.len) for r in found] == [("A", 3), ("C", 1), ("G", 3), ("T", 1), ("A", 1)]


def test_walking_the_transform_spells_the_reads(spark):
    seqs = ["ACGT", "CGTA", "ACGT", "", "GATTACAGATTACAGATTACA"]
    found = index.suffixes(reads_of(spark, seqs))
    # Empty suffixes come first, in the order of the reads: walking from them spells whole reads.
    got = {r.rank: r.seq for r in index.walked(found, found.where(f"rank < {len(seqs)}").select("rank")).collect()}
    assert [got[i] for i in range(len(seqs))] == seqs
    bwt = {r.rank: r.bwt_char for r in found.collect()}
    occ = {r.rank: r for r in index.ranks_at(found, found.where("rank % 3 = 1").select("rank")).collect()}
    for rank, r in occ.items():
        assert [r[c] for c in "ACGT"] == [sum(bwt[k] == c for k in range(rank + 1)) for c in "ACGT"]


def cost_by_recursion(x, y):
    if not x or not y:
        return 2 * (len(x) + len(y))
    return min(cost_by_recursion(x[1:], y[1:]) + (x[0] != y[0]), cost_by_recursion(x[1:], y) + 2, cost_by_recursion(x, y[1:]) + 2)


def test_alignment_cost(spark):
    rng = random.Random(1)
    pairs = [("".join(rng.choices("ACG", k=rng.randint(0, 6))), "".join(rng.choices("ACG", k=rng.randint(0, 6)))) for _ in range(60)] + [(None, "A")]
    rows = spark.createDataFrame(pairs, "x string, y string").select("x", "y", align.alignment_cost(F.col("x"), F.col("y")).alias("c")).collect()
    assert all(r.c == (None if r.x is None else cost_by_recursion(r.x, r.y)) for r in rows)


def test_local_alignment(spark):
    """The golden pair; a gap in the reference; nothing in common."""
    reference, query = "CAGCCTTTCTGACCCGGAAATCAAAATAGGCACAACAAA", "CTGAGCCGGTAAATC"
    row = spark.createDataFrame([(query, reference)], "q string, r string").select(align.aligned(F.col("q"), F.col("r")).alias("a")).first().a
    assert (row.reference_begin, row.reference_end, row.query_begin, row.query_end, row.cigar) == (8, 22, 0, 15, "4=1X4=1I5=")
    assert align.local_alignment("ACGTACGTTT", "ACGTACGGGTTT")["cigar"] == "6=2D4="
    assert align.local_alignment("AAAA", "CCCC")["score"] == 0 == align.local_alignment("", "A")["score"]


def test_link_algebra_is_that_of_places(spark):
    """Vertices as stretches on a line, either way up: the link between two of them follows from their links with a third."""
    g = genome(400, 5)
    rng = random.Random(2)
    for _ in range(30):
        spots = [(rng.randrange(0, 60), rng.random() < 0.5) for _ in range(2)]
        spots.sort()
        (a, a_turned), (b, b_turned) = spots
        if a == b:
            continue
        seq = lambda at, turned: rc(g[at : at + 100]) if turned else g[at : at + 100]
        # From a root at place 0, as written: direction sense, strands change if turned.
        row = spark.range(1).select(*[c.alias(n) for n, c in zip(("d", "dir", "comp"), links.between(F.lit(a), F.lit(0), F.lit(int(a_turned)), F.lit(b), F.lit(0), F.lit(int(b_turned))), strict=True)])
        d, direction, comp = row.first()
        held = spark.createDataFrame([(seq(a, a_turned), seq(b, b_turned))], "x string, y string").select(links.holds(F.col("x"), F.col("y"), F.lit(d), F.lit(direction), F.lit(comp)).alias("h"))
        assert (d, comp) == (b - a, int(a_turned != b_turned)) and held.first().h
    back = spark.range(1).select(*links.non_negative(F.lit("a"), F.lit("b"), F.lit(-7), F.lit(1), F.lit(0))).first()
    assert tuple(back) == ("b", "a", 7, 0, 0)
    assert spark.range(1).select(links.apart(F.lit(-1), F.lit(0)), links.apart(F.lit(-1), F.lit(-2)), links.apart(F.lit(1), F.lit(2))).first()[:] == (True, False, False)


def test_colours(spark):
    graph = make(spark, {f"v{i}": genome(30, i) for i in range(3)}, [("v0", 0, "v1", 1, 10), ("v1", 0, "v2", 1, 10)])
    marked = model.coloured(graph, spark.createDataFrame([("e00",)], "edge_key string"), model.BLACK)
    marked = model.coloured(marked, spark.createDataFrame([("e01",)], "edge_key string"), model.WHITE)
    assert {(r.edge_key, r.colour) for r in marked.half_edges.collect()} == {("e00", "black"), ("e01", "white")}
    left = model.sweep(marked)
    assert {r.edge_key for r in left.half_edges.collect()} == {"e01"} and left.half_edges.columns == graph.half_edges.columns


def test_majority_marks(spark):
    graph = make(spark, {f"v{i}": genome(30, i) for i in range(4)}, [("v0", 0, "v1", 1, 10), ("v1", 0, "v2", 1, 12), ("v2", 0, "v3", 1, 14)])
    rows = features.edge_features(graph)
    training = rows.withColumn("label", (F.col("overlap") > 10).cast("double"))
    trees = [features.DecisionTreeClassifier(featuresCol="features", labelCol="label").fit(features.VectorAssembler(inputCols=list(features.FEATURES), outputCol="features").transform(training))] * 3
    got = {r.edge_key: r.colour for r in features.marked_edges(graph, trees).half_edges.collect()}
    assert got == {"e00": "black", "e01": "white", "e02": "white"}


LINES = "HT\tVN:i:1\nVT\ta\tACGTACGT\tSS:i:0\tCR:i:3\tBX:Z:x!2,y\tEX:Z:8=|c1|5|1,4=1X3=|c2|9|2\nVT\tb\tACGTTTTT\tEX:Z:8=|c1|9|1\nED\ta b 4 7 8 0 3 8 0 0\n"


def test_extensions_are_kept(spark, tmp_path):
    path = tmp_path / "g.asqg"
    path.write_text(LINES)
    graph = asqg.load(spark, str(path))
    found = sorted(map(tuple, asqg.alignments(graph.vertices).collect()))
    assert found == [("a", "4=1X3=", "c2", 9, 2), ("a", "8=", "c1", 5, 1), ("b", "8=", "c1", 9, 1)]
    asqg.write(graph, f"{tmp_path}/out", compression="none")
    again = asqg.load(spark, f"{tmp_path}/out")
    assert sorted(map(tuple, asqg.alignments(again.vertices).collect())) == found
    (r,) = paths.simplify(graph).vertices.collect()
    assert r.seq == "ACGTACGTTTTT" and list(r.extension) == ["8=|c1|5|1", "4=1X3=|c2|9|2", "8=|c1|9|1"]
    (c,) = fastx.contig_records(paths.simplify(graph).vertices).collect()
    assert c.comment.startswith("CR:i:4 BX:Z:x!2,y!1 EX:Z:8=|c1|5|1,4=1X3=")
    labels = {(x.edge_key, x.label) for x in features.labels(graph, asqg.alignments(graph.vertices)).collect()}
    assert {n for _, n in labels} == {1}


def test_the_order_of_records_is_kept(spark, tmp_path):
    lines = LINES.strip().split("\n")
    for order in itertools.permutations(range(4)):
        path = tmp_path / ("".join(map(str, order)) + ".asqg")
        path.write_text("\n".join(lines[i] for i in order) + "\n")
        good = order[0] == 0 and order[3] == 3
        if good:
            asqg.read(spark, str(path))
        else:
            with pytest.raises(ValueError):
                asqg.read(spark, str(path))


def test_containment_edges(spark):
    rows = [("a", "b", 0, 9, 10, 5, 14, 30, 0, 0), ("a", "c", 5, 9, 10, 0, 4, 10, 0, 0), ("d", "e", 0, 9, 10, 0, 9, 10, 1, 0), ("f", "g", 0, 9, 10, 0, 9, 12, 0, 0)]
    edges = spark.createDataFrame(rows, "id0 string, id1 string, s0 int, e0 int, l0 int, s1 int, e1 int, l1 int, is_rc int, num_diff int")
    got = model.containment_halves(edges).collect()
    assert {(r.src, r.dst) for r in got} == {("d", "e"), ("e", "d"), ("f", "g"), ("g", "f")} and len(got) == 8
    assert all(r.dir == r.twin_dir for r in got) and {r.overlap for r in got} == {10}


def test_placement_by_brute_force(spark, monkeypatch):
    g = genome(500, 3)
    reference = [("r", g), ("s", g[100:300] + g[50:90]), ("t", "A"), ("u", "")]
    contigs = [(f"c{i}", g[i * 30 : i * 30 + 20 + 7 * i]) for i in range(12)] + [("none", "ACGT" * 30), ("turned", rc(g[200:260])), ("empty", "")]
    found = paths.placed(spark.createDataFrame(contigs, "name string, seq string"), spark.createDataFrame(reference, "name string, seq string"), both_strands=True)
    want = {(n, r, k, k + len(s), t) for n, c in contigs if c for r, text in reference for t, s in ((False, c), (True, rc(c))) for k in range(len(text) - len(s) + 1) if text[k : k + len(s)] == s}
    assert {tuple(r) for r in found.collect()} == want
    cover = {(r.ref, k) for r in paths.covered(found).collect() for k in range(r.start, r.end)}
    assert cover == {(r, k) for _, r, a, b, _ in want for k in range(a, b)}


def test_simulated_pairs(spark):
    g = genome(3000, 8)
    rows = spark.createDataFrame([("g", g), ("short", "ACGT")], "name string, seq string")
    got = simulate.paired_reads(rows, length=50, coverage=10, insert=200, sigma=20).collect()
    again = simulate.paired_reads(rows, length=50, coverage=10, insert=200, sigma=20).collect()
    assert sorted(got, key=str) == sorted(again, key=str) and 0.6 * 600 < len(got) <= 600
    pairs = {}
    for r in got:
        at = g.find(r.seq)
        assert at >= 0 and r.name.endswith(f"/{r.mate + 1}")
        pairs.setdefault(r.pair_idx, {})[r.mate] = at
    gaps = [p[1] - p[0] - 50 for p in pairs.values()]
    assert abs(sum(gaps) / len(gaps) - 200) < 10 and len(set(gaps)) > 20


def test_new_commands(spark, tmp_path):
    g = genome(2500, 9)
    (tmp_path / "g.fa").write_text(f">g\n{g}\n")
    main(["simulate", f"{tmp_path}/g.fa", "-o", f"{tmp_path}/sim", "--length", "60", "--coverage", "4", "--insert-size", "100", "--sigma", "0"])
    first = fastx.read(spark, f"{tmp_path}/sim.1.fa")
    assert first.count() > 20
    main(["index", f"{tmp_path}/g.fa", "-o", f"{tmp_path}/idx"])
    assert index_files.read_bwt(spark, f"{tmp_path}/idx/index.bwt")[1] == len(g) + 1 and (tmp_path / "idx/index.rsai").exists()
    (tmp_path / "c.fa").write_text(f">a\n{g[100:400]}\n>b\n{'ACCA' * 20}\n")
    main(["place", f"{tmp_path}/c.fa", "-o", f"{tmp_path}/p", "--reference", f"{tmp_path}/g.fa"])
    assert [r.name for r in fastx.read(spark, f"{tmp_path}/p-unplaced.fa").collect()] == ["b"]
    (tmp_path / "g.asqg").write_text(LINES)
    main(["gan", f"{tmp_path}/g.asqg", "-o", f"{tmp_path}/gan"])
    assert asqg.load(spark, f"{tmp_path}/gan-graph.asqg.gz").half_edges.count() == 2
    assert spark.read.csv(f"{tmp_path}/gan-features", sep="\t", header=True).count() == 1
