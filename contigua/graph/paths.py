"""Chains, contigs, walks and pairs on a string graph.

Chains are found on oriented nodes (id, turned): an edge that leaves v at its end starts at (v, false), one that leaves
at its start at (v, true); it reaches w as written if it enters at w's start. Every chain has a mirror image.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dna, links, scores
from ..plans.storage import Rounds, materialise
from .model import ANTISENSE, SENSE, Graph


def arcs(graph: Graph) -> DataFrame:
    """(src, src_rc, dst, dst_rc, overlap, edge_key) between oriented nodes: one for each half-edge."""
    return graph.half_edges.select("src", (F.col("dir") == ANTISENSE).alias("src_rc"), "dst", (F.col("twin_dir") == SENSE).alias("dst_rc"), "overlap", "edge_key")


def linear_arcs(graph: Graph) -> DataFrame:
    """Arcs that are the only one out of their source and into their target, between two vertices."""
    all_arcs = arcs(graph)
    out = all_arcs.groupBy("src", "src_rc").agg(F.count("*").alias("_n")).where("_n = 1").select("src", "src_rc")
    into = all_arcs.groupBy("dst", "dst_rc").agg(F.count("*").alias("_n")).where("_n = 1").select("dst", "dst_rc")
    return all_arcs.join(out, ["src", "src_rc"], "left_semi").join(into, ["dst", "dst_rc"], "left_semi").where("src <> dst")


def chains(graph: Graph) -> DataFrame:
    """(id, rc, head, head_rc, pos, at): every oriented node's chain, place in it, and bases before it.

    Pointers to the node before double their reach each round, with steps and bases summed: rounds grow as the
    logarithm of the longest chain. A ring is opened before its smallest node.
    """
    seqs = graph.vertices.select("id", F.length("seq").alias("size"))
    linear = linear_arcs(graph).join(seqs.select(F.col("id").alias("src"), "size"), "src")
    before = linear.select(F.struct(F.col("dst").alias("id"), F.col("dst_rc").alias("rc")).alias("node"), F.struct(F.col("src").alias("id"), F.col("src_rc").alias("rc")).alias("up"), F.lit(1).cast("long").alias("pos"), (F.col("size") - F.col("overlap")).cast("long").alias("at"))
    nodes = graph.vertices.select(F.explode(F.array(*[F.struct("id", F.lit(rc).alias("rc")) for rc in (False, True)])).alias("node"))
    links = materialise(before, "chain-links")
    heads = nodes.join(links, "node", "left_anti")
    done = heads.select("node", F.col("node").alias("head"), F.lit(0).cast("long").alias("pos"), F.lit(0).cast("long").alias("at"))
    while True:
        found, ring = _doubled(links)
        done = done.unionByName(found)
        if ring is None:
            break
        # A ring's smallest node becomes a head; its other nodes are ranked once more.
        smallest = ring.where("node = low").select("node")
        done = done.unionByName(smallest.select("node", F.col("node").alias("head"), F.lit(0).cast("long").alias("pos"), F.lit(0).cast("long").alias("at")))
        links = materialise(links.join(ring.select("node"), "node", "left_semi").join(smallest, "node", "left_anti"), "ring-links")
    return done.select("node.id", "node.rc", F.col("head.id").alias("head"), F.col("head.rc").alias("head_rc"), "pos", "at")


def _doubled(links: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(node, head, pos, at) of the nodes whose chain has a head, and (node, low) of those in rings, if there are any."""
    state = materialise(links.withColumn("low", F.least("node", "up")), "chain-state")
    n, reach = state.count(), 1
    while True:
        b = state.select(F.col("node").alias("up"), F.col("up").alias("_up"), F.col("pos").alias("_pos"), F.col("at").alias("_at"), F.col("low").alias("_low"))
        state = materialise(
            state.join(b, "up", "left").select("node", F.coalesce("_up", "up").alias("up"), (F.col("pos") + F.coalesce("_pos", F.lit(0))).alias("pos"), (F.col("at") + F.coalesce("_at", F.lit(0))).alias("at"), F.least("low", F.coalesce("_low", "low")).alias("low")),
            "chain-state",
        )
        reach *= 2
        open_nodes = state.join(state.select(F.col("node").alias("up")).distinct(), "up", "left_semi")
        left = open_nodes.count()
        if not left or reach > 2 * n:
            break
    found = state.join(open_nodes.select("node"), "node", "left_anti") if left else state
    return found.select("node", F.col("up").alias("head"), "pos", "at"), open_nodes.select("node", "low") if left else None


def kept_chains(graph: Graph, ranked: DataFrame | None = None) -> DataFrame:
    """chains() of one of each two mirror images: that whose head is not after the other's; of rings, which open where
    either begins, that whose head is as written."""
    ranked = materialise(chains(graph) if ranked is None else ranked, "chains")
    w = ["head", "head_rc"]
    tails = ranked.groupBy(*w).agg(F.max_by(F.struct("id", "rc"), "pos").alias("tail"))
    rings = linear_arcs(graph).select(F.col("dst").alias("head"), F.col("dst_rc").alias("head_rc"), F.lit(True).alias("ring"))
    first = F.struct(F.col("head").alias("id"), F.col("head_rc").alias("rc")) <= F.struct(F.col("tail.id").alias("id"), (~F.col("tail.rc")).alias("rc"))
    one = tails.join(rings, w, "left").where(F.when(F.col("ring"), ~F.col("head_rc")).otherwise(first))
    return ranked.join(one.select(*w), w, "left_semi")


def contigs(graph: Graph, kept: DataFrame | None = None) -> DataFrame:
    """(head, head_rc, id, seq, n_reads, coverage, barcodes[, extension]): the sequence of each kept chain; id is its smallest member."""
    more = ["extension"] if "extension" in graph.vertices.columns else []
    kept = kept_chains(graph) if kept is None else kept
    into = linear_arcs(graph).select(F.col("dst").alias("id"), F.col("dst_rc").alias("rc"), "overlap")
    rows = kept.join(graph.vertices, "id").join(into, ["id", "rc"], "left")
    turned = F.when(F.col("rc"), dna.reverse_complement("seq")).otherwise(F.col("seq"))
    part = F.when(F.col("pos") == 0, turned).otherwise(turned.substr(F.col("overlap") + 1, F.length("seq")))
    made = rows.groupBy("head", "head_rc").agg(F.sort_array(F.collect_list(F.struct("pos", part.alias("part"), "barcodes", *more))).alias("parts"), F.min("id").alias("id"), F.count("*").alias("n_reads"), F.sum("coverage").alias("coverage"))
    return made.select("head", "head_rc", "id", F.array_join("parts.part", "").alias("seq"), "n_reads", "coverage", F.flatten("parts.barcodes").alias("barcodes"), *[F.flatten(f"parts.{c}").alias(c) for c in more])


def simplify(graph: Graph) -> Graph:
    """graph with every unbranched chain as one vertex, and the edges between chains' ends."""
    kept = materialise(kept_chains(graph), "kept")
    made = materialise(contigs(graph, kept), "contigs")
    place = kept.join(made.select("head", "head_rc", F.col("id").alias("contig")), ["head", "head_rc"]).select("id", "rc", "contig")
    used = linear_arcs(graph).join(kept.where("pos > 0").select(F.col("id").alias("dst"), F.col("rc").alias("dst_rc")), ["dst", "dst_rc"], "left_semi").select("edge_key")
    rest = graph.half_edges.join(used.distinct(), "edge_key", "left_anti")
    # A kept chain that holds the vertex as written keeps its directions; one that holds it turned swaps them.
    end = lambda c, d: (F.col(d) + F.col(f"_{c}_rc").cast("int")) % 2
    for c in ("src", "dst"):
        rest = rest.join(place.select(F.col("id").alias(c), F.col("rc").alias(f"_{c}_rc"), F.col("contig").alias(f"_{c}")), c)
    halves = rest.select("edge_key", "half", F.col("_src").alias("src"), F.col("_dst").alias("dst"), end("src", "dir").alias("dir"), end("dst", "twin_dir").alias("twin_dir"), "overlap")
    return Graph(made.select(*graph.vertices.columns), halves).cut()


def contig_statistics(sequences: DataFrame) -> DataFrame:
    """One row: n_contigs, total, longest, n50, n90 of (seq).

    Lengths are counted before they are ordered: there are far fewer of them than contigs.
    """
    lengths = sequences.groupBy(F.length("seq").alias("size")).agg(F.count("*").alias("n"))
    falling = Window.orderBy(F.desc("size"))
    sums = lengths.withColumns({"sum": F.sum(F.col("size") * F.col("n")).over(falling), "total": F.sum(F.col("size") * F.col("n")).over(Window.partitionBy())})
    at = lambda share: F.max(F.when(F.col("sum") >= F.col("total") * share, F.col("size"))).cast("long")
    return sums.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_contigs"), F.coalesce(F.sum(F.col("size") * F.col("n")), F.lit(0)).alias("total"), F.max("size").cast("long").alias("longest"), at(0.5).alias("n50"), at(0.9).alias("n90"))


def khop(graph: Graph, roots: DataFrame, hops: int) -> DataFrame:
    """(id, hop): vertices within so many edges of the roots (id), with the least number."""
    neighbours = graph.half_edges.select("src", "dst").distinct()
    seen = Rounds(roots.sparkSession, "hops")
    frontier = seen.add(roots.select("id", F.lit(0).alias("hop")).distinct())
    for hop in range(1, hops + 1):
        fresh = frontier.join(neighbours, F.col("id") == F.col("src")).select(F.col("dst").alias("id")).distinct()
        frontier = seen.add(fresh.join(seen.all().select("id"), "id", "left_anti").select("id", F.lit(hop).alias("hop")))
        if not frontier.limit(1).count():
            break
    return seen.all()


def subgraph(graph: Graph, roots: DataFrame, hops: int = 5) -> Graph:
    """What lies within so many edges of the roots, with the edges that touch a vertex nearer than that."""
    near = materialise(khop(graph, roots, hops), "near")
    inner = near.where(F.col("hop") < hops).select("id")
    keys = graph.half_edges.join(inner, F.col("src") == F.col("id"), "left_semi").select("edge_key").distinct()
    return Graph(graph.vertices.join(near.select("id"), "id", "left_semi"), graph.half_edges.join(keys, "edge_key", "left_semi"))


#: Steps that a round of walks takes from fewer places than told: a round costs more than their rows then, but its plan
#: doubles with each step.
STRIDES = ((200_000, 4),)


def walks(graph: Graph, roots: DataFrame, max_distance: int, *, first_dir: int | None = None, first: str | None = None, max_nodes: int | None = None) -> DataFrame:
    """(root, id, distance, dir, comp): where walks from the roots (id) come, with signed distances up to the step beyond max_distance.

    A step along a sense edge adds what the source has before the overlap; along an antisense edge it takes away what
    the target has before it. After an edge that changes strands the direction changes. Each place is told once. first
    is a condition on the first step (dir, and rev: 1 where strands change). With max_nodes a root has no more places than that: the nearest, ties by id, direction and strand.

    A round takes a step from all places that the round before found, or some steps where they are few; the places told
    lie in one folder and are read as one table.
    """
    size = graph.vertices.select("id", F.length("seq").alias("size"))
    steps = graph.half_edges.join(size.select(F.col("id").alias("src"), F.col("size").alias("a")), "src").join(size.select(F.col("id").alias("dst"), F.col("size").alias("b")), "dst")
    reverse = (F.col("dir") == F.col("twin_dir")).cast("int")
    length = F.when(F.col("dir") == SENSE, F.col("a") - F.col("overlap")).otherwise(F.col("b") - F.col("overlap"))
    steps = materialise(steps.select("src", "dst", "dir", reverse.alias("rev"), length.cast("long").alias("step")).distinct(), "steps")
    dirs = [SENSE, ANTISENSE] if first_dir is None else [first_dir]
    # up: the direction, seen from the root, that the walk keeps; own: that in which the present vertex is left.
    start = roots.select(F.col("id").alias("root"), "id", F.lit(0).cast("long").alias("distance"), F.explode(F.array(*map(F.lit, dirs))).alias("up")).withColumn("own", F.col("up")).distinct()
    key = ["root", "id", "distance", "up", "own"]
    seen = Rounds(roots.sparkSession, "walks")
    frontier = seen.add(start.select(*key))

    def onward(places: DataFrame, steps: DataFrame = steps) -> DataFrame:
        moved = places.where(F.abs("distance") < max_distance).join(steps, (F.col("id") == F.col("src")) & (F.col("own") == F.col("dir")))
        further = F.col("distance") + F.when(F.col("up") == SENSE, F.col("step")).otherwise(-F.col("step"))
        turned = F.when(F.col("rev") == 1, 1 - F.col("own")).otherwise(F.col("own"))
        return places.union(moved.select("root", F.col("dst").alias("id"), further, "up", turned)).distinct()

    if first is not None:
        frontier = seen.add(onward(frontier, steps.where(first)).join(seen.all(), key, "left_anti"))
    while n := frontier.count():
        fresh = onward(frontier)
        for _ in range(next((k for few, k in STRIDES if n < few), 1) - 1):
            fresh = onward(fresh)
        frontier = seen.add(fresh.join(seen.all(), key, "left_anti"))
    found = seen.all().where("id <> root or distance <> 0").select("root", "id", "distance", F.col("up").alias("dir"), F.when(F.col("up") == F.col("own"), 0).otherwise(1).alias("comp"))
    if max_nodes is None:
        return found
    nearest = Window.partitionBy("root").orderBy(F.abs("distance"), "id", "dir", "comp", "distance")
    return found.withColumn("_n", F.row_number().over(nearest)).where(F.col("_n") <= max_nodes).drop("_n")


def reaches(graph: Graph, pairs: DataFrame, max_distance: int, **kinds) -> DataFrame:
    """(root, end, distance, dir, comp) of pairs (root, end) of which a walk from root meets end: the shortest, ties by direction and strand."""
    met = walks(graph, pairs.select(F.col("root").alias("id")).distinct(), max_distance, **kinds).where(F.abs("distance") < max_distance)
    found = met.join(pairs.select("root", F.col("end").alias("id")).distinct(), ["root", "id"])
    best = found.groupBy("root", F.col("id").alias("end")).agg(F.min_by(F.struct("distance", "dir", "comp"), F.struct(F.abs("distance").alias("a"), "dir", "comp")).alias("x"))
    return best.select("root", "end", "x.distance", "x.dir", "x.comp")


def insert_sizes(graph: Graph, ranked: DataFrame | None = None) -> DataFrame:
    """(name, mate, size): distances of mates on the same chain, each pair once, name before mate."""
    kept = kept_chains(graph, ranked).select("id", "head", "head_rc", "at")
    a = kept.withColumn("mate", dna.mate_name("id")).where("mate <> '' and id < mate")
    b = kept.select(F.col("id").alias("mate"), "head", "head_rc", F.col("at").alias("_at"))
    return a.join(b, ["mate", "head", "head_rc"]).select(F.col("id").alias("name"), "mate", F.abs(F.col("at") - F.col("_at")).alias("size"))


def insert_size(sizes: DataFrame, default: tuple[int, int] = (500, 100)) -> DataFrame:
    """One row: n, mean and deviation of the sizes, cut to whole numbers; the defaults without any."""
    found = sizes.agg(F.count("*").alias("n"), F.floor(F.avg("size")).alias("mean"), F.floor(F.stddev_pop("size")).alias("deviation"))
    return found.select("n", F.coalesce("mean", F.lit(default[0])).cast("long").alias("mean"), F.coalesce("deviation", F.lit(default[1])).cast("long").alias("deviation"))


def paired_links(graph: Graph, max_distance: int, insert_delta: int = 100) -> DataFrame:
    """(src, dst, distance): vertices within max_distance whose mates are likewise linked, up to four deviations further.

    Distances are absolute; the least of each ordered pair is kept. Vertices without mate in the graph have no links.
    """
    ids = graph.vertices.select("id").withColumn("mate", dna.mate_name("id"))
    paired = materialise(ids.join(ids.select(F.col("id").alias("mate")), "mate", "left_semi"), "paired")
    reach = materialise(walks(graph, paired.select("id"), max_distance + 4 * insert_delta).select("root", "id", F.abs("distance").alias("distance")).groupBy("root", "id").agg(F.min("distance").alias("distance")), "reach")
    near = reach.where((F.col("distance") <= max_distance) & (F.col("distance") > 0) & (F.col("root") != F.col("id")))
    mate = lambda c: paired.select(F.col("id").alias(c), F.col("mate").alias(f"{c}_mate"))
    near = near.join(mate("root"), "root").join(mate("id"), "id")
    far = reach.select(F.col("root").alias("root_mate"), F.col("id").alias("id_mate"), F.col("distance").alias("_far"))
    return near.join(far, ["root_mate", "id_mate"]).where(F.col("_far") <= F.col("distance") + 4 * insert_delta).select(F.col("root").alias("src"), F.col("id").alias("dst"), "distance")


def direct_links(found: DataFrame) -> DataFrame:
    """found without those that two shorter ones make: src to some x and x on to dst."""
    a, b = found.alias("a"), found.alias("b")
    over = a.join(b, F.col("a.dst") == F.col("b.src")).select(F.col("a.src").alias("src"), F.col("b.dst").alias("dst"), F.col("a.distance").alias("_first"))
    gone = found.join(over, ["src", "dst"]).where(F.col("_first") < F.col("distance")).select("src", "dst").distinct()
    return found.join(gone, ["src", "dst"], "left_anti")


def resolve_pairs(graph: Graph, found: DataFrame) -> tuple[Graph, DataFrame]:
    """graph without the edges that compete, on a side of a vertex, with one that a link confirms."""
    sure = graph.half_edges.join(found.select("src", "dst"), ["src", "dst"], "left_semi").select("edge_key", "src", "dir")
    rivals = graph.half_edges.join(sure.select("src", "dir").distinct(), ["src", "dir"], "left_semi")
    gone = rivals.join(sure.select("edge_key").distinct(), "edge_key", "left_anti").select("edge_key").distinct()
    return graph.with_edges(graph.half_edges.join(gone, "edge_key", "left_anti")), gone


def pair_links(graph: Graph, max_distance: int, insert_delta: int = 100, max_nodes: int | None = 100) -> DataFrame:
    """(src, dst, distance, dir, comp): links that the mates of both ends confirm; the shortest of each ordered pair.

    From a vertex longer than max_distance its neighbours nearer than that (first along a sense edge, or one that
    changes strands) are kept if the vertex's mate reaches theirs nearer than four deviations beyond. They are linked
    with the vertex, and with each other where they lie on the same side and their sequences agree. A vertex has at most
    max_nodes neighbours, the nearest. Distances are told from the end from which they aren't negative.
    """
    ids = graph.vertices.select("id", F.length("seq").alias("size"), dna.mate_name("id").alias("mate"))
    paired = materialise(ids.join(ids.select(F.col("id").alias("mate")), "mate", "left_semi"), "paired")
    root = paired.where(F.col("size") > max_distance).select("id")
    near = walks(graph, root, max_distance, first=f"dir = {SENSE} or rev = 1", max_nodes=max_nodes)
    near = near.where((F.abs("distance") < max_distance) & (F.col("distance") != 0) & (F.col("root") != F.col("id")))
    far = walks(graph, paired.select("id"), max_distance + 4 * insert_delta).select("root", "id", F.abs("distance").alias("distance"))
    far = far.groupBy(F.col("root").alias("root_mate"), F.col("id").alias("id_mate")).agg(F.min("distance").alias("_far"))
    mate = lambda c: paired.select(F.col("id").alias(c), F.col("mate").alias(f"{c}_mate"))
    sure = near.join(mate("root"), "root").join(mate("id"), "id").join(far, ["root_mate", "id_mate"])
    sure = materialise(sure.where(F.col("_far") < F.abs("distance") + 4 * insert_delta).select("root", "id", "distance", "dir", "comp"), "pair-near")
    told = lambda src, dst, link: [c.alias(n) for c, n in zip(links.non_negative(src, dst, *link), ("src", "dst", "distance", "dir", "comp"), strict=True)]
    own = sure.select(*told(F.col("root"), F.col("id"), (F.col("distance"), F.col("dir"), F.col("comp"))))
    a, b = sure.alias("a"), sure.alias("b")
    both = a.join(b, F.col("a.root") == F.col("b.root")).where((F.abs("a.distance") < F.abs("b.distance")) & ~links.apart(F.col("a.distance"), F.col("b.distance")) & (F.col("a.id") != F.col("b.id")))
    link = links.between(*[F.col(f"{x}.{c}") for x in "ab" for c in ("distance", "dir", "comp")])
    across = agreeing(graph, both.select(*told(F.col("a.id"), F.col("b.id"), link)).distinct())
    least = F.min_by(F.struct("distance", "dir", "comp"), F.struct("distance", "dir", "comp")).alias("x")
    return own.union(across).groupBy("src", "dst").agg(least).select("src", "dst", "x.*")


def agreeing(graph: Graph, found: DataFrame) -> DataFrame:
    """Links (src, dst, distance, dir, comp) whose ends' sequences agree."""
    seq = lambda c: graph.vertices.select(F.col("id").alias(c), F.col("seq").alias(f"_{c}"))
    both = found.join(seq("src"), "src").join(seq("dst"), "dst")
    sure = links.holds(F.col("_src"), F.col("_dst"), F.col("distance"), F.col("dir"), F.col("comp"))
    return both.where(sure).select("src", "dst", "distance", "dir", "comp")


def nearest_links(graph: Graph, found: DataFrame) -> DataFrame:
    """found without the links of a vertex that follow from a nearer one of the same direction: its end links on to theirs."""
    order = lambda x: F.struct(F.col(f"{x}.distance").alias("d"), F.col(f"{x}.dst").alias("t"))
    a, b = found.alias("a"), found.alias("b")
    pairs = a.join(b, (F.col("a.src") == F.col("b.src")) & (F.col("a.dir") == F.col("b.dir"))).where(order("a") < order("b"))
    link = links.between(*[F.col(f"{x}.{c}") for x in "ab" for c in ("distance", "dir", "comp")])
    told = links.non_negative(F.col("a.dst"), F.col("b.dst"), *link)
    asked = pairs.select(F.col("b.src").alias("root"), F.col("b.dst").alias("far"), *[c.alias(n) for c, n in zip(told, ("src", "dst", "distance", "dir", "comp"), strict=True)])
    keys = ["src", "dst", "distance", "dir", "comp"]
    sure = agreeing(graph, asked.select(*keys).distinct())
    gone = asked.join(sure, keys).select(F.col("root").alias("src"), F.col("far").alias("dst")).distinct()
    return found.join(gone, ["src", "dst"], "left_anti")


def with_links(graph: Graph, found: DataFrame) -> tuple[Graph, DataFrame, DataFrame]:
    """(graph, edges added, keys removed): links become true edges, and edges that compete with true ones go.

    A link confirms the edge that leaves src on its side with the same overlap, or adds one. Then, on every side of a
    vertex that has a true edge, all others go, and those that cover a vertex whole.
    """
    size = lambda c: graph.vertices.select(F.col("id").alias(c), F.length("seq").alias(f"_{c}"))
    asked = found.join(size("src"), "src").join(size("dst"), "dst")
    asked = asked.withColumn("overlap", (F.when(F.col("dir") == SENSE, F.col("_src")).otherwise(F.col("_dst")) - F.col("distance")).cast("int"))
    asked = asked.where((F.col("overlap") > 0) & (F.col("overlap") < F.col("_src")) & (F.col("overlap") < F.col("_dst")))
    asked = materialise(asked.select("src", "dst", "dir", F.when(F.col("comp") == 1, F.col("dir")).otherwise(1 - F.col("dir")).alias("twin_dir"), "overlap"), "true-links")
    keys = ["src", "dst", "dir", "twin_dir", "overlap"]
    known = graph.half_edges.join(asked, keys, "left_semi").select("edge_key").distinct()
    fresh = asked.join(graph.half_edges.select(*keys), keys, "left_anti")
    # Both ends may ask for the same edge: the smaller one, or that which leaves its end, adds it.
    swap = F.struct("dst", F.col("twin_dir").alias("d")) < F.struct(F.col("src").alias("dst"), F.col("dir").alias("d"))
    turn = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x)).alias(x)
    fresh = fresh.select(turn("src", "dst"), turn("dst", "src"), turn("dir", "twin_dir"), turn("twin_dir", "dir"), "overlap").distinct()
    fresh = fresh.withColumn("edge_key", F.concat_ws(" ", F.lit("+"), "src", "dst", "dir", "twin_dir", "overlap"))
    half = lambda h, s, d, x, y: F.struct(F.lit(h).alias("half"), F.col(s).alias("src"), F.col(d).alias("dst"), F.col(x).alias("dir"), F.col(y).alias("twin_dir"), "overlap")
    added = fresh.select("edge_key", F.explode(F.array(half(0, "src", "dst", "dir", "twin_dir"), half(1, "dst", "src", "twin_dir", "dir"))).alias("h")).select("edge_key", "h.*")
    added = materialise(added, "true-edges")
    whole = graph.half_edges.unionByName(added.select(*graph.half_edges.columns))
    true = materialise(known.union(added.select("edge_key")).distinct(), "true-keys")
    sides = whole.join(true, "edge_key", "left_semi").select("src", "dir").distinct()
    gone = whole.join(sides, ["src", "dir"], "left_semi").join(true, "edge_key", "left_anti").select("edge_key").distinct()
    return graph.with_edges(whole.join(gone, "edge_key", "left_anti")), added, gone


def reduced(graph: Graph) -> DataFrame:
    """Half-edges of which one stays of those that leave a vertex on a side with equal overlap and equal rest of their end."""
    seq = graph.vertices.select(F.col("id").alias("dst"), F.col("seq").alias("_seq"))
    rest = F.when(F.col("twin_dir") == ANTISENSE, F.col("_seq").substr(F.col("overlap") + 1, F.length("_seq"))).otherwise(F.col("_seq").substr(F.lit(1), (F.length("_seq") - F.col("overlap")).cast("int")))
    label = F.when(F.col("dir") == F.col("twin_dir"), dna.reverse_complement(rest)).otherwise(rest)
    w = Window.partitionBy("src", "dir", "overlap", "_label").orderBy("dst", "edge_key")
    rows = graph.half_edges.join(seq, "dst").withColumn("_label", F.xxhash64(label)).withColumn("_r", F.row_number().over(w))
    return rows.where("_r = 1").select(*graph.half_edges.columns)


def split_repeats(graph: Graph, threshold: float, n: int = scores.READS, genome: int = scores.GENOME) -> tuple[Graph, DataFrame]:
    """(graph, copies (id, end, dir)): unique vertices whose only neighbour on a side is a branching repeat get a copy of it.

    The copy leaves on that side as the repeat does; the edge from the vertex to the repeat goes to the copy. One vertex
    takes a copy on one side at a time, and a repeat gives one for each.
    """
    score = graph.vertices.select("id", scores.repeatness(F.length("seq"), F.col("coverage"), n, genome).alias("score"))
    degree = graph.half_edges.groupBy("src", "dir").agg(F.count("*").alias("n"))
    single = graph.half_edges.join(degree.where("n = 1").select("src", "dir"), ["src", "dir"], "left_semi")
    branching = degree.where("n > 1").select(F.col("src").alias("dst")).distinct()
    rows = single.join(branching, "dst", "left_semi").join(score.select(F.col("id").alias("src"), F.col("score").alias("_own")), "src").join(score.select(F.col("id").alias("dst"), F.col("score").alias("_end")), "dst")
    rows = rows.where((F.col("_own") >= threshold) & (F.col("_end") < F.col("_own")) & (F.col("src") != F.col("dst")))
    once = Window.partitionBy("src").orderBy("dir")
    rows = rows.withColumn("_r", F.row_number().over(once)).where("_r = 1")
    rows = materialise(rows.select("edge_key", "half", F.col("src").alias("v"), F.col("dst").alias("end"), "dir", "twin_dir", "overlap", F.concat_ws("_", "dst", F.lit("copy"), "src").alias("copy")), "repeat-copies")
    held = graph.vertices.join(rows.select(F.col("end").alias("id"), "copy"), "id").withColumn("id", F.col("copy")).drop("copy").select(*graph.vertices.columns)
    # The side of the repeat that faces away from the vertex.
    leaving = graph.half_edges.join(rows.select(F.col("end").alias("src"), (1 - F.col("twin_dir")).alias("dir"), "copy"), ["src", "dir"])
    leaving = leaving.select(F.concat_ws(" ", "edge_key", "copy").alias("edge_key"), F.col("copy").alias("src"), "dst", "dir", "twin_dir", "overlap")
    joined = rows.select(F.concat_ws(" ", "edge_key", "copy").alias("edge_key"), F.col("v").alias("src"), F.col("copy").alias("dst"), "dir", "twin_dir", "overlap")
    fresh = leaving.union(joined)
    halves = fresh.withColumn("half", F.lit(0)).unionByName(fresh.select("edge_key", F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("twin_dir").alias("dir"), F.col("dir").alias("twin_dir"), "overlap").withColumn("half", F.lit(1)))
    rest = graph.half_edges.join(rows.select("edge_key").distinct(), "edge_key", "left_anti")
    whole = rest.unionByName(halves.select(*rest.columns))
    return Graph(graph.vertices.unionByName(held), whole), rows.select(F.col("v").alias("id"), "end", "dir")


def placed(contigs: DataFrame, reference: DataFrame, *, both_strands: bool = False) -> DataFrame:
    """(name, ref, start, end, turned) of every exact occurrence of contigs (name, seq) in reference (name, seq); half-open.

    Contigs meet the reference by a hash of as many bases as the shortest has, and are then compared with the stretch of
    it that lies there; the reference is cut in overlapping pieces, so that no row holds more than one.
    """
    sizes = contigs.where("seq <> ''").agg(F.min(F.length("seq")).alias("least"), F.max(F.length("seq")).alias("most")).first()
    kind = "name string, ref string, start long, end long, turned boolean"
    if sizes.least is None:
        return contigs.sparkSession.createDataFrame([], kind)
    k, piece = sizes.least, max(1 << 16, sizes.most)
    strands = [F.struct(F.col("seq").alias("text"), F.lit(False).alias("turned"))] + [F.struct(dna.reverse_complement("seq").alias("text"), F.lit(True).alias("turned"))] * both_strands
    asked = contigs.where("seq <> ''").select("name", F.explode(F.array(*strands)).alias("s")).select("name", "s.*", F.xxhash64(F.left("s.text", F.lit(k))).alias("key"))
    cut = reference.where(F.length("seq") >= k).select(F.col("name").alias("ref"), "seq", F.explode(F.expr(f"sequence(0, (length(seq) - 1) div {piece})")).alias("part"))
    cut = materialise(cut.select("ref", "part", F.substring("seq", F.col("part") * piece + 1, F.lit(piece + sizes.most - 1)).alias("stretch")), "reference-pieces")
    spots = cut.where(F.length("stretch") >= k).select("ref", "part", "stretch", F.explode(F.expr(f"sequence(1, least({piece}, length(stretch) - {k} + 1))")).alias("p"))
    spots = spots.select("ref", "part", "p", F.xxhash64(F.expr(f"substr(stretch, p, {k})")).alias("key"))
    met = spots.join(asked, "key").join(cut, ["ref", "part"]).where(F.expr("substr(stretch, p, length(text))") == F.col("text"))
    start = F.col("part").cast("long") * piece + F.col("p") - 1
    return met.select("name", "ref", start.alias("start"), (start + F.length("text")).alias("end"), "turned")


def covered(found: DataFrame) -> DataFrame:
    """(ref, start, end) of the stretches of the reference that placements (ref, start, end) cover, merged where they touch."""
    w = Window.partitionBy("ref").orderBy("start", "end")
    marked = found.select("ref", "start", "end").distinct().withColumn("_upto", F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    marked = marked.withColumn("_no", F.count_if(F.col("_upto").isNull() | (F.col("start") > F.col("_upto"))).over(w))
    return marked.groupBy("ref", "_no").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_no")


def repeat_scores(graph: Graph, n: int = scores.READS, genome: int = scores.GENOME) -> DataFrame:
    size = F.length("seq")
    return graph.vertices.select("id", scores.uniqueness(size, F.col("coverage"), n, genome).alias("uniqueness"), scores.repeatness(size, F.col("coverage"), n, genome).alias("repeatness"), scores.point_coverage(F.col("coverage"), size).alias("point"))
