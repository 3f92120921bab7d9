"""The string graph: vertices (id, seq, coverage, barcodes[, extension]) and half-edges, two for each overlap.

A half-edge (edge_key, half, src, dst, dir, twin_dir, overlap) leaves src at its end (dir 0, sense) or its start (dir 1,
antisense); its twin has the same edge_key and the other half. Strands change (comp 1) where both ends are alike. The
overlap's interval on src follows from dir and the sequence's length. extension holds what a file says of alignments.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import coords, dna
from ..plans.storage import materialise

SENSE, ANTISENSE = 0, 1
NO_BARCODES = "array<struct<bx:string,n:bigint>>"


@dataclass(frozen=True)
class Graph:
    vertices: DataFrame
    half_edges: DataFrame

    def cut(self) -> Graph:
        """Written and read again: what a round of an iterative plan ends with."""
        return Graph(materialise(self.vertices, "vertices"), materialise(self.half_edges, "half-edges"))

    def with_edges(self, half_edges: DataFrame) -> Graph:
        return replace(self, half_edges=half_edges)


def vertices_of(reads: DataFrame) -> DataFrame:
    """Vertices of reads (name, seq[, coverage, barcodes, extension])."""
    coverage = F.col("coverage").cast("long") if "coverage" in reads.columns else F.lit(1).cast("long")
    barcodes = F.col("barcodes") if "barcodes" in reads.columns else F.array().cast(NO_BARCODES)
    more = ["extension"] if "extension" in reads.columns else []
    return reads.select(F.col("name").alias("id"), "seq", coverage.alias("coverage"), barcodes.alias("barcodes"), *more)


def half_edges_of(edges: DataFrame) -> DataFrame:
    """Two half-edges for each proper overlap of edges: at the end of one read and the start or end of the other."""
    half = lambda a, b, h: F.struct(F.lit(h).alias("half"), F.col(f"id{a}").alias("src"), F.col(f"id{b}").alias("dst"), F.when(F.col(f"s{a}") == 0, ANTISENSE).otherwise(SENSE).alias("dir"), F.when(F.col(f"s{b}") == 0, ANTISENSE).otherwise(SENSE).alias("twin_dir"), (F.col("e0") - F.col("s0") + 1).cast("int").alias("overlap"))
    key = F.concat_ws(" ", "id0", "id1", "s0", "s1")
    proper = edges.where(coords.is_extreme(F.col("s0"), F.col("e0"), F.col("l0")) & coords.is_extreme(F.col("s1"), F.col("e1"), F.col("l1")))
    proper = proper.where(~coords.is_contained(F.col("s0"), F.col("e0"), F.col("l0")) & ~coords.is_contained(F.col("s1"), F.col("e1"), F.col("l1")))
    return proper.select(key.alias("edge_key"), F.explode(F.array(half(0, 1, 0), half(1, 0, 1))).alias("h")).select("edge_key", "h.*")


def containment_halves(edges: DataFrame) -> DataFrame:
    """Four half-edges, two edges, for each overlap that covers a read whole: it has no direction, so either is there.

    Their keys end with the direction; contained_ids() tells the vertices to mark. Cleaning and chains want none of them.
    """
    key = F.concat_ws(" ", "id0", "id1", "s0", "s1")
    extreme = edges.where(coords.is_extreme(F.col("s0"), F.col("e0"), F.col("l0")) & coords.is_extreme(F.col("s1"), F.col("e1"), F.col("l1")))
    whole = extreme.where(coords.is_contained(F.col("s0"), F.col("e0"), F.col("l0")) | coords.is_contained(F.col("s1"), F.col("e1"), F.col("l1")))
    half = lambda h, a, b, d: F.struct(F.lit(str(d)).alias("way"), F.lit(h).alias("half"), F.col(f"id{a}").alias("src"), F.col(f"id{b}").alias("dst"), F.lit(d).alias("dir"), F.lit(d).alias("twin_dir"), (F.col("e0") - F.col("s0") + 1).cast("int").alias("overlap"))
    rows = whole.select(key.alias("_key"), F.explode(F.array(*[half(h, h, 1 - h, d) for d in (SENSE, ANTISENSE) for h in (0, 1)])).alias("h"))
    return rows.select(F.concat_ws(" ", "_key", "h.way").alias("edge_key"), "h.half", "h.src", "h.dst", "h.dir", "h.twin_dir", "h.overlap")


def contained_ids(edges: DataFrame) -> DataFrame:
    """(id) of vertices that an edge places wholly within another."""
    side = coords.contained_side(*map(F.col, ("s0", "e0", "l0", "s1", "e1", "l1", "id0", "id1")))
    return edges.select(F.when(side == 0, F.col("id0")).when(side == 1, F.col("id1")).alias("id")).where("id is not null").distinct()


def build(reads: DataFrame, edges: DataFrame, *, min_overlap: int = 0, max_edges: int | None = None, strict: bool = False) -> Graph:
    """A graph of reads and edges of at least min_overlap. Edges without both vertices are left out; strict refuses them."""
    vertices = vertices_of(reads)
    halves = half_edges_of(edges.where(F.col("e0") - F.col("s0") + 1 >= min_overlap))
    ids = vertices.select("id")
    bad = halves.join(ids, F.col("src") == F.col("id"), "left_anti").select("edge_key").distinct()
    if strict and bad.limit(1).count():
        raise ValueError("edges of unknown vertices")
    graph = Graph(vertices, halves.join(bad, "edge_key", "left_anti"))
    return graph if max_edges is None else cap_edges(graph, max_edges)


def cap_edges(graph: Graph, most: int) -> Graph:
    """At most so many edges on each side of a vertex, the longest overlaps first; an edge stays if both ends allow it."""
    from pyspark.sql import Window

    best = Window.partitionBy("src", "dir").orderBy(F.desc("overlap"), "dst", "edge_key")
    over = graph.half_edges.withColumn("_r", F.row_number().over(best)).where(F.col("_r") > most).select("edge_key").distinct()
    return without_edges(graph, over)


def without_edges(graph: Graph, keys: DataFrame) -> Graph:
    """graph without the edges of (edge_key), both halves."""
    return graph.with_edges(graph.half_edges.join(keys.select("edge_key").distinct(), "edge_key", "left_anti"))


def without_vertices(graph: Graph, ids: DataFrame) -> Graph:
    """graph without the vertices of (id) and what touches them."""
    ids = ids.select("id").distinct()
    touched = graph.half_edges.join(ids, F.col("src") == F.col("id"), "left_semi").select("edge_key").distinct()
    return replace(without_edges(graph, touched), vertices=graph.vertices.join(ids, "id", "left_anti"))


#: What a predicate makes of an edge; sweep() takes the black ones away.
GREY, WHITE, BLACK = "grey", "white", "black"


def coloured(graph: Graph, keys: DataFrame, colour: str) -> Graph:
    """graph whose half-edges have a colour: the given one for both halves of the edges of (edge_key), grey if they had none."""
    own = graph.half_edges if "colour" in graph.half_edges.columns else graph.half_edges.withColumn("colour", F.lit(GREY))
    marked = keys.select("edge_key").distinct().withColumn("_marked", F.lit(True))
    return graph.with_edges(own.join(marked, "edge_key", "left").withColumn("colour", F.when(F.col("_marked"), F.lit(colour)).otherwise(F.col("colour"))).drop("_marked"))


def sweep(graph: Graph, colour: str = BLACK) -> Graph:
    """graph without the edges of a colour, and without colours."""
    return graph.with_edges(graph.half_edges.where(F.col("colour") != colour).drop("colour"))


def degrees(graph: Graph) -> DataFrame:
    """(id, sense, antisense) of every vertex."""
    own = graph.half_edges.groupBy("src").agg(F.count_if(F.col("dir") == SENSE).alias("sense"), F.count_if(F.col("dir") == ANTISENSE).alias("antisense"))
    nil = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return graph.vertices.select("id").join(own, F.col("id") == F.col("src"), "left").select("id", nil("sense"), nil("antisense"))


def statistics(graph: Graph) -> DataFrame:
    """One row of counts: vertices, edges (halves), islands, tips, vertices that branch on one side or both, simple ones."""
    s, a = F.col("sense"), F.col("antisense")
    return degrees(graph).agg(
        F.count("*").alias("vertices"),
        F.coalesce(F.sum(s + a), F.lit(0)).cast("long").alias("edges"),
        F.count_if((s == 0) & (a == 0)).alias("islands"),
        F.count_if((s == 0) != (a == 0)).alias("tips"),
        F.count_if((s > 1) != (a > 1)).alias("monobranch"),
        F.count_if((s > 1) & (a > 1)).alias("dibranch"),
        F.count_if((s == 1) | (a == 1)).alias("simple"),
    )


def violations(graph: Graph) -> DataFrame:
    """Edges (edge_key, src, dst) whose overlapping bases differ."""
    seq = graph.vertices.select("id", "seq")
    rows = graph.half_edges.where("half = 0").join(seq.select(F.col("id").alias("src"), F.col("seq").alias("a")), "src").join(seq.select(F.col("id").alias("dst"), F.col("seq").alias("b")), "dst")
    part = lambda q, d: F.when(F.col(d) == SENSE, F.right(q, F.col("overlap"))).otherwise(F.left(q, F.col("overlap")))
    a, b = part("a", "dir"), part("b", "twin_dir")
    return rows.where(a != F.when(F.col("dir") == F.col("twin_dir"), dna.reverse_complement(b)).otherwise(b)).select("edge_key", "src", "dst")
