"""Command line: python -m contigua.cli COMMAND [options]. Options can also stand in an INI file (--config)."""

from __future__ import annotations

import argparse
import configparser
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .graph import features, model, paths
from .operators import correct, dedup, index, kmers, match, ordered, overlap, preprocess, preqc
from .plans import assemble
from .plans.storage import materialise
from .sources import asqg, fastx, index_files, simulate


def _preprocess(spark, a):
    reads = fastx.read(spark, a.input)
    pairs = a.pe_mode
    if pairs == 1:
        reads = preprocess.zipped(reads, fastx.read(spark, a.second))
    elif pairs == 2:
        reads = preprocess.paired(reads)
    if a.with_index:
        codes = fastx.read(spark, a.with_index).select("read_idx", F.col("seq").alias("barcode"))
        reads = preprocess.with_barcodes(reads, codes)
    o = preprocess.Options(pairs=pairs, orientation=a.pe_orientation, phred64=a.phred64, quality_trim=a.quality_trim, quality_filter=a.quality_filter, min_length=a.min_length, hard_clip=a.hard_clip, sample_rate=a.sample_rate, primer_check=not a.no_primer_check, with_index=bool(a.with_index))
    fastx.write(preprocess.filtered(reads, o), a.output, compression=a.compression)
    preprocess.statistics(reads, o).show(truncate=False)


def _index(spark, a):
    reads = fastx.read(spark, a.input, columns=("read_idx", "seq"))
    for name, reverse in (("forward", False), ("reverse", True)):
        if getattr(a, f"no_{name}"):
            continue
        found = materialise(index.suffixes(reads, reverse=reverse, algorithm=a.algorithm), "suffixes")
        runs = materialise(index.runs(found), "runs")
        found.write.mode("overwrite").parquet(f"{a.output}/{name}-suffixes")
        runs.write.mode("overwrite").parquet(f"{a.output}/{name}-runs")
        ending = "r" * reverse
        index_files.write_sai(index.read_ranks(found), f"{a.output}/index.{ending}sai")
        index_files.write_bwt(runs, reads.count(), f"{a.output}/index.{ending}bwt")


def _correct(spark, a):
    reads = fastx.read(spark, a.input)
    fastx.write(correct.correct(reads, k=a.kmer_size, threshold=a.kmer_threshold, rounds=a.kmer_rounds, offset=a.kmer_count_offset, algorithm=a.algorithm), a.output, compression=a.compression)


def _overlap(spark, a):
    reads = fastx.read(spark, a.input)
    edges = overlap.string_graph(reads, a.min_overlap, reduce=not a.exhaustive, both_strands=not a.no_opposite_strand)
    within = overlap.containments(reads).where("substring = 1").select(F.col("name").alias("id"))
    asqg.write(model.build(asqg.from_comments(reads), edges), a.output, contained=within, overlap=a.min_overlap, input=a.input)


def _assemble(spark, a):
    graph = asqg.load(spark, a.input, min_overlap=a.min_overlap)
    done = assemble.assemble(graph, assemble.Options(pairs=a.pe_mode == 1, rounds=a.cut_terminal, min_branch_length=a.min_branch_length, max_overlap_delta=a.max_overlap_delta, max_overlap_carefully=a.max_overlap_carefully, min_chimeric_length=a.min_chimeric_length, max_distance=a.max_distance, insert_size=a.insert_size, insert_delta=a.insert_size_delta, genome=a.genome_size))
    fastx.write(fastx.contig_records(done.graph.vertices), f"{a.output}-contigs.fa")
    asqg.write(done.graph, f"{a.output}-graph.asqg.gz")
    paths.contig_statistics(done.contigs).show(truncate=False)


def _subgraph(spark, a):
    graph = asqg.load(spark, a.input, max_edges=128)
    roots = graph.vertices.where(F.col("id") == a.root).select("id")
    asqg.write(paths.subgraph(graph, roots, a.size), a.output)


def _gan(spark, a):
    graph = asqg.load(spark, a.input)
    reference = fastx.read(spark, a.reference).select("seq") if a.reference else None
    labels = materialise(features.labels(graph, asqg.alignments(graph.vertices), reference), "labels")
    rows = features.edge_features(graph, genome=a.genome_size).join(labels, ["edge_key", "half"])
    rows.select("label", "x", "y", *features.FEATURES).write.mode("overwrite").csv(f"{a.output}-features", sep="\t", header=True)
    kept = model.sweep(model.coloured(graph, labels.where("label = 0"), model.BLACK))
    asqg.write(kept, f"{a.output}-graph.asqg.gz")


def _simulate(spark, a):
    genome = fastx.read(spark, a.input).select("name", F.upper("seq").alias("seq"))
    pairs = simulate.paired_reads(genome, length=a.length, coverage=a.coverage, insert=a.insert_size, sigma=a.sigma, seed=a.seed)
    for mate in (0, 1):
        fastx.write(pairs.where(F.col("mate") == mate), f"{a.output}.{mate + 1}.fa")


def _place(spark, a):
    contigs = fastx.read(spark, a.input)
    found = materialise(paths.placed(contigs, fastx.read(spark, a.reference), both_strands=a.both_strands), "placed")
    paths.covered(found).write.mode("overwrite").csv(f"{a.output}-covered", sep="\t", header=True)
    missing = contigs.join(found.select("name").distinct(), "name", "left_anti")
    fastx.write(missing.select(*contigs.columns), f"{a.output}-unplaced.fa")
    paths.contig_statistics(contigs).show(truncate=False)


def _rmdup(spark, a):
    reads = fastx.read(spark, a.input)
    kept, dropped = dedup.rmdup(reads)
    ranks = ordered.global_rank(reads.select("seq", "read_idx"), "seq", "read_idx").select("read_idx", "rank")
    for records, name in zip(fastx.duplicate_records(kept, dropped, ranks), ("kept", "dups"), strict=True):
        fastx.write(records, f"{a.output}.{name}.fa")


def _preqc(spark, a):
    print(preqc.report(fastx.read(spark, a.input), a.kmer_size, a.sample_rate).first().json)


def _match(spark, a):
    reads = fastx.read(spark, a.input)
    queries = fastx.read(spark, a.queries or a.input)
    asked = match.ends(queries, a.length) if a.length else queries.select("name", F.lit(0).alias("end"), "seq")
    found = match.occurrences(asked, reads, opposite_strand=not a.no_opposite_strand)
    found.select(F.concat_ws("\t", F.lit("VT"), "end", "name", "seq", "count")).write.mode("overwrite").text(a.output)


def _kmers(spark, a):
    kmers.spectrum(kmers.counts(fastx.read(spark, a.input), a.kmer_size)).orderBy("n").write.mode("overwrite").csv(a.output, sep="\t")


def _dot(spark, a):
    asqg.graphviz_lines(asqg.load(spark, a.input)).write.mode("overwrite").text(a.output)


#: Command: (function, options with defaults; True and False are flags, a type has no default).
COMMANDS = {
    "preprocess": (_preprocess, {"pe-mode": 0, "pe-orientation": "fr", "second": str, "with-index": str, "phred64": False, "quality-trim": 0, "quality-filter": -1, "min-length": 40, "hard-clip": 0, "sample-rate": 1.0, "no-primer-check": False, "compression": str}),
    "index": (_index, {"algorithm": "sais2", "no-forward": False, "no-reverse": False}),
    "correct": (_correct, {"algorithm": "kmer", "kmer-size": 31, "kmer-threshold": 3, "kmer-rounds": 10, "kmer-count-offset": 1, "compression": str}),
    "overlap": (_overlap, {"min-overlap": overlap.MIN_OVERLAP, "exhaustive": False, "no-opposite-strand": False}),
    "assemble": (_assemble, {"min-overlap": 0, "pe-mode": 0, "cut-terminal": 10, "min-branch-length": 150, "max-overlap-delta": 0, "max-overlap-carefully": False, "min-chimeric-length": 0, "max-distance": 500, "insert-size": int, "insert-size-delta": int, "genome-size": assemble.Options.genome}),
    "subgraph": (_subgraph, {"root": str, "size": 5}),
    "gan": (_gan, {"reference": str, "genome-size": assemble.Options.genome}),
    "simulate": (_simulate, {"length": 150, "coverage": 50, "insert-size": 1000, "sigma": 100, "seed": 0}),
    "place": (_place, {"reference": str, "both-strands": False}),
    "rmdup": (_rmdup, {}),
    "preqc": (_preqc, {"kmer-size": 31, "sample-rate": preqc.SAMPLE_RATE}),
    "match": (_match, {"queries": str, "length": 0, "no-opposite-strand": False}),
    "kmers": (_kmers, {"kmer-size": 31}),
    "dot": (_dot, {}),
}


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="contigua", description=__doc__)
    commands = out.add_subparsers(dest="command", required=True)
    for name, (_, options) in COMMANDS.items():
        p = commands.add_parser(name)
        p.add_argument("input")
        p.add_argument("-o", "--output", default="out")
        p.add_argument("--config")
        for option, default in options.items():
            if default is False:
                p.add_argument(f"--{option}", action="store_true")
            elif isinstance(default, type):
                p.add_argument(f"--{option}", type=default)
            else:
                p.add_argument(f"--{option}", type=type(default), default=default)
    return out


def parsed(args: list[str]) -> argparse.Namespace:
    """Arguments; those of an INI file's section for the command come first, the command line's own win."""
    p = parser()
    a = p.parse_args(args)
    if a.config:
        file = configparser.ConfigParser()
        file.read(a.config)
        own = [x for k, v in (file[a.command].items() if a.command in file else ()) for x in ([f"--{k}"] if v.lower() in ("true", "yes") else [f"--{k}", v])]
        a = p.parse_args([args[0], *own, *args[1:]])
    return a


def main(args: list[str] | None = None) -> int:
    a = parsed(sys.argv[1:] if args is None else args)
    COMMANDS[a.command][0](SparkSession.builder.appName(f"contigua {a.command}").getOrCreate(), a)
    return 0


if __name__ == "__main__":
    sys.exit(main())
