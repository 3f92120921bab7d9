"""FASTA and FASTQ files, plain or compressed, as tables of reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dna
from .text import numbered_lines, running_count

READS = "read_idx long, name string, seq string, quality string, comment string"


def sniff(spark: SparkSession, path: str) -> str:
    """fastq or fasta, by the first character of the first line."""
    first = spark.read.text(path).where("trim(value) <> ''").limit(1).collect()
    kind = {"@": "fastq", ">": "fasta"}.get(first[0].value.strip()[:1] if first else "")
    if kind is None:
        raise ValueError(f"{path} is neither FASTA nor FASTQ")
    return kind


def _indexed(records: DataFrame) -> DataFrame:
    """records (file, rec, ...) with read_idx: files by address, then records in order."""
    sizes = records.groupBy("file").agg((F.max("rec") + 1).alias("_n"))
    first = sizes.select("file", (F.sum("_n").over(Window.orderBy("file")) - F.col("_n")).alias("_first"))
    return records.join(first, "file").withColumn("read_idx", F.col("_first") + F.col("rec"))


def _named(records: DataFrame) -> DataFrame:
    name, comment = dna.split_header("header")
    return _indexed(records).select("read_idx", name.alias("name"), "seq", "quality", comment.alias("comment"))


def read_fastq(spark: SparkSession, paths: str | list[str], *, mode: str = "stop") -> DataFrame:
    """Reads of four lines each. A record is bad if its first line lacks @, its third is neither + alone nor + and ends
    with the name, or quality and sequence differ in length. mode: stop ends each file at its first bad record, drop
    leaves bad ones out, fail raises when they are met."""
    lines = numbered_lines(spark, paths)
    part = lambda k: F.max(F.when(F.col("line_no") % 4 == k, F.col("value")))
    rec = lines.groupBy("file", F.expr("line_no div 4").alias("rec")).agg(*[part(k).alias(f"l{k}") for k in range(4)])
    name, _ = dna.split_header(F.substring("l0", 2, 1 << 30))
    good = F.col("l0").startswith("@") & F.col("l2").startswith("+") & ((F.col("l2") == "+") | F.endswith(F.col("l2"), name)) & (F.length("l1") == F.length("l3"))
    rec = rec.withColumn("good", F.coalesce(good, F.lit(False)))
    if mode == "fail":
        rec = rec.where(F.when(F.col("good"), True).otherwise(F.raise_error(F.concat(F.lit("bad FASTQ record "), F.col("rec"), F.lit(" in "), F.col("file")))))
    elif mode == "stop":
        bad = rec.where(~F.col("good")).groupBy("file").agg(F.min("rec").alias("_bad"))
        rec = rec.join(bad, "file", "left").where(F.col("_bad").isNull() | (F.col("rec") < F.col("_bad")))
    else:
        rec = rec.where("good")
    return _named(rec.select("file", "rec", F.expr("substr(l0, 2)").alias("header"), F.col("l1").alias("seq"), F.col("l3").alias("quality")))


def read_fasta(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Reads whose sequence may span lines; a header without any ends its file."""
    lines = running_count(numbered_lines(spark, paths), F.col("value").startswith(">")).where("n > 0")
    body = F.sort_array(F.collect_list(F.when(~F.col("value").startswith(">"), F.struct("line_no", "value"))))
    rec = lines.groupBy("file", (F.col("n") - 1).alias("rec")).agg(F.max(F.when(F.col("value").startswith(">"), F.expr("substr(value, 2)"))).alias("header"), body.alias("b"))
    rec = rec.select("file", "rec", "header", F.array_join("b.value", "").alias("seq"), F.lit(None).cast("string").alias("quality"))
    bad = rec.where("seq = ''").groupBy("file").agg(F.min("rec").alias("_bad"))
    return _named(rec.join(bad, "file", "left").where(F.col("_bad").isNull() | (F.col("rec") < F.col("_bad"))))


def read(spark: SparkSession, path: str, *, format: str | None = None, columns: tuple[str, ...] | None = None) -> DataFrame:
    """Reads of a file of either kind; columns not asked for aren't assembled."""
    kind = format or sniff(spark, path)
    df = read_fastq(spark, path) if kind == "fastq" else read_fasta(spark, path)
    return df.select(*columns) if columns else df


def lines(reads: DataFrame) -> DataFrame:
    """(read_idx, value): a record's text, FASTQ where there are qualities, else FASTA."""
    header = F.concat_ws(" ", "name", F.when(F.col("comment") != "", F.col("comment")))
    fastq = F.concat(F.lit("@"), header, F.lit("\n"), "seq", F.lit("\n+\n"), "quality")
    return reads.select("read_idx", F.when(F.coalesce(F.col("quality"), F.lit("")) != "", fastq).otherwise(F.concat(F.lit(">"), header, F.lit("\n"), "seq")).alias("value"))


def write(reads: DataFrame, path: str, *, compression: str | None = None) -> None:
    """Writes part files in read order; compression is gzip, bzip2 or none."""
    ordered = lines(reads).repartitionByRange("read_idx").sortWithinPartitions("read_idx").select("value")
    ordered.write.mode("overwrite").text(path, compression=compression or "none")


def stem(path: str) -> str:
    """File name without folders, compression and format endings."""
    name = path.rstrip("/").rsplit("/", 1)[-1]
    for ending in (".gz", ".bz2"):
        name = name.removesuffix(ending)
    return name.rsplit(".", 1)[0] if "." in name else name


def contig_records(vertices: DataFrame) -> DataFrame:
    """Contigs (id, seq, coverage, barcodes[, extension]) as reads to write: coverage above 1, barcodes and extension stand in the comment."""
    bx = F.array_join(F.transform("barcodes", lambda b: F.concat(b["bx"], F.lit("!"), b["n"])), ",")
    tags = [F.when(F.col("coverage") > 1, F.concat(F.lit("CR:i:"), "coverage")), F.when(bx != "", F.concat(F.lit("BX:Z:"), bx))]
    if "extension" in vertices.columns:
        tags.append(F.when(F.size("extension") > 0, F.concat(F.lit("EX:Z:"), F.array_join("extension", ","))))
    comment = F.concat_ws(" ", *tags)
    return vertices.select(F.xxhash64("id").alias("read_idx"), F.col("id").alias("name"), "seq", F.lit(None).cast("string").alias("quality"), comment.alias("comment"))


def duplicate_records(kept: DataFrame, dropped: DataFrame, ranks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reads to write of rmdup: kept ones as name and comment, dropped ones with their rank (read_idx, rank) in the name."""
    note = F.concat(F.col("_name"), F.lit(" NumDuplicates="), F.col("n_duplicates"))
    a = kept.withColumn("_name", F.col("name")).select("read_idx", "name", "seq", "quality", note.alias("comment"))
    b = dropped.join(ranks, "read_idx").withColumn("_name", F.col("name"))
    return a, b.select("read_idx", F.concat("name", F.lit(",seqrank="), "rank").alias("name"), "seq", "quality", note.alias("comment"))
