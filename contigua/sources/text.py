"""Lines of text files in their order, whatever the number of splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def numbered_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, line_no, value): the lines of each file that aren't blank, trimmed, numbered from 0.

    Lines are counted by split (a row for each), then numbered within splits; compressed files are one split each.
    """
    raw = spark.read.text(paths).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"), F.trim(F.regexp_replace("value", "\r$", "")).alias("value"))
    raw = raw.where("value <> ''")
    sizes = raw.groupBy("file", "_block").agg(F.count("*").alias("_n"))
    first = sizes.select("file", "_block", (F.sum("_n").over(Window.partitionBy("file").orderBy("_block")) - F.col("_n")).alias("_first"))
    inside = F.row_number().over(Window.partitionBy("file", "_block").orderBy("_at")) - 1
    return raw.withColumn("_in", inside).join(first, ["file", "_block"]).select("file", (F.col("_first") + F.col("_in")).alias("line_no"), "value")


def running_count(lines: DataFrame, flag) -> DataFrame:
    """lines with n: how many lines of the file up to and with each have the flag; by blocks of lines."""
    held = lines.withColumns({"_block": F.expr("line_no div 65536"), "_flag": flag.cast("long")})
    totals = held.groupBy("file", "_block").agg(F.sum("_flag").alias("_t"))
    before = totals.select("file", "_block", (F.sum("_t").over(Window.partitionBy("file").orderBy("_block")) - F.col("_t")).alias("_before"))
    inside = F.sum("_flag").over(Window.partitionBy("file", "_block").orderBy("line_no"))
    return held.withColumn("_inside", inside).join(before, ["file", "_block"]).select(*lines.columns, (F.col("_before") + F.col("_inside")).alias("n"))
