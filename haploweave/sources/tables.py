"""BED masks, gene lists and sample lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.intervals import merge_intervals


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """Merged closed intervals (contig, beg, fin). Blank lines and # lines are skipped, empty intervals dropped; other lines that are no interval are an error naming the line."""
    rows = spark.read.text(path).select(F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ").alias("f"), F.trim("value").alias("line")).where("line <> '' AND NOT startswith(line, '#')")
    number = lambda i: F.coalesce(F.get(F.col("f"), i).try_cast("long"), F.raise_error(F.concat(F.lit("bad BED line: "), F.col("line"))).cast("long"))
    return merge_intervals(rows.select(F.get(F.col("f"), 0).alias("contig"), number(1).alias("beg"), (number(2) - 1).alias("fin")).where("fin >= beg"))


def read_genes(spark: SparkSession, path: str) -> DataFrame:
    """gene_id, chr, tss, symbol, strand; a header row and blank rows are skipped; a row of another width or a tss that is no number is an error."""
    rows = spark.read.csv(path, schema="gene_id string, chr string, tss string, symbol string, strand string", mode="FAILFAST")
    rows = rows.where((F.col("gene_id").isNotNull()) & (F.lower("tss") != "tss"))
    return rows.withColumn("tss", F.coalesce(F.col("tss").try_cast("long"), F.raise_error(F.concat(F.lit("bad gene row: "), F.col("gene_id"))).cast("long")))


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("sample")).where("sample <> ''")
