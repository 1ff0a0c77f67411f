"""Interval operators: binned range joins, merging, running ends, masking predicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BIN = 1 << 14


def merge_intervals(df: DataFrame) -> DataFrame:
    """Closed intervals (contig, beg, fin); those that overlap or touch become one."""
    order = Window.partitionBy("contig").orderBy("beg", "fin")
    ahead = F.max("fin").over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = df.withColumn("_new", F.when(ahead.isNull() | (F.col("beg") > ahead + 1), 1).otherwise(0)).withColumn("_k", F.sum("_new").over(order))
    return islands.groupBy("contig", "_k").agg(F.min("beg").alias("beg"), F.max("fin").alias("fin")).drop("_k")


def running_end(variants: DataFrame) -> DataFrame:
    """Adds pmax_end, the largest ref_end up to each record in (pos, rec_no) order."""
    order = Window.partitionBy("vcf_key", "contig").orderBy("pos", "rec_no").rowsBetween(Window.unboundedPreceding, 0)
    return variants.withColumn("pmax_end", F.max("ref_end").over(order))


def range_join(left: DataFrame, right: DataFrame, keys: list[str], *, mode: int = 1, size: int = BIN) -> DataFrame:
    """Regions (beg, fin) with the records (pos, ref_end) that they overlap: an equi-join on keys and bin.

    mode 0: the record starts in the region; 1 and 2: its span overlaps. A pair that shares several bins is
    kept in the first of them only. Other modes are an error.
    """
    if mode not in (0, 1, 2):
        raise ValueError(f"overlap mode must be 0, 1 or 2, not {mode}")
    last = F.col("pos") if mode == 0 else F.greatest("pos", "ref_end")
    a = left.withColumn("_bin", F.explode(F.sequence(F.expr(f"beg div {size}"), F.greatest(F.expr(f"beg div {size}"), F.expr(f"fin div {size}")))))
    b = right.withColumn("_last", last).withColumn("_bin", F.explode(F.sequence(F.expr(f"pos div {size}"), F.expr(f"_last div {size}"))))
    both = a.join(b, [*keys, "_bin"])
    hit = (F.col("pos") <= F.col("fin")) & (F.col("_last") >= F.col("beg"))
    return both.where(hit & (F.col("_bin") == F.greatest(F.expr(f"beg div {size}"), F.expr(f"pos div {size}")))).drop("_bin", "_last")


def touched(records: DataFrame, mask: DataFrame, *, size: int = BIN) -> DataFrame:
    """Records whose span touches a masked interval, once each."""
    a = records.withColumn("_bin", F.explode(F.sequence(F.expr(f"pos div {size}"), F.greatest(F.expr(f"pos div {size}"), F.expr(f"ref_end div {size}")))))
    b = mask.select(F.col("contig").alias("_c"), F.col("beg").alias("_beg"), F.col("fin").alias("_fin")).withColumn("_b", F.explode(F.sequence(F.expr(f"_beg div {size}"), F.expr(f"_fin div {size}"))))
    return a.join(b, (F.col("contig") == F.col("_c")) & (F.col("_bin") == F.col("_b")) & (F.col("_beg") <= F.col("ref_end")) & (F.col("_fin") >= F.col("pos")), "left_semi").drop("_bin").distinct()


def alias_contigs(regions: DataFrame, contigs: DataFrame) -> DataFrame:
    """Adds vcf_contig: the VCF's name of chr - the same, without ``chr``, or with it, in this order."""
    names = regions.select("vcf_key", "chr").distinct()
    short = F.when(F.col("chr").startswith("chr"), F.expr("substring(chr, 4)"))
    tries = names.select("vcf_key", "chr", F.posexplode(F.array(F.col("chr"), short, F.concat(F.lit("chr"), F.col("chr")))).alias("_o", "contig")).where("contig IS NOT NULL")
    best = tries.join(contigs.select("vcf_key", "contig"), ["vcf_key", "contig"]).groupBy("vcf_key", "chr").agg(F.min_by("contig", "_o").alias("vcf_contig"))
    return regions.join(best, ["vcf_key", "chr"], "left")
