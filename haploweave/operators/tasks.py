"""Task tables: products, grouping, chunking, deduplication, error rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REGION = ("chr", "start", "end", "vcf_key")


def build_tasks(regions: DataFrame, samples: list[str] | None = None, haplotypes: list[str] | None = None) -> DataFrame:
    """regions (ridx, chr, start, end, vcf_key, gene_id) x samples x haplotypes, region by region; a missing dimension is one null. idx = (ridx * S + s) * H + h."""
    s, h = list(samples or [None]), list(haplotypes or [None])
    side = lambda v: F.array(*[F.lit(x).cast("string") for x in v])
    df = regions.select("*", F.posexplode(side(s)).alias("_s", "sample")).select("*", F.posexplode(side(h)).alias("_h", "haplotype"))
    idx = (F.col("ridx") * len(s) + F.col("_s")) * len(h) + F.col("_h")
    return df.select(idx.cast("long").alias("idx"), *REGION, "gene_id", "sample", "haplotype")


def group_tasks(tasks: DataFrame) -> DataFrame:
    """Regions in first-seen order with the number and the first of their tasks."""
    return tasks.groupBy(*REGION).agg(F.count("*").alias("n"), F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"))


def chunk_tasks(tasks: DataFrame, most: int) -> DataFrame:
    """Adds chunk: within a region, in order of idx, every ``most`` tasks are one; 0 means no limit."""
    order = Window.partitionBy(*REGION).orderBy("idx")
    return tasks.withColumn("chunk", F.floor((F.row_number().over(order) - 1) / most).cast("long") if most else F.lit(0).cast("long"))


def distinct_work(tasks: DataFrame) -> DataFrame:
    """What has to be computed once: region, sample, haplotype, and how many tasks share it."""
    return tasks.groupBy(*REGION, "sample", "haplotype").agg(F.count("*").alias("n"), F.min("idx").alias("first_idx"))


def unknown_keys(tasks: DataFrame, keys: DataFrame) -> DataFrame:
    """Adds error: ``unknown vcf_key: K`` where the key is not loaded."""
    k = keys.select("vcf_key").distinct().withColumn("_known", F.lit(True))
    return tasks.join(k, "vcf_key", "left").withColumn("error", F.when(F.col("_known").isNull(), F.concat(F.lit("unknown vcf_key: "), F.col("vcf_key")))).drop("_known")


def available(genes: DataFrame, chroms: DataFrame, *, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(genes whose chromosome has a VCF, those without). With strict the latter are an error."""
    keep, skip = genes.join(chroms, "chr", "left_semi"), genes.join(chroms, "chr", "left_anti")
    if strict and (bad := skip.select("chr").distinct().head(5)):
        raise FileNotFoundError("no VCF for chromosomes: " + ", ".join(r["chr"] for r in bad))
    return keep, skip


def chrom_order(c: str) -> list[Column]:
    """Sort key: numbered chromosomes by number, then names."""
    n = F.regexp_replace(c, "^chr", "")
    return [F.coalesce(n.try_cast("int"), F.lit(10000)), n]


def shard(tasks: DataFrame, index: int, count: int) -> DataFrame:
    return tasks.where(F.col("idx") % count == index)


def shuffled(tasks: DataFrame, seed: int) -> DataFrame:
    """A seeded global shuffle that any partitioning repeats."""
    return tasks.orderBy(F.xxhash64("idx", F.lit(seed)), "idx")
