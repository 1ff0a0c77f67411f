"""``python -m haploweave.harness``: times consensus over gene windows of many samples and prints one JSON report."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import ConsensusEngine, vcf_paths
from .operators import tasks as task_ops
from .sources import tables
from .sources.fasta import tss_windows


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="haploweave.harness")
    for name in ("ref", "vcf-pattern", "genes"):
        p.add_argument(f"--{name}", required=True)
    p.add_argument("--samples", help="a file with a sample a line; without it, one sequence a gene from the sites alone")
    p.add_argument("--haplotypes", default="1,2")
    p.add_argument("--chrom", action="append", help="only this chromosome; may be repeated")
    p.add_argument("--limit-genes", type=int, default=0)
    p.add_argument("--limit-samples", type=int, default=0)
    p.add_argument("--mode", choices=("many", "iter"), default="many")
    p.add_argument("--strict", action="store_true", help="a chromosome without a VCF is an error")
    return p


def select_genes(genes: DataFrame, chroms: list[str] | None, limit: int) -> DataFrame:
    """Genes of the chromosomes, in order of chromosome, start site and name; limit 0 keeps all."""
    kept = genes.where(F.col("chr").isin(chroms)) if chroms else genes
    return kept.orderBy(*task_ops.chrom_order("chr"), "tss", "gene_id").limit(limit) if limit else kept


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> str:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("haploweave-harness").getOrCreate()
    genes = select_genes(tables.read_genes(spark, a.genes), a.chrom, a.limit_genes)
    vcfs = vcf_paths(a.vcf_pattern, [r["chr"] for r in genes.select("chr").distinct().collect()])
    known = spark.createDataFrame([(c,) for c in vcfs], "chr string")
    genes, _ = task_ops.available(genes, known, strict=a.strict)
    names = [r["sample"] for r in tables.read_samples(spark, a.samples).collect()] if a.samples else None
    names = names[: a.limit_samples] if names and a.limit_samples else names
    windows = tss_windows(genes).withColumn("ridx", F.monotonically_increasing_id()).withColumn("vcf_key", F.col("chr"))
    engine = ConsensusEngine(spark, a.ref, vcfs)
    try:
        return engine.run_report(task_ops.build_tasks(windows, names, a.haplotypes.split(",") if names else None), a.mode)
    finally:
        engine.close()


if __name__ == "__main__":
    print(main())
