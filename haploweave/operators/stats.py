"""Run statistics, profiles and compile statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LANES = ("EmptyRegion", "SameLenOnly", "SameLenIupac", "NormalizedEditScript", "MixedSimpleEdits", "BiallelicPhasedBatch", "FallbackStateMachine")
FAILURES = ("RefMismatch", "BrokenVcf", "InvalidOverlapTrim", "UnsupportedSymbolicAllele")


def run_stats(results: DataFrame) -> DataFrame:
    """n, failed, total_len, min_len, max_len over successes, and the first error by idx."""
    ok, size = F.col("error").isNull(), F.length("seq").cast("long")
    return results.agg(
        F.count_if(ok).alias("n"),
        F.count_if(~ok).alias("failed"),
        F.coalesce(F.sum(F.when(ok, size)), F.lit(0)).alias("total_len"),
        F.coalesce(F.min(F.when(ok, size)), F.lit(0)).cast("long").alias("min_len"),
        F.coalesce(F.max(F.when(ok, size)), F.lit(0)).cast("long").alias("max_len"),
        F.min_by("error", F.when(~ok, F.col("idx"))).alias("first_error"),
    )


def profile_counts(results: DataFrame) -> DataFrame:
    """One row: tasks by lane and failures by kind."""
    lane = [F.count_if(F.col("lane") == x).alias(f"lane.{x}") for x in LANES]
    kind = [F.count_if(F.col("failure_kind") == x).alias(f"apply_failure.{x}") for x in FAILURES]
    return results.agg(*lane, *kind, F.coalesce(F.sum("napplied"), F.lit(0)).alias("napplied"))


def profile_lines(results: DataFrame, elapsed: float) -> list[str]:
    run, counts = run_stats(results).first(), profile_counts(results).first()
    rate = lambda n: n / elapsed if elapsed > 0 else 0.0
    lines = [f"run.{k}={run[k]}" for k in ("n", "failed", "total_len", "min_len", "max_len")]
    lines += [f"run.elapsed_sec={elapsed:.6f}", f"run.seq_per_sec={rate(run['n']):.3f}", f"run.bases_per_sec={rate(run['total_len']):.3f}", f"runtime.alloc_bytes={run['total_len']}", f"runtime.records_applied={counts['napplied']}"]
    return lines + [f"{k}={v}" for k, v in counts.asDict().items() if k != "napplied"]


def compile_stats(variants: DataFrame) -> DataFrame:
    """Per VCF (from classified variants): records by kind and alleles by operation, as rows (vcf_key, what, n)."""
    kinds = variants.groupBy("vcf_key", F.concat(F.lit("record."), F.col("kind")).alias("what")).agg(F.count("*").alias("n"))
    ops = variants.select("vcf_key", F.explode("ops.kind").alias("k")).groupBy("vcf_key", F.concat(F.lit("allele."), F.col("k")).alias("what")).agg(F.count("*").alias("n"))
    return kinds.unionByName(ops)
