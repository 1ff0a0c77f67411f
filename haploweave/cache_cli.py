"""``python -m haploweave.cache_cli [--threads N] [--log-level L] [--htslib-log-level L] [--force] vcf...``: caches beside the files.

Exit codes: 0 done, 1 a file failed, 2 wrong usage.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .engine import LEVELS, build_cache, set_htslib_log_level


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="haploweave.cache_cli")
    p.add_argument("--threads", type=int, default=0, help="threads of a local session; 0 for all cores")
    p.add_argument("--log-level", choices=sorted(LEVELS), default="info")
    p.add_argument("--htslib-log-level", choices=sorted(LEVELS), default="warning")
    p.add_argument("--force", action="store_true", help="build valid caches again")
    p.add_argument("vcf", nargs="+")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """spark: a session to use; without it, the one that spark-submit names, else a local one."""
    a = parser().parse_args(argv)
    set_htslib_log_level(a.htslib_log_level)
    if spark is None:
        builder = SparkSession.builder.appName("haploweave-cache")
        spark = (builder.master(f"local[{a.threads}]") if a.threads else builder).getOrCreate()
    failed = 0
    for path in a.vcf:
        try:
            for r in build_cache(spark, [path], force=a.force, log_level=a.log_level):
                print(f"{r.status}\t{r.path}\t{r.cache_path}\trecords={r.records}\tsamples={r.samples}\tmb={r.cache_mb:.1f}\tsec={r.elapsed_sec:.1f}")
        except OSError as e:
            failed = 1
            print(f"failed\t{e}", file=sys.stderr)
    return failed


if __name__ == "__main__":
    sys.exit(main())
