"""VCF text (plain, or compressed by name) as typed rows."""

from __future__ import annotations

import gzip
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class Vcf:
    """Variants, contigs (declared in the header or seen in rows), samples, and the number of malformed rows that were left out."""

    variants: DataFrame
    contigs: DataFrame
    samples: DataFrame
    malformed: DataFrame


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of gzip files of any number of members, read as a stream."""
    for path in (p for b in batches for p in b.column(0).to_pylist()):
        store, at = fs.FileSystem.from_uri(path if re.match(r"\w+:/", path) else f"file://{path}")
        with store.open_input_file(at) as f, gzip.open(f, "rt", encoding="utf-8", errors="replace", newline="\n") as text:
            lines, size, done = [], 0, 0
            for line in text:
                lines.append(line.rstrip("\r\n"))
                size += len(line)
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string()), pa.array(range(done, done + len(lines)), pa.int64())], ["value", "rec_no"])
                    lines, size, done = [], 0, done + len(lines)
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string()), pa.array(range(done, done + len(lines)), pa.int64())], ["value", "rec_no"])


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """value, rec_no in the order of the file. ``.bgz`` is no name that Spark decompresses."""
    if path.endswith(".bgz"):
        return spark.createDataFrame([(path,)], "path string").mapInArrow(_members, "value string, rec_no long").where(F.length("value") > 0)
    return spark.read.text(path).select("value", F.monotonically_increasing_id().alias("rec_no")).where(F.length("value") > 0)


def read_vcf(spark: SparkSession, path: str, key: str) -> Vcf:
    """Rows with too few columns, a non-integer POS, or more FORMAT values than keys are malformed and left out."""
    lines = _lines(spark, path)
    k = F.lit(key).alias("vcf_key")
    head = lines.where(F.col("value").startswith("#CHROM"))
    names = F.slice(F.split("value", "\t"), 10, 1 << 30)
    samples = head.select(k, F.posexplode(names).alias("sample_idx", "sample")).withColumn("sample", F.when(F.col("sample") == "", F.concat(F.lit("sample_"), F.col("sample_idx").cast("string"))).otherwise(F.col("sample")))
    declared = lines.where(F.col("value").startswith("##contig=")).select(F.regexp_extract("value", r"ID=([^,>]+)", 1).alias("contig"), F.lit(True).alias("declared"))
    f = F.split("value", "\t")
    rows = lines.where(~F.col("value").startswith("#")).withColumn("f", f)
    value = lambda i: F.get(F.col("f"), i)
    keys = F.size(F.split(F.coalesce(value(8), F.lit("")), ":"))
    good = (F.size("f") >= 8) & value(1).rlike(r"^\d+$") & ~F.exists(F.slice("f", 10, 1 << 30), lambda s: F.size(F.split(s, ":")) > keys)
    good = F.coalesce(good, F.lit(False))
    alts = F.filter(F.split(value(4), ","), lambda a: (a != ".") & (a != ""))
    pos = value(1).cast("long") - 1
    end = F.regexp_extract(value(7), r"(?:^|;)END=(\d+)", 1)
    rlen = F.when(end != "", end.cast("long") - pos).otherwise(F.length(value(3)))
    at = F.array_position(F.split(F.coalesce(value(8), F.lit("")), ":"), "GT")
    gt = F.when(at > 0, F.transform(F.slice("f", 10, 1 << 30), lambda s: F.get(F.split(s, ":"), at.cast("int") - 1)))
    variants = rows.where(good).select(k, value(0).alias("contig"), "rec_no", pos.alias("pos"), rlen.cast("int").alias("rlen"), (pos + rlen - 1).alias("ref_end"), F.concat(F.array(value(3)), alts).alias("alleles"), F.forall(alts, lambda a: a.isin("<*>", "<NON_REF>")).alias("var_is_ref"), gt.alias("gt"))
    seen = variants.select("contig").distinct().select("contig", F.lit(False).alias("declared"))
    contigs = declared.unionByName(seen).groupBy("contig").agg(F.max("declared").alias("declared")).select(k, "contig", "declared")
    return Vcf(variants, contigs, samples.select("vcf_key", "sample", "sample_idx"), rows.where(~good).agg(F.count("*").alias("malformed")).select(k, "malformed"))


def decode_gt(gt: Column | str) -> Column:
    """``0|1``, ``./.``, ``1`` -> array of struct(allele, phased). The first allele shares the next one's separator; a haploid call is phased."""
    gt = F.col(gt) if isinstance(gt, str) else gt
    alleles = F.split(gt, r"[/|]")
    marks = F.regexp_extract_all(gt, F.lit(r"[/|]"), F.lit(0))
    return F.when(gt.isNotNull(), F.transform(alleles, lambda a, i: F.struct(a.try_cast("int").alias("allele"), F.coalesce(F.get(marks, F.greatest(i - 1, F.lit(0))) == "|", F.lit(True)).alias("phased"))))


def vcf_path(pattern: str, chrom: str) -> str:
    """Fills {chr}, and {n} without its chr prefix."""
    return pattern.replace("{chr}", chrom).replace("{n}", chrom.removeprefix("chr"))
