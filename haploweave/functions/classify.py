"""Kinds of alleles and records as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("RefOnly", "Snp1", "SameLen", "NormInsertion", "NormDeletion", "SymbolicDel", "GvcfBlock", "SimpleIndel", "Complex")


def allele_op(ref: Column, alt: Column, rlen: Column) -> Column:
    """struct(kind, alt_len, trim_beg, len_diff) of one ALT."""
    rlen = rlen.cast("int")
    same = F.substring(ref, 1, 1) == F.substring(alt, 1, 1)
    diff = (F.length(alt) - rlen).cast("int")
    gone, block = F.upper(alt) == "<DEL>", alt.isin("<*>", "<NON_REF>")
    odd = alt.startswith("<") | (alt == "*") | (alt == "")
    kind = F.when(gone, "SymbolicDel").when(block, "GvcfRefBlock").when(odd, "Unsupported").when(diff == 0, "SameLen").when(same & (diff > 0), "Insert").when(same & (diff < 0), "Delete").otherwise("Replace")
    trim = F.when(gone, 1).when(block | odd, 0).otherwise(same.cast("int"))
    length = F.when(gone, 1).otherwise(F.length(alt)).cast("int")
    return F.struct(kind.alias("kind"), length.alias("alt_len"), trim.cast("int").alias("trim_beg"), F.when(gone, 1 - rlen).when(block, 0).otherwise(diff).cast("int").alias("len_diff"))


def with_ops(variants: DataFrame) -> DataFrame:
    """Adds ops (one per ALT), kind of the record and its flags."""
    alts = F.slice("alleles", 2, 1 << 30)
    df = variants.withColumn("ops", F.transform(alts, lambda a: allele_op(F.get(F.col("alleles"), 0), a, F.col("rlen"))))
    every = lambda *k: F.forall("ops", lambda o: o["kind"].isin(*k))
    some = lambda *k: F.exists("ops", lambda o: o["kind"].isin(*k))
    kind = F.when(F.size("ops") == 0, "RefOnly").when(every("SameLen") & (F.col("rlen") == 1), "Snp1").when(every("SameLen"), "SameLen").when(every("Insert"), "NormInsertion").when(every("Delete"), "NormDeletion").when(every("SymbolicDel"), "SymbolicDel").when(every("GvcfRefBlock"), "GvcfBlock").when(every("Insert", "Delete", "Replace"), "SimpleIndel").otherwise("Complex")
    n = F.size("alleles")
    flags = F.struct(
        (n == 2).alias("biallelic"),
        (n > 2).alias("multi"),
        some("SymbolicDel", "GvcfRefBlock").alias("symbolic"),
        F.exists(alts, lambda a: a == "*").alias("star"),
        F.exists("ops", lambda o: o["len_diff"] != 0).alias("len_change"),
        ((n > 1) & every("SameLen")).alias("all_same_len"),
        ((n > 1) & every("SameLen", "Insert", "Delete", "SymbolicDel")).alias("all_fast"),
    )
    return df.withColumn("kind", kind).withColumn("flags", flags)


def case_flags(allele: Column) -> Column:
    """struct(has_lower, has_upper): whether an allele has ASCII letters of that case."""
    return F.struct(allele.rlike("[a-z]").alias("has_lower"), allele.rlike("[A-Z]").alias("has_upper"))


def any_fallback(gt: Column, active: Column | None = None) -> Column:
    """Whether a sample's genotype is of class fallback (``gt_layout``); active: the places of the samples that count, null for all."""
    calls = gt if active is None else F.transform(active, lambda i: F.get(gt, i))
    return F.coalesce(F.exists(calls, lambda g: F.coalesce(gt_layout(g) == "fallback", F.lit(False))), F.lit(False))


def gt_layout(gt: Column) -> Column:
    """Class of a biallelic sample genotype text: missing, fallback, or its two haplotypes as ref, alt or missing."""
    a = F.split(gt, r"[/|]")
    one, two = F.get(a, 0), F.get(a, 1)
    word = lambda x: F.when(x == ".", "missing").when(x == "1", "alt").otherwise("ref")
    unphased = ~gt.contains("|")
    return (
        F.when(F.size(a) != 2, F.when((F.size(a) == 1) & (one == "."), "missing").otherwise("fallback"))
        .when((one == ".") & (two == "."), "missing")
        .when(unphased, "fallback")
        .when(~one.isin(".", "0", "1") | ~two.isin(".", "0", "1"), "fallback")
        .otherwise(F.concat_ws("|", word(one), word(two)))
    )


def type_of(ref: Column, alt: Column) -> Column:
    """snp, mnp, indel, ref or other."""
    odd = alt.startswith("<") | (alt == "*")
    return F.when(alt.isin("<*>", "<NON_REF>", "."), "ref").when(odd, "other").when(F.length(ref) != F.length(alt), "indel").when(F.length(ref) == 1, "snp").otherwise("mnp")
