"""Consensus sequences of a task table: slices and records per distinct region, alleles per group of a region's tasks, one Arrow pass."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.classify import with_ops
from ..functions.haplotype import mode_of
from ..plans.planner import plan_regions
from ..sources import fasta
from .apply import Options, Record
from .intervals import alias_contigs, range_join
from .lanes import Region
from .tasks import REGION

GROUP = 64  # most tasks that share one row of slice and records
_SHARED = 4096  # most equal tasks that share one sequence
_BYTES = 16 << 20  # sequences are handed back when they reach this
_MEMBERS = pa.list_(pa.struct([("idx", pa.int64()), ("gene_id", pa.string())]))
_OUT = pa.schema([("members", _MEMBERS), ("sample", pa.string()), ("haplotype", pa.string()), ("seq", pa.string()), ("chain", pa.string()), ("error", pa.string()), ("failure_kind", pa.string()), ("lane", pa.string()), ("napplied", pa.int64())])
_DDL = "members array<struct<idx:long,gene_id:string>>, sample string, haplotype string, seq string, chain string, error string, failure_kind string, lane string, napplied long"


def region_records(regions: DataFrame, variants: DataFrame, contigs: DataFrame, mode: int) -> DataFrame:
    """(rid, records, lane): the records of each region in order of position and file; regions without any are absent."""
    named = alias_contigs(regions, contigs).where("vcf_contig IS NOT NULL").select("rid", "vcf_key", F.col("vcf_contig").alias("contig"), "beg", "fin")
    hits = range_join(named, variants, ["vcf_key", "contig"], mode=mode)
    item = F.struct("pos", "rec_no", "rlen", "alleles", "var_is_ref", "gt")
    planned = plan_regions(with_ops(hits), ["rid"], F.array_sort(F.collect_list(item)).alias("records"))
    return planned.select("rid", "records", "lane")


def _groups(tasks: DataFrame, asked: DataFrame, most: int) -> DataFrame:
    """(rid, chunk, jobs): at most ``most`` different tasks of a region, each with its place among the asked samples and the input rows it answers.

    Groups follow idx, so a region with any number of tasks is spread without ranking them."""
    work = tasks.groupBy(*REGION, "sample", "haplotype", F.expr(f"idx div {_SHARED}").alias("_block")).agg(F.collect_list(F.struct("idx", "gene_id")).alias("members"), F.min("idx").alias("_first"))
    work = work.join(asked.select("vcf_key", "sample", "at"), ["vcf_key", "sample"], "left")
    return work.groupBy(_rid().alias("rid"), F.expr(f"_first div {most}").alias("chunk")).agg(F.collect_list(F.struct("sample", "haplotype", "at", "members")).alias("jobs"))


def _rid() -> Column:
    """A region's key as one value; nulls in it equal each other."""
    return F.struct(*REGION)


def run(tasks: DataFrame, reference: DataFrame, variants: DataFrame, contigs: DataFrame, samples: DataFrame, keys: DataFrame, options: Options, *, overlap: int = 0, mask: DataFrame | None = None, group: int = 0) -> DataFrame:
    """Results in the layout of schemas.RESULTS, keyed by idx. group: most tasks of a region that are made together, 0 for the default."""
    regions = tasks.select(*REGION).distinct().withColumn("rid", _rid()).withColumn("beg", F.col("start") - 1).withColumn("fin", F.col("end") - 1)
    # Genotypes of asked samples only, in the order of their columns; ``at`` is a sample's place among them.
    named = tasks.select("vcf_key", "sample").distinct().join(samples.select("vcf_key", "sample", "sample_idx"), ["vcf_key", "sample"])
    columns = named.groupBy("vcf_key").agg(F.sort_array(F.collect_set("sample_idx")).alias("columns"))
    asked = named.join(columns, "vcf_key").withColumn("at", F.array_position("columns", F.col("sample_idx")).cast("int") - 1)
    calls = F.transform(F.coalesce("columns", F.array().cast("array<int>")), lambda i: F.get("gt", i))
    slim = variants.join(columns, "vcf_key", "left").withColumn("gt", calls).drop("columns")

    fetched = fasta.fetch(reference, regions.select("rid", F.col("chr").alias("contig"), "beg", "fin"))
    base = regions.join(fetched.select("rid", "slice"), "rid", "left").join(region_records(regions, slim, contigs, overlap), "rid", "left")
    if mask is not None:
        overlaps = regions.select("rid", F.col("chr").alias("contig"), F.col("beg").alias("b"), F.col("fin").alias("f"))
        m = mask.select("contig", F.col("beg").alias("pos"), F.col("fin").alias("ref_end"))
        near = range_join(overlaps.withColumnsRenamed({"b": "beg", "f": "fin"}), m, ["contig"])
        base = base.join(near.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("pos", "ref_end"))).alias("mask")), "rid", "left")
    else:
        base = base.withColumn("mask", F.lit(None).cast("array<struct<pos:long,ref_end:long>>"))
    if options.mask_with not in ("uc", "lc"):  # a record under a letter mask leaves the region without a fast lane
        under = F.exists("records", lambda r: F.exists("mask", lambda m: (m["pos"] <= r["pos"] + r["rlen"] - 1) & (m["ref_end"] >= r["pos"])))
        base = base.withColumn("lane", F.when(under, "FallbackStateMachine").otherwise(F.col("lane")))
    base = base.withColumn("lane", F.coalesce("lane", F.lit("EmptyRegion")))
    base = base.join(keys.select("vcf_key").distinct().withColumn("known", F.lit(True)), "vcf_key", "left")
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    base = base.withColumn("error0", F.when(F.col("known").isNull(), F.concat(F.lit("unknown vcf_key: "), word("vcf_key"))).when(F.col("start") < 1, F.concat(F.lit("ref fetch failed: 1-based start "), word("start"), F.lit(" < 1"))).when(F.col("slice").isNull(), F.concat(F.lit("ref fetch failed: no bases at "), word("chr"), F.lit(":"), word("start"), F.lit("-"), word("end"))))

    own = lambda r: F.transform("jobs", lambda j: F.get(r["gt"], F.coalesce(j["at"], F.lit(-1))))
    records = F.transform("records", lambda r: F.struct(r["pos"].alias("pos"), r["rlen"].alias("rlen"), r["alleles"].alias("alleles"), r["var_is_ref"].alias("var_is_ref"), own(r).alias("calls")))
    # Dealt anew: the join leaves all groups of a region in one task, and a third of all tasks may be of one region.
    dealt = _groups(tasks, asked, group or GROUP).join(base.drop(*REGION, "known", "fin"), "rid").repartition("rid", "chunk")
    jobs = dealt.select("jobs", F.col("rid.chr").alias("chr"), "beg", "slice", records.alias("records"), "mask", "lane", "error0")
    done = jobs.mapInArrow(_applier(options), _DDL)
    return done.withColumn("m", F.explode("members")).select("m.idx", "m.gene_id", "sample", "haplotype", "seq", "chain", "error", "failure_kind", "lane", "napplied")


def _applier(opt: Options):
    def results(row: dict) -> Iterator[dict]:
        job = lambda j: {"members": j["members"], "sample": j["sample"], "haplotype": j["haplotype"], "lane": row["lane"]}
        if row["error0"]:
            for j in row["jobs"]:
                yield job(j) | {"error": row["error0"], "napplied": 0}
            return
        found = row["records"] or ()
        region = Region(row["slice"], row["chr"], row["beg"], [Record(r["pos"], r["rlen"], r["alleles"], r["var_is_ref"]) for r in found], opt, [(m["pos"], m["ref_end"]) for m in row["mask"] or ()])
        for n, j in enumerate(row["jobs"]):
            o, general = region.run(*mode_of(j["sample"], j["haplotype"], opt.iupac_codes), [r["calls"][n] for r in found])
            lane = "FallbackStateMachine" if general else row["lane"]
            yield job(j) | {"lane": lane, "seq": o.seq, "chain": o.chain, "error": o.error, "failure_kind": o.kind, "napplied": o.napplied}

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                for r in results(batch.slice(i, 1).to_pylist()[0]):
                    out.append(r)
                    size += 200 + len(r.get("seq") or "")
                    if size > _BYTES:
                        yield pa.RecordBatch.from_pylist(out, schema=_OUT)
                        out, size = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=_OUT)

    return apply
