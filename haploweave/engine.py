"""The user's entry: an engine over one reference and any number of VCFs."""

from __future__ import annotations

import glob
import hashlib
import itertools
import json
import logging
import os
import shutil
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas
from .functions.classify import with_ops
from .operators import consensus, stats
from .operators import tasks as task_ops
from .operators.apply import Options
from .operators.intervals import alias_contigs, range_join
from .plans.planner import plan_regions
from .sources import fasta
from .sources.tables import read_bed
from .sources.vcf import Vcf, read_vcf

log = logging.getLogger("haploweave")
LEVELS = {"off": logging.CRITICAL + 10, "none": logging.CRITICAL + 10, "quiet": logging.CRITICAL + 10, "error": logging.ERROR, "err": logging.ERROR, "warn": logging.WARNING, "warning": logging.WARNING, "info": logging.INFO, "debug": logging.DEBUG, "trace": logging.DEBUG}
CACHE_VERSION = 3
WARNINGS = 20  # failures of one engine that are logged before the rest is passed over
PARTS = ("variants", "contigs", "samples", "malformed")


_htslib_level = "warning"


def set_htslib_log_level(level: str) -> None:
    """Kept for callers that set it: no such library reads the files here, so the level has no effect."""
    global _htslib_level
    if level not in LEVELS:
        raise ValueError(f"unknown log level {level!r}")
    _htslib_level = level


def get_htslib_log_level() -> str:
    return _htslib_level


@dataclass
class Task:
    chr: str
    start: int
    end: int
    vcf_key: str
    gene_id: str
    sample: str | None = None
    haplotype: str | None = None


@dataclass(frozen=True)
class ConsensusResult:
    gene_id: str
    sample: str | None
    haplotype: str | None
    seq: bytes | None
    chain: str | None
    error: str | None


@dataclass(frozen=True)
class CacheResult:
    path: str
    cache_path: str
    status: str
    records: int
    samples: int
    cache_mb: float
    elapsed_sec: float


def _letter(name: str, value: str | None, words: tuple[str, ...] = (), fold: bool = False) -> str | None:
    if value is None:
        return None
    v = value.lower() if fold and value.lower() in words else value
    if v in words or (len(v) == 1 and v.isascii()):
        return v
    raise ValueError(f"{name} must be one ASCII character{' or ' + ' or '.join(words) if words else ''}, not {value!r}")


def build_tasks(regions, samples=None, haplotypes=None) -> list[Task]:
    """regions: (chr, start, end, vcf_key, gene_id) each; region by region, then sample, then haplotype."""
    return [Task(*r, s, h) for r, s, h in itertools.product(regions, samples or [None], haplotypes or [None])]


def _fingerprint(path: str) -> dict:
    st = os.stat(path)
    return {"path": os.path.realpath(path), "length": st.st_size, "mtime_ns": st.st_mtime_ns, "version": CACHE_VERSION}


def _cache_of(path: str, cache_dir: str | None) -> tuple[str, dict | None]:
    """The cache folder of a VCF and its manifest, if there is one that can be read."""
    real = os.path.realpath(path)
    target = os.path.join(cache_dir or os.path.dirname(real), f".{os.path.basename(real)}.haplo-{hashlib.sha256(real.encode()).hexdigest()[:12]}")
    try:
        with open(os.path.join(target, "manifest.json")) as f:
            return target, json.load(f)
    except (FileNotFoundError, json.JSONDecodeError):
        return target, None


def _fresh(target: str, manifest: dict | None, mark: dict) -> bool:
    return bool(manifest) and all(manifest.get(k) == v for k, v in mark.items()) and os.path.isdir(os.path.join(target, manifest.get("data", "-")))


def open_vcf(spark: SparkSession, path: str, key: str, cache_dir: str | None = None) -> Vcf:
    """From a valid cache of the file, else from its text. A cache whose manifest names another length, time or version is passed over."""
    if "://" not in path and os.path.exists(path):
        target, manifest = _cache_of(path, cache_dir)
        if _fresh(target, manifest, _fingerprint(path)):
            part = lambda name: spark.read.parquet(os.path.join(target, manifest["data"], name)).withColumn("vcf_key", F.lit(key))
            return Vcf(*(part(name) for name in PARTS))
    return read_vcf(spark, path, key)


def input_warnings(malformed: DataFrame, contigs: DataFrame) -> list[str]:
    """What was left out or filled in while reading: malformed rows by number, undeclared contigs by name."""
    rows = [r for r in malformed.groupBy("vcf_key").agg(F.sum("malformed").alias("n")).collect() if r["n"]]
    names = contigs.where("NOT coalesce(declared, false)").orderBy("vcf_key", "contig").limit(WARNINGS + 1).collect()
    out = [f"{r['vcf_key']}: {r['n']} malformed rows left out" for r in rows]
    out += [f"{r['vcf_key']}: contig {r['contig']} is not declared in the header" for r in names[:WARNINGS]]
    return out + (["further undeclared contigs are not listed"] if len(names) > WARNINGS else [])


def build_cache(spark: SparkSession, paths, *, force: bool = False, cache_dir: str | None = None, log_level: str = "info", compile_threads: int | None = None) -> list[CacheResult]:
    """Parse VCFs once into Parquet beside a manifest; valid caches are hits. Files that are the same on disk are done once, in first-seen order. A failure raises OSError naming the path.

    Each build writes a folder of its own, which the manifest names once it is whole, so a broken build leaves the old cache as it was. The replaced folder is deleted: engines opened on it must be opened again."""
    log.setLevel(LEVELS[log_level])
    out, seen = [], set()
    for path in paths:
        try:
            real = os.path.realpath(path)
            if real in seen:
                continue
            seen.add(real)
            began, mark = time.time(), _fingerprint(path)
            target, old = _cache_of(path, cache_dir)
            if not force and _fresh(target, old, mark):
                status, made = "hit", old
            else:
                status = "forced" if force else "rebuilt" if old else "built"
                vcf, data = read_vcf(spark, path, "cache"), uuid.uuid4().hex
                for name in PARTS:
                    getattr(vcf, name).write.parquet(os.path.join(target, data, name))
                size = lambda name: spark.read.parquet(os.path.join(target, data, name)).count()
                made = mark | {"data": data, "records": size("variants"), "samples": size("samples")}
                part = lambda name: spark.read.parquet(os.path.join(target, data, name))
                for line in input_warnings(part("malformed"), part("contigs")):
                    log.warning("%s: %s", path, line)
                manifest = os.path.join(target, "manifest.json")
                with open(manifest + ".tmp", "w") as f:
                    json.dump(made, f)
                os.replace(manifest + ".tmp", manifest)
                if old and old.get("data"):
                    shutil.rmtree(os.path.join(target, old["data"]), ignore_errors=True)
            mb = sum(os.path.getsize(os.path.join(d, x)) for d, _, xs in os.walk(os.path.join(target, made["data"])) for x in xs) / 1e6
            out.append(CacheResult(path, target, status, made["records"], made["samples"], mb, time.time() - began))
        except Exception as e:
            raise OSError(f"{path}: {e}") from e
    return out


class ConsensusEngine:
    """``vcfs``: {key: path}; a file with a valid cache (``build_cache``) is read from there. Options are those of operators.apply.Options; ``mask`` is a BED path."""

    def __init__(self, spark: SparkSession, ref_path: str, vcfs: dict[str, str], *, iupac_codes: bool = False, missing: str | None = None, absent: str | None = None, mark_del: str | None = None, mark_ins: str | None = None, mark_snv: str | None = None, mask: str | None = None, mask_with: str = "N", chain: bool = False, regions_overlap: int = 0, max_tasks_per_group: int = 0, compile_threads: int | None = None, log_level: str = "info", error_mode: str = "warn", cache_dir: str | None = None):
        began = time.time()
        if regions_overlap not in (0, 1, 2):
            raise ValueError("regions_overlap must be 0, 1 or 2")
        self.spark, self.overlap, self.group = spark, regions_overlap, max_tasks_per_group
        self.strict = error_mode in ("error", "err", "strict", "raise")
        marks = ("uc", "lc")
        self.options = Options(iupac_codes, _letter("missing", missing), _letter("absent", absent), _letter("mark_del", mark_del), _letter("mark_ins", mark_ins, marks), _letter("mark_snv", mark_snv, marks), _letter("mask_with", mask_with, marks, fold=True), chain)
        self.log_level = log_level
        if not os.path.exists(ref_path) and "://" not in ref_path:
            raise OSError(f"fai_load failed for {ref_path}")
        self.reference = fasta.read_fasta(spark, ref_path).cache()
        names: dict[str, list[str]] = {}  # the keys of each file; a file of several keys is read once
        for key, path in sorted(vcfs.items()):
            names.setdefault(os.path.realpath(path) if "://" not in path else path, []).append(key)
        parts = [(keys, open_vcf(spark, path, keys[0], cache_dir)) for path, keys in names.items()]
        self.keys = spark.createDataFrame([(k,) for k in vcfs] or [("",)], "vcf_key string").where("vcf_key <> ''")
        union = lambda name, ddl: self._union([getattr(v, name).withColumn("vcf_key", F.explode(F.array(*map(F.lit, keys)))) for keys, v in parts], ddl)
        self.variants = union("variants", schemas.VARIANTS).cache()
        self.contigs, self.samples = union("contigs", schemas.CONTIGS), union("samples", schemas.SAMPLES)
        self.malformed = union("malformed", "vcf_key string, malformed long")
        self.mask = read_bed(spark, mask) if mask else None
        self._warned = 0
        self.load_sec = time.time() - began

    def close(self) -> None:
        """Give back the memory of the reference and the variants."""
        self.reference.unpersist()
        self.variants.unpersist()

    def input_warnings(self) -> list[str]:
        """Logged and returned; reads the files."""
        lines = input_warnings(self.malformed, self.contigs)
        for line in lines:
            log.warning(line)
        return lines

    def _union(self, frames: list[DataFrame], ddl: str) -> DataFrame:
        out = self.spark.createDataFrame([], ddl)
        for f in frames:
            out = out.unionByName(f.select(*out.columns))
        return out

    @property
    def log_level(self) -> str:
        return self._level

    @log_level.setter
    def log_level(self, level: str) -> None:
        if level not in LEVELS:
            raise ValueError(f"unknown log level {level!r}")
        self._level = level
        log.setLevel(LEVELS[level])

    def task_table(self, tasks) -> DataFrame:
        if isinstance(tasks, DataFrame):
            return tasks
        rows = [(i, t.chr, t.start, t.end, t.vcf_key, t.gene_id, t.sample, t.haplotype) for i, t in enumerate(tasks)]
        return self.spark.createDataFrame(rows, schemas.TASKS)

    def results(self, tasks) -> DataFrame:
        """The lazy result table; everything else is an action on it."""
        return consensus.run(self.task_table(tasks), self.reference, self.variants, self.contigs, self.samples, self.keys, self.options, overlap=self.overlap, mask=self.mask, group=self.group)

    def _result(self, r) -> ConsensusResult:
        if r["error"]:
            if self.strict:
                raise RuntimeError(f"{r['gene_id']}: {r['error']}")
            self._warned += 1
            if self._warned <= WARNINGS:
                log.warning("%s: %s", r["gene_id"], r["error"])
            elif self._warned == WARNINGS + 1:
                log.warning("further failures are not logged")
        return ConsensusResult(r["gene_id"], r["sample"], r["haplotype"], r["seq"].encode() if r["seq"] is not None else None, r["chain"], r["error"])

    def consensus_many(self, tasks, threads: int = 1) -> list[ConsensusResult]:
        return [self._result(r) for r in self.results(tasks).orderBy("idx").collect()]

    def consensus_one(self, task: Task) -> ConsensusResult:
        return self.consensus_many([task])[0]

    def consensus_iter(self, tasks, prefetch_steps: int | None = None, warmup: bool = False, ordered: bool = False, threads: int = 1) -> ConsensusIter:
        df = self.results(tasks)
        return ConsensusIter(self, df.orderBy("idx") if ordered else df, prefetch_steps != 0, warmup)

    def consensus_regions(self, regions, samples=None, haplotypes=None, *, threads: int = 1, prefetch_steps: int | None = None, warmup: bool = False, ordered: bool = False) -> ConsensusIter:
        return self.consensus_iter(build_tasks(regions, samples, haplotypes), prefetch_steps, warmup, ordered, threads)

    def consensus_many_stats(self, tasks, threads: int = 1) -> tuple[int, int, int, int]:
        r = stats.run_stats(self.results(tasks)).first()
        if self.strict and r["failed"]:
            raise RuntimeError(r["first_error"])
        return r["n"], r["total_len"], r["min_len"], r["max_len"]

    consensus_iter_stats = consensus_many_stats

    def consensus_many_profile(self, tasks, threads: int = 1) -> list[str]:
        began = time.time()
        df = self.results(tasks).cache()
        try:
            bad = df.where("startswith(error, 'unknown vcf_key') OR startswith(error, 'ref fetch failed')").head(1)
            if bad:
                raise RuntimeError(bad[0]["error"])
            df.count()
            return stats.profile_lines(df, time.time() - began)
        finally:
            df.unpersist()

    def compile_stats(self) -> list[str]:
        rows = stats.compile_stats(with_ops(self.variants)).orderBy("vcf_key", "what").collect()
        return [f"vcf.{r['vcf_key']}.{r['what']}={r['n']}" for r in rows]

    def query(self, vcf_key: str, chrom: str, start: int, end: int, mode: int | None = None) -> DataFrame:
        """Records of a 1-based closed region, in order of position and file."""
        region = self.spark.createDataFrame([(vcf_key, chrom, start - 1, end - 1)], "vcf_key string, chr string, beg long, fin long")
        named = alias_contigs(region, self.contigs).where("vcf_contig IS NOT NULL").withColumnRenamed("vcf_contig", "contig").drop("chr")
        return range_join(named, self.variants, ["vcf_key", "contig"], mode=self.overlap if mode is None else mode).orderBy("pos", "rec_no")

    def query_set(self, regions: DataFrame, mode: int | None = None) -> DataFrame:
        """Records of many 1-based closed regions (vcf_key, chr, start, end), each with its region."""
        cut = regions.select("vcf_key", "chr", "start", "end", (F.col("start") - 1).alias("beg"), (F.col("end") - 1).alias("fin"))
        named = alias_contigs(cut, self.contigs).where("vcf_contig IS NOT NULL").withColumnRenamed("vcf_contig", "contig")
        return range_join(named, self.variants, ["vcf_key", "contig"], mode=self.overlap if mode is None else mode).drop("beg", "fin")

    def plan_query_set(self, regions: DataFrame, mode: int | None = None) -> DataFrame:
        """n and lane of each region that has records."""
        return plan_regions(with_ops(self.query_set(regions, mode)), ["vcf_key", "chr", "start", "end"])

    def has_gt(self, vcf_key: str) -> bool:
        return bool(self.variants.where((F.col("vcf_key") == vcf_key) & F.col("gt").isNotNull()).head(1))

    def n_sample(self, vcf_key: str) -> int:
        return self.samples.where(F.col("vcf_key") == vcf_key).count()

    def contig_of(self, vcf_key: str, chrom: str) -> str | None:
        """The VCF's own name of a chromosome."""
        return alias_contigs(self.spark.createDataFrame([(vcf_key, chrom)], "vcf_key string, chr string"), self.contigs).first()["vcf_contig"]

    def n_records(self, vcf_key: str) -> int:
        return self.variants.where(F.col("vcf_key") == vcf_key).count()

    def sample_names(self, vcf_key: str) -> list[str]:
        return [r["sample"] for r in self.samples.where(F.col("vcf_key") == vcf_key).orderBy("sample_idx").collect()]

    def run_report(self, tasks, mode: str = "many", threads: int = 1) -> str:
        """JSON of one run; mode is many or iter."""
        began = time.time()
        n, total, low, high = (self.consensus_many_stats if mode == "many" else self.consensus_iter_stats)(tasks)
        wall = time.time() - began
        return json.dumps({"mode": mode, "threads": threads, "load_sec": self.load_sec, "n": n, "total_len": total, "min_len": low, "max_len": high, "wall_sec": wall, "seq_per_sec": n / wall, "bases_per_sec": total / wall})


class ConsensusIter:
    """(idx, result) pairs, one partition ahead of the consumer."""

    def __init__(self, engine: ConsensusEngine, df: DataFrame, prefetch: bool, warmup: bool):
        self._engine, self._prefetch = engine, prefetch
        self._df = df.cache() if warmup else df
        if warmup:
            self._df.count()
        self._rows: Iterator | None = None

    def __iter__(self):
        return self

    def _next(self):
        if self._rows is None:
            self._rows = self._df.toLocalIterator(prefetchPartitions=self._prefetch)
        return next(self._rows)

    def __next__(self) -> tuple[int, ConsensusResult]:
        r = self._next()
        return r["idx"], self._engine._result(r)

    def next_batch(self, n: int) -> list[tuple[int, ConsensusResult]] | None:
        """Up to n pairs; [] for n = 0, None at the end."""
        got = list(itertools.islice(self, n))
        return got if got or n == 0 else None

    def next_batch_bytes(self, n: int) -> list[tuple[int, bytes | None]] | None:
        got = self.next_batch(n)
        return None if got is None else [(i, r.seq) for i, r in got]


def vcf_paths(pattern: str, chroms) -> dict[str, str]:
    """Existing files of a {chr} / {n} pattern."""
    from .sources.vcf import vcf_path

    return {c: p for c in chroms if glob.glob(p := vcf_path(pattern, c))}
