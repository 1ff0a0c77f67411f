"""Registered queries: each applies an operator to a genome derived from the TPC-H-like tables, with the DuckDB SQL of the same result.

Contig c (0 to 4) is long enough to give each (order, line) a base of its own; base p of it is letter (p*p + 3p + c) % 4 of ACGT.
Regions cover the contigs, every lineitem row is in a variant, masks come from supplier, genotypes from position and sample.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify, haplotype, iupac
from ..operators import consensus, intervals, sinks, stats
from ..operators import tasks as task_ops
from ..operators.apply import Options
from ..plans import planner
from ..sources import fasta
from ..sources.vcf import decode_gt

TILE, WIDTH = 128, 60
QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _register(name: str, sql: str):
    def keep(f):
        QUERIES[name] = f
        ORACLE[name] = sql
        return f

    return keep


class Tables:
    """Contig by supplier, base 8 * order + line. Rows of one base make one record, in which each of them counts; with indels its k says insertion, deletion or substitution, and neighbours overlap."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def letter(self, x: str) -> str:
        return f"substring('ACGT', cast({x} as int) + 1, 1)"

    @cached_property
    def windows(self) -> int:
        """Regions of one contig."""
        return self.read("lineitem").agg(F.expr(f"(coalesce(max(8 * l_orderkey + l_linenumber), -1) + {WIDTH}) div {WIDTH}")).first()[0]

    def reference(self, tile: int = TILE) -> DataFrame:
        length = WIDTH * self.windows
        n = -(-length // tile)
        rows = self.spark.range(5 * n).selectExpr(f"id div {n} as c", f"cast(id % {n} as int) as tile", f"id % {n} * {tile} as tile_start")
        bases = f"array_join(transform(sequence(tile_start, least(tile_start + {tile}, {length}L) - 1), p -> {self.letter('(p*p + 3*p + c) % 4')}), '')"
        return rows.selectExpr("cast(c as string) as contig", f"{length}L as contig_len", "tile", "tile_start", f"{bases} as bases")

    def regions(self) -> DataFrame:
        n = self.windows
        return self.spark.range(5 * n).selectExpr("id as rid", f"cast(id div {n} as string) as contig", f"{WIDTH} * (id % {n}) as beg", f"{WIDTH} * (id % {n}) + {WIDTH - 1} as fin")

    def sites(self) -> DataFrame:
        """c, pos, k: one record per position."""
        return self.read("lineitem").groupBy(F.expr("cast(l_suppkey % 5 as bigint)").alias("c"), F.expr("cast(8 * l_orderkey + l_linenumber as bigint)").alias("pos")).agg(F.expr("cast(1 + sum(l_partkey) % 3 as bigint)").alias("k"))

    def variants(self, indels: bool = False) -> DataFrame:
        """Substitutions with genotypes of three samples; or insertions (k = 1), deletions of two bases (k = 2) and substitutions."""
        v = self.sites()
        x = "((pos*pos + 3*pos + c) % 4)"
        ref, alt = self.letter(x), self.letter(f"(({x} + k) % 4)")
        if indels:
            rest = self.letter("(((pos+1)*(pos+1) + 3*(pos+1) + c) % 4)"), self.letter("(((pos+2)*(pos+2) + 3*(pos+2) + c) % 4)")
            alleles = f"case when k = 1 then array({ref}, concat({ref}, 'GG')) when k = 2 then array(concat({ref}, {rest[0]}, {rest[1]}), {ref}) else array({ref}, {alt}) end"
        else:
            alleles = f"array({ref}, {alt})"
        call = "array_join(array({0}, {1}), '|')".format(*(f"element_at(array('0', '1', '.'), cast((pos*31 + s*17 + {h}*7) % 3 as int) + 1)" for h in (0, 1)))
        v = v.selectExpr("'v' as vcf_key", "cast(c as string) as contig", "pos as rec_no", "pos", f"{alleles} as alleles", f"transform(sequence(0L, 2L), s -> {call}) as gt")
        return v.selectExpr("vcf_key", "contig", "rec_no", "pos", "cast(length(alleles[0]) as int) as rlen", "pos + length(alleles[0]) - 1 as ref_end", "alleles", "false as var_is_ref", "gt")

    def spans(self) -> DataFrame:
        """Records of one to five bases, for the interval operators."""
        return self.sites().selectExpr("cast(c as string) as contig", "pos", "pos + (pos + k) % 5 as ref_end", "k")

    def mask(self) -> DataFrame:
        return self.read("supplier").selectExpr("cast(s_suppkey % 5 as string) as contig", "cast(s_suppkey * 37 % 900 as bigint) as beg", "cast(s_suppkey * 37 % 900 + s_suppkey % 25 as bigint) as fin")

    def tasks(self, samples: list[str] | None = None, haplotypes: list[str] | None = None) -> DataFrame:
        r = self.regions().selectExpr("rid as ridx", "contig as chr", "beg + 1 as start", "fin + 1 as end", "'v' as vcf_key", "concat('g', rid) as gene_id")
        return task_ops.build_tasks(r, samples, haplotypes)

    def results(self, tasks: DataFrame, options: Options = Options(), *, indels: bool = False, mask: bool = False, variants: DataFrame | None = None) -> DataFrame:
        v = self.variants(indels) if variants is None else variants
        contigs = self.spark.range(5).selectExpr("'v' as vcf_key", "cast(id as string) as contig", "true as declared")
        samples = self.spark.range(3).selectExpr("'v' as vcf_key", "concat('s', id) as sample", "cast(id as int) as sample_idx")
        keys = self.spark.range(1).selectExpr("'v' as vcf_key")
        return consensus.run(tasks, self.reference(fasta.TILE), v, contigs, samples, keys, options, mask=intervals.merge_intervals(self.mask()) if mask else None)


_CTE = """WITH RECURSIVE reg AS (SELECT (c * n + w)::BIGINT AS rid, c, (60 * w)::BIGINT AS beg, (60 * w + 59)::BIGINT AS fin FROM (SELECT ((max(8 * l_orderkey + l_linenumber) + 60) // 60)::BIGINT AS n FROM lineitem), range(5) a(c), LATERAL (SELECT unnest(range(n)) AS w)),
site AS (SELECT (l_suppkey % 5)::BIGINT AS c, (8 * l_orderkey + l_linenumber)::BIGINT AS pos, (1 + sum(l_partkey) % 3)::BIGINT AS k FROM lineitem GROUP BY 1, 2),
span AS (SELECT c, pos, pos + (pos + k) % 5 AS ref_end, k FROM site),
msk AS (SELECT (s_suppkey % 5)::BIGINT AS c, (s_suppkey * 37 % 900)::BIGINT AS beg, (s_suppkey * 37 % 900 + s_suppkey % 25)::BIGINT AS fin FROM supplier),
cell AS (SELECT rid, reg.c, p, ((p*p + 3*p + reg.c) % 4)::BIGINT AS x, k FROM reg, LATERAL (SELECT unnest(range(beg, fin + 1)) AS p) LEFT JOIN site ON site.c = reg.c AND site.pos = p),
lt AS (SELECT *, substr('ACGT', x + 1, 1) AS b, substr('ACGT', (x + k) % 4 + 1, 1) AS a, EXISTS (SELECT 1 FROM msk WHERE msk.c = cell.c AND p BETWEEN msk.beg AND msk.fin) AS m FROM cell)
"""


def _sequence(expr: str) -> str:
    return _CTE + f"SELECT rid AS idx, string_agg({expr}, '' ORDER BY p) AS seq FROM lt GROUP BY rid"


@_register("tiles_fetch", _CTE + "SELECT rid, string_agg(b, '' ORDER BY p) AS slice FROM lt GROUP BY rid")
def tiles_fetch(spark, d):
    t = Tables(spark, d)
    return fasta.fetch(t.reference(), t.regions(), TILE).select("rid", "slice")


@_register("fasta_metadata", _CTE + "SELECT c::VARCHAR AS contig, max(fin) + 1 AS contig_len FROM reg GROUP BY c")
def fasta_metadata(spark, d):
    return fasta.metadata(Tables(spark, d).reference())


def _overlap(mode):
    def q(spark, d):
        t = Tables(spark, d)
        return intervals.range_join(t.regions(), t.spans(), ["contig"], mode=mode, size=64).select("rid", "contig", "pos", "ref_end")

    return q


_register("overlap_pos", _CTE + "SELECT rid, span.c::VARCHAR AS contig, pos, ref_end FROM reg JOIN span ON reg.c = span.c AND pos BETWEEN beg AND fin")(_overlap(0))
_register("overlap_span", _CTE + "SELECT rid, span.c::VARCHAR AS contig, pos, ref_end FROM reg JOIN span ON reg.c = span.c AND pos <= fin AND ref_end >= beg")(_overlap(1))


@_register("range_join_counts", _CTE + "SELECT rid, count(*) AS n, sum(ref_end - pos)::BIGINT AS width FROM reg JOIN span ON reg.c = span.c AND pos <= fin AND ref_end >= beg GROUP BY rid")
def range_join_counts(spark, d):
    return _overlap(2)(spark, d).groupBy("rid").agg(F.count("*").alias("n"), F.sum(F.expr("ref_end - pos")).alias("width"))


@_register("contig_alias", """WITH t AS (SELECT c_custkey::BIGINT AS id, CASE WHEN c_custkey % 3 = 0 THEN 'chr' ELSE '' END || (c_custkey % 12)::VARCHAR AS chr FROM customer),
k AS (SELECT CASE WHEN i % 2 = 0 THEN 'chr' || i ELSE i::VARCHAR END AS contig FROM range(10) r(i))
SELECT id, chr, coalesce((SELECT contig FROM k WHERE contig = chr), (SELECT contig FROM k WHERE starts_with(chr, 'chr') AND contig = substr(chr, 4)), (SELECT contig FROM k WHERE contig = 'chr' || chr)) AS vcf_contig FROM t""")
def contig_alias(spark, d):
    tasks = Tables(spark, d).read("customer").selectExpr("cast(c_custkey as bigint) as id", "'v' as vcf_key", "concat(if(c_custkey % 3 = 0, 'chr', ''), c_custkey % 12) as chr")
    known = spark.range(10).selectExpr("'v' as vcf_key", "if(id % 2 = 0, concat('chr', id), cast(id as string)) as contig")
    return intervals.alias_contigs(tasks, known).select("id", "chr", "vcf_contig")


_TASKS = "SELECT (rid * 3 + s) * 2 + h AS idx, c::VARCHAR AS chr, beg + 1 AS start, fin + 1 AS \"end\", 'v' AS vcf_key, 'g' || rid AS gene_id, 's' || s AS sample, (h + 1)::VARCHAR AS haplotype FROM reg, range(3) a(s), range(2) b(h)"


@_register("tasks_cross", _CTE + _TASKS)
def tasks_cross(spark, d):
    return Tables(spark, d).tasks(["s0", "s1", "s2"], ["1", "2"])


_ORDERS = "SELECT o_orderkey::BIGINT AS idx, 'c' || (o_custkey % 7) AS chr, (1 + o_custkey % 50)::BIGINT AS start, (100 + o_custkey % 50)::BIGINT AS \"end\", 'v' || (o_orderkey % 4) AS vcf_key, 's' || (o_orderkey % 3) AS sample, (1 + o_orderkey % 2)::VARCHAR AS haplotype FROM orders"


def _orders(spark, d):
    return Tables(spark, d).read("orders").selectExpr("cast(o_orderkey as bigint) as idx", "concat('c', o_custkey % 7) as chr", "cast(1 + o_custkey % 50 as bigint) as start", "cast(100 + o_custkey % 50 as bigint) as end", "concat('v', o_orderkey % 4) as vcf_key", "concat('s', o_orderkey % 3) as sample", "cast(1 + o_orderkey % 2 as string) as haplotype")


@_register("tasks_grouped", f"SELECT chr, start, \"end\", vcf_key, count(*) AS n, min(idx) AS first_idx, max(idx) AS last_idx FROM ({_ORDERS}) GROUP BY 1, 2, 3, 4")
def tasks_grouped(spark, d):
    return task_ops.group_tasks(_orders(spark, d))


@_register("tasks_chunked", f"SELECT idx, (row_number() OVER (PARTITION BY chr, start, \"end\", vcf_key ORDER BY idx) - 1) // 3 AS chunk FROM ({_ORDERS})")
def tasks_chunked(spark, d):
    return task_ops.chunk_tasks(_orders(spark, d), 3).select("idx", "chunk")


@_register("distinct_work", f"SELECT chr, start, \"end\", vcf_key, sample, haplotype, count(*) AS n, min(idx) AS first_idx FROM ({_ORDERS}) GROUP BY ALL")
def distinct_work(spark, d):
    return task_ops.distinct_work(_orders(spark, d))


@_register("task_shard", f"SELECT idx, chr FROM ({_ORDERS}) WHERE idx % 4 = 1")
def task_shard(spark, d):
    return task_ops.shard(_orders(spark, d), 1, 4).select("idx", "chr")


@_register("unknown_key_errors", f"SELECT idx, vcf_key, CASE WHEN vcf_key NOT IN ('v0', 'v2') THEN 'unknown vcf_key: ' || vcf_key END AS error FROM ({_ORDERS})")
def unknown_key_errors(spark, d):
    keys = spark.createDataFrame([("v0",), ("v2",)], "vcf_key string")
    return task_ops.unknown_keys(_orders(spark, d), keys).select("idx", "vcf_key", "error")


def _genes(spark, d):
    t = Tables(spark, d)
    return t.read("part").selectExpr("concat('g', p_partkey) as gene_id", "concat('chr', p_partkey % 9) as chr", "cast(p_partkey * 977 as bigint) as tss"), spark.range(6).selectExpr("concat('chr', id) as chr")


_GENES = "SELECT 'g' || p_partkey AS gene_id, 'chr' || (p_partkey % 9) AS chr, (p_partkey * 977)::BIGINT AS tss, p_partkey % 9 AS n FROM part"
_WORDS = "SELECT p_partkey::BIGINT AS id, CASE p_partkey % 4 WHEN 0 THEN upper(p_name) WHEN 1 THEN lower(p_name) WHEN 2 THEN '' ELSE upper(substr(p_name, 1, 3)) || lower(substr(p_name, 4)) END AS allele FROM part"


@_register("case_flags", f"SELECT id, regexp_matches(allele, '[a-z]') AS has_lower, regexp_matches(allele, '[A-Z]') AS has_upper FROM ({_WORDS})")
def case_flags(spark, d):
    allele = "case p_partkey % 4 when 0 then upper(p_name) when 1 then lower(p_name) when 2 then '' else concat(upper(substr(p_name, 1, 3)), lower(substr(p_name, 4))) end"
    words = Tables(spark, d).read("part").selectExpr("cast(p_partkey as bigint) as id", f"{allele} as allele")
    return words.select("id", classify.case_flags(F.col("allele")).alias("f")).select("id", "f.*")


_CALLS = "['0|1', '1|1', '.|0', './.', '0/1', '2|0', '1', '.']"


@_register("fallback_genotypes", f"""WITH g AS (SELECT c_custkey::BIGINT AS id, s, ({_CALLS})[((c_custkey * 5 + s * 3 + (c_custkey // 8) * s) % 8 + 1)::INT] IN ('0/1', '2|0', '1') AS f FROM customer, range(4) r(s))
SELECT id, bool_or(f) AS any_sample, bool_or(f AND s IN (0, 2)) AS active FROM g GROUP BY id""")
def fallback_genotypes(spark, d):
    calls = "array('0|1', '1|1', '.|0', './.', '0/1', '2|0', '1', '.')"
    gt = f"transform(sequence(0, 3), s -> {calls}[cast((c_custkey * 5 + s * 3 + (c_custkey div 8) * s) % 8 as int)])"
    rows = Tables(spark, d).read("customer").selectExpr("cast(c_custkey as bigint) as id", f"{gt} as gt")
    return rows.select("id", classify.any_fallback(F.col("gt")).alias("any_sample"), classify.any_fallback(F.col("gt"), F.array(F.lit(0), F.lit(2))).alias("active"))


_register("vcf_available", f"SELECT gene_id, chr, tss FROM ({_GENES}) WHERE n < 6")(lambda s, d: task_ops.available(*_genes(s, d))[0].select("gene_id", "chr", "tss"))
_register("vcf_missing", f"SELECT gene_id, chr, tss FROM ({_GENES}) WHERE n >= 6")(lambda s, d: task_ops.available(*_genes(s, d))[1].select("gene_id", "chr", "tss"))
_register("tss_windows", f"SELECT gene_id, chr, greatest(1, tss - 196608) AS start, tss + 196607 AS \"end\" FROM ({_GENES})")(lambda s, d: fasta.tss_windows(_genes(s, d)[0]))


@_register("prefix_max_end", _CTE + "SELECT c::VARCHAR AS contig, pos, max(ref_end) OVER (PARTITION BY c ORDER BY pos ROWS UNBOUNDED PRECEDING) AS pmax_end FROM span")
def prefix_max_end(spark, d):
    v = Tables(spark, d).spans().withColumn("vcf_key", F.lit("v")).withColumn("rec_no", F.col("pos"))
    return intervals.running_end(v).select("contig", "pos", "pmax_end")


@_register("mask_merge", _CTE + """, o AS (SELECT *, max(fin) OVER (PARTITION BY c ORDER BY beg, fin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM msk),
g AS (SELECT *, sum(CASE WHEN prior IS NULL OR beg > prior + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY c ORDER BY beg, fin ROWS UNBOUNDED PRECEDING) AS k FROM o)
SELECT c::VARCHAR AS contig, min(beg) AS beg, max(fin) AS fin FROM g GROUP BY c, k""")
def mask_merge(spark, d):
    return intervals.merge_intervals(Tables(spark, d).mask())


@_register("mask_overlap", _CTE + "SELECT DISTINCT span.c::VARCHAR AS contig, pos, ref_end, k FROM span JOIN msk ON msk.c = span.c AND msk.beg <= ref_end AND msk.fin >= pos")
def mask_overlap(spark, d):
    t = Tables(spark, d)
    return intervals.touched(t.spans(), t.mask(), size=64)


def _alleles(spark, d):
    """Records with every kind of ALT, from part."""
    alt = "element_at(array('C', 'G', 'AC', 'CAA', 'CA', '<DEL>', '<*>', '<NON_REF>', '*', '<INS>', 'TT', 'ACGT'), cast(p_size % 12 as int) + 1)"
    ref = "element_at(array('A', 'AC', 'C', 'CAA'), cast(p_partkey % 4 as int) + 1)"
    more = "if(p_partkey % 5 = 0, array('T'), cast(array() as array<string>))"
    return Tables(spark, d).read("part").selectExpr("cast(p_partkey as bigint) as id", "concat('v', p_partkey % 3) as vcf_key", f"concat(array({ref}), if(p_partkey % 17 = 0, cast(array() as array<string>), concat(array({alt}), {more}))) as alleles").withColumn("rlen", F.length(F.col("alleles")[0]))


_ALLELES = """WITH r AS (SELECT p_partkey::BIGINT AS id, 'v' || (p_partkey % 3) AS vcf_key, ['A', 'AC', 'C', 'CAA'][p_partkey % 4 + 1] AS ref,
  CASE WHEN p_partkey % 17 = 0 THEN [] ELSE list_concat([['C', 'G', 'AC', 'CAA', 'CA', '<DEL>', '<*>', '<NON_REF>', '*', '<INS>', 'TT', 'ACGT'][p_size % 12 + 1]], CASE WHEN p_partkey % 5 = 0 THEN ['T'] ELSE [] END) END AS alts FROM part),
u AS (SELECT id, vcf_key, ref, i, alts[i] AS alt FROM r, LATERAL (SELECT unnest(range(1, len(alts) + 1)) AS i)),
o AS (SELECT *, length(alt) - length(ref) AS dl, ref[1] = alt[1] AS same, CASE WHEN alt = '<DEL>' THEN 'SymbolicDel' WHEN alt IN ('<*>', '<NON_REF>') THEN 'GvcfRefBlock' WHEN alt[1] = '<' OR alt = '*' THEN 'Unsupported'
  WHEN length(alt) = length(ref) THEN 'SameLen' WHEN ref[1] = alt[1] AND length(alt) > length(ref) THEN 'Insert' WHEN ref[1] = alt[1] THEN 'Delete' ELSE 'Replace' END AS kind FROM u),
q AS (SELECT r.id, r.vcf_key, CASE WHEN count(kind) = 0 THEN 'RefOnly' WHEN bool_and(kind = 'SameLen') AND length(any_value(r.ref)) = 1 THEN 'Snp1' WHEN bool_and(kind = 'SameLen') THEN 'SameLen' WHEN bool_and(kind = 'Insert') THEN 'NormInsertion'
  WHEN bool_and(kind = 'Delete') THEN 'NormDeletion' WHEN bool_and(kind = 'SymbolicDel') THEN 'SymbolicDel' WHEN bool_and(kind = 'GvcfRefBlock') THEN 'GvcfBlock' WHEN bool_and(kind IN ('Insert', 'Delete', 'Replace')) THEN 'SimpleIndel' ELSE 'Complex' END AS kind,
  coalesce(bool_or(kind IN ('SymbolicDel', 'GvcfRefBlock')), false) AS symbolic, coalesce(bool_or(alt = '*'), false) AS star, coalesce(bool_and(kind = 'SameLen'), false) AS all_same_len, coalesce(bool_and(kind IN ('SameLen', 'Insert', 'Delete', 'SymbolicDel')), false) AS all_fast, count(kind) AS n_alts
  FROM r LEFT JOIN o ON o.id = r.id GROUP BY r.id, r.vcf_key)
"""


@_register("allele_ops", _ALLELES + "SELECT id, i::BIGINT AS alt_no, kind, (CASE WHEN kind = 'SymbolicDel' THEN 1 - length(ref) WHEN kind = 'GvcfRefBlock' THEN 0 ELSE dl END)::INTEGER AS len_diff, (CASE WHEN kind = 'SymbolicDel' THEN 1 WHEN kind IN ('GvcfRefBlock', 'Unsupported') THEN 0 WHEN same THEN 1 ELSE 0 END)::INTEGER AS trim_beg FROM o")
def allele_ops(spark, d):
    return classify.with_ops(_alleles(spark, d)).select("id", F.posexplode("ops").alias("i", "o")).select("id", (F.col("i") + 1).cast("long").alias("alt_no"), "o.kind", "o.len_diff", "o.trim_beg")


@_register("classify_records", _ALLELES + "SELECT id, kind, n_alts = 1 AS biallelic, n_alts > 1 AS multi, symbolic, star, all_same_len, all_fast FROM q")
def classify_records(spark, d):
    return classify.with_ops(_alleles(spark, d)).select("id", "kind", *[f"flags.{x}" for x in ("biallelic", "multi", "symbolic", "star", "all_same_len", "all_fast")])


@_register("compile_stats", _ALLELES + "SELECT vcf_key, 'record.' || kind AS what, count(*) AS n FROM q GROUP BY 1, 2 UNION ALL SELECT vcf_key, 'allele.' || kind, count(*) FROM o GROUP BY 1, 2")
def compile_stats(spark, d):
    return stats.compile_stats(classify.with_ops(_alleles(spark, d)))


@_register("variant_types", _ALLELES + "SELECT id, i::BIGINT AS alt_no, CASE WHEN alt IN ('<*>', '<NON_REF>') THEN 'ref' WHEN alt[1] = '<' OR alt = '*' THEN 'other' WHEN length(alt) <> length(ref) THEN 'indel' WHEN length(ref) = 1 THEN 'snp' ELSE 'mnp' END AS kind FROM u")
def variant_types(spark, d):
    return _alleles(spark, d).select("id", F.col("alleles")[0].alias("ref"), F.posexplode(F.slice("alleles", 2, 99)).alias("i", "alt")).select("id", (F.col("i") + 1).cast("long").alias("alt_no"), classify.type_of(F.col("ref"), F.col("alt")).alias("kind"))


@_register("lane_plan", _ALLELES + """, l AS (SELECT id % 50 AS region, CASE WHEN symbolic AND kind <> 'SymbolicDel' THEN 'f' WHEN star THEN 'f' WHEN kind = 'RefOnly' OR all_same_len THEN 's' WHEN all_fast THEN 'e' ELSE 'f' END AS l FROM q),
g AS (SELECT region, count(*) AS n, count(*) FILTER (l = 'f') AS n_fallback, count(*) FILTER (l = 's') AS n_same, count(*) FILTER (l = 'e') AS n_edit FROM l GROUP BY region)
SELECT *, CASE WHEN n_fallback > 0 THEN 'FallbackStateMachine' WHEN n_edit = 0 THEN 'SameLenOnly' WHEN n_same = 0 THEN 'NormalizedEditScript' ELSE 'MixedSimpleEdits' END AS lane FROM g""")
def lane_plan(spark, d):
    return planner.plan_regions(classify.with_ops(_alleles(spark, d)).withColumn("region", F.col("id") % 50), ["region"])


_GT = "['0|1', '1|1', '0/1', './.', '.|1', '1|.', '1', '.', '0|2', '0|1|1', '0/.', '1/1'][c_custkey % 12 + 1]"


def _gts(spark, d):
    return Tables(spark, d).read("customer").selectExpr("cast(c_custkey as bigint) as id", "element_at(array('0|1', '1|1', '0/1', './.', '.|1', '1|.', '1', '.', '0|2', '0|1|1', '0/.', '1/1'), cast(c_custkey % 12 as int) + 1) as gt")


@_register("gt_layout", f"""WITH g AS (SELECT c_custkey::BIGINT AS id, {_GT} AS gt FROM customer), a AS (SELECT *, string_split_regex(gt, '[/|]') AS a FROM g)
SELECT id, gt, CASE WHEN len(a) <> 2 THEN CASE WHEN gt = '.' THEN 'missing' ELSE 'fallback' END WHEN a[1] = '.' AND a[2] = '.' THEN 'missing' WHEN NOT contains(gt, '|') THEN 'fallback' WHEN a[1] NOT IN ('.', '0', '1') OR a[2] NOT IN ('.', '0', '1') THEN 'fallback'
ELSE (CASE a[1] WHEN '.' THEN 'missing' WHEN '1' THEN 'alt' ELSE 'ref' END) || '|' || (CASE a[2] WHEN '.' THEN 'missing' WHEN '1' THEN 'alt' ELSE 'ref' END) END AS layout FROM a""")
def gt_layout(spark, d):
    return _gts(spark, d).withColumn("layout", classify.gt_layout(F.col("gt")))


@_register("gt_decode", f"WITH g AS (SELECT c_custkey::BIGINT AS id, {_GT} AS gt FROM customer), a AS (SELECT id, gt, string_split_regex(gt, '[/|]') AS a FROM g) SELECT id, i::BIGINT AS i, TRY_CAST(a[i] AS INTEGER) AS allele, NOT contains(gt, '/') AS phased FROM a, LATERAL (SELECT unnest(range(1, len(a) + 1)) AS i)")
def gt_decode(spark, d):
    return _gts(spark, d).select("id", F.posexplode(decode_gt("gt")).alias("i", "a")).select("id", (F.col("i") + 1).cast("long").alias("i"), "a.allele", "a.phased")


@_register("hap_spec_parse", """WITH h AS (SELECT c_custkey::BIGINT AS id, ['R', 'a', 'L', 'LR', 's', 'SR', 'LA', 'SA', 'I', '1', '02', '1pIu', '2PIU', '0', '1x', 'garbage'][c_custkey % 16 + 1] AS h FROM customer), u AS (SELECT *, upper(h) AS u FROM h),
p AS (SELECT *, coalesce(TRY_CAST(regexp_extract(u, '^([0-9]+)(PIU)?$', 1) AS INTEGER), 0) AS hap, CASE u WHEN 'R' THEN 'ref' WHEN 'A' THEN 'alt' WHEN 'L' THEN 'long+ref' WHEN 'LR' THEN 'long+ref' WHEN 'S' THEN 'short+ref' WHEN 'SR' THEN 'short+ref' WHEN 'LA' THEN 'long+alt' WHEN 'SA' THEN 'short+alt' ELSE '' END AS prefer FROM u)
SELECT id, h, prefer <> '' OR u = 'I' OR hap > 0 AS valid, prefer, hap, u = 'I' OR (u LIKE '%PIU' AND hap > 0) AS iupac FROM p""")
def hap_spec_parse(spark, d):
    h = "element_at(array('R', 'a', 'L', 'LR', 's', 'SR', 'LA', 'SA', 'I', '1', '02', '1pIu', '2PIU', '0', '1x', 'garbage'), cast(c_custkey % 16 as int) + 1)"
    return Tables(spark, d).read("customer").selectExpr("cast(c_custkey as bigint) as id", f"{h} as h").withColumn("s", haplotype.parse_column(F.col("h"))).select("id", "h", "s.valid", "s.prefer", "s.hap", "s.iupac")


@_register("iupac_codes", """WITH m AS (SELECT (o_custkey % 5)::BIGINT AS g, bit_or([1, 2, 4, 8][o_orderkey % 4 + 1]) AS mask, (o_orderkey // 8)::BIGINT AS k FROM orders GROUP BY 1, 3)
SELECT g, k, mask::INTEGER AS mask, substr('ACMGRSVTWYHKDBN', mask::INTEGER, 1) AS code FROM m""")
def iupac_codes(spark, d):
    base = F.expr("element_at(array('A', 'c', 'G', 't'), cast(o_orderkey % 4 as int) + 1)")
    m = Tables(spark, d).read("orders").groupBy(F.expr("cast(o_custkey % 5 as bigint)").alias("g"), F.expr("cast(o_orderkey div 8 as bigint)").alias("k")).agg(F.bit_or(iupac.mask_of(base)).cast("int").alias("mask"))
    return m.withColumn("code", iupac.code_of(F.col("mask")))


def _consensus(name, expr="", options=Options(), sample=None, hap=None, sql=None, **more):
    def q(spark, d):
        t = Tables(spark, d)
        return t.results(t.tasks([sample] if sample else None, [hap] if hap else None), options, **more).select("idx", "seq")

    _register(name, sql or _sequence(expr))(q)


_CALL = "((p*31 + 1*17 + {h}*7) % 3)"
_H1, _H2 = _CALL.format(h=0), _CALL.format(h=1)
_BITS = "substr('ACMGRSVTWYHKDBN', ((CASE WHEN {0} = 0 OR {1} = 0 THEN (1 << x) ELSE 0 END) | (CASE WHEN {0} = 1 OR {1} = 1 THEN (1 << ((x + k) % 4)) ELSE 0 END))::INTEGER, 1)".format(_H1, _H2)
_consensus("consensus_all_alt", "coalesce(a, b)")
_consensus("consensus_iupac_all", "CASE WHEN k IS NULL THEN b ELSE substr('ACMGRSVTWYHKDBN', ((1 << x) | (1 << ((x + k) % 4)))::INTEGER, 1) END", Options(iupac_codes=True))
_consensus("consensus_hap1", f"CASE WHEN k IS NOT NULL AND {_H1} = 1 THEN a ELSE b END", sample="s1", hap="1")
_consensus("consensus_hap2_missing", f"CASE WHEN k IS NULL OR {_H2} = 0 THEN b WHEN {_H2} = 1 THEN a ELSE '?' END", Options(missing="?"), "s1", "2")
_consensus("consensus_sample_iupac", f"CASE WHEN k IS NULL OR ({_H1} = 2 AND {_H2} = 2) THEN b ELSE {_BITS} END", sample="s1")
_consensus("consensus_absent", "CASE WHEN k IS NULL THEN 'N' ELSE a END", Options(absent="N"))
_consensus("consensus_mark_snv", "CASE WHEN k IS NULL THEN b ELSE lower(a) END", Options(mark_snv="lc"))
_consensus("consensus_mask_fill", "CASE WHEN m THEN 'N' WHEN k IS NULL THEN b ELSE a END", mask=True)
_consensus("consensus_mask_lower", "CASE WHEN m THEN lower(coalesce(a, b)) ELSE coalesce(a, b) END", Options(mask_with="lc"), mask=True)


def _pick(prefer: str) -> str:
    """Without a haplotype number: equal calls as they are, a missing call leaves the base."""
    het = {"R": "b", "A": "a"}[prefer]
    return f"CASE WHEN k IS NULL OR {_H1} = 2 OR {_H2} = 2 THEN b WHEN {_H1} = {_H2} THEN CASE WHEN {_H1} = 1 THEN a ELSE b END ELSE {het} END"


_consensus("select_ref", _pick("R"), sample="s1", hap="R")
_consensus("select_alt", _pick("A"), sample="s1", hap="A")

# Base by base: frozen is the last base that an edit has settled; an indel may still share it as its anchor, a substitution may not.
_WALK = _CTE + """, walk(rid, fin, p, frozen, seq) AS (SELECT rid, fin, beg - 1, -1::BIGINT, '' FROM reg UNION ALL
SELECT w.rid, fin, lt.p, CASE WHEN k IS NULL OR lt.p < frozen OR (k = 3 AND lt.p = frozen) THEN frozen WHEN k = 2 THEN least(lt.p + 2, fin) ELSE lt.p END,
       seq || CASE WHEN lt.p > frozen THEN CASE WHEN k = 3 THEN a ELSE b END ELSE '' END || CASE WHEN k = 1 AND lt.p >= frozen THEN 'GG' ELSE '' END
FROM walk w JOIN lt ON lt.rid = w.rid AND lt.p = w.p + 1), s AS (SELECT rid, seq FROM walk WHERE p = fin)
"""
_consensus("consensus_indels", indels=True, sql=_WALK + "SELECT rid AS idx, seq FROM s")


@_register("run_stats", _WALK + "SELECT count(*) AS n, 0::BIGINT AS failed, sum(length(seq))::BIGINT AS total_len, min(length(seq)) AS min_len, max(length(seq)) AS max_len, NULL::VARCHAR AS first_error FROM s")
def run_stats(spark, d):
    t = Tables(spark, d)
    return stats.run_stats(t.results(t.tasks(), indels=True))


@_register("failed_tasks", _CTE + "SELECT rid AS idx, 'unknown vcf_key: w' AS error FROM reg WHERE rid % 3 = 1 UNION ALL SELECT rid, NULL FROM reg WHERE rid % 3 <> 1")
def failed_tasks(spark, d):
    t = Tables(spark, d)
    return t.results(t.tasks().withColumn("vcf_key", F.when(F.col("idx") % 3 == 1, "w").otherwise(F.col("vcf_key")))).select("idx", "error")


@_register("one_hot", _CTE + ", s AS (SELECT rid, p - min(p) OVER (PARTITION BY rid) AS place, coalesce(a, b) AS z FROM lt) SELECT rid AS idx, place, (z = 'A')::INTEGER AS a, (z = 'C')::INTEGER AS c, (z = 'G')::INTEGER AS g, (z = 'T')::INTEGER AS t FROM s")
def one_hot(spark, d):
    t = Tables(spark, d)
    rows = t.results(t.tasks()).select("idx", F.posexplode(sinks.one_hot("seq")).alias("at", "v"))
    return rows.select("idx", F.col("at").cast("long").alias("place"), *[F.col("v")[i].alias(n) for i, n in enumerate("acgt")])


@_register("fasta_text", _CTE + ", s AS (SELECT rid, string_agg(coalesce(a, b), '' ORDER BY p) AS seq FROM lt GROUP BY rid) SELECT 'g' || rid AS gene_id, '>g' || rid || chr(10) || substr(seq, 1, 25) || chr(10) || substr(seq, 26, 25) || chr(10) || substr(seq, 51) AS text FROM s")
def fasta_text(spark, d):
    t = Tables(spark, d)
    return sinks.fasta_text(t.results(t.tasks()), 25).select("gene_id", "text")


@_register("consensus_haplotypes", _CTE + """, h AS (SELECT i AS s, j AS h FROM range(3) a(i), range(2) b(j))
SELECT (rid * 3 + s) * 2 + h AS idx, string_agg(CASE WHEN k IS NOT NULL AND (p*31 + s*17 + h*7) % 3 = 1 THEN a ELSE b END, '' ORDER BY p) AS seq FROM lt, h GROUP BY rid, s, h""")
def consensus_haplotypes(spark, d):
    """The headline query: every region, sample and haplotype."""
    t = Tables(spark, d)
    return t.results(t.tasks(["s0", "s1", "s2"], ["1", "2"])).select("idx", "seq")
