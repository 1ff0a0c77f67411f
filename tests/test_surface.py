"""Readers, sinks, command lines and the stream on small files."""

import gzip
import json
import logging

import pytest

from haploweave import cache_cli, harness, schemas
from haploweave.engine import ConsensusEngine, Task, build_tasks, get_htslib_log_level, set_htslib_log_level
from haploweave.operators.sinks import write_fasta
from haploweave.sources import fasta, tables
from haploweave.streaming.tasks import stream_results

HEAD = "##fileformat=VCFv4.3\n##contig=<ID=chr1,length=8>\n##FORMAT=<ID=GT,Number=1,Type=String,Description=\"GT\">\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS1\tS2\n"
ROWS = "chr1\t2\t.\tC\tG\t.\t.\t.\tGT\t0|1\t1|0\nchr1\t3\t.\tG\tT\t.\t.\t.\tGT\t1|0\t0|1\nchr1\t5\t.\tA\tC\t.\t.\t.\tGT\t0|1:9\t0|0\nchr3\t1\t.\tA\tC\t.\t.\t.\tGT\t0|1\t0|0\n"


@pytest.fixture
def files(tmp_path):
    (tmp_path / "r.fa").write_text(">chr1\nACGT\nACGT\n>chr2 a>b\r\nTTTT\r\n>chr4\n\n")
    (tmp_path / "v.chr1.vcf").write_text(HEAD + ROWS)
    half = len(ROWS) // 2
    (tmp_path / "v.vcf.bgz").write_bytes(gzip.compress(HEAD.encode()) + gzip.compress(ROWS[:half].encode()) + gzip.compress(ROWS[half:].encode()))
    (tmp_path / "genes.csv").write_text("gene_id,chr,tss,symbol,strand\ng1,chr1,4,A,+\n\ng2,chr9,4,B,-\n")
    (tmp_path / "samples.txt").write_text("S1\n\nS2\n")
    return tmp_path


def engine(spark, files, vcf="v.chr1.vcf", **o):
    return ConsensusEngine(spark, str(files / "r.fa"), {"v": str(files / vcf)}, **o)


TASKS = build_tasks([("chr1", 1, 8, "v", "g")], ["S1", "S2"], ["1", "2"])


def test_compressed_members(spark, files):
    assert engine(spark, files, "v.vcf.bgz").consensus_many(TASKS) == engine(spark, files).consensus_many(TASKS)


def test_group_size_changes_nothing(spark, files):
    tasks = TASKS + build_tasks([("chr1", 1, 8, "v", "again"), ("chr2", 1, 3, "v", "h")], [None, "S1", "nobody"], [None, "1", "L"])
    want = engine(spark, files).consensus_many(tasks)
    assert len(want) == len(tasks) == 22
    for most in (1, 3):
        assert engine(spark, files, max_tasks_per_group=most).consensus_many(tasks) == want


def test_one_file_of_two_keys(spark, files):
    path = str(files / "v.chr1.vcf")
    e = ConsensusEngine(spark, str(files / "r.fa"), {"a": path, "b": path})
    assert e.n_records("a") == e.n_records("b") == 3 and e.n_sample("b") == 2 and e.has_gt("a") and e.contig_of("b", "1") == "chr1"
    got = e.consensus_many([Task("chr1", 1, 8, k, "g") for k in ("a", "b")])
    assert got[0].seq == got[1].seq == b"AGTTACGT"
    regions = spark.createDataFrame([("a", "1", 1, 2), ("b", "chr1", 1, 8)], "vcf_key string, chr string, start long, end long")
    assert e.query_set(regions).count() == 3
    assert {(r["vcf_key"], r["n"], r["lane"]) for r in e.plan_query_set(regions).collect()} == {("a", 1, "SameLenOnly"), ("b", 2, "SameLenOnly")}
    e.close()


def test_warnings(spark, files, caplog):
    e = engine(spark, files)
    assert e.input_warnings() == ["v: 1 malformed rows left out", "v: contig chr3 is not declared in the header"]
    with caplog.at_level(logging.WARNING, "haploweave"):
        caplog.clear()
        e.consensus_many([Task("chr1", 0, 4, "v", f"g{i}") for i in range(30)])
    assert len(caplog.records) == 21 and "not logged" in caplog.records[-1].getMessage()
    set_htslib_log_level("trace")
    assert get_htslib_log_level() == "trace"
    with pytest.raises(ValueError):
        set_htslib_log_level("loud")


def test_fasta_files(spark, files):
    tasks = TASKS + [Task("chr1", 0, 4, "v", "a/b"), Task("chr1", 1, 8, "v", "g")]
    assert write_fasta(engine(spark, files).results(tasks), str(files / "out")) == 6
    found = {str(p.relative_to(files / "out")): p.read_text() for p in (files / "out").rglob("*.fa")}
    assert set(found) == {"S1/g.1.fa", "S1/g.2.fa", "S2/g.1.fa", "S2/g.2.fa", "_ref/a_b.all.fa", "_ref/g.all.fa"}
    assert found["S1/g.1.fa"] == ">g\nACTTACGT\n" and found["_ref/a_b.all.fa"].startswith(">a/b ERROR=ref fetch failed")


def test_reference(spark, files):
    ref = fasta.read_fasta(spark, str(files / "r.fa"), tile=3)
    assert {r["contig"]: r["contig_len"] for r in fasta.metadata(ref).collect()} == {"chr1": 8, "chr2": 4, "chr4": 0}
    assert fasta.n_seq(ref) == 3 and fasta.has_seq(ref, "chr2") and not fasta.has_seq(ref, "chr3")
    assert [r["bases"] for r in ref.where("contig = 'chr1'").orderBy("tile").collect()] == ["ACG", "TAC", "GT"]


def test_genes(spark, files):
    assert [tuple(r) for r in tables.read_genes(spark, str(files / "genes.csv")).orderBy("gene_id").collect()] == [("g1", "chr1", 4, "A", "+"), ("g2", "chr9", 4, "B", "-")]
    for bad in ("g3,chr1\n", "g3,chr1,x,C,+\n"):
        (files / "bad.csv").write_text(bad)
        with pytest.raises(Exception):
            tables.read_genes(spark, str(files / "bad.csv")).collect()


def test_cache_cli(spark, files, capsys):
    assert cache_cli.main([str(files / "v.chr1.vcf")], spark) == 0 and capsys.readouterr().out.startswith("built\t")
    assert cache_cli.main([str(files / "gone.vcf"), str(files / "v.chr1.vcf")], spark) == 1 and "hit\t" in capsys.readouterr().out
    with pytest.raises(SystemExit) as e:
        cache_cli.main([], spark)
    assert e.value.code == 2


def test_harness(spark, files):
    args = ["--ref", str(files / "r.fa"), "--vcf-pattern", str(files / "v.{chr}.vcf"), "--genes", str(files / "genes.csv"), "--samples", str(files / "samples.txt")]
    got = json.loads(harness.main(args, spark))
    assert got["n"] == 4 and got["max_len"] == 8 and got["mode"] == "many"
    assert json.loads(harness.main([*args, "--limit-samples", "1", "--chrom", "chr1", "--limit-genes", "1", "--mode", "iter"], spark))["n"] == 2
    with pytest.raises(FileNotFoundError, match="chr9"):
        harness.main([*args, "--strict"], spark)


def test_stream_of_task_files(spark, files):
    (files / "in").mkdir()
    rows = [{"idx": i, "chr": t.chr, "start": t.start, "end": t.end, "vcf_key": t.vcf_key, "gene_id": t.gene_id, "sample": t.sample, "haplotype": t.haplotype} for i, t in enumerate(TASKS)]
    e, got = engine(spark, files), []
    for n, part in enumerate((rows[:1], rows[1:])):
        (files / "in" / f"{n}.json").write_text("\n".join(map(json.dumps, part)))
        stream_results(spark, e, str(files / "in"), lambda df, _: got.extend((r["idx"], r["seq"]) for r in df.collect()), str(files / "state")).awaitTermination(120)
    assert sorted(got) == [(i, r.seq.decode()) for i, r in enumerate(e.consensus_many(TASKS))]
    assert set(schemas.TASKS.replace("`", "").split()) >= set(rows[0])
