"""The engine end to end on small files."""

import pytest

from haploweave.engine import ConsensusEngine, Task, build_cache, build_tasks
from haploweave.sources.vcf import read_vcf

HEAD = "##fileformat=VCFv4.3\n##contig=<ID=chr1,length=8>\n##FORMAT=<ID=GT,Number=1,Type=String,Description=\"GT\">\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS1\tS2\n"


@pytest.fixture
def files(tmp_path):
    (tmp_path / "r.fa").write_text(">chr1\nACGT\nACGT\n>chr2 more\nTTTT\n")
    (tmp_path / "v.vcf").write_text(HEAD + "chr1\t2\t.\tC\tG\t.\t.\t.\tGT\t0|1\t1|0\nchr1\t3\t.\tG\tT\t.\t.\t.\tGT\t1|0\t0|1\nchr1\t5\t.\tA\tC\t.\t.\t.\tGT\t0|1:9\t0|0\n")
    (tmp_path / "m.bed").write_text("# mask\nchr1 4 5\n\n")
    return tmp_path


def engine(spark, files, **o):
    return ConsensusEngine(spark, str(files / "r.fa"), {"v": str(files / "v.vcf")}, **o)


REGION = [("chr1", 1, 8, "v", "g")]


@pytest.mark.parametrize("options,expected", [
    ({}, "ACTTACGT AGGTACGT AGGTACGT ACTTACGT"),
    ({"mark_snv": "X"}, "ACXTACGT AXGTACGT AXGTACGT ACXTACGT"),
    ({"absent": "N"}, "NCTNNNNN NGGNNNNN NGGNNNNN NCTNNNNN"),
    ({"mask": True}, "ACTTNCGT AGGTNCGT AGGTNCGT ACTTNCGT"),
])
def test_batch(spark, files, options, expected):
    if "mask" in options:
        options = {"mask": str(files / "m.bed")}
    got = engine(spark, files, **options).consensus_many(build_tasks(REGION, ["S1", "S2"], ["1", "2"]))
    assert [r.seq.decode() for r in got] == expected.split()


def test_errors_stats_and_iteration(spark, files):
    e = engine(spark, files)
    tasks = [Task("chr1", 1, 8, "v", "a"), Task("chr1", 1, 8, "nope", "b"), Task("chr1", 0, 4, "v", "c"), Task("1", 1, 4, "v", "d"), Task("chr2", 1, 3, "v", "e")]
    got = e.consensus_many(tasks)
    assert [r.seq for r in got] == [b"AGTTACGT", None, None, None, b"TTT"]
    assert got[1].error == "unknown vcf_key: nope"
    assert e.consensus_many_stats(tasks) == (2, 11, 3, 8)
    it = e.consensus_iter(tasks, ordered=True)
    assert it.next_batch(0) == [] and [i for i, _ in it.next_batch(3)] == [0, 1, 2] and len(it.next_batch_bytes(9)) == 2 and it.next_batch(1) is None
    assert "run.n=1" in e.consensus_many_profile(tasks[:1])
    assert any(x.startswith("vcf.v.record.Snp1=2") for x in e.compile_stats())
    assert e.sample_names("v") == ["S1", "S2"] and e.query("v", "1", 2, 2).count() == 1
    with pytest.raises(RuntimeError):
        engine(spark, files, error_mode="strict").consensus_many(tasks)
    with pytest.raises(ValueError):
        engine(spark, files, regions_overlap=3)


def test_cache(spark, files):
    path = str(files / "v.vcf")
    assert build_cache(spark, [path, path])[0].status == "built"
    assert build_cache(spark, [path])[0].status == "hit"
    assert build_cache(spark, [path], force=True)[0].status == "forced"
    with pytest.raises(OSError, match="gone"):
        build_cache(spark, [str(files / "gone.vcf")])


def test_engine_reads_a_valid_cache(spark, files, monkeypatch):
    path, region = str(files / "v.vcf"), build_tasks(REGION, ["S1", "S2"], ["1", "2"])
    want = engine(spark, files).consensus_many(region)
    store = str(files / "store")
    build_cache(spark, [path], cache_dir=store)
    parsed = []

    def no_text(*args):
        parsed.append(args[1])
        return read_vcf(*args)

    monkeypatch.setattr("haploweave.engine.read_vcf", no_text)
    cached = engine(spark, files, cache_dir=store)
    assert cached.consensus_many(region) == want and not parsed
    assert cached.sample_names("v") == ["S1", "S2"]
    engine(spark, files)  # no cache beside the file
    assert parsed == [path]
    with open(path, "a") as f:
        f.write("chr1\t7\t.\tG\tC\t.\t.\t.\tGT\t1|1\t1|1\n")
    changed = engine(spark, files, cache_dir=store).consensus_many(region)
    assert parsed == [path, path] and [r.seq[6:7] for r in changed] == [b"C"] * 4
    assert build_cache(spark, [path], cache_dir=store)[0].status == "rebuilt"
    assert engine(spark, files, cache_dir=store).consensus_many(region) == changed and len(parsed) == 3
