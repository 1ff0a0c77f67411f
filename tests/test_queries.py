"""Registered queries over variants read every lineitem row."""

import random

import duckdb
import pytest

from haploweave.plans.queries import ORACLE, QUERIES

SNV = ["consensus_all_alt", "overlap_span", "range_join_counts"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    r, d = random.Random(3), str(tmp_path_factory.mktemp("tables"))
    rows = [(r.randint(0, 40), r.randint(1, 7), r.randint(0, 99), r.randint(0, 9)) for _ in range(700)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long").write.parquet(f"{d}/lineitem.parquet")
    return d, rows


def brute(rows):
    """Whole contigs, cut in regions of 60: every row is put into its site, sites are applied from left to right."""
    n = max(8 * o + i for o, i, _, _ in rows) // 60 + 1
    site = {}
    for o, i, part, supp in rows:
        site[supp % 5, 8 * o + i] = site.get((supp % 5, 8 * o + i), 0) + part
    snv, edit, taken = {}, {}, 0
    for rid in range(5 * n):
        c, beg = rid // n, 60 * (rid % n)
        a, b, held, gone = "", "", -1, set()
        for p in range(beg, beg + 60):
            base = "ACGT"[(p * p + 3 * p + c) % 4]
            k = 1 + site[c, p] % 3 if (c, p) in site else None
            taken += k is not None
            other = "ACGT"[((p * p + 3 * p + c) % 4 + (k or 0)) % 4]
            a += other
            alive = p not in gone
            ok = k is not None and (p > held or (p == held and k != 3))
            b += (other if ok and k == 3 else base) if alive else ""
            if ok:
                b += "GG" if k == 1 else ""
                gone |= {p + 1, p + 2} if k == 2 else set()
                held = min(p + 2, beg + 59) if k == 2 else p
        snv[rid], edit[rid] = a, b
    return snv, edit, taken, len(site)


def test_every_row_is_used(spark, tables):
    d, rows = tables
    snv, edit, taken, sites = brute(rows)
    assert taken == sites
    got = lambda name: {r["idx"]: r["seq"] for r in QUERIES[name](spark, d).collect()}
    assert got("consensus_all_alt") == snv
    assert got("consensus_indels") == edit
    assert QUERIES["overlap_pos"](spark, d).count() == sites


@pytest.mark.parametrize("name", [*SNV, "consensus_indels", "run_stats"])
def test_sql(spark, tables, name):
    d, _ = tables
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{d}/lineitem.parquet/*.parquet'")
    con.execute("CREATE TABLE supplier (s_suppkey BIGINT)")
    want = con.execute(ORACLE[name])
    cols = [c[0] for c in want.description]
    key = lambda rows: sorted(map(str, rows))
    assert key(map(tuple, QUERIES[name](spark, d).select(*cols).collect())) == key(want.fetchall())
