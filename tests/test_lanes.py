"""The lane of simple edits against the general lane."""

import random

import pytest

from haploweave.functions.haplotype import mode_of, parse_gt
from haploweave.operators.apply import Options, Record, consensus
from haploweave.operators.lanes import Region

OPTIONS = [{}, {"chain": True}, {"absent": "n"}, {"missing": "?"}, {"missing": "?", "absent": "-", "mark_snv": "lc"}, {"mark_del": "-", "mark_ins": "#", "mark_snv": "X"}, {"iupac_codes": True}, {"mark_ins": "lc", "chain": True, "absent": "."}, {"mask_with": "lc"}]
TASKS = [(None, None), ("s", None), *[("s", h) for h in ("1", "2", "3", "R", "A", "L", "SA", "I", "1pIu", "junk")]]


def region(r, kinds):
    """Random records on a random slice, some of them against its edges, on one place or under a wrong REF."""
    genome = "".join(r.choice("ACGTacgt") for _ in range(120))
    start = r.choice([0, 10])
    raw, records, calls = genome[start : r.choice([60, 120])], [], []
    for p in sorted(r.choices(range(max(start - 3, 0), start + len(raw)), k=r.randint(0, 18))):
        kind = r.choice(kinds)
        n = r.randint(1, 4) if kind != "snv" else 1
        ref = genome[p : p + n].upper()
        other = lambda k: "".join(r.choice("ACGT") for _ in range(k))
        alts = {"snv": [other(1) for _ in range(r.randint(1, 2))], "same": [other(len(ref))], "ins": [ref + other(2)], "del": [ref[0]], "odd": [r.choice(["<DEL>", "*", "<INS>", other(3)])], "block": ["<NON_REF>"], "none": []}[kind]
        rlen = len(ref) + (r.randint(0, 5) if kind == "block" else 0)
        if r.random() < 0.01:
            ref = other(len(ref))
        records.append(Record(p, rlen, [ref, *alts], all(a in ("<*>", "<NON_REF>") for a in alts)))
        a = [*map(str, range(len(alts) + 1)), "."]
        calls.append(r.choice([None, r.choice(a), r.choice(a) + r.choice("/|") + r.choice(a), r.choice(a) + r.choice("/|") + r.choice(a), "0|1" if alts else "0|0", "7|0" if r.random() < 0.05 else "1|1"]))
    mask = sorted({(b, b + r.randint(0, 6)) for b in r.choices(range(start, start + len(raw)), k=r.choice([0, 0, 2]))})
    return raw, start, records, calls, mask


@pytest.mark.parametrize("options", OPTIONS)
def test_lanes_agree(options):
    r, opt, fast = random.Random(str(options)), Options(**options), 0
    for turn in range(250):
        kinds = [["snv"], ["snv", "same", "none"], ["ins", "del"], ["snv", "ins", "del", "odd", "block", "none"]][turn % 4]
        raw, start, records, calls, mask = region(r, kinds)
        shared = Region(raw, "c", start, records, opt, mask)
        for sample, hap in TASKS:
            mode, spec = mode_of(sample, hap, opt.iupac_codes)
            want = consensus(raw, "c", start, [Record(x.pos, x.rlen, x.alleles, x.var_is_ref, parse_gt(c)) for x, c in zip(records, calls)], mode, spec, opt, mask)
            got, general = shared.run(mode, spec, calls)
            fast += not general
            assert (got.seq, got.chain, got.error, got.kind, got.napplied, got.frozen) == (want.seq, want.chain, want.error, want.kind, want.napplied, want.frozen), (options, sample, hap, raw, start, records, calls, mask)
    assert fast > 250 * len(TASKS) / 4


def test_no_records():
    for opt, text in ((Options(), "ACgt"), (Options(absent="N"), "NNNN")):
        got, general = Region("ACgt", "c", 5, [], opt).run(*mode_of(None, None, False))
        assert got.seq == text and not general
