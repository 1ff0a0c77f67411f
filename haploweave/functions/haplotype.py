"""Haplotype specifications and the choice of an allele."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .iupac import mix

Gt = list[tuple[int | None, bool]]

#: Sample modes.
ALL_ALT, MIX_ALL, MIX_SAMPLE, ONE_SAMPLE = "all_alt", "mix_all", "mix_sample", "one_sample"


class BrokenVcf(Exception):
    """A genotype names an allele that the record does not have."""


@dataclass(frozen=True)
class Spec:
    """prefer: which allele of a heterozygote, of ref, alt, and length, of long, short; hap: 1-based, 0 for none; iupac: mixing."""

    prefer: frozenset = frozenset()
    hap: int = 0
    iupac: bool = False


_WORDS = {"R": {"ref"}, "A": {"alt"}, "L": {"long", "ref"}, "LR": {"long", "ref"}, "S": {"short", "ref"}, "SR": {"short", "ref"}, "LA": {"long", "alt"}, "SA": {"short", "alt"}}


def parse(text: str | None) -> Spec | None:
    """None for what is no specification."""
    t = (text or "").strip().upper() if text is not None else ""
    if t in _WORDS:
        return Spec(frozenset(_WORDS[t]))
    if t == "I":
        return Spec(iupac=True)
    if (m := re.fullmatch(r"(\d+)(PIU)?", t)) and int(m[1]) > 0:
        return Spec(hap=int(m[1]), iupac=bool(m[2]))
    return None


def parse_column(c: Column) -> Column:
    """struct(valid, prefer, hap, iupac) of a specification; prefer names both preferences, the longer word first."""
    t = F.upper(F.trim(c))
    digits = F.regexp_extract(t, r"^(\d+)(?:PIU)?$", 1)
    hap = F.coalesce(digits.try_cast("int"), F.lit(0))
    word = F.create_map(*[F.lit(x) for k, v in _WORDS.items() for x in (k, "+".join(sorted(v, key=lambda w: (-len(w), w))))])
    prefer = F.coalesce(F.try_element_at(word, t), F.lit(""))
    mixes = (t == "I") | (t.endswith("PIU") & (hap > 0))
    return F.struct(F.coalesce((prefer != "") | mixes | (hap > 0), F.lit(False)).alias("valid"), prefer.alias("prefer"), hap.alias("hap"), F.coalesce(mixes, F.lit(False)).alias("iupac"))


def mode_of(sample: str | None, haplotype: str | None, iupac_codes: bool) -> tuple[str, Spec]:
    if sample is not None:
        return (MIX_SAMPLE, Spec()) if haplotype is None else (ONE_SAMPLE, parse(haplotype) or Spec())
    return (MIX_ALL if iupac_codes and haplotype is None else ALL_ALT), Spec()


def parse_gt(text: str | None) -> Gt | None:
    """A genotype's text as (allele, phased) each, by the rules of sources.vcf.decode_gt."""
    if text is None:
        return None
    marks = [c for c in text if c in "/|"]
    number = lambda a: int(a) if re.fullmatch(r"[+-]?\d+", a) else None
    return [(number(a), not marks or marks[max(i - 1, 0)] == "|") for i, a in enumerate(re.split(r"[/|]", text))]


#: Outcomes of choose besides an allele index.
SKIP, MISSING = None, -1


def choose(mode: str, spec: Spec, alleles: list[str], rlen: int, gt: Gt | None, fill: bool) -> tuple[int | None, str | None]:
    """(allele index, letters that replace it); SKIP, or MISSING where ``fill`` asks for missing letters."""
    absent = (MISSING if fill else SKIP, None)
    n = len(alleles)
    if mode == ALL_ALT:
        return 1, None
    if mode == MIX_ALL:
        return mix(alleles, list(range(n))) if n > 1 else (SKIP, None)
    if gt is None and mode == ONE_SAMPLE:
        return SKIP, None
    known = sorted({a for a, _ in gt or () if a is not None and a < n})
    if mode == MIX_SAMPLE:
        return mix(alleles, known) if known else absent
    if not gt:
        return SKIP, None
    if spec.iupac and (not spec.hap or not (gt[0][1] or gt[-1][1])):
        return mix(alleles, known) if known else absent
    if spec.hap:
        if spec.hap > len(gt):
            return absent if gt[0][0] is None or gt[-1][0] is None else (SKIP, None)
        a = gt[spec.hap - 1][0]
        return absent if a is None else (a, None)
    return _pick(spec, alleles, rlen, gt, absent)


def _pick(spec: Spec, alleles: list[str], rlen: int, gt: Gt, absent: tuple) -> tuple[int | None, str | None]:
    """One allele of a genotype. Of different ones: by length, ties to the preferred kind and then to the first called; without a length the first ALT, if that is preferred, else REF."""
    calls = list(dict.fromkeys(a for a, _ in gt))
    if None in calls[:2]:
        return absent
    if len(calls) == 1:
        return calls[0], None
    called = [a for a in calls if a is not None]
    if max(called) >= len(alleles):
        raise BrokenVcf
    if spec.prefer & {"long", "short"}:
        sign, disliked = -1 if "long" in spec.prefer else 1, lambda a: (a == 0) != ("ref" in spec.prefer)
        return min(called, key=lambda a: (sign * (len(alleles[a]) if a else rlen), disliked(a))), None
    return next((a for a in called if a and "alt" in spec.prefer), 0), None
