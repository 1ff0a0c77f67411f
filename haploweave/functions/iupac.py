"""IUPAC ambiguity codes: bit masks, in Python and as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The code of mask m is CODES[m - 1]; A is 1, C is 2, G is 4, T is 8.
CODES = "ACMGRSVTWYHKDBN"
MASKS = {c: i + 1 for i, c in enumerate(CODES)}


def mask_of(base: Column) -> Column:
    """1 to 15; -1 for what is no code."""
    return F.when(F.length(base) == 1, F.coalesce(F.nullif(F.position(F.upper(base), F.lit(CODES)), F.lit(0)), F.lit(-1))).otherwise(F.lit(-1))


def code_of(mask: Column) -> Column:
    """The letter of a mask of 1 to 15, else null."""
    return F.when(mask.between(1, 15), F.substring(F.lit(CODES), mask.cast("int"), F.lit(1)))


def mix(alleles: list[str], chosen: list[int]) -> tuple[int | None, str | None]:
    """One allele that stands for all ``chosen`` (indexes in order): (index, letters), letters None for an allele as it is.

    Alleles with letters that are no codes are passed over. The longest usable ALT, the first of equals,
    receives the union of all usable alleles place by place. Without a usable ALT the first chosen allele
    stands for all, or the second if the first is REF.
    """
    if not chosen:
        return None, None
    plain = [i for i in chosen if alleles[i] and all(c.upper() in MASKS for c in alleles[i])]
    alts = [i for i in plain if i > 0]
    if not alts:
        return (chosen[1] if chosen[0] == 0 and len(chosen) > 1 else chosen[0]), None
    to = max(alts, key=lambda i: (len(alleles[i]), -i))
    union = [0] * len(alleles[to])
    for i in plain:
        for at, c in enumerate(alleles[i][: len(union)]):
            union[at] |= MASKS[c.upper()]
    return to, "".join(CODES[m - 1] for m in union)
