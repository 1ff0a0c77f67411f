"""The lane of simple edits: the alleles of a region's records are spelled once, then joined for each of its tasks.

An edit beyond the last settled position meets the untouched slice, whatever a task took before it. So
the bytes that an allele writes, and whether its REF fits, are the same for every task of the region, and a
task is a walk over its choices. What needs more than that (an indel on a settled anchor, a trimmed or
overhanging record, symbolic alleles but <DEL> and reference blocks) goes to the general lane.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from ..functions.haplotype import ALL_ALT, MISSING, ONE_SAMPLE, SKIP, BrokenVcf, Spec, choose, parse_gt
from .apply import Chain, Failure, Options, Outcome, Record, consensus, hidden, masked, plain, spell


class _General(Exception):
    """The task needs the general lane."""


@dataclass(frozen=True)
class Edit:
    """letters replace span bases. grows: an insertion. filled: letters after its start that absent filling leaves. gap: the chain's part of it."""

    span: int
    letters: bytes
    grows: bool = False
    filled: int = 0
    gap: tuple[int, int, int] | None = None
    anchored: bool = False
    settles: bool = False


class Region:
    """One slice with its records. Genotypes are given task by task, as texts in the order of the records."""

    def __init__(self, raw: str, contig: str, start: int, records: list[Record], opt: Options, mask: list[tuple[int, int]] = ()):
        self.raw, self.contig, self.start, self.opt, self.mask = raw, contig, start, opt, list(mask)
        self.records = records
        self.slice = (masked(raw, start, self.mask, opt.mask_with) if self.mask else raw).encode()
        skip = lambda r: (len(r.alleles) == 1 and not opt.missing and not opt.absent) or (self.mask and opt.mask_with not in ("uc", "lc") and hidden(r, self.mask))
        self.walk = [(i, r, s) for i, r in enumerate(records) if not (s := bool(skip(r))) or opt.absent]
        self.picks: dict = {}
        self.edits: dict = {}

    def run(self, mode: str, spec: Spec, calls: list[str | None] | None = None) -> tuple[Outcome, bool]:
        """The outcome of one task, and whether the general lane made it."""
        try:
            return self._join(mode, spec, calls), False
        except _General:
            records = self.records if calls is None else [replace(r, gt=parse_gt(c)) for r, c in zip(self.records, calls)]
            return consensus(self.raw, self.contig, self.start, records, mode, spec, self.opt, self.mask), True

    def _pick(self, i: int, r: Record, mode: str, spec: Spec, call: str | None) -> tuple[int | None, str | None]:
        try:
            return choose(mode, spec, r.alleles, r.rlen, parse_gt(call), bool(self.opt.missing)) if mode != ALL_ALT or len(r.alleles) > 1 else (0, None)
        except BrokenVcf:
            raise _General from None

    def _edit(self, r: Record, pick: int, letters: str | None) -> Edit:
        """What the allele writes over the untouched slice. Whatever would fail is left to the general lane, which words the error."""
        at, ref, opt = r.pos - self.start, r.alleles[0], self.opt
        if at < 0 or at + r.rlen > len(self.slice) or pick >= len(r.alleles):
            raise _General
        if pick == MISSING:
            span = r.rlen if r.rlen > 1 and r.var_is_ref else 1
            old = plain(self.slice[at : at + span])
            ref = old if span > 1 else ref[:1]
            if old[:1].upper() != ref[:1].upper() or not old:
                raise _General
            new = spell(ref, opt.missing * span, span, old[0], replace(opt, mark_del=None, mark_ins=None))
            return Edit(span, new.encode(), filled=span)
        alt = letters if letters is not None else r.alleles[pick]
        gone = alt.upper() == "<DEL>"
        if alt in ("<*>", "<NON_REF>"):
            return Edit(r.rlen, b"", filled=r.rlen, settles=True)
        if (alt.startswith("<") and not gone) or alt in ("*", "") or not r.rlen:
            raise _General
        want = ref[: r.rlen].upper()
        if not gone and (not want or plain(self.slice[at : at + len(want)]).upper() != want):
            raise _General
        keep = 1 if gone else int(len(alt) != r.rlen and ref[:1] == alt[:1])
        anchored = bool(keep) and (r.rlen != 1 if gone else len(alt) != r.rlen)
        new = spell(ref, ref[:1] if gone else alt, r.rlen, plain(self.slice[at : at + 1]), opt)
        grows = len(new) > r.rlen
        stay = int(ref[0] == new[0]) if grows else min(keep, len(new))
        same = int(ref[:1].upper() == new[:1].upper())
        gap = (r.pos + same, r.rlen - same, len(new) - same) if len(new) != r.rlen else None
        return Edit(r.rlen, self.slice[at : at + stay] + new[stay:].encode(), grows, len(new) - stay + 1 if grows else len(new), gap, anchored)

    def _join(self, mode: str, spec: Spec, calls: list[str | None] | None) -> Outcome:
        opt, start, size = self.opt, self.start, len(self.slice)
        absent = opt.absent.encode() if opt.absent else None
        picks = self.picks.setdefault((mode, spec), {})
        gaps: list[tuple[int, int, int]] = []
        out, next_, frozen, filled, shift, applied, inserted = [], 0, -1, -1, 0, 0, False

        def fill(pos: int) -> None:
            nonlocal next_
            if not size + shift or pos <= frozen + 1 or pos <= start:
                return
            begin, end = max(filled - shift, next_, 0), min(pos - start, size)
            if begin < end:
                out.append(self.slice[next_:begin])
                out.append(absent * (end - begin))
                next_ = end

        for i, r, skip in self.walk:
            if absent:
                fill(r.pos)
            if skip:
                continue
            call = calls[i] if calls is not None else None
            found = picks.get((i, call))
            if found is None:
                found = picks[i, call] = self._pick(i, r, mode, spec, call)
            pick, letters = found
            if pick is SKIP:
                continue
            if pick != MISSING and (len(r.alleles) == 1 or (mode == ONE_SAMPLE and pick == 0)):
                if absent and r.pos + r.rlen - 1 > frozen:
                    frozen, filled = r.pos + r.rlen - 1, r.pos - start + shift + r.rlen
                continue
            if pick != MISSING and pick == 0 and r.pos <= frozen < r.pos + r.rlen - 1:
                raise _General
            key = (i, pick, letters)
            edit = self.edits.get(key)
            if r.pos <= frozen:
                if pick == MISSING:
                    continue
                if edit is None:  # only its anchor matters here; a REF that does not fit may never be reached
                    alt = letters if letters is not None else r.alleles[pick] if pick < len(r.alleles) else ""
                    if not alt:
                        raise _General
                    gone = alt.upper() == "<DEL>"
                    indel = gone or alt.startswith("<INS") or (not alt.startswith("<") and alt != "*" and len(alt) != r.rlen and r.alleles[0][:1] == alt[:1])
                else:
                    indel = edit.anchored
                if r.pos == frozen and indel and not inserted:
                    raise _General
                continue
            if edit is None:
                edit = self.edits[key] = self._edit(r, pick, letters)
            at = r.pos - start
            if edit.settles:
                if r.pos + edit.span - 1 > frozen:
                    frozen, filled = r.pos + edit.span - 1, at + shift + edit.span
                continue
            if at < next_:
                raise _General
            out.append(self.slice[next_:at])
            out.append(edit.letters)
            next_ = at + edit.span
            filled = at + shift + edit.filled
            shift += len(edit.letters) - edit.span
            if edit.gap:
                gaps.append(edit.gap)
            frozen, inserted = r.pos + edit.span - 1, edit.grows
            applied += 1
        if absent:
            fill(start + size)
        out.append(self.slice[next_:])
        text = None
        if opt.chain:
            chain = Chain(self.contig, start, len(self.raw))
            chain.edits = gaps
            text = chain.text()
        return Outcome(b"".join(out).decode("utf-8", "replace"), text, None, None, applied, frozen)


__all__ = ["Region", "Failure"]
