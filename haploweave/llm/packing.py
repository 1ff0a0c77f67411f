"""Best-fit packing by a configuration linear program over the length histogram.

Documents become token pieces of at most ``capacity`` tokens. The program has a
variable per configuration (a multiset of lengths that fits a sequence) and asks
for the fewest sequences that cover the histogram. It is solved by multiplicative
weights: every length has a price that falls as it is covered, and a knapsack
dynamic program finds the dearest configuration. The fractional counts are rounded
down to what the histogram still has; the remainder is packed best fit (the
largest length that still fits), configuration by configuration.

The histogram and the plan have at most ``capacity`` lengths and a number of
configurations that depends on capacity and ``steps``, not on the corpus; only
they pass through the driver. Pieces are numbered within their length in salted
groups, so a length that a third of all pieces have is spread over ``SALTS`` tasks.

Defined cases: a special token's string in a text is its id, and what is around it is encoded
apart; null and empty texts are the end token alone; repeated rows and
ids are packed one by one; null ids are kept; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import bound_batches, written
from .textblock import blocks, spans, trim

SALTS = 1024
#: First bytes of characters that are never white space (C2, E1, E2 and E3 begin some that are), and last bytes of such.
AFTER = np.ones(256, bool)
AFTER[[*range(0x21), 0x7F, 0xC2, 0xE1, 0xE2, 0xE3]] = False
BEFORE = np.zeros(256, bool)
BEFORE[0x21:0x7F] = True
_ENCODERS: dict = {}


class Encoder:
    """Token ids of blocks of texts.

    A single space always begins a token of the pattern if the character after it, or the one before it, is
    no white space (``AFTER`` and ``BEFORE`` are bytes that surely belong to such characters), so the
    stretches between such spaces are encoded on their own and remembered (at most ``keep`` of them);
    new ones are encoded in one string and told apart by the widths of the tokens. Texts with runs of spaces are encoded in one go.
    """

    def __init__(self, vocabulary: str, pattern: str, specials: dict[str, int] | None = None, keep: int = 300_000):
        import tiktoken

        self.specials = {s.encode(): i for s, i in (specials or {}).items()}
        self.special = re.compile(b"|".join(re.escape(s) for s in sorted(self.specials, key=len, reverse=True)) or b"(?!)")

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.width = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.width[i] = len(token)
        self.keys, self.start, self.count, self.pool = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
        self.keep = keep

    def _encode(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all parts in a row, and how many each has."""
        texts = [p.decode() for p in parts]
        plain = np.array([t[:1] == " " and not t[1:2].isspace() and not t[-1].isspace() for t in texts], bool)
        ids = np.asarray(self.bpe.encode_ordinary("".join(t for t, y in zip(texts, plain) if y)), np.uint32)
        ends = np.searchsorted(np.cumsum(self.width[ids]), np.cumsum([len(p) for p, y in zip(parts, plain) if y]), "right")
        count = np.zeros(len(parts), np.int64)
        count[plain] = np.diff(ends, prepend=0)
        rest = [np.asarray(self.bpe.encode_ordinary(texts[i]), np.uint32) for i in np.flatnonzero(~plain)]
        count[~plain] = [len(x) for x in rest]
        out = np.zeros(int(count.sum()), np.uint32)
        other = np.repeat(~plain, count)
        out[~other] = ids
        out[other] = np.concatenate(rest) if rest else out[:0]
        return out, count

    def __call__(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a block in a row, and each text's bounds among them."""
        found = [(m.start(), m.end(), self.specials[m.group()]) for m in self.special.finditer(data.tobytes())] if self.specials else []
        row = lambda i: int(np.searchsorted(offs, i, "right"))
        if any(row(s) != row(e - 1) for s, e, _ in found):  # strings over the end of a text: look at each text
            found = [(o + m.start(), o + m.end(), self.specials[m.group()]) for o, e in zip(offs, offs[1:]) for m in self.special.finditer(data[o:e].tobytes())]
        if not found:
            return self._plain(data, offs)
        # The stretches between specials are texts of their own; the ids of specials go between them.
        start, end, ids_of = (np.asarray(x) for x in zip(*found))
        gone = np.zeros(len(data), bool)
        for s, e, _ in found:
            gone[s:e] = True
        left = lambda i: i - np.append(0, np.cumsum(gone))[i]
        order = np.argsort(np.concatenate([offs, start]), kind="stable")
        cuts = left(np.concatenate([offs, start]))[order]
        is_special = order >= len(offs)
        # A special at the start of a text follows the text's bound.
        ids, to = self._plain(data[~gone], cuts)
        before = np.cumsum(is_special) - is_special
        return np.insert(ids, to[is_special], ids_of[order[is_special] - len(offs)]).astype(np.uint32), (to + before)[~is_special]

    def _plain(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, rows = len(data), len(offs) - 1
        if not n:
            return np.zeros(0, np.uint32), np.zeros(rows + 1, np.int64)
        space = data == 32
        edge = np.zeros(n + 1, bool)
        edge[offs] = True
        twice = np.flatnonzero(space[1:] & space[:-1] & ~edge[1:n])
        cut = np.zeros(n, bool)
        cut[1:-1] = space[1:-1] & ~space[:-2] & ~space[2:] & ~edge[2:n] & (AFTER[data[2:]] | BEFORE[data[:-2]])
        for r in np.unique(np.searchsorted(offs, twice, "right") - 1):
            cut[offs[r] : offs[r + 1]] = False
        starts = np.flatnonzero(cut | edge[:n])
        ends = np.append(starts[1:], n)
        keys, first, which = np.unique(spans(data, starts, ends), return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        new = self.keys[at] != keys if len(self.keys) else np.ones(len(keys), bool)
        if new.any():
            if len(self.keys) + int(new.sum()) > self.keep:
                self.keys, self.start, self.count, self.pool = keys[:0], self.start[:0], self.count[:0], self.pool[:0]
                new[:] = True
            raw = data.tobytes()
            ids, count = self._encode([raw[starts[i] : ends[i]] for i in first[new]])
            start = len(self.pool) + np.cumsum(count) - count
            self.pool = np.concatenate([self.pool, ids])
            all_keys = np.concatenate([self.keys, keys[new]])
            order = np.argsort(all_keys)
            self.keys, self.start, self.count = all_keys[order], np.concatenate([self.start, start])[order], np.concatenate([self.count, count])[order]
            at = np.searchsorted(self.keys, keys)
        at = at[which]
        count = self.count[at]
        to = np.concatenate([[0], np.cumsum(count)])
        out = self.pool[np.repeat(self.start[at] - to[:-1], count) + np.arange(to[-1])]
        return out, to[np.searchsorted(starts, offs)]


def encoder(vocabulary: str, pattern: str, specials: dict[str, int] | None = None) -> Encoder:
    """One per worker process."""
    key = vocabulary, pattern, tuple((specials or {}).items())
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(vocabulary, pattern, specials)
    return _ENCODERS[key]


def pieces(docs: DataFrame, *, vocabulary: str, pattern: str, specials: dict[str, int] | None = None, end: int = 2, capacity: int = 1024, with_ids: bool = False) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32 and, if asked for, ids. A document of more than ``capacity`` ids is cut so that only its first piece is shorter."""
    kind = docs.schema["doc_id"].dataType
    bound_batches(docs.sparkSession)
    stop = np.asarray([end], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, pattern, specials)
        for batch in batches:
            of, piece, start, length, crc, ids = [], [], [], [], [], []
            for lo, _, data, offs in blocks(batch.column(1)):
                all_ids, to = encode(data, offs)
                for r in range(len(to) - 1):
                    part = all_ids[to[r] : to[r + 1]]
                    n = len(part) + 1
                    at, k = 0, 0
                    while at < n:
                        size = n if n <= capacity else n % capacity if k == 0 and n % capacity else capacity
                        own = part[at : at + size]
                        total = zlib.crc32(own)
                        if at + size == n:
                            total = zlib.crc32(stop, total)
                        of.append(lo + r), piece.append(k), start.append(at), length.append(size), crc.append(total)
                        if with_ids:
                            ids.append(np.append(own, np.uint32(end))[:size].astype(np.int32))
                        at, k = at + size, k + 1
            columns = [batch.column(0).take(pa.array(of, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns, names = [*columns, pa.array(ids, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names)
        trim()

    schema = f"doc_id {kind.simpleString()}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select("doc_id", "text").mapInArrow(cut, schema)


def _dearest(price: np.ndarray, capacity: int) -> list[int]:
    """Knapsack by dynamic programming: lengths of the configuration of the highest total price. price[l - 1]: of length l, -inf where there is none."""
    best, last = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        value = price[:c] + best[c - 1 :: -1][:c]
        j = int(value.argmax())
        if value[j] > best[c - 1]:
            best[c], last[c] = value[j], j + 1
        else:
            best[c] = best[c - 1]
    out, c = [], capacity
    while c > 0:
        if last[c]:
            out.append(int(last[c]))
            c -= int(last[c])
        else:
            c -= 1
    return out


def solve(counts: dict[int, int], capacity: int, *, steps: int = 400, rate: float = 0.35) -> dict[tuple[int, ...], float]:
    """The configuration program's fractional solution by multiplicative weights: sequences of each configuration."""
    n = np.zeros(capacity)
    for length, k in counts.items():
        n[length - 1] = k
    there = n > 0
    x: dict[tuple[int, ...], float] = {}
    if not there.any():
        return x
    covered, log_w = np.zeros(capacity), np.zeros(capacity)
    lengths = np.arange(1, capacity + 1)
    log_w[there] = np.log(lengths[there] * n[there])
    for _ in range(steps):
        low = log_w[there].max()
        price = np.full(capacity, -np.inf)
        price[there] = np.exp(log_w[there] - low) / n[there]
        config = _dearest(price, capacity)
        a = np.bincount(np.asarray(config) - 1, minlength=capacity)
        use = a > 0
        step = float((n[use] / a[use]).min()) * rate
        key = tuple(sorted(config, reverse=True))
        x[key] = x.get(key, 0.0) + step
        gain = step * a[use] / n[use]
        covered[use] += gain
        log_w[use] -= gain / rate
    scale = 1 / max(float((covered[there] * n[there] * lengths[there]).sum() / (n[there] * lengths[there]).sum()), 1e-9)
    return {c: v * scale for c, v in x.items()}


def _round(found: dict[tuple[int, ...], float], counts: dict[int, int], capacity: int, share: float) -> list[tuple[tuple[int, ...], int]]:
    """Whole numbers of sequences: ``share`` of the fractional ones, full configurations first, then best fit for what is left."""
    left = np.zeros(capacity + 1, np.int64)
    for length, k in counts.items():
        left[length] = k
    out: list[tuple[tuple[int, ...], int]] = []

    def use(config: tuple[int, ...], most: float) -> None:
        size, a = np.unique(np.asarray(config), return_counts=True)
        k = int(min(most, (left[size] // a).min()))
        if k > 0:
            left[size] -= k * a
            out.append((config, k))

    for config, x in sorted(found.items(), key=lambda p: (capacity - sum(p[0]), -p[1])):
        use(config, np.floor(x * share))
    while left.any():
        config, room, free = [], capacity, left.copy()
        while room > 0:
            fit = np.flatnonzero(free[: room + 1])
            if not len(fit):
                break
            free[fit[-1]] -= 1
            config.append(int(fit[-1]))
            room -= int(fit[-1])
        use(tuple(config), np.inf)
    return out


def plan(counts: dict[int, int], capacity: int, *, shares: tuple[float, ...] = (1.0, 0.9, 0.75, 0.5, 0.25), **options) -> list[tuple[tuple[int, ...], int]]:
    """Configurations and how many sequences have each; together they hold the histogram exactly. Of the roundings at ``shares`` the one with the fewest sequences counts."""
    found = solve(counts, capacity, **options)
    return min((_round(found, counts, capacity, s) for s in shares), key=lambda p: sum(k for _, k in p))


class Places:
    """Where the i-th piece of a length goes: sequence and offset."""

    def __init__(self, plan: list[tuple[tuple[int, ...], int]]):
        slots: dict[int, list[tuple[int, int, int, int]]] = {}
        first = 0
        for config, k in plan:
            size, a = np.unique(np.asarray(config), return_counts=True)
            offset = 0
            for s, m in zip(size[::-1], a[::-1]):
                slots.setdefault(int(s), []).append((k * int(m), first, int(m), offset))
                offset += int(s * m)
            first += k
        self.sequences = first
        self.at = {}
        for s, v in slots.items():
            v = np.asarray(v, np.int64)
            self.at[s] = (np.concatenate([[0], np.cumsum(v[:, 0])]), v[:, 1], v[:, 2], v[:, 3])

    def __call__(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        seq, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        for s in np.unique(length):
            rows = np.flatnonzero(length == s)
            to, first, many, off = self.at[int(s)]
            c = np.searchsorted(to, number[rows], "right") - 1
            i = number[rows] - to[c]
            seq[rows] = first[c] + i // many[c]
            offset[rows] = off[c] + i % many[c] * s
        return seq, offset


def pack(parts: DataFrame, *, capacity: int = 1024, **options) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, start, length, ids_crc32, more). ``parts`` is read several times: pass a written table."""
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}
    shared = parts.sparkSession.sparkContext.broadcast(Places(plan(counts, capacity, **options)))
    salted = parts.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(SALTS)).cast("int"))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    base = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n")).select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")
    numbered = salted.withColumn("_i", F.row_number().over(inside)).join(base, ["length", "_salt"]).withColumn("_i", F.col("_i") - 1 + F.col("_base")).drop("_base", "_salt")
    names = parts.columns
    numbered = numbered.select(*names, "_i")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = {n: batch.column(i) for i, n in enumerate([*names, "_i"])}
            seq, offset = shared.value(np.asarray(cols["length"]), np.asarray(cols["_i"]))
            yield pa.RecordBatch.from_arrays([*(cols[n] for n in names), pa.array(seq), pa.array(offset)], [*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema) + ", sequence_id long, offset long"
    return numbered.mapInArrow(place, schema)


def pack_documents(docs: DataFrame, *, vocabulary: str, pattern: str, specials: dict[str, int] | None = None, end: int = 2, capacity: int = 1024, **options) -> DataFrame:
    """Tokenise, cut and pack whole documents."""
    return pack(written(pieces(docs, vocabulary=vocabulary, pattern=pattern, specials=specials, end=end, capacity=capacity), "pieces"), capacity=capacity, **options)
