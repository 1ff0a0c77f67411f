"""Language-model scoring by context-tree weighting (CTW) over bytes.

A byte is eight binary decisions, each with a context tree of its own over the
``depth`` preceding bytes. Every node has the Krichevsky-Trofimov estimate of its
zeros and ones, and the weighted probability is half that estimate and half the
product of its children's. Statistics are frozen after training: a node's share of
its own estimate in the mixture is its posterior weight on the training texts, and
the probability of a bit mixes the estimates of all depths along its context.
A text's score is the log10 probability of its bytes (A-Z lower-cased) and its end.

The base model is the smoothed word unigram.

Work is by chunks of about ``chunk_bytes`` of text (documents dealt by a hash of
their id and text) that stream through a task in bounded Arrow batches; a task holds one
chunk's distinct byte stretches (context and byte) and words with training counts, never its
texts. These lists meet by key in parts: counts are summed over the corpus, the
part's subtrees are weighted bit by bit (a part holds all contexts that end in the same two
bytes), and every chunk gets back the value of each of its own keys. So no task holds the
corpus's model; only nodes of depth up to 1 pass through the driver and are broadcast, at most
255 * (1 + 256), whatever the corpus. There are half as many parts as chunks, so the number
of lists grows with the square of the number of chunks: ``chunk_bytes`` should be raised
towards 1 GB for a corpus of 100 TB.

Defined cases: null text is empty, an empty text has the end as its only token;
repeated rows are scored, and count in training, one by one; null ids are kept and
never held out; without training texts every bit has probability 1/2 and base_score is
computed with N = V = 0; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import bound_batches, drop, release, written
from .textblock import LOWER, Lookup, blocks, crc_mod, mix, trim, words

DEPTH = 5
WORD, GRAM, TEXT = 0, 1, 2


def _codes(data: np.ndarray, offs: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """For each byte and each end (byte 0): itself below its ``depth`` predecessors (0 before the text); and the bounds of each text."""
    rows = len(offs) - 1
    row = np.repeat(np.arange(rows), np.diff(offs))
    padded = np.zeros(len(data) + rows * (depth + 1), np.uint64)
    scored = np.ones(len(padded), bool)
    at = np.arange(len(data)) + (depth + 1) * row + depth
    padded[at] = LOWER[data]
    first = offs[:-1] + (depth + 1) * np.arange(rows)
    for j in range(depth):
        scored[first + j] = False
    code = padded.copy()
    for j in range(1, depth + 1):
        code[j:] |= padded[:-j] << np.uint64(8 * j)
    return code[scored], offs + np.arange(rows + 1)


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after moving the argument up by six."""
    low = np.zeros_like(x)
    for i in range(6):
        low += np.log(x + i)
    y = x + 6
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) - low


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Natural log of the Krichevsky-Trofimov probability of a sequence with so many zeros and ones."""
    return _log_gamma(zeros + 0.5) + _log_gamma(ones + 0.5) - math.log(math.pi) - _log_gamma(zeros + ones + 1.0)


class Level:
    """Nodes of one depth: key = context bytes, then the bits of the byte so far behind a leading 1."""

    def __init__(self, keys: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray | None):
        """below: the children's summed log weighted probabilities; None at the greatest depth."""
        self.keys, self.zeros, self.ones = keys, zeros, ones
        own = log_kt(zeros, ones)
        self.log_pw = own if below is None else np.logaddexp(own, below) - math.log(2)
        self.weight = np.ones(len(keys)) if below is None else np.exp(own - math.log(2) - self.log_pw)
        self.estimate = (ones + 0.5) / (zeros + ones + 1.0)
        self.find = Lookup(keys).find


def _bits(code: np.ndarray, bit: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Node key at ``depth`` and value of the bit-th bit (from the top) of each code's byte."""
    byte = code & np.uint64(255)
    context = (code >> np.uint64(8)) & np.uint64((1 << (8 * depth)) - 1)
    prefix = np.uint64(1 << bit) | (byte >> np.uint64(8 - bit))
    return (context << np.uint64(8)) | prefix, ((byte >> np.uint64(7 - bit)) & np.uint64(1)).astype(np.int64)


def up(key: np.ndarray, depth: int) -> np.ndarray:
    """Key of the parent, at ``depth``."""
    return (((key >> np.uint64(8)) & np.uint64((1 << (8 * depth)) - 1)) << np.uint64(8)) | (key & np.uint64(255))


def build(code: np.ndarray, count: np.ndarray, bit: int, depth: int, least: int) -> dict[int, Level]:
    """Levels ``least`` to ``depth`` of the trees that decide the bit-th bit, of all codes with their counts."""
    levels: dict[int, Level] = {}
    for d in range(depth, least - 1, -1):
        nodes, one = _bits(code, bit, d)
        keys, at = np.unique(nodes, return_inverse=True)
        ones = np.bincount(at, count * one, len(keys))
        zeros = np.bincount(at, count * (1.0 - one), len(keys))
        below = None
        if d < depth:
            child = levels[d + 1]
            below = np.bincount(np.searchsorted(keys, up(child.keys, d)), child.log_pw, len(keys))
        levels[d] = Level(keys, zeros, ones, below)
    return levels


def log10_bit(code: np.ndarray, bit: int, levels: dict[int, Level]) -> np.ndarray:
    """log10 probability of the bit-th bit of each code's byte after its context."""
    p = np.full(len(code), 0.5)
    for d in sorted(levels, reverse=True):
        key, one = _bits(code, bit, d)
        at = levels[d].find(key)
        hit = at >= 0
        w, e = levels[d].weight[at[hit]], levels[d].estimate[at[hit]]
        mixed = w * e + (1 - w) * p[hit]
        p = np.full(len(code), 0.5)
        p[hit] = mixed
    return np.log10(np.where(one == 1, p, 1 - p))


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys with summed counts."""
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(at, np.concatenate([c for _, c in parts]), len(keys)).astype(np.int64)


def _blob(x: np.ndarray, kind: str) -> bytes:
    return x.astype(kind).tobytes()


_KEYS = pa.schema([("part", pa.int64()), ("chunk", pa.int64()), ("kind", pa.int32()), ("keys", pa.binary()), ("vals", pa.binary())])
_KEYS_SQL = "part long, chunk long, kind int, keys binary, vals binary"
_NODES = pa.schema([("node", pa.int64()), ("zeros", pa.float64()), ("ones", pa.float64()), ("log_pw", pa.float64())])


def _list(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_KEYS)], schema=_KEYS)


class Gathered:
    """A chunk's distinct words and byte stretches with their training counts."""

    def __init__(self, depth: int):
        self.depth, self.found = depth, {WORD: [], GRAM: []}

    def add(self, text: pa.Array, learn: np.ndarray) -> None:
        for lo, hi, data, offs in blocks(text):
            h, row = words(data, offs)
            code, to = _codes(data, offs, self.depth)
            for what, keys, train in ((WORD, h, learn[lo:hi][row]), (GRAM, code, np.repeat(learn[lo:hi], np.diff(to)))):
                some, at = np.unique(keys, return_inverse=True)
                held = self.found[what]
                held.append((some, np.bincount(at, train, len(some)).astype(np.int64)))
                if len(held) >= 8:
                    held[:] = [_merged(held)]

    def lists(self, chunk: int, parts: int) -> list[tuple]:
        """The lists by part: grams by the two bytes before the byte, words by hash."""
        rows = []
        for what, held in self.found.items():
            keys, n = _merged(held)
            part = (mix((keys >> np.uint64(8)) & np.uint64(0xFFFF) if what == GRAM else keys) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            bounds = np.searchsorted(part[order], np.arange(parts + 1))
            for p in np.flatnonzero(np.diff(bounds)):
                at = order[bounds[p] : bounds[p + 1]]
                rows.append((int(p), chunk, what, _blob(keys[at], "<u8"), _blob(n[at], "<u4" if n[at].max() < 1 << 32 else "<u8")))
        return rows


def _lists_of(table: pa.Table) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(chunk, keys, counts) of each list."""
    out = []
    for c, k, n in zip(*(table.column(x).to_pylist() for x in ("chunk", "keys", "vals"))):
        keys = np.frombuffer(k, "<u8")
        out.append((c, keys, np.frombuffer(n, "<u4" if len(n) == 4 * len(keys) else "<u8").astype(np.int64)))
    return out


def _runs(column: pa.Array) -> Iterator[tuple[int, int, int]]:
    """(value, first row, row after the last) of each run of equal values."""
    x = np.asarray(column)
    at = np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.zeros(0, np.int64)
    yield from zip(x[at].tolist(), at.tolist(), [*at[1:].tolist(), len(x)])


class Scorer:
    """Scores a chunk's texts from the values of its keys."""

    def __init__(self, depth: int, ends: int, base_of: float):
        self.depth, self.ends, self.base_of = depth, ends, base_of
        self.parts: dict[int, list] = {WORD: [], GRAM: []}
        self.known: dict[int, tuple] = {}

    def learn(self, kind: int, keys: bytes, vals: bytes) -> None:
        self.parts[kind].append((keys, vals))

    def score(self, text: pa.Array) -> np.ndarray:
        """Per text: tokens, known tokens, base score, log10 probability, bytes."""
        for what, dtype in ((WORD, "<u8"), (GRAM, "<f4")):
            if what not in self.known:
                rows = self.parts.pop(what)
                keys, vals = (np.frombuffer(b"".join(r[i] for r in rows), t) for i, t in ((0, "<u8"), (1, dtype)))
                self.known[what] = Lookup(keys), vals
        (word_at, counts), (gram_at, prices) = self.known[WORD], self.known[GRAM]
        out = [np.zeros((5, 0))]
        for lo, hi, data, offs in blocks(text):
            n = hi - lo
            h, row = words(data, offs)
            c = counts[word_at.find(h)].astype(float) if len(h) else np.zeros(0)
            code, to = _codes(data, offs, self.depth)
            sums = np.add.reduceat(prices[gram_at.find(code)].astype(float), to[:-1])
            tokens = np.bincount(row, minlength=n) + 1
            base = np.bincount(row, np.log10(c + 0.5), n) + math.log10(self.ends + 0.5) - tokens * self.base_of
            out.append(np.stack([tokens, np.bincount(row, c > 0, n) + (self.ends > 0), base, sums, np.diff(offs)]))
        return np.concatenate(out, axis=1)


def score(docs: DataFrame, *, depth: int = DEPTH, folds: int = 5, held: int = 1, chunk_bytes: int = 64 << 20) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte."""
    if not 2 <= depth <= 6:
        raise ValueError("depth must be 2 to 6")
    spark = docs.sparkSession
    bound_batches(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    chunks = max(12, -(-total // chunk_bytes))
    parts = max(6, chunks // 2)
    dealt = docs.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int").alias("chunk"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held_now = None, None
        for batch in batches:
            learn = crc_mod(batch.column(1).to_pylist(), folds) != held
            for chunk, lo, hi in _runs(batch.column(0)):
                if chunk != now:
                    if held_now:
                        yield from _list(held_now.lists(now, parts)).to_batches()
                    now, held_now = chunk, Gathered(depth)
                held_now.add(batch.column(2).slice(lo, hi - lo), learn[lo:hi])
        if held_now:
            yield from _list(held_now.lists(now, parts)).to_batches()
        trim()

    lists = written(dealt.repartitionById(chunks, "chunk").sortWithinPartitions("chunk").mapInArrow(gather, _KEYS_SQL), "keys")
    release(spark)

    def sum_words(table: pa.Table) -> pa.Table:
        """Corpus counts of each chunk's words; chunk -1 has the part's token and type numbers."""
        own = _lists_of(table)
        keys, n = _merged([(k, c) for _, k, c in own])
        part = table.column("part")[0].as_py()
        rows = [(part, c, WORD, _blob(k, "<u8"), _blob(n[np.searchsorted(keys, k)], "<u8")) for c, k, _ in own]
        trim()
        return _list([*rows, (part, -1, WORD, _blob(np.array([n.sum(), (n > 0).sum()]), "<u8"), b"")])

    by_word = written(lists.where(F.col("kind") == WORD).groupBy("part").applyInArrow(sum_words, _KEYS_SQL), "words")
    tokens = types = 0
    for r in by_word.where("chunk = -1").select("keys").toLocalIterator():
        n, v = np.frombuffer(r["keys"], "<u8")
        tokens, types = tokens + int(n), types + int(v)
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds, F.lit(-1))
    ends = docs.where(fold != held).count()
    tokens, types = tokens + ends, types + (ends > 0)
    release(spark)

    def summits(table: pa.Table) -> pa.Table:
        """Nodes of depth 1: zeros, ones and the children's log weighted probabilities, as far as the part knows."""
        keys, n = _merged([(k, c) for _, k, c in _lists_of(table)])
        out: list[list[np.ndarray]] = [[], [], [], []]
        for bit in range(8):
            top = build(keys[n > 0], n[n > 0], bit, depth, 2)[2]
            nodes, at = np.unique(up(top.keys, 1), return_inverse=True)
            for o, x in zip(out, (nodes.astype(np.int64), *(np.bincount(at, x, len(nodes)) for x in (top.zeros, top.ones, top.log_pw)))):
                o.append(x)
        trim()
        return pa.Table.from_arrays([pa.array(np.concatenate(o)) for o in out], schema=_NODES)

    grams = lists.where(F.col("kind") == GRAM)
    nodes = grams.groupBy("part").applyInArrow(summits, "node long, zeros double, ones double, log_pw double").groupBy("node").agg(*(F.sum(c).alias(c) for c in _NODES.names[1:]))
    got = nodes.toArrow().sort_by("node")
    key, zeros, ones, below = (got.column(c).to_numpy() for c in _NODES.names)
    top = {1: Level(key.astype(np.uint64), zeros, ones, below)}
    keys, at = np.unique(up(top[1].keys, 0), return_inverse=True)
    top[0] = Level(keys, *(np.bincount(at, x, len(keys)) for x in (zeros, ones, top[1].log_pw)))
    upper = spark.sparkContext.broadcast(top)
    release(spark)

    def price(table: pa.Table) -> pa.Table:
        """log10 probability of each chunk's keys."""
        own = _lists_of(table)
        keys, n = _merged([(k, c) for _, k, c in own])
        seen, value = n > 0, np.zeros(len(keys))
        for bit in range(8):
            value += log10_bit(keys, bit, build(keys[seen], n[seen], bit, depth, 2) | upper.value)
        part = table.column("part")[0].as_py()
        rows = [(part, c, GRAM, _blob(k, "<u8"), _blob(value[np.searchsorted(keys, k)], "<f4")) for c, k, _ in own]
        trim()
        return _list(rows)

    by_gram = written(grams.groupBy("part").applyInArrow(price, _KEYS_SQL), "prices")
    drop(lists)
    release(spark)
    base_of = math.log10(tokens + 0.5 * (types + 1)) if tokens else math.log10(0.5)

    def total_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, scorer = None, None
        for batch in batches:
            for chunk, lo, hi in _runs(batch.column("chunk")):
                if chunk != now:
                    scorer = None
                    now, scorer = chunk, Scorer(depth, ends, base_of)
                own = batch.slice(lo, hi - lo)
                for what, a, b in _runs(own.column("kind")):
                    rows = own.slice(a, b - a)
                    if what != TEXT:
                        for k, v in zip(rows.column("keys").to_pylist(), rows.column("vals").to_pylist()):
                            scorer.learn(what, k, v)
                        continue
                    x = scorer.score(rows.column("text"))
                    yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(x[0].astype(np.int64)), pa.array(x[1].astype(np.int64)), pa.array(x[2]), pa.array(x[3]), pa.array(-x[3] * math.log2(10) / (x[4] + 1))], ["doc_id", "n_tokens", "n_known", "base_score", "score", "bits_per_byte"])
        scorer = None
        trim()

    values = by_gram.unionByName(by_word.where("chunk >= 0")).select(F.col("chunk").cast("int").alias("chunk"), "kind", F.lit(None).cast(kind).alias("doc_id"), F.lit(None).cast("string").alias("text"), "keys", "vals")
    texts = dealt.select("chunk", F.lit(TEXT).alias("kind"), "doc_id", "text", F.lit(None).cast("binary").alias("keys"), F.lit(None).cast("binary").alias("vals"))
    # A chunk's values come before its texts.
    scored = values.unionByName(texts).repartitionById(chunks, "chunk").sortWithinPartitions("chunk", "kind").mapInArrow(total_up, f"doc_id {kind}, n_tokens long, n_known long, base_score double, score double, bits_per_byte double")
    return scored.select("doc_id", (fold == held).alias("held_out"), "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score", "bits_per_byte")
