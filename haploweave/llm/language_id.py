"""Language identification by prediction by partial matching (PPM, escape method C).

For each language a byte context tree of orders 0 to 3 is counted once and then
frozen. In a context that saw N bytes of q kinds, a byte seen n times has
probability n / (N + q); the escape q / (N + q) goes to the next shorter
context, whose distribution over the bytes not seen here is renormalised, so
every context's distribution over the 256 bytes sums to one. The code length of
a text is the exact sum of -log P over all its bytes, and the language with the
shortest code wins.

The trees of all languages are resolved into shared tables: one row per distinct
byte sequence of the training sample, one column per language. They are bounded
by the training sample (``max_bytes`` a language), not by the corpus, and so are
safe to broadcast. Every whole text is scored.

Defined cases: a null text, or one without any letter, gives ``und`` with score
0.0; ties go to the language that sorts first; rows with null ids are kept and
count as never held out; repeated rows give repeated results; no labelled text
means ``und`` everywhere; other columns of the input are ignored.
"""


from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import bound_batches
from .textblock import Lookup, blocks, trim

ORDER = 3
PAD = 10


def _codes(data: np.ndarray, offs: np.ndarray, order: int) -> np.ndarray:
    """For each byte: itself below its ``order`` predecessors; a text begins after line ends."""
    rows = len(offs) - 1
    row = np.repeat(np.arange(rows), np.diff(offs))
    at = np.arange(len(data)) + order * (row + 1)
    padded = np.full(len(data) + order * rows, PAD, np.uint64)
    padded[at] = data
    code = padded[at]
    for j in range(1, order + 1):
        code |= padded[at - j] << np.uint64(8 * j)
    return code


class PPM:
    """Frozen trees of several languages: ``langs`` and, for each text, its code length in nats under each."""

    def __init__(self, samples: dict[str, list[str]], order: int = ORDER):
        self.langs, self.order = sorted(samples), order
        n = len(self.langs)
        seen = {}
        for lang in self.langs:
            raw = [t.encode() for t in samples[lang]]
            data = np.frombuffer(b"".join(raw), np.uint8)
            offs = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
            seen[lang] = _codes(data, offs, order)
        self.grams, self.value, self.contexts, self.escape = [], [], [], []
        for d in range(order + 1):
            keep = np.uint64((1 << (8 * (d + 1))) - 1)
            counts = {lang: np.unique(c & keep, return_counts=True) for lang, c in seen.items()}
            union = np.unique(np.concatenate([k for k, _ in counts.values()])) if n else np.zeros(0, np.uint64)
            if d == 0:
                union = np.arange(256, dtype=np.uint64)
                lower = np.full((256, n), -np.log(256.0))
            else:
                lower = self._value(union & np.uint64((1 << (8 * d)) - 1), d - 1)
            heads, head_of = np.unique(union >> np.uint64(8), return_inverse=True)
            value, escape = lower.copy(), np.zeros((len(heads), n))
            for j, lang in enumerate(self.langs):
                keys, c = counts[lang]
                at, h = np.searchsorted(union, keys), head_of[np.searchsorted(union, keys)]
                total = np.bincount(h, c, len(heads))
                kinds = np.bincount(h, minlength=len(heads))
                below = np.bincount(h, np.exp(lower[at, j]), len(heads))
                has = kinds > 0
                with np.errstate(divide="ignore", invalid="ignore"):
                    escape[has, j] = np.log(kinds[has] / (total[has] + kinds[has])) - np.log(np.maximum(1 - below[has], 1e-12))
                value[:, j] = lower[:, j] + escape[head_of, j]
                value[at, j] = np.log(c / (total[h] + kinds[h]))
            self.grams.append(Lookup(union))
            self.value.append(value.astype(np.float32))
            self.contexts.append(Lookup(heads))
            self.escape.append(escape.astype(np.float32))

    def _value(self, code: np.ndarray, d: int) -> np.ndarray:
        """log P of the last byte of each code, given the d bytes before it, under each language."""
        if d == 0:
            return self.value[0][code.astype(np.int64)]
        at = self.grams[d].find(code)
        out = self.value[d][at]
        miss = np.flatnonzero(at < 0)
        if len(miss):
            part = code[miss]
            head = self.contexts[d].find(part >> np.uint64(8))
            out[miss] = self._value(part & np.uint64((1 << (8 * d)) - 1), d - 1) + np.where(head[:, None] >= 0, self.escape[d][head], np.float32(0))
        return out

    def code_lengths(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        out = np.zeros((len(offs) - 1, len(self.langs)))
        full = np.flatnonzero(np.diff(offs) > 0)
        if len(full):
            out[full] = -np.add.reduceat(self._value(_codes(data, offs, self.order), self.order), offs[full], axis=0, dtype=np.float64)
        return out


def fit(docs: DataFrame, *, folds: int = 3, held: int = 1, max_bytes: int = 1_500_000, order: int = ORDER) -> PPM:
    """Learn from text and non-null lang of rows outside the held-out fold.

    ``max_bytes`` bounds the sample of a language: rows are drawn by a hash of the id at the rate that
    gives about that many bytes; of a text longer than an eighth of the bound in bytes, the first
    ``max_bytes // 32`` characters are learned, so that a language of long texts only is learned too.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds, F.lit(0)) != held)).select("doc_id", "lang", F.when(F.octet_length("text") <= max_bytes // 8, F.col("text")).otherwise(F.substring("text", 1, max_bytes // 32)).alias("text")).withColumn("_size", F.octet_length("text"))
    total = {r["lang"]: r["b"] for r in rows.groupBy("lang").agg(F.sum("_size").alias("b")).collect()}
    draw = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rate = F.lit(0.0)
    for lang, b in total.items():
        rate = F.when(F.col("lang") == lang, F.lit(min(1.0, max_bytes / max(b, 1)))).otherwise(rate)
    samples: dict[str, list[str]] = {}
    for r in rows.where(draw < rate).select("lang", F.lower("text").alias("text")).toLocalIterator():
        samples.setdefault(r["lang"], []).append(r["text"])
    return PPM(samples, order)


def _predict(m: PPM, text: pa.Array, letters: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, posterior and bits per byte of each lower-cased text."""
    lang, conf, bits = [], [np.zeros(0)], [np.zeros(0)]
    for lo, hi, data, offs in blocks(text):
        cost = m.code_lengths(data, offs)
        if not m.langs:
            best, p, b = np.zeros(hi - lo, int), np.zeros(hi - lo), np.zeros(hi - lo)
        else:
            best = cost.argmin(axis=1)
            low = cost[np.arange(hi - lo), best]
            p = 1 / np.exp(np.maximum(low[:, None] - cost, -700)).sum(axis=1)
            b = low / np.log(2) / np.maximum(np.diff(offs), 1)
        ok = letters[lo:hi] & bool(m.langs)
        lang += [m.langs[i] if y else "und" for i, y in zip(best, ok)]
        conf.append(np.where(ok, p, 0.0))
        bits.append(b)
    return lang, np.concatenate(conf), np.concatenate(bits)


_LETTER = r"\p{L}"


def language_column(spark: SparkSession, model: PPM, text: str = "text") -> Column:
    """The predicted language as a column, for use as a filter."""
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("string")
    def predict(t: pa.Array, y: pa.Array) -> pa.Array:
        out = pa.array(_predict(shared.value, t, y.to_numpy(zero_copy_only=False).astype(bool))[0], pa.string())
        trim()
        return out

    whole = F.coalesce(text, F.lit(""))
    return predict(F.lower(whole), whole.rlike(_LETTER))


def identify(docs: DataFrame, model: PPM, *, folds: int = 3, held: int = 1) -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score (posterior of the winner under equal priors), bits_per_byte (code length under the winner)."""
    kind = docs.schema["doc_id"].dataType
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            lang, conf, bits = _predict(m, batch.column(1), np.asarray(batch.column(2).to_pylist(), bool))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(conf), pa.array(bits)], ["doc_id", "lang_pred", "score", "bits_per_byte"])
        trim()

    text = F.coalesce("text", F.lit(""))
    found = docs.select("doc_id", F.lower(text).alias("text"), text.rlike(_LETTER).alias("letters")).mapInArrow(score, f"doc_id {kind.simpleString()}, lang_pred string, score double, bits_per_byte double")
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds, F.lit(-1))
    return found.select("doc_id", (fold == held).alias("held_out"), "lang_pred", "score", "bits_per_byte")
