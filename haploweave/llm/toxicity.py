"""Toxicity: a counterfactual-regularised logistic classifier.

Features are the character n-grams (``GRAMS`` characters, once as such and once more
with a mark if they begin a word) and the whole words of the lower-cased text, hashed,
each with a damped count of three steps: it occurs; it occurs twice, and 1.5
times in ``PER`` words; it occurs three times, and 2.5 times in ``PER`` words. So one
chance use of a stem differs from its repeated use, in short and in long texts.
Training minimises the logistic loss plus ``penalty`` times the squared change of the
logit between a sentence of a labelled text and its counterfactual, the sentence with its
identity terms swapped for another member of their group. In a sentence with
terms, all terms of a group become one member and then the next, so that naming both
members leaves no escape; in a text without any term a sentence gets one member and then the
next put in. Hashes that speak for toxicity are screened by their counts;
a first, class-balanced pass with an L1 term chooses among them, a second with a small
L2 term fits the weights, both with the counterfactual penalty and weights of 0 or
more, so that no ordinary word makes up for an insult; the identity terms' words
always stay in the model, so that the penalty, not their absence, keeps mentions neutral.

The classifier is fitted on the driver from a bounded sample (``max_rows`` of
each label, texts of at most ``max_chars`` characters each); every whole text is
then scored.

Defined cases: null and empty texts get the score of a text without known features;
labels that are null or of unknown documents are ignored; several labels of a
document all count; with fewer than two labels in the sample every score is the
smoothed share of the labels seen; null ids are kept, never learned from, and not
held out; extra columns of either table are ignored.
"""

import logging
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import bound_batches
from .textblock import Lookup, Spans, blocks, mix, trim

log = logging.getLogger("haploweave")
WORD = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"[^.!?\n]+")
GRAMS, PER, STEPS = range(3, 9), 300, 3
#: Bits of the hash that the screening counts go by.
_BUCKETS = 20
#: Groups of identity terms in the languages of the tables; a counterfactual takes another member of the group.
IDENTITY = (
    ("man", "woman"), ("men", "women"), ("boy", "girl"), ("boys", "girls"), ("male", "female"), ("husband", "wife"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "sikh", "catholic", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "sikhs", "catholics", "atheists"),
    ("black", "white", "asian", "latino", "arab", "african", "european"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrant", "refugee", "native", "foreigner"), ("immigrants", "refugees", "natives", "foreigners"),
    ("old", "young", "elderly"), ("disabled", "deaf", "blind"),
    ("american", "mexican", "chinese", "german", "french", "spanish", "turkish", "polish", "indian"),
    ("mary", "fatima", "priya", "aisha", "maria", "ling"), ("john", "mohammed", "jamal", "juan", "wei", "ivan"),
    ("mann", "frau"), ("männer", "frauen"), ("junge", "mädchen"), ("muslime", "christen", "juden", "hindus", "buddhisten", "katholiken", "atheisten"),
    ("schwarze", "weiße", "asiaten", "araber", "afrikaner", "europäer"), ("schwul", "lesbisch", "bisexuell", "transgender"),
    ("einwanderer", "flüchtlinge", "ausländer", "einheimische"), ("behinderte", "gehörlose", "blinde"), ("deutsche", "türken", "polen", "franzosen", "spanier", "russen"),
    ("homme", "femme"), ("hommes", "femmes"), ("garçon", "fille"), ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "catholiques", "athées"),
    ("noirs", "blancs", "asiatiques", "arabes", "africains", "européens"), ("homosexuels", "lesbiennes", "bisexuels", "transgenres"),
    ("immigrés", "réfugiés", "étrangers", "autochtones"), ("handicapés", "sourds", "aveugles"), ("français", "allemands", "espagnols", "turcs", "polonais"),
    ("hombre", "mujer"), ("hombres", "mujeres"), ("chico", "chica"), ("musulmanes", "cristianos", "judíos", "hindúes", "budistas", "católicos", "ateos"),
    ("negros", "blancos", "asiáticos", "árabes", "africanos", "europeos"), ("gays", "lesbianas", "bisexuales", "transexuales"),
    ("inmigrantes", "refugiados", "extranjeros", "nativos"), ("discapacitados", "sordos", "ciegos"), ("españoles", "alemanes", "franceses", "turcos", "mexicanos"),
)


def _letters(data: np.ndarray) -> np.ndarray:
    """Bytes of words: a-z and characters beyond ASCII other than Latin-1 signs and general or CJK punctuation."""
    ok = ((data >= 97) & (data <= 122)) | (data >= 0x80)
    at = lambda lead, low, high: np.flatnonzero((data[:-1] == lead) & (data[1:] >= low) & (data[1:] <= high))
    for lead, low, high, width in ((0xC2, 0x80, 0xBF, 2), (0xE2, 0x80, 0x81, 3), (0xE3, 0x80, 0x80, 3)):
        i = at(lead, low, high)
        for j in range(width):
            ok[np.minimum(i + j, len(data) - 1)] = False
    return ok


def grams(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, Iterator[tuple[np.ndarray, np.ndarray]]]:
    """Words of each lower-cased text of a block, and its features in several parts: hashes and the text of each."""
    n, rows = len(data), len(offs) - 1
    if not n:
        return np.zeros(rows, np.int64), iter(())
    letter = _letters(data)
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    first = letter.copy()
    first[1:] &= ~letter[:-1] | edge[1:n]
    last = letter.copy()
    last[:-1] &= ~letter[1:] | edge[1:n]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    row_of = np.searchsorted(offs, s, "right") - 1
    char = np.flatnonzero(letter & (((data & 0xC0) != 0x80) | first))
    word = np.cumsum(first)[char] - 1
    begins = first[char]
    end = np.append(char[1:], n)
    end = np.where(np.append(begins[1:], True), e[word], end)

    def parts() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        hashed = Spans(data)
        yield mix(hashed(s, e) ^ np.uint64(0x2545F4914F6CDD1D)), row_of
        for k in GRAMS:
            at = np.flatnonzero(word[: len(word) - k + 1] == word[k - 1 :]) if len(word) >= k else np.zeros(0, np.int64)
            h, of = hashed(char[at], end[at + k - 1]), row_of[word[at]]
            yield h, of
            head = begins[at]
            yield mix(h[head] ^ np.uint64(0x9E6C63D0876A9F61)), of[head]

    return np.bincount(row_of, minlength=rows), parts()


def _step(count: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Steps of the damped count, 1 to STEPS."""
    share = count / np.maximum(1, words / PER)
    return 1 + ((count >= 2) & (share >= 1.5)) + ((count >= 3) & (share >= 2.5))


class Classifier:
    """``keys`` (hashes), ``weights`` (of each key's steps, added up) and ``bias``; the score is the logistic of their sum over the features present."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray, bias: float):
        self.find, self.weights, self.bias = Lookup(keys), weights, bias
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(keys >> np.uint64(44)).astype(np.int64)] = True

    def present(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, key's place, step) of all known features of a block."""
        words, parts = grams(data, offs)
        size, hits = len(self.find.keys), [np.zeros(0, np.int64)]
        for h, row in parts:
            some = np.flatnonzero(self.seen[(h >> np.uint64(44)).astype(np.int64)])
            at = self.find.find(h[some])
            hits.append((row[some] * size + at)[at >= 0])
        key, count = np.unique(np.concatenate(hits), return_counts=True)
        row, at = (key // size, key % size) if size else (key, key)
        return row, at, _step(count, words[row])

    def logits(self, text: pa.Array) -> np.ndarray:
        out = [np.zeros(0)]
        for lo, hi, data, offs in blocks(pc.utf8_lower(text)):
            row, at, step = self.present(data, offs)
            out.append(np.bincount(row, self.weights[at, step - 1], hi - lo) if len(row) else np.zeros(hi - lo))
        return np.concatenate(out) + self.bias

    def scores(self, text: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(text), -40, 40)))

    def score(self, text: str) -> float:
        return float(self.scores(pa.array([text or ""], pa.string()))[0])


def pairs_of(texts: list[str], groups: tuple[tuple[str, ...], ...] = IDENTITY, most: int = 3) -> list[tuple[str, str]]:
    """Sentences of the texts with their counterfactuals: up to ``most`` sentences with terms of each text, else one sentence with a term put in."""
    group_of = {w: g for g in groups for w in g}
    out = []
    for text in texts:
        low = text.lower()
        named = []
        for m in SENTENCE.finditer(low):
            terms = [w for w in WORD.findall(m.group()) if w in group_of]
            if terms:
                named.append((m.group(), group_of[terms[0]], terms[0]))
                if len(named) == most:
                    break
        for sentence, group, term in named:
            other = group[(group.index(term) + 1) % len(group)]
            out.append(tuple(WORD.sub(lambda w, to=to, g=group: to if w.group() in g else w.group(), sentence) for to in (term, other)))
        if not named and groups:
            found = SENTENCE.search(low)
            words = found.group().split()[:40] if found else []
            draw = zlib.crc32(low.encode())
            group = groups[draw % len(groups)]
            i = draw // 256 % len(group)
            at = draw // 65536 % (len(words) + 1)
            out.append(tuple(" ".join([*words[:at], w, *words[at:]]) for w in (group[i], group[(i + 1) % len(group)])))
    return out


def _solve(rows: list[np.ndarray], pairs: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, size: int, l1: float, l2: float, penalty: float, steps: int, balanced: bool) -> tuple[np.ndarray, float]:
    """Accelerated proximal gradient for the loss above; the step follows a bound of the curvature found by power iteration."""
    at = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)
    of = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    c_at = np.concatenate([x for p in pairs for x in p] or [np.zeros(0, np.int64)]).astype(np.int64)
    c_of = np.repeat(np.repeat(np.arange(len(pairs)), 2), [len(x) for p in pairs for x in p])
    c_sign = np.repeat(np.tile([1.0, -1.0], len(pairs)), [len(x) for p in pairs for x in p])
    weight = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1)) if balanced else np.full(len(y), 1 / len(y))
    many = max(len(pairs), 1)

    def dot(w: np.ndarray) -> np.ndarray:
        return np.bincount(of, w[at], len(rows))

    def gap(w: np.ndarray) -> np.ndarray:
        return np.bincount(c_of, w[c_at] * c_sign, len(pairs)) if len(pairs) else np.zeros(0)

    v, b = np.ones(size), 1.0
    for _ in range(12):
        z = (dot(v) + b) * weight / 4
        v2 = np.bincount(at, z[of], size) + (2 * penalty / many * np.bincount(c_at, gap(v)[c_of] * c_sign, size) if len(pairs) else 0)
        b2 = z.sum()
        norm = np.sqrt((v2**2).sum() + b2**2)
        v, b = v2 / norm, b2 / norm
    step = 1 / (norm * 1.1 + l2)
    w, bias = np.zeros(size), 0.0
    w0, bias0, t = w, bias, 1.0
    for _ in range(steps):
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        u, ub = w + (t - 1) / t2 * (w - w0), bias + (t - 1) / t2 * (bias - bias0)
        r = (1 / (1 + np.exp(-np.clip(dot(u) + ub, -40, 40))) - y) * weight
        g = np.bincount(at, r[of], size) + l2 * u
        if len(pairs):
            g = g + 2 * penalty / many * np.bincount(c_at, gap(u)[c_of] * c_sign, size)
        w0, bias0, t = w, bias, t2
        w = u - step * g
        w = np.maximum(w - step * l1, 0)
        bias = ub - step * r.sum()
    return w, bias


def _screen(text: pa.Array, y: np.ndarray, least: int, top: int) -> np.ndarray:
    """Marks the hash buckets that speak for toxicity: at any step, among the ``top`` by log odds times the root of the toxic texts that hold them."""
    size = 1 << _BUCKETS
    found = np.zeros((STEPS, 2, size), np.int32)
    for lo, hi, data, offs in blocks(text, 1 << 16):
        words, parts = grams(data, offs)
        for h, row in parts:
            key, count = np.unique((row.astype(np.uint64) << np.uint64(_BUCKETS)) | (h >> np.uint64(64 - _BUCKETS)), return_counts=True)
            row, at = (key >> np.uint64(_BUCKETS)).astype(np.int64), (key & np.uint64(size - 1)).astype(np.int64)
            step, label = _step(count, words[row]), y[lo:hi][row].astype(np.int64)
            for j in range(STEPS):
                some = step > j
                np.add.at(found[j], (label[some], at[some]), 1)
    marks, (n0, n1) = np.zeros(size, bool), ((y == 0).sum(), (y == 1).sum())
    for j in range(STEPS):
        odds = np.log((found[j, 1] + 0.5) / (n1 + 1)) - np.log((found[j, 0] + 0.5) / (n0 + 1))
        gain = np.where((found[j, 1] >= least) & (odds > 0), odds * np.sqrt(found[j, 1]), 0)
        best = np.argpartition(gain, size - top)[size - top :]
        marks[best[gain[best] > 0]] = True
    return marks


def train(texts: list[str], y: list[int], *, groups: tuple[tuple[str, ...], ...] = IDENTITY, penalty: float = 10.0, min_docs: int = 5, candidates: int = 2000, l1: float = 0.002, l2: float = 1e-5, steps: int = 150) -> Classifier:
    y = np.asarray(y, float)
    if not len(y) or y.min() == y.max():
        p = (y.sum() + 1) / (len(y) + 2)
        return Classifier(np.zeros(0, np.uint64), np.zeros((0, STEPS)), float(np.log(p / (1 - p))))
    low = pc.utf8_lower(pa.array(texts, pa.string()))
    least = min(min_docs, max(1, int(y.sum()) // 20))
    marks = _screen(low, y, least, candidates)
    found = [np.zeros(0, np.uint64)]
    for _, _, data, offs in blocks(low, 1 << 16):
        held = [(h[some], row[some]) for h, row in grams(data, offs)[1] if len(some := np.flatnonzero(marks[(h >> np.uint64(64 - _BUCKETS)).astype(np.int64)]))]
        if held:
            h, row = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((row, h))
            h, row = h[order], row[order]
            found.append(h[np.append(True, (h[1:] != h[:-1]) | (row[1:] != row[:-1]))])
    keys, counts = np.unique(np.concatenate(found), return_counts=True)
    keys = keys[counts >= least]
    terms = sorted({w for g in groups for w in g})
    at = np.cumsum([0, *(len(w.encode()) for w in terms)])
    named = next(grams(np.frombuffer("".join(terms).encode(), np.uint8), at)[1])[0] if terms else np.zeros(0, np.uint64)
    keys = np.union1d(keys, named)
    model = Classifier(keys, np.zeros((len(keys), STEPS)), 0.0)

    def features(text: pa.Array) -> list[np.ndarray]:
        """Of each text its features: key * STEPS + step, for all steps up to the reached one."""
        out = []
        for lo, hi, data, offs in blocks(text):
            row, at, step = model.present(data, offs)
            every = np.repeat(at * STEPS, step) + np.arange(step.sum()) - np.repeat(np.cumsum(step) - step, step)
            out += np.split(every, np.searchsorted(np.repeat(row, step), np.arange(1, hi - lo)))
        return out

    rows, cf = features(low), pairs_of(texts, groups)
    both = features(pa.array([x for p in cf for x in p], pa.string()))
    pairs = [(a, b) for a, b in zip(both[::2], both[1::2]) if not np.array_equal(a, b)]
    log.info("toxicity: %d texts, %d features, %d counterfactual pairs, %d of them tell members apart", len(rows), len(keys), len(cf), len(pairs))
    size = len(keys) * STEPS
    always = np.isin(np.arange(size) // STEPS, np.searchsorted(keys, named))
    w, _ = _solve(rows, pairs, y, size, l1, l2, penalty, steps, True)
    keep = np.flatnonzero((w > 0) | always)
    place = np.full(size, -1, np.int64)
    place[keep] = np.arange(len(keep))
    inside = lambda r: place[r][place[r] >= 0]
    v, bias = _solve([inside(r) for r in rows], [(inside(a), inside(b)) for a, b in pairs], y, len(keep), 0.0, l2, penalty, 4 * steps, False)
    weights = np.zeros(size)
    weights[keep] = v
    weights = np.cumsum(weights.reshape(-1, STEPS), axis=1)
    some = weights[:, -1] > 0
    return Classifier(keys[some], weights[some], float(bias))


def fit(docs: DataFrame, labels: DataFrame, *, folds: int = 3, held: int = 1, max_rows: int = 3000, max_chars: int = 30_000, **options) -> Classifier:
    """Learn from labelled rows outside the held-out fold, at most about ``max_rows`` of each label, drawn by a hash of the id; that bound is also what makes the drawn ids safe to broadcast."""
    fold = F.crc32(F.col("doc_id").cast("string")) % folds
    marked = labels.where(F.col("toxic").isin(0, 1) & (fold != held)).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    total = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    draw = F.pmod(F.xxhash64("doc_id", F.lit(29)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rate = F.when(F.col("toxic") == 1, min(1.0, max_rows / max(total.get(1, 0), 1))).otherwise(min(1.0, max_rows / max(total.get(0, 0), 1)))
    drawn = marked.where(draw < rate)
    found = docs.where(F.col("text").isNotNull() & (F.length("text") <= max_chars)).select("doc_id", "text").join(F.broadcast(drawn), "doc_id")
    rows = sorted(((r["doc_id"], r["toxic"], r["text"]) for r in found.toLocalIterator()), key=lambda r: (str(r[0]), r[1], r[2]))
    model = train([r[2] for r in rows], [r[1] for r in rows], **options)
    del rows
    trim()
    return model


def score_column(spark: SparkSession, model: Classifier, text: str = "text") -> Column:
    """The score as a column, for use as a filter."""
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(t: pa.Array) -> pa.Array:
        out = pa.array(shared.value.scores(t), pa.float64())
        trim()
        return out

    return score(F.coalesce(text, F.lit("")))


def classify(docs: DataFrame, model: Classifier, *, folds: int = 3, held: int = 1, threshold: float = 0.7) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted."""
    kind = docs.schema["doc_id"].dataType
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(m.scores(pc.fill_null(batch.column(1), "")), pa.float64())], ["doc_id", "score"])
        trim()

    found = docs.select("doc_id", "text").mapInArrow(score, f"doc_id {kind.simpleString()}, score double")
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds, F.lit(-1))
    return found.select("doc_id", (fold == held).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
