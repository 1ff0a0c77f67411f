"""Order MinHash fingerprints in DataFrame expressions.

A text is cut by its content: after white space and behind every character of a fixed choice (some
common letters and digits, and stretches of the other scripts). So a letter put in changes
one or two tokens, with or without spaces, and never shifts the cuts behind it. The text's
k-mers are the ``K`` consecutive tokens from each place, numbered
by occurrence, so that the n-th copy of a k-mer is an element of its own. Elements
are ordered by one hash, whose top bits deal them to ``SLOTS`` slots. In each slot
the two first elements are selected, put back into the order of the text, and the
pair of their k-mers is hashed: a slot agrees only if two texts share both k-mers in
the same order, which follows the edit distance. A slot with fewer than two elements
takes what it lacks from the slots after it, the last being followed by the first.
Elements are packed into 32 bits of hash and 31 of place, which no array's index exceeds.

A fingerprint is SLOTS times eight hexadecimal digits, dashes for a text without k-mers; a
lone k-mer is hashed by itself in all slots. The likeness of two is the share of equal
slots among those that either has; 1.0 if both are empty.

The next document is the one with the next larger id. Texts are shuffled once, into buckets of
neighbouring (id, hash of text); the boundaries are drawn from a sample of the keys
(at most ``BUCKETS``, each of about ``BUCKET_BYTES`` or more). Inside a bucket a window hands every
document its successor's text and fingerprint; the last of a bucket gets the next bucket's first.

Defined cases: null text is empty; a text of fewer than K tokens is one k-mer, one
without tokens has none; rows equal in id and text are one document, with one row in
``compare`` and a row for each of them in ``compare_rows``;
rows of the same id and other text are documents of their own, in hash order;
a null id sorts first; a single document is its own next; extra columns are ignored.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLOTS, K = 64, 3
BUCKETS, BUCKET_BYTES = 1 << 16, 1 << 20
#: Characters behind which a text is cut: of Latin and Greek about one in twelve; of the scripts beyond 32 code points of every 256.
_CUT, _OTHER = "iI05", "\\u0400-\\uD7FF"
_CUT_OTHER = "".join(f"\\u{x:04X}-\\u{x + 31:04X}" for x in range(0x0400, 0xD800, 0x100))
#: Other characters with the cut behind them, or a cut alone. Long classes are slow, so texts of Latin and Greek have a pattern of their own that finds the same.
_LATIN = rf"[^\s{_CUT}]++[{_CUT}]?|[{_CUT}]"
_WORDS = rf"[^\s{_CUT}{_OTHER}]++[{_CUT}]?|[{_CUT}]|(?=[{_OTHER}])(?:[{_OTHER}&&[^{_CUT_OTHER}]]++[{_CUT_OTHER}]?|[{_CUT_OTHER}])"
_BITS = 31
_POS = (1 << _BITS) - 1


def _empty(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def _run_starts(sorted_longs: str, shift: int) -> Column:
    """Indexes at which the upper bits of a sorted array change."""
    at = lambda i: F.shiftright(F.get(F.col(sorted_longs), i), shift)
    return F.when(F.size(sorted_longs) > 0, F.filter(F.sequence(F.lit(0), F.size(sorted_longs) - 1), lambda i: (i == 0) | (at(i) != at(i - 1)))).otherwise(_empty("int"))


def tokens(text: str) -> Column:
    """The tokens of a text in order."""
    found = lambda p: F.regexp_extract_all(text, F.lit(p), F.lit(0))
    return F.when(F.col(text).rlike(f"[{_OTHER}]"), found(_WORDS)).otherwise(found(_LATIN))


def fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds the fingerprint of column ``text`` as column ``out``."""
    t = lambda name: f"_{out}_{name}"
    df = df.withColumn(t("tok"), F.transform(tokens(text), lambda x: F.xxhash64(x)))
    n = F.greatest(F.size(t("tok")) - (K - 1), F.least(F.size(t("tok")), F.lit(1)))
    df = df.withColumn(t("mer"), F.when(F.size(t("tok")) > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.xxhash64(*[F.get(F.col(t("tok")), i + j) for j in range(K)]))).otherwise(_empty("bigint")))
    df = df.withColumn(t("sorted"), F.sort_array(F.transform(t("mer"), lambda h, i: F.shiftleft(F.shiftrightunsigned(h, 1 + _BITS), _BITS).bitwiseOR(i.cast("long")))))
    df = df.withColumn(t("runs"), _run_starts(t("sorted"), _BITS))
    end = lambda r: F.coalesce(F.get(F.col(t("runs")), r + 1), F.size(t("sorted"))) - 1
    item = lambda j: F.get(F.col(t("sorted")), j)
    numbered = lambda s, r: F.transform(F.sequence(s, end(r)), lambda j: F.shiftleft(F.shiftrightunsigned(F.xxhash64(F.shiftright(item(j), _BITS), j - s), 1 + _BITS), _BITS).bitwiseOR(item(j).bitwiseAND(F.lit(_POS))))
    df = df.withColumn(t("order"), F.sort_array(F.flatten(F.transform(t("runs"), numbered))))
    bits = 63 - (SLOTS.bit_length() - 1)
    df = df.withColumn(t("slots"), _run_starts(t("order"), bits))
    pick = lambda i: F.get(F.col(t("order")), i)
    place = lambda i: pick(i).bitwiseAND(F.lit(_POS)).cast("int")
    mer = lambda p: F.get(F.col(t("mer")), p)

    def pair(i: Column) -> Column:
        j = (i + 1) % F.size(t("order"))
        return F.when(F.size(t("order")) > 1, F.xxhash64(mer(F.least(place(i), place(j))), mer(F.greatest(place(i), place(j))))).otherwise(F.xxhash64(mer(place(i)), F.lit(-1)))

    slot = lambda i: F.shiftright(pick(i), bits).cast("int")
    # A pair counts for its slot and the empty ones before it; the first pair also for those after the last.
    since = lambda i, r: slot(i) - F.coalesce(slot(F.get(F.col(t("slots")), r - 1)), F.lit(-1))
    digits = lambda i: F.lpad(F.hex(pair(i).bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")
    df = df.withColumn(t("sig"), F.array_join(F.transform(t("slots"), lambda i, r: F.repeat(digits(i), since(i, r))), ""))
    rest = F.expr(f"repeat(substring({t('sig')}, 1, 8), {SLOTS} - length({t('sig')}) div 8)")
    df = df.withColumn(out, F.when(F.size(t("slots")) == 0, "-" * (8 * SLOTS)).otherwise(F.concat(F.col(t("sig")), rest)))
    return df.drop(*[t(x) for x in ("tok", "mer", "sorted", "runs", "order", "slots", "sig")])


def likeness(a: str, b: str) -> Column:
    """Share of equal slots among those that either fingerprint has."""
    part = lambda c, i: F.substring(F.col(c), i * 8 + 1, F.lit(8))
    slots = F.sequence(F.lit(0), F.lit(SLOTS - 1))
    used = F.size(F.filter(slots, lambda i: (part(a, i) != "--------") | (part(b, i) != "--------")))
    same = F.size(F.filter(slots, lambda i: (part(a, i) != "--------") & (part(a, i) == part(b, i))))
    return F.when(used == 0, F.lit(1.0)).otherwise(same / used)


def _bucket(keys: DataFrame, kind: str, rows: int, size: int) -> Column:
    """The bucket of (doc_id, h): the number of boundaries up to it, found by halving."""
    n = max(1, min(BUCKETS, size // BUCKET_BYTES))
    drawn = keys.where(F.pmod(F.xxhash64("doc_id", "h", F.lit(3)), F.lit(1 << 30)) < int((1 << 30) * min(1.0, 16 * n / max(rows, 1)))).select("doc_id", "h", "size").collect()
    drawn.sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] if r["doc_id"] is not None else 0, r["h"]))
    step, total, bounds = sum(r["size"] for r in drawn) / n, 0, []
    for r in drawn:
        total += r["size"]
        if total >= step * (len(bounds) + 1) and len(bounds) < n - 1:
            bounds.append({"doc_id": r["doc_id"], "h": r["h"]})
    if not bounds:
        return F.lit(0)
    at = F.from_json(F.lit(json.dumps(bounds, default=str)), f"array<struct<doc_id:{kind},h:bigint>>")
    key = F.struct("doc_id", "h")
    steps = F.array(*[F.lit(1 << i) for i in range(len(bounds).bit_length() - 1, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda lo, s: F.when((lo + s <= len(bounds)) & (F.get(at, lo + s - 1) <= key), lo + s).otherwise(lo))


def _compared(docs: DataFrame) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    keys = texts.select("doc_id", "h", (F.octet_length("text") + 64).cast("long").alias("size"))
    rows, size = keys.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    repeated = keys.groupBy("doc_id", "h").agg(F.count("*").alias("copies")).where("copies > 1")
    twice = bool(repeated.head(1))
    if twice:
        texts = texts.dropDuplicates(["doc_id", "h"])
    dealt = texts.withColumn("p", F.coalesce(_bucket(keys, kind, rows, size), F.lit(0))).repartition("p")  # never null, so that no filter keeps the shuffle from being reused
    own = Window.partitionBy("p").orderBy("doc_id", "h")
    seen = fingerprint(dealt.sortWithinPartitions("p", "doc_id", "h"), "text", "fingerprint")
    rows = seen.withColumn("next_text", F.lead("text").over(own)).withColumn("next_fingerprint", F.lead("fingerprint").over(own)).withColumn("last", F.lead(F.lit(1)).over(own).isNull())
    # The first document of each bucket goes to the bucket before it, that of the first one to the last.
    heads = dealt.groupBy("p").agg(F.min_by("text", F.struct("doc_id", "h")).alias("text"))
    order = Window.orderBy("p")
    before = heads.select("p").withColumn("to", F.coalesce(F.lag("p").over(order), F.max("p").over(Window.partitionBy())))
    heads = fingerprint(heads.join(before, "p").select(F.col("to").alias("p"), F.col("text").alias("head_text")), "head_text", "head_fingerprint")
    rows = rows.join(heads, "p", "left")
    pick = lambda c: F.when(F.col("last"), F.col(f"head_{c}")).otherwise(F.col(f"next_{c}"))
    n = F.length("text")
    quarter = F.floor(n / 4).cast("int")
    rows = rows.select("doc_id", "h", n.cast("long").alias("n_chars"), "fingerprint", F.concat(F.substring(F.col("text"), F.lit(1), n - quarter), F.substring(pick("text"), F.lit(1), quarter)).alias("edited_text"), pick("fingerprint").alias("next_fingerprint"))
    rows = fingerprint(rows, "edited_text", "edited_fingerprint")
    rows = rows.select("doc_id", "h", "n_chars", F.sha2(F.col("edited_text").cast("binary"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", likeness("fingerprint", "edited_fingerprint").alias("near_edited"), likeness("fingerprint", "next_fingerprint").alias("near_next"))
    if twice:
        many = repeated.select(F.col("doc_id").alias("r_id"), F.col("h").alias("r_h"), "copies")
        rows = rows.join(many, F.col("doc_id").eqNullSafe(F.col("r_id")) & (F.col("h") == F.col("r_h")), "left").drop("r_id", "r_h")
    else:
        rows = rows.withColumn("copies", F.lit(None).cast("long"))
    return rows.withColumn("copies", F.coalesce("copies", F.lit(1).cast("long"))).drop("h")


def compare(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    return _compared(docs).drop("copies")


def compare_rows(docs: DataFrame) -> DataFrame:
    """The same for every row: a document of n equal rows is returned n times."""
    rows = _compared(docs)
    return rows.withColumn("copies", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("copies")
