"""Mixing sources to target weights by capped water-filling.

Every source has a size (words of its documents) and a weight. Its target is its
share by weight of all words, clamped at ``max_epochs`` times its size; what a
clamp frees is reshared by weight among the others until no source is above its
limit. With the sources in order of limit / weight, the water level after
clamping the first k is (total - limits of those k) / weights of the rest, and the
final level is the largest of these, so one ordered pass over the source table
finds the fixed point.

A document is taken floor(target / size) whole times. The words still missing are
taken once more from documents in the order of a seeded hash: all words of each
until they run out, the first words only of the one document where they do. Hash
order is cut into ``BUCKETS`` ranges, so a source that holds a third of all rows is
summed range by range and no task sees it whole.

Defined cases: null text has size 0 and takes 0; sources sort by code point, null
last as a source of its own; a source of size 0 has target 0; an input without
words has targets 0; repeated rows are mixed one by one; null ids are kept; other
columns, whatever their names, only matter with ``carry``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import written

WORDS = r"[^\x20\x09-\x0D]+"
BUCKETS = 4096
WEIGHTS = (5, 2, 1)


def words(text: Column | str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = 3) -> DataFrame:
    """``sizes``: one row per source, with src (null allowed) and source_size. Adds target."""
    cap = (F.col("source_size") * max_epochs).cast("double")
    pick = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("_n") - 1) % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("_n", F.row_number().over(Window.orderBy(F.col("src").asc_nulls_last()))).withColumn("_w", pick).withColumn("_cap", cap)
    up = Window.orderBy(F.col("_cap") / F.col("_w"), "_n")
    every = Window.partitionBy()
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("_cap").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))) / F.sum("_w").over(up.rowsBetween(0, Window.unboundedFollowing))
    return ranked.withColumn("_level", level).withColumn("target", F.least("_cap", F.col("_w") * F.max("_level").over(every))).select("src", "source_size", "target")


def mix(docs: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = 3, seed: str = "mix", carry: bool = False) -> DataFrame:
    """One row per document: doc_id, size, source_size, target (of its source), taken (words, repeats counted). ``carry`` adds the input's row as struct ``row``."""
    order = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 10), 16, 10).cast("long")
    columns = [F.col("doc_id"), F.col("source").cast("string").alias("src"), words("text").alias("size"), order.alias("at")]
    narrow = written(docs.select(*columns), "mix")
    rows = docs.select(*columns, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")) if carry else narrow
    part = F.shiftright("at", 28).cast("int")
    ranges = narrow.groupBy("src", part.alias("part")).agg(F.sum("size").alias("part_size"))
    sizes = ranges.groupBy("src").agg(F.sum("part_size").alias("source_size"))
    plan = targets(sizes, weights=weights, max_epochs=max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    ahead = Window.partitionBy("src").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("before", F.coalesce(F.sum("part_size").over(ahead), F.lit(0)))
    ranges = ranges.join(plan.withColumn("whole", whole), ranges["src"].eqNullSafe(plan["src"])).select(ranges["src"].alias("r_src"), F.col("part").alias("r_part"), "before", "source_size", "target", "whole", (F.round("target").cast("long") - F.col("whole") * F.col("source_size")).alias("extra"))
    inside = Window.partitionBy("src", "part").orderBy("at", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("part", part).withColumn("in_part", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = rows.join(ranges, rows["src"].eqNullSafe(F.col("r_src")) & (rows["part"] == F.col("r_part")))
    more = F.greatest(F.lit(0).cast("long"), F.least("size", F.col("extra") - F.col("before") - F.col("in_part")))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("whole") * F.col("size") + more).alias("taken"), *(["row"] if carry else []))


def materialise(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document as often as it was taken, a part of a repetition cut after its last taken word (n_chars follows). Documents of which nothing is taken go; those without words stay once."""
    taken = mix(docs, carry=True, **options)
    n = F.when(F.col("size") == 0, 1).otherwise(F.ceil(F.col("taken") / F.greatest("size", F.lit(1)))).cast("int")
    rows = taken.where((F.col("taken") > 0) | (F.col("size") == 0)).select("row", "size", "taken", F.explode(F.sequence(F.lit(1), n)).alias("turn"))
    left = F.col("taken") - (F.col("turn") - 1) * F.col("size")
    cut = F.array_join(F.slice(F.regexp_extract_all("row.text", F.lit(r"[\x20\x09-\x0D]*" + WORDS), F.lit(0)), 1, F.greatest(left, F.lit(1)).cast("int")), "")
    rows = rows.withColumn("_cut", (F.col("size") > 0) & (left < F.col("size"))).withColumn("_text", F.when(F.col("_cut"), cut).otherwise(F.col("row.text")))
    names = [c for c in docs.columns]
    out = [F.col("_text").alias(c) if c == "text" else F.when(F.col("_cut"), F.length("_text").cast("long")).otherwise(F.col("row.n_chars")).alias(c) if c == "n_chars" else F.col(f"row.`{c}`").alias(c) for c in names]
    return rows.select(*out)
