"""Quotation linking: from messages that quote each other to reply-ordered conversations, in DataFrame expressions.

A line's quote level is the number of leading ``>``. Lines are normalised (lower case,
white space to single spaces). Runs of lines of one level are passages. A passage
belongs to the earliest message of the conversation that has its lines unquoted and
in one stretch, be it a part of that message or all of it. What is looked for, for
every level: all lines of the level in a row (replies written between the lines of a
quote), then whole runs, then single lines; a line takes the first of these that an
earlier message has. A message replies to the earlier message that most of its
level-1 lines come from (then the later one); if none of them is linked, the next
level decides. Following replies up gives the root. With the rows in the order
(root_turn, turn) every message follows what it replies to.

A stretch of w lines is hashed from its first and its last 2^k lines, with the largest
such block that fits, so that all stretches of one length cost a hash each. Only lengths
that are quoted in the conversation are hashed. Originals are reduced to one row per
conversation and stretch before the join, so popular lines do not multiply, and roots
are found by pointer doubling. Repeated lines of one level count once.

Defined cases: null or empty text has no lines; lines of white space only count
neither as quotes nor as originals; a quote without an original, or one from a
later message, links nothing; rows that share conversation and turn are one message
for linking (the smallest parent counts) and are all returned; rows with a null
conversation or turn are returned unlinked; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import written

_MARKS = r"^(?:[ \t]*>)+"


def _norm(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"[ \t\r]+", " "))


def _let(x: Column, body: Callable[[Column], Column]) -> Column:
    """body(x) with x computed once, wherever the optimiser moves it."""
    return F.get(F.transform(F.array(x), body), F.lit(0))


def _runs(lines: Column) -> Column:
    """Runs of lines of one level, as structs of level and norms."""
    level = lambda i: F.get(lines, i)["level"]
    starts = F.when(F.size(lines) > 0, F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: (i == 0) | (level(i) != level(i - 1)))).otherwise(F.array().cast("array<int>"))
    run = lambda x, at: F.struct(level(at).alias("level"), F.transform(x, lambda y: y["norm"]).alias("norms"))
    return _let(starts, lambda s: F.transform(s, lambda at, r: run(F.slice(lines, at + 1, F.coalesce(F.get(s, r + 1), F.size(lines)) - at), at)))


def parse(messages: DataFrame) -> DataFrame:
    """Adds ``lines``: for each line its level, raw text behind the marks and normalised text; and ``passages``: for each run of lines of one level, without empty ones, its level and lines."""
    raw = F.split(F.coalesce(F.col("text"), F.lit("")), "\n")

    def line(x: Column) -> Column:
        marks = F.regexp_extract(x, _MARKS, 0)
        rest = F.substring(x, F.length(marks) + 1, F.length(x))
        return F.struct(F.length(F.regexp_replace(marks, "[^>]", "")).alias("level"), rest.alias("raw"), _norm(rest).alias("norm"))

    return messages.withColumn("lines", F.transform(raw, line)).withColumn("passages", _let(F.filter("lines", lambda x: x["norm"] != ""), _runs))


def _blocks(norms: str) -> Column:
    """Hashes of all stretches of 1, 2, 4, 8, ... lines: an array for each of these lengths."""
    kind = "array<array<string>>"

    def double(done: Column, _: Column) -> Column:
        last = F.element_at(done, -1)
        half = F.size(norms) - F.size(last) + 1
        return F.concat(done, F.array(F.transform(F.sequence(F.lit(0), F.size(last) - half - 1), lambda i: F.md5(F.concat(F.get(last, i), F.get(last, i + half)))))).cast(kind)

    doublings = F.length(F.bin(F.size(norms).cast("long"))) - 1
    return F.aggregate(F.when(doublings > 0, F.sequence(F.lit(1), doublings)).otherwise(F.array().cast("array<int>")), F.array(F.transform(norms, lambda x: F.md5(x))).cast(kind), double)


def _stretch(blocks: str, at: Column, w: str) -> Column:
    """Hash of the w lines from index ``at``."""
    k = F.length(F.bin(F.col(w).cast("long"))) - 1
    block = F.get(F.col(blocks), k)
    size = F.size(F.get(F.col(blocks), F.lit(0))) - F.size(block) + 1
    return F.concat(F.get(block, at), F.get(F.get(F.col(blocks), k), at + F.col(w) - size))


def link(messages: DataFrame) -> DataFrame:
    """One row per message: conv_id, turn, role, clean_text, quoted_lines, quote_depth, linked_lines, parent_turn, root_turn, reply_depth."""
    parsed = parse(messages.select("conv_id", "turn", "role", "text"))
    own = F.filter("lines", lambda x: x["level"] == 0)
    clean = F.array_join(F.transform(own, lambda x: x["raw"]), "\n")
    quoted = F.filter("lines", lambda x: (x["level"] > 0) & (x["norm"] != ""))
    rows = parsed.select("conv_id", "turn", "role", clean.alias("clean_text"), F.size(quoted).alias("quoted_lines"), F.coalesce(F.array_max(F.transform("lines", lambda x: x["level"])), F.lit(0)).alias("quote_depth"))

    source = parsed.where("conv_id IS NOT NULL AND turn IS NOT NULL").select("conv_id", "turn", "text", "passages")
    norms = lambda p: F.flatten(F.transform(p, lambda x: x["norms"]))
    unit = lambda rank, level, n: F.struct(F.lit(rank).alias("rank"), level.alias("level"), n.alias("norms"))

    def sought(runs: Column) -> Column:
        """What to look for: the lines of a level (0), each run (1), each line (2)."""
        levels = F.array_distinct(F.transform(runs, lambda x: x["level"]))
        of = lambda v: norms(F.filter(runs, lambda x: x["level"] == v))
        wholes = F.transform(levels, lambda v: unit(0, v, of(v)))
        singles = F.flatten(F.transform(levels, lambda v: F.transform(F.array_distinct(of(v)), lambda n: unit(2, v, F.array(n)))))
        return F.concat(wholes, F.transform(runs, lambda x: unit(1, x["level"], x["norms"])), singles)

    units = source.where(F.col("text").contains(">")).select("conv_id", "turn", F.explode(_let(F.filter("passages", lambda x: x["level"] > 0), sought)).alias("u")).select("conv_id", "turn", "u.*")
    hashed = units.withColumn("w", F.size("norms")).withColumn("blocks", _blocks("norms")).withColumn("h", _stretch("blocks", F.lit(0), "w"))
    asks = written(hashed.select("conv_id", "turn", "level", "rank", "w", "h", F.explode(F.array_distinct(F.transform("norms", lambda x: F.md5(x)))).alias("line")).distinct(), "quotes")

    lengths = asks.groupBy("conv_id").agg(F.collect_set("w").alias("sizes"))
    own = source.select("conv_id", "turn", norms(F.filter("passages", lambda x: x["level"] == 0)).alias("own")).join(lengths, "conv_id").withColumn("blocks", _blocks("own"))
    stretches = own.select("conv_id", "turn", "blocks", F.size("own").alias("n"), F.explode(F.filter("sizes", lambda w: w <= F.size("own"))).alias("w")).select("conv_id", "turn", "w", F.explode(F.transform(F.sequence(F.lit(0), F.col("n") - F.col("w")), lambda i: _stretch("blocks", i, "w"))).alias("h"))
    originals = stretches.groupBy("conv_id", "w", "h").agg(F.min("turn").alias("origin"))
    found = asks.join(originals, ["conv_id", "w", "h"]).where("origin < turn").groupBy("conv_id", "turn", "level", "line").agg(F.min(F.struct("rank", -F.col("w"), "origin"))["origin"].alias("origin")).groupBy("conv_id", "turn", "level", "origin").agg(F.count("*").alias("n"))
    best = found.groupBy("conv_id", "turn").agg(F.max(F.struct(-F.col("level"), "n", "origin"))["origin"].alias("parent_turn"), F.sum("n").alias("linked_lines"))
    links = written(best, "replies")

    jumps = links.select("conv_id", "turn", F.col("parent_turn").alias("up"), F.lit(1).alias("hops"))
    while True:
        over = jumps.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("up").alias("up2"), F.col("hops").alias("hops2"))
        jumps = written(jumps.join(over, (F.col("conv_id") == F.col("c")) & (F.col("up") == F.col("t")), "left").select("conv_id", "turn", F.coalesce("up2", "up").alias("up"), (F.col("hops") + F.coalesce("hops2", F.lit(0))).alias("hops"), F.col("up2").isNotNull().alias("moved")), "roots")
        if not jumps.where("moved").head(1):
            break
        jumps = jumps.drop("moved")
    tree = links.join(jumps.select("conv_id", "turn", F.col("up").alias("root_turn"), F.col("hops").alias("reply_depth")), ["conv_id", "turn"])
    out = rows.join(tree, ["conv_id", "turn"], "left")
    return out.select("conv_id", "turn", "role", "clean_text", F.col("quoted_lines").cast("long"), F.col("quote_depth").cast("long"), F.coalesce("linked_lines", F.lit(0)).cast("long").alias("linked_lines"), "parent_turn", F.coalesce("root_turn", "turn").alias("root_turn"), F.coalesce("reply_depth", F.lit(0)).cast("long").alias("reply_depth"))
