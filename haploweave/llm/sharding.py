"""Sharding by extendible hashing, in DataFrame expressions.

A document's hash is the first 60 bits of the md5 of its id. The directory starts
with one shard; a shard above ``limit`` bytes is split on the next bit, and only it,
until every shard fits. Bits are examined ``STRIDE`` at a time: the cells of a
stride are summed, the sums are rolled up to every depth in it, and a cell's shard
is its shortest prefix that fits. Rows of cells that fit nowhere yet go to the next
stride. What is summed per stride is at most 2^STRIDE cells for each open prefix.

Defined cases: null text has 0 bytes; one document above the limit is a shard by
itself at the first depth where it is alone; rows equal in id and size are numbered
(0, 1, ...) and hashed with the number, so repeated rows spread like others; a null
id hashes as empty text; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import written

BITS, STRIDE = 60, 12


def shard(docs: DataFrame, *, limit: int = 1 << 20) -> DataFrame:
    """One row per document: doc_id, n_bytes, depth, shard (its bits as text), shard_bytes, shard_docs."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    rows = docs.select("doc_id", size.alias("n_bytes")).groupBy("doc_id", "n_bytes").agg(F.count("*").alias("n"))
    rows = rows.select("doc_id", "n_bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("copy"))
    key = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("copy").cast("string"))
    rows = written(rows.select("doc_id", "n_bytes", F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long").alias("h")), "hashes")
    left, done = rows, None
    for low in range(0, BITS, STRIDE):
        high = low + STRIDE
        cell = F.shiftright("h", BITS - high)
        cells = written(left.groupBy(cell.alias("cell")).agg(F.sum("n_bytes").alias("b"), F.count("*").alias("n")), "cells")
        depths = F.sequence(F.lit(low + (low > 0)), F.lit(high))
        at = cells.select("cell", "b", "n", F.explode(depths).alias("depth")).withColumn("prefix", F.expr(f"shiftright(cell, {high} - depth)"))
        sums = at.groupBy("depth", "prefix").agg(F.sum("b").alias("shard_bytes"), F.sum("n").alias("shard_docs"))
        fits = sums.where((F.col("shard_bytes") <= limit) | (F.col("shard_docs") == 1) | (F.col("depth") == BITS))
        best = at.select("cell", "depth", "prefix").join(fits, ["depth", "prefix"]).groupBy("cell").agg(F.min(F.struct("depth", "prefix", "shard_bytes", "shard_docs")).alias("s"))
        best = written(best, "leaves")
        placed = left.join(best, cell == F.col("cell")).select("doc_id", "n_bytes", "s.depth", "s.prefix", "s.shard_bytes", "s.shard_docs")
        done = placed if done is None else done.unionByName(placed)
        open_cells = written(cells.join(best, "cell", "left_anti").select("cell"), "open")
        if not open_cells.head(1):
            break
        left = written(left.join(open_cells, cell == F.col("cell"), "left_semi"), "open_rows")
    bits = F.when(F.col("depth") == 0, "").otherwise(F.expr("lpad(bin(prefix), depth, '0')"))
    return done.select("doc_id", "n_bytes", "depth", bits.alias("shard"), "shard_bytes", "shard_docs")
