"""FASTA as tiles of a contig, and range fetches from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import TILE


def read_fasta(spark: SparkSession, path: str, tile: int = TILE) -> DataFrame:
    """Tiles (contig, contig_len, tile, tile_start, bases) in the file's own letter case.

    Records are split at ``>`` at the start of a line, so a reader's row is one contig; its lines are joined and cut into tiles.
    """
    raw = spark.read.option("lineSep", "\n>").text(path).where(F.length(F.trim("value")) > 0)
    head = F.substring_index("value", "\n", 1)
    name = F.regexp_extract(head, r"^[\s>]*(\S+)", 1)
    body = F.regexp_replace(F.expr("substring(value, length(substring_index(value, '\n', 1)) + 1)"), r"\s+", "")
    return tiles_from(raw.select(name.alias("contig"), body.alias("body")).where("contig <> ''"), "contig", "body", tile)


def tiles_from(df: DataFrame, contig: str, bases: str, tile: int = TILE) -> DataFrame:
    """Tiles of a table with one row per contig."""
    # Bytes: a tile of a string would be found by counting letters from the contig's start.
    rows = df.select(F.col(contig).alias("contig"), F.col(bases).cast("binary").alias("body")).withColumn("contig_len", F.length("body").cast("long"))
    tiles = rows.select("*", F.explode(F.sequence(F.lit(0), F.greatest(F.expr(f"(contig_len - 1) div {tile}"), F.lit(0)).cast("int"))).alias("tile"))
    return tiles.select("contig", "contig_len", "tile", (F.col("tile").cast("long") * tile).alias("tile_start"), F.expr(f"cast(substring(body, tile * {tile} + 1, {tile}) as string)").alias("bases"))


def metadata(reference: DataFrame) -> DataFrame:
    """contig, contig_len."""
    return reference.groupBy("contig").agg(F.max("contig_len").alias("contig_len"))


def n_seq(reference: DataFrame) -> int:
    """The number of contigs."""
    return metadata(reference).count()


def has_seq(reference: DataFrame, contig: str) -> bool:
    return bool(reference.where(F.col("contig") == contig).head(1))


def fetch(reference: DataFrame, regions: DataFrame, tile: int = TILE) -> DataFrame:
    """Adds ``slice`` to regions (rid, contig, beg, fin; closed, beg below 0 counts as 0): the bases, cut at the contig's end; null where there are none."""
    beg = F.greatest("beg", F.lit(0))
    wanted = regions.withColumn("_b", beg).where("fin >= _b").select("rid", "contig", "_b", "fin", F.explode(F.sequence(F.expr(f"cast(_b div {tile} as int)"), F.expr(f"cast(fin div {tile} as int)"))).alias("tile"))
    # Bytes are cut by place; letters of a string would be counted from its start.
    parts = wanted.join(reference.select("contig", "tile", "tile_start", F.col("bases").cast("binary").alias("bases")), ["contig", "tile"])
    own = F.expr("cast(substring(bases, cast(greatest(_b - tile_start, 0) + 1 as int), cast(fin - greatest(_b, tile_start) + 1 as int)) as string)")
    parts = parts.select("rid", "tile", own.alias("s"))  # before the aggregation, which would sort rows with whole tiles
    slices = parts.groupBy("rid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("tile", "s"))), lambda x: x["s"]), "").alias("slice"))
    return regions.join(slices.where("slice <> ''"), "rid", "left")


def tss_windows(genes: DataFrame, before: int = 196_608, after: int = 196_607) -> DataFrame:
    """1-based closed windows around a transcription start."""
    return genes.select("gene_id", "chr", F.greatest(F.lit(1).cast("long"), F.col("tss") - before).alias("start"), (F.col("tss") + after).alias("end"))


__all__ = ["read_fasta", "tiles_from", "metadata", "n_seq", "has_seq", "fetch", "tss_windows"]
