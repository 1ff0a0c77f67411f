"""Lane choice per region from the metadata of its records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lane_of(n: Column, fallback: Column, same: Column, edit: Column) -> Column:
    """From the numbers of records in all, without a simple lane, of equal length only, and of simple edits."""
    return F.when(n == 0, "EmptyRegion").when(fallback > 0, "FallbackStateMachine").when(edit == 0, "SameLenOnly").when(same == 0, "NormalizedEditScript").otherwise("MixedSimpleEdits")


def record_lane(kind: Column, flags: Column) -> Column:
    """same, edit or fallback of one classified record. A simple indel that needs a replacement has no fast lane."""
    odd = (flags["symbolic"] & (kind != "SymbolicDel")) | flags["star"]
    return F.when(odd, "fallback").when((kind == "RefOnly") | flags["all_same_len"], "same").when(flags["all_fast"], "edit").otherwise("fallback")


def plan_regions(records: DataFrame, by: list[str], *more: Column) -> DataFrame:
    """records: classified, one row per region and record. more: further aggregates of a region's records."""
    lane = record_lane(F.col("kind"), F.col("flags"))
    count = lambda x: F.count_if(lane == x)
    return records.groupBy(*by).agg(F.count("*").alias("n"), count("fallback").alias("n_fallback"), count("same").alias("n_same"), count("edit").alias("n_edit"), *more).withColumn("lane", lane_of(F.col("n"), F.col("n_fallback"), F.col("n_same"), F.col("n_edit")))
