"""Runs of short assistant rows become one note."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import strip
from .classify import in_order


def coalesced(rows: DataFrame, most_chars: int = 100, least_run: int = 3) -> DataFrame:
    """Runs of at least ``least_run`` neighbouring short assistant rows, without calls, as one row at the first's place."""
    short = (F.col("role") == "assistant") & F.col("policy").isin("MODERATE", "AGGRESSIVE") & ~F.col("protected") & (F.coalesce(F.size("tool_calls"), F.lit(0)) <= 0) & (F.length("content") < most_chars)
    rows = rows.withColumn("_s", short)
    rows = rows.withColumn("_island", F.sum(F.when(F.col("_s") & F.coalesce(F.lag("_s").over(in_order()), F.lit(False)), 0).otherwise(1)).over(in_order()))
    run = Window.partitionBy("conv_id", "_island")
    part = strip(F.col("content"))
    part = F.when(part == "", None).when(F.substring(part, -1, 1).isin(".", "!", "?", ";", ":"), part).otherwise(F.concat(part, F.lit(".")))
    rows = rows.withColumns({"_n": F.count("*").over(run), "_at": F.min("idx").over(run), "_parts": F.array_sort(F.collect_list(F.struct("idx", part.alias("p"))).over(run))})
    merged = F.col("_s") & (F.col("_n") >= least_run)
    note = F.concat(F.lit("[Assistant notes: "), F.array_join(F.transform(F.col("_parts"), lambda x: x["p"]), " "), F.lit("]"))
    rows = rows.where(~merged | (F.col("idx") == F.col("_at")))
    return rows.withColumn("content", F.when(merged, note).otherwise(F.col("content"))).drop("_s", "_island", "_n", "_at", "_parts")
