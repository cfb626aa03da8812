"""Numbers and neighbours in the order of a key, where one key may hold any share of all rows.

A window over a key is one task, however many rows it has. Here a key's rows are cut into ranges of the ordering
number; the rows of a range are put in order for themselves, and a small table of the ranges gives what came before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Width of a range, in units of the number that orders the rows.
RANGE = 10_000


def _ranged(df: DataFrame, number: str, width: int) -> DataFrame:
    """Rows without a number come first, as they do in an order by it."""
    return df.withColumn("_range", F.coalesce(F.floor(F.col(number) / width), F.lit(-(1 << 62))))


def numbered(df: DataFrame, within: list[str], order: list[str], name: str = "n", width: int = RANGE) -> DataFrame:
    """Adds `name`: 1, 2, ... within the key, by the order columns, of which the first is a number."""
    rows = _ranged(df, order[0], width)
    sizes = rows.groupBy(*within, "_range").agg(F.count(F.lit(1)).alias("_size"))
    before = F.sum("_size").over(W.partitionBy(*within).orderBy("_range").rowsBetween(W.unboundedPreceding, -1))
    sizes = sizes.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(within)), F.col("_range").alias("_r"), F.coalesce(before, F.lit(0)).alias("_before"))
    own = F.row_number().over(W.partitionBy(*within, "_range").orderBy(*order))
    same = rows["_range"] == sizes["_r"]
    for i, c in enumerate(within):
        same = same & rows[c].eqNullSafe(sizes[f"_k{i}"])
    placed = rows.withColumn("_own", own).join(sizes, same)
    return placed.withColumn(name, F.col("_before") + F.col("_own")).drop("_range", "_own", "_before", "_r", *(f"_k{i}" for i in range(len(within))))


def neighbours(df: DataFrame, within: str, order: list[str], value: str, width: int = RANGE) -> DataFrame:
    """Adds before and after: the value of the row in front of and behind each, within the key, by the order columns, of
    which the first is a number; empty at the ends and for a null value."""
    rows = _ranged(df, order[0], width)
    key = F.struct(*order)
    text = F.coalesce(F.col(value), F.lit(""))
    ends = rows.groupBy(within, "_range").agg(F.min_by(text, key).alias("_first"), F.max_by(text, key).alias("_last"))
    w = W.partitionBy(within).orderBy("_range")
    ends = ends.select(F.col(within).alias("_k"), F.col("_range").alias("_r"), F.lag("_last").over(w).alias("_prior"), F.lead("_first").over(w).alias("_next"))
    own = W.partitionBy(within, "_range").orderBy(*order)
    placed = rows.withColumns({"before": F.lag(text).over(own), "after": F.lead(text).over(own)}).join(ends, rows[within].eqNullSafe(F.col("_k")) & (rows["_range"] == F.col("_r")))
    pick: Column = F.coalesce("before", "_prior", F.lit(""))
    return placed.withColumns({"before": pick, "after": F.coalesce("after", "_next", F.lit(""))}).drop("_range", "_r", "_k", "_prior", "_next")
