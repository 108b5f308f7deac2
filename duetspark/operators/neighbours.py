"""The last and the next valid row beside each row of a series, without one task for a long series.

Rows are dealt by series and chunk of the order column. Within a chunk a window finds the
neighbours; across chunks only each chunk's first and last valid row travel on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_neighbours(
    df: DataFrame, keys: list[str], order: Column, valid: Column, payload: Column, chunk: Column, tie: Column | None = None
) -> DataFrame:
    """``df`` with ``prev`` and ``next``: the payload of the nearest valid row at or before and at
    or after each row in the order; rows of equal order stand by ``tie``."""
    tie = F.lit(0) if tie is None else tie
    rows = df.withColumns({"__c": chunk, "__o": order, "__i": tie, "__p": F.when(valid, payload)})
    # both ways as running frames: one that ends at the last row would be read anew for every row
    inside = Window.partitionBy(*keys, "__c").orderBy("__o", "__i")
    back = Window.partitionBy(*keys, "__c").orderBy(F.desc("__o"), F.desc("__i"))
    rows = rows.withColumns({
        "__prev": F.last("__p", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0)),
        "__next": F.last("__p", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, 0)),
    })
    at = F.when(F.col("__p").isNotNull(), F.struct("__o", "__i"))
    ends = rows.groupBy(*keys, "__c").agg(F.min_by("__p", at).alias("__lo"), F.max_by("__p", at).alias("__hi"))
    across, across_back = Window.partitionBy(*keys).orderBy("__c"), Window.partitionBy(*keys).orderBy(F.desc("__c"))
    ends = ends.select(
        *keys, "__c",
        F.last("__hi", ignorenulls=True).over(across.rowsBetween(Window.unboundedPreceding, -1)).alias("__before"),
        F.last("__lo", ignorenulls=True).over(across_back.rowsBetween(Window.unboundedPreceding, -1)).alias("__after"),
    )
    out = rows.join(ends, [*keys, "__c"])
    return out.select(
        *df.columns, F.coalesce("__prev", "__before").alias("prev"), F.coalesce("__next", "__after").alias("next")
    )
