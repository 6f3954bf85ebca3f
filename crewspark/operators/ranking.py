"""Places of rows in large keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crewspark.storage import rewritten

#: Runs of a key in a range up to which their offsets are broadcast (about 100 bytes each).
BROADCAST_RUNS = 200_000


def with_place(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str) -> DataFrame:
    """df with each row's place in its key by order (from 1, nulls first), as row_number gives it, for few keys with
    many rows: rows are dealt by ranges of key and order, and only the ranges' counts of a key come
    together.  Rows of equal keys and order are placed in some order, as there."""
    own = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    dealt = rewritten(own.withColumn("__at", F.monotonically_increasing_id()).withColumn("__part", F.shiftright("__at", 33)))
    named = [F.col(k).alias(f"__{k}") for k in keys]
    runs = dealt.groupBy(F.col("__part").alias("__run"), *named).agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    before = Window.partitionBy(*[f"__{k}" for k in keys]).orderBy("__run").rowsBetween(Window.unboundedPreceding, -1)
    runs = rewritten(runs.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))))
    same = dealt["__part"] == runs["__run"]
    for k in keys:
        same = same & dealt[k].eqNullSafe(runs[f"__{k}"])
    side = F.broadcast(runs) if runs.count() <= BROADCAST_RUNS else runs
    joined = dealt.join(side, same)
    return joined.select(*df.columns, (F.col("__at") - F.col("__first") + F.col("__before") + 1).alias(out))
