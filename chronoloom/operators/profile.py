"""Statistics of a series in one pass: order, steps, backward positions and arrival rates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BACKWARD_POSITIONS = 20


def series_profile(df: DataFrame, keys: Sequence[str], order: str, value: str, *, k: int = BACKWARD_POSITIONS) -> DataFrame:
    """One row a key: n, first, last, least and greatest value, monotony, steps and the first ``k`` backward positions.

    Steps are told apart after rounding to 12 decimals, half to even. A position is that of the earlier value, from 0. A
    series of one value has no steps and counts as monotone both ways. Only the first ``k`` positions are gathered.
    """
    window = Window.partitionBy(*keys).orderBy(order)
    rows = df.select(*keys, order, value).withColumn("step", F.col(value) - F.lag(value).over(window))
    rows = rows.withColumn("at", (F.row_number().over(window) - 2).cast("bigint")).withColumn("back", F.coalesce(F.col("step") < 0, F.lit(False)))
    nth = F.sum(F.col("back").cast("int")).over(window.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    kept = F.when(F.col("back") & (nth <= k), F.col("at"))
    step = F.bround("step", 12)
    return rows.withColumn("kept", kept).groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.min_by(value, order).alias("first_value"),
        F.max_by(value, order).alias("last_value"),
        F.min(value).alias("min_value"),
        F.max(value).alias("max_value"),
        F.coalesce(F.bool_and(F.col("step") >= 0), F.lit(True)).alias("non_decreasing"),
        F.coalesce(F.bool_and(F.col("step") > 0), F.lit(True)).alias("strictly_increasing"),
        F.count_distinct(step).alias("distinct_steps"),
        F.min(step).alias("step_min"),
        F.max(step).alias("step_max"),
        F.sum(F.col("back").cast("bigint")).alias("n_backward"),
        F.array_sort(F.collect_list("kept")).alias("backward_positions"),
    )


def arrival_rate(first: Column, last: Column, n: Column) -> Column:
    """(n - 1) / (last - first) for times in one unit; null where no time has passed."""
    return F.when(last > first, (n - 1) / (last - first))
