"""Problem 2, a few keys holding most records: eager aggregation through joins.

Both inputs are reduced to one compact state per join key before they meet (row count, count and sum of the measure, the best
k rows), each state built in two steps so that a hot key never reaches a single task with all its rows. The states are joined
key by key, counts multiply, sums combine, and the rows come out of the joined states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Measures are summed as decimals, so that the order of rows does not matter.
MEASURE = "decimal(18,8)"


def key_states(rows: DataFrame, k: int) -> DataFrame:
    """One state per key of ``rows`` (key, row_id, measure, at): n, n_measured, total and best, the first k row ids.

    Order of best: measure descending (null and NaN last), at descending (null last), row_id ascending. A row_id delivered again under
    the same key counts once, with its greatest measure and time. Rows without key or row_id take no part.

    The rows of a hot key are spread by row_id for the removal of repeats; the ranking keeps k rows per key and task before the shuffle
    (group limit), the sums are combined before the shuffle as well, so what is moved for a key is bounded by k rows per task.
    """
    clean = rows.dropna(subset=["key", "row_id"]).withColumn("measure", F.when(~F.isnan("measure"), F.col("measure")))
    once = clean.groupBy("key", "row_id").agg(F.max("measure").alias("measure"), F.max("at").alias("at"))
    order = Window.partitionBy("key").orderBy(F.col("measure").desc_nulls_last(), F.col("at").desc_nulls_last(), F.col("row_id"))
    ranked = once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    best = ranked.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("rank", "row_id"))).alias("best"))
    sums = once.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.count("measure").alias("n_measured"), F.sum(F.col("measure").cast(MEASURE)).alias("total")
    )
    return sums.join(best, "key")


def eager_join(left: DataFrame, right: DataFrame, k: int = 3) -> DataFrame:
    """Joins two inputs (as key_states takes them) through their states; a key of one input alone keeps that input's half.

    Result per key: left_n, right_n, pairs (rows of the inner join on key), total_product (sum over those pairs of the product of both
    measures, pairs without both left out), left_best, right_best. Neither input's rows are ever paired. Empty inputs give no rows.
    """
    a, b = ({c: F.col(c).alias(f"{side}_{c}") for c in ("n", "n_measured", "total", "best")} for side in ("left", "right"))
    joined = key_states(left, k).select("key", *a.values()).join(key_states(right, k).select("key", *b.values()), "key", "full")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    # The totals are null where a side has no measure.
    product = F.col("left_total").cast(MEASURE) * F.col("right_total").cast(MEASURE)
    return joined.select(
        "key",
        zero("left_n").alias("left_n"),
        zero("right_n").alias("right_n"),
        (zero("left_n") * zero("right_n")).alias("pairs"),
        (zero("left_n_measured") * zero("right_n_measured")).alias("measured_pairs"),
        product.alias("total_product"),
        "left_best",
        "right_best",
    )
