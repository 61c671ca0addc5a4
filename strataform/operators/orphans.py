"""Problem 1, references to records that do not exist.

Keys of a scope get dense ordinals (parents and references together, in key order), so the parent keys of a version are sorted
integers. Neighbouring ordinals collapse into runs [start, end]; a reference is matched as-of to the run that starts at or
before it, and it is an orphan if there is none or the key lies beyond the run's end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strataform.operators.skew import bucket_of


#: References to one key in one version above which the key's verdict meets them over salts.
HOT_REFS = 100_000


def keyed(refs: DataFrame, parents: DataFrame, scope: list[str], at: str, key: str, n_buckets: Column) -> DataFrame:
    """The distinct keys of both sides: scope, bucket, key, at, whether a parent has it, and how often it is referred to.

    ``refs`` and ``parents`` hold ``scope`` columns (within which keys mean the same), ``at`` (the version, ordered) and ``key``;
    ``n_buckets`` is an expression over the scope columns or a column of both inputs that cuts large scopes into buckets by key hash.
    Rows with a null scope, version or key take no part. Counts are combined before the one shuffle.
    """
    names = [*scope, at, key]

    def side(df: DataFrame, parent: bool) -> DataFrame:
        df = df.select(*names, n_buckets.alias("__n"), F.lit(parent).alias("__parent")).dropna(subset=names)
        return df.withColumn("__bucket", bucket_of(F.col(key), F.col("__n"))).drop("__n")

    both = side(parents, True).unionByName(side(refs, False))
    return both.groupBy(*scope, "__bucket", key, at).agg(F.max("__parent").alias("__parent"), F.count_if(~F.col("__parent")).alias("__refs"))


def hot_keys(keys: DataFrame, scope: list[str], at: str, key: str, bound: int = HOT_REFS) -> DataFrame:
    """The keys of ``keyed`` that no parent of their version has and that more than ``bound`` rows refer to."""
    return keys.where((F.col("__refs") > bound) & ~F.col("__parent")).select(*scope, at, key)


def orphan_keys(keys: DataFrame, scope: list[str], at: str, key: str) -> DataFrame:
    """Distinct referenced keys that their own version lacks, from a table made by ``keyed`` (read twice, so write it first).

    Without parents every reference is an orphan, without references there are no rows. Result: scope, at, key, first_at, last_at
    (versions of the scope that hold the key, null if none does).
    """
    part = [*scope, "__bucket"]
    held = F.when(F.col("__parent"), F.col(at))
    by_key = Window.partitionBy(*part, key)
    ordinals = keys.withColumns(
        {
            "__ord": F.dense_rank().over(Window.partitionBy(*part).orderBy(key)),
            "first_at": F.min(held).over(by_key),
            "last_at": F.max(held).over(by_key),
        }
    )
    # Runs of the parents: the ordinal less the rank inside the version is the same along a run.
    inside = F.row_number().over(Window.partitionBy(*part, at).orderBy("__ord"))
    runs = (
        ordinals.where("__parent")
        .withColumn("__island", F.col("__ord") - inside)
        .groupBy(*part, at, "__island")
        .agg(F.min("__ord").alias("__ord"), F.max("__ord").alias("__end"))
    )
    wanted = ordinals.where("__refs > 0")
    points = runs.select(*part, at, "__ord", "__end", F.lit(0).alias("__kind")).unionByName(
        wanted.select(*part, at, "__ord", F.lit(1).alias("__kind"), key, "first_at", "last_at"), allowMissingColumns=True
    )
    as_of = Window.partitionBy(*part, at).orderBy("__ord", "__kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    matched = points.withColumn("__end", F.last("__end", ignorenulls=True).over(as_of))
    beyond = F.col("__end").isNull() | (F.col("__ord") > F.col("__end"))
    return matched.where((F.col("__kind") == 1) & beyond).select(*scope, at, key, "first_at", "last_at")
