"""Set deltas of keyed tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def keyed_delta(before: DataFrame, after: DataFrame, keys: list[str], compare: list[str]) -> DataFrame:
    """keys, change: added, removed, changed (some compared column differs, null equals null) or unchanged. Keys are unique on either side."""
    b = before.select(*keys, F.struct(*compare).alias("__b") if compare else F.lit(True).alias("__b"))
    a = after.select(*keys, F.struct(*compare).alias("__a") if compare else F.lit(True).alias("__a"))
    kind = F.when(F.col("__b").isNull(), "added").when(F.col("__a").isNull(), "removed").when(F.col("__a").eqNullSafe(F.col("__b")), "unchanged").otherwise("changed")
    return b.join(a, keys, "full").select(*keys, kind.alias("change"))


def fingerprint(*columns: str):
    """One hash of several columns, nulls told apart from empty strings."""
    parts = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in columns]
    return F.substring(F.sha2(reduce(lambda a, b: F.concat(a, F.lit(chr(0)), b), parts), 256), 1, 16)


def row_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows of one table alone, with + or -, repeats kept apart by count."""
    plus = after.exceptAll(before).withColumn("sign", F.lit("+"))
    return plus.unionByName(before.exceptAll(after).withColumn("sign", F.lit("-")))
