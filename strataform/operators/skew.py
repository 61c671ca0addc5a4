"""Tools that keep hot keys and growing small sides from deciding a job's speed.

* ``broadcast_within``: broadcast a side only after its size was measured, else leave it to a shuffle join.
* ``join_dimension``: the same for a dimension whose keys own many rows each; beyond the bound its rows are repeated over salts.
* ``join_hot``: a shuffle join whose known hot keys are spread over salts.
* ``bucket_counts``: how many hash buckets each scope (project, tenant ...) needs so that no bucket is larger than a bound.
* ``chunked_lag`` / ``chunked_fill``: LAG and forward fill over a key that may own any share of the rows: the key is cut into
  chunks of the order column, chunks are windowed in parallel and linked by one summary row each.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Bytes a broadcast side may have; beyond it the join is an ordinary shuffle join.
BROADCAST_BYTES = 48 << 20
#: What a row takes in a hashed relation besides its strings.
ROW_BYTES = 72


def broadcast_within(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hints a broadcast if the rows measured now stay within ``limit`` bytes; costs one pass over ``df``, so use it on dimensions."""
    return F.broadcast(df) if is_within(df, limit) else df


def is_within(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Whether the rows measured now take at most ``limit`` bytes; nested columns count by their JSON."""
    texts = [F.col(f) for f, t in df.dtypes if t in ("string", "binary")]
    nested = [F.to_json(F.struct(f)) for f, t in df.dtypes if t.startswith(("array", "map", "struct"))]
    size = reduce(lambda a, b: a + b, [F.coalesce(F.octet_length(c), F.lit(0)) for c in [*texts, *nested]], F.lit(ROW_BYTES))
    return (df.agg(F.sum(size.cast("long"))).first()[0] or 0) <= limit


#: Parts over which the rows of one key are spread where a dimension is too large to be sent.
SALTS = 32


def join_dimension(rows: DataFrame, dim: DataFrame, on: list[str], salt_by: str, limit: int = BROADCAST_BYTES, salts: int = SALTS) -> DataFrame:
    """Inner join with a dimension (unique in ``on``): sent to all tasks within ``limit`` bytes, beyond it a shuffle join on the key and a salt.

    The salt is the hash of ``salt_by``, a column of ``rows``, and every dimension row is repeated once per salt, so a key that owns any
    share of the rows is spread over ``salts`` tasks.
    """
    if is_within(dim, limit):
        return rows.join(F.broadcast(dim), on)
    salted = dim.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("__salt", F.pmod(F.xxhash64(salt_by), F.lit(salts)).cast("int")).join(salted, [*on, "__salt"]).drop("__salt")


def join_hot(left: DataFrame, right: DataFrame, on: list[str], hot: DataFrame, salt_by: str, salts: int = SALTS) -> DataFrame:
    """Inner shuffle join of many rows (``left``) with few (``right``); the keys in ``hot`` (columns ``on``, distinct) are spread over salts.

    ``hot`` has the keys above a row bound, so it has at most rows / bound of them.
    """
    if hot.isEmpty():
        return left.join(right, on)
    marks = broadcast_within(hot.select(*on, F.lit(True).alias("__hot")))
    salt = F.when(F.col("__hot"), F.pmod(F.xxhash64(salt_by), F.lit(salts)).cast("int")).otherwise(0)
    a = left.join(marks, on, "left").withColumn("__salt", salt).drop("__hot")
    each = F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    b = right.join(marks, on, "left").withColumn("__salt", F.explode(each)).drop("__hot")
    return a.join(b, [*on, "__salt"]).drop("__salt")


def bucket_counts(df: DataFrame, scope: list[str], rows_per_bucket: int, out: str = "n_buckets") -> DataFrame:
    """One row per scope with the number of buckets that hold about ``rows_per_bucket`` rows each (at least 1)."""
    return df.groupBy(*scope).agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / F.lit(rows_per_bucket))).cast("int").alias(out))


def bucket_of(key: Column, n_buckets: Column) -> Column:
    return F.pmod(F.xxhash64(key), n_buckets.cast("long")).cast("int")


def chunked_lag(df: DataFrame, keys: list[str], chunk: str, order: str, col: str, out: str, forward: bool = False) -> DataFrame:
    """LAG(col) over (keys order by order), or LEAD with ``forward``, without gathering a key in one task.

    ``chunk`` must not decrease with ``order`` inside a key, and (keys, order) must be unique. ``col`` must not be null.
    """
    at = F.col(order).desc() if forward else F.col(order)
    inside = df.withColumn(out, F.lag(col).over(Window.partitionBy(*keys, chunk).orderBy(at)))
    edge = (F.min_by if forward else F.max_by)(F.col(col), F.col(order))
    by = F.col(chunk).desc() if forward else F.col(chunk)
    edges = df.groupBy(*keys, chunk).agg(edge.alias("__edge"))
    edges = edges.withColumn("__edge", F.lag("__edge").over(Window.partitionBy(*keys).orderBy(by)))
    return inside.join(edges, [*keys, chunk], "left").withColumn(out, F.coalesce(F.col(out), F.col("__edge"))).drop("__edge")


def chunked_fill(df: DataFrame, keys: list[str], chunk: str, order: str, cols: list[str]) -> DataFrame:
    """Fills nulls of ``cols`` with the last value before them in (keys order by order), chunk by chunk as chunked_lag."""
    w = Window.partitionBy(*keys, chunk).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in cols})
    edges = df.groupBy(*keys, chunk).agg(*[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))).alias(f"__{c}") for c in cols])
    before = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    edges = edges.withColumns({f"__{c}": F.last(f"__{c}", ignorenulls=True).over(before) for c in cols})
    joined = inside.join(edges, [*keys, chunk], "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.col(f"__{c}")) for c in cols}).drop(*[f"__{c}" for c in cols])


def spread(df: DataFrame, key: str) -> DataFrame:
    """At least one partition per core for work that is heavy per row; a table that already has them is left as it is.

    A small file comes as one partition however costly its rows are. The rows are placed by hash, so a lost task repeats itself.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(2 * cores, key)
