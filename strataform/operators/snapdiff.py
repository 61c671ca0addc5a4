"""Problem 4, what changed between full snapshots: ordinals, compressed bitmaps and aligned vectors.

All keys a scope ever had share one dictionary of ordinals, the same in every snapshot, given out in the order in which keys appear:
a later snapshot's new keys take the next ordinals and change none before them (``ordinals``, and ``extended`` for a stored one). A
snapshot's keys are a bitmap over those ordinals, kept as its non-zero 64-bit words only; the compared columns are vectors packed in the order of the set bits, so a bit's
place in a vector is the number of set bits below it. Additions are ``word AND NOT previous``, removals ``previous AND NOT word``,
changes are read at the common bits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strataform.operators.skew import bucket_of, join_dimension


def ordinals(rows: DataFrame, part: list[str], key: str, seq: str) -> DataFrame:
    """Adds ``__ord``, 0, 1, ...: the key's place in its part by first snapshot, then by key. Rows are unique in part, key and ``seq``."""
    first = F.min(seq).over(Window.partitionBy(*part, key))
    return rows.withColumn("__first", first).withColumn("__ord", F.dense_rank().over(Window.partitionBy(*part).orderBy("__first", key)) - 1).drop("__first")


def extended(dictionary: DataFrame, keys: DataFrame, part: list[str], key: str) -> DataFrame:
    """A stored dictionary (part, key, __ord) with the next ordinals for ``keys`` (part, key) it lacks; the old ones stay as they are."""
    used = dictionary.groupBy(*part).agg(F.max("__ord").alias("__last"))
    new = keys.select(*part, key).dropna().distinct().join(dictionary, [*part, key], "left_anti").join(used, part, "left")
    place = F.row_number().over(Window.partitionBy(*part).orderBy(key))
    return dictionary.select(*part, key, "__ord").unionByName(new.select(*part, key, (F.coalesce("__last", F.lit(-1)) + place).alias("__ord")))


def snapshot_changes(rows: DataFrame, snapshots: DataFrame, scope: str, snapshot: str, key: str, value: str) -> DataFrame:
    """Keys added, removed or changed against the scope's previous snapshot.

    ``rows``: scope, snapshot, key (unique within scope and snapshot) and ``value``, a struct compared null-safely, with the columns
    ``seq`` (1, 2, ... the place of the snapshot in its scope), ``next_snapshot`` (null for the last) and ``n_buckets`` (of the scope)
    joined from ``snapshots``. The first snapshot of a scope gives no rows; a scope with no rows in a snapshot has no such snapshot.
    Empty input gives no rows. Result: scope, snapshot (the later one), key, change_kind.
    """
    part = [scope, "__bucket"]
    bucketed = join_dimension(rows, snapshots, [scope, snapshot], key).withColumn("__bucket", bucket_of(F.col(key), F.col("n_buckets")))
    placed = (
        # One shuffle, by bucket, which all steps below keep.
        ordinals(bucketed.repartition(*part), part, key, "seq")
        .withColumn("__word", F.shiftright("__ord", 6))
        .withColumn("__bit", F.col("__ord").bitwiseAND(63))
    )
    vector = F.sort_array(F.collect_list(F.struct("__bit", F.col(key).alias("k"), F.col(value).alias("v"))))
    words = placed.groupBy(*part, "__word", "seq").agg(
        F.bit_or(F.expr("shiftleft(1L, __bit)")).alias("bits"),
        vector.alias("vec"),
        F.first(snapshot).alias(snapshot),
        F.first("next_snapshot").alias("next_snapshot"),
    )
    chain = Window.partitionBy(*part, "__word").orderBy("seq")
    near = lambda c, f, step: F.when(f("seq").over(chain) == F.col("seq") + step, f(c).over(chain))
    pairs = words.withColumns(
        {
            "before": F.coalesce(near("bits", F.lag, -1), F.lit(0).cast("long")),
            "old": near("vec", F.lag, -1),
            "after": F.coalesce(near("bits", F.lead, 1), F.lit(0).cast("long")),
        }
    )
    added = F.when(F.col("seq") > 1, F.expr("bits & ~before")).otherwise(F.lit(0).cast("long"))
    removed = F.when(F.col("next_snapshot").isNotNull(), F.expr("bits & ~after")).otherwise(F.lit(0).cast("long"))
    found = pairs.withColumns({"added": added, "removed": removed, "common": F.expr("bits & before")})
    # Place of a bit in a packed vector: the count of set bits below it.
    at = "{v}[bit_count({m} & ~shiftleft(-1L, b))]"
    some = "transform(filter(sequence(0, 63), b -> (shiftright({w}, b) & 1L) = 1L), b -> {x})"
    new, old = at.format(v="vec", m="bits"), at.format(v="old", m="before")
    gone = some.format(w="removed", x=f"named_struct('s', next_snapshot, 'k', {new}.k, 'c', 'removed')")
    came = some.format(w="added", x=f"named_struct('s', {snapshot}, 'k', {new}.k, 'c', 'added')")
    differs = f"filter(filter(sequence(0, 63), b -> (shiftright(common, b) & 1L) = 1L), b -> not ({new}.v <=> {old}.v))"
    kept = f"transform({differs}, b -> named_struct('s', {snapshot}, 'k', {new}.k, 'c', 'changed'))"
    return (
        found.where("added <> 0 or removed <> 0 or (common <> 0 and not (vec <=> old))")
        .select(scope, F.explode(F.expr(f"concat({came}, {gone}, {kept})")).alias("x"))
        .select(scope, F.col("x.s").alias(snapshot), F.col("x.k").alias(key), F.col("x.c").alias("change_kind"))
    )
