"""Problem 5, history of changing attributes: a change log per attribute, combined at the union of the boundary dates.

Every attribute of an entity has its own log of changes, that is its own intervals. The versions of the entity are the pieces
between neighbouring boundaries of all logs; each piece takes every attribute's value as of its start, and equal neighbours are
coalesced. The updates are shuffled once, by entity, and all steps keep that partitioning. An entity with more updates than a bound
is worked on in chunks of an hour instead (``chunk``, see skew.chunked_lag), so one that owns any share of the updates is spread over
tasks: a task holds at most the distinct effect times of one hour.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strataform.operators.skew import broadcast_within, chunked_fill, chunked_lag

#: Updates of an entity that one task orders; an entity with more is cut into chunks.
ENTITY_ROWS = 200_000
#: The column that cuts the events of a large entity, made by effective_events.
CHUNK = "hour"


def split_hot(updates: DataFrame, keys: list[str], bound: int = ENTITY_ROWS) -> tuple[DataFrame, DataFrame | None]:
    """The updates of entities with at most ``bound`` rows, and of those with more (None if there is no such entity)."""
    hot = updates.dropna(subset=keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > bound).select(*keys)
    if hot.isEmpty():
        return updates, None
    hot = broadcast_within(hot)
    return updates.join(hot, keys, "left_anti"), updates.join(hot, keys, "left_semi")


def effective_events(updates: DataFrame, keys: list[str], at: str, ends: str, attributes: list[str], rank: list[str], chunked: bool = False) -> DataFrame:
    """One event per entity and effect time: of several rows the one with the greatest ``rank`` (columns, in order) counts.

    Rows without entity or time take no part; ``ends`` (boolean, null is false) marks the end of the entity.
    """
    rows = updates.dropna(subset=[*keys, at]).select(*keys, F.col(at).alias("at"), F.struct(*rank, F.coalesce(ends, F.lit(False)).alias("ends"), *attributes).alias("e"))
    if chunked:
        events = rows.groupBy(*keys, "at").agg(F.max("e").alias("e"))
    else:
        # The order of this window is that of all steps after it, so the rows are sorted once.
        place = F.row_number().over(Window.partitionBy(*keys, "at").orderBy(F.desc("e")))
        events = rows.repartition(*keys).withColumn("place", place).where("place = 1")
    return events.select(*keys, "at", F.date_trunc("hour", "at").alias(CHUNK), "e.ends", *[f"e.{a}" for a in attributes])


def _lag(df: DataFrame, keys: list[str], col: str, out: str, forward: bool, chunked: bool) -> DataFrame:
    if chunked:
        return chunked_lag(df, keys, CHUNK, "at", col, out, forward)
    return df.withColumn(out, (F.lead if forward else F.lag)(col).over(Window.partitionBy(*keys).orderBy("at")))


def attribute_log(events: DataFrame, keys: list[str], attributes: list[str], chunked: bool = False) -> DataFrame:
    """keys, attribute, at, hour, ends, value: a row wherever an attribute takes another value, or starts or ends with its entity."""
    prior = _lag(events.withColumn("now", F.struct("ends", *attributes)), keys, "now", "prior", False, chunked)
    one = [F.struct(F.lit(a).alias("attribute"), F.col(f"now.{a}").alias("value"), (_flips() | _moves(a)).alias("told")) for a in attributes]
    logs = prior.select(*keys, "at", CHUNK, "ends", F.explode(F.array(*one)).alias("x"))
    return logs.where("x.told").select(*keys, "x.attribute", "at", CHUNK, "ends", F.when(~F.col("ends"), F.col("x.value")).alias("value"))


def _flips() -> Column:
    """The entity starts or ends; nothing before counts as ended."""
    return F.coalesce("prior.ends", F.lit(True)) != F.col("ends")


def _moves(attribute: str) -> Column:
    return ~F.col("ends") & ~F.col(f"now.{attribute}").eqNullSafe(F.col(f"prior.{attribute}"))


def attribute_intervals(log: DataFrame, keys: list[str], chunked: bool = False) -> DataFrame:
    """The log with ``until``, the start of the attribute's next interval (null if open), without the pieces after an end."""
    out = _lag(log, [*keys, "attribute"], "at", "until", True, chunked)
    return out.where("not ends").select(*keys, "attribute", "value", F.col("at").alias("since"), "until")


def versions(log: DataFrame, keys: list[str], attributes: list[str], chunked: bool = False) -> DataFrame:
    """The versions of each entity: keys, attributes, since, until (null if open).

    A boundary is a time at which some attribute's log has a row; a piece starts at each and takes the values as of there. Pieces equal
    to the one before them are coalesced with it. An end closes the version before it and starts none; an end without a version before it
    is no boundary at all.
    """
    states = [f"s_{a}" for a in attributes]
    told = [F.max(F.when(F.col("attribute") == a, F.struct("ends", "value"))).alias(f"s_{a}") for a in attributes]
    bounds = log.groupBy(*keys, CHUNK, "at").agg(*told)
    if chunked:
        filled = chunked_fill(bounds, keys, CHUNK, "at", states)
    else:
        past = Window.partitionBy(*keys).orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        filled = bounds.withColumns({s: F.last(s, ignorenulls=True).over(past) for s in states})
    whole = _lag(filled.withColumn("piece", F.struct(*states)), keys, "piece", "before", False, chunked)
    first = whole.where(~F.col("piece").eqNullSafe(F.col("before"))).drop("piece", "before")
    cut = _lag(first, keys, "at", "until", True, chunked)
    alive = reduce(lambda x, y: x & y, [~F.col(f"{s}.ends") for s in states])
    return cut.where(alive).select(*keys, *[F.col(f"s_{a}.value").alias(a) for a in attributes], F.col("at").alias("since"), "until")
