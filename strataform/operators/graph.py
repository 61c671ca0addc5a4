"""Reachability over edge tables by a frontier loop; the rows of a step are written to the shared folder, so lineage does not grow."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataform.sources.shared import own_dir, written


def reach(edges: DataFrame, roots: DataFrame, scope: list[str], mode: str = "dependencies", max_depth: int | None = None) -> DataFrame:
    """scope, root, node, depth: everything that the edges (scope, source, target) lead to from each root (scope, node), roots at depth 0.

    ``mode``: dependencies follow edges, dependents go against them, blast-radius does both. A node has its least depth; cycles end where
    they meet what was reached, so the loop ends by itself. With ``max_depth`` it stops there, and a column ``truncated`` tells for every
    root whether there was more. Only the frontier of the last step joins the edges, and what it reaches is reduced to distinct nodes
    before it moves on.
    """
    forward = edges.select(*scope, F.col("source").alias("node"), F.col("target").alias("to"))
    back = edges.select(*scope, F.col("target").alias("node"), F.col("source").alias("to"))
    steps = {"dependencies": forward, "dependents": back, "blast-radius": forward.unionByName(back)}[mode]
    steps = written(steps.dropna().distinct())
    first = roots.select(*scope, F.col("node").alias("root"), "node").dropna().distinct()
    # One folder for all that is reached, a part per depth, so that reading it stays one scan however deep it gets.
    spark, base = edges.sparkSession, f"{own_dir(edges.sparkSession)}/{uuid.uuid4().hex}"
    reached = lambda path: spark.read.schema(first.schema).option("basePath", base).parquet(path)
    first.write.parquet(f"{base}/depth=0")
    depth, more = 0, None
    while True:
        frontier, seen = reached(f"{base}/depth={depth}"), reached(f"{base}/depth=*")
        met = frontier.join(steps, [*scope, "node"]).select(*scope, "root", F.col("to").alias("node")).distinct()
        found = met.join(seen, [*scope, "root", "node"], "left_anti")
        if max_depth is not None and depth == max_depth:
            more = found.select(*scope, "root").distinct().withColumn("truncated", F.lit(True))
            break
        depth += 1
        found.write.parquet(f"{base}/depth={depth}")
        if reached(f"{base}/depth={depth}").isEmpty():
            break
    out = spark.read.schema(T.StructType([*first.schema.fields, T.StructField("depth", T.IntegerType())])).option("basePath", base).parquet(base)
    if max_depth is None:
        return out
    if more is None:
        return out.withColumn("truncated", F.lit(False))
    return out.join(more, [*scope, "root"], "left").na.fill(False, ["truncated"])


def reached_edges(edges: DataFrame, nodes: DataFrame, scope: list[str]) -> DataFrame:
    """scope, root and the edges with both ends among the root's nodes."""
    a = nodes.select(*scope, "root", F.col("node").alias("source"))
    b = nodes.select(*scope, "root", F.col("node").alias("target"))
    return edges.join(a, [*scope, "source"]).join(b, [*scope, "root", "target"])


def two_cycles(edges: DataFrame, scope: list[str]) -> DataFrame:
    """Pairs of names with edges both ways, each pair once in order."""
    pairs = edges.where("source <> target").select(*scope, "source", "target").distinct()
    named = pairs.select(
        *scope, F.least("source", "target").alias("first"), F.greatest("source", "target").alias("second"), (F.col("source") < F.col("target")).alias("forth")
    )
    both = named.groupBy(*scope, "first", "second").agg(F.count_distinct("forth").alias("n"))
    return both.where("n = 2").drop("n")
