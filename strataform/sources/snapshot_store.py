"""Snapshots of tables in a folder: written once, checked by checksum, listed in order."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = "1.0.0"
_ID = re.compile(r"[A-Za-z0-9_-]{1,128}")


class SnapshotConflict(ValueError):
    """A snapshot of this id exists with other content."""


def checksum(df: DataFrame) -> str:
    """A checksum of the rows whatever their order: count, and the exact sum of 64-bit hashes of the rows as JSON."""
    row = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
    n, total = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64(row).cast("decimal(38,0)"))).first()
    return f"{n}:{total or 0}"


class SnapshotStore:
    """``<root>/<table>/snapshot_id=<id>`` per snapshot and a registry table of one row per snapshot."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str, snapshot_id: str) -> str:
        for part in (name, snapshot_id):
            if not _ID.fullmatch(part):
                raise ValueError(f"not a name: {part!r}")
        return f"{self.root}/{name}/snapshot_id={snapshot_id}"

    def registry(self) -> DataFrame:
        """snapshot_id, name, created_at, checksum, version in order of time and id; empty if nothing was saved."""
        schema = "snapshot_id string, name string, created_at timestamp, checksum string, version string"
        try:
            rows = self.spark.read.schema(schema).parquet(f"{self.root}/registry")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)
        return rows.orderBy("created_at", "snapshot_id")

    def save(self, name: str, snapshot_id: str, df: DataFrame, created_at) -> bool:
        """Writes a snapshot. The same id and content again is no change (False); the same id with other content is refused."""
        path = self._path(name, snapshot_id)
        total = checksum(df)
        known = self.registry().where((F.col("snapshot_id") == snapshot_id) & (F.col("name") == name)).select("checksum").first()
        if known:
            if known[0] != total:
                raise SnapshotConflict(f"refusing to overwrite {name}/{snapshot_id}")
            return False
        df.write.mode("overwrite").parquet(path)
        row = self.spark.createDataFrame([(snapshot_id, name, created_at, total, VERSION)], self.registry().schema)
        row.coalesce(1).write.mode("append").parquet(f"{self.root}/registry")
        return True

    def load(self, name: str, snapshot_id: str) -> DataFrame:
        """The rows of a snapshot; fails if it is unknown, of another version, or not what was saved."""
        path = self._path(name, snapshot_id)
        known = self.registry().where((F.col("snapshot_id") == snapshot_id) & (F.col("name") == name)).select("checksum", "version").first()
        if not known:
            raise KeyError(f"{name}/{snapshot_id}")
        if known[1] != VERSION:
            raise ValueError(f"version {known[1]}")
        df = self.spark.read.parquet(path)
        if checksum(df) != known[0]:
            raise ValueError(f"{name}/{snapshot_id} is not what was saved")
        return df

    def latest(self, name: str) -> DataFrame:
        last = self.registry().where(F.col("name") == name).orderBy(F.desc("created_at"), F.desc("snapshot_id")).select("snapshot_id").first()
        if not last:
            raise KeyError(name)
        return self.load(name, last[0])


def stable_json(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows as JSON text with columns in name order, ordered by keys: the same table gives the same lines."""
    return df.orderBy(*keys).select(F.to_json(F.struct(*sorted(df.columns))).alias("value"))


def annotations(findings: DataFrame) -> DataFrame:
    """Findings as workflow commands: ::error file=...,title=...::message with the reserved characters escaped."""
    escape = lambda c: reduce(lambda x, kv: F.replace(x, F.lit(kv[0]), F.lit(kv[1])), (("%", "%25"), ("\r", "%0D"), ("\n", "%0A")), c)
    prop = lambda c: F.replace(F.replace(escape(c), F.lit(":"), F.lit("%3A")), F.lit(","), F.lit("%2C"))
    level = F.when(F.col("severity") == "critical", "error").when(F.col("severity") == "warning", "warning").otherwise("notice")
    line = F.concat(F.lit("::"), level, F.lit(" file="), prop(F.col("path")), F.lit(",title="), prop(F.col("rule_id")), F.lit("::"), escape(F.coalesce("detail", F.lit(""))))
    return findings.select(line.alias("value"))
