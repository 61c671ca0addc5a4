"""A source tree as a table: ``spark.read.format("repofs").option("path", root).load()``.

One row per file with its text, one partition per top-level entry of the root (the root's own files make one more), so a large tree or
many trees are read in parallel. Dot files are read like others. Directories that hold no sources are pruned and told as rows of kind
``skipped``, unreadable ones as rows of kind ``error``; links that lead out of the root are left out, and linked directories are read
under their own path only.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Directories without sources.
PRUNED = frozenset(
    (
        ".git node_modules vendor dist build out .next .nuxt .svelte-kit coverage .dart_tool target .turbo .nx .cache .venv venv __pycache__"
        " .pytest_cache .mypy_cache .gradle .idea .vscode Pods DerivedData .parcel-cache .yarn .pnpm-store"
    ).split()
)
MAX_BYTES = 2 << 20
_LOG = re.compile(r"(?i)\.(log|out|dump)$|(^|/)(debug|trace|coverage-final|chrome-devtools|heapdump)")

SCHEMA = "repo string, path string, kind string, size_bytes bigint, is_symlink boolean, is_binary boolean, is_empty boolean, text string, message string"


def looks_binary(data: bytes) -> bool:
    """A NUL, or more than 30 % control bytes, in the first 8,000 bytes."""
    head = data[:8000]
    odd = sum(b < 7 or 13 < b < 32 for b in head)
    return 0 in head or odd / max(len(head), 1) > 0.3


def inside(root: str, path: str) -> bool:
    return os.path.commonpath([root, path]) == root


class Branch(InputPartition):
    def __init__(self, root: str, start: str, deep: bool) -> None:
        self.root, self.start, self.deep = root, start, deep


class RepoReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.roots = [os.path.realpath(p) for p in options["path"].split(",")]
        self.max_bytes = int(options.get("maxbytes", MAX_BYTES))

    def partitions(self) -> list[Branch]:
        out = []
        for root in self.roots:
            out.append(Branch(root, root, False))
            with os.scandir(root) as entries:
                out += [Branch(root, e.path, True) for e in sorted(entries, key=lambda e: e.name) if e.is_dir(follow_symlinks=False)]
        return out

    def read(self, part: Branch) -> Iterator[tuple]:
        rel = lambda p: os.path.relpath(p, part.root).replace(os.sep, "/")
        row = lambda p, kind, **x: (
            part.root, rel(p), kind, x.get("size"), x.get("link"), x.get("binary"), x.get("empty"), x.get("text"), x.get("message"),
        )
        stack = [part.start]
        if part.deep and os.path.basename(part.start) in PRUNED:
            yield row(part.start, "skipped")
            return
        while stack:
            here = stack.pop()
            try:
                entries = sorted(os.scandir(here), key=lambda e: e.name)
            except OSError as e:
                yield row(here, "error", message=e.strerror)
                continue
            for e in entries:
                try:
                    if e.is_symlink() and not inside(part.root, os.path.realpath(e.path)):
                        continue
                    if e.is_dir():
                        if e.is_symlink():
                            continue
                        if e.name in PRUNED and here != part.root:
                            yield row(e.path, "skipped")
                        elif part.deep:
                            stack.append(e.path)
                    elif e.is_file():
                        yield self._file(row, rel(e.path), e)
                except OSError as x:
                    yield row(e.path, "error", message=x.strerror)

    def _file(self, row, path: str, e: os.DirEntry) -> tuple:
        size, link = e.stat(follow_symlinks=False).st_size, e.is_symlink()
        if size > self.max_bytes:
            # Logs are told by their size although their text is not read.
            return row(e.path, "file" if _LOG.search(path) else "oversized", size=size, link=link)
        with open(e.path, "rb") as f:
            data = f.read(self.max_bytes + 1)
        binary = looks_binary(data)
        text = None if binary else data.decode("utf-8", "replace")
        return row(e.path, "file", size=size, link=link, binary=binary, empty=not binary and not text.strip(), text=text)


class RepoSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "repofs"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RepoReader:
        return RepoReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RepoSource)
