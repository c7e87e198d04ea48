"""Media files as a data source of Spark: trees are walked by the executors, hidden folders are never listed.

The driver lists the roots only; each entry of a root is a partition, which walks depth first in order of names and stops after
`limit` files. Folders must be mounted alike on every executor. What a probe found about a file is kept by path, size and
time, so a file that did not change is not probed again.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tessitura.sources.catalog import MEDIA

SCHEMA = "path string, rel_path string, title string, video_id string, size long, mtime long, place array<string>"
#: Folders whose names begin so are hidden.
HIDDEN = ("_", ".")


def _named(stem: str) -> tuple[str, str | None]:
    """Title and video id of a file's name without extension."""
    head, bracket, tail = stem.rpartition("[")
    ident = tail[:-1]
    if bracket and tail.endswith("]") and len(ident) == 11 and all(c.isascii() and (c.isalnum() or c in "_-") for c in ident):
        return head.rstrip(" \t\n_").strip() or stem, ident
    return stem, None


class _Entry(InputPartition):
    def __init__(self, root: str, name: str, at: int):
        self.root, self.name, self.at = root, name, at


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.roots = options["path"].split(os.pathsep)
        self.limit = int(options.get("limit", -1))

    def partitions(self) -> list[InputPartition]:
        found = [_Entry(root, name, at) for at, root in enumerate(self.roots) for name in sorted(os.listdir(root)) if not (name.startswith(HIDDEN) and os.path.isdir(os.path.join(root, name)))]
        return found or [_Entry("", "", 0)]

    def read(self, partition: _Entry) -> Iterator[tuple]:
        if not partition.root:
            return
        left = self.limit
        for path in self._walk(os.path.join(partition.root, partition.name)):
            if left == 0:
                return
            try:
                stat = os.stat(path)
            except OSError:  # gone meanwhile
                continue
            left -= 1
            rel = os.path.relpath(path, partition.root)
            title, ident = _named(os.path.splitext(os.path.basename(path))[0])
            yield path, rel, title, ident, stat.st_size, int(stat.st_mtime), [f"{partition.at:06d}", *rel.split(os.sep)]

    def _walk(self, path: str) -> Iterator[str]:
        if os.path.isdir(path) and not os.path.islink(path):
            with os.scandir(path) as scan:
                names = sorted((e.name, e.is_dir(follow_symlinks=False)) for e in scan)
            for name, folder in names:
                if not (folder and name.startswith(HIDDEN)):
                    yield from self._walk(os.path.join(path, name))
        elif os.path.isfile(path) and os.path.splitext(path)[1].lower().lstrip(".") in MEDIA:
            yield path


class MediaSource(DataSource):
    """spark.read.format("media").option("limit", n).load(roots), several roots joined as in PATH."""

    @classmethod
    def name(cls) -> str:
        return "media"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def scan(spark: SparkSession, roots: list[str], limit: int = 1000) -> tuple[DataFrame, bool]:
    """The first `limit` media files of the roots in order of path, and whether there are more."""
    spark.dataSource.register(MediaSource)
    most = max(0, limit)
    found = spark.read.format("media").option("limit", most + 1).load(os.pathsep.join(r.rstrip("/") for r in roots)).orderBy("place").limit(most + 1)
    return found.limit(most).drop("place"), found.count() > most


def probed(files: DataFrame, known: DataFrame, probe: Callable[[str], float | None]) -> tuple[DataFrame, DataFrame]:
    """Files with their duration, and the table of what is known now (path, size, mtime, duration).

    Only files that `known` has not with the same size and time are probed; what could not be found out is not kept, so that the
    next scan tries again.
    """
    met = files.join(known.where("duration IS NOT NULL"), ["path", "size", "mtime"], "left")
    fresh, rest = met.where("duration IS NOT NULL"), met.where("duration IS NULL").drop("duration")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(duration=[probe(p) for p in frame["path"]])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rest.schema.fields)
    every = fresh.unionByName(rest.mapInPandas(run, kinds + ", duration double"))
    return every, every.where(F.col("duration").isNotNull() & ~F.isnan("duration")).select("path", "size", "mtime", "duration")
