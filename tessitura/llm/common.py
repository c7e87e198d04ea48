"""Helpers that the training-data operators share: scratch tables, checked broadcasts, connected components."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of an Arrow batch between the JVM and Python workers, which hold a few copies of it.
BATCH_BYTES = 2 << 20
#: Rows up to which `checked_broadcast` broadcasts a side of a few fixed-width columns (about 64 bytes a row).
BROADCAST_ROWS = 500_000

_made: list[tuple[SparkSession, str]] = []
_kept: dict[str, dict] = {}
_scope: ContextVar[list | None] = ContextVar("scratch", default=None)


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where that is unset, a session of one machine (a local master) gets a temporary folder; on a cluster, whose
    executors would write to disks of their own, that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tessitura-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def qualified(spark: SparkSession, path: str) -> str:
    """A path with its scheme; one without is on the session's default file system."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    whole = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(target).toString()
    return "file://" + whole.removeprefix("file:") if whole.startswith("file:/") and not whole.startswith("file://") else whole


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name under the shared folder; it goes when the driver ends, or with `settled`."""
    path = f"{scratch_root(spark)}/tessitura/{name}-{uuid.uuid4().hex[:12]}"
    if not _made:
        atexit.register(sweep)
    _made.append((spark, path))
    if (scope := _scope.get()) is not None:
        scope.append((spark, path))
    return path


def sweep() -> None:
    """Delete every scratch folder made so far: at the driver's end."""
    while _made:
        drop(*_made.pop())


def settled(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """What `make` returns, as a written table; the scratch folders made on the way there are deleted, also if it fails.

    Folders are those of this call's own context, so calls in other threads keep theirs.
    """
    outer, own = _scope.get(), []
    token = _scope.set(own)
    try:
        out = written(make(), name)
        last = own.pop()
    finally:
        _scope.reset(token)
        for spark, path in own:
            drop(spark, path)
    if outer is not None:
        outer.append(last)
    return out


def drop(spark: SparkSession, path: str) -> None:
    jvm = getattr(spark.sparkContext, "_jvm", None)
    if jvm is None or spark.sparkContext._jsc is None:
        return
    try:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001  the session may be gone already
        pass


def bound_batches(spark: SparkSession) -> None:
    """Hold the session's Arrow batches to BATCH_BYTES, so that rows with long texts don't add up."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key).rstrip("bB")) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def worker_state(operator: str) -> dict:
    """What this worker process keeps between tasks of an operator. What it kept for another operator goes first, so that the
    memory of the operators of a session doesn't add up in workers that serve them all."""
    if operator not in _kept:
        _kept.clear()
        pa.default_memory_pool().release_unused()
    return _kept.setdefault(operator, {})


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, read again: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _scans_files(docs: DataFrame) -> bool:
    """Whether docs is a reading of files, but for projections and filters, so that each of its rows is one of theirs."""
    plan = docs._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    return plan.nodeName() == "LogicalRelation"


def numbered(docs: DataFrame, *columns: str) -> tuple[DataFrame, str]:
    """docs with a number of its own for each row, the same at every reading, and the name of that column.

    Rows of Parquet files are numbered by their file and their place in it, so nothing is written and no
    row moves; other tables are written first, of which only the given columns are kept. Files are numbered in order of
    their names, in a table that is broadcast only after it was counted.
    """
    name = "_row"
    while name in docs.columns:
        name += "_"
    if not _scans_files(docs):
        return numbered(written(docs.select(*columns), "rows"), *columns)
    file, place = f"_file{name}", f"_place{name}"
    meta = docs.metadataColumn("_metadata")
    placed = docs.select("*", meta["file_path"].alias(file), meta["row_index"].alias(place))
    nth = F.row_number().over(Window.orderBy(file)) - 1  # a row for each file
    files = written(placed.select(file).distinct().select(file, F.shiftleft(nth.cast("long"), 33).alias(name)), "files")
    rows = placed.join(checked_broadcast(files), file).withColumn(name, F.col(name) + F.col(place))
    return rows.drop(file, place), name


def without(rows: DataFrame, gone: DataFrame, row_col: str) -> DataFrame:
    """The rows that `gone` doesn't number, without their numbers."""
    return rows.join(gone, row_col, "left_anti").drop(row_col)


def checked_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most `rows` rows, otherwise as it is (the join then shuffles).

    Counts df, so pass a written table.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components by alternating large-star and small-star steps.

    edges: columns a, b (long). Returns (node, root) with root the smallest node reachable; nodes
    without edges are absent. All state stays in tables; the driver sees one sum per round.
    """

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        near = pairs.select(F.col("a").alias("u"), F.col("b").alias("v"))
        if large:
            near = near.unionByName(pairs.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        joined = near.join(least, "u")
        keep = F.col("v") > F.col("u") if large else F.lit(True)
        out = joined.where(keep).select(F.col("v").alias("x"), F.col("m").alias("y"))
        if not large:
            out = out.unionByName(least.select(F.col("u").alias("x"), F.col("m").alias("y")))
        return out.where("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()

    pairs = written(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc"
    )
    seen = None
    for _ in range(rounds):
        pairs = written(star(star(pairs, large=True), large=False), "cc")
        now = tuple(
            pairs.agg(
                F.count("*"),
                F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")),
                F.sum(F.col("b").cast("decimal(38,0)")),
            ).first()
        )
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("connected components did not converge")
    return pairs.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")).unionByName(
        pairs.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
