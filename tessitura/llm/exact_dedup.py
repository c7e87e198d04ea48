"""Exact deduplication by stateful streaming (DataFrame and SQL functions only).

Arrivals (digest, identifier, content locator) run through a streaming aggregation whose keyed state
sits in RocksDB on disk and never expires. The state keeps, for each digest, the smallest identifier,
the place of its content (file and row), and how many rows hit the key. For every hit the contents are fetched by
their locators and checked on their full bytes; rows whose bytes differ in spite of equal digests form
classes of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checked_broadcast, numbered, scratch, written

#: Rows of one group that share a copy of the kept text in the byte check; larger groups get more copies.
ROWS_PER_SALT = 2048

#: Settings of the state store. Its native memory is bounded for each executor, and stores of a query that has ended are soon closed.
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "2",
    "spark.sql.streaming.stateStore.maintenanceInterval": "10s",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def normalised(text: Column) -> Column:
    """Null as empty; each run of blank, tab, line feed, vertical tab, form feed or carriage return as one blank.

    The pattern skips lone blanks, so most texts are not rebuilt.
    """
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def digest_state(spark: SparkSession, arrivals_path: str, schema, checkpoint: str, files_per_batch: int = 512) -> DataFrame:
    """Fold the arrivals under a path into the keyed state of a checkpoint and return the state.

    Calling it again with the same checkpoint after more files have arrived folds only those.
    Returns digest, keep_id, locator, group_size.
    """
    before = {k: spark.conf.get(k, None) for k in STATE_CONF}
    for k, v in STATE_CONF.items():
        spark.conf.set(k, v)
    try:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(arrivals_path)
        first = F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "locator")
        query = (
            stream.groupBy("digest")
            .agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("n"))
            .writeStream.format("noop")
            .outputMode("update")
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
        if query.exception() is not None:
            raise query.exception()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    state = spark.read.format("statestore").load(checkpoint)
    value = state.schema["value"].dataType.names
    return state.select(
        F.col("key.digest").alias("digest"),
        F.col(f"value.`{value[0]}`.doc_id").alias("keep_id"),
        F.col(f"value.`{value[0]}`.locator").alias("locator"),
        F.col(f"value.`{value[1]}`").alias("group_size"),
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_bytes: int = 32, row_col: str | None = None) -> DataFrame:
    """One row for each input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after `normalised`. The row with the smallest id stays. Null text
    counts as empty, so null and blank-free empty texts are one class. A null id is larger than any
    other; a class of null ids only has keep_id null and its rows are kept. Rows that repeat an id
    each get a row and share its decision. An empty table gives an empty result. Other columns, of
    whatever name, are ignored. digest_bytes shortens the state key (for tests of the byte check);
    results do not depend on it. row_col: a column that numbers the rows, if there is one.
    """
    spark = docs.sparkSession
    rows, at = (docs, row_col) if row_col else numbered(docs, id_col, text_col)
    rows = rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(at).alias("locator"))
    hashed = rows.withColumn("sha", F.sha2(normalised(F.col("text")), 256))
    arrivals = hashed.select("doc_id", F.substring(F.unhex("sha"), 1, digest_bytes).alias("digest"), F.unhex("sha").alias("sha"), "locator")
    path = scratch(spark, "arrivals")
    arrivals.write.parquet(path)
    state = written(digest_state(spark, path, arrivals.schema, scratch(spark, "digest-state")), "digest-classes")
    arrived = spark.read.schema(arrivals.schema).parquet(path)
    out = written(arrived.join(state.withColumnRenamed("locator", "first"), "digest"), "classed")

    wrong = written(_differing(rows.select("locator", "text"), out), "collisions")
    if not wrong.isEmpty():
        other = written(out.join(wrong, "locator"), "colliding-rows")
        own = other.groupBy("digest", "sha").agg(F.min("doc_id").alias("own_id"), F.count(F.lit(1)).alias("own_size"))
        less = own.groupBy("digest").agg(F.sum("own_size").alias("gone"))
        out = (
            out.join(own, ["digest", "sha"], "left")
            .join(less, "digest", "left")
            .withColumn("group_size", F.coalesce("own_size", F.col("group_size") - F.coalesce("gone", F.lit(0))))
            .withColumn("keep_id", F.when(F.col("own_size").isNotNull(), F.col("own_id")).otherwise(F.col("keep_id")))
        )
    return out.select(
        "doc_id",
        "keep_id",
        F.col("group_size").cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def _differing(texts: DataFrame, classed: DataFrame) -> DataFrame:
    """Locators of rows, in classes of two or more, whose bytes are not those of the row that the class keeps."""
    hits = written(classed.where("group_size > 1").select("locator", "first", "group_size"), "hits")
    bodies = written(texts.join(checked_broadcast(hits), "locator").select("locator", "first", "group_size", normalised(F.col("text")).alias("norm")), "hit-texts")
    bodies = bodies.withColumn("salts", F.expr(f"1 + group_size div {ROWS_PER_SALT}"))
    kept = bodies.where("locator = first").select("first", F.col("norm").alias("kept_norm"), F.explode(F.expr("sequence(0L, salts - 1)")).alias("salt"))
    asked = bodies.where("locator <> first").select("locator", "first", "norm", F.pmod(F.xxhash64("locator"), "salts").alias("salt"))
    return asked.join(kept, ["first", "salt"]).where("norm <> kept_norm").select("locator")
