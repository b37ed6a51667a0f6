"""Ingestion as a stream: new documents are chunked, embedded and marked, each once, however often a batch is run again.

State is in tables by business key, in buckets: a document's chunks are written before the document counts as done, and a
batch begins with an anti-join against what is done in the buckets of its documents. The trigger takes what is there and
stops, so it also serves to back-fill.
"""

from __future__ import annotations

import random
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodemill.functions.splitting import chunk_rows
from lodemill.operators.store import not_yet
from lodemill.sources.buckets import Buckets
from lodemill.sources.tables import written
from lodemill.spi import Embedder, HashEmbedder, embedding


def with_retries(run: Callable[[], object], recover: Callable[[Exception], object] | None = None, attempts: int = 3, first: float = 0.5, most: float = 5.0, wait: Callable[[float], None] = time.sleep) -> object:
    """Run with exponential backoff and jitter; ``recover`` gets the last error."""
    for k in range(attempts):
        try:
            return run()
        except Exception as error:
            if k == attempts - 1:
                if recover is None:
                    raise
                return recover(error)
            wait(min(most, first * 2**k) * (1 + random.random() / 10))
    return None


CHUNKS = "document_id long, chunk_index int, content string, start_position long, end_position long, overlap_length int, quality_score double, vectorized boolean, external_id string, embedding array<float>"
STATES = "document_id long, status string, error_message string"
FILLED = "document_id long, chunk_index int, embedding array<float>"
WAITING = "document_id long, chunk_index int, content string, batch string"
#: Buckets by document of each table of a store.
BUCKETS = 64


def _table(spark: SparkSession, store: str, name: str, schema: str) -> Buckets:
    return Buckets(spark, f"{store}/{name}", schema, "document_id", BUCKETS)


def states(spark: SparkSession, store: str) -> DataFrame:
    """``document_id``, ``status``, ``error_message`` of each document."""
    return _table(spark, store, "states", STATES).read()


def chunks(spark: SparkSession, store: str) -> DataFrame:
    """All chunks, with the vectors that were filled in later."""
    filled = _table(spark, store, "filled", FILLED).read().dropDuplicates(["document_id", "chunk_index"]).withColumnRenamed("embedding", "_later")
    both = _table(spark, store, "chunks", CHUNKS).read().join(filled, ["document_id", "chunk_index"], "left")
    vector = F.coalesce("embedding", "_later")
    return both.withColumn("vectorized", vector.isNotNull()).withColumn("embedding", vector).select(*[c.split()[0] for c in CHUNKS.split(", ")])


def process_batch(docs: DataFrame, store: str, size: int = 500, overlap: int = 100, embedder: Embedder | None = None, strategy: str = "RECURSIVE_CHARACTER", batch: int | None = None) -> None:
    """Chunks and states of the documents of a batch that are not done.

    Those without content are FAILED; those of which every chunk has a vector are INDEXED, others are PROCESSING until
    ``backfill`` has filled the rest in. Of rows that share an id the one with the least content counts. Only the states of
    the buckets that the documents fall into are read. Chunks are put beside those that are there, in folders named by the
    batch's number (else by its documents), so that a batch that was broken off writes over what it left; states come last.
    """
    spark = docs.sparkSession
    known, table = _table(spark, store, "states", STATES), _table(spark, store, "chunks", CHUNKS)
    asked = docs.select(F.col("id").alias("document_id"), "content").where("id is not null")
    # whether an id has content is told once, so that only the content of new documents is shuffled, and once
    ids = written(asked.groupBy("document_id").agg(F.min(F.col("content") != "").alias("filled")), "asked")
    new = written(not_yet(ids, known.of(ids), "document_id"), "new")
    n, name = new.count(), ids.agg(F.bit_xor(F.xxhash64("document_id"))).first()[0]
    if not n:
        return
    name = str(name if batch is None else batch)
    good = asked.join(new.where("filled"), "document_id", "left_semi").groupBy("document_id").agg(F.min("content").alias("content"))
    vectors = chunk_rows(good, "document_id", "content", size, overlap, strategy).withColumn("embedding", embedding(F.col("content"), embedder or HashEmbedder()))
    key = F.concat(F.lit("chunk-"), F.col("document_id").cast("string"), F.lit("-"), F.col("chunk_index").cast("string"))
    table.insert(vectors.withColumn("vectorized", F.col("embedding").isNotNull()).withColumn("external_id", key), name)
    own = table.inserted(name)
    pending = written(own.where("not vectorized").select("document_id", "chunk_index", "content").withColumn("batch", F.lit(name)), "pending")
    if not pending.isEmpty():
        pending.write.mode("append").partitionBy("batch").parquet(f"{store}/waiting")
    whole = own.groupBy("document_id").agg(F.bool_and("vectorized").alias("whole"))
    empty = ~F.coalesce("filled", F.lit(False))
    status = F.when(empty, "FAILED").when(F.coalesce("whole", F.lit(True)), "INDEXED").otherwise("PROCESSING")
    found = new.join(whole, "document_id", "left").select("document_id", status.alias("status"), F.when(empty, "no content").alias("error_message"))
    known.change(found, lambda old, rows: old.unionByName(rows))


def ingest(spark: SparkSession, source: str, schema: str, store: str, checkpoint: str, files_per_trigger: int = 64, **how) -> None:
    """Take all Parquet files of ``source`` that are new, and wait until they are done."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(source)
    query = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda rows, batch: with_retries(lambda: process_batch(rows, store, batch=batch, **how))).start()
    query.awaitTermination()


def _waiting(spark: SparkSession, store: str) -> list[str]:
    """The folders of chunks that wait for vectors, oldest first."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{store}/waiting")
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [(f.getModificationTime(), f.getPath().getName()) for f in fs.listStatus(at) if f.isDirectory()] if fs.exists(at) else []
    return [name for _, name in sorted(found) if name.startswith("batch=")]


def backfill(spark: SparkSession, store: str, embedder: Embedder | None = None, limit: int = 1000) -> int:
    """Fill in vectors of up to ``limit`` chunks without one, oldest batches first, and mark documents INDEXED that have none left; how many were filled.

    What waits is a queue beside the store, a folder for each batch: as many folders are read as the limit asks for, and
    written anew without what was filled. Of the store only the states of the documents' buckets are read. The queue is
    shortened last, so that a run that was broken off is made good by the next one; a vector that is filled in twice counts once.
    """
    read = lambda names: spark.read.schema(WAITING).option("basePath", f"{store}/waiting").parquet(*[f"{store}/waiting/{x}" for x in names])
    taken, n = [], 0
    for name in _waiting(spark, store):
        taken.append(name)
        n += read([name]).count()
        if n >= limit:
            break
    if not taken:
        return 0
    rows = written(read(taken).dropDuplicates(["document_id", "chunk_index"]), "taken")
    todo = rows.orderBy("document_id", "chunk_index").limit(limit)
    filled = written(todo.select("document_id", "chunk_index", embedding(F.col("content"), embedder or HashEmbedder()).alias("embedding")).where("embedding is not null"), "filled")
    n = filled.count()
    if not n:
        return 0
    _table(spark, store, "filled", FILLED).insert(filled, uuid.uuid4().hex)
    left = written(rows.join(filled, ["document_id", "chunk_index"], "left_anti").select("document_id", "chunk_index", "content", "batch"), "left")
    ready = filled.select("document_id").distinct().join(left, "document_id", "left_anti")
    _table(spark, store, "states", STATES).set_status(ready.withColumn("status", F.lit("INDEXED")).withColumn("error_message", F.lit(None).cast("string")))
    left.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{store}/waiting")
    kept = {f"batch={r[0]}" for r in left.select("batch").distinct().collect()}
    for name in set(taken) - kept:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{store}/waiting/{name}")
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    return n


def windowed_counts(events: DataFrame, length: str = "1 hour", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Events and their mean value by kind and window of event time; works on a stream and on a table."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    out = timed.groupBy(w, "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean_value"))
    return out.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "event_type", "n", "mean_value")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Each user's sessions: events with less than ``gap`` between them."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    out = timed.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")
