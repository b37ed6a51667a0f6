"""Documents whose vectors come, or never do: a stream of chunks meets a stream of vectors, and what waits too long has failed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodemill.sources.buckets import Buckets

OUTCOMES = "document_id long, chunk_index int, n_chunks int, vectorized boolean"
STATES = "document_id long, status string, error_message string"


def outcomes(chunks: DataFrame, vectors: DataFrame, wait: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """``document_id, chunk_index, n_chunks, vectorized`` of each chunk, when its vector has come or can no longer come.

    ``chunks(document_id, chunk_index, n_chunks, at)`` and ``vectors(document_id, chunk_index, at)`` are streams; a vector
    counts from the time of its chunk until ``wait`` after it. Rows that are sent again within ``late`` and ``wait``, and
    rows that are later than ``late``, are dropped; null keys have no outcome but move time on. State holds what is younger than both.
    """
    span = f"{late} {wait}"
    key = ["document_id", "chunk_index"]
    c = chunks.withColumn("at", F.col("at").cast("timestamp")).withWatermark("at", span).dropDuplicatesWithinWatermark(key)
    v = vectors.select(*[F.col(k).alias(f"_{k}") for k in key], F.col("at").cast("timestamp").alias("_at")).withWatermark("_at", span).dropDuplicatesWithinWatermark([f"_{k}" for k in key])
    on = (F.col("document_id") == F.col("_document_id")) & (F.col("chunk_index") == F.col("_chunk_index")) & F.col("_at").between(F.col("at"), F.col("at") + F.expr(f"interval {wait}"))
    return c.join(v, on, "leftOuter").where("document_id is not null").select(*key, "n_chunks", F.col("_at").isNotNull().alias("vectorized"))


def follow(found: DataFrame, store: str, checkpoint: str, buckets: int = 64) -> None:
    """Takes what is there of ``outcomes`` and keeps ``states`` of the documents: FAILED if a vector of theirs never came, INDEXED if all have come, else PROCESSING.

    A batch's outcomes are put beside the others of their buckets under its number, and the states of its documents are made
    from the buckets that they fall into; a batch that is run again changes nothing.
    """
    spark = found.sparkSession
    seen, states = Buckets(spark, f"{store}/outcomes", OUTCOMES, "document_id", buckets), Buckets(spark, f"{store}/states", STATES, "document_id", buckets)

    def take(rows: DataFrame, number: int) -> None:
        seen.insert(rows, str(number))
        told = seen.inserted(str(number)).select("document_id").distinct()
        whole = seen.of(told).join(told, "document_id", "left_semi").groupBy("document_id").agg(F.bool_or(~F.col("vectorized")).alias("lost"), F.count_distinct(F.when(F.col("vectorized"), F.col("chunk_index"))).alias("there"), F.max("n_chunks").alias("n"))
        status = F.when(F.col("lost"), "FAILED").when(F.col("there") >= F.col("n"), "INDEXED").otherwise("PROCESSING")
        states.change(whole.select("document_id", status.alias("status"), F.when(F.col("lost"), "no vector").alias("error_message")), lambda old, new: old.join(new, "document_id", "left_anti").unionByName(new))

    found.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(take).start().awaitTermination()


def states(spark: SparkSession, store: str, buckets: int = 64) -> DataFrame:
    """``document_id``, ``status``, ``error_message``."""
    return Buckets(spark, f"{store}/states", STATES, "document_id", buckets).read()
