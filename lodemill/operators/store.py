"""Tables of documents, chunks, vectors, queries and responses: filters, listings, pages, and changes as new versions.

A table is a DataFrame; a change gives the changed table, which ``sources.tables`` writes back. Changes match by key with
joins, not with lists on the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def matching(table: DataFrame, *, contains: dict[str, str] | None = None, any_contains: tuple[tuple[str, ...], str | None] | None = None, between: dict[str, tuple] | None = None, order: str | None = None, **equal) -> DataFrame:
    """Rows that satisfy every given condition; those that are null or blank are not asked. ``order`` is a column, newest first.

    ``contains`` is by LIKE with the text as it is; ``any_contains`` asks several columns for one text; ``between`` has
    inclusive bounds, each of which may be null.
    """
    like = lambda c, v: F.col(c).like(f"%{v}%")
    asked = [F.col(c) == v for c, v in equal.items() if v is not None and v != ""]
    asked += [like(c, v) for c, v in (contains or {}).items() if v]
    if any_contains and any_contains[1]:
        asked.append(reduce(Column.__or__, (like(c, any_contains[1]) for c in any_contains[0])))
    for c, (low, high) in (between or {}).items():
        asked += [F.col(c) >= low] if low is not None else []
        asked += [F.col(c) <= high] if high is not None else []
    out = table.where(reduce(Column.__and__, asked)) if asked else table
    return newest_first(out, order) if order else out


def newest_first(table: DataFrame, by: str, limit: int | None = None, key: str = "id") -> DataFrame:
    out = table.orderBy(F.desc(by), *([key] if key in table.columns else []))
    return out if limit is None else out.limit(limit)


def oldest_first(table: DataFrame, by: str, limit: int | None = None, key: str = "id") -> DataFrame:
    out = table.orderBy(by, *([key] if key in table.columns else []))
    return out if limit is None else out.limit(limit)


def among(table: DataFrame, key: str, values: DataFrame | list) -> DataFrame:
    """Rows whose key is among the values; a table of values is joined."""
    if isinstance(values, DataFrame):
        return table.join(values.select(F.col(values.columns[0]).alias(key)).distinct(), key, "left_semi")
    return table.where(F.col(key).isin(*values)) if values else table.limit(0)


def page(table: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """Page ``number``, counted from 0."""
    return table.orderBy(*order).offset(number * size).limit(size)


def page_counts(table: DataFrame, size: int) -> DataFrame:
    """``total`` rows and ``pages``."""
    return table.agg(F.count("*").alias("total")).withColumn("pages", F.ceil(F.col("total") / size))


def counts_by(table: DataFrame, *keys: str, between: dict[str, tuple] | None = None) -> DataFrame:
    """Rows of each value; a range holds only if both of its bounds are given."""
    both = {c: b for c, b in (between or {}).items() if None not in b}
    return matching(table, between=both).groupBy(*keys).agg(F.count("*").alias("n"))


def mean_latency(queries: DataFrame, status: str = "COMPLETED", between: dict[str, tuple] | None = None) -> DataFrame:
    return matching(queries, status=status, between=between).where("latency_ms is not null").agg(F.avg("latency_ms").alias("mean_latency"))


def work_queue(table: DataFrame, limit: int, by: str, indexed: str | None = "status") -> DataFrame:
    """The oldest rows that have no vector yet (and, for documents, are not indexed)."""
    pending = table.where("not vectorized")
    return oldest_first(pending.where(F.col(indexed) != "INDEXED") if indexed else pending, by, limit)


def numbered(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Adds ``_n``, 1, 2, 3 in the order of ``columns``: rows are sorted by ranges, and each range begins after the sizes of those before it."""
    from lodemill.sources.tables import written

    ordered = rows.repartitionByRange(*columns).sortWithinPartitions(*columns).withColumn("_m", F.monotonically_increasing_id())
    placed = written(ordered, "numbered").withColumn("_p", F.shiftright("_m", 33))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    offsets = placed.groupBy("_p").agg(F.count("*").alias("_c")).withColumn("_o", F.coalesce(F.sum("_c").over(before), F.lit(0)))
    return placed.join(F.broadcast(offsets), "_p").withColumn("_n", F.col("_o") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_m", "_p", "_c", "_o")


def inserted(table: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """The table with new rows, which get the keys after the largest, in the order of their contents."""
    top = table.agg(F.coalesce(F.max(key), F.lit(0)).alias("_top"))
    columns = [c for c in table.columns if c != key]
    return table.unionByName(numbered(rows.select(*columns), columns).crossJoin(F.broadcast(top)).withColumn(key, F.col("_top") + F.col("_n")).select(*table.columns))


def patched(table: DataFrame, patch: DataFrame, key: str = "id", blank_is_null: bool = False, overwrite: tuple[str, ...] = ()) -> DataFrame:
    """Values of ``patch`` that are not null (or not blank) replace the table's; those of ``overwrite`` always do."""
    fields = [c for c in patch.columns if c != key]
    p = patch.select(F.col(key), *[F.col(c).alias(f"_new_{c}") for c in fields], F.lit(True).alias("_hit"))
    joined = table.join(p, key, "left")

    def value(c: str) -> Column:
        new = F.col(f"_new_{c}")
        if c in overwrite:
            return F.when(F.col("_hit"), new).otherwise(F.col(c))
        return F.coalesce(F.nullif(new, F.lit("")) if blank_is_null and dict(patch.dtypes)[c] == "string" else new, F.col(c))

    return joined.select(*[value(c).alias(c) if c in fields else F.col(c) for c in table.columns])


def upserted(table: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """Rows with a known key replace what is not null there; the others are added."""
    fresh = rows.join(table.select(key), key, "left_anti")
    return patched(table, rows.join(table.select(key), key, "left_semi"), key).unionByName(fresh, allowMissingColumns=True)


def with_status(table: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """New statuses, and the error message that comes with each: none clears the old one."""
    return patched(table, changes.select(key, "status", "error_message"), key, overwrite=("error_message",))


def flagged(table: DataFrame, keys: DataFrame, column: str, value: Column, key: str = "id") -> DataFrame:
    """``column`` set for the rows whose key is in ``keys``."""
    hit = keys.select(F.col(key), F.lit(True).alias("_hit")).distinct()
    return table.join(hit, key, "left").withColumn(column, F.when(F.col("_hit"), value).otherwise(F.col(column))).drop("_hit")


def deleted(table: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    return table.join(keys.select(key).distinct(), key, "left_anti")


def not_yet(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key has not been dealt with: running an ingest again adds nothing."""
    return rows.join(done.select(key).distinct(), key, "left_anti")


def completed(chunks: DataFrame, key: str = "document_id") -> DataFrame:
    """Whether all chunks of a document have vectors."""
    return chunks.groupBy(key).agg(F.bool_and("vectorized").alias("done"))


def merged_by_key(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Both tables' rows by key; where both have one, the new row's values."""
    rest = [c for c in old.columns if c != key]
    n = new.select(F.col(key), F.struct(*rest).alias("_new"))
    o = old.select(F.col(key), F.struct(*rest).alias("_old"))
    return o.join(n, key, "full_outer").select(key, F.coalesce("_new", "_old").alias("_row")).select(key, "_row.*")


def first_seen(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def latest_of_bucket(rows: DataFrame, bucket: str, order: list[Column], keep: int = 10) -> DataFrame:
    """At most ``keep`` rows of each bucket, the last ones."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(bucket).orderBy(*order))).where(F.col("_n") <= keep).drop("_n")


def bounded_cache(rows: DataFrame, bucket: str, at: str, order: list[Column], keep: int = 10, buckets: int = 1000) -> DataFrame:
    """At most ``keep`` rows of each bucket, and at most ``buckets`` of these: those with the latest row, the larger name first."""
    ages = rows.groupBy(bucket).agg(F.max(at).alias("_at")).orderBy(F.desc("_at"), F.desc(bucket)).limit(buckets)
    return latest_of_bucket(rows.join(ages.select(bucket), bucket, "left_semi"), bucket, order, keep)


def evicted(rows: DataFrame, key: str, pattern: str) -> DataFrame:
    """Rows of a cache whose key does not fit a pattern, in which ``*`` stands for any signs and ``?`` for one. Null keys stay."""
    import re

    fits = "".join({"*": "(?s).*", "?": "(?s)."}.get(c, re.escape(c)) for c in pattern)
    return rows.where(~F.coalesce(F.regexp_like(F.col(key), F.lit(f"^{fits}$")), F.lit(False)))


def alive(rows: DataFrame, at: Column, now: Column, seconds: int) -> DataFrame:
    """Rows that have not outlived their time."""
    return rows.where(F.unix_micros(now.cast("timestamp")) - F.unix_micros(at.cast("timestamp")) <= seconds * 1_000_000)


def memoized(rows: DataFrame, text: str, compute: Column, out: str) -> DataFrame:
    """``compute`` (of ``text``) once for each distinct text, joined back."""
    once = rows.select(text).where(F.col(text).isNotNull()).distinct().withColumn(out, compute)
    return rows.join(once, text, "left")


def vector_rows(chunks: DataFrame, document_metadata: str = "document_metadata", model: str = "hash", index: str = "default") -> DataFrame:
    """Rows of the vector table from ``chunks(id, content, metadata, document_metadata, vector)``; a chunk's metadata go before its document's."""
    from lodemill.functions.text import merge_metadata, shorten
    from lodemill.functions.vectors import norm

    return chunks.select(
        F.concat(F.lit("chunk-"), F.col("id").cast("string")).alias("external_id"),
        F.lit("CHUNK").alias("vector_type"),
        F.size("vector").alias("dimensions"),
        F.col("vector").alias("embedding"),
        F.lit(index).alias("index_name"),
        merge_metadata(F.col(document_metadata), F.col("metadata")).alias("metadata"),
        F.lit(model).alias("embedding_model"),
        norm(F.col("vector")).alias("vector_norm"),
        F.lit("TEXT").alias("vector_category"),
        shorten(F.col("content"), 100).alias("content_summary"),
        F.lit("COSINE").alias("space_type"),
        F.lit(True).alias("is_primary"),
    )
