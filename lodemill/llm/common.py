"""Shared helpers: hashing in numpy, Arrow batches cut by bytes, numbers for rows; ``materialize`` writes a table to the cluster's shared folder."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodemill.sources.tables import written as materialize

#: Odd multipliers of the two polynomial hashes modulo 2**64, and their inverses.
BASE_A = np.uint64(0x9E3779B97F4A7C15)
BASE_B = np.uint64(0xC2B2AE3D27D4EB4F)


def partitions_for(n_bytes: int, spark: SparkSession, per_partition: int = 24 << 20) -> int:
    """Shuffle partitions for ``n_bytes``: as many as keep each within ``per_partition``, at least the session's count."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // per_partition), 1)


def slices(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that ``column``'s bytes in a piece stay within ``limit``; a row that is longer stands alone."""
    arr = batch.column(batch.schema.get_field_index(column))
    off = string_offsets(arr)
    start, n = 0, len(arr)
    while start < n:
        end = int(np.searchsorted(off, off[start] + limit, side="right")) - 1
        end = min(max(end, start + 1), n)
        yield batch.slice(start, end - start)
        start = end


def string_offsets(arr: pa.Array) -> np.ndarray:
    """Offsets (one more than rows) into the value buffer of a string or binary array, as int64."""
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    kind = np.int64 if wide else np.int32
    if len(arr) == 0:
        return np.zeros(1, np.int64)
    return np.frombuffer(arr.buffers()[1], dtype=kind)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)


def string_bytes(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string array as uint8, and the offsets of its rows; a null row is empty."""
    if arr.null_count:
        arr = arr.fill_null(b"" if pa.types.is_binary(arr.type) or pa.types.is_large_binary(arr.type) else "")
    off = string_offsets(arr)
    buf = arr.buffers()[2] if len(arr) else None
    data = np.frombuffer(buf, dtype=np.uint8)[off[0] : off[-1]] if buf is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over a 64-bit word."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(33))
        x = x * np.uint64(0xFF51AFD7ED558CCD)
        x = x ^ (x >> np.uint64(33))
        x = x * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    with np.errstate(over="ignore"):
        out = np.full(n, base, np.uint64)
        if n:
            out[0] = 1
        return np.multiply.accumulate(out)


def inverse(base: np.uint64) -> np.uint64:
    """The multiplicative inverse of an odd base modulo 2**64."""
    return np.uint64(pow(int(base), -1, 1 << 64))


def prefix_hash(data: np.ndarray, base: np.uint64) -> np.ndarray:
    """Polynomial prefix hashes H[i] = sum of (byte+1) * base**j over j < i, modulo 2**64."""
    with np.errstate(over="ignore"):
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(base, len(data)), out=out[1:])
        return out


def spare(columns: list[str], name: str) -> str:
    """``name``, with as many underscores behind it as set it apart from ``columns``."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def identified(docs: DataFrame, key: str, text: str, out: str = "__id") -> DataFrame:
    """Add ``out``, a long that is unique for each pair of key and text and ascends with the key; ``out`` is to be a free name.

    Where keys are whole numbers, unique and not null, it is the key. Else distinct pairs are numbered in the order of
    sorted ranges: by key (strings by their bytes), then by a hash of the text; null keys come first, and rows that
    repeat both share a number.
    """
    whole = isinstance(docs.schema[key].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    if whole:
        count, distinct = docs.agg(F.count("*"), F.count_distinct(F.col(f"`{key}`"))).first()
        if count == distinct:
            return docs.withColumn(out, F.col(f"`{key}`").cast("long"))
    name, mark, own = (spare([*docs.columns, out], x) for x in ("__key", "__print", "__own"))
    order = [F.col(name).asc_nulls_first(), F.col(mark)]
    marked = docs.withColumn(own, F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))))
    pairs = marked.select(F.col(f"`{key}`").alias(name), F.col(own).alias(mark)).distinct()
    numbers = materialize(pairs.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(out, F.monotonically_increasing_id()), "numbers")
    return marked.join(numbers, marked[f"`{key}`"].eqNullSafe(numbers[name]) & (marked[own] == numbers[mark])).drop(own, name, mark)
