"""Similarity and distance of embedding vectors, as column expressions that stay in the JVM."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def _products(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))


def _even(a: Column, b: Column) -> tuple[Column, Column]:
    n = F.least(F.size(a), F.size(b))
    return F.slice(a, 1, n), F.slice(b, 1, n)


def norm(a: Column) -> Column:
    """Euclidean length."""
    return F.sqrt(_sum(_products(a, a)))


def dot(a: Column, b: Column) -> Column:
    """Inner product over the shorter length; 0 for a null vector."""
    return F.coalesce(_sum(_products(*_even(a, b))), F.lit(0.0))


def cosine(a: Column, b: Column, mismatch: str = "error") -> Column:
    """Cosine similarity in double precision, 0 where a vector has no length.

    Vectors of different sizes raise (``error``), have similarity 0 (``zero``), or are cut to the shorter
    (``truncate``); so do null vectors, which count as missing: they raise, or have similarity 0.
    """
    x, y = _even(a, b) if mismatch == "truncate" else (a, b)
    length = norm(x) * norm(y)
    value = F.when(length > 0, _sum(_products(x, y)) / length).otherwise(0.0)
    if mismatch == "truncate":
        return F.coalesce(value, F.lit(0.0))
    fits = F.coalesce(F.size(a) == F.size(b), F.lit(False)) & a.isNotNull() & b.isNotNull()
    wrong = F.lit(0.0) if mismatch == "zero" else F.raise_error(F.lit("vectors are null or differ in size")).cast("double")
    return F.when(fits, value).otherwise(wrong)


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - cosine(a, b)


def euclidean(a: Column, b: Column) -> Column:
    """Euclidean distance; raises if the sizes differ."""
    squares = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.when(F.size(a) == F.size(b), F.sqrt(_sum(squares))).otherwise(F.raise_error(F.lit("vectors differ in size")).cast("double"))


def similarity(a: Column, b: Column, metric: str | None) -> Column:
    """By name: DOT, else cosine, over the shorter length."""
    return dot(a, b) if (metric or "").upper() == "DOT" else cosine(a, b, "truncate")


def best_of(similarities: Column) -> Column:
    """The aggregate of a set's similarities: the largest, 0 at least."""
    return F.greatest(F.lit(0.0), F.max(similarities))


def to_text(a: Column) -> Column:
    """``[x,y,...]``; null for a null vector."""
    return F.concat(F.lit("["), F.array_join(F.transform(a, lambda x: x.cast("string")), ","), F.lit("]"))


def from_text(text: Column) -> Column:
    """The vector of a literal with or without brackets; an empty one for blank text."""
    inner = F.trim(F.regexp_replace(F.trim(text), r"^\[|\]$", ""))
    return F.when(inner == "", F.array().cast("array<float>")).otherwise(F.transform(F.split(inner, ",", -1), lambda x: F.trim(x).cast("float")))


def bucket_key(a: Column, dims: int = 5) -> Column:
    """The first values with two decimals, joined without a separator."""
    return F.array_join(F.transform(F.slice(a, 1, dims), lambda x: F.format_string("%.2f", x.cast("double"))), "")


#: Floats that a binary vector may have.
MAX_FLOATS = 100_000


def encode_floats(values) -> bytes | None:
    """Four bytes of length and the floats, little-endian."""
    return None if values is None else struct.pack(f"<i{len(values)}f", len(values), *values)


def decode_floats(data: bytes | None) -> list[float] | None:
    """The floats of ``encode_floats``; null if the length is off, too large, or the bytes look like JSON."""
    if not data or len(data) < 4 or data[:1] in (b"[", b"{", b'"'):
        return None
    (n,) = struct.unpack_from("<i", data)
    return list(struct.unpack_from(f"<{n}f", data, 4)) if 0 <= n <= MAX_FLOATS and len(data) == 4 + 4 * n else None


@F.pandas_udf(T.BinaryType())
def to_binary(values: pd.Series) -> pd.Series:
    return values.map(encode_floats)


@F.pandas_udf(T.ArrayType(T.FloatType()))
def from_binary(data: pd.Series) -> pd.Series:
    return data.map(lambda x: decode_floats(None if x is None else bytes(x)))
