"""Documents from files of a folder: each by the loader of its extension, what cannot be read in quarantine."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodemill.functions.text import extension_of_name, loader_of

LOADED = "path string, file_name string, extension string, loader string, size long, modified timestamp, content string, metadata map<string,string>, error string"


def _read(loader: str, name: str, data: bytes, plugins: dict) -> tuple[str, dict[str, str]]:
    from . import html, office

    if loader in plugins:
        return plugins[loader](data, name)
    if loader == "html":
        page = html.parse(data.decode("utf-8", "replace"))
        title = page["title"] or name
        return page["body"], {"title": title, **{k: page[k] for k in ("lang", "charset", "description", "keywords", "author") if page[k]}, "headings": "\n".join(page["headings"])}
    if loader in ("word", "excel", "powerpoint"):
        return {"word": office.read_word, "excel": office.read_excel, "powerpoint": office.read_powerpoint}[loader](data)
    if loader in ("pdf", "image"):
        raise office.Unsupported(f"no {loader} reader is plugged in")
    return data.decode("utf-8", "replace"), {"encoding": "UTF-8"}


def load(spark: SparkSession, path: str, plugins: dict | None = None) -> DataFrame:
    """The files under ``path`` as ``LOADED``; ``error`` says why one could not be read.

    ``plugins`` are readers by loader (``pdf``, ``image`` or any to replace): from bytes and name to text and metadata.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/", -1), -1)
    rows = files.select("path", name.alias("file_name"), extension_of_name(name).alias("extension"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content")
    rows = rows.withColumn("loader", loader_of(F.col("extension")))
    own = plugins or {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, metas, errors = [], [], []
            for loader, file, data in zip(b.column("loader").to_pylist(), b.column("file_name").to_pylist(), b.column("content").to_pylist(), strict=True):
                try:
                    text, meta = _read(loader, file, data, own)
                    texts.append(text)
                    metas.append(list(meta.items()))
                    errors.append(None)
                except Exception as error:
                    texts.append(None)
                    metas.append([])
                    errors.append(f"{type(error).__name__}: {error}")
            kept = [b.column(c) for c in ("path", "file_name", "extension", "loader", "size", "modified")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(texts, pa.string()), pa.array(metas, pa.map_(pa.string(), pa.string())), pa.array(errors, pa.string())], ["path", "file_name", "extension", "loader", "size", "modified", "content", "metadata", "error"])

    return rows.select("path", "file_name", "extension", "loader", "size", "modified", "content").mapInArrow(run, LOADED)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files, with what the file system knows of them."""
    rows = spark.read.option("wholetext", "true").text(path)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_modification_time").alias("modified"), F.col("value").alias("content"))


def as_documents(loaded: DataFrame, batch: str, metadata: Column | None = None) -> DataFrame:
    """New documents of one batch, pending; the caller's metadata give way to the loader's."""
    from lodemill.functions.text import merge_metadata

    meta = F.col("metadata") if metadata is None else merge_metadata(metadata, F.col("metadata"))
    status = F.when(F.col("error").isNull(), "PENDING").otherwise("FAILED")
    return loaded.select(F.xxhash64("path").alias("id"), F.col("file_name").alias("title"), "content", F.col("path").alias("source"), F.col("extension").alias("document_type"), status.alias("status"), F.lit(batch).alias("batch_id"), meta.alias("metadata"), F.lit(False).alias("vectorized"), F.col("error").alias("error_message"))
