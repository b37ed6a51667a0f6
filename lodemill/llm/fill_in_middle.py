"""Fill-in-the-middle transformation in SQL: DuckDB runs inside Arrow map tasks.

Each task registers slices of its batches in a DuckDB of its own, in memory and on one thread, and reads the answer back as
Arrow. A text is cut into units, two points among them are drawn from a hash of the row's key, and the middle moves to the
end, behind marks. There is no Python per row and no shuffle; a lost task is run again and draws the same points.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, spare

#: The marks before prefix, suffix and middle; a unit of text; shares of plain rows and of those with the suffix first, in percent.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
UNIT = "[A-Za-z]+|[^A-Za-z]"
PLAIN_PERCENT, SUFFIX_FIRST_PERCENT = 10, 20
#: Bytes of text that DuckDB gets at a time; a longer text stands alone.
SLICE = 4 << 20

_TRANSFORM = f"""
with drawn as (
  select coalesce(body, '') as body, regexp_extract_all(coalesce(body, ''), '{UNIT}') as units, sha256(draw) as digest from batch),
numbers as (
  select body, units, len(units) as n, [cast('0x' || substr(digest, 1, 8) as ubigint), cast('0x' || substr(digest, 9, 8) as ubigint), cast('0x' || substr(digest, 17, 8) as ubigint), cast('0x' || substr(digest, 25, 8) as ubigint)] as h from drawn),
placed as (
  select body, units, n, least(h[1] % (n + 1), h[2] % (n + 1))::bigint as first, greatest(h[1] % (n + 1), h[2] % (n + 1))::bigint as last,
    case when body = '' or contains(body, '{PREFIX}') or contains(body, '{SUFFIX}') or contains(body, '{MIDDLE}') or h[3] % 100 >= $plain_from then 'plain'
         when h[4] % 100 < $spm_below then 'spm' else 'psm' end as form
  from numbers),
parts as (
  select body, n, form, array_to_string(list_slice(units, 1, first), '') as prefix, array_to_string(list_slice(units, first + 1, last), '') as middle,
    array_to_string(list_slice(units, last + 1, n), '') as suffix
  from placed)
select n::bigint as n, form, case when form <> 'plain' then length(prefix) end::bigint as prefix_chars, case when form <> 'plain' then length(middle) end::bigint as middle_chars,
  case form when 'plain' then body when 'psm' then '{PREFIX}' || prefix || '{SUFFIX}' || suffix || '{MIDDLE}' || middle
            else '{SUFFIX}' || suffix || '{PREFIX}' || prefix || '{MIDDLE}' || middle end as moved
from parts"""

_RESTORE = f"""
with parts as (
  select body, draw as form, split_part(split_part(body, '{PREFIX}', 2), case draw when 'psm' then '{SUFFIX}' else '{MIDDLE}' end, 1) as prefix,
    split_part(split_part(body, '{SUFFIX}', 2), case draw when 'psm' then '{MIDDLE}' else '{PREFIX}' end, 1) as suffix, split_part(body, '{MIDDLE}', 2) as middle
  from batch)
select case when form = 'plain' then body else prefix || middle || suffix end as restored from parts"""


def _mapped(docs: DataFrame, body: str, second: F.Column, sql: str, fields: list[T.StructField], parameters: dict[str, int] | None = None) -> DataFrame:
    """``docs`` with the columns that ``sql`` makes of ``batch(body, draw)``, row by row; columns of these names are replaced."""
    made = {f.name.lower() for f in fields}
    kept = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in made])
    names, draw = [*kept.columns, *[f.name for f in fields]], spare(docs.columns, "__draw")
    n = len(kept.columns)
    inside = [c.lower() for c in kept.columns].index(body.lower()) if body.lower() not in made else n  # the text is sent to the task once
    sent = docs.select(*[F.col(f"`{c}`") for c in kept.columns], *([F.col(f"`{body}`").alias(spare(docs.columns, "__body"))] if inside == n else []), second.alias(draw))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        with duckdb.connect(":memory:", config={"threads": 1, "temp_directory": ""}) as db:
            for whole in rows:
                for piece in slices(whole, whole.schema.names[inside], SLICE):
                    db.register("batch", pa.table([piece.column(inside), piece.column(piece.num_columns - 1)], names=["body", "draw"]))
                    answer = db.sql(sql, params=parameters or {}).to_arrow_table().combine_chunks()
                    db.unregister("batch")
                    yield pa.RecordBatch.from_arrays([*piece.columns[:n], *[c.chunk(0) for c in answer.columns]], names)

    return sent.mapInArrow(run, T.StructType([*kept.schema.fields, *fields]))


def transform(docs: DataFrame, key: str = "doc_id", text: str = "text", out: str = "moved", seed: int = 1, plain_percent: int = PLAIN_PERCENT, suffix_first_percent: int = SUFFIX_FIRST_PERCENT) -> DataFrame:
    """Add ``n`` (units of the text), ``form``, ``prefix_chars``, ``middle_chars`` (code points) and the transformed text ``out`` to every row.

    The points are drawn from the sha256 of seed, colon and key: rows that share both text and key get the same answer, a null
    key draws as an empty one. A form is plain (the text as it is; no lengths) for null, empty and marked texts and for
    ``plain_percent`` of the others; of the rest ``suffix_first_percent`` have the suffix first (spm), the others the prefix
    (psm). A null text counts as empty. Texts of any length are taken whole; a task's DuckDB holds 4 MB of texts or one longer
    text at a time. Input columns of these names are replaced.
    """
    draw = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")))
    fields = [T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()), T.StructField(out, T.StringType())]
    return _mapped(docs, text, draw, _TRANSFORM, fields, {"plain_from": 100 - plain_percent, "spm_below": suffix_first_percent})


def restore(moved: DataFrame, text: str = "moved", form: str = "form", out: str = "restored") -> DataFrame:
    """Add ``out``, the text that ``transform`` was given, from its output and form alone; a null text was empty. A column of that name is replaced.

    The pieces hold no mark, and no mark can begin within a piece and end in the mark after it, so the first of each is the one that was put there.
    """
    return _mapped(moved, text, F.col(f"`{form}`"), _RESTORE, [T.StructField(out, T.StringType())])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents`` transformed, and restored from what came out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    both = restore(transform(docs).drop("text"))
    return both.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("moved", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


ORACLE = f"""
with units as (select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '{UNIT}') as u, sha256('1:' || doc_id) as d from documents),
h as (select doc_id, t, u, len(u) as n, ('0x' || d[1:8])::ubigint as h1, ('0x' || d[9:16])::ubigint as h2, ('0x' || d[17:24])::ubigint as h3, ('0x' || d[25:32])::ubigint as h4 from units),
cuts as (select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b, h3 % 100 >= 90 or t = '' or regexp_matches(t, '{PREFIX}|{SUFFIX}|{MIDDLE}') as plain, h4 % 100 < 20 as back from h),
parts as (select *, array_to_string(u[1:a], '') as p, array_to_string(u[a + 1:b], '') as m, array_to_string(u[b + 1:], '') as s from cuts)
select doc_id, n::bigint as n, case when plain then 'plain' when back then 'spm' else 'psm' end as form, if(plain, null, length(p))::bigint as prefix_chars, if(plain, null, length(m))::bigint as middle_chars,
  sha256(case when plain then t when back then concat('{SUFFIX}', s, '{PREFIX}', p, '{MIDDLE}', m) else concat('{PREFIX}', p, '{SUFFIX}', s, '{MIDDLE}', m) end) as output_sha256, sha256(t) as restored_sha256
from parts"""
