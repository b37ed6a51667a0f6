"""WARC revisits: a not-modified answer is resolved to the latest earlier full response of the same canonical URL.

The as-of join is a window over narrow rows, dealt by URL and by slice of time, so that one URL with a third of all
captures is spread over the slices; the last full response of each slice is then carried forward over the few slices of
a URL. Validators are compared there too. Only then bodies come in: a Bloom filter of the responses that resolved answers
stand for keeps the others from being shuffled, and what passes is joined once, by the record.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize
from .url_filter import MAX_BITS, build_level

#: Headers that a 304 answer may replace in the stored response (RFC 9110, 15.4.5, and Last-Modified).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Query parameters that do not tell pages apart.
TRACKING = r"^(utm_[^=]*|gclid|fbclid|ref|sessionid)(=|$)"
#: Slices of time over which a URL's captures are dealt.
SLICES = 64

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RECORDS = "record_id string, url string, warc_date timestamp, record_type string, status int, headers map<string,string>, body binary"


def canonical_url(url: Column) -> Column:
    """Host and path with sorted query: no scheme, ``www``, default port, fragment, tracking parameters or final slash; the host in lower case. Null stays null."""
    rest = F.regexp_replace(F.regexp_replace(F.trim(url), r"(?s)#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.translate(F.regexp_extract(rest, r"^([^/?]*)", 1), UPPER, LOWER)
    host = F.regexp_replace(F.regexp_replace(host, r":(80|443)$", ""), r"^www\d*\.", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"(?s)^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.regexp_extract(rest, r"(?s)^[^?]*\?(.*)$", 1)
    parts = F.array_sort(F.filter(F.split(query, "&", -1), lambda p: (p != "") & ~p.rlike(TRACKING)))
    return F.concat(host, path, F.when(F.size(parts) > 0, F.concat(F.lit("?"), F.array_join(parts, "&"))).otherwise(""))


def _validator(headers: Column, name: str) -> Column:
    """A validator without the mark of a weak one; null if there is none."""
    return F.nullif(F.regexp_replace(F.trim(F.try_element_at(headers, F.lit(name))), "^W/", ""), F.lit(""))


def resolve_revisits(records: DataFrame, slices: int = SLICES) -> DataFrame:
    """A row for each distinct revisit of ``records``, with the response that it stands for.

    ``records`` has the columns of ``RECORDS``; header names are in lower case. A full response has type ``response``
    and status 200; a revisit has type ``revisit``. Earlier is a smaller date, or the same with a smaller record id.
    ``outcome`` is ``resolved``, ``mismatch`` (a validator that both carry differs), ``unverified`` (no validator is in
    both) or ``unmatched`` (no earlier response, or no URL or date). Entity tags are compared weakly. Only a resolved
    revisit has ``merged_headers`` (the stored ones, the permitted ones replaced by the revisit's) and ``body``.
    Null headers are none. Repeated rows count once; of full responses that share id, URL and date but differ, the one
    with the smaller hash of headers and body is taken. Columns beside these are ignored. Empty tables give empty results.
    """
    url = canonical_url(F.col("url")).alias("canonical_url")
    entries = F.array_sort(F.map_entries(F.coalesce("headers", F.create_map().cast("map<string,string>"))))
    mark = F.xxhash64(entries, "body")
    full = (F.col("record_type") == "response") & (F.col("status") == 200)
    columns = ["record_id", "canonical_url", "warc_date"]
    answers = records.where("record_type = 'revisit'").select("record_id", url, "warc_date", entries.alias("entries")).distinct()
    responses = records.where(full).select("record_id", url, "warc_date", F.struct(mark.alias("mark"), entries.alias("entries")).alias("first"))
    responses = responses.groupBy(*columns).agg(F.min("first").alias("first"), F.count("*").alias("copies")).select(*columns, "first.*", "copies")
    narrow = responses.withColumn("full", F.lit(True)).unionByName(answers.withColumn("full", F.lit(False)), allowMissingColumns=True)
    narrow = materialize(narrow, "captures")
    able = narrow.where("canonical_url is not null and warc_date is not null and record_id is not null").drop("mark", "copies")
    bounds = able.agg(F.percentile_approx(F.unix_micros("warc_date"), [k / slices for k in range(1, slices)], 1000)).first()[0] or []
    edges = F.array(*[F.lit(b) for b in sorted(set(bounds))]).cast("array<bigint>")
    able = able.withColumn("slice", F.size(F.filter(edges, lambda b: b <= F.unix_micros("warc_date")))).withColumn("entries", F.when(~F.col("full"), F.col("entries")))
    place = F.struct(F.col("warc_date").alias("date"), F.col("record_id").alias("id"))
    source = F.when(F.col("full"), place)
    inside = Window.partitionBy("canonical_url", "slice").orderBy("warc_date", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    found = able.withColumn("near", F.last(source, ignorenulls=True).over(inside)).where("not full")
    ends = able.where("full").groupBy("canonical_url", "slice").agg(F.max(place).alias("end"))
    ends = ends.unionByName(found.select("canonical_url", "slice").distinct().withColumn("end", F.lit(None).cast(ends.schema["end"].dataType))).groupBy("canonical_url", "slice").agg(F.max("end").alias("end"))
    before = Window.partitionBy("canonical_url").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("canonical_url", "slice", F.last("end", ignorenulls=True).over(before).alias("far"))
    found = found.join(carried, ["canonical_url", "slice"], "left").select(*columns, "entries", F.coalesce("near", "far").alias("source"))
    lost = narrow.where("not full and (canonical_url is null or warc_date is null or record_id is null)").select(*columns, "entries", F.lit(None).cast(found.schema["source"].dataType).alias("source"))
    found = found.unionByName(lost).select(*columns, "entries", F.col("source.id").alias("source_id"), F.col("source.date").alias("source_date"))
    known = narrow.where("full").select(F.col("record_id").alias("_id"), F.col("canonical_url").alias("_url"), F.col("warc_date").alias("_date"), F.col("entries").alias("stored"), "mark", "copies")
    on = (F.col("source_id") == F.col("_id")) & (F.col("canonical_url") == F.col("_url")) & (F.col("source_date") == F.col("_date"))
    told = found.join(known, on, "left").select(*columns, "source_id", "source_date", F.map_from_entries("entries").alias("own"), F.map_from_entries("stored").alias("stored"), "mark", "copies")
    told = materialize(told.withColumn("outcome", _outcome(F.col("own"), F.col("stored"), F.col("source_id"))), "found")
    return _with_bodies(told, records.where(full), url, mark)


def _outcome(own: Column, stored: Column, source: Column) -> Column:
    same = [_validator(own, v) == _validator(stored, v) for v in ("etag", "last-modified")]
    agree = F.coalesce(same[0], F.lit(True)) & F.coalesce(same[1], F.lit(True))
    return F.when(source.isNull(), "unmatched").when(~agree, "mismatch").when(F.coalesce(*same).isNull(), "unverified").otherwise("resolved")


def _with_bodies(told: DataFrame, full: DataFrame, url: Column, mark: Column) -> DataFrame:
    """``told`` with merged headers, and the bodies of responses that a resolved answer stands for: only these are shuffled, each once.

    A Bloom filter holds ids and dates of the responses that are asked for, so that the others are neither hashed nor given a
    canonical URL; what passes meets the narrow rows in a hash join that
    is built on these, so that bodies are neither sorted nor grouped.
    """
    out = ["record_id", "canonical_url", "warc_date", "source_id", "source_date", "outcome"]
    fresh = F.map_filter("own", lambda k, v: k.isin(*PERMITTED))
    merged = F.map_concat(F.map_filter("stored", lambda k, v: ~F.map_contains_key(fresh, k)), fresh)
    resolved = told.where("outcome = 'resolved'").withColumn("merged_headers", merged)
    without = told.where("outcome != 'resolved'").select(*out, F.lit(None).cast("map<string,string>").alias("merged_headers"), F.lit(None).cast("binary").alias("body"))
    chosen = resolved.select(F.xxhash64("source_id", "source_date").alias("key")).distinct()
    n, most = chosen.count(), resolved.agg(F.max("copies")).first()[0]
    if not n:
        return without
    wanted = full.where(build_level(chosen, n, 900, 12, 4, MAX_BITS, clip=True).has(F.xxhash64("record_id", "warc_date")))
    wanted = wanted.select(F.col("record_id").alias("_id"), url.alias("_url"), F.col("warc_date").alias("_date"), mark.alias("_mark"), "body")
    on = (F.col("source_id") == F.col("_id")) & (F.col("canonical_url") == F.col("_url")) & (F.col("source_date") == F.col("_date")) & (F.col("mark") == F.col("_mark"))
    joined = wanted.join(resolved.hint("shuffle_hash"), on)
    once = joined.where("copies = 1").select(*out, "merged_headers", "body")
    if most > 1:  # responses that stand there several times
        several = joined.where("copies > 1").groupBy(*out).agg(F.first("merged_headers").alias("merged_headers"), F.first("body").alias("body"))
        once = once.unionByName(several)
    return once.unionByName(without)


#: Bytes that are unpacked at a time.
PIECE = 1 << 20


def _unpacked(content: bytes) -> Iterator[bytes | str]:
    """The bytes of a WARC file in pieces, whether or not it is compressed; an error is told as a string and ends it."""
    import zlib

    if content[:2] != b"\x1f\x8b":
        yield from (content[a : a + PIECE] for a in range(0, len(content), PIECE))
        return
    at = 0
    while at < len(content):
        member = zlib.decompressobj(31)
        try:
            while not member.eof and at < len(content):
                fed = content[at : at + PIECE]
                out = member.decompress(fed, PIECE)
                at += len(fed) - len(member.unconsumed_tail) - len(member.unused_data)
                if out:
                    yield out
            while not member.eof and (out := member.decompress(member.unconsumed_tail, PIECE)):
                yield out
        except zlib.error as error:
            yield f"broken compression: {error}"
            return
        if not member.eof:
            yield "truncated compression"


def _parse(content: bytes) -> Iterator[tuple[dict[str, str], bytes, str | None]]:
    """Header fields (names in lower case), block and error of each record; a file is unpacked as far as a record goes.

    A record whose length is no number has no block, and reading goes on at the next record; one that the file ends in has
    what there is of it. Both say so in their error.
    """
    held, pieces, error = bytearray(), _unpacked(content), None

    def more() -> bool:
        nonlocal error
        piece = next(pieces, None)
        if isinstance(piece, str):
            error = piece
        elif piece is not None:
            held.extend(piece)
            return True
        return False

    while True:
        while (at := held.find(b"WARC/")) < 0 and more():
            del held[: max(0, len(held) - PIECE - 5)]
        if at < 0:
            break
        del held[:at]
        while (end := held.find(b"\r\n\r\n")) < 0 and more():
            pass
        if end < 0:
            yield {}, b"", error or "truncated header"
            return
        lines = bytes(held[:end]).decode("utf-8", "replace").split("\r\n")[1:]
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        del held[: end + 4]
        length = fields.get("content-length") or "0"
        if not (length.isascii() and length.isdigit()):
            yield fields, b"", f"content length {length[:40]!r}"
            continue
        size = int(length)
        while len(held) < size and more():
            pass
        yield fields, bytes(held[:size]), None if len(held) >= size else error or "truncated block"
        del held[:size]
    if error:
        yield {}, b"", error


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of WARC files as ``RECORDS`` and ``error``; blocks that hold no HTTP answer have a null status.

    A file is read by one task, which unpacks it piece by piece, so that only the file as it is stored (2 GB at most) and a
    record are in memory. Records with a bad length, broken or truncated ones are rows with an ``error``, and with type
    ``broken``, so that nothing is resolved to them; an empty file has no rows.
    """

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("record_id", pa.string()), ("url", pa.string()), ("date", pa.string()), ("record_type", pa.string()), ("status", pa.int32()), ("headers", pa.map_(pa.string(), pa.string())), ("body", pa.binary()), ("error", pa.string())])
        for batch in rows:
            for content in batch.column(0).to_pylist():
                held, size = [], 0
                for fields, block, error in _parse(content):
                    head, _, body = block.partition(b"\r\n\r\n") if block[:5] == b"HTTP/" else (b"", b"", block)
                    first, *lines = head.decode("utf-8", "replace").split("\r\n")
                    own = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines) if k}
                    status = first.split(" ")[1] if first.count(" ") else ""
                    kind = "broken" if error else fields.get("warc-type")
                    held.append((fields.get("warc-record-id"), fields.get("warc-target-uri"), fields.get("warc-date"), kind, int(status) if status.isascii() and status.isdigit() and len(status) < 9 else None, list(own.items()), body, error))
                    size += len(body)
                    if len(held) >= 256 or size > 8 * PIECE:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)

    files = spark.read.format("binaryFile").load(path).select("content").where("length(content) > 0")
    got = files.mapInArrow(run, RECORDS.replace("warc_date timestamp", "date string") + ", error string")
    return got.select("record_id", "url", F.try_to_timestamp("date").alias("warc_date"), "record_type", "status", "headers", "body", "error")


def captures_of_pages(pages: DataFrame) -> DataFrame:
    """Capture records of ``pages``: each page as full responses of its URL on three of sixty days, and not-modified answers on three others.

    The days of responses and answers of a URL lie among each other, so that some answers come before the first response
    and others between two. Each response has an entity tag of its own day for ids that end in 9, else of its content. Of
    the answers, those of ids that end in 3 have a weak entity tag, in 7 one of other content, in 5 no validator.
    """
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    last, text, number = F.col("page_id") % 10, F.coalesce("html", F.lit("")), F.col("page_id").cast("string")
    days = lambda step, first: F.explode(F.array(*[F.struct(F.lit(k).alias("k"), ((F.col("page_id") * step + first + 20 * k) % 60).alias("day")) for k in range(3)]))
    tag = lambda more: F.concat(F.lit('"'), F.md5(F.concat(text, more).cast("binary")), F.lit('"'))
    full = pages.select("page_id", "url", "html", days(7, 3).alias("at")).select("*", "at.k", "at.day")
    stored = F.map_from_arrays(
        F.array(*map(F.lit, ("content-type", "content-length", "etag", "last-modified", "cache-control", "date"))),
        F.array(F.lit("text/html"), F.octet_length(text).cast("string"), tag(F.when(last == 9, F.col("day").cast("string")).otherwise("")), F.lit("Mon, 01 Jan 2024 00:00:00 GMT"), F.lit("max-age=60"), F.concat(F.lit("response "), F.col("day").cast("string"))),
    )
    shared = ["url", "day", "page_id"]
    full = full.select(F.concat(F.lit("r"), number, F.lit("."), F.col("k").cast("string")).alias("record_id"), *shared, F.lit("response").alias("record_type"), F.lit(200).alias("status"), stored.alias("headers"), F.concat(text, F.lit(" on day "), F.col("day").cast("string")).cast("binary").alias("body"))
    again = pages.select("page_id", "url", "html", days(11, 8).alias("at")).select("*", "at.k", "at.day")
    plain = F.map_from_arrays(F.array(*map(F.lit, ("cache-control", "content-length", "date", "x-cache"))), F.array(F.lit("max-age=120"), F.lit("0"), F.concat(F.lit("answer "), F.col("day").cast("string")), F.lit("HIT")))
    own = F.when(last == 3, F.concat(F.lit("W/"), tag(F.lit("")))).when(last == 7, tag(F.lit("new"))).when(last == 9, tag(F.lit("23"))).otherwise(tag(F.lit("")))
    answer = F.when(last == 5, plain).otherwise(F.map_concat(plain, F.create_map(F.lit("etag"), own)))
    again = again.select(F.concat(F.lit("v"), number, F.lit("."), F.col("k").cast("string")).alias("record_id"), *shared, F.lit("revisit").alias("record_type"), F.lit(304).alias("status"), answer.alias("headers"), F.lit(None).cast("binary").alias("body"))
    date = F.timestamp_micros(F.unix_micros(start) + (F.col("day") * 86_400_000 + F.col("page_id") % 86_400_000) * 1000)
    return full.unionByName(again).select("record_id", "url", date.alias("warc_date"), "record_type", "status", "headers", "body")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's not-modified answers, resolved against the pages' full responses."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    out = resolve_revisits(captures_of_pages(pages))
    lines = F.array_join(F.transform(F.array_sort(F.map_entries("merged_headers")), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")
    return out.select("record_id", "canonical_url", "source_id", "outcome", lines.alias("headers"), F.octet_length("body").cast("long").alias("n_bytes"), F.sha2("body", 256).alias("body_sha256"))


#: The same by an as-of join of answers and responses.
ORACLE = rf"""
with u as (
  select page_id, coalesce(html, '') as html, regexp_replace(regexp_replace(trim(url, ' '), '(?s)#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') as rest from pages),
c as (
  select page_id, html,
    regexp_replace(regexp_replace(translate(regexp_extract(rest, '^([^/?]*)', 1), '{UPPER}', '{LOWER}'), ':(80|443)$', ''), '^www[0-9]*[.]', '')
    || regexp_replace(regexp_extract(rest, '(?s)^[^/?]*([^?]*)', 1), '/+$', '') as base,
    list_sort(list_filter(string_split(regexp_extract(rest, '(?s)^[^?]*[?](.*)$', 1), '&'), lambda p: p != '' and not regexp_matches(p, '{TRACKING}'))) as parts
  from u),
p as (select page_id, html, base || case when len(parts) > 0 then '?' || array_to_string(parts, '&') else '' end as canonical_url from c),
d as (select *, unnest([0, 1, 2]) as k from p),
r as (
  select 'r' || page_id || '.' || k as source_id, canonical_url, (page_id * 7 + 3 + 20 * k) % 60 as day, page_id, html,
    '"' || md5(html || case when page_id % 10 = 9 then ((page_id * 7 + 3 + 20 * k) % 60)::varchar else '' end) || '"' as tag from d),
v as (
  select 'v' || page_id || '.' || k as record_id, canonical_url, (page_id * 11 + 8 + 20 * k) % 60 as day, page_id,
    case page_id % 10 when 3 then 'W/"' || md5(html) || '"' when 5 then null when 7 then '"' || md5(html || 'new') || '"' when 9 then '"' || md5(html || '23') || '"' else '"' || md5(html) || '"' end as own from d),
a as (
  select v.record_id, arg_max(r.source_id, {{'at': r.day * 86400000 + r.page_id % 86400000, 'id': r.source_id}}) as source_id
  from v join r on r.canonical_url = v.canonical_url and (r.day * 86400000 + r.page_id % 86400000, r.source_id) < (v.day * 86400000 + v.page_id % 86400000, v.record_id) group by v.record_id),
o as (
  select v.*, a.source_id, r.tag, r.html as stored, r.day as source_day, case when a.source_id is null then 'unmatched' when own is null then 'unverified'
    when regexp_replace(own, '^W/', '') != r.tag then 'mismatch' else 'resolved' end as outcome
  from v left join a using (record_id) left join r on r.source_id = a.source_id)
select record_id, canonical_url, source_id, outcome,
  case when outcome = 'resolved' then 'cache-control: max-age=120' || chr(10) || 'content-length: ' || strlen(stored) || chr(10) || 'content-type: text/html' || chr(10)
    || 'date: answer ' || day || chr(10) || 'etag: ' || own || chr(10) || 'last-modified: Mon, 01 Jan 2024 00:00:00 GMT' end as headers,
  case when outcome = 'resolved' then strlen(stored || ' on day ' || source_day)::bigint end as n_bytes,
  case when outcome = 'resolved' then sha256(stored || ' on day ' || source_day) end as body_sha256
from o"""
