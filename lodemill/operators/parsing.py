"""How a document is parsed: table signs, modes, timeouts, retries of pages, the page cache, tables across pages."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodemill.functions.evaluation import TABLE_RULE, let
from lodemill.functions.text import is_high_quality

#: Words that head a table.
HEADER_WORDS = ("序号", "编号", "名称", "数量", "金额", "日期", "时间", "姓名", "部门", "合计", "总计", "小计", r"No\.", "ID", "Name", "Date", "Amount", "Total", "Qty")

#: Signs of text that a task looks at together.
SIGNS = 1 << 20


def aligned_rows(pages: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys`` and ``aligned``: in how many lines of a page a space stands in the same five columns, the largest such number from 3 on.

    Lines under ten characters do not count, nor pages under three lines; a space counts beside a character that is none.
    """
    others = pages.select(*keys, F.regexp_replace(F.col(text), r"\n+$", "").alias("_text")).where("_text is not null")
    schema = T.StructType([*(others.schema[k] for k in keys), T.StructField("place", T.LongType()), T.StructField("n", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, texts, held = 0, [], 0
            for k, x in enumerate(batch.column(batch.num_columns - 1)):
                texts.append(x.as_py())
                held += len(texts[-1])
                if held > SIGNS or k == batch.num_rows - 1:
                    row, place, n = _aligned_places(texts)
                    yield pa.RecordBatch.from_arrays([*(c.take(pa.array(first + row)) for c in batch.columns[:-1]), pa.array(place), pa.array(n)], schema.fieldNames())
                    first, texts, held = k + 1, [], 0

    rows = others.mapInArrow(run, schema)
    return rows.groupBy(*keys, "place").agg(F.sum("n").alias("n")).where("n >= 3").groupBy(*keys).agg(F.max("n").cast("int").alias("aligned"))


def _aligned_places(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts, the places (five columns each) where a space stands beside another sign, and in how many lines: text, place, lines."""
    bare = [x + "\n" for x in texts]
    signs = np.frombuffer("".join(bare).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.flatnonzero(signs == 10)
    begins = np.concatenate([[0], ends[:-1] + 1]).astype(np.int64)
    owner = np.repeat(np.arange(len(bare)), [x.count("\n") for x in bare])
    enough = np.bincount(owner, minlength=len(bare))[owner] >= 3
    counts = enough & (ends - begins >= 10)
    space = signs == 32
    at = np.flatnonzero(space[1:-1] & ~(space[:-2] & space[2:])) + 1 if len(signs) > 2 else np.zeros(0, np.int64)
    line = np.searchsorted(ends, at)
    inside = counts[line] & (at > begins[line]) & (at < ends[line] - 1)
    at, line = at[inside], line[inside]
    place = (at - begins[line]) // 5
    most = int(place.max(initial=0)) + 1
    each = np.unique(line * most + place)  # a place counts once in a line
    found, n = np.unique(owner[each // most] * most + each % most, return_counts=True)
    return found // most, found % most, n.astype(np.int64)


def table_indicators(text: Column, aligned: Column) -> Column:
    """Counts of what tables leave in a text, their weighted sum, and whether the page has a table."""
    heads = F.regexp_count(text, F.lit("(?i)(" + "|".join(HEADER_WORDS) + ")"))
    counts = F.struct(F.regexp_count(text, F.lit(r"\t")).alias("tabs"), F.regexp_count(text, F.lit(" {3,}")).alias("spaces"), F.regexp_count(text, F.lit(r"\d+\.?\d*\s{2,}\d+\.?\d*")).alias("numbers"), heads.alias("heads"))
    from_ = lambda n, least, value: F.when(n > least, value).otherwise(0)

    def weighed(c: Column) -> Column:
        total = from_(c["tabs"], 2, c["tabs"]) + from_(c["spaces"], 5, F.floor(c["spaces"] / 2)) + from_(c["numbers"], 2, c["numbers"] * 2) + from_(c["heads"], 2, c["heads"] * 3) + from_(aligned, 3, aligned * 2)
        has = (total > 10) | ((c["heads"] >= 2) & ((c["spaces"] > 3) | (aligned > 2)))
        return F.struct(*[c[n].alias(n) for n in ("tabs", "spaces", "numbers", "heads")], total.cast("long").alias("indicators"), has.alias("has_table"))

    return let(counts, weighed)  # each pattern is looked for once


def document_table_score(pages: DataFrame, key: str) -> DataFrame:
    """``table_score`` and ``likely`` of each document, from its pages' ``indicators`` and ``has_table``."""
    score = 0.6 * F.least(F.lit(1.0), F.sum("indicators") / 50) + 0.4 * F.count_if("has_table") / F.count("*")
    return pages.groupBy(key).agg(score.alias("table_score"), F.bool_or("has_table").alias("any")).select(key, "table_score", (F.col("any") | (F.col("table_score") > 0.5)).alias("likely"))


def parsing_mode(mode: Column, extension: Column, text: Column, has_table: Column) -> Column:
    """SIMPLE or OCR, for a mode that may be AUTO: scans, tables and poor text of a PDF are read by OCR."""
    poor = F.coalesce(F.length(text) < 100, F.lit(True)) | F.coalesce(has_table, F.lit(False)) | ~is_high_quality(text)
    auto = F.when(F.lower(extension) != "pdf", "SIMPLE").when(poor, "OCR").otherwise("SIMPLE")
    return F.when(F.upper(mode).isin("SIMPLE", "OCR"), F.upper(mode)).otherwise(auto)


def legacy_parsing_mode(forced: Column, extension: Column, text: Column, has_table: Column) -> Column:
    """The older decision: OCR where it is forced, for tables of a PDF, and for text that is missing or poor."""
    return F.when(forced | ((F.lower(extension) == "pdf") & F.coalesce(has_table, F.lit(False))) | ~is_high_quality(F.coalesce(text, F.lit(""))), "OCR").otherwise("SIMPLE")


#: Rows of a stretch of a sequence that are looked at together.
STRETCH = 100_000


def recent_durations(rows: DataFrame, duration: str, order: list[str], keys: list[str] | None = None, size: int = 20, stretch: int = STRETCH) -> DataFrame:
    """Adds ``seen``, ``mean``, ``spread`` and ``largest`` of the last ``size`` durations, this one included, in the order of ``order`` (of each of ``keys``).

    Null durations are in their place but are not counted. Rows that tie in ``order`` follow each other by the rest of their
    values. Rows are numbered in ranges of that order, and a stretch of the sequence gets the ``size - 1`` rows before it
    handed on, so that one sequence, or one key with most of the rows, is spread over as many tasks as it has stretches.
    """
    from lodemill.operators.store import numbered

    rest = [f.name for f in rows.schema.fields if f.name not in [*(keys or []), *order] and not isinstance(f.dataType, (T.MapType, T.VariantType))]
    placed = numbered(rows, [*(keys or []), *order, *rest]).withColumn("_n", F.col("_n") - 1)
    own = F.floor(F.col("_n") / stretch)
    handed = F.sequence(own, F.floor((F.col("_n") + size - 1) / stretch))  # to every stretch with a row that looks back so far
    dealt = placed.withColumn("_own", own).withColumn("_stretch", F.explode(handed))
    last = Window.partitionBy("_stretch", *(keys or [])).orderBy("_n").rowsBetween(1 - size, 0)
    d = F.col(duration)
    told = dealt.select("*", F.count(d).over(last).alias("seen"), F.avg(d).over(last).alias("mean"), F.stddev_pop(d).over(last).alias("spread"), F.max(d).over(last).alias("largest"))
    return told.where(F.col("_stretch") == F.col("_own")).drop("_n", "_own", "_stretch")


def dynamic_timeout(mean: Column, spread: Column) -> Column:
    """Milliseconds for a page: 2.5 means, 2 spreads and 5 seconds, between 15 seconds and 5 minutes; one minute if nothing is known."""
    wanted = (2.5 * mean + 2 * spread + 5000).cast("long")
    return F.coalesce(F.greatest(F.lit(15_000).cast("long"), F.least(F.lit(300_000).cast("long"), wanted)), F.lit(60_000).cast("long"))


def is_slow(seen: Column, mean: Column) -> Column:
    return F.coalesce((seen >= 3) & (mean > 90_000), F.lit(False))


def network_status(mean: Column) -> Column:
    return F.when(mean.isNull(), "unknown").when(mean < 10_000, "excellent").when(mean < 30_000, "good").when(mean < 60_000, "fair").when(mean < 120_000, "slow").otherwise("very slow")


def parallelism(seen: Column, mean: Column, default: int) -> Column:
    """Half of the default when slow, twice (8 at most) when fast."""
    return F.when(is_slow(seen, mean), max(1, default // 2)).when(mean < 15_000, min(2 * default, 8)).otherwise(default)


def remaining_time(mean: Column, pages: Column, parallel: Column) -> Column:
    """Milliseconds for so many pages, and ten seconds more."""
    return F.floor(mean) * F.ceil(pages / parallel) + 10_000


def total_timeout(pages: Column, parallel: int, per_page: Column, factor: float = 3.0, most: int = 3600) -> Column:
    """Seconds for a document: batches of pages, each with its timeout and a margin, two minutes more, ``most`` at most."""
    batches = F.ceil(pages / F.least(F.lit(parallel), pages))
    return F.least((batches * per_page * factor).cast("long") + 120, F.lit(most).cast("long"))


def pending_pages(expected: DataFrame, cache: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """``doc_key, page_no`` still to be parsed.

    ``expected(doc_key, page_count)``; ``cache(doc_key, page_no, page_count, ok, cached_at)``. A cached document counts
    only with the same number of pages and for a day.
    """
    pages = expected.select("doc_key", "page_count", F.explode(F.sequence(F.lit(1), F.col("page_count"))).alias("page_no"))
    fresh = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("cached_at").cast("timestamp")) <= hours * 3_600_000_000
    done = cache.where(F.col("ok") & fresh).select("doc_key", "page_no", "page_count")
    return pages.join(done, ["doc_key", "page_no", "page_count"], "left_anti").select("doc_key", "page_no")


def cache_statistics(cache: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """Documents, whole and partial ones, pages that are there and that failed, of what has not expired."""
    fresh = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("cached_at").cast("timestamp")) <= hours * 3_600_000_000
    by_doc = cache.where(fresh).groupBy("doc_key").agg(F.count_if("ok").alias("good"), F.count_if(~F.col("ok")).alias("bad"), F.max("page_count").alias("n"))
    whole = F.col("good") >= F.col("n")
    return by_doc.agg(F.count("*").alias("documents"), F.count_if(whole).alias("complete"), F.count_if(~whole).alias("partial"), F.coalesce(F.sum("good"), F.lit(0)).alias("pages_ok"), F.coalesce(F.sum("bad"), F.lit(0)).alias("pages_failed"))


def parse_in_rounds(pages: DataFrame, parse: Callable[[DataFrame], DataFrame], rounds: int = 3, wait: Callable[[float], None] = time.sleep) -> DataFrame:
    """Parsed pages (``doc_key, page_no, ok, ...``), failed ones tried again in up to ``rounds`` further rounds.

    ``parse`` takes pages and marks each as ``ok`` or not. Each round is written out, so no round is run twice.
    """
    from lodemill.sources.tables import written

    done, todo = None, pages
    for k in range(rounds + 1):
        got = written(parse(todo), f"round{k}")
        good = got.where("ok")
        done = good if done is None else done.unionByName(good)
        failed = got.where("not ok")
        if k == rounds or failed.isEmpty():
            return done.unionByName(failed)
        todo = pages.join(failed.select("doc_key", "page_no"), ["doc_key", "page_no"], "left_semi")
        wait(2.0 * (k + 1))
    return done


def header_line(markdown: Column) -> Column:
    """The first row of a Markdown table; null without one."""
    lines = F.transform(F.split(markdown, "\n", -1), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    return F.get(F.filter(lines, lambda x: x.startswith("|") & x.endswith("|") & ~x.rlike(TABLE_RULE)), F.lit(0))


def header_similarity(a: Column, b: Column) -> Column:
    """Shared column names (repeats counted) over all; 0 without any."""
    names = lambda h: F.filter(F.transform(F.split(h, r"\|", -1), lambda x: F.lower(F.trim(x))), lambda x: x != "")
    x, y = names(a), names(b)
    shared = F.size(F.filter(x, lambda s: F.array_contains(y, s)))
    union = F.size(x) + F.size(y) - shared
    return F.coalesce(F.when(union > 0, shared / union), F.lit(0.0))


def _first_table(layout: Column, height: Column, bottom: bool, ratio: float) -> Column:
    """Place (from 1) of the first table at the bottom or the top of a page; null if there is none."""
    n = F.size(layout)

    def there(e: Column, i: Column) -> Column:
        boxed = F.coalesce(F.size(e["bbox"]) >= 4, F.lit(False))
        y = F.get(e["bbox"], F.lit(1))
        placed = (y + F.get(e["bbox"], F.lit(3)) >= height * ratio) if bottom else (y <= height * ratio)
        edge = (i == n - 1) if bottom else (i == 0)
        return (F.lower(e["type"]) == "table") & F.when(boxed, placed).otherwise(edge)

    marks = F.transform(layout, lambda e, i: F.when(F.coalesce(there(e, i), F.lit(False)), i + 1))
    return F.array_min(F.array_compact(marks))


def merged_markdown(first: Column, second: Column) -> Column:
    """Two Markdown tables as one: of the second, the first row and the first rule go, and blank lines."""
    bare = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    rule, row = lambda x: bare(x).rlike(TABLE_RULE), lambda x: bare(x).startswith("|") & ~bare(x).rlike(TABLE_RULE)
    place = lambda lines, of: F.array_min(F.array_compact(F.transform(lines, lambda x, i: F.when(of(x), i))))
    lines = F.split(F.coalesce(second, F.lit("")), "\n", -1)
    head, line = F.coalesce(place(lines, row), F.lit(-1)), F.coalesce(place(lines, rule), F.lit(-1))
    kept = F.filter(lines, lambda x, i: (i != head) & (i != line) & (bare(x) != ""))
    return bare(F.array_join(F.concat(F.array(F.coalesce(first, F.lit(""))), kept), "\n"))


def merged_pages(pages: Column, page: T.StructType, similarity: float = 0.7, bottom: float = 0.85, top: float = 0.15) -> Column:
    """``pages`` with a table at a page's bottom and its continuation at the next page's top as one table; none for null.

    The heads of the two have to be alike. The page takes in the next one, which is not looked at again, so that in a run of
    pages that could each take in the next it is the first, third, fifth ... that do. All of it is said of one value, so
    rows may repeat or have no key, and nothing is shuffled. ``page`` is the type of a page.
    """
    height = lambda p: F.coalesce(F.when(F.size(p["image_size"]) > 1, F.get(p["image_size"], F.lit(1))), F.lit(1000))

    def pair(p: Column, q: Column) -> Column:
        """The places of the two tables, if they are one."""
        a, b = _first_table(p["layout"], height(p), True, bottom), _first_table(q["layout"], height(q), False, top)
        x, y = header_line(F.get(p["layout"], a - 1)["md_text"]), header_line(F.get(q["layout"], b - 1)["md_text"])
        alike = (header_similarity(x, y) >= similarity) & x.isNotNull() & y.isNotNull()
        return F.when(F.coalesce(alike, F.lit(False)), F.struct(a.alias("a"), b.alias("b")))

    def whole(p: Column, q: Column, places: Column) -> Column:
        x, y = F.get(p["layout"], places["a"] - 1), F.get(q["layout"], places["b"] - 1)
        said = {
            "type": F.lit("table"),
            "bbox": x["bbox"],
            "text": F.concat(F.coalesce(x["text"], F.lit("")), F.lit("\n"), F.coalesce(y["text"], F.lit(""))),
            "md_text": merged_markdown(x["md_text"], y["md_text"]),
            "confidence": F.greatest(F.coalesce(x["confidence"], F.lit(0.0)), F.coalesce(y["confidence"], F.lit(0.0))),
        }
        table = F.struct(*[said.get(f.name, F.lit(None).cast(f.dataType)).cast(f.dataType).alias(f.name) for f in page["layout"].dataType.elementType.fields])
        rest = F.filter(q["layout"], lambda e, i: i != places["b"] - 1)
        return p.withField("layout", F.concat(F.transform(p["layout"], lambda e, i: F.when(i == places["a"] - 1, table).otherwise(e)), rest))

    pairs = F.transform(pages, lambda p, i: pair(p, F.get(pages, i + 1)))
    walk = F.aggregate(pairs, F.array().cast("array<boolean>"), lambda done, c: F.concat(done, F.array(c.isNotNull() & ~F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit(False)))))

    def taken(found: Column) -> Column:
        """From pages, pairs and marks of those that take in the next: what is left of the pages."""
        p, c, marks = found["p"], found["c"], found["m"]
        left = F.filter(F.transform(p, lambda x, i: F.struct(x.alias("page"), i.alias("i"))), lambda z: (z["i"] == 0) | ~F.get(marks, z["i"] - 1))
        return F.transform(left, lambda z: F.when(F.get(marks, z["i"]), whole(z["page"], F.get(p, z["i"] + 1), F.get(c, z["i"]))).otherwise(z["page"]))

    # the array of one struct keeps pairs and marks from being worked out again for every page
    return F.coalesce(F.flatten(F.transform(F.array(F.struct(pages.alias("p"), pairs.alias("c"), walk.alias("m"))), taken)), F.array().cast(T.ArrayType(page)))


def merge_tables_across_pages(docs: DataFrame, key: str, pages: str = "pages", similarity: float = 0.7, bottom: float = 0.85, top: float = 0.15) -> DataFrame:
    """``key``, ``pages`` of each row, as by ``merged_pages``; null and repeated keys are kept as they are."""
    whole = merged_pages(F.col(pages), docs.schema[pages].dataType.elementType, similarity, bottom, top)
    return docs.select(key, whole.alias(pages))


def in_order(number: str, value: Column, once: bool = False) -> Column:
    """An aggregate: values as an array in the order of their numbers, those of one number in any order, or one of them if ``once``; values need not be comparable."""
    found = F.collect_list(F.struct(F.col(number).alias("n"), value.alias("v")))
    ordered = F.array_sort(found, lambda x, y: F.when(x["n"] < y["n"], -1).when(x["n"] > y["n"], 1).otherwise(0))
    if once:
        first = lambda z: F.filter(z, lambda x, i: (i == 0) | ~x["n"].eqNullSafe(F.get(z, i - 1)["n"]))
        ordered = F.flatten(F.transform(F.array(ordered), first))  # the array of one keeps it from being sorted for every value
    return F.transform(ordered, lambda z: z["v"])


def ocr_documents(expected: DataFrame, cache: DataFrame, parse: Callable[[DataFrame], DataFrame], now: Column, rounds: int = 3, hours: int = 24, wait: Callable[[float], None] = time.sleep) -> tuple[DataFrame, DataFrame]:
    """Whole documents from their pages, and the rows that go into the page cache.

    ``expected(doc_key, page_count)``; ``cache(doc_key, page_no, page_count, ok, cached_at, page)``; ``parse`` turns pages
    into ``doc_key, page_no, ok, page`` (a structured page, null where it failed), and is asked again in rounds for what
    failed. Pages that the cache has are not parsed. A document has its tables merged over pages, its Markdown, its counts
    and quality, and is COMPLETE if all pages are there, PARTIAL if some are, and FAILED if none is. A document that is
    expected twice counts once, with the larger number of pages; one without a key has no pages.
    """
    from lodemill.functions import layout

    expected = expected.groupBy("doc_key").agg(F.max("page_count").alias("page_count"))
    got = parse_in_rounds(pending_pages(expected, cache, now, hours), parse, rounds, wait).select("doc_key", "page_no", "ok", "page")
    fresh = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("cached_at").cast("timestamp")) <= hours * 3_600_000_000
    known = cache.where(F.col("ok") & fresh).join(expected, ["doc_key", "page_count"], "left_semi").where(F.col("page_no").between(1, F.col("page_count"))).select("doc_key", "page_no", "page")
    pages = known.unionByName(got.where("ok").select("doc_key", "page_no", "page")).where("doc_key is not null")
    # pages are shuffled once: repeated ones go within their document, and what is counted is counted there
    whole = expected.join(pages.groupBy("doc_key").agg(in_order("page_no", F.col("page"), once=True).alias("pages")), "doc_key", "left")
    whole = whole.withColumn("pages", F.coalesce("pages", F.array().cast(f"array<{layout.PAGE}>")))
    n = F.size("pages")
    status = F.when(n == F.col("page_count"), "COMPLETE").when(n > 0, "PARTIAL").otherwise("FAILED")
    total, confidence = layout.counted(F.col("pages"))
    out = whole.withColumns({"total_elements": total, "average_confidence": confidence, "merged": merged_pages(F.col("pages"), whole.schema["pages"].dataType.elementType)})
    quality = layout.ocr_quality(F.col("total_elements"), F.col("average_confidence"))
    out = out.select("doc_key", status.alias("status"), n.alias("pages_ok"), "page_count", "total_elements", quality.alias("quality"), layout.markdown(F.col("merged")).alias("markdown"), F.col("merged").alias("pages"))
    return out, got.join(expected, "doc_key").select("doc_key", "page_no", "page_count", "ok", now.cast("timestamp").alias("cached_at"), "page")
