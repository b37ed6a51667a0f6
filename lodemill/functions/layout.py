"""Structured documents: pages of layout elements, as nested columns."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import estimate_tokens

TABLE = "struct<title:string,caption:string,headers:array<string>,row_count:int,column_count:int,rows:array<array<string>>,summary:string>"
ELEMENT = f"struct<element_id:string,parent_id:string,type:string,heading_level:int,bbox:array<double>,text:string,md_text:string,confidence:double,attributes:map<string,string>,table_info:{TABLE}>"
PAGE = f"struct<page_no:int,image_size:array<int>,layout:array<{ELEMENT}>>"
DOCUMENT = f"struct<pages:array<{PAGE}>,model_info:string,processing_time_ms:bigint,metadata:map<string,string>>"

TITLES = ("title", "heading", "header")


def parse(text: Column) -> Column:
    """A structured document from JSON; null for what is none."""
    return F.from_json(text, DOCUMENT)


def best_text(e: Column) -> Column:
    """Markdown if there is any, else the plain text, else nothing."""
    return F.coalesce(F.nullif(e["md_text"], F.lit("")), e["text"], F.lit(""))


def is_title(e: Column) -> Column:
    return F.coalesce(F.lower(e["type"]).isin(*TITLES), F.lit(False))


def confident(layout: Column, least: float) -> Column:
    """Elements whose confidence is unknown or ``least`` at least."""
    return F.filter(layout, lambda e: e["confidence"].isNull() | (e["confidence"] >= least))


def list_marked(text: Column) -> Column:
    """Trimmed lines, each with a list mark; blank ones go."""
    lines = F.filter(F.transform(F.split(text, "\n", -1), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    return F.array_join(F.transform(lines, lambda x: F.when(x.rlike(r"^([-*+]|\d+\.)\s"), x).otherwise(F.concat(F.lit("- "), x))), "\n")


def as_table(text: str | None) -> str | None:
    """Lines of cells that tabs or two spaces part, as a Markdown table; other lines and single lines stay as they are."""
    if text is None or len(lines := text.rstrip("\n").split("\n")) < 2:
        return text
    out, ruled = [], False
    for line in lines:
        cells = re.split(r"\t|\s{2,}", line)
        while len(cells) > 1 and not cells[-1]:
            cells.pop()
        if len(cells) < 2:
            out.append(line)
            continue
        out.append("| " + " | ".join(c.strip() for c in cells) + " |")
        if not ruled:
            out.append("|" + "---|" * len(cells))
            ruled = True
    return "\n".join(out).strip()


@F.pandas_udf(T.StringType())
def to_table(text: pd.Series) -> pd.Series:
    return text.map(as_table)


def element_markdown(kind: Column, content: Column, table: Column | None = None) -> Column:
    """An element's content in the Markdown of its kind. ``table`` is the content as a table, where that is needed."""
    unless = lambda mark, new: F.when(content.startswith(mark), content).otherwise(new)
    t = F.lower(kind)
    return (
        F.when(F.coalesce(content == "", F.lit(True)), "")
        .when(t.isin(*TITLES), unless("#", F.concat(F.lit("# "), content)))
        .when(t.isin("subtitle", "subheading"), unless("#", F.concat(F.lit("## "), content)))
        .when(t == "table", F.when(F.contains(content, F.lit("|")), content).otherwise(content if table is None else table))
        .when(t.isin("list", "bullet"), list_marked(content))
        .when(t == "code", unless("```", F.concat(F.lit("```\n"), content, F.lit("\n```"))))
        .when(t.isin("formula", "math", "equation"), F.when(content.startswith("$") | content.startswith("\\["), content).otherwise(F.concat(F.lit("$"), content, F.lit("$"))))
        .when(t.isin("image", "figure", "caption"), F.concat(F.lit("*"), content, F.lit("*")))
        .when(t == "footnote", F.concat(F.lit("[^note]: "), content))
        .when(t.isin("quote", "blockquote"), unless(">", F.concat(F.lit("> "), F.replace(content, F.lit("\n"), F.lit("\n> ")))))
        .otherwise(content)
    )


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def markdown(pages: Column, least_confidence: float = 0.0) -> Column:
    """The Markdown of a document: elements apart by blank lines, pages from the second on after a rule."""

    def page(state: Column, p: Column) -> Column:
        parts = F.filter(F.transform(confident(p["layout"], least_confidence), lambda e: element_markdown(e["type"], best_text(e))), lambda x: x != "")
        ruled = (state["n"] > 0) & (F.size(p["layout"]) > 0)
        rule = F.when(F.coalesce(ruled, F.lit(False)), "\n\n---\n\n").otherwise("")
        lead = F.when((state["any"]) & (F.size(parts) > 0), "\n\n").otherwise("")
        body = F.coalesce(F.concat(lead, F.array_join(parts, "\n\n")), F.lit(""))
        return F.struct((state["n"] + 1).alias("n"), (state["any"] | F.coalesce(F.size(parts) > 0, F.lit(False))).alias("any"), F.concat(state["out"], rule, body).alias("out"))

    start = F.struct(F.lit(0).alias("n"), F.lit(False).alias("any"), F.lit("").alias("out"))
    return F.coalesce(_strip(F.aggregate(pages, start, page)["out"]), F.lit(""))


def plain_text(pages: Column) -> Column:
    """All non-empty texts, apart by blank lines."""
    texts = F.filter(F.flatten(F.transform(pages, lambda p: F.coalesce(F.transform(p["layout"], lambda e: e["text"]), F.array().cast("array<string>")))), lambda x: F.coalesce(x != "", F.lit(False)))
    return F.coalesce(_strip(F.array_join(texts, "\n\n")), F.lit(""))


def elements(docs: DataFrame, key: str, pages: str = "pages") -> DataFrame:
    """A row for each element: ``key``, ``page_index``, ``page_no``, ``place`` and ``e``."""
    each = docs.select(key, F.posexplode(pages).alias("page_index", "p"))
    return each.select(key, "page_index", F.col("p.page_no").alias("page_no"), F.posexplode("p.layout").alias("place", "e"))


def stats(docs: DataFrame, key: str, pages: str = "pages") -> DataFrame:
    """Counts by kind, mean confidence, characters and tokens of each document; zeros for one without pages."""
    kind = F.lower("e.type")
    groups = {"title_count": ("title", "heading", "header", "subtitle"), "text_count": ("text", "paragraph"), "table_count": ("table",), "image_count": ("image", "figure")}
    known = reduce(lambda a, b: a | b, (kind.isin(*g) for g in groups.values()))
    counted = elements(docs, key, pages).groupBy(key).agg(
        F.count("*").alias("total_elements"),
        *[F.count_if(kind.isin(*g)).alias(c) for c, g in groups.items()],
        F.count_if(kind.isNotNull() & ~known).alias("other_count"),
        F.coalesce(F.avg("e.confidence"), F.lit(0.0)).alias("average_confidence"),
        F.sum(F.length(best_text(F.col("e")))).alias("total_characters"),
    )
    base = docs.select(key, F.coalesce(F.size(pages), F.lit(0)).alias("page_count"))
    out = base.join(counted, key, "left").fillna(0)
    return out.withColumn("estimated_tokens", estimate_tokens(F.col("total_characters")))


def counted(pages: Column) -> tuple[Column, Column]:
    """Elements of a document and their mean confidence, as ``stats`` has them, from its own row; zeros for one without pages."""
    each = lambda p: F.transform(p["layout"], lambda e: e["confidence"])
    all_ = F.flatten(F.transform(pages, lambda p: F.coalesce(each(p), F.array().cast("array<double>"))))
    sure = F.aggregate(F.array_compact(all_), F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("n")), lambda s, x: F.struct((s["sum"] + x).alias("sum"), (s["n"] + 1).alias("n")), lambda s: F.when(s["n"] > 0, s["sum"] / s["n"]).otherwise(0.0))
    return F.coalesce(F.size(F.when(pages.isNotNull(), all_)).cast("long"), F.lit(0)), F.coalesce(sure, F.lit(0.0))


def confidence_histogram(docs: DataFrame, key: str, pages: str = "pages") -> DataFrame:
    """How many elements have a confidence of 0.9, of 0.7 and of less; unknown ones count nowhere."""
    c = F.col("e.confidence")
    return elements(docs, key, pages).groupBy(key).agg(F.count_if(c >= 0.9).alias("high"), F.count_if((c >= 0.7) & (c < 0.9)).alias("medium"), F.count_if(c < 0.7).alias("low"))


def ocr_quality(total_elements: Column, confidence: Column) -> Column:
    return 0.3 * F.least(F.lit(1.0), total_elements / 10.0) + 0.7 * confidence


UNIT = "struct<element_id:string,type:string,content:string,page_no:int,confidence:double,heading_level:int,is_boundary:boolean,section_path:array<string>,is_table:boolean>"


def chunkable_units(pages: Column) -> Column:
    """Elements with content, in order, each with the headings above it, as an array.

    A heading is pushed after its own unit, once headings of its level or below are gone; one without a level has level 1.
    """
    flat = F.flatten(F.transform(pages, lambda p: F.coalesce(F.transform(p["layout"], lambda e: F.struct(p["page_no"].alias("page_no"), e.alias("e"))), F.array().cast(f"array<struct<page_no:int,e:{ELEMENT}>>"))))

    def step(state: Column, x: Column) -> Column:
        e, content = x["e"], best_text(x["e"])
        level = F.coalesce(e["heading_level"], F.lit(1))
        table = (F.lower(e["type"]) == "table") & e["table_info"].isNotNull()
        boundary = is_title(e) | F.coalesce(table, F.lit(False)) | F.coalesce(F.lower(e["type"]).isin("code", "formula", "equation"), F.lit(False))
        unit = F.struct(
            e["element_id"].alias("element_id"), e["type"].alias("type"), content.alias("content"), x["page_no"].alias("page_no"), e["confidence"].alias("confidence"), F.when(is_title(e), level).alias("heading_level"),
            boundary.alias("is_boundary"), state["path"].alias("section_path"), F.coalesce(table, F.lit(False)).alias("is_table"),
        ).cast(UNIT)
        units = F.when(content != "", F.array_append(state["units"], unit)).otherwise(state["units"])
        above = F.slice(state["path"], 1, F.least(F.size(state["path"]), F.greatest(level - 1, F.lit(0))))
        path = F.when(is_title(e), F.array_append(above, content)).otherwise(state["path"])
        return F.struct(units.alias("units"), path.alias("path"))

    start = F.struct(F.array().cast(f"array<{UNIT}>").alias("units"), F.array().cast("array<string>").alias("path"))
    return F.coalesce(F.aggregate(flat, start, step)["units"], F.array().cast(f"array<{UNIT}>"))


def units_of_type(units: Column, kind: str) -> Column:
    return F.filter(units, lambda u: F.lower(u["type"]) == kind.lower())


def title_units(units: Column) -> Column:
    return F.filter(units, lambda u: u["heading_level"].isNotNull())


def boundaries(docs: DataFrame, key: str, units: str = "units") -> DataFrame:
    """Where the text may best be cut: ``key``, ``unit_index``, ``char_offset``, ``type``, ``heading_level``, ``is_table``."""
    rows = docs.select(key, F.posexplode(units).alias("unit_index", "u"))
    before = Window.partitionBy(key).orderBy("unit_index").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("char_offset", F.coalesce(F.sum(F.length("u.content") + 2).over(before), F.lit(0)))
    return rows.where("u.is_boundary").select(key, "unit_index", "char_offset", F.col("u.type").alias("type"), F.col("u.heading_level").alias("heading_level"), F.col("u.is_table").alias("is_table"))


def table_context(t: Column) -> Column:
    """A table's title and Markdown header."""
    title = F.when(F.coalesce(t["title"] != "", F.lit(False)), F.concat(t["title"], F.lit("\n"))).otherwise("")
    head = F.concat(F.lit("| "), F.array_join(t["headers"], " | "), F.lit(" |\n|"), F.array_join(F.transform(t["headers"], lambda _: F.lit("---|")), ""))
    return F.concat(title, F.when(F.coalesce(F.size(t["headers"]) > 0, F.lit(False)), head).otherwise(""))


def _row(cells: Column) -> Column:
    return F.when(F.size(cells) > 0, F.concat(F.lit("| "), F.array_join(cells, " | ", ""), F.lit(" |"))).when(cells.isNotNull(), "|")


def rows_with_context(t: Column) -> Column:
    """Each row of a table beneath its title and header."""
    return F.coalesce(F.transform(t["rows"], lambda r: F.concat(table_context(t), F.lit("\n"), _row(r))), F.array().cast("array<string>"))


def row_with_context(t: Column, i: Column) -> Column:
    """One row of a table; empty where there is no such row."""
    row = F.when((i >= 0) & (i < F.size(t["rows"])), F.get(t["rows"], i))
    return F.coalesce(F.concat(table_context(t), F.lit("\n"), _row(row)), F.lit(""))


def table_chunks(e: Column) -> Column:
    """What is indexed of a table element: itself, its rows with context, its summary; null if it has no content."""
    t, none = e["table_info"], F.array().cast("array<string>")
    rows = F.when(t.isNotNull(), rows_with_context(t)).otherwise(none)
    summary = F.when(F.coalesce(t["summary"] != "", F.lit(False)), F.array(t["summary"])).otherwise(none)
    return F.when(best_text(e) != "", F.concat(F.array(best_text(e)), rows, summary))


def prefixed_ids(page: Column) -> Column:
    """A page whose element and parent ids begin with ``p<number>_``."""
    mark = F.concat(F.lit("p"), page["page_no"].cast("string"), F.lit("_"))
    fix = lambda x: F.when(x.startswith(mark), x).otherwise(F.concat(mark, x))
    return page.withField("layout", F.transform(page["layout"], lambda e: e.withField("element_id", fix(e["element_id"])).withField("parent_id", fix(e["parent_id"]))))
