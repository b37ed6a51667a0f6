"""Tables over pages and whole documents from pages, against plain Python."""

from __future__ import annotations

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from lodemill.functions import layout
from lodemill.operators import parsing
from lodemill.sources import tables

ELEMENTS = "array<struct<type:string,bbox:array<double>,text:string,md_text:string,confidence:double,extra:map<string,int>>>"
SCHEMA = f"k long, pages array<struct<page_no:int,image_size:array<int>,layout:{ELEMENTS}>>"
HEADS = ("| Name | Qty |", "| name | QTY | Sum |", "| A | B |", "no head")


def header(md):
    lines = [x.strip() for x in (md or "").split("\n")]
    return next((x for x in lines if x.startswith("|") and x.endswith("|") and not re.fullmatch(r"\|[-:|\s]+\|", x)), None)


def alike(x, y):
    a, b = ([n.strip().lower() for n in h.split("|") if n.strip()] for h in (x, y))
    both = sum(n in b for n in a)
    return both / (len(a) + len(b) - both) >= 0.7 if a or b else False


def at_edge(page, bottom):
    height = page["image_size"][1] if page["image_size"] and len(page["image_size"]) > 1 else 1000
    for i, e in enumerate(page["layout"] or []):
        if (e["type"] or "").lower() != "table":
            continue
        if e["bbox"] and len(e["bbox"]) >= 4:
            if (e["bbox"][1] + e["bbox"][3] >= height * 0.85) if bottom else (e["bbox"][1] <= height * 0.15):
                return i
        elif i == (len(page["layout"]) - 1 if bottom else 0):
            return i
    return None


def one_table(a, b):
    head = rule = False
    out = [a or ""]
    for line in (b or "").split("\n"):
        bare = line.strip()
        is_rule = re.fullmatch(r"\|[-:|\s]+\|", bare) is not None
        if not head and bare.startswith("|") and not is_rule:
            head = True
        elif not rule and is_rule:
            rule = True
        elif bare:
            out.append(line)
    return "\n".join(out).strip()


def plain_merge(pages):
    out, i = [], 0
    while i < len(pages or []):
        p, step = pages[i], 1
        if i + 1 < len(pages):
            q = pages[i + 1]
            a, b = at_edge(p, True), at_edge(q, False)
            if a is not None and b is not None:
                x, y = p["layout"][a], q["layout"][b]
                if header(x["md_text"]) and header(y["md_text"]) and alike(header(x["md_text"]), header(y["md_text"])):
                    table = {"type": "table", "bbox": x["bbox"], "text": (x["text"] or "") + "\n" + (y["text"] or ""), "md_text": one_table(x["md_text"], y["md_text"]), "confidence": max(x["confidence"] or 0.0, y["confidence"] or 0.0), "extra": None}
                    p = {**p, "layout": [table if k == a else e for k, e in enumerate(p["layout"])] + [e for k, e in enumerate(q["layout"]) if k != b]}
                    step = 2
        out.append(p)
        i += step
    return out


def random_pages(rng, n):
    def element():
        if rng.random() < 0.3:
            return {"type": rng.choice(["text", None]), "bbox": None, "text": "t", "md_text": None, "confidence": None, "extra": {"a": 1}}
        body = rng.choice(["\n|---|---|", "", "\n| - | - |\n"]) + "\n" + rng.choice(["| a | 1 |", "| b | 2 |\n\n|---|---|", " "])
        box = rng.choice([None, [0.0, 0.0, 1.0, 950.0], [0.0, 800.0, 1.0, 100.0], [0.0, 10.0, 1.0, 20.0], [1.0]])
        return {"type": rng.choice(["table", "Table"]), "bbox": box, "text": rng.choice(["x", None]), "md_text": rng.choice([None, rng.choice(HEADS) + body]), "confidence": rng.choice([None, 0.5, 0.9]), "extra": None}

    return [{"page_no": k + 1, "image_size": rng.choice([[800, 1000], [800], None]), "layout": rng.choice([None, [], [element() for _ in range(rng.randint(1, 3))]]) if rng.random() < 0.1 else [element() for _ in range(rng.randint(1, 3))]} for k in range(n)]


def plain(rows):
    return [[p.asDict(recursive=True) for p in r] for r in rows]


def test_tables_over_pages_as_by_a_walk(spark):
    rng = random.Random(11)
    table = {"type": "table", "bbox": [0.0, 0.0, 1.0, 1000.0], "text": "t", "md_text": "| A | B |\n|---|---|\n| 1 | 2 |", "confidence": 0.1, "extra": None}
    chain = [{"page_no": k, "image_size": None, "layout": [table]} for k in range(301)]
    docs = [random_pages(rng, rng.randint(0, 7)) for _ in range(150)] + [[], None, chain, chain[:2], chain[:1]]
    rows = [(None if k % 7 == 0 else k // 3, d) for k, d in enumerate(docs)]  # null and repeated keys
    frame = spark.createDataFrame(rows, SCHEMA)
    got = parsing.merge_tables_across_pages(frame, "k")
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    expected = [(k, plain_merge(d)) for k, d in rows]
    assert sum(len(x or []) - len(y) for (_, x), (_, y) in zip(rows, expected, strict=True)) > 100
    found = [(r["k"], [p.asDict(recursive=True) for p in r["pages"]]) for r in got.collect()]
    assert sorted(map(str, found)) == sorted(map(str, expected))


def test_documents_without_key_or_expected_twice(spark):
    empty = spark.createDataFrame([], f"doc_key long, page_no int, page_count int, ok boolean, cached_at timestamp, page {layout.PAGE}")
    expected = spark.createDataFrame([(1, 2), (1, 2), (None, 1), (2, 0), (3, 2)], "doc_key long, page_count int")
    page = F.from_json(F.lit('{"page_no": 1, "layout": [{"type": "text", "text": "hello", "md_text": "hello", "confidence": 0.5}]}'), layout.PAGE)

    def parse(rows):
        twice = rows.unionByName(rows)  # a provider that answers twice
        return twice.select("doc_key", "page_no", (F.coalesce("doc_key", F.lit(0)) != 3).alias("ok"), page.alias("page"))

    out, cache = parsing.ocr_documents(expected.where("page_count > 0").unionByName(spark.createDataFrame([(4, 1)], "doc_key long, page_count int")), empty, parse, F.lit("2024-01-31").cast("timestamp"), 1, wait=lambda _: None)
    got = {r["doc_key"]: (r["status"], r["pages_ok"], r["total_elements"]) for r in out.collect()}
    assert got == {1: ("COMPLETE", 2, 2), None: ("FAILED", 0, 0), 3: ("FAILED", 0, 0), 4: ("COMPLETE", 1, 1)} and out.count() == 4


def test_a_sequence_is_the_same_in_any_stretches(spark):
    rng = random.Random(3)
    rows = [(k % 3 if k % 5 else None, rng.randint(0, 40), k, None if rng.random() < 0.2 else rng.random() * 100) for k in range(500)]
    frame = spark.createDataFrame(rows, "k int, at int, id int, ms double").repartition(5)

    def plain(keys: bool) -> dict[int, tuple]:
        out = {}
        for group in {r[0] for r in rows} if keys else {0}:
            own = sorted((r for r in rows if not keys or r[0] == group), key=lambda r: (r[1], r[2]))
            for i, r in enumerate(own):
                last = [x[3] for x in own[max(0, i - 19) : i + 1] if x[3] is not None]
                mean = sum(last) / len(last) if last else None
                spread = (sum((x - mean) ** 2 for x in last) / len(last)) ** 0.5 if last else None
                out[r[2]] = (len(last), mean, spread, max(last, default=None))
        return out

    for keys in (None, ["k"]):
        want = plain(bool(keys))
        for stretch in (7, 20, 33, 100_000):
            got = parsing.recent_durations(frame, "ms", ["at", "id"], keys, stretch=stretch)
            assert got.columns == [*frame.columns, "seen", "mean", "spread", "largest"]
            found = {r["id"]: (r["seen"], r["mean"], r["spread"], r["largest"]) for r in got.collect()}
            assert found.keys() == want.keys() and all(found[k][0] == want[k][0] and found[k][3] == want[k][3] and all((x is None) == (y is None) and (x is None or abs(x - y) < 1e-9) for x, y in zip(found[k][1:3], want[k][1:3], strict=True)) for k in want)
    plan = parsing.recent_durations(frame, "ms", ["at", "id"])._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(_stretch" in plan and plan.count("SinglePartition") <= 1  # that one is of a row for each range
    assert parsing.recent_durations(frame.limit(0), "ms", ["at"]).count() == 0


def test_clarifications_say_what_is_missing(spark):
    from lodemill.operators import answering

    rows = [(None, None), ("  ", "FAQ"), ("short", "FAQ"), ("How does it differ from the other one?", "FAQ"), ("How do I reset the password of a user?", None), ("it?", "unknown"), ("Compare tables of two documents in full, please, and say why", "COMPARISON")]
    d = spark.createDataFrame(rows, "text string, task string")
    got = [r[0] for r in d.select(answering.clarification(F.col("text"), F.col("task"))).collect()]
    assert got[:2] == [answering.CLARIFICATION] * 2 and got[2] == 'About "short": It is very short; please say more of it.'
    assert "points to" in got[3] and "explained" not in got[3] and "explained" in got[4] and got[5].count(".") == 2 and "explained" in got[5]
    assert got[6] == f'About "Compare tables of two documents in full,...": {answering.CLARIFICATION}'


def test_aligned_rows_as_by_signs(spark, monkeypatch):
    monkeypatch.setattr(parsing, "SIGNS", 200)
    rng = random.Random(5)
    line = lambda: "".join(rng.choice("ab  é😀\r") for _ in range(rng.choice([0, 3, 9, 10, 11, 30])))
    texts = [(k // 2 if k % 10 else None, rng.choice([None, "", "\n\n", "\n".join(line() for _ in range(rng.randint(1, 9))) + rng.choice(["", "\n", "\n\n", "\n\r"])])) for k in range(200)]
    want = Counter()
    for key, t in texts:
        lines = re.sub(r"\n+(?=(?:\r\n|\r)?\Z)", "", t).split("\n") if t is not None else []
        for x in lines if len(lines) >= 3 else []:
            if len(x) >= 10:
                want.update((key, p) for p in {i // 5 for i in range(1, len(x) - 1) if x[i] == " " and (x[i - 1] != " " or x[i + 1] != " ")})
    most = {}
    for (key, _), n in want.items():
        if n >= 3:
            most[key] = max(n, most.get(key, 0))
    found = parsing.aligned_rows(spark.createDataFrame(texts, "k long, t string").repartition(3), ["k"], "t")
    assert found.dtypes == [("k", "bigint"), ("aligned", "int")] and "Generate" not in found._jdf.queryExecution().executedPlan().toString()
    assert {r[0]: r[1] for r in found.collect()} == most and len(most) > 10


def test_pages_of_documents_are_written_by_rounds_and_shuffled_once(spark, monkeypatch):
    """Repeated pages and repeated cache rows count once, nulls do not count in a mean, and pages are written by the rounds alone."""
    names, written = [], tables.written
    monkeypatch.setattr(tables, "written", lambda df, name: names.append(name) or written(df, name))
    now = F.lit("2024-01-31").cast("timestamp")
    text = lambda conf: '{"page_no": 1, "layout": [' + ",".join(f'{{"type": "text", "text": "a", "confidence": {c}}}' for c in conf) + "]}"
    pages = spark.createDataFrame([(1, 1, text(["0.5", "null"])), (1, 2, text([])), (1, 3, text(["1.0", "0.0", "0.9"])), (2, 1, '{"page_no": 1}'), (3, 1, text(["0.1"]))], "doc_key long, page_no int, j string").select("doc_key", "page_no", F.from_json("j", layout.PAGE).alias("page"))
    cache = pages.where("doc_key = 1 and page_no = 3").select("doc_key", "page_no", F.lit(3).alias("page_count"), F.lit(True).alias("ok"), now.alias("cached_at"), "page")
    expected = spark.createDataFrame([(1, 3), (2, 1), (3, 2)], "doc_key long, page_count int")
    out, kept = parsing.ocr_documents(expected, cache.unionByName(cache), lambda rows: rows.unionByName(rows).join(pages.withColumn("ok", F.lit(True)), ["doc_key", "page_no"]), now, 1, wait=lambda _: None)
    got = {r["doc_key"]: (r["status"], r["pages_ok"], r["total_elements"], round(r["quality"], 6)) for r in out.collect()}
    assert got == {1: ("COMPLETE", 3, 5, round(0.3 * 0.5 + 0.7 * 0.6, 6)), 2: ("COMPLETE", 1, 0, 0.0), 3: ("PARTIAL", 1, 1, round(0.03 + 0.07, 6))}
    assert names == ["round0"] and kept.count() == 8
    stats = layout.stats(out, "doc_key").select("doc_key", "total_elements", F.round("average_confidence", 6)).collect()
    total, mean = layout.counted(F.col("pages"))
    assert sorted(map(tuple, stats)) == sorted(map(tuple, out.select("doc_key", total, F.round(mean, 6)).collect()))
