"""Parts of the engine by small examples and properties."""

from __future__ import annotations

import io
import random
import re
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodemill import spi
from lodemill.functions import evaluation, layout, splitting
from lodemill.functions import vectors as V
from lodemill.operators import parsing, planner, retrieval, routing, store
from lodemill.operators.retrieval import RetrievalParams, resolve
from lodemill.sources import files, html, json_repair, office, tables
from lodemill.streaming import ingest

TEXTS = st.text(alphabet="ab .,\n。，é", max_size=300)


@settings(max_examples=200, deadline=None)
@given(TEXTS, st.integers(1, 40), st.integers(0, 39))
def test_recursive_chunks_are_pieces_of_bounded_length(text, size, overlap):
    overlap = min(overlap, size - 1)
    chunks = splitting.recursive(text, size, overlap) if text else []
    assert all(c in text and len(c) <= size + overlap for c in chunks)
    if not overlap:  # blank pieces and a separator at the end of a piece may be lost
        letters = lambda s: re.sub(r"[\s.,。，]", "", s)
        assert letters("".join(chunks)) == letters(text)


@settings(max_examples=200, deadline=None)
@given(TEXTS, st.integers(1, 40), st.integers(0, 39), st.sampled_from(["SENTENCE", "PARAGRAPH", "TOKEN", "CHINESE_WORD"]))
def test_packed_chunks_are_bounded_and_keep_the_letters(text, size, overlap, name):
    overlap = min(overlap, size - 1)
    chunks = splitting.STRATEGIES[name](text, size, overlap)
    assert all(len(c) <= size + overlap + 1 for c in chunks)
    if not overlap:
        assert "".join("".join(chunks).split()) == "".join(text.split())


def test_chunk_size_and_overlap_are_checked(spark):
    for size, overlap in ((0, 0), (10, 10), (10, -1)):
        with pytest.raises(ValueError):
            splitting.split(F.lit("x"), size, overlap)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=12), st.lists(st.integers(0, 3), max_size=12))
def test_edit_distance(a, b):
    table = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1, j + 1] = min(table[i, j + 1] + 1, table[i + 1, j] + 1, table[i, j] + (x != y))
    assert evaluation.edit_distance(a, b) == table[len(a), len(b)]


def test_tables_are_compared_by_rows(spark):
    rows = [("| a |\n|---|\n| 1 |", "| A |\n|---|\n| 1 |"), ("", ""), (None, "| a |"), ("| a |\n| 2 |", "| a |\n| 1 |")]
    got = spark.createDataFrame(rows, "p string, t string").select(evaluation.table_similarity("p", "t").alias("s")).toPandas().s.tolist()
    assert got == [1.0, 1.0, 0.0, 1 - 1 / 5]


def test_rules_are_grouped_by_type(spark):
    rules = spark.createDataFrame([(1, "KEYWORD", "test", True), (2, "REGEX", r"\d+", True)], "id long, rule_type string, rule_content string, is_active boolean").withColumn("priority", F.lit(None).cast("int")).withColumn("confidence", F.lit(None).cast("double"))
    by_type = {r["rule_type"]: r["n"] for r in routing.ordered_rules(rules).groupBy("rule_type").agg(F.count("*").alias("n")).collect()}
    assert by_type == {"KEYWORD": 1, "REGEX": 1}
    assert routing.active_rules(rules, "SEMANTIC_EXAMPLE").count() == 0


def test_parameters_come_from_the_first_source_that_has_them():
    p = resolve({"top_k": 9, "doc_agg": " "}, {"top_k": 1, "doc_agg": "MAX", "limit": None})
    assert (p.top_k, p.doc_agg, p.limit, p.min_score) == (9, "MAX", 5, 0.7)
    assert RetrievalParams(top_k=3, limit=7, candidate_multiplier=0).width == 7


def test_blocks_of_probes_give_the_same(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows, probes = e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("probe"), F.col("embedding").alias("probe_vector"))
    best = lambda block: sorted(map(tuple, retrieval.against_all(rows, probes, lambda p: p.select("probe", "id", F.round(V.dot(F.col("vector"), F.col("probe_vector")), 4)), block).collect()))
    assert best(4096) == best(5)


def test_vectors_of_different_sizes(spark):
    d = spark.createDataFrame([([1.0, 0.0, 5.0], [1.0, 0.0])], "a array<float>, b array<float>")
    a, b = F.col("a"), F.col("b")
    assert d.select(V.cosine(a, b, "truncate")).first()[0] == 1.0
    assert d.select(V.cosine(a, b, "zero")).first()[0] == 0.0
    assert d.select(V.cosine(F.lit(None).cast("array<float>"), b, "zero")).first()[0] == 0.0
    for bad in (V.cosine(a, b), V.euclidean(a, b)):
        with pytest.raises(Exception, match="vectors"):
            d.select(bad).collect()


def test_vector_literals_and_bytes(spark):
    d = spark.createDataFrame([("[1.5,2]",), ("3, 4",), ("",), ("[]",)], "t string")
    assert [r[0] for r in d.select(V.from_text(F.col("t"))).collect()] == [[1.5, 2.0], [3.0, 4.0], [], []]
    assert V.decode_floats(V.encode_floats([1.0, 2.0])) == [1.0, 2.0]
    assert V.decode_floats(b"[1,2]") is None and V.decode_floats(b"\x02\x00\x00\x00\x00") is None


def _zip(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


WORD = _zip({"word/document.xml": "<w:d xmlns:w='w'><w:p><w:r><w:t>One</w:t><w:tab/><w:t>two</w:t></w:r></w:p><w:p/></w:d>", "docProps/core.xml": "<c xmlns:d='d'><d:creator>me</d:creator></c>"})
SLIDES = _zip({"ppt/slides/slide1.xml": "<p:s xmlns:p='p' xmlns:a='a'><p:sp><a:p><a:t>Hi</a:t></a:p></p:sp><p:sp><a:p><a:t> </a:t></a:p></p:sp></p:s>"})
BOOK = _zip({
    "xl/workbook.xml": "<w><sheets><sheet name='S'/></sheets></w>", "xl/sharedStrings.xml": "<s><si><t>head</t></si></s>", "xl/styles.xml": "<s><cellXfs><xf numFmtId='0'/><xf numFmtId='14'/></cellXfs></s>",
    "xl/worksheets/sheet1.xml": "<w><sheetData><row><c t='s'><v>0</v></c><c><v>2.0</v></c><c s='1'><v>45292</v></c><c t='b'><v>1</v></c><c><f>A1+1</f></c></row></sheetData></w>",
})


def test_office_files():
    assert office.read_word(WORD) == ("One\ttwo\n", {"creator": "me"})
    assert office.read_powerpoint(SLIDES)[0] == "--- Slide 1 ---\nHi"
    assert office.read_excel(BOOK)[0] == "=== Sheet: S ===\nhead\t2\t2024-01-01T00:00:00\ttrue\t=A1+1"
    for data in (office.OLE + b"x", b"text"):
        with pytest.raises(office.Unsupported):
            office.read_word(data)


def test_files_are_loaded_by_extension(spark, tmp_path):
    for name, data in {"a.docx": WORD, "b.html": b"<html lang=en><title>T</title><body><p>x<script>no</script></body>", "c.txt": "é".encode(), "d.pdf": b"%PDF", "e": b"plain"}.items():
        (tmp_path / name).write_bytes(data)
    got = {r["file_name"]: r for r in files.load(spark, str(tmp_path)).collect()}
    assert got["a.docx"]["content"].startswith("One") and got["b.html"]["content"] == "x" and got["b.html"]["metadata"]["title"] == "T"
    assert got["c.txt"]["content"] == "é" and got["e"]["loader"] == "text" and "no pdf reader" in got["d.pdf"]["error"]
    plugged = files.load(spark, str(tmp_path), {"pdf": lambda data, name: ("from pdf", {"pages": "1"})}).where("extension = 'pdf'").first()
    assert plugged["content"] == "from pdf" and plugged["error"] is None
    docs = files.as_documents(files.load(spark, str(tmp_path)), "b1", F.create_map(F.lit("title"), F.lit("mine"), F.lit("k"), F.lit("v")))
    one = docs.where("title = 'b.html'").first()
    assert one["status"] == "PENDING" and one["metadata"]["title"] == "T" and one["metadata"]["k"] == "v"
    assert docs.where("status = 'FAILED'").count() == 1
    assert files.read_texts(spark, str(tmp_path / "c.txt")).first()["content"] == "é"


def test_html_skips_what_is_not_text():
    p = html.parse("<html lang='de'><head><meta charset=utf-8><meta name=Author content=me><title>A &amp; B</title><style>x</style></head><body><h1>H <b>1</b></h1>a<br>b<h2></h2></body>")
    assert (p["title"], p["lang"], p["charset"], p["author"], p["body"], p["headings"]) == ("A & B", "de", "utf-8", "me", "H 1 a b", ["H 1", ""])
    assert html.parse(None)["body"] == ""


def test_json_is_repaired():
    assert json_repair.repair("```json\n{a: 1, 'b': \"x, }\", // c\n c: [True, None,], }\n```") is not None
    assert json_repair.repair("no json") is None and json_repair.repair(None) is None
    assert json_repair.is_complete('{"a": "}"}') and not json_repair.is_complete('{"a": [1}')


def test_providers_are_tried_in_turn():
    class P:
        def __init__(self, name, priority, answers, up=True):
            self.name, self.priority, self.answers, self.up = name, priority, iter(answers), up

        def available(self):
            return self.up

        def recognize(self, image):
            a = next(self.answers)
            if isinstance(a, Exception):
                raise a
            return a

    providers = [P("low", 1, ["{}"]), P("down", 9, ["no"], up=False), P("high", 5, [spi.Retryable(), ValueError()])]
    assert spi.recognized(b"", providers) == ("{}", "low")
    assert spi.recognized(b"", []) == (None, None)


def test_a_batch_that_fails_is_embedded_one_by_one(spark):
    class Picky(spi.HashEmbedder):
        def embed(self, texts):
            if len(texts) > 1 or texts == ["bad"]:
                raise ValueError
            return super().embed(texts)

    d = spark.createDataFrame([("a b",), ("bad",), (None,)], "t string")
    assert [None if r[0] is None else len(r[0]) for r in d.select(spi.embedding(F.col("t"), Picky(4))).collect()] == [4, None, None]


def test_plans_run_by_level_and_fail_apart():
    tasks = [planner.Task(1), planner.Task(2, "T", "", (1,)), planner.Task(3, "BAD", "", (1,)), planner.Task(4, "T", "", (3,)), planner.Task(5, "T", "", (6,)), planner.Task(6, "T", "", (5,)), planner.Task(7, "T", "", (99,))]

    def run(task, before):
        if task.tool == "BAD":
            raise ValueError
        return (task.step, sorted(before))

    out = planner.execute(tasks, run)
    assert out.results == {1: (1, []), 2: (2, [1]), 7: (7, [])} and set(out.failed) == {3} and out.blocked == {4, 5, 6} and out.last == (7, [])
    switched = planner.execute(tasks[:4], run, lambda t, e, n: ("RETRY", None) if n < 2 else ("SWITCH_TOOL", "T"))
    assert set(switched.results) == {1, 2, 3, 4}
    assert planner.execute(tasks[:4], run, lambda t, e, n: ("ABORT", None)).aborted


def test_sections_of_units(spark):
    e = lambda i, kind, level, text: {"element_id": i, "type": kind, "heading_level": level, "text": text}
    pages = [{"page_no": 1, "layout": [e("a", "Title", 1, "A"), e("b", "text", None, "x"), e("c", "heading", 3, "C"), e("d", "code", None, "y"), e("e", "text", None, "")]}, {"page_no": 2, "layout": [e("f", "header", 2, "F"), e("g", "text", None, "z")]}]
    import json

    d = spark.createDataFrame([(json.dumps({"pages": pages}),), ("{}",)], "j string").select(layout.chunkable_units(layout.parse(F.col("j"))["pages"]).alias("u"))
    units = d.collect()[0]["u"]
    assert [(u["element_id"], u["section_path"], u["is_boundary"]) for u in units] == [("a", [], True), ("b", ["A"], False), ("c", ["A"], True), ("d", ["A", "C"], True), ("f", ["A", "C"], True), ("g", ["A", "F"], False)]
    assert d.collect()[1]["u"] == []


def test_tables_across_pages(spark):
    t = lambda y, h, rows: {"type": "table", "bbox": [0.0, y, 1.0, h], "text": "t", "md_text": "| Name | Qty |\n|---|---|\n" + rows, "confidence": 0.5}
    schema = "k long, pages array<struct<page_no:int,image_size:array<int>,layout:array<struct<type:string,bbox:array<double>,text:string,md_text:string,confidence:double>>>>"
    pages = [{"page_no": 1, "image_size": [8, 1000], "layout": [t(800.0, 100.0, "| a | 1 |")]}, {"page_no": 2, "image_size": [8, 1000], "layout": [t(0.0, 900.0, "| b | 2 |"), {"type": "text", "text": "after"}]}, {"page_no": 3, "image_size": [8, 1000], "layout": [t(0.0, 10.0, "| c | 3 |")]}]
    d = spark.createDataFrame([(1, pages), (2, []), (3, None)], schema)
    got = {r["k"]: r["pages"] for r in parsing.merge_tables_across_pages(d, "k").collect()}
    assert [p["page_no"] for p in got[1]] == [1, 3] and got[2] == [] and got[3] == []
    assert got[1][0]["layout"][0]["md_text"] == "| Name | Qty |\n|---|---|\n| a | 1 |\n| b | 2 |"
    assert [e["text"] for e in got[1][0]["layout"]] == ["t\nt", "after"]


def test_ingest_runs_once(spark, tmp_path):
    docs = spark.createDataFrame([(1, "one two. three"), (2, ""), (3, None)], "id long, content string")
    docs.write.parquet(str(tmp_path / "in"))
    store_path = str(tmp_path / "store")
    for _ in range(2):
        ingest.ingest(spark, str(tmp_path / "in"), "id long, content string", store_path, str(tmp_path / "cp"), size=6, overlap=2)
    ingest.process_batch(docs, store_path, 6, 2)
    states = {r["document_id"]: r["status"] for r in ingest.states(spark, store_path).collect()}
    chunks = ingest.chunks(spark, store_path)
    assert states == {1: "INDEXED", 2: "FAILED", 3: "FAILED"} and chunks.select("external_id").distinct().count() == chunks.count() > 1
    assert ingest.backfill(spark, store_path) == 0


class Failing(spi.HashEmbedder):
    def embed(self, texts):
        raise ValueError("no model")


def test_documents_wait_for_all_of_their_vectors(spark, tmp_path):
    docs = spark.createDataFrame([(1, "one two. three"), (2, "four")], "id long, content string")
    store_path = str(tmp_path / "store")
    for _ in range(2):  # a batch that is run again is written over
        ingest.process_batch(docs, store_path, 6, 2, Failing(), batch=0)
    status = lambda: {r["document_id"]: r["status"] for r in ingest.states(spark, store_path).collect()}
    n = ingest.chunks(spark, store_path).where("not vectorized").count()
    assert status() == {1: "PROCESSING", 2: "PROCESSING"} and n == ingest.chunks(spark, store_path).count()
    assert ingest.backfill(spark, store_path, Failing()) == 0 and ingest.backfill(spark, store_path, limit=n - 1) == n - 1
    assert status() == {1: "INDEXED", 2: "PROCESSING"}
    assert ingest.backfill(spark, store_path) == 1 and status() == {1: "INDEXED", 2: "INDEXED"}
    assert ingest.chunks(spark, store_path).where("vectorized and embedding is not null").count() == n


def test_hash_embeddings_as_by_plain_loops(spark, sf):
    import hashlib
    import math

    rows = spark.read.parquet(f"{sf}/conversations.parquet").select("text").limit(50).withColumn("v", spi.embedding(F.col("text"), spi.HashEmbedder(32))).collect()
    for r in rows:
        v = [0.0] * 32
        for w in r["text"].lower().split():
            h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
            v[h % 32] += 1 if h >> 63 else -1
        n = math.sqrt(sum(x * x for x in v)) or 1.0
        assert all(abs(x / n - y) < 1e-6 for x, y in zip(v, r["v"], strict=True))


def test_processors_by_route(spark):
    class Named:
        def __init__(self, kind):
            self.kind = kind

        def supports(self, route):
            return route == self.kind

        def process(self, queries):
            return queries.select("query", F.lit(self.kind).alias("answer_text"))

    q = spark.createDataFrame([(1, "HYDE"), (2, None), (3, "ODD"), (4, "BASIC")], "query long, route string")
    assert {tuple(r) for r in spi.processed(q, [Named("HYDE"), Named("BASIC")]).collect()} == {(1, "HYDE"), (2, "BASIC"), (3, "BASIC"), (4, "BASIC")}


def test_retries_back_off():
    waits: list[float] = []

    def fail():
        raise ValueError

    assert ingest.with_retries(fail, lambda e: "recovered", wait=waits.append) == "recovered"
    assert len(waits) == 2 and 0.5 <= waits[0] < waits[1] <= 1.2


def test_chunk_positions_follow_the_contents(spark):
    random.seed(3)
    d = spark.createDataFrame([(k, "".join(random.choice("ab ") for _ in range(97))) for k in range(5)] + [(9, None), (10, "")], "id long, text string")
    rows = splitting.chunk_rows(d, "id", "text", 20, 5, "FIXED_LENGTH").collect()
    texts = {r["id"]: r["text"] for r in d.collect()}
    assert {r["id"] for r in rows} == set(range(5)) and all(texts[r["id"]][r["start_position"] : r["end_position"]] == r["content"] for r in rows)


def test_versions_of_tables(spark, tmp_path):
    d = spark.createDataFrame([(1, "a")], "id long, x string")
    tables.append(d, str(tmp_path / "t"))
    new = tables.replace(store.upserted(spark.read.parquet(str(tmp_path / "t")), spark.createDataFrame([(1, None), (2, "b")], "id long, x string")), str(tmp_path / "t"))
    assert sorted(map(tuple, new.collect())) == [(1, "a"), (2, "b")]
    assert store.among(d, "id", []).count() == 0
