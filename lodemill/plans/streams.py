"""Queries that ingest documents as a stream, load files, run a plan of steps, or call stand-in models."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodemill import spi
from lodemill.functions.vectors import norm
from lodemill.operators import parsing as P
from lodemill.operators import planner
from lodemill.operators import routing
from lodemill.operators import store as S
from lodemill.sources import files, json_repair
from lodemill.sources.tables import append, shared, table, written
from lodemill.streaming import caches, ingest, vectors

from .routing import _BEST

DOCUMENTS = "id long, content string"


def stream_ingest(spark, sf):
    """Documents, taken as a file stream, chunked and embedded once; a second run finds nothing to do."""
    root = shared(spark, "ingest")
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    docs.write.parquet(f"{root}/landing")
    for _ in range(2):
        ingest.ingest(spark, f"{root}/landing", DOCUMENTS, f"{root}/store", f"{root}/checkpoint", embedder=spi.HashEmbedder(16), strategy="FIXED_LENGTH")
    done = ingest.chunks(spark, f"{root}/store").groupBy("document_id").agg(F.count("*").alias("n_chunks"), F.sum(F.length("content")).alias("n_chars"))
    return ingest.states(spark, f"{root}/store").join(done, "document_id", "left").select("document_id", "status", "n_chunks", "n_chars")


def _root(spark, name):
    """A folder that goes when the application ends."""
    root = shared(spark, name)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return root


class Picky(spi.HashEmbedder):
    """Fails for texts with a ``q`` in them."""

    def _one(self, text: str) -> list[float] | None:
        if "q" in text:
            raise ValueError("no q")
        return super()._one(text)


def stream_backfill(spark, sf):
    """Conversations of which some cannot be embedded at first; they wait, and are indexed when their chunks are filled in."""
    root = shared(spark, "backfill")
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    docs = table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("content"))
    ingest.process_batch(docs, root, embedder=Picky(16), strategy="FIXED_LENGTH")
    before = written(ingest.states(spark, root), "before").select("document_id", F.col("status").alias("first"))
    while ingest.backfill(spark, root, spi.HashEmbedder(16), limit=100_000):
        pass
    return ingest.states(spark, root).join(before, "document_id").select("document_id", "first", F.col("status").alias("last"))


#: Rows of a file that a stream lands, at least where there are several.
LANDED = 50_000


def _landed(spark, root, rows, at, days=(8, 16, 24)):
    """``rows`` as files of a stream, as many for each range of days as its rows ask for, in the order of time; a range is a batch."""
    edges = [None, *days, None]
    day = F.dayofmonth(at)
    ranges = [(F.lit(True) if low is None else day > low) & (F.lit(True) if high is None else day <= high) for low, high in zip(edges, edges[1:])]
    # every range has the same number of files, none of them empty, so that a batch takes a whole range
    n = max(1, min(rows.agg(*[F.count_if(r) for r in ranges]).first()) // LANDED)
    for k, own in enumerate(ranges):
        part = rows.where(own)
        (part.coalesce(1) if n == 1 else part.repartition(n)).write.parquet(f"{root}/{k}")
    return spark.readStream.schema(rows.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", n).parquet(root)


def cache_lookups(spark, sf):
    """Events ask a cache that keeps each user's value for a day; errors have none. Some events come twice, and some weeks late."""
    root = _root(spark, "lookups")
    e = table(spark, sf, "events").select("event_id", "user_id", "ts", F.when(F.col("event_type") != "error", F.col("event_id").cast("string")).alias("value"))
    twice = e.where("event_id % 5 = 0")
    late = e.where("event_id % 7 = 0 and dayofmonth(ts) <= 8").select((F.col("event_id") + 1_000_000_000).alias("event_id"), "user_id", "ts", F.lit("late").alias("value"))
    rows = e.withColumn("n", F.lit(0)).unionByName(twice.withColumn("n", F.lit(0))).unionByName(late.withColumn("n", F.lit(20)))
    stream = _landed(spark, f"{root}/in", rows, F.date_add("ts", F.col("n")))
    with caches.rocksdb(spark):
        answers = caches.asked(stream, "user_id", "event_id", "ts", "value", 86_400)
        answers.writeStream.format("parquet").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start(f"{root}/out").awaitTermination()
    return spark.read.schema(answers.schema).parquet(f"{root}/out").select("event_id", "hit", "value")


def vector_timeouts(spark, sf):
    """Events as the chunks of their users' documents; a vector comes up to ninety minutes later, or never, and counts within the hour."""
    root = _root(spark, "timeouts")
    e = table(spark, sf, "events").where("event_type = 'purchase'")
    n = e.groupBy("user_id").agg(F.count("*").cast("int").alias("n_chunks"))
    chunks = e.join(n, "user_id").select(F.col("user_id").alias("document_id"), F.col("event_id").cast("int").alias("chunk_index"), "n_chunks", F.col("ts").cast("timestamp").alias("at"))
    sent = chunks.where("chunk_index % 33 != 0").select("document_id", "chunk_index", F.timestamp_micros(F.unix_micros("at") + F.when(F.col("chunk_index") % 20 == 0, 90).otherwise(F.col("chunk_index") % 60).cast("long") * 60_000_000).alias("at"))
    beat = spark.sql("select cast(null as bigint) document_id, cast(null as int) chunk_index, cast(null as int) n_chunks, timestamp'2024-03-31' at")
    both = lambda x, name: _landed(spark, f"{root}/{name}", x.unionByName(x.where("chunk_index % 4 = 0")).unionByName(beat.select(*x.columns)), F.when(F.col("at") >= "2024-02-01", F.lit("2024-01-31")).otherwise(F.col("at")))
    found = vectors.outcomes(both(chunks, "chunks"), both(sent, "vectors"))
    for _ in range(2):  # the second time finds nothing new
        vectors.follow(found, f"{root}/store", f"{root}/checkpoint", 16)
    return vectors.states(spark, f"{root}/store", 16)


def embed_texts(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", "text").withColumn("v", spi.embedding(F.col("text"), spi.HashEmbedder(32)))
    return c.select("conv_id", "turn", F.size("v").alias("dimensions"), F.round(norm(F.col("v")), 4).alias("norm"))


def embed_once(spark, sf):
    """Each text is embedded once, also where turns repeat it: here by its length, so that SQL can say the same."""
    c = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    return S.memoized(c, "text", spi.embedding(F.col("text"), Lengths()), "v").select("conv_id", "turn", F.get("v", F.lit(0)).cast("long").alias("length"), F.get("v", F.lit(1)).cast("long").alias("spaces"))


class Lengths:
    """A text's length and spaces as a vector."""

    name, dimensions = "lengths", 2

    def embed(self, texts: list[str]) -> list[list[float] | None]:
        return [[float(len(t)), float(t.count(" "))] for t in texts]


class Reader:
    """Stands in for an OCR provider: its answer is an image's length, and breaks off for those with an ``!``."""

    def __init__(self, name: str, priority: int, refuses: bytes) -> None:
        self.name, self.priority, self.refuses = name, priority, refuses

    def available(self) -> bool:
        return True

    def recognize(self, image: bytes) -> str:
        if self.refuses in image:
            raise ValueError("not this one")
        return '{"blocks": [' if b"!" in image else f'{{"length": {len(image)}, "prompt": "full"}}'

    def recognize_simply(self, image: bytes) -> str:
        return f'{{"length": {len(image)}, "prompt": "simple"}}'


def ocr_providers(spark, sf):
    """Texts as images: the provider of larger priority refuses some, the other one others."""
    c = table(spark, sf, "documents").select("doc_id", F.col("text").cast("binary").alias("image"))
    r = c.select("doc_id", spi.recognition(F.col("image"), [Reader("second", 1, b"the"), Reader("first", 2, b"und")]).alias("r"))
    return r.select("doc_id", "r.provider", F.get_json_object("r.json", "$.length").cast("long").alias("length"), F.get_json_object("r.json", "$.prompt").alias("prompt"))


def load_files(spark, sf):
    """Regions and nations, written as text files and loaded again by their extension, as documents of one batch."""
    root = shared(spark, "files")
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("key"), F.concat_ws(" ", "n_name", F.col("n_regionkey").cast("string"), F.lit("é")).alias("value"))
    n.repartition(32, "key").write.partitionBy("key").text(root)
    docs = files.as_documents(files.load(spark, root), "batch-1", F.create_map(F.lit("encoding"), F.lit("mine"), F.lit("k"), F.lit("v")))
    whole = files.read_texts(spark, f"{root}/*").select("path", "size")
    key = lambda c: F.regexp_extract(c, r"key=(\d+)", 1).cast("int")
    return docs.select(key("source").alias("key"), "document_type", "status", "batch_id", F.trim(F.regexp_replace("content", "\n", "")).alias("content"), F.array_join(F.transform(F.array_sort(F.map_entries("metadata")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("metadata")).join(whole.select(key("path").alias("key"), "size"), "key")


def append_rows(spark, sf):
    """Vectors written in two batches to a table that is partitioned by their index, and read again."""
    root = shared(spark, "vectors")
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    e = table(spark, sf, "embeddings").select("vec_id", F.size("embedding").alias("dimensions"), "label")
    append(e.where("label < 5"), root, ["label"])
    append(e.where("label >= 5"), root, ["label"])
    return spark.read.parquet(root).select("vec_id", "dimensions", "label")


def page_rounds(spark, sf):
    """Pages that fail at first and pass in a later round; those of odd documents never do."""
    pages = table(spark, sf, "nation").select(F.col("n_nationkey").alias("doc_key"), F.explode(F.sequence(F.lit(1), F.lit(3))).alias("page_no"))
    state = {"round": -1}

    def parse(rows):
        state["round"] += 1
        ok = (F.col("page_no") <= state["round"] + 1) & ((F.col("doc_key") % 2 == 0) | (F.col("page_no") == 1))
        return rows.select("doc_key", "page_no", ok.alias("ok"), F.lit(state["round"]).alias("round"))

    return P.parse_in_rounds(pages, parse, 3, wait=lambda _: None).select("doc_key", "page_no", "ok")


def plan_run(spark, sf):
    """A diamond of steps, each a count over a table that stays a DataFrame; a step of an unknown tool fails and blocks what follows."""
    tasks = [planner.Task(1, "COUNT", "orders"), planner.Task(2, "COUNT", "lineitem", (1,)), planner.Task(3, "COUNT", "part", (1,)), planner.Task(4, "SUM", "", (2, 3)), planner.Task(5, "NONE", "", (4,)), planner.Task(6, "SUM", "", (5,))]
    tools = planner.ToolRegistry()
    tools.register("COUNT", lambda name: table(spark, sf, name).agg(F.count("*").alias("result")))

    def run(task, before):
        return reduce(DataFrame.union, before.values()).agg(F.sum("result").alias("result")) if task.tool == "SUM" else tools.run(task.tool, task.description)

    out = planner.execute(tasks, run)
    return reduce(DataFrame.union, [df.select(F.lit(step).alias("step"), "result") for step, df in sorted(out.results.items())])


def repaired_json(spark, sf):
    e = table(spark, sf, "events")
    broken = F.concat(F.lit("```json\n{k: '"), F.col("event_type"), F.lit("', \"n\": "), F.col("event_id").cast("string"), F.lit(", /* c */ \"l\": [True, None,],}\n```"))
    j = e.select("event_id", json_repair.repaired(broken).alias("j"))
    return j.select("event_id", F.get_json_object("j", "$.k").alias("k"), F.get_json_object("j", "$.n").cast("long").alias("n"), F.get_json_object("j", "$.l[0]").alias("first"))


def routing_trace(spark, sf):
    from .routing import questions, rules

    q = questions(spark, sf)
    r = routing.detect_by_rules(q, rules(spark)).select("query", F.lit("rules").alias("detector"), F.lit(-100).alias("sort"), "confidence", F.concat(F.lit("rule "), F.col("rule_id").cast("string")).alias("reason"), F.col("rule_id").alias("latency_ms"))
    f = q.select("query", F.lit("fallback"), F.lit(1000), F.lit(0.3), F.lit("nothing fits"), F.lit(1).cast("long"))
    each = F.transform("detectors", lambda d: F.concat_ws(" ", d["detector"], d["confidence"].cast("string"), d["reason"], d["latency_ms"].cast("string")))
    return routing.trace(r.union(f)).select("query", F.array_join(each, "; ").alias("detectors"), "latency_ms", "chosen")


QUERIES = {f.__name__: f for f in (stream_ingest, stream_backfill, cache_lookups, vector_timeouts, ocr_providers, load_files, append_rows, embed_texts, embed_once, page_rounds, plan_run, repaired_json, routing_trace)}
ORACLES = {
    "page_rounds": "select n_nationkey as doc_key, p as page_no, n_nationkey % 2 = 0 or p = 1 as ok from nation, (select unnest([1, 2, 3])::int as p)",
    "plan_run": "with c as (select (select count(*) from orders) as a, (select count(*) from lineitem) as b, (select count(*) from part) as c) select unnest([1, 2, 3, 4]) as step, unnest([a, b, c, b + c]) as result from c",
    "repaired_json": "select event_id, event_type as k, event_id as n, 'true' as first from events",
    "embed_once": "select conv_id, turn, length(text)::bigint as length, (length(text) - length(replace(text, ' ', '')))::bigint as spaces from conversations",
    "append_rows": "select vec_id, len(embedding)::int as dimensions, label from embeddings",
    "load_files": """
select n_nationkey as key, 'txt' as document_type, 'PENDING' as status, 'batch-1' as batch_id, n_name || ' ' || n_regionkey || ' é' as content, 'encoding=UTF-8,k=v' as metadata,
  (strlen(n_name) + 6)::bigint as size from nation""",
    "ocr_providers": """
with p as (select doc_id, text, case when not contains(text, 'und') then 'first' when not contains(text, 'the') then 'second' end as provider from documents)
select doc_id, provider, case when provider is not null then strlen(text) end::bigint as length, case when provider is not null then case when contains(text, '!') then 'simple' else 'full' end end as prompt from p""",
    "stream_ingest": """
with c as (select doc_id, text, unnest(range(0, (length(text) - 1) // 400 + 1)) as i from documents where text != ''), n as (select doc_id, count(*) as n_chunks, sum(length(text[i * 400 + 1 : i * 400 + 500]))::bigint as n_chars from c group by 1)
select d.doc_id as document_id, case when coalesce(text, '') = '' then 'FAILED' else 'INDEXED' end as status, n_chunks, n.n_chars from documents d left join n using (doc_id)""",
    "stream_backfill": """
select conv_id * 1000 + turn as document_id, case when coalesce(text, '') = '' then 'FAILED' when contains(text, 'q') then 'PROCESSING' else 'INDEXED' end as first,
  case when coalesce(text, '') = '' then 'FAILED' else 'INDEXED' end as last from conversations""",
    "cache_lookups": """
with recursive e as (select event_id, user_id, ts, case when event_type != 'error' then event_id::varchar end as value from events),
puts as (
  select user_id, first.ts as ts, first.event_id as event_id, first.value as value from (select user_id, min({'ts': ts, 'event_id': event_id, 'value': value}) as first from e where value is not null group by 1)
  union all
  select user_id, next.ts, next.event_id, next.value from (
    select p.user_id, min({'ts': e.ts, 'event_id': e.event_id, 'value': e.value}) as next from puts p join e on e.user_id = p.user_id and e.ts >= p.ts + interval 1 day and e.value is not null group by p.user_id, p.event_id)),
hits as (select e.event_id, max(p.value) as value from e join puts p on p.user_id = e.user_id and (p.ts, p.event_id) < (e.ts, e.event_id) and e.ts < p.ts + interval 1 day group by 1)
select e.event_id, h.event_id is not null as hit, coalesce(h.value, e.value) as value from e left join hits h using (event_id)""",
    "vector_timeouts": """
with c as (select user_id as document_id, event_id % 33 != 0 and event_id % 20 != 0 as ok from events where event_type = 'purchase')
select document_id, case when bool_and(ok) then 'INDEXED' else 'FAILED' end as status, case when not bool_and(ok) then 'no vector' end as error_message from c group by 1""",
    "routing_trace": f"""with {_BEST}
select q.query, coalesce('rules ' || coalesce(confidence, 0.8)::double || ' rule ' || id || ' ' || id || '; ', '') || 'fallback 0.3 nothing fits 1' as detectors, (coalesce(id, 0) + 1)::bigint as latency_ms,
  case when coalesce(confidence, 0.8) >= 0.3 and b.query is not null then 'rules' else 'fallback' end as chosen from q left join b using (query)""",
}
