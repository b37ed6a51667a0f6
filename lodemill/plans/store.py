"""Store queries: reports, filters, listings, pages, changes, idempotent ingestion, caches, the configuration graph."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodemill.functions import text as X
from lodemill.operators import config_graph as G
from lodemill.operators import keyword_index as keyword_lists
from lodemill.operators import planner as P
from lodemill.operators import store as S
from lodemill.sources.tables import table

BETWEEN = (datetime(2024, 1, 5), datetime(2024, 1, 20))
NOW = "2024-01-31 00:00:00"


def events(spark: SparkSession, sf: str) -> DataFrame:
    """Events as queries: the type is the status, the value the latency, the user the session."""
    e = table(spark, sf, "events")
    return e.select(F.col("event_id").alias("id"), "user_id", F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("session_id"), F.col("event_type").alias("status"), F.col("ts").alias("create_time"), F.when(F.col("event_type") == "purchase", F.col("value")).alias("latency_ms"), F.col("props").alias("text"), (F.col("event_id") % 7).alias("route"))


def documents(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.select(F.col("doc_id").alias("id"), F.substring("text", 1, 30).alias("title"), F.col("text").alias("content"), "source", F.col("lang").alias("document_type"), F.when(F.col("doc_id") % 4 == 0, "INDEXED").when(F.col("doc_id") % 4 == 1, "PENDING").otherwise("FAILED").alias("status"), (F.col("doc_id") % 3 == 0).alias("vectorized"), F.floor(F.col("doc_id") / 10).alias("parent_id"), (F.col("doc_id") % 10).cast("int").alias("position"), "n_chars")


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.floor(F.col("vec_id") / 5).alias("document_id"), (F.col("vec_id") % 5).cast("int").alias("chunk_index"), (F.col("vec_id") * 3).alias("vector_id"), (F.col("vec_id") % 2 == 0).alias("vectorized"), (F.col("vec_id") % 11 / 10.0).alias("quality_score"))


def count_by_status(spark, sf):
    return S.counts_by(documents(spark, sf), "status")


def count_by_type_range(spark, sf):
    return S.counts_by(events(spark, sf), "status", "route", between={"create_time": BETWEEN})


def count_half_open(spark, sf):
    return S.counts_by(events(spark, sf), "status", between={"create_time": (BETWEEN[0], None)})


def avg_latency(spark, sf):
    out = S.mean_latency(events(spark, sf), "purchase", {"create_time": BETWEEN})
    return out.select(F.round("mean_latency", 6).alias("mean_latency"))


def count_unvectorized(spark, sf):
    return S.counts_by(chunks(spark, sf).where("not vectorized"), "document_id")


def doc_dynamic_filter(spark, sf):
    return S.matching(documents(spark, sf), contains={"title": "e"}, source="src3", document_type="en", status=None, vectorized=False, between={"n_chars": (100, 5000)}).select("id", "title", "status")


def query_dynamic_filter(spark, sf):
    return S.matching(events(spark, sf), any_contains=(("text", "status"), "v"), status="view", between={"create_time": BETWEEN}, session_id=None).select("id", "session_id", "status")


def chunk_dynamic_filter(spark, sf):
    return S.matching(chunks(spark, sf), chunk_index=2, vectorized=True, between={"quality_score": (0.2, 0.8)}).select("id", "document_id", F.round("quality_score", 6).alias("quality_score"))


def point_lookup(spark, sf):
    return documents(spark, sf).where("id = 42").select("id", "source", "status")


def newest_by_status(spark, sf):
    return S.newest_first(S.matching(events(spark, sf), status="signup"), "create_time", 50).select("id", "status")


def children_by_position(spark, sf):
    return S.oldest_first(S.matching(documents(spark, sf), parent_id=3), "position").select("id", "position")


def keyword_docs(spark, sf):
    return S.matching(documents(spark, sf), any_contains=(("title", "content"), "license")).select("id", "source")


def keyword_chunks(spark, sf):
    rows = documents(spark, sf).select("id", "content", X.quality_score(F.col("content")).alias("quality"))
    return S.matching(rows, contains={"content": "the th"}).select("id", F.round("quality", 6).alias("quality"))


#: Keywords of every length and kind: rare and frequent, too short for a trigram, with wild cards.
KEYWORDS = ("license", "the th", "hereby granted", "q", "e", "a%license", "zzz", "und _er")


def keyword_index(spark, sf):
    """Which documents hold which keyword, found by their trigrams."""
    index = keyword_lists.build(documents(spark, sf).select("id", "content"), "content", ["id"])
    return index.search_all(KEYWORDS).select("keyword", "id")


def in_list(spark, sf):
    wanted = table(spark, sf, "labels").where("toxic = 1").select("doc_id")
    return S.among(documents(spark, sf), "id", wanted).select("id", "status")


def in_short_list(spark, sf):
    return S.among(events(spark, sf), "id", [1, 5, 77, 99999999]).select("id", "status")


def time_range(spark, sf):
    return S.matching(events(spark, sf), between={"create_time": BETWEEN}, order="create_time").select("id", "status")


def history_session(spark, sf):
    return S.oldest_first(S.matching(events(spark, sf), session_id="s7"), "create_time").select("id", "session_id", "status")


def history_user(spark, sf):
    return S.newest_first(S.matching(events(spark, sf), user_id=7), "create_time", 20).select("id", "user_id")


def pending_documents(spark, sf):
    return S.work_queue(documents(spark, sf), 25, "id").select("id", "status")


def pending_chunks(spark, sf):
    return S.work_queue(chunks(spark, sf), 25, "id", indexed=None).select("id", "document_id")


def chunks_of_document(spark, sf):
    return S.oldest_first(S.matching(chunks(spark, sf), document_id=4), "chunk_index").select("id", "chunk_index")


def chunk_by_vector(spark, sf):
    return chunks(spark, sf).where(F.col("vector_id") == F.lit("36").cast("long")).select("id", "vector_id")


def page_slice(spark, sf):
    return S.page(events(spark, sf), [F.desc("create_time"), F.col("id")], 3, 40).select("id", "status")


def page_total(spark, sf):
    return S.page_counts(events(spark, sf), 40)


def chunk_doc_context(spark, sf):
    c = chunks(spark, sf).join(documents(spark, sf).select(F.col("id").alias("document_id"), "title", "source"), "document_id")
    return c.select("document_id", "chunk_index", "title", "source")


def _patch(spark, sf):
    return table(spark, sf, "labels").select(F.col("doc_id").alias("id"), F.when(F.col("quality") == 1, "GOOD").otherwise("").alias("status"), F.when(F.col("toxic") == 1, "toxic").alias("title"))


def upsert_patch(spark, sf):
    return S.patched(documents(spark, sf).select("id", "title", "status", "source"), _patch(spark, sf), blank_is_null=True)


def upsert_new(spark, sf):
    """Changes of which some have a key that no document has yet."""
    base = documents(spark, sf).select("id", "title", "status")
    return S.upserted(base, _patch(spark, sf).withColumn("id", F.col("id") * 2))


def status_reset(spark, sf):
    base = documents(spark, sf).select("id", "status", F.lit("old").alias("error_message"))
    changes = table(spark, sf, "labels").select(F.col("doc_id").alias("id"), F.lit("PROCESSING").alias("status"), F.when(F.col("quality") == 0, "bad").alias("error_message"))
    return S.with_status(base, changes)


def flag_vectorized(spark, sf):
    return S.flagged(chunks(spark, sf).select("id", "vectorized"), table(spark, sf, "labels").select(F.col("doc_id").alias("id")), "vectorized", F.lit(True))


def delete_anti(spark, sf):
    return S.deleted(documents(spark, sf).select("id", "status"), table(spark, sf, "labels").select(F.col("doc_id").alias("id")))


def insert_generated(spark, sf):
    base = documents(spark, sf).select("id", "source")
    return S.inserted(base, table(spark, sf, "nation").select(F.lit(-1).cast("long").alias("id"), F.col("n_name").alias("source")))


def idempotent_append(spark, sf):
    return S.not_yet(chunks(spark, sf).select("id", "document_id"), table(spark, sf, "labels").select(F.col("doc_id").alias("document_id")), "document_id")


def page_merge(spark, sf):
    old = table(spark, sf, "documents").select(F.col("doc_id").alias("page_no"), F.col("source").alias("content"))
    new = table(spark, sf, "labels").select((F.col("doc_id") * 2).alias("page_no"), F.col("quality").cast("string").alias("content"))
    return S.merged_by_key(old, new, "page_no")


def doc_completion(spark, sf):
    return S.completed(chunks(spark, sf))


def first_seen_users(spark, sf):
    return S.first_seen(events(spark, sf), ["user_id", "status"], ["create_time", "id"]).select("id", "user_id", "status")


def ttl_filter(spark, sf):
    return S.alive(events(spark, sf), F.col("create_time"), F.lit(NOW), 7 * 86400).select("id")


def fifo_bucket(spark, sf):
    return S.latest_of_bucket(events(spark, sf), "user_id", [F.desc("create_time"), F.desc("id")], 10).select("id", "user_id")


def fifo_bounded(spark, sf):
    return S.bounded_cache(events(spark, sf), "user_id", "create_time", [F.desc("create_time"), F.desc("id")], 3, 50).select("id", "user_id")


def cache_eviction(spark, sf):
    """A cache of pages by key, of which one user's and all entries of one kind go."""
    keyed = events(spark, sf).select("id", F.concat_ws(":", F.lit("page"), F.col("user_id").cast("string"), F.col("status")).alias("key"))
    return S.evicted(S.evicted(keyed, "key", "page:7:*"), "key", "page:?*:err*").select("id", "key")


def count_vectors_by_index(spark, sf):
    e = table(spark, sf, "embeddings").select(F.concat(F.lit("index"), F.col("label").cast("string")).alias("index_name"), F.when(F.col("vec_id") % 5 == 0, "DOCUMENT").otherwise("CHUNK").alias("vector_type"))
    return S.counts_by(e, "vector_type", "index_name")


def vector_by_external_id(spark, sf):
    e = table(spark, sf, "embeddings").select(F.concat(F.lit("chunk-"), F.col("vec_id").cast("string")).alias("external_id"), F.size("embedding").alias("dimensions"), F.col("label").cast("string").alias("index_name"))
    return S.matching(e, external_id="chunk-42")


def vector_dynamic_filter(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.size("embedding").alias("dimensions"), F.col("label").cast("string").alias("index_name"))
    return S.matching(e, index_name="3", dimensions=64, vec_id=None).select("vec_id", "index_name")


def _settings(spark, sf):
    """Customers as settings: business key, name, kind, status and time of change."""
    c = table(spark, sf, "customer")
    return c.select(F.col("c_custkey").alias("id"), F.concat(F.lit("key-"), F.col("c_custkey").cast("string")).alias("key"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("kind"), F.when(F.col("c_acctbal") > 0, 1).otherwise(0).alias("status"), F.col("c_nationkey").alias("changed"))


def config_enabled(spark, sf):
    return S.newest_first(S.matching(_settings(spark, sf), status=1), "changed").select("key", "kind", "changed")


def config_by_kind(spark, sf):
    return S.matching(_settings(spark, sf), kind="BUILDING", contains={"name": "1"}).select("key", "name")


def config_writes(spark, sf):
    """Settings after a partial update by key, inserts of new keys and a deletion by id."""
    base = _settings(spark, sf).select("key", "name", "kind", "status")
    s = table(spark, sf, "supplier")
    changes = s.select(F.concat(F.lit("key-"), (F.col("s_suppkey") * 20).cast("string")).alias("key"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")).alias("name"), F.lit(None).cast("string").alias("kind"), F.lit(0).alias("status"))
    gone = table(spark, sf, "nation").select(F.concat(F.lit("key-"), F.col("n_nationkey").cast("string")).alias("key"))
    return S.deleted(S.upserted(base, changes, "key"), gone, "key")


def config_prompts(spark, sf):
    """Enabled prompts of clients, each once, where it is met first."""
    edges, _, prompts, ids = _graph(spark, sf)
    return G.prompts_of(edges, prompts.withColumnRenamed("api_id", "prompt_id"), ids).select("client", "prompt_id", "base_url")


def memoized_lengths(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    return S.memoized(c, "text", F.length("text"), "n").select("conv_id", "turn", "n")


def _steps(spark, sf):
    """The lines of an order as the steps of a plan: a line depends on others by its values, some of which make cycles."""
    line = table(spark, sf, "lineitem")
    n, q = F.col("l_linenumber"), F.col("l_quantity")
    deps = F.array_compact(F.array(F.when(q > 20, n - 1), F.when(F.col("l_discount") > 0.04, n - 2), F.when(q % 5 == 0, n + 3), F.when(F.col("l_tax") > 0.07, n + 40)))
    return line.select(F.col("l_orderkey").alias("plan"), n.alias("step"), deps.alias("dependencies"), F.concat(F.lit("ship "), F.col("l_returnflag")).alias("description"), F.when(q > 3, q).alias("result"))


def dag_levels(spark, sf):
    return P.levels(_steps(spark, sf), "plan")


def step_prompts(spark, sf):
    """What a model is told of each line, of which those with a quantity have given results."""
    steps = _steps(spark, sf)
    asked = table(spark, sf, "orders").select(F.col("o_orderkey").alias("plan"), F.concat(F.lit("what of "), F.col("o_orderpriority")).alias("question"))
    return P.prompts(steps, steps.where("result is not null").select("plan", "step", F.col("result").cast("int").alias("result")), asked)


def _graph(spark, sf):
    """Suppliers as clients, nations as models, regions as interfaces and tools."""
    s, n, r = (table(spark, sf, t) for t in ("supplier", "nation", "region"))
    text = lambda c: F.col(c).cast("string")
    edge = lambda d, st, sid, tt, tid, base: d.select((F.col(base[0]) + base[1]).cast("long").alias("id"), F.lit(st).alias("source_type"), text(sid).alias("source_id"), F.lit(tt).alias("target_type"), text(tid).alias("target_id"), F.when(F.col(base[0]) % 7 == 3, 0).otherwise(1).alias("status"))
    edges = edge(s, "client", "s_suppkey", "model", "s_nationkey", ("s_suppkey", 0)).unionByName(edge(n, "model", "n_nationkey", "tool_mcp", "n_regionkey", ("n_nationkey", 1_000_000)))
    # client k has prompt k modulo the number of regions, and its neighbour's
    for step in (0, 1):
        own = edge(s, "client", "s_suppkey", "system_prompt", "s_suppkey", ("s_suppkey", 2_000_000 + 1_000_000 * step))
        edges = edges.unionByName(own.withColumn("target_id", F.pmod(F.col("source_id").cast("long") + step, F.lit(5)).cast("string")))
    models = n.select(text("n_nationkey").alias("model_id"), text("n_regionkey").alias("api_id"), F.col("n_name").alias("model_name"), F.when(F.col("n_nationkey") % 5 == 4, 0).otherwise(1).alias("status"))
    interfaces = r.select(text("r_regionkey").alias("api_id"), F.col("r_name").alias("base_url"), F.when(F.col("r_regionkey") == 2, 0).otherwise(1).alias("status"))
    return edges, models, interfaces, s.select(text("s_suppkey").alias("client_id"))


def config_models(spark, sf):
    edges, models, _, ids = _graph(spark, sf)
    return G.models_of(edges, models, ids).select("client", "model_id", "model_name", "tools")


def config_graph_walk(spark, sf):
    return G.interfaces_of(*_graph(spark, sf)).select("client", "api_id", "base_url")


def config_tools(spark, sf):
    edges, _, interfaces, ids = _graph(spark, sf)
    return G.tools_of(edges, interfaces.withColumnRenamed("api_id", "mcp_id"), ids).select("client", "mcp_id", "base_url")


def config_assembled(spark, sf):
    edges, _, _, ids = _graph(spark, sf)
    return G.assembled(edges, ids)


def region_revenue(spark, sf):
    """The largest joins that the tables have: revenue by region and priority."""
    l = table(spark, sf, "lineitem").where("l_shipdate >= timestamp_ntz '1995-01-01 00:00:00'").select("l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"))
    o, c, n, r = (table(spark, sf, t) for t in ("orders", "customer", "nation", "region"))
    j = l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("r_name", "o_orderpriority").agg(F.round(F.sum("revenue"), 2).alias("revenue"), F.count("*").alias("n"))


_STEPS = """steps as (
  select l_orderkey as plan, l_linenumber as step, 'ship ' || l_returnflag as description, case when l_quantity > 3 then l_quantity end as result,
    list_filter([case when l_quantity > 20 then l_linenumber - 1 end, case when l_discount > 0.04 then l_linenumber - 2 end, case when l_quantity % 5 = 0 then l_linenumber + 3 end, case when l_tax > 0.07 then l_linenumber + 40 end], lambda x: x is not null) as deps
  from lineitem)"""

QUERIES = {
    f.__name__: f
    for f in (
        count_by_status, count_by_type_range, count_half_open, avg_latency, count_unvectorized, doc_dynamic_filter, query_dynamic_filter, chunk_dynamic_filter, point_lookup, newest_by_status, children_by_position,
        keyword_docs, keyword_chunks, keyword_index, in_list, in_short_list, time_range, history_session, history_user, pending_documents, pending_chunks, chunks_of_document, chunk_by_vector, page_slice, page_total,
        chunk_doc_context, upsert_patch, upsert_new, status_reset, flag_vectorized, delete_anti, insert_generated, idempotent_append, page_merge, doc_completion, first_seen_users, ttl_filter, fifo_bucket,
        fifo_bounded, cache_eviction, count_vectors_by_index, vector_by_external_id, vector_dynamic_filter, config_enabled, config_by_kind, config_writes, config_prompts,
        memoized_lengths, dag_levels, step_prompts, config_models, config_graph_walk, config_tools, config_assembled, region_revenue,
    )
}

_EV = """(select event_id as id, user_id, 's' || user_id as session_id, event_type as status, ts as create_time, case when event_type = 'purchase' then value end as latency_ms, props as text, event_id % 7 as route from events)"""
_DOC = """(select doc_id as id, text[1:30] as title, text as content, source, lang as document_type, case doc_id % 4 when 0 then 'INDEXED' when 1 then 'PENDING' else 'FAILED' end as status, doc_id % 3 = 0 as vectorized, doc_id // 10 as parent_id, (doc_id % 10)::int as position, n_chars from documents)"""
_CH = """(select vec_id as id, vec_id // 5 as document_id, (vec_id % 5)::int as chunk_index, vec_id * 3 as vector_id, vec_id % 2 = 0 as vectorized, (vec_id % 11) / 10.0::double as quality_score from embeddings)"""
_RANGE = "create_time between timestamp '2024-01-05' and timestamp '2024-01-20'"
_PATCH = "(select doc_id as id, case when quality = 1 then 'GOOD' else '' end as status, case when toxic = 1 then 'toxic' end as title from labels)"
_EDGES = """
e as (select s_suppkey::bigint as id, 'client' as source_type, s_suppkey::varchar as source_id, 'model' as target_type, s_nationkey::varchar as target_id, case when s_suppkey % 7 = 3 then 0 else 1 end as status from supplier
  union all select n_nationkey + 1000000, 'model', n_nationkey::varchar, 'tool_mcp', n_regionkey::varchar, case when n_nationkey % 7 = 3 then 0 else 1 end from nation),
ep as (select s_suppkey + 2000000 + 1000000 * k as id, s_suppkey::varchar as client, ((s_suppkey + k) % 5)::varchar as target_id, case when s_suppkey % 7 = 3 then 0 else 1 end as status from supplier, (select unnest([0, 1]) as k)),
m as (select n_nationkey::varchar as model_id, n_regionkey::varchar as api_id, n_name as model_name, case when n_nationkey % 5 = 4 then 0 else 1 end as status from nation),
i as (select r_regionkey::varchar as api_id, r_name as base_url, case when r_regionkey = 2 then 0 else 1 end as status from region),
c as (select s_suppkey::varchar as client from supplier),
cm as (select c.client, e.target_id as id, e.id as ord from c join e on e.source_id = c.client where source_type = 'client' and target_type = 'model' and status = 1),
ct as (select cm.client, e.target_id as id, e.id as ord from cm join e on e.source_id = cm.id where source_type = 'model' and target_type = 'tool_mcp' and status = 1)"""
_QUAL = """
(select id, 0.3 * least(1.0::double, length(content) / 1000.0::double)
  + 0.4 * greatest(0.0::double, 1 - 2 * coalesce(list_sum(list_transform(regexp_extract_all(content, '[^\\p{L}\\p{N}\\s]{3,}'), lambda x: length(x))), 0) / length(content)::double)
  + 0.3 * least(1.0::double, 10 * len(regexp_split_to_array(trim(content, chr(32) || chr(10) || chr(9)), '\\s+')) / length(content)::double) as quality, content from """ + _DOC + " t)"

ORACLES = {
    "count_by_status": f"select status, count(*) as n from {_DOC} t group by 1",
    "count_by_type_range": f"select status, route, count(*) as n from {_EV} t where {_RANGE} group by all",
    "count_half_open": f"select status, count(*) as n from {_EV} t group by all",
    "avg_latency": f"select round(avg(latency_ms), 6) as mean_latency from {_EV} t where status = 'purchase' and latency_ms is not null and {_RANGE}",
    "count_unvectorized": f"select document_id, count(*) as n from {_CH} t where not vectorized group by 1",
    "doc_dynamic_filter": f"select id, title, status from {_DOC} t where title like '%e%' and source = 'src3' and document_type = 'en' and not vectorized and n_chars between 100 and 5000",
    "query_dynamic_filter": f"select id, session_id, status from {_EV} t where (text like '%v%' or status like '%v%') and status = 'view' and {_RANGE}",
    "chunk_dynamic_filter": f"select id, document_id, round(quality_score, 6) as quality_score from {_CH} t where chunk_index = 2 and vectorized and quality_score between 0.2::double and 0.8::double",
    "point_lookup": f"select id, source, status from {_DOC} t where id = 42",
    "newest_by_status": f"select id, status from {_EV} t where status = 'signup' order by create_time desc, id limit 50",
    "children_by_position": f"select id, position from {_DOC} t where parent_id = 3",
    "keyword_docs": f"select id, source from {_DOC} t where title like '%license%' or content like '%license%'",
    "keyword_chunks": f"select id, round(quality, 6) as quality from {_QUAL} t where content like '%the th%'",
    "keyword_index": f"select keyword, id from {_DOC} t, (select unnest({list(KEYWORDS)}) as keyword) k where content like '%' || keyword || '%'",
    "in_list": f"select id, status from {_DOC} t where id in (select doc_id from labels where toxic = 1)",
    "in_short_list": f"select id, status from {_EV} t where id in (1, 5, 77, 99999999)",
    "time_range": f"select id, status from {_EV} t where {_RANGE}",
    "history_session": f"select id, session_id, status from {_EV} t where session_id = 's7'",
    "history_user": f"select id, user_id from {_EV} t where user_id = 7 order by create_time desc, id limit 20",
    "pending_documents": f"select id, status from {_DOC} t where not vectorized and status != 'INDEXED' order by id limit 25",
    "pending_chunks": f"select id, document_id from {_CH} t where not vectorized order by id limit 25",
    "chunks_of_document": f"select id, chunk_index from {_CH} t where document_id = 4",
    "chunk_by_vector": f"select id, vector_id from {_CH} t where vector_id = 36",
    "page_slice": f"select id, status from {_EV} t order by create_time desc, id limit 40 offset 120",
    "page_total": f"select count(*) as total, ceil(count(*) / 40.0)::bigint as pages from {_EV} t",
    "chunk_doc_context": f"select document_id, chunk_index, title, source from {_CH} c join {_DOC} d on c.document_id = d.id",
    "upsert_patch": f"select d.id, coalesce(p.title, d.title) as title, coalesce(nullif(p.status, ''), d.status) as status, source from {_DOC} d left join {_PATCH} p using (id)",
    "upsert_new": f"""
select d.id, coalesce(p.title, d.title) as title, coalesce(p.status, d.status) as status from {_DOC} d left join (select * replace (id * 2 as id) from {_PATCH} p) p using (id)
union all select id * 2, title, status from {_PATCH} p where id * 2 not in (select id from {_DOC} d)""",
    "status_reset": f"select d.id, case when l.doc_id is null then status else 'PROCESSING' end as status, case when l.doc_id is null then 'old' when quality = 0 then 'bad' end as error_message from {_DOC} d left join labels l on l.doc_id = d.id",
    "flag_vectorized": f"select id, vectorized or id in (select doc_id from labels) as vectorized from {_CH} t",
    "delete_anti": f"select id, status from {_DOC} t where id not in (select doc_id from labels)",
    "insert_generated": "select doc_id as id, source from documents union all select (select max(doc_id) from documents) + row_number() over (order by n_name), n_name from nation",
    "idempotent_append": f"select id, document_id from {_CH} t where document_id not in (select doc_id from labels)",
    "page_merge": "select coalesce(d.doc_id, l.doc_id * 2) as page_no, case when l.doc_id is not null then quality::varchar else source end as content from documents d full join labels l on d.doc_id = l.doc_id * 2",
    "doc_completion": f"select document_id, bool_and(vectorized) as done from {_CH} t group by 1",
    "first_seen_users": f"select id, user_id, status from {_EV} t qualify row_number() over (partition by user_id, status order by create_time, id) = 1",
    "ttl_filter": f"select id from {_EV} t where timestamp '2024-01-31' - create_time <= interval 7 days",
    "fifo_bucket": f"select id, user_id from {_EV} t qualify row_number() over (partition by user_id order by create_time desc, id desc) <= 10",
    "memoized_lengths": "select conv_id, turn, length(text)::int as n from conversations",
    "dag_levels": f"""
with recursive {_STEPS},
edges as (select distinct s.plan, s.step, s.dep from (select plan, step, unnest(deps) as dep from steps) s join steps d on d.plan = s.plan and d.step = s.dep),
reach as (select plan, dep as a, step as b from edges union select r.plan, r.a, e.step from reach r join edges e on e.plan = r.plan and e.dep = r.b),
blocked as (select plan, b as step from reach where (plan, a) in (select (plan, a) from reach where a = b) union select plan, a from reach where a = b),
free as (select plan, step from steps where (plan, step) not in (select (plan, step) from blocked)),
walk as (
  select plan, step, 0 as level from free
  union select w.plan, e.step, w.level + 1 from walk w join edges e on e.plan = w.plan and e.dep = w.step join free f on f.plan = e.plan and f.step = e.step)
select plan, step, max(level)::int as level from walk group by 1, 2""",
    "step_prompts": f"""
with {_STEPS},
g as (select plan, step, min(description) as description, min(result)::int as result from steps group by 1, 2),
e as (select distinct plan, step, unnest(deps) as dep from steps),
d as (select e.plan, e.step, string_agg('step ' || e.dep || ': ' || t.result, chr(10) order by e.dep) as earlier, bool_and(t.result is not null) as whole from e join g t on t.plan = e.plan and t.step = e.dep group by 1, 2)
select plan, step, 'question: what of ' || o_orderpriority || coalesce(chr(10) || earlier, '') || chr(10) || 'task: ' || description as prompt
from g left join d using (plan, step) join orders on o_orderkey = plan where coalesce(whole, true)""",
    "config_models": f"""
with {_EDGES},
f as (select * from cm qualify row_number() over (partition by id order by client, ord) = 1)
select client, model_id, model_name, coalesce((select list_sort(list(distinct target_id)) from e where source_type = 'model' and target_type = 'tool_mcp' and source_id = model_id), []) as tools
from f join m on m.model_id = f.id where m.status = 1""",
    "config_graph_walk": f"""
with {_EDGES},
f as (select cm.client, m.api_id as id, ord from cm join m on m.model_id = cm.id where m.status = 1 qualify row_number() over (partition by m.api_id order by client, ord) = 1)
select client, api_id, base_url from f join i on i.api_id = f.id where i.status = 1""",
    "config_tools": f"""
with {_EDGES},
f as (select * from ct qualify row_number() over (partition by id order by client, ord) = 1)
select client, api_id as mcp_id, base_url from f join i on i.api_id = f.id where i.status = 1""",
    "config_assembled": f"""
with {_EDGES}
select client, coalesce((select list_sort(list(distinct id)) from cm where cm.client = c.client), []) as models, coalesce((select list_sort(list(distinct target_id)) from ep where ep.client = c.client and status = 1), []) as prompts,
       coalesce((select list_sort(list(distinct id)) from ct where ct.client = c.client), []) as tools from c""",
    "config_prompts": f"""
with {_EDGES},
f as (select client, target_id as id from ep where status = 1 qualify row_number() over (partition by target_id order by client, id) = 1)
select client, id as prompt_id, base_url from f join i on i.api_id = f.id where i.status = 1""",
    "fifo_bounded": f"""
with b as (select user_id from {_EV} t group by 1 order by max(create_time) desc, user_id desc limit 50)
select id, user_id from {_EV} t where user_id in (select user_id from b) qualify row_number() over (partition by user_id order by create_time desc, id desc) <= 3""",
    "cache_eviction": f"select id, 'page:' || user_id || ':' || status as key from {_EV} t where not (key glob 'page:7:*') and not (key glob 'page:?*:err*')",
    "count_vectors_by_index": "select case when vec_id % 5 = 0 then 'DOCUMENT' else 'CHUNK' end as vector_type, 'index' || label as index_name, count(*) as n from embeddings group by all",
    "vector_by_external_id": "select 'chunk-' || vec_id as external_id, len(embedding)::int as dimensions, label::varchar as index_name from embeddings where vec_id = 42",
    "vector_dynamic_filter": "select vec_id, label::varchar as index_name from embeddings where label = 3 and len(embedding) = 64",
    "config_enabled": "select 'key-' || c_custkey as key, c_mktsegment as kind, c_nationkey as changed from customer where c_acctbal > 0",
    "config_by_kind": "select 'key-' || c_custkey as key, c_name as name from customer where c_mktsegment = 'BUILDING' and contains(c_name, '1')",
    "config_writes": """
with b as (select 'key-' || c_custkey as key, c_name as name, c_mktsegment as kind, case when c_acctbal > 0 then 1 else 0 end as status from customer),
x as (select 'key-' || s_suppkey * 20 as key, case when s_suppkey % 2 = 0 then s_name end as name, null::varchar as kind, 0 as status from supplier),
u as (select b.key, coalesce(x.name, b.name) as name, coalesce(x.kind, b.kind) as kind, coalesce(x.status, b.status) as status from b left join x using (key) union all select * from x where key not in (select key from b))
select * from u where key not in (select 'key-' || n_nationkey from nation)""",
    "region_revenue": """
select r_name, o_orderpriority, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, count(*) as n
from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey
where l_shipdate >= timestamp '1995-01-01' group by all""",
}
