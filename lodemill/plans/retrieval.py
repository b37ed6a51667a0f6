"""Vector search, re-ranking and similarity queries over ``embeddings``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodemill.functions import vectors as V
from lodemill.operators import products
from lodemill.operators import retrieval as R
from lodemill.operators import store as S
from lodemill.operators import vector_lists
from lodemill.sources.tables import table

#: Probes are the vectors whose ids 20 divides.
PROBES = "vec_id % 20 = 0"


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors as chunks: five to a document."""
    e = table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.floor(F.col("vec_id") / 5).alias("document_id"), (F.col("vec_id") % 5).cast("int").alias("chunk_index"), F.col("embedding").alias("vector"), F.col("label").cast("string").alias("index_name"), F.size("embedding").alias("dimensions"))


def probes(spark: SparkSession, sf: str, where: str = PROBES) -> DataFrame:
    return table(spark, sf, "embeddings").where(where).select(F.col("vec_id").alias("probe"), F.col("embedding").alias("probe_vector"))


def _params(**how) -> R.RetrievalParams:
    return R.RetrievalParams(**how)


def knn_topk(spark, sf):
    return R.top_k(corpus(spark, sf), probes(spark, sf), 20).select("probe", "id", "score", "rank")


def knn_lists(spark, sf):
    """The same by lists of vectors, of which those are read that may hold what a probe looks for."""
    return vector_lists.build(corpus(spark, sf).select("id", "vector"), 20).search(probes(spark, sf), 20)


def knn_by_index(spark, sf):
    first = table(spark, sf, "embeddings").where("vec_id = 7").first()
    return R.nearest(corpus(spark, sf), first["embedding"], 10, index_name=str(first["label"]), dimensions=64).select("id", "index_name", "score")


def knn_join_context(spark, sf):
    rows = corpus(spark, sf)
    best = R.top_k(rows.select("id", "vector"), probes(spark, sf), 20).withColumnRenamed("id", "vector_id")
    chunks = rows.select(F.col("id").alias("chunk_id"), F.col("id").alias("vector_id"), "document_id", "chunk_index")
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("document_id"), "source", "lang")
    return R.with_context(best, chunks, docs).select("probe", "chunk_id", "document_id", "chunk_index", "source", "lang", "score")


def _candidates(spark, sf, k=20):
    return R.top_k(corpus(spark, sf).drop("index_name", "dimensions"), probes(spark, sf), k)


def doc_score_max(spark, sf):
    return R.document_scores(_candidates(spark, sf), "MAX")


def doc_score_mean_top2(spark, sf):
    return R.document_scores(_candidates(spark, sf))


def rerank_full(spark, sf):
    return R.rerank(_candidates(spark, sf), _params())


def rerank_threshold(spark, sf):
    return R.retrieve(corpus(spark, sf), probes(spark, sf), _params(min_score=0.3)).select("probe", "id", "document_id", "score", "position", "fallback")


def rerank_fallback(spark, sf):
    return R.retrieve(corpus(spark, sf), probes(spark, sf), _params(min_score=2.0, top_k=8, neighbor_window=2, per_doc_max_chunks=3)).select("probe", "id", "document_id", "score", "position", "fallback")


def _pairs(spark, sf, measures, check=None, size=None):
    """``measures`` of every probe (its first ``size`` components) and every row."""
    e = table(spark, sf, "embeddings")
    x = F.col("embedding") if size is None else F.slice("embedding", 1, size)
    a = e.where(PROBES).select(F.col("vec_id").alias("a"), x.alias("probe_vector"))
    return products.every_pair(e.select(F.col("vec_id").alias("b"), F.col("embedding").alias("vector")), a, measures, check=check)


def vector_similarities(spark, sf):
    return _pairs(spark, sf, {"cosine": products.cosines, "dot": products.dots, "euclidean": products.distances, "by_name": products.by_name("DOT")}, products.same_size)


def cosine_truncated(spark, sf):
    return _pairs(spark, sf, {"truncated": lambda x, y: products.cosines(x, y, True), "zero": products.cosines}, size=40)


def l2_norms(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.round(V.norm(F.col("embedding")), 6).alias("norm"), F.size("embedding").alias("dimensions"))


def vector_text_codec(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", V.from_text(V.to_text(F.transform("embedding", lambda x: F.round(x.cast("double"), 3).cast("float")))).alias("v"))
    return e.select("vec_id", F.size("v").alias("n"), F.round(F.get("v", F.lit(0)).cast("double"), 3).alias("first"), F.round(V.norm(F.col("v")), 4).alias("norm"))


def vector_binary_codec(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "embedding", V.from_binary(V.to_binary("embedding")).alias("back"))
    return e.select("vec_id", (F.col("embedding") == F.col("back")).alias("same"))


def _similar_routes(spark, sf):
    e = table(spark, sf, "embeddings")
    queries = e.where(PROBES).select(F.col("vec_id").alias("query"), F.col("embedding").alias("query_vector"))
    examples = e.select(F.col("label").alias("route"), F.col("embedding").alias("vector"))
    return R.routes_by_similarity(queries, examples)


def semantic_route(spark, sf):
    return _similar_routes(spark, sf)


def semantic_margin(spark, sf):
    return R.decide_route(_similar_routes(spark, sf).withColumn("route", F.col("route").cast("string")), 0.3, 0.05)


def semantic_router(spark, sf):
    """Queries, some with knobs of their own, and some whose vector is missing."""
    e = table(spark, sf, "embeddings")
    vector = F.when(F.col("vec_id") % 60 != 20, F.col("embedding"))
    queries = e.where(PROBES).select(F.col("vec_id").alias("query"), vector.alias("query_vector"), F.when(F.col("vec_id") % 80 == 0, F.lit(1.1)).alias("threshold"), F.when(F.col("vec_id") % 100 == 0, F.lit(0.9)).alias("margin"))
    return R.semantic_router(queries, e.select(F.col("label").cast("string").alias("route"), F.col("embedding").alias("vector")), 0.3, 0.05)


def _plans_and_queries(spark, sf):
    """Every vector as a cached plan, and as a query of its own text: a third with the same vector, a third with a first value that leads to another bucket, a third with a text that no plan has."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    plans = e.select(F.col("id").alias("plan_id"), F.concat(F.lit("plan "), F.col("id").cast("string")).alias("text"), F.col("v").alias("vector"))
    kind = F.col("id") % 3
    moved = F.transform("v", lambda x, i: F.when((i == 0) & (kind > 0), (x + F.lit(0.25)).cast("float")).otherwise(x))
    queries = e.select(F.col("id").alias("query"), F.when(kind == 2, F.lit("unknown")).otherwise(F.concat(F.lit("plan "), F.col("id").cast("string"))).alias("text"), moved.alias("vector"))
    return plans, queries


def near_duplicate_cache(spark, sf):
    plans, queries = _plans_and_queries(spark, sf)
    return R.similar_plans(queries, plans)


def vector_rows(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), "lang", "source")
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    chunks = docs.join(e, "id").select("id", "content", "vector", F.create_map(F.lit("lang"), F.col("lang"), F.lit("kind"), F.lit("chunk")).alias("metadata"), F.create_map(F.lit("source"), F.col("source"), F.lit("kind"), F.lit("document")).alias("document_metadata"))
    out = S.vector_rows(chunks)
    meta = F.array_join(F.transform(F.array_sort(F.map_entries("metadata")), lambda x: F.concat(x["key"], F.lit("="), x["value"])), ";")
    return out.select("external_id", "vector_type", "dimensions", "index_name", F.round("vector_norm", 6).alias("vector_norm"), "content_summary", "space_type", "is_primary", meta.alias("metadata"))


QUERIES = {
    f.__name__: f
    for f in (
        knn_topk, knn_lists, knn_by_index, knn_join_context, doc_score_max, doc_score_mean_top2, rerank_full, rerank_threshold, rerank_fallback, vector_similarities, cosine_truncated, l2_norms, vector_text_codec,
        vector_binary_codec, semantic_route, semantic_margin, semantic_router, near_duplicate_cache, vector_rows,
    )
}

_COS = "coalesce(list_cosine_similarity({a}::double[], {b}::double[]), 0)"
_CAND = f"""
with p as (select vec_id as probe, embedding as v from embeddings where vec_id % 20 = 0),
s as (select probe, vec_id as id, vec_id // 5 as document_id, (vec_id % 5)::int as chunk_index, round({_COS.format(a="e.embedding", b="p.v")}, 6) as score from embeddings e, p),
c as (select *, row_number() over (partition by probe order by score desc, id)::int as rank from s)"""


#: A mean of scores of six decimals by whole numbers, so that equal means are equal.
_MEAN = "sum(round(score * 1000000)::bigint)::double / (count(*) * 1000000)"


def _rerank(source: str, width: int, top: int, window: int, per_doc: int, contexts: int, name: str) -> str:
    """CTEs of a re-ranking; the last is ``name``."""
    p = name
    return f"""
{p}_c as (select * from {source} where rank <= {width}),
{p}_n as (select *, row_number() over (partition by probe, document_id order by score desc, id) as anchor from {p}_c),
{p}_s as (select probe, document_id, {_MEAN} as doc_score from {p}_n where anchor <= 2 group by all),
{p}_d as (select *, row_number() over (partition by probe order by doc_score desc, document_id) as doc_rank from {p}_s),
{p}_a as (select n.*, d.doc_rank from {p}_n n join {p}_d d using (probe, document_id) where d.doc_rank <= {max(3, top)}),
{p}_v as (
  select a.probe, a.id, a.document_id, a.chunk_index, a.score, a.rank, a.doc_rank, min(b.anchor * 100 + abs(a.chunk_index - b.chunk_index) * 10 + case when a.chunk_index > b.chunk_index then 1 else 0 end) as visit
  from {p}_a a join {p}_a b on a.probe = b.probe and a.document_id = b.document_id and abs(a.chunk_index - b.chunk_index) <= {window} group by all),
{p}_p as (select *, row_number() over (partition by probe, document_id order by visit, id) as pick from {p}_v qualify pick <= {per_doc}),
{p}_b as (select probe, doc_rank, coalesce(sum(count(*)) over (partition by probe order by doc_rank rows between unbounded preceding and 1 preceding), 0) as before from {p}_p group by probe, doc_rank),
{p}_k as (
  select x.probe, x.id, x.document_id, x.chunk_index, x.score, x.rank, row_number() over (partition by x.probe order by x.score desc, x.id) as position
  from {p}_p x join {p}_b b using (probe, doc_rank) where b.before < {contexts} qualify position <= {contexts}),
{p}_z as (
  select c.probe, c.id, c.document_id, c.chunk_index, c.score, c.rank,
         row_number() over (partition by c.probe order by c.rank) + coalesce((select count(*) from {p}_k k where k.probe = c.probe), 0) as position
  from {p}_c c where not exists (select 1 from {p}_k k where k.probe = c.probe and k.id = c.id)),
{p} as (select * from {p}_k union all select * from {p}_z where position <= {top})"""


_PAIRS = "from embeddings y, (select * from embeddings where vec_id % 20 = 0) x"
_ROUTES = f"""
q as (select vec_id as query, embedding as v from embeddings where vec_id % 20 = 0),
r as (select label as route, embedding as v from embeddings),
m as (select query, route, round(greatest(0, max({_COS.format(a="q.v", b="r.v")})), 6) as similarity from q, r group by all)"""

ORACLES = {
    "knn_topk": _CAND + " select probe, id, score, rank from c where rank <= 20",
    "knn_lists": _CAND + " select probe, id, score, rank from c where rank <= 20",
    "knn_by_index": f"""
with p as (select * from embeddings where vec_id = 7)
select e.vec_id as id, e.label::varchar as index_name, round({_COS.format(a="e.embedding", b="p.embedding")}, 6) as score
from embeddings e, p where e.label = p.label order by score desc, id limit 10""",
    "knn_join_context": _CAND + """
select probe, id as chunk_id, document_id, chunk_index, source, lang, score from c join documents d on d.doc_id = c.document_id where rank <= 20""",
    "doc_score_max": _CAND + " select probe, document_id, max(score) as doc_score from c where rank <= 20 group by all",
    "doc_score_mean_top2": _CAND + """,
t as (select *, row_number() over (partition by probe, document_id order by score desc, id) as n from c where rank <= 20)
select probe, document_id, """ + _MEAN + """ as doc_score from t where n <= 2 group by all""",
    "rerank_full": _CAND + "," + _rerank("c", 20, 5, 1, 2, 6, "k") + " select probe, id, document_id, chunk_index, score, rank, position::int as position from k",
    "rerank_threshold": _CAND + "," + _rerank("c", 20, 5, 1, 2, 6, "k") + ", g as (select * from k where score >= 0.3), w as (select * from c where probe not in (select probe from g))," + _rerank("w", 40, 5, 1, 2, 6, "f") + """
select probe, id, document_id, score, position::int as position, false as fallback from g
union all select probe, id, document_id, score, position::int, true from f""",
    "rerank_fallback": _CAND + "," + _rerank("c", 32, 8, 2, 3, 6, "k") + ", g as (select * from k where score >= 2), w as (select * from c where probe not in (select probe from g))," + _rerank("w", 64, 8, 2, 3, 6, "f") + """
select probe, id, document_id, score, position::int as position, false as fallback from g
union all select probe, id, document_id, score, position::int, true from f""",
    "vector_similarities": f"""
select x.vec_id as a, y.vec_id as b, round({_COS.format(a="x.embedding", b="y.embedding")}, 6) as cosine, round(list_inner_product(x.embedding::double[], y.embedding::double[]), 6) as dot,
       round(list_distance(x.embedding::double[], y.embedding::double[]), 6) as euclidean, round(list_inner_product(x.embedding::double[], y.embedding::double[]), 6) as by_name {_PAIRS}""",
    "cosine_truncated": f"select x.vec_id as a, y.vec_id as b, round({_COS.format(a='x.embedding[1:40]', b='y.embedding[1:40]')}, 6) as truncated, 0.0::double as zero {_PAIRS}",
    "l2_norms": "select vec_id, round(sqrt(list_inner_product(embedding::double[], embedding::double[])), 6) as norm, len(embedding)::int as dimensions from embeddings",
    "vector_text_codec": """
with r as (select vec_id, list_transform(embedding, lambda x: round(x::double, 3)::float) as v from embeddings)
select vec_id, len(v)::int as n, round(v[1]::double, 3) as first, round(sqrt(list_inner_product(v::double[], v::double[])), 4) as norm from r""",
    "vector_binary_codec": "select vec_id, true as same from embeddings",
    "semantic_route": f"with {_ROUTES} select * from m",
    "semantic_margin": f"""
with {_ROUTES},
o as (select *, row_number() over w as place, coalesce(lead(similarity) over w, 0) as second from m window w as (partition by query order by similarity desc, route::varchar))
select query, case when similarity >= 0.3 and similarity - second >= 0.05 then route::varchar else 'BASIC' end as route, similarity, second from o where place = 1""",
    "semantic_router": f"""
with q as (select vec_id as query, case when vec_id % 60 != 20 then embedding end as v, case when vec_id % 80 = 0 then 1.1 else 0.3 end as threshold, case when vec_id % 100 = 0 then 0.9 else 0.05 end as margin
  from embeddings where vec_id % 20 = 0),
m as (select query, label::varchar as route, round(greatest(0, max({_COS.format(a="q.v", b="r.embedding")})), 6) as similarity from q, embeddings r where v is not null group by all),
o as (select *, row_number() over w as place, coalesce(lead(similarity) over w, 0) as second from m window w as (partition by query order by similarity desc, route))
select query, case when similarity >= threshold and similarity - second >= margin then route else 'BASIC' end as route, coalesce(similarity, 0)::double as similarity from q left join (select * from o where place = 1) using (query)""",
    "near_duplicate_cache": f"""
with p as (select vec_id as plan_id, 'plan ' || vec_id as text, embedding as v from embeddings),
q as (select vec_id as query, case when vec_id % 3 = 2 then 'unknown' else 'plan ' || vec_id end as text, list_transform(embedding, lambda x, i: case when i = 1 and vec_id % 3 > 0 then (x + 0.25)::float else x end) as v from embeddings),
pb as (select *, array_to_string(list_transform(v[1:5], lambda x: printf('%.2f', x::double)), '') as bucket from p),
qb as (select *, array_to_string(list_transform(v[1:5], lambda x: printf('%.2f', x::double)), '') as bucket from q),
s as (select query, plan_id, round({_COS.format(a="qb.v", b="pb.v")}, 6) as similarity, 'bucket' as how from qb join pb using (bucket)
  union all select query, plan_id, round({_COS.format(a="qb.v", b="pb.v")}, 6), 'text' from qb join pb on qb.text = pb.text where qb.bucket not in (select bucket from pb))
select * from s where similarity >= 0.95 qualify row_number() over (partition by query order by similarity desc, plan_id) = 1""",
    "vector_rows": """
select 'chunk-' || doc_id as external_id, 'CHUNK' as vector_type, len(embedding)::int as dimensions, 'default' as index_name,
       round(sqrt(list_inner_product(embedding::double[], embedding::double[])), 6) as vector_norm, case when length(text) > 100 then text[1:100] || '...' else text end as content_summary,
       'COSINE' as space_type, true as is_primary, 'kind=chunk;lang=' || lang || ';source=' || source as metadata
from documents join embeddings on doc_id = vec_id""",
}
