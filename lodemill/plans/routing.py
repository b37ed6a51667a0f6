"""Routing queries over ``conversations`` and ``labels``, and windows over ``events``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodemill.operators import routing as R
from lodemill.operators.rule_index import matches
from lodemill.sources.tables import table
from lodemill.streaming import ingest as I

#: Rules of these queries: id, type, content, task, processor, confidence, priority, active, mode, cascades.
RULE_ROWS = (
    (1, "KEYWORD", "the", "FAQ", "BASIC", 0.9, 10, True, None, None),
    (2, "KEYWORD", "tion", "ANALYSIS", "STEP_BACK", 0.8, 5, True, None, None),
    (3, "KEYWORD", "A", "COMPARISON", "MULTI_QUERY", 0.7, 5, True, "PREFIX", True),
    (4, "KEYWORD", ".", "CHAT", "BASIC", None, None, True, "SUFFIX", True),
    (5, "REGEX", "[0-9]+", "ORDER_LOOKUP", "BASIC", 0.95, 1, True, None, None),
    (6, "REGEX", "ou[a-z]*x", "FACT_LOOKUP", "DECOMPOSITION", 0.6, 3, True, None, False),
    (7, "KEYWORD", "never", "FAQ", "BASIC", 0.9, 0, False, None, None),
    (8, "REGEX", "^[A-Z]", "SUMMARIZATION", "BASIC", 0.5, 2, True, None, None),
    (9, "REGEX", "([", "FAQ", "BASIC", 0.99, 0, True, None, None),
)
RULES_SCHEMA = "id long, rule_type string, rule_content string, task_type string, target_processor string, confidence double, priority int, is_active boolean, match_mode string, allow_cascade boolean"
#: Words of these queries in place of the Chinese lists.
WORDS = {"HYDE": ("would", "wenn"), "MULTI_QUERY": ("all", "les"), "DECOMPOSITION": ("und", "thth"), "SELF_RAG": ("true", "eau")}
TOOLS = ("RAG_QUERY", "SEARCH", "AUTO")


def _sql(v) -> str:
    return "null" if v is None else f"'{v}'" if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else str(v)


def rules(spark: SparkSession) -> DataFrame:
    names = [c.split()[0] for c in RULES_SCHEMA.split(", ")]
    rows = spark.sql("select * from values " + ", ".join("(" + ", ".join(map(_sql, r)) + ")" for r in RULE_ROWS) + f" as t({', '.join(names)})")
    return rows.select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in RULES_SCHEMA.split(", ")])


def questions(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("query"), "text", "role")


def _rules_of_parts(spark, sf):
    """Parts as rules: size is the priority, every fourth one is not active."""
    p = table(spark, sf, "part")
    kind = F.element_at(F.array(*map(F.lit, ("KEYWORD", "REGEX", "SEMANTIC_EXAMPLE"))), F.col("p_size") % 3 + 1)
    return p.select(F.col("p_partkey").alias("id"), kind.alias("rule_type"), F.when(F.col("p_size") % 7 != 0, F.col("p_size")).alias("priority"), F.when(F.col("p_size") % 5 != 0, F.floor("p_retailprice") / 10_000).alias("confidence"), (F.col("p_partkey") % 4 != 0).alias("is_active"))


def rule_listing(spark, sf):
    return R.active_rules(_rules_of_parts(spark, sf)).select("id", "rule_type", "priority")


def rule_order(spark, sf):
    return R.ordered_rules(_rules_of_parts(spark, sf)).select("id", "rule_type", "seq")


def rule_matches(spark, sf):
    q, r = questions(spark, sf), rules(spark).where("is_active")
    return matches(q, r)


def _rules_of_words(spark, sf):
    """Every word of the documents as a rule: contained, at the start, at the end, or as a pattern of its ends, by its length."""
    w = table(spark, sf, "documents").select(F.explode(F.split("text", r"[^A-Za-z]+", -1)).alias("w")).where("w rlike '^[a-z]{4,}$'").distinct()
    kind = F.length("w") % 5
    content = F.when(kind == 4, F.concat(F.substring("w", 1, 3), F.lit("[a-z]*"), F.substring("w", -2, 2))).otherwise(F.col("w"))
    mode = F.when(kind == 0, "PREFIX").when(kind == 1, " suffix").when(kind == 2, "")
    return w.select(F.conv(F.substring(F.md5("w"), 1, 15), 16, 10).cast("long").alias("id"), F.when(kind == 4, "REGEX").otherwise("KEYWORD").alias("rule_type"), content.alias("rule_content"), mode.alias("match_mode"))


def rules_of_words(spark, sf):
    """How many of the documents' words fit each question as rules, and which is the first and last."""
    hits = matches(questions(spark, sf), _rules_of_words(spark, sf))
    return hits.groupBy("query").agg(F.count("*").alias("n"), F.min("rule_id").alias("first"), F.max("rule_id").alias("last"))


def rule_best(spark, sf):
    return R.detect_by_rules(questions(spark, sf), rules(spark))


def router_first_match(spark, sf):
    t = F.col("text")
    return questions(spark, sf).select("query", R.route_by_first_rule(t, WORDS).alias("route"), R.route_by_first_rule(t, WORDS, ("BASIC", "HYDE")).alias("limited"))


def router_scored(spark, sf):
    flags = {"multi_query": F.col("query") % 5 == 0, "step_back": F.col("query") % 7 == 0}
    explicit = F.when(F.col("query") % 11 == 0, " hyde ").when(F.col("query") % 13 == 0, "nothing")
    q = questions(spark, sf).select("query", R.route_by_score(F.col("text"), explicit, flags, WORDS).alias("r"))
    return q.select("query", "r.processor", F.round("r.confidence", 6).alias("confidence"))


def _intents(spark, sf):
    tasks = F.array(*map(F.lit, ("FAQ", "COMPARISON", "ANALYSIS", "TROUBLESHOOT", "DECISION_SUPPORT", "ORDER_LOOKUP", "CHAT")))
    l = table(spark, sf, "labels")
    return l.select("doc_id", F.element_at(tasks, (F.col("doc_id") % 7 + 1).cast("int")).alias("task"), F.when(F.col("doc_id") % 3 == 0, "HYDE").alias("suggested"), (F.col("quality") == 1).alias("locked"), (F.col("doc_id") % 10 == 0).alias("has_plan"), (F.col("toxic") == 1).alias("multi_step"))


def strategy_map(spark, sf):
    i = _intents(spark, sf)
    s = R.strategy(F.col("task"), F.col("suggested"), F.col("locked"), F.col("has_plan"), F.col("multi_step"))
    return i.select("doc_id", s.alias("s")).select("doc_id", "s.*")


def downgrade(spark, sf):
    l = table(spark, sf, "labels")
    faith = F.when(F.col("doc_id") % 4 != 0, (F.col("doc_id") % 11).cast("int"))
    return l.select("doc_id", R.downgrade(F.lit("HYDE"), F.col("quality") == 1, faith, F.lit(7), F.lit(0.85), F.lit(0.6), F.lit(True)).alias("processor"))


def tool_fallback(spark, sf):
    l = questions(spark, sf).withColumn("tool", F.element_at(F.array(*map(F.lit, ("RAG_QUERY", "SEARCH", "AUTO"))), (F.col("query") % 3 + 1).cast("int")))
    q = F.substring("text", 1, 12)
    a = R.after_failure(F.col("tool"), (F.col("query") % 4).cast("int"), q, F.col("role") == "system", TOOLS)
    alone = R.after_failure(F.lit("RAG_QUERY"), F.lit(2), F.when(F.col("query") % 2 == 0, F.substring("text", 1, 4)).otherwise(q), F.lit(False), ("RAG_QUERY",))
    empty = R.after_nothing(F.col("tool"), q, F.lit(False), ("RAG_QUERY",))
    return l.select("query", a["action"].alias("action"), a["tool"].alias("next"), alone["action"].alias("alone"), empty["action"].alias("empty"), empty["tool"].alias("empty_next"))


def detector_cascade(spark, sf):
    q = questions(spark, sf)
    by_rule = R.detect_by_rules(q, rules(spark)).select("query", F.lit("rules").alias("detector"), F.lit(-100).alias("sort"), "confidence", (F.col("rule_id") % 2 == 0).alias("cascades"), F.lit(False).alias("clarify"))
    other = q.where(F.contains("text", F.lit("ing"))).select("query", F.lit("semantic"), F.lit(-50), F.round(F.length("text") % 100 / 100.0, 2), F.lit(False), F.lit(False))
    plan = q.where(F.contains("text", F.lit("eau"))).select("query", F.lit("planner"), F.lit(100), F.lit(0.72), F.lit(False), F.length("text") < 60)
    out = R.cascade(by_rule.union(other).union(plan))
    return out.select("query", "detector", "confidence", "decided")


def planner_intents(spark, sf):
    e = table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query"), "text")
    plan = F.when(F.col("query") % 3 == 0, F.lit('{"taskType":"faq","tasks":[]}')).when(F.col("query") % 3 == 1, F.lit('{"taskType":"analysis","tasks":[{"step":1,"dependencies":[]}]}'))
    i = R.planner_intent(F.substring("text", 1, 9), plan, F.col("query") % 6 == 1)
    return e.select("query", i.alias("i")).where("i is not null").select("query", "i.task_type", "i.confidence", "i.multi_step", "i.clarify", "i.target_processor")


def planner_cached(spark, sf):
    """A planner that has the plans of some queries in its cache, and no answer for others."""
    q = questions(spark, sf).select("query", "text", F.length("text").alias("n"))
    steps = F.lit('{"taskType":"analysis","tasks":[{"step":1,"dependencies":[]}]}')
    plans = q.select("query", F.when(F.col("n") % 4 == 0, F.lit("no json")).when(F.col("n") % 4 == 1, steps).otherwise(F.lit('{"tasks":[]}')).alias("plan"))
    cached = q.where("n % 7 = 0").select("query", steps.alias("plan"))
    return R.planned_intents(q, plans, cached, 40)


def fallback_intents(spark, sf):
    i = R.fallback_intent(F.col("text"))
    return questions(spark, sf).select("query", i.alias("i")).select("query", "i.task_type", "i.confidence", "i.complexity")


def evaluation_parse(spark, sf):
    l = table(spark, sf, "labels")
    answer = F.when(F.col("doc_id") % 3 == 0, "no json").otherwise(F.concat(F.lit('{"faithfulness":'), F.col("quality").cast("string"), F.lit(',"total":7,"reasoning":"r"}')))
    s = R.evaluation_scores(answer)
    return l.select("doc_id", s["faithfulness"].alias("faithfulness"), s["fluency"].alias("fluency"), s["total"].alias("total"))


def context_merge(spark, sf):
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("probe"), F.col("turn").alias("position"), F.col("text").alias("content"))
    return R.context_text(c).select("probe", F.sha2("context", 256).alias("digest"))


def hourly_events(spark, sf):
    out = I.windowed_counts(table(spark, sf, "events"), "1 day")
    return out.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round(F.col("mean_value") * F.col("n"), 2).alias("total_value"))


def user_sessions(spark, sf):
    out = I.sessions(table(spark, sf, "events"), "12 hours")
    return out.select("user_id", F.unix_seconds("session_start").alias("start"), "n")


QUERIES = {
    f.__name__: f
    for f in (
        rule_listing, rule_order, rule_matches, rules_of_words, rule_best, router_first_match, router_scored, strategy_map, downgrade, tool_fallback, detector_cascade, planner_intents, planner_cached, fallback_intents, evaluation_parse,
        context_merge, hourly_events, user_sessions,
    )
}

_R = "r as (select * from (values " + ", ".join("(" + ", ".join(map(_sql, r)) + ")" for r in RULE_ROWS) + ") t(id, rule_type, rule_content, task_type, target_processor, confidence, priority, is_active, match_mode, allow_cascade))"
_PARTS = """r as (select p_partkey as id, ['KEYWORD', 'REGEX', 'SEMANTIC_EXAMPLE'][p_size % 3 + 1] as rule_type, case when p_size % 7 != 0 then p_size end as priority,
  case when p_size % 5 != 0 then floor(p_retailprice) / 10000 end as confidence, p_partkey % 4 != 0 as is_active from part)"""
_Q = "q as (select conv_id * 1000 + turn as query, text, role from conversations)"
_HIT = """case when rule_content = '([' then false when rule_type = 'REGEX' then regexp_matches(trim(text, ' '), rule_content) when match_mode = 'PREFIX' then starts_with(trim(text, ' '), rule_content) when match_mode = 'SUFFIX' then ends_with(trim(text, ' '), rule_content)
  else contains(trim(text, ' '), rule_content) end"""
_BEST = f"""{_R}, {_Q},
o as (select *, row_number() over (partition by rule_type order by priority asc nulls last, coalesce(confidence, 0) desc, id) as seq from r where is_active),
h as (select query, o.*, (rule_type = 'REGEX')::int as stage from q, o where {_HIT}),
s as (select *, min(seq) filter (allow_cascade = false) over (partition by query, stage) as stop from h),
t as (select * from s where stop is null or seq = stop qualify row_number() over (partition by query, stage order by priority asc nulls last, coalesce(confidence, 0) desc, seq) = 1),
u as (select *, max(case when stage = 0 and not coalesce(allow_cascade, false) then 1 end) over (partition by query) as closed from t),
b as (select * from u where closed is null or stage = 0
  qualify row_number() over (partition by query order by (stop is not null and stage = 1) desc, priority asc nulls last, coalesce(confidence, 0) desc, stage) = 1)"""
_LIKE = lambda ws: "(" + " or ".join(f"contains(low, '{w}')" for w in ws) + ")"
_TASK = "['FAQ', 'COMPARISON', 'ANALYSIS', 'TROUBLESHOOT', 'DECISION_SUPPORT', 'ORDER_LOOKUP', 'CHAT'][doc_id % 7 + 1]"

ORACLES = {
    "rule_listing": f"with {_PARTS} select id, rule_type, priority from r where is_active",
    "rule_order": f"with {_PARTS} select id, rule_type, (row_number() over (partition by rule_type order by priority asc nulls last, coalesce(confidence, 0) desc, id))::int as seq from r where is_active",
    "rules_of_words": f"""
with {_Q}, w as (select distinct unnest(regexp_split_to_array(text, '[^A-Za-z]+')) as w from documents),
r as (select ('0x' || md5(w)[1:15])::bigint as id, length(w) % 5 as kind, w from w where regexp_matches(w, '^[a-z]{{4,}}$')),
h as (select query, id from (select query, trim(text, ' ') as t from q) q, r where case kind when 0 then starts_with(t, w) when 1 then ends_with(t, w) when 4 then regexp_matches(t, w[1:3] || '[a-z]*' || w[-2:]) else contains(t, w) end)
select query, count(*) as n, min(id) as first, max(id) as last from h group by 1""",
    "rule_matches": f"with {_R}, {_Q} select query, id::bigint as rule_id from q, r where is_active and {_HIT}",
    "rule_best": f"with {_BEST} select query, id::bigint as rule_id, task_type, target_processor, coalesce(confidence, 0.8)::double as confidence, case when stage = 1 then 'REGEX' else 'KEYWORD' end as stage from b",
    "router_first_match": f"""with {_Q}, k as (select query, text, lower(text) as low from q)
select query, case when {_LIKE(WORDS["HYDE"])} then 'HYDE' when {_LIKE(WORDS["MULTI_QUERY"])} then 'MULTI_QUERY' when {_LIKE(WORDS["DECOMPOSITION"])} then 'DECOMPOSITION' when {_LIKE(WORDS["SELF_RAG"])} then 'SELF_RAG'
  when length(text) > 100 then 'STEP_BACK' else 'BASIC' end as route, case when {_LIKE(WORDS["HYDE"])} then 'HYDE' else 'BASIC' end as limited from k""",
    "router_scored": f"""with {_Q}, k as (select query, lower(text) as low from q),
s as (select query, unnest(['BASIC', 'MULTI_QUERY', 'DECOMPOSITION', 'HYDE', 'STEP_BACK', 'SELF_RAG']) as kind, unnest([1, 2, 3, 4, 5, 6]) as place, unnest([0.10::double,
  case when {_LIKE(WORDS["MULTI_QUERY"])} then 0.30 else 0 end + case when query % 5 = 0 then 0.35 else 0 end, case when {_LIKE(WORDS["DECOMPOSITION"])} then 0.25 else 0 end, case when {_LIKE(WORDS["HYDE"])} then 0.35 else 0 end,
  case when length(low) > 120 then 0.20 else 0 end + case when query % 7 = 0 then 0.30 else 0 end, case when {_LIKE(WORDS["SELF_RAG"])} then 0.20 else 0 end]) as score from k),
b as (select * from s qualify row_number() over (partition by query order by score desc, place) = 1)
select query, case when query % 11 = 0 then 'HYDE' else kind end as processor, round(least(1.0::double, score), 6) as confidence from b""",
    "strategy_map": f"""
with i as (select doc_id, {_TASK} as task, case when doc_id % 3 = 0 then 'HYDE' end as suggested, quality = 1 as locked, doc_id % 10 = 0 as has_plan, toxic = 1 as multi_step from labels),
k as (select *, task in ('ANALYSIS', 'DECISION_SUPPORT', 'ORDER_LOOKUP') as evaluate from i)
select doc_id, case when has_plan then 'RAG_FUSION' when suggested is not null then suggested when task = 'COMPARISON' then 'MULTI_QUERY' when task in ('ANALYSIS', 'DECISION_SUPPORT') then 'STEP_BACK' when task = 'TROUBLESHOOT' then 'DECOMPOSITION' else 'BASIC' end as processor,
  task = 'COMPARISON' as multi_query, task = 'ANALYSIS' as step_back, case when task in ('COMPARISON', 'DECISION_SUPPORT') then true when task = 'FAQ' then false else multi_step end as hybrid,
  case when task = 'DECISION_SUPPORT' then 0.2 else 0.1 end::double as temperature, task != 'CHAT' as citations, evaluate, case when evaluate then 0.85 else 0.6 end::double as min_faithfulness, 0.6::double as min_relevance, case when evaluate then 1 else 0 end as max_retry from k""",
    "downgrade": "select doc_id, case when quality = 1 and doc_id % 4 != 0 and (doc_id % 11) / 10.0::double < 0.85 then 'BASIC' else 'HYDE' end as processor from labels",
    "tool_fallback": f"""with {_Q}, k as (select *, ['RAG_QUERY', 'SEARCH', 'AUTO'][query % 3 + 1] as tool from q),
f as (select *, case when tool = 'RAG_QUERY' then 'SEARCH' else 'RAG_QUERY' end as other from k)
select query, case when query % 4 < 2 then 'RETRY' else 'SWITCH_TOOL' end as action, case when query % 4 < 2 then tool else other end as next,
  case when length(trim(case when query % 2 = 0 then text[1:4] else text[1:12] end, ' ')) < 10 then 'CLARIFY' else 'ABORT' end as alone,
  case when tool != 'RAG_QUERY' then 'SWITCH_TOOL' when length(trim(text[1:12], ' ')) < 10 then 'CLARIFY' else 'ABORT' end as empty, case when tool != 'RAG_QUERY' then 'RAG_QUERY' end as empty_next from f""",
    "detector_cascade": f"""with {_BEST},
d as (select query, 'rules' as detector, -100 as sort, coalesce(confidence, 0.8)::double as confidence, id % 2 = 0 as cascades, false as clarify from b
  union all select query, 'semantic', -50, round((length(text) % 100) / 100.0::double, 2), false, false from q where contains(text, 'ing')
  union all select query, 'planner', 100, 0.72::double, false, length(text) < 60 from q where contains(text, 'eau')),
e as (select *, (confidence >= 0.65 and not cascades) or clarify as decided from d)
select query, detector, confidence, decided from e qualify row_number() over (partition by query order by decided desc, case when decided then sort end, confidence desc, sort) = 1""",
    "planner_intents": f"""with {_Q}
select query, case when query % 3 = 0 then 'FAQ' else 'ANALYSIS' end as task_type, case when query % 6 = 1 then 0.85 else 0.72 end::double as confidence, query % 3 = 1 as multi_step, true as clarify,
  case when query % 3 = 0 then 'BASIC' else 'RAG_FUSION' end as target_processor from q where query % 3 != 2""",
    "planner_cached": f"""with {_Q}, n as (select query, length(text) as n, length(trim(text, ' ')) < 40 as short from q),
c as (select *, n % 7 = 0 as cached, n % 7 = 0 or n % 4 = 1 as multi_step from n)
select query, case when multi_step then 'ANALYSIS' else 'UNKNOWN' end as task_type, case when cached then 0.85 when short then 0.72 else 0.88 end::double as confidence, multi_step, short or not multi_step as clarify,
  case when multi_step then 'RAG_FUSION' else 'BASIC' end as target_processor from c where cached or n % 4 != 0""",
    "fallback_intents": f"with {_Q} select query, 'UNKNOWN' as task_type, 0.3::double as confidence, case when length(text) > 120 then 'HIGH' else 'MEDIUM' end as complexity from q",
    "evaluation_parse": "select doc_id, case when doc_id % 3 = 0 then 5 else quality end::int as faithfulness, 5 as fluency, case when doc_id % 3 = 0 then 5 else 7 end as total from labels",
    "context_merge": "select conv_id as probe, sha256(string_agg(text, chr(10) || chr(10) order by turn, text)) as digest from conversations group by 1",
    "hourly_events": "select strftime(ts, '%Y-%m-%d') as day, event_type, count(*) as n, round(sum(value), 2) as total_value from events group by all",
    "user_sessions": """
with e as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 12 hours then 0 else 1 end as new from events),
s as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) as k from e)
select user_id, floor(epoch(min(ts)))::bigint as start, count(*) as n from s group by user_id, k""",
}
