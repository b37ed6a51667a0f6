"""Which processor answers a query: rules, examples, a cascade of detectors, strategies and fallbacks.

Rules and word lists are small tables or parameters; queries are a column, so a batch of queries is decided in one plan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodemill.operators.rule_index import compiles, is_pattern, matches

#: Kinds of processors in the order that decides ties, and the word lists of the rule router.
PROCESSORS = ("BASIC", "MULTI_QUERY", "DECOMPOSITION", "HYDE", "STEP_BACK", "SELF_RAG", "ADAPTIVE_RAG", "RAG_FUSION")
MULTI_QUERY_WORDS = ("比较", "对比", "不同", "区别", "多个", "列举", "枚举", "所有", "哪些", "列出")
DECOMPOSITION_WORDS = ("详细解释", "深入分析", "分步", "逐步", "从多方面", "全面", "综合", "详细描述")
SELF_RAG_WORDS = ("准确", "精确", "权威", "可靠", "专业", "事实", "科学", "验证")
HYDE_WORDS = ("假设", "假如", "如果", "设想", "想象", "理论上")
WORDS = {"HYDE": HYDE_WORDS, "MULTI_QUERY": MULTI_QUERY_WORDS, "DECOMPOSITION": DECOMPOSITION_WORDS, "SELF_RAG": SELF_RAG_WORDS}

#: Columns of a rules table beside what the store has; null ones behave as if they were not there.
RULES = "id long, rule_type string, rule_content string, task_type string, topic_domain string, target_processor string, confidence double, priority int, is_active boolean, match_mode string, allow_cascade boolean"


def active_rules(rules: DataFrame, rule_type: str | None = None) -> DataFrame:
    """Active rules, larger priority first, for listings."""
    own = rules.where("is_active")
    return (own if rule_type is None else own.where(F.col("rule_type") == rule_type)).orderBy(F.desc("priority"), "id")


def ordered_rules(rules: DataFrame) -> DataFrame:
    """Active rules with their place in their type: smaller priority first (none last), then larger confidence."""
    order = Window.partitionBy("rule_type").orderBy(F.asc_nulls_last("priority"), F.desc(F.coalesce("confidence", F.lit(0.0))), "id")
    return rules.where("is_active").withColumn("seq", F.row_number().over(order))


def with_valid_patterns(rules: DataFrame) -> DataFrame:
    """``rules`` without the content of those whose pattern is none, so that they match nothing; patterns are tried where the rules are."""
    pattern = is_pattern(F.col("rule_type"), F.col("match_mode"))
    return rules.withColumn("rule_content", F.when(~pattern | compiles(F.when(pattern, F.col("rule_content"))), F.col("rule_content")))


def rule_matches(text: Column, content: Column, rule_type: Column, mode: Column) -> Column:
    """Whether a rule fits: keywords are contained unless a mode says otherwise; rules that are patterns are searched.

    Patterns are to be valid (``with_valid_patterns``); a rule without content fits nothing.
    """
    m = F.upper(F.coalesce(F.nullif(F.trim(mode), F.lit("")), F.lit("CONTAINS")))
    pattern = is_pattern(rule_type, mode)
    plain = F.when(m == "EXACT", text == content).when(m == "PREFIX", F.startswith(text, content)).when(m == "SUFFIX", F.endswith(text, content)).otherwise(F.contains(text, content))
    fits = F.when(pattern, F.regexp_like(text, F.when(pattern, content).otherwise(F.lit("$^")))).otherwise(plain)
    return F.coalesce((F.trim(content) != "") & fits, F.lit(False))


def detect_by_rules(queries: DataFrame, rules: DataFrame, query: str = "query", text: str = "text") -> DataFrame:
    """The best rule of each query that one fits: ``query``, ``rule_id``, ``task_type``, ``target_processor``, ``confidence``, ``stage``.

    Keyword rules go first; a hit keeps pattern rules from being asked, unless its rule cascades. Among rules of a stage
    the smaller priority wins, then the larger confidence, then the first; a rule that forbids cascading ends the stage
    where it stands in the list. One whose pattern is none matches nothing. Which rules fit is asked of all together (``rule_index.matches``).
    """
    r = ordered_rules(rules).where(F.col("rule_type").isin("KEYWORD", "REGEX"))
    hits = matches(queries, r, query, text)
    r = r.select(F.col("id").cast("long").alias("rule_id"), "rule_type", "match_mode", "allow_cascade", "task_type", "target_processor", "confidence", "priority", "seq")
    hits = hits.join(r, "rule_id").withColumn("stage", (F.col("rule_type") == "REGEX").cast("int"))
    stage = Window.partitionBy("query", "stage")
    hits = hits.withColumn("stop", F.min(F.when(~F.col("allow_cascade"), F.col("seq"))).over(stage))
    hits = hits.where(F.col("stop").isNull() | (F.col("seq") == F.col("stop")))
    rank = F.row_number().over(stage.orderBy(F.asc_nulls_last("priority"), F.desc(F.coalesce("confidence", F.lit(0.0))), "seq"))
    best = hits.withColumn("place", rank).where("place = 1")
    every = Window.partitionBy("query")
    closed = F.max(F.when((F.col("stage") == 0) & ~F.coalesce("allow_cascade", F.lit(False)), 1)).over(every)
    best = best.withColumn("closed", closed).where(F.col("closed").isNull() | (F.col("stage") == 0))
    # a later stage replaces a cascading keyword hit if it stops the scan or is better
    final = Window.partitionBy("query").orderBy(F.desc(F.col("stop").isNotNull() & (F.col("stage") == 1)), F.asc_nulls_last("priority"), F.desc(F.coalesce("confidence", F.lit(0.0))), "stage")
    best = best.withColumn("place", F.row_number().over(final)).where("place = 1")
    return best.select("query", "rule_id", "task_type", "target_processor", F.coalesce("confidence", F.lit(0.8)).alias("confidence"), F.when(F.col("stage") == 1, "REGEX").otherwise("KEYWORD").alias("stage"))


def with_route(examples: DataFrame) -> DataFrame:
    """Examples with their route: the rule's own key, else its task type."""
    return examples.withColumn("route", F.coalesce(F.when(F.trim("route_key") != "", F.col("route_key")), F.col("task_type")))


def semantic_routes(examples: DataFrame) -> DataFrame:
    """Routes of examples, and what each one's first rule says."""
    return with_route(examples).groupBy("route").agg(F.min_by("threshold", "id").alias("threshold"), F.min_by("target_processor", "id").alias("target_processor"))


def detect_by_examples(similarities: DataFrame, routes: DataFrame, threshold: float = 0.8) -> DataFrame:
    """The best route of each query, where it reaches the route's own threshold or the common one."""
    order = Window.partitionBy("query").orderBy(F.desc("similarity"), "route")
    best = similarities.withColumn("place", F.row_number().over(order)).where("place = 1").drop("place")
    joined = best.join(routes.select("route", "threshold", "target_processor"), "route")
    return joined.where(F.col("similarity") >= F.coalesce("threshold", F.lit(threshold))).select("query", "route", "target_processor", F.col("similarity").alias("confidence"))


PLAN = "struct<taskType:string,domain:string,summary:string,tasks:array<struct<step:int,description:string,dependencies:array<int>>>>"


def planner_intent(text: Column, plan: Column, cached: Column, short: int = 10) -> Column:
    """What a planner's answer (JSON) says: task type, confidence, whether it has steps and whether to ask back; null if it is none."""
    p = F.when(F.startswith(F.ltrim(F.get_json_object(plan, "$")), F.lit("{")), F.from_json(plan, PLAN))  # null where it cannot be read
    is_short = F.length(F.regexp_replace(text, r"^\s+|\s+$", "")) < short
    steps = F.coalesce(F.size(p["tasks"]) > 0, F.lit(False))
    confidence = F.when(cached, 0.85).when(is_short, 0.72).otherwise(0.88)
    processor = F.when(steps, "RAG_FUSION").otherwise("BASIC")
    return F.when((F.trim(text) != "") & p.isNotNull(), F.struct(F.coalesce(F.upper(p["taskType"]), F.lit("UNKNOWN")).alias("task_type"), confidence.alias("confidence"), steps.alias("multi_step"), (is_short | ~steps).alias("clarify"), processor.alias("target_processor")))


def fallback_intent(text: Column) -> Column:
    """What holds where no detector knows better: ask back."""
    complexity = F.when(F.length(text) > 120, "HIGH").otherwise("MEDIUM")
    return F.struct(F.lit("UNKNOWN").alias("task_type"), F.lit("BASIC").alias("target_processor"), F.lit(0.3).alias("confidence"), F.lit(True).alias("clarify"), complexity.alias("complexity"))


def cascade(results: DataFrame, threshold: float = 0.65) -> DataFrame:
    """The detector that decides each query, from ``results(query, detector, sort, confidence, cascades, clarify)``.

    The first in order that is sure and does not cascade, or that wants to ask back; else the surest, the first of equals.
    """
    decides = ((F.col("confidence") >= threshold) & ~F.coalesce("cascades", F.lit(False))) | F.coalesce("clarify", F.lit(False))
    order = Window.partitionBy("query").orderBy(F.desc(decides), F.when(decides, F.col("sort")), F.desc("confidence"), "sort")
    return results.withColumn("decided", decides).withColumn("place", F.row_number().over(order)).where("place = 1").drop("place")


def trace(results: DataFrame, threshold: float = 0.65) -> DataFrame:
    """What each detector said, in order, why, and how long it took, and which one decided: a row for each query.

    ``results`` is as for ``cascade``, with ``reason`` and ``latency_ms`` where detectors give them.
    """
    for name, kind in (("cascades", "boolean"), ("clarify", "boolean"), ("reason", "string"), ("latency_ms", "long")):
        if name not in results.columns:
            results = results.withColumn(name, F.lit(None).cast(kind))
    each = F.struct("sort", "detector", F.coalesce(F.col("confidence") > 0, F.lit(False)).alias("matched"), "confidence", "reason", "latency_ms")
    every = results.groupBy("query").agg(F.sort_array(F.collect_list(each)).alias("detectors"), F.sum("latency_ms").alias("latency_ms"))
    chosen = cascade(results, threshold).select("query", F.col("detector").alias("chosen"))
    return every.join(chosen, "query", "left")


def planned_intents(queries: DataFrame, plans: DataFrame, cached: DataFrame, short: int = 10) -> DataFrame:
    """``query`` and the intent of a planner that asks its cache first: ``queries(query, text)``, fresh ``plans(query, plan)`` and ``cached(query, plan)``."""
    joined = queries.join(cached.select("query", F.col("plan").alias("_known")), "query", "left").join(plans.select("query", F.col("plan").alias("_fresh")), "query", "left")
    intent = planner_intent(F.col("text"), F.coalesce("_known", "_fresh"), F.col("_known").isNotNull(), short)
    return joined.select("query", intent.alias("i")).where("i is not null").select("query", "i.*")


def strategy(task: Column, suggested: Column, locked: Column, has_plan: Column, multi_step: Column) -> Column:
    """Processor and the knobs of retrieval, generation and evaluation for an intent."""
    by_task = F.when(task == "COMPARISON", "MULTI_QUERY").when(task.isin("ANALYSIS", "DECISION_SUPPORT"), "STEP_BACK").when(task == "TROUBLESHOOT", "DECOMPOSITION").otherwise("BASIC")
    strict = F.coalesce(task.isin("ANALYSIS", "DECISION_SUPPORT", "ORDER_LOOKUP"), F.lit(False))
    hybrid = F.when(task.isin("COMPARISON", "DECISION_SUPPORT"), True).when(task.isin("FAQ", "FACT_LOOKUP"), False).otherwise(multi_step)
    return F.struct(
        F.when(has_plan, "RAG_FUSION").when(locked & suggested.isNotNull(), suggested).otherwise(F.coalesce(suggested, by_task)).alias("processor"),
        (task == "COMPARISON").alias("multi_query"),
        (task == "ANALYSIS").alias("step_back"),
        hybrid.alias("hybrid"),
        F.when(task == "DECISION_SUPPORT", 0.2).otherwise(0.1).alias("temperature"),
        (task != "CHAT").alias("citations"),
        strict.alias("evaluate"),
        F.when(strict, 0.85).otherwise(0.6).alias("min_faithfulness"),
        F.lit(0.6).alias("min_relevance"),
        F.when(strict, 1).otherwise(0).alias("max_retry"),
    )


def downgrade(processor: Column, evaluate: Column, faithfulness: Column, relevance: Column, min_faithfulness: Column, min_relevance: Column, retry: Column) -> Column:
    """The processor of the next try: BASIC if scores (of ten) fall short and a retry is allowed."""
    low = (faithfulness / 10 < min_faithfulness) | (relevance / 10 < min_relevance)
    return F.when(F.coalesce(evaluate & retry & low & faithfulness.isNotNull() & relevance.isNotNull(), F.lit(False)), "BASIC").otherwise(processor)


def _any_word(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(Column.__or__, (F.contains(text, F.lit(w.lower())) for w in words))


def route_by_first_rule(text: Column, words: dict[str, tuple[str, ...]] | None = None, available: tuple[str, ...] = PROCESSORS, long: int = 100) -> Column:
    """The first rule that fits, in the order of ``words``; then length; BASIC where a processor is not available."""
    low, out = F.lower(text), F.when(F.lit(False), F.lit(""))
    for kind, own in (words or WORDS).items():
        out = out.when(_any_word(low, own), kind if kind in available else "BASIC")
    return out.when(F.length(text) > long, "STEP_BACK" if "STEP_BACK" in available else "BASIC").otherwise("BASIC")


def route_by_score(text: Column, explicit: Column | None = None, flags: dict[str, Column] | None = None, words: dict[str, tuple[str, ...]] | None = None, available: tuple[str, ...] = PROCESSORS) -> Column:
    """``processor`` and ``confidence``: the largest sum of what fits; an explicit and available one goes before."""
    low, w, flags = F.lower(F.coalesce(text, F.lit(""))), words or WORDS, flags or {}
    on = lambda c, x: F.when(F.coalesce(c, F.lit(False)), x).otherwise(0.0)
    flag = lambda name, x: on(flags.get(name, F.lit(False)), x)
    scores = {k: F.lit(0.0) for k in PROCESSORS} | {
        "BASIC": F.lit(0.10),
        "MULTI_QUERY": on(_any_word(low, w["MULTI_QUERY"]), 0.30) + flag("multi_query", 0.35),
        "DECOMPOSITION": on(_any_word(low, w["DECOMPOSITION"]), 0.25),
        "HYDE": on(_any_word(low, w["HYDE"]), 0.35) + flag("hyde", 0.35),
        "STEP_BACK": on(F.length(low) > 120, 0.20) + flag("step_back", 0.30),
        "SELF_RAG": on(_any_word(low, w["SELF_RAG"]), 0.20) + flag("self_rag", 0.30),
    }
    ranked = F.array_max(F.array(*[F.struct(scores[k].alias("score"), F.lit(-i).alias("place"), F.lit(k).alias("kind")) for i, k in enumerate(PROCESSORS) if k in available]))
    named = F.upper(F.trim(explicit)) if explicit is not None else F.lit(None).cast("string")
    chosen = F.when(named.isin(*available), named).otherwise(ranked["kind"])
    return F.struct(chosen.alias("processor"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), ranked["score"])).alias("confidence"))


def fallback_tool(tool: Column, tools: tuple[str, ...], prefer_rag: bool = True) -> Column:
    """The tool to try in place of one that failed; null if there is none."""
    spare = F.filter(F.array(*map(F.lit, tools)) if tools else F.array().cast("array<string>"), lambda t: (t != tool) & (t != "AUTO"))
    rag = F.lit(bool(prefer_rag and "RAG_QUERY" in tools))
    return F.when(F.size(spare) > 0, F.when((tool != "RAG_QUERY") & rag, "RAG_QUERY").otherwise(F.get(spare, F.lit(0))))


def after_failure(tool: Column, attempts: Column, question: Column, clarify: Column, tools: tuple[str, ...], retries: int = 2, may_ask: bool = True) -> Column:
    """``action`` (RETRY, SWITCH_TOOL, CLARIFY or ABORT) and the next ``tool`` after a tool has failed ``attempts`` times."""
    return _ladder(F.when(attempts < retries, "RETRY"), tool, question, clarify, tools, may_ask)


def after_nothing(tool: Column, question: Column, clarify: Column, tools: tuple[str, ...], may_ask: bool = True) -> Column:
    """The same after a tool has found nothing: it is not tried again."""
    return _ladder(F.when(F.lit(False), "RETRY"), tool, question, clarify, tools, may_ask)


def _ladder(first: Column, tool: Column, question: Column, clarify: Column, tools: tuple[str, ...], may_ask: bool) -> Column:
    other = fallback_tool(tool, tools)
    vague = F.coalesce(F.length(F.trim(question)) < 10, F.lit(True)) | F.coalesce(clarify, F.lit(False))
    action = first.when(other.isNotNull(), "SWITCH_TOOL").when(F.lit(may_ask) & vague, "CLARIFY").otherwise("ABORT")
    return F.struct(action.alias("action"), F.when(action == "SWITCH_TOOL", other).when(action == "RETRY", tool).alias("tool"))


SCORES = ("faithfulness", "relevance", "coherence", "fluency", "conciseness", "helpfulness")


def evaluation_scores(answer: Column) -> Column:
    """Six scores, a total and the reasoning of a judge's JSON; 5 for each that is missing or if it is none."""
    p = F.from_json(answer, "struct<" + ",".join(f"{s}:int" for s in SCORES) + ",total:int,reasoning:string>")
    return F.struct(*[F.coalesce(p[s], F.lit(5)).alias(s) for s in (*SCORES, "total")], p["reasoning"].alias("reasoning"))


def context_text(contexts: DataFrame, probe: str = "probe", content: str = "content", order: str = "position") -> DataFrame:
    """The contexts of each probe as one text, apart by blank lines."""
    return contexts.groupBy(probe).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, content))), lambda x: x[content]), "\n\n").alias("context"))
