"""Clients, models, interfaces, tools and prompts as a small graph: edges with a status, walked by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def linked(edges: DataFrame, sources: DataFrame, source_type: str, target_type: str, enabled: bool = True) -> DataFrame:
    """``client``, ``id``, ``order`` of the targets of ``sources(client, id)`` over edges of such a kind."""
    e = edges.where((F.col("source_type") == source_type) & (F.col("target_type") == target_type))
    e = (e.where("status = 1") if enabled else e).select(F.col("source_id").alias("_from"), F.col("target_id").alias("_to"), F.col("id").alias("order"))
    return sources.join(e, F.col("id") == F.col("_from")).select("client", F.col("_to").alias("id"), "order")


def clients(ids: DataFrame) -> DataFrame:
    return ids.select(F.col("client_id").alias("client"), F.col("client_id").alias("id"))


def first_of_each(found: DataFrame) -> DataFrame:
    """Each target once, where it is met first: by client, then by edge."""
    return found.withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy("client", "order"))).where("_n = 1").drop("_n")


def models_of(edges: DataFrame, models: DataFrame, ids: DataFrame) -> DataFrame:
    """Enabled models of clients, each once, with the tools that it is linked to."""
    found = first_of_each(linked(edges, clients(ids), "client", "model")).join(models.where("status = 1"), F.col("id") == F.col("model_id")).drop("status")
    own = edges.where("source_type = 'model' and target_type = 'tool_mcp'").groupBy(F.col("source_id").alias("_m")).agg(F.sort_array(F.collect_set("target_id")).alias("tools"))
    return found.join(own, F.col("model_id") == F.col("_m"), "left").drop("_m").withColumn("tools", F.coalesce("tools", F.array().cast("array<string>")))


def interfaces_of(edges: DataFrame, models: DataFrame, interfaces: DataFrame, ids: DataFrame) -> DataFrame:
    """Enabled interfaces of the enabled models of clients, each once."""
    found = linked(edges, clients(ids), "client", "model").join(models.where("status = 1").select("model_id", "api_id"), F.col("id") == F.col("model_id"))
    found = first_of_each(found.select("client", F.col("api_id").alias("id"), "order"))
    return found.join(interfaces.where("status = 1").drop("status"), F.col("id") == F.col("api_id"))


def tools_of(edges: DataFrame, tools: DataFrame, ids: DataFrame) -> DataFrame:
    """Enabled tools of the models of clients, each once."""
    models = linked(edges, clients(ids), "client", "model").select("client", "id")
    return first_of_each(linked(edges, models, "model", "tool_mcp")).join(tools.where("status = 1").drop("status"), F.col("id") == F.col("mcp_id"))


def prompts_of(edges: DataFrame, prompts: DataFrame, ids: DataFrame) -> DataFrame:
    """Enabled prompts of clients, each once."""
    return first_of_each(linked(edges, clients(ids), "client", "system_prompt")).join(prompts.where("status = 1").drop("status"), F.col("id") == F.col("prompt_id"))


def assembled(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Each client with the sorted ids of its models, prompts and tools."""
    base = clients(ids)
    models = linked(edges, base, "client", "model")
    parts = {"models": models, "prompts": linked(edges, base, "client", "system_prompt"), "tools": linked(edges, models.select("client", "id"), "model", "tool_mcp")}
    out = base.select("client").distinct()
    for name, found in parts.items():
        out = out.join(found.groupBy("client").agg(F.sort_array(F.collect_set("id")).alias(name)), "client", "left")
    return out.select("client", *[F.coalesce(n, F.array().cast("array<string>")).alias(n) for n in parts])
