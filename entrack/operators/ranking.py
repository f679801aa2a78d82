"""Ranked candidate lists: fusion, leads, verdicts, suggestions and the staged cascade."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from entrack.config import RESCUE_FLOOR, RESCUE_LEAD, SENTINEL, Thresholds


def fused(lists: DataFrame, k: int, list_no: str = "variant", rank: str = "rank") -> DataFrame:
    """Each query's candidate lists as one: the best score of every entity, ties by list and place."""
    best = lists.groupBy("query_id", "entity_id").agg(
        F.max(F.struct("score", (-F.col(list_no)).alias("l"), (-F.col(rank)).alias("r"), "item_id")).alias("b"),
        F.min(F.struct(F.col(list_no).alias("l"), F.col(rank).alias("r"))).alias("first"),
    )
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "first")
    flat = best.select("query_id", "entity_id", F.col("b.item_id").alias("item_id"), F.col("b.score").alias("score"), (-F.col("b.l")).alias("from_list"), "first")
    return flat.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("first")


def with_lead(candidates: DataFrame, digits: int = 6) -> DataFrame:
    """Adds the lead over the next candidate; the last one leads over 0."""
    following = F.lead("score").over(Window.partitionBy("query_id").orderBy("rank"))
    return candidates.withColumn("lead", F.round(F.col("score") - F.coalesce(following, F.lit(0.0)), digits))


def is_sure(score: Column, lead: Column, entity: Column, t: Thresholds) -> Column:
    gate = (score >= t.score) & (lead >= t.margin)
    if t.second_score is not None:
        gate = gate | ((score >= t.second_score) & (lead >= t.second_margin))
    return gate & ((entity != SENTINEL) | (lead >= t.sentinel_margin))


def verdict(score: Column, lead: Column, entity: Column, t: Thresholds) -> Column:
    """none below the floor, else sure or low."""
    return F.when(score.isNull() | (score < t.floor), "none").when(is_sure(score, lead, entity, t), "sure").otherwise("low")


def suggestions(candidates: DataFrame, floor: float, margin: float, most: int) -> DataFrame:
    """Candidates at or above the floor and within the margin of the first; none where the first is the sentinel."""
    by_rank = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = candidates.withColumn("top", F.first("score").over(by_rank)).withColumn("top_entity", F.first("entity_id").over(by_rank))
    kept = first.where((F.col("top_entity") != SENTINEL) & (F.col("entity_id") != SENTINEL) & (F.col("score") >= floor) & (F.round(F.col("top") - F.col("score"), 6) <= margin))
    order = Window.partitionBy("query_id").orderBy("rank")
    return kept.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).drop("top", "top_entity")


def rescued(lists: DataFrame, floor: float = RESCUE_FLOOR, lead: float = RESCUE_LEAD, sentinel: int = SENTINEL) -> DataFrame:
    """(query_id, entity_id, score, lead, answered): the best entity of a query's lists, the sentinel aside.

    It is an answer with a floor and a lead of its own; without a second entity it leads over 0. A query whose lists
    hold the sentinel alone has no entity and no answer.
    """
    top = with_lead(fused(lists.where(F.col("entity_id") != sentinel), 2)).where("rank = 1").select("query_id", "entity_id", "score", "lead")
    every = lists.select("query_id").distinct().join(top, "query_id", "left")
    return every.withColumn("answered", F.coalesce((F.col("score") >= floor) & (F.col("lead") >= lead), F.lit(False)))


def staged(lists: DataFrame, stages: int, k: int, t: Thresholds) -> DataFrame:
    """The first stage whose fused lists are sure answers, else the last stage.

    ``lists`` has stage_no beside the columns of ``fused``; stage s fuses all lists up to s.
    """
    upto = lists.join(F.broadcast(lists.sparkSession.range(stages).select(F.col("id").cast("int").alias("stage"))), F.col("stage_no") <= F.col("stage"))
    keyed = upto.withColumn("query", F.col("query_id")).withColumn("query_id", F.struct("query", "stage"))
    tops = with_lead(fused(keyed, k)).where("rank = 1")
    tops = tops.select(F.col("query_id.query").alias("query_id"), F.col("query_id.stage").alias("stage"), "entity_id", "item_id", "score", "lead")
    tops = tops.withColumn("verdict", verdict(F.col("score"), F.col("lead"), F.col("entity_id"), t))
    order = Window.partitionBy("query_id").orderBy(F.when(F.col("verdict") == "sure", F.col("stage")).otherwise(stages + 0), F.col("stage").desc())
    return tops.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")
