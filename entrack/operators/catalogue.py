"""Catalogue and index maintenance: prioritised joins, overlays, upserts, base and delta."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def prioritised_join(records: DataFrame, enrich: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Enrichment rows find a record by id, else by an item id, else by the exact name.

    ``records``: id, name, item_ids, pos; ``enrich``: row_no, id, name, points. Of several rows for one record
    the closer kind of match wins, then the higher points. Of records with one id the last counts, of those
    with one item or name the first. Returns (every record with how and points, the enrichment rows with
    points that found none).
    """
    last = Window.partitionBy("id").orderBy(F.col("pos").desc())
    by_id = records.withColumn("n", F.row_number().over(last)).where("n = 1").select(F.lit(0).alias("how"), F.col("id").cast("string").alias("key"), F.col("pos").alias("record"))
    items = records.select("pos", F.explode("item_ids").alias("item"))
    by_item = items.groupBy("item").agg(F.min("pos").alias("record")).select(F.lit(1).alias("how"), F.col("item").cast("string").alias("key"), "record")
    by_name = records.groupBy("name").agg(F.min("pos").alias("record")).select(F.lit(2).alias("how"), F.col("name").alias("key"), "record")
    keys = by_id.unionByName(by_item).unionByName(by_name)
    tries = enrich.select("row_no", "points", F.explode(F.array(
        F.struct(F.lit(0).alias("how"), F.col("id").cast("string").alias("key")),
        F.struct(F.lit(1).alias("how"), F.col("id").cast("string").alias("key")),
        F.struct(F.lit(2).alias("how"), F.col("name").alias("key")),
    )).alias("t")).select("row_no", "points", "t.how", "t.key")
    found = tries.join(keys, ["how", "key"])
    first = found.groupBy("row_no").agg(F.min(F.struct("how", "record", "points")).alias("m")).select("row_no", "m.*")
    best = first.groupBy("record").agg(F.min(F.struct("how", (-F.col("points")).alias("minus"), "row_no")).alias("b"))
    merged = records.join(best.select(F.col("record").alias("pos"), F.col("b.how").alias("how"), (-F.col("b.minus")).alias("points")), "pos", "left")
    missed = enrich.where(F.col("points") > 0).join(first.select("row_no"), "row_no", "left_anti")
    return merged, missed


def localised(records: DataFrame, texts: DataFrame) -> DataFrame:
    """Own text by id, else that of the first item that has one. ``texts``: id, text."""
    direct = texts.select(F.col("id"), F.col("text").alias("own"))
    items = records.select("id", F.posexplode("item_ids").alias("at", "item")).join(texts.select(F.col("id").alias("item"), "text"), "item")
    by_item = items.groupBy("id").agg(F.min_by("text", "at").alias("through_item"))
    joined = records.join(direct, "id", "left").join(by_item, "id", "left")
    return joined.withColumn("text", F.coalesce("own", "through_item")).drop("own", "through_item")


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of every key."""
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def upserted(stored: DataFrame, fresh: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Fresh rows replace stored ones of the same key."""
    both = stored.withColumn("_age", F.lit(0)).unionByName(fresh.withColumn("_age", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy(F.col("_age").desc(), F.col(order).desc())
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_age")


def merged_index(base: DataFrame, delta: DataFrame, denied: DataFrame, key: str) -> DataFrame:
    """Base rows, then delta rows that the base does not have, without denied ones."""
    extra = delta.join(base.select(key), key, "left_anti")
    return base.withColumn("origin", F.lit("base")).unionByName(extra.withColumn("origin", F.lit("delta"))).join(denied.select(key), key, "left_anti")


def to_do(missing: DataFrame, catalogue: DataFrame, failures: DataFrame, now: Column, cooldown: Column, key: str) -> DataFrame:
    """Missing rows of the catalogue that are not waiting after a failure. ``failures``: key, at, status."""
    waiting = failures.where(now - F.col("at") < cooldown).select(key).distinct()
    return missing.join(catalogue.select(key).distinct(), key, "left_semi").join(waiting, key, "left_anti")


def first_wins(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def difference(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Rows added and removed, by key."""
    added = after.join(before.select(key), key, "left_anti").select(key, F.lit("added").alias("change"))
    removed = before.join(after.select(key), key, "left_anti").select(key, F.lit("removed").alias("change"))
    return added.unionByName(removed)


def gap_plan(entities: DataFrame, external: DataFrame) -> DataFrame:
    """Entities with more external items than own ones. Both: entity_id, n."""
    joined = entities.join(external.withColumnRenamed("n", "n_external"), "entity_id")
    return joined.withColumn("missing", F.greatest(F.col("n_external") - F.col("n"), F.lit(0))).withColumn("planned", F.col("missing") > 0)
