"""Guards of an index with extra rows: append, strip, stability, scope and compatibility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from entrack.functions import text as X
from entrack.operators import vectors as V
from entrack.operators.geometry import greedy_by_level
from entrack.operators.lineage import cut


def appended(base: DataFrame, extras: DataFrame) -> DataFrame:
    """Base rows, then extras at the following positions. Both: pos, item_id.

    Raises when the base has a synthetic id already, an extra has none, or an id is there twice.
    """
    faults = base.where(X.is_synthetic(F.col("item_id"))).select(F.lit("the base has extra rows already").alias("fault"))
    faults = faults.unionByName(extras.where(~X.is_synthetic(F.col("item_id"))).select(F.lit("an extra row has no synthetic id").alias("fault")))
    both = base.withColumn("tail", F.lit(0)).unionByName(extras.withColumn("tail", F.lit(1)))
    faults = faults.unionByName(both.groupBy("item_id").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("an id is in the index twice").alias("fault")))
    first = faults.first()
    if first:
        raise ValueError(first["fault"])
    start = base.agg(F.coalesce(F.max("pos") + 1, F.lit(0)).alias("start"))  # one row
    shifted = extras.join(F.broadcast(start)).select((F.col("pos") + F.col("start")).alias("pos"), "item_id")
    return base.select("pos", "item_id", F.lit("base").alias("origin")).unionByName(shifted.withColumn("origin", F.lit("extra")))


def stripped(index: DataFrame) -> DataFrame:
    """The index without its synthetic tail; raises when other rows come after it. ``index``: pos, item_id."""
    synthetic = X.is_synthetic(F.col("item_id"))
    ends = index.agg(F.min(F.when(synthetic, F.col("pos"))).alias("first"), F.max(F.when(~synthetic, F.col("pos"))).alias("last")).first()
    if ends["first"] is not None and ends["last"] is not None and ends["last"] > ends["first"]:
        raise ValueError("extra rows come before other ones")
    return index.where(~synthetic)


def unchanged(before: DataFrame, after: DataFrame, columns: list[str]) -> DataFrame:
    """(same): whether two tables hold the same rows at the same positions. Both: pos and the columns."""
    a = before.select("pos", F.struct(*columns).alias("a"))
    b = after.select("pos", F.struct(*columns).alias("b"))
    met = a.join(b, "pos", "full_outer")
    return met.agg(F.coalesce(F.bool_and(F.col("a").isNotNull() & F.col("b").isNotNull() & F.col("a").eqNullSafe(F.col("b"))), F.lit(True)).alias("same"))


def out_of_scope(extras: DataFrame, scope: DataFrame, gap_entities: DataFrame) -> DataFrame:
    """Extras that a run would lose: outside its scope, though their entity still has a gap."""
    return extras.join(scope.select("item_id"), "item_id", "left_anti").join(gap_entities.select("entity_id"), "entity_id", "left_semi")


def incompatible(index: DataFrame, vec: str, dim: int, model: Column, wanted: str) -> DataFrame:
    """(fault, n): how many rows have another model or another dimension; empty for an index that fits."""
    fault = F.when(model != wanted, "other model").when(F.size(vec) != dim, "other dimension")
    return index.select(fault.alias("fault")).where("fault is not null").groupBy("fault").agg(F.count("*").alias("n"))


def gap_decisions(entities: DataFrame, external: DataFrame, every: bool) -> DataFrame:
    """(entity_id, variant, decision): what is planned for each outer item of the entities that have too few.

    ``entities``: entity_id, n (own items); ``external``: entity_id, variant, main (of the main release), render.
    Only variants 1 to 99 count; outside the main release an item is out of scope unless ``every``; without a render
    it is skipped.
    """
    real = external.where(F.col("variant").between(1, X.SLOTS - 1))
    counts = real.groupBy("entity_id").agg(F.count("*").alias("m"))
    short = entities.join(counts, "entity_id").where("m > n").select("entity_id")
    decision = F.when(~F.col("main") & F.lit(not every), "out of scope").when(~F.col("render"), "no clean render").otherwise("planned")
    return real.join(short, "entity_id", "left_semi").select("entity_id", "variant", decision.alias("decision"))


def unaccepted(groups: DataFrame, accepted: DataFrame) -> DataFrame:
    """Groups of more than one entity that no accepted list covers. ``groups``: group_id, entity_id; ``accepted``: list_id, entity_id."""
    members = groups.distinct()
    sizes = members.groupBy("group_id").agg(F.count("*").alias("n")).where("n > 1")
    met = members.join(accepted.distinct(), "entity_id").groupBy("group_id", "list_id").agg(F.count("*").alias("met"))
    covered = met.join(sizes, "group_id").where("met = n").select("group_id").distinct()
    return sizes.join(covered, "group_id", "left_anti")


def decisions(rows: DataFrame, checks: list[tuple[str, DataFrame]], key: str, otherwise: str) -> DataFrame:
    """Each row's first decision: the first table of ``checks`` that has its key."""
    decision = F.lit(otherwise)
    for i, (name, found) in enumerate(reversed(checks)):
        rows = rows.join(found.select(key).distinct().withColumn(f"_{i}", F.lit(True)), key, "left")
        decision = F.when(F.col(f"_{i}"), name).otherwise(decision)
    return rows.withColumn("decision", decision).drop(*[f"_{i}" for i in range(len(checks))])


#: Scores down to which one-to-one matches are settled in turn.
LEVELS = (0.8, 0.55, 0.45)


def cascade(new: DataFrame, vectors: DataFrame, held: Column, least: float, clearly: float) -> DataFrame:
    """Adds each new item's decision; ``new``: item, entity_id, blank (like the placeholder).

    ``vectors``: node, entity_id, vec of new and held items; ``held``: whether the column node is of the index already;
    ``least``: the cosine from which on an item may match an own one. In turn: covered (clearly like an own held item, or matched to
    one, each held one once), placeholder, duplicate (of the first item of its group inside the entity), shared
    (clearly like a held item of another entity), look-alike (in a group with new items of other entities), added.
    Each step looks only at the items that those before left open; pairs leave a tile for the matches alone, level by level.
    """
    unit = cut(V.units(vectors, "node", "vec", "entity_id"))
    own = unit.where(held).withColumnRenamed("node", "own")
    asked = cut(unit.withColumnRenamed("node", "item").join(new.select("item"), "item", "left_semi"))

    def met(left: DataFrame, right: DataFrame, level: float) -> DataFrame:
        return V.scored_pairs(left, right, "item", "own", level, ["entity_id"])

    matches = greedy_by_level(asked, own, ["entity_id"], "item", "own", "score", least, LEVELS, met).select("item")
    unmatched = cut(asked.join(matches, "item", "left_anti"))
    covered = cut(matches.unionByName(V.like_any(unmatched, own, "item", "own", clearly, ["entity_id"])))
    open_ = cut(asked.join(new.where("not blank").select("item"), "item", "left_semi").join(covered, "item", "left_anti"))  # an item without a vector meets none
    doubles = cut(V.similar_groups(open_, "item", "vec", clearly, within="entity_id").where("node <> group_id").select(F.col("node").alias("item")))
    left = cut(open_.join(doubles, "item", "left_anti"))
    shared = cut(V.like_any(left, own, "item", "own", clearly, None, "entity_id"))
    alike = cut(V.similar_groups(left.join(shared, "item", "left_anti"), "item", "vec", clearly, apart="entity_id"))
    many = alike.groupBy("group_id").agg(F.count("*").alias("n")).where("n > 1")
    lookalikes = alike.join(many, "group_id", "left_semi").select(F.col("node").alias("item"))
    checks = [("covered", covered), ("placeholder", new.where("blank")), ("duplicate", doubles), ("shared", shared), ("look-alike", lookalikes)]
    return decisions(new, checks, "item", "added")


def first_listing(entities: DataFrame) -> DataFrame:
    """(item_id, entity_id): each item with the first entity that lists it. ``entities``: pos, entity_id, item_ids."""
    each = entities.select("pos", "entity_id", F.posexplode("item_ids").alias("at", "item_id"))
    return each.groupBy("item_id").agg(F.min_by("entity_id", F.struct("pos", "at")).alias("entity_id"))


def middle_row(keys: list[str], order: list[str]) -> Column:
    """Whether a row stands in the middle of its group, the lower one of two."""
    w = Window.partitionBy(*keys)
    return F.row_number().over(w.orderBy(*order)) == F.floor((F.count("*").over(w) + 1) / 2)
