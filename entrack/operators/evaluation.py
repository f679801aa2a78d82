"""Evaluation analytics: percentiles, buckets, threshold calibration and before/after reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from entrack.operators.lineage import cut


def ranked_values(rows: DataFrame, keys: list[str], value: str, places: dict[str, Column]) -> DataFrame:
    """The value at each place of the sorted group; a place is a column over ``n``, the group's size, from 0.

    Values are counted before they are put in order, so a group costs its distinct values, not its rows, and
    is never gathered in one array.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*keys)
    upto = F.sum("_c").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    placed = counts.withColumn("n", F.sum("_c").over(w)).withColumn("_upto", upto)
    return placed.groupBy(*keys).agg(*[F.min(F.when(F.col("_upto") > place, F.col(value))).alias(name) for name, place in places.items()])


def nearest_rank(q: float) -> Column:
    """The rounded place q * (n - 1)."""
    return F.floor(F.lit(q) * (F.col("n") - 1) + 0.5)


def upper_median() -> Column:
    return F.floor(F.col("n") / 2)


def lower_median() -> Column:
    return F.floor((F.col("n") - 1) / 2)


def share(part: Column, whole: Column) -> Column:
    """part / whole, 0 where the whole is 0."""
    return F.when(whole > 0, part / whole).otherwise(0.0)


def outcome(scored: DataFrame, score: Column, margin: Column, floor: Column, keys: list[str]) -> DataFrame:
    """Precision, coverage and share without an answer of thresholds. ``scored``: s1, s2, correct."""
    below = F.col("s1") < floor
    sure = ~below & (F.col("s1") >= score) & (F.round(F.col("s1") - F.col("s2"), 9) >= margin)
    counted = scored.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(sure).alias("confident"), F.count_if(sure & F.col("correct")).alias("right"), F.count_if(below).alias("below"))
    return counted.select(
        *keys, "confident", F.round(share(F.col("right"), F.col("confident")), 9).alias("precision"),
        F.round(share(F.col("confident"), F.col("n")), 9).alias("coverage"), F.round(share(F.col("below"), F.col("n")), 9).alias("nothing"),
    )


def calibrated(scored: DataFrame, precision: float, least: int, step: float, most: float, floor_percentile: float) -> DataFrame:
    """The score and margin with the most answers at the target precision, one row.

    (score, margin, floor, achieved, precision, coverage). For each margin of the grid the deepest cut in
    descending score whose answers are right often enough; cuts lie between distinct scores only. Rows are counted
    by score and lead in steps first, so margins repeat counts, not rows. Where no cut reaches the target, score and
    margin are 1, nothing is achieved.
    """
    last = int(most / step + 1e-9)
    quantile = scored.where("correct").agg(F.percentile("s1", F.lit(floor_percentile)).alias("p"))
    floor = F.broadcast(quantile.select(F.coalesce(F.floor(F.col("p") * 1000 + 1e-9) / 1000, F.lit(0.0)).alias("floor")))  # one row
    lead = F.floor(F.round(F.col("s1") - F.col("s2"), 9) / step + 1e-6).cast("int")
    steps = scored.groupBy("s1", F.least(lead, F.lit(last)).alias("k")).agg(F.count("*").alias("c"), F.count_if("correct").alias("r")).where("k >= 0")
    counts = steps.join(floor).where("s1 >= floor").select("s1", "c", "r", F.explode(F.sequence(F.lit(0), F.col("k"))).alias("k"))
    counts = counts.groupBy("k", "s1").agg(F.sum("c").alias("c"), F.sum("r").alias("r"))
    down = Window.partitionBy("k").orderBy(F.col("s1").desc()).rowsBetween(Window.unboundedPreceding, 0)
    cuts = counts.withColumn("n", F.sum("c").over(down)).withColumn("right", F.sum("r").over(down))
    good = cuts.where((F.col("n") >= least) & (F.col("right") >= precision * F.col("n")))
    deepest = good.groupBy("k").agg(F.max_by("s1", "n").alias("s1"), F.max("n").alias("n"))
    best = deepest.agg(F.max_by(F.struct("s1", "k"), F.struct("n", -F.col("k"))).alias("b")).join(floor)  # one row
    raised = F.greatest(F.col("floor"), F.ceil(F.col("b.s1") * 10000 - 1e-9) / 10000)
    found = best.select("floor", F.when(F.col("b").isNotNull(), raised).otherwise(1.0).alias("score"), F.coalesce(F.round(F.col("b.k") * step, 4), F.lit(1.0)).alias("margin"), F.col("b").isNotNull().alias("any"))
    held = (F.col("s1") >= F.col("floor")) & (F.col("s1") >= F.col("score")) & (F.round(F.col("s1") - F.col("s2"), 9) >= F.col("margin"))
    sure = held & F.col("any")
    judged = scored.join(F.broadcast(found)).groupBy("score", "margin", "floor").agg(F.count("*").alias("n"), F.count_if(sure).alias("c"), F.count_if(sure & F.col("correct")).alias("r"))
    right = F.round(share(F.col("r"), F.col("c")), 9)
    return judged.select(
        "score", "margin", "floor", ((F.col("c") >= least) & (F.col("r") >= precision * F.col("c"))).alias("achieved"), right.alias("precision"), F.round(share(F.col("c"), F.col("n")), 9).alias("coverage")
    )


def by_tags(rows: DataFrame, groups: Column, measures: list[Column]) -> DataFrame:
    """The same measures over overlapping groups; ``groups`` is an array of group names per row."""
    return rows.withColumn("group", F.explode(groups)).groupBy("group").agg(*measures)


def transitions(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """How many rows went from which state to which. Both: key, state."""
    joined = before.withColumnRenamed("state", "was").join(after.withColumnRenamed("state", "is_now"), key)
    return joined.groupBy("was", "is_now").agg(F.count("*").alias("n"))


def rejections(rows: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """Adds ``reason``: the first rule that holds, null for rows that pass them all."""
    reason = F.lit(None).cast("string")
    for name, rule in reversed(rules):
        reason = F.when(rule, F.lit(name)).otherwise(reason)
    return rows.withColumn("reason", reason)


def capped_weight(keys: list[str], most: float) -> Column:
    """Rows of a large group share ``most`` between them."""
    return F.least(F.lit(1.0), F.lit(most) / F.count("*").over(Window.partitionBy(*keys)))


_OUTCOMES = ("right", "wrong", "negative")


def grid_replay(readings: DataFrame, rules: DataFrame, most_negative: int) -> DataFrame:
    """The rules under which no reading is answered wrongly and at most ``most_negative`` of those without a truth are answered.

    ``readings``: a1, m1, top1 and a2, m2, top2, score, lead and answer of the first list and of the list of all views;
    truth (null: nothing to find); never (asked back, so never sure). ``rules``: score, margin, floor, score2, margin2 (a rule
    without a second gate has nulls there). A reading is sure by its first list, else by the other. Gives confident,
    negative and place: most confident first, then fewer negatives, higher score, higher floor, then the other values.

    Readings are counted once, by the steps between the rules' thresholds on all four axes; running sums along
    each axis make every count a lookup, so rules cost the same whatever the number of readings. The table's size is
    the product of the numbers of thresholds.
    """
    spark = readings.sparkSession
    lower = lambda column: F.greatest(F.col("floor"), F.col(column))
    scores = rules.select(F.explode(F.array(lower("score"), F.when(F.col("score2").isNotNull(), lower("score2")))).alias("x")).where("x is not null").distinct()
    margins = rules.select(F.explode(F.array("margin", "margin2")).alias("x")).where("x is not null").distinct()
    scores, margins = (sorted(r.x for r in axis.collect()) for axis in (scores, margins))  # thresholds of the rules
    step = lambda value, axis: sum(F.when(F.col(value) >= F.lit(x) - 1e-9, 1).otherwise(0) for x in axis)
    axes = {"a1": scores, "m1": margins, "a2": scores, "m2": margins}
    told = lambda top: [F.count_if(F.col("truth") == F.col(top)), F.count_if(F.col("truth") != F.col(top)), F.count_if(F.col("truth").isNull())]
    names = [f"{o}{i}" for i in (1, 2) for o in _OUTCOMES]
    counted = readings.where("not never").select(*[step(v, axis).alias(v) for v, axis in axes.items()], "top1", "top2", "truth").groupBy(*axes)
    counted = counted.agg(*[c.alias(n) for n, c in zip(names, told("top1") + told("top2"), strict=True)])
    grid = spark.range(1)
    for v, axis in axes.items():
        grid = grid.withColumn(v, F.explode(F.sequence(F.lit(0), F.lit(len(axis)))))
    sums = grid.drop("id").join(counted, list(axes), "left").select(*axes, *[F.coalesce(n, F.lit(0)).alias(n) for n in names])
    for v in axes:
        others = Window.partitionBy(*[x for x in axes if x != v]).orderBy(F.col(v).desc()).rowsBetween(Window.unboundedPreceding, 0)
        sums = sums.select(*axes, *[F.sum(n).over(others).alias(n) for n in names])
    sums = cut(sums)

    def corners(i: int) -> Column:
        """(a, m, sign) of the list's quadrants, as steps; a rule without a second gate has its first alone."""
        place = lambda value, axis: sum(F.when(value >= F.lit(x) - 1e-9, 1).otherwise(0) for x in axis)
        one = (place(lower("score"), scores), place(F.col("margin"), margins))
        two = (place(lower("score2"), scores), place(F.col("margin2"), margins))
        both = (F.greatest(one[0], two[0]), F.greatest(one[1], two[1]))
        rows = [F.struct(a.alias(f"a{i}"), m.alias(f"m{i}"), F.lit(s).alias(f"s{i}")) for (a, m), s in ((one, 1), (two, 1), (both, -1))]
        return F.when(F.col("score2").isNull(), F.array(rows[0])).otherwise(F.array(*rows))

    every = lambda i: F.array(F.struct(F.lit(0).alias(f"a{i}"), F.lit(0).alias(f"m{i}"), F.lit(1).alias(f"s{i}")))
    numbered = cut(rules.select("score", "margin", "floor", "score2", "margin2").distinct())
    keys = numbered.columns
    parts = []
    for first, second, take, sign in ((corners(1), every(2), "1", 1), (every(1), corners(2), "2", 1), (corners(1), corners(2), "2", -1)):
        asked = numbered.select(*keys, F.inline(first)).select(*keys, "a1", "m1", "s1", F.inline(second))
        weight = F.col("s1") * F.col("s2") * F.lit(sign)
        parts.append(asked.join(sums, list(axes)).select(*keys, *[(F.col(f"{o}{take}") * weight).alias(o) for o in _OUTCOMES]))
    tallied = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy(*keys).agg(*[F.sum(o).alias(o) for o in _OUTCOMES])
    good = tallied.where((F.col("wrong") == 0) & (F.col("negative") <= most_negative)).withColumnRenamed("right", "confident")
    order = [F.col("confident").desc(), F.col("negative"), F.col("score").desc(), F.col("floor").desc(), F.col("margin"), F.col("score2").asc_nulls_first(), F.col("margin2").asc_nulls_first()]
    return good.withColumn("place", F.row_number().over(Window.orderBy(*order))).drop("wrong")  # rules, not readings
