"""Operators on ordered rows: collapsing, capping, counting, rate slots, sessions, votes and admission."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def without_rescans(rows: DataFrame, page: str, entity: str, at: str, tie: str, gap: float) -> DataFrame:
    """Of rows that repeat the entity within ``gap`` of the next row of the page, only the newest stays."""
    w = Window.partitionBy(page).orderBy(at, tie)
    again = (F.lead(entity).over(w) == F.col(entity)) & (F.lead(at).over(w) - F.col(at) <= gap)
    return rows.withColumn("_again", F.coalesce(again, F.lit(False))).where("not _again").drop("_again")


def newest(rows: DataFrame, keys: list[str], at: list[str], most: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in at])
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def capped(rows: DataFrame, keys: list[str], at: list[str], size: str, most_rows: int, most_size: float) -> DataFrame:
    """The newest rows within both caps; the newest one always stays."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in at]).rowsBetween(Window.unboundedPreceding, 0)
    order = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in at])
    marked = rows.withColumn("_n", F.row_number().over(order)).withColumn("_s", F.sum(size).over(w))
    return marked.where((F.col("_n") == 1) | ((F.col("_n") <= most_rows) & (F.col("_s") <= most_size))).drop("_n", "_s")


def appearances(sightings: DataFrame, keys: list[str], time: str, order: list[str], gap: float) -> DataFrame:
    """Per key: first time in order of arrival, last as a running maximum, and how often it came back after ``gap``."""
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    again = F.coalesce((F.col(time) - F.max(time).over(before) >= gap).cast("int"), F.lit(0))
    marked = sightings.withColumn("_again", again)
    return marked.groupBy(*keys).agg(
        F.min_by(time, F.struct(*order)).alias("first_time"), F.max(time).alias("last_time"), (F.sum("_again") + 1).alias("appearances")
    )


def rate_slots(requests: DataFrame, keys: list[str], now: str, order: list[str], spacing: float) -> DataFrame:
    """Slot of each request: the later of now and the slot before plus ``spacing``, as a running maximum."""
    w = Window.partitionBy(*keys).orderBy(*order)
    i = F.row_number().over(w) - 1
    marked = requests.withColumn("_i", i)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    return marked.withColumn("slot", F.max(F.col(now) - F.col("_i") * spacing).over(run) + F.col("_i") * spacing).drop("_i")


def run_length(rows: DataFrame, keys: list[str], order: list[str], holds: Column) -> DataFrame:
    """Adds ``run``: how many rows in a row, this one included, the condition has held."""
    w = Window.partitionBy(*keys).orderBy(*order)
    marked = rows.withColumn("_h", holds.cast("int"))
    island = marked.withColumn("_g", F.sum(1 - F.col("_h")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy(*keys, "_g").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return island.withColumn("run", F.sum("_h").over(inside)).drop("_h", "_g")


def paced(cost: Column, least: float, most: float, load: float) -> Column:
    """Wait until the next cycle: the cost over its allowed share of the time, between two limits."""
    return F.floor(F.least(F.lit(most), F.greatest(F.lit(least), cost / load)) + 0.5)


def sessions(rows: DataFrame, keys: list[str], at: str, tie: str, gap: float) -> DataFrame:
    """Adds ``session``: a new one wherever the time jumps by more than ``gap``."""
    w = Window.partitionBy(*keys).orderBy(at, tie)
    jumped = F.coalesce((F.abs(F.col(at) - F.lag(at).over(w)) > gap).cast("int"), F.lit(0))
    return rows.withColumn("_j", jumped).withColumn("session", F.sum("_j").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_j")


def places(rows: DataFrame, keys: list[str], order: str, ranges: int = 256) -> DataFrame:
    """Adds ``_n``, each row's place in its group by the numeric column ``order`` from 0, and ``_c``, the group's size.

    Places are counted inside ranges of the column and shifted by the sizes of the ranges before, so a group with
    most of the rows is worked on in ``ranges`` parts.
    """
    ends = rows.agg(F.min(order).alias("lo"), F.max(order).alias("hi")).first()
    span = max(1.0, ((ends["hi"] or 0) - (ends["lo"] or 0) + 1) / ranges)
    dealt = rows.withColumn("_r", F.floor((F.col(order) - F.lit(ends["lo"] or 0)) / span))
    sizes = dealt.groupBy(*keys, "_r").agg(F.count("*").alias("_s"))
    w = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("_s").over(w.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(*keys, "_r", before.alias("_before"), F.sum("_s").over(w).alias("_c"))
    local = F.row_number().over(Window.partitionBy(*keys, "_r").orderBy(order)) - 1
    return dealt.withColumn("_l", local).join(starts, [*keys, "_r"]).withColumn("_n", F.col("_before") + F.col("_l")).drop("_r", "_l", "_before")


def spread(rows: DataFrame, keys: list[str], order: str, most: int) -> DataFrame:
    """At most ``most`` rows of each group, evenly spread over it."""
    marked = places(rows, keys, order)
    step = F.greatest(F.lit(1), F.floor(F.col("_c") / most))
    return marked.where((F.col("_n") % step == 0) & (F.floor(F.col("_n") / step) < most)).drop("_n", "_c")


AGREE, CLEAR, TRIES = 2, 0.86, 4


def settled_votes(readings: DataFrame, track: list[str], seq: str) -> DataFrame:
    """Each track's state after each reading: promoted, rejected or voting.

    ``readings``: track, seq, entity_id (null: nothing matched), sure, score, moving. Promoted on two agreeing
    sure readings or a clear one, unless two entities were read surely; rejected after TRIES tries, after
    three times as many readings, or on two equal unsure readings in a row.
    """
    w = Window.partitionBy(*track).orderBy(seq)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    sure = F.col("sure") & F.col("entity_id").isNotNull()
    one = F.when(sure, F.col("entity_id"))
    rows = readings.select(
        *track, seq, "entity_id", "sure", "score",
        F.count_if(sure).over(run).alias("n_sure"),
        F.min(one).over(run).alias("low"), F.max(one).over(run).alias("high"),
        F.max(F.when(sure, F.col("score"))).over(run).alias("best"),
        F.count_if(F.col("entity_id").isNotNull()).over(run).alias("n_read"),
        F.count_if(F.col("entity_id").isNotNull() | ~F.col("moving")).over(run).alias("n_still"),
        F.count("*").over(run).alias("n"),
        (~F.col("sure") & ~F.lag("sure").over(w) & F.col("entity_id").eqNullSafe(F.lag("entity_id").over(w)) & (F.abs(F.col("score") - F.lag("score").over(w)) < 0.001)).alias("same"),
    )
    promoted = (F.col("n_sure") > 0) & (F.col("low") == F.col("high")) & ((F.col("n_sure") >= AGREE) | (F.col("best") >= CLEAR))
    tries = F.when(F.col("n_sure") > 0, F.col("n_read")).otherwise(F.col("n_still"))
    rejected = (tries >= TRIES) | (F.col("n") >= 3 * TRIES) | F.coalesce(F.col("same"), F.lit(False))
    state = F.when(promoted, "promoted").when(rejected, "rejected").otherwise("voting")
    return rows.select(*track, seq, state.alias("state"), F.when(promoted, F.col("low")).alias("entity_id"), F.col("n").cast("long").alias("reads"))


def vote_outcomes(states: DataFrame, track: list[str], seq: str) -> DataFrame:
    """The first reading that ended each track's vote, else its last one."""
    w = Window.partitionBy(*track).orderBy((F.col("state") == "voting").cast("int"), F.when(F.col("state") == "voting", -F.col(seq)).otherwise(F.col(seq)))
    return states.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def sequential(rows: DataFrame, keys: list[str], order: list[str], start: Callable[[], object], step: Callable, schema: str) -> DataFrame:
    """A fold over each key's rows in order, for rules where a row's outcome depends on earlier outcomes.

    Rows stream through sorted partitions; only one key's state is held at a time, whatever its number of rows.
    ``step(state, row)`` changes the state and returns the output values of one row.
    """
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                key = tuple(getattr(row, k) for k in keys)
                if key != current:
                    current, state = key, start()
                out.append(step(state, row))
            yield pd.DataFrame(out, columns=names)

    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, *order)
    return dealt.mapInPandas(run, schema)


def admitted(requests: DataFrame, keys: list[str], per_minute: int, per_day: int) -> DataFrame:
    """Adds the answer of a gate that counts accepted requests only. ``requests``: keys, event_id, at (seconds), paused.

    One key's requests are sequential by nature: take the narrowest key that the limits are meant for.
    """

    def step(state: dict, row: tuple) -> tuple:
        recent = state["recent"] = [t for t in state["recent"] if t > row.at - 60]
        day = int(row.at // 86400)
        if state["day"] != day:
            state.update(day=day, count=0)
        answer = "paused" if row.paused else "busy" if len(recent) >= per_minute else "daily-limit" if state["count"] >= per_day else "ok"
        if answer == "ok":
            recent.append(row.at)
            state["count"] += 1
        return (*[getattr(row, k) for k in keys], row.event_id, answer)

    types = dict(requests.dtypes)
    schema = ", ".join([*[f"{k} {types[k]}" for k in keys], "event_id long", "answer string"])
    return sequential(requests.select(*keys, "event_id", "at", "paused"), keys, ["at", "event_id"], lambda: {"recent": [], "day": None, "count": 0}, step, schema)
