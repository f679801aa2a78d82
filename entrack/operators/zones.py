"""Zones of a frame: motion, settling, and cuts that touch all zones of a session at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Mean difference of a frame that is a cut; of a zone that moves, that is quiet; quiet samples that settle it.
CUT, MOVING, QUIET, SETTLE = 40.0, 6.0, 3.0, 2


def gated(samples: DataFrame, session: str, order: list[str], cut: float = CUT, moving: float = MOVING, quiet: float = QUIET, settle: int = SETTLE) -> DataFrame:
    """(session, order, sample, result, settled, n_moving) of every sample, after it is taken.

    ``samples``: session, the order, ``frame`` (difference of the whole frame to the sample before), ``diffs`` (of each
    zone), ``compared`` (false where the sample has nothing to be compared with, as after a pause; the first never
    has). A cut makes all zones move; else a zone moves from ``moving`` on and settles after ``settle`` quiet samples in a
    row. A zone is moving where its last motion is later than its last full quiet run, so all zones are windows; a
    session's series are dealt by zone.
    """
    numbered = samples.withColumn("sample", F.row_number().over(Window.partitionBy(session).orderBy(*order)))
    numbered = numbered.withColumn("compared", F.col("compared") & (F.col("sample") > 1))
    is_cut = F.col("compared") & (F.col("frame") >= cut)
    zones = numbered.where("compared").select(session, "sample", is_cut.alias("cut"), F.posexplode("diffs").alias("zone", "d"))
    each = Window.partitionBy(session, "zone").orderBy("sample")
    run = each.rowsBetween(Window.unboundedPreceding, 0)
    moves = F.col("cut") | (F.col("d") >= moving)
    i = F.col("i")
    rows = zones.withColumn("i", F.row_number().over(each)).withColumn("q", ~F.col("cut") & (F.col("d") < quiet))
    rows = rows.withColumn("length", i - F.coalesce(F.max(F.when(~F.col("q"), i)).over(run), F.lit(0)))
    rows = rows.withColumn("full", F.col("q") & (F.col("length") >= settle))
    last = lambda c: F.coalesce(F.max(F.when(c, i)).over(run), F.lit(0))
    rows = rows.withColumn("now", last(moves) > last(F.col("full"))).withColumn("was", F.coalesce(F.lag("now").over(each), F.lit(False)))
    changes = rows.groupBy(session, "sample").agg(F.sum(F.col("now").cast("int") - F.col("was").cast("int")).alias("change"), F.count_if(F.col("was") & ~F.col("now")).alias("settled"))
    found = numbered.select(session, *order, "sample", "compared", is_cut.alias("cut")).join(changes, [session, "sample"], "left")
    upto = Window.partitionBy(session).orderBy("sample").rowsBetween(Window.unboundedPreceding, 0)
    result = F.when(F.col("cut"), "cut").when(F.col("compared"), "ok").otherwise("first")
    return found.select(session, *order, "sample", result.alias("result"), F.coalesce("settled", F.lit(0)).cast("long").alias("settled"), F.coalesce(F.sum("change").over(upto), F.lit(0)).cast("long").alias("n_moving"))


def current(rows: DataFrame, session: str, cycle: str, kind: str, at: str) -> DataFrame:
    """(session, cycle, begun, ended): results of cycles in which nothing was cut, each once.

    ``rows``: kind is begin, result or cut. A cycle's epoch is the number of its session's cuts before it; a result
    whose epoch has gone by since the cycle began says nothing any more. At one time cuts come first. A result that is
    delivered again counts once, at its first time; one without a beginning is dropped.
    """
    first = rows.where(F.col(kind) != "cut").groupBy(session, cycle, kind).agg(F.min(at).alias(at))
    marks = first.unionByName(rows.where(F.col(kind) == "cut").select(session, cycle, kind, at))
    upto = Window.partitionBy(session).orderBy(F.col(at), (F.col(kind) != "cut").cast("int")).rangeBetween(Window.unboundedPreceding, 0)
    timed = marks.withColumn("epoch", F.count_if(F.col(kind) == "cut").over(upto)).where(F.col(kind) != "cut")
    pick = lambda k, c: F.max(F.when(F.col(kind) == k, F.col(c)))
    both = timed.groupBy(session, cycle).agg(pick("begin", at).alias("begun"), pick("result", at).alias("ended"), pick("begin", "epoch").alias("e0"), pick("result", "epoch").alias("e1"))
    return both.where("e0 = e1 and ended >= begun").select(session, cycle, "begun", "ended")
