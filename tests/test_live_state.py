"""Zone gates, epochs, failures with a time to live and checks: stream twins, plain folds, planted cases."""

from __future__ import annotations

import time
from collections import Counter, namedtuple

import pandas as pd
import pytest

from entrack.operators import checks as C
from entrack.operators import zones as Z
from entrack.plans import live, registry
from entrack.plans.sequences import events
from entrack.streaming import stateful
from pyspark.sql import functions as F


class Fed:
    """A stream that gets one batch after the other."""

    def __init__(self, spark, tmp_path, schema: str, build, idle: bool):
        stateful.use_state_store(spark)
        spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", str(idle).lower())  # processing time alone would start batches without end
        self.spark, self.schema, self.root, self.held = spark, schema, tmp_path / "in", []
        self.root.mkdir()
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", "2")  # a state store for each
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(self.root))
        self.query = build(source).writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "check")).foreachBatch(lambda df, _: self.held.append(df.toPandas())).start()
        spark.conf.set("spark.sql.shuffle.partitions", before)

    def feed(self, rows: list[tuple]) -> None:
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(str(self.root))
        self.query.processAllAvailable()

    def rows(self) -> pd.DataFrame:
        return pd.concat(self.held, ignore_index=True)


@pytest.fixture
def fed(spark, tmp_path):
    made = []

    def make(schema, build, idle=True):
        made.append(Fed(spark, tmp_path, schema, build, idle))
        return made[0]

    yield make
    made[0].query.stop()


def plain_gate(samples: list) -> list[tuple]:
    """(result, settled, n_moving) of one session's samples, by a loop over all zones."""
    moving, quiet, out = {}, {}, []
    for k, s in enumerate(samples):
        settled = 0
        if k == 0 or not s.compared:
            out.append(("first", 0, sum(moving.values())))
            continue
        if s.frame >= 40:
            moving, quiet = dict.fromkeys(range(len(s.diffs)), True), {}
        else:
            for z, d in enumerate(s.diffs):
                if d >= 6:
                    moving[z], quiet[z] = True, 0
                elif d >= 3:
                    quiet[z] = 0
                elif moving.get(z):
                    quiet[z] = quiet.get(z, 0) + 1
                    if quiet[z] == 2:
                        moving[z], quiet[z], settled = False, 0, settled + 1
        out.append(("cut" if s.frame >= 40 else "ok", settled, sum(moving.values())))
    return out


def test_cuts_mark_every_zone_in_batch_and_stream(spark, small, fed):
    e = events(spark, small)
    rows = stateful.samples_from(e, live.ZONES).join(e.select(F.col("event_id").alias("seq"), "at"), "seq").orderBy("at", "seq").collect()
    sessions: dict[int, list] = {}
    for r in rows:
        sessions.setdefault(r.session, []).append(r)
    want = {(s, r.seq): w for s, of in sessions.items() for r, w in zip(of, plain_gate(of), strict=True)}
    assert {w[0] for w in want.values()} == {"first", "ok", "cut"} and any(w[1] for w in want.values())
    batch = registry.QUERIES["zone_cuts"](spark, small).collect()
    assert {(r.session, r.seq): (r.result, r.settled, r.n_moving) for r in batch} == want
    place = {r.seq: k for k, r in enumerate(rows)}
    feed = fed("session long, seq long, frame double, diffs array<double>, compared boolean", stateful.zone_gate_stream)
    every = [(r.session, place[r.seq], r.frame, list(r.diffs), r.compared) for r in rows]
    for lo in range(0, len(every), 400):
        feed.feed(every[lo : lo + 400])
    out = feed.rows()
    assert {(r.session, rows[r.seq].seq): (r.result, r.settled, r.n_moving) for r in out.itertuples()} == want


def test_a_zone_never_seen_moves_after_a_cut(spark):
    rows = [(1, 0, 0.0, [0.0] * 3, True), (1, 1, 41.0, [0.0] * 3, True), (1, 2, 0.0, [1.0, 4.0, 7.0], True), (1, 3, 0.0, [1.0, 1.0, 1.0], True), (1, 4, 0.0, [1.0] * 3, True), (1, 5, 0.0, [9.0, 0.0, 0.0], False), (1, 6, 0.0, [1.0] * 3, True)]
    df = spark.createDataFrame(rows, "session long, seq long, frame double, diffs array<double>, compared boolean")
    found = [(r.result, r.settled, r.n_moving) for r in Z.gated(df, "session", ["seq"]).orderBy("seq").collect()]
    assert found == [("first", 0, 0), ("cut", 0, 3), ("ok", 0, 3), ("ok", 1, 2), ("ok", 2, 0), ("first", 0, 0), ("ok", 0, 0)]


def test_failures_are_forgotten_after_their_time_and_not_before(fed):
    waits = {"missing": 24.0, "busy": 8.0}
    feed = fed("item string, seq long, outcome string", lambda s: stateful.cooldown_stream(s, waits), idle=False)
    feed.feed([("d", 1, "request")])  # the first batch starts the workers
    began = time.time()
    feed.feed([("a", 1, "missing"), ("b", 1, "busy"), ("c", 1, "busy")])
    feed.feed([("a", 2, "request"), ("b", 2, "request"), ("c", 2, "ok"), ("c", 3, "request")])
    assert time.time() - began < 8, "too slow for the times of this test"
    time.sleep(max(0.0, began + 13 - time.time()))
    feed.feed([("a", 3, "request"), ("b", 3, "request")])
    assert time.time() - began < 24, "too slow for the times of this test"
    time.sleep(max(0.0, began + 29 - time.time()))
    feed.feed([("a", 4, "request")])
    found = {(r.item, r.seq): r.answer for r in feed.rows().itertuples()}
    assert found == {("d", 1): "fetch", ("a", 2): "wait", ("b", 2): "wait", ("c", 3): "fetch", ("a", 3): "wait", ("b", 3): "fetch", ("a", 4): "fetch"}


def at(seconds: float) -> pd.Timestamp:
    return pd.Timestamp(1_700_000_000 + seconds, unit="s").to_pydatetime()


def test_results_begun_before_a_cut_are_dropped_late_and_repeated_rows_too(fed):
    feed = fed("session long, cycle long, kind string, at timestamp", lambda s: stateful.current_stream(s, "60 seconds"))
    feed.feed([(1, 1, "begin", at(0)), (1, 2, "begin", at(5)), (2, 1, "begin", at(5)), (1, 1, "result", at(8)), (1, 1, "result", at(8))])
    feed.feed([(1, 90, "cut", at(10)), (1, 3, "begin", at(11)), (1, 1, "result", at(12))])
    feed.feed([(1, 2, "result", at(20)), (1, 3, "result", at(21)), (2, 1, "result", at(22)), (1, 90, "cut", at(10))])
    feed.feed([(1, 4, "begin", at(500))])
    feed.feed([(1, 5, "begin", at(30)), (1, 5, "result", at(505)), (1, 4, "result", at(506))])  # cycle 5 began too late to count
    assert sorted((r.session, r.cycle) for r in feed.rows().itertuples()) == [(1, 1), (1, 3), (1, 4), (2, 1)]


def test_current_results_by_hand(spark):
    rows = [(1, 1, "begin", 0.0), (1, 1, "result", 5.0), (1, 1, "result", 9.0), (1, 7, "cut", 6.0), (1, 2, "begin", 6.0), (1, 2, "result", 8.0), (1, 3, "begin", 5.0), (1, 3, "result", 6.0), (2, 1, "result", 3.0), (None, 1, "begin", 1.0)]
    df = spark.createDataFrame(rows, "session long, cycle long, kind string, at double")
    assert sorted(map(tuple, Z.current(df, "session", "cycle", "kind", "at").collect())) == [(1, 1, 0.0, 5.0), (1, 2, 6.0, 8.0)]


Row = namedtuple("Row", "seq at media over quiet paused entity sure score")
OWN, OTHER, THIRD = 1, 2, 3


def visit(*answers: tuple, gap: float = 0.3, moved_before: bool = True, quiet: bool = False, paused: bool = False) -> list[Row]:
    """A visit to a spot that moves: nothing, then one row for each possible read."""
    rows = [Row(0, 0.0, 0.0, False, not moved_before, paused, None, False, None), Row(1, 0.1, 0.1, True, quiet, paused, None, False, None)]
    for k, (entity, sure, score) in enumerate(answers):
        t = 0.1 + gap * (k + 1)
        rows.append(Row(k + 2, t, 0.2 if paused else t, True, quiet, paused, entity, sure, score))
    return rows


def played(rows: list[Row], limits: C.Limits = C.Limits()) -> tuple[int, int]:
    """How many checks were made, and the name at the end."""
    state, n, name = C.listed(OWN), 0, None
    for r in rows:
        due, name, _, _ = C.check_step(state, r, limits)
        n += due
    return n, name


SURE, NOTHING, UNSURE = (OTHER, True, 0.8), (None, False, None), (OTHER, False, 0.5)
CASES = {
    "one check a visit that reads its own": (visit(*[(OWN, True, 0.8)] * 20), 1, OWN),
    "an empty first check is the only one": (visit(*[NOTHING] * 20), 1, OWN),
    "a quiet spot is not checked": (visit(*[SURE] * 9, quiet=True), 0, OWN),
    "passing over checks nothing": (visit(*[SURE] * 2, gap=0.1), 0, OWN),
    "one misread changes nothing": (visit(SURE, *[(OWN, True, 0.8)] * 9), 2, OWN),
    "two agreeing sure reads rename": (visit(SURE, SURE, *[(OTHER, True, 0.8)] * 4), 2, OTHER),
    "a clear read of a spot that moves renames alone": (visit((OTHER, True, 0.9), SURE), 1, OTHER),
    "a hand for a moment does not end the checks": (visit(SURE, NOTHING, NOTHING, SURE), 4, OTHER),
    "a hand that stays ends them at the reads of a visit": (visit(SURE, *[NOTHING] * 20, gap=0.26), 8, OWN),
    "empty reads after the cover window are tries": (visit(SURE, *[NOTHING] * 20, gap=1.5), 4, OWN),
    "a third entity after a hand starts again": (visit(SURE, NOTHING, (THIRD, True, 0.95), (THIRD, True, 0.8)), 4, THIRD),
    "two entities back to back are not settled": (visit(SURE, (THIRD, True, 0.8), SURE, *[SURE] * 9), 3, OWN),
    "reads that name an entity are tries": (visit(SURE, UNSURE, (OTHER, False, 0.6), *[UNSURE] * 9), 3, OWN),
    "a still frame is not read twice": (visit(SURE, NOTHING, NOTHING, SURE, paused=True), 2, OWN),
}


@pytest.mark.parametrize("case", CASES)
def test_checks_by_case(case):
    rows, n, name = CASES[case]
    assert played(rows) == (n, name)


def test_checks_end_with_their_visit():
    first = visit(SURE)
    away = [Row(3, 1.0, 1.0, False, False, False, None, False, None), Row(4, 1.1, 1.1, True, False, False, None, False, None)]
    assert played([*first, *away, Row(5, 1.5, 1.5, True, False, False, OTHER, True, 0.8)]) == (2, OWN)


def plain_checks(rows: list, limits: C.Limits, entity: int) -> list[tuple]:
    """The same rules as a class with one method for each; visits are found first."""

    class Item:
        reads, open, last_media, last_read = [(entity, True, None, False)] * 2, [], None, -1

    def settled(reads):
        sure = [r for r in reads if r[1] and r[0] is not None]
        names = Counter(r[0] for r in sure)
        if len(names) == 1:
            (name, n), best = *names.items(), max((r[2] or 0) for r in sure)
            if n > 1 or best >= 0.86:
                return name
        counted = [r for r in reads if not (r[0] is None and (r[3] or sure))]
        a, b = (reads[-2:] + [None, None])[:2]
        twins = b is not None and not a[1] and not b[1] and a[0] == b[0] and a[2] is not None and b[2] is not None and abs(a[2] - b[2]) < 0.001
        return "over" if len(counted) > 3 or len(reads) > 11 or twins else None

    item, out, last_motion, here = Item(), [], -1, None
    for r in rows:
        last_motion = last_motion if r.quiet else r.seq
        if not r.over:
            here, item.open = None, []
        elif here is None:
            here = {"came": r.at, "n": 0, "tries": 0, "first": None, "stale": last_motion > item.last_read, "read": item.last_read}
        due = False
        if here and not r.quiet:
            fresh = item.last_media is None or r.media > item.last_media
            if item.open:
                due = here["tries"] < limits.tries and here["n"] < limits.reads and not (item.open[-1][0] is None and r.paused and not fresh)
            else:
                due = here["n"] == 0 and r.at - here["came"] >= limits.rest and here["read"] == item.last_read and here["stale"] and (fresh or not r.paused)
        if due:
            e = None if r.entity is None else int(r.entity)
            covered = e is None and fresh and here["first"] is not None and r.at - here["first"] <= limits.cover
            item.last_media, here["n"], here["tries"] = r.media, here["n"] + 1, here["tries"] + (not covered)
            sure, own = r.sure and e is not None, settled(item.reads)
            if sure and e == own:
                item.open, item.last_read = [], r.seq
            elif item.open or sure:
                if not item.open:
                    here["first"] = r.at
                said = [c[0] for c in item.open if c[1] and c[0] is not None]
                if sure and said and said[0] != e and item.open[-1][0] is None:
                    here["first"], item.open = r.at, [(e, True, None, True)]
                else:
                    item.open = [*item.open, (e, bool(r.sure), r.score, True)]
                end = settled(item.open)
                if end not in (None, "over"):
                    item.reads, item.last_read = item.open, r.seq
                    here.update(n=0, tries=0, first=None)
                if end is not None:
                    item.open = []
        out.append((r.seq, due, settled(item.reads), here["tries"] if here else 0, len(item.open)))
    return out


def test_checks_equal_a_plain_version(spark, small):
    rows: dict[int, list] = {}
    for r in live.check_rows(spark, small).orderBy("at", "seq").collect():
        rows.setdefault(r.user_id, []).append(r)
    want = {(u, *w) for u, of in rows.items() for w in plain_checks(of, live.CHECKS, 1)}
    found = {tuple(r) for r in registry.QUERIES["item_checks"](spark, small).collect()}
    assert found == want
    assert len({w[3] for w in want}) > 1 and max(w[5] for w in want) > 1
