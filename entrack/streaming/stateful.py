"""Streams with several states a key: zone gates with whole-frame cuts, failures with a time to live, results by epoch.

Each processor keeps its parts in states of their own, so a micro-batch reads and writes only what its rows touch. Rows of
a key are taken by their order inside a micro-batch and in order of arrival across them. They need the RocksDB state
store (``use_state_store``).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from entrack.operators.zones import CUT, MOVING, QUIET, SETTLE


def use_state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _in_order(rows: Iterator[pd.DataFrame], order: list[str]) -> pd.DataFrame:
    return pd.concat(list(rows), ignore_index=True).sort_values(order, kind="stable")


def _frame(rows: list[tuple], **types: str) -> pd.DataFrame:
    """Rows with typed columns, so that a batch without rows has the schema too."""
    return pd.DataFrame(rows, columns=list(types)).astype(types)


class ZoneGate(StatefulProcessor):
    """One value for the session (samples, last cut, zones moving), one map entry for each zone that has changed since.

    A cut writes the session's value alone: a zone whose entry is older than the last cut is moving, its quiet run 0.
    """

    def __init__(self, cut: float = CUT, moving: float = MOVING, quiet: float = QUIET, settle: int = SETTLE):
        self.cut, self.moving, self.quiet, self.settle = cut, moving, quiet, settle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.session = handle.getValueState("session", "sample long, cut_at long, n_moving long")
        self.zones = handle.getMapState("zones", "zone int", "at long, moving boolean, run int")

    def _zone(self, z: int, cut_at: int) -> tuple[bool, int]:
        at, moving, run = self.zones.getValue((z,)) if self.zones.containsKey((z,)) else (0, False, 0)
        return (True, 0) if cut_at > at else (moving, run)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        sample, cut_at, n_moving = self.session.get() if self.session.exists() else (0, 0, 0)
        out = []
        for row in _in_order(rows, ["seq"]).itertuples(index=False):
            sample += 1
            result, settled = "ok", 0
            if not row.compared or sample == 1:
                result = "first"
            elif row.frame >= self.cut:
                result, cut_at, n_moving = "cut", sample, len(row.diffs)
            else:
                for z, d in enumerate(row.diffs):
                    moving, run = self._zone(z, cut_at)
                    after = (True, 0) if d >= self.moving else (moving, 0) if d >= self.quiet or not moving else (moving, run + 1)
                    if after[1] >= self.settle:
                        after, settled = (False, 0), settled + 1
                    if after != (moving, run):
                        n_moving += after[0] - moving
                        self.zones.updateValue((z,), (sample, *after))
            out.append((key[0], row.seq, sample, result, settled, n_moving))
        self.session.update((sample, cut_at, n_moving))
        yield _frame(out, session="int64", seq="int64", sample="int64", result="str", settled="int64", n_moving="int64")

    def close(self) -> None:
        pass


def zone_gate_stream(samples: DataFrame, **limits: float) -> DataFrame:
    """The stream twin of ``zones.gated``. ``samples``: session, seq, frame, diffs, compared."""
    schema = "session long, seq long, sample long, result string, settled long, n_moving long"
    return samples.groupBy("session").transformWithStateInPandas(ZoneGate(**limits), schema, "Append", "None")


#: Seconds after which a failure is forgotten: not there, busy or failing, gone for good.
WAITS = {"missing": 3600.0, "busy": 600.0, "gone": 7 * 86400.0}


class Failures(StatefulProcessor):
    """An item's failures, each kind in a state that forgets it after its own time; a success forgets all."""

    def __init__(self, waits: dict[str, float]):
        self.waits = waits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kinds = {kind: handle.getValueState(kind, "seq long", ttlDurationMs=int(wait * 1000)) for kind, wait in self.waits.items()}

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        out = []
        for row in _in_order(rows, ["seq"]).itertuples(index=False):
            if row.outcome in self.kinds:
                self.kinds[row.outcome].update((int(row.seq),))
            elif row.outcome == "ok":
                for state in self.kinds.values():
                    state.clear()
            else:
                held = [kind for kind, state in self.kinds.items() if state.exists()]
                out.append((key[0], row.seq, "wait" if held else "fetch", ",".join(sorted(held))))
        yield _frame(out, item="str", seq="int64", answer="str", failed="str")

    def close(self) -> None:
        pass


def cooldown_stream(rows: DataFrame, waits: dict[str, float] | None = None) -> DataFrame:
    """(item, seq, answer, failed) of every request. ``rows``: item (text), seq, outcome: a kind of failure, ok, or request.

    Failures are kept with a time to live in processing time, so what has run out also leaves the store.
    """
    return rows.groupBy("item").transformWithStateInPandas(Failures(waits or WAITS), "item string, seq long, answer string, failed string", "Append", "ProcessingTime")


class Epochs(StatefulProcessor):
    """A session's number of cuts, and the number at which each of its open cycles began."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.epoch = handle.getValueState("epoch", "epoch long")
        self.open = handle.getMapState("open", "cycle long", "epoch long, begun timestamp")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        epoch = self.epoch.get()[0] if self.epoch.exists() else 0
        arrived = pd.concat(list(rows), ignore_index=True)
        arrived["turn"] = arrived["kind"].map({"cut": 0, "begin": 1, "result": 2})
        out = []
        for row in arrived.sort_values(["at", "turn"], kind="stable").itertuples(index=False):
            if row.kind == "cut":
                epoch += 1
            elif row.kind == "begin":
                self.open.updateValue((int(row.cycle),), (epoch, row.at.to_pydatetime()))
            elif self.open.containsKey((int(row.cycle),)):
                then, begun = self.open.getValue((int(row.cycle),))
                self.open.removeKey((int(row.cycle),))
                if then == epoch:
                    out.append((key[0], row.cycle, begun, row.at))
        self.epoch.update((epoch,))
        yield _frame(out, session="int64", cycle="int64", begun="datetime64[us]", ended="datetime64[us]")

    def close(self) -> None:
        pass


def current_stream(rows: DataFrame, delay: str) -> DataFrame:
    """The stream twin of ``zones.current``. ``rows``: session, cycle, kind (begin, result, cut), at (timestamp).

    Rows later than ``delay`` behind the newest are dropped, and so are rows that repeat one within it.
    """
    fresh = rows.withWatermark("at", delay).dropDuplicatesWithinWatermark(["session", "cycle", "kind"])
    return fresh.groupBy("session").transformWithStateInPandas(Epochs(), "session long, cycle long, begun timestamp, ended timestamp", "Append", "None")


def samples_from(events: DataFrame, zones: int) -> DataFrame:
    """Events as samples of a session: the value as the frame's difference, and one for each of ``zones`` zones."""
    diffs = F.transform(F.sequence(F.lit(0), F.lit(zones - 1)), lambda z: F.pmod(F.col("k") * 7 + z * 31 + F.col("event_id") * 3, F.lit(97)) / 10)
    return events.select(F.col("user_id").alias("session"), F.col("event_id").alias("seq"), (F.col("value") / 4).alias("frame"), diffs.alias("diffs"), (F.col("event_type") != "error").alias("compared"))
