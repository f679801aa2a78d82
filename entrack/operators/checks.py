"""Checks of a listed item while a pointer rests on it: a vote of its own, inside a visit, with a cover window and a restart."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from entrack.operators.sequences import AGREE, CLEAR, TRIES, sequential


@dataclass(frozen=True)
class Limits:
    """Fixed values, times in seconds: rest before a check, tries and reads a visit, how long an empty read may be a hand."""

    rest: float = 0.25
    tries: int = 3
    reads: int = 8
    cover: float = 2.0


def verdict(reads: list[list]) -> tuple[str, int | None]:
    """The state of a vote and the entity it names. A read is [entity or None, sure, score or None, moving]."""
    sure = [r for r in reads if r[1] and r[0] is not None]
    if len({r[0] for r in sure}) == 1 and (len(sure) >= AGREE or max(r[2] or 0.0 for r in sure) >= CLEAR):
        return "promoted", sure[0][0]
    says_nothing = sum(r[0] is None and bool(r[3] or sure) for r in reads)
    if len(reads) - says_nothing >= TRIES or len(reads) >= 3 * TRIES:
        return "rejected", None
    pair = reads[-2:]
    same = len(pair) == 2 and not pair[0][1] and not pair[1][1] and pair[0][0] == pair[1][0] and None not in (pair[0][2], pair[1][2]) and abs(pair[0][2] - pair[1][2]) < 0.001
    return ("rejected" if same else "voting"), None


def listed(entity: int) -> dict:
    """An item that two sure reads have named."""
    return {"held": [[entity, True, None, False]] * 2, "moved": -1, "verified": -1, "visit": None, "checks": None, "media": None}


def _due(state: dict, row: tuple, limits: Limits) -> bool:
    visit, newer = state["visit"], state["media"] is None or row.media > state["media"]
    if visit is None or row.quiet:
        return False
    if state["checks"]:
        if state["checks"][-1][0] is None and row.paused and not newer:
            return False  # a still frame says the same again
        return visit["tries"] < limits.tries and visit["checks"] < limits.reads
    if visit["checks"] or row.at - visit["at"] < limits.rest or state["verified"] != visit["seen"]:
        return False
    return visit["stale"] and (newer or not row.paused)


def _checked(state: dict, row: tuple, limits: Limits) -> None:
    """One check: the row's read counts in the visit, and may end, restart or carry on the vote of checks."""
    entity = None if row.entity is None or row.entity != row.entity else int(row.entity)
    score = None if row.score is None or row.score != row.score else float(row.score)
    read = [entity, bool(row.sure), score, not row.quiet]
    visit, sure = state["visit"], read[1] and entity is not None
    newer = state["media"] is None or row.media > state["media"]
    state["media"] = row.media
    visit["checks"] += 1
    hand = entity is None and newer and visit["sure_at"] is not None and row.at - visit["sure_at"] <= limits.cover
    visit["tries"] += not hand
    name = verdict(state["held"])[1]
    if sure and entity == name:
        state.update(checks=None, verified=row.seq)
        return
    if not state["checks"]:
        if not sure:
            return
        visit["sure_at"] = row.at
    pending = next((c[0] for c in state["checks"] or [] if c[1] and c[0] is not None), None)
    if sure and pending not in (None, entity) and state["checks"][-1][0] is None:
        visit["sure_at"] = row.at  # a third entity after an empty read: the checks begin again, and no score counts alone
        checks = [[entity, True, None, read[3]]]
    else:
        checks = [*(state["checks"] or []), read]
    result, _ = verdict(checks)
    state["checks"] = checks if result == "voting" else None
    if result == "promoted":
        state.update(held=checks, verified=row.seq)
        visit.update(checks=0, tries=0, sure_at=None)


def check_step(state: dict, row: tuple, limits: Limits) -> tuple[bool, int | None, int, int]:
    """(due, name, tries, open checks) after one row. ``row``: seq, at, media, over, quiet, paused, entity, sure, score."""
    if not row.quiet:
        state["moved"] = int(row.seq)
    if not row.over:
        state.update(visit=None, checks=None)  # checks end with their visit
    elif state["visit"] is None:
        state["visit"] = {"at": row.at, "checks": 0, "tries": 0, "sure_at": None, "stale": state["moved"] > state["verified"], "seen": state["verified"]}
    due = _due(state, row, limits)
    if due:
        _checked(state, row, limits)
    return due, verdict(state["held"])[1], state["visit"]["tries"] if state["visit"] else 0, len(state["checks"] or [])


def checked(rows: DataFrame, key: str, entity: int, limits: Limits) -> DataFrame:
    """(key, seq, due, name, tries, open) of every row, in the order of at and seq; each key's item begins as ``entity``."""

    def step(state: dict, row: tuple) -> tuple:
        return (getattr(row, key), row.seq, *check_step(state, row, limits))

    kind = dict(rows.dtypes)[key]
    schema = f"{key} {kind}, seq long, due boolean, name long, tries long, open long"
    return sequential(rows, [key], ["at", "seq"], lambda: listed(entity), step, schema)
