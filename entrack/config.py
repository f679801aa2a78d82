"""Thresholds as plain values."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Thresholds:
    """Accept and reject rules for a ranked candidate list.

    Below ``floor`` nothing is said. An answer is sure with ``score`` and ``margin``, or with the second
    gate's pair; the sentinel entity needs its own margin as well.
    """

    score: float = 0.8
    margin: float = 0.02
    floor: float = 0.74
    second_score: float | None = 0.73
    second_margin: float = 0.1
    sentinel_margin: float = 0.1


#: For the test tables, whose vectors are random: best scores lie around 0.35.
SYNTHETIC = Thresholds(score=0.36, margin=0.02, floor=0.30, second_score=0.33, second_margin=0.05, sentinel_margin=0.04)
SENTINEL = -1
#: Score and lead with which the readings of a rescue give an answer.
RESCUE_FLOOR, RESCUE_LEAD = 0.72, 0.03
