"""Spaced-repetition state (published FSRS-6 formulas) as column arithmetic in double."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The published default parameters w0 to w20.
W = (0.212, 1.2931, 2.3065, 8.2956, 6.4133, 0.8334, 3.0194, 0.001, 1.8722, 0.1666, 0.796, 1.4835, 0.0614, 0.2629, 1.6483, 0.6014, 1.8729, 0.5425, 0.0912, 0.0658, 0.1542)
DECAY = W[20]
FACTOR = 0.9 ** (-1 / DECAY) - 1
GRADES = {"again": 1, "hard": 2, "good": 3, "easy": 4}
MIN_STABILITY, MAX_STABILITY = 0.001, 36500.0


def initial_difficulty(grade: int) -> float:
    return W[4] - math.exp(W[5] * (grade - 1)) + 1


INITIAL_STABILITY = W[2]
INITIAL_DIFFICULTY = min(10.0, max(1.0, initial_difficulty(3)))


def retrievability(stability: Column, days: Column) -> Column:
    return F.pow(F.lit(1.0) + F.lit(FACTOR) * days / stability, F.lit(-DECAY))


def next_difficulty(difficulty: Column, grade: Column) -> Column:
    moved = difficulty - F.lit(W[6]) * (grade - 3) * (F.lit(10.0) - difficulty) / 9
    return F.least(F.lit(10.0), F.greatest(F.lit(1.0), F.lit(W[7] * initial_difficulty(4)) + F.lit(1 - W[7]) * moved))


def next_stability(stability: Column, difficulty: Column, days: Column, grade: Column) -> Column:
    r = retrievability(stability, days)
    extra = F.when(grade == 2, F.lit(W[15])).when(grade == 4, F.lit(W[16])).otherwise(F.lit(1.0))
    growth = F.lit(math.exp(W[8])) * (F.lit(11.0) - difficulty) * F.pow(stability, F.lit(-W[9])) * (F.exp(F.lit(W[10]) * (1 - r)) - 1) * extra
    recalled = stability * (1 + growth)
    lapsed = F.lit(W[11]) * F.pow(difficulty, F.lit(-W[12])) * (F.pow(stability + 1, F.lit(W[13])) - 1) * F.exp(F.lit(W[14]) * (1 - r))
    forgotten = F.least(lapsed, stability / F.lit(math.exp(W[17] * W[18])))
    return F.least(F.lit(MAX_STABILITY), F.greatest(F.lit(MIN_STABILITY), F.when(grade == 1, forgotten).otherwise(recalled)))
