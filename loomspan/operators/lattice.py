"""Candidate lattices: classes of analyses with equal cuts, and drawing from them."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GAMMA = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


@dataclass
class Choice:
    """A class of a unit's analyses that give the same cuts and status."""

    cuts: tuple[int, ...]
    status: int
    count: int
    score: np.float32
    selected: bool


def log_add(left: np.float32, right: np.float32) -> np.float32:
    """log(exp(left) + exp(right)) in single precision throughout."""
    if left == -np.inf or right == -np.inf:
        return np.float32(max(left, right))
    top = max(left, right)
    return np.float32(top + np.log(np.float32(np.exp(np.float32(left - top)) + np.exp(np.float32(right - top)))))


def collapse(candidates: list[tuple[tuple[int, ...], int, float]], selected: int) -> list[Choice]:
    """(cuts, status, score) of analyses in order, as classes: the chosen one first, then by cuts."""
    made: dict[tuple, Choice] = {}
    for k, (cuts, status, score) in enumerate(candidates):
        key, value = (tuple(cuts), status), np.float32(score)
        if key in made:
            made[key].count += 1
            made[key].score = log_add(made[key].score, value)
            made[key].selected |= k == selected
        else:
            made[key] = Choice(*key, 1, value, k == selected)
    return sorted(made.values(), key=lambda c: (not c.selected, c.cuts, c.status))


def splitmix(seed: int, step: int) -> int:
    """The step-th number, from 1, of the generator with that seed."""
    value = (seed + step * GAMMA) & _MASK
    value = ((value ^ (value >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
    value = ((value ^ (value >> 27)) * 0x94D049BB133111EB) & _MASK
    return value ^ (value >> 31)


def unit_float(number: int) -> np.float32:
    """The top 23 bits as a number from 0 up to 1."""
    return np.array([0x3F800000 | (number >> 41)], dtype=np.uint32).view(np.float32)[0] - np.float32(1)


def draw(choices: list[list[Choice]], policy: str = "best", seed: int = 0, temperature: float = 1.0) -> list[int]:
    """Index of a class for each unit. Only units with several use the generator."""
    if policy not in ("best", "uniform", "weighted"):
        raise ValueError("policy must be best, uniform or weighted")
    if policy == "weighted" and not (temperature > 0 and np.isfinite(temperature)):
        raise ValueError("temperature must be positive")
    out, step = [], 0
    for found in choices:
        if len(found) == 1:
            out.append(0)
        elif policy == "best":
            out.append(next(k for k, c in enumerate(found) if c.selected))
        else:
            step += 1
            number = splitmix(seed, step)
            if policy == "uniform":
                out.append(number % len(found))
                continue
            scores = np.array([c.score for c in found], dtype=np.float32) / np.float32(temperature)
            weights = np.exp(scores - scores.max(), dtype=np.float32)
            total = np.float32(0)
            for w in weights:
                total = np.float32(total + w)
            target, reached, pick = np.float32(unit_float(number) * total), np.float32(0), len(found) - 1
            for k, w in enumerate(weights):
                reached = np.float32(reached + w)
                if target < reached:
                    pick = k
                    break
            out.append(pick)
    return out


def collapse_table(candidates: DataFrame) -> DataFrame:
    """``collapse`` for rows of ``doc_id``, ``unit_idx``, ``cuts``, ``status``, ``score``, ``selected``.

    Scores are added up in double precision: exp, sum, log about the greatest.
    """
    top = F.max("score")
    grouped = candidates.groupBy("doc_id", "unit_idx", "status", "cuts").agg(
        F.count("*").alias("analysis_count"), top.alias("_top"), F.collect_list("score").alias("_scores"), F.max("selected").alias("selected")
    )
    total = F.aggregate("_scores", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("_top")))
    return grouped.select("doc_id", "unit_idx", "status", "cuts", "analysis_count", (F.col("_top") + F.log(total)).alias("score"), "selected")


def _let(column: Column, use) -> Column:
    """``use`` of a column that is worked out once, as a lambda's variable."""
    return F.transform(F.array(column), use)[0]


def _mul(column: Column, factor: int) -> Column:
    return _let(column, lambda c: _product(c, factor))


def _product(column: Column, factor: int) -> Column:
    """Wrapping 64-bit product, by 32-bit halves, as integer columns raise on overflow."""
    low, high = factor & 0xFFFFFFFF, factor >> 32
    a, b = column.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(column, 32)
    # each partial product is split again to stay below 2^63
    a0, a1 = a.bitwiseAND(F.lit(0xFFFF)), F.shiftrightunsigned(a, 16)
    first = a0 * F.lit(low)
    second = a1 * F.lit(low)
    cross = (_low32(a0 * F.lit(high)) + F.shiftleft(_low32(a1 * F.lit(high)).bitwiseAND(F.lit(0xFFFF)), 16) + _low32(b.bitwiseAND(F.lit(0xFFFF)) * F.lit(low)) + F.shiftleft(_low32(F.shiftrightunsigned(b, 16) * F.lit(low)).bitwiseAND(F.lit(0xFFFF)), 16))
    lower = first + F.shiftleft(second.bitwiseAND(F.lit(0xFFFF)), 16)
    upper = F.shiftrightunsigned(second, 16) + F.shiftrightunsigned(lower, 32) + cross
    return F.shiftleft(upper.bitwiseAND(F.lit(0xFFFFFFFF)), 32).bitwiseOR(_low32(lower))


def _low32(column: Column) -> Column:
    return column.bitwiseAND(F.lit(0xFFFFFFFF))


def _add(left: Column, right: Column) -> Column:
    low = _low32(left) + _low32(right)
    high = F.shiftrightunsigned(left, 32) + F.shiftrightunsigned(right, 32) + F.shiftrightunsigned(low, 32)
    return F.shiftleft(_low32(high), 32).bitwiseOR(_low32(low))


def splitmix_column(seed: int, step: Column) -> Column:
    """``splitmix`` on a column of steps, as a signed number with the same bits."""
    signed = lambda v: F.lit(v - (1 << 64) if v >> 63 else v).cast("long")
    turned = lambda column, bits: _let(column, lambda c: c.bitwiseXOR(F.shiftrightunsigned(c, bits)))
    value = _let(_mul(step.cast("long"), GAMMA), lambda c: _add(c, signed(seed & _MASK)))
    value = _mul(turned(value, 30), 0xBF58476D1CE4E5B9)
    value = _mul(turned(value, 27), 0x94D049BB133111EB)
    return turned(value, 31)
