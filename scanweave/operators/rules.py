"""Verdict and gate rules as column expressions and small pivots."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def profile_gate(cosine: Column, rmse: Column, floor_mm: Column) -> Column:
    return (F.when((cosine > 0.95) & (rmse < 6 * floor_mm), "GREEN")
            .when((cosine < 0.7) | (rmse > 12 * floor_mm), "RED").otherwise("YELLOW"))


def removable(full: Column, without_a: Column, without_b: Column, margin: float) -> Column:
    """Which of two feature blocks the full model could do without."""
    both = (full < without_a - margin) & (full < without_b - margin)
    return (F.when(full.isNull() | without_a.isNull() | without_b.isNull(), "incomplete").when(both, "complementary")
            .when(F.abs(full - without_a) < margin, "scan_removable")
            .when(F.abs(full - without_b) < margin, "geometry_removable").otherwise("unclear"))


def majority(judgements, column: str, needed: int, order: tuple[str, ...], default: str):
    """One row: the first label of ``order`` with enough votes."""
    votes = {v: F.count_if(F.col(column) == v) for v in order}
    rule = F.lit(default)
    for v in reversed(order):
        rule = F.when(votes[v] >= needed, F.lit(v)).otherwise(rule)
    return judgements.agg(*[votes[v].alias(f"n_{v}") for v in order], rule.alias("verdict"))


def share_verdict(share: Column, low: float = 0.05, high: float = 0.20) -> Column:
    return (F.when(share.isNull(), "incomplete").when(share < low, "negligible").when(share < high, "bounded").otherwise("large"))


def count_verdict(passes: Column, all_: int, names: tuple[str, str, str]) -> Column:
    """All pass, none passes, or some pass."""
    return F.when(passes == all_, names[0]).when(passes == 0, names[2]).otherwise(names[1])


# Verdict labels, and the margins in dB that they rest on.
SETTINGS = ("GREEN", "YELLOW", "RED")
CONTROL = ("REAL_SIGNAL", "MARGINAL_DISTRIBUTION_DRIVEN", "NOT_SIGNAL")
FRAMEWORK = ("FRAMEWORK_ROBUST", "FRAMEWORK_PARTIAL", "FRAMEWORK_FRAGILE")
COMBINED = ("ROBUST_POSITIVE", "PARTIALLY_ROBUST", "ILLUSORY")
PIVOT = ("RECOVERABLE_HYPERPARAMS", "RECOVERABLE_VALIDATION_PROTOCOL", "PIVOT_JUSTIFIED")
WITHIN = ("WITHIN-SESSION-HELPS", "MIXED", "WITHIN-SESSION-NULL")
EXEMPLAR = ("R-4 IS A ROBUST EXEMPLAR", "R-4 IS PARTIALLY ROBUST", "R-4 IS ILLUSORY")
HELPS_DB, CLEARS_DB, SHIFTS_DB, FOLDS_NEEDED = 0.5, 1.0, 0.5, 3


def reached(delta: Column, margin: float, beyond: bool = False) -> Column:
    """1 where a gain is at least (or beyond) a margin, else 0; a missing gain reaches nothing."""
    return F.coalesce(((delta > margin) if beyond else (delta >= margin)).cast("int"), F.lit(0))


def settings_verdict(gains: list[Column]) -> Column:
    """Three settings vote: two that help make it green, two that don't red."""
    votes = sum(reached(g, HELPS_DB) for g in gains)
    best, middle, worst = SETTINGS
    return F.when(votes >= 2, best).when(len(gains) - votes >= 2, worst).otherwise(middle)


def control_verdict(real: Column, placebo: Column) -> Column:
    """Does the gain outdo that of shuffled columns, or is it there with them as well?"""
    signal, marginal, none = CONTROL
    return F.when(reached(real - placebo, HELPS_DB) == 1, signal).when(reached(placebo, HELPS_DB) == 1, marginal).otherwise(none)


def framework_verdict(gains: list[Column]) -> Column:
    """A second learner: robust if any setting helps, fragile if all settings lose; a missing setting doesn't lose."""
    robust, partial, fragile = FRAMEWORK
    lost = sum(reached(-g, 0.0, beyond=True) for g in gains)
    return F.when(sum(reached(g, HELPS_DB) for g in gains) > 0, robust).when(lost == len(gains), fragile).otherwise(partial)


def pivot_verdict(by_time: list[Column], at_random: list[Column], counterpart: list[Column]) -> Column:
    """What would bring the gain back: other settings, or validation rows drawn at random instead of by time.

    ``counterpart`` are the gains by time of the settings of ``at_random``.
    """
    settings, protocol, justified = PIVOT
    shifted = sum(reached(F.abs(r - t), SHIFTS_DB, beyond=True) for r, t in zip(at_random, counterpart))
    clears = lambda gains: sum(reached(g, CLEARS_DB, beyond=True) for g in gains)
    return F.when(clears(by_time) > 0, settings).when((shifted > 0) & (clears(at_random) > 0), protocol).otherwise(justified)


def within_verdict(clearing: Column) -> Column:
    """By the number of folds that clear the margin. The direction of the other folds is reported beside it: it
    never changes the label."""
    return count_verdict(F.when(clearing >= FOLDS_NEEDED, FOLDS_NEEDED).otherwise(clearing), FOLDS_NEEDED, WITHIN)


def exemplar_verdict(gains: list[Column]) -> Column:
    """Do all corrections of one region's gain leave it standing, some, or none?"""
    return count_verdict(sum(reached(g, HELPS_DB) for g in gains), len(gains), EXEMPLAR)


def fit_gate(r2: list[Column], moved: list[Column], limit: float = 3.0) -> tuple[Column, Column]:
    """Gate on fits that explain nearly everything, and a flag for a moved transmitter."""
    every = r2[0] > 0.85
    for r in r2[1:]:
        every = every & (r > 0.85)
    far = moved[0] > limit
    for m in moved[1:]:
        far = far | (m > limit)
    return F.when(every, "YELLOW").otherwise("GREEN"), far


def view_gate(valid_fraction: Column, width_deg: Column) -> Column:
    return F.when(valid_fraction < 0.30, "RED").when(width_deg < 120.0, "YELLOW").otherwise("GREEN")


def correlation_gate(n_strong: Column, n_demoted: Column, n_some: Column) -> Column:
    """Strong rank correlation in two sessions; demoted where the fit explains nothing."""
    return (F.when((n_strong >= 2) & (n_demoted == 0), "GREEN").when(n_strong >= 2, "YELLOW")
            .when(n_some >= 1, "YELLOW").otherwise("RED"))


def level_gate(value: Column, good: float, fair: float) -> Column:
    return F.when(value < good, "GREEN").when(value < fair, "YELLOW").otherwise("RED")
