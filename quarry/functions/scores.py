"""Scores of chunks, functions and correlations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.maps import STRENGTH_SCORE, lookup

#: Words in a function's name that raise its focus.
FOCUS_NAMES = ["auth", "login", "password", "token", "encrypt", "decrypt", "validate"]


def density(tokens: Column, lines: Column) -> Column:
    """Tokens a line; 0 without lines."""
    return F.when(lines == 0, 0.0).otherwise(tokens / lines)


def usable_tokens(available: Column, reserved: Column, template: Column) -> Column:
    return F.greatest(F.lit(0), available - reserved - template)


def duration_seconds(start: Column, end: Column) -> Column:
    return (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 1_000_000


def strength_score(strength: Column) -> Column:
    return lookup(STRENGTH_SCORE, strength)


def function_priority(name: Column, complexity: Column, n_calls: Column) -> Column:
    """0.5; 0.2 more if public, 0.2 if complex, 0.1 with more than five calls; 1.0 at most."""
    public, hard = ~name.startswith("_"), complexity.isin("complex", "very_complex")
    return F.least(F.lit(1.0), 0.5 + F.when(public, 0.2).otherwise(0.0) + F.when(hard, 0.2).otherwise(0.0) + F.when(n_calls > 5, 0.1).otherwise(0.0))


def function_focus(name: Column, complexity: Column, mentioned: Column) -> Column:
    """0.8 if a finding mentions the function, else 0.6 for a telling name, else 0.4 if it is complex."""
    telling = F.lower(name).rlike("|".join(FOCUS_NAMES))
    return F.when(mentioned, 0.8).when(telling, 0.6).when(complexity.isin("complex", "very_complex"), 0.4).otherwise(0.0)


def partial_overlap(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Whether two spans overlap without being equal."""
    return (a_start <= b_end) & (b_start <= a_end) & ~((a_start == b_start) & (a_end == b_end))


def overlap_merges(share: Column, a_focus: Column, b_focus: Column) -> Column:
    return (share > 0.3) | ((a_focus > 0.7) & (b_focus > 0.7))
