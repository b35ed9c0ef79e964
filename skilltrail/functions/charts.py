"""Numbers behind the career page: bar scores, tiers and edge widths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Score axis of the learning plan and its tier names.
SCORE_AXIS = 4
SCORE_OFFSET = 0.75
TIERS = ["", "Weak", "Medium", "Strong", "Very Strong"]

# Thinnest and thickest line between a skill and a suggestion.
MIN_STROKE = 0.2
MAX_STROKE = 2.0


def bar_score(strength: Column, n_user_skills: Column) -> Column:
    """Length of a suggestion's bar."""
    return strength * F.lit(SCORE_AXIS + 1) / n_user_skills + F.lit(SCORE_OFFSET)


def strength_tier(score: Column) -> Column:
    """Name of the axis tick a bar has reached."""
    tick = F.floor(F.greatest(F.lit(0.0), F.least(score, F.lit(float(SCORE_AXIS)))))
    return F.element_at(F.array(*[F.lit(t) for t in TIERS]), (tick + 1).cast("int"))


def edge_width(strength: Column, low: Column, high: Column) -> Column:
    """Stroke width of an edge, scaled between the weakest and strongest one."""
    return F.pow(
        (strength - low + F.lit(MIN_STROKE)) * F.lit(MAX_STROKE) / (high - low + F.lit(MIN_STROKE)),
        F.lit(2.0),
    )
