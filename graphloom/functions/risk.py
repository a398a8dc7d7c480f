"""Risk and similarity formulas as column expressions, clustering proximity and the normalised entropy."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cap(x: Column, limit: float = 1.0) -> Column:
    return F.least(x, F.lit(float(limit)))


def nz(name: str, default: float = 0.0) -> Column:
    return F.coalesce(F.col(name).cast("double"), F.lit(float(default)))


def advisor_parts(rank: Column, complexity: Column, fan_out: Column, debt: Column, churn: Column, entropy: Column) -> dict[str, Column]:
    """MET-01: the weighted parts; their sum is the risk."""
    return {
        "gravity_part": 0.25 * rank, "complexity_part": 0.35 * cap(complexity / 20), "fan_out_part": 0.15 * cap(fan_out / 10),
        "debt_part": 0.05 * cap(debt / 5), "churn_part": 0.1 * cap(churn / 100), "entropy_part": 0.1 * entropy,
    }


# Weights of the composite risk for ordinary code and for fallbacks.
COMPOSITE = {"gravity": (0.25, 0.15), "complexity": (0.35, 0.30), "entropy": (0.10, 0.10), "churn": (0.10, 0.10), "fan_out": (0.15, 0.10), "fallback": (0.05, 0.25)}


def composite(is_fallback: Column, **signals: Column) -> Column:
    """MET-02: six signals whose weights depend on whether the code is a fallback."""
    total = F.lit(0.0)
    for name, (usual, other) in COMPOSITE.items():
        total = total + signals[name] * F.when(is_fallback, F.lit(other)).otherwise(F.lit(usual))
    return total


def fallback_risk(is_fallback: Column, confidence: Column, ratio: Column, complexity: Column, tenure: Column, naming: Column) -> Column:
    """MET-03."""
    unused = F.when(confidence > 0.7, (1 - ratio) * 0.4).otherwise(0.0)
    hard = F.when(complexity > 10, cap((complexity - 10) / 20, 0.3)).otherwise(0.0)
    old = F.when((tenure > 365) & (naming > 0.5), 0.3).otherwise(0.0)
    return F.when(is_fallback, cap(unused + hard + old)).otherwise(0.0)


def basic(rank: Column, entropy: Column, churn: Column, fan_out: Column) -> Column:
    """MET-04."""
    return 0.4 * rank + 0.3 * entropy + 0.2 * cap(churn / 100) + 0.1 * cap(fan_out / 10)


def basic_factors(rank: Column, entropy: Column, churn: Column, fan_out: Column, complexity: Column) -> Column:
    """MET-04: the thresholds that are passed."""
    named = ((rank > 0.7, "gravity"), (entropy > 0.6, "ownership"), (churn > 50, "churn"), (fan_out > 8, "fan_out"), (complexity > 50, "complexity"))
    return F.array_compact(F.array(*(F.when(test, F.lit(name)) for test, name in named)))


def split_score(gravity: Column, entropy: Column, churn: Column, cohesion: Column) -> Column:
    """MET-05, clamped to 0..1."""
    return F.greatest(F.lit(0.0), cap(0.4 * gravity + 0.3 * entropy + 0.2 * churn / 100 - 0.5 * cohesion + 0.5))


def path_proximity(a: Column, b: Column) -> Column:
    """GR-25: common leading segments over the mean number of segments."""
    x, y = F.split(a, "/"), F.split(b, "/")
    same = F.zip_with(x, y, lambda p, q: p.eqNullSafe(q))
    # the position of the first difference is the number of common leading segments
    common = F.coalesce(F.nullif(F.array_position(same, False), F.lit(0)) - 1, F.least(F.size(x), F.size(y)).cast("long"))
    common = F.least(common, F.least(F.size(x), F.size(y)).cast("long"))
    return common / ((F.size(x) + F.size(y)) / 2)


def jaccard(a: Column, b: Column) -> Column:
    """SET-05 over arrays; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


# What names of fallbacks hold.
FALLBACK_NAMES = (r"\b(fallback|default|legacy|compat)\b", r"\b(alternative|secondary|backup)\b", r"\b(legacy|old|deprecated)\b", r"\b(try|attempt)\b", r"\b(else|fail|error)\b")


def naming_score(name: Column) -> Column:
    """MET-08: the share of the five patterns that a name has."""
    low = F.lower(F.coalesce(name, F.lit("")))
    return sum((low.rlike(p).cast("int") for p in FALLBACK_NAMES), F.lit(0)) / len(FALLBACK_NAMES)
