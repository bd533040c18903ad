"""Severities: scores, levels and risk codes to names, and what follows from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
ORDER = ["CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO"]
LEVELS = {"error": "HIGH", "warning": "MEDIUM", "note": "LOW", "info": "INFO"}
CONFIG_LEVELS = {"error": "HIGH", "warning": "MEDIUM", "note": "LOW", "none": "INFO"}
RISK_CODES = {"0": "INFO", "1": "LOW", "2": "MEDIUM", "3": "HIGH"}
WEIGHTS = {"critical": 1.5, "high": 1.3, "medium": 1.0, "low": 0.8}
ADVISORY_SCORES = {"critical": 9.5, "high": 7.5, "medium": 5.0, "low": 2.5}


def lookup(values: dict, key: Column, default=None) -> Column:
    """A literal table as an expression; null and unknown keys give the default."""
    return F.coalesce(*[F.when(key == k, F.lit(v)) for k, v in values.items()], F.lit(default))


def from_score(score: Column) -> Column:
    """A score of 9, 7, 4 or more is CRITICAL, HIGH, MEDIUM; less is LOW; null stays null."""
    return F.when(score >= 9, "CRITICAL").when(score >= 7, "HIGH").when(score >= 4, "MEDIUM").when(score.isNotNull(), "LOW")


def of_rule(score_text: Column, level: Column) -> Column:
    """By the rule's score if it is a number, else by the result's level, else UNKNOWN."""
    return F.coalesce(from_score(score_text.try_cast("double")), lookup(LEVELS, level, "UNKNOWN"))


def of_level(level: Column) -> Column:
    """A level of a configuration scan, MEDIUM if unknown or null."""
    return lookup(CONFIG_LEVELS, F.lower(level), "MEDIUM")


def of_risk(code: Column) -> Column:
    """A risk code, INFO if null, UNKNOWN if not one."""
    return lookup(RISK_CODES, F.coalesce(code, F.lit("0")), "UNKNOWN")


def of_advisory(text: Column) -> Column:
    """P5: the first severity word in a text, in the order of their weight; medium if none."""
    low = F.lower(text)
    return F.coalesce(*[F.when(F.contains(low, F.lit(w)), F.lit(w)) for w in ("critical", "high", "medium", "low")], F.lit("medium"))


def default_score(severity: Column) -> Column:
    """The score that stands for an advisory's severity; 5.0 if unknown."""
    return lookup(ADVISORY_SCORES, F.lower(severity), 5.0)


def importance(severity: Column, focus: Column, has_context: Column) -> Column:
    """Severity weight, by 1.2 for classification examples, by 1.1 with code context."""
    weight = lookup(WEIGHTS, F.lower(severity), 1.0)
    return weight * F.when(F.contains(F.coalesce(focus, F.lit("")), F.lit("vulnerability_classification")), 1.2).otherwise(1.0) * F.when(has_context, 1.1).otherwise(1.0)


def update_severity(releases: Column, latest: Column, now: Column) -> Column:
    """High with two security releases missed, or any within 180 days; medium with an older one, low without."""
    recent = F.coalesce(latest > now - F.expr("interval 180 days"), F.lit(False))
    return F.when(releases == 0, "low").when((releases >= 2) | recent, "high").otherwise("medium")


def update_score(releases: Column) -> Column:
    """The score that goes with so many security releases missed."""
    return F.when(releases == 0, 3.0).when(releases >= 2, 7.5).otherwise(5.5)


def overall_result(*statuses: Column) -> Column:
    """Failure if any failed, success if all succeeded, cancelled if any was, else skipped."""
    any_of = lambda v: F.exists(F.array(*statuses), lambda s: s == v)
    return F.when(any_of("failure"), "failure").when(F.forall(F.array(*statuses), lambda s: s == "success"), "success").when(any_of("cancelled"), "cancelled").otherwise("skipped")
