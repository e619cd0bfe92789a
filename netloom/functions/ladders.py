"""Threshold ladders that turn scores into labels, and display values."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from netloom.functions.numeric import rnd


def _ladder(value: Column, steps, default: str) -> Column:
    chain = None
    for bound, label in steps:
        test = value >= F.lit(float(bound))
        chain = F.when(test, label) if chain is None else chain.when(test, label)
    return chain.otherwise(default)


def _graded(score, confidence, high, medium):
    adjusted = score * confidence
    return (
        F.when(adjusted >= F.lit(float(high)), "high")
        .when(adjusted >= F.lit(float(medium)), "medium")
        .when(score > 0, "low")
        .otherwise("informational")
    )


def flow_severity(score, confidence):
    return _graded(score, confidence, 55, 30)


def host_severity(score, confidence):
    return _graded(score, confidence, 48, 26)


def relationship_severity(score, confidence):
    return _graded(score, confidence, 52, 28)


def event_severity(score):
    return (
        F.when(score >= 90, "CRITICAL")
        .when(score >= 70, "HIGH")
        .when(score >= 40, "MEDIUM")
        .when(score > 0, "LOW")
        .otherwise("INFO")
    )


def event_severity_label(label):
    text = F.upper(F.coalesce(label, F.lit("")))
    return F.when(text.isin("CRITICAL", "HIGH", "MEDIUM", "LOW"), text).otherwise("INFO")


def priority_level(score):
    return _ladder(score, [(90, "CRITICAL"), (75, "HIGH"), (60, "MEDIUM"), (40, "LOW")], "INFORMATIONAL")


def fallback_priority_level(score):
    return _ladder(score, [(85, "CRITICAL"), (70, "HIGH"), (45, "MEDIUM")], "LOW")


def finding_tier(confidence):
    return _ladder(confidence, [(85, "PRIMARY"), (70, "SECONDARY")], "SUPPORTING")


def _color(score, confidence, high, medium):
    adjusted = score * confidence
    return (
        F.when(adjusted >= F.lit(float(high)), "#d95f3d")
        .when(adjusted >= F.lit(float(medium)), "#ffb347")
        .when(score > 0, "#f0d878")
        .otherwise("#7aa6c2")
    )


def host_color(score, confidence):
    return _color(score, confidence, 55, 30)


def edge_color(score, confidence):
    return _color(score, confidence, 52, 28)


def node_size(degree, risk):
    return rnd(F.least(F.lit(8.0) + degree * F.lit(0.35) + risk / 8, F.lit(42.0)), 2)


def edge_width(flows, risk):
    return rnd(F.least(F.lit(1.0) + flows / 12 + risk / 40, F.lit(8.0)), 2)


SEVERITY_RANKS = {"INFO": 0, "LOW": 1, "MEDIUM": 2, "HIGH": 3, "CRITICAL": 4}


def severity_rank(label: Column) -> Column:
    chain = F.when(label == "CRITICAL", 4)
    for name in ("HIGH", "MEDIUM", "LOW"):
        chain = chain.when(label == name, SEVERITY_RANKS[name])
    return chain.otherwise(0)


def rank_severity(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in SEVERITY_RANKS]), rank.cast("int") + 1)
