"""Consistency checks over the finished tables."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.functions import ip
from netloom.functions.numeric import rnd, scaled
from netloom.functions.text import labels, normalize_role

CAP = "capture_id"


def community_audit(nodes: DataFrame) -> DataFrame:
    c = F.col
    return nodes.select(
        CAP, "ip_address", normalize_role(c("role")).alias("role"), rnd(c("role_confidence") * 100, 1).alias("role_confidence"), c("community_type").alias("community"),
        ip.is_private(c("ip_num")).alias("is_internal"), ip.is_public(c("ip_num")).alias("is_external"), "risk_score",
    )


def graph_consistency(nodes: DataFrame) -> DataFrame:
    c = F.col
    return nodes.groupBy(CAP).agg(
        F.count(F.lit(1)).alias("graph_nodes"), F.count("community_type").alias("classified_nodes"), F.count_distinct("community_type").alias("community_count"),
        F.count_if("non_investigative").alias("suppressed_nodes"),
    ).withColumns({
        "unclassified_nodes": F.greatest(c("graph_nodes") - c("classified_nodes"), F.lit(0)), "investigative_nodes": c("graph_nodes") - c("suppressed_nodes"),
        "valid": c("graph_nodes") == c("classified_nodes"),
    })


def role_mismatches(hosts: DataFrame, nodes: DataFrame, candidates: DataFrame) -> DataFrame:
    """Hosts whose role differs between profile, graph node and candidate."""
    c = F.col
    a = hosts.select(CAP, c("ip_address").alias("host"), normalize_role(c("role")).alias("host_profile_role"))
    b = nodes.select(CAP, c("ip_address").alias("host"), normalize_role(c("role")).alias("graph_node_role"))
    d = candidates.select(CAP, "host", normalize_role(c("host_role")).alias("investigation_candidate_role"))
    j = a.join(b, [CAP, "host"], "full_outer").join(d, [CAP, "host"], "full_outer")
    profile = c("host_profile_role").isNotNull() & ~c("host_profile_role").eqNullSafe(c("graph_node_role"))
    role = c("investigation_candidate_role")
    candidate = role.isNotNull() & (~role.eqNullSafe(c("host_profile_role")) | ~role.eqNullSafe(c("graph_node_role")))
    return j.where(profile | candidate)


def role_consistency(hosts: DataFrame, nodes: DataFrame, candidates: DataFrame) -> DataFrame:
    bad = role_mismatches(hosts, nodes, candidates).groupBy(CAP).agg(F.count(F.lit(1)).alias("bad"))
    n = hosts.groupBy(CAP).agg(F.count(F.lit(1)).alias("checked_hosts"))
    m = candidates.groupBy(CAP).agg(F.count(F.lit(1)).alias("m"))
    return n.join(m, CAP, "left").join(bad, CAP, "left").select(
        CAP, "checked_hosts", F.coalesce("m", F.lit(0)).cast("bigint").alias("candidate_hosts"), F.coalesce("bad", F.lit(0)).cast("bigint").alias("mismatch_count"),
        (F.coalesce("bad", F.lit(0)) == 0).alias("valid"),
    )


def _missing_text(name):
    return F.coalesce(F.col(name), F.lit("")) == ""


def _empty(name):
    return F.coalesce(F.size(name), F.lit(-1)) <= 0


def hypothesis_errors(hypotheses: DataFrame) -> DataFrame:
    missing = labels(
        ("supporting_evidence", _empty("supporting_evidence")), ("contradictory_evidence", F.col("contradictory_evidence").isNull()),
        ("confidence", F.col("confidence").isNull()), ("confidence_explanation", _missing_text("confidence_explanation")),
    )
    return hypotheses.withColumn("missing_fields", missing)


def candidate_errors(candidates: DataFrame) -> DataFrame:
    missing = labels(
        ("host", _missing_text("host")), ("priority", _missing_text("priority")), ("priority_score", F.col("priority_score").isNull()), ("host_role", _missing_text("host_role")),
        ("risk", F.col("risk").isNull()), ("findings", _empty("findings")), ("priority_explanation", F.col("risk_contribution").isNull()),
    )
    return candidates.withColumn("missing_fields", missing)


def validation(checked: DataFrame, captures: DataFrame) -> DataFrame:
    """Checked rows, rows with errors, and whether there are none."""
    counts = checked.groupBy(CAP).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.size("missing_fields") > 0).alias("e"))
    return captures.select(CAP).distinct().join(counts, CAP, "left").select(
        CAP, F.coalesce("n", F.lit(0)).cast("bigint").alias("checked"), F.coalesce("e", F.lit(0)).cast("bigint").alias("error_count"), (F.coalesce("e", F.lit(0)) == 0).alias("valid"))


def snapshot_quality_report(snapshots: DataFrame) -> DataFrame:
    c = F.col
    return snapshots.groupBy(CAP).agg(
        F.count(F.lit(1)).alias("total_snapshots"), F.count_if(c("quality_reason") == "useful_snapshot").alias("meaningful_snapshots"),
        F.count_if(c("quality_reason") == "redundant_snapshot").alias("redundant_snapshots"),
        rnd(F.sum(scaled(c("quality_score"), 2)) / F.count(F.lit(1)) / F.lit(100.0), 4).alias("quality_score"),
    ).withColumn("valid", c("quality_score") >= 0.90)


def readiness(hosts: DataFrame, nodes: DataFrame, hypotheses: DataFrame, candidates: DataFrame, captures: DataFrame) -> DataFrame:
    """ready, and the parts that a capture lacks."""
    c = F.col

    def count(frame, name):
        return frame.groupBy(CAP).agg(F.count(F.lit(1)).alias(name))

    chains = hypotheses.groupBy(CAP).agg(F.count_if(c("supporting_evidence").isNull() | c("contradictory_evidence").isNull()).alias("broken"))
    row = captures.select(CAP).distinct()
    for part in (count(hosts, "h"), count(hypotheses, "f"), chains, count(candidates, "k"), count(nodes, "g")):
        row = row.join(part, CAP, "left")

    def none(name):
        return F.coalesce(name, F.lit(0)) == 0

    missing = labels(("HostProfile", none("h")), ("AttackHypothesis", none("f")), ("EvidenceChain", F.coalesce("broken", F.lit(0)) > 0), ("InvestigationCandidate", none("k")), ("GraphContext", none("g")))
    return row.select(CAP, missing.alias("missing_components")).withColumn("ready", F.size("missing_components") == 0)


def stable(graph, roles, hypotheses, candidates, snapshots, ready: DataFrame) -> DataFrame:
    """All audits of a capture in one row."""
    c = F.col
    row = ready
    for name, frame in (("graph_valid", graph), ("roles_valid", roles), ("hypotheses_valid", hypotheses), ("candidates_valid", candidates), ("snapshots_valid", snapshots)):
        row = row.join(frame.select(CAP, c("valid").alias(name)), CAP, "left")
    parts = ["graph_valid", "roles_valid", "hypotheses_valid", "candidates_valid", "snapshots_valid", "ready"]
    both = F.lit(True)
    for p in parts:
        both = both & F.coalesce(c(p), F.lit(False))
    return row.withColumn("stable", both)
