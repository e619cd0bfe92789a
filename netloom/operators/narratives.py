"""Candidates to narratives: text from the primary finding and the types of all findings."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.functions.numeric import rnd
from netloom.functions.text import join_phrases, labels, ordered_distinct, words
from netloom.operators.ordered import global_rank

# The texts.
EVIDENCE_PHRASES = {
    "periodicity": "recurring communication timing",
    "persistence": "a relationship that persisted across the capture window",
    "external_relationship": "communication with an external destination",
    "rare_destination": "a rare external destination",
    "exclusive_destination": "a destination used only by this host",
    "low_volume": "low-volume traffic characteristics",
    "low_jitter": "stable timing between communications",
    "common_cloud_service": "the destination resembles common cloud service infrastructure",
    "shared_destination": "the destination is shared by multiple internal hosts",
    "many_internal_consumers": "many internal hosts use the same destination",
    "high_destination_fan_in": "the destination has high internal fan-in",
    "infrastructure_role": "the destination has an infrastructure-like role",
}
DRIVERS = {
    "high": {"exclusive_destination": "destination exclusivity", "rare_destination": "destination rarity"},
    "medium": {"periodicity": "periodic timing behavior", "low_jitter": "stable timing behavior", "persistence": "relationship persistence"},
    "low": {"low_volume": "low-volume communication", "external_relationship": "external communication path"},
}
REASONS = {
    "exclusive_destination": "The destination was observed exclusively for this host.",
    "rare_destination": "The destination was rare within the observed environment.",
    "periodicity": "Communication intervals remained consistent throughout the capture.",
    "low_jitter": "The timing pattern had limited variation between communications.",
    "persistence": "The relationship persisted across multiple observation windows.",
    "low_volume": "Traffic volume stayed low, which can make recurring communication less obvious in aggregate flow views.",
    "external_relationship": "The relationship crossed the internal network boundary to an external destination.",
}
_SCAN_ACTIONS = ["Review source host activity", "Inspect authentication logs"]
_TLS_ACTIONS = ["Inspect destination ownership", "Review process activity", "Verify application legitimacy"]
ACTIONS = {
    "beaconing": ["Review endpoint telemetry", "Identify initiating process", "Investigate destination", "Check EDR alerts"],
    "persistent_tls": _TLS_ACTIONS,
    "port_scan": [*_SCAN_ACTIONS, "Validate intended behavior"],
    "host_sweep": [*_SCAN_ACTIONS, "Validate intended behavior"],
}
PLANS = {
    "beaconing": [
        "Review endpoint telemetry for the host during the capture window",
        "Identify the process responsible for the external connection",
        "Review destination ownership and reputation using approved internal sources",
        "Correlate DNS and TLS activity for the destination",
        "Examine the user and process activity timeline around the recurring communications",
    ],
    "persistent_tls": _TLS_ACTIONS,
    "port_scan": [*_SCAN_ACTIONS, "Validate whether the scan pattern was expected administrative behavior"],
    "host_sweep": [*_SCAN_ACTIONS, "Validate whether the peer sweep was expected administrative behavior"],
}
FALLBACK_ACTIONS = ["Review endpoint telemetry", "Validate expected business activity", "Correlate with authentication and EDR data"]
SELECTION_REASON = "This host was selected because it represents the highest-priority investigation candidate identified during analysis."


def primary_hypothesis(candidates: DataFrame) -> DataFrame:
    """The most confident finding of tier PRIMARY, else the most confident."""
    best = F.filter("findings", lambda f: f["finding_tier"] == "PRIMARY")
    pool = F.when(F.size(best) > 0, best).otherwise(F.col("findings"))
    return candidates.withColumn("pool_", pool).withColumn("top_", F.array_max(F.transform("pool_", lambda f: f["confidence"]))).withColumn(
        "primary", F.filter("pool_", lambda f: f["confidence"] == F.col("top_"))[0]
    ).drop("pool_", "top_")


def environment_rank(candidates: DataFrame, nodes: DataFrame, **limits) -> DataFrame:
    """Place of each candidate among all nodes by risk.

    Nodes are placed by chunks of their order, so neither a window over all nodes nor a pair of each candidate and node is needed.
    """
    n = nodes.select("capture_id", F.col("ip_address").alias("host"), "risk_score")
    # after the risk the first four bytes of the address, then the next four
    levels = ["cast(floor(-risk_score * 100) AS bigint)"] + [f"cast(conv(rpad(substring(hex(host), {i}, 8), 8, '0'), 16, 10) AS bigint)" for i in (1, 9)]
    ranked = global_rank(n, ["capture_id"], levels, [F.desc("risk_score"), "host"], "environment_rank", start=1, **limits).select("capture_id", "host", "environment_rank")
    sizes = n.groupBy("capture_id").agg(F.count(F.lit(1)).alias("environment_size"))
    return candidates.select("capture_id", "host").join(ranked, ["capture_id", "host"], "left").join(sizes, "capture_id")


def evidence_phrases(items):
    known = F.create_map(*[F.lit(x) for pair in EVIDENCE_PHRASES.items() for x in pair])
    return ordered_distinct(F.transform(items, lambda e: F.coalesce(F.try_element_at(known, e), F.replace(e, F.lit("_"), F.lit(" ")))))


def confidence_drivers(evidence):
    return {level: labels(*[(label, F.array_contains(evidence, e)) for e, label in items.items()]) for level, items in DRIVERS.items()}


def confidence_explanation():
    def part(level, lead):
        return F.when(F.size(f"drivers_{level}") > 0, F.concat(F.lit(lead), join_phrases(F.col(f"drivers_{level}"), ""), F.lit("."))).otherwise("")

    some = F.size("drivers_high") + F.size("drivers_medium") + F.size("drivers_low") > 0
    return F.when(some, F.concat(
        F.lit("Overall confidence is elevated because multiple independent behavioral indicators support the same hypothesis."),
        part("high", " The strongest drivers are "), part("medium", " Additional support comes from "), part("low", " Lower-impact context includes "),
    )).otherwise("Confidence is based on multiple correlated behavioral indicators supporting the same hypothesis.")


def reasoning_text(evidence, kind):
    known = F.create_map(*[F.lit(x) for pair in REASONS.items() for x in pair])
    sentences = ordered_distinct(F.array_compact(F.transform(evidence, lambda e: F.try_element_at(known, e))))
    closing = F.when(kind == "beaconing", words(["Together, these characteristics are commonly associated with beaconing behavior."])).otherwise(words([]))
    whole = F.concat(sentences, closing)
    return F.when(F.size(whole) > 0, F.array_join(whole, " ")).otherwise(
        "The finding was prioritized because multiple behavioral indicators point to the same investigation path.")


def assessment(types, evidence):
    scan = F.arrays_overlap(types, words(["port_scan", "host_sweep"]))
    return F.array_join(labels(
        ("Observed activity is consistent with command-and-control beaconing.", F.array_contains(types, "beaconing")),
        ("Observed behavior indicates persistent encrypted communication.", F.array_contains(types, "persistent_tls")),
        ("Observed behavior suggests reconnaissance activity.", scan),
        ("The behavior exhibits persistence, timing regularity, and destination exclusivity.", F.arrays_overlap(evidence, words(["persistence", "periodicity", "exclusive_destination"]))),
        ("Additional endpoint investigation is recommended before concluding malicious activity.", F.lit(True)),
    ), " ")


def negative_findings(types):
    scan, tls = F.arrays_overlap(types, words(["port_scan", "host_sweep"])), F.array_contains(types, "persistent_tls")
    found = labels(
        ("No Layer 5 reconnaissance hypothesis was generated for this host during the capture.", ~scan),
        ("No separate persistent encrypted-channel hypothesis was generated beyond the observed beaconing behavior.", ~tls),
    )
    return F.when(F.size(found) > 0, found).otherwise(words(["No additional negative findings were identified from the currently implemented Layer 5 hypothesis set."]))


def _by_type(types, table):
    known = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), words(v))])
    listed = ordered_distinct(F.flatten(F.array_compact(F.transform(types, lambda t: F.try_element_at(known, t)))))
    return F.when(F.size(listed) > 0, listed).otherwise(words(FALLBACK_ACTIONS))


def recommended_actions(types):
    return _by_type(types, ACTIONS)


def investigation_plan(types):
    return F.slice(_by_type(types, PLANS), 1, 5)


def narratives(candidates: DataFrame, nodes: DataFrame) -> DataFrame:
    c = F.col
    n = primary_hypothesis(candidates).join(environment_rank(candidates, nodes), ["capture_id", "host"], "left").withColumns({
        "types": F.transform("findings", lambda f: f["hypothesis_type"]),
        "supporting": c("primary.supporting_evidence"), "contradictory": c("primary.contradictory_evidence"), "primary_type": c("primary.hypothesis_type"),
        "primary_id": c("primary.hypothesis_id"), "destination": c("primary.destination"),
        "supporting_hypotheses": F.transform("findings", lambda f: f["hypothesis_id"]),
    })
    n = n.withColumns({
        "phrases": evidence_phrases(c("supporting")), "against": evidence_phrases(c("contradictory")),
        **{f"drivers_{k}": v for k, v in confidence_drivers(c("supporting")).items()},
    })
    where = F.when(F.coalesce("destination", F.lit("")) != "", F.concat(F.lit(" with external destination "), c("destination"))).otherwise(" with an external destination")
    summary = F.concat(
        F.lit("Host "), c("host"), F.lit(" established persistent low-volume communication"), where,
        F.lit(". The behavior is unusual compared to other observed relationships and was prioritized for analyst investigation."))
    behaviour = F.when(F.size("phrases") > 0, F.concat(F.lit("The host demonstrated "), join_phrases(c("phrases"), ""), F.lit("."))).otherwise(
        "Observed behavior was prioritized based on the correlated investigation findings.")
    evidence = F.concat(F.lit("Supporting evidence includes "), join_phrases(c("phrases"), "no notable evidence"), F.when(
        F.size("against") == 0, F.lit(". No contradictory evidence was observed for the primary finding.")
    ).otherwise(F.concat(F.lit(". Contradictory context includes "), join_phrases(c("against"), ""), F.lit("."))))
    n = n.withColumns({
        "executive_summary": summary, "behavioral_summary": behaviour, "evidence_summary": evidence,
        "investigation_reasoning": reasoning_text(c("supporting"), c("primary_type")), "assessment": assessment(c("types"), c("supporting")),
        "negative_findings": negative_findings(c("types")), "confidence_explanation": confidence_explanation(),
        "recommended_actions": recommended_actions(c("types")), "investigation_plan": investigation_plan(c("types")), "selection_reason": F.lit(SELECTION_REASON),
    })
    filled = [c(x) != "" for x in ("executive_summary", "investigation_reasoning", "assessment", "confidence_explanation")] + [F.size(x) > 0 for x in ("investigation_plan", "negative_findings")]
    share = sum((F.when(t, F.lit(1)).otherwise(F.lit(0)) for t in filled), F.lit(0))
    return n.withColumn("narrative_quality_score", rnd(share / 6 * 100, 1)).drop("primary", "phrases", "against", "findings")
