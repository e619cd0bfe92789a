"""Questions an analyst asks of the finished tables."""

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netloom.functions import ladders
from netloom.functions.numeric import rnd
from netloom.operators.ordered import global_rank
from netloom.operators.timeline import EVENTS_AT_ONCE

CAP = "capture_id"
# Up to this many first rows of a window are cut before the shuffle (spark.sql.optimizer.windowGroupLimitThreshold).
FIRST_ROWS = 1_000
# What is advised for a web finding.
WEB_ACTIONS = ["inspect endpoint", "review browser and process telemetry", "investigate destination domain", "preserve host identity evidence"]


def frame_lookup(frames: DataFrame, key: str) -> DataFrame:
    """A frame by its number or its id."""
    return frames.where((F.col("frame_number").cast("string") == key) | (F.col("frame_id") == key))


def replay_duration(frames: DataFrame) -> DataFrame:
    return frames.groupBy(CAP).agg(rnd((F.max("us") - F.min("us")) / F.lit(1e6), 4).alias("duration_seconds"))


def capture_summary(frames, events, chapters, nodes, hypotheses, candidates, stable, snapshots: DataFrame) -> DataFrame:
    """One row per capture: sizes, the leading host and destination, and the validation results.

    All tables go into one grouping, each with its own columns and nulls for the rest, so they meet in one shuffle of partial results.
    """
    c = F.col
    counted = {"event_count": events, "chapter_count": chapters, "hypothesis_count": hypotheses, "candidate_count": candidates}
    lead = {"hypothesis_count": ("destination", "primary_destination"), "candidate_count": ("host", "top_host")}
    parts = [frames.select(CAP, F.lit(1).alias("frame_count"), c("us").alias("frame_us")), nodes.select(CAP, F.lit(1).alias("node_count"), "community_type")]
    for name, frame in counted.items():
        first = [F.when(c("place") == 1, c(lead[name][0])).alias(lead[name][1])] if name in lead else []
        parts.append(frame.select(CAP, F.lit(1).alias(name), *first))
    verdicts = ["ready", "stable", "graph_valid", "roles_valid", "hypotheses_valid", "candidates_valid", "snapshots_valid"]
    parts += [stable.select(CAP, "missing_components", *verdicts), snapshots.select(CAP, c("quality_score").alias("snapshot_quality"))]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    total = rows.groupBy(CAP).agg(
        *[F.nullif(F.count(name), F.lit(0)).alias(name) for name in ("frame_count", *counted, "node_count")],
        # at most as many as communities have names
        F.size(F.collect_set("community_type")).cast("bigint").alias("community_count"),
        rnd((F.max("frame_us") - F.min("frame_us")) / F.lit(1e6), 4).alias("duration_seconds"),
        *[F.max(name).alias(name) for name in ("primary_destination", "top_host", "missing_components", *verdicts, "snapshot_quality")],
    )
    return total.where("frame_count IS NOT NULL")


def host_detail(hosts: DataFrame, nodes: DataFrame, timelines: DataFrame) -> DataFrame:
    """Hosts of the timeline with their profile, in its absence the facts of their node, and the figures of their events and chapters.

    Whole events and chapters are the rows of `host_timeline_events` and `host_timeline_chapters` with the same host.
    """
    c = F.col
    facts = hosts.select(CAP, c("ip_address").alias("host"), c("risk_score").alias("p_risk"), c("role").alias("p_role"), c("hostname").alias("p_hostname"), "mac_address", "user_identity")
    node = nodes.select(CAP, c("ip_address").alias("host"), c("risk_score").alias("n_risk"), c("role").alias("n_role"), c("hostname").alias("n_hostname"))
    j = timelines.join(facts, [CAP, "host"], "left").join(node, [CAP, "host"], "left")
    return j.withColumns({
        "risk": F.coalesce("p_risk", "n_risk", F.lit(0.0)), "role": F.coalesce("p_role", "n_role", F.lit("UNKNOWN")), "hostname": F.coalesce("p_hostname", "n_hostname"),
    }).drop("p_risk", "n_risk", "p_role", "n_role", "p_hostname", "n_hostname")


def ranked_hosts(hosts: DataFrame, candidates: DataFrame, hypotheses: DataFrame) -> DataFrame:
    """Candidates first, then by risk and confidence; `order_keys` sort the result."""
    c = F.col
    chosen = candidates.select(CAP, c("host").alias("ip_address"), c("risk").alias("c_risk"), c("confidence").alias("c_confidence"), c("priority").alias("c_priority"))
    counts = hypotheses.select(CAP, F.explode("impacted_entities").alias("ip_address")).groupBy(CAP, "ip_address").agg(F.count(F.lit(1)).alias("finding_count"))
    j = hosts.join(chosen, [CAP, "ip_address"], "left").join(counts, [CAP, "ip_address"], "left")
    return j.select(
        CAP, "ip_address", "role", "role_confidence", c("graph_cluster_group").alias("community"), "mac_address", "hostname", "user_identity",
        F.coalesce("c_risk", "risk_score").alias("risk"), F.when(c("c_risk").isNotNull(), "candidate").otherwise("none").alias("candidate_status"),
        F.coalesce("finding_count", F.lit(0)).cast("bigint").alias("finding_count"), F.coalesce("c_confidence", F.lit(0.0)).alias("confidence"),
        F.coalesce("c_priority", F.lit("LOW")).alias("priority"), c("external_unique_relationships").alias("external_relationships"),
        c("internal_unique_relationships").alias("internal_relationships"), F.slice("protocols", 1, 5).alias("top_protocols"),
    ).orderBy(CAP, F.expr("candidate_status <> 'candidate'"), F.desc("risk"), F.desc("confidence"), "ip_address")


def relationship_context(relationships: DataFrame, hypotheses: DataFrame, host: str | None = None) -> DataFrame:
    """Relationships with the finding on their pair, in either direction; optionally of one host."""
    c = F.col
    if host is not None:
        relationships = relationships.where((c("source") == host) | (c("target") == host))
    last = Window.partitionBy(CAP, "consumer", "destination").orderBy(F.desc("place"))
    pairs = hypotheses.where("consumer IS NOT NULL AND destination IS NOT NULL").withColumn("i", F.row_number().over(last)).where("i = 1")
    facts = F.struct("rarity_score", "exclusivity_score", "consumer_count", "supporting_evidence", "contradictory_evidence", "confidence_explanation")
    forward = pairs.select(CAP, c("consumer").alias("source"), c("destination").alias("target"), facts.alias("f1"))
    back = pairs.select(CAP, c("destination").alias("source"), c("consumer").alias("target"), facts.alias("f2"))
    j = relationships.join(forward, [CAP, "source", "target"], "left").join(back, [CAP, "source", "target"], "left").withColumn("f", F.coalesce("f1", "f2"))
    none = F.array().cast("array<string>")
    return j.select(
        CAP, "edge_id", "source", "target", c("relationship_risk").alias("risk"), "confidence", "severity", "protocols", "first_us", "last_us",
        c("f.rarity_score").alias("destination_rarity_score"), c("f.exclusivity_score").alias("destination_exclusivity_score"),
        c("f.consumer_count").alias("destination_consumer_count"), F.coalesce("f.supporting_evidence", none).alias("supporting_evidence"),
        F.coalesce("f.contradictory_evidence", none).alias("contradictory_evidence"), F.coalesce("f.confidence_explanation", F.lit("")).alias("confidence_explanation"),
    ).orderBy(CAP, F.desc("risk"), "source", "target")


def destination_intel(relationships: DataFrame, hypotheses: DataFrame) -> DataFrame:
    """Per destination with findings (ten at most per capture): its risk, consumers, rarity and evidence."""
    c = F.col
    found = hypotheses.where("destination IS NOT NULL")

    def evidence(name):
        return F.array_sort(F.array_distinct(F.flatten(F.collect_list(name))))

    d = found.groupBy(CAP, "destination").agg(
        F.min_by("consumer", "place").alias("related_host"), F.min_by("consumer_count", "place").alias("known_consumers"), F.min_by("rarity_score", "place").alias("rarity_score"),
        F.min_by("exclusivity_score", "place").alias("exclusivity_score"), evidence("supporting_evidence").alias("supporting_evidence"),
        evidence("contradictory_evidence").alias("contradictory_evidence"), F.count(F.lit(1)).alias("hypothesis_count"),
    )
    seen = relationships.join(d.select(CAP, c("destination").alias("target")), [CAP, "target"], "left_semi").groupBy(CAP, c("target").alias("destination")).agg(
        F.max("relationship_risk").alias("risk"), F.count(F.lit(1)).alias("consumers"))
    return d.join(seen, [CAP, "destination"], "left").withColumns({
        "risk": F.coalesce("risk", F.lit(0.0)), "consumer_count": F.coalesce("known_consumers", "consumers", F.lit(0)).cast("bigint"),
    }).drop("known_consumers", "consumers")


def context_fallback(flows: DataFrame, hosts: DataFrame, hypotheses: DataFrame, candidates: DataFrame) -> DataFrame:
    """The most suspicious web flow, for captures that have neither hypotheses nor candidates."""
    found = hypotheses.select(CAP).unionByName(candidates.select(CAP)).distinct()
    return web_finding(flows.join(found, CAP, "left_anti"), hosts)


def web_finding(flows: DataFrame, hosts: DataFrame) -> DataFrame:
    """The outbound web flow of each capture to its most suspicious domain, as a finding. Its texts are fixed values."""
    c = F.col
    web = flows.where((c("direction") == "outbound") & c("application_protocol").isin("http", "https")).withColumn("domain", c("web_domain")).where("domain IS NOT NULL")
    plain = c("application_protocol") == "http"
    w = Window.partitionBy(CAP).orderBy(plain.desc(), (c("domain").endswith(".su") | c("domain").endswith(".cc")).desc(), F.desc("packet_count"), "first_us", "first_seen_sequence")
    best = web.withColumn("i", F.row_number().over(w)).where("i = 1")
    facts = hosts.select(
        CAP, c("ip_address").alias("initiator_ip"), c("risk_score").alias("profile_risk"), c("role").alias("host_role"), "hostname", "mac_address", "user_identity",
        c("external_unique_relationships").alias("external_relationships"), c("internal_unique_relationships").alias("internal_relationships"),
        F.slice("protocols", 1, 5).alias("top_protocols"),
    )
    j = best.join(facts, [CAP, "initiator_ip"], "left").withColumns({
        "conf": F.when(plain, F.lit(78.0)).otherwise(F.lit(68.0)),
        "risk": F.greatest(F.coalesce("profile_risk", F.lit(0.0)), F.when(plain, F.lit(70.0)).otherwise(F.lit(60.0))),
    }).withColumn("priority_score", rnd(c("risk") * 0.35 + c("conf") * 0.35 + F.lit(50.0) * 0.30, 1))
    host, dest, domain = c("initiator_ip"), c("responder_ip"), c("domain")
    return j.select(
        CAP, F.concat_ws(":", F.lit("context"), host, dest, domain).alias("hypothesis_id"), F.lit("external_web_activity").alias("hypothesis_type"),
        F.lit("External Web Activity").alias("title"), F.concat(host, F.lit(" communicated with "), domain, F.lit(" at "), dest, F.lit(":"), c("responder_port")).alias("summary"),
        F.array(host, dest, domain).alias("impacted_entities"),
        F.array(F.lit("external_relationship"), F.concat(F.lit("domain_observed:"), domain), F.concat(F.lit("protocol:"), c("application_protocol")), F.lit("rare_destination")).alias("supporting_evidence"),
        F.concat(F.lit("Confidence "), c("conf").cast("int"), F.lit("%. Positive: external web relationship, observed domain "), domain,
                 F.lit(", rare destination context. Negative: no Layer 5 beaconing hypothesis was generated.")).alias("confidence_explanation"),
        c("conf").alias("confidence"), F.lit("medium").alias("severity"), "priority_score", ladders.fallback_priority_level(c("priority_score")).alias("priority_level"),
        host.alias("host"), F.coalesce("host_role", F.lit("UNKNOWN")).alias("host_role"), "risk",
        F.concat(F.lit("Host has externally visible web activity to rare domain "), domain, F.lit(" at "), dest, F.lit(".")).alias("candidate_rationale"),
        F.array().cast("array<string>").alias("contradictory_evidence"), F.lit("PRIMARY").alias("finding_tier"), F.lit("context_fallback").alias("source"),
        host.alias("relationship_consumer"), dest.alias("relationship_destination"), domain, c("responder_port").alias("destination_port"),
        F.lit(1).cast("bigint").alias("destination_consumer_count"), F.lit(1.0).alias("destination_rarity_score"), F.lit(1.0).alias("destination_exclusivity_score"),
        # the parts of the priority beside risk and confidence
        F.lit(50.0).alias("criticality"), "hostname", "mac_address", "user_identity",
        *[F.coalesce(n, F.lit(0)).cast("bigint").alias(n) for n in ("external_relationships", "internal_relationships")],
        F.coalesce("top_protocols", F.array().cast("array<string>")).alias("top_protocols"),
        F.array(F.lit("external_web_activity"), F.concat(F.lit("domain:"), domain), F.concat(F.lit("destination:"), dest)).alias("rationale"),
        F.array(*[F.lit(x) for x in WEB_ACTIONS]).alias("recommended_actions"),
    )


def community_context(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy(CAP, "community_type", "role").agg(F.count(F.lit(1)).alias("node_count"))


def event_search(events: DataFrame, severity: str | None = None, text: str = "", latest: int | None = 120) -> DataFrame:
    """The latest events of a severity that contain a text anywhere, per capture; `recent` counts back from the last hit.

    Up to a thousand hits the first of each input partition alone are shuffled; beyond that, or for all of them (latest None),
    places are counted by ranges of event numbers, so no window holds all hits of a capture.
    """
    c = F.col
    hit = events if severity is None else events.where(c("severity") == severity)
    if text:
        shown = F.to_json(F.struct("event_id", "us", "event_type", "severity", "host", "related_hosts", "description"))
        hit = hit.where(F.lower(shown).contains(text.lower()))
    if latest is not None and latest <= FIRST_ROWS:
        w = Window.partitionBy(CAP).orderBy(F.desc("event_index"))
        return hit.withColumn("recent", F.row_number().over(w)).where(c("recent") <= latest)
    back = hit.withColumn("back_", -c("event_index"))
    placed = global_rank(back, [CAP], [f"back_ div {EVENTS_AT_ONCE}L"], ["back_"], "recent", start=1, hot=None).drop("back_")
    return placed if latest is None else placed.where(c("recent") <= latest)


def capture_totals(flows: DataFrame, hosts: DataFrame) -> DataFrame:
    c = F.col
    f = flows.groupBy(CAP).agg(
        F.count(F.lit(1)).alias("flows"), F.sum(c("initiator_bytes") + c("responder_bytes")).alias("total_bytes"), F.count_if("suppressed").alias("suppressed_flows"),
        F.count("beacon_score").alias("beacon_eligible_flows"), F.count_if("is_suspicious").alias("suspicious_flows"),
    )
    h = hosts.groupBy(CAP).agg(F.count(F.lit(1)).alias("hosts"), F.count_if(c("risk_score") >= 35).alias("elevated_hosts"))
    return f.join(h, CAP)
