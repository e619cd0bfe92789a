"""Deltas to attack hypotheses, their ranking, and investigation candidates."""

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netloom.functions import ip, ladders
from netloom.functions.numeric import flag, rnd, unit
from netloom.functions.text import dedup_evidence, labels, role_display, words
from netloom.limits import best
from netloom.operators.ordered import global_rank


@dataclass(frozen=True)
class Definition:
    """A hypothesis type. Pass a changed dictionary of these to replace, add or remove types."""

    title: str
    severity: str
    signals: list = field(default_factory=list)
    weights: dict = field(default_factory=dict)


# Titles, severities, signals and weights of the hypothesis types.
DEFINITIONS = {
    "port_scan": Definition(
        "Port Scan", "medium", ["new_relationship_count", "unique_ports_delta", "low_persistence"],
        {"new_relationship_count": 0.45, "unique_ports_delta": 0.25, "low_persistence": 0.20, "risk_delta": 0.10},
    ),
    "host_sweep": Definition(
        "Host Sweep", "medium", ["new_peer_count", "external_host_delta", "steady_port_pattern"],
        {"new_peer_count": 0.40, "external_host_delta": 0.25, "steady_port_pattern": 0.20, "risk_delta": 0.15},
    ),
    "beaconing": Definition(
        "Beaconing", "high", ["periodicity", "persistence", "external_relationship"],
        {"periodicity": 0.35, "persistence": 0.35, "external_relationship": 0.20, "risk_delta": 0.10},
    ),
    "persistent_tls": Definition(
        "Persistent TLS", "high", ["https_persistence", "external_tls", "session_duration"],
        {"https_persistence": 0.45, "external_tls": 0.35, "risk_delta": 0.20},
    ),
}
TYPE_ORDER = ["port_scan", "host_sweep", "beaconing", "persistent_tls"]
CRITICALITY = {"DOMAIN_CONTROLLER": 100.0, "INFRASTRUCTURE": 80.0, "SERVER": 70.0, "WORKSTATION": 50.0, "EXTERNAL_SERVICE": 20.0}
RECOMMENDED = ["inspect endpoint", "review EDR telemetry", "check destination reputation", "examine process activity"]


def weighted_score(weights: dict, values: dict):
    """Weighted mean of signal values in percent; a signal without a value counts 0."""
    total = F.lit(0.0)
    for signal, weight in weights.items():
        if signal in values:
            total = total + values[signal] * weight
    whole = sum(weights.values())
    return rnd(total / whole * 100.0, 2) if whole else F.lit(0.0)


def destination_pair(deltas: DataFrame) -> DataFrame:
    """consumer and destination: the private end consumes, the public end is the destination; else as observed."""
    n = ip.with_numbers(deltas, s_num="source", t_num="target").withColumns({"s_in": ip.is_private(F.col("s_num")), "t_in": ip.is_private(F.col("t_num"))})
    turned = F.col("t_in") & ~F.col("s_in")
    return n.withColumns({
        "consumer": F.when(turned, F.col("target")).otherwise(F.col("source")), "destination": F.when(turned, F.col("source")).otherwise(F.col("target")),
    }).drop("s_num", "t_num", "s_in", "t_in")


def destination_consumers(pairs: DataFrame) -> DataFrame:
    """Distinct consumers per destination over all relationship deltas.

    Pairs are made distinct first, so a destination that every host uses is counted in parallel.
    """
    # source and target are the same two addresses; a filter on them is pushed to the scan
    seen = pairs.where((F.col("source") != F.col("target")) & F.col("source").isNotNull())
    distinct = seen.select("capture_id", "destination", "consumer").distinct()
    return distinct.groupBy("capture_id", "destination").agg(F.count(F.lit(1)).alias("consumer_count"))


def rarity(consumers):
    return F.when(consumers <= 0, F.lit(0.0)).otherwise(rnd(F.lit(1.0) / F.greatest(consumers, F.lit(1)), 4))


def exclusivity(consumers):
    return F.when(consumers <= 0, F.lit(0.0)).when(consumers == 1, F.lit(1.0)).otherwise(
        rnd(F.greatest(F.lit(1.0) - (consumers - 1) / F.lit(12.0), F.lit(0.0)), 4)
    )


def _one_digit(value):
    return F.format_string("%.1f", rnd(value, 1))


def _finding(kind: str, d: Definition, **c):
    empty = F.array().cast("array<string>")
    return [
        "capture_id", F.concat(F.lit(f"{kind}:"), F.col("delta_id")).alias("hypothesis_id"), F.lit(kind).alias("hypothesis_type"), F.lit(d.title).alias("title"),
        c["summary"].alias("summary"), c["entities"].alias("impacted_entities"), F.array("delta_id").alias("supporting_delta_ids"),
        dedup_evidence(c["evidence"]).alias("supporting_evidence"), c.get("against", empty).alias("contradictory_evidence"),
        c["explanation"].alias("confidence_explanation"), F.col("conf").alias("confidence"), c.get("severity", F.lit(d.severity)).alias("severity"),
        ladders.finding_tier(F.col("conf")).alias("finding_tier"), c.get("signals", words(d.signals)).alias("signals"),
        *[c.get(n, F.lit(None)).cast(t).alias(n) for n, t in (
            ("consumer", "string"), ("destination", "string"), ("consumer_count", "bigint"), ("rarity_score", "double"), ("exclusivity_score", "double"))],
    ]


def hyp_port_scan(deltas: DataFrame, d: Definition = DEFINITIONS["port_scan"]) -> DataFrame:
    c = F.col
    n, ports = F.coalesce("new_relationship_count", F.lit(0)), F.coalesce("unique_ports_delta", F.lit(0))
    score = weighted_score(d.weights, {
        "new_relationship_count": unit(n / 10), "unique_ports_delta": unit(ports / 10),
        "low_persistence": flag(c("low_persistence_ratio") >= 0.75), "risk_delta": unit(F.abs(F.coalesce("risk_score_delta", F.lit(0.0))) / 30),
    })
    hit = deltas.where(c("delta_type").isin("host_behavior_change", "risk_increase", "risk_decrease") & (n >= 5) & (ports >= 4)).withColumn("conf", score)
    return hit.select(*_finding(
        "port_scan", d, entities=F.array("entity_id"), evidence=F.array(F.concat(F.lit("new_relationships="), n), F.concat(F.lit("ports_added="), ports)),
        summary=F.concat(F.lit("Host "), c("entity_id"), F.lit(" exhibits port scan indicators based on newly observed relationships and port expansion.")),
        explanation=F.concat(F.lit("Port scan confidence based on "), n, F.lit(" new relationships and "), ports, F.lit(" new ports.")),
    ))


def hyp_host_sweep(deltas: DataFrame, d: Definition = DEFINITIONS["host_sweep"]) -> DataFrame:
    c = F.col
    peers, ext = F.coalesce("new_peer_count", "new_relationship_count", F.lit(0)), F.coalesce("external_host_delta", F.lit(0))
    score = weighted_score(d.weights, {
        "new_peer_count": unit(peers / 10), "external_host_delta": unit(ext / 5),
        "steady_port_pattern": flag(c("same_port_peer_count") >= 0.75), "risk_delta": unit(F.abs(F.coalesce("risk_score_delta", F.lit(0.0))) / 30),
    })
    hit = deltas.where(c("delta_type").isin("host_behavior_change", "risk_increase", "risk_decrease") & (peers >= 4) & (ext >= 2)).withColumn("conf", score)
    return hit.select(*_finding(
        "host_sweep", d, entities=F.array("entity_id"), evidence=F.array(F.concat(F.lit("new_peers="), peers), F.concat(F.lit("external_hosts="), ext)),
        summary=F.concat(F.lit("Host "), c("entity_id"), F.lit(" exhibits host sweep indicators with many new peer relationships.")),
        explanation=F.concat(F.lit("Host sweep confidence based on "), peers, F.lit(" new peer connections across "), ext, F.lit(" external hosts.")),
    ))


def _speaks_tls():
    return F.arrays_overlap("protocols", words(["https", "tls"]))


def hyp_beaconing(deltas: DataFrame, hosts: DataFrame, d: Definition = DEFINITIONS["beaconing"]) -> DataFrame:
    """Three signals are needed: only emerging external relationships with persistence of .55 and more have them.

    The few that do are joined with the consumer counts of their destinations and the role of their target.
    """
    c = F.col
    pairs = destination_pair(deltas.where("entity_type = 'relationship'"))
    consumers = destination_consumers(pairs)
    hit = pairs.where((c("delta_type") == "external_relationship_emergence") & _speaks_tls() & (c("persistence") >= 0.55))
    roles = hosts.select("capture_id", c("ip_address").alias("target"), c("role").alias("target_role"))
    j = hit.join(consumers, ["capture_id", "destination"], "left").join(roles, ["capture_id", "target"], "left")
    j = ip.with_numbers(j, dest_num="destination").withColumn("consumer_count", F.coalesce("consumer_count", F.lit(0)))
    k = c("consumer_count")
    j = j.withColumns({"rarity_score": rarity(k), "exclusivity_score": exclusivity(k), "cloud": ip.common_cloud_ip(c("dest_num"))})
    against = [
        ("infrastructure_role", F.coalesce(c("target_role").isin("INFRASTRUCTURE", "DOMAIN_CONTROLLER"), F.lit(False)), F.lit(0.25)),
        ("shared_destination", k >= 2, F.least(k * 0.015, F.lit(0.20))),
        ("many_internal_consumers", k >= 8, F.lit(0.15)),
        ("high_destination_fan_in", k >= 20, F.lit(0.15)),
        ("common_cloud_service", c("cloud"), F.lit(0.18)),
    ]
    penalty = sum((F.when(t, v).otherwise(F.lit(0.0)) for _, t, v in against), F.lit(0.0))
    p = c("persistence")
    score = weighted_score(d.weights, {"periodicity": unit(p), "persistence": unit(p), "external_relationship": F.lit(1.0)}) / 100.0
    signals = [
        ("periodicity", F.lit(True)), ("persistence", F.lit(True)), ("external_relationship", F.lit(True)), ("low_jitter", p >= 0.70),
        ("low_volume", F.coalesce("flows", F.lit(1)) <= 5), ("rare_destination", c("rarity_score") >= 0.5), ("exclusive_destination", c("exclusivity_score") >= 0.75),
    ]
    j = j.withColumns({
        "raw": F.least(score + (c("rarity_score") * 0.14 + c("exclusivity_score") * 0.16), F.lit(0.92)) - penalty,
        "found": labels(*signals), "contra": labels(*[(n, t) for n, t, _ in against]),
    })
    # a generator in place of a filter: a filter would be pushed below and repeat the whole score there
    j = j.withColumn("conf", F.explode(F.when(c("raw") >= 0.60, F.array(rnd(c("raw") * 100, 1)))))
    listed = F.array_join(F.transform(F.array_sort("found"), lambda x: F.concat(F.lit("+ "), x)), ", ")
    negative = F.when(F.size("contra") == 0, F.lit("- none observed")).otherwise(F.array_join(F.transform("contra", lambda x: F.concat(F.lit("- "), x)), ", "))
    severity = F.when(c("raw") >= 0.95, "critical").when(c("raw") >= 0.85, "high").when(c("raw") >= 0.75, "medium").otherwise("low")
    return j.select(*_finding(
        "beaconing", d, entities=F.array("source", "target"), evidence=c("found"), against=c("contra"), severity=severity, signals=F.array_sort("found"),
        summary=F.concat(F.lit("TLS beaconing: "), c("source"), F.lit(" <-> "), c("target")),
        explanation=F.concat(F.lit("Confidence "), _one_digit(c("conf")), F.lit("%. Positive: "), listed, F.lit(". Negative: "), negative, F.lit(".")),
        consumer=c("consumer"), destination=c("destination"), consumer_count=k, rarity_score=c("rarity_score"), exclusivity_score=c("exclusivity_score"),
    ))


def hyp_persistent_tls(deltas: DataFrame, d: Definition = DEFINITIONS["persistent_tls"]) -> DataFrame:
    c = F.col
    j = destination_pair(deltas.where((c("delta_type") == "persistence_increase") & _speaks_tls()))
    external = F.when(c("consumer") != c("destination"), F.lit(1.0)).otherwise(F.lit(0.5))
    hit = j.withColumn("conf", weighted_score(d.weights, {"https_persistence": unit(c("persistence")), "external_tls": external}))
    share = F.concat(_one_digit(c("persistence") * 100), F.lit("%"))
    return hit.select(*_finding(
        "persistent_tls", d, entities=F.array("source", "target"), evidence=F.array(F.concat(F.lit("https_persistence="), share)),
        summary=F.concat(F.lit("Relationship "), c("source"), F.lit("->"), c("target"), F.lit(" shows persistent TLS behavior.")),
        explanation=F.concat(F.lit("Persistent TLS confidence based on "), share, F.lit(" persistence ratio.")), consumer=c("consumer"), destination=c("destination"),
    ))


def all_hypotheses(host_deltas: DataFrame, relationship_deltas: DataFrame, hosts: DataFrame, definitions: dict = DEFINITIONS) -> DataFrame:
    """Findings of the defined types, before ranking."""
    makers = {
        "port_scan": lambda d: hyp_port_scan(host_deltas, d), "host_sweep": lambda d: hyp_host_sweep(host_deltas, d),
        "beaconing": lambda d: hyp_beaconing(relationship_deltas, hosts, d), "persistent_tls": lambda d: hyp_persistent_tls(relationship_deltas, d),
    }
    parts = [makers[k](definitions[k]) for k in TYPE_ORDER if k in definitions]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def confidence_filter(hypotheses: DataFrame, least: float = 60.0) -> DataFrame:
    return hypotheses.where(F.col("confidence") >= least)


_FIRST, _SECOND = "impacted_entities[0]", "try_element_at(impacted_entities, 2)"


def dedup_reverse_pairs(hypotheses: DataFrame) -> DataFrame:
    """Of a beaconing pair seen in both directions the first in (source, target) order stays."""
    keyed = hypotheses.withColumn("pair", F.when(F.col("hypothesis_type") == "beaconing", F.array_sort("impacted_entities")).otherwise(F.array("hypothesis_id")))
    w = Window.partitionBy("capture_id", "pair").orderBy(F.expr(_FIRST), F.expr(_SECOND), "hypothesis_id")
    return keyed.withColumn("i", F.row_number().over(w)).where("i = 1").drop("i", "pair")


def top_n_limits(hypotheses: DataFrame, per_host: int | None = 3) -> DataFrame:
    """One finding per beaconing pair; of the others the best three per impacted host, each once."""
    c = F.col
    order = [F.desc("confidence"), F.expr("severity <> 'critical'"), F.expr(_FIRST), F.expr(_SECOND), "hypothesis_id"]
    beacon = c("hypothesis_type") == "beaconing"
    by_pair = Window.partitionBy("capture_id", F.array_sort("impacted_entities")).orderBy(*order)
    pairs = hypotheses.where(beacon).withColumn("i", F.row_number().over(by_pair)).where("i = 1").drop("i")
    by_host = Window.partitionBy("capture_id", "entity").orderBy(*order)
    rest = hypotheses.where(~beacon).withColumn("entity", F.explode("impacted_entities"))
    rest = best(rest, by_host, per_host)
    return pairs.unionByName(rest.drop("i", "entity").dropDuplicates(["capture_id", "hypothesis_id"]))


def investigation_host(hypotheses: DataFrame, hosts: DataFrame) -> DataFrame:
    """host: the consumer, else the riskiest known entity, else the first. Role and risk of that host come along."""
    c = F.col
    known = hosts.select("capture_id", c("ip_address").alias("entity"), "risk_score")
    pointed = hypotheses.select("capture_id", "hypothesis_id", F.posexplode("impacted_entities").alias("pos", "entity")).join(known, ["capture_id", "entity"])
    riskiest = pointed.groupBy("capture_id", "hypothesis_id").agg(F.max_by("entity", F.struct("risk_score", -c("pos"))).alias("riskiest"))
    named = hypotheses.join(riskiest, ["capture_id", "hypothesis_id"], "left").withColumn("host", F.coalesce("consumer", "riskiest", F.expr(_FIRST), F.lit("unknown"))).drop("riskiest")
    facts = hosts.select("capture_id", c("ip_address").alias("host"), c("risk_score").alias("host_risk"), c("role").alias("host_role"), "role_confidence",
                         "external_unique_hosts", "internal_unique_hosts", F.slice("protocols", 1, 5).alias("top_protocols"))
    return named.join(facts, ["capture_id", "host"], "left").withColumns({
        "host_risk": F.coalesce("host_risk", F.lit(0.0)), "host_role": F.coalesce("host_role", F.lit("UNKNOWN")),
    })


def priority_score(risk, confidence, criticality):
    return rnd(risk * 0.35 + confidence * 0.35 + criticality * 0.30, 2)


def criticality(frame: DataFrame) -> DataFrame:
    chain = F.when(ip.is_public(F.col("host_num")), F.lit(20.0))
    for role, value in CRITICALITY.items():
        chain = chain.when(F.col("host_role") == role, F.lit(value))
    return ip.with_numbers(frame, host_num="host").withColumn("asset_criticality_score", chain.otherwise(F.lit(40.0))).drop("host_num")


def placed(rows: DataFrame, order: list, levels: list[str], top: int | None, **limits) -> DataFrame:
    """`place` in the capture from 1: the first `top` rows, or all, whose places are counted by chunks of the order (`levels`)."""
    if top is None:
        ranked = global_rank(rows, ["capture_id"], levels, order, "place", start=1, **limits)
        return ranked.withColumn("place", F.col("place").cast("int"))
    return best(rows, Window.partitionBy("capture_id").orderBy(*order), top, "place")


def scored_hypotheses(found: DataFrame, hosts: DataFrame, per_host: int | None = 3) -> DataFrame:
    """Filtered, made distinct, limited per host and scored."""
    c = F.col
    kept = top_n_limits(dedup_reverse_pairs(confidence_filter(found)), per_host)
    scored = criticality(investigation_host(kept, hosts)).withColumn("priority_score", priority_score(c("host_risk"), c("confidence"), c("asset_criticality_score")))
    return scored.withColumn("priority_level", ladders.priority_level(c("priority_score")))


def hypotheses(scored: DataFrame, capture_end: DataFrame, top: int | None = 10, **limits) -> DataFrame:
    """Ranked: the ten best of a capture, or all, with `place` from 1."""
    order = [F.desc("priority_score"), F.desc("confidence"), F.expr("hypothesis_type <> 'beaconing'"), F.expr(_FIRST), F.expr(_SECOND), "hypothesis_id"]
    levels = ["cast(floor(-priority_score * 100) AS bigint)", "cast(floor(-confidence * 100) AS bigint)", "cast(hypothesis_type <> 'beaconing' AS bigint)"]
    ranked = placed(scored, order, levels, top, **limits)
    return ranked.join(capture_end, "capture_id", "left")


FINDING = ["place", "hypothesis_id", "hypothesis_type", "finding_tier", "confidence", "supporting_evidence", "contradictory_evidence", "destination", "created_us"]


def host_summaries(ranked: DataFrame) -> DataFrame:
    """Per host: its findings among the ranked ones and the best of their scores."""
    c = F.col
    once = ["host_risk", "host_role", "role_confidence", "external_unique_hosts", "internal_unique_hosts", "top_protocols", "asset_criticality_score"]
    return ranked.groupBy("capture_id", "host").agg(
        *[F.min_by(n, "place").alias(n) for n in once], F.count(F.lit(1)).alias("hypothesis_count"), F.max("confidence").alias("highest_confidence"),
        F.max("priority_score").alias("priority_score"), F.array_sort(F.collect_list(F.struct(*FINDING))).alias("findings"), F.min("place").alias("first_place"),
    )


def investigation_candidates(summaries: DataFrame, top: int | None = 3, **limits) -> DataFrame:
    c = F.col
    order = [F.desc("priority_score"), F.desc("highest_confidence"), "first_place"]
    levels = ["cast(floor(-priority_score * 100) AS bigint)", "cast(floor(-highest_confidence * 100) AS bigint)", "first_place div 1000000L"]
    chosen = placed(summaries, order, levels, top, **limits)
    evidence = dedup_evidence(c("findings")[0]["supporting_evidence"])

    def has(name):
        return F.array_contains("rationale", name)

    text = (
        F.when(has("rare_destination") & has("exclusive_destination"), F.concat(
            F.lit("Host exhibits persistent low-volume communication with rare and exclusive external destination "), F.coalesce(c("findings")[0]["destination"], F.lit("")), F.lit(".")))
        .when(has("persistence") & has("periodicity"), "Host exhibits persistent communication with periodic timing behavior.")
        .otherwise("Host has prioritized findings based on risk, confidence, and asset criticality.")
    )
    return chosen.withColumn("rationale", evidence).select(
        "capture_id", "place", "host", "host_role", role_display(c("host_role")).alias("host_role_display"), ladders.priority_level(c("priority_score")).alias("priority"), "priority_score",
        rnd(c("host_risk") * 0.35, 2).alias("risk_contribution"), rnd(c("highest_confidence") * 0.35, 2).alias("confidence_contribution"),
        rnd(c("asset_criticality_score") * 0.30, 2).alias("criticality_contribution"), c("highest_confidence").alias("confidence"), c("host_risk").alias("risk"),
        "asset_criticality_score", text.alias("candidate_rationale"), "role_confidence", c("external_unique_hosts").alias("external_relationships"),
        c("internal_unique_hosts").alias("internal_relationships"), "top_protocols", "rationale", words(RECOMMENDED).alias("recommended_actions"), "findings",
        "hypothesis_count",
    )
