"""Results to timeline events, phases and chapters."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netloom.functions import ladders
from netloom.functions.numeric import rnd
from netloom.functions.text import words
from netloom.functions.times import us_to_iso
from netloom.limits import best
from netloom.operators.ordered import global_rank, runs

CAP = "capture_id"
METADATA = {
    "flow_id": "string", "edge_id": "string", "hypothesis_id": "string", "hypothesis_type": "string", "protocol": "string", "packet_count": "bigint",
    "bytes": "bigint", "score": "double", "role": "string", "community": "string", "persistence": "double", "confidence": "double", "priority": "string",
    "priority_score": "double",
}
# Order of events is (us, event_id). Cuts that respect it: a second, a microsecond, four digits of the id.
EVENT_LEVELS = ["us div 1000000L", "us", "cast(conv(substring(event_id, 5, 4), 16, 10) AS bigint)"]
# Event numbers in a chunk where the numbers themselves cut the order.
EVENTS_AT_ONCE = 500_000
EVENT_ORDER = ["us", "event_id"]
# Event type -> phase, event type -> chapter, chapter -> (title, importance).
PHASES = {
    "dns_query": "Discovery", "dns_response": "Discovery", "connection_created": "Communication", "connection_closed": "Communication",
    "tls_established": "Communication", "http_session": "Communication", "relationship_created": "Communication", "relationship_persistent": "Persistence",
    "periodicity_detected": "Beaconing", "rare_destination_detected": "Beaconing", "beaconing_started": "Beaconing", "beaconing_confidence_increased": "Beaconing",
    "host_risk_increased": "Investigation", "host_role_assigned": "Investigation", "community_assigned": "Investigation", "community_changed": "Investigation",
    "hypothesis_created": "Investigation", "hypothesis_promoted": "Investigation", "candidate_created": "Investigation",
    "candidate_priority_changed": "Investigation", "narrative_generated": "Investigation",
}
CHAPTER_OF_EVENT = {
    "host_role_assigned": "INITIAL_ACTIVITY", "community_assigned": "INITIAL_ACTIVITY", "dns_query": "NETWORK_DISCOVERY", "dns_response": "NETWORK_DISCOVERY",
    "connection_created": "RELATIONSHIP_FORMATION", "connection_closed": "RELATIONSHIP_FORMATION", "tls_established": "EXTERNAL_COMMUNICATION",
    "http_session": "EXTERNAL_COMMUNICATION", "relationship_created": "RELATIONSHIP_FORMATION", "relationship_persistent": "PERSISTENT_COMMUNICATION",
    "periodicity_detected": "BEACONING_DEVELOPMENT", "rare_destination_detected": "BEACONING_DEVELOPMENT", "beaconing_started": "BEACONING_DEVELOPMENT",
    "beaconing_confidence_increased": "BEACONING_DEVELOPMENT", "host_risk_increased": "BEHAVIORAL_ESCALATION", "hypothesis_created": "INVESTIGATION_TRIGGER",
    "hypothesis_promoted": "INVESTIGATION_TRIGGER", "candidate_created": "INVESTIGATION_PRIORITY", "candidate_priority_changed": "INVESTIGATION_PRIORITY",
    "narrative_generated": "INVESTIGATION_PRIORITY",
}
CHAPTERS = {
    "INITIAL_ACTIVITY": ("Initial Network Activity", 30), "NETWORK_DISCOVERY": ("Network Discovery", 45),
    "RELATIONSHIP_FORMATION": ("Relationship Formation", 60), "EXTERNAL_COMMUNICATION": ("External Communication", 65),
    "PERSISTENT_COMMUNICATION": ("Persistent Communications", 75), "BEHAVIORAL_ESCALATION": ("Behavioral Escalation", 82),
    "BEACONING_DEVELOPMENT": ("Beaconing Indicators", 90), "INVESTIGATION_TRIGGER": ("Investigation Trigger", 95),
    "INVESTIGATION_PRIORITY": ("Investigation Priority", 100), "UNKNOWN": ("Unclassified Activity", 20),
}
CHAPTER_TEXTS = {
    "NETWORK_DISCOVERY": "Name-resolution and discovery activity provides early context for host communication paths.",
    "RELATIONSHIP_FORMATION": "Hosts begin forming observable network relationships that become part of the investigation timeline.",
    "PERSISTENT_COMMUNICATION": "One or more relationships persist across observation windows and become durable replay anchors.",
    "BEHAVIORAL_ESCALATION": "Behavioral scoring increases as risk-relevant activity accumulates.",
    "BEACONING_DEVELOPMENT": "Periodic and persistent communication patterns develop into a beaconing storyline.",
    "INVESTIGATION_TRIGGER": "Layer 5 hypotheses convert timeline behavior into analyst-facing investigation findings.",
    "INVESTIGATION_PRIORITY": "The investigation candidate and narrative milestones define the highest-priority replay jump targets.",
}


def _map(table: dict):
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def _event(us, kind, severity, host, description, related=None, **metadata):
    """Columns of one event; the id is a digest of what tells events apart."""
    related = words([]) if related is None else related
    kind = F.lit(kind) if isinstance(kind, str) else kind
    severity = F.lit(severity) if isinstance(severity, str) else severity
    marks = [metadata[n].cast("string") for n in ("flow_id", "edge_id", "hypothesis_id", "role", "community") if n in metadata]
    key = F.concat_ws("|", us.cast("string"), kind, host, F.array_join(related, ","), *marks)
    fields = [us.alias("us"), F.concat(F.lit("evt_"), F.substring(F.md5(key), 1, 12)).alias("event_id"), kind.alias("event_type"), severity.alias("severity"),
              host.alias("host"), related.alias("related_hosts"), description.alias("description")]
    return fields + [metadata.get(n, F.lit(None)).cast(t).alias(n) for n, t in METADATA.items()]


def network_events(flows: DataFrame, top: int | None = None) -> DataFrame:
    c = F.col
    w = Window.partitionBy(CAP).orderBy(F.desc("behavioral_score"), F.desc("packet_count"), "first_us", "first_seen_sequence")
    chosen = best(flows, w, top)
    p = c("application_protocol")
    kind = F.when(p == "dns", "dns_query").when(p == "http", "http_session").when((p == "https") | (c("responder_port") == 443), "tls_established").otherwise("connection_created")
    text = F.concat(F.upper(p), F.lit(" relationship observed between "), c("initiator_ip"), F.lit(" and "), c("responder_ip"))
    return chosen.select(CAP, *_event(
        c("first_us"), kind, ladders.event_severity(c("behavioral_score")), c("initiator_ip"), text, F.array("responder_ip"), flow_id=c("flow_id"), protocol=p,
        packet_count=c("packet_count"), bytes=c("initiator_bytes") + c("responder_bytes"), score=c("behavioral_score")))


def host_events(nodes: DataFrame) -> DataFrame:
    c = F.col
    role = _event(c("first_us"), "host_role_assigned", ladders.event_severity(c("risk_score")), c("ip_address"),
                  F.concat("ip_address", F.lit(" classified as "), "role"), role=c("role"), score=c("risk_score"))
    community = _event(c("first_us"), "community_assigned", "INFO", c("ip_address"),
                       F.concat("ip_address", F.lit(" assigned to "), "community_type"), community=c("community_type"))
    return nodes.select(CAP, F.explode(F.array(F.struct(*role), F.struct(*community))).alias("e")).select(CAP, "e.*")


def relationship_events(relationships: DataFrame, top: int | None = None) -> DataFrame:
    c = F.col
    w = Window.partitionBy(CAP).orderBy(F.desc("relationship_risk"), F.desc("packet_count"), F.desc("total_bytes"), "source", "target")
    chosen = best(relationships, w, top)
    kind = F.when(c("persistence") >= 0.5, "relationship_persistent").otherwise("relationship_created")
    text = F.concat(F.lit("Relationship observed between "), c("source"), F.lit(" and "), c("target"))
    return chosen.select(CAP, *_event(
        c("first_us"), kind, ladders.event_severity(c("relationship_risk")), c("source"), text, F.array("target"), edge_id=c("edge_id"),
        score=c("relationship_risk"), persistence=c("persistence")))


def timed_hypotheses(hypotheses: DataFrame, relationships: DataFrame) -> DataFrame:
    """Each finding at the time its relationship was last seen; without one, at its creation."""
    c = F.col
    first = F.coalesce(c("consumer"), c("impacted_entities")[0])
    second = F.coalesce(c("destination"), F.try_element_at("impacted_entities", F.lit(2)))
    h = hypotheses.withColumns({"a": first, "b": second})
    # an outer join shuffles all relationships however few findings there are, so those of no finding are left out where they lie
    asked = h.select(CAP, "a", "b").distinct()

    def seen(source, target, name):
        pairs = relationships.select(CAP, c(source).alias("a"), c(target).alias("b"), c("last_us").alias(name))
        return pairs.join(asked, [CAP, "a", "b"], "left_semi")

    forward = h.join(seen("source", "target", "t1"), [CAP, "a", "b"], "left")
    back = seen("target", "source", "t2")
    inside = F.filter("impacted_entities", lambda e: e.startswith("10.") | e.startswith("172.") | e.startswith("192.168."))
    return forward.join(back, [CAP, "a", "b"], "left").withColumns({
        "us": F.coalesce("t1", "t2", "created_us"), "primary_host": F.coalesce(F.try_element_at(inside, F.lit(1)), c("impacted_entities")[0], F.lit("")),
    }).drop("a", "b", "t1", "t2")


def hypothesis_events(timed: DataFrame) -> DataFrame:
    c = F.col
    others = F.filter("impacted_entities", lambda e: e != F.col("primary_host"))
    made = _event(c("us"), "hypothesis_created", ladders.event_severity_label(c("severity")), c("primary_host"), c("summary"), others,
                  hypothesis_id=c("hypothesis_id"), hypothesis_type=c("hypothesis_type"), confidence=c("confidence"), priority_score=c("priority_score"))
    beacon = _event(c("us"), "beaconing_started", ladders.event_severity(c("confidence")), c("primary_host"),
                    F.coalesce(F.nullif("confidence_explanation", F.lit("")), "summary"), others, hypothesis_id=c("hypothesis_id"))
    both = F.array_compact(F.array(F.struct(*made), F.when(c("hypothesis_type") == "beaconing", F.struct(*beacon))))
    return timed.select(CAP, F.explode(both).alias("e")).select(CAP, "e.*")


def candidate_times(candidates: DataFrame, timed: DataFrame) -> DataFrame:
    times = timed.groupBy(CAP, "host").agg(F.max("us").alias("us"))
    return candidates.join(times, [CAP, "host"], "left")


def candidate_events(candidates: DataFrame, timed: DataFrame) -> DataFrame:
    c = F.col
    return candidate_times(candidates, timed).select(CAP, *_event(
        c("us"), "candidate_created", ladders.event_severity_label(c("priority")), c("host"), c("candidate_rationale"), priority=c("priority"),
        priority_score=c("priority_score"), confidence=c("confidence"), score=c("risk")))


def narrative_events(narratives: DataFrame, timed: DataFrame) -> DataFrame:
    c = F.col
    return candidate_times(narratives, timed).select(CAP, *_event(
        c("us"), "narrative_generated", ladders.event_severity_label(c("priority")), c("host"), c("executive_summary"), priority=c("priority"),
        confidence=c("confidence"), score=c("narrative_quality_score")))


def event_correlation(events: DataFrame) -> DataFrame:
    """Of events with the same type, hosts and source the earliest stays."""
    source = F.coalesce("flow_id", "edge_id", "hypothesis_id", F.lit(""))
    w = Window.partitionBy(CAP, "event_type", "host", F.array_sort("related_hosts"), source).orderBy(*EVENT_ORDER)
    return events.withColumn("i", F.row_number().over(w)).where("i = 1").drop("i")


def indexed_events(events: DataFrame, **limits) -> DataFrame:
    """event_index (place in the capture), phase_name and run (number of the phase)."""
    named = events.withColumn("phase_name", F.coalesce(F.try_element_at(_map(PHASES), F.col("event_type")), F.lit("Unknown")))
    placed = global_rank(named, [CAP], EVENT_LEVELS, EVENT_ORDER, "event_index", **limits)
    return runs(placed, [CAP], EVENT_LEVELS, EVENT_ORDER, "phase_name", "run", **limits)


def activity_phases(events: DataFrame) -> DataFrame:
    """Runs of events of one phase. The events of a phase are those that carry its `run`."""
    c = F.col
    types = F.array_sort(F.collect_set("event_type"))
    phases = events.groupBy(CAP, "run").agg(
        F.max("phase_name").alias("phase_name"), F.min("us").alias("start_us"), F.max("us").alias("end_us"), F.count(F.lit(1)).alias("event_count"), types.alias("event_types"),
    )
    key = F.concat_ws("|", "phase_name", us_to_iso("start_us"), us_to_iso("end_us"), c("event_count").cast("string"))
    text = F.concat(c("phase_name"), F.lit(" phase containing "), c("event_count"), F.lit(" correlated events: "), F.array_join(F.slice("event_types", 1, 5), ", "))
    return phases.withColumns({"phase_id": F.concat(F.lit("phase_"), F.substring(F.md5(key), 1, 10)), "description": text})


def with_chapter(events: DataFrame) -> DataFrame:
    beacon = (F.col("event_type") == "hypothesis_created") & (F.col("hypothesis_type") == "beaconing")
    plain = F.coalesce(F.try_element_at(_map(CHAPTER_OF_EVENT), F.col("event_type")), F.lit("UNKNOWN"))
    return events.withColumn("chapter_type", F.when(beacon, "BEACONING_DEVELOPMENT").otherwise(plain))


def chapter_bounds(events: DataFrame) -> DataFrame:
    return with_chapter(events).groupBy(CAP, "chapter_type").agg(
        F.min("us").alias("start_us"), F.max("us").alias("end_us"), F.count(F.lit(1)).alias("event_count"), F.max(ladders.severity_rank(F.col("severity"))).alias("rank"),
    )


def chapter_phase_overlap(bounds: DataFrame, phases: DataFrame) -> DataFrame:
    """Phases that overlap each chapter; a capture has ten chapters at most."""
    c = F.col
    p = phases.select(CAP, "phase_id", c("start_us").alias("p_start"), c("end_us").alias("p_end"))
    return p.join(bounds.select(CAP, "chapter_type", "start_us", "end_us"), CAP).where((c("p_start") <= c("end_us")) & (c("p_end") >= c("start_us"))).select(CAP, "chapter_type", "phase_id")


def chapter_hosts(events: DataFrame) -> DataFrame:
    """Hosts per chapter as rows, as a chapter may hold every host."""
    return with_chapter(events).where("host <> ''").select(CAP, "chapter_type", "host").distinct()


def chapters(events: DataFrame, phases: DataFrame, top: int = 6) -> DataFrame:
    c = F.col
    counts = with_chapter(events).groupBy(CAP, "chapter_type", "event_type").agg(F.count(F.lit(1)).alias("n"), F.max(ladders.severity_rank(c("severity"))).alias("s"))
    ordered = F.reverse(F.array_sort(F.collect_list(F.struct("s", "n", "event_type"))))
    keys = counts.groupBy(CAP, "chapter_type").agg(F.slice(F.transform(ordered, lambda x: x["event_type"]), 1, top).alias("key_events"))
    bounds = chapter_bounds(events)
    overlap = chapter_phase_overlap(bounds, phases).distinct().groupBy(CAP, "chapter_type").agg(F.count(F.lit(1)).alias("phase_count"))
    hosts = chapter_hosts(events).groupBy(CAP, "chapter_type").agg(F.count(F.lit(1)).alias("host_count"))
    j = bounds.join(keys, [CAP, "chapter_type"]).join(overlap, [CAP, "chapter_type"], "left").join(hosts, [CAP, "chapter_type"], "left")
    place = F.array_position(words(list(CHAPTERS)), c("chapter_type"))
    by_start = Window.partitionBy(CAP).orderBy("start_0", "type_place")
    whole = Window.partitionBy(CAP)
    base = F.try_element_at(F.create_map(*[x for k, (_, v) in CHAPTERS.items() for x in (F.lit(k), F.lit(v))]), c("chapter_type"))
    importance = rnd(F.least(base + c("rank") * 2 + F.least(c("event_count") / 25, F.lit(8.0)), F.lit(100.0)), 1)
    key = F.concat_ws("|", "chapter_type", us_to_iso("start_us"), us_to_iso("end_us"))
    text = (
        F.when(c("chapter_type") == "INITIAL_ACTIVITY", F.concat(
            F.lit("The replay establishes the initial host and community context across "), F.coalesce("host_count", F.lit(0)), F.lit(" observed hosts.")))
        .when(c("chapter_type") == "EXTERNAL_COMMUNICATION", F.concat(
            F.lit("External application sessions appear in the timeline, including "), F.array_join(F.slice("key_events", 1, 3), ", "), F.lit(".")))
        .otherwise(F.coalesce(F.try_element_at(_map(CHAPTER_TEXTS), c("chapter_type")), F.lit("Timeline activity did not match a known chapter category.")))
    )
    j = j.withColumns({
        "chapter_id": F.concat(F.lit("chapter_"), F.substring(F.md5(key), 1, 10)), "title": F.try_element_at(_map({k: v[0] for k, v in CHAPTERS.items()}), c("chapter_type")),
        "description": text, "phase_count": F.coalesce("phase_count", F.lit(0)).cast("bigint"), "host_count": F.coalesce("host_count", F.lit(0)).cast("bigint"),
        "severity": ladders.rank_severity(c("rank")), "importance": importance, "type_place": place, "start_0": c("start_us"), "end_0": c("end_us"),
    })
    # ten rows per capture: the first chapter starts with the capture, the last one ends with it
    j = j.withColumns({"i": F.row_number().over(by_start), "k": F.count(F.lit(1)).over(whole), "t0": F.min("start_0").over(whole), "t1": F.max("end_0").over(whole)})
    j = j.withColumns({"start_us": F.when(c("i") == 1, c("t0")).otherwise(c("start_us")), "end_us": F.when(c("i") == c("k"), c("t1")).otherwise(c("end_us"))})
    return j.withColumn("duration_seconds", rnd(F.greatest(c("end_us") - c("start_us"), F.lit(0)) / F.lit(1e6), 4)).drop("start_0", "end_0", "t0", "t1", "k", "rank", "type_place").withColumnRenamed("i", "chapter_number")


def chapter_merge(chapters_: DataFrame) -> DataFrame:
    """Neighbours of one type become one chapter."""
    c = F.col
    w = Window.partitionBy(CAP).orderBy("start_us", "chapter_number")
    marked = chapters_.withColumn("new", F.when(F.lag("chapter_type").over(w) == c("chapter_type"), 0).otherwise(1)).withColumn("g", F.sum("new").over(w))
    keys = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("start_us", "chapter_number", "key_events"))), lambda x: x["key_events"]))
    first = F.struct("start_us", "chapter_number")
    return marked.groupBy(CAP, "g").agg(
        *[F.min_by(n, first).alias(n) for n in ("chapter_id", "chapter_type", "title", "description")], F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"),
        F.sum("event_count").alias("event_count"), F.sum("phase_count").alias("phase_count"), F.slice(F.array_distinct(keys), 1, 6).alias("key_events"),
        F.max("importance").alias("importance"), ladders.rank_severity(F.max(ladders.severity_rank(c("severity")))).alias("severity"),
    )


def chapter_index(chapters_: DataFrame) -> DataFrame:
    entry = F.struct("chapter_number", "chapter_id", "title", "start_us", "end_us")
    return chapters_.groupBy(CAP).agg(F.count(F.lit(1)).alias("chapter_count"), F.array_sort(F.collect_list(entry)).alias("chapters"))


def host_timeline_events(events: DataFrame) -> DataFrame:
    """Every event of every host with its place among the events of the host, from 1.

    A host may have most of all events: places are counted by ranges of event numbers, so none of them is one window.
    """
    named = events.where("host <> ''").select(CAP, "host", "event_id", "event_index", "us", "event_type", "severity", "description")
    return global_rank(named, [CAP, "host"], [f"event_index div {EVENTS_AT_ONCE}L"], ["event_index"], "place", start=1, hot=None)


def host_timeline_chapters(events: DataFrame, chapters_: DataFrame) -> DataFrame:
    """Every chapter that a host is part of, in order; a host has as many as there are types at most."""
    parts = chapter_hosts(events).join(chapters_.select(CAP, "chapter_type", "chapter_number", "chapter_id", "title", "start_us", "end_us", "severity"), [CAP, "chapter_type"])
    return parts.withColumn("place", F.row_number().over(Window.partitionBy(CAP, "host").orderBy("chapter_number")))


def host_timelines(entries: DataFrame, parts: DataFrame, shown: int) -> DataFrame:
    """A row for each host: how many events, the first `shown` of them, and its chapters.

    entries, parts: rows of host_timeline_events and host_timeline_chapters, which have all.
    """
    c = F.col

    def in_order(name, keep):
        return F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct("place", name)))), lambda x: x[name])

    by_host = entries.groupBy(CAP, "host").agg(
        in_order("event_id", c("place") <= shown).alias("events"), F.count(F.lit(1)).alias("event_count"), F.min("us").alias("first_us"), F.max("us").alias("last_us"))
    return by_host.join(parts.groupBy(CAP, "host").agg(in_order("chapter_id", F.lit(True)).alias("chapters")), [CAP, "host"], "left")
