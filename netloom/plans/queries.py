"""Registered queries: one per operator, over all packets projected from `events`."""

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netloom.operators.hosts import BASELINE_FIELDS
from netloom.operators.snapshots import COMMUNITIES
from netloom.plans.pipeline import Analysis, written
from netloom.plans.special import SPECIAL
from netloom.session import fit_shuffles, tune
from netloom.sources.packets import packets_from_events

_SESSIONS: dict = {}
WINDOW_CUT = 1704072600000000
EVENTS_A_PART = 250_000


def analysis(spark: SparkSession, folder: str) -> Analysis:
    """The analysis of a folder, built once per session so that queries share its kept tables."""
    tune(spark)
    events = spark.read.parquet(f"{folder}/events.parquet")
    # tables rewritten by Spark have new file names and get an analysis of their own; for files changed in place see `forget`
    stamp = tuple(sorted(events.inputFiles()))
    key = (spark.sparkContext.applicationId, folder, stamp)
    if key not in _SESSIONS:
        # splits of a file go by bytes, and its rows to the splits that hold a row group's middle: deal the rows evenly, so many to a task
        parts = max(spark.sparkContext.defaultParallelism, -(-events.count() // EVENTS_A_PART))
        fit_shuffles(spark, parts)
        events = events.select("event_id", "user_id", "event_type", "ts", "props").repartition(parts, "event_id")
        keep = written(spark)
        raw = keep("raw_packets", packets_from_events(events))
        a = _SESSIONS[key] = Analysis(raw, keep=keep)
        # two windows of the same capture, for the operators that compare
        before = Analysis(raw.where(F.col("us") < WINDOW_CUT), keep=written(spark))
        a.w = Analysis(raw.where(F.col("us") >= WINDOW_CUT), previous=before, keep=written(spark))
    return _SESSIONS[key]


def forget(spark: SparkSession) -> None:
    """Let the next query build its tables anew."""
    _SESSIONS.clear()


def flat(frame: DataFrame, columns: list[str]) -> DataFrame:
    """Chosen columns with arrays and maps as text, so that any engine can compare them."""
    kinds = {f.name: f.dataType for f in frame.schema}
    out = []
    for name in columns:
        kind, col = kinds[name], F.col(name)
        if isinstance(kind, T.ArrayType):
            col = F.coalesce(F.array_join(F.transform(col, lambda x: x.cast("string")), ","), F.lit(""))
        elif isinstance(kind, T.MapType):
            pairs = F.transform(F.map_entries(col), lambda e: F.concat(e["key"], F.lit("="), F.floor(e["value"] * 1e4 + 0.5).cast("string")))
            col = F.array_join(F.array_sort(pairs), ",")
        elif isinstance(kind, T.IntegerType):
            col = col.cast("bigint")
        out.append(col.alias(name))
    return frame.select(*out)


_FINDING = [
    "hypothesis_id", "hypothesis_type", "title", "summary", "@impacted_entities", "@supporting_evidence", "confidence_explanation", "confidence",
    "severity", "priority_score", "priority_level", "host", "host_role", "risk", "candidate_rationale", "@contradictory_evidence", "finding_tier", "source",
    "relationship_consumer", "relationship_destination", "domain", "destination_port", "destination_consumer_count", "destination_rarity_score",
    "destination_exclusivity_score", "criticality", "hostname", "mac_address", "user_identity", "external_relationships", "internal_relationships",
    "@top_protocols", "@rationale", "@recommended_actions",
]
_HOST_EVENTS = ["host", "place", "event_id", "event_index", "us", "event_type", "severity", "description"]
_HOST_CHAPTERS = ["host", "place", "chapter_id", "chapter_type", "chapter_number", "title", "start_us", "end_us", "severity"]
_HITS = ["search", "event_id", "us", "event_type", "severity", "host", "recent"]
PACKET_COLUMNS = [
    "capture_id", "packet_index", "replay_sequence_id", "us", "src_ip", "dst_ip", "ttl", "transport_layer", "src_port", "dst_port",
    "payload_bytes", "total_bytes", "application_protocol", "app_confidence", "protocol_enrichment", "@protocol_evidence",
    "tls_sni", "tls_alpn", "http_host", "dns_query", "src_mac", "dst_mac", "nbns_name", "kerberos_cname", "direction", "flow_id",
]
FLOW_COLUMNS = [
    "flow_id", "first_us", "last_us", "first_seen_sequence", "last_seen_sequence", "initiator_ip", "responder_ip", "transport_layer",
    "initiator_port", "responder_port", "initiator_packets", "initiator_bytes", "responder_packets", "responder_bytes",
    "application_protocol", "app_confidence", "direction", "packet_count",
]
ENRICHED_COLUMNS = FLOW_COLUMNS + [
    "initiator_mac", "responder_mac", "@observed_domains", "@nbns_names", "@kerberos_cnames", "tcp_state_summary", "chronology_valid",
    "@duration_anomalies", "duration_seconds", "raw_duration_seconds", "packets_per_second", "bytes_per_second", "avg_packet_size",
    "packet_size_variance", "packet_size_cv", "mean_inter_packet_delay_ms", "median_inter_packet_delay_ms", "max_inter_packet_delay_ms",
    "inter_arrival_jitter", "beacon_intervals", "payload_entropy", "port_entropy", "protocol_diversity", "data_ratio", "suppressed",
    "suppression_reason", "suppression_category", "beacon_score", "beacon_confidence", "beacon_reason", "behavioral_score", "confidence",
    "severity", "is_suspicious", "@suspicious_indicators", "@indicator_details",
]
HOST_METRIC_COLUMNS = [
    "ip_address", *BASELINE_FIELDS[:30], "initiated_flow_count", "responded_flow_count", "upload_download_ratio", "average_flow_duration",
    "inbound_connections", "outbound_connections", "@protocols", "@transports", "transport_diversity", "protocol_confidence_avg",
    "outbound_ratio", "inbound_ratio", "internal_ratio", "suppressed_flow_count", "periodic_flow_ratio", "persistent_connection_ratio",
    "first_us", "last_us", "first_seen_sequence", "last_seen_sequence", "graph_weight", "graph_degree", "graph_importance",
]
GRAPH_HEALTH = [
    "capture_id", "avg_node_risk", "avg_edge_persistence", "externality_ratio", "infrastructure_ratio", "suspicious_edge_ratio",
    "avg_protocol_diversity", "isolated_node_ratio", "community_balance_score", "relationship_diversity_score", "external_dependency_score",
    "risk_concentration_score",
]
FINDING_COLUMNS = [
    "hypothesis_id", "hypothesis_type", "title", "summary", "@impacted_entities", "@supporting_evidence", "@contradictory_evidence",
    "confidence_explanation", "confidence", "severity", "finding_tier", "consumer", "destination", "consumer_count", "rarity_score", "exclusivity_score",
]
RANKED_COLUMNS = FINDING_COLUMNS + ["place", "host", "host_risk", "host_role", "asset_criticality_score", "priority_score", "priority_level", "created_us"]
CANDIDATE_COLUMNS = [
    "place", "host", "host_role", "host_role_display", "priority", "priority_score", "risk_contribution", "confidence_contribution",
    "criticality_contribution", "confidence", "risk", "asset_criticality_score", "candidate_rationale", "role_confidence",
    "external_relationships", "internal_relationships", "@top_protocols", "@rationale", "@recommended_actions", "hypothesis_count",
]
EVENT_COLUMNS = ["us", "event_id", "event_type", "severity", "host", "@related_hosts", "description", "flow_id", "edge_id", "hypothesis_id", "hypothesis_type"]
CHAPTER_COLUMNS = [
    "chapter_id", "chapter_type", "title", "description", "start_us", "end_us", "event_count", "phase_count", "@key_events", "severity", "importance",
]

FRAME_COLUMNS = [
    "frame_number", "frame_id", "us", "trigger_event_id", "trigger_event_type", "node_count", "edge_count", "events_upto", "candidate_count",
    "graph_density", "graph_risk_score", "isolated_node_count", "final",
]
DELTA_COLUMNS = ["frame_number", "frame_id", "us", "added_nodes", "added_edges", "removed_nodes", "removed_edges", "frame_duration"]
WINDOW_FIGURES = [
    "avg_node_risk", "avg_edge_persistence", "suspicious_edges", "suspicious_edge_ratio", "externality_ratio", "infrastructure_ratio",
    "avg_protocol_diversity", "@relationship_types", "relationship_diversity_score", "replay_sequence_start", "replay_sequence_end",
]

# slug -> (table, columns); "@" marks arrays and maps
TABLES: dict[str, tuple[str, list[str]]] = {
    "normalize_packets": ("packets", PACKET_COLUMNS),
    "build_flows": ("flows", FLOW_COLUMNS),
    "flow_tcp_flag_counts": ("flows", ["flow_id", "syn_count", "ack_count", "rst_count", "fin_count", "psh_count", "urg_count"]),
    "flow_context_sets": ("flows", ["flow_id", "initiator_mac", "responder_mac", "@observed_domains", "@nbns_names", "@kerberos_cnames"]),
    "flow_names": ("flow_names", ["flow_id", "kind", "name", "packets", "first_us"]),
    "flow_name_facts": ("flows", ["flow_id", "domain_count", "nbns_count", "kerberos_count", "first_user", "web_domain"]),
    "flow_duration_rates": ("flows", ["flow_id", "raw_duration_seconds", "duration_seconds", "raw_pps", "chronology_valid", "@duration_anomalies"]),
    "tcp_state_summary": ("flows", ["flow_id", "transport_layer", "tcp_state_summary"]),
    "enriched_flows": ("enriched_flows", ENRICHED_COLUMNS),
    "packet_size_stats": ("enriched_flows", ["flow_id", "avg_packet_size", "packet_size_variance", "packet_size_stddev", "packet_size_cv"]),
    "throughput_stats": ("enriched_flows", ["flow_id", "packets_per_second", "bytes_per_second", "data_ratio"]),
    "suppression": ("enriched_flows", ["flow_id", "suppressed", "suppression_reason", "suppression_category"]),
    "beacon_score": ("enriched_flows", ["flow_id", "beacon_score", "beacon_confidence", "beacon_reason"]),
    "behavioral_risk": ("enriched_flows", ["flow_id", "behavioral_score", "@suspicious_indicators", "@indicator_details"]),
    "host_flow_expansion": ("host_flow_expansion", [
        "flow_id", "ip_address", "peer_ip", "role", "host_direction", "host_packets", "upload", "download", "initiated", "responded", "mac",
    ]),
    "edge_hints": ("edge_hints", ["ip_address", "target", "flow_count", "@protocols", "total_bytes", "first_us", "last_us"]),
    "host_metrics": ("host_profiles", HOST_METRIC_COLUMNS),
    "activity_clusters": ("host_profiles", ["ip_address", "activity_cluster_count", "activity_density", "session_density"]),
    "host_identity": ("host_profiles", ["ip_address", "mac_address", "hostname", "user_identity"]),
    "host_role": ("host_profiles", ["ip_address", "role", "role_confidence", "@role_evidence"]),
    "host_risk": ("host_profiles", ["ip_address", "risk_score", "confidence", "severity", "@behavioral_indicators", "@indicator_details"]),
    "host_profiles": ("host_profiles", HOST_METRIC_COLUMNS + [
        "mac_address", "hostname", "user_identity", "role", "role_confidence", "@role_evidence", "risk_score", "confidence", "severity",
        "@behavioral_indicators", "@indicator_details", "graph_node_size", "graph_risk_color", "graph_cluster_group",
    ]),
    "baseline_snapshot": ("baseline_snapshot", ["snapshot_id", "host_count", "ip_address", *BASELINE_FIELDS, "@protocols", "@behavioral_indicators", "role"]),
    "relationships": ("relationships", [
        "edge_id", "source", "target", "relationship_risk", "confidence", "severity", "flows", "packet_count", "total_bytes", "@protocols",
        "@transports", "first_us", "last_us", "first_seen_sequence", "last_seen_sequence", "persistence", "@temporal_buckets",
        "protocol_diversity", "directionality", "@relationship_indicators", "graph_weight", "graph_edge_color", "graph_edge_width",
        "suspicious_flows", "suppressed_flows",
    ]),
    "graph_nodes": ("scored_nodes", [
        "node_id", "ip_address", "hostname", "inferred_role", "role", "risk_score", "confidence", "@behavioral_indicators", "protocol_diversity",
        "first_us", "last_us", "replay_sequence_start", "replay_sequence_end", "role_confidence", "@role_evidence", "external_connections",
        "internal_connections", "@protocols", "telemetry_completeness", "communication_density", "node_degree", "weighted_degree",
        "centrality_hint", "node_priority",
    ]),
    "graph_edges": ("graph_edges", [
        "edge_id", "source_node", "target_node", "relationship_type", "communication_pattern", "directionality", "relationship_risk",
        "persistence_score", "communication_density", "protocol_diversity", "first_us", "last_us", "replay_sequence_start",
        "replay_sequence_end", "severity", "flows", "packet_count", "total_bytes", "@protocols", "@relationship_indicators", "graph_weight",
    ]),
    "relationship_type": ("graph_edges", ["edge_id", "@protocols", "@relationship_indicators", "relationship_type"]),
    "communication_pattern": ("graph_edges", ["edge_id", "persistence", "flows", "communication_pattern"]),
    "edge_metric_clamp": ("graph_edges", ["edge_id", "persistence_score", "communication_density"]),
    "node_degree": ("scored_nodes", ["node_id", "node_degree", "weighted_degree", "communication_density", "inbound_edges", "outbound_edges"]),
    "behavioral_centrality": ("scored_nodes", ["node_id", "centrality_hint", "node_priority"]),
    "infrastructure_noise": ("scored_nodes", ["node_id", "infrastructure_noise"]),
    "investigative_entity": ("scored_nodes", ["node_id", "is_investigative"]),
    "graph_metrics": ("graph_metrics", [
        "capture_id", "node_count", "edge_count", "graph_density", "graph_risk_score", "isolated_node_count", "@high_centrality_nodes",
        "@relationship_types", "avg_node_degree", "suspicious_edges",
    ]),
    "communities": ("scored_nodes", ["ip_address", "community_type", "community_confidence"]),
    "communities_heuristic": ("scored_nodes", ["ip_address", "community_heuristic"]),
    "external_service": ("scored_nodes", ["ip_address", "is_external_service", "service_confidence", "service_reason"]),
    "behavioral_importance": ("scored_nodes", ["ip_address", "behavioral_importance"]),
    "graph_risk_decomposition": ("graph_risk", ["capture_id", "host_risk", "relationship_risk", "community_risk", "topology_risk"]),
    "graph_health": ("graph_health", GRAPH_HEALTH),
    "graph_fingerprint": ("hashes", ["entity", "hash"]),
    "graph_state": ("graph_state", [
        *GRAPH_HEALTH, "node_count", "edge_count", "graph_density", "graph_risk_score", "isolated_node_count", "@high_centrality_nodes",
        "@relationship_types", "avg_node_degree", "suspicious_edges", "snapshot_id", "graph_fingerprint", "timestamp_us",
        "replay_sequence_start", "replay_sequence_end", "community_count", "classified_nodes", "unclassified_nodes", "@community_summary",
        "host_risk", "relationship_risk_part", "community_risk", "topology_risk",
    ]),
    "host_deltas": ("w.host_deltas", [
        "delta_id", "entity_type", "entity_id", "delta_type", "confidence", "severity", "summary", "risk_score_delta", "new_relationship_count",
        "new_peer_count", "external_host_delta", "unique_ports_delta", "same_port_peer_count", "low_persistence_ratio", "persistence_delta",
        "@new_protocols", "@removed_protocols",
    ]),
    "relationship_deltas": ("w.relationship_deltas", [
        "delta_id", "entity_type", "entity_id", "delta_type", "confidence", "severity", "summary", "source", "target", "@protocols", "persistence",
        "persistence_delta", "flows", "@new_protocols", "@removed_protocols",
    ]),
    "historical_host_baseline": ("w.host_history", [
        "ip_address", "risk_score_mean", "risk_score_std", "average_persistence", "unique_port_mean", "sample_count", "observed_protocols",
    ]),
    "historical_relationship_baseline": ("w.edge_history", ["edge_id", "persistence_mean", "persistence_std", "average_flow_count", "sample_count", "observed_protocols"]),
    "historical_comparison": ("w.host_deltas", ["delta_id", "entity_id", "delta_type", "risk_score_mean"]),
    "hyp_port_scan": ("w.port_scan", FINDING_COLUMNS),
    "hyp_host_sweep": ("w.host_sweep", FINDING_COLUMNS),
    "hyp_beaconing": ("beaconing", FINDING_COLUMNS),
    "hyp_persistent_tls": ("w.persistent_tls", FINDING_COLUMNS),
    "confidence_filter": ("w.confident", FINDING_COLUMNS),
    "dedup_reverse_pairs": ("deduped", FINDING_COLUMNS),
    "top_n_limits": ("w.limited", FINDING_COLUMNS),
    "hypothesis_priority": ("hypotheses", RANKED_COLUMNS),
    "hypotheses_windows": ("w.hypotheses", RANKED_COLUMNS),
    "investigation_host": ("w.hypotheses", ["hypothesis_id", "host", "host_risk", "host_role", "asset_criticality_score"]),
    "host_summaries": ("w.host_summaries", [
        "host", "host_risk", "host_role", "asset_criticality_score", "hypothesis_count", "highest_confidence", "priority_score", "@top_protocols",
    ]),
    "investigation_candidates": ("candidates", CANDIDATE_COLUMNS),
    "primary_hypothesis": ("narratives", ["host", "primary_id", "primary_type", "@supporting", "@contradictory"]),
    "environment_rank": ("narratives", ["host", "environment_rank", "environment_size"]),
    "evidence_phrases": ("narratives", ["host", "behavioral_summary", "evidence_summary"]),
    "confidence_drivers": ("narratives", ["host", "@drivers_high", "@drivers_medium", "@drivers_low", "confidence_explanation"]),
    "reasoning_text": ("narratives", ["host", "investigation_reasoning"]),
    "assessment_text": ("narratives", ["host", "assessment", "@negative_findings"]),
    "recommended_actions": ("narratives", ["host", "@recommended_actions", "@investigation_plan"]),
    "narratives": ("narratives", [
        "host", "priority", "confidence", "risk", "environment_rank", "environment_size", "selection_reason", "executive_summary", "behavioral_summary",
        "evidence_summary", "investigation_reasoning", "@drivers_high", "@drivers_medium", "@drivers_low", "@negative_findings", "assessment",
        "confidence_explanation", "@recommended_actions", "@investigation_plan", "narrative_quality_score", "@supporting_hypotheses",
    ]),
    "network_events": ("network_events", EVENT_COLUMNS),
    "host_events": ("host_events", EVENT_COLUMNS),
    "relationship_events": ("relationship_events", EVENT_COLUMNS),
    "hypothesis_events": ("hypothesis_events", EVENT_COLUMNS),
    "candidate_events": ("candidate_events", EVENT_COLUMNS),
    "narrative_events": ("narrative_events", EVENT_COLUMNS),
    "timeline_events": ("timeline_events", EVENT_COLUMNS),
    "event_correlation": ("correlated", EVENT_COLUMNS),
    "activity_phases": ("activity_phases", ["run", "phase_id", "phase_name", "start_us", "end_us", "event_count", "description"]),
    "chapter_phase_overlap": ("chapter_phase_overlap", ["chapter_type", "phase_id"]),
    "chapters": ("chapters", CHAPTER_COLUMNS + ["host_count", "duration_seconds", "chapter_number"]),
    "chapter_merge": ("chapter_merge", CHAPTER_COLUMNS),
    "frame_selection": ("frame_selection", ["frame_number", "event_id", "event_index", "us"]),
    "frame_state": ("frames", FRAME_COLUMNS),
    "frame_nodes": ("frame_nodes", ["ip_address", "frame_number"]),
    "frame_edges": ("frame_edges", ["edge_id", "frame_number"]),
    "frame_offsets": ("frame_offsets", ["frame_id", "frame_offset"]),
    "host_event_offsets": ("host_event_offsets", ["host", "event_index"]),
    "frame_recent_events": ("frame_recent", ["frame_number", "event_index", "event_id"]),
    "frame_delta": ("frame_deltas", DELTA_COLUMNS),
    "replay_index": ("whole.indexed_events", ["event_id", "event_index", "host"]),
    "host_timelines": ("host_timelines", ["host", "event_count", "@events", "@chapters"]),
    "host_timeline_events": ("host_timeline_events", _HOST_EVENTS),
    "host_timeline_chapters": ("host_timeline_chapters", _HOST_CHAPTERS),
    "host_timeline_events_uncut": ("uncut.host_timeline_events", _HOST_EVENTS),
    "host_timeline_chapters_uncut": ("uncut.host_timeline_chapters", _HOST_CHAPTERS),
    "replay_coverage": ("replay_coverage", ["capture_id", "replay_coverage", "event_compression_ratio"]),
    "frame_seek_nearest": ("seek", ["ip_address", "target_us", "frame_number", "frame_us"]),
    "chapter_jump": ("chapter_jump", ["chapter_id", "target_us", "frame_number", "frame_us"]),
    "lifecycle_events": ("lifecycle_events", ["us", "type", "entity"]),
    "snapshot_windows": ("snapshot_windows", ["us", "node_count", "edge_count", "node_set"]),
    "snapshot_state": ("snapshot_states", ["us", "node_count", "edge_count", "graph_density", "graph_risk_score", *COMMUNITIES.values(), *WINDOW_FIGURES]),
    "snapshot_quality": ("snapshots", ["us", "quality_score", "quality_reason", "snapshot_lineage_id"]),
    "temporal_snapshots": ("snapshots", [
        "snapshot_number", "snapshot_id", "window_start_us", "window_end_us", "node_count", "edge_count", "graph_density", "graph_risk_score",
        "quality_score", "quality_reason", "snapshot_lineage_id", *COMMUNITIES.values(), *WINDOW_FIGURES,
    ]),
    "capture_summary": ("capture_summary", [
        "capture_id", "duration_seconds", "frame_count", "event_count", "chapter_count", "node_count", "hypothesis_count", "candidate_count",
        "community_count", "primary_destination", "top_host", "ready", "snapshot_quality", "graph_valid", "hypotheses_valid", "candidates_valid", "snapshots_valid",
    ]),
    "replay_duration": ("replay_duration", ["capture_id", "duration_seconds"]),
    "host_detail": ("host_detail", ["host", "risk", "role", "mac_address", "hostname", "user_identity", "event_count", "@events", "@chapters"]),
    "ranked_hosts": ("ranked_hosts", [
        "ip_address", "role", "role_confidence", "community", "mac_address", "hostname", "user_identity", "risk", "candidate_status", "finding_count",
        "confidence", "priority", "external_relationships", "internal_relationships", "@top_protocols",
    ]),
    "relationship_context": ("relationship_context", [
        "edge_id", "source", "target", "risk", "confidence", "severity", "@protocols", "first_us", "last_us", "destination_rarity_score",
        "destination_exclusivity_score", "destination_consumer_count", "@supporting_evidence", "@contradictory_evidence", "confidence_explanation",
    ]),
    "destination_intel": ("destination_intel", [
        "destination", "related_host", "risk", "consumer_count", "rarity_score", "exclusivity_score", "@supporting_evidence",
        "@contradictory_evidence", "hypothesis_count",
    ]),
    "web_finding": ("web_finding", _FINDING),
    "context_fallback": ("context_fallback", _FINDING),
    "community_context": ("community_context", ["community_type", "role", "node_count"]),
    "event_searches": ("event_searches", _HITS),
    "event_searches_uncut": ("uncut.event_searches", _HITS),
    "event_search": ("event_search", ["event_id", "us", "event_type", "severity", "host", "recent"]),
    "capture_totals": ("capture_totals", [
        "capture_id", "flows", "total_bytes", "suppressed_flows", "beacon_eligible_flows", "suspicious_flows", "hosts", "elevated_hosts",
    ]),
    "suspicious_flows": ("suspicious_top", ["place", "flow_id", "behavioral_score", "confidence", "severity", "@suspicious_indicators"]),
    "elevated_hosts": ("elevated_top", ["place", "ip_address", "role", "risk_score", "confidence", "@behavioral_indicators"]),
    "traffic_direction_summary": ("direction_summary", ["capture_id", "direction", "flows"]),
    "protocol_summary": ("protocol_top", ["place", "application_protocol", "flows"]),
    "timeline_events_uncut": ("uncut.timeline_events", EVENT_COLUMNS),
    "event_correlation_uncut": ("uncut.correlated", EVENT_COLUMNS),
    "activity_phases_uncut": ("uncut.activity_phases", ["run", "phase_id", "phase_name", "start_us", "end_us", "event_count", "description"]),
    "chapters_uncut": ("uncut.chapters", CHAPTER_COLUMNS + ["host_count", "duration_seconds", "chapter_number"]),
    "frame_selection_uncut": ("uncut.frame_selection", ["frame_number", "event_id", "event_index", "us"]),
    "frame_state_uncut": ("uncut.frames", FRAME_COLUMNS),
    "frame_delta_uncut": ("uncut.frame_deltas", DELTA_COLUMNS),
    "frame_seek_nearest_uncut": ("uncut.seek", ["ip_address", "target_us", "frame_number", "frame_us"]),
    "event_search_uncut": ("uncut.event_search", ["event_id", "us", "event_type", "severity", "host", "recent"]),
    "hypothesis_priority_uncut": ("ranked_whole", ["place", "hypothesis_id", "hypothesis_type", "host", "confidence", "priority_score", "priority_level"]),
    "community_audit": ("community_audit", ["ip_address", "role", "role_confidence", "community", "is_internal", "is_external", "risk_score"]),
    "graph_consistency": ("graph_consistency", [
        "capture_id", "graph_nodes", "classified_nodes", "community_count", "suppressed_nodes", "unclassified_nodes", "investigative_nodes", "valid",
    ]),
    "role_consistency": ("role_consistency", ["capture_id", "checked_hosts", "candidate_hosts", "mismatch_count", "valid"]),
    "hypothesis_validation": ("hypothesis_validation", ["capture_id", "checked", "error_count", "valid"]),
    "candidate_validation": ("candidate_validation", ["capture_id", "checked", "error_count", "valid"]),
    "snapshot_quality_report": ("snapshot_report", ["capture_id", "total_snapshots", "meaningful_snapshots", "redundant_snapshots", "quality_score", "valid"]),
    "readiness": ("stable", ["capture_id", "ready", "@missing_components", "snapshots_valid", "stable"]),
}


# Tables of artifact folders and the queries whose columns they are compared in: (format, artifact) -> slug.
ARTIFACTS = {
    f"{fmt}_{artifact}": (fmt, artifact, slug)
    for fmt, tables in (
        ("csv", {"normalized_packets": "normalize_packets", "enriched_flows": "enriched_flows", "host_profiles": "host_profiles", "relationships": "relationships", "flows": "build_flows"}),
        ("ndjson", {
            "normalized_packets": "normalize_packets", "enriched_flows": "enriched_flows", "flow_names": "flow_names", "host_baseline_snapshot": "baseline_snapshot",
            "layer5_hypotheses": "hypothesis_priority", "layer5_investigation_candidates": "investigation_candidates", "investigation_narratives": "narratives", "graph_nodes": "graph_nodes",
            "graph_edges": "graph_edges", "graph_snapshots": "temporal_snapshots", "graph_state": "graph_state", "timeline_events": "timeline_events", "activity_phases": "activity_phases",
            "replay_frames": "frame_state", "replay_index": "replay_index", "major_chapters": "chapters",
        }),
    ) for artifact, slug in tables.items()
}


def names() -> list[str]:
    return list(TABLES) + list(SPECIAL) + list(ARTIFACTS)


def run(name: str):
    """The query as a function of (session, folder)."""

    def query(spark: SparkSession, folder: str) -> DataFrame:
        a = analysis(spark, folder)
        if name in SPECIAL:
            frame = SPECIAL[name](a)
            return flat(frame, frame.columns)
        if name in ARTIFACTS:
            fmt, artifact, slug = ARTIFACTS[name]
            return flat(a.read_back(fmt)[artifact], [c.lstrip("@") for c in TABLES[slug][1]])
        table, columns = TABLES[name]
        return flat(reduce(getattr, table.split("."), a), [c.lstrip("@") for c in columns])

    return query
