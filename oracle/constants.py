"""Fixed values of the tables, written apart from those of the library so that a wrong one shows."""

# Event type -> phase, event type -> chapter, chapter -> (title, importance).
PHASES = {
    "dns_query": "Discovery",
    "dns_response": "Discovery",
    "connection_created": "Communication",
    "connection_closed": "Communication",
    "tls_established": "Communication",
    "http_session": "Communication",
    "relationship_created": "Communication",
    "relationship_persistent": "Persistence",
    "periodicity_detected": "Beaconing",
    "rare_destination_detected": "Beaconing",
    "beaconing_started": "Beaconing",
    "beaconing_confidence_increased": "Beaconing",
    "host_risk_increased": "Investigation",
    "host_role_assigned": "Investigation",
    "community_assigned": "Investigation",
    "community_changed": "Investigation",
    "hypothesis_created": "Investigation",
    "hypothesis_promoted": "Investigation",
    "candidate_created": "Investigation",
    "candidate_priority_changed": "Investigation",
    "narrative_generated": "Investigation",
}
CHAPTER_OF_EVENT = {
    "host_role_assigned": "INITIAL_ACTIVITY",
    "community_assigned": "INITIAL_ACTIVITY",
    "dns_query": "NETWORK_DISCOVERY",
    "dns_response": "NETWORK_DISCOVERY",
    "connection_created": "RELATIONSHIP_FORMATION",
    "connection_closed": "RELATIONSHIP_FORMATION",
    "tls_established": "EXTERNAL_COMMUNICATION",
    "http_session": "EXTERNAL_COMMUNICATION",
    "relationship_created": "RELATIONSHIP_FORMATION",
    "relationship_persistent": "PERSISTENT_COMMUNICATION",
    "periodicity_detected": "BEACONING_DEVELOPMENT",
    "rare_destination_detected": "BEACONING_DEVELOPMENT",
    "beaconing_started": "BEACONING_DEVELOPMENT",
    "beaconing_confidence_increased": "BEACONING_DEVELOPMENT",
    "host_risk_increased": "BEHAVIORAL_ESCALATION",
    "hypothesis_created": "INVESTIGATION_TRIGGER",
    "hypothesis_promoted": "INVESTIGATION_TRIGGER",
    "candidate_created": "INVESTIGATION_PRIORITY",
    "candidate_priority_changed": "INVESTIGATION_PRIORITY",
    "narrative_generated": "INVESTIGATION_PRIORITY",
}
CHAPTERS = {
    "INITIAL_ACTIVITY": ("Initial Network Activity", 30),
    "NETWORK_DISCOVERY": ("Network Discovery", 45),
    "RELATIONSHIP_FORMATION": ("Relationship Formation", 60),
    "EXTERNAL_COMMUNICATION": ("External Communication", 65),
    "PERSISTENT_COMMUNICATION": ("Persistent Communications", 75),
    "BEHAVIORAL_ESCALATION": ("Behavioral Escalation", 82),
    "BEACONING_DEVELOPMENT": ("Beaconing Indicators", 90),
    "INVESTIGATION_TRIGGER": ("Investigation Trigger", 95),
    "INVESTIGATION_PRIORITY": ("Investigation Priority", 100),
    "UNKNOWN": ("Unclassified Activity", 20),
}
# Community -> column.
COMMUNITIES = {
    "Domain Controllers": "domain_controllers",
    "Infrastructure": "infrastructure",
    "Servers": "servers",
    "Workstations": "workstations",
    "External Services": "external_services",
    "Unknown": "unknown",
}
# Fields of a host that baselines compare.
BASELINE_FIELDS = [
    "flow_count",
    "external_flow_count",
    "internal_flow_count",
    "packet_count",
    "total_bytes",
    "upload_bytes",
    "download_bytes",
    "external_connections",
    "external_unique_hosts",
    "external_unique_relationships",
    "internal_connections",
    "internal_unique_hosts",
    "internal_unique_relationships",
    "unique_destinations",
    "unique_peers",
    "unique_ports",
    "protocol_relationships",
    "persistent_relationships",
    "protocol_diversity",
    "unknown_protocol_ratio",
    "encrypted_flow_ratio",
    "telemetry_completeness",
    "beacon_flow_count",
    "suspicious_flow_count",
    "persistent_connection_count",
    "long_lived_flow_count",
    "active_duration",
    "activity_density",
    "session_density",
    "activity_cluster_count",
    "risk_score",
    "confidence",
]
