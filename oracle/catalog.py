"""Snapshots, catalogue, audits."""

import re

from oracle.base import CTES, cte, iso, private, r, sc
from oracle.constants import COMMUNITIES

M = 5000000
cte("lifecycle_events", """SELECT capture_id, first_us AS us, 'node_appears' AS type, ip_address AS entity FROM scored_nodes UNION ALL SELECT capture_id, last_us, 'node_disappears', ip_address FROM scored_nodes
 UNION ALL SELECT capture_id, first_us, 'edge_appears', source || '->' || target FROM graph_edges UNION ALL SELECT capture_id, last_us, 'edge_disappears', source || '->' || target FROM graph_edges""")
cte("moments", "SELECT DISTINCT us AS t FROM lifecycle_events")
_cc = ", ".join(f"count(*) FILTER (community_type = '{k}') AS {v}" for k, v in COMMUNITIES.items())
_in = f"last_us >= t - {M} AND first_us <= t + {M}"
_zero = lambda n, x: f"CASE WHEN {n} > 0 THEN {x} ELSE 0e0 END"
cte("win_nodes", f"""SELECT t, count(node_id) AS node_count, coalesce(bit_xor(cast('0x' || substr(node_id, 1, 15) AS bigint)), 0) AS node_set, {_cc},
 {_zero('count(node_id)', r(f"sum({sc('risk_score', 2)}) / count(node_id) / 100e0", 2))} AS avg_node_risk, {_zero('count(node_id)', r('sum(external_connections) / (count(node_id) * 10)', 4))} AS externality_ratio,
 {_zero('count(node_id)', r("count(*) FILTER (role = 'INFRASTRUCTURE') / count(node_id)", 4))} AS infrastructure_ratio, {_zero('count(node_id)', r('sum(protocol_diversity) / count(node_id)', 2))} AS avg_protocol_diversity,
 coalesce(min(replay_sequence_start) FILTER (replay_sequence_start > 0), 0) AS replay_sequence_start, coalesce(max(replay_sequence_end) FILTER (replay_sequence_end > 0), 0) AS replay_sequence_end
 FROM moments LEFT JOIN scored_nodes ON {_in} GROUP BY t""")
cte("win_edges", f"""SELECT t, count(edge_id) AS edge_count, {_zero('count(edge_id)', r(f"sum({sc('persistence_score', 4)}) / 1e4 / count(edge_id)", 4))} AS avg_edge_persistence, count(*) FILTER (relationship_risk >= 35) AS suspicious_edges,
 {_zero('count(edge_id)', r('count(*) FILTER (relationship_risk >= 35) / count(edge_id)', 4))} AS suspicious_edge_ratio,
 list_sort(list(DISTINCT relationship_type) FILTER (relationship_type IS NOT NULL)) AS relationship_types, {r('count(DISTINCT relationship_type) / 12', 2)} AS relationship_diversity_score
 FROM moments LEFT JOIN graph_edges ON {_in} GROUP BY t""")
cte("win_risk", f"""SELECT t, {r('sum(x) / 100e0 / max(k)', 2)} AS graph_risk_score FROM (SELECT t, x, i, greatest(n // 10, 1) AS k FROM (SELECT t, {sc('risk_score', 2)} AS x, row_number() OVER (PARTITION BY t ORDER BY risk_score DESC) AS i, count(*) OVER (PARTITION BY t) AS n
 FROM moments JOIN scored_nodes ON last_us >= t - {M} AND first_us <= t + {M})) WHERE i <= k GROUP BY t""")
cte("snapshot_windows", "SELECT 'cap0' AS capture_id, n.t AS us, n.* EXCLUDE (t), e.* EXCLUDE (t) FROM win_nodes n JOIN win_edges e ON e.t = n.t")
cte("snapshot_states", f"""SELECT w.*, graph_risk_score, {r('edge_count / greatest(node_count * (node_count - 1), 1)', 6)} AS graph_density FROM snapshot_windows w JOIN win_risk q ON q.t = w.us""")
cte("snapshots", f"""SELECT *, row_number() OVER (ORDER BY us) - 1 AS snapshot_number, us - {M} AS window_start_us, us + {M} AS window_end_us, CASE quality_reason WHEN 'empty_snapshot' THEN 0e0 WHEN 'sparse_snapshot' THEN 0.6e0 ELSE 1e0 END AS quality_score,
 substr(sha256(replace({iso(f'(us - {M})')}, 'Z', '+00:00') || ':' || replace({iso(f'(us + {M})')}, 'Z', '+00:00') || ':' || node_count || ':' || edge_count), 1, 16) AS snapshot_id, substr(sha256({iso(f'(us - {M})')} || ':' || node_count || ':' || edge_count), 1, 16) AS snapshot_lineage_id
FROM (SELECT *, CASE WHEN node_count = 0 OR edge_count = 0 THEN 'empty_snapshot' WHEN node_count = pn AND edge_count = pe THEN 'useful_snapshot' WHEN edge_count < greatest(node_count - 1, 1) THEN 'sparse_snapshot' ELSE 'useful_snapshot' END AS quality_reason
 FROM (SELECT *, lag(node_count) OVER (ORDER BY us) AS pn, lag(edge_count) OVER (ORDER BY us) AS pe, lag(node_set) OVER (ORDER BY us) AS ps FROM snapshot_states) WHERE pn IS NULL OR pn <> node_count OR pe <> edge_count OR ps <> node_set)""")

cte("replay_duration", f"SELECT capture_id, {r('(max(us) - min(us)) / 1e6', 4)} AS duration_seconds FROM frames GROUP BY 1")
cte("readiness", """SELECT *, len(missing_components) = 0 AS ready FROM (SELECT 'cap0' AS capture_id, list_filter([CASE WHEN (SELECT count(*) FROM host_profiles) = 0 THEN 'HostProfile' END, CASE WHEN (SELECT count(*) FROM hypotheses) = 0 THEN 'AttackHypothesis' END,
 CASE WHEN (SELECT count(*) FROM candidates) = 0 THEN 'InvestigationCandidate' END, CASE WHEN (SELECT count(*) FROM scored_nodes) = 0 THEN 'GraphContext' END], lambda x: x IS NOT NULL) AS missing_components)""")
cte("capture_summary", """SELECT d.capture_id, d.duration_seconds, (SELECT count(*) FROM frames) AS frame_count, (SELECT count(*) FROM indexed_events) AS event_count, (SELECT count(*) FROM chapters) AS chapter_count, (SELECT count(*) FROM scored_nodes) AS node_count,
 (SELECT count(*) FROM hypotheses) AS hypothesis_count, (SELECT count(*) FROM candidates) AS candidate_count, (SELECT count(DISTINCT community_type) FROM scored_nodes) AS community_count, (SELECT destination FROM hypotheses WHERE place = 1) AS primary_destination,
 (SELECT host FROM candidates WHERE place = 1) AS top_host, rd.ready, sr.quality_score AS snapshot_quality, g.valid AS graph_valid, hv.valid AS hypotheses_valid, cv.valid AS candidates_valid, sr.valid AS snapshots_valid FROM replay_duration d, readiness rd, snapshot_report sr, graph_consistency g, hypothesis_validation hv, candidate_validation cv""")
cte("host_detail", "SELECT t.*, coalesce(h.risk_score, n.risk_score, 0e0) AS risk, coalesce(h.role, n.role, 'UNKNOWN') AS role, h.mac_address, coalesce(h.hostname, n.hostname) AS hostname, h.user_identity FROM host_timelines t LEFT JOIN host_profiles h ON h.ip_address = t.host LEFT JOIN scored_nodes n ON n.ip_address = t.host")
cte("ranked_hosts", """SELECT h.ip_address, h.role, h.role_confidence, graph_cluster_group AS community, h.mac_address, h.hostname, h.user_identity, coalesce(c.risk, h.risk_score) AS risk, CASE WHEN c.host IS NULL THEN 'none' ELSE 'candidate' END AS candidate_status,
 (SELECT count(*) FROM hypotheses p WHERE list_contains(p.impacted_entities, h.ip_address)) AS finding_count, coalesce(c.confidence, 0e0) AS confidence, coalesce(c.priority, 'LOW') AS priority, external_unique_relationships AS external_relationships,
 internal_unique_relationships AS internal_relationships, h.protocols[1:5] AS top_protocols FROM host_profiles h LEFT JOIN candidates c ON c.host = h.ip_address""")
cte("relationship_context", """SELECT x.edge_id, x.source, x.target, relationship_risk AS risk, x.confidence, x.severity, x.protocols, x.first_us, x.last_us, coalesce(f.rarity_score, b.rarity_score) AS destination_rarity_score, coalesce(f.exclusivity_score, b.exclusivity_score) AS destination_exclusivity_score,
 coalesce(f.consumer_count, b.consumer_count) AS destination_consumer_count, coalesce(f.supporting_evidence, b.supporting_evidence, []) AS supporting_evidence, coalesce(f.contradictory_evidence, b.contradictory_evidence, []) AS contradictory_evidence,
 coalesce(f.confidence_explanation, b.confidence_explanation, '') AS confidence_explanation FROM relationships x LEFT JOIN hypotheses f ON f.consumer = x.source AND f.destination = x.target LEFT JOIN hypotheses b ON b.consumer = x.target AND b.destination = x.source""")
cte("destination_intel", """SELECT destination, arg_min(consumer, place) AS related_host, (SELECT max(relationship_risk) FROM relationships x WHERE x.target = h.destination) AS risk, arg_min(consumer_count, place) AS consumer_count, arg_min(rarity_score, place) AS rarity_score,
 arg_min(exclusivity_score, place) AS exclusivity_score, list_sort(list_distinct(flatten(list(supporting_evidence)))) AS supporting_evidence, list_sort(list_distinct(flatten(list(contradictory_evidence)))) AS contradictory_evidence, count(*) AS hypothesis_count FROM hypotheses h WHERE destination IS NOT NULL GROUP BY destination""")
cte("web_finding", f"""SELECT capture_id, 'context:' || host || ':' || dest || ':' || domain AS hypothesis_id, 'external_web_activity' AS hypothesis_type, 'External Web Activity' AS title, host || ' communicated with ' || domain || ' at ' || dest || ':' || responder_port AS summary,
 [host, dest, domain] AS impacted_entities, ['external_relationship', 'domain_observed:' || domain, 'protocol:' || application_protocol, 'rare_destination'] AS supporting_evidence,
 'Confidence ' || cast(conf AS int) || '%. Positive: external web relationship, observed domain ' || domain || ', rare destination context. Negative: no Layer 5 beaconing hypothesis was generated.' AS confidence_explanation, conf AS confidence, 'medium' AS severity,
 ps AS priority_score, CASE WHEN ps >= 85 THEN 'CRITICAL' WHEN ps >= 70 THEN 'HIGH' WHEN ps >= 45 THEN 'MEDIUM' ELSE 'LOW' END AS priority_level, host, host_role, risk, 'Host has externally visible web activity to rare domain ' || domain || ' at ' || dest || '.' AS candidate_rationale,
 [] AS contradictory_evidence, 'PRIMARY' AS finding_tier, 'context_fallback' AS source, host AS relationship_consumer, dest AS relationship_destination, domain, responder_port AS destination_port, 1 AS destination_consumer_count, 1e0 AS destination_rarity_score, 1e0 AS destination_exclusivity_score,
 50e0 AS criticality, hostname, mac_address, user_identity, external_unique_relationships AS external_relationships, internal_unique_relationships AS internal_relationships, host_protocols[1:5] AS top_protocols, ['external_web_activity', 'domain:' || domain, 'destination:' || dest] AS rationale,
 ['inspect endpoint', 'review browser and process telemetry', 'investigate destination domain', 'preserve host identity evidence'] AS recommended_actions
FROM (SELECT *, {r('risk * 0.35e0 + conf * 0.35e0 + 50e0 * 0.3e0', 1)} AS ps FROM (SELECT f.*, initiator_ip AS host, responder_ip AS dest, h.role AS host_role, h.hostname, h.mac_address, h.user_identity, h.external_unique_relationships, h.internal_unique_relationships, h.protocols AS host_protocols, CASE WHEN application_protocol = 'http' THEN 78e0 ELSE 68e0 END AS conf, greatest(h.risk_score, CASE WHEN application_protocol = 'http' THEN 70e0 ELSE 60e0 END) AS risk
 FROM (SELECT *, web_domain AS domain FROM enriched_flows WHERE direction = 'outbound' AND application_protocol IN ('http', 'https')) f JOIN host_profiles h ON h.ip_address = f.initiator_ip WHERE domain IS NOT NULL
 ORDER BY application_protocol = 'http' DESC, domain LIKE '%.su' OR domain LIKE '%.cc' DESC, f.packet_count DESC, f.first_us, f.first_seen_sequence LIMIT 1))""")
cte("context_fallback", "SELECT * FROM web_finding WHERE capture_id NOT IN (SELECT capture_id FROM hypotheses UNION ALL SELECT capture_id FROM candidates)")
cte("community_context", "SELECT community_type, role, count(*) AS node_count FROM scored_nodes GROUP BY ALL")
cte("event_search", "SELECT * FROM (SELECT *, row_number() OVER (ORDER BY event_index DESC) AS recent FROM indexed_events WHERE severity = 'LOW' AND contains(lower(event_id || us || event_type || severity || host || array_to_string(related_hosts, ',') || description), 'tls')) WHERE recent <= 120")
_SHOWN = "lower(event_id || us || event_type || severity || host || array_to_string(related_hosts, ',') || description)"
_CALLS = [("LOW", ""), ("MEDIUM", ""), ("any", ""), ("any", "flow"), ("INFO", "10.")]
cte("event_searches", " UNION ALL ".join(
    f"SELECT *, '{sev}:{text}' AS search FROM (SELECT *, row_number() OVER (ORDER BY event_index DESC) AS recent FROM indexed_events WHERE ('{sev}' = 'any' OR severity = '{sev}') AND contains({_SHOWN}, '{text}')) WHERE recent <= 120" for sev, text in _CALLS))
cte("capture_totals", """SELECT 'cap0' AS capture_id, count(*) AS flows, cast(sum(initiator_bytes + responder_bytes) AS bigint) AS total_bytes, count(*) FILTER (suppressed) AS suppressed_flows, count(beacon_score) AS beacon_eligible_flows, count(*) FILTER (is_suspicious) AS suspicious_flows,
 (SELECT count(*) FROM host_profiles) AS hosts, (SELECT count(*) FROM host_profiles WHERE risk_score >= 35) AS elevated_hosts FROM enriched_flows""")
cte("suspicious_top", "SELECT * FROM (SELECT *, row_number() OVER (ORDER BY behavioral_score DESC, first_us, first_seen_sequence) AS place FROM enriched_flows WHERE is_suspicious) WHERE place <= 5")
cte("elevated_top", "SELECT * FROM (SELECT *, row_number() OVER (ORDER BY risk_score DESC, ip_address) AS place FROM host_profiles WHERE risk_score >= 35) WHERE place <= 5")
cte("direction_summary", "SELECT capture_id, direction, count(*) AS flows FROM flows GROUP BY ALL")
cte("protocol_top", "SELECT * FROM (SELECT application_protocol, count(*) AS flows, row_number() OVER (ORDER BY count(*) DESC, application_protocol) AS place FROM flows GROUP BY 1) WHERE place <= 10")

cte("community_audit", f"SELECT ip_address, role, {r('role_confidence * 100', 1)} AS role_confidence, community_type AS community, {private('ip_address')} AS is_internal, NOT {private('ip_address')} AS is_external, risk_score FROM scored_nodes")
cte("graph_consistency", "SELECT capture_id, count(*) AS graph_nodes, count(*) AS classified_nodes, count(DISTINCT community_type) AS community_count, count(*) FILTER (non_investigative) AS suppressed_nodes, 0::bigint AS unclassified_nodes, count(*) FILTER (NOT non_investigative) AS investigative_nodes, true AS valid FROM scored_nodes GROUP BY 1")
cte("role_consistency", "SELECT *, mismatch_count = 0 AS valid FROM (SELECT 'cap0' AS capture_id, (SELECT count(*) FROM host_profiles) AS checked_hosts, (SELECT count(*) FROM candidates) AS candidate_hosts, (SELECT count(*) FROM host_profiles h LEFT JOIN scored_nodes n ON n.ip_address = h.ip_address LEFT JOIN candidates c ON c.host = h.ip_address WHERE n.role IS DISTINCT FROM h.role OR coalesce(c.host_role, h.role) <> h.role) AS mismatch_count)")
cte("hypothesis_validation", "SELECT 'cap0' AS capture_id, count(*) AS checked, count(*) FILTER (len(supporting_evidence) = 0 OR contradictory_evidence IS NULL OR confidence IS NULL OR confidence_explanation = '') AS error_count, error_count = 0 AS valid FROM hypotheses")
cte("candidate_validation", "SELECT 'cap0' AS capture_id, count(*) AS checked, count(*) FILTER (host = '' OR priority_score IS NULL OR risk IS NULL OR len(finding_ids) = 0) AS error_count, error_count = 0 AS valid FROM candidates")
cte("snapshot_report", f"SELECT 'cap0' AS capture_id, count(*) AS total_snapshots, count(*) FILTER (quality_reason = 'useful_snapshot') AS meaningful_snapshots, 0::bigint AS redundant_snapshots, {r('sum(' + sc('quality_score', 2) + ') / count(*) / 1e2', 4)} AS quality_score, {r('sum(' + sc('quality_score', 2) + ') / count(*) / 1e2', 4)} >= 0.9e0 AS valid FROM snapshots")
cte("stable", "SELECT 'cap0' AS capture_id, rd.ready, rd.missing_components, g.valid AND ro.valid AND hv.valid AND cv.valid AND sr.valid AND rd.ready AS stable, sr.valid AS snapshots_valid FROM readiness rd, graph_consistency g, role_consistency ro, hypothesis_validation hv, candidate_validation cv, snapshot_report sr")

# The timeline without cuts: the same tables under another prefix.
_LONG = ("network_events", "relationship_events", "timeline_events", "correlated", "indexed_events", "activity_phases", "chapter_bounds", "chapter_phase_overlap", "chapter_hosts", "chapters", "frames0", "frame_selection", "event_search", "event_searches", "host_timeline_events", "host_timeline_chapters", "frames", "frame_deltas", "seek")
for _n in _LONG:
    _sql = CTES[_n].replace(" LIMIT 300", "").replace(" WHERE recent <= 120", "")
    if _n == "frames0":
        _sql = "SELECT *, row_number() OVER (ORDER BY us, event_id) AS frame_number FROM indexed_events"
    cte(f"uncut_{_n}", re.sub(r"\b(FROM|JOIN)\s+(" + "|".join(_LONG) + r")\b", r"\1 uncut_\2", _sql))
cte("whole_hosted", re.sub(r"\blimited\b", "deduped", CTES["hosted"]))
cte("ranked_whole", re.sub(r"\bhosted\b", "whole_hosted", CTES["hypotheses"]).replace(" WHERE place <= 10", ""))
# The timeline of all findings, without the cuts of hypotheses, findings of a host and candidates either.
_OF_FINDINGS = ("timed", "hypothesis_events", "host_summaries", "candidates", "narr0", "narratives", "candidate_events", "narrative_events", "timeline_events", "correlated", "indexed_events")
_NOT_CUT = {"hypotheses": "ranked_whole", "network_events": "uncut_network_events", "relationship_events": "uncut_relationship_events"} | {n: f"whole_{n}" for n in _OF_FINDINGS}
for _n in _OF_FINDINGS:
    cte(f"whole_{_n}", re.sub(r"\b(FROM|JOIN)\s+(" + "|".join(_NOT_CUT) + r")\b", lambda m: f"{m[1]} {_NOT_CUT[m[2]]}", CTES[_n].replace(" WHERE place <= 3", "")))
for _name, _key, _table in (("frame_nodes", "ip_address", "scored_nodes"), ("frame_edges", "edge_id", "graph_edges")):
    cte(_name, f"SELECT x.{_key}, coalesce((SELECT min(frame_number) FROM frames f WHERE f.us >= x.first_us), (SELECT max(frame_number) FROM frames)) AS frame_number FROM {_table} x")
cte("frame_offsets", "SELECT frame_id, frame_number - 1 AS frame_offset FROM frames")
cte("host_event_offsets", "SELECT host, event_index FROM indexed_events")
