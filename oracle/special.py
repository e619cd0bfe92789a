"""SQL of the queries in netloom.plans.special."""

from oracle.base import cloud, color, direction, evsev, graded, noninv, private, r
from oracle.constants import BASELINE_FIELDS

_NAMES = "split_part(split_part(nbns_name, ',', 1), '<', 1)"
_ROLE = "CASE role WHEN 'DOMAIN_CONTROLLER' THEN 'Domain Controller' WHEN 'INFRASTRUCTURE' THEN 'Infrastructure' WHEN 'SERVER' THEN 'Server' WHEN 'WORKSTATION' THEN 'Workstation' WHEN 'EXTERNAL_SERVICE' THEN 'External Service' ELSE 'Unknown' END"


def _ladder(x: str, *steps, default: str) -> str:
    return "CASE " + " ".join(f"WHEN {x} >= {b} THEN '{n}'" for b, n in steps) + f" ELSE '{default}' END"


_S = "behavioral_score"
_fields = " UNION ALL ".join(
    f"SELECT coalesce(c.ip_address, p.ip_address) AS ip_address, '{f}' AS field, coalesce(cast(p.{f} AS double), 0e0) AS previous, coalesce(cast(c.{f} AS double), 0e0) AS current "
    "FROM host_profiles_cur c FULL JOIN host_profiles_prev p ON c.ip_address = p.ip_address" for f in BASELINE_FIELDS)

def _counted(tables: dict) -> str:
    return " UNION ALL ".join(f"SELECT '{name}' AS artifact, count(*) AS rows, 0::bigint AS changed FROM {table}" for name, table in tables.items())


SQL = {
    "packet_source": """SELECT capture_id, packet_index, us, src_ip, dst_ip, transport, src_port, dst_port, ttl, total_bytes, layer, tls_sni, http_host, dns_query, tls_alpn, src_mac, dst_mac, nbns_name, kerberos_cname,
      coalesce(transport = 'tcp' AND syn, false) AS tcp_syn, coalesce(transport = 'tcp' AND ack, false) AS tcp_ack, coalesce(transport = 'tcp' AND rst, false) AS tcp_rst, coalesce(transport = 'tcp' AND fin, false) AS tcp_fin, coalesce(transport = 'tcp' AND psh, false) AS tcp_psh FROM raw_packets""",
    "hypothesis_errors": "SELECT hypothesis_id, array_to_string(list_filter([CASE WHEN len(supporting_evidence) = 0 THEN 'supporting_evidence' END, CASE WHEN place % 3 = 0 THEN 'confidence' END, CASE WHEN place % 2 = 0 THEN 'confidence_explanation' END], lambda x: x IS NOT NULL), ',') AS missing_fields FROM hypotheses",
    "candidate_errors": "SELECT host, CASE place WHEN 1 THEN 'host_role' WHEN 2 THEN 'risk' ELSE '' END AS missing_fields FROM candidates",
    "role_mismatches": "SELECT ip_address AS host, 'SERVER' AS graph_node_role FROM scored_nodes WHERE (ip_address LIKE '%0' OR ip_address LIKE '%5') AND replace(role, ' ', '_') <> 'SERVER'",
    "immediate_edge_baseline": "SELECT c.edge_id, c.flows, p.flows AS previous_flows, c.relationship_risk AS risk, p.relationship_risk AS previous_risk FROM relationships_cur c LEFT JOIN relationships_prev p ON p.edge_id = c.edge_id",
    "frame_lookup": "SELECT frame_number, frame_id, us, node_count, edge_count FROM frames WHERE frame_number IN (3, 7)",
    "chapter_index": "SELECT capture_id, count(*) OVER () AS chapter_count, row_number() OVER (ORDER BY chapter_number) - 1 AS place, chapter_number, chapter_id, title, start_us, end_us FROM chapters",
    "chapter_merge_pairs": """SELECT 'TYPE_' || (chapter_number - (chapter_number - 1) % 2) AS chapter_type, min(start_us) AS start_us, max(end_us) AS end_us, sum(event_count)::bigint AS event_count, sum(phase_count)::bigint AS phase_count,
      max(importance) AS importance, arg_max(severity, CASE severity WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 1 ELSE 0 END) AS severity FROM chapters GROUP BY 1""",
    "normalize_fragments": """SELECT packet_index, sp AS src_port, dp AS dst_port, CASE WHEN transport <> 'arp' THEN ttl END AS ttl,
      CASE WHEN transport = 'arp' THEN 0 ELSE greatest(total_bytes - CASE transport WHEN 'tcp' THEN 40 WHEN 'udp' THEN 28 ELSE 20 END, 0) END AS payload_bytes,
      substr(md5(src_ip || ':' || coalesce(sp, 0) || '->' || dst_ip || ':' || coalesce(dp, 0) || '(' || transport || ')'), 1, 16) AS flow_id
      FROM (SELECT *, CASE WHEN packet_index % 5 <> 0 AND transport IN ('tcp', 'udp') THEN src_port END AS sp, CASE WHEN packet_index % 5 <> 0 AND transport IN ('tcp', 'udp') THEN dst_port END AS dp FROM raw_packets)
      WHERE packet_index % 5 <> 2 AND (packet_index % 5 <> 1 OR transport NOT IN ('tcp', 'udp'))""",
    "normalize_timestamp": "SELECT packet_index, CASE WHEN packet_index % 3 = 2 THEN us - 7200000000 ELSE us END AS utc_us FROM raw_packets",
    "normalization_counts": "SELECT capture_id, count(*) AS packets, count(*) AS normalized, 0::bigint AS failed FROM raw_packets GROUP BY 1",
    "packet_sequence": "SELECT packet_index, packet_index AS replay_sequence_id FROM raw_packets",
    "timeline_index": "SELECT packet_index, row_number() OVER (ORDER BY us, packet_index) - 1 AS timeline_index FROM raw_packets",
    "chronology_warning": "SELECT capture_id, bool_or(coalesce(p > packet_index, false)) AS out_of_order FROM (SELECT *, lag(packet_index) OVER (ORDER BY us, packet_index) AS p FROM raw_packets) GROUP BY 1",
    "capture_duration": f"SELECT capture_id, {r('(max(us) - min(us)) / 1e6', 4)} AS capture_duration_seconds FROM raw_packets GROUP BY 1",
    "ip_class": "SELECT ip, cls AS ip_class FROM ips",
    "direction": f"SELECT DISTINCT src_ip, dst_ip, {direction('s.cls', 'd.cls')} AS direction FROM raw_packets JOIN ips s ON s.ip = src_ip JOIN ips d ON d.ip = dst_ip",
    "is_private_ip": f"SELECT ip, {private('ip')} AS is_private FROM ips",
    "tcp_flags": "SELECT packet_index, syn, ack, rst, fin, psh, false AS urg, false AS ece, false AS cwr FROM raw_packets WHERE transport = 'tcp'",
    "transport_protocol": "SELECT packet_index, transport AS transport_layer FROM raw_packets",
    "app_protocol_infer": "SELECT packet_index, weak_name AS inferred_name, weak_conf AS inferred_confidence FROM proto",
    "app_protocol_enrich": "SELECT packet_index, strong_name AS enriched_name, strong_conf AS enriched_confidence, kind AS enrichment_kind, coalesce(array_to_string(evidence, ','), '') AS evidence FROM proto",
    "protocol_merge": "SELECT packet_index, CASE WHEN strong_name <> 'unknown' OR weak_name = 'unknown' THEN strong_name ELSE weak_name END AS application_protocol, CASE WHEN strong_name <> 'unknown' OR weak_name = 'unknown' THEN strong_conf ELSE weak_conf END AS app_confidence FROM proto",
    "layer_metadata": "SELECT packet_index, tls_sni, http_host, tls_alpn, dns_query, coalesce(array_to_string(list_filter([CASE WHEN tls_sni IS NOT NULL THEN 'tls_sni' END, CASE WHEN http_host IS NOT NULL THEN 'http_host' END, CASE WHEN tls_alpn IS NOT NULL THEN 'tls_alpn' END, CASE WHEN dns_query IS NOT NULL THEN 'dns_query' END], lambda x: x IS NOT NULL), ','), '') AS evidence FROM raw_packets",
    "identity_fields": "SELECT packet_index, src_mac, dst_mac, nbns_name, kerberos_cname FROM raw_packets",
    "payload_bytes": "SELECT packet_index, payload_bytes FROM packets",
    "flow_id": "SELECT packet_index, flow_id FROM packets",
    "normalize_domain": "SELECT packet_index, field, trim(split_part(regexp_replace(trim(lower(x)), '^[a-z]+://', ''), '/', 1), '.') AS domain FROM (SELECT packet_index, unnest(['http_host', 'dns_query', 'tls_sni']) AS field, unnest([http_host, dns_query, tls_sni]) AS x FROM raw_packets) WHERE x IS NOT NULL",
    "clean_nbns_name": f"SELECT packet_index, trim({_NAMES}) AS name FROM raw_packets WHERE nbns_name IS NOT NULL",
    "clean_hostname": f"SELECT packet_index, trim({_NAMES}) AS hostname FROM raw_packets WHERE nbns_name IS NOT NULL",
    "normalize_role": f"SELECT ip_address, role, {_ROLE} AS role_display FROM host_profiles",
    "non_investigative_node": f"SELECT ip, {noninv('ip')} AS non_investigative FROM ips",
    "common_cloud_ip": f"SELECT ip, {cloud('ip')} AS common_cloud FROM ips",
    "investigative_domain": "SELECT DISTINCT domain, contains(domain, '.') AND NOT regexp_matches(domain, 'microsoft|windows|office|msn\\.com|bing\\.com|google|cloudflare|akamai|azureedge|adobe|mozilla|digicert|msft|live\\.com|gstatic') AS investigative FROM (SELECT name AS domain FROM flow_names WHERE kind = 'domain')",
    "severity": f"SELECT flow_id, {graded(_S, 'confidence', 55, 30)} AS flow_severity, {graded(_S, 'confidence', 48, 26)} AS host_severity, {graded(_S, 'confidence', 52, 28)} AS relationship_severity, {evsev(_S)} AS event_severity, CASE WHEN severity IN ('high', 'medium', 'low') THEN upper(severity) ELSE 'INFO' END AS event_label, "
                f"{_ladder(_S, (90, 'CRITICAL'), (75, 'HIGH'), (60, 'MEDIUM'), (40, 'LOW'), default='INFORMATIONAL')} AS priority_level, {_ladder(_S, (85, 'CRITICAL'), (70, 'HIGH'), (45, 'MEDIUM'), default='LOW')} AS fallback_level, {_ladder(_S, (85, 'PRIMARY'), (70, 'SECONDARY'), default='SUPPORTING')} AS tier FROM enriched_flows",
    "display_columns": f"SELECT ip_address, {color('risk_score', 'confidence', 55, 30)} AS color, {r('least(8e0 + graph_degree * 0.35e0 + risk_score / 8, 42e0)', 2)} AS size, {r('least(1e0 + flow_count / 12 + risk_score / 40, 8e0)', 2)} AS width FROM host_profiles",
    "dedup_evidence": "SELECT flow_id, array_to_string(list_concat(suspicious_indicators, ['TLS']), ',') AS evidence FROM enriched_flows",
    "bidirectional_flows": "SELECT * EXCLUDE (capture_id) FROM bidirectional_flows",
    "inter_packet_delay": "SELECT * FROM delay",
    "shannon_entropy": "SELECT flow_id, payload_entropy AS entropy FROM size_entropy",
    "rarity_context": "SELECT flow_id, destination_flows, protocol_flows FROM scored",
    "host_temporal": "SELECT ip_address, first_us, last_us, first_seen_sequence, last_seen_sequence, active_time_buckets, hourly_activity_distribution FROM host_profiles",
    "immediate_baseline": "SELECT c.ip_address, c.risk_score AS current_risk, p.risk_score AS previous_risk, c.unique_ports AS current_ports, p.unique_ports AS previous_ports, p.ip_address IS NOT NULL AS known FROM host_profiles_cur c LEFT JOIN host_profiles_prev p ON p.ip_address = c.ip_address",
    "baseline_diff": f"SELECT *, {r('current - previous', 4)} AS delta FROM ({_fields}) WHERE current <> previous",
    "indicator_diff": "SELECT ip_address, coalesce(array_to_string(list_sort(list_filter(n, lambda x: NOT list_contains(t, x))), ','), '') AS new_indicators, coalesce(array_to_string(list_sort(list_filter(t, lambda x: NOT list_contains(n, x))), ','), '') AS removed_indicators FROM (SELECT coalesce(c.ip_address, p.ip_address) AS ip_address, coalesce(c.behavioral_indicators, []) AS n, coalesce(p.behavioral_indicators, []) AS t FROM host_profiles_cur c FULL JOIN host_profiles_prev p ON p.ip_address = c.ip_address)",
    "destination_pair": "SELECT delta_id, consumer, destination FROM pairs",
    "destination_consumers": "SELECT destination, n AS consumer_count FROM consumers",
    "destination_rarity": f"SELECT destination, {r('1e0 / n', 4)} AS rarity, CASE WHEN n = 1 THEN 1e0 ELSE {r('greatest(0e0, 1e0 - (n - 1) / 12e0)', 4)} END AS exclusivity FROM consumers",
    "hypothesis_definitions": """SELECT d.*, (SELECT count(*) FROM w_found f WHERE f.hypothesis_type = d.hypothesis_type) AS findings FROM (VALUES
      ('port_scan', 'Port Scan', 'medium', 'new_relationship_count,unique_ports_delta,low_persistence', 'new_relationship_count=45,unique_ports_delta=25,low_persistence=20,risk_delta=10'),
      ('host_sweep', 'Host Sweep', 'medium', 'new_peer_count,external_host_delta,steady_port_pattern', 'new_peer_count=40,external_host_delta=25,steady_port_pattern=20,risk_delta=15'),
      ('beaconing', 'Beaconing', 'high', 'periodicity,persistence,external_relationship', 'periodicity=35,persistence=35,external_relationship=20,risk_delta=10'),
      ('persistent_tls', 'Persistent TLS', 'high', 'https_persistence,external_tls,session_duration', 'https_persistence=45,external_tls=35,risk_delta=20')) d(hypothesis_type, title, severity, signals, weights)""",
    "weighted_score": f"SELECT delta_id, {r('(persistence * 0.35e0 + persistence * 0.35e0 + (CASE WHEN delta_type = ' + chr(39) + 'external_relationship_emergence' + chr(39) + ' THEN 0.2e0 ELSE 0e0 END)) * 1e2', 2)} AS score FROM relationship_deltas",
    "write_ndjson": _counted({
        "normalized_packets": "packets", "flows": "flows", "flow_names": "flow_names", "enriched_flows": "enriched_flows", "host_profiles": "host_profiles", "relationships": "relationships",
        "host_baseline_snapshot": "baseline_snapshot", "layer5_deltas": "(SELECT 1 FROM host_profiles UNION ALL SELECT 1 FROM relationships)", "layer5_hypotheses": "hypotheses",
        "layer5_investigation_candidates": "candidates", "investigation_narratives": "narratives", "graph_nodes": "scored_nodes", "graph_edges": "graph_edges", "graph_snapshots": "snapshots",
        "graph_state": "graph_state", "timeline_events": "timeline_events", "activity_phases": "activity_phases", "replay_frames": "frames", "replay_index": "indexed_events",
        "host_timelines": "host_timelines", "host_timeline_events": "host_timeline_events", "host_timeline_chapters": "host_timeline_chapters", "major_chapters": "chapters",
    }),
    "write_csv": _counted({x: x if x != "normalized_packets" else "packets" for x in ("normalized_packets", "flows", "enriched_flows", "host_profiles", "relationships")}),
    "read_artifacts": "SELECT format, ip_address, risk_score, role, coalesce(array_to_string(protocols, ','), '') AS protocols FROM host_profiles, (VALUES ('csv'), ('ndjson')) f(format)",
}
