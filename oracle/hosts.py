"""Hosts and relationships."""

from oracle.base import color, cte, graded, ipclass, lst, private, r, ratio

H = 3600000000

cte("host_flow_expansion", """
SELECT *, initiator_ip AS ip_address, responder_ip AS peer_ip, 'initiator' AS role, initiator_packets AS host_packets, initiator_bytes AS upload,
  responder_bytes AS download, initiator_mac AS mac, direction AS host_direction, 1::bigint AS initiated, CASE WHEN initiator_ip = responder_ip THEN 1::bigint ELSE 0 END AS responded FROM enriched_flows
UNION ALL BY NAME
SELECT *, responder_ip AS ip_address, initiator_ip AS peer_ip, 'responder' AS role, responder_packets AS host_packets, responder_bytes AS upload,
  initiator_bytes AS download, responder_mac AS mac, CASE direction WHEN 'outbound' THEN 'inbound' WHEN 'inbound' THEN 'outbound' ELSE direction END AS host_direction,
  0::bigint AS initiated, 1::bigint AS responded FROM enriched_flows WHERE initiator_ip <> responder_ip""")

cte("edge_hints", """
SELECT capture_id, ip_address, peer_ip AS target, count(*) AS flow_count, list_sort(list(DISTINCT application_protocol)) AS protocols,
  cast(sum(initiator_bytes + responder_bytes) AS bigint) AS total_bytes, min(first_us) AS first_us, max(last_us) AS last_us
FROM host_flow_expansion GROUP BY ALL""")

cte("host_hours", f"""
SELECT ip_address, h, count(*) AS n FROM (SELECT ip_address, unnest([first_us // {H}, last_us // {H}]) AS h FROM host_flow_expansion) GROUP BY ALL""")
cte("host_hour_lists", f"""
SELECT ip_address, count(*) AS active_bucket_count, sum(CASE WHEN p IS NULL OR h - p > 1 THEN 1 ELSE 0 END) AS activity_cluster_count,
  string_agg(h * {H}, ',' ORDER BY h) AS active_time_buckets, string_agg((h * {H}) || '=' || n, ',' ORDER BY h) AS hourly_activity_distribution
FROM (SELECT *, lag(h) OVER (PARTITION BY ip_address ORDER BY h) AS p FROM host_hours) GROUP BY 1""")

cte("host_names", """
SELECT ip_address, arg_min(n, (CASE WHEN n LIKE '%-%' OR upper(n) LIKE 'DESKTOP%' THEN 0 ELSE 1 END, n)) AS hostname
FROM (SELECT ip_address, trim(split_part(unnest(all_nbns), '<', 1)) AS n FROM host_flow_expansion) WHERE n <> '' AND upper(n) NOT IN ('WORKGROUP', 'MSHOME') GROUP BY 1""")
cte("host_users", """
SELECT ip_address, min(x) AS user_identity FROM (SELECT ip_address, unnest(all_users) AS x FROM host_flow_expansion
 WHERE role = CASE WHEN responder_port IN (88, 464) THEN 'initiator' WHEN initiator_port IN (88, 464) THEN 'responder' END) GROUP BY 1""")

_F = "count(*) FILTER"
cte("host_base", f"""
SELECT capture_id, ip_address, count(*) AS flow_count, cast(sum(host_packets) AS bigint) AS packet_count, cast(sum(upload) AS bigint) AS upload_bytes,
  cast(sum(download) AS bigint) AS download_bytes, upload_bytes + download_bytes AS total_bytes, cast(sum(initiated) AS bigint) AS initiated_flow_count,
  cast(sum(responded) AS bigint) AS responded_flow_count, {_F} (host_direction = 'outbound') AS outbound_connections, {_F} (host_direction = 'inbound') AS inbound_connections,
  {_F} (host_direction = 'internal') AS internal_flow_count, {_F} (host_direction IN ('outbound', 'inbound', 'external')) AS external_flow_count,
  {_F} (is_periodic) AS beacon_flow_count, {_F} (is_suspicious) AS suspicious_flow_count, {_F} (suppressed) AS suppressed_flow_count,
  {_F} (raw_duration_seconds >= 900) AS persistent_connection_count, {_F} (raw_duration_seconds >= 300) AS long_lived_flow_count,
  {_F} (application_protocol = 'unknown') AS unknown_n, {_F} (application_protocol IN ('https', 'http2', 'smtps', 'ldaps', 'imaps', 'pops')) AS encrypted_n,
  {_F} (list_contains(suspicious_indicators, 'low_frequency_destination')) AS low_n,
  {_F} (application_protocol IN ('https', 'http2') AND direction IN ('outbound', 'inbound', 'external') AND (raw_duration_seconds >= 300 OR coalesce(beacon_score, 0) <> 0)) AS tls_n,
  {_F} (application_protocol = 'smb' AND direction IN ('outbound', 'inbound', 'external')) AS smb_n,
  sum(last_us - first_us) AS dur_us, sum(cast(round(app_confidence * 10000) AS bigint)) AS conf_e4,
  count(DISTINCT peer_ip) AS unique_peers, count(DISTINCT peer_ip) FILTER (initiated = 1) AS unique_destinations,
  count(DISTINCT peer_ip) FILTER (pc.cls = 'external') AS external_unique_hosts, count(DISTINCT peer_ip) FILTER (pc.cls = 'internal') AS internal_unique_hosts,
  count(DISTINCT responder_port) AS unique_ports, count(DISTINCT responder_port) FILTER (responded = 1 AND responder_port IN (53, 80, 88, 135, 139, 389, 443, 445, 464, 636, 3389)) AS server_ports,
  count(DISTINCT (peer_ip, application_protocol)) AS protocol_relationships, count(DISTINCT peer_ip) FILTER (raw_duration_seconds >= 900) AS persistent_relationships,
  list_sort(list(DISTINCT application_protocol)) AS protocols, list_sort(list(DISTINCT transport_layer)) AS transports,
  min(first_us) AS first_us, max(last_us) AS last_us, arg_min(first_seen_sequence, (first_us, first_seen_sequence)) AS first_seen_sequence,
  arg_max(last_seen_sequence, (last_us, -first_us, -first_seen_sequence)) AS last_seen_sequence,
  min(lower(mac)) FILTER (mac <> 'ff:ff:ff:ff:ff:ff') AS mac_address
FROM host_flow_expansion JOIN ips pc ON pc.ip = peer_ip GROUP BY 1, 2""")
cte("host_top_peer", "SELECT ip_address, max(flow_count) AS top_peer FROM edge_hints GROUP BY 1")

cte("host_metrics", f"""
SELECT *, {r('least(flow_count / 50, 1e0) * 0.25e0 + least(packet_count / 750, 1e0) * 0.25e0 + least(active_duration / 3600, 1e0) * 0.2e0 + protocol_confidence_avg * (1e0 - least(unknown_protocol_ratio, 0.85e0)) * 0.3e0', 4)} AS telemetry_completeness,
  {ratio('flow_count', 'greatest(active_duration / 3600, 1e0)')} AS session_density
FROM (SELECT b.*, t.top_peer, n.hostname, u.user_identity, hl.active_bucket_count, cast(hl.activity_cluster_count AS bigint) AS activity_cluster_count, hl.active_time_buckets, hl.hourly_activity_distribution,
  {r('(last_us - first_us) / 1e6', 4)} AS active_duration, {ratio('unknown_n', 'flow_count')} AS unknown_protocol_ratio, {ratio('encrypted_n', 'flow_count')} AS encrypted_flow_ratio,
  {r('conf_e4 / flow_count / 1e4', 4)} AS protocol_confidence_avg, {ratio('upload_bytes', 'download_bytes')} AS upload_download_ratio, {r('dur_us / flow_count / 1e6', 4)} AS average_flow_duration,
  external_flow_count AS external_connections, internal_flow_count AS internal_connections, external_unique_hosts AS external_unique_relationships,
  internal_unique_hosts AS internal_unique_relationships, len(protocols) AS protocol_diversity, len(transports) AS transport_diversity,
  {ratio('outbound_connections', 'flow_count')} AS outbound_ratio, {ratio('inbound_connections', 'flow_count')} AS inbound_ratio, {ratio('internal_flow_count', 'flow_count')} AS internal_ratio,
  {ratio('beacon_flow_count', 'flow_count')} AS periodic_flow_ratio, {ratio('persistent_connection_count', 'flow_count')} AS persistent_connection_ratio,
  {r('flow_count / greatest(active_bucket_count, 1)', 4)} AS activity_density, {r('total_bytes / 1e6 + flow_count', 4)} AS graph_weight, unique_peers AS graph_degree,
  {r('least(flow_count / 250, 1e0) * 0.35e0 + least(unique_peers / 50, 1e0) * 0.35e0 + least(external_flow_count / 50, 1e0) * 0.3e0', 4)} AS graph_importance
FROM host_base b JOIN host_hour_lists hl ON hl.ip_address = b.ip_address JOIN host_top_peer t ON t.ip_address = b.ip_address
LEFT JOIN host_names n ON n.ip_address = b.ip_address LEFT JOIN host_users u ON u.ip_address = b.ip_address)""")

_DC = "list_sort(list_filter(protocols, lambda x: x IN ('dns', 'kerberos', 'ldap', 'ldaps', 'smb', 'msrpc')))"
_INFRA = "list_sort(list_filter(protocols, lambda x: x IN ('arp', 'dhcp', 'dns', 'llmnr', 'mdns', 'nbns', 'ntp', 'ssdp')))"
_WEB = "list_has_any(protocols, ['dns', 'https', 'http'])"
_PUB = f"NOT {private('ip_address')}"
cte("host_roles", f"""
SELECT *, CASE rule WHEN 1 THEN 'EXTERNAL_SERVICE' WHEN 3 THEN 'DOMAIN_CONTROLLER' WHEN 4 THEN 'WORKSTATION' WHEN 5 THEN 'WORKSTATION' WHEN 6 THEN 'WORKSTATION'
    WHEN 7 THEN 'INFRASTRUCTURE' WHEN 8 THEN 'SERVER' WHEN 9 THEN 'INFRASTRUCTURE' ELSE 'UNKNOWN' END AS role, role AS inferred_role,
  CASE rule WHEN 1 THEN 0.82e0 WHEN 3 THEN 0.84e0 WHEN 4 THEN 0.84e0 WHEN 5 THEN 0.84e0 WHEN 6 THEN 0.7e0 WHEN 7 THEN 0.78e0 WHEN 8 THEN 0.76e0 WHEN 9 THEN 0.72e0 ELSE 0.35e0 END AS role_confidence,
  CASE rule WHEN 1 THEN ['external_ip', 'external_service_behavior'] WHEN 2 THEN ['external_low_signal_endpoint'] WHEN 3 THEN {_DC}
    WHEN 4 THEN ['external_destination_fanout', 'dns_https_client_behavior'] WHEN 5 THEN ['outbound_dominant', 'dns_https_client_behavior', 'destination_fanout']
    WHEN 6 THEN ['outbound_dominant', 'client_fanout'] WHEN 7 THEN {_INFRA} WHEN 8 THEN ['high_inbound_ratio', 'stable_service_ports', 'many_clients']
    WHEN 9 THEN ['infrastructure_protocol_only'] ELSE ['insufficient_role_evidence'] END AS role_evidence
FROM (SELECT *, CASE
  WHEN {_PUB} AND (internal_unique_hosts >= 2 OR persistent_relationships >= 2 OR suspicious_flow_count > 0 OR beacon_flow_count > 0) THEN 1
  WHEN {_PUB} THEN 2
  WHEN list_has_all(protocols, ['ldap', 'kerberos', 'smb']) OR (len({_DC}) >= 4 AND inbound_ratio >= 0.35e0 AND responded_flow_count >= 10) THEN 3
  WHEN unique_destinations >= 20 AND external_unique_hosts >= 20 AND {_WEB} THEN 4
  WHEN outbound_ratio >= 0.4e0 AND unique_destinations >= 3 AND {_WEB} THEN 5
  WHEN outbound_ratio >= 0.35e0 AND unique_destinations >= 2 THEN 6
  WHEN list_contains(protocols, 'dhcp') OR (list_has_any(protocols, ['dns', 'ldap']) AND len({_INFRA}) >= 2) THEN 7
  WHEN inbound_ratio >= 0.35e0 AND responded_flow_count >= 10 AND server_ports >= 2 THEN 8
  WHEN len(protocols) > 0 AND len({_INFRA}) = len(protocols) THEN 9 ELSE 10 END AS rule FROM host_metrics)""")

_EXPECTED = "('arp','dhcp','dns','ftp','http','http2','https','icmp','imap','imaps','kerberos','ldap','ldaps','llmnr','mdns','msrpc','nbns','netbios_datagram','netbios_session','ntp','pop','pops','rdp','smb','smtp','smtp_submission','smtps','snmp','snmptrap','ssdp','ssh')"
HP = [
    ("unusual_external_persistence", "persistent_relationships > 0 AND external_unique_hosts > 0", "least(persistent_relationships * 8e0, 20e0)"),
    ("periodic_communication_behavior", "beacon_flow_count > 0", "least(beacon_flow_count * 10e0, 24e0)"),
    ("elevated_external_relationship_fanout", "external_unique_hosts >= 12", "least(external_unique_hosts / 35 * 18e0, 18e0)"),
    ("recurring_activity_windows", "activity_cluster_count >= 3 AND active_duration >= 1800", "least(activity_cluster_count * 4e0, 14e0)"),
    ("ambiguous_or_unusual_protocol_mix", f"len(list_filter(protocols, lambda x: x NOT IN {_EXPECTED})) > 0", "10e0"),
    ("asymmetric_upload_behavior", "upload_bytes > 1000000 AND upload_download_ratio >= 3", "14e0"),
    ("persistent_external_tls", "tls_n > 0", "14e0"),
    ("infrequent_external_contact", "low_n > 0", "least(low_n * 6e0, 16e0)"),
    ("elevated_flow_context", "suspicious_flow_count > 0", "least(suspicious_flow_count * 7e0, 20e0)"),
    ("concentrated_external_relationship", "top_peer / flow_count >= 0.7e0 AND external_unique_hosts > 0", "8e0"),
    ("workstation_external_smb_exposure", "role = 'WORKSTATION' AND smb_n > 0", "16e0"),
]
_sum = " + ".join(f"(CASE WHEN {c} THEN {r(v, 4)} ELSE 0e0 END)" for _, c, v in HP)
_det = ", ".join(f"CASE WHEN {c} THEN '{n}=' || cast(floor(({v}) * 1e4 + 0.5e0) AS bigint) END" for n, c, v in HP)
_CHAT = "len(list_filter(protocols, lambda x: x NOT IN ('arp', 'dhcp', 'llmnr', 'mdns', 'nbns', 'ssdp'))) = 0"
_STAB = "(CASE WHEN flow_count < 3 THEN 0.22e0 WHEN active_duration <= 0 THEN 0.3e0 WHEN activity_cluster_count <= 1 THEN 0.48e0 WHEN activity_density <= 10 THEN 0.68e0 ELSE 0.58e0 END)"

cte("host_scored", f"""
SELECT *, {lst(*[(n, c) for n, c, _ in HP])} AS behavioral_indicators, list_sort(list_filter([{_det}], lambda x: x IS NOT NULL)) AS indicator_details,
  greatest({_sum} - (least(suppressed_flow_count / flow_count * 40, 38e0) + CASE WHEN {_CHAT} THEN 34 ELSE 0 END
   + CASE WHEN role IN ('DOMAIN_CONTROLLER', 'SERVER') AND list_contains(protocols, 'smb') THEN 8 ELSE 0 END + CASE WHEN role = 'INFRASTRUCTURE' THEN 18 ELSE 0 END
   + CASE WHEN external_unique_hosts = 0 AND suspicious_flow_count = 0 THEN 14 ELSE 0 END), 0e0) AS pressure,
  least(CASE WHEN role = 'INFRASTRUCTURE' THEN 42e0 ELSE 82e0 END, CASE len(behavioral_indicators) WHEN 0 THEN 48e0 WHEN 1 THEN 48e0 WHEN 2 THEN 64e0 ELSE 82e0 END) AS cap,
  {r(f'least((least(flow_count / 85, 1e0) * 0.18e0 + least(packet_count / 1500, 1e0) * 0.18e0 + least(active_duration / 10800, 1e0) * 0.18e0 + protocol_confidence_avg * (1e0 - least(unknown_protocol_ratio, 0.9e0)) * 0.18e0 + telemetry_completeness * 0.18e0 + {_STAB} * 0.1e0) * (1e0 - least(unknown_protocol_ratio * 0.55e0, 0.55e0)) * (1e0 - least(encrypted_flow_ratio * 0.18e0, 0.18e0)), 0.78e0)', 4)} AS confidence
FROM host_roles""")

cte("host_profiles", f"""
SELECT *, {graded('risk_score', 'confidence', 48, 26)} AS severity, {r('least(8e0 + graph_degree * 0.35e0 + risk_score / 8, 42e0)', 2)} AS graph_node_size,
  {color('risk_score', 'confidence', 55, 30)} AS graph_risk_color,
  CASE WHEN external_connections > 0 AND {graded('risk_score', 'confidence', 48, 26)} IN ('medium', 'high') THEN 'elevated_external_behavior' WHEN {_CHAT} THEN 'infrastructure_chatter'
    WHEN internal_connections > 0 AND external_connections = 0 THEN 'internal_host' ELSE 'mixed_behavior' END AS graph_cluster_group
FROM (SELECT *, {r('least(cap * (1e0 - exp(-pressure / 48)), cap)', 2)} AS risk_score FROM host_scored)""")

_RP = [
    ("unusual_relationship_persistence", "persistence >= 0.6e0", "18e0"),
    ("periodic_relationship_activity", "periodic_flows > 0", "least(periodic_flows * 12e0, 24e0)"),
    ("elevated_flow_context", "suspicious_flows > 0", "least(suspicious_flows * 10e0, 20e0)"),
    ("ambiguous_protocol_relationship", "list_contains(protocols, 'unknown')", "8e0"),
    ("persistent_tls_relationship", "protocols = ['https'] AND persistence >= 0.45e0", "12e0"),
]
_rsum = " + ".join(f"(CASE WHEN {c} THEN {v} ELSE 0e0 END)" for _, c, v in _RP)
cte("relationships", f"""
SELECT *, {graded('relationship_risk', 'confidence', 52, 28)} AS severity, {color('relationship_risk', 'confidence', 52, 28)} AS graph_edge_color,
  {r('least(1e0 + flows / 12 + relationship_risk / 40, 8e0)', 2)} AS graph_edge_width
FROM (SELECT *, {lst(*[(n, c) for n, c, _ in _RP])} AS relationship_indicators,
  {r(f'78e0 * (1e0 - pow(2.718281828e0, -(({_rsum}) * (1e0 - least(suppressed_flows / flows * 0.75e0, 0.75e0))) / 42))', 2)} AS relationship_risk,
  {r("least(least(flows / 20, 1e0) * 0.25e0 + least(packet_count / 250, 1e0) * 0.3e0 + least(span / 3600, 1e0) * 0.2e0 + (CASE WHEN list_contains(protocols, 'unknown') THEN 0.45e0 ELSE 0.72e0 END) * 0.25e0, 0.8e0)", 4)} AS confidence
 FROM (SELECT *, substr(sha256(source || '->' || target), 1, 16) AS edge_id, (last_us - first_us) / 1e6 AS span, len(protocols) AS protocol_diversity, 'directed' AS directionality,
   {r('least(dur_us / 1e6 / 3600, 1e0) * 0.45e0 + least((last_us - first_us) / 1e6 / 7200, 1e0) * 0.35e0 + least(flows / 24, 1e0) * 0.2e0', 4)} AS persistence, {r('flows + packet_count / 100', 4)} AS graph_weight
  FROM (SELECT capture_id, initiator_ip AS source, responder_ip AS target, count(*) AS flows, cast(sum(packet_count) AS bigint) AS packet_count, cast(sum(initiator_bytes + responder_bytes) AS bigint) AS total_bytes,
   list_sort(list(DISTINCT application_protocol)) AS protocols, list_sort(list(DISTINCT transport_layer)) AS transports, min(first_us) AS first_us, max(last_us) AS last_us,
   min(first_seen_sequence) AS first_seen_sequence, max(last_seen_sequence) AS last_seen_sequence, sum(last_us - first_us) AS dur_us,
   count(*) FILTER (is_suspicious) AS suspicious_flows, count(*) FILTER (is_periodic) AS periodic_flows, count(*) FILTER (suppressed) AS suppressed_flows,
   list_sort(list_distinct(list_concat(list(first_us // {H}), list(last_us // {H})))) AS temporal_buckets FROM enriched_flows GROUP BY ALL)))""")

BASE = ["flow_count", "external_flow_count", "internal_flow_count", "packet_count", "total_bytes", "upload_bytes", "download_bytes", "external_connections",
        "external_unique_hosts", "external_unique_relationships", "internal_connections", "internal_unique_hosts", "internal_unique_relationships",
        "unique_destinations", "unique_peers", "unique_ports", "protocol_relationships", "persistent_relationships", "protocol_diversity",
        "unknown_protocol_ratio", "encrypted_flow_ratio", "telemetry_completeness", "beacon_flow_count", "suspicious_flow_count",
        "persistent_connection_count", "long_lived_flow_count", "active_duration", "activity_density", "session_density", "activity_cluster_count", "risk_score", "confidence"]
cte("baseline_snapshot", """
SELECT h.*, n AS host_count, substr(sha256('cap0|' || n || '|' || x), 1, 16) AS snapshot_id FROM host_profiles h,
 (SELECT count(*) AS n, bit_xor(cast('0x' || substr(md5(ip_address), 1, 15) AS bigint)) AS x FROM host_profiles)""")
