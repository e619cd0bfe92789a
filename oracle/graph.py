"""Graph tables."""

from oracle.base import cte, digest, ipnum, noninv, private, r, sc, within

_OUT = f"(NOT {within(ipnum('ip_address'), '10.0.0.0/8', '172.16.0.0/12', '192.168.0.0/16')})"
cte("graph_nodes", f"""
SELECT *, non_investigative OR (role = 'INFRASTRUCTURE' AND len(protocols) > 0 AND len(list_filter(protocols, lambda x: x NOT IN ('dhcp', 'dns', 'ntp', 'arp', 'ldap'))) = 0) AS infrastructure_noise,
  CASE WHEN community_type = 'Unknown' THEN 0.35e0 ELSE 0.85e0 END AS community_confidence
FROM (SELECT capture_id, substr(sha256('node:' || ip_address), 1, 16) AS node_id, ip_address, hostname, role, inferred_role, risk_score, confidence, behavioral_indicators, protocol_diversity,
  CASE WHEN external_unique_hosts + internal_unique_hosts = 0 THEN 0e0 ELSE {r('least(flow_count / ((external_unique_hosts + internal_unique_hosts) * 10 + 1), 1e0)', 4)} END AS initial_density,
  first_us, last_us, first_seen_sequence AS replay_sequence_start, last_seen_sequence AS replay_sequence_end, role_confidence, role_evidence,
  external_unique_hosts AS external_connections, internal_unique_hosts AS internal_connections, protocols, telemetry_completeness,
  CASE WHEN role = 'UNKNOWN' AND NOT {private('ip_address')} THEN 'External Services' ELSE CASE role WHEN 'DOMAIN_CONTROLLER' THEN 'Domain Controllers' WHEN 'INFRASTRUCTURE' THEN 'Infrastructure'
    WHEN 'SERVER' THEN 'Servers' WHEN 'WORKSTATION' THEN 'Workstations' WHEN 'EXTERNAL_SERVICE' THEN 'External Services' ELSE 'Unknown' END END AS community_type,
  {noninv('ip_address')} AS non_investigative FROM host_profiles)""")

cte("graph_edges", f"""
SELECT capture_id, edge_id, source, target, substr(sha256('node:' || source), 1, 16) AS source_node, substr(sha256('node:' || target), 1, 16) AS target_node,
  CASE WHEN list_contains(relationship_indicators, 'persistent_tls_relationship') THEN 'persistent_tls' WHEN list_contains(relationship_indicators, 'periodic_relationship_activity') THEN 'periodic_communication'
    WHEN list_contains(relationship_indicators, 'elevated_flow_context') THEN 'suspicious_communication' WHEN list_has_any(protocols, ['ldap', 'kerberos', 'krb5']) THEN 'directory_authentication'
    WHEN list_has_any(protocols, ['msrpc', 'netbios', 'epmap']) THEN 'administrative_rpc' WHEN list_contains(protocols, 'dns') THEN 'infrastructure_dns'
    WHEN list_contains(protocols, 'http') AND persistence < 0.4e0 THEN 'interactive_http' WHEN list_has_any(protocols, ['https', 'tls']) AND persistence >= 0.4e0 THEN 'external_tls_session'
    WHEN list_has_any(protocols, ['smb', 'sftp', 'ftp', 'cifs']) THEN 'file_transfer' WHEN list_has_any(protocols, ['mdns', 'ssdp', 'dns-sd']) THEN 'service_discovery'
    WHEN list_contains(protocols, 'dhcp') THEN 'dhcp_assignment' WHEN list_has_any(protocols, ['https', 'tls']) THEN 'persistent_tls' ELSE 'interaction' END AS relationship_type,
  CASE WHEN persistence >= 0.7e0 THEN 'continuous' WHEN persistence >= 0.4e0 THEN 'periodic' WHEN flows <= 3 THEN 'sporadic' ELSE 'bursty' END AS communication_pattern, directionality,
  relationship_risk, {r('least(persistence, 1e0)', 4)} AS persistence_score, {r('least(packet_count / (flows * 5 + 1), 1e0)', 4)} AS communication_density, protocol_diversity, first_us, last_us,
  first_seen_sequence AS replay_sequence_start, last_seen_sequence AS replay_sequence_end, severity, flows, packet_count, total_bytes, protocols, persistence, relationship_indicators, graph_weight
FROM relationships""")

cte("links", f"""
SELECT node_id, count(DISTINCT other) AS node_degree, count(*) FILTER (inb = 1) AS inbound_edges, count(*) FILTER (inb = 0) AS outbound_edges, count(*) FILTER (inb = 0 OR node_id <> other) AS touches,
  sum({sc('graph_weight', 4)}) / 1e4 AS weighted, sum({sc('persistence_score', 4)}) FILTER (inb = 0 OR node_id <> other) AS pe4, count(DISTINCT relationship_type) AS type_count
FROM (SELECT source_node AS node_id, target_node AS other, 0 AS inb, * FROM graph_edges UNION ALL SELECT target_node, source_node, 1, * FROM graph_edges) GROUP BY 1""")

cte("linked_nodes", f"""
SELECT n.* EXCLUDE (initial_density), coalesce(node_degree, 0) AS node_degree, coalesce(inbound_edges, 0) AS inbound_edges, coalesce(outbound_edges, 0) AS outbound_edges, coalesce(touches, 0) AS touches,
  coalesce(type_count, 0) AS type_count, coalesce(weighted, 0e0) AS weighted_degree, coalesce(pe4 / 1e4 / touches, 0e0) AS average_persistence,
  CASE WHEN node_degree > 0 THEN {r('weighted / (node_degree + 1)', 4)} ELSE initial_density END AS communication_density
FROM graph_nodes n LEFT JOIN links l ON l.node_id = n.node_id""")

_CS = ("node_degree / greatest(top_degree, 1) * 0.2e0 + least(risk_score / 100, 1e0) * 0.3e0 + least(type_count / 8, 1e0) * 0.2e0"
       " + least(protocol_diversity / 10, 1e0) * 0.15e0 + least(external_connections / 50, 1e0) * 0.15e0")
_CONS = "(CASE WHEN inbound_edges >= 3 THEN 3 WHEN inbound_edges >= 2 THEN 2 ELSE 0 END)"
_TLS = "list_has_any(protocols, ['https', 'tls', 'ssl'])"
cte("scored_nodes", f"""
SELECT *, {r('risk_score * 0.4e0 + centrality_hint * 60', 4)} AS node_priority, pts >= 5 AS is_external_service, pts / 10 AS service_confidence,
  CASE WHEN NOT outside THEN 'internal_ip' WHEN len(reasons) = 0 THEN 'low_signal' ELSE array_to_string(reasons, '|') END AS service_reason
FROM (SELECT *, CASE WHEN infrastructure_noise THEN 0.05e0 WHEN touches = 0 THEN 0e0 ELSE {r(f'least({_CS}, 1e0)', 4)} END AS centrality_hint,
  NOT infrastructure_noise AND (risk_score >= 5 OR external_connections > 0 OR len(behavioral_indicators) > 0 OR len(protocols) > 2 OR role <> 'INFRASTRUCTURE' OR node_degree >= 2) AS is_investigative,
  {r('least(least(risk_score / 100, 1e0) * 0.25e0 + least(type_count / 8, 1e0) * 0.2e0 + least(external_connections / 100, 1e0) * 0.25e0 + average_persistence * 0.15e0 + least(protocol_diversity / 10, 1e0) * 0.15e0, 1e0)', 4)} AS behavioral_importance,
  CASE WHEN role = 'INFRASTRUCTURE' THEN 'Infrastructure' WHEN list_has_any(protocols, ['ldap', 'kerberos', 'krb5', 'msrpc']) AND node_degree > 5 THEN 'Domain Controllers'
    WHEN outside AND inbound_edges >= 2 THEN 'External Services' WHEN inbound_edges > outbound_edges * 2 AND inbound_edges > 5 THEN 'Servers'
    WHEN external_connections > 0 OR outbound_edges > inbound_edges THEN 'Workstations' ELSE 'Unknown' END AS community_heuristic,
  CASE WHEN outside THEN {_CONS} + CASE WHEN {_TLS} THEN 3 ELSE 0 END + CASE WHEN len(protocols) > 0 THEN 2 ELSE 0 END + CASE WHEN average_persistence >= 0.5e0 THEN 2 ELSE 0 END ELSE 0 END AS pts,
  list_filter([CASE WHEN inbound_edges >= 2 THEN inbound_edges || '_consumers' END, CASE WHEN {_TLS} THEN 'tls_service' END, CASE WHEN len(protocols) > 0 THEN 'service_protocols' END,
    CASE WHEN average_persistence >= 0.5e0 THEN 'persistent_relationships' END], lambda x: x IS NOT NULL) AS reasons
 FROM (SELECT *, {_OUT} AS outside, max(node_degree) OVER (ORDER BY ip_address ROWS UNBOUNDED PRECEDING) AS top_degree FROM linked_nodes))""")

cte("communities", f"""
SELECT capture_id, community_type, count(*) AS node_count, sum({sc('risk_score', 2)}) / count(*) / 100e0 AS average_risk FROM scored_nodes GROUP BY ALL""")
cte("central", """
SELECT CASE WHEN coalesce(len(q), 0) < 3 THEN f ELSE q END AS high_centrality_nodes FROM
 (SELECT list(ip_address ORDER BY centrality_hint DESC, ip_address)[1:5] AS f, (list(ip_address ORDER BY centrality_hint DESC, ip_address) FILTER (NOT infrastructure_noise))[1:5] AS q
  FROM scored_nodes WHERE NOT non_investigative)""")
cte("tops", f"""
SELECT sum(x) FILTER (i <= greatest(n // 10, 1)) / 100e0 AS top10, greatest(max(n) // 10, 1) AS k10, sum(x) FILTER (i <= greatest(n // 5, 1)) / 100e0 AS top5, sum(x) / 100e0 AS risk_sum
FROM (SELECT {sc('risk_score', 2)} AS x, row_number() OVER (ORDER BY risk_score DESC) AS i, count(*) OVER () AS n FROM scored_nodes)""")
cte("graph_metrics", f"""
SELECT 'cap0' AS capture_id, n.node_count, edge_count, {r('edge_count / greatest(n.node_count * (n.node_count - 1), 1)', 6)} AS graph_density, {r('top10 / k10', 2)} AS graph_risk_score, isolated_node_count,
  high_centrality_nodes, relationship_types, {r('deg / n.node_count', 2)} AS avg_node_degree, suspicious_edges
FROM (SELECT count(*) AS node_count, count(*) FILTER (touches = 0) AS isolated_node_count, sum(node_degree) AS deg FROM scored_nodes) n,
 (SELECT count(*) AS edge_count, list_sort(list(DISTINCT relationship_type)) AS relationship_types, count(*) FILTER (relationship_risk >= 35) AS suspicious_edges FROM graph_edges), tops, central""")

_RISKY = "relationship_type IN ('persistent_tls', 'external_tls_session', 'directory_authentication', 'administrative_rpc')"
cte("graph_risk", f"""
SELECT 'cap0' AS capture_id, {r('top10 / k10 * 0.4e0', 2)} AS host_risk, {r('greatest(p * rr, q) * 0.25e0', 2)} AS relationship_risk,
  {r('least(worst / (mean + 0.01e0) * 2, 100e0) * 0.2e0', 2)} AS community_risk, {r('greatest(least(contacts / 100, 1e0) * 25, alone * 5e0) * 0.15e0', 2)} AS topology_risk
FROM tops, (SELECT coalesce(sum({sc('persistence_score', 4)}) FILTER ({_RISKY}) / count(*) FILTER ({_RISKY}) / 1e4, 0e0) AS p, coalesce(sum({sc('relationship_risk', 2)}) FILTER ({_RISKY}) / count(*) FILTER ({_RISKY}) / 1e2, 0e0) AS rr,
   coalesce(sum({sc('relationship_risk', 2)}) FILTER (communication_pattern = 'periodic') / count(*) FILTER (communication_pattern = 'periodic') / 1e2, 0e0) AS q FROM graph_edges),
 (SELECT max(average_risk) AS worst, list_reduce(list(average_risk ORDER BY community_type), lambda a, b: a + b) / count(*) AS mean FROM communities),
 (SELECT sum(external_connections) AS contacts, count(*) FILTER (touches = 0 AND risk_score >= 20) AS alone FROM scored_nodes)""")

cte("graph_health", f"""
SELECT 'cap0' AS capture_id, {r('risk_e2 / n / 100e0', 2)} AS avg_node_risk, {r('pe4 / 1e4 / m', 4)} AS avg_edge_persistence, {r('contacts / (n * 10)', 4)} AS externality_ratio, {r('infra / n', 4)} AS infrastructure_ratio,
  {r('susp / m', 4)} AS suspicious_edge_ratio, {r('div / n', 2)} AS avg_protocol_diversity, {r('alone / n', 4)} AS isolated_node_ratio,
  {r('greatest(least(1e0 - v / (mean * mean + 0.01e0), 1e0), 0e0)', 2)} AS community_balance_score, {r('types / 12', 2)} AS relationship_diversity_score, {r('users / n', 2)} AS external_dependency_score,
  CASE WHEN risk_sum > 0 THEN {r('top5 / risk_sum', 2)} ELSE 0e0 END AS risk_concentration_score
FROM tops, (SELECT count(*) AS n, sum({sc('risk_score', 2)}) AS risk_e2, sum(external_connections) AS contacts, count(*) FILTER (role = 'INFRASTRUCTURE') AS infra, sum(protocol_diversity) AS div, count(*) FILTER (node_degree = 0) AS alone FROM scored_nodes),
 (SELECT count(*) AS m, sum({sc('persistence_score', 4)}) AS pe4, count(*) FILTER (relationship_risk >= 35) AS susp, count(DISTINCT relationship_type) AS types FROM graph_edges),
 (SELECT sum(node_count) / count(*) AS mean, (sum(node_count * node_count) * count(*) - sum(node_count) * sum(node_count)) / count(*) / count(*) AS v FROM communities),
 (SELECT count(DISTINCT source_node) AS users FROM graph_edges WHERE target_node IN (SELECT node_id FROM scored_nodes WHERE is_external_service))""")

cte("hashes", """
SELECT 'node_' || ip_address AS entity, substr(sha256(node_id || ':' || risk_score || ':' || array_to_string(list_sort(behavioral_indicators), ',') || ':' || array_to_string(protocols, ',')), 1, 16) AS hash FROM scored_nodes
UNION ALL SELECT 'edge_' || edge_id, substr(sha256(source_node || ':' || target_node || ':' || relationship_type || ':' || relationship_risk), 1, 16) FROM graph_edges""")
cte("graph_state", f"""
SELECT m.*, x.*, risk.* EXCLUDE (capture_id, relationship_risk), risk.relationship_risk AS relationship_risk_part, h.* EXCLUDE (capture_id), g.*, m.node_count - classified_nodes AS unclassified_nodes,
  {digest('hash', 'hashes')} AS graph_fingerprint,
  substr(sha256({digest('node_id', 'scored_nodes')} || ':' || coalesce({digest('edge_id', 'graph_edges')}, '')), 1, 16) AS snapshot_id
FROM graph_metrics m, graph_risk risk, graph_health h,
 (SELECT max(last_us) AS timestamp_us, min(replay_sequence_start) FILTER (replay_sequence_start > 0) AS replay_sequence_start, max(replay_sequence_end) AS replay_sequence_end FROM scored_nodes) x,
 (SELECT count(*) AS community_count, cast(sum(node_count) AS bigint) AS classified_nodes, list(community_type || '=' || node_count ORDER BY community_type) AS community_summary FROM communities) g""")
