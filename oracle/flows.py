"""Packets and flows."""

from oracle.base import cte, direction, graded, ipclass, lst, r, ratio

cte("ev", """
SELECT event_id AS id, user_id AS u, event_type AS et, cast(json_extract_string(props, '$.k') AS int) AS k, event_id % 40 AS rr,
  1704067200000000 + (epoch_us(ts) - 1704067200000000) // 240 AS us, epoch_us(ts) AS raw_us,
  '10.2.' || (1 + user_id // 250) || '.' || (1 + user_id % 250) AS hub
FROM events""")

cte("pk0", """
SELECT *,
  CASE WHEN id % 1000 = 999 THEN '127.0.0.1' WHEN rr < 3 THEN '10.2.0.' || (11 + rr)
    WHEN et = 'error' AND k < 50 THEN '52.224.' || (k % 10) || '.' || (u % 20 + 1) ELSE hub END AS src_ip,
  CASE WHEN id % 1000 = 999 THEN '127.0.0.1' WHEN rr < 3 THEN '45.131.214.' || (85 + rr)
    WHEN et = 'click' THEN '52.224.' || (k % 10) || '.' || (u % 20 + 1) WHEN et = 'view' THEN '93.184.' || (k % 5) || '.34'
    WHEN et = 'purchase' THEN '10.2.28.' || (2 + k % 2) WHEN et = 'signup' THEN '10.2.28.2' WHEN k < 50 THEN hub
    WHEN k < 60 THEN '10.2.28.255' WHEN k < 70 THEN '224.0.0.251' WHEN k < 80 THEN '255.255.255.255' WHEN k < 89 THEN '10.2.28.1'
    WHEN k = 89 THEN '0.0.0.0' ELSE '185.220.101.' || (1 + u % 30) END AS dst_ip,
  CASE WHEN id % 1000 = 999 OR rr < 3 OR et IN ('click', 'view', 'purchase') THEN 'tcp' WHEN et = 'signup' THEN 'udp'
    WHEN k < 50 THEN 'tcp' WHEN k < 80 THEN 'udp' WHEN k < 90 THEN 'arp' ELSE 'tcp' END AS transport,
  CASE WHEN id % 1000 = 999 THEN 8080 WHEN rr < 3 THEN 50000 + rr WHEN et = 'click' THEN 40000 + u % 1000 WHEN et = 'view' THEN 41000 + k % 4
    WHEN et = 'purchase' THEN 42000 + k % 3 WHEN et = 'signup' THEN 50100 + k % 8 WHEN k < 50 THEN 443 WHEN k < 60 THEN 137
    WHEN k < 70 THEN 5353 WHEN k < 80 THEN 68 WHEN k < 90 THEN NULL ELSE 43000 END AS src_port,
  CASE WHEN id % 1000 = 999 THEN 8080 WHEN rr < 3 THEN 443 WHEN et = 'click' THEN 443 WHEN et = 'view' THEN 80
    WHEN et = 'purchase' THEN [445, 389, 88, 53][k % 4 + 1] WHEN et = 'signup' THEN 53 WHEN k < 50 THEN 40000 + u % 1000 WHEN k < 60 THEN 137
    WHEN k < 70 THEN 5353 WHEN k < 80 THEN 67 WHEN k < 90 THEN NULL ELSE 4444 END AS dst_port
FROM ev""")

cte("raw_packets", """
SELECT 'cap0' AS capture_id, id AS packet_index, us, src_ip, dst_ip, transport, cast(src_port AS bigint) AS src_port,
  cast(dst_port AS bigint) AS dst_port, 64::bigint AS ttl, cast(CASE WHEN rr < 3 THEN 120 + k % 5 ELSE 60 + k * 14 END AS bigint) AS total_bytes,
  transport = 'tcp' AND id % 8 = 0 AS syn, transport = 'tcp' AND id % 8 <> 0 AS ack, transport = 'tcp' AND dst_port = 4444 AND k % 2 = 0 AS rst,
  transport = 'tcp' AND id % 16 = 15 AS fin, transport = 'tcp' AND k % 3 = 0 AS psh,
  CASE WHEN transport = 'arp' THEN 'ARP' WHEN dst_port = 443 AND k % 2 = 0 THEN 'TLS' END AS layer,
  CASE WHEN rr >= 3 AND et = 'click' THEN 'site' || (k % 10) || '.example.com' END AS tls_sni,
  CASE WHEN rr >= 3 AND et = 'view' THEN 'http://Web' || (k % 5) || '.example.su/x' END AS http_host,
  CASE WHEN rr >= 3 AND et = 'signup' THEN 'host' || k || '.corp.local.' END AS dns_query,
  CASE WHEN rr >= 3 AND et = 'click' AND k % 2 = 0 THEN 'h2' END AS tls_alpn,
  '02:00:00:00:' || lpad(cast(u // 100 AS varchar), 2, '0') || ':' || lpad(cast(u % 100 AS varchar), 2, '0') AS src_mac,
  CASE WHEN dst_ip IN ('255.255.255.255', '10.2.28.255') THEN 'ff:ff:ff:ff:ff:ff' END AS dst_mac,
  CASE WHEN dst_port = 137 THEN 'DESKTOP-' || u || '<00>' END AS nbns_name,
  CASE WHEN dst_port = 88 THEN 'user' || u END AS kerberos_cname
FROM pk0""")

# port tables of the two protocol rules, limited to nothing: all known ports
cte("port_weak", """
SELECT * FROM (VALUES ('udp',53,'dns',0.75e0),('udp',67,'dhcp',0.85e0),('udp',68,'dhcp',0.85e0),('udp',137,'nbns',0.85e0),('udp',1900,'ssdp',0.85e0),
 ('udp',5353,'mdns',0.85e0),('udp',5355,'llmnr',0.85e0),('tcp',22,'ssh',0.7e0),('tcp',25,'smtp',0.7e0),('tcp',80,'http',0.7e0),('tcp',110,'pop',0.7e0),
 ('tcp',143,'imap',0.7e0),('tcp',443,'https',0.7e0),('tcp',445,'smb',0.7e0)) v(t, port, name, conf)""")
cte("port_strong", """
SELECT * FROM (VALUES ('tcp',20,'ftp_data',0.62e0),('tcp',21,'ftp',0.68e0),('tcp',22,'ssh',0.72e0),('tcp',25,'smtp',0.68e0),('tcp',53,'dns',0.64e0),
 ('tcp',80,'http',0.72e0),('tcp',110,'pop',0.66e0),('tcp',123,'ntp',0.62e0),('tcp',135,'msrpc',0.70e0),('tcp',139,'netbios_session',0.70e0),
 ('tcp',143,'imap',0.66e0),('tcp',389,'ldap',0.70e0),('tcp',443,'https',0.74e0),('tcp',445,'smb',0.74e0),('tcp',465,'smtps',0.68e0),
 ('tcp',587,'smtp_submission',0.66e0),('tcp',636,'ldaps',0.70e0),('tcp',993,'imaps',0.68e0),('tcp',995,'pops',0.68e0),('tcp',3389,'rdp',0.74e0),
 ('udp',53,'dns',0.78e0),('udp',67,'dhcp',0.86e0),('udp',68,'dhcp',0.86e0),('udp',123,'ntp',0.72e0),('udp',137,'nbns',0.86e0),
 ('udp',138,'netbios_datagram',0.80e0),('udp',161,'snmp',0.70e0),('udp',162,'snmptrap',0.68e0),('udp',1900,'ssdp',0.86e0),
 ('udp',5353,'mdns',0.88e0),('udp',5355,'llmnr',0.88e0)) v(t, port, name, conf)""")

cte("proto", """
SELECT p.packet_index,
  CASE WHEN layer = 'TLS' THEN 'https' WHEN layer = 'ARP' THEN 'arp' ELSE coalesce(wd.name, ws.name, CASE transport WHEN 'arp' THEN 'arp' WHEN 'icmp' THEN 'icmp' ELSE 'unknown' END) END AS weak_name,
  CASE WHEN layer = 'TLS' THEN 0.9e0 WHEN layer = 'ARP' THEN 0.95e0 ELSE coalesce(wd.conf, ws.conf, CASE WHEN transport IN ('arp', 'icmp') THEN 0.95e0 ELSE 0e0 END) END AS weak_conf,
  CASE WHEN layer = 'TLS' THEN 'https' WHEN layer = 'ARP' THEN 'arp' ELSE coalesce(sd.name, ss.name, CASE transport WHEN 'arp' THEN 'arp' WHEN 'icmp' THEN 'icmp' ELSE 'unknown' END) END AS strong_name,
  CASE WHEN layer = 'TLS' THEN 0.92e0 WHEN layer = 'ARP' THEN 0.96e0 ELSE coalesce(sd.conf, ss.conf, CASE transport WHEN 'arp' THEN 0.96e0 WHEN 'icmp' THEN 0.95e0 ELSE 0e0 END) END AS strong_conf,
  CASE WHEN layer IN ('TLS', 'ARP') THEN 'decoded_layer' WHEN coalesce(sd.name, ss.name) IS NOT NULL THEN 'port_inference' WHEN transport IN ('arp', 'icmp') THEN 'transport_inference' ELSE 'none' END AS kind,
  CASE WHEN layer IN ('TLS', 'ARP') THEN ['decoded_layer:' || lower(layer)] WHEN sd.name IS NOT NULL THEN ['well_known_port:' || transport || '/' || dst_port]
    WHEN ss.name IS NOT NULL THEN ['well_known_port:' || transport || '/' || src_port] WHEN transport IN ('arp', 'icmp') THEN ['transport:' || transport] ELSE cast([] AS varchar[]) END AS evidence
FROM raw_packets p
LEFT JOIN port_weak wd ON wd.t = (CASE transport WHEN 'udp' THEN 'udp' ELSE 'tcp' END) AND wd.port = dst_port
LEFT JOIN port_weak ws ON ws.t = (CASE transport WHEN 'udp' THEN 'udp' ELSE 'tcp' END) AND ws.port = src_port
LEFT JOIN port_strong sd ON sd.t = transport AND sd.port = dst_port
LEFT JOIN port_strong ss ON ss.t = transport AND ss.port = src_port""")

cte("ips", f"SELECT ip, {ipclass('ip')} AS cls FROM (SELECT src_ip AS ip FROM raw_packets UNION SELECT dst_ip FROM raw_packets)")

cte("packets", f"""
SELECT p.capture_id, p.packet_index, p.packet_index AS replay_sequence_id, us, src_ip, dst_ip, CASE WHEN transport <> 'arp' THEN ttl END AS ttl,
  transport AS transport_layer, src_port, dst_port, syn, ack, rst, fin, psh,
  cast(CASE transport WHEN 'arp' THEN 0 WHEN 'tcp' THEN greatest(0, total_bytes - 40) WHEN 'udp' THEN greatest(0, total_bytes - 28) ELSE greatest(0, total_bytes - 20) END AS bigint) AS payload_bytes,
  total_bytes,
  CASE WHEN transport = 'arp' THEN 'arp' WHEN strong_name <> 'unknown' OR weak_name = 'unknown' THEN strong_name ELSE weak_name END AS application_protocol,
  CASE WHEN transport = 'arp' THEN 0.95e0 WHEN strong_name <> 'unknown' OR weak_name = 'unknown' THEN strong_conf ELSE weak_conf END AS app_confidence,
  CASE WHEN transport = 'arp' THEN 'transport_inference' ELSE kind END AS protocol_enrichment,
  CASE WHEN transport = 'arp' THEN ['transport:arp'] ELSE list_concat(evidence, {lst(('tls_sni', 'tls_sni IS NOT NULL'), ('tls_alpn', 'tls_alpn IS NOT NULL'), ('http_host', 'http_host IS NOT NULL'), ('dns_query', 'dns_query IS NOT NULL'))}) END AS protocol_evidence,
  tls_sni, tls_alpn, http_host, dns_query, src_mac, dst_mac, nbns_name, kerberos_cname,
  {direction('s.cls', 'd.cls')} AS direction,
  substr(md5(src_ip || ':' || coalesce(src_port, 0) || '->' || dst_ip || ':' || coalesce(dst_port, 0) || '(' || transport || ')'), 1, 16) AS flow_id
FROM raw_packets p JOIN proto USING (packet_index) JOIN ips s ON s.ip = src_ip JOIN ips d ON d.ip = dst_ip""")

cte("packet_names", """
SELECT DISTINCT capture_id, packet_index, flow_id, us, kind, name FROM (
  SELECT *, trim(split_part(CASE WHEN contains(lower(trim(x)), '://') THEN split_part(lower(trim(x)), '://', 2) ELSE lower(trim(x)) END, '/', 1), '.') AS name
  FROM (SELECT capture_id, packet_index, flow_id, us, 'domain' AS kind, unnest([http_host, dns_query, tls_sni]) AS x FROM packets)
  UNION ALL SELECT capture_id, packet_index, flow_id, us, 'nbns', nbns_name, trim(split_part(split_part(nbns_name, ',', 1), '<', 1)) FROM packets
  UNION ALL SELECT capture_id, packet_index, flow_id, us, 'kerberos', kerberos_cname, kerberos_cname FROM packets) WHERE name <> ''""")
cte("flow_names", "SELECT capture_id, flow_id, kind, name, count(*) AS packets, min(us) AS first_us FROM packet_names GROUP BY ALL")
cte("listed_names", """
SELECT flow_id, list(name ORDER BY name) FILTER (kind = 'domain') AS ds, list(name ORDER BY name) FILTER (kind = 'nbns') AS ns, list(name ORDER BY name) FILTER (kind = 'kerberos') AS ks FROM flow_names GROUP BY 1""")

cte("flows", f"""
SELECT *, greatest(raw_duration_seconds, 0.001e0) AS duration_seconds, least(packet_count / greatest(raw_duration_seconds, 0.001e0), 1e5) AS raw_pps,
  raw_duration_seconds >= 0 AS chronology_valid, {lst(('duration_exceeds_one_year', 'raw_duration_seconds > 31536000'))} AS duration_anomalies,
  CASE WHEN transport_layer <> 'tcp' THEN 'not_tcp' WHEN rst_count > 0 THEN 'reset_observed' WHEN syn_count > 0 AND ack_count = 0 THEN 'syn_without_ack'
    WHEN syn_count > 0 AND ack_count > 0 AND fin_count > 0 THEN 'closed' WHEN syn_count > 0 THEN 'established_observed' ELSE 'tcp_flags_observed' END AS tcp_state_summary
FROM (
  SELECT capture_id, p.flow_id, min(us) AS first_us, max(us) AS last_us, arg_min(replay_sequence_id, (us, replay_sequence_id)) AS first_seen_sequence,
    arg_max(replay_sequence_id, (us, -replay_sequence_id)) AS last_seen_sequence, any_value(src_ip) AS initiator_ip, any_value(dst_ip) AS responder_ip,
    any_value(transport_layer) AS transport_layer, any_value(src_port) AS initiator_port, any_value(dst_port) AS responder_port,
    count(*) AS initiator_packets, cast(sum(total_bytes) AS bigint) AS initiator_bytes, 0::bigint AS responder_packets, 0::bigint AS responder_bytes,
    count(*) FILTER (syn) AS syn_count, count(*) FILTER (ack) AS ack_count, count(*) FILTER (rst) AS rst_count, count(*) FILTER (fin) AS fin_count,
    count(*) FILTER (psh) AS psh_count, 0::bigint AS urg_count,
    arg_min(application_protocol, (us, replay_sequence_id)) AS application_protocol, arg_min(app_confidence, (us, replay_sequence_id)) AS app_confidence,
    any_value(direction) AS direction, arg_min(src_mac, (us, replay_sequence_id)) AS initiator_mac, arg_min(dst_mac, (us, replay_sequence_id)) FILTER (dst_mac IS NOT NULL) AS responder_mac,
    coalesce(any_value(ds), [])[1:100] AS observed_domains, coalesce(len(any_value(ds)), 0) AS domain_count, coalesce(len(any_value(ns)), 0) AS nbns_count, coalesce(len(any_value(ks)), 0) AS kerberos_count,
    list_filter(any_value(ds), lambda d: contains(d, '.') AND NOT regexp_matches(d, 'microsoft|windows|office|msn\\.com|bing\\.com|google|cloudflare|akamai|azureedge|adobe|mozilla|digicert|msft|live\\.com|gstatic'))[1] AS web_domain, any_value(ks)[1] AS first_user,
    coalesce(any_value(ns), []) AS all_nbns, coalesce(any_value(ks), []) AS all_users,
    coalesce(any_value(ns), [])[1:100] AS nbns_names, coalesce(any_value(ks), [])[1:100] AS kerberos_cnames,
    count(*) AS packet_count, (max(us) - min(us)) / 1e6 AS raw_duration_seconds
  FROM packets p LEFT JOIN listed_names d ON p.flow_id = d.flow_id GROUP BY capture_id, p.flow_id)""")

cte("bidirectional_flows", """
SELECT capture_id, ip_a, port_a, ip_b, port_b, cast(sum(packet_count) AS bigint) AS total_packets, cast(sum(initiator_bytes) AS bigint) AS total_bytes,
  min(first_us) AS first_us, max(last_us) AS last_us, count(*) AS directional_flows
FROM (SELECT *, initiator_ip < responder_ip OR (initiator_ip = responder_ip AND coalesce(initiator_port, -1) <= coalesce(responder_port, -1)) AS keep,
  CASE WHEN keep THEN initiator_ip ELSE responder_ip END AS ip_a, CASE WHEN keep THEN initiator_port ELSE responder_port END AS port_a,
  CASE WHEN keep THEN responder_ip ELSE initiator_ip END AS ip_b, CASE WHEN keep THEN responder_port ELSE initiator_port END AS port_b FROM flows)
GROUP BY ALL""")

cte("size_stats", f"""
SELECT flow_id, {r('m', 2)} AS avg_packet_size, {r('v', 2)} AS packet_size_variance, {r('sqrt(v)', 2)} AS packet_size_stddev, {r('sqrt(v)/m', 4)} AS packet_size_cv
FROM (SELECT flow_id, sum(total_bytes) / count(*) AS m,
  cast(count(*)::hugeint * sum(total_bytes * total_bytes)::hugeint - sum(total_bytes)::hugeint * sum(total_bytes)::hugeint AS double) / count(*) / count(*) AS v FROM packets GROUP BY 1)""")
cte("size_entropy", f"""
SELECT flow_id, {r('greatest(-sum((n / t) * log2(n / t)), 0e0)', 4)} AS payload_entropy
FROM (SELECT flow_id, total_bytes, count(*) AS n, sum(count(*)) OVER (PARTITION BY flow_id) AS t FROM packets GROUP BY 1, 2) GROUP BY 1""")
cte("delay", f"""
SELECT flow_id, {r('avg(g) / 1000e0', 4)} AS mean_inter_packet_delay_ms, {r('median(g) / 1000e0', 4)} AS median_inter_packet_delay_ms,
  {r('max(g) / 1000e0', 4)} AS max_inter_packet_delay_ms, {r('coalesce(stddev_samp(g), 0e0) / 1000e0', 4)} AS inter_arrival_jitter, count(g) AS beacon_intervals
FROM (SELECT flow_id, us - lag(us) OVER (PARTITION BY flow_id ORDER BY us) AS g FROM packets) WHERE g IS NOT NULL GROUP BY 1""")

cte("scored", f"""
SELECT f.*, s.* EXCLUDE (flow_id), e.payload_entropy, mean_inter_packet_delay_ms, median_inter_packet_delay_ms, max_inter_packet_delay_ms, inter_arrival_jitter,
  coalesce(beacon_intervals, 0) AS beacon_intervals, {r('raw_pps', 4)} AS packets_per_second, {r('least(initiator_bytes / duration_seconds, 1e9)', 4)} AS bytes_per_second,
  {ratio('responder_bytes', 'initiator_bytes')} AS data_ratio,
  CASE WHEN initiator_port IS NULL OR initiator_port = responder_port THEN 0e0 ELSE 1e0 END AS port_entropy, 1::bigint AS protocol_diversity,
  count(*) OVER (PARTITION BY responder_ip) AS destination_flows, count(*) OVER (PARTITION BY application_protocol) AS protocol_flows,
  CASE WHEN application_protocol IN ('arp', 'dhcp', 'llmnr', 'mdns', 'nbns', 'ssdp') THEN 'expected_' || application_protocol || '_infrastructure_traffic'
    WHEN direction IN ('broadcast', 'multicast', 'loopback') THEN 'expected_' || direction || '_traffic' WHEN transport_layer = 'arp' THEN 'expected_arp_resolution'
    WHEN transport_layer = 'udp' AND (initiator_port IN (67, 68, 137, 1900, 5353, 5355) OR responder_port IN (67, 68, 137, 1900, 5353, 5355)) THEN 'expected_udp_service_port_' ||
      array_to_string(list_sort(list_distinct(list_filter([initiator_port, responder_port], lambda x: x IN (67, 68, 137, 1900, 5353, 5355)))), ',')
    ELSE '' END AS suppression_reason,
  CASE WHEN packet_count < 20 THEN 'insufficient_packets (' || packet_count || ' < 20)' WHEN coalesce(beacon_intervals, 0) < 10 THEN 'insufficient_intervals (' || beacon_intervals || ' < 10)'
    WHEN coalesce(mean_inter_packet_delay_ms, 0) <= 0 THEN 'missing_timing_data' END AS gap,
  inter_arrival_jitter / nullif(mean_inter_packet_delay_ms, 0) AS icv
FROM flows f JOIN size_stats s ON s.flow_id = f.flow_id JOIN size_entropy e ON e.flow_id = f.flow_id LEFT JOIN delay d ON d.flow_id = f.flow_id""")

cte("beacons", f"""
SELECT *, CASE WHEN gap IS NULL THEN {r('greatest(1e0 - least(icv, 1.5e0) / 1.5e0, 0e0) * 0.7e0 + greatest(1e0 - least(packet_size_cv, 1.5e0) / 1.5e0, 0e0) * 0.3e0', 4)} END AS raw_beacon,
  CASE WHEN gap IS NULL THEN {r('least((least(beacon_intervals / 50, 1e0) * 0.3e0 + least(raw_duration_seconds / 3600, 1e0) * 0.2e0 + greatest(1e0 - least(icv, 2e0) / 2, 0e0) * 0.2e0 + least(greatest(app_confidence, 0.2e0), 0.95e0) * 0.15e0 + least(packet_count / 100, 1e0) * 0.15e0) * (CASE WHEN app_confidence >= 0.85e0 THEN 0.88e0 ELSE 1e0 END), 0.82e0)', 4)} END AS raw_beacon_conf,
  coalesce(gap, 'periodicity_cv=' || printf('%.2f', {r('icv', 2)}) || ';payload_cv=' || printf('%.2f', {r('packet_size_cv', 2)})) AS raw_reason FROM scored""")

PTS = [
    ("potential_beaconing_behavior", "raw_beacon >= 0.65e0", "raw_beacon * 30"),
    ("periodic_low_volume_communication", "raw_duration_seconds >= 300 AND packet_count >= 10 AND raw_pps < 0.2e0", "18e0"),
    ("external_communication", "direction IN ('outbound', 'inbound', 'external')", "12e0"),
    ("low_frequency_destination", "direction IN ('outbound', 'external') AND destination_flows <= 2", "12e0"),
    ("unusual_protocol_context", "application_protocol IN ('unknown', 'irc') OR protocol_flows <= 2", "10e0"),
    ("unusual_remote_service_port", "responder_port IN (4444, 5555, 6667, 8888, 1337, 31337, 27374, 12345)", "18e0"),
    ("upload_heavy_asymmetry", "initiator_bytes > 1000000 AND data_ratio < 0.25e0", "16e0"),
    ("tcp_syn_without_ack", "transport_layer = 'tcp' AND tcp_state_summary = 'syn_without_ack'", "12e0"),
    ("tcp_reset_observed", "transport_layer = 'tcp' AND tcp_state_summary = 'reset_observed'", "12e0"),
]
_points = " + ".join(f"coalesce(CASE WHEN {c} THEN {v} END, 0e0)" for _, c, v in PTS)
_detail = ", ".join(f"CASE WHEN {c} THEN '{n}=' || cast(floor(({v}) * 1e4 + 0.5e0) AS bigint) END" for n, c, v in PTS)

cte("risked", f"""
SELECT *, {lst(*[(n, c) for n, c, _ in PTS])} AS ind, list_filter([{_detail}], lambda x: x IS NOT NULL) AS details,
  CASE WHEN len(ind) >= 2 THEN {r(f'least({_points}, 100e0)', 2)} ELSE 0e0 END AS raw_score FROM beacons""")

cte("enriched_flows", f"""
SELECT * EXCLUDE (raw_beacon, raw_beacon_conf, raw_reason, ind, details, raw_score, gap, icv),
  {graded('behavioral_score', 'confidence', 55, 30)} AS severity, behavioral_score >= 35 AND confidence >= 0.2e0 AS is_suspicious,
  coalesce(beacon_score >= 0.65e0, false) AS is_periodic
FROM (SELECT *, suppression_reason <> '' AS suppressed, CASE WHEN suppressed THEN 'infrastructure' ELSE '' END AS suppression_category,
  CASE WHEN NOT suppressed THEN raw_beacon END AS beacon_score, CASE WHEN NOT suppressed THEN raw_beacon_conf END AS beacon_confidence,
  CASE WHEN suppressed THEN suppression_reason ELSE raw_reason END AS beacon_reason, CASE WHEN suppressed THEN 0e0 ELSE raw_score END AS behavioral_score,
  CASE WHEN suppressed THEN 0e0 ELSE coalesce(nullif(raw_beacon_conf, 0), {r('least(least(beacon_intervals / 30, 1e0) * 0.35e0 + least(raw_duration_seconds / 1800, 1e0) * 0.25e0 + least(packet_count / 50, 1e0) * 0.25e0 + 0.1e0, 0.7e0)', 4)}) END AS confidence,
  CASE WHEN suppressed OR len(ind) < 2 THEN [] ELSE ind END AS suspicious_indicators,
  CASE WHEN suppressed OR len(ind) < 2 THEN [] ELSE list_sort(details) END AS indicator_details
FROM risked)""")
