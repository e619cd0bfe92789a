"""Windows, deltas, hypotheses, candidates."""

import re

from oracle.base import CTES, cte, cloud, direction, ipclass, lst, private, r

CUT = 1704072600000000
FIXED = ("ev", "pk0", "port_weak", "port_strong", "raw_packets")
_chain = [n for n in CTES if n not in FIXED]
for _suffix, _test in (("cur", f"us >= {CUT}"), ("prev", f"us < {CUT}")):
    cte(f"raw_packets_{_suffix}", f"SELECT * FROM raw_packets WHERE {_test}")
    for _n in _chain:
        cte(f"{_n}_{_suffix}", re.sub(r"\b(FROM|JOIN)\s+(" + "|".join([*_chain, "raw_packets"]) + r")\b", rf"\1 \2_{_suffix}", CTES[_n]))


def listing(x: str) -> str:
    return f"'[' || coalesce(array_to_string(list_transform({x}, lambda v: '''' || v || ''''), ', '), '') || ']'"


def pyf(x: str) -> str:
    return f"cast({x} AS varchar)"


_HM = {"new_relationship_count": "rel_d", "new_peer_count": "peer_d", "external_host_delta": "ext_d", "unique_ports_delta": "ports_d", "same_port_peer_count": "same", "low_persistence_ratio": "low"}
_ALLH = ["risk_score_delta", "persistence_delta", "new_protocols", "removed_protocols", *_HM]


def _h(kind, conf, sev, text, test, **m):
    cols = ", ".join(f"{m.get(n, 'NULL')} AS {n}" for n in _ALLH)
    return f"""SELECT capture_id, substr(sha256('host:' || ip || ':' || {kind}), 1, 16) AS delta_id, 'host' AS entity_type, ip AS entity_id, {kind} AS delta_type, {conf}e0 AS confidence, {sev} AS severity,
  'Host ' || ip || {text} AS summary, {cols}, rmean AS risk_score_mean FROM w_pair WHERE {test}"""




def _observed(key: str, current: str, previous: str) -> str:
    """Protocols of a key with the snapshots that show them, counts times 10,000 as maps are compared."""
    return f"""SELECT {key}, array_to_string(list(p || '=' || (n * 10000) ORDER BY p || '=' || (n * 10000)), ',') AS observed_protocols FROM (SELECT {key}, p, count(*) AS n FROM
 (SELECT {key}, unnest(protocols) AS p FROM {current} UNION ALL SELECT {key}, unnest(protocols) FROM {previous}) GROUP BY ALL) GROUP BY 1"""


cte("w_host_history", f"""
SELECT h.*, o.observed_protocols FROM (SELECT ip_address, sum(cast(round(risk_score * 100) AS bigint)) / count(*) / 1e2 AS risk_score_mean,
  sqrt(greatest((sum(cast(round(risk_score * 100) AS bigint) * cast(round(risk_score * 100) AS bigint)) * count(*) - sum(cast(round(risk_score * 100) AS bigint)) * sum(cast(round(risk_score * 100) AS bigint))) / count(*) / count(*), 0)) / 1e2 AS risk_score_std,
  sum(cast(round(persistent_connection_ratio * 10000) AS bigint)) / count(*) / 1e4 AS average_persistence, sum(unique_ports) / count(*) AS unique_port_mean, count(*) AS sample_count
FROM (SELECT * FROM host_profiles_cur UNION ALL BY NAME SELECT * FROM host_profiles_prev) GROUP BY 1) h
LEFT JOIN ({_observed("ip_address", "host_profiles_cur", "host_profiles_prev")}) o USING (ip_address)""")
cte("w_edge_history", f"""
SELECT h.*, o.observed_protocols FROM (SELECT edge_id, sum(cast(round(persistence * 10000) AS bigint)) / count(*) / 1e4 AS persistence_mean,
  sqrt(greatest((sum(cast(round(persistence * 10000) AS bigint) * cast(round(persistence * 10000) AS bigint)) * count(*) - sum(cast(round(persistence * 10000) AS bigint)) * sum(cast(round(persistence * 10000) AS bigint))) / count(*) / count(*), 0)) / 1e4 AS persistence_std,
  sum(flows) / count(*) AS average_flow_count, count(*) AS sample_count
FROM (SELECT * FROM relationships_cur UNION ALL BY NAME SELECT * FROM relationships_prev) GROUP BY 1) h
LEFT JOIN ({_observed("edge_id", "relationships_cur", "relationships_prev")}) o USING (edge_id)""")

cte("w_pair", f"""
SELECT *, CASE WHEN peer_d >= 3 AND ports_d <= 2 THEN 1e0 ELSE 0e0 END AS same,
 list_sort(list_filter(cp, lambda x: NOT list_contains(pp, x))) AS added, list_sort(list_filter(pp, lambda x: NOT list_contains(cp, x))) AS gone
FROM (SELECT 'cap0' AS capture_id, coalesce(c.ip_address, p.ip_address) AS ip, c.ip_address IS NULL AS no_cur, p.ip_address IS NULL AS no_prev, c.ip_address IS NOT NULL AND p.ip_address IS NOT NULL AS both_,
  {r('c.risk_score - p.risk_score', 4)} AS risk_d, c.unique_ports - p.unique_ports AS ports_d, {r('c.persistent_connection_ratio - p.persistent_connection_ratio', 4)} AS persist_d,
  c.protocol_relationships - p.protocol_relationships AS rel_d, c.unique_peers - p.unique_peers AS peer_d, c.external_unique_hosts - p.external_unique_hosts AS ext_d,
  CASE WHEN c.persistent_relationships < p.persistent_relationships THEN 1e0 ELSE 0e0 END AS low, c.protocols AS cp, p.protocols AS pp, h.risk_score_mean AS rmean
 FROM host_profiles_cur c FULL JOIN host_profiles_prev p ON c.ip_address = p.ip_address LEFT JOIN w_host_history h ON h.ip_address = coalesce(c.ip_address, p.ip_address))""")
_RISK = "both_ AND (abs(risk_d) >= 15 OR risk_d >= greatest(15e0, rmean * 0.3e0))"
cte("w_host_deltas", " UNION ALL ".join([
    _h("'new_host'", "0.75", "'informational'", "' appears for the first time in the current snapshot.'", "no_prev"),
    _h("CASE WHEN risk_d > 0 THEN 'risk_increase' ELSE 'risk_decrease' END", "0.8", "CASE WHEN risk_d > 0 THEN 'medium' ELSE 'low' END", f"' risk score changed by ' || {pyf('risk_d')} || '.'", _RISK, risk_score_delta="risk_d"),
    _h("'protocol_change'", "0.7", "'informational'", f"' has protocol changes: added ' || {listing('added')} || ', removed ' || {listing('gone')} || '.'", "both_ AND len(added) + len(gone) > 0", new_protocols="added", removed_protocols="gone"),
    _h("'persistence_change'", "0.75", "'informational'", f"' persistence changed by ' || {pyf('persist_d')} || '.'", "both_ AND abs(persist_d) >= 0.2e0", persistence_delta="persist_d"),
    _h("'host_behavior_change'", "0.7", "'informational'", "' has behavioral profile changes in relationships and persistence.'", "both_ AND (rel_d <> 0 OR peer_d <> 0 OR ext_d <> 0 OR same <> 0 OR low <> 0)", **_HM),
    _h("'removed_host'", "0.7", "'informational'", "' no longer appears in the current snapshot.'", "no_cur"),
]))


def _rel(pair: str, hist: str = "NULL") -> str:
    def row(kind, conf, sev, text, test, protocols="cprot", pers="cpers", pd="NULL", flows="NULL", added="NULL", gone="NULL", ends=True):
        s, t = ("source", "target") if ends else ("NULL", "NULL")
        return f"""SELECT capture_id, substr(sha256('relationship:' || edge_id || ':' || {kind}), 1, 16) AS delta_id, 'relationship' AS entity_type, edge_id AS entity_id, {kind} AS delta_type, {conf}e0 AS confidence, {sev} AS severity,
  {text} AS summary, {s} AS source, {t} AS target, {protocols} AS protocols, {pers} AS persistence, {pd} AS persistence_delta, {flows} AS flows, {added} AS new_protocols, {gone} AS removed_protocols FROM {pair} WHERE {test}"""
    name = "'Relationship ' || source || '->' || target"
    return " UNION ALL ".join([
        row("CASE WHEN dir IN ('inbound', 'outbound') THEN 'external_relationship_emergence' ELSE 'new_relationship' END", "0.8", "'informational'",
            f"CASE WHEN dir IN ('inbound', 'outbound') THEN 'External relationship ' || source || '->' || target || ' emerged with direction ' || dir || '.' ELSE 'New relationship ' || source || '->' || target || ' appears with protocols ' || {listing('cprot')} || '.' END", "no_prev"),
        row("'persistence_increase'", "0.8", "'medium'", f"{name} || ' persistence increased by ' || {pyf('pd')} || '.'", "both_ AND pd >= 0.2e0", pd="pd", flows="cflows"),
        row("'protocol_evolution'", "0.7", "'informational'", f"{name} || ' protocol set changed: added ' || {listing('added')} || ', removed ' || {listing('gone')} || '.'", "both_ AND len(added) + len(gone) > 0", protocols="NULL", pers="NULL", added="added", gone="gone", ends=False),
        row("'removed_relationship'", "0.7", "'informational'", f"{name} || ' no longer appears in the current snapshot.'", "no_cur", protocols="pprot", pers="NULL"),
    ])


def _edge_pair(cur: str, prev: str) -> str:
    return f"""SELECT *, {direction('sc', 'tc')} AS dir, list_sort(list_filter(cprot, lambda x: NOT list_contains(pprot, x))) AS added, list_sort(list_filter(pprot, lambda x: NOT list_contains(cprot, x))) AS gone
 FROM (SELECT 'cap0' AS capture_id, coalesce(c.edge_id, p.edge_id) AS edge_id, coalesce(c.source, p.source) AS source, coalesce(c.target, p.target) AS target, c.edge_id IS NULL AS no_cur, p.edge_id IS NULL AS no_prev,
  c.edge_id IS NOT NULL AND p.edge_id IS NOT NULL AS both_, {r('c.persistence - p.persistence', 4)} AS pd, c.persistence AS cpers, c.flows AS cflows, c.protocols AS cprot, p.protocols AS pprot,
  {ipclass('coalesce(c.source, p.source)')} AS sc, {ipclass('coalesce(c.target, p.target)')} AS tc FROM {cur} c FULL JOIN {prev} p ON c.edge_id = p.edge_id)"""


cte("w_edge_pair", _edge_pair("relationships_cur", "relationships_prev"))
cte("w_relationship_deltas", _rel("w_edge_pair"))
cte("edge_pair", _edge_pair("relationships", "(SELECT * FROM relationships WHERE false)"))
cte("relationship_deltas", _rel("edge_pair"))

_FC = "capture_id, hypothesis_id, hypothesis_type, title, summary, impacted_entities, supporting_evidence, contradictory_evidence, confidence_explanation, confidence, severity, finding_tier, consumer, destination, consumer_count, rarity_score, exclusivity_score"


def _tier(c: str) -> str:
    return f"CASE WHEN {c} >= 85 THEN 'PRIMARY' WHEN {c} >= 70 THEN 'SECONDARY' ELSE 'SUPPORTING' END"


def _w(terms: str) -> str:
    return r(f"({terms}) / 1e0 * 1e2", 2)


_HOSTCHG = "delta_type IN ('host_behavior_change', 'risk_increase', 'risk_decrease')"
cte("w_port_scan", f"""
SELECT capture_id, 'port_scan:' || delta_id AS hypothesis_id, 'port_scan' AS hypothesis_type, 'Port Scan' AS title, 'Host ' || entity_id || ' exhibits port scan indicators based on newly observed relationships and port expansion.' AS summary,
 [entity_id] AS impacted_entities, ['new_relationships=' || new_relationship_count, 'ports_added=' || unique_ports_delta] AS supporting_evidence, cast([] AS varchar[]) AS contradictory_evidence,
 'Port scan confidence based on ' || new_relationship_count || ' new relationships and ' || unique_ports_delta || ' new ports.' AS confidence_explanation, conf AS confidence, 'medium' AS severity, {_tier('conf')} AS finding_tier,
 cast(NULL AS varchar) AS consumer, cast(NULL AS varchar) AS destination, cast(NULL AS bigint) AS consumer_count, cast(NULL AS double) AS rarity_score, cast(NULL AS double) AS exclusivity_score
FROM (SELECT *, {_w('least(new_relationship_count / 10, 1e0) * 0.45e0 + least(unique_ports_delta / 10, 1e0) * 0.25e0 + low_persistence_ratio * 0.2e0')} AS conf FROM w_host_deltas
 WHERE {_HOSTCHG} AND new_relationship_count >= 5 AND unique_ports_delta >= 4)""")
cte("w_host_sweep", f"""
SELECT capture_id, 'host_sweep:' || delta_id AS hypothesis_id, 'host_sweep' AS hypothesis_type, 'Host Sweep' AS title, 'Host ' || entity_id || ' exhibits host sweep indicators with many new peer relationships.' AS summary,
 [entity_id] AS impacted_entities, ['new_peers=' || new_peer_count, 'external_hosts=' || external_host_delta] AS supporting_evidence, cast([] AS varchar[]) AS contradictory_evidence,
 'Host sweep confidence based on ' || new_peer_count || ' new peer connections across ' || external_host_delta || ' external hosts.' AS confidence_explanation, conf AS confidence, 'medium' AS severity, {_tier('conf')} AS finding_tier,
 cast(NULL AS varchar) AS consumer, cast(NULL AS varchar) AS destination, cast(NULL AS bigint) AS consumer_count, cast(NULL AS double) AS rarity_score, cast(NULL AS double) AS exclusivity_score
FROM (SELECT *, {_w('least(new_peer_count / 10, 1e0) * 0.4e0 + least(external_host_delta / 5, 1e0) * 0.25e0 + same_port_peer_count * 0.2e0')} AS conf FROM w_host_deltas
 WHERE {_HOSTCHG} AND new_peer_count >= 4 AND external_host_delta >= 2)""")

_ORIENT = f"""CASE WHEN {private('target')} AND NOT {private('source')} THEN target ELSE source END AS consumer, CASE WHEN {private('target')} AND NOT {private('source')} THEN source ELSE target END AS destination"""


def _beaconing(deltas: str, profiles: str, pre: str) -> None:
    cte(f"{pre}pairs", f"SELECT *, {_ORIENT} FROM {deltas} WHERE source IS NOT NULL")
    cte(f"{pre}consumers", f"SELECT destination, count(DISTINCT consumer) AS n FROM {pre}pairs WHERE consumer <> destination GROUP BY 1")
    sig = lst(("periodicity", "true"), ("persistence", "true"), ("external_relationship", "true"), ("low_jitter", "persistence >= 0.7e0"), ("low_volume", "coalesce(flows, 1) <= 5"), ("rare_destination", "rar >= 0.5e0"), ("exclusive_destination", "exc >= 0.75e0"))
    con = lst(("infrastructure_role", "infra"), ("shared_destination", "k >= 2"), ("many_internal_consumers", "k >= 8"), ("high_destination_fan_in", "k >= 20"), ("common_cloud_service", cloud("destination")))
    pen = f"(0e0 + CASE WHEN infra THEN 0.25e0 ELSE 0e0 END + CASE WHEN k >= 2 THEN least(0.2e0, k * 0.015e0) ELSE 0e0 END + CASE WHEN k >= 8 THEN 0.15e0 ELSE 0e0 END + CASE WHEN k >= 20 THEN 0.15e0 ELSE 0e0 END + CASE WHEN {cloud('destination')} THEN 0.18e0 ELSE 0e0 END)"
    cte(f"{pre}beaconing", f"""
SELECT capture_id, 'beaconing:' || delta_id AS hypothesis_id, 'beaconing' AS hypothesis_type, 'Beaconing' AS title, 'TLS beaconing: ' || source || ' <-> ' || target AS summary, [source, target] AS impacted_entities,
 sig AS supporting_evidence, con AS contradictory_evidence, 'Confidence ' || printf('%.1f', conf) || '%. Positive: ' || array_to_string(list_transform(list_sort(sig), lambda x: '+ ' || x), ', ') || '. Negative: ' ||
  CASE WHEN len(con) = 0 THEN '- none observed' ELSE array_to_string(list_transform(con, lambda x: '- ' || x), ', ') END || '.' AS confidence_explanation, conf AS confidence,
 CASE WHEN raw >= 0.95e0 THEN 'critical' WHEN raw >= 0.85e0 THEN 'high' WHEN raw >= 0.75e0 THEN 'medium' ELSE 'low' END AS severity, {_tier('conf')} AS finding_tier, consumer, destination, k AS consumer_count, rar AS rarity_score, exc AS exclusivity_score
FROM (SELECT *, {sig} AS sig, {con} AS con, least(0.92e0, {_w('persistence * 0.35e0 + persistence * 0.35e0 + 0.2e0')} / 1e2 + (rar * 0.14e0 + exc * 0.16e0)) - {pen} AS raw, {r('raw * 1e2', 1)} AS conf
 FROM (SELECT *, CASE WHEN k <= 0 THEN 0e0 ELSE {r('1e0 / k', 4)} END AS rar, CASE WHEN k <= 0 THEN 0e0 WHEN k = 1 THEN 1e0 ELSE {r('greatest(0e0, 1e0 - (k - 1) / 12e0)', 4)} END AS exc
  FROM (SELECT p.*, coalesce(n, 0) AS k, coalesce(h.role IN ('INFRASTRUCTURE', 'DOMAIN_CONTROLLER'), false) AS infra FROM {pre}pairs p LEFT JOIN {pre}consumers c ON c.destination = p.destination LEFT JOIN {profiles} h ON h.ip_address = p.target
   WHERE delta_type = 'external_relationship_emergence' AND list_has_any(p.protocols, ['https', 'tls']) AND p.persistence >= 0.55e0)) ) WHERE raw >= 0.6e0""")
    cte(f"{pre}persistent_tls", f"""
SELECT capture_id, 'persistent_tls:' || delta_id AS hypothesis_id, 'persistent_tls' AS hypothesis_type, 'Persistent TLS' AS title, 'Relationship ' || source || '->' || target || ' shows persistent TLS behavior.' AS summary,
 [source, target] AS impacted_entities, ['https_persistence=' || pct] AS supporting_evidence, cast([] AS varchar[]) AS contradictory_evidence, 'Persistent TLS confidence based on ' || pct || ' persistence ratio.' AS confidence_explanation,
 conf AS confidence, 'high' AS severity, {_tier('conf')} AS finding_tier, consumer, destination, cast(NULL AS bigint) AS consumer_count, cast(NULL AS double) AS rarity_score, cast(NULL AS double) AS exclusivity_score
FROM (SELECT *, printf('%.1f', {r('persistence * 100', 1)}) || '%' AS pct, {_w('least(persistence, 1e0) * 0.45e0 + (CASE WHEN consumer <> destination THEN 1e0 ELSE 0.5e0 END) * 0.35e0')} AS conf FROM {pre}pairs
 WHERE delta_type = 'persistence_increase' AND list_has_any(protocols, ['https', 'tls']))""")


_beaconing("relationship_deltas", "host_profiles", "")
_beaconing("w_relationship_deltas", "host_profiles_cur", "w_")


def _rank(pre: str, sources: list[str], profiles: str, end: str) -> None:
    cte(f"{pre}found", " UNION ALL BY NAME ".join(f"SELECT {_FC} FROM {s}" for s in sources))
    cte(f"{pre}deduped", f"""
SELECT * EXCLUDE (i) FROM (SELECT *, row_number() OVER (PARTITION BY CASE WHEN hypothesis_type = 'beaconing' THEN list_sort(impacted_entities) ELSE [hypothesis_id] END
 ORDER BY impacted_entities[1], impacted_entities[2]) AS i FROM {pre}found WHERE confidence >= 60) WHERE i = 1""")
    cte(f"{pre}limited", f"""
SELECT * FROM {pre}deduped WHERE hypothesis_type = 'beaconing' OR hypothesis_id IN (SELECT hypothesis_id FROM (SELECT hypothesis_id, row_number() OVER (PARTITION BY e ORDER BY confidence DESC, severity <> 'critical',
 impacted_entities[1], impacted_entities[2], hypothesis_id) AS i FROM (SELECT *, unnest(impacted_entities) AS e FROM {pre}deduped WHERE hypothesis_type <> 'beaconing')) WHERE i <= 3)""")
    cte(f"{pre}hosted", f"""
SELECT l.*, coalesce(consumer, (SELECT arg_max(ip_address, (risk_score, -list_position(l.impacted_entities, ip_address))) FROM {profiles} WHERE list_contains(l.impacted_entities, ip_address)), impacted_entities[1]) AS host FROM {pre}limited l""")
    cte(f"{pre}hypotheses", f"""
SELECT * FROM (SELECT *, row_number() OVER (ORDER BY priority_score DESC, confidence DESC, hypothesis_type <> 'beaconing', impacted_entities[1], impacted_entities[2], hypothesis_id) AS place,
 CASE WHEN priority_score >= 90 THEN 'CRITICAL' WHEN priority_score >= 75 THEN 'HIGH' WHEN priority_score >= 60 THEN 'MEDIUM' WHEN priority_score >= 40 THEN 'LOW' ELSE 'INFORMATIONAL' END AS priority_level, ({end}) AS created_us
 FROM (SELECT *, {r('host_risk * 0.35e0 + confidence * 0.35e0 + asset_criticality_score * 0.3e0', 2)} AS priority_score FROM (
  SELECT t.*, coalesce(h.risk_score, 0e0) AS host_risk, coalesce(h.role, 'UNKNOWN') AS host_role, h.role_confidence, h.external_unique_hosts, h.internal_unique_hosts, h.protocols[1:5] AS top_protocols,
  CASE WHEN NOT {private('host')} THEN 20e0 WHEN h.role = 'DOMAIN_CONTROLLER' THEN 100e0 WHEN h.role = 'INFRASTRUCTURE' THEN 80e0 WHEN h.role = 'SERVER' THEN 70e0 WHEN h.role = 'WORKSTATION' THEN 50e0 WHEN h.role = 'EXTERNAL_SERVICE' THEN 20e0 ELSE 40e0 END AS asset_criticality_score
  FROM {pre}hosted t LEFT JOIN {profiles} h ON h.ip_address = t.host))) WHERE place <= 10""")
    cte(f"{pre}host_summaries", f"""
SELECT capture_id, host, arg_min(host_risk, place) AS host_risk, arg_min(host_role, place) AS host_role, arg_min(role_confidence, place) AS role_confidence, arg_min(external_unique_hosts, place) AS external_unique_hosts,
 arg_min(internal_unique_hosts, place) AS internal_unique_hosts, arg_min(top_protocols, place) AS top_protocols, arg_min(asset_criticality_score, place) AS asset_criticality_score, count(*) AS hypothesis_count,
 max(confidence) AS highest_confidence, max(priority_score) AS priority_score, min(place) AS first_place, list(hypothesis_id ORDER BY place) AS finding_ids FROM {pre}hypotheses GROUP BY ALL""")
    cte(f"{pre}candidates", f"""
SELECT *, CASE WHEN list_has_all(rationale, ['rare_destination', 'exclusive_destination']) THEN 'Host exhibits persistent low-volume communication with rare and exclusive external destination ' || coalesce(first_dest, '') || '.'
  WHEN list_has_all(rationale, ['persistence', 'periodicity']) THEN 'Host exhibits persistent communication with periodic timing behavior.' ELSE 'Host has prioritized findings based on risk, confidence, and asset criticality.' END AS candidate_rationale,
 {r('risk * 0.35e0', 2)} AS risk_contribution, {r('confidence * 0.35e0', 2)} AS confidence_contribution, {r('asset_criticality_score * 0.3e0', 2)} AS criticality_contribution
FROM (SELECT s.*, s.host_risk AS risk, s.highest_confidence AS confidence, s.external_unique_hosts AS external_relationships, s.internal_unique_hosts AS internal_relationships, f.supporting_evidence AS rationale, f.destination AS first_dest,
  CASE WHEN s.priority_score >= 90 THEN 'CRITICAL' WHEN s.priority_score >= 75 THEN 'HIGH' WHEN s.priority_score >= 60 THEN 'MEDIUM' WHEN s.priority_score >= 40 THEN 'LOW' ELSE 'INFORMATIONAL' END AS priority,
  CASE s.host_role WHEN 'DOMAIN_CONTROLLER' THEN 'Domain Controller' WHEN 'INFRASTRUCTURE' THEN 'Infrastructure' WHEN 'SERVER' THEN 'Server' WHEN 'WORKSTATION' THEN 'Workstation' WHEN 'EXTERNAL_SERVICE' THEN 'External Service' ELSE 'Unknown' END AS host_role_display,
  row_number() OVER (ORDER BY s.priority_score DESC, s.highest_confidence DESC, s.first_place) AS place, ['inspect endpoint', 'review EDR telemetry', 'check destination reputation', 'examine process activity'] AS recommended_actions
 FROM {pre}host_summaries s JOIN {pre}hypotheses f ON f.place = s.first_place) WHERE place <= 3""")


_rank("", ["beaconing", "persistent_tls"], "host_profiles", "SELECT max(us) FROM raw_packets")
_rank("w_", ["w_port_scan", "w_host_sweep", "w_beaconing", "w_persistent_tls"], "host_profiles_cur", "SELECT max(us) FROM raw_packets_cur")
cte("w_confident", "SELECT * FROM w_found WHERE confidence >= 60")
