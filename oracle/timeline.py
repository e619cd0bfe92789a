"""Narratives, timeline, replay."""

from netloom.operators import narratives as txt
from netloom.operators import timeline as tlx
from oracle import constants as known
from oracle.base import cte, evsev, iso, r

q = "'"


def lit(s: str) -> str:
    return q + s.replace("'", "''") + q


def case(col: str, table: dict, default: str = "NULL") -> str:
    return f"CASE {col} " + " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in table.items()) + f" ELSE {default} END"


def arr(items) -> str:
    return "[" + ", ".join(lit(i) for i in items) + "]"


def dedupe(x: str) -> str:
    return f"list_filter({x}, lambda v, i: list_position({x}, v) = i)"


def join_and(x: str, empty: str = "") -> str:
    return f"(CASE len({x}) WHEN 0 THEN {lit(empty)} WHEN 1 THEN {x}[1] WHEN 2 THEN {x}[1] || ' and ' || {x}[2] ELSE array_to_string({x}[1:len({x})-1], ', ') || ', and ' || {x}[len({x})] END)"


def drivers(level: str) -> str:
    items = ", ".join(f"CASE WHEN list_contains(supporting, {lit(e)}) THEN {lit(label)} END" for e, label in txt.DRIVERS[level].items())
    return f"list_filter([{items}], lambda x: x IS NOT NULL)"


def by_type(table: dict) -> str:
    parts = " ".join(f"WHEN {lit(k)} THEN {arr(v)}" for k, v in table.items())
    return f"flatten(list_transform(types, lambda t: CASE t {parts} END))"


SCAN = "list_has_any(types, ['port_scan', 'host_sweep'])"
cte("narr0", f"""
SELECT *, {dedupe('ph0')} AS phrases, {dedupe('ag0')} AS against, {drivers('high')} AS drivers_high, {drivers('medium')} AS drivers_medium, {drivers('low')} AS drivers_low,
 {by_type(txt.ACTIONS)} AS acts, {by_type(txt.PLANS)} AS plans
FROM (SELECT c.*, p.supporting_evidence AS supporting, p.contradictory_evidence AS contradictory, p.hypothesis_type AS primary_type, p.hypothesis_id AS primary_id, p.destination,
  t.types, t.ids AS supporting_hypotheses, e.environment_rank, e.environment_size,
  list_transform(p.supporting_evidence, lambda x: {case('x', txt.EVIDENCE_PHRASES, "replace(x, '_', ' ')")}) AS ph0,
  list_transform(p.contradictory_evidence, lambda x: {case('x', txt.EVIDENCE_PHRASES, "replace(x, '_', ' ')")}) AS ag0
 FROM candidates c
 JOIN (SELECT *, row_number() OVER (PARTITION BY host ORDER BY finding_tier <> 'PRIMARY', confidence DESC, place) AS i FROM hypotheses) p ON p.host = c.host AND p.i = 1
 JOIN (SELECT host, list(hypothesis_type ORDER BY place) AS types, list(hypothesis_id ORDER BY place) AS ids FROM hypotheses GROUP BY 1) t ON t.host = c.host
 LEFT JOIN (SELECT ip_address, row_number() OVER (ORDER BY risk_score DESC, ip_address) AS environment_rank, count(*) OVER () AS environment_size FROM scored_nodes) e ON e.ip_address = c.host)""")


def _part(level: str, lead: str) -> str:
    return f"CASE WHEN len(drivers_{level}) > 0 THEN {lit(lead)} || {join_and('drivers_' + level)} || '.' ELSE '' END"


_REAS = f"list_filter(list_transform(supporting, lambda x: {case('x', txt.REASONS)}), lambda x: x IS NOT NULL)"
cte("narratives", f"""
SELECT capture_id, host, priority, confidence, risk, environment_rank, environment_size, supporting, contradictory, primary_type, primary_id, destination, types, supporting_hypotheses, drivers_high, drivers_medium, drivers_low,
 {lit(txt.SELECTION_REASON)} AS selection_reason,
 'Host ' || host || ' established persistent low-volume communication' || CASE WHEN coalesce(destination, '') <> '' THEN ' with external destination ' || destination ELSE ' with an external destination' END || '. The behavior is unusual compared to other observed relationships and was prioritized for analyst investigation.' AS executive_summary,
 CASE WHEN len(phrases) > 0 THEN 'The host demonstrated ' || {join_and('phrases')} || '.' ELSE 'Observed behavior was prioritized based on the correlated investigation findings.' END AS behavioral_summary,
 'Supporting evidence includes ' || {join_and('phrases', 'no notable evidence')} || CASE WHEN len(against) = 0 THEN '. No contradictory evidence was observed for the primary finding.' ELSE '. Contradictory context includes ' || {join_and('against')} || '.' END AS evidence_summary,
 array_to_string(list_concat({dedupe(_REAS)}, CASE WHEN primary_type = 'beaconing' THEN ['Together, these characteristics are commonly associated with beaconing behavior.'] ELSE [] END), ' ') AS investigation_reasoning,
 array_to_string(list_filter([CASE WHEN list_contains(types, 'beaconing') THEN 'Observed activity is consistent with command-and-control beaconing.' END, CASE WHEN list_contains(types, 'persistent_tls') THEN 'Observed behavior indicates persistent encrypted communication.' END,
   CASE WHEN {SCAN} THEN 'Observed behavior suggests reconnaissance activity.' END, CASE WHEN list_has_any(supporting, ['persistence', 'periodicity', 'exclusive_destination']) THEN 'The behavior exhibits persistence, timing regularity, and destination exclusivity.' END,
   'Additional endpoint investigation is recommended before concluding malicious activity.'], lambda x: x IS NOT NULL), ' ') AS assessment,
 list_filter([CASE WHEN NOT {SCAN} THEN 'No Layer 5 reconnaissance hypothesis was generated for this host during the capture.' END,
   CASE WHEN NOT list_contains(types, 'persistent_tls') THEN 'No separate persistent encrypted-channel hypothesis was generated beyond the observed beaconing behavior.' END], lambda x: x IS NOT NULL) AS negative_findings,
 'Overall confidence is elevated because multiple independent behavioral indicators support the same hypothesis.' || {_part('high', ' The strongest drivers are ')} || {_part('medium', ' Additional support comes from ')} || {_part('low', ' Lower-impact context includes ')} AS confidence_explanation,
 {dedupe('acts')} AS recommended_actions, ({dedupe('plans')})[1:5] AS investigation_plan, 100e0 AS narrative_quality_score
FROM narr0""")

_EV = "capture_id, us, 'evt_' || substr(md5(us || '|' || event_type || '|' || host || '|' || array_to_string(related_hosts, ',') || '|' || mark), 1, 12) AS event_id, event_type, severity, host, related_hosts, description, {f} AS flow_id, {e} AS edge_id, {h} AS hypothesis_id, {ht} AS hypothesis_type"


def ev(src: str, f="NULL", e="NULL", h="NULL", ht="NULL") -> str:
    return "SELECT " + _EV.format(f=f, e=e, h=h, ht=ht) + f" FROM ({src})"


def label(x: str) -> str:
    return f"CASE WHEN upper({x}) IN ('CRITICAL', 'HIGH', 'MEDIUM', 'LOW') THEN upper({x}) ELSE 'INFO' END"


cte("network_events", ev(f"""SELECT *, first_us AS us, CASE WHEN application_protocol = 'dns' THEN 'dns_query' WHEN application_protocol = 'http' THEN 'http_session' WHEN application_protocol = 'https' OR coalesce(responder_port, 0) = 443 THEN 'tls_established' ELSE 'connection_created' END AS event_type,
 {evsev('behavioral_score')} AS severity_, initiator_ip AS host, [responder_ip] AS related_hosts, upper(application_protocol) || ' relationship observed between ' || initiator_ip || ' and ' || responder_ip AS description, flow_id AS mark
 FROM (SELECT * FROM enriched_flows ORDER BY behavioral_score DESC, packet_count DESC, first_us, first_seen_sequence LIMIT 300)""", f="flow_id").replace("event_type, severity,", "event_type, severity_ AS severity,"))
cte("host_events", ev(f"""SELECT capture_id, first_us AS us, 'host_role_assigned' AS event_type, {evsev('risk_score')} AS severity, ip_address AS host, cast([] AS varchar[]) AS related_hosts, ip_address || ' classified as ' || role AS description, role AS mark FROM scored_nodes
 UNION ALL SELECT capture_id, first_us, 'community_assigned', 'INFO', ip_address, [], ip_address || ' assigned to ' || community_type, community_type FROM scored_nodes"""))
cte("relationship_events", ev(f"""SELECT * EXCLUDE (severity), first_us AS us, CASE WHEN persistence >= 0.5e0 THEN 'relationship_persistent' ELSE 'relationship_created' END AS event_type, {evsev('relationship_risk')} AS severity, source AS host, [target] AS related_hosts,
 'Relationship observed between ' || source || ' and ' || target AS description, edge_id AS mark FROM (SELECT * FROM relationships ORDER BY relationship_risk DESC, packet_count DESC, total_bytes DESC, source, target LIMIT 300)""", e="edge_id"))
cte("timed", """SELECT h.*, coalesce(f.last_us, b.last_us, created_us) AS us, coalesce(list_filter(impacted_entities, lambda x: x LIKE '10.%' OR x LIKE '172.%' OR x LIKE '192.168.%')[1], impacted_entities[1]) AS primary_host
 FROM hypotheses h LEFT JOIN relationships f ON f.source = h.consumer AND f.target = h.destination LEFT JOIN relationships b ON b.source = h.destination AND b.target = h.consumer""")
cte("hypothesis_events", ev(f"""SELECT capture_id, us, 'hypothesis_created' AS event_type, {label('severity')} AS severity, primary_host AS host, list_filter(impacted_entities, lambda x: x <> primary_host) AS related_hosts, summary AS description, hypothesis_id AS mark, hypothesis_id, hypothesis_type AS ht FROM timed
 UNION ALL SELECT capture_id, us, 'beaconing_started', {evsev('confidence')}, primary_host, list_filter(impacted_entities, lambda x: x <> primary_host), confidence_explanation, hypothesis_id, hypothesis_id, NULL FROM timed WHERE hypothesis_type = 'beaconing'""", h="hypothesis_id", ht="ht"))
_T = "(SELECT host AS th, max(us) AS us FROM timed GROUP BY 1)"
cte("candidate_events", ev(f"SELECT capture_id, us, 'candidate_created' AS event_type, {label('priority')} AS severity, host, cast([] AS varchar[]) AS related_hosts, candidate_rationale AS description, '' AS mark FROM candidates JOIN {_T} ON th = host").replace(" || '|' || mark", ""))
cte("narrative_events", ev(f"SELECT capture_id, us, 'narrative_generated' AS event_type, {label('priority')} AS severity, host, cast([] AS varchar[]) AS related_hosts, executive_summary AS description, '' AS mark FROM narratives JOIN {_T} ON th = host").replace(" || '|' || mark", ""))
cte("timeline_events", " UNION ALL ".join(f"SELECT * FROM {x}_events" for x in ("network", "host", "relationship", "hypothesis", "candidate", "narrative")))
cte("correlated", """SELECT * EXCLUDE (i) FROM (SELECT *, row_number() OVER (PARTITION BY event_type, host, list_sort(related_hosts), coalesce(flow_id, edge_id, hypothesis_id, '') ORDER BY us, event_id) AS i FROM timeline_events) WHERE i = 1""")
cte("indexed_events", f"""SELECT *, sum(CASE WHEN phase_name <> p THEN 1 ELSE 0 END) OVER (ORDER BY us, event_id) AS run FROM (SELECT *, lag(phase_name) OVER (ORDER BY us, event_id) AS p FROM (
 SELECT *, row_number() OVER (ORDER BY us, event_id) - 1 AS event_index, {case('event_type', known.PHASES, "'Unknown'")} AS phase_name, CASE WHEN event_type = 'hypothesis_created' AND hypothesis_type = 'beaconing' THEN 'BEACONING_DEVELOPMENT' ELSE {case('event_type', known.CHAPTER_OF_EVENT, "'UNKNOWN'")} END AS chapter_type,
  CASE severity WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 1 ELSE 0 END AS rank FROM correlated))""")
cte("activity_phases", f"""SELECT *, 'phase_' || substr(md5(phase_name || '|' || {iso('start_us')} || '|' || {iso('end_us')} || '|' || event_count), 1, 10) AS phase_id,
 phase_name || ' phase containing ' || event_count || ' correlated events: ' || array_to_string(event_types[1:5], ', ') AS description
FROM (SELECT capture_id, cast(run AS bigint) AS run, any_value(phase_name) AS phase_name, min(us) AS start_us, max(us) AS end_us, count(*) AS event_count, list_sort(list(DISTINCT event_type)) AS event_types FROM indexed_events GROUP BY ALL)""")
cte("chapter_bounds", "SELECT capture_id, chapter_type, min(us) AS start_us, max(us) AS end_us, count(*) AS event_count, max(rank) AS rank FROM indexed_events GROUP BY ALL")
cte("chapter_phase_overlap", "SELECT b.chapter_type, p.phase_id FROM chapter_bounds b JOIN activity_phases p ON p.start_us <= b.end_us AND p.end_us >= b.start_us")
cte("chapter_hosts", "SELECT DISTINCT chapter_type, host FROM indexed_events WHERE host <> ''")
_IMP = "CASE chapter_type " + " ".join(f"WHEN '{k}' THEN {v[1]}" for k, v in known.CHAPTERS.items()) + " END"
_ORD = "list_position([" + ", ".join(f"'{k}'" for k in known.CHAPTERS) + "], chapter_type)"
cte("chapters", f"""SELECT * EXCLUDE (start_us, end_us), CASE WHEN chapter_number = 1 THEN t0 ELSE start_us END AS start_us, CASE WHEN chapter_number = k THEN t1 ELSE end_us END AS end_us,
 {r('((CASE WHEN chapter_number = k THEN t1 ELSE end_us END) - (CASE WHEN chapter_number = 1 THEN t0 ELSE start_us END)) / 1e6', 4)} AS duration_seconds
FROM (SELECT *, row_number() OVER (ORDER BY start_us, {_ORD}) AS chapter_number, count(*) OVER () AS k, min(start_us) OVER () AS t0, max(end_us) OVER () AS t1,
  'chapter_' || substr(md5(chapter_type || '|' || {iso('start_us')} || '|' || {iso('end_us')}), 1, 10) AS chapter_id, {case('chapter_type', {k: v[0] for k, v in known.CHAPTERS.items()})} AS title,
  CASE chapter_type WHEN 'INITIAL_ACTIVITY' THEN 'The replay establishes the initial host and community context across ' || host_count || ' observed hosts.' WHEN 'EXTERNAL_COMMUNICATION' THEN 'External application sessions appear in the timeline, including ' || array_to_string(key_events[1:3], ', ') || '.'
   ELSE {case('chapter_type', tlx.CHAPTER_TEXTS, "'Timeline activity did not match a known chapter category.'")} END AS description,
  ['INFO', 'LOW', 'MEDIUM', 'HIGH', 'CRITICAL'][rank + 1] AS severity, {r(f'least({_IMP} + rank * 2 + least(event_count / 25, 8e0), 100e0)', 1)} AS importance
 FROM (SELECT b.*, (SELECT count(DISTINCT phase_id) FROM chapter_phase_overlap o WHERE o.chapter_type = b.chapter_type) AS phase_count, (SELECT count(*) FROM chapter_hosts h WHERE h.chapter_type = b.chapter_type) AS host_count,
   (SELECT list(event_type ORDER BY s DESC, n DESC, event_type DESC)[1:6] FROM (SELECT event_type, max(rank) AS s, count(*) AS n FROM indexed_events e WHERE e.chapter_type = b.chapter_type GROUP BY 1)) AS key_events FROM chapter_bounds b))""")
cte("host_timeline_events", "SELECT *, row_number() OVER (PARTITION BY host ORDER BY event_index) AS place FROM indexed_events WHERE host <> ''")
cte("host_timeline_chapters", "SELECT h.host, c.*, row_number() OVER (PARTITION BY h.host ORDER BY chapter_number) AS place FROM chapter_hosts h JOIN chapters c USING (chapter_type)")
cte("host_timelines", """SELECT e.host, count(*) AS event_count, list(event_id ORDER BY event_index) AS events, any_value(c.chapters) AS chapters FROM indexed_events e
 JOIN (SELECT host, list(chapter_id ORDER BY chapter_number) AS chapters FROM chapter_hosts JOIN chapters USING (chapter_type) GROUP BY 1) c ON c.host = e.host WHERE e.host <> '' GROUP BY 1""")

_IMPT = "(event_type IN ('beaconing_started', 'hypothesis_created', 'hypothesis_promoted', 'candidate_created', 'candidate_priority_changed', 'narrative_generated', 'host_risk_increased') OR severity IN ('HIGH', 'CRITICAL'))"
cte("frames0", f"""SELECT *, row_number() OVER (ORDER BY us, event_id) AS frame_number FROM (SELECT *, count(*) OVER () AS n, greatest(500 - count(*) FILTER ({_IMPT}) OVER (), 0) AS room FROM indexed_events)
 WHERE n <= 500 OR {_IMPT} OR (event_index % greatest(n // greatest(room, 1), 1) = 0 AND event_index // greatest(n // greatest(room, 1), 1) < room)""")
cte("frames", """SELECT f.capture_id, f.frame_number, printf('frame_%05d', f.frame_number) AS frame_id, f.us, f.event_id AS trigger_event_id, f.event_type AS trigger_event_type, f.frame_number = max(f.frame_number) OVER () AS final,
 CASE WHEN final THEN s.node_count ELSE (SELECT count(*) FROM scored_nodes x WHERE x.first_us <= f.us) END AS node_count, CASE WHEN final THEN s.edge_count ELSE (SELECT count(*) FROM graph_edges x WHERE x.first_us <= f.us) END AS edge_count,
 CASE WHEN final THEN (SELECT count(*) FROM indexed_events) ELSE (SELECT count(*) FROM indexed_events x WHERE x.us <= f.us) END AS events_upto,
 CASE WHEN final THEN (SELECT count(*) FROM candidates) ELSE (SELECT count(*) FROM candidates c JOIN hypotheses h ON h.place = c.first_place WHERE h.created_us <= f.us) END AS candidate_count, s.graph_density, s.graph_risk_score, s.isolated_node_count
FROM frames0 f, graph_metrics s""")
cte("frame_recent", "SELECT f.frame_number, e.event_index, e.event_id FROM frames f JOIN indexed_events e ON e.event_index < f.events_upto AND e.event_index >= f.events_upto - 25")
cte("frame_deltas", """SELECT frame_number, frame_id, us, node_count - coalesce(lag(node_count) OVER w, 0) AS added_nodes, edge_count - coalesce(lag(edge_count) OVER w, 0) AS added_edges, 0::bigint AS removed_nodes, 0::bigint AS removed_edges,
 coalesce(greatest(lead(us) OVER w - us, 0) / 1e6, 0e0) AS frame_duration FROM frames WINDOW w AS (ORDER BY frame_number)""")
cte("replay_coverage", f"""SELECT 'cap0' AS capture_id, {r('least((f.node_count / s.node_count + f.edge_count / s.edge_count) / 2, 1e0) * 100', 2)} AS replay_coverage,
 {r('(SELECT count(*) FROM indexed_events) / (SELECT count(*) FROM packets)', 4)} AS event_compression_ratio FROM frames f, graph_metrics s WHERE final""")
cte("seek", """SELECT *, (SELECT any_value(us) FROM frames f WHERE f.frame_number = q.frame_number) AS frame_us FROM (SELECT t.ip_address, t.first_us AS target_us, (SELECT arg_min(frame_number, (abs(f.us - t.first_us), f.us, CASE WHEN f.us < t.first_us THEN -f.frame_number ELSE f.frame_number END)) FROM frames f) AS frame_number FROM scored_nodes t) q""")
cte("chapter_jump", """SELECT *, (SELECT any_value(us) FROM frames f WHERE f.frame_number = q.frame_number) AS frame_us FROM (SELECT t.chapter_id, t.start_us AS target_us, (SELECT arg_min(frame_number, (abs(f.us - t.start_us), f.us, CASE WHEN f.us < t.start_us THEN -f.frame_number ELSE f.frame_number END)) FROM frames f) AS frame_number FROM chapters t) q""")
cte("chapter_merge", "SELECT * FROM chapters")
cte("frame_selection", "SELECT * FROM frames0")
