"""Operators on small tables: hot paths, invariants, artifacts, joins in time."""

import gzip
import random
import statistics
import zlib
from itertools import pairwise

import pytest
from pyspark.sql import functions as F

from netloom.operators import catalog as ca
from netloom.operators import findings as fi
from netloom.operators import flows as fl
from netloom.operators import graph as gr
from netloom.operators import hosts as hs
from netloom.operators import narratives as na
from netloom.operators import packets as pk
from netloom.operators import replay as rp
from netloom.operators import snapshots as sn
from netloom.operators import timeline as ti
from netloom.operators.ordered import global_rank, with_chunks
from netloom.plans import queries
from netloom.plans.pipeline import Analysis, shared_folder
from netloom.plans.queries import analysis
from netloom.plans.special import changed_rows
from netloom.session import FIRST_PARTITIONS
from netloom.sources.artifacts import read_artifacts, write_artifacts


@pytest.fixture(scope="module")
def a(spark, data):
    return analysis(spark, data)


def same(x, y):
    return x.exceptAll(y).count() == 0 and y.exceptAll(x).count() == 0


def test_busy_flows_give_the_same_gaps(a):
    plain, split = (fl.inter_packet_delay(a.packets, a.flows, hot) for hot in (10**9, 5))
    assert fl.hot_flows(a.flows, 5).count() > 0 and same(plain, split)


def test_busy_flow_with_equal_times(spark):
    values = [("c", "f", us) for us in [0, 0, 0, 5, 9, 2_000_000, 2_000_000, 7_500_001]]
    packets = spark.createDataFrame(values, "capture_id string, flow_id string, us bigint")
    flows = packets.groupBy("capture_id", "flow_id").agg(F.count("*").alias("packet_count"))
    assert same(fl.inter_packet_delay(packets, flows, 100), fl.inter_packet_delay(packets, flows, 1))


def test_packets_are_kept(a):
    assert a.flows.agg(F.sum("packet_count")).first()[0] == a.packets.count()
    assert a.scored_nodes.where("community_type IS NULL").count() == 0
    assert a.activity_phases.agg(F.sum("event_count")).first()[0] == a.indexed_events.count()


def test_planted_beacons_score(spark):
    assert analysis(spark, "/root/testdata/sf0.01").enriched_flows.where("beacon_score >= 0.9 AND initiator_ip LIKE '10.2.0.%'").count() == 3


def test_partitions_do_not_matter(spark, a):
    one = a.packets.coalesce(1)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        single = fl.build_flows(one)
        assert same(single, a.flows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_chronology(spark):
    def check(times):
        df = spark.createDataFrame([("c", i, t) for i, t in enumerate(times)], "capture_id string, replay_sequence_id bigint, us bigint")
        return pk.chronology_warning(df).first().out_of_order

    assert not check([1, 2, 2, 3]) and check([1, 3, 2])


def test_policy_can_be_replaced(a):
    loud = fl.suppression(a.flows, fl.SuppressionPolicy(noisy_protocols=frozenset({"https"}), noisy_udp_ports=frozenset(), suppressed_directions=frozenset()))
    assert loud.where("application_protocol = 'https' AND NOT suppressed").count() == 0
    assert loud.where("application_protocol = 'nbns' AND suppressed").count() == 0


ROLE_COLUMNS = ["inbound_ratio", "outbound_ratio", "responded_flow_count", "unique_destinations", "internal_unique_hosts", "external_unique_hosts", "persistent_relationships",
                "suspicious_flow_count", "beacon_flow_count", "server_port_overlap"]


@pytest.mark.parametrize("ip_address, protocols, values, want", [
    ("10.0.0.5", ["dns", "kerberos", "ldap", "smb"], {"inbound_ratio": 0.8, "responded_flow_count": 20}, "DOMAIN_CONTROLLER"),
    ("10.0.0.6", ["https", "dns"], {"outbound_ratio": 0.9, "unique_destinations": 5}, "WORKSTATION"),
    ("10.0.0.7", ["rdp"], {"outbound_ratio": 0.36, "unique_destinations": 2}, "WORKSTATION"),
    ("10.0.0.8", ["https", "smb"], {"inbound_ratio": 0.9, "responded_flow_count": 12, "server_port_overlap": 2}, "SERVER"),
    ("10.0.0.255", ["nbns"], {}, "INFRASTRUCTURE"),
    ("8.8.8.8", ["dns"], {"internal_unique_hosts": 3}, "EXTERNAL_SERVICE"),
    ("8.8.4.4", ["dns"], {}, "UNKNOWN"),
])
def test_roles(spark, ip_address, protocols, values, want):
    row = [("c", ip_address, protocols, *[float(values.get(n, 0)) for n in ROLE_COLUMNS])]
    df = spark.createDataFrame(row, "capture_id string, ip_address string, protocols array<string>, " + ", ".join(f"{n} double" for n in ROLE_COLUMNS))
    assert hs.host_role(df).first().role == want


def test_digests_do_not_depend_on_partitions(a):
    digests = [gr.graph_fingerprint(a.scored_nodes.repartition(n), a.graph_edges.repartition(n)).first().graph_fingerprint for n in (1, 3)]
    assert digests[0] == digests[1] and len(digests[0]) == 64


def test_global_degree_is_an_option(a):
    assert gr.behavioral_centrality(a.linked_nodes, global_max=True).count() == a.linked_nodes.count()


def test_windows_agree_with_counting(a):
    n = a.scored_nodes.select("first_us", "last_us")
    w = a.snapshot_windows.select("us", "node_count")
    brute = w.join(n, (F.col("last_us") >= F.col("us") - sn.MARGIN_US) & (F.col("first_us") <= F.col("us") + sn.MARGIN_US)).groupBy("us").agg(F.count("*").alias("node_count"))
    assert same(w, brute)


def test_seek(spark):
    frames = spark.createDataFrame([("c", 1, 0), ("c", 2, 10), ("c", 3, 20)], "capture_id string, frame_number int, us bigint")
    targets = spark.createDataFrame([("c", t) for t in (-5, 5, 6, 11, 20, 99)], "capture_id string, target_us bigint")
    got = {r.target_us: r.frame_number for r in rp.seek_nearest(targets, frames).collect()}
    assert got == {-5: 1, 5: 1, 6: 2, 11: 2, 20: 3, 99: 3}


def test_frames_of_a_short_timeline(spark):
    events = spark.createDataFrame([("c", i, i, f"evt_{i:012x}", "dns_query", "LOW") for i in range(20)], "capture_id string, event_index bigint, us bigint, event_id string, event_type string, severity string")
    assert rp.frame_selection(events).count() == 20
    short = rp.frame_selection(events, limit=5)
    assert [r.event_index for r in short.orderBy("frame_number").collect()] == [0, 4, 8, 12, 16]


def test_chapters_merge(spark):
    schema = "capture_id string, chapter_number int, chapter_id string, chapter_type string, title string, description string, start_us bigint, end_us bigint, event_count bigint, phase_count bigint, key_events array<string>, importance double, severity string"
    rows = [("c", 1, "x", "A", "", "", 0, 5, 2, 1, ["p"], 10.0, "LOW"), ("c", 2, "y", "A", "", "", 6, 9, 3, 1, ["q", "p"], 20.0, "HIGH"), ("c", 3, "z", "B", "", "", 7, 8, 1, 1, ["r"], 5.0, "INFO")]
    got = ti.chapter_merge(spark.createDataFrame(rows, schema)).orderBy("start_us").collect()
    assert [(r.chapter_id, r.event_count, r.end_us, r.key_events, r.severity) for r in got] == [("x", 5, 9, ["p", "q"], "HIGH"), ("z", 1, 8, ["r"], "INFO")]


@pytest.mark.parametrize("fmt", ["csv", "ndjson"])
def test_artifacts(spark, fmt):
    """Texts with quotes, breaks, blanks, backslashes and none, nested values, maps with numbers as keys, extreme numbers; a table without captures, an empty and an absent one."""
    texts = ["", None, " a ", 'say "x", or\nnot\r', "\\N", "\\", "\\\\x", "null", "é日", "[]", "a,b;c|d", "''"]
    schema = "capture_id string, t string, n bigint, d double, b boolean, list array<string>, pairs map<bigint,double>, s struct<a:string,b:array<int>>"
    rows = [(f"c{i % 3}", t, 2**62 + i if i else None, 0.1 + 1e300 * i if i != 1 else None, i % 2 == 0 if i != 2 else None, [t, ""] if i else None, {i: 0.5, -i - 1: 1e-9}, (t, [i, None]) if i % 4 else None) for i, t in enumerate(texts)]
    table = spark.createDataFrame(rows, schema)
    loose = table.drop("capture_id", "pairs")
    folder = f"{shared_folder(spark)}/artifacts-{fmt}-{spark.sparkContext.startTime}"
    write_artifacts({"table": table, "loose": loose, "none": table.where("false")}, folder, fmt)
    back = read_artifacts(spark, folder)
    assert set(back) == {"table", "loose", "none"} and back["table"].schema.simpleString() == table.schema.simpleString()
    text = lambda frame: sorted(r[0] for r in frame.select(F.to_json(F.struct(*sorted(frame.columns)), {"ignoreNullFields": "false"})).collect())
    assert text(back["table"]) == text(table) and text(back["loose"]) == text(loose) and back["none"].count() == 0
    assert read_artifacts(spark, folder, {"absent": table.schema}, fmt)["absent"].count() == 0


def test_lookup_and_search(a):
    assert ca.frame_lookup(a.frames, "frame_00003").first().frame_number == ca.frame_lookup(a.frames, "3").first().frame_number == 3
    host = a.relationships.first().source
    assert ca.relationship_context(a.relationships, a.hypotheses, host).where(f"source <> '{host}' AND target <> '{host}'").count() == 0
    assert ca.event_search(a.indexed_events, latest=7).count() == 7


def test_many_captures_at_once(spark, a):
    """Two copies under different ids give each the result of one."""
    both = a.raw_packets.unionByName(a.raw_packets.withColumn("capture_id", F.lit("cap1")))
    two = Analysis(both)
    one = a.scored_nodes.drop("capture_id")
    for capture in ("cap0", "cap1"):
        assert same(two.scored_nodes.where(F.col("capture_id") == capture).drop("capture_id").select(one.columns), one)


@pytest.mark.parametrize("hot", [1, 10**6])
def test_gaps_of_any_length(spark, hot):
    day = 86_400_000_000
    times = {"a": [0, 1, 2, 200 * day], "b": [0, 5 * 365 * day, 5 * 365 * day + 1], "c": [7, 7, 7], "d": [0, 1]}
    packets = spark.createDataFrame([("c", f, t) for f, ts in times.items() for t in ts], "capture_id string, flow_id string, us bigint")
    flows = packets.groupBy("capture_id", "flow_id").agg(F.count("*").alias("packet_count"))
    got = {r.flow_id: r for r in fl.inter_packet_delay(packets, flows, hot).collect()}
    for f, ts in times.items():
        gaps = [b - a for a, b in pairwise(ts)]
        want = statistics.stdev(gaps) / 1000 if len(gaps) > 1 else 0.0
        assert got[f].inter_arrival_jitter == pytest.approx(want, rel=1e-9, abs=1e-4) and got[f].max_inter_packet_delay_ms == pytest.approx(max(gaps) / 1000, rel=1e-12, abs=1e-4)


def test_seek_among_ten_thousand_frames_and_targets(spark):
    """One capture; frames at equal moments, targets before, between, at and after them; a second capture and one without frames."""
    import bisect

    rng = random.Random(8)
    moments = sorted(rng.randrange(0, 90_000_000) // 1000 * 1000 for _ in range(10_000))
    frames = spark.createDataFrame([("c", i + 1, us) for i, us in enumerate(moments)] + [("d", 1, 5)], "capture_id string, frame_number bigint, us bigint")
    asked = [rng.randrange(-1000, 91_000_000) for _ in range(9_000)] + rng.sample(moments, 1_000)
    targets = spark.createDataFrame([("c", i, us) for i, us in enumerate(asked)] + [("d", 0, 9), ("none", 0, 1), ("c", -1, None)], "capture_id string, name bigint, target_us bigint")
    got = {(r.capture_id, r.name): (r.frame_number, r.frame_us) for r in rp.seek_nearest(targets, frames).collect()}
    assert len(got) == len(asked) + 1 and got.pop(("d", 0)) == (1, 5)
    for (_, name), (number, us) in got.items():
        t = asked[name]
        at = bisect.bisect_left(moments, t)
        near = [i for i in (at - 1, at) if 0 <= i < len(moments)]
        best = min(near, key=lambda i: (abs(moments[i] - t), i))
        assert (number, us) == (best + 1, moments[best])


def test_frame_deltas_follow_the_whole_order(spark):
    frames = spark.range(5000).selectExpr("'c' AS capture_id", "id + 1 AS frame_number", "concat('f', id) AS frame_id", "id div 3 * 1000000 AS us", "id * 2 AS node_count", "id div 2 AS edge_count")
    out = {r.frame_number: r for r in rp.frame_delta(frames).collect()}
    assert len(out) == 5000 and out[1].added_nodes == 0 and out[5000].frame_duration == 0
    assert all(out[i].added_nodes == 2 and out[i].added_edges == (i - 1) // 2 - (i - 2) // 2 for i in range(2, 5001))
    assert all(out[i].frame_duration == i // 3 - (i - 1) // 3 for i in range(1, 5000))


def test_a_resolver_flow_of_many_names(spark):
    """Names beyond the preview are rows, and identities and findings still see all of them."""
    packets = spark.range(30_000).selectExpr(
        "'c' AS capture_id", "if(id % 10 = 0, 'small', 'resolver') AS flow_id", "id AS us",
        "concat('Name', id % 20000, '.example.org/path') AS dns_query", "if(id = 7, 'http://WWW.Microsoft.com', concat('name', id % 20000, '.example.org')) AS http_host", "cast(null AS string) AS tls_sni",
        "if(id % 3 = 1, concat('host', id % 500, '<20>, x'), '') AS nbns_name", "if(id = 8, 'zed', if(id = 9, '', null)) AS kerberos_cname")
    names = fl.flow_names(packets)
    rows = {(r.flow_id, r.kind, r.name): r.packets for r in names.collect()}
    want = {}
    for i in range(30_000):
        shown = {("domain", f"name{i % 20000}.example.org")} | ({("domain", "www.microsoft.com")} if i == 7 else set())
        shown |= {("nbns", f"host{i % 500}")} if i % 3 == 1 else set()
        shown |= {("kerberos", "zed")} if i == 8 else set()
        for kind, name in shown:
            key = ("resolver" if i % 10 else "small", kind, name)
            want[key] = want.get(key, 0) + 1
    assert rows == want
    for preview in (100, 3, None):
        facts = {r.flow_id: r for r in fl.name_facts(names, preview).collect()}
        for flow in ("resolver", "small"):
            mine = {kind: sorted(n for f, k, n in want if (f, k) == (flow, kind)) for kind in fl.NAME_KINDS}
            r = facts[flow]
            assert (r.domain_count, r.nbns_count, r.kerberos_count) == tuple(len(mine[k]) for k in fl.NAME_KINDS)
            assert [r.observed_domains, r.nbns_names, r.kerberos_cnames] == [mine[k][:preview] for k in fl.NAME_KINDS]
            assert r.best_hostname.name == mine["nbns"][0] and r.web_domain == next(n for n in mine["domain"] if "microsoft" not in n)
        assert facts["resolver"].first_user == "zed" and facts["small"].first_user is None


def test_facts_of_hot_keys(spark, a):
    """One destination with half of all flows: as the plain join, and no exchange of flows by a hot key."""
    from netloom.operators.facts import beside
    from netloom.operators.flows import rarity_context, rarity_counts

    flows = a.flows.withColumn("responder_ip", F.when(F.pmod(F.xxhash64("flow_id"), F.lit(2)) == 0, F.lit("10.9.9.9")).otherwise(F.col("responder_ip"))).select("capture_id", "flow_id", "responder_ip", "application_protocol")
    by_destination, by_protocol = rarity_counts(flows)
    want = flows.join(by_destination, ["capture_id", "responder_ip"]).join(by_protocol, ["capture_id", "application_protocol"])
    assert same(rarity_context(flows).select(want.columns), want)
    rows = spark.range(50_000).select(F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 1, None).otherwise(F.concat(F.lit("k"), F.col("id"))).alias("k"), "id")
    facts = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    got = beside(rows, facts, ["k"], "n", 50_000)
    assert same(got.select("k", "id", "n"), rows.join(facts, "k").select("k", "id", "n"))
    assert got.where("k IS NULL").count() == 0 and beside(rows.where("false"), facts.where("false"), ["k"], "n", 0).count() == 0


def test_state_of_few_nodes(a):
    """A capture without edges and one with a single node have a state; scans and exchanges stay few."""

    none = gr.graph_state(a.scored_nodes, a.graph_edges.where("false")).first()
    assert none.edge_count == 0 and none.relationship_risk_part == 0.0 and none.snapshot_id and none.external_dependency_score == 0.0
    first = a.scored_nodes.orderBy("ip_address").limit(1)
    one = gr.graph_state(first, a.graph_edges.where("false")).first()
    assert one.node_count == one.classified_nodes == 1 and one.graph_risk_score == first.first().risk_score
    plan = gr.graph_state(a.scored_nodes, a.graph_edges)._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Scan parquet") <= 7 and plan.count("Exchange hashpartitioning") <= 16


def test_host_rows(a):
    """Places of events of a host by chunks; a host without a profile has the facts of its node."""
    tl = ti

    events = a.indexed_events
    old = tl.EVENTS_AT_ONCE
    tl.EVENTS_AT_ONCE = 3
    try:
        got = [(r.host, r.place, r.event_index) for r in tl.host_timeline_events(events).collect()]
    finally:
        tl.EVENTS_AT_ONCE = old
    by_host = {}
    for r in events.where("host <> ''").orderBy("event_index").collect():
        by_host.setdefault(r.host, []).append(r.event_index)
    assert sorted(got) == sorted((h, i + 1, e) for h, es in by_host.items() for i, e in enumerate(es))
    shown = tl.host_timelines(a.host_timeline_events, a.host_timeline_chapters, 2).collect()
    assert {r.host: r.event_count for r in shown} == {h: len(es) for h, es in by_host.items()} and max(len(r.events) for r in shown) <= 2
    host = next(r.ip_address for r in a.scored_nodes.collect() if r.ip_address in by_host)
    node = a.scored_nodes.where(F.col("ip_address") == host).first()
    row = ca.host_detail(a.host_profiles.where(F.col("ip_address") != host), a.scored_nodes, a.host_timelines).where(F.col("host") == host).first()
    assert (row.risk, row.role, row.hostname, row.mac_address) == (node.risk_score, node.role, node.hostname, None)


def test_search_beyond_a_window(a):
    """Places counted by chunks are those of a window."""
    whole = ca.event_search(a.indexed_events, latest=None)
    few = ca.event_search(a.indexed_events, latest=9)
    assert same(whole.where("recent <= 9").select(few.columns), few)
    assert whole.count() == a.indexed_events.count() and same(ca.event_search(a.indexed_events, latest=5_000).select(few.columns), whole.where("recent <= 5000").select(few.columns))


def test_round_trip_moves_digests(a, spark, tmp_path):
    """Rows are compared by digests, so no text is shuffled; files are bounded, compressed and not ordered by capture."""
    packets = a.artifact("normalized_packets")
    other = packets.where("packet_index <> 0").unionByName(packets.where("packet_index = 0").withColumn("ttl", F.lit(1)))
    counts = changed_rows(packets, other)
    assert counts.schema["row"].dataType.simpleString() == "binary"
    assert sorted(r.n for r in counts.where("n <> 0").collect()) == [-1, 1]
    assert changed_rows(packets.unionByName(packets), packets).agg(F.sum("n")).first()[0] == packets.count()
    write_artifacts({"packets": packets}, f"{tmp_path}/out")
    files = list(tmp_path.glob("out/packets.ndjson/*/part-*"))
    assert files and all(f.name.endswith(".json.gz") for f in files)
    assert same(read_artifacts(spark, f"{tmp_path}/out")["packets"].drop("tcp_flags"), packets.drop("tcp_flags"))


@pytest.mark.parametrize("fmt", ["csv", "ndjson"])
def test_artifacts_are_packed_fast(spark, tmp_path, fmt):
    """Files of artifacts are packed at the fastest level, as packing took most of the time of a written file, and hold the same rows."""
    table = spark.range(20_000).selectExpr("id", "sha2(cast(id % 500 AS string), 256) AS t", "array(concat('10.2.', id % 250), 'tcp') AS list").coalesce(1)
    write_artifacts({"table": table}, f"{tmp_path}/out", fmt)
    (file,) = tmp_path.glob(f"out/table.{fmt}/part-*.gz")
    fast, usual = (len(zlib.compress(gzip.decompress(file.read_bytes()), level)) for level in (1, 6))
    size = file.stat().st_size
    assert usual < fast and abs(size - fast) < abs(size - usual)
    assert same(read_artifacts(spark, f"{tmp_path}/out")["table"], table)


def test_events_are_dealt_evenly(spark, data, tmp_path, monkeypatch):
    """A file of one row group is dealt over tasks of so many rows, and the packets of every event are there once."""
    events = spark.read.parquet(f"{data}/events.parquet")
    events.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    monkeypatch.setattr(queries, "EVENTS_A_PART", 50)
    raw = analysis(spark, str(tmp_path)).raw_packets
    a_file = [r["count"] for r in raw.groupBy(F.input_file_name()).count().collect()]
    assert len(a_file) > 8 and max(a_file) <= 100
    assert raw.count() == raw.select("packet_index").distinct().count() == events.count()


def test_chunks_of_events_hold_a_second(spark):
    """A chunk of the order holds the events of a second, so what a task sorts does not grow with the minute."""
    events = spark.range(200).selectExpr("'c' AS capture_id", "1704067200000000 + id * 300000 AS us", "concat('evt_', lpad(hex(id * 7919 % 65536), 12, '0')) AS event_id", "id % 3 AS label")
    cut = with_chunks(events, ["capture_id"], ti.EVENT_LEVELS)
    assert cut.groupBy("chunk0").agg((F.max("us") - F.min("us")).alias("span")).agg(F.max("span")).first()[0] < 1_000_000
    placed = global_rank(events, ["capture_id"], ti.EVENT_LEVELS, ti.EVENT_ORDER, "place")
    assert [r.place for r in placed.orderBy("us").collect()] == list(range(200))


def test_shuffles_grow_with_the_input(spark, data, tmp_path, monkeypatch):
    """Shuffles of a larger input start from more partitions than the session names, and never from fewer."""
    spark.read.parquet(f"{data}/events.parquet").write.parquet(f"{tmp_path}/events.parquet")
    before = spark.conf.get(FIRST_PARTITIONS, None)
    spark.conf.unset(FIRST_PARTITIONS)
    try:
        events = spark.read.parquet(f"{tmp_path}/events.parquet").count()
        monkeypatch.setattr(queries, "EVENTS_A_PART", 2)
        analysis(spark, str(tmp_path))
        assert int(spark.conf.get(FIRST_PARTITIONS)) == -(-events // 2) > int(spark.conf.get("spark.sql.shuffle.partitions"))
        monkeypatch.undo()
        queries.fit_shuffles(spark, 1)
        assert int(spark.conf.get(FIRST_PARTITIONS)) == -(-events // 2)
    finally:
        spark.conf.unset(FIRST_PARTITIONS)
        if before:
            spark.conf.set(FIRST_PARTITIONS, before)


def test_findings_do_not_shuffle_relationships(a, spark):
    """Findings take the end of their relationship, forward or back, and only relationships of a finding are moved."""
    rows = [("cap0", "x", "y", 5), ("cap0", "y", "x", 7), ("cap0", "v", "u", 9), *[("cap0", f"s{i}", f"t{i}", i) for i in range(500)]]
    links = spark.createDataFrame(rows, "capture_id string, source string, target string, last_us bigint")
    found = [("cap0", 1, "x", "y", ["x", "y"], 1), ("cap0", 2, "u", "v", ["u", "v"], 1), ("cap0", 3, "q", None, ["q"], 2), ("cap0", 4, None, None, ["x", "y"], 1)]
    findings = spark.createDataFrame(found, "capture_id string, place int, consumer string, destination string, impacted_entities array<string>, created_us bigint")
    assert [r.us for r in ti.timed_hypotheses(findings, links).orderBy("place").collect()] == [5, 9, 2, 5]
    plan = ti.timed_hypotheses(a.hypotheses, a.relationships)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftSemi") == 2


def test_replay_index_has_every_event(spark):
    """An event for each flow, relationship, host, hypothesis and candidate, however many there are."""
    folder = "/root/testdata/sf0.01"
    a = analysis(spark, folder)
    found = a.ranked_whole.select("hypothesis_type", "host").collect()
    assert a.flows.count() > 300 and a.relationships.count() > 300 and len(found) > 10
    beacons, hosts = sum(r.hypothesis_type == "beaconing" for r in found), {r.host for r in found}
    want = a.flows.count() + a.relationships.count() + 2 * a.scored_nodes.count() + len(found) + beacons + 2 * len(hosts)
    rows = queries.run("replay_index")(spark, folder).collect()
    assert len(rows) == want and sorted(r.event_index for r in rows) == list(range(want))
    place = {r.event_id: r.event_index for r in rows}
    shown = [r.event_id for r in a.indexed_events.orderBy("event_index").collect()]
    assert [place[x] for x in shown] == sorted(place[x] for x in shown)


def test_places_of_all_findings(spark):
    """Without a limit, places counted by chunks are those of a window, whatever a chunk holds."""
    a = analysis(spark, "/root/testdata/sf0.01")
    many = 10**6
    scored = fi.scored_hypotheses(a.found, a.host_profiles, None)
    window = fi.hypotheses(fi.scored_hypotheses(a.found, a.host_profiles, many), a.capture_end, many)
    summaries = fi.host_summaries(a.ranked_whole)
    risks = sorted((-r.risk_score, r.ip_address) for r in a.scored_nodes.collect())
    hosts = a.scored_nodes.select("capture_id", F.col("ip_address").alias("host"))
    for hot in (many, 1):
        assert same(fi.hypotheses(scored, a.capture_end, None, hot=hot), window)
        assert same(fi.investigation_candidates(summaries, None, hot=hot), fi.investigation_candidates(summaries, many))
        ranks = na.environment_rank(hosts, a.scored_nodes, hot=hot).collect()
        assert sorted((r.environment_rank, r.host, r.environment_size) for r in ranks) == [(i + 1, ip, len(risks)) for i, (_, ip) in enumerate(risks)]
