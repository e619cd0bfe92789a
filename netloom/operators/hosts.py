"""Scored flows to host profiles: metrics, role, identity, risk."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.functions import ip, ladders
from netloom.functions.numeric import flag, ratio, rnd, scaled, tally, unit
from netloom.functions.text import words
from netloom.functions.times import HOUR_US, hour_bucket
from netloom.limits import within

HOST = ["capture_id", "ip_address"]
LONG_LIVED_US = 300_000_000
PERSISTENT_US = 900_000_000
# Protocol and port sets of the role and risk rules.
ENCRYPTED = ["https", "http2", "smtps", "ldaps", "imaps", "pops"]
ROLE_INFRASTRUCTURE = ["arp", "dhcp", "dns", "llmnr", "mdns", "nbns", "ntp", "ssdp"]
DOMAIN_CONTROLLER_PROTOCOLS = ["dns", "kerberos", "ldap", "ldaps", "msrpc", "smb"]
SERVER_PORTS = [53, 80, 88, 135, 139, 389, 443, 445, 464, 636, 3389]
CHATTER = ["arp", "dhcp", "llmnr", "mdns", "nbns", "ssdp"]
EXPECTED_PROTOCOLS = [
    "arp", "dhcp", "dns", "ftp", "http", "http2", "https", "icmp", "imap", "imaps", "kerberos", "ldap", "ldaps", "llmnr", "mdns",
    "msrpc", "nbns", "netbios_datagram", "netbios_session", "ntp", "pop", "pops", "rdp", "smb", "smtp", "smtp_submission", "smtps",
    "snmp", "snmptrap", "ssdp", "ssh",
]


def host_flow_expansion(enriched: DataFrame) -> DataFrame:
    """Each flow as seen by its initiator and by its responder; a flow to itself is seen once, in both roles."""
    own = F.col("initiator_ip") == F.col("responder_ip")
    flipped = F.when(F.col("direction") == "outbound", "inbound").when(F.col("direction") == "inbound", "outbound").otherwise(F.col("direction"))

    def side(host, peer, role, sent, received, packets, mac, direction, initiated, responded):
        return F.struct(
            F.col(host).alias("ip_address"), F.col(peer).alias("peer_ip"), F.lit(role).alias("role"), F.col(packets).alias("host_packets"),
            F.col(sent).alias("upload"), F.col(received).alias("download"), F.col(mac).alias("mac"), direction.alias("host_direction"),
            initiated.alias("initiated"), responded.alias("responded"),
        )

    first = side("initiator_ip", "responder_ip", "initiator", "initiator_bytes", "responder_bytes", "initiator_packets", "initiator_mac", F.col("direction"), F.lit(1), flag(own))
    second = side("responder_ip", "initiator_ip", "responder", "responder_bytes", "initiator_bytes", "responder_packets", "responder_mac", flipped, F.lit(0), F.lit(1))
    sides = F.when(own, F.array(first)).otherwise(F.array(first, second))
    return enriched.withColumn("side", F.explode(sides)).select("*", "side.*").drop("side")


def _with_identity(rows: DataFrame) -> DataFrame:
    """Per row: a usable MAC, the best host name and the user that belongs to this side of the flow."""
    owner = F.when(F.col("responder_port").isin(88, 464), "initiator").when(F.col("initiator_port").isin(88, 464), "responder")
    return rows.withColumns({
        "mac_": F.when((F.col("mac") != "") & (F.col("mac") != "ff:ff:ff:ff:ff:ff"), F.lower("mac")),
        "hostname_": F.col("best_hostname"),
        "user_": F.when(owner == F.col("role"), F.col("first_user")),
    })


def host_peers(rows: DataFrame) -> DataFrame:
    """One row per (host, peer). Every later host figure is a sum or a count over these rows.

    The grouping by peer spreads a host that takes part in most flows over many tasks; sets hold
    protocol and transport names only.
    """
    span = F.col("last_us") - F.col("first_us")
    external = F.col("direction").isin("outbound", "inbound", "external")
    tls = F.col("application_protocol").isin("https", "http2") & external
    rare = F.array_contains("suspicious_indicators", "low_frequency_destination")
    return _with_identity(rows).groupBy(*HOST, "peer_ip").agg(
        F.count(F.lit(1)).alias("flow_count"),
        F.sum("host_packets").alias("packet_count"),
        F.sum("upload").alias("upload_bytes"),
        F.sum("download").alias("download_bytes"),
        F.sum(F.col("initiator_bytes") + F.col("responder_bytes")).alias("pair_bytes"),
        F.sum("initiated").alias("initiated_flow_count"),
        F.sum("responded").alias("responded_flow_count"),
        *[tally(F.col("host_direction") == d).alias(f"{d}_n") for d in ("outbound", "inbound", "internal", "external")],
        tally(F.col("is_periodic")).alias("beacon_flow_count"),
        tally(F.col("is_suspicious")).alias("suspicious_flow_count"),
        tally(F.col("suppressed")).alias("suppressed_flow_count"),
        tally(span >= PERSISTENT_US).alias("persistent_connection_count"),
        tally(span >= LONG_LIVED_US).alias("long_lived_flow_count"),
        tally(F.col("application_protocol") == "unknown").alias("unknown_n"),
        tally(F.col("application_protocol").isin(ENCRYPTED)).alias("encrypted_n"),
        tally(rare).alias("low_frequency_n"),
        tally(tls & ((span >= LONG_LIVED_US) | (F.coalesce("beacon_score", F.lit(0.0)) != 0))).alias("persistent_tls_n"),
        tally(external & (F.col("application_protocol") == "smb")).alias("external_smb_n"),
        F.sum(F.greatest(span, F.lit(0))).alias("duration_us"),
        F.sum(scaled(F.col("app_confidence"), 4)).alias("app_confidence_e4"),
        F.collect_set("application_protocol").alias("protocols"),
        F.collect_set("transport_layer").alias("transports"),
        F.min(F.struct("first_us", "first_seen_sequence")).alias("first_"),
        F.max(F.struct(F.col("last_us"), (-F.col("first_us")).alias("a"), (-F.col("first_seen_sequence")).alias("b"), F.col("last_seen_sequence"))).alias("last_"),
        F.min("mac_").alias("mac_"), F.min("hostname_").alias("hostname_"), F.min("user_").alias("user_"),
    )


def edge_hints(peers: DataFrame) -> DataFrame:
    return peers.select(
        *HOST, F.col("peer_ip").alias("target"), "flow_count", F.array_sort(F.filter("protocols", lambda p: p != "")).alias("protocols"),
        F.col("pair_bytes").alias("total_bytes"), F.col("first_.first_us").alias("first_us"), F.col("last_.last_us").alias("last_us"),
    )


def host_hours(rows: DataFrame) -> DataFrame:
    """Flows that start or end per (host, hour); a flow counts once at its start and once at its end."""
    ends = F.explode(F.array(hour_bucket("first_us"), hour_bucket("last_us"))).alias("hour")
    return rows.select(*HOST, ends).groupBy(*HOST, "hour").agg(F.count(F.lit(1)).alias("n"))


def activity_clusters(hours: DataFrame) -> DataFrame:
    """Hours with activity, their histogram, and the number of runs of neighbouring hours.

    The array of a host is as long as the capture has hours.
    """
    ordered = hours.groupBy(*HOST).agg(F.array_sort(F.collect_list(F.struct("hour", "n"))).alias("h"))
    buckets = F.transform("h", lambda x: x["hour"])
    return ordered.withColumn("active_time_buckets", buckets).select(
        *HOST, "active_time_buckets", F.size("h").alias("active_bucket_count"),
        F.map_from_entries("h").alias("hourly_activity_distribution"),
        # a run begins where the hour before is not the element before
        F.size(F.filter("active_time_buckets", lambda x, i: (i == 0) | (F.get(F.col("active_time_buckets"), i - 1) != x - 1))).alias("activity_cluster_count"),
    )


def host_ports(rows: DataFrame) -> DataFrame:
    """Responder ports a host took part in, and how many well-known server ports it answered on."""
    ports = rows.where("responder_port IS NOT NULL").groupBy(*HOST, "responder_port").agg(F.max("responded").alias("service"))
    return ports.groupBy(*HOST).agg(
        F.count(F.lit(1)).alias("unique_ports"),
        tally((F.col("service") == 1) & F.col("responder_port").isin(SERVER_PORTS)).alias("server_port_overlap"),
    )


def host_metrics(rows: DataFrame, peers: DataFrame, hours: DataFrame) -> DataFrame:
    """All figures of a host."""
    classed = ip.with_numbers(peers, peer_num="peer_ip").withColumn("peer_class", ip.ip_class(F.col("peer_num")))
    protocols = F.array_sort(F.array_distinct(F.flatten(F.collect_set("protocols"))))
    summed = [
        "flow_count", "packet_count", "upload_bytes", "download_bytes", "initiated_flow_count", "responded_flow_count", "outbound_n",
        "inbound_n", "internal_n", "external_n", "beacon_flow_count", "suspicious_flow_count", "suppressed_flow_count",
        "persistent_connection_count", "long_lived_flow_count", "unknown_n", "encrypted_n", "low_frequency_n", "persistent_tls_n",
        "external_smb_n", "duration_us", "app_confidence_e4",
    ]
    base = classed.groupBy(*HOST).agg(
        *[F.sum(c).alias(c) for c in summed],
        F.count(F.lit(1)).alias("unique_peers"),
        tally(F.col("peer_class") == "external").alias("external_unique_hosts"),
        tally(F.col("peer_class") == "internal").alias("internal_unique_hosts"),
        tally(F.col("initiated_flow_count") > 0).alias("unique_destinations"),
        F.sum(F.size("protocols")).alias("protocol_relationships"),
        tally(F.col("persistent_connection_count") > 0).alias("persistent_relationships"),
        F.max("flow_count").alias("top_peer_flows"),
        protocols.alias("protocols"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("transports")))).alias("transports"),
        F.min("first_").alias("first_"), F.max("last_").alias("last_"),
        F.min("mac_").alias("mac_address"), F.min("hostname_").alias("hostname_"), F.min("user_").alias("user_identity"),
    )
    c = F.col
    flows = c("flow_count")
    m = base.join(activity_clusters(hours), HOST, "left").join(host_ports(rows), HOST, "left").withColumns({
        "hostname": c("hostname_.name"),
        "unique_ports": F.coalesce("unique_ports", F.lit(0)).cast("bigint"),
        "server_port_overlap": F.coalesce("server_port_overlap", F.lit(0)).cast("bigint"),
        "first_us": c("first_.first_us"), "last_us": c("last_.last_us"),
        "first_seen_sequence": c("first_.first_seen_sequence"), "last_seen_sequence": c("last_.last_seen_sequence"),
        "external_flow_count": c("outbound_n") + c("inbound_n") + c("external_n"),
        "total_bytes": c("upload_bytes") + c("download_bytes"),
    }).withColumns({
        "active_duration": rnd((c("last_us") - c("first_us")) / F.lit(1e6), 4),
        "unknown_protocol_ratio": ratio(c("unknown_n"), flows),
        "encrypted_flow_ratio": ratio(c("encrypted_n"), flows),
        "protocol_confidence_avg": rnd(c("app_confidence_e4") / flows / F.lit(1e4), 4),
    })
    completeness = (
        unit(flows / 50) * 0.25 + unit(c("packet_count") / 750) * 0.25 + unit(c("active_duration") / 3600) * 0.20
        + c("protocol_confidence_avg") * (F.lit(1.0) - F.least(c("unknown_protocol_ratio"), F.lit(0.85))) * 0.30
    )
    importance = unit(flows / 250) * 0.35 + unit(c("unique_peers") / 50) * 0.35 + unit(c("external_flow_count") / 50) * 0.30
    return m.withColumns({
        "internal_flow_count": c("internal_n"),
        "external_connections": c("external_flow_count"), "internal_connections": c("internal_n"),
        "external_unique_relationships": c("external_unique_hosts"), "internal_unique_relationships": c("internal_unique_hosts"),
        "inbound_connections": c("inbound_n"), "outbound_connections": c("outbound_n"),
        "upload_download_ratio": ratio(c("upload_bytes"), c("download_bytes")),
        "average_flow_duration": rnd(c("duration_us") / flows / F.lit(1e6), 4),
        "protocol_diversity": F.size("protocols"), "transport_diversity": F.size("transports"),
        "telemetry_completeness": rnd(completeness, 4),
        "outbound_ratio": ratio(c("outbound_n"), flows), "inbound_ratio": ratio(c("inbound_n"), flows), "internal_ratio": ratio(c("internal_n"), flows),
        "periodic_flow_ratio": ratio(c("beacon_flow_count"), flows),
        "persistent_connection_ratio": ratio(c("persistent_connection_count"), flows),
        "activity_density": rnd(flows / F.greatest(c("active_bucket_count"), F.lit(1)), 4),
        "session_density": ratio(flows, F.greatest(c("active_duration") / 3600, F.lit(1.0))),
        "graph_weight": rnd(c("total_bytes") / F.lit(1e6) + flows, 4),
        "graph_degree": c("unique_peers"),
        "graph_importance": rnd(importance, 4),
    }).drop("first_", "last_", "hostname_")


def host_role(metrics: DataFrame) -> DataFrame:
    """role, role_confidence, role_evidence: the first rule that matches."""
    c = F.col
    p = F.transform("protocols", lambda x: F.lower(x))

    def common(items):
        return F.array_sort(F.array_intersect(c("p_"), words(items)))

    def has(*items):
        return F.arrays_overlap(c("p_"), words(items))

    m = ip.with_numbers(metrics, ip_num="ip_address").withColumn("p_", p).withColumns({
        "dc_": common(DOMAIN_CONTROLLER_PROTOCOLS), "infra_": common(ROLE_INFRASTRUCTURE), "public_": ip.is_public(c("ip_num")),
    })
    web = has("dns", "https", "http")
    busy_inside = (c("inbound_ratio") >= 0.35) & (c("responded_flow_count") >= 10)
    active_outside = (
        (c("internal_unique_hosts") >= 2) | (c("persistent_relationships") >= 2) | (c("suspicious_flow_count") > 0) | (c("beacon_flow_count") > 0)
    )
    all_dc = F.size(common(["kerberos", "ldap", "smb"])) == 3
    rules = [
        (c("public_") & active_outside, "EXTERNAL_SERVICE", 0.82, words(["external_ip", "external_service_behavior"])),
        (c("public_"), "UNKNOWN", 0.35, words(["external_low_signal_endpoint"])),
        (all_dc | ((F.size("dc_") >= 4) & busy_inside), "DOMAIN_CONTROLLER", 0.84, c("dc_")),
        ((c("unique_destinations") >= 20) & (c("external_unique_hosts") >= 20) & web, "WORKSTATION", 0.84,
         words(["external_destination_fanout", "dns_https_client_behavior"])),
        ((c("outbound_ratio") >= 0.40) & (c("unique_destinations") >= 3) & web, "WORKSTATION", 0.84,
         words(["outbound_dominant", "dns_https_client_behavior", "destination_fanout"])),
        ((c("outbound_ratio") >= 0.35) & (c("unique_destinations") >= 2), "WORKSTATION", 0.70, words(["outbound_dominant", "client_fanout"])),
        (has("dhcp") | (has("dns", "ldap") & (F.size("infra_") >= 2)), "INFRASTRUCTURE", 0.78, c("infra_")),
        (busy_inside & (c("server_port_overlap") >= 2), "SERVER", 0.76, words(["high_inbound_ratio", "stable_service_ports", "many_clients"])),
        ((F.size("p_") > 0) & (F.size("infra_") == F.size("p_")), "INFRASTRUCTURE", 0.72, words(["infrastructure_protocol_only"])),
    ]
    chain = None
    for test, role, confidence, evidence in rules:
        value = F.struct(F.lit(role).alias("role"), F.lit(confidence).alias("conf"), evidence.alias("evidence"))
        chain = F.when(test, value) if chain is None else chain.when(test, value)
    default = F.struct(F.lit("UNKNOWN").alias("role"), F.lit(0.35).alias("conf"), words(["insufficient_role_evidence"]).alias("evidence"))
    return (
        m.withColumn("role_", chain.otherwise(default))
        .withColumns({"role": c("role_.role"), "inferred_role": c("role_.role"), "role_confidence": c("role_.conf"), "role_evidence": c("role_.evidence")})
        .drop("role_", "p_", "dc_", "infra_", "public_")
    )


# Indicator names in the order in which they are reported.
HOST_INDICATORS = [
    "unusual_external_persistence",
    "periodic_communication_behavior",
    "elevated_external_relationship_fanout",
    "recurring_activity_windows",
    "ambiguous_or_unusual_protocol_mix",
    "asymmetric_upload_behavior",
    "persistent_external_tls",
    "infrequent_external_contact",
    "elevated_flow_context",
    "concentrated_external_relationship",
    "workstation_external_smb_exposure",
]


def host_risk(m: DataFrame) -> DataFrame:
    """risk_score, confidence, severity and the indicators behind them."""
    c = F.col
    ext = c("external_unique_hosts")

    def capped(test, value, top):
        return F.when(test, F.least(value.cast("double"), F.lit(float(top))))

    def fixed(test, value):
        return F.when(test, F.lit(float(value)))

    # the expected protocols already contain those that servers and domain controllers may add
    unusual = F.size(F.array_except("protocols", words(EXPECTED_PROTOCOLS))) > 0
    points = [
        capped((c("persistent_relationships") > 0) & (ext > 0), c("persistent_relationships") * 8, 20),
        capped(c("beacon_flow_count") > 0, c("beacon_flow_count") * 10, 24),
        capped(ext >= 12, ext / 35 * 18, 18),
        capped((c("activity_cluster_count") >= 3) & (c("active_duration") >= 1800), c("activity_cluster_count") * 4, 14),
        fixed(unusual, 10),
        fixed((c("upload_bytes") > 1_000_000) & (c("upload_download_ratio") >= 3), 14),
        fixed(c("persistent_tls_n") > 0, 14),
        capped(c("low_frequency_n") > 0, c("low_frequency_n") * 6, 16),
        capped(c("suspicious_flow_count") > 0, c("suspicious_flow_count") * 7, 20),
        fixed((c("top_peer_flows") / c("flow_count") >= 0.70) & (ext > 0), 8),
        fixed((c("role") == "WORKSTATION") & (c("external_smb_n") > 0), 16),
    ]
    found = F.filter(
        F.array(*[F.struct(F.lit(n).alias("name"), rnd(v, 4).alias("points")) for n, v in zip(HOST_INDICATORS, points)]),
        lambda x: x["points"].isNotNull(),
    )
    chatter_only = F.size(F.array_except("protocols", words(CHATTER))) == 0
    has_smb = F.array_contains("protocols", "smb")
    relief = (
        F.least(c("suppressed_flow_count") / c("flow_count") * 40, F.lit(38.0))
        + flag(chatter_only) * 34
        + flag(c("role").isin("DOMAIN_CONTROLLER", "SERVER") & has_smb) * 8
        + flag(c("role") == "INFRASTRUCTURE") * 18
        + flag((ext == 0) & (c("suspicious_flow_count") == 0)) * 14
    )
    cap = F.least(
        F.when(c("role") == "INFRASTRUCTURE", F.lit(42.0)).otherwise(F.lit(82.0)),
        F.when(F.size("found_") <= 1, F.lit(48.0)).when(F.size("found_") == 2, F.lit(64.0)).otherwise(F.lit(82.0)),
    )
    stability = (
        F.when(c("flow_count") < 3, F.lit(0.22)).when(c("active_duration") <= 0, F.lit(0.30)).when(c("activity_cluster_count") <= 1, F.lit(0.48))
        .when(c("activity_density") <= 10, F.lit(0.68)).otherwise(F.lit(0.58))
    )
    confidence = (
        unit(c("flow_count") / 85) * 0.18 + unit(c("packet_count") / 1500) * 0.18 + unit(c("active_duration") / 10800) * 0.18
        + c("protocol_confidence_avg") * (F.lit(1.0) - F.least(c("unknown_protocol_ratio"), F.lit(0.9))) * 0.18
        + c("telemetry_completeness") * 0.18 + stability * 0.10
    ) * (F.lit(1.0) - F.least(c("unknown_protocol_ratio") * 0.55, F.lit(0.55))) * (F.lit(1.0) - F.least(c("encrypted_flow_ratio") * 0.18, F.lit(0.18)))
    total = F.aggregate("found_", F.lit(0.0), lambda acc, x: acc + x["points"])
    return (
        m.withColumn("found_", found)
        .withColumns({"pressure_": F.greatest(total - relief, F.lit(0.0)), "cap_": cap})
        .withColumns({
            "risk_score": rnd(F.least(c("cap_") * (F.lit(1.0) - F.exp(-c("pressure_") / 48)), c("cap_")), 2),
            "confidence": rnd(F.least(confidence, F.lit(0.78)), 4),
            "behavioral_indicators": F.transform("found_", lambda x: x["name"]),
            "indicator_details": F.map_from_entries("found_"),
        })
        .withColumn("severity", ladders.host_severity(c("risk_score"), c("confidence")))
        .drop("found_", "pressure_", "cap_")
    )


def host_profiles(metrics: DataFrame) -> DataFrame:
    """Role and risk on top of the metrics, with display values and the nested graph node."""
    c = F.col
    chatter_only = F.size(F.array_except("protocols", words(CHATTER))) == 0
    group = (
        F.when((c("external_connections") > 0) & c("severity").isin("medium", "high"), "elevated_external_behavior")
        .when(chatter_only, "infrastructure_chatter")
        .when((c("internal_connections") > 0) & (c("external_connections") == 0), "internal_host")
        .otherwise("mixed_behavior")
    )
    scored = host_risk(host_role(metrics)).withColumns({
        "graph_node_size": ladders.node_size(c("graph_degree"), c("risk_score")),
        "graph_risk_color": ladders.host_color(c("risk_score"), c("confidence")),
        "graph_cluster_group": group,
    })
    node = F.struct(
        c("ip_address").alias("id"), "risk_score", "confidence", c("unique_peers").alias("connections"), "protocols",
        c("graph_node_size").alias("node_size"), c("graph_risk_color").alias("node_color"), c("graph_cluster_group").alias("cluster_group"),
        "first_us", "last_us",
        F.struct("flow_count", "external_flow_count", "external_unique_hosts", "suspicious_flow_count", "graph_importance").alias("metadata"),
    )
    return scored.withColumn("graph_node", node)


def host_temporal(hosts: DataFrame) -> DataFrame:
    return hosts.select(
        *HOST, "first_us", "last_us", "first_seen_sequence", "last_seen_sequence",
        F.array_join(F.transform("active_time_buckets", lambda h: (h * HOUR_US).cast("string")), ",").alias("active_time_buckets"),
        F.array_join(
            F.transform(F.array_sort(F.map_entries("hourly_activity_distribution")), lambda e: F.concat((e["key"] * HOUR_US).cast("string"), F.lit("="), e["value"].cast("string"))), ","
        ).alias("hourly_activity_distribution"),
    )


# Numeric fields of a baseline, in order.
BASELINE_FIELDS = [
    "flow_count", "external_flow_count", "internal_flow_count", "packet_count", "total_bytes", "upload_bytes", "download_bytes",
    "external_connections", "external_unique_hosts", "external_unique_relationships", "internal_connections", "internal_unique_hosts",
    "internal_unique_relationships", "unique_destinations", "unique_peers", "unique_ports", "protocol_relationships",
    "persistent_relationships", "protocol_diversity", "unknown_protocol_ratio", "encrypted_flow_ratio", "telemetry_completeness",
    "beacon_flow_count", "suspicious_flow_count", "persistent_connection_count", "long_lived_flow_count", "active_duration",
    "activity_density", "session_density", "activity_cluster_count", "risk_score", "confidence",
]


def set_digest(text):
    """Aggregate: digest of a set of texts that does not depend on order and needs no list."""
    return F.bit_xor(F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint"))


def baseline_snapshot(hosts: DataFrame) -> DataFrame:
    """One row per host with the fields that later runs compare, and the id of the snapshot."""
    ids = hosts.groupBy("capture_id").agg(F.count(F.lit(1)).alias("host_count"), set_digest(F.col("ip_address")).alias("d")).select(
        "capture_id", "host_count",
        F.substring(F.sha2(F.concat_ws("|", "capture_id", F.col("host_count").cast("string"), F.col("d").cast("string")), 256), 1, 16).alias("snapshot_id"),
    )
    kept = hosts.select(
        *HOST, *BASELINE_FIELDS, "protocols", "transports", "first_us", "last_us", "first_seen_sequence", "last_seen_sequence",
        "active_time_buckets", "hourly_activity_distribution", "behavioral_indicators", "inferred_role", "role", "role_confidence", "graph_node",
    )
    return kept.join(ids, "capture_id")


def baseline_diff(current: DataFrame, previous: DataFrame) -> DataFrame:
    """One row per host and field that differs."""
    def side(frame, prefix):
        return frame.select(*HOST, *[F.col(f).cast("double").alias(f"{prefix}_{f}") for f in BASELINE_FIELDS])

    both = side(current, "c").join(side(previous, "p"), HOST, "full_outer")
    values = [(f, *(F.coalesce(f"{p}_{f}", F.lit(0.0)) for p in "cp")) for f in BASELINE_FIELDS]
    fields = F.array(*[F.struct(F.lit(f).alias("field"), now.alias("current"), then.alias("previous")) for f, now, then in values])
    changed = both.select(*HOST, F.explode(F.filter(fields, lambda x: x["current"] != x["previous"])).alias("x")).select(*HOST, "x.*")
    return changed.withColumn("delta", rnd(F.col("current") - F.col("previous"), 4))


def indicator_diff(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Indicators that came and went per host."""
    empty = F.array().cast("array<string>")
    now = current.select(*HOST, F.col("behavioral_indicators").alias("now"))
    then = previous.select(*HOST, F.col("behavioral_indicators").alias("then"))
    both = now.join(then, HOST, "full_outer").withColumns({"now": F.coalesce("now", empty), "then": F.coalesce("then", empty)})
    return both.select(
        *HOST, F.array_sort(F.array_except("now", "then")).alias("new_indicators"), F.array_sort(F.array_except("then", "now")).alias("removed_indicators")
    )


def elevated_hosts(hosts: DataFrame, top: int | None = 5) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("capture_id").orderBy(F.desc("risk_score"), "ip_address")
    return hosts.where(F.col("risk_score") >= 35).withColumn("place", F.row_number().over(w)).where(within("place", top))
