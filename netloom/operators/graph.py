"""Profiles and relationships to a behavioural graph: nodes, edges, centrality, communities, risk, health."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netloom.functions import ip
from netloom.functions.numeric import flag, rnd, scaled, tally, unit
from netloom.functions.text import words
from netloom.operators.ordered import running_max

CAP = "capture_id"
NODE = [CAP, "node_id"]
# Protocols of a node that is infrastructure only.
NOISE_PROTOCOLS = ["dhcp", "dns", "ntp", "arp", "ldap"]
RISKY_TYPES = ["persistent_tls", "external_tls_session", "directory_authentication", "administrative_rpc"]
# All values that `relationship_type` gives.
RELATIONSHIP_TYPES = [
    "administrative_rpc", "dhcp_assignment", "directory_authentication", "external_tls_session", "file_transfer", "infrastructure_dns", "interaction",
    "interactive_http", "periodic_communication", "periodic_dns", "persistent_tls", "service_discovery", "suspicious_communication",
]
COMMUNITY_OF_ROLE = {
    "DOMAIN_CONTROLLER": "Domain Controllers",
    "INFRASTRUCTURE": "Infrastructure",
    "SERVER": "Servers",
    "WORKSTATION": "Workstations",
    "EXTERNAL_SERVICE": "External Services",
}


def node_id(address):
    return F.substring(F.sha2(F.concat(F.lit("node:"), address), 256), 1, 16)


def graph_nodes(hosts: DataFrame) -> DataFrame:
    c = F.col
    contacts = c("external_unique_hosts") + c("internal_unique_hosts")
    density = F.when((c("flow_count") == 0) | (contacts == 0), F.lit(0.0)).otherwise(rnd(unit(c("flow_count") / (contacts * 10 + 1)), 4))
    public_unknown = (c("role") == "UNKNOWN") & ip.is_public(c("ip_num"))
    effective = F.when(public_unknown, "EXTERNAL_SERVICE").otherwise(c("role"))
    names = F.create_map(*[F.lit(x) for pair in COMMUNITY_OF_ROLE.items() for x in pair])
    protocols_noise = (F.size("protocols") > 0) & (F.size(F.array_except("protocols", words(NOISE_PROTOCOLS))) == 0)
    return hosts.select(
        CAP, node_id(c("ip_address")).alias("node_id"), "ip_address", "ip_num", "hostname", "inferred_role", "role", "risk_score", "confidence",
        "behavioral_indicators", "protocol_diversity", density.alias("initial_density"), "first_us", "last_us",
        c("first_seen_sequence").alias("replay_sequence_start"), c("last_seen_sequence").alias("replay_sequence_end"),
        "role_confidence", "role_evidence", c("external_unique_hosts").alias("external_connections"),
        c("internal_unique_hosts").alias("internal_connections"), "protocols", "telemetry_completeness",
        F.coalesce(F.try_element_at(names, effective), F.lit("Unknown")).alias("community_type"),
    ).withColumns({
        "community_confidence": F.when(c("community_type") == "Unknown", F.lit(0.35)).otherwise(F.lit(0.85)),
        "non_investigative": ip.non_investigative_node(c("ip_num")),
    }).withColumn("infrastructure_noise", c("non_investigative") | ((c("role") == "INFRASTRUCTURE") & protocols_noise))


def relationship_type():
    c = F.col

    def shown(name):
        return F.array_contains("relationship_indicators", name)

    def speaks(*names):
        return F.arrays_overlap("protocols", words(names))

    return (
        F.when(shown("persistent_tls_relationship"), "persistent_tls")
        .when(shown("periodic_relationship_activity"), "periodic_communication")
        .when(shown("periodic_low_volume_communication"), "periodic_dns")
        .when(shown("elevated_flow_context"), "suspicious_communication")
        .when(speaks("ldap", "kerberos", "krb5"), "directory_authentication")
        .when(speaks("msrpc", "netbios", "epmap"), "administrative_rpc")
        .when(speaks("dns"), "infrastructure_dns")
        .when(speaks("http") & (c("persistence") < 0.4), "interactive_http")
        .when(speaks("https", "tls") & (c("persistence") >= 0.4), "external_tls_session")
        .when(speaks("smb", "sftp", "ftp", "cifs"), "file_transfer")
        .when(speaks("mdns", "ssdp", "dns-sd"), "service_discovery")
        .when(speaks("dhcp"), "dhcp_assignment")
        .when(speaks("https", "tls"), "persistent_tls")
        .otherwise("interaction")
    )


def communication_pattern():
    p = F.col("persistence")
    return F.when(p >= 0.7, "continuous").when(p >= 0.4, "periodic").when(F.col("flows") <= 3, "sporadic").otherwise("bursty")


def edge_metric_clamp(value):
    return rnd(unit(value), 4)


def graph_edges(relationships: DataFrame) -> DataFrame:
    c = F.col
    return relationships.select(
        CAP, "edge_id", "source", "target", node_id(c("source")).alias("source_node"), node_id(c("target")).alias("target_node"),
        relationship_type().alias("relationship_type"), communication_pattern().alias("communication_pattern"), "directionality",
        "relationship_risk", edge_metric_clamp(c("persistence")).alias("persistence_score"),
        edge_metric_clamp(c("packet_count") / (c("flows") * 5 + 1)).alias("communication_density"), "protocol_diversity", "first_us", "last_us",
        c("first_seen_sequence").alias("replay_sequence_start"), c("last_seen_sequence").alias("replay_sequence_end"),
        "severity", "flows", "packet_count", "total_bytes", "protocols", "transports", "persistence", "relationship_indicators",
        "graph_weight", "graph_edge_color", "graph_edge_width",
    )


def node_links(edges: DataFrame) -> DataFrame:
    """Edge figures per node. Grouping by neighbour first spreads a node that most edges touch."""

    def ends(node, other, inbound):
        own = F.col("source_node") == F.col("target_node")
        return edges.select(
            CAP, F.col(node).alias("node_id"), F.col(other).alias("neighbour"), F.lit(inbound).alias("inbound"),
            # a loop is one relationship but counts at both ends of the weighted degree
            (F.lit(1) - flag(own) * inbound).alias("touches"), "graph_weight", "persistence_score", "relationship_type",
        )

    both = ends("source_node", "target_node", 0).unionByName(ends("target_node", "source_node", 1))
    per_neighbour = both.groupBy(*NODE, "neighbour").agg(
        F.sum("inbound").alias("inbound_edges"), F.sum(F.lit(1) - F.col("inbound")).alias("outbound_edges"), F.sum("touches").alias("touches"),
        F.sum(scaled(F.col("graph_weight"), 4)).alias("weight_e4"),
        F.sum(scaled(F.col("persistence_score"), 4) * F.col("touches")).alias("persistence_e4"),
        F.collect_set("relationship_type").alias("types"),
    )
    return per_neighbour.groupBy(*NODE).agg(
        F.count(F.lit(1)).alias("node_degree"), F.sum("inbound_edges").alias("inbound_edges"), F.sum("outbound_edges").alias("outbound_edges"),
        F.sum("touches").alias("touches"), F.sum("weight_e4").alias("weight_e4"), F.sum("persistence_e4").alias("persistence_e4"),
        F.size(F.array_distinct(F.flatten(F.collect_set("types")))).alias("type_count"),
    )


def node_degree(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Degree, weighted degree, refined density and the edge figures that later scores use."""
    c = F.col
    counts = ["node_degree", "inbound_edges", "outbound_edges", "touches", "type_count"]
    joined = nodes.join(links, NODE, "left").withColumns({n: F.coalesce(n, F.lit(0)).cast("bigint") for n in counts})
    return joined.withColumns({
        "weighted_degree": F.coalesce(c("weight_e4") / F.lit(1e4), F.lit(0.0)),
        "average_persistence": F.when(c("touches") > 0, c("persistence_e4") / F.lit(1e4) / c("touches")).otherwise(F.lit(0.0)),
    }).withColumn(
        "communication_density",
        F.when(c("node_degree") > 0, rnd(c("weighted_degree") / (c("node_degree") + 1), 4)).otherwise(c("initial_density")),
    ).drop("weight_e4", "persistence_e4", "initial_density")


def behavioral_centrality(nodes: DataFrame, global_max: bool = False) -> DataFrame:
    """centrality_hint and node_priority.

    Degrees are compared with the largest degree of all nodes up to this one in address order. With
    `global_max` they are compared with the largest degree of the capture.
    """
    c = F.col
    if global_max:
        top = nodes.groupBy(CAP).agg(F.max("node_degree").alias("top_degree"))
        nodes = nodes.join(top, CAP)
    else:
        # five characters of the address cut even a full IPv4 space into windows of a few million rows
        nodes = running_max(nodes, [CAP], ["substring(ip_address, 1, 5)"], ["ip_address"], "node_degree", "top_degree")
    score = (
        c("node_degree") / F.greatest(c("top_degree"), F.lit(1)) * 0.2 + unit(c("risk_score") / 100) * 0.3 + unit(c("type_count") / 8) * 0.2
        + unit(c("protocol_diversity") / 10) * 0.15 + unit(c("external_connections") / 50) * 0.15
    )
    value = F.when(c("infrastructure_noise"), F.lit(0.05)).when(c("touches") == 0, F.lit(0.0)).otherwise(rnd(unit(score), 4))
    return nodes.withColumn("centrality_hint", value).withColumn("node_priority", rnd(c("risk_score") * 0.4 + c("centrality_hint") * 60, 4)).drop("top_degree")


def investigative_entity():
    c = F.col
    return ~c("infrastructure_noise") & (
        (c("risk_score") >= 5.0) | (c("external_connections") > 0) | (F.size("behavioral_indicators") > 0) | (F.size("protocols") > 2)
        | (c("role") != "INFRASTRUCTURE") | (c("node_degree") >= 2)
    )


def behavioral_importance():
    c = F.col
    return rnd(unit(
        unit(c("risk_score") / 100) * 0.25 + unit(c("type_count") / 8) * 0.2 + unit(c("external_connections") / 100) * 0.25
        + c("average_persistence") * 0.15 + unit(c("protocol_diversity") / 10) * 0.15
    ), 4)


def community_heuristic():
    """The alternative rule: degree, protocols and edge counts in place of the role."""
    c = F.col
    inbound, outbound = c("inbound_edges"), c("outbound_edges")
    directory = F.arrays_overlap("protocols", words(["ldap", "kerberos", "krb5", "msrpc"]))
    tls = F.arrays_overlap("protocols", words(["https", "tls"]))
    outside = ip.outside_internal(c("ip_num"))
    return (
        F.when(c("role") == "INFRASTRUCTURE", "Infrastructure")
        .when(directory & (c("node_degree") > 5), "Domain Controllers")
        .when(outside & (((inbound >= 3) & tls) | (inbound >= 2)), "External Services")
        .when((inbound > outbound * 2) & (inbound > 5), "Servers")
        .when((c("external_connections") > 0) | (outbound > inbound), "Workstations")
        .otherwise("Unknown")
    )


def external_service(nodes: DataFrame) -> DataFrame:
    """is_external_service, service_confidence, service_reason. Edges are one per pair, so inbound edges are consumers."""
    c = F.col
    consumers = c("inbound_edges")
    tls = F.arrays_overlap("protocols", words(["https", "tls", "ssl"]))
    any_protocol, durable = F.size("protocols") > 0, c("average_persistence") >= 0.5
    points = (
        F.when(consumers >= 3, 3).when(consumers >= 2, 2).otherwise(0) + flag(tls) * 3 + flag(any_protocol) * 2 + flag(durable) * 2
    )
    reasons = F.array_compact(F.array(
        F.when(consumers >= 2, F.concat(consumers.cast("string"), F.lit("_consumers"))), F.when(tls, "tls_service"),
        F.when(any_protocol, "service_protocols"), F.when(durable, "persistent_relationships"),
    ))
    outside = ip.outside_internal(c("ip_num"))
    return nodes.withColumn("points_", F.when(outside, points).otherwise(0)).withColumns({
        "is_external_service": c("points_") >= 5,
        "service_confidence": unit(c("points_") / 10),
        "service_reason": F.when(~outside, "internal_ip").when(F.size(reasons) == 0, "low_signal").otherwise(F.array_join(reasons, "|")),
    }).drop("points_")


def scored_nodes(linked: DataFrame, global_max: bool = False) -> DataFrame:
    """All scores of nodes that carry their edge figures."""
    scored = external_service(behavioral_centrality(linked, global_max))
    return scored.withColumns({
        "is_investigative": investigative_entity(), "behavioral_importance": behavioral_importance(), "community_heuristic": community_heuristic(),
    })


def isolated(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("isolated", F.col("touches") == 0)


def node_figures(nodes: DataFrame) -> DataFrame:
    """All that a state sums over the nodes of a capture, from one pass.

    Nodes are first folded by community and risk score. Scores have two digits below 82 and communities are six, so what is
    ordered by risk, to take the largest max(1, n div 10) and max(1, n div 5) scores, has at most 49,200 rows for each capture.
    """
    c = F.col
    cells = nodes.groupBy(CAP, "community_type", scaled(c("risk_score"), 2).alias("risk")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(c("touches") == 0).alias("isolated"), F.count_if((c("touches") == 0) & (c("risk_score") >= 20)).alias("risky_alone"),
        F.count_if(c("node_degree") == 0).alias("alone"), F.count_if(c("role") == "INFRASTRUCTURE").alias("infra"), F.sum("node_degree").alias("degree_sum"),
        F.sum("external_connections").alias("contacts"), F.sum("protocol_diversity").alias("diversity"), F.max("last_us").alias("timestamp_us"),
        F.min(F.when(c("replay_sequence_start") > 0, c("replay_sequence_start"))).alias("replay_sequence_start"),
        F.max(F.when(c("replay_sequence_end") > 0, c("replay_sequence_end"))).alias("replay_sequence_end"),
    )
    down = Window.partitionBy(CAP).orderBy(F.desc("risk"), "community_type").rowsBetween(Window.unboundedPreceding, -1)
    placed = cells.withColumns({"before": F.coalesce(F.sum("n").over(down), F.lit(0)), "all_n": F.sum("n").over(Window.partitionBy(CAP))})

    def taken(share):
        return F.greatest(F.least(c("n"), F.greatest(F.expr(f"all_n div {share}"), F.lit(1)) - c("before")), F.lit(0))

    sums = ["isolated", "risky_alone", "alone", "infra", "degree_sum", "contacts", "diversity"]
    by_community = placed.groupBy(CAP, "community_type").agg(
        F.sum("n").alias("n"), F.sum(c("risk") * c("n")).alias("risk_e2"), *[F.sum(x).alias(x) for x in sums], F.max("timestamp_us").alias("timestamp_us"),
        F.min("replay_sequence_start").alias("replay_sequence_start"), F.max("replay_sequence_end").alias("replay_sequence_end"),
        *[F.sum(c("risk") * taken(share)).alias(f"top{share}_e2") for share in (10, 5)], F.sum(taken(10)).alias("top_n"),
    )
    community = F.struct("community_type", c("n").alias("node_count"), (c("risk_e2") / c("n") / F.lit(100.0)).alias("average_risk"))
    return by_community.groupBy(CAP).agg(
        F.sum("n").alias("node_count"), *[F.sum(x).alias(x) for x in ("risk_e2", *sums, "top10_e2", "top5_e2", "top_n")], F.max("timestamp_us").alias("timestamp_us"),
        F.coalesce(F.min("replay_sequence_start"), F.lit(0)).alias("replay_sequence_start"), F.coalesce(F.max("replay_sequence_end"), F.lit(0)).alias("replay_sequence_end"),
        F.array_sort(F.collect_list(community)).alias("groups"),
    )


def edge_figures(edges: DataFrame) -> DataFrame:
    """All that a state sums over the edges of a capture, from one pass."""
    c = F.col

    def mean_of(column, digits, test):
        return F.coalesce(F.sum(F.when(test, scaled(c(column), digits))) / F.greatest(F.count_if(test), F.lit(1)) / F.lit(10.0**digits), F.lit(0.0))

    risky, periodic = c("relationship_type").isin(RISKY_TYPES), c("communication_pattern") == "periodic"
    return edges.groupBy(CAP).agg(
        F.count(F.lit(1)).alias("m"), F.array_sort(F.collect_set("relationship_type")).alias("relationship_types"), F.count_if(c("relationship_risk") >= 35).alias("suspicious"),
        F.sum(scaled(c("persistence_score"), 4)).alias("persistence_e4"), mean_of("persistence_score", 4, risky).alias("p"), mean_of("relationship_risk", 2, risky).alias("r"),
        mean_of("relationship_risk", 2, periodic).alias("q"),
    )


def central_nodes(nodes: DataFrame, top: int = 5) -> DataFrame:
    """The most central nodes, noise left out; when fewer than three remain, noise is let in."""
    c = F.col
    w = Window.partitionBy(CAP, "infrastructure_noise").orderBy(F.desc("centrality_hint"), "ip_address")
    ranked = nodes.where("NOT non_investigative").withColumn("place", F.row_number().over(w)).where(c("place") <= top)
    # at most `top` of each kind for a capture
    listed = ranked.groupBy(CAP).agg(F.array_sort(F.collect_list(F.struct((-c("centrality_hint")).alias("k"), "ip_address", "infrastructure_noise"))).alias("all"))
    quiet = F.filter("all", lambda x: ~x["infrastructure_noise"])
    picked = F.when(F.size(quiet) < 3, F.slice("all", 1, top)).otherwise(quiet)
    return listed.select(CAP, F.transform(picked, lambda x: x["ip_address"]).alias("high_centrality_nodes"))


def service_users(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """How many nodes talk to an external service."""
    services = nodes.where("is_external_service").select(CAP, F.col("node_id").alias("target_node"))
    return edges.join(services, [CAP, "target_node"], "left_semi").select(CAP, "source_node").distinct().groupBy(CAP).agg(F.count(F.lit(1)).alias("users"))


def _metrics() -> list:
    c = F.col
    possible = F.greatest(c("node_count") * (c("node_count") - 1), F.lit(1))
    edge_count = F.coalesce("m", F.lit(0)).cast("bigint")
    return [
        c("node_count"), edge_count.alias("edge_count"), rnd(edge_count / possible, 6).alias("graph_density"), rnd(c("top10_e2") / F.lit(100.0) / c("top_n"), 2).alias("graph_risk_score"),
        c("isolated").alias("isolated_node_count"), c("high_centrality_nodes"), c("relationship_types"), rnd(c("degree_sum") / c("node_count"), 2).alias("avg_node_degree"),
        F.coalesce("suspicious", F.lit(0)).cast("bigint").alias("suspicious_edges"),
    ]


def _risk_parts(relationship_risk: str) -> list:
    c = F.col
    means = F.transform("groups", lambda x: x["average_risk"])
    # the few community means are added in name order, so that the sum has one value
    mean = F.aggregate(means, F.lit(0.0), lambda a, x: a + x) / F.size("groups").cast("bigint")
    has_edges = c("m").isNotNull()
    return [
        rnd(c("top10_e2") / F.lit(100.0) / c("top_n") * 0.4, 2).alias("host_risk"),
        F.when(has_edges, rnd(F.greatest(c("p") * c("r"), c("q")) * 0.25, 2)).otherwise(F.lit(0.0)).alias(relationship_risk),
        rnd(F.least(F.array_max(means) / (mean + 0.01) * 2, F.lit(100.0)) * 0.2, 2).alias("community_risk"),
        F.when(has_edges, rnd(F.greatest(unit(c("contacts") / 100) * 25, c("risky_alone") * 5.0) * 0.15, 2)).otherwise(F.lit(0.0)).alias("topology_risk"),
    ]


def _health() -> list:
    c = F.col
    n, k = c("node_count"), F.size("groups").cast("bigint")
    squares = F.aggregate("groups", F.lit(0).cast("bigint"), lambda a, x: a + x["node_count"] * x["node_count"])
    mean = n / k
    variance = (squares * k - n * n) / k / k
    balance = F.lit(1.0) - variance / (mean * mean + 0.01)

    def per_edge(value, digits):
        return F.coalesce(rnd(value / c("m"), digits), F.lit(0.0))

    return [
        rnd(c("risk_e2") / n / F.lit(100.0), 2).alias("avg_node_risk"), per_edge(c("persistence_e4") / F.lit(1e4), 4).alias("avg_edge_persistence"),
        rnd(c("contacts") / (n * 10), 4).alias("externality_ratio"), rnd(c("infra") / n, 4).alias("infrastructure_ratio"),
        per_edge(c("suspicious"), 4).alias("suspicious_edge_ratio"), rnd(c("diversity") / n, 2).alias("avg_protocol_diversity"),
        rnd(c("alone") / n, 4).alias("isolated_node_ratio"), rnd(F.greatest(unit(balance), F.lit(0.0)), 2).alias("community_balance_score"),
        rnd(F.coalesce(F.size("relationship_types"), F.lit(0)) / 12, 2).alias("relationship_diversity_score"), rnd(F.coalesce("users", F.lit(0)) / n, 2).alias("external_dependency_score"),
        F.when(c("risk_e2") > 0, rnd(c("top5_e2") / F.lit(100.0) / (c("risk_e2") / F.lit(100.0)), 2)).otherwise(F.lit(0.0)).alias("risk_concentration_score"),
    ]


def graph_metrics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row per capture."""
    return node_figures(nodes).join(edge_figures(edges), CAP, "left").join(central_nodes(nodes), CAP, "left").select(CAP, *_metrics())


def graph_risk_decomposition(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row per capture."""
    return node_figures(nodes).join(edge_figures(edges), CAP, "left").select(CAP, *_risk_parts("relationship_risk"))


def graph_health(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row per capture."""
    return node_figures(nodes).join(edge_figures(edges), CAP, "left").join(service_users(nodes, edges), CAP, "left").select(CAP, *_health())


def _node_hash():
    text = F.concat_ws(":", "node_id", F.col("risk_score").cast("string"), F.array_join(F.array_sort("behavioral_indicators"), ","), F.array_join(F.array_sort("protocols"), ","))
    return F.substring(F.sha2(text, 256), 1, 16)


def _edge_hash():
    text = F.concat_ws(":", "source_node", "target_node", "relationship_type", F.col("relationship_risk").cast("string"))
    return F.substring(F.sha2(text, 256), 1, 16)


def node_hashes(nodes: DataFrame) -> DataFrame:
    return nodes.select(CAP, F.concat(F.lit("node_"), F.col("ip_address")).alias("entity"), _node_hash().alias("hash"))


def edge_hashes(edges: DataFrame) -> DataFrame:
    return edges.select(CAP, F.concat(F.lit("edge_"), F.col("edge_id")).alias("entity"), _edge_hash().alias("hash"))


def sorted_digests(values: DataFrame) -> DataFrame:
    """A digest for each kind of all hex values of a capture in order, the same definition at every size.

    The values are joined by `|` and digested for each leading three digits, in parallel; the digest of a capture is that of
    its at most 4,096 part digests in order. So no task ever holds the whole text.
    """
    bucket = F.substring("value", 1, 3)
    parts = values.groupBy(CAP, "kind", bucket.alias("bucket")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("value")), "|"), 256).alias("part"))
    return parts.groupBy(CAP).agg(*[
        F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("bucket", "part")))), lambda x: x["part"]), "|"), 256).alias(kind)
        for kind in ("graph", "node", "edge")
    ])


def graph_identity(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """graph_fingerprint over the contents of nodes and edges, snapshot_id over their ids."""

    def tagged(frame, kind, own, content):
        both = F.array(F.struct(F.lit(kind).alias("kind"), F.col(own).alias("value")), F.struct(F.lit("graph").alias("kind"), content.alias("value")))
        return frame.select(CAP, F.explode(both).alias("x")).select(CAP, "x.*")

    c = F.col
    digests = sorted_digests(tagged(nodes, "node", "node_id", _node_hash()).unionByName(tagged(edges, "edge", "edge_id", _edge_hash())))
    # a capture without edges has no digest of them
    edge_part = F.when(c("edge") == F.sha2(F.lit(""), 256), F.lit("")).otherwise(c("edge"))
    return digests.select(CAP, c("graph").alias("graph_fingerprint"), F.substring(F.sha2(F.concat(c("node"), F.lit(":"), edge_part), 256), 1, 16).alias("snapshot_id"))


def graph_fingerprint(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return graph_identity(nodes, edges).select(CAP, "graph_fingerprint")


def graph_state(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One wide row per capture.

    Nodes and edges are folded once each for all figures; digests, central nodes and users of services are passes of their own.
    Every joined table has one row per capture.
    """
    c = F.col
    facts = node_figures(nodes).join(edge_figures(edges), CAP, "left")
    for part in (central_nodes(nodes), service_users(nodes, edges), graph_identity(nodes, edges)):
        facts = facts.join(part, CAP, "left")
    size = F.aggregate("groups", F.lit(0).cast("bigint"), lambda a, x: a + x["node_count"])
    return facts.select(
        CAP, *_metrics(), "snapshot_id", "graph_fingerprint", "timestamp_us", "replay_sequence_start", "replay_sequence_end",
        F.size("groups").cast("bigint").alias("community_count"), size.alias("classified_nodes"),
        F.transform("groups", lambda x: F.concat(x["community_type"], F.lit("="), x["node_count"].cast("string"))).alias("community_summary"),
        *_risk_parts("relationship_risk_part"), *_health(),
    ).withColumn("unclassified_nodes", F.greatest(c("node_count") - c("classified_nodes"), F.lit(0)))
