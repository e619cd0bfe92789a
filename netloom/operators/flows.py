"""Packets to directional flows, and flows to scored flows."""

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netloom.functions import ladders
from netloom.functions.numeric import flag, ratio, rnd, unit
from netloom.functions.text import clean_hostname, clean_nbns_name, investigative_domain, labels, normalize_domain
from netloom.limits import Limits, best, within
from netloom.operators.facts import beside

KEY = ["capture_id", "flow_id"]
MIN_BEACON_PACKETS = 20
MIN_BEACON_INTERVALS = 10
PERIODIC_SCORE = 0.65
# Responder ports that are unusual for a service.
UNUSUAL_PORTS = [4444, 5555, 6667, 8888, 1337, 31337, 27374, 12345]
# A flow with more packets than this is not put into one window.
HOT_FLOW_PACKETS = 2_000_000


# Kinds of names in `flow_names`, and the columns of a flow that preview them.
NAME_KINDS = {"domain": "observed_domains", "nbns": "nbns_names", "kerberos": "kerberos_cnames"}


def packet_domains(packets: DataFrame) -> DataFrame:
    """(packet columns, field, domain): each name that a packet shows as host, query or server name, one row for each field."""
    fields = F.array(*[F.struct(F.lit(x).alias("field"), F.col(x).alias("value")) for x in ("http_host", "dns_query", "tls_sni")])
    rows = packets.withColumn("shown", F.explode(fields)).where("shown.value IS NOT NULL")
    return rows.withColumns({"field": F.col("shown.field"), "domain": normalize_domain(F.col("shown.value"))}).drop("shown")


def flow_names(packets: DataFrame) -> DataFrame:
    """(capture, flow, kind, name, packets, first_us): the names that the packets of a flow show, one row for each.

    Equal names are folded before the shuffle, which is by name as well as by flow; so a flow may have any number of names.
    """
    shown = lambda kind, name: F.struct(F.lit(kind).alias("kind"), name.alias("name"))
    domains = [shown("domain", normalize_domain(F.col(x))) for x in ("http_host", "dns_query", "tls_sni")]
    names = F.array_distinct(F.array(*domains, shown("nbns", clean_nbns_name(F.col("nbns_name"))), shown("kerberos", F.col("kerberos_cname"))))
    rows = packets.select(*KEY, "us", F.explode(names).alias("x")).where("x.name <> ''")
    return rows.groupBy(*KEY, F.col("x.kind").alias("kind"), F.col("x.name").alias("name")).agg(F.count(F.lit(1)).alias("packets"), F.min("us").alias("first_us"))


def name_facts(names: DataFrame, preview: int | None) -> DataFrame:
    """One row per flow with names: how many there are of each kind, its first `preview` names of each, and what identities and findings take from all of them."""
    of = lambda kind, value: F.when(F.col("kind") == kind, value)
    host = clean_hostname(F.col("name"))
    ranked = F.struct((~(host.contains("-") | F.upper(host).startswith("DESKTOP"))).cast("int").alias("plain"), host.alias("name"))
    facts = names.groupBy(*KEY).agg(
        *[F.count(of(kind, F.lit(1))).alias(f"{kind}_count") for kind in NAME_KINDS],
        F.min(of("nbns", F.when(host.isNotNull(), ranked))).alias("best_hostname"), F.min(of("kerberos", F.col("name"))).alias("first_user"),
        F.min(of("domain", F.when(investigative_domain(F.col("name")), F.col("name")))).alias("web_domain"),
    )
    listed = best(names, Window.partitionBy(*KEY, "kind").orderBy("name"), preview)
    listed = listed.groupBy(*KEY).agg(*[F.array_sort(F.collect_list(of(kind, F.col("name")))).alias(column) for kind, column in NAME_KINDS.items()])
    return facts.join(listed, KEY)


def build_flows(packets: DataFrame, names: DataFrame | None = None, preview: int | None = Limits.flow_names) -> DataFrame:
    """One row per directional 5-tuple; partial aggregates run before the shuffle.

    names: the table of `flow_names`. The lists of a flow show its first `preview` names of a kind; the table has all.
    """
    order = F.struct("us", "replay_sequence_id")
    first = F.min_by(
        F.struct("src_ip", "dst_ip", "transport_layer", "src_port", "dst_port", "application_protocol", "app_confidence", "direction"),
        order,
    )

    def first_mac(column):
        filled = F.col(column) != ""
        return F.min_by(F.when(filled, F.col(column)), F.when(filled, order))

    grouped = packets.groupBy(*KEY).agg(
        first.alias("f"),
        F.min("us").alias("first_us"),
        F.max("us").alias("last_us"),
        F.min_by("replay_sequence_id", order).alias("first_seen_sequence"),
        F.max_by("replay_sequence_id", F.struct(F.col("us"), -F.col("replay_sequence_id"))).alias("last_seen_sequence"),
        F.count(F.lit(1)).alias("packet_count"),
        F.sum("total_bytes").alias("initiator_bytes"),
        *[F.count_if(F.col(f"tcp_flags.{x}")).alias(f"{x}_count") for x in ("syn", "ack", "rst", "fin", "psh", "urg")],
        first_mac("src_mac").alias("initiator_mac"),
        first_mac("dst_mac").alias("responder_mac"),
    )
    shown = name_facts(flow_names(packets) if names is None else names, preview)
    none = F.array().cast("array<string>")
    flows = grouped.join(shown, KEY, "left").select(
        *KEY, "first_us", "last_us", "first_seen_sequence", "last_seen_sequence",
        F.col("f.src_ip").alias("initiator_ip"), F.col("f.dst_ip").alias("responder_ip"),
        "f.transport_layer", F.col("f.src_port").alias("initiator_port"), F.col("f.dst_port").alias("responder_port"),
        F.col("packet_count").alias("initiator_packets"), "initiator_bytes",
        F.lit(0).cast("bigint").alias("responder_packets"), F.lit(0).cast("bigint").alias("responder_bytes"),
        "syn_count", "ack_count", "rst_count", "fin_count", "psh_count", "urg_count",
        "f.application_protocol", "f.app_confidence", "f.direction",
        "initiator_mac", "responder_mac", *[F.coalesce(x, none).alias(x) for x in NAME_KINDS.values()], "packet_count",
        *[F.coalesce(f"{kind}_count", F.lit(0)).cast("bigint").alias(f"{kind}_count") for kind in NAME_KINDS], "best_hostname", "first_user", "web_domain",
    )
    return flow_rates(flows).withColumn("tcp_state_summary", tcp_state())


def flow_rates(flows: DataFrame) -> DataFrame:
    raw = (F.col("last_us") - F.col("first_us")) / F.lit(1e6)
    return flows.withColumn("raw_duration_seconds", raw).withColumns({
        "duration_seconds": F.greatest(F.col("raw_duration_seconds"), F.lit(0.001)),
        "chronology_valid": F.col("raw_duration_seconds") >= 0,
        "duration_anomalies": labels(
            ("negative_duration", F.col("raw_duration_seconds") < 0),
            ("duration_exceeds_one_year", F.col("raw_duration_seconds") > 31536000),
        ),
        # unrounded: the risk rule needs it
        "raw_pps": F.least(F.col("packet_count") / F.greatest(F.col("raw_duration_seconds"), F.lit(0.001)), F.lit(100000.0)),
    })


def tcp_state():
    syn, ack, fin = F.col("syn_count") > 0, F.col("ack_count") > 0, F.col("fin_count") > 0
    return (
        F.when(F.col("transport_layer") != "tcp", "not_tcp")
        .when(F.col("rst_count") > 0, "reset_observed")
        .when(syn & ~ack, "syn_without_ack")
        .when(syn & ack & fin, "closed")
        .when(syn & ack, "established_observed")
        .otherwise("tcp_flags_observed")
    )


def bidirectional_flows(flows: DataFrame) -> DataFrame:
    """Both directions of a conversation by the unordered pair of endpoints."""

    def end(ip, port):
        return F.struct(F.col(ip).alias("ip"), F.col(port).alias("port"))

    a, b = end("initiator_ip", "initiator_port"), end("responder_ip", "responder_port")
    return (
        flows.withColumns({"a": F.least(a, b), "b": F.greatest(a, b)})
        .groupBy("capture_id", "a", "b")
        .agg(
            F.sum("packet_count").alias("total_packets"),
            F.sum(F.col("initiator_bytes") + F.col("responder_bytes")).alias("total_bytes"),
            F.min("first_us").alias("first_us"),
            F.max("last_us").alias("last_us"),
            F.count(F.lit(1)).alias("directional_flows"),
        )
        .select(
            "capture_id", F.col("a.ip").alias("ip_a"), F.col("a.port").alias("port_a"), F.col("b.ip").alias("ip_b"),
            F.col("b.port").alias("port_b"), "total_packets", "total_bytes", "first_us", "last_us", "directional_flows",
        )
    )


def value_entropy(df: DataFrame, part: list[str], value: str, name: str) -> DataFrame:
    """Shannon entropy of a column per group, in bits."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*part, value).agg(F.count(F.lit(1)).alias("n"))
    # -sum(p log p) = log N - sum(n log n)/N, so one pass over the counts is enough
    return counts.groupBy(*part).agg(
        rnd(F.greatest(F.log2(F.sum("n")) - F.sum(F.col("n") * F.log2(F.col("n"))) / F.sum("n"), F.lit(0.0)), 4).alias(name)
    )


def packet_size_stats(packets: DataFrame) -> DataFrame:
    """Size moments and size entropy per flow, from the histogram of sizes.

    A packet has at most 65,535 bytes, so a flow has at most that many histogram rows, however large it is.
    Sums are exact integers; the division comes last.
    """
    hist = packets.groupBy(*KEY, "total_bytes").agg(F.count(F.lit(1)).alias("n"))
    size, n = F.col("total_bytes"), F.col("n")
    dec = "decimal(38,0)"
    sums = hist.groupBy(*KEY).agg(
        F.sum("n").alias("packets"),
        F.sum(size * n).alias("s1"),
        F.sum((size * size).cast("decimal(19,0)") * n.cast("decimal(19,0)")).cast(dec).alias("s2"),
        F.sum(n * F.log2(n)).alias("nlogn"),
    )
    count = F.col("packets").cast("decimal(19,0)")
    moment = (F.col("s2") * count).cast(dec) - (F.col("s1").cast("decimal(19,0)") * F.col("s1").cast("decimal(19,0)"))
    return (
        sums.withColumns({
            "mean_": F.col("s1") / F.col("packets"),
            "var_": moment.cast("double") / F.col("packets") / F.col("packets"),
            "entropy_": F.log2(F.col("packets")) - F.col("nlogn") / F.col("packets"),
        })
        .withColumn("sd_", F.sqrt("var_"))
        .select(
            *KEY,
            rnd(F.col("mean_"), 2).alias("avg_packet_size"),
            rnd(F.col("var_"), 2).alias("packet_size_variance"),
            rnd(F.col("sd_"), 2).alias("packet_size_stddev"),
            rnd(F.when(F.col("mean_") > 0, F.col("sd_") / F.col("mean_")).otherwise(F.lit(0.0)), 4).alias("packet_size_cv"),
            rnd(F.greatest(F.col("entropy_"), F.lit(0.0)), 4).alias("payload_entropy"),
        )
    )


def hot_flows(flows: DataFrame, hot: int = HOT_FLOW_PACKETS) -> DataFrame:
    return flows.where(F.col("packet_count") > hot).select(*KEY)


def _gap_summary(gaps: DataFrame) -> DataFrame:
    """Statistics of gaps of flows that fit a task."""
    gap = F.col("gap").cast("decimal(19,0)")
    return gaps.groupBy(*KEY).agg(
        F.count("gap").alias("n"),
        F.sum("gap").alias("s1"),
        F.sum(gap * gap).alias("s2"),
        F.max("gap").alias("top"),
        F.percentile("gap", 0.5).alias("middle"),
    )


def _hot_gap_summary(ticks: DataFrame) -> DataFrame:
    """The same for flows of any size: seconds are windows of their own, equal gaps are counted first.

    Gaps that differ pairwise add up to less than the capture, so d distinct gaps need d*d/2 microseconds:
    30 days hold at most 2.3 million of them per flow.
    """
    ticks = ticks.groupBy(*KEY, "us").agg(F.count(F.lit(1)).alias("same")).withColumn("second", F.expr("us div 1000000L"))
    inside = Window.partitionBy(*KEY, "second").orderBy("us")
    across = Window.partitionBy(*KEY).orderBy("second")
    seconds = ticks.groupBy(*KEY, "second").agg(F.max("us").alias("hi")).withColumn("before", F.lag("hi").over(across)).drop("hi")
    stepped = ticks.join(seconds, [*KEY, "second"]).withColumn("gap", F.col("us") - F.coalesce(F.lag("us").over(inside), "before"))
    # n packets at one microsecond: one gap to the packet before them, and n - 1 of nothing
    one, rest = F.lit(1).cast("bigint"), F.col("same") - 1
    both = F.array(F.struct(F.col("gap"), one.alias("n")), F.struct(F.lit(0).cast("bigint").alias("gap"), rest.alias("n")))
    gaps = stepped.select(*KEY, F.explode(both).alias("g")).select(*KEY, "g.gap", "g.n").where("gap IS NOT NULL AND n > 0")
    counts = gaps.groupBy(*KEY, "gap").agg(F.sum("n").alias("n"))
    upto = Window.partitionBy(*KEY).orderBy("gap")
    whole = Window.partitionBy(*KEY)
    placed = counts.withColumns({"last_": F.sum("n").over(upto), "all_": F.sum("n").over(whole)})

    def at(position):
        return F.max(F.when((F.col("last_") - F.col("n") < position) & (F.col("last_") >= position), F.col("gap")))

    lower, upper = F.expr("(all_ + 1) div 2"), F.expr("all_ div 2 + 1")
    gap, n = F.col("gap").cast("decimal(19,0)"), F.col("n").cast("decimal(19,0)")
    return placed.groupBy(*KEY).agg(
        F.sum("n").alias("n"),
        F.sum(F.col("gap") * F.col("n")).alias("s1"),
        F.sum((gap * gap * n).cast("decimal(38,0)")).alias("s2"),
        F.max("gap").alias("top"),
        ((at(lower) + at(upper)) / F.lit(2.0)).alias("middle"),
    )


def inter_packet_delay(packets: DataFrame, flows: DataFrame, hot: int = HOT_FLOW_PACKETS) -> DataFrame:
    """Mean, median, largest and deviation of the gaps between packets, in ms. Flows with one packet are left out."""
    narrow = packets.select(*KEY, "us")
    large = hot_flows(flows, hot)
    w = Window.partitionBy(*KEY).orderBy("us")
    gaps = narrow.join(large, KEY, "left_anti").select(*KEY, (F.col("us") - F.lag("us").over(w)).alias("gap")).where("gap IS NOT NULL")
    stats = _gap_summary(gaps).unionByName(_hot_gap_summary(narrow.join(large, KEY, "left_semi")))
    n = F.col("n")
    # s2 - s1 * s1 / n with s1 = q * n + r, so that no product exceeds s1 * s1 and only r * r / n is not an integer
    wide = "decimal(38,0)"
    count, q, r = (F.expr(x).cast("decimal(19,0)") for x in ("n", "s1 div n", "s1 % n"))
    whole = F.col("s2").cast(wide) - ((q * q).cast(wide) * count).cast(wide) - ((q * r).cast(wide) * F.lit(2)).cast(wide)
    rest = r.cast("double") * r.cast("double") / n
    deviation = F.when(n > 1, F.sqrt(F.greatest(whole.cast("double") - rest, F.lit(0.0)) / (n - 1))).otherwise(F.lit(0.0))
    return stats.select(
        *KEY,
        rnd(F.col("s1") / n / F.lit(1000.0), 4).alias("mean_inter_packet_delay_ms"),
        rnd(F.col("middle") / F.lit(1000.0), 4).alias("median_inter_packet_delay_ms"),
        rnd(F.col("top") / F.lit(1000.0), 4).alias("max_inter_packet_delay_ms"),
        rnd(deviation / F.lit(1000.0), 4).alias("inter_arrival_jitter"),
        n.alias("beacon_intervals"),
    )


def rarity_counts(flows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Flows per destination and flows per protocol."""
    by_destination = flows.groupBy("capture_id", "responder_ip").agg(F.count(F.lit(1)).alias("destination_flows"))
    by_protocol = flows.groupBy("capture_id", "application_protocol").agg(F.count(F.lit(1)).alias("protocol_flows"))
    return by_destination, by_protocol


def rarity_context(flows: DataFrame) -> DataFrame:
    """The two counts beside every flow; a destination or protocol of any share of the flows stays spread."""
    by_destination, by_protocol = rarity_counts(flows)
    total = flows.count()
    once = beside(flows, by_destination, ["capture_id", "responder_ip"], "destination_flows", total)
    return beside(once, by_protocol, ["capture_id", "application_protocol"], "protocol_flows", total)


def _rare(flows: DataFrame, columns: list[str], name: str) -> DataFrame:
    """Flows whose value of `columns` occurs at most twice.

    The one or two flow ids travel inside the aggregate, so the flows join by their own key and a
    value shared by most flows never gathers in one task.
    """
    return (
        flows.groupBy(*columns)
        .agg(F.count(F.lit(1)).alias("n"), F.min("flow_id").alias("a"), F.max("flow_id").alias("b"))
        .where("n <= 2")
        .select("capture_id", F.explode(F.array_distinct(F.array("a", "b"))).alias("flow_id"), F.lit(True).alias(name))
    )


@dataclass(frozen=True)
class SuppressionPolicy:
    """Expected infrastructure traffic; every set can be replaced."""

    noisy_protocols: frozenset = field(default_factory=lambda: frozenset({"arp", "dhcp", "llmnr", "mdns", "nbns", "ssdp"}))
    noisy_udp_ports: frozenset = field(default_factory=lambda: frozenset({67, 68, 137, 1900, 5353, 5355}))
    suppressed_directions: frozenset = field(default_factory=lambda: frozenset({"broadcast", "multicast", "loopback"}))


def suppression(flows: DataFrame, policy: SuppressionPolicy = SuppressionPolicy()) -> DataFrame:
    """suppressed, suppression_reason, suppression_category: the first rule that matches."""
    protocol = F.lower("application_protocol")
    ports = F.array_distinct(F.array_compact(F.array("initiator_port", "responder_port")))
    noisy = F.array_sort(F.array_intersect(ports, F.array(*[F.lit(p).cast("int") for p in sorted(policy.noisy_udp_ports)]).cast("array<int>")))
    port_list = F.array_join(F.transform(noisy, lambda p: p.cast("string")), ",")
    reason = (
        F.when(protocol.isin(sorted(policy.noisy_protocols)), F.concat(F.lit("expected_"), protocol, F.lit("_infrastructure_traffic")))
        .when(F.col("direction").isin(sorted(policy.suppressed_directions)), F.concat(F.lit("expected_"), F.col("direction"), F.lit("_traffic")))
        .when(F.col("transport_layer") == "arp", F.lit("expected_arp_resolution"))
        .when((F.col("transport_layer") == "udp") & (F.size(noisy) > 0), F.concat(F.lit("expected_udp_service_port_"), port_list))
        .otherwise("")
    )
    return flows.withColumn("suppression_reason", reason).withColumns({
        "suppressed": F.col("suppression_reason") != "",
        "suppression_category": F.when(F.col("suppression_reason") != "", "infrastructure").otherwise(""),
    })


def beacon_score(frame: DataFrame) -> DataFrame:
    """beacon_score, beacon_confidence and beacon_reason from the rounded timing and size columns."""
    intervals = F.coalesce(F.col("beacon_intervals"), F.lit(0))
    mean = F.col("mean_inter_packet_delay_ms")
    reason = (
        F.when(F.col("packet_count") < MIN_BEACON_PACKETS, F.concat(F.lit("insufficient_packets ("), F.col("packet_count"), F.lit(f" < {MIN_BEACON_PACKETS})")))
        .when(intervals < MIN_BEACON_INTERVALS, F.concat(F.lit("insufficient_intervals ("), intervals, F.lit(f" < {MIN_BEACON_INTERVALS})")))
        .when(mean.isNull() | (mean <= 0), F.lit("missing_timing_data"))
    )

    def steady(cv):
        return F.greatest(F.lit(1.0) - F.least(cv, F.lit(1.5)) / 1.5, F.lit(0.0))

    cv, size_cv = F.col("interval_cv"), F.col("packet_size_cv")
    app = F.col("app_confidence")
    quality = (
        unit(intervals / 50) * 0.30
        + unit(F.greatest(F.col("raw_duration_seconds"), F.lit(0.0)) / 3600) * 0.20
        + F.greatest(F.lit(1.0) - F.least(cv, F.lit(2.0)) / 2, F.lit(0.0)) * 0.20
        + F.least(F.greatest(app, F.lit(0.2)), F.lit(0.95)) * 0.15
        + unit(F.col("packet_count") / 100) * 0.15
    ) * F.when(app >= 0.85, F.lit(0.88)).otherwise(F.lit(1.0))
    two_digits = "%.2f"
    return (
        frame.withColumn("beacon_gap", reason)
        .withColumn("interval_cv", F.when(F.col("beacon_gap").isNull(), F.col("inter_arrival_jitter") / mean))
        .withColumns({
            "beacon_score": F.when(F.col("beacon_gap").isNull(), rnd(steady(cv) * 0.7 + steady(size_cv) * 0.3, 4)),
            "beacon_confidence": F.when(F.col("beacon_gap").isNull(), rnd(F.least(quality, F.lit(0.82)), 4)),
            "beacon_reason": F.coalesce(
                "beacon_gap",
                F.concat(F.lit("periodicity_cv="), F.format_string(two_digits, rnd(cv, 2)), F.lit(";payload_cv="), F.format_string(two_digits, rnd(size_cv, 2))),
            ),
        })
        .drop("beacon_gap", "interval_cv")
    )


# Indicator names in the order in which they are reported.
FLOW_INDICATORS = [
    "potential_beaconing_behavior",
    "periodic_low_volume_communication",
    "external_communication",
    "low_frequency_destination",
    "unusual_protocol_context",
    "unusual_remote_service_port",
    "upload_heavy_asymmetry",
    "tcp_syn_without_ack",
    "tcp_reset_observed",
]


def behavioral_risk(frame: DataFrame) -> DataFrame:
    """behavioral_score, suspicious_indicators, indicator_details. Needs beacon_score and the rarity flags."""
    tcp = F.col("transport_layer") == "tcp"

    def points(condition, value):
        return F.when(condition, F.lit(float(value)) if isinstance(value, int) else value)

    values = [
        points(F.col("beacon_score") >= PERIODIC_SCORE, F.col("beacon_score") * 30),
        points((F.col("raw_duration_seconds") >= 300) & (F.col("packet_count") >= 10) & (F.col("raw_pps") < 0.2), 18),
        points(F.col("direction").isin("outbound", "inbound", "external"), 12),
        points(F.col("direction").isin("outbound", "external") & F.col("rare_destination"), 12),
        points(F.col("application_protocol").isin("unknown", "irc") | F.col("rare_protocol"), 10),
        points(F.col("responder_port").isin(UNUSUAL_PORTS), 18),
        points((F.col("initiator_bytes") > 1_000_000) & (F.col("data_ratio") < 0.25), 16),
        points(tcp & (F.col("tcp_state_summary") == "syn_without_ack"), 12),
        points(tcp & (F.col("tcp_state_summary") == "reset_observed"), 12),
    ]
    pairs = F.filter(
        F.array(*[F.struct(F.lit(n).alias("name"), v.alias("points")) for n, v in zip(FLOW_INDICATORS, values)]),
        lambda x: x["points"].isNotNull(),
    )
    total = F.aggregate(F.col("pairs"), F.lit(0.0), lambda acc, x: acc + x["points"])
    enough = F.size("pairs") >= 2
    none = F.filter(F.col("pairs"), lambda x: F.lit(False))
    return (
        frame.withColumn("pairs", pairs)
        .withColumn("behavioral_score", F.when(enough, rnd(F.least(total, F.lit(100.0)), 2)).otherwise(F.lit(0.0)))
        .withColumn("pairs", F.when(enough, F.col("pairs")).otherwise(none))
        .withColumns({
            "suspicious_indicators": F.transform("pairs", lambda x: x["name"]),
            "indicator_details": F.map_from_entries(F.transform("pairs", lambda x: F.struct(x["name"], rnd(x["points"], 4)))),
        })
        .drop("pairs")
    )


def weak_confidence():
    q = (
        unit(F.coalesce(F.col("beacon_intervals"), F.lit(0)) / 30) * 0.35
        + unit(F.greatest(F.col("raw_duration_seconds"), F.lit(0.0)) / 1800) * 0.25
        + unit(F.col("packet_count") / 50) * 0.25
        + 0.10
    )
    return rnd(F.least(q, F.lit(0.70)), 4)


def throughput(frame: DataFrame) -> DataFrame:
    total = F.col("initiator_bytes") + F.col("responder_bytes")
    return frame.withColumns({
        "packets_per_second": rnd(F.col("raw_pps"), 4),
        "bytes_per_second": rnd(F.least(total / F.col("duration_seconds"), F.lit(1e9)), 4),
        "data_ratio": ratio(F.col("responder_bytes"), F.col("initiator_bytes")),
    })


def enriched_flows(packets: DataFrame, flows: DataFrame, policy: SuppressionPolicy = SuppressionPolicy(), hot: int = HOT_FLOW_PACKETS) -> DataFrame:
    """Flows with size, timing, entropy, suppression and scores. All side tables share the key of the flows."""
    ports_differ = F.col("initiator_port").isNotNull() & (F.col("initiator_port") != F.col("responder_port"))
    frame = (
        flows.join(packet_size_stats(packets), KEY, "left")
        .join(inter_packet_delay(packets, flows, hot), KEY, "left")
        .join(_rare(flows, ["capture_id", "responder_ip"], "rare_destination"), KEY, "left")
        .join(_rare(flows, ["capture_id", "application_protocol"], "rare_protocol"), KEY, "left")
    )
    frame = throughput(frame).withColumns({
        "beacon_intervals": F.coalesce("beacon_intervals", F.lit(0)).cast("bigint"),
        # every packet of a directional flow has the same two ports
        "port_entropy": F.when(ports_differ, F.lit(1.0)).otherwise(F.lit(0.0)),
        "protocol_diversity": flag(F.col("application_protocol") != ""),
        "rare_destination": F.coalesce("rare_destination", F.lit(False)),
        "rare_protocol": F.coalesce("rare_protocol", F.lit(False)),
    })
    frame = behavioral_risk(beacon_score(suppression(frame, policy)))
    quiet = F.col("suppressed")
    no_score = F.lit(None).cast("double")
    return (
        frame.withColumns({
            "confidence": F.when(quiet, F.lit(0.0)).otherwise(F.coalesce(F.nullif("beacon_confidence", F.lit(0.0)), weak_confidence())),
            "beacon_score": F.when(quiet, no_score).otherwise(F.col("beacon_score")),
            "beacon_confidence": F.when(quiet, no_score).otherwise(F.col("beacon_confidence")),
            "beacon_reason": F.when(quiet, F.col("suppression_reason")).otherwise(F.col("beacon_reason")),
            "behavioral_score": F.when(quiet, F.lit(0.0)).otherwise(F.col("behavioral_score")),
            "suspicious_indicators": F.when(quiet, F.array().cast("array<string>")).otherwise(F.col("suspicious_indicators")),
            "indicator_details": F.when(quiet, F.create_map().cast("map<string,double>")).otherwise(F.col("indicator_details")),
        })
        .withColumns({
            "severity": ladders.flow_severity(F.col("behavioral_score"), F.col("confidence")),
            "is_suspicious": (F.col("behavioral_score") >= 35) & (F.col("confidence") >= 0.20),
            "is_periodic": F.coalesce(F.col("beacon_score") >= PERIODIC_SCORE, F.lit(False)),
        })
        .drop("raw_pps", "rare_destination", "rare_protocol")
    )


def traffic_direction_summary(flows: DataFrame) -> DataFrame:
    return flows.groupBy("capture_id", "direction").agg(F.count(F.lit(1)).alias("flows"))


def protocol_summary(flows: DataFrame, top: int | None = 10) -> DataFrame:
    w = Window.partitionBy("capture_id").orderBy(F.desc("flows"), "application_protocol")
    counted = flows.groupBy("capture_id", "application_protocol").agg(F.count(F.lit(1)).alias("flows"))
    return counted.withColumn("place", F.row_number().over(w)).where(within("place", top))


def suspicious_flows(enriched: DataFrame, top: int | None = 5) -> DataFrame:
    w = Window.partitionBy("capture_id").orderBy(F.desc("behavioral_score"), "first_us", "first_seen_sequence")
    return enriched.where("is_suspicious").withColumn("place", F.row_number().over(w)).where(within("place", top))
