"""Packets to canonical events: validity, protocols, direction, flow key, sequence and time order."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netloom.functions import ip, protocols
from netloom.functions.numeric import rnd
from netloom.operators.ordered import global_rank


def payload_bytes(total, transport):
    header = F.when(transport == "tcp", 40).when(transport == "udp", 28).otherwise(20)
    return F.when(transport == "arp", F.lit(0)).otherwise(F.greatest(total - header, F.lit(0))).cast("bigint")


def flow_id(src_ip, dst_ip, src_port, dst_port, transport):
    def port(p):
        return F.coalesce(p, F.lit(0)).cast("string")

    key = F.concat(src_ip, F.lit(":"), port(src_port), F.lit("->"), dst_ip, F.lit(":"), port(dst_port), F.lit("("), transport, F.lit(")"))
    return F.substring(F.md5(key), 1, 16)


def first_filled(*values):
    """First value that is neither null nor empty."""
    return F.coalesce(*[F.when(v != "", v) for v in values])


def layer_metadata(frame: DataFrame, pairs: dict) -> DataFrame:
    """Names from the first filled field of each pair, and one evidence tag per name found."""
    frame = frame.withColumns({name: first_filled(*[F.col(c) for c in fields]) for name, fields in pairs.items()})
    return frame.withColumn("metadata_evidence", metadata_evidence(list(pairs)))


def metadata_evidence(names):
    return F.array_compact(F.array(*[F.when(F.col(n) != "", n) for n in names]))


def protocol_merge(df: DataFrame) -> DataFrame:
    """application_protocol and app_confidence: the enrichment wins when it knows, or when nobody does."""
    use = (F.col("enriched_name") != "unknown") | (F.col("inferred_name") == "unknown")
    return df.withColumns({
        "application_protocol": F.when(use, F.col("enriched_name")).otherwise(F.col("inferred_name")),
        "app_confidence": F.when(use, F.col("enriched_confidence")).otherwise(F.col("inferred_confidence")),
    })


def application_protocols(df: DataFrame, transport: str = "transport_layer") -> DataFrame:
    """Both rules and their merge, with the evidence for the name."""
    ends = ("layer", transport, "src_port", "dst_port")
    named = protocols.with_matches(df, *ends).withColumns({
        "inferred_name": protocols.inferred_name(),
        "inferred_confidence": protocols.inferred_confidence(),
        "enriched_name": protocols.enriched_name(),
        "enriched_confidence": protocols.enriched_confidence(),
        "enrichment_kind": protocols.enrichment_kind(),
        "enrichment_evidence": protocols.enrichment_evidence(*ends),
    })
    return protocol_merge(named.drop(*protocols.MATCHES))


def packet_validity(raw: DataFrame) -> DataFrame:
    """Typed columns and `valid`: a field that does not parse, or no IPv4/ARP layer, drops the packet.

    Fragments have no ports; they stay, with null ports.
    """
    transport = F.coalesce(F.col("transport"), protocols.transport_protocol(F.lit(None), F.col("layer")))
    with_ports = transport.isin("tcp", "udp")

    def number(name, kind):
        return F.expr(f"try_cast({name} AS {kind})")

    typed = raw.withColumns({
        "transport_layer": transport,
        "network_ok": F.col("src_ip").isNotNull() & F.col("dst_ip").isNotNull(),
        "bytes_": number("total_bytes", "bigint"),
        "sport_": number("src_port", "int"),
        "dport_": number("dst_port", "int"),
        "ttl_": number("ttl", "int"),
    })
    parses = {name: F.col(name).isNull() | F.col(typed_).isNotNull() for name, typed_ in (("src_port", "sport_"), ("dst_port", "dport_"), ("ttl", "ttl_"))}
    ports_ok = ~with_ports | (parses["src_port"] & parses["dst_port"])
    return typed.withColumn(
        "valid", F.col("network_ok") & F.col("us").isNotNull() & F.col("bytes_").isNotNull() & ports_ok & parses["ttl"]
    )


def normalize_packets(raw: DataFrame) -> DataFrame:
    """Canonical packets: one narrow stage, no shuffle."""
    p = packet_validity(raw).where("valid")
    arp = F.col("transport_layer") == "arp"
    with_ports = F.col("transport_layer").isin("tcp", "udp")
    names = ["tls_sni", "tls_alpn", "http_host", "dns_query"]
    p = p.withColumns({
        "src_port": F.when(with_ports, F.col("sport_")),
        "dst_port": F.when(with_ports, F.col("dport_")),
        "ttl": F.when(~arp, F.col("ttl_")),
        "total_bytes": F.col("bytes_"),
        "tcp_flags": F.when(F.col("transport_layer") == "tcp", F.col("tcp_flags")),
        **{n: F.when(~arp & (F.col(n) != ""), F.col(n)) for n in names},
    })
    t, sp, dp = (F.col(c) for c in ("transport_layer", "src_port", "dst_port"))
    p = application_protocols(ip.with_direction(p, "src_ip", "dst_ip"))
    return p.select(
        "capture_id", "packet_index", F.col("packet_index").alias("replay_sequence_id"), "us", "src_ip", "dst_ip",
        "ttl", "transport_layer", "src_port", "dst_port", "tcp_flags",
        payload_bytes(F.col("total_bytes"), t).alias("payload_bytes"), "total_bytes",
        F.when(arp, F.lit("arp")).otherwise(F.col("application_protocol")).alias("application_protocol"),
        F.when(arp, F.lit(0.95)).otherwise(F.col("app_confidence")).alias("app_confidence"),
        F.when(arp, F.lit("transport_inference")).otherwise(F.col("enrichment_kind")).alias("protocol_enrichment"),
        F.when(arp, F.array(F.lit("transport:arp")))
        .otherwise(F.concat("enrichment_evidence", metadata_evidence(names)))
        .alias("protocol_evidence"),
        *names, "src_mac", "dst_mac",
        *[F.when(~arp, first_filled(F.col(c))).alias(c) for c in ("nbns_name", "kerberos_cname")],
        "direction",
        flow_id(F.col("src_ip"), F.col("dst_ip"), sp, dp, t).alias("flow_id"),
    )


def normalization_counts(raw: DataFrame) -> DataFrame:
    return packet_validity(raw).groupBy("capture_id").agg(
        F.count(F.lit(1)).alias("packets"),
        F.count_if("valid").alias("normalized"),
        F.count_if(~F.coalesce(F.col("valid"), F.lit(False))).alias("failed"),
    )


def timeline_index(packets: DataFrame, **limits) -> DataFrame:
    """0-based place of every packet in its capture by (time, sequence)."""
    return global_rank(packets, ["capture_id"], PACKET_LEVELS, ["us", "replay_sequence_id"], "timeline_index", **limits)


# Order-preserving cuts of (us, sequence): a second, then a microsecond, then a block of the sequence.
PACKET_LEVELS = ["us div 1000000L", "us", "replay_sequence_id div 65536L"]


def chronology_warning(packets: DataFrame) -> DataFrame:
    """True for captures in which sequence order differs from time order.

    Time order agrees with sequence order exactly when no packet is earlier than the latest packet
    of all lower sequence blocks, and none is earlier than its neighbour inside its block.
    """
    block = F.expr("replay_sequence_id div 65536L")
    in_block = Window.partitionBy("capture_id", "block").orderBy("replay_sequence_id")
    blocks = (
        packets.select("capture_id", "replay_sequence_id", "us", block.alias("block"))
        .withColumn("back", F.col("us") < F.lag("us").over(in_block))
        .groupBy("capture_id", "block")
        .agg(F.min("us").alias("lo"), F.max("us").alias("hi"), F.max("back").alias("back"))
    )
    before = Window.partitionBy("capture_id").orderBy("block")
    return (
        blocks.withColumn("across", F.col("lo") < F.lag("hi").over(before))
        .groupBy("capture_id")
        .agg(F.coalesce(F.max(F.coalesce("back", F.lit(False)) | F.coalesce("across", F.lit(False))), F.lit(False)).alias("out_of_order"))
    )


def capture_duration(packets: DataFrame) -> DataFrame:
    span = (F.max("us") - F.min("us")) / F.lit(1e6)
    return packets.groupBy("capture_id").agg(
        F.when(F.count(F.lit(1)) < 2, F.lit(0.0)).otherwise(rnd(span, 4)).alias("capture_duration_seconds")
    )
