"""Protocol names from decoded layers and ports."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Top layer -> (protocol, confidence), the weaker inference.
LAYER_INFERENCE = {
    "HTTP": ("http", 0.95),
    "HTTPS": ("https", 0.95),
    "TLS": ("https", 0.90),
    "SSL": ("https", 0.85),
    "DNS": ("dns", 0.95),
    "MDNS": ("mdns", 0.95),
    "NBNS": ("nbns", 0.95),
    "LLMNR": ("llmnr", 0.95),
    "SSDP": ("ssdp", 0.95),
    "DHCP": ("dhcp", 0.95),
    "BOOTP": ("dhcp", 0.95),
    "ARP": ("arp", 0.95),
    "SMB": ("smb", 0.90),
    "NBSS": ("smb", 0.85),
    "FTP": ("ftp", 0.90),
    "SSH": ("ssh", 0.95),
    "TELNET": ("telnet", 0.90),
    "SMTP": ("smtp", 0.90),
    "POP": ("pop", 0.90),
    "IMAP": ("imap", 0.90),
    "KERBEROS": ("kerberos", 0.95),
    "LDAP": ("ldap", 0.90),
    "ICMP": ("icmp", 0.95),
}
# Port -> (protocol, confidence), the weaker inference.
UDP_INFERENCE = {
    53: ("dns", 0.75),
    67: ("dhcp", 0.85),
    68: ("dhcp", 0.85),
    137: ("nbns", 0.85),
    1900: ("ssdp", 0.85),
    5353: ("mdns", 0.85),
    5355: ("llmnr", 0.85),
}
TCP_INFERENCE = {
    22: ("ssh", 0.70),
    25: ("smtp", 0.70),
    80: ("http", 0.70),
    110: ("pop", 0.70),
    143: ("imap", 0.70),
    443: ("https", 0.70),
    445: ("smb", 0.70),
}
# Top layer -> (protocol, confidence), the stronger enrichment.
LAYER_ENRICHMENT = {
    "HTTP": ("http", 0.96),
    "HTTP2": ("http2", 0.92),
    "TLS": ("https", 0.92),
    "SSL": ("https", 0.86),
    "DNS": ("dns", 0.96),
    "MDNS": ("mdns", 0.96),
    "NBNS": ("nbns", 0.96),
    "LLMNR": ("llmnr", 0.96),
    "SSDP": ("ssdp", 0.96),
    "DHCP": ("dhcp", 0.96),
    "BOOTP": ("dhcp", 0.96),
    "ARP": ("arp", 0.96),
    "SMB": ("smb", 0.92),
    "NBSS": ("smb", 0.86),
    "KERBEROS": ("kerberos", 0.92),
    "LDAP": ("ldap", 0.88),
    "ICMP": ("icmp", 0.95),
}
# Transport and port -> (protocol, confidence), the stronger enrichment.
PORT_ENRICHMENT = {
    "tcp": {
        20: ("ftp_data", 0.62),
        21: ("ftp", 0.68),
        22: ("ssh", 0.72),
        25: ("smtp", 0.68),
        53: ("dns", 0.64),
        80: ("http", 0.72),
        110: ("pop", 0.66),
        123: ("ntp", 0.62),
        135: ("msrpc", 0.70),
        139: ("netbios_session", 0.70),
        143: ("imap", 0.66),
        389: ("ldap", 0.70),
        443: ("https", 0.74),
        445: ("smb", 0.74),
        465: ("smtps", 0.68),
        587: ("smtp_submission", 0.66),
        636: ("ldaps", 0.70),
        993: ("imaps", 0.68),
        995: ("pops", 0.68),
        3389: ("rdp", 0.74),
    },
    "udp": {
        53: ("dns", 0.78),
        67: ("dhcp", 0.86),
        68: ("dhcp", 0.86),
        123: ("ntp", 0.72),
        137: ("nbns", 0.86),
        138: ("netbios_datagram", 0.80),
        161: ("snmp", 0.70),
        162: ("snmptrap", 0.68),
        1900: ("ssdp", 0.86),
        5353: ("mdns", 0.88),
        5355: ("llmnr", 0.88),
    },
}
# Top layer -> transport when the IP protocol number does not tell.
LAYER_TRANSPORT = {"TCP": "tcp", "UDP": "udp", "ICMP": "icmp", "IGMP": "igmp", "ARP": "arp"}
IP_PROTO_TRANSPORT = {"6": "tcp", "17": "udp", "1": "icmp"}


MATCH = "struct<weak:string,weak_confidence:double,strong:string,strong_confidence:double>"


def _match(weak, strong) -> Column:
    w, s = weak or (None, None), strong or (None, None)
    return F.struct(
        F.lit(w[0]).alias("weak"), F.lit(w[1]).alias("weak_confidence"), F.lit(s[0]).alias("strong"), F.lit(s[1]).alias("strong_confidence")
    ).cast(MATCH)


def _matches(weak: dict, strong: dict) -> Column:
    """Literal map from a key to what the weaker and the stronger table say about it."""
    entries = []
    for key in dict.fromkeys([*weak, *strong]):
        entries += [F.lit(key), _match(weak.get(key), strong.get(key))]
    return F.create_map(*entries)


def _by_port(tables: dict) -> dict:
    return {f"{t}/{port}": found for t, ports in tables.items() for port, found in ports.items()}


def _text_map(table: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def with_matches(df: DataFrame, layer: str, transport: str, src_port: str, dst_port: str) -> DataFrame:
    """Columns layer_match, dst_match, src_match, transport_match: one lookup each, used by both rules."""
    ports = _matches(_by_port({"tcp": TCP_INFERENCE, "udp": UDP_INFERENCE}), _by_port(PORT_ENRICHMENT))

    def port_match(port):
        return F.try_element_at(ports, F.concat(F.col(transport), F.lit("/"), F.col(port).cast("string")))

    known = _matches({"arp": ("arp", 0.95), "icmp": ("icmp", 0.95)}, {"arp": ("arp", 0.96), "icmp": ("icmp", 0.95)})
    return df.withColumns({
        "layer_match": F.try_element_at(_matches(LAYER_INFERENCE, LAYER_ENRICHMENT), F.upper(layer)),
        "dst_match": port_match(dst_port),
        "src_match": port_match(src_port),
        "transport_match": F.try_element_at(known, F.col(transport)),
    })


MATCHES = ["layer_match", "dst_match", "src_match", "transport_match"]


def _first(kind: str, default) -> Column:
    return F.coalesce(*[F.col(f"{m}.{kind}") for m in MATCHES], F.lit(default))


def inferred_name() -> Column:
    """The weaker rule: layer, then destination port, source port, transport."""
    return _first("weak", "unknown")


def inferred_confidence() -> Column:
    return _first("weak_confidence", 0.0)


def enriched_name() -> Column:
    """The stronger rule, in the same order."""
    return _first("strong", "unknown")


def enriched_confidence() -> Column:
    return _first("strong_confidence", 0.0)


def enrichment_kind() -> Column:
    """Where the stronger name came from."""
    return (
        F.when(F.col("layer_match.strong").isNotNull(), "decoded_layer")
        .when(F.coalesce("dst_match.strong", "src_match.strong").isNotNull(), "port_inference")
        .when(F.col("transport_match.strong").isNotNull(), "transport_inference")
        .otherwise("none")
    )


def enrichment_evidence(layer: str, transport: str, src_port: str, dst_port: str) -> Column:
    """One-element array, or an empty one when nothing matched."""

    def port_evidence(port):
        return F.concat(F.lit("well_known_port:"), F.col(transport), F.lit("/"), F.col(port).cast("string"))

    text = (
        F.when(F.col("layer_match.strong").isNotNull(), F.concat(F.lit("decoded_layer:"), F.lower(layer)))
        .when(F.col("dst_match.strong").isNotNull(), port_evidence(dst_port))
        .when(F.col("src_match.strong").isNotNull(), port_evidence(src_port))
        .when(F.col("transport_match.strong").isNotNull(), F.concat(F.lit("transport:"), F.col(transport)))
    )
    return F.array_compact(F.array(text))


def transport_protocol(ip_proto: Column, layer: Column) -> Column:
    return F.coalesce(
        F.try_element_at(_text_map(IP_PROTO_TRANSPORT), ip_proto.cast("string")),
        F.try_element_at(_text_map(LAYER_TRANSPORT), F.upper(layer)),
        F.lit("unknown"),
    )


FLAG_LABELS = {"syn": "SYN", "ack": "ACK", "rst": "RST", "fin": "FIN", "psh": "PSH", "urg": "URG", "ece": "ECE", "cwr": "CWR"}


def tcp_flags(label_text: Column, bits: dict) -> Column:
    """Struct of 8 booleans from a label text and/or 0-1 fields."""
    upper = F.upper(F.coalesce(label_text, F.lit("")))
    return F.struct(
        *[
            (upper.contains(label) | F.coalesce(bits[name].cast("string") == "1", F.lit(False))).alias(name)
            for name, label in FLAG_LABELS.items()
        ]
    )
