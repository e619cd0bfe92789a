"""Readers for tables of dissected packets, and the projection of an event stream into packets."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.functions import protocols
from netloom.functions.times import normalize_timestamp, ntz_to_us

TCP_FLAGS = "struct<syn:boolean,ack:boolean,rst:boolean,fin:boolean,psh:boolean,urg:boolean,ece:boolean,cwr:boolean>"
PACKET_SCHEMA = f"""
    capture_id string, packet_index bigint, us bigint, src_ip string, dst_ip string, transport string,
    src_port int, dst_port int, ttl int, total_bytes bigint, tcp_flags {TCP_FLAGS}, layer string,
    tls_sni string, http_host string, dns_query string, tls_alpn string, src_mac string, dst_mac string,
    nbns_name string, kerberos_cname string
"""


def read_packets(spark: SparkSession, path: str | list[str], fmt: str = "parquet", **options) -> DataFrame:
    """Packets of one or many captures, from Parquet, JSON or CSV files; a row without a capture id takes the name of its file.

    Parquet has the columns of PACKET_SCHEMA. JSON and CSV have them too, but for these: a time is `us`, or `timestamp` as ISO
    text; flags are `tcp_flags` as text of labels, or flat columns `tcp_syn` and so on of 0 and 1. Numbers of JSON and CSV
    are read as text, so that a malformed field drops its packet later and not the file.
    """
    reader = spark.read.format(fmt).options(**({"header": "true"} | options if fmt == "csv" else options))
    name = F.coalesce("capture_id", F.col("_metadata.file_name"))
    if fmt == "parquet":
        return reader.schema(PACKET_SCHEMA).load(path).withColumn("capture_id", name)
    columns = [f.split() for f in PACKET_SCHEMA.replace(TCP_FLAGS, "string").split(",")]
    flat = {flag: f"tcp_{flag}" for flag in protocols.FLAG_LABELS}
    wide = ", ".join([*(f"{column} string" for column, _ in columns), "timestamp string", *(f"{c} string" for c in flat.values())])
    if fmt == "csv":  # columns by the names of the header, which all files share
        raw = reader.load(path).select("*", "_metadata.file_name")
        absent = [f.split()[0] for f in wide.split(", ") if f.split()[0] not in raw.columns]
        raw = raw.select("*", *[F.lit(None).cast("string").alias(n) for n in absent])
        raw = raw.withColumn("capture_id", F.coalesce("capture_id", "file_name"))
    else:
        raw = reader.schema(wide).load(path).withColumn("capture_id", name)
    flags = protocols.tcp_flags(F.col("tcp_flags"), {flag: F.col(c) for flag, c in flat.items()})
    known = F.coalesce("tcp_flags", *flat.values()).isNotNull()
    return raw.select(*[
        F.when(known, flags).alias(c) if c == "tcp_flags"
        else F.coalesce(F.expr("try_cast(us AS bigint)"), normalize_timestamp(F.col("timestamp"))).alias(c) if c == "us"
        else F.expr(f"try_cast({c} AS {kind})").alias(c) if c == "packet_index"
        else F.col(c)
        for c, kind in columns
    ])


# The stream is 30 days long; it is squeezed by 240 into a capture of three hours.
_TIME = f"1704067200000000 + ({ntz_to_us('ts')} - 1704067200000000) div 240"
_RULE = """
    CASE WHEN id % 1000 = 999 THEN 'self' WHEN r < 3 THEN 'beacon' WHEN et = 'click' THEN 'click'
         WHEN et = 'view' THEN 'view' WHEN et = 'purchase' THEN 'purchase' WHEN et = 'signup' THEN 'signup'
         WHEN et = 'error' AND k < 50 THEN 'reply' WHEN k < 60 THEN 'nbns' WHEN k < 70 THEN 'mdns'
         WHEN k < 80 THEN 'dhcp' WHEN k < 89 THEN 'arp' WHEN k = 89 THEN 'arp0' ELSE 'odd' END
"""
# rule -> source, destination, transport, source port, destination port
_ENDPOINTS = {
    "self": ("'127.0.0.1'", "'127.0.0.1'", "tcp", "8080", "8080"),
    "beacon": ("concat('10.2.0.', 11 + r)", "concat('45.131.214.', 85 + r)", "tcp", "50000 + r", "443"),
    "click": ("hub", "concat('52.224.', k % 10, '.', u % 20 + 1)", "tcp", "40000 + u % 1000", "443"),
    "view": ("hub", "concat('93.184.', k % 5, '.34')", "tcp", "41000 + k % 4", "80"),
    "purchase": ("hub", "concat('10.2.28.', 2 + k % 2)", "tcp", "42000 + k % 3", "element_at(array(445, 389, 88, 53), k % 4 + 1)"),
    "signup": ("hub", "'10.2.28.2'", "udp", "50100 + k % 8", "53"),
    "reply": ("concat('52.224.', k % 10, '.', u % 20 + 1)", "hub", "tcp", "443", "40000 + u % 1000"),
    "nbns": ("hub", "'10.2.28.255'", "udp", "137", "137"),
    "mdns": ("hub", "'224.0.0.251'", "udp", "5353", "5353"),
    "dhcp": ("hub", "'255.255.255.255'", "udp", "68", "67"),
    "arp": ("hub", "'10.2.28.1'", "arp", None, None),
    "arp0": ("hub", "'0.0.0.0'", "arp", None, None),
    "odd": ("hub", "concat('185.220.101.', 1 + u % 30)", "tcp", "43000", "4444"),
}


def _by_rule(position: int) -> str:
    branches = " ".join(
        f"WHEN '{rule}' THEN {ends[position]}" for rule, ends in _ENDPOINTS.items() if ends[position] is not None
    )
    return f"CASE rule {branches} END"


def packets_from_events(events: DataFrame) -> DataFrame:
    """Every event becomes one packet; a narrow projection that needs no shuffle."""
    ends = events.selectExpr(
        "event_id AS id", "user_id AS u", "event_type AS et", "cast(get_json_object(props, '$.k') AS int) AS k",
        "event_id % 40 AS r", f"{_TIME} AS us", "concat('10.2.', 1 + user_id div 250, '.', 1 + user_id % 250) AS hub",
    ).withColumn("rule", F.expr(_RULE)).selectExpr(
        "*", f"{_by_rule(0)} AS src_ip", f"{_by_rule(1)} AS dst_ip",
        "CASE WHEN rule IN ('signup', 'nbns', 'mdns', 'dhcp') THEN 'udp' WHEN rule IN ('arp', 'arp0') THEN 'arp' ELSE 'tcp' END AS transport",
        f"cast({_by_rule(3)} AS int) AS src_port", f"cast({_by_rule(4)} AS int) AS dst_port",
    )
    return ends.selectExpr(
        "'cap0' AS capture_id", "id AS packet_index", "us", "src_ip", "dst_ip", "transport", "src_port", "dst_port", "64 AS ttl",
        "cast(CASE WHEN r < 3 THEN 120 + k % 5 ELSE 60 + k * 14 END AS bigint) AS total_bytes",
        """CASE WHEN transport = 'tcp' THEN named_struct(
            'syn', id % 8 = 0, 'ack', id % 8 <> 0, 'rst', dst_port = 4444 AND k % 2 = 0, 'fin', id % 16 = 15,
            'psh', k % 3 = 0, 'urg', false, 'ece', false, 'cwr', false) END AS tcp_flags""",
        "CASE WHEN transport = 'arp' THEN 'ARP' WHEN dst_port = 443 AND k % 2 = 0 THEN 'TLS' END AS layer",
        "CASE WHEN r >= 3 AND et = 'click' THEN concat('site', k % 10, '.example.com') END AS tls_sni",
        "CASE WHEN r >= 3 AND et = 'view' THEN concat('http://Web', k % 5, '.example.su/x') END AS http_host",
        "CASE WHEN r >= 3 AND et = 'signup' THEN concat('host', k, '.corp.local.') END AS dns_query",
        "CASE WHEN r >= 3 AND et = 'click' AND k % 2 = 0 THEN 'h2' END AS tls_alpn",
        "concat('02:00:00:00:', lpad(cast(u div 100 AS string), 2, '0'), ':', lpad(cast(u % 100 AS string), 2, '0')) AS src_mac",
        "CASE WHEN dst_ip IN ('255.255.255.255', '10.2.28.255') THEN 'ff:ff:ff:ff:ff:ff' END AS dst_mac",
        "CASE WHEN dst_port = 137 THEN concat('DESKTOP-', u, '<00>') END AS nbns_name",
        "CASE WHEN dst_port = 88 THEN concat('user', u) END AS kerberos_cname",
    )
