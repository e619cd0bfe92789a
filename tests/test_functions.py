"""Scalar functions and score formulas against hand-made values."""

import hashlib

import ipaddress

import pytest
from pyspark.sql import functions as F

from netloom.functions import ip, ladders, text
from netloom.functions.numeric import rnd
from netloom.functions.times import normalize_timestamp, us_to_iso
from netloom.operators import findings as fi
from netloom.operators import narratives as na
from netloom.operators import packets as pk


def rows(spark, schema, values):
    return spark.createDataFrame(values, schema)


ADDRESSES = {
    "127.0.0.1": "loopback", "169.254.3.4": "link_local", "255.255.255.255": "broadcast", "0.0.0.0": "this_network", "224.0.0.251": "multicast",
    "240.1.2.3": "reserved", "10.1.2.3": "internal", "172.16.0.1": "internal", "172.32.0.1": "external", "192.168.9.9": "internal", "8.8.8.8": "external",
    "bad": "error", "1.2.3": "error", "256.1.1.1": "error", "01.2.3.4": "error", "": "error",
}


def test_ip_class(spark):
    df = ip.with_numbers(rows(spark, "ip string", [(a,) for a in ADDRESSES]), num="ip").select("ip", ip.ip_class(F.col("num")).alias("k"))
    assert {r.ip: r.k for r in df.collect()} == ADDRESSES


def test_private_agrees_with_python(spark):
    some = [a for a, k in ADDRESSES.items() if k != "error"] + ["192.0.0.9", "192.0.0.10", "192.0.0.8", "192.0.2.7", "198.18.0.1", "198.19.255.255", "198.20.0.0",
                                                               "198.51.100.4", "203.0.113.9", "100.64.0.1", "11.0.0.0", "239.1.1.1"]
    df = ip.with_numbers(rows(spark, "ip string", [(a,) for a in some]), num="ip").select("ip", ip.is_private(F.col("num")).alias("p"))
    for r in df.collect():
        assert r.p == ipaddress.ip_address(r.ip).is_private, r.ip


@pytest.mark.parametrize("src, dst, want", [
    ("8.8.8.8", "1.1.1.1", "external"), ("bad", "10.0.0.1", "error"), ("10.0.0.1", "8.8.8.8", "outbound"), ("8.8.8.8", "10.0.0.1", "inbound"),
    ("10.0.0.1", "255.255.255.255", "broadcast"), ("127.0.0.1", "224.0.0.1", "multicast"), ("127.0.0.1", "10.0.0.1", "loopback"), ("10.0.0.1", "0.0.0.0", "unknown"),
])
def test_direction(spark, src, dst, want):
    assert ip.with_direction(rows(spark, "s string, d string", [(src, dst)]), "s", "d").first().direction == want


def test_timestamps(spark):
    given = ["2024-01-01T00:00:00", "2024-01-01T00:00:00Z", "2024-01-01T02:00:00+02:00", "2024-07-01T00:00:00.500000Z", "no time"]
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got = [r[0] for r in rows(spark, "t string", [(g,) for g in given]).select(normalize_timestamp(F.col("t"))).collect()]
        back = rows(spark, "us bigint", [(got[3],), (got[0],)]).select(us_to_iso("us")).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got[:3] == [1704067200000000] * 3 and got[4] is None
    assert [b[0] for b in back] == ["2024-07-01T00:00:00.500000Z", "2024-01-01T00:00:00Z"]


def test_text(spark):
    df = rows(spark, "a string", [("http://Web1.Example.su/x",), (" host.corp.local. ",), ("/",), (None,)])
    assert [r[0] for r in df.select(text.normalize_domain(F.col("a"))).collect()] == ["web1.example.su", "host.corp.local", None, None]
    names = rows(spark, "a string", [("DESKTOP-1<00>, x",), ("WORKGROUP<1e>",), ("<00>",)])
    assert [tuple(r) for r in names.select(text.clean_nbns_name(F.col("a")), text.clean_hostname(F.col("a"))).collect()] == [
        ("DESKTOP-1", "DESKTOP-1"), ("WORKGROUP", None), (None, None)]
    roles = rows(spark, "a string", [("domain controller",), ("infrastructure_device",), ("nonsense",), (None,)])
    assert [r[0] for r in roles.select(text.normalize_role(F.col("a"))).collect()] == ["DOMAIN_CONTROLLER", "INFRASTRUCTURE", "UNKNOWN", "UNKNOWN"]


def test_evidence_keeps_order(spark):
    df = rows(spark, "e array<string>", [(["b ", "A", "", "a", "B", "c"],)])
    assert df.select(text.dedup_evidence(F.col("e"))).first()[0] == ["b", "A", "c"]


def test_join_phrases(spark):
    df = rows(spark, "e array<string>", [([],), (["a"],), (["a", "b"],), (["a", "b", "c"],)])
    assert [r[0] for r in df.select(text.join_phrases(F.col("e"), "none")).collect()] == ["none", "a", "a and b", "a, b, and c"]


def test_priority_golden(spark):
    df = rows(spark, "r double, c double, k double", [(74.0, 92.0, 50.0), (80.0, 70.0, 100.0)])
    assert [r[0] for r in df.select(fi.priority_score(F.col("r"), F.col("c"), F.col("k"))).collect()] == [73.1, 82.5]
    levels = rows(spark, "s double", [(91.0,), (76.0,), (61.0,), (41.0,), (20.0,)]).select(ladders.priority_level(F.col("s")))
    assert [r[0] for r in levels.collect()] == ["CRITICAL", "HIGH", "MEDIUM", "LOW", "INFORMATIONAL"]


def test_rarity_golden(spark):
    got = rows(spark, "n bigint", [(0,), (1,), (50,)]).select(fi.rarity(F.col("n")), fi.exclusivity(F.col("n"))).collect()
    assert [tuple(r) for r in got] == [(0.0, 0.0), (1.0, 1.0), (0.02, 0.0)]


def test_rounding(spark):
    got = rows(spark, "x double", [(1.005,), (0.125,), (-0.5,)]).select(rnd(F.col("x"), 2)).collect()
    assert [r[0] for r in got] == [1.0, 0.13, -0.5]


def test_bad_packets_are_counted_and_dropped(spark):
    schema = ("capture_id string, packet_index bigint, us bigint, src_ip string, dst_ip string, transport string, src_port string, dst_port string, ttl string, total_bytes string, "
              "tcp_flags struct<syn:boolean>, layer string, tls_sni string, http_host string, dns_query string, tls_alpn string, src_mac string, dst_mac string, nbns_name string, kerberos_cname string")
    rest = [None] * 8
    raw = rows(spark, schema, [
        ("c", 0, 1, "10.0.0.1", "8.8.8.8", "tcp", "1000", "443", "64", "100", None, "TLS", *rest), ("c", 1, 2, "10.0.0.1", "8.8.8.8", "tcp", "x", "443", "64", "100", None, None, *rest),
        ("c", 2, None, "10.0.0.1", "8.8.8.8", "udp", "1", "2", "64", "100", None, None, *rest), ("c", 3, 4, None, None, "udp", "1", "2", "64", "100", None, None, *rest),
        ("c", 4, 5, "10.0.0.1", "10.0.0.2", "arp", None, None, None, "42", None, "ARP", *rest), ("c", 5, 6, "10.0.0.1", "8.8.8.8", "udp", None, None, "64", "1500", None, None, *rest),
        ("c", 6, 7, "10.0.0.1", "8.8.8.8", "udp", None, "y", "64", "1500", None, None, *rest),
    ])
    counts = pk.normalization_counts(raw).first()
    assert (counts.packets, counts.normalized, counts.failed) == (7, 3, 4)
    fragment = pk.normalize_packets(raw).where("packet_index = 5").first()
    assert (fragment.src_port, fragment.dst_port) == (None, None)
    assert fragment.flow_id == hashlib.md5(b"10.0.0.1:0->8.8.8.8:0(udp)").hexdigest()[:16]
    assert [(r.packet_index, r.application_protocol, r.payload_bytes) for r in pk.normalize_packets(raw).orderBy("packet_index").collect()] == [(0, "https", 60), (4, "arp", 0), (5, fragment.application_protocol, 1472)]


def test_texts_without_evidence(spark):
    df = rows(spark, "e array<string>, k string, t array<string>", [([], "port_scan", ["port_scan", "persistent_tls"]), (["odd_signal"], "beaconing", ["other"])])
    got = df.select(na.reasoning_text(F.col("e"), F.col("k")), na.negative_findings(F.col("t")), na.recommended_actions(F.col("t")), na.evidence_phrases(F.col("e"))).collect()
    assert got[0][0].startswith("The finding was prioritized") and got[0][1][0].startswith("No additional negative findings")
    assert got[0][2][0] == "Review source host activity" and len(got[0][2]) == 6
    assert got[1][2] == na.FALLBACK_ACTIONS and got[1][3] == ["odd signal"]
