"""Registered queries that are more than columns of a table: scalar functions, baselines, comparisons, sinks."""

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.functions import ip, ladders, protocols, text
from netloom.functions.times import normalize_timestamp, us_to_iso
from netloom.operators import audit as au
from netloom.operators import catalog as ca
from netloom.operators import deltas as dl
from netloom.operators import findings as fi
from netloom.operators import flows as fl
from netloom.operators import hosts as hs
from netloom.operators import packets as pk
from netloom.operators import timeline as ti
from netloom.plans.pipeline import shared_folder
from netloom.sources import packets
from netloom.sources.artifacts import read_artifacts

c = F.col
# Columns of a packet without its flags.
LISTED = [
    "capture_id", "packet_index", "us", "src_ip", "dst_ip", "transport", "src_port", "dst_port", "ttl", "total_bytes", "layer",
    "tls_sni", "http_host", "dns_query", "tls_alpn", "src_mac", "dst_mac", "nbns_name", "kerberos_cname",
]


def addresses(a):
    """All addresses of the packets, each once, with their number."""
    both = a.packets.select(F.explode(F.array("src_ip", "dst_ip")).alias("ip")).distinct()
    return ip.with_numbers(both, num="ip")


def q_packet_source(a):
    """The packets written as Parquet, as JSON and as CSV (times and flags as text), and read by the source."""
    spark, base = a.raw_packets.sparkSession, f"{shared_folder(a.raw_packets.sparkSession)}/packets-{uuid.uuid4().hex}"
    part = lambda k: a.raw_packets.where(c("packet_index") % 3 == k)
    shown = F.array_join(F.array_compact(F.array(*[F.when(c(f"tcp_flags.{n}"), label) for n, label in protocols.FLAG_LABELS.items()])), " ")
    as_text = F.when(c("tcp_flags").isNotNull(), shown)
    bits = {f"tcp_{n}": c(f"tcp_flags.{n}").cast("int") for n in protocols.FLAG_LABELS}
    part(0).write.parquet(f"{base}/0")
    part(1).withColumn("tcp_flags", as_text).write.json(f"{base}/1")
    part(2).withColumns({"timestamp": us_to_iso("us"), **bits}).select(*[n for n in LISTED if n != "us"], "timestamp", *bits).write.option("header", "true").csv(f"{base}/2")
    kinds = {f.name: f.dataType for f in a.raw_packets.schema}
    read = [packets.read_packets(spark, f"{base}/{k}", fmt) for k, fmt in enumerate(("parquet", "json", "csv"))]
    flags = [F.coalesce(c(f"tcp_flags.{n}"), F.lit(False)).alias(f"tcp_{n}") for n in ("syn", "ack", "rst", "fin", "psh")]
    typed = [r.select(*[c(n).cast(kinds[n]).alias(n) for n in LISTED], *flags) for r in read]
    return reduce(DataFrame.unionByName, typed)


def q_hypothesis_errors(a):
    """Every hypothesis with the fields it lacks, after some have lost theirs."""
    odd = a.hypotheses.withColumns({"confidence_explanation": F.when(c("place") % 2 == 0, "").otherwise(c("confidence_explanation")), "confidence": F.when(c("place") % 3 != 0, c("confidence"))})
    return au.hypothesis_errors(odd).select("hypothesis_id", F.array_join("missing_fields", ",").alias("missing_fields"))


def q_candidate_errors(a):
    odd = a.candidates.withColumns({"host_role": F.when(c("place") == 1, "").otherwise(c("host_role")), "risk": F.when(c("place") != 2, c("risk"))})
    return au.candidate_errors(odd).select("host", F.array_join("missing_fields", ",").alias("missing_fields"))


def q_role_mismatches(a):
    """Hosts whose graph node says another role, after each fifth node was changed."""
    nodes = a.scored_nodes.withColumn("role", F.when(c("ip_address").rlike("[05]$"), "SERVER").otherwise(c("role")))
    return au.role_mismatches(a.host_profiles, nodes, a.candidates).select("host", "graph_node_role")


def q_immediate_edges(a):
    b = dl.immediate_relationship_baseline(a.w.relationships, a.w.previous.relationships)
    return b.select("edge_id", c("current.flows").alias("flows"), c("previous.flows").alias("previous_flows"), c("current.relationship_risk").alias("risk"), c("previous.relationship_risk").alias("previous_risk"))


def q_frame_lookup(a):
    """Frames found by number and by id."""
    return ca.frame_lookup(a.frames, "3").unionByName(ca.frame_lookup(a.frames, "frame_00007")).select("frame_number", "frame_id", "us", "node_count", "edge_count")


def q_chapter_index(a):
    return a.chapter_index.select("capture_id", "chapter_count", F.posexplode("chapters").alias("place", "x")).select("capture_id", "chapter_count", "place", "x.*")


def q_chapter_merge(a):
    """Chapters of which every second has the type of the one before, merged."""
    pair = F.expr("chapter_number - (chapter_number - 1) % 2")
    odd = a.chapters.withColumn("chapter_type", F.concat(F.lit("TYPE_"), pair.cast("string")))
    merged = ti.chapter_merge(odd)
    return merged.select("chapter_type", "start_us", "end_us", "event_count", "phase_count", "importance", "severity")


def q_normalize_timestamp(a):
    """Times as text without offset, with Z, and two hours east, back to UTC."""
    plain = F.regexp_replace(us_to_iso("us"), "Z$", "")
    written = F.when(c("packet_index") % 3 == 0, plain).when(c("packet_index") % 3 == 1, F.concat(plain, F.lit("Z"))).otherwise(F.concat(plain, F.lit("+02:00")))
    return a.raw_packets.select("packet_index", written.alias("text")).select("packet_index", normalize_timestamp(c("text")).alias("utc_us"))


def q_tcp_flags(a):
    names = list(protocols.FLAG_LABELS)
    tcp = a.raw_packets.where("transport = 'tcp'")
    shown = F.array_join(F.array_compact(F.array(*[F.when(c(f"tcp_flags.{n}"), protocols.FLAG_LABELS[n]) for n in names])), " ")
    as_text = c("packet_index") % 2 == 0
    bits = {n: F.when(~as_text & c(f"tcp_flags.{n}"), "1").otherwise("0") for n in names}
    return tcp.select("packet_index", protocols.tcp_flags(F.when(as_text, shown), bits).alias("f")).select("packet_index", *[c(f"f.{n}").alias(n) for n in names])


def q_transport_protocol(a):
    number = F.when(c("transport") == "tcp", "6").when(c("transport") == "udp", "17")
    return a.raw_packets.select("packet_index", protocols.transport_protocol(number, c("layer")).alias("transport_layer"))


def _protocols(a):
    return pk.application_protocols(a.raw_packets.withColumn("transport_layer", c("transport")))


def q_layer_metadata(a):
    odd = c("packet_index") % 2 == 1
    split = a.raw_packets.withColumns({f"{n}_{i}": F.when(odd if i else ~odd, c(n)).otherwise("") for n in ("tls_sni", "http_host") for i in (0, 1)})
    found = pk.layer_metadata(split, {"tls_sni": ["tls_sni_0", "tls_sni_1"], "http_host": ["http_host_0", "http_host_1"], "tls_alpn": ["tls_alpn"], "dns_query": ["dns_query"]})
    return found.select("packet_index", "tls_sni", "http_host", "tls_alpn", "dns_query", F.array_join("metadata_evidence", ",").alias("evidence"))


def q_severity(a):
    """Every ladder over the scores of the flows."""
    s, k = c("behavioral_score"), c("confidence")
    return a.enriched_flows.select(
        "flow_id", ladders.flow_severity(s, k).alias("flow_severity"), ladders.host_severity(s, k).alias("host_severity"), ladders.relationship_severity(s, k).alias("relationship_severity"),
        ladders.event_severity(s).alias("event_severity"), ladders.event_severity_label(c("severity")).alias("event_label"), ladders.priority_level(s).alias("priority_level"),
        ladders.fallback_priority_level(s).alias("fallback_level"), ladders.finding_tier(s).alias("tier"))


def q_dedup_evidence(a):
    """Evidence with spaces, capitals and repeats added to the indicators of each flow."""
    noisy = F.concat("suspicious_indicators", F.array(F.lit(" "), F.lit("TLS "), F.lit("tls")), F.transform("suspicious_indicators", lambda x: F.upper(x)))
    return a.enriched_flows.select("flow_id", F.array_join(text.dedup_evidence(noisy), ",").alias("evidence"))


def q_immediate_baseline(a):
    b = dl.immediate_host_baseline(a.w.host_profiles, a.w.previous.host_profiles)
    return b.select("ip_address", c("current.risk_score").alias("current_risk"), c("previous.risk_score").alias("previous_risk"), c("current.unique_ports").alias("current_ports"),
                    c("previous.unique_ports").alias("previous_ports"), c("previous").isNotNull().alias("known"))


def q_baseline_diff(a):
    return hs.baseline_diff(a.w.host_profiles, a.w.previous.host_profiles).select("ip_address", "field", "previous", "current", "delta")


def q_indicator_diff(a):
    d = hs.indicator_diff(a.w.host_profiles, a.w.previous.host_profiles)
    return d.select("ip_address", F.array_join("new_indicators", ",").alias("new_indicators"), F.array_join("removed_indicators", ",").alias("removed_indicators"))


def q_definitions(a):
    """The defined types with their weights, and how many findings of each the windows hold."""
    spark = a.raw_packets.sparkSession
    rows = [(k, d.title, d.severity, ",".join(d.signals), ",".join(f"{n}={int(round(w * 100))}" for n, w in d.weights.items())) for k, d in fi.DEFINITIONS.items()]
    known = spark.createDataFrame(rows, "hypothesis_type string, title string, severity string, signals string, weights string")
    counts = a.w.found.groupBy("hypothesis_type").agg(F.count(F.lit(1)).alias("findings"))
    return known.join(counts, "hypothesis_type", "left").withColumn("findings", F.coalesce("findings", F.lit(0)).cast("bigint"))


def q_weighted_score(a):
    w = fi.DEFINITIONS["beaconing"].weights
    new = a.relationship_deltas
    outside = F.when(c("delta_type") == "external_relationship_emergence", 1.0).otherwise(0.0)
    return new.select("delta_id", fi.weighted_score(w, {"periodicity": c("persistence"), "persistence": c("persistence"), "external_relationship": outside}).alias("score"))


def _pairs(a):
    return fi.destination_pair(a.relationship_deltas)


def q_entropy(a):
    return fl.value_entropy(a.packets, ["capture_id", "flow_id"], "total_bytes", "entropy").select("flow_id", "entropy")


def changed_rows(before, after):
    """(row, n): digests of rows with how many more there are of them before than after, over all columns. Only digests are shuffled."""
    text = F.to_json(F.struct(*sorted(after.columns)), {"ignoreNullFields": "false"})
    row = F.unhex(F.sha2(text, 256)).alias("row")
    return before.select(row, F.lit(1).alias("n")).unionByName(after.select(row, F.lit(-1).alias("n"))).groupBy("row").agg(F.sum("n").alias("n"))


def _round_trip(a, fmt):
    """(artifact, rows, changed): all artifacts of a format, written and read again; `changed` counts rows that differ in any column."""
    out = []
    for name, back in a.read_back(fmt).items():
        changed = changed_rows(a.artifact(name), back).agg(F.coalesce(F.sum(F.abs("n")), F.lit(0)).alias("changed"))
        out.append(back.agg(F.count(F.lit(1)).alias("rows")).crossJoin(changed).select(F.lit(name).alias("artifact"), "rows", "changed"))
    return reduce(DataFrame.unionByName, out)


def q_read_artifacts(a):
    """A table from each format, and one that was not written."""
    spark = a.raw_packets.sparkSession
    tables = [a.read_back(fmt)["host_profiles"].select(F.lit(fmt).alias("format"), "ip_address", "risk_score", "role", F.array_join("protocols", ",").alias("protocols")) for fmt in ("csv", "ndjson")]
    absent = read_artifacts(spark, f"{shared_folder(spark)}/no-such-folder", {"absent": tables[0].schema})["absent"]
    return tables[0].unionByName(tables[1]).unionByName(absent)


def q_normalize_fragments(a):
    """Packets of which a fifth are fragments without ports, a fifth have a malformed port, and a fifth a malformed ttl."""
    kind = c("packet_index") % 5
    port = lambda name: F.when(kind == 0, F.lit(None)).when((kind == 1) & (F.lit(name) == "src_port"), F.lit("x1")).otherwise(c(name).cast("string"))
    raw = a.raw_packets.withColumns({"src_port": port("src_port"), "dst_port": port("dst_port"), "ttl": F.when(kind == 2, F.lit("many")).otherwise(c("ttl").cast("string"))})
    return pk.normalize_packets(raw).select("packet_index", "src_port", "dst_port", "ttl", "payload_bytes", "flow_id")


SPECIAL = {
    "packet_source": q_packet_source,
    "hypothesis_errors": q_hypothesis_errors,
    "candidate_errors": q_candidate_errors,
    "role_mismatches": q_role_mismatches,
    "immediate_edge_baseline": q_immediate_edges,
    "frame_lookup": q_frame_lookup,
    "chapter_index": q_chapter_index,
    "chapter_merge_pairs": q_chapter_merge,
    "normalize_fragments": q_normalize_fragments,
    "normalize_timestamp": q_normalize_timestamp,
    "normalization_counts": lambda a: pk.normalization_counts(a.raw_packets),
    "packet_sequence": lambda a: a.packets.select("packet_index", "replay_sequence_id"),
    "timeline_index": lambda a: pk.timeline_index(a.packets).select("packet_index", "timeline_index"),
    "chronology_warning": lambda a: pk.chronology_warning(a.packets),
    "capture_duration": lambda a: pk.capture_duration(a.packets),
    "ip_class": lambda a: addresses(a).select("ip", ip.ip_class(c("num")).alias("ip_class")),
    "direction": lambda a: ip.with_direction(a.packets.select("src_ip", "dst_ip").distinct(), "src_ip", "dst_ip"),
    "is_private_ip": lambda a: addresses(a).select("ip", ip.is_private(c("num")).alias("is_private")),
    "tcp_flags": q_tcp_flags,
    "transport_protocol": q_transport_protocol,
    "app_protocol_infer": lambda a: _protocols(a).select("packet_index", "inferred_name", "inferred_confidence"),
    "app_protocol_enrich": lambda a: _protocols(a).select("packet_index", "enriched_name", "enriched_confidence", "enrichment_kind", F.array_join("enrichment_evidence", ",").alias("evidence")),
    "protocol_merge": lambda a: _protocols(a).select("packet_index", "application_protocol", "app_confidence"),
    "layer_metadata": q_layer_metadata,
    "identity_fields": lambda a: a.packets.select("packet_index", "src_mac", "dst_mac", "nbns_name", "kerberos_cname"),
    "payload_bytes": lambda a: a.raw_packets.select("packet_index", pk.payload_bytes(c("total_bytes"), c("transport")).alias("payload_bytes")),
    "flow_id": lambda a: a.raw_packets.select("packet_index", pk.flow_id(c("src_ip"), c("dst_ip"), c("src_port"), c("dst_port"), c("transport")).alias("flow_id")),
    "normalize_domain": lambda a: fl.packet_domains(a.packets).select("packet_index", "field", "domain"),
    "clean_nbns_name": lambda a: a.packets.where("nbns_name IS NOT NULL").select("packet_index", text.clean_nbns_name(c("nbns_name")).alias("name")),
    "clean_hostname": lambda a: a.packets.where("nbns_name IS NOT NULL").select("packet_index", text.clean_hostname(c("nbns_name")).alias("hostname")),
    "normalize_role": lambda a: a.host_profiles.select("ip_address", text.normalize_role(F.replace("role", F.lit("_"), F.lit(" "))).alias("role"), text.role_display(c("role")).alias("role_display")),
    "non_investigative_node": lambda a: addresses(a).select("ip", ip.non_investigative_node(c("num")).alias("non_investigative")),
    "common_cloud_ip": lambda a: addresses(a).select("ip", ip.common_cloud_ip(c("num")).alias("common_cloud")),
    "investigative_domain": lambda a: a.flow_names.where("kind = 'domain'").select(c("name").alias("domain")).distinct().select("domain", text.investigative_domain(c("domain")).alias("investigative")),
    "severity": q_severity,
    "display_columns": lambda a: a.host_profiles.select("ip_address", ladders.host_color(c("risk_score"), c("confidence")).alias("color"), ladders.node_size(c("graph_degree"), c("risk_score")).alias("size"),
                                                        ladders.edge_width(c("flow_count"), c("risk_score")).alias("width")),
    "dedup_evidence": q_dedup_evidence,
    "bidirectional_flows": lambda a: fl.bidirectional_flows(a.flows).drop("capture_id"),
    "inter_packet_delay": lambda a: fl.inter_packet_delay(a.packets, a.flows).drop("capture_id"),
    "shannon_entropy": q_entropy,
    "rarity_context": lambda a: fl.rarity_context(a.flows).select("flow_id", "destination_flows", "protocol_flows"),
    "host_temporal": lambda a: hs.host_temporal(a.host_profiles).drop("capture_id"),
    "immediate_baseline": q_immediate_baseline,
    "baseline_diff": q_baseline_diff,
    "indicator_diff": q_indicator_diff,
    "destination_pair": lambda a: _pairs(a).select("delta_id", "consumer", "destination"),
    "destination_consumers": lambda a: fi.destination_consumers(_pairs(a)).select("destination", "consumer_count"),
    "destination_rarity": lambda a: fi.destination_consumers(_pairs(a)).select("destination", fi.rarity(c("consumer_count")).alias("rarity"), fi.exclusivity(c("consumer_count")).alias("exclusivity")),
    "hypothesis_definitions": q_definitions,
    "weighted_score": q_weighted_score,
    "write_ndjson": lambda a: _round_trip(a, "ndjson"),
    "write_csv": lambda a: _round_trip(a, "csv"),
    "read_artifacts": q_read_artifacts,
}
