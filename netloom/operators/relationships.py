"""Scored flows to directed host-to-host relationships."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.functions import ladders
from netloom.functions.numeric import rnd, tally, unit
from netloom.functions.text import labels
from netloom.functions.times import hour_bucket

# Fixed value: the base of the exponential, as the scale of the scores was set with it.
EULER = 2.718281828


def relationships(enriched: DataFrame) -> DataFrame:
    """One row per ordered pair of hosts; one shuffle, partial aggregates first."""
    c = F.col
    grouped = enriched.groupBy("capture_id", c("initiator_ip").alias("source"), c("responder_ip").alias("target")).agg(
        F.count(F.lit(1)).alias("flows"),
        F.sum("packet_count").alias("packet_count"),
        F.sum(c("initiator_bytes") + c("responder_bytes")).alias("total_bytes"),
        F.collect_set("application_protocol").alias("protocols"),
        F.collect_set("transport_layer").alias("transports"),
        F.min("first_us").alias("first_us"),
        F.max("last_us").alias("last_us"),
        F.min("first_seen_sequence").alias("first_seen_sequence"),
        F.max("last_seen_sequence").alias("last_seen_sequence"),
        F.sum(F.greatest(c("last_us") - c("first_us"), F.lit(0))).alias("duration_us"),
        tally(c("is_suspicious")).alias("suspicious_flows"),
        tally(c("is_periodic")).alias("periodic_flows"),
        tally(c("suppressed")).alias("suppressed_flows"),
        # hours of the capture: bounded by its length
        F.collect_set(hour_bucket("first_us")).alias("h1"),
        F.collect_set(hour_bucket("last_us")).alias("h2"),
    )
    span = F.greatest((c("last_us") - c("first_us")) / F.lit(1e6), F.lit(0.0))
    persistence = unit(c("duration_us") / F.lit(1e6) / 3600) * 0.45 + unit(c("span") / 7200) * 0.35 + unit(c("flows") / 24) * 0.20
    unknown = F.array_contains("protocols", "unknown")
    only_https = (F.size("protocols") == 1) & F.array_contains("protocols", "https")
    tests = [
        ("unusual_relationship_persistence", c("persistence") >= 0.60, F.lit(18.0)),
        ("periodic_relationship_activity", c("periodic_flows") > 0, F.least(c("periodic_flows") * 12.0, F.lit(24.0))),
        ("elevated_flow_context", c("suspicious_flows") > 0, F.least(c("suspicious_flows") * 10.0, F.lit(20.0))),
        ("ambiguous_protocol_relationship", unknown, F.lit(8.0)),
        ("persistent_tls_relationship", only_https & (c("persistence") >= 0.45), F.lit(12.0)),
    ]
    points = sum((F.when(test, value).otherwise(F.lit(0.0)) for _, test, value in tests), F.lit(0.0))
    relief = F.lit(1.0) - F.least(c("suppressed_flows") / c("flows") * 0.75, F.lit(0.75))
    confidence = (
        unit(c("flows") / 20) * 0.25 + unit(c("packet_count") / 250) * 0.30 + unit(c("span") / 3600) * 0.20
        + F.when(unknown, F.lit(0.45)).otherwise(F.lit(0.72)) * 0.25
    )
    return (
        grouped.withColumns({
            "protocols": F.array_sort("protocols"), "transports": F.array_sort("transports"),
            "temporal_buckets": F.array_sort(F.array_union("h1", "h2")), "span": span,
        })
        .withColumn("persistence", rnd(persistence, 4))
        .withColumns({"pressure": points * relief, "relationship_indicators": labels(*[(n, t) for n, t, _ in tests])})
        .withColumns({
            "edge_id": F.substring(F.sha2(F.concat(c("source"), F.lit("->"), c("target")), 256), 1, 16),
            "relationship_risk": rnd(F.lit(78.0) * (F.lit(1.0) - F.pow(F.lit(EULER), -c("pressure") / 42)), 2),
            "confidence": rnd(F.least(confidence, F.lit(0.80)), 4),
            "protocol_diversity": F.size("protocols"),
            "graph_weight": rnd(c("flows") + c("packet_count") / 100, 4),
            "directionality": F.lit("directed"),
        })
        .withColumns({
            "severity": ladders.relationship_severity(c("relationship_risk"), c("confidence")),
            "graph_edge_color": ladders.edge_color(c("relationship_risk"), c("confidence")),
            "graph_edge_width": ladders.edge_width(c("flows"), c("relationship_risk")),
        })
        .drop("h1", "h2", "span", "pressure", "duration_us")
    )
