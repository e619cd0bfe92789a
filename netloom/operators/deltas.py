"""Differences between two windows of a capture, and baselines over many."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.functions import ip
from netloom.functions.numeric import exact_mean, flag, rnd

HOST = ["capture_id", "ip_address"]
EDGE = ["capture_id", "edge_id"]
HOST_STATE = [
    "risk_score", "protocols", "persistent_relationships", "unique_ports", "external_unique_hosts", "persistent_connection_ratio",
    "behavioral_indicators", "inferred_role", "role", "protocol_relationships", "unique_peers",
]
EDGE_STATE = ["source", "target", "persistence", "protocols", "relationship_risk", "flows", "total_bytes", "relationship_indicators"]


def _side(frame: DataFrame, key: list[str], columns: list[str], name: str) -> DataFrame:
    return frame.select(*key, F.struct(*columns).alias(name))


def paired(current: DataFrame, previous: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """current and previous state side by side; one shuffle per side on a unique key."""
    return _side(current, key, columns, "cur").join(_side(previous, key, columns, "prev"), key, "full_outer")


def immediate_host_baseline(current: DataFrame, previous: DataFrame) -> DataFrame:
    return _side(current, HOST, HOST_STATE, "current").join(_side(previous, HOST, HOST_STATE, "previous"), HOST, "left")


def immediate_relationship_baseline(current: DataFrame, previous: DataFrame) -> DataFrame:
    return _side(current, EDGE, EDGE_STATE, "current").join(_side(previous, EDGE, EDGE_STATE, "previous"), EDGE, "left")


def _protocol_counts(snapshots: DataFrame, key: list[str]) -> DataFrame:
    counts = snapshots.select(*key, F.explode("protocols").alias("p")).groupBy(*key, "p").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("p", "n")))).alias("observed_protocols"))


def _deviation(column: str, digits: int):
    """Population deviation from exact integer sums."""
    v = F.expr(f"cast(floor({column} * {10**digits} + 0.5) AS bigint)")
    n = F.count(F.lit(1))
    return F.sqrt(F.greatest((F.sum(v * v) * n - F.sum(v) * F.sum(v)) / n / n, F.lit(0.0))) / F.lit(10.0**digits)


def historical_host_baseline(snapshots: DataFrame) -> DataFrame:
    """Per host over any number of snapshots of profiles (all rows of all snapshots in one table)."""
    base = snapshots.groupBy(*HOST).agg(
        exact_mean(F.col("risk_score"), 2).alias("risk_score_mean"), _deviation("risk_score", 2).alias("risk_score_std"),
        exact_mean(F.col("persistent_connection_ratio"), 4).alias("average_persistence"),
        (F.sum("unique_ports") / F.count(F.lit(1))).alias("unique_port_mean"), F.count(F.lit(1)).alias("sample_count"),
    )
    return base.join(_protocol_counts(snapshots, HOST), HOST, "left")


def historical_relationship_baseline(snapshots: DataFrame) -> DataFrame:
    base = snapshots.groupBy(*EDGE).agg(
        exact_mean(F.col("persistence"), 4).alias("persistence_mean"), _deviation("persistence", 4).alias("persistence_std"),
        (F.sum("flows") / F.count(F.lit(1))).alias("average_flow_count"), F.count(F.lit(1)).alias("sample_count"),
    )
    return base.join(_protocol_counts(snapshots, EDGE), EDGE, "left")


def _listing(items):
    return F.concat(F.lit("["), F.array_join(F.transform(items, lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", "), F.lit("]"))


def _delta(test, kind, confidence, severity, summary, **metrics):
    fields = [F.lit(kind).alias("delta_type") if isinstance(kind, str) else kind.alias("delta_type"), F.lit(confidence).alias("confidence"),
              (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"), summary.alias("summary")]
    for name, sql_type in METRICS.items():
        fields.append(metrics.get(name, F.lit(None)).cast(sql_type).alias(name))
    return F.when(test, F.struct(*fields))


METRICS = {
    "source": "string", "target": "string", "protocols": "array<string>", "persistence": "double", "persistence_delta": "double", "flows": "bigint",
    "risk_score_delta": "double", "new_relationship_count": "bigint", "new_peer_count": "bigint", "external_host_delta": "bigint",
    "unique_ports_delta": "bigint", "same_port_peer_count": "double", "low_persistence_ratio": "double",
    "new_protocols": "array<string>", "removed_protocols": "array<string>",
}


def _exploded(frame: DataFrame, key: str, entity: str, deltas: list, keep: list[str]) -> DataFrame:
    rows = frame.select("*", F.explode(F.array_compact(F.array(*deltas))).alias("d"))
    seed = F.concat(F.lit(f"{entity}:"), F.col(key), F.lit(":"), F.col("d.delta_type"))
    return rows.select(
        "capture_id", F.substring(F.sha2(seed, 256), 1, 16).alias("delta_id"), F.lit(entity).alias("entity_type"), F.col(key).alias("entity_id"), "d.*", *keep
    )


def host_deltas(current: DataFrame, previous: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """One row per change of a host. With `history` the risk gate and the comparison columns use it."""
    c = F.col
    pair = paired(current, previous, HOST, HOST_STATE)
    if history is not None:
        pair = pair.join(history.select(*HOST, "risk_score_mean", "risk_score_std", "unique_port_mean", "average_persistence"), HOST, "left")
    else:
        pair = pair.withColumns({n: F.lit(None).cast("double") for n in ("risk_score_mean", "risk_score_std", "unique_port_mean", "average_persistence")})

    def diff(field):
        return c(f"cur.{field}") - c(f"prev.{field}")

    p = pair.withColumns({
        "both": c("cur").isNotNull() & c("prev").isNotNull(),
        "risk_d": rnd(diff("risk_score"), 4), "ports_d": diff("unique_ports"), "persist_d": rnd(diff("persistent_connection_ratio"), 4),
        "rel_d": diff("protocol_relationships"), "peer_d": diff("unique_peers"), "ext_d": diff("external_unique_hosts"),
        "low": flag(diff("persistent_relationships") < 0).cast("double"),
        "added": F.array_sort(F.array_except("cur.protocols", "prev.protocols")), "gone": F.array_sort(F.array_except("prev.protocols", "cur.protocols")),
    }).withColumn("same", flag((c("peer_d") >= 3) & (c("ports_d") <= 2)).cast("double"))
    host = F.concat(F.lit("Host "), c("ip_address"))

    def text(*parts):
        return F.concat(host, *[F.lit(x) if isinstance(x, str) else x for x in parts])

    big = (F.abs(c("risk_d")) >= 15) | F.coalesce(c("risk_d") >= F.greatest(c("risk_score_mean") * 0.30, F.lit(15.0)), F.lit(False))
    kind = F.when(c("risk_d") > 0, "risk_increase").otherwise("risk_decrease")
    changed = (c("rel_d") != 0) | (c("peer_d") != 0) | (c("ext_d") != 0) | (c("same") != 0) | (c("low") != 0)
    deltas = [
        _delta(c("prev").isNull(), "new_host", 0.75, "informational", text(" appears for the first time in the current snapshot.")),
        _delta(c("both") & big, kind, 0.80, F.when(c("risk_d") > 0, "medium").otherwise("low"),
               text(" risk score changed by ", c("risk_d").cast("string"), "."), risk_score_delta=c("risk_d")),
        _delta(c("both") & (F.size("added") + F.size("gone") > 0), "protocol_change", 0.70, "informational",
               text(" has protocol changes: added ", _listing(c("added")), ", removed ", _listing(c("gone")), "."), new_protocols=c("added"), removed_protocols=c("gone")),
        _delta(c("both") & (F.abs(c("persist_d")) >= 0.20), "persistence_change", 0.75, "informational",
               text(" persistence changed by ", c("persist_d").cast("string"), "."), persistence_delta=c("persist_d")),
        _delta(c("both") & changed, "host_behavior_change", 0.70, "informational", text(" has behavioral profile changes in relationships and persistence."),
               new_relationship_count=c("rel_d"), new_peer_count=c("peer_d"), external_host_delta=c("ext_d"), same_port_peer_count=c("same"),
               low_persistence_ratio=c("low"), unique_ports_delta=c("ports_d")),
        _delta(c("cur").isNull(), "removed_host", 0.70, "informational", text(" no longer appears in the current snapshot.")),
    ]
    return _exploded(p, "ip_address", "host", deltas, ["risk_score_mean", "risk_score_std", "unique_port_mean", "average_persistence"])


def relationship_deltas(current: DataFrame, previous: DataFrame | None = None, history: DataFrame | None = None) -> DataFrame:
    """One row per change of a relationship; without `previous` every relationship is new."""
    c = F.col
    if previous is None:
        pair = _side(current, EDGE, EDGE_STATE, "cur").withColumn("prev", F.lit(None).cast(f"struct<{_edge_state_type(current)}>"))
    else:
        pair = paired(current, previous, EDGE, EDGE_STATE)
    if history is not None:
        pair = pair.join(history.select(*EDGE, "persistence_mean", "persistence_std", "average_flow_count"), EDGE, "left")
    else:
        pair = pair.withColumns({n: F.lit(None).cast("double") for n in ("persistence_mean", "persistence_std", "average_flow_count")})
    p = pair.withColumns({"source": F.coalesce("cur.source", "prev.source"), "target": F.coalesce("cur.target", "prev.target")})
    p = ip.with_direction(p, "source", "target").withColumns({
        "both": c("cur").isNotNull() & c("prev").isNotNull(), "persist_d": rnd(c("cur.persistence") - c("prev.persistence"), 4),
        "added": F.array_sort(F.array_except("cur.protocols", "prev.protocols")), "gone": F.array_sort(F.array_except("prev.protocols", "cur.protocols")),
    })
    name = F.concat(c("source"), F.lit("->"), c("target"))
    outside = c("direction").isin("inbound", "outbound")
    ends = {"source": c("source"), "target": c("target")}
    now = {**ends, "protocols": c("cur.protocols"), "persistence": c("cur.persistence")}
    new_text = F.when(outside, F.concat(F.lit("External relationship "), name, F.lit(" emerged with direction "), c("direction"), F.lit("."))).otherwise(
        F.concat(F.lit("New relationship "), name, F.lit(" appears with protocols "), _listing(c("cur.protocols")), F.lit("."))
    )

    def text(*parts):
        return F.concat(F.lit("Relationship "), name, *[F.lit(x) if isinstance(x, str) else x for x in parts])

    deltas = [
        _delta(c("prev").isNull(), F.when(outside, "external_relationship_emergence").otherwise("new_relationship"), 0.80, "informational", new_text, **now),
        _delta(c("both") & (c("persist_d") >= 0.20), "persistence_increase", 0.80, "medium",
               text(" persistence increased by ", c("persist_d").cast("string"), "."), **now, persistence_delta=c("persist_d"), flows=c("cur.flows")),
        _delta(c("both") & (F.size("added") + F.size("gone") > 0), "protocol_evolution", 0.70, "informational",
               text(" protocol set changed: added ", _listing(c("added")), ", removed ", _listing(c("gone")), "."), new_protocols=c("added"), removed_protocols=c("gone")),
        _delta(c("cur").isNull(), "removed_relationship", 0.70, "informational", text(" no longer appears in the current snapshot."), **ends, protocols=c("prev.protocols")),
    ]
    return _exploded(p.drop("source", "target").withColumns({"source": F.coalesce("cur.source", "prev.source"), "target": F.coalesce("cur.target", "prev.target")}),
                     "edge_id", "relationship", deltas, ["persistence_mean", "persistence_std", "average_flow_count"])


def _edge_state_type(frame: DataFrame) -> str:
    return ", ".join(f"{n}: {frame.schema[n].dataType.simpleString()}" for n in EDGE_STATE)
