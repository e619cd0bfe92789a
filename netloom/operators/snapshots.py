"""Event-driven snapshots: the graph within five seconds of every appearance or disappearance.

A snapshot is kept when its counts or its set of nodes differ from the last kept one. (Its other figures
depend on its nodes and edges only, so they cannot change while those stay.) Nothing here joins windows with entities:
counts, sums and the digest of the node set are running folds over starts and ends, and so is the histogram that gives
the mean of the highest risks.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.functions.numeric import rnd, scaled
from netloom.functions.times import us_to_iso
from netloom.operators.graph import RELATIONSHIP_TYPES
from netloom.operators.ordered import ADD, MAX, XOR, running, runs

CAP = "capture_id"
MARGIN_US = 5_000_000
# Digits of a risk in hundredths, in the base of the levels of the histogram: 11 to the power of 4 values.
BASE, DIGITS = 11, 4
# Larger than any sequence number.
LAST = 1 << 62
COMMUNITIES = {
    "Domain Controllers": "domain_controllers", "Infrastructure": "infrastructure", "Servers": "servers", "Workstations": "workstations",
    "External Services": "external_services", "Unknown": "unknown",
}


def lifecycle_events(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Appearance and disappearance of every node and edge."""
    c = F.col

    def moment(frame, us, kind, entity):
        return frame.select(CAP, c(us).alias("us"), F.lit(kind).alias("type"), entity.alias("entity"))

    edge = F.concat(c("source"), F.lit("->"), c("target"))
    return (
        moment(nodes, "first_us", "node_appears", c("ip_address")).unionByName(moment(nodes, "last_us", "node_disappears", c("ip_address")))
        .unionByName(moment(edges, "first_us", "edge_appears", edge)).unionByName(moment(edges, "last_us", "edge_disappears", edge))
    )


def _changes(frame: DataFrame, columns: dict) -> DataFrame:
    """Start and end of activity of each row as two rows; `columns` maps a name to its value at the start."""
    start, end = F.col("first_us") - MARGIN_US, F.col("last_us") + MARGIN_US + 1
    both = F.explode(F.array(F.struct(start.alias("us"), F.lit(1).alias("sign")), F.struct(end.alias("us"), F.lit(-1).alias("sign")))).alias("m")
    return frame.select(CAP, both, *[v.alias(k) for k, v in columns.items()]).select(CAP, "m.us", "m.sign", *columns)


def _node_sums() -> dict[str, Column]:
    """What each active node adds to a window."""
    c = F.col
    return {
        "nodes": F.lit(1), "risk_e2": scaled(c("risk_score"), 2), "contacts": c("external_connections"), "diversity": c("protocol_diversity"),
        "infra": (c("role") == "INFRASTRUCTURE").cast("int"), "starts": (c("replay_sequence_start") > 0).cast("int"), "ends": (c("replay_sequence_end") > 0).cast("int"),
        **{f"in_{s}": (c("community_type") == name).cast("int") for name, s in COMMUNITIES.items()},
    }


def _edge_sums() -> dict[str, Column]:
    """What each active edge adds; a type is present while its running count is above 0."""
    c = F.col
    return {
        "edges": F.lit(1), "persistence_e4": scaled(c("persistence_score"), 4), "suspicious": (c("relationship_risk") >= 35).cast("int"),
        **{f"type_{t}": (c("relationship_type") == t).cast("int") for t in RELATIONSHIP_TYPES},
    }


def snapshot_windows(nodes: DataFrame, edges: DataFrame, keep) -> DataFrame:
    """One row per moment with a lifecycle event: the active nodes (also by community) and edges, their sums and types, the digest of the node set."""
    c = F.col
    node, edge = _node_sums(), _edge_sums()
    added = [*node, *edge]
    nothing = lambda names: {x: F.lit(0).cast("bigint") for x in names}
    digest = F.conv(F.substring("node_id", 1, 15), 16, 10).cast("bigint")
    at_nodes = _changes(nodes, {"node_set": digest, **node}).withColumns(nothing(edge))
    at_edges = _changes(edges, edge).withColumns(nothing(["node_set", *node]))
    # xor undoes itself, so the digest of a node enters and leaves by the same operation
    changes = at_nodes.unionByName(at_edges).groupBy(CAP, "us").agg(*[F.sum(F.coalesce(c(x), F.lit(0)) * c("sign")).alias(x) for x in added], F.bit_xor("node_set").alias("node_set")).withColumn("asks", F.lit(0))
    moments = lifecycle_events(nodes, edges).select(CAP, "us").distinct().withColumns({**nothing([*added, "node_set"]), "asks": F.lit(1)})
    folds = {**{x: ADD for x in added}, "node_set": XOR}
    points = keep("snapshot_changes", changes.unionByName(moments))
    summed = running(points, [CAP], ["us div 1000000L", "us"], ["us", "asks"], folds).where("asks = 1")
    now = lambda x: c(f"{x}_upto")
    n, m = now("nodes"), now("edges")
    per = lambda value, of, digits: F.when(of > 0, rnd(value, digits)).otherwise(F.lit(0.0))
    types = F.filter(F.array(*[F.when(now(f"type_{t}") > 0, t) for t in RELATIONSHIP_TYPES]), lambda t: t.isNotNull())
    windows = summed.select(
        CAP, "us", now("nodes").alias("node_count"), now("edges").alias("edge_count"), now("node_set").alias("node_set"), *[now(f"in_{s}").alias(s) for s in COMMUNITIES.values()],
        per(now("risk_e2") / n / F.lit(100.0), n, 2).alias("avg_node_risk"), per(now("persistence_e4") / F.lit(1e4) / m, m, 4).alias("avg_edge_persistence"),
        now("suspicious").alias("suspicious_edges"), per(now("suspicious") / m, m, 4).alias("suspicious_edge_ratio"), per(now("contacts") / (n * 10), n, 4).alias("externality_ratio"),
        per(now("infra") / n, n, 4).alias("infrastructure_ratio"), per(now("diversity") / n, n, 2).alias("avg_protocol_diversity"),
        types.alias("relationship_types"), rnd(F.size(types) / 12, 2).alias("relationship_diversity_score"),
        now("starts").alias("starts"), now("ends").alias("ends"),
    )
    windows = keep("snapshot_sums", windows)
    bounds = sequence_bounds(windows, nodes)
    known = lambda n, bound: F.when(c(n) > 0, c(bound)).otherwise(F.lit(0)).cast("bigint").alias(bound)
    kept = [x for x in windows.columns if x not in ("starts", "ends")]
    return windows.join(bounds, [CAP, "us"]).select(*kept, known("starts", "replay_sequence_start"), known("ends", "replay_sequence_end"))


def sequence_bounds(windows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Smallest first and largest last sequence number of the nodes in each window, where it has any.

    Sequence numbers rise with time. So a node that starts after a window has a larger first number than any in it, and the
    smallest among all nodes that end at or after its beginning is that of the window: a running fold over ends, from the
    last one back. In the same way the largest last number among nodes that start by its end is a running fold over starts.
    """
    c = F.col
    asked = windows.select(CAP, "us", F.lit(1).alias("asks"))
    back = nodes.where("replay_sequence_start > 0").select(CAP, (-(c("last_us") + MARGIN_US)).alias("us"), F.lit(0).alias("asks"), (F.lit(LAST) - c("replay_sequence_start")).alias("bound"))
    on = nodes.where("replay_sequence_end > 0").select(CAP, (c("first_us") - MARGIN_US).alias("us"), F.lit(0).alias("asks"), c("replay_sequence_end").alias("bound"))
    nothing = F.lit(None).cast("bigint")

    def folded(changes: DataFrame, moments: DataFrame) -> DataFrame:
        points = changes.groupBy(CAP, "us", "asks").agg(F.max("bound").alias("bound")).unionByName(moments.withColumn("bound", nothing))
        return running(points, [CAP], ["us div 1000000L", "us"], ["us", "asks"], {"bound": MAX}).where("asks = 1")

    first = folded(back, asked.withColumn("us", -c("us"))).select(CAP, (-c("us")).alias("us"), (F.lit(LAST) - c("bound_upto")).alias("replay_sequence_start"))
    return first.join(folded(on, asked).select(CAP, "us", c("bound_upto").alias("replay_sequence_end")), [CAP, "us"])


def _level(changes: DataFrame, asked: DataFrame, weight: int, parts: int) -> DataFrame:
    """One digit further: the histogram of the next digit at each asked moment, among values with the digits found so far, and the digit in which the `left` highest end."""
    c = F.col
    digits = range(BASE - 1, -1, -1)
    digit = F.expr(f"value div {weight}L % {BASE}L")
    points = changes.groupBy(CAP, F.expr(f"value div {weight * BASE}L").alias("prefix"), "us").agg(
        *[F.sum(F.when(digit == d, c("change")).otherwise(0)).alias(f"n{d}") for d in digits],
        *[F.sum(F.when(digit == d, c("change") * c("value")).otherwise(0)).alias(f"v{d}") for d in digits],
    ).withColumns({"asks": F.lit(0), "left": F.lit(None).cast("bigint"), "taken": F.lit(None).cast("bigint"), "k": F.lit(None).cast("bigint")})
    names = [f"{x}{d}" for x in "nv" for d in digits]
    points = points.unionByName(asked.withColumns({"asks": F.lit(1), **{x: F.lit(0).cast("bigint") for x in names}}))
    found = running(points, [CAP, "prefix"], ["us div 1000000L", "us"], ["us", "asks"], {x: ADD for x in names}).where("asks = 1")
    total = sum((c(f"n{d}_upto") for d in digits), F.lit(0).cast("bigint"))
    found = found.withColumn("total", total).withColumn("k", F.coalesce("k", F.expr(f"greatest(1L, total div {parts}L)")))
    found = found.withColumns({"left": F.coalesce("left", "k"), "taken": F.coalesce("taken", F.lit(0).cast("bigint"))})
    bars = F.array(*[F.struct(F.lit(d).cast("bigint").alias("digit"), c(f"n{d}_upto").alias("n"), c(f"v{d}_upto").alias("v")) for d in digits])
    start = F.struct(c("left"), c("taken"), F.lit(-1).cast("bigint").alias("digit"))

    def step(s, bar):
        ends = (s["digit"] < 0) & (bar["n"] >= s["left"])
        passes = (s["digit"] < 0) & ~ends
        return F.struct(
            F.when(passes, s["left"] - bar["n"]).otherwise(s["left"]).alias("left"), F.when(passes, s["taken"] + bar["v"]).otherwise(s["taken"]).alias("taken"),
            F.when(ends, bar["digit"]).otherwise(s["digit"]).alias("digit"))

    at = found.select(CAP, "us", "prefix", "k", F.aggregate(bars, start, step).alias("s"))
    return at.select(CAP, "us", (c("prefix") * BASE + F.greatest(c("s.digit"), F.lit(0))).alias("prefix"), "k", c("s.left").alias("left"), c("s.taken").alias("taken"))


def running_top_mean(changes: DataFrame, moments: DataFrame, keep, parts: int = 10) -> DataFrame:
    """(capture, us, top_mean): the mean of the highest value in `parts` of the values that are active at each moment, at least one.

    changes: (capture, us, value, change), whole values below BASE ** DIGITS that become active or cease. The histogram over
    time is kept by levels: first by the leading digit of the value, as a running sum for each digit, then by the next digit
    within the one where the highest end, and so on. So each moment reads BASE sums on each level, a level is one ordered fold,
    and no moment meets the values themselves. Each level is a table, written by `keep(name, frame)`.
    """
    c = F.col
    asked = moments.select(CAP, "us", F.lit(0).cast("bigint").alias("prefix"), *[F.lit(None).cast("bigint").alias(x) for x in ("k", "left", "taken")])
    for level in range(DIGITS - 1, -1, -1):
        asked = keep(f"highest_{level}", _level(changes, asked, BASE**level, parts))
    # on the last level a digit is one value; with nothing active none is left to add
    return asked.select(CAP, "us", ((c("taken") + c("left") * c("prefix")) / c("k")).alias("top_mean"))


def window_risk(windows: DataFrame, nodes: DataFrame, keep) -> DataFrame:
    """graph_risk_score at each window."""
    changes = _changes(nodes, {"value": scaled(F.col("risk_score"), 2)}).groupBy(CAP, "us", "value").agg(F.sum("sign").alias("change"))
    top = running_top_mean(keep("risk_changes", changes), windows.select(CAP, "us"), keep)
    return top.select(CAP, "us", rnd(F.col("top_mean") / F.lit(100.0), 2).alias("graph_risk_score"))


def snapshot_state(windows: DataFrame, nodes: DataFrame, keep) -> DataFrame:
    c = F.col
    possible = F.greatest(c("node_count") * (c("node_count") - 1), F.lit(1))
    density = F.when(c("node_count") == 0, F.lit(0.0)).otherwise(rnd(c("edge_count") / possible, 6))
    return windows.join(window_risk(windows, nodes, keep), [CAP, "us"]).withColumn("graph_density", density)


def kept_windows(states: DataFrame) -> DataFrame:
    """The first window of each run of equal windows, numbered, beside the counts of the one kept before it."""
    c = F.col
    label = F.concat_ws(":", c("node_count").cast("string"), c("edge_count").cast("string"), c("node_set").cast("string"))
    numbered = runs(states.withColumn("label", label), [CAP], ["us div 1000000L", "us"], ["us"], "label", "snapshot_number")
    columns = [x for x in states.columns if x not in (CAP, "us")]
    first = numbered.groupBy(CAP, "snapshot_number").agg(F.min("us").alias("us"), *[F.min_by(x, "us").alias(x) for x in columns])
    before = first.select(CAP, (c("snapshot_number") + 1).alias("snapshot_number"), c("node_count").alias("previous_nodes"), c("edge_count").alias("previous_edges"))
    return first.join(before, [CAP, "snapshot_number"], "left")


def snapshot_quality(kept: DataFrame) -> DataFrame:
    """quality_score and quality_reason. A kept window with the old counts differs in its nodes, so it is useful."""
    c = F.col
    same = (c("node_count") == c("previous_nodes")) & (c("edge_count") == c("previous_edges"))
    reason = (
        F.when((c("node_count") == 0) | (c("edge_count") == 0), "empty_snapshot")
        .when(F.coalesce(same, F.lit(False)), "useful_snapshot")
        .when(c("edge_count") < F.greatest(c("node_count") - 1, F.lit(1)), "sparse_snapshot")
        .otherwise("useful_snapshot")
    )
    score = F.when(c("quality_reason") == "empty_snapshot", F.lit(0.0)).when(c("quality_reason") == "sparse_snapshot", F.lit(0.6)).otherwise(F.lit(1.0))
    return kept.withColumn("quality_reason", reason).withColumn("quality_score", score)


def temporal_snapshots(states: DataFrame) -> DataFrame:
    c = F.col
    k = snapshot_quality(kept_windows(states)).withColumns({"window_start_us": c("us") - MARGIN_US, "window_end_us": c("us") + MARGIN_US})
    start, end = us_to_iso("window_start_us"), us_to_iso("window_end_us")
    counts = [c("node_count").cast("string"), c("edge_count").cast("string")]

    def offset(text):
        return F.replace(text, F.lit("Z"), F.lit("+00:00"))

    return k.withColumns({
        "snapshot_id": F.substring(F.sha2(F.concat_ws(":", offset(start), offset(end), *counts), 256), 1, 16),
        "snapshot_lineage_id": F.substring(F.sha2(F.concat_ws(":", start, *counts), 256), 1, 16),
    })
