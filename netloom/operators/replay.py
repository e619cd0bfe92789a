"""Timeline events to replay frames."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.functions.numeric import rnd
from netloom.operators.ordered import ADD, global_rank, nearest_value, running
from netloom.operators.timeline import EVENT_LEVELS, EVENT_ORDER

CAP = "capture_id"
# Event types that always get a frame.
IMPORTANT = [
    "beaconing_started", "hypothesis_created", "hypothesis_promoted", "candidate_created", "candidate_priority_changed", "narrative_generated", "host_risk_increased",
]


def frame_selection(events: DataFrame, limit: int | None = None) -> DataFrame:
    """Events that trigger a frame: all, or beyond the limit the important ones and an even sample of the rest."""
    if limit is None:
        return global_rank(events, [CAP], EVENT_LEVELS, EVENT_ORDER, "frame_number", start=1)
    c = F.col
    important = c("event_type").isin(IMPORTANT) | c("severity").isin("HIGH", "CRITICAL")
    sizes = events.groupBy(CAP).agg(F.count(F.lit(1)).alias("n"), F.count_if(important).alias("m")).withColumn("room", F.greatest(F.lit(limit) - c("m"), F.lit(0)))
    sizes = sizes.withColumn("stride", F.greatest(F.expr("n div greatest(room, 1)"), F.lit(1)))
    sampled = (c("event_index") % c("stride") == 0) & (F.expr("event_index div stride") < c("room"))
    chosen = events.join(sizes, CAP).where((c("n") <= limit) | important | sampled).drop("n", "m", "room", "stride")
    return global_rank(chosen, [CAP], EVENT_LEVELS, EVENT_ORDER, "frame_number", start=1)


def upto(marks: dict, queries: DataFrame) -> DataFrame:
    """For each query row (capture, us): how many marks of each kind have us at or before it."""
    points = None
    for name, frame in marks.items():
        counted = frame.groupBy(CAP, "us").agg(F.count(F.lit(1)).alias(name)).select(
            CAP, "us", F.lit(0).alias("asks"), *[F.col(n) if n == name else F.lit(0).cast("bigint").alias(n) for n in marks])
        points = counted if points is None else points.unionByName(counted)
    asked = queries.select(CAP, "us").distinct().select(CAP, "us", F.lit(1).alias("asks"), *[F.lit(0).cast("bigint").alias(n) for n in marks])
    summed = running(points.unionByName(asked), [CAP], ["us div 1000000L", "us"], ["us", "asks"], {n: ADD for n in marks})
    # marks of several kinds may share a microsecond; the query row comes after all of them
    return summed.where("asks = 1").select(CAP, "us", *[F.col(f"{n}_upto").alias(n) for n in marks])


def frame_state(frames: DataFrame, nodes: DataFrame, edges: DataFrame, events: DataFrame, candidates: DataFrame, state: DataFrame) -> DataFrame:
    """What a frame shows, as counts: nodes and edges first seen by then, events so far, visible candidates; the last frame shows all."""
    c = F.col
    shown = candidates.select(CAP, c("findings")[0]["created_us"].alias("us"))
    seen = upto({
        "nodes_seen": nodes.select(CAP, c("first_us").alias("us")), "edges_seen": edges.select(CAP, c("first_us").alias("us")), "events_seen": events.select(CAP, "us"),
        "candidates_seen": shown,
    }, frames)
    # everything else has one row for each capture
    totals = state.select(CAP, "node_count", "edge_count", "graph_density", "graph_risk_score", "isolated_node_count")
    for rows, name in ((events, "events_all"), (shown.where("us IS NOT NULL"), "candidates_all")):
        totals = totals.join(rows.groupBy(CAP).agg(F.count(F.lit(1)).alias(name)), CAP, "left")
    totals = totals.join(frames.groupBy(CAP).agg(F.max("frame_number").alias("last_frame")), CAP)
    f = frames.select(CAP, "frame_number", "us", "event_id", "event_type").join(seen, [CAP, "us"]).join(totals, CAP)
    f = f.withColumn("final", c("frame_number") == c("last_frame"))

    def pick(part, whole):
        return F.coalesce(F.when(c("final"), c(whole)).otherwise(c(part)), F.lit(0)).cast("bigint")

    return f.select(
        CAP, "frame_number", F.format_string("frame_%05d", "frame_number").alias("frame_id"), "us", c("event_id").alias("trigger_event_id"), c("event_type").alias("trigger_event_type"),
        pick("nodes_seen", "node_count").alias("node_count"), pick("edges_seen", "edge_count").alias("edge_count"), pick("events_seen", "events_all").alias("events_upto"),
        pick("candidates_seen", "candidates_all").alias("candidate_count"), "graph_density", "graph_risk_score", "isolated_node_count", "final",
    )


def frame_recent_events(frames: DataFrame, events: DataFrame, recent: int | None = 25) -> DataFrame:
    """The latest events at each frame, as rows (frame, event). Without a limit each frame repeats all events before it."""
    c = F.col
    spots = F.sequence(F.lit(0).cast("bigint") if recent is None else F.greatest(c("events_upto") - recent, F.lit(0)), c("events_upto") - 1)
    asked = frames.where("events_upto > 0").select(CAP, "frame_number", F.explode(spots).alias("event_index"))
    return asked.join(events.select(CAP, "event_index", "event_id"), [CAP, "event_index"])


def frame_delta(frames: DataFrame) -> DataFrame:
    """Nodes and edges that a frame adds, and the seconds to the next frame. Nothing is ever removed."""
    c = F.col
    levels, order = ["us div 1000000L", "us", "frame_number div 1000000L"], ["us", "frame_number"]
    rows = frames.select(CAP, "frame_number", "frame_id", "us", "node_count", "edge_count", F.struct("us", "node_count", "edge_count").alias("row"))
    rows = nearest_value(nearest_value(rows, [CAP], levels, order, "row", "before"), [CAP], levels, order, "row", "after", ahead=True)
    return rows.select(
        CAP, "frame_number", "frame_id", "us", (c("node_count") - F.coalesce("before.node_count", F.lit(0))).alias("added_nodes"),
        (c("edge_count") - F.coalesce("before.edge_count", F.lit(0))).alias("added_edges"), F.lit(0).alias("removed_nodes"), F.lit(0).alias("removed_edges"),
        F.coalesce(F.greatest(c("after.us") - c("us"), F.lit(0)) / F.lit(1e6), F.lit(0.0)).alias("frame_duration"),
    )


def replay_coverage(frames: DataFrame, events: DataFrame, packets: DataFrame, state: DataFrame) -> DataFrame:
    """Share of nodes and edges in the last frame, and events per packet."""
    c = F.col
    last = frames.where("final").select(CAP, c("node_count").alias("n"), c("edge_count").alias("m"))
    ne = events.groupBy(CAP).agg(F.count(F.lit(1)).alias("events"))
    np_ = packets.groupBy(CAP).agg(F.count(F.lit(1)).alias("packets"))
    j = state.select(CAP, "node_count", "edge_count").join(last, CAP, "left").join(ne, CAP, "left").join(np_, CAP)
    share = (c("n") / F.greatest(c("node_count"), F.lit(1)) + c("m") / F.greatest(c("edge_count"), F.lit(1))) / 2
    return j.select(
        CAP, F.coalesce(rnd(F.least(share, F.lit(1.0)) * 100, 2), F.lit(0.0)).alias("replay_coverage"),
        rnd(F.coalesce("events", F.lit(0)) / F.greatest(c("packets"), F.lit(1)), 4).alias("event_compression_ratio"),
    )


def seek_nearest(targets: DataFrame, frames: DataFrame) -> DataFrame:
    """Nearest frame to each `target_us`; of two equally near ones the earlier, beyond the ends the outermost.

    Moments and frames are put in one order, and each moment takes the last frame before it and the first from it on; both
    are carried over chunks of the order, so a capture may have any number of frames and targets.
    """
    c = F.col
    # a moment stands before the frames of its microsecond
    known = frames.select(CAP, "us", (c("frame_number") + 1).cast("bigint").alias("spot"), F.struct("us", "frame_number").alias("frame"))
    asked = targets.select(CAP, c("target_us").alias("us")).where("us IS NOT NULL").distinct().select(CAP, "us", F.lit(0).cast("bigint").alias("spot"), F.lit(None).cast(known.schema["frame"].dataType).alias("frame"))
    levels, order = ["us div 1000000L", "us", "spot div 1000000L"], ["us", "spot"]
    rows = nearest_value(known.unionByName(asked), [CAP], levels, order, "frame", "before")
    rows = nearest_value(rows, [CAP], levels, order, "frame", "after", ahead=True).where("spot = 0")
    early = c("after").isNull() | (c("us") - c("before.us") <= c("after.us") - c("us"))
    nearest = F.when(c("before").isNull(), c("after")).when(early, c("before")).otherwise(c("after"))
    found = rows.select(CAP, c("us").alias("target_us"), nearest.alias("nearest")).where("nearest IS NOT NULL")
    return targets.join(found, [CAP, "target_us"]).select(*targets.columns, c("nearest.frame_number").alias("frame_number"), c("nearest.us").alias("frame_us"))


def first_frames(frames: DataFrame, shown: DataFrame, key: str) -> DataFrame:
    """(capture, key, frame_number): the first frame that shows each row of `shown` (key, first_us).

    That is the first frame at or after first_us, and the last frame for what comes later, as it shows all. One row for each
    node or edge; the rows of a frame are what it adds to the frame before, and those up to it are its members.
    """
    c = F.col
    asked = shown.select(CAP, key, (c("first_us") - 1).alias("us"))
    before = upto({"before": frames.select(CAP, "us")}, asked)
    total = frames.groupBy(CAP).agg(F.max("frame_number").alias("last_frame"))
    return asked.join(before, [CAP, "us"]).join(total, CAP).select(CAP, key, F.least(c("before") + 1, c("last_frame")).cast("bigint").alias("frame_number"))


def frame_offsets(frames: DataFrame) -> DataFrame:
    """Place of each frame from 0."""
    return frames.select(CAP, "frame_id", (F.col("frame_number") - 1).cast("bigint").alias("frame_offset"))


def host_event_offsets(events: DataFrame) -> DataFrame:
    """Places of the events of each host, as rows (host, place)."""
    return events.select(CAP, "host", "event_index")
