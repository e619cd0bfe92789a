"""The whole analysis as lazily built, named tables."""

import tempfile
import uuid
from dataclasses import replace
from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.limits import Limits
from netloom.operators import audit as au
from netloom.operators import catalog as ca
from netloom.operators import deltas as dl
from netloom.operators import findings as fi
from netloom.operators import flows as fl
from netloom.operators import graph as gr
from netloom.operators import hosts as hs
from netloom.operators import narratives as na
from netloom.operators import packets as pk
from netloom.operators import relationships as rel
from netloom.operators import replay as rp
from netloom.operators import snapshots as sn
from netloom.operators import timeline as ti
from netloom.session import tune
from netloom.sources.artifacts import read_artifacts, write_artifacts

# The tables that an analysis leaves behind, by the names of their files.
ARTIFACTS = {
    "normalized_packets": "packets", "flows": "flows", "flow_names": "flow_names", "enriched_flows": "enriched_flows", "host_profiles": "host_profiles", "relationships": "relationships",
    "host_baseline_snapshot": "baseline_snapshot", "layer5_deltas": "layer5_deltas", "layer5_hypotheses": "hypotheses", "layer5_investigation_candidates": "candidates",
    "investigation_narratives": "narratives", "graph_nodes": "scored_nodes", "graph_edges": "graph_edges", "graph_snapshots": "snapshots", "graph_state": "graph_state",
    "timeline_events": "timeline_events", "activity_phases": "activity_phases", "replay_frames": "frames", "replay_index": "indexed_events", "host_timelines": "host_timelines",
    "host_timeline_events": "host_timeline_events", "host_timeline_chapters": "host_timeline_chapters",
    "major_chapters": "chapters",
}
CSV_ARTIFACTS = ["normalized_packets", "flows", "enriched_flows", "host_profiles", "relationships"]

# Tables that no limit of events, frames or findings touches.
BEFORE_FINDINGS = ["packets", "flows", "enriched_flows", "host_metrics", "host_profiles", "relationships", "graph_edges", "linked_nodes", "scored_nodes"]


_OWN_FOLDER: dict[str, str] = {}


class Analysis:
    """All tables of the captures in a table of raw packets.

    Tables with several consumers are kept: `keep(name, frame)` is called for them. The default writes them
    as Parquet to the shared folder of the session and reads them back. That cuts the lineage, so lost
    executors cost no recomputation from the packets, later plans stay small, and consumers read only the
    columns they need.
    """

    def __init__(self, raw_packets: DataFrame, previous: "Analysis | None" = None, keep=None, policy=None, definitions=None, limits=None):
        tune(raw_packets.sparkSession)
        self.source = raw_packets
        self.previous = previous
        self.keep = keep or written(raw_packets.sparkSession)
        self.definitions = definitions or fi.DEFINITIONS
        self.policy = policy or fl.SuppressionPolicy()
        self.limits = limits or Limits()

    def _sharing(self, names: list[str], **limits) -> "Analysis":
        other = Analysis(self.source, self.previous, written(self.source.sparkSession), self.policy, self.definitions, replace(self.limits, **limits))
        for name in names:
            other.__dict__[name] = getattr(self, name)
        return other

    @cached_property
    def uncut(self) -> "Analysis":
        """The same analysis with a whole timeline of its findings; it shares all tables that the cuts of events and frames do not touch."""
        return self._sharing([*BEFORE_FINDINGS, "graph_state", "found", "hypotheses", "candidates", "narratives"], network_events=None, relationship_events=None, frames=None, search_hits=None)

    @cached_property
    def whole(self) -> "Analysis":
        """As `uncut`, and with all hypotheses, candidates and narratives, so that its timeline has the event of each."""
        none = dict.fromkeys(["network_events", "relationship_events", "frames", "search_hits", "hypotheses", "findings_per_host", "candidates"])
        return self._sharing([*BEFORE_FINDINGS, "found"], **none)

    @cached_property
    def ranked_whole(self) -> DataFrame:
        """All hypotheses, ranked, without a cut per capture or host."""
        return fi.hypotheses(fi.scored_hypotheses(self.found, self.host_profiles, None), self.capture_end, None)

    @cached_property
    def raw_packets(self):
        return self.source

    @cached_property
    def packets(self):
        return self.keep("packets", pk.normalize_packets(self.raw_packets))

    @cached_property
    def flows(self):
        return self.keep("flows", fl.build_flows(self.packets, self.flow_names, self.limits.flow_names))

    @cached_property
    def flow_names(self):
        return self.keep("flow_names", fl.flow_names(self.packets))

    @cached_property
    def enriched_flows(self):
        return self.keep("enriched_flows", fl.enriched_flows(self.packets, self.flows, self.policy))

    @cached_property
    def host_flow_expansion(self):
        return hs.host_flow_expansion(self.enriched_flows)

    @cached_property
    def host_peers(self):
        return self.keep("host_peers", hs.host_peers(self.host_flow_expansion))

    @cached_property
    def edge_hints(self):
        return hs.edge_hints(self.host_peers)

    @cached_property
    def host_metrics(self):
        rows = self.host_flow_expansion
        return self.keep("host_metrics", hs.host_metrics(rows, self.host_peers, hs.host_hours(rows)))

    @cached_property
    def host_profiles(self):
        return self.keep("host_profiles", hs.host_profiles(self.host_metrics))

    @cached_property
    def relationships(self):
        return self.keep("relationships", rel.relationships(self.enriched_flows))

    @cached_property
    def baseline_snapshot(self):
        return hs.baseline_snapshot(self.host_profiles)

    # graph

    @cached_property
    def graph_edges(self):
        return self.keep("graph_edges", gr.graph_edges(self.relationships))

    @cached_property
    def linked_nodes(self):
        nodes = gr.graph_nodes(self.host_profiles)
        return self.keep("linked_nodes", gr.node_degree(nodes, gr.node_links(self.graph_edges)))

    @cached_property
    def scored_nodes(self):
        return self.keep("scored_nodes", gr.scored_nodes(self.linked_nodes))

    @cached_property
    def graph_metrics(self):
        return gr.graph_metrics(self.scored_nodes, self.graph_edges)

    @cached_property
    def graph_risk(self):
        return gr.graph_risk_decomposition(self.scored_nodes, self.graph_edges)

    @cached_property
    def graph_health(self):
        return gr.graph_health(self.scored_nodes, self.graph_edges)

    @cached_property
    def hashes(self):
        return gr.node_hashes(self.scored_nodes).unionByName(gr.edge_hashes(self.graph_edges))

    @cached_property
    def graph_state(self):
        return self.keep("graph_state", gr.graph_state(self.scored_nodes, self.graph_edges))

    # deltas and findings

    @cached_property
    def capture_end(self):
        return self.packets.groupBy("capture_id").agg(F.max("us").alias("created_us"))

    @cached_property
    def host_deltas(self):
        if self.previous is None:
            hosts = self.host_profiles
            return dl.host_deltas(hosts, hosts.where("false"))
        return self.keep("host_deltas", dl.host_deltas(self.host_profiles, self.previous.host_profiles, self.host_history))

    @cached_property
    def relationship_deltas(self):
        before = None if self.previous is None else self.previous.relationships
        history = None if self.previous is None else self.edge_history
        return self.keep("relationship_deltas", dl.relationship_deltas(self.relationships, before, history))

    @cached_property
    def host_history(self):
        return dl.historical_host_baseline(self.host_profiles.unionByName(self.previous.host_profiles))

    @cached_property
    def edge_history(self):
        return dl.historical_relationship_baseline(self.relationships.unionByName(self.previous.relationships))

    @cached_property
    def found(self):
        return self.keep("found", fi.all_hypotheses(self.host_deltas, self.relationship_deltas, self.host_profiles, self.definitions))

    def _of_type(self, kind: str):
        return self.found.where(F.col("hypothesis_type") == kind)

    port_scan = property(lambda self: self._of_type("port_scan"))
    host_sweep = property(lambda self: self._of_type("host_sweep"))
    beaconing = property(lambda self: self._of_type("beaconing"))
    persistent_tls = property(lambda self: self._of_type("persistent_tls"))
    confident = property(lambda self: fi.confidence_filter(self.found))

    @cached_property
    def deduped(self):
        return fi.dedup_reverse_pairs(fi.confidence_filter(self.found))

    @cached_property
    def limited(self):
        return fi.top_n_limits(self.deduped, self.limits.findings_per_host)

    @cached_property
    def hypotheses(self):
        scored = fi.scored_hypotheses(self.found, self.host_profiles, self.limits.findings_per_host)
        if self.limits.hypotheses is None:  # places of all are counted in several passes
            scored = self.keep("scored_hypotheses", scored)
        return self.keep("hypotheses", fi.hypotheses(scored, self.capture_end, self.limits.hypotheses))

    @cached_property
    def host_summaries(self):
        summaries = fi.host_summaries(self.hypotheses)
        return summaries if self.limits.candidates is not None else self.keep("host_summaries", summaries)

    @cached_property
    def candidates(self):
        return self.keep("candidates", fi.investigation_candidates(self.host_summaries, self.limits.candidates))

    # narratives, timeline, replay

    @cached_property
    def narratives(self):
        return self.keep("narratives", na.narratives(self.candidates, self.scored_nodes))

    @cached_property
    def timed_hypotheses(self):
        return self.keep("timed_hypotheses", ti.timed_hypotheses(self.hypotheses, self.relationships))

    network_events = property(lambda self: ti.network_events(self.enriched_flows, self.limits.network_events))
    host_events = property(lambda self: ti.host_events(self.scored_nodes))
    relationship_events = property(lambda self: ti.relationship_events(self.relationships, self.limits.relationship_events))
    hypothesis_events = property(lambda self: ti.hypothesis_events(self.timed_hypotheses))
    candidate_events = property(lambda self: ti.candidate_events(self.candidates, self.timed_hypotheses))
    narrative_events = property(lambda self: ti.narrative_events(self.narratives, self.timed_hypotheses))

    @cached_property
    def timeline_events(self):
        parts = [self.network_events, self.host_events, self.relationship_events, self.hypothesis_events, self.candidate_events, self.narrative_events]
        return self.keep("timeline_events", reduce(DataFrame.unionByName, parts))

    @cached_property
    def correlated(self):
        return self.keep("correlated", ti.event_correlation(self.timeline_events))

    @cached_property
    def indexed_events(self):
        return self.keep("indexed_events", ti.indexed_events(self.correlated))

    @cached_property
    def activity_phases(self):
        return self.keep("activity_phases", ti.activity_phases(self.indexed_events))

    chapter_phase_overlap = property(lambda self: ti.chapter_phase_overlap(ti.chapter_bounds(self.indexed_events), self.activity_phases))
    chapter_hosts = property(lambda self: ti.chapter_hosts(self.indexed_events))

    @cached_property
    def chapters(self):
        return self.keep("chapters", ti.chapters(self.indexed_events, self.activity_phases))

    chapter_merge = property(lambda self: ti.chapter_merge(self.chapters))
    host_timeline_chapters = property(lambda self: ti.host_timeline_chapters(self.indexed_events, self.chapters))
    host_timelines = property(lambda self: ti.host_timelines(self.host_timeline_events, self.host_timeline_chapters, self.limits.host_events))

    @cached_property
    def host_timeline_events(self):
        return self.keep("host_timeline_events", ti.host_timeline_events(self.indexed_events))

    @cached_property
    def frame_selection(self):
        return self.keep("frame_selection", rp.frame_selection(self.indexed_events, self.limits.frames))

    @cached_property
    def frames(self):
        return self.keep("frames", rp.frame_state(self.frame_selection, self.scored_nodes, self.graph_edges, self.indexed_events, self.candidates, self.graph_state))

    frame_nodes = property(lambda self: rp.first_frames(self.frames, self.scored_nodes, "ip_address"))
    frame_edges = property(lambda self: rp.first_frames(self.frames, self.graph_edges, "edge_id"))
    frame_offsets = property(lambda self: rp.frame_offsets(self.frames))
    host_event_offsets = property(lambda self: rp.host_event_offsets(self.indexed_events))
    chapter_index = property(lambda self: ti.chapter_index(self.chapters))
    frame_recent = property(lambda self: rp.frame_recent_events(self.frames, self.indexed_events, self.limits.recent_events))
    frame_deltas = property(lambda self: rp.frame_delta(self.frames))
    replay_coverage = property(lambda self: rp.replay_coverage(self.frames, self.indexed_events, self.packets, self.graph_state))

    @property
    def seek(self):
        targets = self.scored_nodes.select("capture_id", "ip_address", F.col("first_us").alias("target_us"))
        return rp.seek_nearest(targets, self.frames)

    @property
    def chapter_jump(self):
        targets = self.chapters.select("capture_id", "chapter_id", F.col("start_us").alias("target_us"))
        return rp.seek_nearest(targets, self.frames)

    # snapshots

    lifecycle_events = property(lambda self: sn.lifecycle_events(self.scored_nodes, self.graph_edges))

    @cached_property
    def snapshot_windows(self):
        return self.keep("snapshot_windows", sn.snapshot_windows(self.scored_nodes, self.graph_edges, self.keep))

    @cached_property
    def snapshot_states(self):
        return self.keep("snapshot_states", sn.snapshot_state(self.snapshot_windows, self.scored_nodes, self.keep))

    @cached_property
    def snapshots(self):
        return self.keep("snapshots", sn.temporal_snapshots(self.snapshot_states))

    # catalogue

    replay_duration = property(lambda self: ca.replay_duration(self.frames))
    host_detail = property(lambda self: ca.host_detail(self.host_profiles, self.scored_nodes, self.host_timelines))
    ranked_hosts = property(lambda self: ca.ranked_hosts(self.host_profiles, self.candidates, self.hypotheses))
    relationship_context = property(lambda self: ca.relationship_context(self.relationships, self.hypotheses))
    destination_intel = property(lambda self: ca.destination_intel(self.relationships, self.hypotheses))
    web_finding = property(lambda self: ca.web_finding(self.enriched_flows, self.host_profiles))
    context_fallback = property(lambda self: ca.context_fallback(self.enriched_flows, self.host_profiles, self.hypotheses, self.candidates))
    community_context = property(lambda self: ca.community_context(self.scored_nodes))
    event_search = property(lambda self: ca.event_search(self.indexed_events, "LOW", "TLS", self.limits.search_hits))

    @property
    def event_searches(self):
        """The search with and without a severity and a text, one row for each search and hit."""
        calls = [("LOW", ""), ("MEDIUM", ""), (None, ""), (None, "flow"), ("INFO", "10.")]
        hits = [ca.event_search(self.indexed_events, s, t, self.limits.search_hits).withColumn("search", F.lit(f"{s or 'any'}:{t}")) for s, t in calls]
        return reduce(DataFrame.unionByName, hits)

    capture_totals = property(lambda self: ca.capture_totals(self.enriched_flows, self.host_profiles))
    suspicious_top = property(lambda self: fl.suspicious_flows(self.enriched_flows, self.limits.suspicious_flows))
    elevated_top = property(lambda self: hs.elevated_hosts(self.host_profiles, self.limits.elevated_hosts))
    direction_summary = property(lambda self: fl.traffic_direction_summary(self.flows))
    protocol_top = property(lambda self: fl.protocol_summary(self.flows, self.limits.protocols))

    @property
    def capture_summary(self):
        return ca.capture_summary(self.frames, self.indexed_events, self.chapters, self.scored_nodes, self.hypotheses, self.candidates, self.stable, self.snapshot_report)

    # artifacts

    layer5_deltas = property(lambda self: self.host_deltas.unionByName(self.relationship_deltas, allowMissingColumns=True))

    def artifact(self, name: str) -> DataFrame:
        return getattr(self, ARTIFACTS[name])

    def export(self, folder: str, fmt: str = "ndjson", names=None) -> None:
        """Writes the artifacts, in CSV those that are lists of records unless `names` says otherwise."""
        names = names or (CSV_ARTIFACTS if fmt == "csv" else ARTIFACTS)
        write_artifacts({name: self.artifact(name) for name in names}, folder, fmt)

    @cached_property
    def _exported(self) -> dict[str, dict[str, DataFrame]]:
        return {}

    def read_back(self, fmt: str) -> dict[str, DataFrame]:
        """The artifacts as read from a folder that they were written to, written once."""
        if fmt not in self._exported:
            spark = self.source.sparkSession
            folder = f"{shared_folder(spark)}/artifacts-{uuid.uuid4().hex}"
            self.export(folder, fmt)
            self._exported[fmt] = read_artifacts(spark, folder)
        return self._exported[fmt]

    # audits

    community_audit = property(lambda self: au.community_audit(self.scored_nodes))
    graph_consistency = property(lambda self: au.graph_consistency(self.scored_nodes))
    role_consistency = property(lambda self: au.role_consistency(self.host_profiles, self.scored_nodes, self.candidates))
    hypothesis_validation = property(lambda self: au.validation(au.hypothesis_errors(self.hypotheses), self.graph_state))
    candidate_validation = property(lambda self: au.validation(au.candidate_errors(self.candidates), self.graph_state))
    snapshot_report = property(lambda self: au.snapshot_quality_report(self.snapshots))
    readiness = property(lambda self: au.readiness(self.host_profiles, self.scored_nodes, self.hypotheses, self.candidates, self.graph_state))

    @property
    def stable(self):
        return au.stable(self.graph_consistency, self.role_consistency, self.hypothesis_validation, self.candidate_validation, self.snapshot_report, self.readiness)


def shared_folder(spark: SparkSession) -> str:
    """The folder in `spark.checkpoint.dir`; a session on one machine without it gets a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
    return _OWN_FOLDER.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="netloom-"))


def written(spark: SparkSession, folder: str | None = None):
    """A `keep` that writes a table to shared storage, below a name of its own, and reads it back."""
    base = f"{folder or shared_folder(spark)}/netloom-{uuid.uuid4().hex}"

    def keep(name: str, frame: DataFrame) -> DataFrame:
        path = f"{base}/{name}"
        frame.write.parquet(path)
        return spark.read.schema(frame.schema).parquet(path)

    return keep
