"""Figures of snapshot windows against plain ones."""

import random
from functools import partial

import numpy as np
import pytest
from pyspark.sql import functions as F

from netloom.operators import ordered
from netloom.operators import snapshots as sn
from netloom.plans.pipeline import written


def plain_tops(changes, moments, parts=10):
    changes, at, held, out = sorted(changes), 0, {}, {}
    for us in sorted(moments):
        while at < len(changes) and changes[at][0] <= us:
            held[changes[at][1]] = held.get(changes[at][1], 0) + changes[at][2]
            at += 1
        values = sorted((v for v, n in held.items() for _ in range(n)), reverse=True)
        k = max(1, len(values) // parts)
        out[us] = sum(values[:k]) / k
    return out


@pytest.mark.parametrize(("values", "hot"), [([0, 1, 10, 11, 120, 121, 1330, 1331, 8200, 14640], 2_000_000), (list(range(0, 900, 7)), 20)])
def test_running_top_mean(spark, monkeypatch, values, hot):
    monkeypatch.setattr(sn, "running", partial(ordered.running, hot=hot))
    rng = random.Random(1)
    spans = [(a := rng.randrange(0, 3_000), a + rng.randrange(1, 1500), rng.choice(values)) for _ in range(150)]
    changes = [(a, v, 1) for a, _, v in spans] + [(b, v, -1) for _, b, v in spans]
    moments = sorted({rng.randrange(-10, 5000) for _ in range(300)})
    frame = spark.createDataFrame([("c", *x) for x in changes] + [("d", 5, 3, 1)], "capture_id string, us bigint, value bigint, change bigint")
    asked = spark.createDataFrame([("c", m) for m in moments] + [("d", 4), ("d", 6)], "capture_id string, us bigint")
    got = {(r.capture_id, r.us): r.top_mean for r in sn.running_top_mean(frame, asked, written(spark)).collect()}
    assert got.pop(("d", 4)) == 0 and got.pop(("d", 6)) == 3
    assert {us: m for (_, us), m in got.items()} == pytest.approx(plain_tops(changes, moments))


def test_a_million_moments_in_ten_seconds(spark):
    """One capture, a million asked moments and 100,000 changes within ten seconds."""
    n = 100_000
    value = F.pmod(F.xxhash64("id"), F.lit(8201))
    starts = spark.range(n).select(F.lit("c").alias("capture_id"), (F.col("id") * 50).alias("us"), value.alias("value"), F.lit(1).cast("bigint").alias("change"))
    ends = starts.withColumns({"us": F.col("us") + 5_000_000, "change": F.lit(-1).cast("bigint")})
    moments = spark.range(1_000_000).select(F.lit("c").alias("capture_id"), (F.col("id") * 10).alias("us"))
    out = sn.running_top_mean(starts.unionByName(ends), moments, written(spark))
    assert out.count() == 1_000_000
    table = starts.select("us", "value").toPandas().sort_values("us")["value"].to_numpy()
    some = out.where("us % 400000 = 0").collect()
    assert len(some) == 25
    for r in some:
        active = np.sort(table[max(0, (r.us - 5_000_000) // 50 + 1) : r.us // 50 + 1])[::-1]
        assert r.top_mean == pytest.approx(active[: max(1, len(active) // 10)].mean())


NODES = (
    "capture_id string, node_id string, ip_address string, first_us bigint, last_us bigint, risk_score double, external_connections bigint, protocol_diversity bigint, role string, "
    "community_type string, replay_sequence_start bigint, replay_sequence_end bigint"
)
EDGES = "capture_id string, edge_id string, source string, target string, first_us bigint, last_us bigint, persistence_score double, relationship_risk double, relationship_type string"


def test_windows_against_plain_sums(spark):
    """Nodes that come and go, with gaps longer than the margin, windows without edges, and sequence numbers from 0."""
    rng = random.Random(3)
    moments = sorted(rng.sample(range(0, 400_000_000, 1000), 400))
    pick = lambda: sorted(rng.sample(range(400), 2))
    nodes, edges = [], []
    for i in range(60):
        a, b = pick() if i else (0, 1)
        b = min(b, a + rng.randrange(1, 25))
        nodes.append(("c", f"{i:016x}", f"10.0.0.{i}", moments[a], moments[b], rng.randrange(0, 8200) / 100, rng.randrange(9), rng.randrange(4), rng.choice(["INFRASTRUCTURE", "SERVER"]), rng.choice(list(sn.COMMUNITIES)), a, b))
    for i in range(40):
        a, b = pick()
        b = min(b, a + 8)
        edges.append(("c", f"e{i}", "s", f"t{i}", moments[a], moments[b], rng.randrange(10_000) / 1e4, float(rng.randrange(80)), rng.choice(sn.RELATIONSHIP_TYPES)))
    keep = written(spark)
    n, e = spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES)
    out = sn.snapshot_state(sn.snapshot_windows(n, e, keep), n, keep).collect()
    asked = {x[3] for x in nodes} | {x[4] for x in nodes} | {x[4] for x in edges} | {x[5] for x in edges}
    assert {r.us for r in out} == asked and len(out) == len(asked)
    m, half = sn.MARGIN_US, lambda x, d: np.floor(x * 10**d + 0.5) / 10**d
    for r in out:
        on = [x for x in nodes if x[4] >= r.us - m and x[3] <= r.us + m]
        lit = [x for x in edges if x[5] >= r.us - m and x[4] <= r.us + m]
        k = max(1, len(on) // 10)
        assert (r.node_count, r.edge_count) == (len(on), len(lit))
        assert r.graph_risk_score == pytest.approx(half(sum(sorted((x[5] for x in on), reverse=True)[:k]) / k, 2), abs=0.011)
        assert r.avg_node_risk == pytest.approx(sum(x[5] for x in on) / max(1, len(on)), abs=0.0051)
        assert r.avg_edge_persistence == pytest.approx(sum(x[6] for x in lit) / max(1, len(lit)), abs=0.000051)
        assert r.suspicious_edges == sum(x[7] >= 35 for x in lit) and r.relationship_types == sorted({x[8] for x in lit})
        assert r.infrastructure_ratio == pytest.approx(sum(x[8] == "INFRASTRUCTURE" for x in on) / max(1, len(on)), abs=0.000051)
        assert r.replay_sequence_start == min((x[10] for x in on if x[10] > 0), default=0)
        assert r.replay_sequence_end == max((x[11] for x in on if x[11] > 0), default=0)
