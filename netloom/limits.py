"""How many rows the listings of an analysis hold."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Limits:
    """Cuts per capture, or per host or flow where the name says so. None: no cut.

    The defaults are those of the investigation view. Tables built from a cut table are cut with it: events make the timeline,
    phases, chapters and frames; hypotheses make candidates and narratives.
    """

    network_events: int | None = 300
    relationship_events: int | None = 300
    frames: int | None = 500
    recent_events: int | None = 25
    hypotheses: int | None = 10
    findings_per_host: int | None = 3
    candidates: int | None = 3
    protocols: int | None = 10
    suspicious_flows: int | None = 5
    elevated_hosts: int | None = 5
    search_hits: int | None = 120
    # events that the row of a host shows; `host_timeline_events` has all
    host_events: int = 1_000
    # names of a kind that the row of a flow shows; `flow_names` has all
    flow_names: int | None = 100


def within(place: str, top: int | None) -> Column:
    return F.lit(True) if top is None else F.col(place) <= top


def best(frame: DataFrame, window: Window, top: int | None, place: str = "i") -> DataFrame:
    """The first `top` rows of each window with their place; all, and no place, if top is None."""
    if top is None:
        return frame
    return frame.withColumn(place, F.row_number().over(window)).where(within(place, top))
