"""Neighbours in error over a stream of feature rows: what is known at once, then corrections."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.neighbours import STRETCH

FOUND = "chr string, site long, neighbour_error_pos array<int>, seen long, version long"
STATE = "sites array<long>, own array<boolean>, wrong array<boolean>, version long, seen long"


def neighbour_updates(rows: DataFrame, k: int = 2, threshold: float = 0.5, stretch: int = STRETCH, delay: str = "1 hour") -> DataFrame:
    """(chr, site, neighbour_error_pos, seen in microseconds, version) of a stream of (chr, site, mismatch_rate, ts), as far as known; later versions correct earlier ones.

    A site is reported when it first comes, and again whenever another one within ``k`` turns out to be
    in error. The state of a stretch of positions holds its different sites and those within ``k`` of its
    borders, so never more than ``stretch + 2k``; it goes when the watermark (the newest time less
    ``delay``) has passed its newest row. Rows of a stretch must come within ``delay`` of each other; ones
    behind the watermark are dropped and counted by the query. A site is in error if any of its rows
    is; repeated rows change nothing, and rows without a chromosome or site are left out.
    """
    if k >= stretch:
        raise ValueError("a stretch must be longer than the reach")
    own = F.floor(F.col("site") / stretch)
    reach = F.array_distinct(F.array(own, F.floor((F.col("site") - k) / stretch), F.floor((F.col("site") + k) / stretch)))
    sent = rows.where("chr is not null and site is not null and ts is not null").withWatermark("ts", delay)
    sent = sent.select("chr", "site", "ts", F.unix_micros("ts").alias("at"), F.coalesce(F.col("mismatch_rate") >= threshold, F.lit(False)).alias("wrong"), own.alias("home"), F.explode(reach).alias("stretch"))

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        known: dict[int, tuple[bool, bool]] = {}
        version, seen = 0, 0
        if state.exists:
            sites, mine, wrong, version, seen = state.get
            known = dict(zip(sites, zip(mine, wrong, strict=True), strict=True))
        # sites to report: new ones of this stretch, and all within reach of what has turned out to be in error
        fresh, turned = set(), set()
        for frame in frames:
            seen = max(seen, int(frame["at"].max()))
            for site, wrong, home in zip(frame["site"].tolist(), frame["wrong"].tolist(), (frame["home"] == frame["stretch"]).tolist(), strict=True):
                was = known.get(site)
                if was is None:
                    known[site] = (home, wrong)
                    if home:
                        fresh.add(site)
                if wrong and (was is None or not was[1]):
                    known[site] = (home, True)
                    turned.add(site)
        near = {s for t in turned for s in range(t - k, t + k + 1) if s != t and s in known and known[s][0]}
        version += 1
        report = sorted(fresh | near)
        offsets = [np.array([d for d in range(-k, k + 1) if d and known.get(s + d, (False, False))[1]], np.int32) for s in report]
        state.update((list(known), [o for o, _ in known.values()], [w for _, w in known.values()], version, seen))
        state.setTimeoutTimestamp(max(seen // 1000, state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame({"chr": [key[0]] * len(report), "site": report, "neighbour_error_pos": offsets, "seen": [seen] * len(report), "version": [version] * len(report)})

    return sent.groupBy("chr", "stretch").applyInPandasWithState(update, FOUND, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def latest(updates: DataFrame) -> DataFrame:
    """(chr, site, neighbour_error_pos): the last version of each site."""
    return updates.groupBy("chr", "site").agg(F.max_by("neighbour_error_pos", F.struct("seen", "version")).alias("neighbour_error_pos"))
