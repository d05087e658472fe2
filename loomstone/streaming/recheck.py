"""A second look at sites that seem out of date, after a grace: a run that met a deploy half-way is no alarm.

A site's pages are compared as captures of them arrive. If none is off, its
report is made at once. Otherwise a timer waits for the grace, in event time,
and the report is that of the captures that came by then: pages that turned
current are well, others are stale.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Seconds until the second look.
GRACE = 90
REPORT = "site string, page string, verdict string, stale boolean, rechecked boolean, at timestamp"


def page_verdict(served_status: Column, served: Column, source_status: Column, source: Column) -> Column:
    """current, stale, or unreachable where either side is no 200; the bodies are digests or texts."""
    good = F.coalesce((served_status == 200) & (source_status == 200), F.lit(False))
    return F.when(~good, "unreachable").when(served.eqNullSafe(source), "current").otherwise("stale")


class Recheck(StatefulProcessor):
    """By site: the latest verdict of each page, and the time of the second look if one is due."""

    def __init__(self, grace: int):
        self.grace = grace * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pages = handle.getMapState("pages", "page string", "verdict string, at long")
        self.due = handle.getValueState("due", "at long")

    def _report(self, site: str, rechecked: bool) -> Iterator[pd.DataFrame]:
        rows = [(site, page[0], verdict, verdict != "current", rechecked, pd.Timestamp(at, unit="ms")) for page, (verdict, at) in self.pages.iterator()]
        self.pages.clear()
        if rows:
            yield pd.DataFrame(sorted(rows), columns=[c.split()[0] for c in REPORT.split(", ")])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        latest: dict[str, tuple[int, str]] = {}
        for batch in rows:
            for page, verdict, at in zip(batch["page"], batch["verdict"], batch["ms"], strict=True):
                latest[page] = max(latest.get(page, (int(at), verdict)), (int(at), verdict))
        for page, (at, verdict) in latest.items():
            if not self.pages.containsKey((page,)) or self.pages.getValue((page,))[1] <= at:
                self.pages.updateValue((page,), (verdict, at))
        if self.due.exists():
            return
        known = [v for _, v in self.pages.iterator()]
        if not self.grace or all(verdict == "current" for verdict, _ in known):
            yield from self._report(key[0], False)
        else:
            due = min(at for verdict, at in known if verdict != "current") + self.grace
            self.due.update((due,))
            self.handle.registerTimer(due)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.due.clear()
        yield from self._report(key[0], True)

    def close(self) -> None:
        pass


def recheck(captures: DataFrame, grace: int = GRACE, late: str = "0 seconds") -> DataFrame:
    """Reports (site, page, verdict, stale, rechecked, at) of a stream of captures.

    ``captures`` has site, page, at, served_status, served, source_status and
    source. The captures of a site that come in one batch are one look at it;
    ``late`` is how late a capture may come. State goes to RocksDB, which the
    session's state store must name.
    """
    verdict = page_verdict(F.col("served_status"), F.col("served"), F.col("source_status"), F.col("source"))
    rows = captures.withWatermark("at", late).select("site", "page", "at", F.unix_millis("at").alias("ms"), verdict.alias("verdict"))
    return rows.groupBy("site").transformWithStateInPandas(Recheck(grace), REPORT, "Append", "EventTime")
