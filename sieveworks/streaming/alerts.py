"""Alerts on the rate of good answers, from metrics that are observed while a stream or a batch runs.

A run without samples, a rate below a floor, and a fall below the mean of the runs before are alerts. Nothing is
computed twice: the counts are gathered by ``observe`` in the tasks that move the rows anyway.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

NAME = "ok_rate"


def observed(samples: DataFrame, good: Column, name: str = NAME) -> DataFrame:
    """``samples`` unchanged, with the metrics samples and good of every micro-batch under ``name``; a null verdict
    is not good."""
    return samples.observe(name, F.count(F.lit(1)).alias("samples"), F.count_if(F.coalesce(good, F.lit(False))).alias("good"))


class RateRule:
    """Judges runs in their order: an alert's text, or None. ``memory`` runs are remembered."""

    def __init__(self, floor: float = 0.5, fall: float = 0.2, memory: int = 5) -> None:
        self.floor, self.fall, self.before = floor, fall, deque(maxlen=memory)

    def judge(self, samples: int, good: int) -> str | None:
        if not samples:
            return "no samples"
        rate = good / samples
        mean = sum(self.before) / len(self.before) if self.before else None
        self.before.append(rate)
        if mean is not None and rate < mean - self.fall:
            return f"fell from {mean:.3f} to {rate:.3f}"
        return f"below {self.floor:g}: {rate:.3f}" if rate < self.floor else None


class RateAlerts(StreamingQueryListener):
    """Calls ``alert(query id, batch number, text)`` for each micro-batch whose observed rate breaks the rule. Each
    query has its own memory; micro-batches that had no input are no runs, unless ``empty`` asks for them."""

    def __init__(self, alert: Callable[[str, int, str], None], name: str = NAME, rule: Callable[[], RateRule] = RateRule, empty: bool = False) -> None:
        self.alert, self.name, self.rule, self.empty = alert, name, rule, empty
        self.rules: dict[str, RateRule] = {}
        self.broken: list[tuple[str, str]] = []

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self.rules[str(event.id)] = self.rule()

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        counts = p.observedMetrics.get(self.name)
        if counts is None or not (counts["samples"] or self.empty):
            return
        text = self.rules.setdefault(str(p.id), self.rule()).judge(counts["samples"], counts["good"])
        if text:
            self.alert(str(p.id), p.batchId, text)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        return

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.rules.pop(str(event.id), None)
        if event.exception:
            self.broken.append((str(event.id), event.exception))


def rate_alerts(samples: DataFrame, run: str, good: Column, by: str | None = None, floor: float = 0.5, fall: float = 0.2, memory: int = 5) -> DataFrame:
    """The same rule over a table of past runs: by (if given), run, samples, rate, mean of up to ``memory`` runs
    before, alert. Rates are aggregated before they are ordered, so the window holds a row a run."""
    from pyspark.sql import Window

    keys = [by] if by else []
    rates = samples.groupBy(*keys, run).agg(F.count(F.lit(1)).alias("samples"), F.avg(F.when(good, 1.0).otherwise(0.0)).alias("rate"))
    order = Window.partitionBy(*keys).orderBy(run).rowsBetween(-memory, -1)
    out = rates.withColumn("mean", F.avg("rate").over(order))
    alert = F.when(F.col("rate") < F.col("mean") - fall, "fell").when(F.col("rate") < floor, "low")
    return out.withColumn("alert", alert)
