"""What is learned about hosts from observations: keyed state with judgement, decay and a cap.

An observation is (`host`, `fetch_ok`, `score`, `template_hit`, `garbled_hit`, `latency`, `observed_at`). NaN scores count as
null, latencies of 0 or less are not known. The batch form without decay is one aggregation that combines before the
shuffle; the form with decay is a fold over each host's observations in event time, halved once per 30 idle days.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagesift.functions.urls import learner_host

# Fixed values of the judgement.
LEAST_N, LOW_SCORE, LOW_RATE, FETCH_RATE, SLOW = 5, 0.25, 0.6, 0.2, 25.0
IDLE_DAYS = 30


def cleaned(observations: DataFrame) -> DataFrame:
    """Observations once each (whole rows may come twice), by the key of their host; those without a host are left out."""
    score = F.when(~F.isnan("score"), F.col("score"))
    return observations.select("obs_id", learner_host("host").alias("host"), F.coalesce("fetch_ok", F.lit(False)).alias("fetch_ok"), score.alias("score"), F.coalesce(F.col("template_hit") | F.col("garbled_hit"), F.lit(False)).alias("bad"), F.when(F.col("latency") > 0, F.col("latency")).alias("latency"), F.col("observed_at").cast("timestamp").alias("observed_at")).where("host != ''").dropDuplicates(["obs_id"])


def judgement(n, ok, avg, low, slow) -> list[tuple]:
    """The table of the judgement (H2): (condition, penalty or reward), of which the first that holds counts, else 0.

    Of columns or of numbers. `low` may count an observation twice, for its score and for its marks.
    """
    return [
        (n < LEAST_N, 0.0), (((ok == 0) & (n >= 8)) | (ok / n < FETCH_RATE), -0.5), ((avg < LOW_SCORE) & (low / n > LOW_RATE), -0.4),
        (slow > SLOW, -0.3), ((avg > 0.7) & (n >= 10), 0.1),
    ]


def judge(n: Column, ok: Column, score_sum: Column, low: Column, lat_sum: Column, lat_n: Column) -> Column:
    """Penalty or reward of a host by the table."""
    avg = F.when(ok > 0, score_sum / ok).otherwise(0.0)
    slow = F.when(lat_n > 0, lat_sum / lat_n).otherwise(0.0)
    rules = [F.when(holds, delta) for holds, delta in judgement(n, ok, avg, low, slow)]
    return F.coalesce(*rules, F.lit(0.0))


def host_stats(observations: DataFrame) -> DataFrame:
    """State of each host after all observations, without decay (H1): counts, sums and `delta`."""
    c = F.col
    low = F.coalesce(c("score") < LOW_SCORE, F.lit(False)).cast("int") + c("bad").cast("int")
    sums = cleaned(observations).groupBy("host").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("fetch_ok").alias("ok"), F.coalesce(F.sum(F.when(c("fetch_ok"), c("score"))), F.lit(0.0)).alias("score_sum"), F.sum(low).alias("low"),
        F.coalesce(F.sum("latency"), F.lit(0.0)).alias("lat_sum"), F.count("latency").alias("lat_n"), F.max("observed_at").alias("last"),
    )
    return sums.withColumn("delta", judge(c("n"), c("ok"), c("score_sum"), c("low"), c("lat_sum"), c("lat_n")))


class HostState:
    """State of one host in the fold with decay (H1 to H4)."""

    __slots__ = ("n", "ok", "score_sum", "low", "lat_sum", "lat_n", "last", "delta", "changes")

    def __init__(self, values: tuple = (0, 0, 0.0, 0, 0.0, 0, 0.0, 0.0, 0)) -> None:
        self.n, self.ok, self.score_sum, self.low, self.lat_sum, self.lat_n, self.last, self.delta, self.changes = values

    def values(self) -> tuple:
        return tuple(getattr(self, a) for a in self.__slots__)

    def idle(self, now: float) -> None:
        """Halve once for every 30 idle days, unless a penalty holds; forget what is left of it after 60."""
        turns = int(max(0.0, now - self.last) // (IDLE_DAYS * 86400)) if self.last and self.delta >= 0 else 0
        for _ in range(min(turns, 40)):
            self.n, self.score_sum, self.lat_sum, self.lat_n = max(1, self.n // 2), self.score_sum / 2, self.lat_sum / 2, self.lat_n // 2
        if turns >= 2 and self.n <= 1:
            self.__init__()

    def add(self, ok: bool, score: float | None, bad: bool, latency: float | None, at: float) -> None:
        self.idle(at)
        self.n += 1
        self.last = max(self.last, at)
        if ok:
            self.ok += 1
            self.score_sum += score or 0.0
        self.low += (score is not None and score < LOW_SCORE) + bool(bad)
        if latency is not None:
            self.lat_sum, self.lat_n = self.lat_sum + latency, self.lat_n + 1
        delta = self.judged()
        if delta != self.delta:
            self.delta, self.changes = delta, self.changes + 1

    def judged(self) -> float:
        avg, slow = self.score_sum / max(1, self.ok) * (self.ok > 0), self.lat_sum / max(1, self.lat_n)
        return next((delta for holds, delta in judgement(self.n, self.ok, avg, self.low, slow) if holds), 0.0)


STATE = "n long, ok long, score_sum double, low long, lat_sum double, lat_n long, last double, delta double, changes long"


def known(value):
    return None if value is None or value != value else float(value)


def folded_stats(observations: DataFrame) -> DataFrame:
    """State of each host with decay (H3, H4), folded in event time: (`host`, state).

    Rows of a host are sorted by the shuffle and pass through in Arrow batches, of which only the state is kept; a host with
    a third of all rows takes one long pass but no memory.
    """
    rows = cleaned(observations).select("host", "fetch_ok", "score", "bad", "latency", F.col("observed_at").cast("double").alias("at"), "obs_id")
    ordered = rows.repartition("host").sortWithinPartitions("host", "at", "obs_id").drop("obs_id")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        host, state, out = None, HostState(), []
        for batch in batches:
            for h, ok, score, bad, latency, at in batch.itertuples(index=False, name=None):
                if h != host:
                    if host is not None:
                        out.append((host, *state.values()))
                    host, state = h, HostState()
                state.add(ok, known(score), bad, known(latency), at)
            if len(out) > 5000:
                yield pd.DataFrame(out, columns=["host", *HostState.__slots__])
                out = []
        if host is not None:
            out.append((host, *state.values()))
        yield pd.DataFrame(out, columns=["host", *HostState.__slots__])

    return ordered.mapInPandas(fold, f"host string, {STATE}")


def capped_hosts(stats: DataFrame, most: int = 1000) -> DataFrame:
    """At most `most` hosts (H5): those with the fewest observations go first, hosts with a penalty never.

    The cut is found by a histogram over `n`, so only hosts on its edge are ordered.
    """
    total = stats.count()
    over = total - most
    if over <= 0:
        return stats
    free = stats.where(~(F.coalesce("delta", F.lit(0.0)) < 0))
    steps = free.groupBy("n").agg(F.count(F.lit(1)).alias("_c")).withColumn("_before", F.coalesce(F.sum("_c").over(Window.orderBy("n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    edge = steps.where(F.col("_before") < over).agg(F.max("n"), F.max("_before")).first()
    if edge[0] is None:
        return stats
    gone = free.where(F.col("n") < edge[0]).select("host").union(free.where(F.col("n") == edge[0]).orderBy("host").limit(over - edge[1]).select("host"))
    return stats.join(gone, "host", "left_anti")


def with_delta(rows: DataFrame, stats: DataFrame, host: Column) -> DataFrame:
    """Add the current `delta` of each row's host (H6), 0 for unknown ones."""
    return rows.withColumn("_h", host).join(stats.select(F.col("host").alias("_h"), "delta"), "_h", "left").withColumn("delta", F.coalesce("delta", F.lit(0.0))).drop("_h")


def one_per_host(items: DataFrame, batch: str = "batch_id", pos: str = "pos", url: str = "url") -> DataFrame:
    """The first item of each host in a batch, which is observed (H7); items without a host are not."""
    from pagesift.operators.ranking import first_rows

    keyed = items.withColumn("host", learner_host(url)).where("host != ''")
    return first_rows(keyed, [batch, "host"], [pos])


def delta_changes(stats: DataFrame, before: DataFrame) -> DataFrame:
    """Audit rows for hosts whose delta differs from an earlier snapshot (SNK5): (`host`, `old`, `new`, `note`)."""
    avg = F.when(F.col("ok") > 0, F.col("score_sum") / F.col("ok")).otherwise(0.0)
    note = F.format_string("delta=%+.1f (avg=%.2f low=%.2f n=%d)", F.col("delta"), avg, F.col("low") / F.col("n"), F.col("n"))
    return stats.join(before.select("host", F.col("delta").alias("old")), "host", "left").where(F.col("delta") != F.coalesce("old", F.lit(0.0))).select("host", F.coalesce("old", F.lit(0.0)).alias("old"), F.col("delta").alias("new"), note.alias("note"))
