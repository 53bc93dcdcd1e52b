"""The fold over host observations as a stream: state per host, late rows up to a watermark, updates as they come."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pagesift.functions.urls import learner_host
from pagesift.operators.learning import STATE, HostState, known

WATERMARK = "10 days"


def host_updates(observations: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """State of each host after every micro-batch that touched it: (`host`, state).

    observations: a stream of the table of `operators.learning`, with `obs_id` and a timestamp `observed_at`. Rows later
    than the watermark are dropped, repeated ones within it are ignored. Within a micro-batch the rows of a host are folded
    in event time.
    """
    rows = observations.withColumn("observed_at", F.col("observed_at").cast("timestamp")).withWatermark("observed_at", watermark).dropDuplicatesWithinWatermark(["obs_id"]).select(
        learner_host("host").alias("host"), F.coalesce("fetch_ok", F.lit(False)).alias("fetch_ok"), F.when(~F.isnan("score"), F.col("score")).alias("score"),
        F.coalesce(F.col("template_hit") | F.col("garbled_hit"), F.lit(False)).alias("bad"), F.when(F.col("latency") > 0, F.col("latency")).alias("latency"), F.col("observed_at").cast("double").alias("at"), "obs_id",
    ).where("host != ''")

    def update(key: tuple, batches: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        state = HostState(group.get) if group.exists else HostState()
        seen = pd.concat(batches).sort_values(["at", "obs_id"])
        for ok, score, bad, latency, at in seen[["fetch_ok", "score", "bad", "latency", "at"]].itertuples(index=False, name=None):
            state.add(ok, known(score), bad, known(latency), at)
        group.update(state.values())
        yield pd.DataFrame([(key[0], *state.values())], columns=["host", *HostState.__slots__])

    return rows.groupBy("host").applyInPandasWithState(update, f"host string, {STATE}", STATE, "update", GroupStateTimeout.NoTimeout)


def run_once(observations: DataFrame, folder: str, name: str) -> DataFrame:
    """Run the stream over what is there and give the last state of each host; `folder` takes the checkpoint."""
    spark = observations.sparkSession
    out = f"{folder}/{name}-updates"

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = host_updates(observations).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{folder}/{name}-checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    updates = spark.read.parquet(out)
    rest = [c for c in updates.columns if c not in ("host", "batch")]
    return updates.groupBy("host").agg(F.max_by(F.struct(*rest), "batch").alias("_s")).select("host", "_s.*")
