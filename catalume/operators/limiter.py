"""Sliding-window admission of requests, as a batch over recorded requests; daily cap."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SECOND = 1_000_000


def decide(admitted: deque[int], now: int, most: int, window: int) -> int:
    """0 and ``now`` noted if a request is admitted, else the seconds to wait; all times in microseconds."""
    while admitted and admitted[0] < now - window:
        admitted.popleft()
    if len(admitted) < most:
        admitted.append(now)
        return 0
    return max(1, (admitted[0] + window - now) // SECOND + 1)


def sliding_window(requests: DataFrame, most: int, window_seconds: int) -> DataFrame:
    """(event_id, origem, allowed, wait_s) of requests (event_id, origem, quando as microseconds).

    An origin's requests are taken in order of time, ties by event_id; only
    admitted ones count, for ``window_seconds``, bounds included. Requests are
    dealt by origin and sorted outside Python, which holds one origin's
    admitted instants, ``most`` at most. As each decision depends on the ones
    before it, one origin's requests are taken by one task, however many.
    """
    window = window_seconds * SECOND

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, admitted = None, deque()
        for batch in batches:
            waits = []
            for origin, now in zip(batch["origem"].tolist(), batch["quando"].tolist(), strict=True):
                if origin != current:
                    current, admitted = origin, deque()
                waits.append(decide(admitted, now, most, window))
            out = batch[["event_id", "origem"]].copy()
            out["wait_s"] = waits
            out["allowed"] = out["wait_s"] == 0
            yield out[["event_id", "origem", "allowed", "wait_s"]]

    rows = requests.select("event_id", "origem", "quando").repartition("origem").sortWithinPartitions("origem", "quando", "event_id")
    kind = dict(requests.dtypes)
    return rows.mapInPandas(run, f"event_id {kind['event_id']}, origem {kind['origem']}, allowed boolean, wait_s bigint")


def sliding_fold(requests: DataFrame, most: int, window_seconds: int) -> DataFrame:
    """``sliding_window`` as a fold in SQL functions; an origin's requests are gathered, so it suits origins with few."""
    window = window_seconds * SECOND
    listed = requests.groupBy("origem").agg(F.array_sort(F.collect_list(F.struct("quando", "event_id"))).alias("asked"))
    start = F.struct(F.array().cast("array<bigint>").alias("held"), F.array().cast("array<struct<event_id:bigint,wait_s:bigint>>").alias("out"))

    def step(state: Column, r: Column) -> Column:
        held = F.filter(state["held"], lambda x: x >= r["quando"] - window)
        room = F.size(held) < most
        wait = F.when(room, F.lit(0).cast("bigint")).otherwise(F.greatest(F.lit(1).cast("bigint"), F.floor((F.array_min(held) + window - r["quando"]) / SECOND) + 1))
        after = F.when(room, F.concat(held, F.array(r["quando"]))).otherwise(held)
        return F.struct(after.alias("held"), F.concat(state["out"], F.array(F.struct(r["event_id"].alias("event_id"), wait.alias("wait_s")))).alias("out"))

    flat = listed.select("origem", F.explode(F.aggregate("asked", start, step)["out"]).alias("o"))
    return flat.select("o.event_id", "origem", (F.col("o.wait_s") == 0).alias("allowed"), "o.wait_s")


def daily_state(calls: DataFrame, cap: int) -> DataFrame:
    """(dia, chamadas, reduzido): model calls (ts) per UTC day and whether the cap was reached."""
    counted = calls.groupBy(F.to_date("ts").alias("dia")).agg(F.count("*").alias("chamadas"))
    return counted.withColumn("reduzido", F.col("chamadas") >= cap)


def calls_under_cap(calls: DataFrame, cap: int) -> DataFrame:
    """(event_id, reduzido): whether a call came after the day's cap was used up, by time.

    Only a day's first ``cap`` calls are ordered; the last of them splits the
    day. Up to spark.sql.optimizer.windowGroupLimitThreshold (1,000 where not
    set) that limit holds before rows are shuffled; with a higher cap, raise
    it too, or a day's calls are sorted by one task.
    """
    rows = calls.select("event_id", "ts", F.to_date("ts").alias("dia"))
    first = rows.withColumn("k", F.row_number().over(Window.partitionBy("dia").orderBy("ts", "event_id"))).where(F.col("k") <= cap)
    last = first.groupBy("dia").agg(F.max(F.struct("ts", "event_id")).alias("last"))
    return rows.join(last, "dia", "left").select("event_id", (F.struct("ts", "event_id") > F.col("last")).alias("reduzido"))
