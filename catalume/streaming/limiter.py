"""The sliding-window limiter over a stream, with keyed state that goes when it is no longer needed."""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from catalume.operators.limiter import SECOND, decide

#: Places that origins share, if not said otherwise.
PLACES = 1024
_OUT = "event_id bigint, origem bigint, allowed boolean, wait_s bigint"


class Admission(StatefulProcessor):
    """Keeps the admitted instants of each origin of a place, ``most`` at most; with ``evict`` until none of them counts any more.

    A place has one timer, for the instant from which on those of its first origin are out of the window.
    """

    def __init__(self, most: int, window_seconds: int, evict: bool = False):
        self.most, self.window, self.evict = most, window_seconds * SECOND, evict

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.instants = handle.getValueState("instants", "origens array<struct<origem: bigint, quando: array<bigint>>>")

    def over(self, admitted: Iterable[int]) -> int:
        """The time in milliseconds from which on no instant counts."""
        return (max(admitted) + self.window) // 1000 + 1

    def first(self, held: dict[int, deque[int]]) -> int | None:
        """When the timer of a place that holds these has to fire."""
        return min(map(self.over, held.values()), default=None) if self.evict else None

    def keep(self, held: dict[int, deque[int]]) -> None:
        if held:
            self.instants.update(([(origin, list(admitted)) for origin, admitted in held.items()],))
        else:
            self.instants.clear()

    def held(self) -> dict[int, deque[int]]:
        kept = self.instants.get()
        return defaultdict(deque, {origin: deque(sorted(admitted)) for origin, admitted in kept[0]} if kept else {})

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        held = self.held()
        before = self.first(held)
        for now, event, origin in sorted(((r["quando"], r["event_id"], r["origem"]) for r in rows), key=lambda r: r[:2]):
            wait = decide(held[origin], now, self.most, self.window)
            yield Row(event_id=event, origem=origin, allowed=wait == 0, wait_s=wait)
        self.keep(held)
        after = self.first(held)
        if before != after:
            if before is not None:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(after)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        mark = timerValues.getCurrentWatermarkInMs()
        held = {origin: admitted for origin, admitted in self.held().items() if self.over(admitted) > mark}
        self.keep(held)
        if held:
            self.handle.registerTimer(self.first(held))
        return iter(())

    def close(self) -> None:
        pass


def admit(requests: DataFrame, most: int, window_seconds: int, late_seconds: int | None = None, places: int = PLACES) -> DataFrame:
    """(event_id, origem, allowed, wait_s) of a stream of requests (event_id, origem, quando as microseconds).

    Each micro-batch is taken in order of time; needs the RocksDB state store. State is read and written once for each
    place of a micro-batch, not for each origin, as every call to the store takes a millisecond or so; origins are dealt
    over ``places`` by a hash, so with more of them less is written again, and a task holds fewer requests at once. With ``late_seconds`` requests may come so
    much later than the newest one, by their own time, and those that come later still are passed over; the state of an
    origin then goes as soon as no request that may yet come can meet its newest admitted one, so what is kept is
    bounded by the origins of a window. Time is that of the requests, so a query over recorded ones ends as it should.
    """
    timed = requests
    if late_seconds is not None:
        timed = requests.withColumn("_ts", F.timestamp_micros("quando")).withWatermark("_ts", f"{late_seconds} seconds")
    return timed.withColumn("_place", F.pmod(F.xxhash64("origem"), F.lit(places)).cast("int")).groupBy("_place").transformWithState(
        statefulProcessor=Admission(most, window_seconds, late_seconds is not None),
        outputStructType=_OUT,
        outputMode="Append",
        timeMode="None" if late_seconds is None else "EventTime",
    )


def origins_kept(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The origins whose instants a query's checkpoint holds now."""
    state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "instants").load()
    return state.select(F.explode("value.origens").alias("o")).select("o.origem").distinct()
