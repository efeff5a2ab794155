"""Temporal memory of a stream: what each frame is told of the frames before it, as they arrive.

Frames wait in the state of their group until the watermark has passed them, so order of arrival does not matter within the
delay; then they are taken in order. The state of a group is the frames that wait (list state, packed by some thousand frames)
and one value: its last frame, the timer that is set, the earliest frame that waits, its last changes and the keys it has shown
in first-seen order. A call of a group thus costs a few messages between Python and the store, whatever the number of frames.
One timer per group stands at its latest waiting frame; frames that the watermark has passed also leave when the group's next
rows come.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.memory import SHORT_TERM, MemoryBuilder
from ..session import ship_package
from ..sources.files import scratch

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_OUT = "key string, id long, short_term array<string>, long_term array<string>"
#: Frames in one entry of the list of those that wait.
_PACK = 2000
#: Later than any frame.
_NEVER = (1 << 63) - 1


class MemoryProcessor(StatefulProcessor):
    """Frames (key, at in microseconds, id, l0, l1) in; their memory out, in order of (at, id) within a key."""

    def __init__(self, short_term: int = SHORT_TERM):
        self.short_term = short_term

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at array<long>, id array<long>, l0 array<string>, l1 array<string>")
        self.known = handle.getValueState("known", "some boolean, l0 string, l1 string, timer long, earliest long, signs array<string>, changed array<string>, seen array<string>")

    def _known(self) -> list:
        return list(self.known.get() or (False, "", "", -1, _NEVER, [], [], []))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        known, new = self._known(), [(r["at"], r["id"], r["l0"], r["l1"]) for r in rows]
        latest = max((-(-x[0] // 1000) for x in new), default=-1)  # timers go by milliseconds
        if latest > known[3]:
            if known[3] >= 0:
                self.handle.deleteTimer(known[3])
            self.handle.registerTimer(latest)
            known[3] = latest
        yield from self._taken(key, known, new, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        upto, known = expiredTimerInfo.getExpiryTimeInMs(), self._known()
        if known[3] <= upto:
            known[3] = -1
        yield from self._taken(key, known, [], upto)

    def _wait(self, frames: list[tuple], write) -> None:
        write([tuple(map(list, zip(*frames[i : i + _PACK], strict=True))) for i in range(0, len(frames), _PACK)])

    def _taken(self, key, known: list, new: list[tuple], upto: int) -> Iterator[Row]:
        """The memory of the waiting frames up to a time, which then count as seen; the others wait on."""
        some, l0, l1, timer, earliest, signs, changed, seen = known
        first = min((x[0] for x in new), default=_NEVER)
        if min(earliest, first) > 1000 * upto:
            if new:
                self._wait(new, self.waiting.appendList)
            self.known.update((some, l0, l1, timer, min(earliest, first), signs, changed, seen))
            return
        old = self.waiting.get() if earliest < _NEVER else ()
        # a frame that came twice counts once, as it came last
        frames = {x[:2]: x[2:] for x in [*(x for pack in old for x in zip(*pack, strict=True)), *new]}
        late = [(*at, *said) for at, said in frames.items() if at[0] > 1000 * upto]
        builder = MemoryBuilder(self.short_term)
        builder.log, builder.seen, builder.last = list(zip(signs, changed, strict=True)), dict.fromkeys(seen), (l0, l1) if some else None
        for at in sorted(at for at in frames if at[0] <= 1000 * upto):
            long_term, short_term = builder.before()
            yield Row(key=key[0], id=at[1], short_term=short_term, long_term=long_term)
            builder.record(*frames[at])
            builder.log = builder.log[-self.short_term :]
        if late:
            self._wait(late, self.waiting.put)
        elif earliest < _NEVER:
            self.waiting.clear()
        self.known.update((True, *builder.last, timer, min((x[0] for x in late), default=_NEVER), [s for s, _ in builder.log], [k for _, k in builder.log], list(builder.seen)))

    def close(self) -> None:
        pass


def stream_memory(frames: DataFrame, delay: str = "10 minutes", short_term: int = SHORT_TERM) -> DataFrame:
    """Memory of a stream of (key string, ts timestamp, id long, l0 string, l1 string): key, id, short_term, long_term.

    As `memory.with_memory` by key in order of (ts, id), for frames that come at most `delay` after later ones; others are
    dropped. A frame of a recording's end that is later than `delay` lets all before it out. Needs `rocksdb_state`.
    """
    ship_package(frames.sparkSession)
    rows = frames.select("key", "ts", F.unix_micros("ts").alias("at"), "id", F.coalesce("l0", F.lit("")).alias("l0"), F.coalesce("l1", F.lit("")).alias("l1"))
    return rows.withWatermark("ts", delay).groupBy("key").transformWithState(MemoryProcessor(short_term), _OUT, "append", "EventTime")


@contextmanager
def rocksdb_state(spark: SparkSession):
    """Streams started within keep their state in RocksDB, as transformWithState asks."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


class MemoryStream:
    """A folder of frames, the memory written of them, and the checkpoint between runs; each `run` takes what is new and ends."""

    def __init__(self, spark: SparkSession, source: str, root: str | None = None, delay: str = "10 minutes", short_term: int = SHORT_TERM):
        self.spark, self.source, self.delay, self.short_term = spark, source, delay, short_term
        self.root = root or scratch(spark, "memory-stream")

    def run(self) -> None:
        with rocksdb_state(self.spark):
            frames = self.spark.readStream.schema("key string, ts timestamp, id long, l0 string, l1 string").parquet(self.source)
            out = stream_memory(frames, self.delay, self.short_term).writeStream.format("parquet").option("path", f"{self.root}/memory").option("checkpointLocation", f"{self.root}/checkpoint")
            out.trigger(availableNow=True).start().awaitTermination()

    def rows(self) -> DataFrame:
        return self.spark.read.schema(_OUT).parquet(f"{self.root}/memory")
