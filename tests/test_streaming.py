"""The streaming query closes the segments that the batch query finds."""

import random

from strataline.operators import islands as I
from strataline.streaming.segments import stream_segments


def test_stream_equals_batch(spark, tmp_path):
    rng = random.Random(6)
    rows = [(f"k{k}", t, rng.choice("AAB")) for k in range(4) for t in range(30)]
    schema = "key string, tp long, state string"
    batch = spark.createDataFrame(rows, schema)
    ends = [(f"k{k}", 99, None) for k in range(4)]
    for i, part in enumerate([[r for r in rows if r[1] < 13], [r for r in rows if r[1] >= 13], ends]):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    q = stream_segments(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect()))
    want = I.segments(batch, "key", "tp", "state", 2).select("key", "tp_start", "tp_end", "n_frames", "state")
    assert got == sorted(map(tuple, want.collect()))


def test_memory_of_a_stream_equals_batch(spark):
    """Frames in shuffled micro-batches, each taken by a run of its own that starts from the checkpoint of the last."""
    import random

    from pyspark.sql import functions as F

    from strataline.operators.memory import with_memory
    from strataline.sources.files import scratch
    from strataline.streaming.memory import MemoryStream

    rng = random.Random(5)
    rows = [(f"take-{k}", 1_700_000_000 + 60 * t, 100 * k + t, rng.choice(["a", "b", "", "c"]), rng.choice(["p", "q"])) for k in range(4) for t in range(40 if k else 3)]
    rows += [("take-1", 1_700_000_000 + 60 * 5, 999, "tie", "p")]
    frames = spark.createDataFrame(rows, "key string, s long, id long, l0 string, l1 string").withColumn("ts", F.timestamp_seconds("s"))
    want = {r.id: (r.short_term, r.long_term) for r in with_memory(frames, ["key"], ["ts", "id"]).collect()}
    source = scratch(spark, "frames")
    stream = MemoryStream(spark, source, delay="20 minutes")
    mixed = sorted(rows, key=lambda r: r[1] + 60 * rng.uniform(0, 15))  # a frame comes at most 15 minutes late
    end = [("end", 1_800_000_000, 0, "", "")]
    for part in (mixed[:50], mixed[50:], end):
        # what a source folder gets while no stream runs
        spark.createDataFrame(part, "key string, s long, id long, l0 string, l1 string").withColumn("ts", F.timestamp_seconds("s")).select("key", "ts", "id", "l0", "l1").repartition(3).write.mode("append").parquet(source)
        stream.run()
    got = stream.rows().where("key <> 'end'").collect()
    assert len(got) == len(rows) and {r.id: (r.short_term, r.long_term) for r in got} == want


def test_messages_to_the_store_do_not_grow_with_frames():
    """A group's call sends a few messages, however many frames wait; two calls and a timer give the memory frame by frame."""
    from types import SimpleNamespace as Box

    from strataline.operators.memory import MemoryBuilder
    from strataline.streaming.memory import MemoryProcessor

    sent = []

    class Store:
        def __init__(self):
            self.value = None

        def get(self):
            sent.append("get")
            return self.value if not isinstance(self.value, list) else iter(self.value)

        def put(self, value):
            sent.append("put")
            self.value = value

        update = put

        def appendList(self, value):  # noqa: N802
            sent.append("append")
            self.value = [*(self.value or []), *value]

        def clear(self):
            sent.append("clear")
            self.value = None

    timers = set()
    handle = Box(getListState=lambda *a: Store(), getValueState=lambda *a: Store(), registerTimer=timers.add, deleteTimer=timers.remove)
    p = MemoryProcessor(3)
    p.init(handle)
    rng = random.Random(4)
    rows = [{"at": 1000 * t, "id": t % 7, "l0": rng.choice("ab"), "l1": rng.choice(["", "p"])} for t in range(5000)]
    mixed = rng.sample(rows, len(rows))
    at = lambda ms: Box(getCurrentWatermarkInMs=lambda: ms)
    assert not list(p.handleInputRows(("k",), iter(mixed[:2500]), at(-1)))
    early = {r["at"] for r in mixed[:2500] if r["at"] <= 1_000_000}
    rest = [r for r in mixed[2500:] if r["at"] > 1_000_000]
    out = list(p.handleInputRows(("k",), iter(rest), at(1000)))
    assert timers == {max(r["at"] for r in mixed[:2500] + rest) // 1000} and len(out) == len(early)
    out += p.handleExpiredTimer(("k",), None, Box(getExpiryTimeInMs=lambda: max(timers)))
    builder, want = MemoryBuilder(3), []
    for r in rows:
        if r["at"] in early or r["at"] > 1_000_000:
            long_term, short_term = builder.before()
            want.append((r["id"], short_term, long_term))
            builder.record(r["l0"], r["l1"])
    assert [(r.id, r.short_term, r.long_term) for r in out] == want
    assert len(sent) <= 15, sent
