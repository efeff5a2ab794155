"""Folding of idle steps as one plan held against the sequential rule."""

import random

from strataline.operators import grouping as G


def test_random_roles(spark):
    rng = random.Random(4)
    says = ["holds the drill", "holds the saw", "The drill holds", "", None, "waits here", "a a b", "a b b"]
    rows = []
    for r in range(120):
        for i in range(rng.randint(1, 9)):
            ids = [f"{r}-{i}-{j}" for j in range(rng.choice([1, 1, 1, 2]))]
            rows.append((f"r{r}", i, ids, ids if rng.random() < 0.5 else [], i * 2 if i % 4 else None, i * 2 + 1, rng.choice(says), rng.choice(["", None, "hum", "beep"])))
    df = spark.createDataFrame(rows, "role string, ord int, segment_ids array<string>, idle_ids array<string>, time_start int, time_end int, summary string, audio_summary string").repartition(3)
    key = lambda t: sorted(map(repr, (tuple(r) for r in t.select("role", "ord", "segment_ids", "time_start", "time_end", "summary", "audio_summary").collect())))
    plan = G.fold_idle_steps(df, ["role"])
    assert "Python" not in plan._jdf.queryExecution().toString() and "Pandas" not in plan._jdf.queryExecution().toString()
    want = []
    for r in range(120):
        own = sorted((x for x in rows if x[0] == f"r{r}"), key=lambda x: x[1])
        steps = [dict(segment_ids=list(x[2]), time_start=x[4], time_end=x[5], summary=x[6], audio_summary=x[7]) for x in own]
        for n, s in enumerate(G.fold_idle(steps, {i for x in own for i in x[3]}, G.token_similarity)):
            want.append((f"r{r}", n, s["segment_ids"], s["time_start"], s["time_end"], s["summary"], s["audio_summary"]))
    assert key(plan) == sorted(map(repr, want))
