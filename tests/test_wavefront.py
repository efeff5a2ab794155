"""Prediction of many groups at once held against prediction frame by frame, with runs that end early."""

import random

import pytest

from strataline.operators import inference as P
from strataline.operators.wavefront import PredictionRuns, wavefront
from strataline.sources.files import scratch

SAMPLE = "id string, take string, role string, role_human string, l2_segment_id string, tp_id string, image array<string>, gt_l0 string, gt_l1 string, gt_l2 string"


@pytest.fixture(scope="module")
def samples(spark):
    rng = random.Random(7)
    rows = [(f"{g}-{t}", f"t{g % 3}", f"r{g % 5}", None if g % 4 else "R", f"s{g}", f"{t:06d}", [f"{g}.jpg"] if t % 3 else None, rng.choice(["a", "b", None]), rng.choice("xy"), "z") for g in range(30) for t in range(rng.randint(1, 9))]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, SAMPLE).repartition(3)


def says(images, role, memory):
    """Depends on all that it is asked."""
    return "" if len(memory) % 7 == 3 else f"L0: p{memory.count('+L0') % 3} | L1: {role}{len(images)} | L2: {memory.replace(chr(10), ' ')}"


def ask(requests):
    return [says(*r) for r in requests]


@pytest.mark.parametrize("mode", ["predicted", "gt", "none"])
@pytest.mark.parametrize("fill", [True, False])
def test_answers_are_those_of_frame_by_frame(spark, samples, mode, fill):
    runs = PredictionRuns(spark, scratch(spark, "predictions"))
    assert runs.run(samples, ask, mode, fill, wave=4, bundle=3) == 30
    key = lambda df: sorted(map(repr, (r.asDict() for r in df.select(*runs.rows().columns).collect())))
    assert key(runs.rows()) == key(P.predict(samples, says, mode, fill))


def test_a_call_asks_all_open_groups():
    groups = [[dict(id=f"{g}{t}", take="t", role="r", role_human="", tp_id=str(t), l2_segment_id=str(g), image=[], gt_l0="a", gt_l1="b", gt_l2="c") for t in range(n)] for g, n in enumerate([5, 1, 3, 9, 2])]
    sizes = []

    def counted(requests):
        sizes.append(len(requests))
        return ask(requests)

    done = list(wavefront(iter(groups), counted, "predicted", True, 5, 100))
    assert sizes == [5, 4, 3, 2, 2, 1, 1, 1, 1] and sorted(map(len, done)) == [1, 2, 3, 5, 9]  # no more calls than the longest group
    sizes.clear()
    assert len(list(wavefront(iter(groups), counted, "predicted", True, 5, 2))) == 5 and max(sizes) == 2
    with pytest.raises(ValueError, match="answers"):
        list(wavefront(iter(groups), lambda r: [], "none", True, 5, 2))


def test_a_run_that_ends_early_is_resumed(spark, samples):
    """The model dies in every task; what is written is whole groups, and the next run asks for the others only."""
    root = scratch(spark, "predictions")
    runs = PredictionRuns(spark, root)
    calls = []

    def dies(requests, left=[6]):  # noqa: B006  (a count of each worker's own)
        left[0] -= 1
        if left[0] < 0:
            raise RuntimeError("the model is gone")
        return ask(requests)

    with pytest.raises(Exception, match="the model is gone"):
        runs.run(samples, dies, wave=2, bundle=1)
    some = runs.rows().collect()
    whole = {(r.take, r.role, r.l2_segment_id): r.n for r in samples.groupBy("take", "role", "l2_segment_id").agg({"*": "count"}).withColumnRenamed("count(1)", "n").collect()}
    found = {}
    for r in some:
        found[r.take, r.role, r.l2_segment_id] = found.get((r.take, r.role, r.l2_segment_id), 0) + 1
    assert 0 < len(found) < 30 and all(n == whole[g] for g, n in found.items())
    assert runs.run(samples, ask) == 30 - len(found)
    assert runs.run(samples, ask) == 0 and not calls
    key = lambda df: sorted(map(repr, (r.asDict() for r in df.select(*runs.rows().columns).collect())))
    assert key(runs.rows()) == key(P.predict(samples, says))
    # a sample more: its group is predicted anew, whole, and replaces the old one
    more = samples.unionByName(spark.createDataFrame([("0-new", "t0", "r0", "R", "s0", "000099", None, "a", "x", "z")], SAMPLE))
    assert runs.run(more, ask) == 1
    assert key(runs.rows()) == key(P.predict(more, says))


def test_no_samples(spark, samples):
    runs = PredictionRuns(spark, scratch(spark, "predictions"))
    assert runs.run(samples.where("false"), ask) == 0 and runs.rows().count() == 0
