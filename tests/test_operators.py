"""Joins, grouping, assembly, baselines, metrics and text functions."""

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from strataline.functions import metrics as M
from strataline.functions import text as T
from strataline.functions import vocab as V
from strataline.operators import assemble as A
from strataline.operators import baselines as L
from strataline.operators import grouping as G
from strataline.operators import inference as P
from strataline.operators import intervals as J
from strataline.operators import labels as B
from strataline.operators import timeline as S


def one(spark, column, **values):
    return spark.createDataFrame([Row(**values)]).select(column.alias("x")).first().x


def test_role_and_tool_timelines(spark):
    rows = [("t", "1", "nurse", "CloseTo", "ot"), ("t", "1", "head_surgeon", "Sawing", "patient"), ("t", "2", "nurse", "Holding", "drill"), ("t", "2", "nurse", "Holding", "drill"), ("t", "2", "patient", "Holding", "saw"), ("t", "3", "nurse", "Unknown", "ot")]
    df = spark.createDataFrame(rows, "take string, tp_id string, subj string, pred string, obj string")
    roles = {(r.tp_id, r.role): [tuple(x) for x in r.state] for r in S.role_timeline(df).collect()}
    assert roles == {("1", "nurse"): [], ("1", "head_surgeon"): [("Sawing", "patient")], ("2", "nurse"): [("Holding", "drill")], ("3", "nurse"): []}
    tools = {(r.tp_id, r.role): [tuple(x) for x in r.state] for r in S.tool_timeline(df).collect()}
    assert tools == {("1", "saw"): [("Sawing", "head_surgeon")], ("2", "drill"): [("Holding", "nurse")], ("2", "saw"): [("Holding", "patient")]}


def test_screen_choice(spark):
    rows = [("k", 0, "A", "phase", "0.5"), ("k", 1, "B", "phase", "0.5"), ("k", 2, "C", "current_step", "bad"), ("k", 3, "D", "other", "9"), ("m", 0, "E", "phase", "-1"), ("m", 1, "F", "phase", None)]
    got = {r.k: (r.phase, r.step) for r in S.screen_choice(spark.createDataFrame(rows, "k string, pos int, name string, type string, certainty string"), ["k"], ["pos"]).collect()}
    assert got == {"k": ("A", "C"), "m": ("F", None)}


def test_overlap_bounds_are_closed(spark):
    seg = spark.createDataFrame([("t", "s1", 10, 20), ("t", "s2", None, 5), ("t", "s3", 0, 200)], "take string, id string, time_start int, time_end int")
    said = spark.createDataFrame([("t", 0, 0.0, 10.0, "touch"), ("t", 1, 20.0, 30.0, "edge"), ("t", 2, 20.1, 30.0, "after"), ("u", 3, 10.0, 20.0, "other")], "take string, ord int, start_s double, end_s double, text string")
    got = {r.id: [x.text for x in r.transcript] for r in J.overlap_lists(seg, said, ["take"], "id", width=7.0).collect()}
    assert got == {"s1": ["touch", "edge"], "s3": ["touch", "edge", "after"]}


def test_as_of_ties_go_to_the_earlier(spark):
    q = spark.createDataFrame([("a", 5), ("a", 0), ("a", 9), ("b", 1), ("a", 4)], "k string, t int")
    v = spark.createDataFrame([("a", 4), ("a", 6), ("a", 4)], "k string, v int")
    got = {(r.k, r.t): (r.previous, r.following, r.nearest) for r in J.as_of(q, v, ["k"], "t", "v").collect()}
    assert got == {("a", 5): (4, 6, 4), ("a", 0): (None, 4, 4), ("a", 9): (6, None, 6), ("b", 1): (None, None, None), ("a", 4): (4, 4, 4)}


def test_label_first_interval_wins(spark):
    p = spark.createDataFrame([("a", 1), ("a", 5), ("a", 11)], "k string, t int")
    i = spark.createDataFrame([("a", 0, 5, "x", 0), ("a", 5, 9, "y", 1)], "k string, s int, e int, label string, ord int")
    assert {r.t: r.label for r in J.label_points(p, i, ["k"], "t", ("s", "e"), "label", "ord", 3).collect()} == {1: "x", 5: "x", 11: None}


def test_labels_fill_gaps_and_later_segments_win(spark):
    l0 = spark.createDataFrame([("r", "a", 0, 1, 4, "A"), ("r", "b", 1, 4, 6, "B"), ("r", "c", 2, 9, 9, "C")], "role string, segment_id string, ord int, tp_start int, tp_end int, description string")
    l1 = spark.createDataFrame([("r", "p", 0, ["a", "b"], "P"), ("r", "q", 1, ["b"], "Q")], "role string, segment_id string, ord int, children array<string>, summary string")
    l2 = spark.createDataFrame([("r", "z", 0, ["p", "q", "gone"], "Z")], "role string, segment_id string, ord int, children array<string>, summary string")
    got = {r.tp: (r.l0, r.l1, r.l2) for r in B.frame_labels(l0, l1, l2, ["role"]).collect()}
    assert got == {1: ("A", "P", "Z"), 2: ("A", "P", "Z"), 3: ("A", "P", "Z"), 4: ("B", "Q", "Z"), 5: ("B", "Q", "Z"), 6: ("B", "Q", "Z")}
    assert sorted(r.tp for r in B.time_points(l0, l1, l2, ["role"]).collect()) == [1, 2, 3, 4, 5, 6]


def test_chunk_answers_merge():
    ids = [f"s{i}" for i in range(31)]
    first = [{"segment_ids": ids[:20]}, {"segment_ids": ids[20:28]}, {"segment_ids": ids[28:30]}]
    got = G.merge_chunks(ids, [first, [{"segment_ids": ids[27:31]}]])
    assert [g["segment_ids"] for g in got] == [ids[:20], ids[20:27], ids[27:31]]
    import pandas as pd

    whole = G.group_segments(pd.DataFrame({"segment_id": ids}), lambda s: [{"segment_ids": s["segment_id"].tolist()}])
    assert [g["segment_ids"] for g in whole] == [ids[:27], ids[27:]]
    assert G.group_segments(pd.DataFrame({"segment_id": ids}), lambda s: None) is None


def step(*ids, summary="", audio=""):
    return {"segment_ids": list(ids), "time_start": 0, "time_end": 1, "summary": summary, "audio_summary": audio}


@pytest.mark.parametrize(
    ("steps", "idle", "expected"),
    [
        ([step("i"), step("a", summary="x")], {"i"}, [["i", "a"]]),
        ([step("a", summary="x"), step("i")], {"i"}, [["a", "i"]]),
        ([step("a", summary="cut bone"), step("i"), step("b", summary="cut bone")], {"i"}, [["a", "i", "b"]]),
        ([step("a", summary="cut bone"), step("i"), step("b", summary="clean up")], {"i"}, [["a", "i"], ["b"]]),
        ([step("i")], {"i"}, [["i"]]),
        ([step("i"), step("j"), step("k")], {"i", "j", "k"}, [["i", "j", "k"]]),
        ([step("a", "i"), step("b")], {"i"}, [["a", "i"], ["b"]]),
    ],
)
def test_idle_steps_fold(steps, idle, expected):
    got = G.fold_idle(steps, idle, G.token_similarity)
    assert [s["segment_ids"] for s in got] == expected


def test_group_issues(spark):
    groups = spark.createDataFrame([("r", 0, ["a", "b"], "x"), ("r", 1, [], "y"), ("r", 2, ["zz"], ""), ("o", 0, ["b", "a"], "x")], "role string, ord int, segment_ids array<string>, summary string")
    ids = spark.createDataFrame([("r", ["a", "b", "c"]), ("o", ["a", "b"])], "role string, ids array<string>")
    got = sorted(map(tuple, G.validate_groups(groups, ids, ["role"]).collect()))
    assert got == [("o", "out of order", ""), ("r", "empty group", ""), ("r", "missing segments", "c"), ("r", "missing summary", "zz"), ("r", "unknown segments", "zz")]


def test_assembly(spark):
    rows = [("x", "r", "r_L2_004", f"{i:03d}", a, b, c, t) for i, (a, b, c, t) in enumerate([("p", "s", "m", None), ("p", "s", "n", 5), ("q", "s", "n", 6), ("q", "t", "m", 7)])]
    t = A.assemble(spark.createDataFrame(rows, "take string, role string, l2_segment_id string, tp_id string, l0 string, l1 string, l2 string, time int"))
    assert sorted((r.segment_id, r.tp_start, r.tp_end, r.time_start, r.time_end) for r in t["l0"].collect()) == [("r_L0_000", "000", "001", 0, 5), ("r_L0_001", "002", "002", 6, 6), ("r_L0_002", "003", "003", 7, 7)]
    assert sorted(r.segment_id for r in t["l1"].collect()) == ["r_L1_004_000", "r_L1_004_001"]
    assert [(r.segment_id, r.summary) for r in t["l2"].collect()] == [("r_L2_004", "m")]  # a tie: the first seen


def test_baselines(spark):
    rows = [(str(i), i, "t", "r", "s", i, x, x, x) for i, x in enumerate(["b", "a", "a", "b", "c"])]
    df = spark.createDataFrame(rows, "id string, ord int, take string, role string, l2_segment_id string, tp_id int, gt_l0 string, gt_l1 string, gt_l2 string")
    assert {r.pred_l0 for r in L.majority_class(df, df).collect()} == {"b"}
    assert {r.pred_l0 for r in L.majority_class(df.limit(0), df).collect()} == {""}
    assert [r.pred_l1 for r in L.copy_last(df).orderBy("ord").collect()] == ["", "b", "a", "a", "b"]
    one_, two = (sorted((r.id, r.pred_l0, r.pred_l2) for r in L.random_label(df, df).collect()) for _ in range(2))
    assert one_ == two and len(one_) == 5 and {x for _, x, _ in one_} <= {"a", "b", "c"}


def test_random_labels_follow_the_counts(spark):
    """One label per test row and level at any number of partitions, drawn by share, alike whatever the order of rows."""
    train = spark.range(20000).select(F.col("id").cast("string").alias("id"), F.when(F.col("id") % 10 < 7, "often").otherwise(F.concat(F.lit("x"), F.col("id") % 97)).alias("gt_l0"), F.lit("one").alias("gt_l1"), F.when(F.col("id") % 2 == 0, "even").alias("gt_l2"))
    test = spark.range(3000).select(F.col("id").cast("string").alias("id"))
    rows = [sorted(map(tuple, L.random_label(t, test.repartition(n)).collect())) for t, n in ((train, 2), (train.orderBy("gt_l0").repartition(7), 5))]
    assert rows[0] == rows[1] and len({i for i, *_ in rows[0]}) == len(rows[0]) == 3000
    assert abs(sum(a == "often" for _, a, _, _ in rows[0]) / 3000 - 0.7) < 0.03 and {b for _, _, b, _ in rows[0]} == {"one"} and {c for *_, c in rows[0]} == {"", "even"}
    assert {a for _, a, _, _ in L.random_label(train.limit(0), test).collect()} == {""}


def test_left_overlap_keeps_all(spark):
    left = spark.createDataFrame([("t", 1, 10, 20), ("t", 2, 30, 25), ("t", 3, 100, 110), (None, 4, 1, 2), ("t", 1, 10, 20), ("t", 5, None, 3)], "k string, id int, a int, b int")
    right = spark.createDataFrame([("t", 15, 15, "x"), ("t", 5, 50, "y")], "k string, s int, e int, v string")
    got = sorted(((r.id, r.v) for r in J.overlapping(left, right, ["k"], ("a", "b"), ("s", "e"), 7, "left").collect()), key=str)
    assert got == [(1, "x"), (1, "x"), (1, "y"), (1, "y"), (2, None), (3, None), (4, None), (5, None)]
    with pytest.raises(ValueError, match="outer"):
        J.overlapping(left, right, ["k"], ("a", "b"), ("s", "e"), 7, "outer")


def test_equal_points_all_get_labels(spark):
    p = spark.createDataFrame([("a", 1), ("a", 1), ("a", None), (None, 1)], "k string, t int")
    i = spark.createDataFrame([("a", 0, 5, "x", 0)], "k string, s int, e int, label string, ord int")
    assert sorted(((r.k, r.t, r.label) for r in J.label_points(p, i, ["k"], "t", ("s", "e"), "label", "ord", 3).collect()), key=str) == sorted([("a", 1, "x"), ("a", 1, "x"), ("a", None, None), (None, 1, None)], key=str)


def test_memory_equals_the_builder(spark):
    import random

    from strataline.operators.memory import MemoryBuilder, with_memory

    rng = random.Random(3)
    rows = [(g, i, rng.choice(["a", "b", ""]), rng.choice(["p", "q"])) for g in "xyz" for i in range(40)]
    got = {(r.g, r.i): (r.long_term, r.short_term) for r in with_memory(spark.createDataFrame(rows, "g string, i int, l0 string, l1 string"), ["g"], ["i"]).collect()}
    for g in "xyz":
        log = MemoryBuilder()
        for _, i, l0, l1 in (r for r in rows if r[0] == g):
            assert got[g, i] == log.before()
            log.record(l0, l1)


def test_plugged_in_models(spark):
    df = spark.createDataFrame([(1, "a b c d", "a b c x"), (2, None, "x"), (3, "runs", "running")], "k int, a string, b string")
    score = M.batch_score(lambda refs, hyps: [float(len(r) + len(h)) for r, h in zip(refs, hyps, strict=True)])
    assert {r.k: r.x for r in df.select("k", score(F.col("a"), F.col("b")).alias("x")).collect()} == {1: 14.0, 2: None, 3: 11.0}
    stemmed = df.select("k", M.text_scores(F.col("a"), F.col("b"), stem=lambda w: w[:3])["rouge1"].alias("x"))
    assert {r.k: r.x for r in stemmed.collect()} == {1: 0.75, 2: None, 3: 1.0}
    said = P.answer_batch(df, "a", lambda prompts: [f"<think>x</think>User\n {p.upper()} " for p in prompts])
    assert {r.k: r.answer for r in said.collect()} == {1: "A B C D", 2: None, 3: "RUNS"}


def test_metrics(spark):
    long = "the nurse is holding the bone saw near the table"
    assert M.bleu(long, long) == pytest.approx(1.0) and M.bleu("", long) == 0 and M.bleu("a b", "c d") == 0
    assert M.rouge_l(long, long) == 1 and M.rouge_l("a b c d", "a c b d") == pytest.approx(0.75) and M.rouge1("A b!", "b, a") == 1
    a, b = "abcbdab" * 9, "bdcaba" * 11
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    assert M.lcs_length(list(a), list(b)) == table[-1][-1]
    df = spark.createDataFrame([(1, "the a a b", "a a a c"), (2, "", "x"), (3, None, "x")], "k int, a string, b string")
    assert {r.k: round(r.rouge1, 6) for r in M.rouge1_table(df, "k", "a", "b").collect()} == {1: 0.5, 2: 0.0, 3: 0.0}
    pred = spark.createDataFrame([("1", " x\n", "y", "z"), ("9", "x", "y", "z")], "id string, pred_l0 string, pred_l1 string, pred_l2 string")
    gt = spark.createDataFrame([("1", 0, "old", "old", "old"), ("1", 1, "x", "q", "z")], "id string, ord int, gt_l0 string, gt_l1 string, gt_l2 string")
    got = {(r.level, r.metric): r.value for r in M.evaluate(pred, gt).collect()}
    assert got["all", "matched"] == 1 and got["all", "total_predictions"] == 2 and got["l0", "exact_match"] == 1 and got["l1", "exact_match"] == 0
    assert {(r.level, r.metric): r.value for r in M.evaluate(pred.where("id = '9'"), gt).collect()} == {("all", "matched"): 0.0}


def test_text_functions(spark):
    assert one(spark, T.strip_think(F.col("t")), t=" <think>a\nb</think> c <think>d</think>\n") == "c"
    assert one(spark, T.drop_speaker(F.col("t")), t="Assistant\nuser\n hi ") == "hi"
    assert tuple(one(spark, T.parse_output(F.col("t")), t="L0: a | b | L1: c|L1:d")) == ("a", "d", "")
    assert one(spark, V.humanize(F.col("t")), t="c_arm") == "C-arm" and one(spark, V.humanize(F.col("t")), t="new_thing") == "new thing"
    assert one(spark, T.memory_string(F.array(F.lit("L1:x")), F.array().cast("array<string>")), t=1) == "<memory_start>\nLong: L1:x\n<memory_end>"
    assert one(spark, T.l2_index(F.col("t"), F.lit(7)), t="nurse_L2_012") == 12 and one(spark, T.l2_index(F.col("t"), F.lit(7)), t="nurse") == 7
    assert one(spark, F.array_join(T.relative_images(F.array(F.lit("/data/processed/t/a.jpg"), F.lit("b.jpg"), F.lit("t/c.jpg")), F.lit("t")), ","), t=1) == "t/a.jpg,t/b.jpg,t/c.jpg"
    assert [one(spark, T.is_take(F.col("t")), t=x) for x in ("012_PKA", "012_1_TKA", "take_jsons", "12_PKA")] == [True, True, False, False]
    state = F.array(F.struct(F.lit("Phase").alias("p"), F.lit("Idle").alias("o")))
    assert one(spark, T.is_idle(state), t=1) and one(spark, T.describe_robot(F.lit("robot_setup"), state), t=1) == "robot setup (physical): Idle"
    assert one(spark, T.describe_union(F.array(state, state)), t=1) == "Phase Idle"


def test_augmentation_shares(spark):
    df = spark.range(20000).select(T.augment_memory(1, F.col("id"), F.array(*[F.lit(f"l{i}") for i in range(8)]), F.array(*[F.lit(f"s{i}") for i in range(8)])).alias("m"), T.augment_views(1, F.col("id"), F.array(*map(F.lit, "abcd"))).alias("v"))
    r = df.agg(F.avg((F.col("m") == "").cast("int")).alias("none"), F.avg((F.contains("m", F.lit("Long")) & F.contains("m", F.lit("Short"))).cast("int")).alias("both"), F.min(F.size("v")).alias("least"), F.avg(F.size("v")).alias("mean"), F.countDistinct("v").alias("orders")).first()
    assert abs(r.none - 0.5) < 0.02 and abs(r.both - 1 / 6) < 0.02 and r.least == 1 and 1.9 < r.mean < 2.2 and r.orders > 50


def test_prediction_memory(spark):
    rows = [(f"{i}", "t", "r", "R", "s", f"{i}", ["a.jpg"], f"g{i}", "G", "Z") for i in range(4)]
    df = spark.createDataFrame(rows, "id string, take string, role string, role_human string, l2_segment_id string, tp_id string, image array<string>, gt_l0 string, gt_l1 string, gt_l2 string")

    def says(images, role, memory):
        return f"L0: p{memory.count('+L0')} | L1: q | L2: {memory.replace(chr(10), ' ')}"

    got = [r.raw_output for r in P.predict(df, says).orderBy("tp_id").collect()]
    assert "+L0" not in got[0] and "+L0:p0" in got[1] and got[1].split("L2:")[1] == got[2].split("L2:")[1] and "+L0:p1" in got[3]
    truth = [r.raw_output for r in P.predict(df, says, mode="gt").orderBy("tp_id").collect()]
    assert all(f"+L0:g{i - 1}" in truth[i] for i in (1, 2, 3))
    assert all("memory" not in r.raw_output for r in P.predict(df, says, mode="none").collect())
