"""Readers and writers over a small tree of synthetic recordings."""

import json

import pytest
from pyspark.sql import functions as F

from strataline.sources import recordings as R
from strataline.sources import sinks as K


def write(path, content):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(content if isinstance(content, str) else json.dumps(content))


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    top = tmp_path_factory.mktemp("recordings")
    frames = [[f"{i * 2:06d}", {"original_timestamp": 100 + i, "azure": f"{i}", "simstation": f"s{i}", "extra": 1}] for i in range(12)]
    for take in ("901_PKA", "902_TKA", "not_a_take"):
        write(top / take / "timestamp_to_pcd_and_frames_list.json", frames)
        for i in range(12):
            write(top / take / "relation_labels" / f"{i:06d}.json", {"rel_annotations": [["nurse", "Holding", "drill"]]})
    write(top / "901_PKA" / "relation_labels" / "000003.json", "{broken")
    write(top / "901_PKA" / "relation_labels" / "000004.json", {"other": 1})
    write(top / "901_PKA" / "relation_labels" / "000099.json", "{broken but unmapped")
    write(top / "903_PKA" / "relation_labels" / "000000.json", {"rel_annotations": []})
    write(top / "take_timestamp_to_robot_phase" / "901_1_PKA.json", {"000001": "a", "000002": "b"})
    write(top / "take_timestamp_to_robot_phase" / "901_2_PKA.json", {"000002": "c"})
    write(top / "take_timestamp_to_robot_phase" / "902_TKA.json", {"000001": "own"})
    write(top / "take_timestamp_to_robot_phase" / "902_1_TKA.json", {"000001": "split"})
    write(top / "screen_summaries" / "901_PKA" / "s1.json", {"P": {"type": "phase", "certainty": 0.5}, "Q": {"type": "phase", "certainty": "0.5"}, "S": {"type": "current_step"}})
    write(top / "screen_summaries" / "901_PKA" / "s2.json", {"X": {"type": "other", "certainty": 1}})
    srt = "1\n00:00:01,500 --> 00:00:02.000\nhello\nworld\n\n2\nbad time\ntext\n\n3\n00:01:00,000 --> 00:01:01,250 x\nlater\n \n4\n00:00:01,000 --> 00:00:02,000\n"
    write(top / "take_transcripts" / "901_PKA.srt", srt)
    return str(top)


def test_frames_and_labels(spark, root):
    frames = R.frame_map(spark, root)
    assert frames.where("take = '901_PKA'").count() == 12
    r = frames.where("take = '901_PKA' and tp_id = '000005'").first()
    assert (r.original_timestamp, r.azure, r.simstation, r.tracker) == (105, "5", "s5", None)
    labels = {r.tp_id: [tuple(t) for t in r.triplets] for r in R.relation_labels(spark, root, frames).where("take = '901_PKA'").collect()}
    assert sorted(labels) == ["000000", "000001", "000002", *(f"{i:06d}" for i in range(5, 12)), "000099"]
    assert labels["000000"] == [("nurse", "Holding", "drill")] and labels["000099"] == []


def test_takes(spark, root):
    assert sorted(r.take for r in R.takes(spark, root).collect()) == ["901_PKA", "902_TKA"]
    assert R.takes(spark, root, 13).count() == 1


def test_robot_and_screens(spark, root):
    frames = R.frame_map(spark, root)
    got = {(r.take, r.tp_id): r.phase for r in R.robot_phases(spark, root, frames.where("take like '90%'")).collect()}
    assert got == {("901_PKA", "000001"): "a", ("901_PKA", "000002"): "c", ("902_TKA", "000001"): "own"}
    assert [tuple(r) for r in R.screen_summaries(spark, root, frames.where("take = '901_PKA'")).collect()] == [("901_PKA", "000001", "P", "S")]


def test_transcripts(spark, root):
    got = [(r.ord, r.start_s, r.end_s, r.text) for r in R.transcripts(spark, root).orderBy("ord").collect()]
    assert got == [(0, 1.5, 2.0, "hello world"), (2, 60.0, 61.25, "later")]


def test_predictions_resume(spark, tmp_path):
    assert R.predictions(spark, f"{tmp_path}/none.jsonl").count() == 0
    write(tmp_path / "p.jsonl", '{"id": "a", "pred_l0": "1"}\n{broken\n\n{"id": "", "pred_l0": "2"}\n{"id": "a", "pred_l0": "3"}\n{"pred_l0": "4"}\n')
    assert [(r.id, r.pred_l0) for r in R.predictions(spark, f"{tmp_path}/p.jsonl").collect()] == [("a", "3")]
    write(tmp_path / "s.jsonl", '{"id": "a"}\n{broken\n')
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        R.samples(spark, f"{tmp_path}/s.jsonl").collect()


def test_hierarchy_round_trip(spark, tmp_path):
    l0 = spark.createDataFrame([("t", "nurse", 1, "n_L0_001", "b"), ("t", "nurse", 0, "n_L0_000", "a"), ("t", "saw", 0, "s_L0_000", "c")], "take string, role string, ord int, segment_id string, description string")
    l1 = spark.createDataFrame([("t", "nurse", 0, "n_L1_000", ["n_L0_000", "n_L0_001"], "s")], "take string, role string, ord int, segment_id string, segment_ids array<string>, summary string")
    l2 = spark.createDataFrame([("t", "nurse", 0, "n_L2_000", ["n_L1_000"], "p")], "take string, role string, ord int, segment_id string, child_ids array<string>, summary string")
    doc = K.hierarchy_documents(l0, l1, l2).first()
    write(tmp_path / "t_hierarchy_x.json", doc.value)
    assert list(json.loads(doc.value)["roles"]) == ["nurse", "saw"]
    back = R.hierarchies(spark, f"{tmp_path}/*.json")
    assert [(r.take, r.role_key, r.ord, r.segment_id, r.role_human) for r in back["l0"].orderBy("role_key", "ord").collect()] == [("t", "nurse", 0, "n_L0_000", "nurse"), ("t", "nurse", 1, "n_L0_001", "nurse"), ("t", "saw", 0, "s_L0_000", "saw")]
    assert back["l1"].first().segment_ids == ["n_L0_000", "n_L0_001"] and back["l2"].first().child_ids == ["n_L1_000"]


SAMPLES = "id string, take string, image array<string>, conversations array<struct<from:string,value:string>>, ord int"


def sample(i, images):
    return (i, "t1", images, [("human", "<image>\n<memory_start>\nLong: x\n<memory_end>\nAsk"), ("gpt", "L0: a")], int(i))


def test_converters(spark, tmp_path):
    df = spark.createDataFrame([sample("1", ["a", "b"]), sample("2", ["a", "gone"]), sample("3", [])], SAMPLES)
    files = spark.createDataFrame([("a",), ("b",)], "path string")
    assert [r.id for r in K.with_existing_images(df, files).collect()] == ["1"]
    assert sorted(r.id for r in K.with_existing_images(df, files, empty_ok=True).collect()) == ["1", "3"]
    assert K.llava(df, False).first().conversations[0].value == "<image>\nAsk"
    assert "memory_start" in K.llava(df, True).first().conversations[0].value
    got = K.sharegpt(df.where("id = '1'"), False).first()
    assert got.messages[0].content == "<image><image>Ask" and got.messages[1].content == "L0: a" and got.pc == "" and got.images == ["a", "b"]
    K.write_pair(df, f"{tmp_path}/pair")
    assert spark.read.json(f"{tmp_path}/pair/no_memory").count() == spark.read.json(f"{tmp_path}/pair/with_memory").count() == 3
    with pytest.raises(ValueError, match="no sample"):
        K.write_pair(df.limit(0), f"{tmp_path}/none")
    K.write_splits(K.with_split(df, {"t1": "val"}), f"{tmp_path}/split")
    assert spark.read.json(f"{tmp_path}/split/split=val").count() == 3


def test_groups_are_replaced_whole(spark, tmp_path):
    rows = lambda v: spark.createDataFrame([("a", v), ("a", v), ("b", v)], "g string, v int")
    K.write_predictions(rows(1), f"{tmp_path}/p", ["g"])
    K.write_predictions(rows(2).where("g = 'a'"), f"{tmp_path}/p", ["g"])
    assert sorted((r.g, r.v) for r in spark.read.json(f"{tmp_path}/p").collect()) == [("a", 2), ("a", 2), ("b", 1)]


def test_canonical_order_and_history(spark, tmp_path):
    pred = spark.createDataFrame([("x", 0, "old"), ("extra", 1, "e"), ("y", 2, "y"), ("x", 3, "new")], "id string, ord int, pred_l0 string")
    order = spark.createDataFrame([("y", 0), ("x", 1)], "id string, ord int")
    assert [(r.id, r.pred_l0) for r in K.canonical(pred, order).collect()] == [("y", "y"), ("x", "new"), ("extra", "e")]
    K.append_history(spark, f"{tmp_path}/h", ['{"a": 1, "timestamp": "T"}'])
    K.append_history(spark, f"{tmp_path}/h", ['{"b": 2}'])
    got = sorted(r.timestamp for r in spark.read.parquet(f"{tmp_path}/h").collect())
    assert len(got) == 2 and got[1] == "T"


def test_safe_overwrite_reads_its_own_target(spark, tmp_path):
    path = f"{tmp_path}/table"
    spark.range(3).write.parquet(path)
    K.overwrite_safely(spark.read.parquet(path).withColumn("id", F.col("id") + 1), path)
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [1, 2, 3]


def test_root_and_model_path(spark, tmp_path, monkeypatch):
    from strataline.plans.hierarchy import resolve_root

    near, far = tmp_path / "near", tmp_path / "far"
    near.mkdir(), far.mkdir()
    monkeypatch.delenv("RECORDINGS", raising=False)
    paths = [str(tmp_path / "none"), str(far), str(near)]
    assert resolve_root(None, "RECORDINGS", paths) == str(far) and resolve_root(None, "RECORDINGS", paths, local_first=True) == str(near)
    monkeypatch.setenv("RECORDINGS", "/e")
    assert resolve_root(None, "RECORDINGS", paths) == "/e" and resolve_root("/x", "RECORDINGS", paths) == "/x"
    monkeypatch.delenv("RECORDINGS")
    with pytest.raises(FileNotFoundError):
        resolve_root(None, "RECORDINGS", paths[:1])
    files = lambda *names: spark.createDataFrame([(n,) for n in names], "path string")
    assert R.model_path(files("m/checkpoint-9/a", "m/checkpoint-10/b", "m/other"), "m").first().path == "m/checkpoint-10"
    assert R.model_path(files("m/checkpoint-9/a", "m/adapter_model.bin"), "m/").first().path == "m"
    assert R.model_path(files("m/x"), "m").first().path == "m"


def test_dry_run_of_few(spark):
    rows = [(f"t/r/s/{i:06d}", "x" if i else None, i, ["a"]) for i in range(2)]
    df = spark.createDataFrame(rows, "id string, tp_id string, ord int, image array<string>")
    got = sorted((r.split, r.id, r.image[0]) for r in K.head_sample(df, 32).collect())
    view = "colorimage/camera01_colorimage-000000.jpg"
    assert got == [("test", rows[0][0], view), ("test", rows[1][0], view), ("train", rows[0][0], view), ("train", rows[1][0], view), ("val", rows[0][0], view)]


def test_kept_images(spark):
    df = spark.createDataFrame([sample("1", ["a", "gone", "b", "a"]), sample("2", ["gone"]), sample("3", [])], SAMPLES)
    files = spark.createDataFrame([("a",), ("b",)], "path string")
    assert {r.id: r.image for r in K.keep_existing_images(df, files).collect()} == {"1": ["a", "b", "a"]}
    assert {r.id: r.image for r in K.keep_existing_images(df, files, skip=False).collect()} == {"1": ["a", "b", "a"], "2": [], "3": []}


def test_results_without_a_match(spark):
    one = spark.createDataFrame([("all", "matched", 0.0)], "level string, metric string, value double")
    assert json.loads(K.results_document(one).first().value) == {"matched": 0}
    rows = [("all", "matched", 2.0), ("all", "total_predictions", 3.0), ("l0", "bleu", 0.5), ("l0", "exact_match", 0.1), ("l2", "exact_match", 0.25), ("l2", "rougeL", 1.0)]
    got = json.loads(K.results_document(spark.createDataFrame(rows, "level string, metric string, value double")).first().value)
    flat = {r.name: r.value for r in K.flatten_results(spark.createDataFrame(rows, "level string, metric string, value double")).collect()}
    assert flat == {f"{a}/{b}": v for a, b, v in rows}
    assert got == {"matched": 2, "total_predictions": 3, "l0": {"bleu": 0.5}, "l2": {"rougeL": 1.0}, "l2_exact_match": 0.25}


def test_checkpoint(spark):
    df = spark.createDataFrame([("m/checkpoint-9",), ("m/checkpoint-10",), ("m/checkpoint-x",)], "path string")
    assert R.latest_checkpoint(df).first().path == "m/checkpoint-10"


def test_hierarchy_of_all_takes(spark, root):
    from strataline.functions import vocab as V
    from strataline.plans import hierarchy as H

    got = H.build(spark, root)
    l0 = {(r.take, r.segment_id): r for r in got["l0"].collect()}
    nurse = l0["901_PKA", "nurse_L0_000"]
    assert nurse.description == "scrub nurse: is holding drill" and nurse.duration_frames == 10 and (nurse.time_start, nurse.time_end, nurse.duration_s) == (100, 111, 12)
    assert l0["901_PKA", "drill_L0_000"].description == "drill: scrub nurse is holding"
    assert l0["901_PKA", "robot_setup_L0_000"].description == "robot setup (physical): a"
    assert l0["901_PKA", "robot_monitor_L0_000"].description == "robot monitor (Mako screen): P (S)"
    assert [t.text for t in nurse.transcript] == []
    l1 = {r.segment_id: r for r in got["l1"].where("take = '901_PKA'").collect()}
    assert l1["nurse_L1_000"].children == ["nurse_L0_000"] and l1["nurse_L1_000"].summary == "is holding drill"
    assert got["l2"].where("take = '901_PKA' and role = 'nurse'").first().children == ["nurse_L1_000"]
    doc = json.loads(H.documents(got).where("take = '901_PKA'").first().value)
    assert doc["metadata"]["total_level0_segments"] == len([k for k in l0 if k[0] == "901_PKA"]) and doc["metadata"]["tp_range"] == ["000000", "000099"]
    assert doc["roles"]["nurse"]["num_segments"] == 1 and doc["roles"]["nurse"]["level0_segments"][0]["active_predicates"] == [["Holding", "drill"]]
    assert doc["debounce_analysis"]["per_role"] == {"nurse": {"raw": 1, "debounced": 1, "removed": 0}} and doc["debounce_analysis"]["categories"] == {}
    one = lambda part: [{"segment_ids": part["segment_id"].tolist(), "summary": "all", "audio_summary": None}] if "nurse" in part["segment_id"].iloc[0] else None
    asked = H.build(spark, root, groupers=(one, one))
    assert [(r.role, r.children, r.summary) for r in asked["l2"].where("take = '901_PKA'").collect()] == [("nurse", ["nurse_L1_000"], "all")]
    assert {(r.take, r.role): (r.raw, r.debounced) for r in got["report"].collect()} == {("901_PKA", "nurse"): (1, 1), ("902_TKA", "nurse"): (1, 1)}
    roles = [r.role for r in H.ordered_roles(got["l0"].where("take = '901_PKA'").select("role")).collect()]
    assert list(dict.fromkeys(roles)) == ["nurse", "robot_monitor", "drill", "robot_setup"]
    item = F.struct("segment_id", "time_start", "time_end", "duration_s", "description", "transcript")
    ask = got["l0"].where("take = '901_PKA' and role = 'drill'").groupBy("role").agg(F.collect_list(item).alias("s"))
    text = ask.select(H.segment_prompt(F.col("role"), F.col("s"), F.col("role").isin(*V.TOOLS)).alias("p")).first().p
    assert "Note:" in text and "[drill_L0_000] t=100s-111s (12s): drill: scrub nurse is holding\n      Speech: —" in text
    few = H.entries(R.relation_labels(spark, root, R.frame_map(spark, root)), "000002", 3)
    assert sorted(r.tp_id for r in few.where("take = '902_TKA'").collect()) == ["000002", "000003", "000004"]
