"""Label files that are opened only where they matter, documents that are written whole, and versions of a table."""

import json
import os
import threading

import pytest
from pyspark.sql import functions as F

from strataline.sources import documents, files, labels
from strataline.sources import recordings as R
from strataline.sources.snapshots import Conflict, Snapshots


@pytest.fixture
def tree(tmp_path):
    """Two recordings; what must not be opened is a folder with the name of a label file."""
    for take, frames in (("001_PKA", 4), ("002_PKA", 2)):
        folder = tmp_path / "processed" / take / "relation_labels"
        folder.mkdir(parents=True)
        (folder.parent / "timestamp_to_pcd_and_frames_list.json").write_text(json.dumps([[str(i), {"original_timestamp": i, "azure": "a"}] for i in range(frames)]))
        for i in range(frames):
            (folder / f"{i:06d}.json").write_text("{broken" if take == "002_PKA" and i == 1 else json.dumps({"rel_annotations": [["nurse", "Holding", f"x{i}"]]}))
        for i in (frames, 999999):
            (folder / f"{i:06d}.json").mkdir()
    (tmp_path / "processed" / "empty").mkdir()
    return str(tmp_path / "processed")


def test_unmapped_files_are_not_opened(spark, tree):
    rows = {(r.take, r.tp_id): r for r in labels.label_files(spark, tree).collect()}
    assert len(rows) == 10 and {k for k, r in rows.items() if not r.mapped} == {("001_PKA", "000004"), ("001_PKA", "999999"), ("002_PKA", "000002"), ("002_PKA", "999999")}
    assert all((r.value is None) != r.mapped for r in rows.values())
    got = {(r.take, r.tp_id): [tuple(t) for t in r.triplets] for r in R.relation_labels(spark, tree, R.frame_map(spark, tree)).collect()}
    assert ("002_PKA", "000001") not in got and len(got) == 9 and got["001_PKA", "000003"] == [("nurse", "Holding", "x3")] and got["001_PKA", "999999"] == []


def test_slices_and_filters(spark, tree):
    every = sorted(map(tuple, labels.label_files(spark, tree).select("take", "tp_id", "mapped").collect()))
    assert sorted(map(tuple, labels.label_files(spark, tree, slices=3).select("take", "tp_id", "mapped").collect())) == every
    # what is filtered away may be as broken as it likes
    os.remove(f"{tree}/001_PKA/relation_labels/000002.json")
    os.mkdir(f"{tree}/001_PKA/relation_labels/000002.json")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        some = labels.label_files(spark, tree).where("take = '001_PKA' and tp_id >= '000003' and value is not null")
        assert [r.tp_id for r in some.collect()] == ["000003"]
        assert labels.label_files(spark, tree).where("take in ('002_PKA', 'x') and tp_id < '000001'").count() == 1
        assert labels.label_files(spark, tree).where("take like '002%'").count() == 4
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_labels_of_a_store_that_only_spark_reads(spark, tree, monkeypatch):
    for take in ("001_PKA", "002_PKA"):
        for name in os.listdir(f"{tree}/{take}/relation_labels"):
            if os.path.isdir(f"{tree}/{take}/relation_labels/{name}"):
                os.rmdir(f"{tree}/{take}/relation_labels/{name}")
    frames = R.frame_map(spark, tree)
    one = sorted(map(repr, R.relation_labels(spark, tree, frames).collect()))
    monkeypatch.setattr(labels, "reachable", lambda root: False)
    assert sorted(map(repr, R.relation_labels(spark, tree, frames).collect())) == one
    assert not labels.reachable("viewfs://store/in")


def test_documents_are_there_whole_or_not_at_all(spark):
    target = files.scratch(spark, "documents")
    store = Snapshots(spark, target)
    docs = lambda n, text: spark.range(n).repartition(4).select(F.concat(F.lit("d"), "id", F.lit(".json")).alias("path"), F.lit(text).alias("value"))
    read = lambda: {r.path.rpartition("/")[2]: r.value for r in spark.read.text(f"{store.folder()}/*.json", wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value").collect()}
    store.replace_documents(docs(20, "one"))
    assert read() == {f"d{i}.json": "one" for i in range(20)}
    fails = F.udf(lambda i: 1 / (i - 13) and "two")
    with pytest.raises(Exception, match="ZeroDivisionError"):
        store.replace_documents(spark.range(20).repartition(4).select(F.concat(F.lit("d"), "id").alias("path"), fails("id").alias("value")))
    assert read() == {f"d{i}.json": "one" for i in range(20)} and store.version() == 1
    at, top = files.store(f"{target}/data")
    from pyarrow.fs import FileSelector

    # what the failed run wrote is gone (a task that was at a file may leave that one in the staging folder)
    assert len([x for x in at.get_file_info(FileSelector(top)) if not x.base_name.endswith(".staging")]) == 1
    store.replace_documents(docs(5, "three"))
    assert read() == {f"d{i}.json": "three" for i in range(5)}
    empty = f"{target}/none"
    documents.write_documents(docs(0, ""), empty)
    assert at.get_file_info(files.store(empty)[1]).type.name == "Directory"


def test_readers_never_fail_while_a_table_is_overwritten(spark):
    store = Snapshots(spark, files.scratch(spark, "snapshots"))
    store.overwrite(spark.range(3).selectExpr("id", "0 as n"))
    seen, errors, stop = [], [], threading.Event()

    def reads():
        mine = Snapshots(spark, store.root)
        while not stop.is_set():
            try:
                seen.append({(r.id, r.n) for r in mine.read().collect()})
            except Exception as e:
                errors.append(e)

    reader = threading.Thread(target=reads)
    reader.start()
    for _ in range(50):
        store.overwrite(store.read().selectExpr("id", "n + 1 as n").coalesce(1))
    stop.set()
    reader.join()
    assert not errors and seen and all(len({n for _, n in s}) == 1 and len(s) == 3 for s in seen)
    assert store.version() == 51 and {r.n for r in store.read().collect()} == {50} and {r.n for r in store.read(11).collect()} == {10}
    assert len(store.expire(2)) == 49 and store.read().count() == 3 and store.read(50).count() == 3


def test_of_two_writers_one_raises(spark):
    store = Snapshots(spark, files.scratch(spark, "snapshots"))
    store.overwrite(spark.range(1))
    outcomes = []

    def writes(n):
        try:
            outcomes.append(Snapshots(spark, store.root).overwrite(spark.range(n), base=1))
        except Conflict:
            outcomes.append("conflict")

    both = [threading.Thread(target=writes, args=(n,)) for n in (5, 6)]
    [t.start() for t in both]
    [t.join() for t in both]
    assert sorted(map(str, outcomes)) == ["2", "conflict"] and store.version() == 2 and store.read().count() in (5, 6)
    with pytest.raises(FileNotFoundError):
        Snapshots(spark, files.scratch(spark, "snapshots")).read()


def test_history_starts_anew_after_a_broken_entry(spark):
    store = Snapshots(spark, files.scratch(spark, "snapshots"))
    store.overwrite(spark.range(1), {"did": "made", "timestamp": "T"})
    store.note({"did": "seen"})
    rows = store.history().collect()
    assert [(r.version, json.loads(r.entry)["did"]) for r in rows] == [(1, "made"), (2, "seen")] and rows[0].timestamp == "T" and rows[1].timestamp[:2] == "20"
    assert "timestamp" in json.loads(rows[1].entry)
    at, top = files.store(store.root)
    files.write_text(at, f"{top}/log/{3:012d}.json", "{broken")
    assert store.history().count() == 0 and store.read().count() == 1
    store.overwrite(spark.range(2), {"did": "again"})
    assert [json.loads(r.entry)["did"] for r in store.history().collect()] == ["again"] and store.read().count() == 2


def test_large_label_files_are_handed_on_one_by_one(spark, tmp_path, monkeypatch):
    """A worker holds some files at a time by their size, and few recordings are cut into as many slices as there are tasks."""
    from strataline.sources import labels

    root = tmp_path / "r"
    (root / "001_PKA/relation_labels").mkdir(parents=True)
    (root / "001_PKA/timestamp_to_pcd_and_frames_list.json").write_text(str([["x", {}]] * 9).replace("'", '"'))
    for i in range(9):
        (root / f"001_PKA/relation_labels/{i:06d}.json").write_text(f"{i}" * 60)
    monkeypatch.setattr(labels, "_LETTERS", 100)
    reader = labels.LabelReader({"path": str(root), "tasks": "4"})
    parts = reader.partitions()
    assert [(p.take, p.part, p.of) for p in parts] == [("001_PKA", i, 4) for i in range(4)]
    batches = [b for p in parts for b in reader.read(p)]
    assert max(b.num_rows for b in batches) == 2
    assert sorted(v for b in batches for v in b.column("value").to_pylist()) == [f"{i}" * 60 for i in range(9)]


def test_a_worker_holds_few_texts_of_files(spark, tmp_path):
    from pyspark.sql import functions as F

    from strataline.sources import files

    before = spark.conf.get(files._RECORDS, None)
    with files.small_batches(spark):
        rows = spark.range(100).coalesce(1).mapInArrow(lambda bs: (b.slice(0, 1) for b in bs), "id long")
        seen = rows.count()
    assert seen == -(-100 // files._TEXTS) and spark.conf.get(files._RECORDS, None) == before
    rows = spark.range(30).select(F.format_string("f%02d.txt", "id").alias("path"), F.repeat(F.lit("x"), F.col("id").cast("int")).alias("value"))
    assert files.write_files(rows, str(tmp_path)) == 30 and (tmp_path / "f29.txt").read_text() == "x" * 29
