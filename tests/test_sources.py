from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from spanqc.operators import reports
from spanqc.schemas import CANDIDATE
from spanqc.sources import readers, shared, writers
from spanqc.sources.tables import read_table
from spanqc.streaming import incremental


def test_jsonl(spark, tmp_path):
    good = {"context_id": "c", "context": "é", "question": "q", "answer_text": None, "answer_start": 1, "answer_end": 2, "impossible_find_answer": "false", "is_impossible": "respondido"}
    path = tmp_path / "x.worker-0"
    path.write_text(json.dumps(good, ensure_ascii=False) + "\n\n{broken\n")
    rows, bad = readers.read_jsonl_tolerant(spark, str(tmp_path / "x.worker-*"))
    assert rows.count() == 1 and (bad.head()["line"], bad.head()["line_index"]) == ("{broken", 2)
    with pytest.raises(Exception, match="(?i)malformed|corrupt|FAILFAST"):
        readers.read_jsonl(spark, str(path), CANDIDATE).collect()
    writers.write_jsonl(rows, str(tmp_path / "out"))
    writers.write_jsonl(rows, str(tmp_path / "out"), mode="append")
    back = readers.read_jsonl(spark, str(tmp_path / "out"), CANDIDATE)
    assert back.count() == 2 and back.head()["context"] == "é"
    assert all('"answer_text":null' in line for p in (tmp_path / "out").glob("part-*") for line in p.read_text().splitlines())


def test_bad_lines_are_numbered_in_files_of_many_parts(spark, tmp_path):
    lines = [json.dumps({"context_id": f"c{k}"}) if k % 97 else "{broken %d" % k for k in range(4000)]
    for name in ("a", "b"):
        (tmp_path / f"x.{name}").write_text("\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        assert readers.numbered_lines(spark, str(tmp_path / "x.*"))[1].count() > 10
        rows, bad = readers.read_jsonl_tolerant(spark, str(tmp_path / "x.*"))
        assert {(r["source_file"][-1], r["line_index"], r["line"]) for r in bad.collect()} == {(f, k, lines[k]) for f in "ab" for k in range(0, 4000, 97)}
        assert rows.count() == 2 * (4000 - 42)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_the_shared_folder(spark):
    from types import SimpleNamespace

    path = shared.shared_path(spark, "x")
    spark.range(3).write.parquet(path)
    assert path in shared.WRITTEN
    shared.forget(path)
    shared.forget(path)  # what is gone is no error
    store, name = shared.filesystem(path)
    assert path not in shared.WRITTEN and store.get_file_info(name).type.name == "NotFound"
    for master in ("spark://host:7077", "yarn"):
        cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: None))
        with pytest.raises(ValueError, match="checkpoint"):
            shared.shared_dir(cluster)


def test_csv(spark, tmp_path):
    frame = spark.createDataFrame([("1", 'a "b"\nc', " q ", "g", "no")], "row_id string, context string, question string, gold_answer string, gold_is_impossible string")
    writers.write_csv(frame, str(tmp_path / "c"), report=True)
    assert readers.read_audit(spark, str(tmp_path / "c")).head()[1:3] == ('a "b"\nc', " q ")
    with pytest.raises(ValueError, match="missing"):
        readers.read_csv(spark, str(tmp_path / "c"), ["nope"])


def test_variants(spark, tmp_path):
    ok = {"id": "a_context_1_ab", "context": "el gato", "question": "q", "is_impossible": False, "answers": {"text": ["gato"], "answer_start": [3]}}
    bad = ok | {"id": "a_context_2_ab", "answers": {"text": ["gato"], "answer_start": [0]}}
    (tmp_path / "v.jsonl").write_text("\n".join(map(json.dumps, (ok, bad))))
    loose = readers.load_variant(spark, str(tmp_path / "v.jsonl"), "v", strict=False).orderBy("id").collect()
    assert [r["context_id"] for r in loose] == ["context_1", "context_2"] and loose[1]["schema_errors"] == ["offset_mismatch"]
    with pytest.raises(ValueError):
        readers.load_variant(spark, str(tmp_path / "v.jsonl"), "v")
    assert readers.key_set(readers.load_variant(spark, str(tmp_path / "v.jsonl"), "v", strict=False)).count() == 1


def test_nested(spark, tmp_path):
    doc = {"data": [{"paragraphs": [{"context": "c", "qas": [{"id": "1", "question": "q", "is_impossible": False, "answers": [{"text": "x", "answer_start": 3}]}, {"id": "2", "question": "r", "is_impossible": True, "answers": []}]}]}]}
    (tmp_path / "n.json").write_text(json.dumps(doc, indent=1))
    assert [tuple(r)[1:] for r in readers.read_nested(spark, str(tmp_path / "n.json")).orderBy("id").collect()] == [("1", "q", False, "x", 3), ("2", "r", True, None, None)]
    assert readers.read_document(spark, str(tmp_path / "n.json"), spark.read.json(str(tmp_path / "n.json"), multiLine=True).schema).count() == 1


def test_logs_and_metrics(spark, tmp_path):
    logs = tmp_path / "logs"
    (logs / "resume_1").mkdir(parents=True)
    (logs / "w0.log").write_text("1/4 [0:00:01<\n3747/3750 [10:20:48<00:31\nFallback\nError crítico")
    (logs / "resume_1" / "w1.log").write_text("nothing")
    got = {r["segment"]: r for r in reports.parsed_logs(readers.read_logs(spark, str(logs)).withColumn("model", F.lit("m"))).collect()}
    assert (got["initial"]["processed"], got["initial"]["total_seconds"], got["initial"]["fallbacks"], got["initial"]["critical_errors"]) == (3747, 37248, 1, 1)
    assert got["resume_1"]["processed"] == 0 and got["resume_1"]["seconds_per_context"] is None
    folder = tmp_path / "m" / "m1" / "strict" / "ft"
    folder.mkdir(parents=True)
    (folder / "metrics_test.csv").write_text("exact,f1\n0.5,0.6\n")
    schema = spark.createDataFrame([], "exact double, f1 double").schema
    r = readers.read_metric_files(spark, str(tmp_path / "m"), schema).head()
    assert (r["model"], r["dataset"], r["mode"], r["f1"]) == ("m1", "strict", "ft", 0.6)


def test_writers(spark, tmp_path):
    rows = spark.createDataFrame([("1", "c", "q", False, (["c"], [0]), "x", "train"), ("2", "c", "q", True, ([], []), "x", "test")], "id string, context string, question string, is_impossible boolean, answers struct<text:array<string>,answer_start:array<int>>, context_id string, split string")
    writers.write_splits(rows, str(tmp_path / "s"), {"n": 2})
    assert spark.read.json(str(tmp_path / "s" / "splits")).groupBy("split").count().count() == 2
    assert json.loads(spark.read.text(str(tmp_path / "s" / "info")).head()[0]) == {"n": 2}
    metrics = spark.createDataFrame([("m", "d", "ft", 0.5)], "model string, dataset string, mode string, exact double")
    writers.write_experiment(str(tmp_path / "e"), metrics, metrics, metrics, {"lr": 1})
    done = spark.read.option("header", True).csv(str(tmp_path / "e" / "metrics"))
    planned = reports.plan(spark, ["m"], ["d"], ["zsl", "ft"], 1)
    assert {r["mode"]: r["completed"] for r in writers.completed(done, planned).collect()} == {"zsl": False, "ft": True}
    data = tmp_path / "data"
    spark.createDataFrame([("uno dos",)], "relato string").write.json(str(data) + ".json")
    assert readers.read_dataset(spark, str(data) + ".json").head()["word_count"] == 2


def test_small_tables_use_all_cores(spark, sf_dir):
    frame = read_table(spark, sf_dir, "documents")
    assert frame.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert frame.count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()


def test_stream_gives_what_the_batch_gives(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    source = tmp_path / "in"
    events.where("day(ts) < 15").coalesce(1).write.parquet(str(source))
    stream = incremental.stream_of(spark, str(source), events.schema)
    for _ in range(2):  # the second run finds what came meanwhile
        incremental.run_available(incremental.windowed_counts(stream), str(tmp_path / "out"), str(tmp_path / "check"))
        events.where("day(ts) >= 15").coalesce(1).write.mode("append").parquet(str(source))
    got = {(r["window_start"], r["event_type"]): r["n"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r["window_start"], r["event_type"]): r["n"] for r in incremental.windowed_counts(events).collect()}
    assert got and all(want[k] == n for k, n in got.items()) and len(want) - len(got) <= 4 * 5
    assert incremental.sliding_counts(events).count() > incremental.windowed_counts(events).count()
