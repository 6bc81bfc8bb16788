"""Generators that fail, runs that break off, spans over windows."""

from __future__ import annotations

import random

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from spanqc.operators import decode, reports
from spanqc.streaming import incremental


def failing():
    """A class of this function's own, which goes to the workers by value."""

    class Failing:
        def __init__(self):
            self.calls = {}

        def __call__(self, context, question):
            n = self.calls[context, question] = self.calls.get((context, question), 0) + 1
            if question == "never" or question == "third" and n < 3:
                raise ValueError(f"call {n}")
            if question == "broken":
                return {"answer_start": 1}
            return {"answer_text": context or "nothing", "answer_start": 2, "answer_end": 5}

    return Failing()


def test_rows_that_cannot_fail(spark):
    contexts = spark.createDataFrame([("c1", "text"), ("c2", None), ("c2", "")], "context_id string, context string")
    asked = contexts.withColumn("question", F.explode(F.array(*[F.lit(q) for q in ("plain", "never", "third", "broken")])))
    rows = incremental.answers(asked, failing(), retries=2, delay=0.0)
    got = {(r.context, r.question): tuple(r)[3:] for r in rows.collect()}
    assert len(got) == 12
    assert got["text", "plain"] == ("text", "respondido", 2, 5, False, 1, None) and got[None, "plain"][0] == "nothing"
    assert got["text", "third"] == ("text", "respondido", 2, 5, False, 3, None)
    assert got["text", "never"] == ("RESPUESTA_NO_ENCONTRADA", "imposible", 0, 0, True, 3, "ValueError: call 3")
    assert got["", "broken"][-1] == "KeyError: 'answer_text'"
    assert sorted(r.question for r in incremental.failures(rows).collect()) == ["broken"] * 3 + ["never"] * 3
    assert incremental.answers(asked.where("false"), failing()).count() == 0


@pytest.mark.parametrize("moment", ["before", "within", "after"])
def test_a_run_that_broke_off_ends_like_a_whole_one(spark, tmp_path, moment):
    spark.range(40).select("id", F.concat(F.lit("c"), "id").alias("context_id")).repartition(4, "id").write.parquet(str(tmp_path / "in"))
    files = len(list((tmp_path / "in").glob("*.parquet")))
    stream = lambda: incremental.stream_of(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema, 1)
    make = lambda batch: batch.withColumn("k", F.explode(F.array(*[F.lit(k) for k in range(5)])))
    rows, checkpoint, schema = str(tmp_path / "rows"), str(tmp_path / "checkpoint"), "id long, context_id string, k int"
    calls = []

    def breaks(batch):
        calls.append(1)
        if len(calls) == 2:
            if moment != "before":
                make(batch).where("k < 2" if moment == "within" else "true").write.json(f"{rows}/batch=1")
            raise RuntimeError("cut off")
        return make(batch)

    with pytest.raises(StreamingQueryException):
        incremental.append_batches(stream(), breaks, rows, checkpoint)
    part = incremental.read_batches(spark, rows, checkpoint, schema)
    assert part.select("batch").distinct().count() == 1 and part.groupBy("id").count().where("count <> 5").count() == 0
    for _ in range(2):  # the second run finds nothing to do
        incremental.append_batches(stream(), make, rows, checkpoint)
        whole = incremental.read_batches(spark, rows, checkpoint, schema)
        assert sorted((r.id, r.k) for r in whole.collect()) == [(i, k) for i in range(40) for k in range(5)]
        assert whole.select("batch").distinct().count() == files
    spark.range(40, 42).select("id", F.concat(F.lit("c"), "id").alias("context_id")).write.mode("append").parquet(str(tmp_path / "in"))
    incremental.append_batches(stream(), make, rows, checkpoint)
    assert incremental.read_batches(spark, rows, checkpoint, schema).count() == 210


def test_spans_over_windows(spark):
    rng = random.Random(2)
    texts = {"a": "".join(rng.choice(["word ", "a", "  ", "\n", "é😀"]) for _ in range(600)), "b": "one", "c": "", "d": " \t", "e": None, "f": "  lead and trail  "}
    spans, want = [], []
    for key, text in texts.items():
        size = len(text or "")
        for k in range(30):
            start = rng.randint(0, size + 2)
            spans.append((key, k, start, start + rng.choice([0, 1, 3, 9, 40])))
    spans += [("zz", 0, 0, 1), ("a", None, 5, 9)]
    frame = spark.createDataFrame(list(texts.items()), "context_id string, context string")
    got = decode.window_labels(frame, spark.createDataFrame(spans, "context_id string, k int, start int, end int"), 12, 5)
    for key, k, start, end in spans:
        if key not in texts:
            continue
        words, at, text = [], 0, texts[key] or ""
        for word in text.split():
            at = text.index(word, at)
            words.append((at, at + len(word)))
            at += len(word)
        for window, low in enumerate(range(0, max(len(words) - 5, 1), 7)):
            own = words[low : low + 12]
            first = [i for i, (b, _) in enumerate(own) if b <= start]
            last = [i for i, (_, e) in enumerate(own) if e >= end]
            ok = end > start and first and last
            want.append((key, k, start, end, window, first[-1] + 1 if ok else 0, last[0] + 1 if ok else 0))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()


def log_rows(rng):
    """Whole logs, and their pieces, which end at ends of lines."""
    whole, pieces = [], []
    for k in range(30):
        lines = [rng.choice([f"{rng.randint(1, 9)}/9 [{rng.randint(0, 2)}:05:{rng.randint(10, 59)}<1", "Fallback fallback", "Error crítico", "Checkpoint guardado", "", "none"]) + "\n" for _ in range(rng.randint(0, 12))]
        path, model, at, number = rng.choice(["", "resume_1/", "resume_2/deep/"]) + f"w{k}.log", rng.choice(["a", "b", None]), 0, 0
        whole.append((model, path, "".join(lines)))
        while at < len(lines) or not number:
            size = rng.randint(1, 4)
            pieces.append((model, path, number, "".join(lines[at : at + size])))
            at, number = at + size, number + 1
    return whole, pieces


def test_growing_logs(spark, tmp_path):
    rng = random.Random(7)
    whole, pieces = log_rows(rng)
    want = sorted(map(tuple, reports.parsed_logs(spark.createDataFrame(whole, "model string, path string, text string")).collect()), key=str)
    schema = "model string, path string, piece int, text string"
    rng.shuffle(pieces)
    told = reports.told(reports.grown_logs(spark.createDataFrame(pieces, schema)), "path", "model")
    assert sorted(map(tuple, told.collect()), key=str) == want
    for part in range(3):  # pieces come in any order, and the stream is stopped between
        spark.createDataFrame(pieces[part::3], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "pieces"))
        stream = incremental.stream_of(spark, str(tmp_path / "pieces"), spark.createDataFrame([], schema).schema, 1)
        logs = incremental.follow_logs(stream, str(tmp_path / "state"), str(tmp_path / "checkpoint"))
        come = [p for k in range(part + 1) for p in pieces[k::3]]
        assert logs.count() == len({p[:2] for p in come})
    assert sorted(map(tuple, logs.collect()), key=str) == want
    again = incremental.follow_logs(stream, str(tmp_path / "state"), str(tmp_path / "checkpoint"))
    assert sorted(map(tuple, again.collect()), key=str) == want


def test_grown_logs_of_odd_pieces(spark):
    rows = [("m", "w", 2, "3/9 [0:00:03<"), ("m", "w", 2, "5/9 [0:00:01<"), ("m", "w", None, "9/9 [9:00:00< fallback"), ("m", "w", 7, None), ("m", None, 0, "Fallback"), (None, "x/w", 0, "")]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "model string, path string, piece int, text string, progress int").drop("progress")
    got = {(r.model, r.path): (r.progress and r.progress.processed, r.fallbacks) for r in reports.grown_logs(frame).collect()}
    assert got == {("m", "w"): (5, 1), ("m", None): (None, 1), (None, "x/w"): (None, 0)}
    assert reports.grown_logs(frame.limit(0)).count() == 0


def test_plan_of_rows(spark):
    rows = spark.createDataFrame([("m2", "d"), ("m1", None), (None, "c"), ("m2", "d"), ("é", "d")], "model string, dataset string")
    got = [tuple(r) for r in reports.plan_of(rows, "model", "dataset", ["x", "y"], 3).orderBy("place").collect()]
    runs = [(m, d, o) for m in ("m1", "m2", "é") for d in ("c", "d") for o in ("x", "y")]
    assert got == [(k, *run, k % 3) for k, run in enumerate(runs)]
    assert reports.plan_of(rows.limit(0), "model", "dataset", ["x"], 3).count() == 0
    with pytest.raises(Exception, match="more than 2 models"):
        reports.plan_of(rows, "model", "dataset", ["x"], 3, 2).collect()


def test_followed_logs_have_no_state(spark, tmp_path):
    rng = random.Random(11)
    whole, pieces = log_rows(rng)
    want = sorted(map(tuple, reports.parsed_logs(spark.createDataFrame(whole, "model string, path string, text string")).collect()), key=str)
    schema = "model string, path string, piece int, text string"
    rng.shuffle(pieces)
    spark.createDataFrame(pieces, schema).repartition(5).write.parquet(str(tmp_path / "pieces"))  # a log's pieces come in several batches
    stream = incremental.stream_of(spark, str(tmp_path / "pieces"), spark.createDataFrame([], schema).schema, 1)
    logs = incremental.follow_logs(stream, str(tmp_path / "rows"), str(tmp_path / "checkpoint"))
    assert sorted(map(tuple, logs.collect()), key=str) == want
    assert len(list((tmp_path / "checkpoint" / "commits").glob("[0-9]*"))) > 1
    assert not list((tmp_path / "checkpoint").glob("state/*"))
