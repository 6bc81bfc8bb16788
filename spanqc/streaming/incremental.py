"""Incremental processing: windows over an event stream, and work that goes on where it stopped."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.reports import joined_logs, piece_marks, told
from ..schemas import ANSWERED, IMPOSSIBLE, QUESTIONS_PER_CONTEXT, SENTINEL


def stream_of(spark: SparkSession, path: str, schema: StructType, files_at_once: int = 8) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path)


def windowed_counts(events: DataFrame, size: str = "1 day", late: str = "2 days", by: str = "event_type") -> DataFrame:
    """Events, their sum and mean in tumbling windows; works on a stream (rows later than ``late`` are left out) and on a table."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp"))
    rows = timed.withWatermark("at", late) if events.isStreaming else timed
    out = rows.groupBy(F.window("at", size), by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("window_start"), by, "n", "total")


def sliding_counts(events: DataFrame, size: str = "2 days", slide: str = "1 day", late: str = "2 days", by: str = "event_type") -> DataFrame:
    timed = events.withColumn("at", F.col("ts").cast("timestamp"))
    rows = timed.withWatermark("at", late) if events.isStreaming else timed
    return rows.groupBy(F.window("at", size, slide), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("window_start"), by, "n")


def session_counts(events: DataFrame, gap: str = "6 hours", late: str = "2 days", by: str = "user_id") -> DataFrame:
    timed = events.withColumn("at", F.col("ts").cast("timestamp"))
    rows = timed.withWatermark("at", late) if events.isStreaming else timed
    out = rows.groupBy(F.session_window("at", gap), by).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), by, "n")


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Processes what has come since the last run, writes it, and ends; the checkpoint says what was done."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def generate(contexts: DataFrame, make: Callable, schema: StructType | str, done: DataFrame | None = None, key: str = "context_id") -> DataFrame:
    """Rows of a generator for the contexts that aren't done.

    ``make`` is called as ``mapInPandas`` does, with batches of contexts, and gives batches of rows;
    it is where a model would run.
    """
    todo = contexts if done is None else contexts.join(done.select(key).distinct(), key, "left_anti")
    return todo.mapInPandas(make, schema)


def finished(rows: DataFrame, questions: int = QUESTIONS_PER_CONTEXT, key: str = "context_id") -> DataFrame:
    """Keys with all their rows."""
    return rows.groupBy(key).count().where(F.col("count") == questions).select(key)


#: What ``answers`` adds to a context and a question.
ANSWER = "answer_text string, is_impossible string, answer_start int, answer_end int, impossible_find_answer boolean, attempts int, error string"


def answers(asked: DataFrame, ask: Callable[[str, str], dict], retries: int = 3, delay: float = 3.0) -> DataFrame:
    """A row for each context and question of ``asked``, whatever the generator does.

    ``ask`` gives ``answer_text`` and, if it knows them, the other columns of ``ANSWER``. Where it raises, it is asked again up to ``retries``
    times, after ``delay`` seconds, twice, three times as many, ... A question that never succeeds gets the row of an impossible one, with the
    last ``error``, so that each context keeps all its rows; one that succeeds has no error. ``attempts`` counts the calls. Null texts are asked as they are.
    """
    columns = [c.split()[0] for c in ANSWER.split(", ")]

    def one(context: str | None, question: str | None) -> tuple:
        failed = ""
        for attempt in range(1, retries + 2):
            try:
                said = ask(context, question)
                text = said["answer_text"]
                none = bool(said.get("impossible_find_answer", text == SENTINEL))
                start = int(said.get("answer_start", 0))
                return text, said.get("is_impossible", IMPOSSIBLE if none else ANSWERED), start, int(said.get("answer_end", 0)), none, attempt, None
            except Exception as problem:  # noqa: BLE001, a generator may fail in any way
                failed = f"{type(problem).__name__}: {problem}"
                if attempt <= retries:
                    time.sleep(delay * attempt)
        return SENTINEL, IMPOSSIBLE, 0, 0, True, retries + 1, failed

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [one(c, q) for c, q in zip(batch["context"], batch["question"], strict=True)]
            yield pd.concat([batch.reset_index(drop=True), pd.DataFrame(found, columns=columns)], axis=1)

    schema = StructType([*asked.schema.fields, *StructType.fromDDL(ANSWER).fields])
    return asked.mapInPandas(made, schema)


def failures(answered: DataFrame) -> DataFrame:
    """The questions that got no answer of their own, and the last error of each."""
    return answered.where(F.col("error").isNotNull()).select("context_id", "question", "attempts", "error")


def append_batches(stream: DataFrame, make: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Rows that ``make`` gives for what has come since the last run, each batch in a folder of its own; ends when all is done.

    A batch whose run was cut off, before, in or after its writing, is made again whole and takes the place of what
    it left, so no key is ever there in part or twice. What is read by ``read_batches`` is what was written whole.
    With ``mode="update"`` a batch has the groups of a running aggregation that it changed.
    """

    def write(batch: DataFrame, number: int) -> None:
        make(batch).write.mode("overwrite").option("ignoreNullFields", False).json(f"{path}/batch={number}")

    query = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def read_batches(spark: SparkSession, path: str, checkpoint: str, schema: StructType | str) -> DataFrame:
    """The rows of the batches that ended, with the number of each as ``batch``; a batch that was cut off is left out until it is made again."""
    ended = spark.read.text(f"{checkpoint}/commits").select(F.regexp_extract(F.col("_metadata.file_name"), r"^(\d+)$", 1).try_cast("long").alias("batch")).distinct()
    rows = spark.read.schema(schema).option("basePath", path).json(path)
    return rows.withColumn("batch", F.col("batch").cast("long")).join(ended, "batch", "left_semi")


def follow_logs(pieces: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """What growing logs say so far, as ``parsed_logs`` has it; call it again when more pieces have come.

    Only new pieces are read. Each batch writes what its own pieces tell, a row for each of their logs; what batches tell is put together
    when it is read. So the stream has no state, which would hold a row for each log in the executors' memory.
    """
    append_batches(pieces, piece_marks, path, checkpoint)
    number = pieces.schema["piece"].dataType.simpleString()
    schema = f"model string, path string, told struct<piece: {number}, progress: struct<processed: long, target: long, total_seconds: long>>, fallbacks long, critical_errors long, checkpoints long"
    return told(joined_logs(read_batches(pieces.sparkSession, path, checkpoint, schema)), "path", "model")
