"""Queries over files: what the library writes into the shared folder, read back by its readers."""

from __future__ import annotations

from contextlib import suppress

from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import text as T
from ..operators import metrics, reports, semantics, spans, validation
from ..schemas import CANDIDATE, IMPOSSIBLE, PREDICTION, SQUAD2
from ..sources import readers, writers
from ..sources.shared import shared_path
from ..streaming import incremental
from . import fixtures as X
from . import queries as Q


def flat(records: DataFrame, *more: str | Column) -> DataFrame:
    """Records with their first answer as columns."""
    return records.select("id", *more, "is_impossible", F.try_element_at("answers.text", F.lit(1)).alias("answer"), F.try_element_at("answers.answer_start", F.lit(1)).alias("answer_start"))


@Q.query
def jsonl_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records as JSON lines, read strictly."""
    path = shared_path(spark, "records")
    writers.write_jsonl(spans.to_squad2(X.classified(spark, sf_dir), "model"), path)
    return flat(readers.read_jsonl(spark, path, SQUAD2), "context_id", F.md5("context").alias("context"))


def candidate_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model a's candidates as a generator's output: JSON lines, some cut off in the middle and some followed by a blank line, by worker."""
    rows = X.candidates(spark, sf_dir).where("model = 'a'")
    line = F.to_json(F.struct(F.when(F.col("h") % 17 > 0, F.col("context_id")).alias("context_id"), "context", "question", "answer_text", "answer_start", "answer_end", "is_impossible"), {"ignoreNullFields": "false"})
    cut = F.when(F.col("h") % 13 == 0, F.substr(line, F.lit(1), F.lit(40))).otherwise(line)
    return rows.select("doc_id", "k", "h", (F.col("doc_id") % 3).alias("worker"), F.concat(cut, F.when(F.col("h") % 5 == 0, "\n").otherwise("")).alias("value"))


def shards(spark: SparkSession, sf_dir: str) -> str:
    """The lines as a folder for each worker, in one file each, in order of context and question; the workers are three."""
    path = shared_path(spark, "shards")
    candidate_lines(spark, sf_dir).repartition("worker").sortWithinPartitions("worker", "doc_id", "k").select("worker", "value").write.partitionBy("worker").text(path)
    return f"{path}/worker=*"


@Q.query
def tolerant_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """workers' shards by a pattern; each bad line with its number in its file, and how many lines are good."""
    good, bad = readers.read_jsonl_tolerant(spark, shards(spark, sf_dir), CANDIDATE)
    lines = bad.select(F.regexp_extract("source_file", r"worker=(\d+)", 1).cast("long").alias("worker"), "line_index", F.md5("line").alias("line"))
    counted = good.agg(F.lit(None).cast("long").alias("worker"), F.count(F.lit(1)).alias("line_index"), F.lit("good").alias("line"))
    return lines.unionByName(counted)


@Q.query
def resumed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V8: of interrupted output, the lines that are kept as they are: of finished contexts, without an id, and those that can't be parsed."""
    _, kept = validation.resume_lines(spark.read.text(shards(spark, sf_dir)).select("value"))
    return kept.groupBy(F.md5("value").alias("line")).agg(F.count(F.lit(1)).alias("n"))


@Q.query
def audit_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3, K2: an audit's CSV with quotes and line breaks in its texts."""
    path = shared_path(spark, "audit")
    rows = X.candidates(spark, sf_dir).where("model = 'b'")
    broken = F.regexp_replace("context", " t", ' "t,\n')
    audit = rows.select(F.concat_ws("-", "context_id", "k").alias("row_id"), broken.alias("context"), "question", F.concat(F.lit("-"), "answer_text").alias("gold_answer"), F.when(F.col("is_impossible") == IMPOSSIBLE, "True").otherwise("False").alias("gold_is_impossible"))
    writers.write_csv(audit, path)
    return readers.read_audit(spark, path).select("row_id", F.md5("context").alias("context"), "question", "gold_answer", "gold_is_impossible")


@Q.query
def narratives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hub's dataset by a local copy, as JSON lines and as Parquet."""
    rows = X.table(spark, sf_dir, "documents").select(F.col("text").alias("relato"))
    lines, table = f"{shared_path(spark, 'narratives')}.jsonl", shared_path(spark, "narratives")
    writers.write_jsonl(rows, lines)
    rows.write.parquet(table)
    both = readers.read_dataset(spark, lines).withColumn("copy", F.lit("lines")).unionByName(readers.read_dataset(spark, table).withColumn("copy", F.lit("table")))
    return both.groupBy("copy").agg(F.count("relato").alias("n"), F.sum("word_count").cast("long").alias("words"), F.max("word_count").cast("long").alias("longest"))


def experiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored rows of made-up runs: by model and mode, of one dataset."""
    scored = metrics.at_threshold(metrics.scored(X.predictions(spark, sf_dir), X.references(spark, sf_dir)))
    number = F.regexp_extract("id", r"_(\d+)_", 1).cast("long")
    return scored.withColumns({"model": F.concat(F.lit("m"), number % 2), "dataset": F.lit("strict"), "mode": F.when(number % 3 == 0, "zsl").otherwise("ft")})


RUN = ("model", "dataset", "mode")


@Q.query
def experiment_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """runs' results by folders, their metrics found by pattern with the folders as columns."""
    root, rows = shared_path(spark, "runs"), experiment(spark, sf_dir)
    names = ["exact", "f1", "total"]
    summary = metrics.summary(rows, *RUN).select(*RUN, *names)
    gold = metrics.summary(rows.where("NOT is_impossible"), *RUN).select(*RUN, *names)
    kinds = metrics.summary(rows, *RUN, "kind").select(*RUN, "kind", *names)
    writers.write_experiment(root, summary, kinds, rows.select(*RUN, *PREDICTION.names), {"threshold": 0.0}, gold=gold)
    schema = "exact double, f1 double, total bigint"
    keys = [F.regexp_replace(c, "^[a-z]+=", "").alias(c) for c in RUN]
    of = lambda folder, s: readers.read_metric_files(spark, f"{root}/{folder}", spark.createDataFrame([], s).schema, "*.csv").select(F.lit(folder).alias("part"), *keys, *(["kind"] if "kind" in s else [F.lit("").alias("kind")]), F.round("exact", 9).alias("exact"), F.round("f1", 9).alias("f1"), "total")
    said = spark.read.schema(PREDICTION).option("recursiveFileLookup", True).json(f"{root}/predictions")
    counted = said.select(F.lit("predictions").alias("part"), *[F.lit("").alias(c) for c in (*RUN, "kind")], F.length("prediction_text").alias("size")).groupBy("part", *RUN, "kind").agg(F.lit(0.0).alias("exact"), F.sum("size").cast("double").alias("f1"), F.count(F.lit(1)).alias("total"))
    return of("metrics", schema).unionByName(of("metrics_by_kind", f"kind string, {schema}")).unionByName(of("gold", schema)).unionByName(counted)


@Q.query
def completed_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planned runs and whether they have results."""
    root = shared_path(spark, "runs")
    writers.write_experiment(root, metrics.summary(experiment(spark, sf_dir), *RUN).select(*RUN, "exact"))
    done = spark.read.option("header", True).csv(f"{root}/metrics")
    return writers.completed(done, reports.plan(spark, ["m0", "m1", "m2"], ["strict"], ["zsl", "ft"], 2)).select("model", "dataset", "mode", "completed")


@Q.query
def log_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole logs from folders; each folder's markers, however its lines are spread over files."""
    root = shared_path(spark, "logs")
    logs = Q.worker_logs(spark, sf_dir).withColumn("segment", F.when(F.contains("path", F.lit("/")), F.element_at(F.split("path", "/"), F.lit(1))).otherwise("initial"))
    logs.select("segment", "text").write.partitionBy("segment").text(root, lineSep="\n")
    found = reports.parsed_logs(readers.read_logs(spark, root, "*.txt").withColumn("model", F.lit("m")))
    return found.groupBy(F.regexp_replace("segment", "^segment=", "").alias("segment")).agg(F.sum("fallbacks").alias("fallbacks"), F.sum("critical_errors").alias("critical_errors"), F.sum("checkpoints").alias("checkpoints"))


@Q.query
def growing_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of logs that grow: a stream gets them line by line, later lines first for some, in two runs."""
    root = shared_path(spark, "growing")
    lines = Q.worker_logs(spark, sf_dir).select("model", "path", F.posexplode(F.split("text", "\n")).alias("piece", "text"))
    first = (F.col("piece") == 1) | (F.col("piece") == 2) & F.startswith("path", F.lit("w"))
    for some in (first, ~first):
        lines.where(some).write.mode("append").parquet(f"{root}/pieces")  # in all tasks
        at_once = max(4, spark.sparkContext.defaultParallelism)  # files that keep all cores busy
        stream = incremental.stream_of(spark, f"{root}/pieces", StructType.fromDDL("model string, path string, piece int, text string"), at_once)
        logs = incremental.follow_logs(stream, f"{root}/state", f"{root}/checkpoint")
    return reports.segment_summary(logs)


@Q.query
def json_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that fill a file, each a list of an event type's days, over several lines."""
    root = shared_path(spark, "documents")
    daily = X.table(spark, sf_dir, "events").groupBy("event_type", F.dayofmonth("ts").cast("long").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("most"))
    lists = daily.groupBy("event_type").agg(F.to_json(F.sort_array(F.collect_list(F.struct("day", "event_type", "n", "most")))).alias("value"))
    lists.withColumn("value", F.replace("value", F.lit("},{"), F.lit("},\n{"))).repartition("event_type").write.partitionBy("event_type").text(root)
    schema = spark.createDataFrame([], "day bigint, event_type string, n bigint, most double").schema
    return readers.read_document(spark, f"{root}/event_type=*", schema)


@Q.query
def nested_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested documents in files."""
    path = shared_path(spark, "nested")
    writers.write_jsonl(Q.nested(spark, sf_dir), path)
    rows = readers.flatten_nested(spark.read.schema(readers.NESTED).json(path))
    return rows.groupBy("is_impossible").agg(F.count(F.lit(1)).alias("n"), F.count("answer").alias("answered"), F.sum(F.length("question")).cast("long").alias("characters"))


@Q.query
def variant_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both models' records as files, loaded with their errors."""
    root, records = shared_path(spark, "variants"), Q.records(spark, sf_dir)
    loaded = []
    for split in ("a", "b"):
        writers.write_jsonl(records.where(F.col("split") == split).drop("split"), f"{root}/{split}")
        loaded.append(readers.load_variant(spark, f"{root}/{split}", split, strict=False))
    rows = loaded[0].unionByName(loaded[1]).select(F.col("source").alias("split"), F.explode_outer("schema_errors").alias("error"))
    return rows.groupBy("split", F.coalesce("error", F.lit("none")).alias("error")).agg(F.count(F.lit(1)).alias("n"))


@Q.query
def split_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K4, K5: records by split with their information, written in two goes."""
    root = shared_path(spark, "splits")
    rows = spans.to_squad2(X.classified(spark, sf_dir), "model").withColumn("split", F.when(F.startswith("id", F.lit("a")), "train").otherwise("test"))
    writers.write_splits(rows.where("is_impossible"), root, {"model": "both"})
    writers.write_jsonl(rows.where("NOT is_impossible AND split = 'train'").drop("split"), f"{root}/splits/split=train", mode="append")
    writers.write_jsonl(rows.where("NOT is_impossible AND split = 'test'").drop("split"), f"{root}/splits/split=test", mode="append")
    back = spark.read.schema(SQUAD2).json(f"{root}/splits")
    info = spark.read.text(f"{root}/info").select(F.get_json_object("value", "$.model").alias("info"))
    return back.groupBy("split", "is_impossible").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.size("answers.text") > 0).alias("answered")).crossJoin(info)  # one row of information


@Q.query
def picked_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row by a hash."""
    return reports.random_row(X.contexts(spark, sf_dir).select("context_id", "doc_id"), 7, "context_id")


@Q.query
def latex_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K3: a report as LaTeX, line by line."""
    counted = X.candidates(spark, sf_dir).groupBy(semantics.question_kind("question").alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.avg("answer_start").alias("mean_start")).orderBy("kind")
    lines = reports.latex(counted, "Kinds & counts", "tab:kinds").split("\n")
    return spark.createDataFrame(list(enumerate(lines)), "line bigint, value string").where(T.strip("value") != "")


@Q.query
def resumed_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K4, V8: rows appended batch by batch; the run breaks off after a batch was written but not noted, and goes on."""
    root = shared_path(spark, "append")
    X.contexts(spark, sf_dir).select("doc_id", "context_id", "context").repartition(3, "doc_id").write.parquet(f"{root}/contexts")
    stream = lambda: incremental.stream_of(spark, f"{root}/contexts", StructType.fromDDL("doc_id long, context_id string, context string"), 1)

    def make(batch: DataFrame) -> DataFrame:
        asked = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(q).alias("question")) for k, q in X.QUESTIONS])).alias("q")
        return batch.select("context_id", F.regexp_extract("context", r"\S+", 0).alias("answer_text"), asked).select("context_id", "q.*", "answer_text")

    def breaks(batch: DataFrame) -> DataFrame:
        seen.append(batch)
        if len(seen) == 2:  # it leaves a part of its rows, and the run ends
            make(batch).where("k < 4").write.json(f"{root}/rows/batch=1")
            raise RuntimeError("cut off")
        return make(batch)

    seen: list[DataFrame] = []

    with suppress(StreamingQueryException):
        incremental.append_batches(stream(), breaks, f"{root}/rows", f"{root}/checkpoint")
    incremental.append_batches(stream(), make, f"{root}/rows", f"{root}/checkpoint")
    rows = incremental.read_batches(spark, f"{root}/rows", f"{root}/checkpoint", "context_id string, k long, question string, answer_text string")
    return rows.select("context_id", "k", "question", "answer_text")
