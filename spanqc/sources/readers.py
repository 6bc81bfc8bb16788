"""Readers with fixed schemas; nothing is inferred."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions import text as T
from ..operators.validation import context_id_of, record_errors
from ..schemas import AUDIT_COLUMNS, CANDIDATE, SQUAD2

CORRUPT = "_corrupt_record"


def read_jsonl(spark: SparkSession, path: str | list[str], schema: StructType) -> DataFrame:
    """JSON lines; a bad line is an error, blank lines are skipped."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def numbered_lines(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """Lines (``source_file``, ``part``, ``_n``, ``value``) and parts of files (``source_file``, ``part``, ``before``): line ``_n + before`` of its file, from 0.

    Lines of a part of a file come to one task in order, so their places follow from running numbers; only the
    parts' numbers of lines are shuffled.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("part"), F.monotonically_increasing_id().alias("_n"), "value"
    )
    parts = lines.groupBy("source_file", "part").agg(F.min("_n").alias("_first"), F.count(F.lit(1)).alias("_lines"))
    earlier = Window.partitionBy("source_file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return lines, parts.withColumn("before", F.coalesce(F.sum("_lines").over(earlier), F.lit(0)) - F.col("_first")).select("source_file", "part", "before")


def read_jsonl_tolerant(spark: SparkSession, path: str | list[str], schema: StructType = CANDIDATE) -> tuple[DataFrame, DataFrame]:
    """JSON lines as good rows and bad lines, with file, line number (``line_index``, from 0) and text; paths may be patterns, as of workers' shards."""
    wide = StructType([*schema.fields, StructField(CORRUPT, StringType())])
    lines, parts = numbered_lines(spark, path)
    parsed = F.from_json("value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    rows = lines.where(T.strip("value") != "").withColumn("r", parsed)
    good = rows.where(F.col(f"r.{CORRUPT}").isNull()).select("r.*").drop(CORRUPT)
    bad = rows.where(F.col(f"r.{CORRUPT}").isNotNull()).join(parts, ["source_file", "part"])
    return good, bad.select("source_file", (F.col("_n") + F.col("before")).alias("line_index"), F.col("value").alias("line"))


def read_csv(spark: SparkSession, path: str, required: Sequence[str] = ()) -> DataFrame:
    """CSV with a header, quoted line breaks, all columns texts; a missing required column is an error."""
    frame = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    missing = [c for c in required if c not in frame.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return frame


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, AUDIT_COLUMNS)


def read_dataset(spark: SparkSession, path: str, text_column: str = "relato") -> DataFrame:
    """Narratives from a local copy of a hub's dataset (Parquet, or JSON lines by its name), with ``word_count``."""
    frame = spark.read.schema(StructType([StructField(text_column, StringType())])).json(path) if path.endswith((".json", ".jsonl")) else spark.read.parquet(path)
    return frame.withColumn("word_count", T.word_count(text_column))


def with_path_parts(frame: DataFrame, names: Sequence[str], path: Column | None = None) -> DataFrame:
    """Columns from the last folders of each row's file, the first name for the outermost."""
    where = F.col("_metadata.file_path") if path is None else path
    n = len(names)
    return frame.select("*", *[T.path_part(where, n - k + 1).alias(name) for k, name in enumerate(names)])


def read_metric_files(spark: SparkSession, root: str, schema: StructType, pattern: str = "metrics_*.csv", names: Sequence[str] = ("model", "dataset", "mode")) -> DataFrame:
    """All files of a pattern under a folder, with the folders' names as columns."""
    rows = spark.read.schema(schema).option("header", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).csv(root)
    return with_path_parts(rows, names)


def read_logs(spark: SparkSession, root: str, pattern: str = "*.log") -> DataFrame:
    """Whole logs with their path relative to the folder."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(root, wholetext=True)
    base = root.rstrip("/").rpartition("/")[2]
    relative = F.element_at(F.split(F.col("_metadata.file_path"), f"/{base}/"), F.lit(-1))
    return rows.select(relative.alias("path"), F.col("value").alias("text"))


def read_document(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A JSON document that fills a file; an array gives a row for each element."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


NESTED = "data array<struct<paragraphs: array<struct<context: string, qas: array<struct<id: string, question: string, is_impossible: boolean, answers: array<struct<text: string, answer_start: int>>>>>>>>"


def flatten_nested(documents: DataFrame) -> DataFrame:
    """A row for each question of nested documents: its first answer, null if it has none."""
    paragraphs = documents.select(F.explode("data").alias("d")).select(F.explode("d.paragraphs").alias("p"))
    questions = paragraphs.select(F.col("p.context").alias("context"), F.explode("p.qas").alias("q"))
    first = F.try_element_at("q.answers", F.lit(1))
    impossible = F.coalesce("q.is_impossible", F.lit(False))
    return questions.select("context", F.col("q.id").alias("id"), F.col("q.question").alias("question"), impossible.alias("is_impossible"), F.when(~impossible, first["text"]).alias("answer"), F.when(~impossible, first["answer_start"]).alias("answer_start"))


def read_nested(spark: SparkSession, path: str) -> DataFrame:
    return flatten_nested(spark.read.schema(NESTED).option("multiLine", True).json(path))


def key_set(records: DataFrame) -> DataFrame:
    """The different pairs of context and question."""
    return records.select("context", "question").distinct()


def load_variant(spark: SparkSession, path: str, name: str, strict: bool = True) -> DataFrame:
    """Records with the context's id, the name of the variant, and errors.

    A strict load raises if any record has an error, and gives none; otherwise they are in ``schema_errors``.
    """
    schema = StructType([f for f in SQUAD2.fields if f.name != "is_impossible"] + [StructField("is_impossible", StringType())])
    rows = read_jsonl(spark, path, schema).withColumn("is_impossible", T.as_bool("is_impossible"))
    named = rows.withColumn("context_id", context_id_of("id", F.col("context_id"), strict=strict)).withColumn("source", F.lit(name))
    checked = named.withColumn("schema_errors", record_errors())
    if strict:
        bad = checked.where(F.size("schema_errors") > 0).select("id", "schema_errors").limit(5).collect()
        if bad:
            raise ValueError("; ".join(f"{r['id']}: {','.join(r['schema_errors'])}" for r in bad))
        return checked.drop("schema_errors")
    return checked
