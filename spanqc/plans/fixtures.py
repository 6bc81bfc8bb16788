"""QA rows made from the ``documents`` table by fixed rules, for queries and tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import semantics, spans
from ..schemas import ANSWERED, IMPOSSIBLE, SENTINEL, WORDS_HIGH, WORDS_LOW
from ..sources.tables import read_table as table

#: The five questions, one of each kind.
QUESTIONS = (
    (1, "¿Qué objetos fueron robados?"),
    (2, "¿En qué fecha ocurrió el incidente?"),
    (3, "¿A qué hora sucedió el robo?"),
    (4, "¿En qué dirección o entre qué calles sucedió el robo, suceso o incidente?"),
    (5, "¿Qué valor en dólares tenían los objetos sustraídos o robados?"),
)
FOREIGN = "0000 respuesta ajena"


def contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of 82 to 150 words."""
    rows = table(spark, sf_dir, "documents").where(T.words_between("text", WORDS_LOW, WORDS_HIGH))
    return rows.select("doc_id", F.concat(F.lit("context_"), F.col("doc_id").cast("string")).alias("context_id"), F.col("text").alias("context"))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten rows for each context: two models, five questions; which state a row has follows from a hash."""
    return answered(contexts(spark, sf_dir))


def answered(contexts: DataFrame) -> DataFrame:
    """The candidates of contexts, which may have more columns."""
    asked = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(q).alias("question")) for k, q in QUESTIONS])
    rows = contexts.select("*", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("model")).select("*", F.explode(asked).alias("_q")).select("*", "_q.*").drop("_q")
    key = F.when(F.col("doc_id") % 4 == 0, F.lit("a")).otherwise(F.col("model"))
    digest = F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("k").cast("string"), key))
    rows = rows.withColumn("h", F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"))
    rows = rows.withColumns({"b": (F.col("h") % 10).cast("int"), "t": (F.floor(F.col("h") / 10) % 2).cast("int"), "pos": (F.col("h") % F.greatest(F.length("context") - 40, F.lit(1))).cast("int")})
    cut = F.substring("context", F.col("pos") + 1, F.lit(24))
    plain, b, t = F.trim(cut), F.col("b"), F.col("t")
    answer = (
        F.when(b <= 3, plain).when(b == 4, F.trim(F.substring("context", F.col("pos") + 1, F.lit(3)))).when(b == 5, F.replace(plain, F.lit(" "), F.lit("  ")))
        .when(b == 6, F.reverse(cut)).when(b == 7, SENTINEL).when((b == 8) & (t == 0), "").when(b == 8, FOREIGN).when(t == 0, plain).otherwise(SENTINEL)
    )
    label = F.when((b == 7) | (b == 8) | ((b == 9) & (t == 0)), IMPOSSIBLE).otherwise(ANSWERED)
    rows = rows.withColumns({"answer_text": answer, "is_impossible": label})
    start = F.greatest(T.find("context", T.strip("answer_text")), F.lit(0)) + F.when(F.col("h") % 13 == 0, 1).otherwise(0)
    rows = rows.withColumn("answer_start", start.cast("int"))
    return rows.withColumn("answer_end", (F.col("answer_start") + F.length(T.strip("answer_text"))).cast("int")).drop("b", "t", "pos")


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates with their states, by the normal form that keeps accents, which SQL has too."""
    return spans.extractive_validity(candidates(spark, sf_dir), normal=T.collapse)


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classified rows with the heuristics' flags; the ten rows of a context share its normal form."""
    rows = answered(contexts(spark, sf_dir).withColumn("normal_context", T.normalize("context")))
    return semantics.heuristics(spans.extractive_validity(rows, normal=T.collapse), normal_context="normal_context").drop("normal_context")


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model a's rows as references: an impossible row has no answer, another its stripped text."""
    rows = candidates(spark, sf_dir).where("model = 'a'")
    impossible = F.col("is_impossible") == IMPOSSIBLE
    gold = F.when(impossible, F.array().cast("array<string>")).otherwise(F.array(T.strip("answer_text")))
    return rows.select(
        spans.row_id("model").alias("id"), "context_id", "question", semantics.question_kind("question").alias("kind"), impossible.alias("is_impossible"),
        F.struct(gold.alias("text"), F.transform(gold, lambda g: F.lit(0)).alias("answer_start")).alias("answers"), "h",
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gold answer, a part of it with a word more, or none, with scores that tie on purpose."""
    gold = F.coalesce(F.try_element_at("answers.text", F.lit(1)), F.lit("nada"))
    said = F.when(F.col("h") % 4 < 2, gold).when(F.col("h") % 4 == 2, F.concat(F.substring(gold, 1, 14), F.lit(" El, extra"))).otherwise("")
    return references(spark, sf_dir).select("id", said.alias("prediction_text"), ((F.col("h") % 400) / 100.0 - 2).cast("double").alias("no_answer_probability"))
