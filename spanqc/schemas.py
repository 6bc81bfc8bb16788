"""Fixed schemas, labels and other values of the data model."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, StringType, StructField, StructType

# Fixed values of the data format.
SENTINEL = "RESPUESTA_NO_ENCONTRADA"
ANSWERED, IMPOSSIBLE = "respondido", "imposible"
LABELS = (ANSWERED, IMPOSSIBLE)
TRUE_SPELLINGS = ("true", "1", "yes")
QC_STATUSES = (
    "no_answer_clean",
    "no_answer_empty",
    "no_answer_free_text",
    "imposible_but_span_present",
    "respondido_no_answer",
    "extractive_valid_unique",
    "extractive_ambiguous",
    "extractive_only_normalized",
    "non_extractive_or_hallucinated",
)
CLEAN_NO_ANSWER = ("no_answer_clean", "no_answer_empty", "no_answer_free_text")
EXTRACTIVE = ("extractive_valid_unique", "extractive_ambiguous")
EXPANDED = (*CLEAN_NO_ANSWER, *EXTRACTIVE, "extractive_only_normalized")
KIND_NAMES = {"hora": "time", "fecha": "date", "valor": "value", "lugar": "place", "objetos": "objects", "otro": "other"}
QUESTIONS_PER_CONTEXT = 5
WORDS_LOW, WORDS_HIGH = 82, 150

CANDIDATE = StructType(
    [
        StructField("context_id", StringType()),
        StructField("context", StringType()),
        StructField("question", StringType()),
        StructField("answer_text", StringType()),
        StructField("answer_start", IntegerType()),
        StructField("answer_end", IntegerType()),
        StructField("impossible_find_answer", StringType()),
        StructField("is_impossible", StringType()),
    ]
)
ANSWERS = StructType([StructField("text", ArrayType(StringType())), StructField("answer_start", ArrayType(IntegerType()))])
SQUAD2 = StructType(
    [
        StructField("id", StringType()),
        StructField("context", StringType()),
        StructField("question", StringType()),
        StructField("is_impossible", BooleanType()),
        StructField("answers", ANSWERS),
        StructField("context_id", StringType()),
    ]
)
LEGACY = StructType(
    [
        StructField("index", StringType()),
        StructField("context", StringType()),
        StructField("question", StringType()),
        StructField("answer_text", StringType()),
        StructField("answer_start", IntegerType()),
        StructField("answer_end", IntegerType()),
        StructField("impossible_find_answer", StringType()),
    ]
)
PREDICTION = StructType([StructField("id", StringType()), StructField("prediction_text", StringType()), StructField("no_answer_probability", DoubleType())])
AUDIT_COLUMNS = ("row_id", "context", "question", "gold_answer", "gold_is_impossible")
