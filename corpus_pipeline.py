"""A corpus pipeline of five stages, each by one operator of ``spanqc.llm``.

Each stage takes the documents that its predecessor kept and returns the columns it
was given, but for the last, which returns how much the mix takes of each document.
Rows come and go whole; columns of any names beside those used are carried along.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanqc.llm.common import stored
from spanqc.llm.decontamination import contamination
from spanqc.llm.language_id import identify
from spanqc.llm.mixing import mix
from spanqc.llm.near_dedup import near_duplicates
from spanqc.llm.quality import score
from spanqc.sources.shared import forget, scope, shared_path
from spanqc.sources.tables import read_table


def plain_names(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The documents with columns c0, c1, ..., which no operator's results clash with; and the new name of each."""
    names = {c: f"c{k}" for k, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def others(names: dict[str, str]) -> tuple[str, ...]:
    return tuple(new for old, new in names.items() if old != "doc_id")


def named_back(kept: DataFrame, names: dict[str, str]) -> DataFrame:
    return kept.select(*[F.col(new).alias(old) for old, new in names.items()])


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts good; it learns from the labels of these documents."""
    plain, names = plain_names(docs)
    judged = score(plain, read_table(spark, sf_dir, "labels"), names["doc_id"], names["text"], names.get("n_chars"), keep=others(names))
    return named_back(judged.where("predicted = 1"), names)


#: The least share of all languages' chances that a document's language has, so that it is likelier than all others
#: together. Of 12,820 held-out documents with text none has less than 0.9999, so clean ones are far from it.
LEAST_SHARE = 0.5


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; those without a letter, or of which no language is likelier than all others, go."""
    plain, names = plain_names(docs)
    judged = identify(plain, public_tokenizers.path("piece_bpe_32k.model"), names["doc_id"], names["text"], names["lang"], keep=others(names))
    return named_back(judged.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SHARE)), names)


def places(docs: DataFrame) -> DataFrame:
    """The documents with ``row``, which tells every row from all others and stays a row's own whenever it is worked out.

    It is the row's place in the files that are read: the file by 96 bits of hashes of its path, and the number in
    it. Documents that aren't read straight from files are stored with running numbers.
    """
    try:
        path, number = F.col("_metadata.file_path"), F.col("_metadata.row_index")
        return docs.select("*", F.struct(F.xxhash64(path).alias("file"), F.hash(path).alias("name"), number.alias("number")).alias("row"))
    except AnalysisException:  # no files of rows with numbers
        return stored(docs.withColumn("row", F.struct(F.monotonically_increasing_id().alias("number"))), "keyed")


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near-duplicates one row: that with the least id, nulls last; of rows that repeat it any one.

    Texts are shuffled only where the rows to drop are many.
    """
    plain, names = plain_names(docs)
    keyed = places(plain)
    key = F.struct(F.col(names["doc_id"]).isNull().alias("none"), F.col(names["doc_id"]).alias("id"), "row")
    groups = near_duplicates(keyed.select(key.alias("key"), names["text"]), "key", names["text"])
    gone = groups.where(F.col("key.row") != F.col("component_id.row")).select(F.col("key.row").alias("gone"))
    return named_back(keyed.join(stored(gone, "near-duplicates"), F.col("row") == F.col("gone"), "left_anti"), names)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    plain, names = plain_names(docs)
    found = contamination(plain, read_table(spark, sf_dir, "benchmark"), names["doc_id"], names["text"], keep=others(names))
    return named_back(found.where("n_hit = 0"), names)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How much the mix takes of each document."""
    return mix(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", good_quality),
    ("language id", known_language),
    ("simhash near-dedup", one_of_each),
    ("benchmark decontamination", uncontaminated),
    ("source mixing", mixed),
]

#: The classifiers and fingerprints can't be expressed in SQL; tests/llm/test_pipeline.py holds each stage against brute force, given what the classifiers learned.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; what each keeps is written to the shared folder and read again.

    What a stage read, and what it put into the shared folder besides, is taken away once its rows are written.
    """
    folder = shared_path(spark, "pipeline")
    docs = read_table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES[:-1]):
        path = f"{folder}/{number}"
        with scope() as made:
            stage(spark, docs, sf_dir).write.parquet(path)
        forget(f"{folder}/{number - 1}", *made)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
