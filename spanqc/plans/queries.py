"""The library's own queries over the test tables."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import agreement, datasets, decode, metrics, reports, semantics, spans, stats, validation
from ..schemas import ANSWERED, IMPOSSIBLE
from ..sources.readers import flatten_nested, key_set
from ..streaming import incremental
from . import fixtures as X

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def long(c: Column | str) -> Column:
    return T.column(c).cast("long")


def worded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars", T.word_count("text").alias("words"))


# Scans, projections and filters.


@query
def word_range_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P1, P2."""
    return X.contexts(spark, sf_dir).select("doc_id", "context_id", long(T.word_count("context")).alias("words"))


@query
def clean_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P3, P4, V4."""
    rows = validation.normalize_candidates(X.candidates(spark, sf_dir).withColumn("impossible_find_answer", F.when(F.col("is_impossible") == IMPOSSIBLE, " TRUE ").otherwise("no")))
    return rows.where(~F.col("impossible_find_answer") & (T.word_count("answer_text") > 0)).groupBy("model").agg(F.count(F.lit(1)).alias("n"))


@query
def length_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P5."""
    return reports.length_counts(worded(spark, sf_dir), "words", "lang")


@query
def iqr_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P6."""
    rows = worded(spark, sf_dir)
    kept = reports.within_iqr(rows, "words", 100).agg(F.count(F.lit(1)).alias("kept"))
    return reports.iqr_bounds(rows, "words").crossJoin(kept)  # one row each


@query
def model_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Renamed, mapped, constant and conditional columns."""
    rows = X.candidates(spark, sf_dir).select("context_id", "model", F.col("question").alias("asked"), semantics.question_kind("question").alias("kind"), "is_impossible")
    return rows.select(
        F.substring_index("context_id", "_", -1).cast("long").alias("context_number"), "model", semantics.english("kind").alias("kind"),
        F.when(F.col("is_impossible") == IMPOSSIBLE, "impossible").when(F.col("kind") == "hora", "timed").otherwise("other").alias("state"), F.lit("audit").alias("origin"),
    ).groupBy("kind", "state", "origin", "model").agg(F.count(F.lit(1)).alias("n"), F.max("context_number").alias("last_context"))


@query
def membership_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose key pair is in another set."""
    rows = X.candidates(spark, sf_dir)
    keys = key_set(rows.where((F.col("model") == "a") & (F.col("is_impossible") == ANSWERED)))
    return rows.where("model = 'b'").join(keys, ["context", "question"], "left_semi").groupBy("is_impossible").agg(F.count(F.lit(1)).alias("n"))


@query
def limited_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first contexts in order of text; the limit is what is asked for."""
    return X.contexts(spark, sf_dir).select("context_id").orderBy("context_id").limit(25)


# Validation.


@query
def structural_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1, V10, A4, A12."""
    return validation.structural_report(X.candidates(spark, sf_dir))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model a's records as the library makes them, and model b's with the quirks that validation is to find."""
    rows = X.classified(spark, sf_dir)
    good = spans.to_squad2(rows.where("model = 'a'"), "model").withColumn("split", F.lit("a"))
    return good.unionByName(spans.to_squad2(rows.where("model = 'b'"), "model", legacy=True).withColumn("split", F.lit("b")))


@query
def record_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V2, E7."""
    rows = records(spark, sf_dir).select("split", F.explode_outer(validation.record_errors()).alias("error"))
    return rows.groupBy("split", F.coalesce("error", F.lit("none")).alias("error")).agg(F.count(F.lit(1)).alias("n"))


@query
def readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V3."""
    return validation.readiness(records(spark, sf_dir))


@query
def squad_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flattened records with ids that every run gives alike."""
    rows = spans.to_squad2(X.classified(spark, sf_dir), "model")
    return rows.select(
        "id", validation.context_id_of("id").alias("context_id"), "is_impossible", F.try_element_at("answers.text", F.lit(1)).alias("answer"), F.try_element_at("answers.answer_start", F.lit(1)).alias("answer_start")
    )


@query
def legacy_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V5: flat rows, some with blanks around the answer, made records."""
    rows = X.candidates(spark, sf_dir).where("model = 'a'")
    flat = rows.select(
        F.concat_ws("-", "context_id", "k").alias("index"), "context", "question", F.substring("context", F.col("answer_start"), F.length("answer_text") + 1).alias("answer_text"),
        (F.col("answer_start") - 1).alias("answer_start"), F.when(F.col("is_impossible") == IMPOSSIBLE, "1").otherwise("0").alias("impossible_find_answer"),
    )
    out = validation.to_records(flat.where("answer_start >= 0"))
    return out.select("id", "context_id", "is_impossible", F.try_element_at("answers.text", F.lit(1)).alias("answer"), F.try_element_at("answers.answer_start", F.lit(1)).alias("answer_start"))


@query
def turn_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V7: conversations with another number of turns than four."""
    return validation.incomplete_contexts(X.table(spark, sf_dir, "conversations"), 4, "conv_id")


@query
def resume_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V8: what is kept when interrupted work, which lost a row in seven, goes on."""
    rows = X.candidates(spark, sf_dir).where("model = 'a' AND h % 7 <> 0")
    done, kept = validation.resume_state(rows)
    return kept.groupBy("question").agg(F.count(F.lit(1)).alias("n")).crossJoin(done.agg(F.count(F.lit(1)).alias("finished")))  # one row on the right


@query
def gold_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V9."""
    rows = X.candidates(spark, sf_dir).withColumn("split", F.col("model"))
    return validation.gold_leaks(rows, gold_pairs(rows)).select("split", F.col("count").alias("n"))


def gold_pairs(rows: DataFrame) -> DataFrame:
    return rows.where("model = 'a' AND h % 11 = 0").select("context", "question")


# Spans.


@query
def span_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E1, E6, E8."""
    rows = X.candidates(spark, sf_dir)
    new = spans.relabel(rows.withColumn("found_in_context", F.contains("context", "answer_text")))
    return new.select("context_id", "model", long("k").alias("k"), long("answer_start").alias("answer_start"), long("answer_end").alias("answer_end"), "is_impossible", "found_in_context")


@query
def occurrence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping and other occurrences of short answers."""
    rows = X.candidates(spark, sf_dir)
    return rows.select("context_id", "model", long("k").alias("k"), long(T.count_overlapping("context", F.substring("context", 2, 2))).alias("overlapping"), long(T.count_hits("context", ["en", "er", "ou"])).alias("hits"))


@query
def qc_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E4, A2."""
    return X.classified(spark, sf_dir).groupBy("model", "qc_status").agg(F.count(F.lit(1)).alias("n"))


@query
def qc_status_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E4, E5 with their side columns."""
    return X.classified(spark, sf_dir).select(
        "context_id", "model", long("k").alias("k"), "literal_match", "norm_match", long("literal_match_count").alias("literal_match_count"),
        long("recomputed_answer_start").alias("recomputed_answer_start"), "provided_offset_valid", "qc_status", long("answer_words").alias("answer_words"),
    )


@query
def qc_status_accents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E4 with F1: the comparison that takes accents off."""
    return spans.extractive_validity(X.candidates(spark, sf_dir)).groupBy("model", "qc_status").agg(F.count(F.lit(1)).alias("n"))


@query
def qc_status_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E4 with the exact normal form; on precomposed text it is that of qc_status_accents."""
    return spans.extractive_validity(X.candidates(spark, sf_dir), exact=True).groupBy("model", "qc_status").agg(F.count(F.lit(1)).alias("n"))


#: Characters by which short passages meet documents.
FIRST = 8


@query
def passage_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage whole.

    A passage's words 2 to 4 are looked for among the documents' runs of three words, so pairs meet by key. Of
    passages of fewer than five words these may be the last, which can be the beginning of a longer word: they meet by
    their first ``FIRST`` characters, or by all if they have fewer, among as many characters from every place of a document.
    """
    words = lambda c: F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    runs = lambda w: F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - 3, F.lit(0))), lambda i: F.array_join(F.slice(w, i + 1, F.lit(3)), " "))
    docs = X.table(spark, sf_dir, "documents").select("doc_id", "text")
    every = X.table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("passage"), words(F.col("text")).alias("_w"))
    items = every.where(F.size("_w") >= 5).select("item_id", F.array_join(F.slice("_w", 2, 3), " ").alias("run"))
    keyed = docs.withColumn("_w", words(F.col("text"))).select("doc_id", F.explode(F.array_distinct(runs(F.col("_w")))).alias("run"))
    met = keyed.join(items, "run").select("doc_id", "item_id")
    short = every.where(F.size("_w") < 5).select("item_id", F.left("passage", F.lit(FIRST)).alias("run"))
    for row in short.select(F.length("run").alias("n")).distinct().collect():  # at most FIRST + 1 numbers
        places = F.regexp_extract_all("text", F.lit(f"(?s)(?=(.{{{row.n}}}))"), 1) if row.n else F.array(F.lit(""))
        begun = docs.where(F.col("text").isNotNull()).select("doc_id", F.explode(F.array_distinct(places)).alias("run"))
        met = met.union(begun.join(short.where(F.length("run") == row.n), "run").select("doc_id", "item_id"))
    # Each pair once, by its ids alone, before the texts come to it.
    pairs = met.distinct().join(docs, "doc_id").join(every.select("item_id", "passage"), "item_id")
    return pairs.where(F.contains("text", "passage")).select("doc_id", "item_id").distinct()


# Semantics.


@query
def kind_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H1 in both versions."""
    rows = X.candidates(spark, sf_dir)
    return rows.groupBy(semantics.question_kind("question").alias("kind"), semantics.question_kind("question", old=True).alias("old_kind")).agg(F.count(F.lit(1)).alias("n"))


@query
def semantic_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H2, H3, H4, E3, F12, F15."""
    return X.judged(spark, sf_dir).groupBy("model", "question_kind").agg(
        F.count_if("semantic_flag_v1").alias("v1"), F.count_if("semantic_flag_v2").alias("v2"), F.sum(long("semantic_score")).alias("score")
    )


@query
def audit_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H5, F2."""
    return semantics.audit_flag(X.judged(spark, sf_dir)).groupBy("model", "question_kind").agg(F.count_if("audit_flag").alias("flagged"))


@query
def toy_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule engine with rules for the synthetic text."""
    rules = semantics.SemanticRules({"hora": [semantics.wanted(r"\bthe\b"), semantics.marked_near(r"\bthe\b", ["tion"], 30)], "valor": [semantics.short_without(["er"], 3)], "lugar": [semantics.surplus(["en", "th"], 20)]})
    rows = X.classified(spark, sf_dir).withColumn("kind", semantics.question_kind("question"))
    score = rules.score(F.col("kind"), T.collapse("answer_text"), T.collapse("context"), F.col("qc_status"))
    return rows.groupBy("kind").agg(F.sum(long(score)).alias("score"))


# Joins and curation.


def pair_of_models(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = X.judged(spark, sf_dir)
    return rows.where("model = 'a'"), rows.where("model = 'b'")


@query
def agreement_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J1, D4, P10."""
    return agreement.agreement(*pair_of_models(spark, sf_dir)).select("context_id", "question", "agreement")


@query
def agreement_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D4."""
    return agreement.agreement_rates(agreement.agreement(*pair_of_models(spark, sf_dir)))


@query
def merged_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J2, D5."""
    return agreement.merged(*pair_of_models(spark, sf_dir)).select("context_id", "question", "model", "is_impossible", "answer_text", long("recomputed_answer_start").alias("recomputed_answer_start"))


@query
def merged_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the second model read another context under the same id, its rows are no partners."""
    a, b = pair_of_models(spark, sf_dir)
    other = F.when(F.col("doc_id") % 3 == 0, F.concat("context", F.lit(" ."))).when(F.col("doc_id") % 3 == 1, F.col("context"))
    mine = F.when(F.col("doc_id") % 3 < 2, F.col("context"))
    return agreement.merged(a.withColumn("context", mine), b.withColumn("context", other)).select("context_id", "question", F.md5("context").alias("context"), "model", "answer_text")


@query
def unmatched_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that only one model has, after rows of each are lost."""
    rows = X.candidates(spark, sf_dir)
    return agreement.unmatched(rows.where("model = 'a' AND h % 5 <> 0"), rows.where("model = 'b' AND h % 3 <> 0")).groupBy("only_in").agg(F.count(F.lit(1)).alias("n"))


@query
def positional_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both models' answers by place in the context, where the questions must be the same."""
    rows = X.candidates(spark, sf_dir)
    pairs = agreement.positional(rows.where("model = 'a'"), rows.where("model = 'b'"), ("answer_text", "is_impossible"))
    return pairs.select("context_id", long("k").alias("k"), "question", (F.col("is_impossible_a") == F.col("is_impossible_b")).alias("same_label"), (F.col("answer_text_a") == F.col("answer_text_b")).alias("same_text"))


@query
def suffix_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of contexts of equal number under other names; model b lacks every third context."""
    rows = X.candidates(spark, sf_dir)
    other = rows.where("model = 'b' AND doc_id % 3 <> 0").withColumn("context_id", F.regexp_replace("context_id", "^context_", "row-"))
    pairs = agreement.by_number(rows.where("model = 'a'"), other, ("is_impossible", "context_id"))
    return pairs.select("context_number", "question", "context_id_a", "context_id_b", (F.col("is_impossible_a") == F.col("is_impossible_b")).alias("same_label"))


@query
def split_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of splits with their labels' accuracy, null where there are none."""
    docs = X.table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n_docs"))
    labels = X.table(spark, sf_dir, "labels").join(X.table(spark, sf_dir, "documents").select("doc_id", "source", "lang"), "doc_id")
    return docs.join(labels.groupBy("source", "lang").agg(F.avg("quality").alias("accuracy")), ["source", "lang"], "left")


@query
def reference_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions with their references; one without is an error."""
    return metrics.scored(X.predictions(spark, sf_dir), X.references(spark, sf_dir)).groupBy("is_impossible").agg(F.count(F.lit(1)).alias("n"))


@query
def index_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by a list of indices, and those left."""
    ids = X.contexts(spark, sf_dir).select("doc_id")
    chosen = ids.where("doc_id % 3 = 0").union(ids.where("doc_id % 5 = 0")).distinct()
    left = datasets.remaining(ids, chosen, "doc_id")
    return chosen.select(F.lit("chosen").alias("part"), "doc_id").unionByName(left.select(F.lit("left").alias("part"), "doc_id"))


@query
def gold_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J5."""
    rows = X.candidates(spark, sf_dir)
    return datasets.without_gold(rows, gold_pairs(rows)).groupBy("model").agg(F.count(F.lit(1)).alias("n"))


@query
def gold_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O13."""
    rows = X.candidates(spark, sf_dir)
    return gold_pairs(rows).intersect(key_set(rows.where(F.col("is_impossible") == IMPOSSIBLE))).agg(F.count(F.lit(1)).alias("n"))


@query
def strict_expanded_uncertain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D1, D2, D3."""
    return datasets.curated(X.judged(spark, sf_dir)).groupBy("model", "in_strict", "in_expanded", "in_uncertain").agg(F.count(F.lit(1)).alias("n"))


@query
def gold_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D6, D7."""
    rows = X.candidates(spark, sf_dir).where("model = 'a' AND h % 11 = 0")
    audit = rows.select(F.concat_ws("-", "context_id", "k").alias("row_id"), "context", "question", F.col("answer_text").alias("gold_answer"), F.when(F.col("is_impossible") == IMPOSSIBLE, "True").otherwise("False").alias("gold_is_impossible"))
    gold = datasets.gold_records(audit)
    safe = datasets.clamped(gold)
    out = gold.select("id", "is_impossible", F.try_element_at("answers.text", F.lit(1)).alias("answer"), long(F.try_element_at("answers.answer_start", F.lit(1))).alias("answer_start"))
    return out.join(safe.select("id", long(F.try_element_at("answers.answer_start", F.lit(1))).alias("clamped_start")), "id")


def audited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judged rows with a made-up human label."""
    right = F.when(F.col("qc_status").isin("extractive_valid_unique", "no_answer_clean"), F.col("h") % 5 > 0).otherwise(F.col("h") % 3 == 0)
    return X.judged(spark, sf_dir).withColumn("human_correct", right.cast("int"))


@query
def gold_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D8."""
    rows = audited(spark, sf_dir).where("model = 'a'")
    return datasets.gold_accuracy(rows.where("h % 4 = 0"), {"strict": rows.where(datasets.strict()), "expanded": rows.where(datasets.expanded(True)), "none": rows.where("false")})


# Samples and splits.


@query
def hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty contexts, as many as are asked for."""
    return datasets.hash_sample(X.contexts(spark, sf_dir).select("context_id"), 50, 42, "context_id")


@query
def stratified_audit_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixty rows of each model, as many as are asked for."""
    return datasets.audit_sample(X.judged(spark, sf_dir), 60).select("model", "context_id", "question", long("stratum").alias("stratum"), long("place").alias("place"))


@query
def audit_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O7."""
    return X.judged(spark, sf_dir).groupBy("model", datasets.audit_stratum().alias("stratum")).agg(F.count(F.lit(1)).alias("n"))


@query
def context_split_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O8."""
    return datasets.split_by_key(X.contexts(spark, sf_dir), "context_id", 0.8, 0.1, 0.1, 42)


@query
def row_split_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O9, O11."""
    return datasets.split_by_key(X.references(spark, sf_dir), "id", 0.8, 0.0, 0.2, 7)


@query
def stride_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O10."""
    return datasets.shards(X.contexts(spark, sf_dir).select("context_id"), "context_id", 4, seed=42).select("context_id", "place", "shard")


@query
def ordered_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O10 in order of the keys themselves."""
    return datasets.shards(X.contexts(spark, sf_dir).select("context_id"), "context_id", 4).select("context_id", "place", "shard")


@query
def experiment_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D9."""
    rows = X.judged(spark, sf_dir).where("model = 'a'").select("context_id", "question", "qc_status", "is_impossible", "provided_offset_valid", "semantic_heuristic_flag")
    parts = datasets.split_by_key(rows, "context_id", 0.7, 0.15, 0.15, 42)
    return datasets.experiment_splits(parts, rows.where(datasets.strict()), rows).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query
def prepared_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Splits from train and test, from all three parts, and from train alone."""
    ids = X.references(spark, sf_dir).select("id", "context_id", "h")
    test, rest = ids.where("h % 10 = 0"), ids.where("h % 10 > 0")
    cases = {"two": {"train": rest, "test": test}, "three": {"train": rest.where("h % 10 > 1"), "validation": ids.where("h % 10 = 1"), "test": test}, "one": {"train": ids}}
    every = [datasets.prepared_splits(parts).groupBy(F.lit(name).alias("given"), "split").agg(F.count(F.lit(1)).alias("n")) for name, parts in cases.items()]
    return every[0].unionByName(every[1]).unionByName(every[2])


@query
def longest_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O1, O2: the twenty longest texts."""
    return reports.longest_texts(X.table(spark, sf_dir, "documents").select("doc_id", "text"), "text", "doc_id", 20).select("doc_id", long("chars").alias("chars"))


@query
def top3_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O3."""
    rows = X.table(spark, sf_dir, "events").select("event_type", "event_id", "value")
    return reports.first_per_group(rows, ["event_type"], [F.desc("value"), "event_id"]).select("event_type", "event_id", "value", long("place").alias("place"))


@query
def first_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of equal texts the first."""
    rows = X.table(spark, sf_dir, "documents").dropna(subset=["text"]).select("doc_id", F.md5("text").alias("digest"))
    return rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies")).where("copies > 1")


@query
def union_with_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O12."""
    a = X.table(spark, sf_dir, "labels").select("doc_id", long("quality").alias("quality"))
    b = X.table(spark, sf_dir, "documents").select("doc_id", "lang")
    return a.unionByName(b, allowMissingColumns=True).groupBy("quality", "lang").agg(F.count(F.lit(1)).alias("n"))


# Metrics.


@query
def em_f1_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F4, F5, F6, F7, M1 by row."""
    rows = metrics.at_threshold(metrics.scored(X.predictions(spark, sf_dir), X.references(spark, sf_dir)))
    return rows.select("id", "em_kept", F.round("f1_kept", 9).alias("f1_kept"), "em", F.round("f1", 9).alias("f1"))


@query
def squad_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1, A25."""
    return metrics.squad_metrics(X.predictions(spark, sf_dir), X.references(spark, sf_dir))


@query
def metrics_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M3."""
    return metrics.squad_metrics(X.predictions(spark, sf_dir), X.references(spark, sf_dir), by=("kind",))


@query
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W2, M2."""
    rows = metrics.scored(X.predictions(spark, sf_dir), X.references(spark, sf_dir))
    return metrics.sweep(rows).select("threshold", F.round("exact", 9).alias("exact"), F.round("f1", 9).alias("f1"))


@query
def best_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M2."""
    found = metrics.best_thresholds(metrics.scored(X.predictions(spark, sf_dir), X.references(spark, sf_dir)))
    return found.select(F.round("best_exact", 9).alias("best_exact"), F.round("best_f1", 9).alias("best_f1"))


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A training curve made of the events of each day."""
    daily = X.table(spark, sf_dir, "events").groupBy(F.dayofmonth("ts").cast("double").alias("epoch")).agg((F.count_if(F.col("value") > 50) / F.count(F.lit(1))).alias("eval_f1"), F.min("value").alias("eval_best_f1_thresh"))
    return daily


@query
def dev_tuned_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain scores, those at the development set's threshold and those at the rows' own best."""
    rows = metrics.scored(X.predictions(spark, sf_dir), X.references(spark, sf_dir))
    return metrics.tuned(history(spark, sf_dir), rows).select("mode", F.round("t", 9).alias("threshold"), F.round("exact", 9).alias("exact"), F.round("f1", 9).alias("f1"), "total")


@query
def plateau(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W1."""
    return metrics.plateau(history(spark, sf_dir), 0.03).select("epoch", F.round("eval_f1", 9).alias("eval_f1"), F.round("delta", 9).alias("delta"), F.round("future_best", 9).alias("future_best"), "is_plateau", "is_best")


@query
def epoch_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M9: the last value of each kind for each epoch."""
    log = X.table(spark, sf_dir, "events").select(F.dayofmonth("ts").alias("epoch"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "click", F.col("value")).alias("loss"), F.when(F.col("user_id") % 2 == 0, F.col("value")).alias("eval"))
    return metrics.epochs_of(log, ["loss", "eval"]).select(long("epoch").alias("epoch"), "loss", "eval")


# Statistics and reports.


@query
def confusion_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A16."""
    rows = audited(spark, sf_dir).where(F.col("is_impossible") == ANSWERED)
    return stats.confusion(rows, ["model", "question_kind"], "semantic_heuristic_flag", "human_correct")


@query
def wilson_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A17, A3."""
    rows = X.table(spark, sf_dir, "labels").join(X.table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return stats.accuracy_intervals(rows, "lang", "quality")


@query
def stratum_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O7, A3, A17."""
    return stats.accuracy_intervals(audited(spark, sf_dir).withColumn("stratum", datasets.audit_stratum()), ["model", "stratum"], "human_correct")


@query
def two_prop_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Z and p."""
    return stats.two_proportion_z(audited(spark, sf_dir), "model", "human_correct", "a", "b").withColumn("p", F.round("p", 7))


@query
def chi_square(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistic with Yates's correction, and p."""
    return stats.chi_square(audited(spark, sf_dir), "model", "human_correct").withColumn("p", F.round("p", 7))


@query
def chi_square_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A19 with more than one degree of freedom."""
    rows = X.table(spark, sf_dir, "labels").join(X.table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return stats.chi_square(rows, "lang", "quality").withColumn("p", F.round("p", 7))


@query
def margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows for a margin, and the worst margin of each model's rows."""
    need = F.ceil(F.lit(1.96 * 1.96 * 0.25) / (F.lit(0.05) * F.lit(0.05)))
    n = F.count(F.lit(1))
    return X.candidates(spark, sf_dir).groupBy("model").agg((1.96 * F.sqrt(0.25 / n)).alias("worst_margin"), F.max(need).cast("long").alias("rows_for_5_points"))


@query
def abstention_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5."""
    return reports.abstention(X.classified(spark, sf_dir), "model")


@query
def label_crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A6, F19."""
    rows = X.candidates(spark, sf_dir).withColumn("kind", semantics.question_kind("question"))
    return reports.crosstab_percent(rows, "kind", "is_impossible", [IMPOSSIBLE, ANSWERED])


@query
def word_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A7, A10."""
    return reports.describe(worded(spark, sf_dir), "words", "lang")


@query
def price_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A7, A10, P6 for continuous values: no task holds all of a group's."""
    rows = X.table(spark, sf_dir, "lineitem").withColumn("l_returnflag", F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")))
    found = reports.quantiles(rows, "l_extendedprice", (0.01, 0.25, 0.5, 0.75, 0.99), "l_returnflag")
    return found.select("l_returnflag", *[F.round(c, 4).alias(c) for c in ("p1", "p25", "p50", "p75", "p99")])


@query
def word_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A8, A10."""
    return reports.population(worded(spark, sf_dir), "words", "lang")


@query
def price_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K8: the boxes of prices, whose few highest lie beyond the whiskers, by return flag."""
    rows = X.table(spark, sf_dir, "lineitem").select(F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("l_returnflag"), (F.col("l_extendedprice") * F.col("l_discount")).alias("off"))
    found = reports.box_plot(rows, "off", "l_returnflag")
    return found.select("l_returnflag", "n", *[F.round(c, 4).alias(c) for c in ("low", "q1", "median", "q3", "high")], "below", "above")


@query
def word_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A11."""
    return reports.histogram(worded(spark, sf_dir), "words", 50)


@query
def overlong_p99(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A9."""
    return reports.overlong(X.classified(spark, sf_dir), "model")


@query
def duplicated_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A12."""
    return reports.duplicates_beyond_first(X.candidates(spark, sf_dir), "answer_text", "model")


@query
def grouped_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1, A3, A4."""
    rows = X.table(spark, sf_dir, "events")
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.avg("value").alias("mean"), F.count_distinct("user_id").alias("users"))


@query
def pivot_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A13."""
    rows = X.table(spark, sf_dir, "events").withColumn("day", F.dayofmonth("ts"))
    return reports.pivoted(rows, ["day"], "event_type", ["click", "view", "purchase"], F.avg("value")).withColumn("day", long("day"))


@query
def unpivot_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A14."""
    wide = X.table(spark, sf_dir, "labels").groupBy("toxic").agg(F.avg("quality").alias("eval_quality"), F.sum(F.col("quality").cast("double")).alias("eval_total"))
    return reports.melted(wide.withColumn("toxic", long("toxic")), ["toxic"], ["eval_quality", "eval_total"], prefix="eval_")


@query
def metric_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A15."""
    return reports.metric_table(X.judged(spark, sf_dir), 200)


@query
def best_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A21."""
    rows = X.table(spark, sf_dir, "events").select("event_type", "event_id", "user_id", F.floor("value").alias("score"))
    return reports.best_row(rows, ["event_type"], "score", "event_id", ["event_id", "user_id", "score"])


def worker_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs of workers made of events: some in the root, some in folders of resumed runs."""
    rows = X.table(spark, sf_dir, "events").withColumn("n", F.col("event_id") % 90 + 10)
    line = F.concat(
        F.lit("x 1/99 [0:00:01<9\n"), F.when(F.col("event_id") % 4 == 0, "Error crítico fallback\n").otherwise("Fallback\nCheckpoint guardado\n"), F.col("n").cast("string"), F.lit("/99 ["),
        (F.col("event_id") % 3).cast("string"), F.lit(":05:"), F.lpad((F.col("user_id") % 60).cast("string"), 2, "0"), F.lit("<00:31"),
    )
    path = F.when(F.col("user_id") % 3 == 0, F.concat(F.lit("w"), F.col("event_id"), F.lit(".log"))).otherwise(F.concat(F.lit("resume_"), F.col("user_id") % 2, F.lit("/w"), F.col("event_id"), F.lit(".log")))
    return rows.select(F.when(F.col("event_type") == "click", "a").otherwise("b").alias("model"), path.alias("path"), F.when(F.col("event_id") % 11 == 0, "nothing yet").otherwise(line).alias("text"))


@query
def log_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S7, F13, F14, A22."""
    return reports.segment_summary(reports.parsed_logs(worker_logs(spark, sf_dir)))


@query
def log_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A22 for each model."""
    return reports.model_summary(reports.segment_summary(reports.parsed_logs(worker_logs(spark, sf_dir))))


@query
def probe_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A23."""
    rows = X.table(spark, sf_dir, "documents").select((F.lit(128) * (1 + F.col("doc_id") % 3)).alias("max_new_tokens"), (F.col("doc_id") % 5 > 0).alias("ok"), F.col("n_chars").alias("answer_chars"), long(T.word_count("text")).alias("answer_tokens"))
    return reports.probe_summary(rows)


@query
def benchmark_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A24."""
    rows = X.table(spark, sf_dir, "events").select(F.col("event_type").alias("model"), (F.col("event_id") % 7 > 0).alias("ok"), F.col("value").alias("elapsed_s"))
    return reports.benchmark_summary(rows)


@query
def experiment_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source's model on the documents of every language."""
    return reports.plan_of(X.table(spark, sf_dir, "documents"), "source", "lang", ["zsl", "ft"], 4)


@query
def rows_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A28."""
    return reports.counts_of_counts(X.table(spark, sf_dir, "conversations"), "conv_id")


@query
def mode_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M8."""
    rows = X.table(spark, sf_dir, "events").select("event_type", F.when(F.col("user_id") % 2 == 0, "zsl").otherwise("ft").alias("mode"), "value")
    return reports.deltas(rows, ["event_type"], ["value"])


# Text, JSON and nested data.


@query
def normalized_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1 (fast), F2, F3."""
    return X.contexts(spark, sf_dir).select("context_id", F.md5(T.normalize_fast("context")).alias("bare"), F.md5(T.collapse("context")).alias("low"), F.length(T.strip("context")).cast("long").alias("stripped"))


@query
def metric_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F4, F5."""
    return X.contexts(spark, sf_dir).select("context_id", long(F.size(T.tokens("context"))).alias("n_tokens"), F.md5(T.normalize_answer("context")).alias("plain"))


@query
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of JSON texts."""
    parsed = F.from_json("props", "k bigint, page string, ref string")
    return X.table(spark, sf_dir, "events").select("event_id", F.try_parse_json("props").isNotNull().alias("valid"), parsed["k"].alias("k"), parsed["page"].alias("page"), parsed["ref"].alias("ref"))


@query
def json_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fenced, wrapped and broken answers of a generator."""
    answer = F.concat(F.lit('{"answer_text": "w'), F.col("doc_id").cast("string"), F.lit('", "is_impossible": "respondido"}'))
    kind = F.col("doc_id") % 4
    raw = F.when(kind == 0, answer).when(kind == 1, F.concat(F.lit("```json\n"), answer, F.lit("\n```"))).when(kind == 2, F.concat(F.lit("Claro: "), answer, F.lit(" listo"))).otherwise(F.substring(answer, 1, 12))
    return X.table(spark, sf_dir, "documents").select("doc_id", T.parse_answer(raw).alias("a")).select("doc_id", "a.answer_text", "a.is_impossible")


@query
def nested_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as nested documents, flattened again."""
    return flatten_nested(nested(spark, sf_dir)).select("id", F.md5("question").alias("question"), "is_impossible", "answer", long("answer_start").alias("answer_start"))


def nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nested document for each conversation: its turns are the questions."""
    turns = X.table(spark, sf_dir, "conversations").withColumn("text", T.or_empty("text"))
    qas = turns.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("text").alias("question"), (F.col("role") == "system").alias("imp")))).alias("q"), F.min("text").alias("context")
    )
    answer = lambda x: F.when(F.length(x["question"]) > 5, F.array(F.struct(F.substring(x["question"], 1, 3).alias("text"), F.lit(3).alias("answer_start")))).otherwise(F.array().cast("array<struct<text:string,answer_start:int>>"))
    paragraph = F.struct("context", F.transform("q", lambda x: F.struct(x["id"].alias("id"), x["question"].alias("question"), x["imp"].alias("is_impossible"), answer(x).alias("answers"))).alias("qas"))
    return qas.select(F.array(F.struct(F.array(paragraph).alias("paragraphs"))).alias("data"))


@query
def token_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W3."""
    rows = decode.token_windows(X.table(spark, sf_dir, "documents").select("doc_id", "text"), "text", 384, 128)
    return rows.select("doc_id", long("window").alias("window"), long("first").alias("first"), long(F.size("tokens")).alias("n_tokens"))


@query
def token_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M6: spans of characters as tokens of fixed width, as many as the context has."""
    rows = X.classified(spark, sf_dir).where("model = 'a' AND literal_match")
    size = F.length("context")
    offsets = F.transform(F.sequence(F.lit(0), F.floor((size - 1) / 10).cast("int")), lambda i: F.struct((i * 10).alias("b"), F.least(i * 10 + 10, size).alias("e")))
    at = F.col("recomputed_answer_start")
    return rows.select("context_id", long("k").alias("k"), decode.span_tokens(offsets, at, at + F.length(T.strip("answer_text"))).alias("s")).select("context_id", "k", long("s.start_token").alias("start_token"), long("s.end_token").alias("end_token"))


@query
def window_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M6 over W3: answers in windows of 40 words that share 15."""
    rows = X.classified(spark, sf_dir).where("model = 'a' AND literal_match")
    spans_ = rows.select("context_id", "k", F.col("recomputed_answer_start").alias("start"), (F.col("recomputed_answer_start") + F.length(T.strip("answer_text"))).alias("end"))
    found = decode.window_labels(X.contexts(spark, sf_dir), spans_, 40, 15)
    return found.select("context_id", *[long(c).alias(c) for c in ("k", "window", "start_token", "end_token")])


def logits(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Windows over each whole context, half overlapping, with logits that follow from a hash.

    A window has 38 tokens of five characters and, at 0 and 20, two that stand for none; these and tokens beyond the end are at (0, 0).
    """
    ids = X.contexts(spark, sf_dir).select(F.col("context_id").alias("id"), "context")
    value = lambda side: F.transform(F.sequence(F.lit(0), F.lit(39)), lambda i: (F.conv(F.substring(F.md5(F.concat_ws("/", "id", "window", i, F.lit(side))), 1, 6), 16, 10).cast("double") / 1e6))
    begin = lambda i: F.col("window") * 95 + (i - F.when(i < 20, 1).otherwise(2)) * 5
    offsets = F.transform(
        F.sequence(F.lit(0), F.lit(39)),
        lambda i: F.when((i == 0) | (i == 20) | (begin(i) >= F.col("size")), F.struct(F.lit(0).alias("b"), F.lit(0).alias("e"))).otherwise(F.struct(begin(i).alias("b"), F.least(begin(i) + 5, F.col("size")).alias("e"))),
    )
    last = F.greatest(F.ceil(F.length("context") / 95).cast("int") - 2, F.lit(0))
    wide = ids.select("id", F.length("context").alias("size"), F.explode(F.sequence(F.lit(0), last)).alias("window"))
    return wide.select(F.col("id").alias("example_id"), "window", offsets.alias("offsets"), value("s").alias("start_logits"), value("e").alias("end_logits")), ids


@query
def decode_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M5, O4."""
    return decode.decode(*logits(spark, sf_dir))


@query
def top_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best positions of every vector."""
    rows = X.table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(decode.top_positions(F.col("embedding"), 3)).alias("place", "p"))
    return rows.select("vec_id", long("place").alias("place"), long("p.at").alias("at"))


@query
def similarity_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F10, F11."""
    rows = X.candidates(spark, sf_dir).withColumn("impossible", F.col("is_impossible") == IMPOSSIBLE)
    return agreement.similarity_agreement(rows.where("model = 'a'"), rows.where("model = 'b'")).groupBy("agreement").agg(F.count(F.lit(1)).alias("n"))


@query
def bleu_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F21."""
    rows = X.predictions(spark, sf_dir).join(X.references(spark, sf_dir).select("id", F.coalesce(F.try_element_at("answers.text", F.lit(1)), F.lit("")).alias("gold")), "id")
    return rows.select("id", T.google_bleu("prediction_text", "gold").alias("bleu"))


@query
def run_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names, paths and prompts."""
    rows = X.contexts(spark, sf_dir).withColumn("path", F.concat(F.lit("out/model "), F.col("doc_id") % 3, F.lit("/strict/zsl/"), "context_id", F.lit(".csv")))
    return rows.select(
        "context_id", T.sanitized("path", 40).alias("name"), T.path_part("path", 4).alias("model"), T.path_part("path", 3).alias("dataset"), T.path_part("path", 2).alias("mode"), F.md5(T.prompt("context", F.lit("¿?"))).alias("prompt")
    )


@query
def word_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a clamped window around a span, and a part at an offset."""
    rows = X.classified(spark, sf_dir).where("literal_match")
    at = F.col("recomputed_answer_start")
    size = F.length(T.strip("answer_text"))
    return rows.select("context_id", "model", long("k").alias("k"), F.md5(T.window_around("context", at, size)).alias("around"), T.starts_at("context", T.strip("answer_text"), F.col("answer_start")).alias("at_given"))


# Extensions.


@query
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumbling windows, as the stream computes them."""
    rows = incremental.windowed_counts(X.table(spark, sf_dir, "events"))
    return rows.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n", "total")


@query
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session windows of users."""
    return incremental.session_counts(X.table(spark, sf_dir, "events")).groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.max("n").alias("longest"))


@query
def generation_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hook for a generator: contexts that aren't done are asked; here the answer is the first word."""

    def make(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            yield batch.assign(answer_text=batch["context"].str.split().str[0])[["context_id", "answer_text"]]

    todo = X.contexts(spark, sf_dir)
    done = todo.where("doc_id % 2 = 0").select("context_id")
    return incremental.generate(todo, make, "context_id string, answer_text string", done)


class Moody:
    """A generator that fails for some questions always, for others the first time."""

    def __init__(self) -> None:
        self.asked: set[tuple[str, str]] = set()

    def __call__(self, context: str, question: str) -> dict:
        mood = int(hashlib.md5(f"{context}/{question}".encode()).hexdigest()[0], 16)
        again = (context, question) in self.asked
        if mood < 4 or mood < 8 and not again:
            self.asked.add((context, question))
            raise RuntimeError(f"mood {mood}")
        self.asked.discard((context, question))
        word = context.split()[0]
        return {"answer_text": word, "answer_start": context.find(word), "answer_end": context.find(word) + len(word)}


@query
def generation_fallbacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A generator that fails for some rows: every context keeps its five, with what went wrong."""
    asked = X.contexts(spark, sf_dir).select("context_id", "context", F.explode(F.array(*[F.lit(q) for _, q in X.QUESTIONS])).alias("question")).distinct()
    return incremental.answers(asked, Moody(), retries=2, delay=0.0).drop("context")


@query
def kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cohen's kappa of two labels."""
    rows = X.table(spark, sf_dir, "labels")
    n = F.count(F.lit(1)).cast("double")
    q, t = F.avg(F.col("quality").cast("double")), F.avg(F.col("toxic").cast("double"))
    seen, chance = F.count_if(F.col("quality") == F.col("toxic")) / n, q * t + (1 - q) * (1 - t)
    return rows.agg(F.try_divide(seen - chance, 1 - chance).alias("kappa"))


@query
def label_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine similarity of every vector to its label's mean vector."""
    rows = X.table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("long").alias("label"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    means = rows.select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("c"))
    # One row a label, so that each vector meets its label's whole mean at once.
    centres = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "c"))), lambda s: s["c"]).alias("m"))
    total = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    cosine = total("v", "m") / (F.sqrt(total("v", "v")) * F.sqrt(total("m", "m")))
    return rows.join(centres, "label").select("vec_id", "label", F.round(cosine, 9).alias("cosine"))


@query
def pricing_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rolled-up sums by flag and status."""
    rows = X.table(spark, sf_dir, "lineitem")
    return rows.rollup("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("quantity"), F.count(F.lit(1)).alias("n"))


@query
def event_lags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours between a user's events: the least and the mean."""
    rows = X.table(spark, sf_dir, "events").withColumn("before", F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    hours = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("before").cast("timestamp"))) / 3.6e9
    return rows.where("before IS NOT NULL").groupBy("user_id").agg(F.round(F.min(hours), 6).alias("least"), F.round(F.avg(hours), 6).alias("mean"))


from . import files  # noqa: E402, F401  registers its queries
