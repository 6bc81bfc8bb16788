"""Structural and schema validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..schemas import LABELS, QUESTIONS_PER_CONTEXT

REQUIRED = ("context_id", "context", "question", "answer_text", "is_impossible")


def normalize_candidates(frame: DataFrame) -> DataFrame:
    """Null texts to '', labels trimmed in lower case, the impossible mark a boolean."""
    texts = {c: T.or_empty(c) for c in ("context", "question", "answer_text")}
    out = frame.withColumns(texts).withColumn("is_impossible", F.lower(T.strip(T.or_empty("is_impossible"))))
    return out.withColumn("impossible_find_answer", T.as_bool("impossible_find_answer")) if "impossible_find_answer" in frame.columns else out


def count_if(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


def percent(part: Column, whole: Column, places: int | None = 2) -> Column:
    """100 part / whole; 0 for an empty whole."""
    value = F.coalesce(F.try_divide(part * F.lit(100.0), whole), F.lit(0.0))
    return value if places is None else T.half_even(value, places)


def structural_report(frame: DataFrame, by: str = "model", questions: int = QUESTIONS_PER_CONTEXT) -> DataFrame:
    """Rows, usable rows, labels, repeated keys and complete contexts for each value of ``by``.

    A key repeated n times counts n - 1 times; null keys count like others. The questions of a
    context are counted first, so no set of all keys is held.
    """
    filled = [F.col(c).isNotNull() for c in REQUIRED]
    required = filled[0] & filled[1] & filled[2] & filled[3] & filled[4]
    by_key = frame.groupBy(by, "context_id", "question").agg(
        F.count(F.lit(1)).alias("rows"), count_if(required).alias("required"), count_if(F.col("is_impossible").isin(*LABELS)).alias("labelled")
    )
    by_context = by_key.groupBy(by, "context_id").agg(
        F.sum("rows").alias("rows"), F.sum("required").alias("required"), F.sum("labelled").alias("labelled"),
        F.sum(F.col("rows") - 1).alias("repeated"), F.count("question").alias("questions"),
    )
    out = by_context.groupBy(by).agg(
        F.sum("rows").alias("rows"), F.sum("required").alias("required_ok"), F.sum("labelled").alias("label_ok"), F.sum("repeated").alias("duplicate_keys"),
        count_if(F.col("questions") == questions).alias("complete_contexts"), F.count("context_id").alias("contexts"),
    )
    asked = frame.groupBy(by).agg(F.count_distinct("question").alias("questions"))
    return out.join(asked, by).withColumn("valid_rate", percent(F.col("required_ok"), F.col("rows")))


def record_errors(strict_text: bool = True) -> Column:
    """What is wrong with a record with nested answers, as an array of texts.

    Missing fields or misshapen answers end the search; else: answers of an impossible
    question, an answerable one without exactly one span, a span that isn't at its offset.
    """
    names = ("id", "context", "question", "is_impossible", "answers")
    missing = F.filter(F.array(*[F.when(F.col(c).isNull(), F.lit(f"missing:{c}")) for c in names]), lambda e: e.isNotNull())
    texts, starts = F.col("answers.text"), F.col("answers.answer_start")
    misshapen = texts.isNull() | starts.isNull() | (F.size(texts) != F.size(starts))
    first, at = F.try_element_at(texts, F.lit(1)), F.try_element_at(starts, F.lit(1))
    impossible = F.col("is_impossible")
    found = F.array(
        F.when(impossible & ((F.size(texts) > 0) | (F.size(starts) > 0)), F.lit("impossible_with_answers")),
        F.when(~impossible & (F.size(texts) != 1), F.lit("answerable_without_one_span")),
        F.when(~impossible & (F.size(texts) == 1) & ~F.coalesce(T.starts_at("context", first, at), F.lit(False)), F.lit("offset_mismatch")),
    )
    return F.when(F.size(missing) > 0, missing).when(misshapen, F.array(F.lit("answers_misshapen"))).otherwise(F.filter(found, lambda e: e.isNotNull()))


def readiness(frame: DataFrame, by: str = "split") -> DataFrame:
    """For each split, counts that should be zero and the usual totals."""
    texts, starts, impossible = F.col("answers.text"), F.col("answers.answer_start"), F.col("is_impossible")
    first, at = F.try_element_at(texts, F.lit(1)), F.try_element_at(starts, F.lit(1))
    by_id = frame.withColumn("_bad", F.size(record_errors()) > 0).groupBy(by, "id", "context_id").agg(
        F.count(F.lit(1)).alias("rows"),
        count_if(impossible).alias("impossible"),
        count_if(impossible & ((F.size(texts) > 0) | (F.size(starts) > 0))).alias("iwa"),
        count_if(~impossible & (F.size(texts) == 0)).alias("awa"),
        count_if(~impossible & ~F.coalesce(T.starts_at("context", first, at), F.lit(False))).alias("bad_offset"),
        count_if(F.col("_bad")).alias("bad"),
    )
    return by_id.groupBy(by).agg(
        F.sum("rows").alias("rows"), F.count_distinct("context_id").alias("contexts"), F.sum(F.col("rows") - F.col("impossible")).alias("answerable"), F.sum("impossible").alias("impossible"),
        percent(F.sum("impossible"), F.sum("rows")).alias("impossible_rate"), F.sum("iwa").alias("impossible_with_answers"), F.sum("awa").alias("answerable_without_answers"),
        F.sum("bad_offset").alias("invalid_offsets"), (F.sum("rows") - F.count_distinct("id")).alias("duplicate_ids"), F.sum("bad").alias("schema_errors"),
    )


def is_legacy(frame: DataFrame) -> bool:
    return {"answer_text", "impossible_find_answer"} <= set(frame.columns)


def from_legacy(frame: DataFrame) -> DataFrame:
    """Flat rows as records with nested answers.

    Texts are stripped; where the stripped text isn't at its offset but is after the blanks
    that were before it, the offset moves there. A missing offset is -1. Ids come from the
    index, else the id, else a digest of context and question; contexts' ids from a digest.
    """
    context, question, raw = T.or_empty("context"), T.or_empty("question"), T.or_empty("answer_text")
    text = T.strip(raw)
    start = F.coalesce(F.col("answer_start").try_cast("int"), F.lit(-1))
    moved = start + F.length(raw) - F.length(F.regexp_replace(raw, r"(?U)^\s+", ""))
    repaired = F.when((start >= 0) & ~T.starts_at(context, text, start) & T.starts_at(context, text, moved), moved).otherwise(start)
    impossible = T.as_bool("impossible_find_answer")
    has = lambda c: F.col(c).cast("string") if c in frame.columns else F.lit(None).cast("string")
    name = F.coalesce(F.concat(F.lit("legacy_"), has("index")), F.nullif(has("id"), F.lit("")), F.concat(F.lit("legacy_"), F.substring(F.md5(F.concat(context, question)), 1, 16)))
    answers = F.struct(
        F.when(impossible, F.array().cast("array<string>")).otherwise(F.array(text)).alias("text"),
        F.when(impossible, F.array().cast("array<int>")).otherwise(F.array(repaired)).alias("answer_start"),
    )
    named = F.coalesce(F.nullif(has("context_id"), F.lit("")), F.concat(F.lit("ctx_"), F.substring(F.md5(context), 1, 12)))
    return frame.select(name.alias("id"), context.alias("context"), question.alias("question"), impossible.alias("is_impossible"), answers.alias("answers"), named.alias("context_id"))


def to_records(frame: DataFrame, schema: str = "auto") -> DataFrame:
    """Records with nested answers from either schema; ``auto`` goes by the columns."""
    return from_legacy(frame) if schema == "legacy" or (schema == "auto" and is_legacy(frame)) else frame


def context_id_of(record_id: Column | str, given: Column | None = None, models: tuple[str, ...] = ("merged", "a", "b"), strict: bool = True) -> Column:
    """The context's id: the given one, else that inside the record's id; else an error, or null unless ``strict``."""
    rid = T.or_empty(record_id)
    named = F.nullif(F.regexp_extract(rid, rf"^(?:{'|'.join(models)})_(context_\d+)_([0-9a-f]+)$", 1), F.lit(""))
    parts = F.split(rid, "_")
    by_parts = F.when((F.size(parts) >= 3) & (F.try_element_at(parts, F.lit(2)) == "context"), F.array_join(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0))), "_"))
    lost = F.raise_error(F.concat(F.lit("no context id in id "), rid)).cast("string") if strict else F.lit(None).cast("string")
    return F.coalesce(*([given.cast("string")] if given is not None else []), named, by_parts, lost)


def incomplete_contexts(frame: DataFrame, questions: int = QUESTIONS_PER_CONTEXT, key: str = "context_id") -> DataFrame:
    """Contexts with another number of rows, and that number."""
    return frame.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows")).where(F.col("n_rows") != questions)


def assert_complete(frame: DataFrame, questions: int = QUESTIONS_PER_CONTEXT) -> DataFrame:
    """The frame, unless a context is incomplete; the error names up to twenty."""
    bad = incomplete_contexts(frame, questions).orderBy("context_id").limit(20).collect()
    if bad:
        raise ValueError("incomplete contexts: " + ", ".join(f"{r['context_id']} ({r['n_rows']})" for r in bad))
    return frame


def resume_state(frame: DataFrame, questions: int = QUESTIONS_PER_CONTEXT) -> tuple[DataFrame, DataFrame]:
    """Ids of finished contexts, and the rows to keep when work goes on: those of finished contexts and those without an id."""
    done = frame.where(F.col("context_id").isNotNull()).groupBy("context_id").count().where(F.col("count") == questions).select("context_id")
    kept = frame.join(done, "context_id", "left_semi").unionByName(frame.where(F.col("context_id").isNull()))
    return done, kept


def resume_lines(lines: DataFrame, questions: int = QUESTIONS_PER_CONTEXT) -> tuple[DataFrame, DataFrame]:
    """Ids of finished contexts, and the lines (``value``) to keep when work goes on, as they are: those of finished contexts, those without an id, and those that can't be parsed.

    Blank lines aren't kept. Write the kept lines to a new path.
    """
    parsed = F.from_json("value", "context_id string, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    named = lines.where(T.strip("value") != "").select("value", parsed["context_id"].alias("context_id"))
    done, kept = resume_state(named, questions)
    return done, kept.select("value")


def gold_leaks(records: DataFrame, gold: DataFrame, by: str = "split") -> DataFrame:
    """For each split, rows whose context and question are a gold pair."""
    return records.join(gold.select("context", "question").distinct(), ["context", "question"], "left_semi").groupBy(by).count()


def assert_no_leaks(records: DataFrame, gold: DataFrame, by: str = "split") -> DataFrame:
    found = gold_leaks(records, gold, by).limit(20).collect()
    if found:
        raise ValueError("gold pairs in splits: " + ", ".join(f"{r[by]} ({r['count']})" for r in found))
    return records


def assert_valid(records: DataFrame) -> DataFrame:
    """The records, unless one has an error."""
    found = records.select("id", record_errors().alias("errors")).where(F.size("errors") > 0).limit(5).collect()
    if found:
        raise ValueError("invalid records: " + "; ".join(f"{r['id']}: {','.join(r['errors'])}" for r in found))
    return records


def completeness(frame: DataFrame, expected: int, by: str = "model") -> DataFrame:
    """Rows there should be and are, in percent, and how many are missing."""
    n = F.count(F.lit(1))
    return frame.groupBy(by).agg(n.alias("n_rows"), percent(n, F.lit(expected)).alias("completeness"), percent(F.lit(expected) - n, F.lit(expected)).alias("missing_rate"))


