"""Queries that run over all rows: against the SQL of the whole job, where the twin states less."""

from __future__ import annotations

import difflib
import os
import random
import re
import sys
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import naive_decode
from test_queries import plain

from spanqc.functions import text
from spanqc.operators import agreement, datasets, decode, reports, semantics, stats, validation
from spanqc.plans import queries
from spanqc.plans.oracles import ORACLES
from spanqc.plans.queries import QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def same_as(spark, sf_dir, name, sql, tables):
    con = duckdb.connect()
    for table in tables:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    frame = QUERIES[name](spark, sf_dir)
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(frame.columns)
    want = sorted(tuple(map(plain, r)) for r in found.fetchall())
    assert sorted(tuple(plain(r[c]) for c in names) for r in frame.collect()) == want
    return frame


@pytest.mark.parametrize("name", ["log_segments", "log_models"])
def test_every_event_is_a_log(spark, sf_dir, name):
    frame = same_as(spark, sf_dir.replace("sf0.001", "sf0.01"), name, ORACLES[name], ["events"])  # users grow with the scale
    if name == "log_segments":
        assert frame.groupBy().sum("workers").head()[0] == 10_000


def test_every_span_is_labelled(spark, sf_dir):
    frame = same_as(spark, sf_dir, "token_labels", ORACLES["token_labels"], ["documents"])
    assert frame.where("end_token >= 20").count() > frame.where("end_token < 20").count()


def test_windows_reach_the_end(spark, sf_dir):
    features, examples = queries.logits(spark, sf_dir)
    contexts = {r["id"]: r["context"] for r in examples.collect()}
    rows = [(r["example_id"], r["window"], [tuple(o) for o in r["offsets"]], r["start_logits"], r["end_logits"]) for r in features.collect()]
    covered = {name: set() for name in contexts}
    for name, _, offsets, _, _ in rows:
        covered[name].update(*[range(b, e) for b, e in offsets])
    assert covered == {name: set(range(len(c))) for name, c in contexts.items()}
    got = {r["id"]: (r["prediction_text"], r["no_answer_probability"]) for r in QUERIES["decode_spans"](spark, sf_dir).collect()}
    assert got == naive_decode(rows, contexts, 20, 100)


def test_histogram_spans_all_values(spark, sf_dir):
    big = sf_dir.replace("sf0.001", "sf0.01")
    words = [r["words"] for r in queries.worded(spark, big).collect()]
    assert max(words) > 1000
    want = {k + 1: n for k, n in enumerate(np.histogram(words, 50)[0].tolist()) if n}
    assert {r["bin"]: r["n"] for r in QUERIES["word_histogram"](spark, big).collect()} == want
    same = spark.createDataFrame([(5,), (5,), (None,)], "x int")
    assert [tuple(r) for r in reports.histogram(same, "x", 4).collect()] == [(3, 2)] and reports.histogram(same.where("false"), "x", 4).collect() == []


def test_short_passages(spark, tmp_path):
    docs = [(1, "the red fox jumps over it"), (2, "red foxes"), (3, "of one two three fourteen and"), (4, "x"), (5, None), (6, "it 😀 and 😀 é"), (6, "it 😀 and 😀 é")]
    items = [(1, "red fox"), (2, "one two three four"), (3, "x"), (4, "red fox jumps over it"), (5, "he red fox jumps over i"), (6, None), (7, ""), (8, " it"), (9, "d fox jumps o"), (10, "x "), (11, "😀 a"), (12, "é")]
    spark.createDataFrame(docs, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").coalesce(1).write.parquet(str(tmp_path / "benchmark.parquet"))
    got = sorted(tuple(r) for r in QUERIES["passage_containment"](spark, str(tmp_path)).collect())
    assert got == sorted((d, i) for d, text in set(docs) for i, passage in items if None not in (text, passage) and passage in text)
    plan = QUERIES["passage_containment"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_contexts_by_words_alone(spark, tmp_path):
    rows = [(k, " ".join(["w"] * n), size) for k, (n, size) in enumerate([(81, 500), (82, None), (100, 3), (150, 299), (151, None)])]
    spark.createDataFrame(rows, "doc_id long, text string, n_chars long").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    assert sorted(r["doc_id"] for r in queries.X.contexts(spark, str(tmp_path)).collect()) == [1, 2, 3]


def test_similar_answers_row_by_row(spark, sf_dir):
    rows = queries.X.candidates(spark, sf_dir).select("context_id", "question", "model", "answer_text", "is_impossible").collect()
    by = {(r["context_id"], r["question"], r["model"]): r for r in rows}
    want = Counter()
    for (context, question, model), a in by.items():
        if model == "a":
            b = by[context, question, "b"]
            none = [x["is_impossible"] == "imposible" for x in (a, b)]
            x, y = a["answer_text"] or "", b["answer_text"] or ""
            ratio = difflib.SequenceMatcher(None, x, y).ratio() if x or y else 1.0
            want["both_impossible" if all(none) else "disagree" if any(none) or ratio < 0.7 else "agree"] += 1
    assert {r["agreement"]: r["n"] for r in QUERIES["similarity_agreement"](spark, sf_dir).collect()} == want


def test_bleu_row_by_row(spark, sf_dir):
    said = {r["id"]: r["prediction_text"] for r in queries.X.predictions(spark, sf_dir).collect()}
    gold = {r["id"]: (r["answers"]["text"] or [""])[0] for r in queries.X.references(spark, sf_dir).collect()}
    got = {r["id"]: r["bleu"] for r in QUERIES["bleu_scores"](spark, sf_dir).collect()}
    assert set(got) == set(said)
    for name, text in said.items():
        grams = [[" ".join(w[i : i + n]) for n in (1, 2, 3, 4) for i in range(len(w) - n + 1)] for w in (text.split(), gold[name].split())]
        shared, rest = 0, list(grams[1])
        for g in grams[0]:
            if g in rest:
                rest.remove(g)
                shared += 1
        assert abs(got[name] - (shared / max(map(len, grams)) if any(grams) else 0.0)) < 1e-12


def test_compared_by_place_or_number(spark):
    a = spark.createDataFrame([("context_1", 1, "q", "x"), ("context_1", 2, "r", "y"), ("none", 1, "q", "z")], "context_id string, k int, question string, t string")
    b = spark.createDataFrame([("row-1", 1, "q", "u"), ("row-2", 1, "q", "v")], "context_id string, k int, question string, t string")
    assert [tuple(r) for r in agreement.by_number(a, b, ("t",)).collect()] == [(1, "q", "x", "u")]
    same = a.withColumn("t", F.upper("t"))
    assert sorted((r["k"], r["t_a"], r["t_b"]) for r in agreement.positional(a.where("k < 3"), same, ("t",)).collect()) == [(1, "x", "X"), (1, "z", "Z"), (2, "y", "Y")]
    for other in (same.where("k = 1"), same.withColumn("question", F.lit("q"))):
        with pytest.raises(Exception, match="other questions or places"):
            agreement.positional(a, other, ("t",)).collect()


def test_decomposed_texts_compare_like_precomposed(spark):
    pairs = [("Café", "Cafe\u0301"), ("ﬁn", "fin"), ("½ día", "1⁄2 dia"), ("İ", "i"), ("a\u00a0b", "a b"), ("x", "y"), (None, ""), ("ẞ", "ß")]
    rows = spark.createDataFrame(pairs, "a string, b string").select("*", text.normalize("a").alias("x"), text.normalize("b").alias("y"))
    for r in rows.collect():
        assert (r["x"], r["y"]) == (text.normal_form(r["a"]), text.normal_form(r["b"]))


def test_exact_form_of_all_characters(spark):
    """Every code point, alone and between others; nothing of it runs in Python."""
    every = [k for k in range(1, sys.maxunicode + 1) if not 0xD800 <= k <= 0xDFFF]
    rng = random.Random(5)
    texts = [f"a{chr(k)}B" for k in every] + ["".join(chr(rng.choice(every)) for _ in range(30)) for _ in range(3000)] + ["ΟΔΥΣΣΕΥΣ ΣΑΣ. Σ", "한국어 각각", " x\x1cy ", "“Él” comió , ﬁn\u00a0!"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string").repartition(8).select("t", text.normalize("t").alias("n"))
    assert [r["t"] for r in frame.collect() if r["n"] != text.normal_form(r["t"])] == []
    for name in ("semantic_flags", "merged_policy", "strict_expanded_uncertain", "stratified_audit_hash", "confusion_metrics"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan, name


def test_hits_of_many_hints_in_one_scan(spark):
    hints = [*semantics.OBJECTS, *semantics.PLACES, "aa", "aba", "a", "ab", "."]
    rng = random.Random(6)
    pieces = [*hints, " ", "", "x", "teléfon", "\n"]
    texts = [None, "", *["".join(rng.choices(pieces, k=rng.randint(0, 30))) for _ in range(400)], "aaaa", "ababa", "altauraltaura tabletablet"]
    for some in (hints, semantics.PLACES, ["a"], ["aa"], ["ab", "abc", "b"]):
        rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.count_hits("t", some).alias("n")).collect()
        assert [r["n"] for r in rows] == [sum((r["t"] or "").count(h) for h in some) for r in rows]


def test_rows_over_other_contexts_are_no_pair(spark):
    columns = "context_id string, question string, context string, answer_text string, is_impossible string, qc_status string, provided_offset_valid boolean, semantic_heuristic_flag boolean, recomputed_answer_start int"
    row = lambda context, answer, valid=True: ("c1", "q", context, answer, "respondido", "extractive_valid_unique", valid, False, 3)
    a = spark.createDataFrame([row("otro contexto", "x", False), row(None, "n"), row("el gato", "gato")], columns)
    b = spark.createDataFrame([row("el gato", "gato"), row(None, "m"), row("El gato", "gato")], columns)
    got = [tuple(r) for r in agreement.merged(a, b).select("context", "model", "answer_text").collect()]
    assert sorted(got, key=str) == [("el gato", "a", "gato"), (None, "a", "n")]


def test_chances_of_tests(spark):
    assert abs(stats.normal_two_sided(1.959964) - 0.05) < 1e-6 and abs(stats.chi_square_p(3.841459, 1) - 0.05) < 1e-6 and abs(stats.chi_square_p(7.814728, 3) - 0.05) < 1e-6
    rows = spark.createDataFrame([("a", 1), ("a", 0), ("c", 1)], "m string, ok int")
    assert stats.two_proportion_z(rows, "m", "ok", "a", "b").head()["p"] is None


def test_kept_lines_are_as_they_were(spark):
    lines = ['{"context_id": "c1", "x": 1}'] * 5 + ['{"context_id": "c2"}', "{broken", '{"y": 2}', "  ", '{"context_id": null}', '{"context_id": "c3"}   '] + ['{"context_id": "c4"}'] * 6
    done, kept = validation.resume_lines(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert [r[0] for r in done.collect()] == ["c1"]
    assert sorted(r[0] for r in kept.collect()) == sorted(lines[:5] + ["{broken", '{"y": 2}', '{"context_id": null}'])


def test_shards_in_order_of_keys(spark):
    keys = [f"k{(k * 7919) % 1000:04d}" for k in range(1000)] + ["k0003", None]
    rows = datasets.shards(spark.createDataFrame([(k,) for k in keys], "k string").repartition(5), "k", 4).collect()
    places = {k: p for p, k in enumerate(sorted({k for k in keys if k}))}
    assert len(rows) == 1001 and all((r["place"], r["shard"]) == (places[r["k"]], places[r["k"]] % 4) for r in rows)
    assert datasets.shards(spark.createDataFrame([], "k string"), "k", 4).count() == 0


def test_words_are_counted_up_to_the_most(spark):
    rng = random.Random(8)
    texts = [None, "", " ", "\n\t", *["".join(rng.choices(["w", "é", "😀", " ", "\n", " ", "\x1c", " "], k=rng.randint(0, 40))) for _ in range(500)], "w " * 200_000, "w" * 200_000]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for low, high in ((0, 3), (1, 1), (2, 5), (4, 150)):
        wrong = rows.where(text.words_between("t", low, high) != text.word_count("t").between(low, high))
        assert wrong.count() == 0 and rows.where(text.words_between("t", low, high).isNull()).count() == 0
    plan = queries.X.contexts(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "regexp_extract_all" not in plan and "regexp_count" not in plan


def test_a_context_is_normalised_once(spark, sf_dir):
    rows = queries.X.judged(spark, sf_dir)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.rindex("AS normal_context") > plan.index("Generate explode")  # below the explosion into ten rows
    alone = semantics.heuristics(queries.X.classified(spark, sf_dir))
    assert sorted(rows.columns) == sorted(alone.columns)
    columns = ["context_id", "model", "k", "question_kind", "semantic_flag_v1", "semantic_score", "semantic_heuristic_flag"]
    assert sorted(map(tuple, rows.select(columns).collect())) == sorted(map(tuple, alone.select(columns).collect()))


def test_overlaps_are_counted(spark):
    rng = random.Random(9)
    pairs = [(None, "a"), ("a", None), ("", ""), ("aaaa", "aa"), ("x\\Ey\\Ez", "\\E"), ("ab", "ab"), ("😀a😀a", "😀a"), *[("".join(rng.choices("ab😀", k=rng.randint(0, 9))), "".join(rng.choices("ab😀", k=rng.randint(0, 3)))) for _ in range(500)]]
    got = spark.createDataFrame(pairs, "h string, n string").select("h", "n", text.count_overlapping("h", "n").alias("c")).collect()
    assert [r["c"] for r in got] == [sum((h or "").startswith(n, i) for i in range(len(h or ""))) if n else 0 for h, n in pairs]


def test_blank_spans_and_sorted_positions(spark):
    rng = random.Random(10)
    contexts = {"a": "  😀 \n  x  y \t", "b": "   ", "c": "word", "d": ""}
    rows = []
    for name, context in contexts.items():
        for window in range(3):
            offsets = [(0, 0), *[(b, b + rng.randint(0, 3)) for b in sorted(rng.randint(0, len(context)) for _ in range(8))], (0, 0)]
            rows.append((name, window, offsets, [float(rng.randint(0, 3)) for _ in offsets], [float(rng.randint(0, 3)) for _ in offsets]))
    features = spark.createDataFrame(rows, "example_id string, window int, offsets array<struct<b: int, e: int>>, start_logits array<double>, end_logits array<double>")
    found = decode.decode(features, spark.createDataFrame(list(contexts.items()), "id string, context string"), 6, 4)
    assert {r["id"]: (r["prediction_text"], r["no_answer_probability"]) for r in found.collect()} == naive_decode(rows, contexts, 6, 4)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert [plan[:m.start()].endswith(side) for m, side in zip(re.finditer(r"transform\(filter\(slice\(array_sort\(", plan), ("starts, ", "ends, "), strict=True)] == [True, True], re.findall(r".{80}slice\(array_sort\(", plan)  # once a window, not for each start
