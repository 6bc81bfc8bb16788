from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from spanqc.operators import agreement, datasets, decode, metrics, reports, semantics, spans, stats, validation
from spanqc.plans import fixtures as X
from spanqc.schemas import SENTINEL

CANDIDATE = "context_id string, context string, question string, answer_text string, answer_start string, answer_end string, is_impossible string"


def classified(spark, cases, exact=False):
    data = [(str(i), c, "q", a, s, e, label) for i, (c, a, s, e, label, _) in enumerate(cases)]
    return spans.extractive_validity(spark.createDataFrame(data, CANDIDATE), exact=exact).orderBy(F.col("context_id").cast("int")).collect()


BRANCHES = [
    ("el gato", SENTINEL, None, None, "imposible", "no_answer_clean"),
    ("el gato", "  ", None, None, " IMPOSIBLE ", "no_answer_empty"),
    ("el gato", "gato", "3", "7", "imposible", "imposible_but_span_present"),
    ("el gato", "perro", None, None, "imposible", "no_answer_free_text"),
    ("el gato", SENTINEL, None, None, "respondido", "respondido_no_answer"),
    ("el gato", None, None, None, "respondido", "respondido_no_answer"),
    ("el gato", " gato ", "3", "7", "respondido", "extractive_valid_unique"),
    ("aaaa.", "aa", "0", "2", "respondido", "extractive_ambiguous"),
    ("El  gato", "el gato", "0", "7", "respondido", "extractive_only_normalized"),
    ("el gato", "perro", "x", "y", "otra cosa", "non_extractive_or_hallucinated"),
    ("🎉 gato", "gato", "2", "6", "respondido", "extractive_valid_unique"),
    ("a(b)$", "(b)$", "1", "5", "respondido", "extractive_valid_unique"),
    (None, "x", "0", "1", "respondido", "non_extractive_or_hallucinated"),
]


@pytest.mark.parametrize("exact", [False, True])
def test_each_state(spark, exact):
    got = classified(spark, BRANCHES, exact)
    assert [r["qc_status"] for r in got] == [b[-1] for b in BRANCHES]
    by = {r["answer_text"]: r for r in got}
    assert by[" gato "]["provided_offset_valid"] and by[" gato "]["recomputed_answer_start"] == 3 and by[" gato "]["answer_words"] == 1
    assert by["aa"]["literal_match_count"] == 3 and not by["el gato"]["literal_match"] and by["el gato"]["norm_match"]
    assert by["el gato"]["recomputed_answer_start"] == -1


def test_offsets_that_are_no_offsets(spark):
    cases = [("gato", "gato", a, b, "respondido", "") for a, b in (("-4", "4"), ("4", "0"), ("cero", "4"), (None, None), ("0", "4"))]
    assert [r["provided_offset_valid"] for r in classified(spark, cases)] == [False, False, False, False, True]


def test_relabel(spark):
    rows = spark.createDataFrame([("hola mi nombre es juancarlos", "juan", 0, 0, "x", "imposible"), ("a", " ", 3, 4, "x", "respondido")], "context string, answer_text string, answer_start int, answer_end int, impossible_find_answer string, is_impossible string")
    got = [tuple(r)[2:] for r in spans.relabel(rows).collect()]
    assert got == [(18, 22, "false", "respondido"), (0, 0, "true", "imposible")]


def record(i, imp, texts, starts, context="el gato", question="q"):
    return (i, context, question, imp, (texts, starts), "c")


SQUAD = "id string, context string, question string, is_impossible boolean, answers struct<text:array<string>,answer_start:array<int>>, context_id string"


def test_record_errors(spark):
    rows = [
        record("1", False, ["gato"], [3]), record("2", True, [], []), record("3", True, ["gato"], [3]), record("4", False, [], []), record("5", False, ["gato"], [2]), record("6", False, ["gato"], [-1]),
        record("7", False, ["a", "b"], [0, 1]), record(None, False, ["gato"], [3]), record("9", False, ["gato"], [3, 4]), record("8", False, None, [1]),
    ]
    frame = spark.createDataFrame(rows, SQUAD)
    got = {r[0]: r[1] for r in frame.select("id", validation.record_errors()).collect()}
    assert got == {"1": [], "2": [], "3": ["impossible_with_answers"], "4": ["answerable_without_one_span"], "5": ["offset_mismatch"], "6": ["offset_mismatch"], "7": ["answerable_without_one_span"], None: ["missing:id"], "9": ["answers_misshapen"], "8": ["answers_misshapen"]}
    with pytest.raises(ValueError):
        validation.assert_valid(frame)
    r = validation.readiness(frame.withColumn("split", F.lit("s"))).head()
    assert (r["rows"], r["impossible"], r["impossible_with_answers"], r["schema_errors"]) == (10, 2, 1, 8)


def test_legacy_rows(spark):
    rows = [("7", "el gato", "q", " gato", 2, 7, "no"), (None, "el gato", "q", "gato", None, 7, "0"), ("9", "el gato", "q", "x", 0, 1, "TRUE")]
    frame = spark.createDataFrame(rows, "index string, context string, question string, answer_text string, answer_start int, answer_end int, impossible_find_answer string")
    got = validation.to_records(frame).collect()
    assert [(r["id"], r["answers"]["text"], r["answers"]["answer_start"]) for r in got[::2]] == [("legacy_7", ["gato"], [3]), ("legacy_9", [], [])]
    assert got[1]["answers"]["answer_start"] == [-1] and got[1]["id"].startswith("legacy_") and got[0]["context_id"].startswith("ctx_")


def test_context_ids(spark):
    frame = spark.createDataFrame([("merged_context_2_63be43e3", None), ("other_context_7_zz", None), ("x", "given")], "id string, context_id string")
    assert [r[0] for r in frame.select(validation.context_id_of("id", F.col("context_id"))).collect()] == ["context_2", "context_7", "given"]
    bad = spark.createDataFrame([("nothing",)], "id string")
    assert bad.select(validation.context_id_of("id", strict=False)).head()[0] is None
    with pytest.raises(Exception, match="no context id"):
        bad.select(validation.context_id_of("id")).collect()


def test_completeness_and_resume(spark):
    rows = [(c, i) for c, n in (("a", 4), ("b", 5), ("c", 6)) for i in range(n)] + [(None, 0)]
    frame = spark.createDataFrame(rows, "context_id string, question int")
    with pytest.raises(ValueError, match=r"a \(4\)"):
        validation.assert_complete(frame)
    done, kept = validation.resume_state(frame)
    assert [r[0] for r in done.collect()] == ["b"] and sorted(str(r[0]) for r in kept.collect()) == ["None"] + ["b"] * 5
    assert validation.assert_complete(frame.where("context_id = 'b'")).count() == 5
    gold = spark.createDataFrame([("x", "q")], "context string, question string")
    leaky = spark.createDataFrame([("x", "q", "test")], "context string, question string, split string")
    with pytest.raises(ValueError):
        validation.assert_no_leaks(leaky, gold)
    assert datasets.without_gold(leaky, gold).count() == 0 and validation.assert_no_leaks(datasets.without_gold(leaky, gold), gold).count() == 0


def test_structure_of_an_empty_table(spark, sf_dir):
    empty = X.candidates(spark, sf_dir).where("false")
    assert validation.structural_report(empty).collect() == []
    assert spans.extractive_validity(empty).collect() == []
    assert datasets.audit_sample(semantics.heuristics(spans.extractive_validity(empty)), 10).collect() == []
    assert datasets.split_by_key(empty).collect() == []
    assert metrics.squad_metrics(X.predictions(spark, sf_dir).where("false"), X.references(spark, sf_dir)).head()["exact"] == 0.0


def test_semantic_rules(spark):
    cases = [
        ("hora", "10:30", "llegó a las 10:30 y dejé el auto", "extractive_valid_unique", 1, False), ("hora", "a las diez", "a las diez", "extractive_valid_unique", 1, True), ("hora", "10:30", "fue 10:30", "extractive_ambiguous", 0, False),
        ("fecha", "3 de mayo", "3 de mayo", "extractive_valid_unique", 0, True), ("valor", "$ 50", "$ 50", "extractive_valid_unique", 0, False), ("lugar", "a 20 metros", "a 20 metros", "extractive_valid_unique", 1, False),
        ("lugar", "centro", "centro", "extractive_valid_unique", 2, True), ("objetos", "cosas", "celular moto dinero cosas", "extractive_valid_unique", 3, True), ("objetos", "un celular", "un celular", "non_extractive_or_hallucinated", 0, False),
    ]
    questions = {"hora": "¿A qué hora?", "fecha": "¿fecha?", "valor": "¿qué valor?", "lugar": "¿en qué calles?", "objetos": "¿objetos robados?"}
    frame = spark.createDataFrame([(i, questions[k], a, c, s) for i, (k, a, c, s, _, _) in enumerate(cases)], "i int, question string, answer_text string, context string, qc_status string")
    for exact in (False, True):
        got = semantics.heuristics(frame, exact=exact).orderBy("i").collect()
        assert [(r["question_kind"], r["semantic_score"], r["semantic_flag_v1"]) for r in got] == [(k, n, old) for k, _, _, _, n, old in cases]
        assert all(r["semantic_heuristic_flag"] == (r["semantic_score"] >= 1) for r in got)
    # The audit keeps accents: a marker without an unaccented twin is found by it alone.
    one = spark.createDataFrame([("¿hora?", "10:30", "observó 10:30", "extractive_valid_unique")], "question string, answer_text string, context string, qc_status string")
    r = semantics.audit_flag(semantics.heuristics(one)).head()
    assert (r["semantic_score"], r["audit_flag"]) == (0, True)
    assert one.select(semantics.question_kind(F.lit("¿en qué calles?")), semantics.question_kind(F.lit("¿en qué calles?"), old=True)).head()[:] == ("lugar", "otro")


def test_sets_are_nested(spark, sf_dir):
    rows = datasets.curated(X.judged(spark, sf_dir))
    assert rows.where("in_strict AND NOT in_expanded").count() == 0
    assert rows.where("in_uncertain = (in_strict OR in_expanded)").count() == 0


def test_agreement_classes_add_up(spark, sf_dir):
    rows = X.judged(spark, sf_dir)
    pairs = agreement.agreement(rows.where("model = 'a'"), rows.where("model = 'b'"))
    r = agreement.agreement_rates(pairs).head()
    assert r["n_pairs"] == pairs.count() and abs(r["answerability_agreement"] + r["disagreement"] - 1) < 1e-12
    legacy = agreement.merged(rows.where("model = 'a'"), rows.where("model = 'b'"), legacy=True)
    assert legacy.count() >= agreement.merged(rows.where("model = 'a'"), rows.where("model = 'b'")).count()


def test_null_keys_meet(spark):
    a = spark.createDataFrame([(None, "q", "x")], "context_id string, question string, v string")
    assert agreement.paired(a, a, ("v",)).count() == 1


def test_splits(spark):
    ids = spark.createDataFrame([(f"context_{i}",) for i in range(205)] * 2, "context_id string")
    for shares in ((0.8, 0.1, 0.1), (0.5, 0.25, 0.25), (1.0, 0.0, 0.0)):
        got = {r[0]: r[1] for r in datasets.split_by_key(ids, "context_id", *shares).collect()}
        sizes = [list(got.values()).count(s) for s in ("train", "validation", "test")]
        assert len(got) == 205 and sizes[1:] == [round(205 * s) for s in shares[1:]]
        assert got == {r[0]: r[1] for r in datasets.split_by_key(ids, "context_id", *shares).collect()}
    with pytest.raises(ValueError):
        datasets.split_by_key(ids, "context_id", 0.8, 0.1, 0.2)
    assert datasets.split_by_key(ids, "context_id", limit=7).count() == 7
    exact = datasets.exact_split(["b", "a", "c"], 0.34, 0.33, 0.33, 42)
    order = sorted("abc")
    random.Random(42).shuffle(order)
    assert exact == {order[0]: "test", order[1]: "validation", order[2]: "train"}
    assert datasets.exact_sample(100, 5, 42) == sorted(random.Random(42).sample(range(100), 5))


def test_metrics_at_thresholds(spark):
    rng = random.Random(5)
    refs, preds, plain = [], [], []
    for i in range(120):
        imp = rng.random() < 0.3
        golds = [] if imp else [rng.choice(["a b", "b c d", "e"]) for _ in range(rng.randint(0, 2))]
        text, score = rng.choice(["", "a b", "b, C", "e"]), rng.choice([-1.0, 0.0, 0.5, float("-inf"), float("inf"), 2.0])
        refs.append((str(i), "c", "q", imp, (golds, [0] * len(golds)), "c"))
        preds.append((str(i), text, score))
        plain.append((imp, golds, text, score))

    def one(imp, golds, text):
        from test_text import f1, plain_answer

        if imp or text == "":
            return (1.0, 1.0) if imp and text == "" else (0.0, 0.0)
        p = plain_answer(text)
        return float(any(p == plain_answer(g) for g in golds)), max([f1(p, plain_answer(g)) for g in golds], default=0.0)

    def at(th):
        rows = [one(imp, golds, "" if score > th else text) for imp, golds, text, score in plain]
        return sum(r[0] for r in rows) / len(rows), sum(r[1] for r in rows) / len(rows)

    scored = metrics.scored(spark.createDataFrame(preds, "id string, prediction_text string, no_answer_probability double"), spark.createDataFrame(refs, SQUAD)).cache()
    for th in (0.0, 0.5):
        r = metrics.summary(metrics.at_threshold(scored, th)).head()
        assert abs(r["exact"] - at(th)[0]) < 1e-12 and abs(r["f1"] - at(th)[1]) < 1e-12 and r["has_ans_total"] + r["no_ans_total"] == 120
    swept = {r["threshold"]: (r["exact"], r["f1"]) for r in metrics.sweep(scored).collect()}
    ths = [float("-inf"), *sorted({s for *_, s in plain} - {float("-inf"), float("inf")}), float("inf")]
    assert sorted(swept) == ths and all(abs(swept[t][k] - at(t)[k]) < 1e-12 for t in ths for k in (0, 1))
    best = metrics.best_thresholds(scored).head()
    for k, name in ((0, "exact"), (1, "f1")):
        value = max(at(t)[k] for t in ths)
        first = next(t for t in ths if at(t)[k] > value - 1e-12)
        assert abs(best[f"best_{name}"] - value) < 1e-12 and best[f"best_{name}_thresh"] == first
    with pytest.raises(Exception, match="no reference"):
        metrics.squad_metrics(spark.createDataFrame([("zz", "a", 0.0)], "id string, prediction_text string, no_answer_probability double"), spark.createDataFrame(refs, SQUAD)).collect()


def test_plateau(spark):
    frame = spark.createDataFrame([(float(e), f) for e, f in enumerate([0.5, 0.7, 0.74, 0.6, 0.75, 0.75], 1)] + [(7.0, None)], "epoch double, eval_f1 double")
    got = metrics.plateau(frame, 0.02, 2).orderBy("epoch").collect()
    assert [r["epoch"] for r in got if r["is_plateau"]] == [3.0] and [r["epoch"] for r in got if r["is_best"]] == [5.0] and len(got) == 6


def naive_decode(features, contexts, n_best, longest):
    out = {}
    for ex, context in contexts.items():
        best, null = None, math.inf
        for f in sorted((f for f in features if f[0] == ex), key=lambda f: f[1]):
            _, w, offsets, s, e = f
            null = min(null, s[0] + e[0])
            top = lambda x: sorted(range(len(x)), key=lambda i: (-x[i], i))[:n_best]
            for i in top(s):
                for j in top(e):
                    if j < i or j - i >= longest or offsets[i] == (0, 0) or offsets[j] == (0, 0) or offsets[i][1] <= offsets[i][0]:
                        continue
                    text = context[offsets[i][0] : offsets[j][1]]
                    if text.strip() and (best is None or (s[i] + e[j], -w, -i, -j) > best[0]):
                        best = ((s[i] + e[j], -w, -i, -j), text)
        out[ex] = (best[1], null - best[0][0]) if best else ("", math.inf)
    return out


def test_decoding(spark):
    rng = random.Random(9)
    contexts = {f"e{k}": "".join(rng.choice("ab 🎉") for _ in range(60)) for k in range(12)}
    features = []
    for ex in list(contexts)[:-1]:
        for w in range(rng.randint(1, 3)):
            offsets = [(0, 0) if rng.random() < 0.2 else (k * 3, k * 3 + rng.randint(0, 3)) for k in range(20)]
            features.append((ex, w, offsets, [float(rng.randint(-5, 5)) for _ in range(20)], [float(rng.randint(-5, 5)) for _ in range(20)]))
    frame = spark.createDataFrame(features, "example_id string, window int, offsets array<struct<b:int,e:int>>, start_logits array<double>, end_logits array<double>")
    examples = spark.createDataFrame(list(contexts.items()), "id string, context string")
    for n, longest in ((20, 100), (4, 3)):
        got = {r["id"]: (r["prediction_text"], r["no_answer_probability"]) for r in decode.decode(frame, examples, n, longest).collect()}
        assert got == naive_decode(features, contexts, n, longest)


def test_windows_and_labels(spark):
    for n in (0, 1, 383, 384, 385, 640, 641, 1000):
        frame = spark.createDataFrame([(" ".join(map(str, range(n))),)], "context string")
        got = decode.token_windows(frame).orderBy("window").collect()
        covered = {t for r in got for t in r["tokens"]}
        assert len(covered) == n and len(got) == max(1, math.ceil((n - 128) / 256)) and all(len(r["tokens"]) <= 384 for r in got)
    offsets = F.array(*[F.struct(F.lit(b).alias("b"), F.lit(e).alias("e")) for b, e in ((0, 0), (0, 4), (5, 9), (10, 14), (0, 0))])
    at = lambda a, b: tuple(spark.range(1).select(decode.span_tokens(offsets, F.lit(a), F.lit(b))).head()[0])
    assert [at(5, 9), at(0, 14), at(6, 12), at(5, 20), at(3, 3)] == [(2, 2), (1, 3), (2, 3), (0, 0), (0, 0)]
    with pytest.raises(ValueError):
        decode.windows(F.array(), 10, 10)


def test_statistics(spark):
    r = spark.range(1).select(stats.wilson_low(F.lit(57), F.lit(100)), stats.wilson_high(F.lit(57), F.lit(100)), stats.wilson_low(F.lit(0), F.lit(0))).head()
    assert abs(r[0] - 0.472) < 1e-3 and abs(r[1] - 0.6627) < 1e-3 and r[2] is None
    assert abs(stats.normal_two_sided(1.96) - 0.05) < 1e-4
    assert abs(stats.chi_square_p(3.841459, 1) - 0.05) < 1e-6 and abs(stats.chi_square_p(5.991465, 2) - 0.05) < 1e-6 and abs(stats.chi_square_p(1.0, 4) - 0.909796) < 1e-6
    assert stats.sample_size(0.05) == 385 and stats.sample_size(0.03) == 1068 and abs(stats.worst_margin(200) - 0.0693) < 1e-4
    rows = spark.createDataFrame([("a", 1)] * 10 + [("a", 0)] * 20 + [("b", 1)] * 30 + [("b", 0)] * 10, "m string, c int")
    got = stats.chi_square(rows, "m", "c").head()
    assert got["dof"] == 1 and abs(got["chi2"] - 10.5109) < 1e-3
    assert abs(stats.two_proportion_z(rows, "m", "c", "a", "b").head()["z"] + 3.4861) < 1e-3
    none = stats.confusion(rows.withColumn("f", F.lit(False)), ["m"], "f", "c").head()
    assert none["precision"] is None and none["f1"] is None


def test_reports(spark):
    latex = reports.latex(spark.createDataFrame([("a_b", 1.23456, None)], "m string, v double, n string"), "C", "l")
    assert r"a\_b & 1.23 &  \\" in latex and r"\label{l}" in latex
    with pytest.raises(ValueError):
        reports.latex(spark.range(10), "C", "l", most=5)
    assert spark.range(1).select(reports.hms(F.lit(37249))).head()[0] == "10:20:49"
    assert reports.benchmark_summary(spark.createDataFrame([("m", False, 1.0)], "model string, ok boolean, elapsed_s double")).head()["avg_context_time_s"] is None
    plan = reports.plan(spark, ["a", "b"], ["d"], ["x", "y"], 3).collect()
    assert [r["slot"] for r in plan] == [0, 1, 2, 0]


def test_chi_square_with_cells_that_have_no_rows(spark):
    rng = random.Random(8)
    for a, b, n in ((2, 2, 40), (2, 2, 5), (5, 4, 30), (1, 3, 9), (9, 2, 200)):
        rows = [(rng.choice([None, *range(a - 1)]), rng.choice([None, *range(b - 1)])) for _ in range(n)]
        r, c = {x for x, _ in rows}, {y for _, y in rows}
        dof, chi2 = (len(r) - 1) * (len(c) - 1), 0.0
        for x in r:
            for y in c:
                want = sum(i == x for i, _ in rows) * sum(j == y for _, j in rows) / n
                apart = abs(rows.count((x, y)) - want)
                chi2 += (apart - min(0.5, apart) * (dof == 1)) ** 2 / want
        frame = stats.chi_square(spark.createDataFrame(rows, "m int, c int"), "m", "c")
        got = frame.head()
        assert got.dof == dof and abs(got.chi2 - chi2) < 1e-9
    assert stats.chi_square(spark.createDataFrame([], "m int, c int"), "m", "c").count() == 0
