from __future__ import annotations

import difflib
import random
import re
import string
from collections import Counter

from pyspark.sql import functions as F

from spanqc.functions import text as T
from spanqc.functions.matching import automaton, similarity_of


def rows(spark, values, *columns, schema="i long, x string"):
    frame = spark.createDataFrame(list(enumerate(values)), schema)
    return [tuple(r)[1:] for r in frame.select("i", *columns).orderBy("i").collect()]


TEXTS = [None, "", "  ", " a b\t", "El  Niño,  comió .", "“Hola” ‘tú’", "ﬁn ½", "él", "🎉 a a", "ÁÉÍ ñ ¿Qué?", "a\n\nb ;c"]


def test_exact_normal_form(spark):
    assert [r[0] for r in rows(spark, TEXTS, T.normalize_exact("x"))] == [T.normal_form(t) for t in TEXTS]
    assert T.normal_form("  “Él”  comió , ﬁn ") == '"el" comio, fin'


def test_fast_normal_form_agrees_on_precomposed_latin(spark):
    plain = [t for t in TEXTS if t is None or not re.search("[ﬁ½́]", t)]
    assert [r[0] for r in rows(spark, plain, T.normalize_fast("x"))] == [T.normal_form(t) for t in plain]


def test_words_strip_collapse(spark):
    got = rows(spark, TEXTS, T.word_count("x"), T.strip(T.or_empty("x")), T.collapse("x"))
    for t, (n, stripped, low) in zip(TEXTS, got, strict=True):
        t = t or ""
        assert (n, stripped, low) == (len(t.split()), t.strip(), re.sub(r"\s+", " ", t.lower()).strip())


def test_bool_spellings(spark):
    assert [r[0] for r in rows(spark, ["TRUE", " yes ", "1", "no", None, "0"], T.as_bool("x"))] == [True, True, True, False, False, False]


def overlapping(h, n):
    return sum(h.startswith(n, i) for i in range(len(h))) if n else 0


def test_counts_of_occurrences(spark):
    pairs = [("aaaa.", "aa"), ("a.b.a", "."), (r"x\Ex\E", r"\E"), ("", "a"), ("abc", ""), ("🎉🎉🎉", "🎉🎉"), ("a$a$a", "a$a"), (None, "a"), ("a", None)]
    frame = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i long, h string, n string")
    got = [r[0] for r in frame.orderBy("i").select(T.count_overlapping("h", "n")).collect()]
    assert got == [overlapping(h or "", n or "") for h, n in pairs]


def test_find_and_hints(spark):
    pairs = [("hola mi nombre es juancarlos", "juan", 18), ("a🎉b", "b", 2), ("abc", " ", -1), ("abc", None, -1), ("abc", "x", -1), (None, "x", -1)]
    frame = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i long, h string, n string, w int")
    assert all(r[0] == r[1] for r in frame.select(T.find("h", "n"), "w").collect())
    assert rows(spark, ["grave led aa aaa"], T.count_hits("x", ["av", "aa", "zz"]), T.any_hint("x", ["led"]), T.any_hint("x", [])) == [(3, True, False)]


def plain_answer(t):
    return "".join(c for c in (t or "").lower() if c not in string.punctuation).split()


def f1(p, g):
    common = sum((Counter(p) & Counter(g)).values())
    return 2 * common / (len(p) + len(g)) if p and g and common else 0.0


def test_token_f1(spark):
    rng = random.Random(1)
    words = ["a", "b", "a.", "É", "¿x", "c-d", ""]
    pairs = [(" ".join(rng.choices(words, k=rng.randint(0, 6))), " ".join(rng.choices(words, k=rng.randint(0, 6)))) for _ in range(200)]
    frame = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i long, p string, g string")
    got = frame.orderBy("i").select(T.token_f1(T.tokens("p"), T.tokens("g")), T.exact_match(T.tokens("p"), T.tokens("g"))).collect()
    for (p, g), r in zip(pairs, got, strict=True):
        assert abs(r[0] - f1(plain_answer(p), plain_answer(g))) < 1e-12
        assert r[1] == int(plain_answer(p) == plain_answer(g))


def test_similarity(spark):
    pairs = [("", ""), (None, None), ("a", ""), ("juan carlos", "juan"), ("abcd", "dcba")]
    frame = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i long, a string, b string")
    got = [r[0] for r in frame.orderBy("i").select(T.similarity("a", "b")).collect()]
    assert got == [1.0 if not a and not b else difflib.SequenceMatcher(None, a or "", b or "").ratio() for a, b in pairs]


def test_similarity_of_many_pairs():
    rng = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789é😀 "
    for n in [*range(40)] * 8 + [199, 200, 201, 350, 700] * 8:  # beyond 199 characters common ones begin no match
        few = letters[: rng.choice([1, 2, 3, 9, len(letters)])]
        a = "".join(rng.choices(few, k=n))
        b = [*a] if rng.random() < 0.6 else rng.choices(few, k=rng.choice([0, n, n + 60]))
        for _ in range(rng.randint(0, 8)):
            at = rng.randint(0, len(b))
            b[at : at + rng.randint(0, 3)] = rng.choices(few, k=rng.randint(0, 3))
        b = "".join(b)
        assert similarity_of(a, b) == (difflib.SequenceMatcher(None, a, b).ratio() if a or b else 1.0)


def test_similarity_of_long_texts_takes_linear_states():
    rng = random.Random(4)
    for n in (2_000, 20_000):
        a, b = ("".join(rng.choices([chr(0x4E00 + k) for k in range(150)], k=n)) for _ in range(2))
        assert len(automaton(b, 0, n, frozenset())[0]) <= 2 * n
    assert similarity_of("a" * 100_000 + "b", "a" * 150 + "c") == 300 / 100_152  # as many comparisons as places would be 15 million


def test_json_answers(spark):
    good = '{"answer_text": "x", "is_impossible": "respondido"}'
    texts = [good, f"```json\n{good}\n```", f"bla {good} bla", '{"answer_text": "x', "", None, "[1]"]
    got = rows(spark, texts, T.parse_answer("x")["answer_text"], T.parse_answer("x")["is_impossible"])
    assert got == [("x", "respondido")] * 3 + [("RESPUESTA_NO_ENCONTRADA", "imposible")] * 4


def test_bleu(spark):
    frame = spark.createDataFrame([("a b c", "a b c"), ("a b", "a c"), ("", ""), (None, "a")], "p string, g string")
    assert [r[0] for r in frame.select(T.google_bleu("p", "g")).collect()] == [1.0, 1 / 3, 0.0, 0.0]


def test_small_helpers(spark):
    got = rows(spark, ["x 3/9 [1:02:03< 7/9 [0:00:09<", "none"], T.last_match("x", r"(\d+)/(\d+)", 1), T.window_around("x", F.lit(2), F.lit(1), 1), T.slice_of("x", F.lit(3), F.lit(1)), T.starts_at("x", F.lit("x"), F.lit(0)))
    assert got == [("7", " 3/", "", True), (None, "one", "", False)]
    assert rows(spark, ["a b/" + "c" * 200], F.length(T.sanitized("x")), T.path_part("x", 2)) == [(96, "a b")]
