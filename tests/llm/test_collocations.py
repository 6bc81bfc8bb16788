"""Phrases against brute force."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanqc.llm import collocations as C

SCHEMA = "doc_id long, text string, lang string"


def brute(rows, most_words=3, least=10, held=50, best=2000):
    counts = defaultdict(Counter)
    for _, text, lang in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            counts[lang or "und" if lang is None else lang].update(tuple(words[i : i + k]) for k in range(1, most_words + 1) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in candidates.items():
            if any(100 * b >= held * a for q, b in candidates.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))):
                continue
            score, k = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), p[:k], p[k:]))
        n = sum(a for p, a in f.items() if len(p) == 1)
        out += [(lang, rank, phrase.decode(), -a, f[head], f[tail], n, -score) for rank, (score, a, phrase, head, tail) in enumerate(sorted(kept)[:best], 1)]
    return sorted(out)


def sample(seed, rows=250):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)] + ["É", "été", "日本", "w1" * 40, "\x00", "\xa0"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    common = ["New York City", "new york", "the UNITED states of america", "a.b c,d e\tf  g"]
    texts = []
    for i in range(rows):
        words = rng.choices(vocabulary, weights, k=rng.randint(0, 60))
        for _ in range(rng.randint(0, 4)):
            words.insert(rng.randrange(len(words) + 1), rng.choice(common))
        texts.append((i, "".join(w + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "; "]) for w in words), rng.choice(["en", "en", "de", None, "und", ""])))
    texts += [(None, None, "en"), (1, "", None), (2, " \t ", "xx"), (3, "...", "en"), *texts[:20]]
    return texts + [(9, "again and again " * 3000, "long")]


@pytest.mark.parametrize(("most_words", "least", "held", "best"), [(3, 10, 50, 2000), (2, 5, 50, 7), (4, 6, 80, 30), (5, 3, 30, 2000)])
def test_by_brute_force(spark, monkeypatch, most_words, least, held, best):
    monkeypatch.setattr(C, "SLICE", 500)
    monkeypatch.setattr(C, "COUNTED", 300)
    rows = sample(most_words)
    frame = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("id", "a", "n", "c0", "phrase", "word")}).repartition(3)
    got = sorted(tuple(r) for r in C.collocations(frame, most_words, least, held, best).collect())
    assert got == brute(rows, most_words, least, held, best)


def test_words_of_one_name_get_others(spark, monkeypatch):
    """Names that are first much too short, so that many are equal."""
    tried, plain = [], C.mixed

    def short(texts, seed):
        tried.append(seed)
        return counted(texts, seed).withColumn("id", F.col("id") % 50 if seed < 2 else F.col("id"))

    counted = C.counted_words
    monkeypatch.setattr(C, "counted_words", short)
    rows = sample(1, 60)
    assert sorted(tuple(r) for r in C.collocations(spark.createDataFrame(rows, SCHEMA)).collect()) == brute(rows)
    assert tried == [0, 1, 2] and plain is C.mixed


def test_no_rows(spark):
    assert C.collocations(spark.createDataFrame([], SCHEMA)).collect() == []
    assert C.collocations(spark.createDataFrame([(1, None, "en"), (2, "once only", None)], SCHEMA)).collect() == []


@pytest.mark.parametrize("bits", [1 << 8, 1 << 30])
def test_a_full_filter_loses_nothing(spark, monkeypatch, bits):
    monkeypatch.setattr(C, "BITS", bits)
    monkeypatch.setattr(C, "SEGMENT", 1 << 6)
    rows = sample(7, 120)
    assert sorted(tuple(r) for r in C.collocations(spark.createDataFrame(rows, SCHEMA), least=4).collect()) == brute(rows, least=4)


def test_scores_beyond_64_bits(spark):
    a = 4_000_000_000_000
    level = spark.createDataFrame([(a, [5 * a, a], [7 * a, a])], "a long, heads array<long>, tails array<long>")
    assert tuple(level.select(C.weakest_cut(2).alias("cut")).select("cut.*").head()) == (1_000_000 * a * a // (35 * a * a), 1, 5 * a, 7 * a)


def test_names_of_words_alone(spark):
    import pyarrow as pa

    batch = pa.record_batch({"lang": ["a", "b", "a"], "text": pa.array([b"One two. one", b"one", b"one\xc3\xa9  two"], pa.binary())})
    (words, _), = C.words_of(iter([batch]), 0)
    one, two, again, other, *rest = words.ids.tolist()
    assert one == again != other and two == rest[1] and rest[0] not in (one, two, other)
    assert words.joined.tolist() == [True, False, False, False, True, False] and np.array(words.row).tolist() == [0, 0, 0, 1, 2, 2]
