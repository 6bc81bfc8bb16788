"""The operators on small tables against brute force, with nulls, ties, repeats, empty tables and clashing names."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import public_tokenizers
import sentencepiece
import xxhash
from pyspark.sql import functions as F

from spanqc.llm import bm25, chat, common, components, decontamination, fm_index, language_id, mixing, near_dedup, quality, simhash_kernel, token_counts, url_filter, warc
from spanqc.sources.shared import shared_path

MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "\n\t", "a", "A", "é", "日本 🎉", "x" * 3000, "the " * 900, "one two three", "One, two!\nthree", "12 34", "a\u00a0b", "<s> </s> ▁▁a", "tail  "]


def documents(spark, rows, schema="doc_id long, text string, lang string, source string, n_chars long"):
    return spark.createDataFrame(rows, schema)


def odd_documents(spark):
    rows = [(i, t, ["en", None][i % 2], ["s", None, ""][i % 3], None if i % 4 == 0 else len(t or "")) for i, t in enumerate(ODD)]
    rows += [rows[10], (None, "one two three", "en", "s", 3), (None, None, None, None, None)]
    # Names that the operators' results have too, and that they use inside.
    return documents(spark, rows).withColumns({c: F.lit(7) for c in ("n_tokens", "score", "held_out", "id", "node", "rank", "size", "target", "block", "__text", "n_words", "items", "fingerprint", "lang_pred", "predicted")})


# Token counts.


def test_token_counts_are_the_librarys(spark):
    rng = random.Random(2)
    alphabet = list("aehtn  \n▁<s>é日🎉\x00.,1")
    texts = ODD + ["".join(rng.choices(alphabet, k=rng.randint(0, 60))) for _ in range(800)] + ["ab" * 4000, " " * 3000]
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    frame = documents(spark, [(i, t, None, None, None) for i, t in enumerate(texts)])
    got = {r["doc_id"]: r for r in token_counts.token_counts(frame, MODEL).collect()}
    for i, t in enumerate(texts):
        n = len(library.encode(t or ""))
        assert (got[i]["n_tokens"], got[i]["n_bytes"], got[i]["over_limit"]) == (n, len((t or "").encode()), n > 4096)


def test_token_counts_edges(spark):
    frame = odd_documents(spark)
    out = token_counts.token_counts(frame, MODEL)
    assert out.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"] and out.count() == frame.count()
    assert token_counts.token_counts(frame.where("false"), MODEL).collect() == []


# Chat.


def conversations(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_snapshots_collapse(spark):
    rng = random.Random(4)
    logs, rows = {}, []
    for c in range(120):
        base = logs[rng.choice(list(logs))] if logs and rng.random() < 0.6 else []
        turns = base[: rng.randint(0, len(base))] + [(rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "", None])) for _ in range(rng.randint(1, 2))]
        logs[c] = turns
        first = rng.randint(0, 5)
        rows += [(c, first + 2 * k, *t) for k, t in enumerate(turns)]
    rng.shuffle(rows)
    want = {c: t for c, t in logs.items() if not any(len(o) > len(t) and o[: len(t)] == t for o in logs.values())}
    got = {r["conv_id"]: r for r in chat.render(conversations(spark, rows)).collect()}
    assert set(got) == set(want)
    for c, turns in want.items():
        assert got[c]["n_turns"] == len(turns)
        assert got[c]["rendered"] == "".join(f"<|im_start|>{r or ''}\n{t or ''}<|im_end|>\n" for r, t in turns)


def test_chat_rows_without_an_id(spark):
    """They are conversations of one turn, dealt to many tasks, and collapse like any other."""
    rows = [(None, k % 7, "u", f"t{k % 300}") for k in range(50_000)] + [(1, 0, "u", "t5"), (1, 1, "a", "x"), (2, 0, "u", "t6")]
    out = chat.render(conversations(spark, rows).repartition(4))
    got = out.groupBy("conv_id").count().rdd.collectAsMap()
    lost = sum(t == "t5" for c, _, _, t in rows if c is None)
    assert got == {None: 50_000 - lost, 1: 1, 2: 1}
    assert {tuple(r) for r in out.where("conv_id IS NULL").select("n_turns", "rendered").distinct().collect()} == {(1, f"<|im_start|>u\nt{k}<|im_end|>\n") for k in range(300) if k != 5}


def test_chat_edges(spark):
    rows = [(1, 0, "u", "a"), (1, 0, "u", "a"), (2, 0, "u", "a"), (None, None, "u", "z"), (None, 1, None, None), (3, 0, "u", "b"), (4, 0, "u", "b")]
    frame = conversations(spark, rows).withColumns({c: F.lit(1) for c in ("place", "h0", "more", "conv", "c", "n_turns", "rendered", "digest")})
    got = sorted(((r["conv_id"], r["n_turns"]) for r in chat.render(frame).collect()), key=str)
    assert got == [(1, 2), (3, 1), (4, 1), (None, 1), (None, 1)]  # equal conversations both stay; a repeated row is a turn; without an id each row stands alone
    assert chat.render(frame.where("false")).collect() == []


# Language.


def test_segmentations_are_all_summed():
    pieces = {"a": 1, "b": 2, "ab": 3, "▁": 4, "▁a": 5, "ba": 6, "aba": 7}
    chance = np.random.default_rng(1).random((8, 3)) / 4

    def every(word):
        if not word:
            return np.ones(3)
        return sum(chance[pieces.get(word[:k], 0)] * every(word[k:]) for k in range(1, min(3, len(word)) + 1) if word[:k] in pieces or k == 1)

    words = ["a", "ab", "abab", "babba", "xax"]
    lattice = language_id.Lattice(words, language_id.Pieces(pieces))
    assert np.allclose(lattice.whole(lattice.forward(chance)), [every("▁" + w) for w in words])
    # Expected counts weighted by piece length cover every character of every word once.
    counts = np.ones((len(words), 3))
    use = lattice.expected(chance, counts)
    size = np.array([1, 1, 1, 2, 1, 2, 2, 3])
    assert np.allclose((use * size[:, None]).sum(axis=0), sum(len(w) + 1 for w in words))


def test_lattices_hold_every_piece():
    numbers = language_id.vocabulary(MODEL)
    pieces, rng = language_id.tree(MODEL), random.Random(8)
    words = ["", "a", "straße", "été", "日本", "\U0001d4b3x", "wood" * 9] + ["".join(rng.choices("etaoinshré日ß", k=rng.randint(1, 14))) for _ in range(300)]
    lattice = language_id.Lattice(words, pieces)
    got = sorted(zip(*(x.tolist() for x in (lattice.row, lattice.start, lattice.end, lattice.number)), strict=True))
    marked = ["▁" + w for w in words]
    want = [(k, s, e, numbers.get(w[s:e], 0)) for k, w in enumerate(marked) for s in range(len(w)) for e in range(s + 1, len(w) + 1) if w[s:e] in numbers or e == s + 1]
    assert got == sorted(want) and (np.diff(lattice.end) >= 0).all()


def test_scorer_of_long_and_short_words_agree():
    model = language_id.Model.learn({"x": {"hello": 3, "hell": 1}, "y": {"allez": 2, "alle": 5}}, MODEL)
    scorer = language_id.Scorer(model)
    words = ["hello", "allez", "zzz"]
    totals, lettered = scorer.totals(words + [None, "12"])
    assert np.allclose(totals[:3], [scorer.alone(w) for w in words]) and lettered.tolist() == [True] * 3 + [False] * 2
    names, shares = scorer.best(["hello", "alle allez", "", "a" * 500])
    assert names[:3] == ["x", "y", "und"] and shares[2] == 0.0 and all(0 <= s <= 1 for s in shares)


def test_language_of_held_out_texts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = language_id.identify(docs, MODEL, keep=("lang",)).collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == docs.count() and len(held) > 20
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) >= 0.97
    # Labels of held-out rows aren't learned from, and no row's own label is an input.
    other = docs.withColumn("lang", F.when(language_id.held_out("doc_id"), F.lit("xx")).otherwise(F.col("lang")))
    again = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identify(other, MODEL).collect()}
    assert again == {r["doc_id"]: (r["lang_pred"], r["score"]) for r in rows}


def test_language_edges(spark):
    frame = odd_documents(spark)
    rows = language_id.identify(frame, MODEL).collect()
    assert len(rows) == frame.count()
    und = {r["doc_id"] for r in rows if r["lang_pred"] == "und"}
    assert und >= {0, 1, 2, 3, 12} and 4 not in und
    assert language_id.identify(frame.where("false"), MODEL).collect() == []
    unlabelled = language_id.identify(frame.withColumn("lang", F.lit(None).cast("string")), MODEL).collect()
    assert {r["lang_pred"] for r in unlabelled} == {"und"} and {r["score"] for r in unlabelled} == {0.0}


def test_draws_are_bounded_and_tell_repeats_apart(spark):
    rng = random.Random(5)
    rows = [("a", str(i)) for i in range(5000)] + [("b", "same")] * 5000 + [("b", f"{i % 3}") for i in range(3)] + [("c", "few")] * 7 + [(None, "no")] * 50
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "kind string, text string")
    found, sizes = common.drawn(frame, "kind", ("text",), 100)
    got = found.groupBy("kind").count().rdd.collectAsMap()
    assert sizes == {"a": 5000, "b": 5003, "c": 7} and got["b"] == 100 and got["c"] == 7 and 100 <= got["a"] <= 400
    again, _ = common.drawn(frame.repartition(7), "kind", ("text",), 100)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, found.collect()))
    heavy, _ = common.drawn(frame, "kind", ("text",), 100, F.lit(10.0), 50.0)
    assert 5 <= heavy.where("kind = 'a'").count() < 30
    with pytest.raises(ValueError, match="more than 2 values"):
        common.drawn(frame, "kind", ("text",), 100, keys=2)


def test_languages_of_long_texts_and_of_repeats_are_learned(spark):
    """Neither a text's length nor that rows are equal keeps a language from being learned."""
    words = {"x": "hello world again and over there the thing", "y": "allez bonjour toujours merci encore une fois la chose", "z": "guten morgen wieder und noch einmal das ding"}
    rows = [(k, (words["x"] + " ") * 4000, "x", None, None) for k in range(30)] + [(1000, words["y"], "y", None, None)] * 40_000 + [(2000 + k, words["z"], "z", None, None) for k in range(8)]
    assert len(rows[0][1]) > 160_000
    asked = [(5000, "hello there again", None, None, None), (5001, "merci toujours une fois", None, None, None), (5002, "wieder das ding", None, None, None)]
    frame = documents(spark, rows + asked).repartition(4)
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(frame, MODEL).where("doc_id >= 5000").collect()}
    assert got == {5000: "x", 5001: "y", 5002: "z"}


def test_all_words_are_learned_from(spark):
    """Sums on executors are those of all words at once, rare and long ones too, however rows are dealt."""
    long = "supercalifragilistic" * 7
    texts = [("x", f"aa aa aa bb bb cc {long} ÉTÉ"), ("x", "aa"), ("y", "dd"), ("y", None), (None, "zz")]
    frame = documents(spark, [(k, t, lang, None, None) for k, (lang, t) in enumerate(texts)])
    want = language_id.Model.learn({"x": {"aa": 4, "bb": 2, "cc": 1, long: 1, "été": 1}, "y": {"dd": 1}}, MODEL)
    for parts in (1, 5):
        got = language_id.learn(frame.repartition(parts), MODEL, "doc_id", "text", "lang", F.lit(True))
        assert got.languages == want.languages and (got.chance == want.chance).all()
    assert sum(want.uses("x", language_id.stretches(long), np.ones(4)) > 0) > 0 and language_id.stretches(long) == ["▁" + long[:40], long[40:80], long[80:120], long[120:]]


def test_languages_of_long_words_alone(spark):
    """All labelled words are long; and a language without blanks beside one with blanks."""
    rng = random.Random(4)
    word = lambda letters, n: "".join(rng.choices(letters, k=n))
    for other, own in (("aeinrst", 60), ("日本語学校東京大", 300)):
        rows = [(k, " ".join(word("bcdfgklmop", 55 if own == 60 else 6) for _ in range(9)), "p", None, None) for k in range(60)]
        rows += [(100 + k, word(other, own), "q", None, None) for k in range(60)]
        got = language_id.identify(documents(spark, rows).repartition(3), MODEL).collect()
        assert {(r["doc_id"] < 100, r["lang_pred"]) for r in got} == {(True, "p"), (False, "q")}


def test_repeats_are_drawn_in_many_tasks(spark):
    """One row a hundred thousand times: no stage but the last limit brings its rows together, and that at most the wanted number of each partition."""
    frame = spark.range(100_000, numPartitions=8).select(F.lit("a").alias("kind"), F.when(F.col("id") % 9973 == 0, F.col("id").cast("string")).otherwise("same").alias("text"))
    found, _ = common.drawn(frame, "kind", ("text",), 50)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 50 and "Window" not in plan and "Sort" not in plan


# Near-duplicates.


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def smallest_reachable(ids, prints, radius=4, links=None):
    parent = list(range(len(ids)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    near = ((i, j) for i in range(len(ids)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= radius) if links is None else links
    for i, j in near:
        parent[root(i)] = root(j)
    least = {}
    for i, x in enumerate(ids):
        if x is not None:
            least[root(i)] = min(least.get(root(i), x), x)
    return [least.get(root(i)) for i in range(len(ids))]


def test_near_duplicates_by_brute_force(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    texts = [(r["doc_id"], r["text"]) for r in rows] + [(10_000 + i, t) for i, t in enumerate(ODD)] + [(None, ODD[10]), (None, "alone here now"), (rows[0]["doc_id"], rows[0]["text"])]
    prints = [fingerprint(t) for _, t in texts]
    want = sorted((str(i), f"{p:016x}", str(c)) for (i, _), p, c in zip(texts, prints, smallest_reachable([i for i, _ in texts], prints), strict=True))
    frame = spark.createDataFrame(texts, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("id", "node", "least", "root", "component_id")})
    out = near_dedup.near_duplicates(frame)
    assert out.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted((str(r[0]), r[1], str(r[2])) for r in out.collect()) == want
    assert near_dedup.near_duplicates(frame.where("false")).collect() == []


@pytest.mark.parametrize("crowded", [20, 10**6])
def test_dense_and_chained_fingerprints(spark, crowded):
    """A crowd around one fingerprint, chains of distance four, and chance ones; places are split or not."""
    rng = random.Random(8)
    flip = lambda x, n: x ^ sum(1 << b for b in rng.sample(range(64), n))
    centre = rng.getrandbits(64)
    prints = [flip(centre, rng.randint(0, 3)) for _ in range(150)]
    for _ in range(30):
        chain = [rng.getrandbits(64)]
        for _ in range(rng.randint(1, 6)):
            chain.append(flip(chain[-1], 4))
        prints += chain
    prints += [rng.getrandbits(64) for _ in range(200)]
    prints = sorted(set(prints))
    signed = [p - (p >> 63 << 64) for p in prints]
    nodes = spark.createDataFrame([(s,) for s in signed], "node long")
    links = near_dedup.near_links(nodes.select("node", *near_dedup.table_columns("node")), 4, crowded)
    found = {r["node"]: r["root"] for r in components.components(links).collect()}
    want = smallest_reachable(signed, prints)
    assert [found.get(s, s) for s in signed] == want


def test_components_of_random_graphs(spark):
    rng = random.Random(3)
    pairs = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(220)] + [(k, k + 1) for k in range(400, 440)] + [(500, k) for k in range(501, 560)] + [(7, 7)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert all(got.get(x, x) == root(x) for x in parent)
    assert components.components(spark.createDataFrame([], "u long, v long")).collect() == []


def distance_table(nodes):
    plain = np.bitwise_count(nodes[:, None] ^ near_dedup.PIVOTS).astype(np.uint8)
    return [np.ascontiguousarray(plain[:, k : k + 8]).view("<u8")[:, 0] for k in range(0, plain.shape[1], 8)]


def test_pivot_tables_are_made_once_for_each_node(spark):
    nodes = np.random.default_rng(6).integers(0, 2**64, 50, np.uint64)
    frame = spark.createDataFrame([(int(n),) for n in nodes.view(np.int64)], "node long").select("node", *near_dedup.table_columns("node"))
    rows = frame.collect()
    want = distance_table(np.array([r["node"] for r in rows], np.int64).view(np.uint64))
    assert [[r[c] for r in rows] for c in near_dedup.TABLE] == [w.view(np.int64).tolist() for w in want]
    for radius in (0, 4, 9):
        a, b = np.triu_indices(len(nodes), 1)
        plain = np.bitwise_count(nodes[:, None] ^ near_dedup.PIVOTS).astype(int)
        most = np.abs(plain[a] - plain[b])
        for k, column in enumerate(distance_table(nodes)):
            assert (near_dedup.coordinates_near(column[a], column[b], radius) == (most[:, 8 * k : 8 * k + 8].max(axis=1) <= radius)).all()


def test_a_crowded_place_takes_seconds():
    """Of 100,000 unrelated nodes that share a part of their bits, the tables leave few pairs to verify."""
    import time

    rng = np.random.default_rng(7)
    nodes = np.unique(rng.integers(0, 2**43, 100_000, np.uint64))
    nodes = np.unique(np.r_[nodes, nodes[:300] ^ np.uint64(0b1001)])
    began = time.process_time()
    a, b = near_dedup.forest(nodes, distance_table(nodes), 4)
    assert time.process_time() - began < 60
    near = np.bitwise_count(nodes[a] ^ nodes[b])
    assert len(a) >= 300 and near.max() <= 4
    pairs = set(zip(a.tolist(), b.tolist(), strict=True)) | set(zip(b.tolist(), a.tolist(), strict=True))
    few = nodes[:2000]
    x, y = np.triu_indices(len(few), 1)
    exact = np.bitwise_count(few[x] ^ few[y]) <= 4
    parent = smallest_reachable(list(range(len(nodes))), None, links=pairs)
    assert all(parent[i] == parent[j] for i, j in zip(x[exact].tolist(), y[exact].tolist(), strict=True))


def test_pivot_filter_keeps_all_near_pairs():
    nodes = np.random.default_rng(5).integers(0, 2**64, 300, np.uint64)
    near = nodes ^ np.uint64(0b1011)
    both = np.r_[nodes, near]
    table = distance_table(both)
    a, b = np.triu_indices(len(both), 1)
    exact = np.bitwise_count(both[a] ^ both[b]) <= 4
    assert (near_dedup.within(a, b, both, table, 4) == exact).all() and exact.sum() >= 300
    assert near_dedup.blocks_for(10, 4) == 6 < near_dedup.blocks_for(10**9, 4)


def test_long_texts_are_counted_in_blocks(monkeypatch):
    texts = [b"a b c d e f", None, b"", b"x", b"Q w e r t y " * 40]
    whole = simhash_kernel.fingerprints(texts)
    monkeypatch.setattr(simhash_kernel, "BLOCK", 3)
    assert (simhash_kernel.fingerprints(texts) == whole).all()
    assert [int(x) for x in whole] == [fingerprint(t.decode() if t is not None else None) for t in texts]


# Decontamination.


def words_of(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def contaminated(texts, items, width):
    windows = {}
    for name, text in items:
        w = words_of(text)
        for k in range(max(1, len(w) - width + 1) if w else 0):
            windows.setdefault(tuple(w[k : k + width]), set()).add(name)
    out = []
    for text in texts:
        w, names = words_of(text), set()
        hit = [False] * len(w)
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if found := windows.get(tuple(w[k : k + size])):
                    names |= found
                    hit[k : k + size] = [True] * size
        listed = sorted(n for n in names if n is not None)
        out.append((len(w), sum(hit), len(listed), hashlib.sha256(",".join(listed).encode()).hexdigest(), any(hit)))
    return out


@pytest.mark.parametrize("limits", [(7, 5, 40), (10**6, 4_000_000, 16_000_000)])
def test_contamination_by_brute_force(spark, monkeypatch, limits):
    rng = random.Random(6)
    mk = lambda n: rng.choice([" ", "-", "\n"]).join(rng.choice(["a", "B", "c", "é", "4"]) for _ in range(rng.randint(0, n)))
    texts = [rng.choice([None, "", mk(80), mk(80), mk(6)]) for _ in range(60)]
    items = [(rng.choice([None, i % 9]), rng.choice([None, "", mk(12), mk(3)])) for i in range(14)]
    for name, value in zip(("SHARD_WORDS", "PIECE_BYTES", "BLOCK_BYTES"), limits, strict=True):
        monkeypatch.setattr(decontamination, name, value)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({c: F.lit(1) for c in ("id", "n_words", "items", "spans")})
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("item", F.lit(0))
    for width in (1, 3, 10):
        got = {r[0]: tuple(r)[1:] for r in decontamination.digest(decontamination.contamination(frame, bench, width=width)).collect()}
        assert [got[i] for i in range(len(texts))] == contaminated(texts, [(None if n is None else str(n), t) for n, t in items], width)


def test_contamination_edges(spark, sf_dir):
    frame = odd_documents(spark)
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    for docs, items, n in ((frame, bench, frame.count()), (frame, bench.where("false"), frame.count()), (frame.where("false"), bench, 0)):
        rows = decontamination.contamination(docs, items).collect()
        assert len(rows) == n and all(r["n_hit"] == 0 for r in rows)
    one = spark.createDataFrame([(1, "x Y z, a b.")], "doc_id long, text string")
    item = spark.createDataFrame([(5, "y Z")], "item_id long, text string")
    r = decontamination.contamination(one, item).head()
    assert [tuple(s) for s in r["spans"]] == [(1, 3)] and r["items"] == ["5"]
    assert decontamination.without_spans("x Y z, a b.", [(1, 3)]) == "x , a b."


def test_suffix_order_and_ranks():
    rng = np.random.default_rng(2)
    for _ in range(60):
        parts = [np.r_[rng.integers(1, 4, rng.integers(1, 40)), 0] for _ in range(rng.integers(1, 8))]
        text = np.concatenate(parts)
        cuts = np.cumsum(text == 0)
        # A separator is less than all symbols, and than the separators after it.
        key = [(int(t), 0) if t else (-1, int(c)) for t, c in zip(text, cuts, strict=True)]
        want = sorted(range(len(text)), key=lambda i: key[i:])
        assert fm_index.suffix_array(text, 3).tolist() == want
        tree = fm_index.WaveletTree(text, 3)
        for s in range(4):
            at = np.arange(len(text) + 1)
            assert tree.rank(np.full(len(at), s), at).tolist() == [int((text[:i] == s).sum()) for i in at]
        index = fm_index.FMIndex(text, 3)
        phrases = np.array([[0, 1], [1, 2], [2, 2], [3, 1]])
        low, high = index.search(phrases, np.array([1, 2, 2, 2]))
        for (a, b), size, lo, hi in zip(phrases.tolist(), (1, 2, 2, 2), low, high, strict=True):
            found = sorted(index.locate(np.arange(lo, hi)).tolist())
            assert found == [i for i in range(len(text)) if (text[i : i + size].tolist() == [a, b][-size:])]


# WARC.


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_archives_round_trip(spark):
    big, same = "é<p>\r\n\r\n" * 40_000, "WARC/1.1\r\n\r\n" + "s" * 1200
    rows = [(1, "http://a/", big), (2, None, ""), (3, "u\nv", None), (4, "x", same), (5, "y", same), (6, "z", "short"), (7, "z", "short"), (None, "q", same), (9, "w", same), (9, "w", same), (10, "b", big), (11, "c", "t" * 999), (12, "c", "t" * 999)]
    folder = shared_path(spark, "warc-test")
    frame = pages(spark, rows).repartition(3).withColumns({c: F.lit(1) for c in ("page", "digest", "payload", "original", "chunk", "data", "n", "kind")})
    warc.write_archives(frame, folder)
    chunks = warc.read_archives(spark, folder).cache()
    got = sorted((tuple(r) for r in warc.page_digests(chunks).collect()), key=str)
    group = {}
    for page, _, html in rows:
        if page is not None and len((html or "").encode()) >= 1000:
            group[html] = max(group.get(html, page), page)
    want = []
    for page, _, html in rows:
        data = (html or "").encode()
        first = group.get(html, page)
        want.append((page, len(data), hashlib.sha1(data).hexdigest(), "response" if page == first else "revisit", None if page == first else first))
    assert got == sorted(want, key=str)
    # The payload comes back whole, in chunks of bounded size that carry the digest so far.
    parts = chunks.where("page = '10'").orderBy("chunk").collect()
    assert b"".join(bytes(p["data"]) for p in parts) == big.encode() and [p["chunk"] for p in parts] == list(range(len(parts)))
    done = b""
    for p in parts:
        done += bytes(p["data"])
        assert len(p["data"]) <= warc.CHUNK and (p["bytes_so_far"], p["sha1_so_far"]) == (len(done), hashlib.sha1(done).hexdigest())
    assert [p["last"] for p in parts] == [False] * (len(parts) - 1) + [True]


def test_ids_of_any_characters(spark):
    ids = ["a\r\nWARC-Type: x", " outer ", "é%41", "", "plain", None]
    frame = spark.createDataFrame([(i, "u", "p" * 1500) for i in ids], "page_id string, url string, html string")
    folder = shared_path(spark, "warc-ids")
    warc.write_archives(frame, folder)
    got = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in warc.page_digests(warc.read_archives(spark, folder), id_type="string").collect()}
    assert got == {i: ("response", None) if i == "é%41" else ("revisit", "é%41") for i in ids}


def test_archives_are_read_in_stretches(tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "STRETCH_BYTES", 2000)
    rng = random.Random(3)
    payloads = [bytes(rng.randrange(256) for _ in range(900)) for _ in range(12)]
    out = warc.Writer(str(tmp_path), "1970-01-01T00:00:00Z")
    for k, p in enumerate(payloads):
        out.chunk(str(k), None, hashlib.sha1(p).hexdigest(), len(p), "response", None, 0, p)
    out.end_record()
    out.end_file()
    assert len(out.done) > 2 and [d[2] for d in out.done] == list(np.cumsum([0, *[d[3] for d in out.done]]))[:-1]
    found = []
    for path, offset, _, n, size in out.done:
        with open(path, "rb") as file:
            file.seek(offset)
            part = [b"".join(pieces) for _, pieces in warc.records(warc.Stretch(file, size))]
        assert len(part) == n
        found += part
    assert found == payloads


def test_archives_edges(spark):
    folder = shared_path(spark, "warc-empty")
    warc.write_archives(pages(spark, []), folder)
    assert warc.read_archives(spark, folder).collect() == []
    store, path = warc.filesystem("file:/tmp/x y")
    assert path == "/tmp/x y" and warc.filesystem("/tmp/z")[1] == "/tmp/z"


def test_a_damaged_archive_is_an_error(spark):
    folder = shared_path(spark, "warc-bad")
    warc.write_archives(pages(spark, [(1, "a", "x" * 5000)]).coalesce(1), folder)
    store, path = warc.filesystem(spark.read.parquet(f"{folder}/manifest").head()["file"])
    data = store.open_input_stream(path, compression=None).read()
    with store.open_output_stream(path, compression=None) as out:
        out.write(data[:-30])
    with pytest.raises(Exception, match="archive|record|digest|incomplete"):
        warc.read_archives(spark, folder).collect()


# URL filters.


RULES = (["com/", "www.example.com/en/"], ["example.com/en/", "net/es/", "net/fr/"])


def judged(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    m = re.match(r"([^/?#]*)([^?#]*)", rest, re.S)
    host, path = re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]
    best = None
    for verdict, rules in zip(("allow", "block"), RULES, strict=True):
        for rule in rules:
            h, p = rule[: rule.index("/")], rule[rule.index("/") :]
            if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(rule) > len(best[0])):
                best = (rule, verdict)
    return host, path, *(best or (None, "allow"))


def test_urls(spark):
    hosts = ["example.com", "www.example.com", "WWW.Example.COM", "xexample.com", "a.b.net", "net", "com", "", "example.com:80", ".com", "..net", "m.org"]
    urls = [f"{s}{h}{p}" for s in ("http://", "x://", "", "a://b://") for h in hosts for p in ("", "/", "/en/", "/en", "/es/1?x", "/fr/#a", "?q=/en/", "#/", "/EN/", "/en/\nz")] + [None, "://", "http://" + "a." * 500 + "com/"]
    frame = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumns({c: F.lit(1) for c in ("id", "host", "path", "rule", "verdict")})
    got = {r[0]: tuple(r)[1:] for r in url_filter.judge(frame, *RULES).collect()}
    assert [got[i] for i in range(len(urls))] == [judged(u) for u in urls]
    assert url_filter.judge(frame.where("false"), *RULES).collect() == []
    assert {r["verdict"] for r in url_filter.judge(frame, [], [], default="block").collect()} == {"block"}
    for rule in ("Example.com/", "nopath"):
        with pytest.raises(ValueError, match="rules"):
            url_filter.judge(frame, [rule], [])


def test_cascade_is_exact_over_its_universe():
    listed = [f"k{i}" for i in range(200)]
    universe = [f"k{i}" for i in range(20_000)]
    first = url_filter.Bloom(listed, 0.3, 1)
    cascade = url_filter.Cascade(first, listed, [k for k in universe[200:] if k in first])
    assert len(cascade.levels) > 3 and all((k in cascade) == (i < 200) for i, k in enumerate(universe))


# Mixing.


def test_targets_by_resharing(spark):
    rng = random.Random(9)
    for n in (1, 2, 5, 23):
        sizes = {s: rng.choice([0, 5, 100, 100, 10_000]) for s in [f"s{i:02d}" for i in range(n)] + [None]}
        frame = spark.createDataFrame([(s, v) for s, v in sizes.items()], "source string, size long")
        order = sorted(sizes, key=lambda s: (s is None, s or ""))
        weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
        total, target, free = 1.5 * sum(sizes.values()), dict.fromkeys(order, 0.0), set(order)
        left = total
        while free:  # share what is left by weight; those that would be above stop
            level = left / sum(weight[s] for s in free)
            full = {s for s in free if level * weight[s] > 2 * sizes[s]}
            target.update({s: 2.0 * sizes[s] for s in full} if full else {s: level * weight[s] for s in free})
            left -= sum(2.0 * sizes[s] for s in full)
            free = free - full if full else set()
        got = {r["source"]: r["target"] for r in mixing.source_targets(frame).collect()}
        assert all(abs(got[s] - target[s]) < 1e-6 * (1 + total) for s in order)


def test_mix(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for rows in (2048, 3):
        monkeypatch.setattr(mixing, "BLOCK_ROWS", rows)
        out = [tuple(r) for r in mixing.mix(docs).orderBy("doc_id").collect()]
        assert out == [tuple(r) for r in mixing.mix(docs.repartition(3)).orderBy("doc_id").collect()]
        assert len(out) == docs.count() and all(t in (0, s, 2 * s) for _, s, _, _, t in out)
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    taken, target, most = {}, {}, {}
    for d, s, _, t, k in out:
        taken[source[d]] = taken.get(source[d], 0) + k
        target[source[d]] = t
        most[source[d]] = max(most.get(source[d], 0), s)
    assert all(abs(taken[s] - target[s]) <= 2.5 * most[s] for s in taken)


def mixed_by_hand(docs, block_rows):
    """The mix restated: rows are (id, source, size)."""
    import math

    order = sorted({s for _, s, _ in docs}, key=lambda s: (s is None, s or ""))
    sizes = {s: sum(n for _, x, n in docs if x == s) for s in order}
    rows = {s: sum(x == s for _, x, _ in docs) for s in order}
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, target, free = 1.5 * sum(sizes.values()), dict.fromkeys(order, 0.0), set(order)
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] > 2 * sizes[s]}
        target.update({s: 2.0 * sizes[s] for s in full} if full else {s: level * weight[s] for s in free})
        left -= sum(2.0 * sizes[s] for s in full)
        free = free - full if full else set()
    digits = lambda text: int(hashlib.md5(text.encode()).hexdigest()[:8], 16)
    out = []
    for s in order:
        blocks = max(1, math.ceil(rows[s] / max(block_rows, math.floor(math.sqrt(rows[s])))))
        line = [(digits(f"42:{'null' if d is None else d}:{n}") % blocks, n, d) for d, x, n in docs if x == s]
        line.sort(key=lambda r: (r[0], r[1] if r[0] % 2 == 0 else -r[1], r[2] is None, r[2] or 0))
        ratio = target[s] / sizes[s] if sizes[s] else 0.0
        start = digits("offset 42:" + ("null" if s is None else "=" + s)) / 2**32
        out += [(d, n, sizes[s], (math.floor((k + 1) * ratio + start) - math.floor(k * ratio + start)) * n) for k, (_, n, d) in enumerate(line)]
    return out


def test_mix_by_hand_with_repeats_and_null_ids(spark, monkeypatch):
    """Rows of one id and size stand as one in the line, and are dealt to many tasks after it."""
    monkeypatch.setattr(mixing, "STRETCH", 7)
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 40)
    rng = random.Random(12)
    rows = [(None if rng.random() < 0.3 else rng.randint(0, 90), "w " * rng.randint(0, 9), None, rng.choice(["a", "b", None]), None) for _ in range(900)]
    got = sorted(((r["doc_id"], r["size"], r["source_size"], r["taken"]) for r in mixing.mix(documents(spark, rows)).collect()), key=str)
    want = sorted(mixed_by_hand([(d, s, len(t.split())) for d, t, _, s, _ in rows], 40), key=str)
    assert got == want


def test_mix_spreads_null_ids(spark):
    rows = spark.range(50_000).selectExpr("CAST(NULL AS bigint) AS doc_id", "repeat('w ', CAST(id % 500 AS int)) AS text", "'s' AS source")
    out = mixing.mix(rows)
    assert out.count() == 50_000
    plan = out._jdf.queryExecution().toString()
    assert "partial_count" in plan  # counted before they are shuffled
    assert out.groupBy("size").count().count() == 500


def test_mix_edges(spark):
    frame = odd_documents(spark)
    rows = mixing.mix(frame).collect()
    assert len(rows) == frame.count() and all(r["taken"] <= 2 * r["size"] for r in rows)
    assert {r["doc_id"]: r["size"] for r in rows}[11] == 3
    assert mixing.mix(frame.where("false")).collect() == []
    assert {r["target"] for r in mixing.mix(frame.withColumn("text", F.lit(None).cast("string"))).collect()} == {0.0}


# Search.


def best_rows(texts, k, every, terms):
    import math
    from collections import Counter

    counts = [Counter(words_of(t)) for _, t in texts]
    mean = sum(sum(c.values()) for c in counts) / max(1, len(texts))
    df = Counter(w for c in counts for w in c)
    idf = {w: math.log1p((len(texts) - n + 0.5) / (n + 0.5)) for w, n in df.items()}
    share = lambda c, w: c[w] * 2.2 / (c[w] + 1.2 * (1 - 0.75 + 0.75 * sum(c.values()) / mean))
    out = []
    for (name, _), c in zip(texts, counts, strict=True):
        if name is None or name % every:
            continue
        asked = sorted(c, key=lambda w: (-round(idf[w] * share(c, w), 6), w))[:terms]
        scored = [(round(sum(idf[w] * share(d, w) for w in asked if w in d), 6), i) for i, d in enumerate(counts) if any(w in d for w in asked)]
        ranked = sorted(scored, key=lambda x: (-x[0], texts[x[1]][0] is None, texts[x[1]][0] or 0))[:k]
        out += [(name, r + 1, texts[i][0], s) for r, (s, i) in enumerate(ranked)]
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [1, 3, 64])
def test_search_by_brute_force(spark, monkeypatch, block):
    rng = random.Random(block)
    monkeypatch.setattr(bm25, "WAVES", 1 + block)
    monkeypatch.setattr(bm25, "QUERIES_AT_ONCE", 5)
    vocabulary = [f"w{i}" for i in range(40)]
    weights = [1 / (i + 1) for i in range(40)]
    texts = [(i, rng.choice([" ".join(rng.choices(vocabulary, weights, k=rng.randint(1, 30)))] * 6 + [None, "", "w1 w2"])) for i in range(300)] + [(None, "w1 w3 w2")]
    frame = spark.createDataFrame(texts, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("id", "query", "word", "score", "rank", "query_id")})
    for k, terms in ((1, 3), (5, 12)):
        got = sorted((tuple(r) for r in bm25.top_k(frame, k=k, every=7, terms=terms).collect()), key=str)
        want = best_rows(texts, k, 7, terms)
        assert [g[:3] for g in got] == [w[:3] for w in want] and all(abs(g[3] - w[3]) < 2e-6 for g, w in zip(got, want, strict=True))


def asked_once(texts):
    """The texts with those of an id joined, as which its rows ask."""
    joined = {}
    for name, text in texts:
        joined.setdefault(name, []).append(text or "")
    return {name: " ".join(t) for name, t in joined.items()}


def best_rows_of_repeats(texts, k, every):
    """As ``best_rows``, where an id asks once with the different words of all its rows."""
    alone = [(None, t) for _, t in texts]
    out = []
    for name, text in asked_once(texts).items():
        if name is None or name % every:
            continue
        # A row more, which only asks: it isn't counted among the rows.
        words = set(words_of(text))
        found = scores_of(alone, words)
        ranked = sorted(((-s, texts[i][0] is None, texts[i][0] or 0) for i, s in found.items()))[:k]
        out += [(name, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(ranked)]
    return sorted(out, key=str)


def scores_of(texts, words):
    import math
    from collections import Counter

    counts = [Counter(words_of(t)) for _, t in texts]
    mean = sum(map(Counter.total, counts)) / max(1, len(texts))
    df = Counter(w for c in counts for w in c)
    idf = {w: math.log1p((len(texts) - n + 0.5) / (n + 0.5)) for w, n in df.items()}
    share = lambda c, w: c[w] * 2.2 / (c[w] + 1.2 * (1 - 0.75 + 0.75 * c.total() / mean))
    return {i: round(sum(idf[w] * share(c, w) for w in sorted(words) if w in c), 6) for i, c in enumerate(counts) if words & set(c)}


def test_search_with_repeated_ids(spark):
    """Equal rows ask with a word once, and rows of one id with the words of all."""
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(60)]
    texts = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(1, 25)))) for i in range(80)]
    texts += [texts[0], texts[20], texts[20], (40, "w1 w2 w3 quite another text"), (None, texts[40][1]), (None, texts[40][1]), (60, None)]
    frame = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    got = sorted((tuple(r) for r in bm25.top_k(frame).collect()), key=str)
    want = best_rows_of_repeats(texts, 10, 20)
    assert [g[:3] for g in got] == [w[:3] for w in want] and all(abs(g[3] - w[3]) < 2e-6 for g, w in zip(got, want, strict=True))
    once = [t for k, t in enumerate(texts[:80])]
    frame = spark.createDataFrame([*once, once[20]], "doc_id long, text string")
    few = {r["query_id"]: r for r in bm25.top_k(frame, k=1, terms=3).collect()}
    words = sorted(words_of(once[20][1]), key=lambda w: w)
    shares = {w: scores_of([*once, once[20]], {w})[20] for w in set(words)}
    # The id's two rows ask as a text twice as long, so the shares differ; but three different words ask.
    assert few[20]["score"] <= sum(sorted(shares.values())[-3:]) + 1e-5 and few[20]["doc_id"] == 20


def test_search_edges(spark):
    frame = odd_documents(spark)
    rows = [(r["doc_id"], r["text"]) for r in frame.collect()]
    got = sorted((tuple(r) for r in bm25.top_k(frame, every=1).collect()), key=str)
    want = best_rows_of_repeats(rows, 10, 1)
    assert [g[:3] for g in got] == [w[:3] for w in want] and all(abs(g[3] - w[3]) < 2e-6 for g, w in zip(got, want, strict=True))
    assert bm25.top_k(frame.where("false")).collect() == []


# Quality.


def test_interactions_in_linear_time():
    machine = quality.Machine(50, 4, seed=3)
    rng = np.random.default_rng(1)
    machine.weights[:] = rng.normal(size=50)
    machine.factors[:] = rng.normal(size=(50, 4))
    at, x = np.array([3, 7, 20, 41], np.int32), rng.normal(size=4).astype(np.float32)
    pairs = sum(float(machine.factors[at[i]] @ machine.factors[at[j]]) * float(x[i] * x[j]) for i in range(4) for j in range(i + 1, 4))
    raw = machine.bias + float(machine.weights[at] @ x) + pairs
    assert abs(machine.scores([(at, x)])[0] - 1 / (1 + np.exp(-raw))) < 1e-5


def test_quality_of_held_out_texts(spark, sf_dir):
    big = sf_dir.replace("sf0.001", "sf0.01")
    docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    rows = {r["doc_id"]: r for r in quality.score(docs, labels).collect()}
    assert len(rows) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for d, r in rows.items())
    known = [(rows[r["doc_id"]]["predicted"], r["quality"]) for r in labels.collect() if rows[r["doc_id"]]["held_out"]]
    assert len(known) > 40 and sum(a == b for a, b in known) / len(known) >= 0.93
    # Held-out labels, languages and sources make no difference.
    other = labels.withColumn("quality", F.when(quality.held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = quality.score(docs.withColumn("lang", F.lit("zz")).withColumn("source", F.lit(None).cast("string")), other).collect()
    assert {r["doc_id"]: r["score"] for r in again} == {d: r["score"] for d, r in rows.items()}


def test_quality_learns_a_bounded_number_of_repeats(spark, monkeypatch):
    """A repeated id's rows are drawn one by one, and very long texts have fewer rows drawn."""
    seen = []
    learn = quality.Machine.learn
    monkeypatch.setattr(quality.Machine, "learn", lambda self, rows, *rest: seen.append(len(rows)) or learn(self, rows[:50], *(r[:50] for r in rest)))
    rows = [(1, f"good text {k % 5}", None, None, None) for k in range(40_000)] + [(k, f"bad {k}", None, None, None) for k in range(2, 200)]
    labels = spark.createDataFrame([(1, 1)] + [(k, 0) for k in range(2, 200)], "doc_id long, quality int")
    quality.learn(documents(spark, rows), labels, "doc_id", "text", None, "doc_id", "quality", 30)
    assert 60 <= seen[0] <= 240
    long = [(k, " ".join(f"w{k}x{i}" for i in range(4000)), None, None, None) for k in range(40)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, quality int")
    monkeypatch.setattr(quality, "TRAIN_FEATURES", 40_000)
    quality.learn(documents(spark, long), labels, "doc_id", "text", None, "doc_id", "quality", 30)
    assert 2 <= seen[1] < 20


def test_quality_edges(spark):
    frame = odd_documents(spark)
    labels = spark.createDataFrame([(4, 1), (5, 0), (5, 0), (6, None), (None, 1), (7, 3), (10, 1)], "doc_id long, quality int").withColumn("toxic", F.lit(0))
    rows = quality.score(frame, labels).collect()
    assert len(rows) == frame.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert quality.score(frame.where("false"), labels).collect() == []
    assert {r["score"] for r in quality.score(frame, labels.where("false")).collect()} == {0.5}
    assert quality.score(frame.drop("n_chars"), labels).count() == frame.count()
