from __future__ import annotations

import re

import corpus_pipeline as pipeline
from pyspark.sql import functions as F

import __spark_entry__ as entry
from spanqc.llm import queries


def test_registered():
    names = set(entry.queries())
    assert names >= set(queries.QUERIES) | {"pipeline"}
    assert {q.split("_")[0] for q in queries.QUERIES} == {f"op{n}" for n in range(1, 14)}
    assert set(queries.ORACLES) <= set(queries.QUERIES) and len(pipeline.STAGES) == 5


def stages(spark, docs, folder, tmp_path):
    kept = [docs]
    for k, (_, stage) in enumerate(pipeline.STAGES):
        stage(spark, kept[-1], folder).write.parquet(str(tmp_path / str(k)))
        kept.append(spark.read.parquet(str(tmp_path / str(k))))
    return kept


def test_stages(spark, sf_dir, tmp_path):
    sf_dir = sf_dir.replace("sf0.001", "sf0.01")  # enough labels to learn from
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = stages(spark, docs, sf_dir, tmp_path)
    assert all(k.columns == docs.columns for k in kept[1:5])
    sizes = [k.count() for k in kept]
    assert sizes == sorted(sizes, reverse=True) and sizes[0] > sizes[1] > sizes[3] and sizes[4] == sizes[5] > 0.6 * sizes[0]
    # What is kept is what was there, whole.
    assert kept[4].exceptAll(docs).count() == 0
    # Clean documents pass the quality stage, bad ones don't.
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").join(docs.select("doc_id"), "doc_id")
    left = labels.join(kept[1].select("doc_id"), "doc_id", "left_semi").groupBy("quality").count().rdd.collectAsMap()
    every = labels.groupBy("quality").count().rdd.collectAsMap()
    assert left[1] >= 0.98 * every[1] and left.get(0, 0) <= 0.1 * every[0]
    # One of each group of equal texts stays, no benchmark passage does.
    assert kept[3].groupBy("text").count().where("count > 1").count() == 0
    assert kept[3].select("text").distinct().count() <= kept[2].select("text").distinct().count()
    passages = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("text").alias("passage"))
    assert kept[4].crossJoin(F.broadcast(passages)).where(F.contains("text", "passage")).count() == 0
    out = pipeline.run(spark, sf_dir)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, kept[5].collect()))


def test_odd_documents(spark, sf_dir, tmp_path):
    from test_corpus_operators import odd_documents

    docs = odd_documents(spark).unionByName(spark.read.parquet(f"{sf_dir}/documents.parquet"), allowMissingColumns=True)
    kept = stages(spark, docs, sf_dir, tmp_path)
    assert all(k.columns == docs.columns for k in kept[1:5])
    assert kept[2].where("text IS NULL OR text = ''").count() == 0
    empty = stages(spark, docs.where("false"), sf_dir, tmp_path / "empty")
    assert [k.count() for k in empty] == [0] * 6


def test_stages_by_brute_force(spark, sf_dir, tmp_path, monkeypatch):
    """Each stage's rows against plain Python, given what the two classifiers learned."""
    import numpy as np
    from test_corpus_operators import MODEL, contaminated, fingerprint, mixed_by_hand, smallest_reachable

    from spanqc.llm import language_id, quality

    machines, models = [], []
    learn_machine, learn_model = quality.learn, language_id.learn
    monkeypatch.setattr(quality, "learn", lambda *a, **k: machines.append(learn_machine(*a, **k)) or machines[-1])
    monkeypatch.setattr(language_id, "learn", lambda *a, **k: models.append(learn_model(*a, **k)) or models[-1])
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    passage = spark.read.parquet(f"{sf_dir}/benchmark.parquet").head()["text"]
    first = docs.where("text IS NOT NULL").orderBy("doc_id").head().asDict()
    odd = [{**first, "doc_id": 9001, "text": None}, {**first, "doc_id": 9002, "text": "12 34"}, {**first, "doc_id": None}, first, {**first, "doc_id": 9004, "text": "e " * 200}, {**first, "doc_id": 9003, "text": f"{first['text']} {passage}"}]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    kept = [[r.asDict() for r in k.collect()] for k in stages(spark, docs, sf_dir, tmp_path)]
    ordered = lambda rows: sorted((tuple(r.values()) for r in rows), key=str)

    def good(r):
        at, x = quality.features(r["text"].encode() if r["text"] is not None else None, None if r["n_chars"] is None else float(r["n_chars"]))
        m = machines[0]
        v = m.factors[at].astype(float) * x[:, None].astype(float)
        pairs = float(np.triu(v @ v.T, 1).sum())  # every pair of features
        return 1 / (1 + np.exp(-(m.bias + float(m.weights[at].astype(float) @ x) + pairs))) >= quality.THRESHOLD

    assert ordered(kept[1]) == ordered(r for r in kept[0] if good(r))
    scorer = language_id.Scorer(models[0])
    chances = {}

    def spoken(r):
        """Whether one language is likelier than all others, each word summed alone over its segmentations."""
        words = [w for w in language_id.letters(r["text"] or "") if w]
        for w in words:
            if w not in chances:
                chances[w] = scorer.alone(w)
        total = np.sum([chances[w] for w in words], axis=0)
        return bool(words) and 1 / np.exp(total - total.max()).sum() >= pipeline.LEAST_SHARE

    assert ordered(kept[2]) == ordered(r for r in kept[1] if spoken(r))
    assert not spoken({"text": "12 34"}) and len({spoken({"text": t}) for t in ("a", "e", "n", "s", "t", first["text"])}) == 2
    prints = [fingerprint(r["text"]) for r in kept[2]]
    group = smallest_reachable(list(range(len(prints))), prints)
    best = {}
    for g, r in zip(group, kept[2], strict=True):
        if g not in best or (r["doc_id"] is None, r["doc_id"] or 0) < (best[g]["doc_id"] is None, best[g]["doc_id"] or 0):
            best[g] = r
    assert ordered(kept[3]) == ordered(best.values())
    items = [(str(r["item_id"]), r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    hit = contaminated([r["text"] for r in kept[3]], items, 10)
    assert ordered(kept[4]) == ordered(r for r, h in zip(kept[3], hit, strict=True) if not h[4]) and len(kept[4]) < len(kept[3])
    want = mixed_by_hand([(r["doc_id"], r["source"], len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))) for r in kept[4]], 2048)
    assert sorted((r["doc_id"], r["size"], r["source_size"], r["taken"]) for r in kept[5]) == sorted(want)


def test_nothing_is_left_of_a_run(spark, sf_dir):
    from spanqc.sources import shared

    before = set(shared.WRITTEN)
    out = pipeline.run(spark, sf_dir)
    assert out.count() > 0
    left = shared.WRITTEN - before
    # The last stage reads what the one before kept and its own sums; they go with the process, or by name.
    assert len(left) <= 4
    shared.forget(*left)
    assert all(shared.filesystem(p)[0].get_file_info(shared.filesystem(p)[1]).type.name == "NotFound" for p in left)
