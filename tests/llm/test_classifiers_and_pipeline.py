import random
import zlib

import corpus_pipeline
import numpy as np
import pytest
from fixtures_llm import docs_of, extras_kept
from pyspark.sql import functions as F

from graphloom.llm import packing, quality, registry, textfeat, toxicity


def labelled_rows(words, label):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(600):
        text = [rng.choice(words) for _ in range(rng.randint(20, 60))]
        bad = rng.random() < 0.3
        if bad and label == "toxic":
            for _ in range(3):
                text[rng.randrange(len(text))] = rng.choice(["rotten", "vile"])
        if bad and label == "quality":
            text = [w + "###" for w in text]
        rows.append((i, " ".join(text)))
        labels.append((i, int(not bad), int(bad)))
    return rows, labels


@pytest.mark.parametrize(("op", "label", "held"), [(toxicity, "toxic", (3, 1)), (quality, "quality", (5, 0))])
def test_held_out_accuracy_and_odd_texts(spark, words, odd_rows, op, label, held):
    rows, labels = labelled_rows(words, label)
    docs, table = docs_of(spark, rows), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    model = op.train(docs, table)
    score = {r.doc_id: r.score for r in (op.toxicity if label == "toxic" else op.quality)(docs, model).collect()}
    truth = {i: t if label == "toxic" else q for i, q, t in labels}
    out = [i for i in truth if zlib.crc32(str(i).encode()) % held[0] == held[1]]
    assert len(out) > 50 and np.mean([(score[i] >= op.THRESHOLD) == (truth[i] == 1) for i in out]) > 0.95
    # labels of held-out rows, lang, source and other columns change nothing
    flipped = spark.createDataFrame([(i, 1 - q if i in set(out) else q, 1 - t if i in set(out) else t) for i, q, t in labels], "doc_id bigint, quality int, toxic int")
    again = op.train(docs.withColumns({"source": F.lit(None).cast("string"), "score": F.lit(9)}), flipped)
    assert (again.scores([textfeat.word_hashes(t) for _, t in rows[:50]]) == model.scores([textfeat.word_hashes(t) for _, t in rows[:50]])).all()
    odd = (op.toxicity if label == "toxic" else op.quality)(docs_of(spark, odd_rows), model).collect()
    assert len(odd) == len(odd_rows) and all(0 <= r.score <= 1 for r in odd)
    assert len({r.score for r in odd if r.doc_id in (1, 2, 3, 4)}) == 1
    kept = op.filtered(docs_of(spark, odd_rows), model, lambda s: s >= 0)
    assert kept.count() == len(odd_rows) and kept.columns == docs.columns and extras_kept(kept)
    empty = op.train(docs.limit(0), table.limit(0))
    assert empty.scores([textfeat.word_hashes("a b")]).tolist() == [0.5]


def test_the_labelled_sample_is_of_documents_that_are_here(spark, words):
    rows, labels = labelled_rows(words, "toxic")
    here = docs_of(spark, rows[:50])
    many = spark.createDataFrame([*labels, *((i, 1, i % 2) for i in range(1_000, 20_000))], "doc_id bigint, quality int, toxic int")
    can = [i for i in range(50) if zlib.crc32(str(i).encode()) % 3 != 1]
    docs, y, lang = textfeat.labelled(here, many, "toxic", (3, 1), 100)
    assert len(docs) == len(y) == len(lang) == len(can) and sorted(map(len, docs)) == sorted(len(textfeat.word_hashes(rows[i][1])) for i in can)
    few, _, _ = textfeat.labelled(here, many, "toxic", (3, 1), 100, max_words=200)
    assert 0 < len(few) < len(can) and sum(map(len, few)) <= 200 and all((a == b).all() for a, b in zip(few, docs))


def test_long_texts_are_scored_in_slices_as_if_whole(words, monkeypatch):
    rng = random.Random(1)
    docs = [textfeat.word_hashes(" ".join(rng.choice(words) for _ in range(n))) for n in (0, 1, 2, 500, 3, 40)]
    cnn, vectors = toxicity.Cnn.start(), quality.word_vectors(docs)
    whole, pooled = cnn.pooled(docs), quality.pool(docs, vectors)
    monkeypatch.setattr(toxicity, "_SLICE", 37)
    monkeypatch.setattr(quality, "_SLICE", 37)
    assert np.allclose(whole, cnn.pooled(docs), atol=1e-5) and np.allclose(pooled, quality.pool(docs, vectors))
    for d, row in zip(docs, pooled, strict=True):
        plain = np.mean([vectors[int(h) % quality.BUCKETS] for h in d], axis=0) if len(d) else np.zeros(quality.DIM)
        assert np.allclose(row[: quality.DIM], plain, atol=1e-6)


def test_word_vectors_equal_plain_sums(words, monkeypatch):
    rng = random.Random(4)
    docs = [textfeat.word_hashes(" ".join(rng.choice(words[:40]) for _ in range(n))) for n in (1, 30, 2, 60, 0)]
    places, signs = quality.index_vectors()
    index = lambda b: sum((np.eye(quality.DIM)[p] * s for p, s in zip(places[b], signs[b], strict=True)), np.zeros(quality.DIM))
    sums = {}
    for d in docs:
        buckets = [int(h) & 0xFFFF for h in d]
        for i, b in enumerate(buckets):
            total = sums.setdefault(b, np.zeros(quality.DIM))
            for j in range(max(0, i - quality.WINDOW), min(len(buckets), i + quality.WINDOW + 1)):
                if j != i:
                    total += index(buckets[j])
    seen = {b: v for b, v in sums.items() if v.any()}
    centre = np.mean(list(seen.values()), axis=0)
    for size in (100_000, 4):  # in one slice and in many
        monkeypatch.setattr(quality, "_SLICE", size)
        got = quality.word_vectors(docs)
        for b, v in seen.items():
            v = v - centre
            assert np.allclose(got[b], v / max(np.linalg.norm(v), 1e-9), atol=1e-5)
        other = next(b for b in range(quality.BUCKETS) if b not in sums)
        own = index(other) - centre
        assert np.allclose(got[other], own / np.linalg.norm(own), atol=1e-5)


def test_a_training_step_follows_the_gradient(words):
    rng = random.Random(5)
    docs = [textfeat.word_hashes(" ".join(rng.choice(words) for _ in range(n))) for n in (5, 9, 3, 12)]
    y, weight = np.array([1.0, 0.0, 1.0, 0.0]), np.array([1.0, 2.0, 1.0, 1.0])

    def loss(model):
        z = model.logits(docs)
        return float(np.mean(weight * (np.logaddexp(0, z) - y * z)))

    before, after = toxicity.Cnn.start(), toxicity.Cnn.start()
    after.step(docs, y, weight, {}, 1e-3)
    checked = 0
    for name, at in [("out", (k,)) for k in range(0, 48, 5)] + [("bias", (k,)) for k in range(0, 48, 5)] + [("filters", (w, 0, i, j)) for w in range(3) for i in range(0, toxicity.DIM, 7) for j in range(0, toxicity.FILTERS, 5)]:
        of = lambda m: m.filters[at[0]] if name == "filters" else getattr(m, name)  # noqa: B023, E731
        place = at[1:] if name == "filters" else at
        moved = float(of(after)[place] - of(before)[place])
        model = toxicity.Cnn.start()
        values = of(model)
        values[place] += 1e-2
        up = loss(model)
        values[place] -= 2e-2
        slope = (up - loss(model)) / 2e-2
        if abs(slope) > 2e-3:
            assert moved * slope < 0, (name, at, moved, slope)
            checked += 1
    assert checked > 15 and loss(after) < loss(before)


def test_convolution_equals_plain_loops(words):
    docs = [textfeat.word_hashes(" ".join(words[:9]))]
    cnn = toxicity.Cnn.start()
    rows, _ = toxicity._flat(docs)
    x = cnn.embed(rows)
    for k, w in enumerate(toxicity.WIDTHS):
        plain = [sum(x[i + j] @ cnn.filters[k][j] for j in range(w) if i + j < len(x)) for i in range(len(x))]
        part = slice(k * toxicity.FILTERS, (k + 1) * toxicity.FILTERS)
        assert np.allclose(cnn.pooled(docs)[0, part], np.max(plain, axis=0), atol=1e-5)


def test_pipeline_stages(spark, tmp_path, words):
    rows, labels = labelled_rows(words, "toxic")
    bad, more = labelled_rows(words, "quality")
    rows += [(1_000 + i, t) for i, t in bad] + [(5_000, rows[0][1]), (5_001, "write to bob.42@mail1.example.com soon"), (5_002, None), (5_003, "")]
    labels = [(i, 1, t) for i, _, t in labels] + [(1_000 + i, q, 0) for i, q, _ in more]
    docs = docs_of(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    sf = str(tmp_path)
    toxic = {i for i, _, t in labels if t}
    low = {i for i, q, _ in labels if not q}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "quality", "near_dedup", "pii", "packing"]
    at = docs
    kept = []
    for n, stage in corpus_pipeline.STAGES:
        out = stage(spark, at, sf)
        if n != "packing":
            assert out.columns == docs.columns
        out.write.parquet(f"{sf}/{n}")
        at = spark.read.parquet(f"{sf}/{n}")
        kept.append({r.doc_id for r in at.select("doc_id").collect()})
    every = {i for i, _ in rows}
    assert len(kept[0] & toxic) <= 0.05 * len(toxic) and len(every - toxic - kept[0]) <= 0.02 * len(every)
    assert len(kept[1] & low) <= 0.05 * len(low) and len(kept[0] - low - kept[1]) <= 0.02 * len(every)
    assert not {0, 5_000} <= kept[2] and kept[3] == kept[2] == kept[4]
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/pii").collect()}
    assert texts.get(5_001, "[EMAIL]").count("[EMAIL]") == 1
    whole = corpus_pipeline.run(spark, sf)
    assert whole.columns == at.columns and whole.count() == at.count()
    assert at.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0] <= packing.CAPACITY


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES if n.startswith("op")) == list(range(1, 11)) and "pipeline" in registry.QUERIES
