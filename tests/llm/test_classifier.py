import random
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalog.llm import classifier, queries_free


def corpus(n, seed):
    rnd = random.Random(seed)
    good = ["river", "mountain", "castle", "garden", "étude", "walking", "quietly", "the", "of", "a"]
    rows = []
    for i in range(n):
        words = [rnd.choice(good) for _ in range(rnd.randrange(5, 80))]
        bad = rnd.random() < 0.4
        if bad:
            kind = rnd.randrange(3)
            words = [w.upper() + "!!" for w in words] if kind == 0 else [w + rnd.choice(("###", "$$$", "%%%")) for w in words] if kind == 1 else [w for w in words for _ in range(8)]
        rows.append((i, " ".join(words), int(not bad)))
    return rows


def plain_features(word):
    """By the definition: n-grams of 2 to 4 characters of the word with its borders, mixed and dealt to buckets, and the word."""
    points, out = [ord(c) for c in f" {word}\n"], []
    for n in (2, 3, 4):
        for at in range(len(points) - n + 1):
            value = 0
            for k in range(n):
                value = (value * 0x100000001B3 + points[at + k] + k + 1) % 2**64
            value = value * 0x9E3779B97F4A7C15 % 2**64
            out.append((value ^ (value >> 29)) % classifier.BUCKETS)
    return [*out, zlib.crc32(word.encode()) % classifier.BUCKETS]


def plain_score(model, text):
    """The model's definition, feature by feature."""
    words = text.split()
    found = [f for w in words for f in plain_features(w)]
    again = classifier.REPEAT * sum(a == b for a, b in zip(words, words[1:]))
    total = sum(float(model.weights[f]) for f in found) + again * model.repeat
    n = len(found) + again
    return 1 / (1 + np.exp(-(model.bias + (total / n if n else 0))))


def fitted(rows):
    return classifier.fit([classifier.counted(t.encode()) for _, t, _ in rows], [y for *_, y in rows])


def test_held_out_accuracy_and_definition():
    rows = corpus(400, 1)
    model = fitted(rows)
    other = corpus(200, 2)
    scores = model.scores([t.encode() for _, t, _ in other])
    assert np.mean([(s >= 0.3) == y for s, (*_, y) in zip(scores, other)]) > 0.97
    for text in ("river ÉTUDE!! garden garden", "x", "漢字 castle###"):
        assert abs(model.scores([text.encode()])[0] - plain_score(model, text)) < 1e-5
    assert model.scores([b"", None, b" \n"]) == [model.scores([b""])[0]] * 3
    assert 0 <= model.scores([b"a" * 300000])[0] <= 1


def test_features_of_one_word_do_not_depend_on_its_neighbours():
    alone = {w: sorted(classifier.features([w])[0].tolist()) for w in (b"a", b"garden", "é漢".encode())}
    found, counts = classifier.features(list(alone))
    ends = np.cumsum(counts)
    for i, w in enumerate(alone):
        assert sorted(found[ends[i] - counts[i] : ends[i]].tolist()) == alone[w]


def test_fit_is_reproducible_and_degenerate_labels_are_defined():
    rows = corpus(60, 3)
    a, b = fitted(rows), fitted(rows)
    assert np.array_equal(a.weights, b.weights) and a.bias == b.bias
    assert classifier.fit([], []).scores([b"x"]) == [0.5]
    assert classifier.fit([classifier.counted(b"x")] * 3, [1] * 3).scores([b"y", None])[0] > 0.8


def test_query(spark, tmp_path):
    rows = corpus(300, 4)
    spark.createDataFrame([(i, t) for i, t, _ in rows] + [(1000, None), (1001, ""), (None, "river"), (7, "river")], "doc_id long, text string").withColumn("score", F.lit("clash")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, y, 0) for i, _, y in rows] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = queries_free.op6_quality(spark, str(tmp_path)).collect()
    assert len(got) == 304
    truth = {i: y for i, _, y in rows}
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) or r.doc_id is None
        assert r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    docs, labels = spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet")
    chosen = classifier.training_rows(docs, labels, max_docs=50, where=lambda k: ~classifier.held_out(k)).collect()
    counts = {tuple(x.astype("<i4").tobytes() for x in classifier.counted(t.encode())): i for i, t, _ in rows}
    assert len(chosen) == 50 and all(zlib.crc32(str(counts[bytes(r["found"]), bytes(r["times"])]).encode()) % 5 for r in chosen if r["found"])


def test_repeated_rows_and_ids_do_not_go_beyond_the_bound(spark):
    docs = spark.createDataFrame([(i % 4, f"text {i % 20}") for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i % 4, 1) for i in range(40)], "doc_id long, quality int")
    assert classifier.training_rows(docs, labels).count() == 20
    assert classifier.training_rows(docs, labels, max_docs=3).count() == 3


def test_a_small_memo_gives_the_same_scores(monkeypatch):
    rows = corpus(60, 6)
    model, texts = fitted(rows), [t.encode() for _, t, _ in corpus(90, 7)]
    whole = model.scores(texts)
    monkeypatch.setattr(classifier, "MEMO", 9)
    model.memo = None
    assert [s for t in texts for s in model.scores([t])] == whole


def test_held_out_quality_on_the_given_tables_with_the_default_sample(spark):
    folder = Path("/root/testdata/sf0.01")
    if not folder.exists():
        pytest.skip("the given tables are not here")
    scored = queries_free.op6_quality(spark, str(folder)).where("held_out").join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").select("score", "predicted", "quality").collect()
    good, bad = ([r.score for r in scored if r.quality == q] for q in (1, 0))
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc > 0.95 and np.mean([r.predicted == r.quality for r in scored]) > 0.9
