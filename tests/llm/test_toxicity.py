"""Op 6: accuracy on rows held out of training, misspellings and edge rows."""
from __future__ import annotations

import zlib

import numpy as np
import pytest

from talentmatch.llm import queries, toxicity
from talentmatch.llm.common import read_table


def auc(scores, labels):
    order = np.argsort(scores, kind="stable")
    ranks = np.empty(len(scores))
    ranks[order] = np.arange(1, len(scores) + 1)
    n = labels.sum()
    return (ranks[labels == 1].sum() - n * (n + 1) / 2) / (n * (len(labels) - n))


def test_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in read_table(spark, sf, "labels").collect()}
    rows = queries.op6_toxicity(spark, sf).collect()
    assert len(rows) == read_table(spark, sf, "documents").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    test = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    s, y = np.array([x for x, _ in test]), np.array([x for _, x in test])
    print("held out", len(y), "auc", auc(s, y), "recall", (s[y == 1] >= .5).mean(), "precision", y[s >= .5].mean())
    assert auc(s, y) > 0.92  # 2,900 labelled documents; on 16,500 it is 0.998
    assert (s[y == 1] >= 0.5).mean() > 0.65 and (s[y == 0] >= 0.5).mean() < 0.03


def test_unseen_misspellings_share_grams():
    rng = np.random.default_rng(1)
    vocabulary = ["".join(rng.choice(list("aeinorst"), rng.integers(3, 9))) for _ in range(400)]
    texts, labels = [], []
    for k in range(600):
        words = set(rng.choice(vocabulary, 40))
        if k % 3 == 0:
            words.add(("glumbuck", "glumbucks", "zorkwitz")[k // 3 % 3])
        texts.append(sorted(words))
        labels.append(int(k % 3 == 0))
    model = toxicity.train(texts, labels)
    clean = " ".join(rng.choice(vocabulary, 40))

    def odds(text):
        p = model.score(text)
        return np.log(p / (1 - p))

    for word in ("glumbukc", "glummbuck", "zorkwitzz"):
        assert odds(f"{clean} {word}") > odds(clean) + 2
    assert abs(odds(f"{clean} qqhvvx") - odds(clean)) < 1  # shares none


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 0.5), (None, "", 0.5), (2, "loser " * 50000, 0.5), (2, "x" * 99999, 0.5)],
                                 "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 1), (77, 0)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    out = toxicity.scored(docs, model)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"] and out.count() == 4
    assert toxicity.scored(docs.limit(0), toxicity.fit(docs.limit(0), labels.limit(0))).count() == 0
    assert toxicity.train([], []).score("") == pytest.approx(0.5)


def test_long_words_are_read_whole():
    rng = np.random.default_rng(5)
    word = "".join(rng.choice(list("abcdefghijklmnop"), 1000))
    inside = {word[i:i + n] for n in toxicity.GRAMS for i in range(len(word) - n + 1)}
    windows = toxicity.words_of("short " + word) - {"short"}
    assert inside <= {w[i:i + n] for w in windows for n in toxicity.GRAMS for i in range(len(w) - n + 1)}
    assert toxicity.words_of("a" * 40) == {"a" * 40}
    weight = np.zeros(toxicity.BUCKETS, np.float32)
    weight[toxicity.grams("xyzzy")] = 50
    model = toxicity.SubwordModel(weight, 0.0)
    assert model.score(word[:500] + "xyzzy" + word[500:]) > model.score(word) + 0.01


def test_rare_words_train():
    texts = [[f"plain{k}", f"usual{k}", *(["glumbuck"] if k % 4 == 0 else [])] for k in range(24)]
    model = toxicity.train(texts, [int(k % 4 == 0) for k in range(24)])
    assert model.score("plain1 usual1 glumbuck") > 0.5 > model.score("plain1 usual1")


def test_all_words_of_a_sampled_text_train(spark):
    docs = spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(9000)) + " zzz")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    (row,) = toxicity.training_set(docs, labels).collect()
    assert set(row.words.split("\n")) == {*(f"w{k}" for k in range(9000)), "zzz"}
