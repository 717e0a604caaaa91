"""Toxicity: features against a plain list, a learner step by hand, and what is found in rows held out."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.llm import toxicity


def _plain(text):
    """Distinct features of a text, by name."""
    ws = toxicity._WORD.findall(text.lower())
    return {(w,) for w in ws} | {(a, b, g) for g in toxicity.GAPS for a, b in zip(ws, ws[g:], strict=False)}


def _slot_of(f):
    h = [np.array([zlib.crc32(w.encode())], np.uint64) for w in f[:2] if isinstance(w, str)]
    return int(toxicity._slot(h[0] if len(h) == 1 else (h[0] * toxicity._LEFT ^ h[1]) + np.uint64(f[2]))[0])


@pytest.mark.parametrize("piece", [1 << 20, 9, 1])
def test_features_are_words_pairs_and_skip_grams(monkeypatch, piece):
    monkeypatch.setattr(toxicity, "PIECE", piece)
    for text in ("", "one", "You IDIOT, über-x_y 7!", "a b c d e f a b c d " * 5):
        assert toxicity.features(text).tolist() == sorted({_slot_of(f) for f in _plain(text)})


def test_one_step_by_hand():
    f = toxicity.Ftrl(np.zeros(toxicity.BIAS + 1), np.zeros(toxicity.BIAS + 1), alpha=1.0, beta=1.0, l1=0.1, l2=0.0)
    f.learn(np.array([3]), 1.0)
    assert f.z[3] == f.z[toxicity.BIAS] == -0.5 and f.n[3] == 0.25
    assert np.allclose(f.weights(np.array([3, 4, toxicity.BIAS])), [(0.5 - 0.15) / 1.5, 0.0, 0.5 / 1.5])


BAD, GOOD = ["scum", "idiot", "süffx"], ["the", "of", "tree", "house", "river", "über", "blue", "run"]


def _tables(spark, n=900):
    pick = random.Random(2)
    docs, labels = [], []
    for i in range(n):
        words = pick.choices(GOOD, k=pick.randint(1, 60)) + [f"n{pick.randrange(400)}"]
        toxic = i % 6 == 0
        if toxic:
            words.insert(pick.randrange(len(words)), pick.choice(BAD).upper() + "!")
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs += [(n, None), (n + 1, ""), (None, "you idiot"), (n + 2, "idiot"), (n + 2, "idiot"), (n + 3, "river " * 300_000 + "scum")]
    labels += [(n, 1), (None, 0), (n + 2, 0), (n + 2, 1), (n + 1, None)]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"score": F.lit("x"), "y": F.lit(1), "id": F.lit(5)})
    return d, spark.createDataFrame(labels, "doc_id long, toxic int").withColumn("text", F.lit("idiot"))


def test_held_out_rows_are_told_apart(spark):
    docs, labels = _tables(spark)
    model = toxicity.fit(docs, labels)
    assert 0 < len(model.slots) < 2_000
    out = toxicity.scored(docs, model).join(labels.filter("toxic IS NOT NULL").select("doc_id", "toxic"), "doc_id").collect()
    held = [r for r in out if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 and r["doc_id"] < 900]
    wrong = [r for r in held if r["predicted"] != r["toxic"]]
    assert len(held) > 200 and len(wrong) <= len(held) // 50
    again = toxicity.fit(docs, labels)
    assert np.array_equal(model.slots, again.slots) and np.array_equal(model.weights, again.weights) and model.bias == again.bias


def test_every_row_gets_a_score(spark):
    docs, labels = _tables(spark, 300)
    out = toxicity.scored(docs, toxicity.fit(docs, labels))
    assert sorted(out.columns) == ["doc_id", "id", "predicted", "score", "text", "y"] and out.count() == docs.count()
    rows = out.filter("doc_id IS NULL OR doc_id >= 300").collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    empty = {r["score"] for r in rows if not r["text"]}
    assert len(empty) == 1 and empty.pop() < 0.5
    assert all(r["predicted"] == 1 for r in rows if r["text"] and "idiot" in r["text"])


def test_labels_that_teach(spark):
    docs, labels = _tables(spark, 300)
    taught = toxicity.labelled(docs, labels)
    assert taught.count() == sum(zlib.crc32(str(i).encode()) % 3 != 1 for i in range(300))
    assert 0 < toxicity.labelled(docs, labels, sample_rows=60).count() < 100


def test_nothing_to_learn_from(spark):
    docs, labels = _tables(spark, 10)
    model = toxicity.fit(docs, labels.limit(0))
    assert {r["score"] for r in toxicity.scored(docs, model).collect()} == {0.5}
    assert toxicity.scored(docs.limit(0), model).collect() == []
