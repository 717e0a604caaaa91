"""Ranked search against scores of every document for every item."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lattica.llm import impact_index

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _terms(text):
    return TERM.findall((text or "").translate(LOWER))


def _expected(docs, items, k):
    held = [(d, Counter(_terms(t))) for d, t in docs]
    held = [(d, c) for d, c in held if c]
    n_docs, length = len(held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, c in held:
            m = 50 + 50 * c.total() * n_docs // length
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in set(_terms(text)) if c[t])
            if s > 0:
                scores.append((-s, d is not None, d or 0))
        out += [(item, i + 1, d if there else None, -s) for i, (s, there, d) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def _ranked(spark, docs, items, k=50, **more):
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"n": F.lit(1), "terms": F.lit("x"), "q": F.lit(2)})
    i = spark.createDataFrame(items, "item_id long, text string").withColumns({"q": F.lit(1), "rank": F.lit("x")})
    return sorted([tuple(r) for r in impact_index.ranked(d, i, k, **more).collect()], key=str)


def _made(n, seed=5):
    pick = random.Random(seed)
    words = ["the", "of", "über", "X1", *[f"w{i}" for i in range(60)]]
    text = lambda: " ".join(pick.choices(words, weights=[30, 20, 5, 5, *[60 / (i + 1) for i in range(60)]], k=pick.randint(1, 40)))
    docs = [(i, text()) for i in range(n)]
    docs += [(n, None), (n + 1, ""), (n + 2, "?!"), (None, docs[0][1]), (0, docs[0][1]), (n + 3, "the " * 5000 + "w7")] + [(n + 10 + i, docs[3][1]) for i in range(30)]
    items = [(i, text()) for i in range(12)] + [(90, None), (91, "--"), (92, "absent"), (93, "THE, the (Of)"), (0, docs[3][1])]
    return docs, items


@pytest.mark.parametrize(("shard", "k"), [(1_000_000, 5), (60, 3), (400, 50)])
def test_ranks_are_those_of_all_scores(spark, shard, k):
    docs, items = _made(150)
    assert _ranked(spark, docs, items, k, postings=shard) == _expected(docs, items, k)


def test_items_in_blocks_and_long_texts_in_pieces(spark, monkeypatch):
    docs, items = _made(40, 9)
    assert _ranked(spark, docs, items, 4, block_terms=25) == _expected(docs, items, 4)
    monkeypatch.setattr(impact_index, "PIECE", 7)
    own, counts = impact_index.term_counts("Ab über-ab AB xyzxyzxyz 1".encode())
    assert dict(zip([t.decode() for t in own], counts.tolist(), strict=True)) == {"ab": 3, "über": 1, "xyzxyzxyz": 1, "1": 1}


def test_stops_before_all_postings_are_read(monkeypatch):
    import numpy as np
    import pyarrow as pa

    n = 5000
    tf = np.where(np.arange(n) % 100 == 7, 1 + np.arange(n), 1)
    rows = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array(np.full(n, 900)), pa.array([[0]] * n, pa.list_(pa.int32())), pa.array([[int(x)] for x in tf])], names=["doc_id", "n", "terms", "tfs"])
    shard, read = impact_index.Shard([rows], np.array([1000]), n, 900 * n), []
    true = np.searchsorted
    monkeypatch.setattr(np, "searchsorted", lambda *a: read.append(len(a[0])) or true(*a))
    best, scores = shard.top(np.array([0], np.int32), 10, int(np.sort(-shard.falling)[-10]))
    assert scores.tolist() == sorted((-shard.falling).tolist(), reverse=True)[:10]
    assert min(read) > n * 0.9


def test_empty_tables(spark):
    docs, items = _made(5)
    assert _ranked(spark, [], items) == [] and _ranked(spark, docs, []) == [] and _ranked(spark, [(1, "..")], items) == []
