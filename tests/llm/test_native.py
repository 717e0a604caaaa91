import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lattica.llm import mixing, quality


def brute_quality(text):
    text = text or ""
    words = text.encode().split()
    starts = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    count = Counter(starts)
    hit = {p for i, w in enumerate(starts) if count[w] > 1 for p in range(i, i + 8)}
    lines = [x for x in text.encode().split(b"\n") if x.split()]
    return len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


def test_measurements_match_brute_force(spark, docs, odd):
    rnd = random.Random(6)
    rows = odd + [(100 + k, " ".join(rnd.choice(["a", "b|", "c\n", "é#", "dd"]) for _ in range(rnd.randint(0, 60)))) for k in range(80)]
    out = quality.ledger(docs(rows)).select("doc_id", "text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "failures").collect()
    assert len(out) == len(rows)
    for r in out:
        assert tuple(r)[2:7] == brute_quality(r.text), r.text
        assert bool(r.failures & quality.bits(quality.POLICIES["base"])) == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)


def test_ablation_counts(spark):
    rows = spark.createDataFrame([(0,), (1,), (1,), (3,), (4,)], "failures long")
    got = {(r.policy, r.rule): (r.n_rejected, r.n_failed, r.n_kept_without) for r in quality.ablation(rows, {"p": ("few_words", "repeated_windows")}).collect()}
    assert got == {("p", "few_words"): (3, 3, 2), ("p", "repeated_windows"): (3, 1, 0)}


def brute_targets(sizes, weights=(5, 2, 1)):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    total, target, fixed = sum(sizes.values()), {}, set()
    while True:
        left = total - sum(3 * sizes[s] for s in fixed)
        share = sum(weight[s] for s in order if s not in fixed)
        target = {s: 3 * sizes[s] if s in fixed else left * weight[s] / share for s in order}
        over = {s for s in order if s not in fixed and target[s] > 3 * sizes[s]}
        if not over:
            return target
        fixed |= over


def test_targets_and_taken_words(spark, docs):
    rnd = random.Random(8)
    for case in range(4):
        rows = [(k, "w " * rnd.choice([0, 1, 5, 40, 400 if case else 3]), "en", rnd.choice(["b", "a", None, "é", "z", "hot", "hot", "hot"])) for k in range(300)]
        rows += [(7, "w w", "en", "a"), (7, "w w", "en", "a"), (None, "w", "en", "a"), (8, None, "en", "only"), (9, "w " * 9, "en", "tiny")]
        out = mixing.mix(mixing.sized(docs(rows))).collect()
        assert len(out) == len(rows)
        sizes, taken = Counter(), Counter()
        for r in out:
            sizes[r.source] += r.size
            taken[r.source] += r.taken
            assert 0 <= r.taken <= 3 * r.size
        want = brute_targets(dict(sizes))
        for r in out:
            assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert all(abs(taken[s] - want[s]) <= 0.5 for s in sizes)
    again = mixing.mix(mixing.sized(docs(rows).repartition(7))).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, out))


def test_repeated_rows_follow_the_plan(spark, docs):
    df = docs([(k, "w " * (k % 7 + 1), "en", f"s{k % 4}") for k in range(200)])
    out = mixing.repeated(df)
    assert out.columns == df.columns
    words = out.groupBy("source").agg(F.sum(F.size(F.split(F.trim("text"), " "))).alias("n")).collect()
    aims = {r.source: r.target for r in mixing.mix(mixing.sized(df)).select("source", "target").distinct().collect()}
    assert all(abs(r.n - aims[r.source]) <= 7 for r in words)


def test_empty_tables(spark, docs):
    assert mixing.mix(mixing.sized(docs([]))).count() == 0
    assert mixing.repeated(docs([])).count() == 0
    assert quality.ledger(docs([])).count() == 0
    assert mixing.mix(mixing.sized(docs([(1, "", "en", "a"), (2, None, "en", None)]))).agg(F.sum("taken")).first()[0] == 0
