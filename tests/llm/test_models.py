import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from lattica.llm import itq, langid, suffix_tree

SYLLABLES = {"aa": ["lor", "em", "ips", "um", "dol"], "bb": ["chi", "sch", "ung", "keit", "ver"], "cc": ["eau", "oir", "ment", "que", "ais"]}


def corpus(n=150, seed=1):
    rnd = random.Random(seed)
    out = []
    for k in range(n):
        lang = rnd.choice(list(SYLLABLES))
        words = ["".join(rnd.choice(SYLLABLES[lang]) for _ in range(rnd.randint(1, 3))) for _ in range(rnd.randint(5, 60))]
        out.append((k, " ".join(words), lang, "s"))
    return out


def test_language_of_held_out_texts(spark, docs):
    rows = corpus() + [(900, None, "aa", "s"), (901, "12 !!", "bb", "s"), (902, "", None, None), (None, "ungkeit versch", "bb", None)]
    df = docs(rows)
    got = langid.predicted(df, langid.fit(df)).select("doc_id", "lang", "lang_pred", "score").collect()
    assert len(got) == len(rows)
    held = [r for r in got if r.doc_id is not None and r.doc_id < 900 and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert held and sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held)
    assert {r.lang_pred for r in got if r.doc_id in (900, 901, 902)} == {"und"}
    assert all(0 <= r.score <= 1 for r in got)


def test_no_labels_no_language(spark, docs):
    df = docs([(1, "abc", None, None)])
    assert [r.lang_pred for r in langid.predicted(df, langid.fit(df)).collect()] == ["und"]
    assert langid.predicted(docs([]), langid.fit(df)).count() == 0


def test_filters_return_every_language_of_a_gram():
    table = np.zeros((1 << 12, 1), np.uint64)
    grams = langid.grams(b"some words of text")
    for s in langid.slots(grams, 12):
        table[s] |= np.uint64(3)
    assert (langid.Model(["x", "y"], table, 12).counts(grams) > 0.9 * len(grams)).all()


def test_scores_against_brute_force(spark, docs):
    rows = corpus(120) + [(500, None, None, None), (501, "", None, None), (None, "lor em", None, None), (502, "lor em", None, None), (502, "lor em", None, None)]
    df = suffix_tree.marked(docs(rows))
    got = suffix_tree.scored(df).collect()
    count = Counter()
    for k, t, *_ in rows:
        if k is None or zlib.crc32(str(k).encode()) % 10:
            count.update((t or "").encode().lower().split() + ["end"])
    n, v = sum(count.values()), len(count)
    want = sorted((str(k), len((t or "").split()) + 1, sum(count[w] > 0 for w in [*(t or "").encode().lower().split(), "end"]), round(sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in [*(t or "").encode().lower().split(), "end"]), 6)) for k, t, *_ in rows)
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
    assert all(r.train_tokens == n and r.score < 0 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_more_languages_than_bits_and_rare_ones(spark, docs):
    rnd = random.Random(5)
    parts = {f"l{k}": ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(4)) for _ in range(9)] for k in range(70)}
    rows, k = [], 0
    for lang in parts:
        for _ in range(120 if lang == "l0" else 12):
            rows.append((k, " ".join("".join(rnd.choice(parts[lang]) for _ in range(2)) for _ in range(40)), lang, "s"))
            k += 1
    rows += [(None, rows[0][1], "l0", "s")] * 50 + [(7, rows[0][1], "l0", "s")] * 50
    df = docs(rows)
    model = langid.fit(df, sample_rows=20)
    assert len(model.languages) == 70 and model.table.shape[1] == 2
    got = langid.predicted(df, model).select("doc_id", "lang", "lang_pred", "known", "n_words").collect()
    assert len(got) == len(rows) and all(r.lang == r.lang_pred and r.n_words == "z" for r in got)
    assert all(r.known > 0.1 for r in got)


def test_long_texts_and_repeated_rows_of_language(spark, docs):
    rows = corpus(60) + [(700, "lor em ips um " * 200_000, None, None)] + [(3, "schung keitver", "bb", "s")] * 3
    df = docs(rows)
    got = langid.predicted(df, langid.fit(df)).filter("doc_id = 700 OR text = 'schung keitver'").collect()
    assert sorted(r.lang_pred for r in got) == ["aa", "bb", "bb", "bb"]


def brute_scores(rows):
    """(score of each text) by a tree of dictionaries: every context that is retained, its distribution, and the longest suffix of each place."""
    lines = [(k, b" ".join((t or "").encode().lower().split()) + (b" " if (t or "").split() else b"") + b"\n") for k, t, *_ in rows]
    seen = [Counter() for _ in range(suffix_tree.DEPTH + 1)]
    for k, line in lines:
        if k is None or zlib.crc32(str(k).encode()) % 10:
            line = b"\n" * suffix_tree.DEPTH + line
            for i in range(suffix_tree.DEPTH, len(line)):
                for d in range(suffix_tree.DEPTH + 1):
                    seen[d][line[i - d : i + 1]] += 1
    dists, kept = {}, set()
    for d in range(suffix_tree.DEPTH + 1):
        after = {}
        for gram, n in seen[d].items():
            after.setdefault(gram[:-1], {})[gram[-1]] = n
        for s, ns in after.items():
            c = sum(ns.values())
            if d == 0:
                dists[s] = [(ns.get(x, 0) + 0.1) / (c + 25.6) for x in range(256)]
                continue
            base = dists[s[1:]]
            p = [(max(ns.get(x, 0) - suffix_tree.DISCOUNT, 0) + suffix_tree.DISCOUNT * len(ns) * base[x]) / c for x in range(256)]
            dists[s] = p
            assert abs(sum(p) - 1) < 1e-9
            if sum(a * math.log(a / b) for a, b in zip(p, base, strict=True)) * c >= suffix_tree.GAIN:
                kept.add(s)
    out = []
    for k, line in lines:
        line, total = b"\n" * suffix_tree.DEPTH + line, 0.0
        for i in range(suffix_tree.DEPTH, len(line)):
            d = next((d for d in range(suffix_tree.DEPTH, 0, -1) if line[i - d : i] in kept), 0)
            total += math.log10(dists[line[i - d : i]][line[i]])
        out.append((str(k), total))
    return sorted(out)


def test_text_scores_against_a_tree_of_dictionaries(spark, docs):
    rows = corpus(40) + [(500, None, None, None), (501, "", None, None), (None, "lor em", None, None), (502, "LOR em\n\tzz", None, None), (502, "LOR em\n\tzz", None, None), (503, "é 中文 " * 30, None, None), (504, "ipsum" * 400, None, None)]
    got = suffix_tree.scored(suffix_tree.marked(docs(rows))).collect()
    pairs = zip(sorted((str(r.doc_id), r.score) for r in got), brute_scores(rows), strict=True)
    assert all(a == c and abs(b - d) <= 0.01 for (a, b), (c, d) in pairs)


def test_many_small_blocks_give_the_same_scores(spark, docs, monkeypatch):
    df = suffix_tree.marked(docs(corpus(60))).repartition(3)
    want = {r.doc_id: r.score for r in suffix_tree.scored(df).collect()}
    for name, value in (("CHUNK_BYTES", 300), ("BLOCK_BYTES", 900), ("MOST_BLOCKS", 4)):
        monkeypatch.setattr(suffix_tree, name, value)
    got = {r.doc_id: r.score for r in suffix_tree.scored(df).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 0.01 for k in want)


def test_pieces_and_blocks_do_not_change_scores():
    text = b" ".join(t.encode() for _, t, *_ in corpus(30))
    whole = list(suffix_tree.segments(text))
    old = suffix_tree.CHUNK_BYTES
    suffix_tree.CHUNK_BYTES = 100
    try:
        parts = list(suffix_tree.segments(text))
    finally:
        suffix_tree.CHUNK_BYTES = old
    assert len(whole) == 1 and len(parts) > 10
    both = [suffix_tree.packed(b"".join(p), [len(x) - suffix_tree.DEPTH for x in p]) for p in (whole, parts)]
    assert (both[0] == both[1]).all()


def test_empty_training(spark, docs):
    df = suffix_tree.marked(docs([(1, "a b")])).selectExpr("doc_id", "text", "true AS held_out")
    (r,) = suffix_tree.scored(df).collect()
    assert r.train_tokens == 0 and r.n_known == 0 and r.base_score is None and r.score < 0
    assert suffix_tree.scored(df.limit(0)).collect() == []


def test_keys_grow_with_the_number_of_vectors():
    assert itq.layout(1) == itq.layout(131_072) == (12, 20)
    assert itq.layout(2_000_000)[0] == 16 and itq.layout(10**9)[0] == 25
    for n in (10, 10**6, 10**8):
        bits, tables = itq.layout(n)
        assert (1 - 0.88**bits) ** tables <= 0.008 and n / 2**bits <= 32
    bits = np.random.default_rng(1).random((5, 12, 64)) > 0.5
    assert itq.keys_of(bits, 16, 35).shape == (5, 35)


def test_no_vectors(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert itq.near_duplicates(df).collect() == []


@pytest.mark.parametrize("block", [4, 512])
def test_links_and_recall(spark, block, monkeypatch):
    monkeypatch.setattr(itq, "BLOCK", block)
    rng = np.random.default_rng(2)
    base = rng.normal(size=(60, 32))
    near = base[:30] + rng.normal(size=(30, 32)) * 0.15
    hot = base[0] + rng.normal(size=(25, 32)) * 0.02
    rows = [(i, v.tolist(), i % 2 if i < 60 else (i - 60) % 2 if i < 90 else 0) for i, v in enumerate(np.concatenate([base, near, hot]))]
    rows += [(200, None, 1), (201, [0.0] * 32, 1), (202, [float("nan")] * 32, 1), (203, rows[5][1], rows[5][2]), (204, rows[5][1], None), (205, [None] * 32, 1), (None, rows[7][1], 9), (206, [], 1), (207, [1.0, 2.0], 1)]
    got = {r.vec_id: r for r in itq.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    assert len(got) == len(rows)
    true = Counter()
    ok = [(i, np.float32(v).astype(float), l) for i, v, l in rows if l is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    for a, x, p in ok:
        for b, y, q in ok:
            if a != b and p == q and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.93:
                true[a] += 1
    assert all(got[i].n_links <= true[i] for i in got)
    assert sum(r.n_links for r in got.values()) >= 0.9 * sum(true.values()) > 500
    for i in (200, 201, 202, 204, 205, 206):
        assert got[i].n_links == 0 and got[i].component_id == i and got[i].kept
    assert got[203].component_id == got[5].component_id
