import hashlib
import random
from collections import Counter

from lattica.llm import substring_index


def words_corpus(seed):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)]
    passages = [[rnd.choice(vocab) for _ in range(rnd.randint(3, 25))] for _ in range(8)]
    out = []
    for k in range(80):
        words = []
        for _ in range(rnd.randint(0, 5)):
            words += rnd.choice(passages) if rnd.random() < 0.5 else [rnd.choice(vocab) for _ in range(rnd.randint(1, 20))]
        out.append((k, " ".join(words)))
    return out


def brute_words(rows, window):
    count = Counter(tuple(w[i : i + window]) for _, t in rows for w in [(t or "").encode().split()] for i in range(len(w) - window + 1))
    out = []
    for k, t in rows:
        w = (t or "").encode().split()
        gone = set()
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                gone |= set(range(i, i + window))
        left = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((k, len(w), len(gone), hashlib.sha256(left).hexdigest()))
    return sorted(out, key=str)


def test_substrings_match_brute_force(spark, docs, odd):
    for window, rows in ((8, words_corpus(1)), (3, words_corpus(2)), (12, words_corpus(3)), (35, odd), (2, odd)):
        got = substring_index.without_repeats(docs(rows), window).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
        assert sorted(map(tuple, got), key=str) == brute_words(rows, window)
    assert substring_index.without_repeats(docs([])).count() == 0


def places(df):
    return sorted({(r["doc_id"], r["first"] + j) for r in df.select("doc_id", "first", "count").collect() for j in range(r["count"])})


def test_index_meets_history_and_compacts(spark, docs):
    index = substring_index.Index(spark, fan_in=2)
    text = " ".join(f"x{i}" for i in range(60))
    first, second, third = (substring_index.fingerprints(docs([(k, t)]), 10) for k, t in ((1, text + " 1"), (2, text + " 2"), (3, "other " * 50)))
    assert index.extend(first).count() == 0
    assert {r.doc_id for r in index.extend(second).collect()} == {1, 2}
    again = substring_index.Index(spark, index.path, fan_in=2)
    assert len(again.runs) == 2
    assert {r.doc_id for r in again.extend(third).collect()} == {3}
    assert len(again.runs) == 1 and len(again.prints) == 3
    assert {r.doc_id for r in again.extend(substring_index.fingerprints(docs([(4, text)]), 10)).collect()} == {1, 2, 4}
    again.drop()
    assert again.runs == [] and again.prints == []


def test_batches_added_one_by_one_find_what_a_full_run_finds(spark, docs):
    rows = words_corpus(5)
    whole = docs(rows)
    index, hits = substring_index.Index(spark, fan_in=2), []
    for k in range(4):
        hits.append(index.extend(substring_index.fingerprints(docs([r for i, r in enumerate(rows) if i % 4 == k]), 8)))
    got = places(substring_index.verified(substring_index._union(hits), whole, 8))
    assert got and got == places(substring_index.repeated_windows(whole, 8, batches=1)) == places(substring_index.repeated_windows(whole, 8, batches=3))


def test_texts_outside_the_map_are_left_alone(spark):
    texts = spark.range(500).selectExpr("id", "xxhash64(id) AS mark")
    wanted = texts.filter("id % 7 = 0").selectExpr("mark AS m")
    got = substring_index._marked(texts, wanted).collect()
    assert len(got) == 500 and all(r["_in"] for r in got if r["id"] % 7 == 0)
    assert sum(r["_in"] for r in got) < 80
    assert not any(r["_in"] for r in substring_index._marked(texts, wanted.limit(0)).collect())
