import random

import xxhash
from pyspark.sql import functions as F

from lattica.llm import simhash


def brute(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if hashes and 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_match_definition(odd):
    texts = [t for _, t in odd if t is None or len(t) < 1000] + ["A b C d", "x", "x y"]
    assert simhash.fingerprints_of([(t or "").encode() for t in texts]).tolist() == [brute(t) for t in texts]


def test_masks_cover_every_pair_of_positions():
    for radius in (2, 4):
        masks = simhash.covering_masks(radius)
        assert len(masks) == 2 ** (radius + 1) - 1
        rnd = random.Random(radius)
        for _ in range(3000):
            diff = sum(1 << i for i in rnd.sample(range(64), radius))
            assert any(not m & diff for m in masks)


def test_masks_of_half_a_fingerprint_are_of_equal_size():
    masks = simhash.covering_masks(5, bits=32)
    assert len(masks) == 63 and sorted(m.bit_count() for m in masks) == [16] * 62 + [32]
    rnd = random.Random(5)
    for _ in range(3000):
        diff = sum(1 << i for i in rnd.sample(range(32), 5))
        assert any(not m & diff for m in masks)


def test_components_match_brute_force_with_a_hot_bucket(spark):
    rnd = random.Random(3)
    base = [rnd.getrandbits(64) for _ in range(40)]
    prints = [b ^ sum(1 << i for i in rnd.sample(range(64), rnd.randint(0, 3))) for b in base for _ in range(5)]
    prints += [base[0] ^ 1 << i ^ 1 << j for i in range(0, 30, 3) for j in range(1, 40, 3)]
    rows = [(k, simhash._signed(p)) for k, p in enumerate(prints)]
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, fp long")).collect()}
    want = list(range(len(prints)))
    moved = True
    while moved:
        moved = False
        for a in range(len(prints)):
            for b in range(a):
                if (prints[a] ^ prints[b]).bit_count() <= 2 and want[a] != want[b]:
                    want[a] = want[b] = min(want[a], want[b])
                    moved = True
    assert got == dict(enumerate(want))


def test_one_document_stays_of_each_group(spark, docs, odd):
    out = simhash.deduplicated(docs(odd)).collect()
    kept = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in out)
    assert (False, 1, "") in kept and sum(not (t or "").strip() for _, _, t in kept) == 1
    assert sum(t == "same words here" for _, _, t in kept) == 1
    assert simhash.deduplicated(docs([])).count() == 0
    assert simhash.fingerprinted(docs(odd)).filter(F.col("fp") == 0).count() == 5


def test_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, "a b c"), (3, "x y z w")], "doc_id long, text string").withColumns({c: F.lit(5) for c in ("component_id", "component", "_mark", "_text", "mark", "id", "c0")})
    out = simhash.deduplicated(df)
    assert out.columns == df.columns and sorted((r.doc_id, r.component_id, r._mark) for r in out.collect()) == [(1, 5, 5), (3, 5, 5)]
    got = simhash.near_duplicates(simhash.fingerprinted(df)).collect()
    assert sorted((r.doc_id, r.component_id, r.c0) for r in got) == [(1, 1, 5), (2, 1, 5), (3, 3, 5)]
