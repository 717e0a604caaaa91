import numpy as np
import xxhash

from lattica.llm import near_copies


def test_bitmaps_differ_in_no_more_bits_than_sets_in_shingles():
    rng = np.random.default_rng(3)
    for n in (4, 30, 150, 2000):
        a = np.unique(rng.integers(0, 1 << 63, n, np.uint64))
        for changed in (0, 1, n // 4, n):
            b = np.unique(np.concatenate((a[changed:], rng.integers(0, 1 << 63, changed, np.uint64))))
            apart = int(np.bitwise_count((near_copies.parity_map(a) ^ near_copies.parity_map(b)).view(np.uint64)).sum())
            assert apart <= len(np.setxor1d(a, b))
            if changed == n // 4 and n == 150:
                assert apart > (len(a) + len(b)) / 9


def test_shingles_are_those_of_the_words():
    words = [b"a", b"b", b"a", b"b", b"a", b"b", b"c"]
    hashes = near_copies._words(b" ".join(words).upper())
    assert (hashes == np.array([xxhash.xxh64_intdigest(w, 1) for w in words], np.uint64)).all()
    assert len(near_copies.shingles(hashes, 5)) == len({tuple(words[i : i + 5]) for i in range(3)})
    assert len(near_copies.shingles(hashes[:3], 5)) == 1 and len(near_copies.shingles(hashes[:0], 5)) == 0
