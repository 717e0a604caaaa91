import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lattica.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def enc():
    with open(PATH, encoding="utf-8") as f:
        return bpe.encoder(f.read())


def texts():
    rnd = random.Random(5)
    out = ["", "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "a" * 3000, " " * 999, "\x85\xa0\x1c  x", "ab" * 2000]
    out += ["".join(rnd.choice("abetn oris'sllre 12\n\té中😀<|>") for _ in range(rnd.randint(1, 60))) for _ in range(3000)]
    return out + ["".join(chr(rnd.choice([rnd.randint(32, 0x2FF), rnd.randint(0x300, 0xD7FF), rnd.randint(0xE000, 0x1FFFF)])) for _ in range(20)) for _ in range(2000)]


def test_same_ids_as_the_library_and_round_trip(enc):
    lib = Tokenizer.from_file(PATH)
    for text, want in zip(texts(), lib.encode_batch(texts(), add_special_tokens=False), strict=True):
        ids = enc.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == want.ids, repr(text)
        assert enc.decode(ids).decode() == text


def test_short_pieces_need_no_automaton(enc, monkeypatch):
    rnd = random.Random(6)
    pieces = [bytes(rnd.choice(b"aeetnorisl-'_=<") for _ in range(rnd.randint(1, bpe.SHORT))) for _ in range(4000)]
    pieces += [bytes(rnd.randrange(256) for _ in range(rnd.randint(1, bpe.SHORT))) for _ in range(2000)]
    monkeypatch.setattr(enc, "short", 0)
    want = [enc.merged(p) for p in pieces]
    monkeypatch.setattr(enc, "short", bpe.SHORT)
    monkeypatch.setattr(enc, "automaton", None)
    assert [enc.merged(p) for p in pieces] == want


def test_pieces_of_a_group_are_encoded_once_and_together(enc, monkeypatch):
    rnd = random.Random(7)
    words = ["".join(rnd.choice("aeetnorisl'-_=<é中") for _ in range(rnd.randint(1, 12))) for _ in range(3000)]
    group = [" ".join(rnd.choices(words, k=rnd.randint(0, 60))) for _ in range(2000)] + texts()
    apart = [enc.encode(t) for t in group[::7]]
    called = []
    monkeypatch.setattr(enc, "merged", lambda p, f=enc.merged: called.append(p) or f(p))
    together = list(enc.encode_all(group))
    assert together[::7] == apart and [enc.decode(i).decode() for i in together] == group
    assert called and len(called) == len(set(called)) and min(map(len, called)) > bpe.SHORT
    monkeypatch.setattr(bpe, "GROUP_PIECES", 5)
    monkeypatch.setattr(bpe, "GROUP_DISTINCT", 3)
    monkeypatch.setattr(bpe, "BLOCK", 2)
    assert list(enc.encode_all(group[::20])) == together[::20]


def test_arrays_find_pairs_compatible_as_the_chains_of_merges_do(enc):
    rnd = random.Random(8)
    tokens = [t for t in enc.shorter if len(enc.pieces[t]) <= 8]
    merged = list(enc.merges[0])
    pairs = [rnd.choice(merged) for _ in range(3000)] + [(t, t) for t in tokens[:5000]] + [(rnd.choice(tokens), rnd.choice(tokens)) for _ in range(20000)]
    a, b = np.array(pairs, np.int32).T
    want = [not enc._crossed(x, y) for x, y in pairs]
    assert 0 < sum(want) < len(want)
    assert enc._compatible(a, b).tolist() == want
    assert enc._compatible(a, b).tolist() == want


def test_every_character_of_the_basic_plane_is_split_as_the_library_does(enc):
    lib = Tokenizer.from_file(PATH)
    rows = [f"a{c}1 {c}.\n{c} 's{c}{c}" for c in map(chr, [*range(0xD800), *range(0xE000, 0x10000)])]
    for text, ids, want in zip(rows, enc.encode_all(rows), lib.encode_batch(rows, add_special_tokens=False), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == want.ids, repr(text)


def test_query_over_odd_rows(spark, docs, odd):
    rows = bpe.encoded(docs(odd), PATH).collect()
    assert len(rows) == len(odd)
    assert all(r.n_tokens * 4 == len(r.token_ids) for r in rows)
    assert sum(r.n_tokens == 0 for r in rows) == 3
    assert bpe.encoded(docs([]), PATH).count() == 0
