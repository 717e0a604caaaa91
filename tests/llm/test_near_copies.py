import random

import pytest

import corpus_pipeline
from lattica.llm import near_copies


def shingle_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def brute(rows):
    """The least id of each component."""
    sets, part = [shingle_set(t) for _, t in rows], list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if part[a] != part[b] and jaccard(sets[a], sets[b]) >= 0.8:
                part = [part[b] if x == part[a] else x for x in part]
    return sorted(min(k for (k, _), p in zip(rows, part, strict=True) if p == q) for q in set(part))


def planted(seed=7):
    """Texts with near copies at similarities on both sides of 0.8, up to 0.99, and one large group of near copies."""
    rnd = random.Random(seed)
    text = lambda n: [f"w{rnd.randrange(5000)}" for _ in range(n)]
    out = []
    for _ in range(30):
        base = text(rnd.randint(60, 400))
        out.append(base)
        for at in (0.7, 0.8, 0.85, 0.9, 0.95, 0.99):
            edits = max(1, round(len(base) * (1 - at) / (1 + at) / 5))
            copy = list(base)
            for i in rnd.sample(range(len(copy)), edits):
                copy[i] = "new" + str(rnd.randrange(10**6))
            out.append(copy)
    hot = text(120)
    for k in range(60):
        copy = list(hot)
        copy[k * 2] = f"hot{k}"
        out.append(copy)
    rnd.shuffle(out)
    return [(k, " ".join(w)) for k, w in enumerate(out)]


@pytest.mark.parametrize("paired", [24, 0])
def test_stage_drops_planted_near_copies(spark, docs, paired, monkeypatch):
    monkeypatch.setattr(near_copies, "PAIRED", paired)
    monkeypatch.setattr(near_copies, "ROUNDS", 2)
    rows = planted()
    got = sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs(rows), "").select("doc_id").collect())
    assert got == brute(rows)
    assert len(got) < len(rows) / 3


EDITS = ("added", "removed", "replaced", "scattered")


def edited(rnd, base, edit, at):
    """``base`` with one passage or some words changed, so that its similarity to the original is near ``at``."""
    new = lambda n: [f"x{rnd.randrange(10**6)}" for _ in range(n)]
    n, copy = len(base) - 4, list(base)
    if edit == "added":
        k = max(1, round((n - 4) / at - n - 4))
        i = rnd.randrange(5, len(base) - 5)
        return copy[:i] + new(k) + copy[i:]
    if edit == "scattered":
        for i in rnd.sample(range(len(copy)), max(1, round(n * (1 - at) / (1 + at) / 5))):
            copy[i] = new(1)[0]
        return copy
    k = max(1, round(n * (1 - at)) - 8) if edit == "removed" else max(1, round(n * (1 - at) / (1 + at)) - 4)
    i = rnd.randrange(5, len(base) - k - 5)
    return copy[:i] + (new(k) if edit == "replaced" else []) + copy[i + k :]


def test_no_kind_of_edit_escapes(spark, docs):
    """Passages added, removed or replaced, and scattered words, at similarities from 0.8 up: each pair of 0.8 or more is found, and no other."""
    rnd, rows, close = random.Random(3), [], {}
    for edit in EDITS:
        for at in (0.79, 0.805, 0.81, 0.83, 0.86, 0.92, 0.97):
            for _ in range(12):
                base = [f"w{rnd.randrange(9000)}" for _ in range(rnd.randint(60, 500))]
                k, copy = len(rows), edited(rnd, base, edit, at)
                rows += [(k, " ".join(base)), (k + 1, " ".join(copy))]
                close[k + 1] = jaccard(shingle_set(rows[k][1]), shingle_set(rows[k + 1][1]))
    assert sum(0.8 <= x < 0.85 for x in close.values()) > 60
    kept = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs(rows), "").select("doc_id").collect()}
    assert kept == {k for k, _ in rows if close.get(k, 0) < 0.8}


def test_odd_rows(spark, docs, odd):
    out = corpus_pipeline.drop_near_copies(spark, docs(odd), "").collect()
    kept = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in out)
    assert sum(not (t or "").strip() for _, _, t in kept) == 1
    assert sum(t == "same words here" for _, _, t in kept) == 1 and sum(t == "other words here" for _, _, t in kept) == 1
    assert corpus_pipeline.drop_near_copies(spark, docs([]), "").count() == 0
