import hashlib
import random

import pytest
from pyspark.sql import functions as F

from lattica.llm import line_dedup


def brute(rows, window, passage):
    """(doc_id, lines, removed lines, digest of the rest) of texts without later repeats."""
    places = {}
    for k, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        lines = [x for x in (t or "").encode().split(b"\n") if x.split()]
        for size in {1, window} if passage else {window}:
            for i in range(len(lines) - size + 1):
                if size < window and len(lines[i].split()) < passage:
                    continue
                places.setdefault(tuple(lines[i : i + size]), []).append((k, i))
    later, stays, alone = set(), set(), set()
    for run, where in places.items():
        if len(run) == 1:
            alone |= set(where[1:])
        elif len(where) > 1:
            stays |= {(where[0][0], where[0][1] + j) for j in range(len(run))}
            later |= {(k, i + j) for k, i in where[1:] for j in range(len(run))}
    gone, out = later - stays | alone, []
    for k, t in rows:
        kept, at = [], 0
        for line in (t or "").encode().split(b"\n"):
            if not line.split() or (k, at) not in gone:
                kept.append(line)
            at += bool(line.split())
        out.append((k, at, sum(a == k for a, _ in gone), hashlib.sha256(b"\n".join(kept)).hexdigest()))
    return sorted(out, key=str)


def results(df):
    return sorted(map(tuple, df.select("doc_id", "n_lines", "n_removed_lines", "kept_sha256").collect()), key=str)


@pytest.mark.parametrize(("window", "passage"), [(1, None), (2, None), (3, None), (2, 5), (3, 4)])
def test_lines_match_brute_force(spark, docs, window, passage):
    rnd = random.Random(4)
    lines = ["a b c d e", "f g h i j k", "l m n o", "p", "q", "r s t u", "", " ", "v w", "x y z 1 2 3 4"]
    rows = [(k, "\n".join(rnd.choice([*lines, f"own line number {k} of {j} words"]) for j in range(rnd.randint(0, 12)))) for k in range(60)] + [(99, None)]
    assert results(line_dedup.deduplicated(docs(rows), window, passage=passage)) == brute(rows, window, passage)


def test_the_earliest_copy_stays_where_a_later_one_overlaps_it(spark, docs):
    rows = [(1, "a\na\na"), (2, "q\nq\nq\nq"), (3, "x\ny"), (4, "x\ny\nz"), (5, "y\nz")]
    got = {r.doc_id: r.text for r in line_dedup.deduplicated(docs(rows)).collect()}
    assert got == {1: "a\na", 2: "q\nq", 3: "x\ny", 4: "y\nz", 5: ""}


def test_lines_of_odd_rows(spark, docs, odd):
    out = line_dedup.deduplicated(docs(odd))
    assert out.count() == len(odd) and out.filter("text IS NULL").count() == 2
    assert out.filter("text = 'same words here'").count() == 2
    assert line_dedup.deduplicated(docs([])).count() == 0


def test_columns_of_any_name_pass(spark):
    df = spark.createDataFrame([(1, "a b c d e f\nx"), (2, "a b c d e f\ny")], "doc_id long, text string")
    df = df.withColumns({c: F.lit(7) for c in ("_text", "_runs", "_d", "_m", "_mark", "_id", "c0", "n_lines")})
    out = line_dedup.deduplicated(df)
    assert out.columns == [*[c for c in df.columns if c != "n_lines"], "n_lines", "n_removed_lines", "kept_sha256"]
    assert sorted((r.text, r._runs, r.c0, r.n_lines) for r in out.collect()) == [("a b c d e f\nx", 7, 7, 2), ("y", 7, 7, 2)]


def test_batches_of_long_texts():
    text = b"\n".join(b"line %d of some words here" % (k % 900) for k in range(20_000))
    found = list(line_dedup.winnowed([text, b"", text[:5000]], 2, 5))
    assert sum(len(f[2]) for f in found if f[1] == 1) == 20_000 + sum(len(x.split()) >= 5 for x in text[:5000].split(b"\n"))
    for _, size, fp, _, windows, bounds in found:
        assert len(fp) == len(bounds) - 1 and bounds[-1] == len(windows) and (size == 1 or (bounds[1:] - bounds[:-1] <= 2).all())
