"""The Merkle manifest against a plain recursion."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from lattica.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def _h(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


def _leaf(row, text) -> str:
    values = [*row[:4], text]
    return _h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def _tree(hs: list[str]) -> tuple[str, list[list[str]]]:
    """Root, and the siblings of each leaf, level by level, as (before, after)."""
    paths, at = [[] for _ in hs], list(range(len(hs)))
    while len(hs) > 1:
        for j, i in enumerate(at):
            run = i // 3 * 3
            paths[j].append(("".join(hs[run:i]), "".join(hs[i + 1 : run + 3])))
            at[j] = i // 3
        hs = [_h("".join(hs[k : k + 3])) for k in range(0, len(hs), 3)]
    return hs[0], paths


def _expected(rows):
    by: dict = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    roots, out = {}, []
    for s in order:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, _leaf(r, r[4])))
        roots[s] = _tree([_leaf(r, r[4]) for r in by[s]])
    root, over = _tree([roots[s][0] for s in order])
    for s, above in zip(order, over, strict=True):
        for r, path in zip(by[s], roots[s][1], strict=True):
            leaf, full = _leaf(r, r[4]), path + above
            even = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            now = _leaf(r, r[4].replace("\n", "") if even and r[4] is not None else r[4])
            for a, b in full:
                now = _h(a + now + b)
            out.append((r[0], leaf, roots[s][0], root, _h("".join(a + b for a, b in full)), now, now == root))
    return sorted(out, key=str)


def _manifest(docs, **more):
    now = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))
    values = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    return merkle.manifest(docs.select("doc_id", "source", merkle.digest(*values, F.col("text")).alias("leaf"), merkle.digest(*values, now).alias("claim")), **more)


def _rows(n, seed=1):
    pick = random.Random(seed)
    return [(pick.choice([None, i, i, i, i]), pick.choice(["a", "b", "é", "", None, "a"]), pick.choice(["en", None]), pick.choice([None, 5]), pick.choice([None, "", "x\ny", f"t{i}\n", "ü" * 50])) for i in range(n)]


@pytest.mark.parametrize(("levels", "n"), [(7, 1), (7, 60), (1, 60), (2, 200)])
def test_manifest_is_the_plain_tree(spark, levels, n):
    rows = _rows(n)
    rows += rows[:2]
    found = [tuple(r) for r in _manifest(spark.createDataFrame(rows, SCHEMA), most=levels).drop("source").collect()]
    assert sorted(found, key=str) == _expected(rows)


def test_proofs_lead_to_the_root(spark):
    docs = spark.createDataFrame(_rows(50, 3), SCHEMA).withColumns({"key": F.lit(1), "i": F.lit("x"), "root": F.lit(0), "block": F.lit(0)})
    for r in _manifest(docs, keep_proofs=True).collect():
        now = r["leaf"]
        for p in r["proof"]:
            now = _h(p["before"] + now + p["after"])
        assert now == r["root"]
        assert r["proof_sha256"] == _h("".join(p["before"] + p["after"] for p in r["proof"]))
        assert r["verified"] == (r["folded_root"] == r["root"])


def test_empty_table_and_null_claim(spark):
    assert _manifest(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = spark.createDataFrame([(1, "a", _h("x"), None)], "doc_id long, source string, leaf string, claim string")
    [r] = merkle.manifest(rows).collect()
    assert (r["root"], r["folded_root"], r["verified"]) == (_h("x"), None, False)
