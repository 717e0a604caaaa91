"""run() and its stages on a fixture, against brute force of each stage on its own input."""

import random
import zlib
from collections import Counter

import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from test_line_passages import brute as brute_lines
from test_near_copies import brute as brute_near
from tokenizers import Tokenizer

import corpus_pipeline

SYLLABLES = {"aa": ["lor", "em", "ips", "um", "dol"], "bb": ["chi", "sch", "ung", "keit", "ver"]}
NOTICE = "lorem dolum umips emlor ipsum dolor"
EXTRA = ["score", "known", "n_lines", "component_id", "own_size", "mark", "key", "_text"]


def fixture():
    rnd = random.Random(8)
    word = lambda lang: "".join(rnd.choice(SYLLABLES[lang]) for _ in range(rnd.randint(1, 4)))
    line = lambda lang, n: " ".join(word(lang) for _ in range(n))
    rows = []
    for k in range(90):
        lang = "aa" if k % 3 else "bb"
        rows.append((k, "\n".join(line(lang, 12) for _ in range(rnd.randint(3, 8))), lang))
    for k in range(90, 110):  # near copies: one word of a long line changed
        words = rows[k - 90][1].split(" ")
        words[len(words) // 2] = "ungdol"
        rows.append((k, " ".join(words).replace("\n", " "), rows[k - 90][2]))
    rows += [(110 + k, f"{line('aa', 9)}\n{NOTICE}\n{line('aa', 9)}", "aa") for k in range(5)]
    rows += [(120, None, None), (121, "", "aa"), (122, " 12 !! ", None), (123, NOTICE, "aa"), (124, "zzqj xxkw qqzz wwxx jjqz " * 9, None), (125, rows[4][1], "aa"), (126, line("bb", 5000), "bb")]
    return [(k, t, lang, ["s1", "s2", None][k % 3]) for k, t, lang in rows]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    rows = fixture()
    columns = {"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows], "lang": [r[2] for r in rows], "source": [r[3] for r in rows], "n_chars": [len(r[1]) if r[1] is not None else None for r in rows]}
    path = tmp_path_factory.mktemp("corpus")
    pq.write_table(pa.table(columns | {c: ["x"] * len(rows) for c in EXTRA}), path / "documents.parquet")
    return str(path)


def test_each_stage_on_its_own_input(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    first = corpus_pipeline.language_id(spark, docs, folder)
    kept = {r.doc_id: r.text for r in first.collect()}
    assert first.columns == columns
    assert {r[0] for r in fixture()} - set(kept) == {120, 121, 122, 124}

    second = corpus_pipeline.drop_repeated_lines(spark, first, folder)
    want = {k: (n, gone) for k, n, gone, _ in brute_lines(list(kept.items()), 2, 5)}
    lines = {r.doc_id: r for r in second.collect()}
    assert second.columns == columns
    assert set(lines) == {k for k, (n, gone) in want.items() if gone < n}
    assert 123 not in lines and NOTICE in lines[110].text and not any(NOTICE in lines[k].text for k in range(111, 115))
    assert all(len([x for x in r.text.split("\n") if x.split()]) == want[k][0] - want[k][1] and r.n_chars == len(r.text) for k, r in lines.items())

    third = corpus_pipeline.drop_near_copies(spark, second, folder)
    near = sorted(r.doc_id for r in third.collect())
    assert third.columns == columns
    assert near == brute_near([(k, r.text) for k, r in lines.items()])

    fourth = corpus_pipeline.mix_sources(spark, third, folder)
    taken = Counter((r.doc_id, r.text) for r in fourth.collect())
    assert fourth.columns == columns
    size, sources = {}, {}
    for r in third.collect():
        size[r.doc_id, r.text] = len((r.text or "").split())
        sources[r.doc_id, r.text] = r.source
    by_source = Counter()
    for k, n in size.items():
        by_source[sources[k]] += n
    total, weight, target, left = sum(by_source.values()), {"s1": 5, "s2": 2, None: 1}, {}, set(by_source)
    while True:
        rest = total - sum(target.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in left) for s in left}
        over = {s for s in left if share[s] > 3 * by_source[s]}
        if not over:
            target |= share
            break
        target |= {s: 3 * by_source[s] for s in over}
        left -= over
    for s, aim in target.items():
        words = sum(n * size[k] for k, n in taken.items() if sources[k] == s)
        longest = max(n for k, n in size.items() if sources[k] == s)
        assert abs(words - aim) <= longest and max(taken.values()) <= 3


def test_run_is_its_stages_and_ends_in_ids_of_the_library(spark, folder):
    out = corpus_pipeline.run(spark, folder).collect()
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
    want = Counter((r.doc_id, r.text) for r in docs.collect())
    library = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    library.no_truncation(), library.no_padding()
    assert Counter(r.doc_id for r in out) == Counter(k for k, _ in want.elements())
    texts = {k: t for k, t in want}
    for r in out:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
    assert zlib.crc32(repr(sorted(want)).encode())


def test_empty_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    assert docs.count() == 0


def test_copies_of_one_id_and_null_ids_pass_every_stage(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").filter("doc_id IN (1, 2, 4)").selectExpr("CAST(NULL AS bigint) AS doc_id", "* EXCEPT (doc_id)")
    docs = docs.unionByName(docs).unionByName(spark.read.parquet(f"{folder}/documents.parquet"))
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    assert docs.count() > 0
