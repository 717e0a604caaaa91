import pytest
from pyspark.sql import functions as F

from lattica.functions import files, text
from lattica.operators import extract, refine, search
from lattica.plans import derived
from lattica.sources import readers
from lattica.streaming import events


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()], F.lit(0).alias("_z"))
    return row.select(column.alias("x")).first()["x"]


def test_html(spark):
    html = "<html><title> A &amp; B </title><script>x<1</script><body>one&nbsp;<b>two</b> &amp;lt; <!-- c --></body></html>"
    assert one(spark, text.html_title(F.col("h")), h=html) == "A &amp; B"
    assert one(spark, text.html_text(F.col("h")), h=html) == "A & B one two <"
    assert one(spark, text.html_title(F.col("h")), h="none") is None


def js_hash(q):
    h = 0
    for c in q.strip().lower():
        h = (h * 31 + ord(c) + 2**31) % 2**32 - 2**31
    n, out = abs(h), ""
    while n:
        n, d = divmod(n, 36)
        out = "0123456789abcdefghijklmnopqrstuvwxyz"[d] + out
    return "q_" + (out or "0")


def test_keys_and_slugs(spark):
    for q in ("What is this?", " a ", "x" * 50):
        assert one(spark, text.cache_key(F.col("q")), q=q) == js_hash(q)
    assert one(spark, text.path_slug(F.col("p")), p="src/a.py") == "src_a_py"
    assert one(spark, text.question_slug(F.col("p")), p="How does X work??") == "how-does-x-work"
    assert one(spark, text.sanitized_label(F.col("p")), p="<a>\x01'&") == "&lt;a&gt;&#39;&amp;"
    assert one(spark, text.next_version(F.col("p")), p="v9") == "v10"
    assert one(spark, text.substring_difference(F.col("a"), F.col("b")), a="abcd", b="abxy") == 2
    assert one(spark, text.section_header(F.col("k")), k="class") == "Class" and one(spark, text.section_header(F.col("k")), k="entity") == "Entitys"


def test_tokens(spark):
    assert one(spark, text.tokens(F.col("t")), t="12345") == 2
    assert one(spark, text.class_tokens(F.col("t")), t="hello world") == 2 + 2 + 3
    assert one(spark, text.class_tokens(F.col("t")), t="") == 0


@pytest.mark.parametrize("url,bad", [("https://example.org/x", None), ("ftp://a", "protocol"), ("http://localhost:1/", "localhost"), ("http://10.1.2.3/", "private"), ("http://172.20.0.1", "private"), ("http://172.40.0.1", None), ("http://169.254.169.254/", "metadata"), ("nonsense", "invalid")])
def test_urls(spark, url, bad):
    assert one(spark, files.url_problem(F.col("u")), u=url) == bad


def test_globs(spark):
    for path, pattern, want in (("dist/a.js", "dist/", True), ("a/dist/b", "dist/", True), ("a/b.md", "**/*.md", True), ("b.md", "**/*.md", True), ("a/b.md", "a/*.txt", False), ("src/x/y.ts", "src/**", True)):
        assert one(spark, files.ignored(F.col("p"), [pattern]), p=path) is want, (path, pattern)
    assert files.ignore_patterns(["# c", "", " a ", "a"]) == ["a"]


def test_markdown(spark):
    doc = "---\ntitle: My Doc\n---\n# One\n\n## Two\n[[other page|x]] [l](local/f.md) [w](http://x)\n"
    rows = extract.markdown(spark.createDataFrame([("docs/a.md", doc)], "file string, text string")).collect()
    assert {(r.id, r.label) for r in rows if r.kind == "node"} == {("docs_a_md", "My Doc"), ("docs_a_md-h0", "One"), ("docs_a_md-h1", "Two")}
    assert {(r.target, r.relation, r.weight) for r in rows if r.kind == "edge"} == {("docs_a_md-h0", "defines", 1.0), ("docs_a_md-h1", "defines", 1.0), ("other_page", "references", 0.8), ("local_f_md", "references", 0.6)}


def test_code(spark):
    src = "import os\nclass A(B):\n    def go(self):\n        return run()\ndef run():\n    return 1\n"
    rows = extract.code(spark.createDataFrame([("m.py", src), ("bad.py", "def ("), ("x.go", "func Main() {}\n")], "file string, text string")).collect()
    nodes = {(r.file, r.label, r.type) for r in rows if r.kind == "node"}
    assert {("m.py", "A", "class"), ("m.py", "go", "function"), ("m.py", "run", "function"), ("m.py", "m.py", "module"), ("bad.py", "bad.py", "module"), ("x.go", "x.go", "module"), ("x.go", "Main", "function")} == nodes
    edges = {(r.relation, r.target) for r in rows if r.kind == "edge" and r.file == "m.py"}
    run = next(r.id for r in rows if r.label == "run")
    assert {("imports", "os"), ("extends", "B"), ("calls", run)} <= edges


def test_router(spark):
    from tests.test_graph import graph

    g = graph(spark)
    none = spark.createDataFrame([], "community int, summary string"), spark.createDataFrame([], "id string, content string")
    assert search.route(g, "How many nodes are there?", None, *none, None)["answer"] == "The graph contains 5 nodes."
    assert search.route(g, "why?", "report text", *none, lambda p, most: ("because", 10))["tier"] == 1
    assert search.route(g, "why?", None, *none, lambda p, most: ("because", 10))["tier"] == 4


def test_gates(spark):
    s = lambda *xs: spark.createDataFrame([(i, float(x)) for i, x in enumerate(xs)], "ord long, score double")
    assert refine.gate(s(0.8), s(0.75)).first()["passed"] is True
    assert refine.gate(s(0.9), s(0.7)).first()["passed"] is False
    assert refine.gate(s(0.9), s()).first()["passed"] is False
    assert refine.improvement(s(0.1, 0.5), s(0.3, 0.4)).first()["better"] == 1


def test_streams_match_batches(spark, tmp_path):
    rows = [(i, i // 3, ["view", "error", "error", "error"][i % 4], f"2024-01-01 00:{i % 60:02d}:00") for i in range(40)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, ts string").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = events.debounced(stream, "2 minutes", "1 minute").writeStream.outputMode("append").format("memory").queryName("sessions").trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = {tuple(r) for r in events.debounced(df, "2 minutes").collect()}
    got = {tuple(r) for r in spark.table("sessions").collect()}
    assert got and got <= batch
    seen = []
    events.apply_changes(spark, stream, lambda b, i: seen.append(b.count()), str(tmp_path / "cp")).awaitTermination(120)
    assert sum(seen) == 40


def test_code_over_the_limit(spark, monkeypatch):
    monkeypatch.setattr(extract, "CHUNK", 1000)
    n = 30_000
    files = spark.createDataFrame([("m.py", "class A(B):\n" + "".join(f"    def part{i}(self):\n        return 1\n" for i in range(n)))], "file string, text string")
    assert files.select(F.octet_length("text")).first()[0] > extract.MAX_BYTES
    assert extract.code(files).count() == 0
    rows = extract.code(files, most=None).filter("type = 'function'").select("id", "label").collect()
    assert {(r.id, r.label) for r in rows} == {(f"m_py-n{i + 2}", f"part{i}") for i in range(n)}
    assert extract.corpus_graph(files, most=None).nodes.count() == n + 2


def test_a_file_written_in_parts(spark, tmp_path, monkeypatch):
    """Sources of about 300, 40 and 6 kB in parts of 10 kB: a part within the limit does not make a file of a source above it."""
    rows = [(i, "x" * 99, "abc"[i % 3] if i < 180 else "a" if i < 3000 else "b") for i in range(3300)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(derived, "PART", 10_000, raising=False)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        base = derived._written(spark, str(tmp_path))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r["length"] for r in spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base).select("length").collect()]
    assert sum(sizes) == 2 * 330_000 and max(sizes) < 200_000
    found = {r.file: (r.size, len(r.text)) for r in readers.files(spark, base, ["folder=dist/"], most=50_000, parts=True).collect()}
    assert found == {"folder=src/source=from_b": (36_000, 36_000), "folder=src/source=from_c": (6_000, 6_000)}
