"""Nodes and edges from source code, markdown and model answers."""

from __future__ import annotations

import ast
import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions.files import extractor, language
from lattica.functions.text import path_slug
from lattica.model import Graph

MAX_BYTES = 1 << 20
#: Rows that a task hands on at once.
CHUNK = 20_000
OUT = "file string, kind string, id string, label string, type string, source string, target string, relation string, weight double, content string, ord long"

#: Declarations of languages without a parser here: (type, pattern with the name as its group).
DECLARED = (
    ("class", r"^\s*(?:export\s+)?(?:public\s+|abstract\s+|final\s+)*class\s+(\w+)"),
    ("interface", r"^\s*(?:export\s+)?(?:public\s+)?(?:interface|trait)\s+(\w+)"),
    ("type", r"^\s*(?:export\s+)?(?:type|enum|struct)\s+(\w+)"),
    ("function", r"^\s*(?:export\s+)?(?:async\s+)?(?:function|func|fn|def)\s+(?:\([^)]*\)\s*)?(\w+)"),
    ("function", r"^(\w+)\s*\(\)\s*\{"),
)


#: Fixed value: the form of the request.
PROMPT = """# Extract Knowledge Graph

Source: `%s`
Output: `%s`

Read the source file and extract a knowledge graph as JSON:

```json
{
  "nodes": [{ "id": "...", "type": "concept|entity|rationale", "label": "...", "source": "%s" }],
  "edges": [{ "id": "...", "source": "...", "target": "...", "label": "related_to|depends_on" }]
}
```

Write the JSON to `%s`.
"""


class _Visitor(ast.NodeVisitor):
    def __init__(self, doc: str):
        self.doc, self.n, self.rows, self.owner, self.names = doc, 0, [], [f"{doc}-n0"], {}

    def node(self, label: str, kind: str) -> str:
        self.n += 1
        own = f"{self.doc}-n{self.n}"
        self.rows.append(("node", own, label, kind, None, None, None, None, None))
        self.edge(self.owner[-1], own, "defines")
        self.names.setdefault(label, own)
        return own

    def edge(self, source: str, target: str, relation: str) -> None:
        self.rows.append(("edge", f"{source}-{relation}-{target}", None, None, source, target, relation, 1.0, None))

    def inside(self, own: str, item) -> None:
        self.owner.append(own)
        self.generic_visit(item)
        self.owner.pop()

    def visit_ClassDef(self, item):
        own = self.node(item.name, "class")
        for base in item.bases:
            if isinstance(base, ast.Name):
                self.edge(own, base.id, "extends")
        self.inside(own, item)

    def visit_FunctionDef(self, item):
        self.inside(self.node(item.name, "function"), item)

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_Import(self, item):
        for name in item.names:
            self.edge(self.owner[-1], name.name.split(".")[-1], "imports")

    def visit_ImportFrom(self, item):
        for name in item.names:
            self.edge(self.owner[-1], name.name, "imports")

    def visit_Call(self, item):
        called = item.func
        name = called.id if isinstance(called, ast.Name) else called.attr if isinstance(called, ast.Attribute) else None
        if name:
            self.edge(self.owner[-1], name, "calls")
        self.generic_visit(item)


def parsed_code(path: str, text: str, lang: str | None) -> list[tuple]:
    """Rows of one file: its module, declarations, and edges for what they define, import, call and extend. An end that is a name
    declared in the file becomes its id. A file that does not parse gives its module with the whole text."""
    doc = re.sub("[^A-Za-z0-9]", "_", path)
    module = lambda content: ("node", f"{doc}-n0", path.rsplit("/", 1)[-1], "module", None, None, None, None, content)
    visitor = _Visitor(doc)
    if lang == "Python":
        try:
            visitor.visit(ast.parse(text))
        except (SyntaxError, ValueError, RecursionError):
            return [("node", f"{path}-module", path.rsplit("/", 1)[-1], "module", None, None, None, None, text)]
    elif lang is not None:
        for line in text.splitlines():
            for kind, pattern in DECLARED:
                if m := re.match(pattern, line):
                    visitor.node(m[1], kind)
                    break
            if m := re.match(r"""^\s*(?:import|from|use|require)\b.*?["'<]?([\w./-]+)["'>]?;?\s*$""", line):
                visitor.edge(f"{doc}-n0", re.split(r"[/.]", m[1].strip("\"'"))[-1], "imports")
    else:
        return [("node", f"{path}-module", path.rsplit("/", 1)[-1], "module", None, None, None, None, text)]
    known = visitor.names
    rows = [r if r[0] == "node" else (r[0], f"{r[4]}-{r[6]}-{known.get(r[5], r[5])}", None, None, r[4], known.get(r[5], r[5]), r[6], r[7], None) for r in visitor.rows]
    return [module(text[:200]), *rows]


def code(files: DataFrame, most: int | None = MAX_BYTES) -> DataFrame:
    """Rows (OUT) of files (file, text) that have a language here; files over ``most`` bytes (None: no limit) are left out."""
    fits = F.lit(True) if most is None else F.octet_length("text") <= most
    rows = files.filter(fits & (extractor(F.col("file")) == "ast")).select("file", "text", language(F.col("file")).alias("lang"))

    def run(batches):
        import pandas as pd

        names = ["kind", "id", "label", "type", "source", "target", "relation", "weight", "content"]
        table = lambda out: pd.DataFrame(out, columns=["file", *names, "ord"]).astype({"weight": "float64"})
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                for i, row in enumerate(parsed_code(r.file, r.text or "", r.lang)):
                    out.append((r.file, *row, i))
                    if len(out) == CHUNK:
                        yield table(out)
                        out = []
            yield table(out)

    return rows.mapInPandas(run, OUT)


def front_matter(text):
    """(block, body) columns of a markdown text."""
    block = F.regexp_extract(text, r"(?s)\A---\r?\n(.*?)\r?\n---\r?\n?", 1)
    return block, F.regexp_replace(text, r"(?s)\A---\r?\n.*?\r?\n---\r?\n?", "")


def front_values(block):
    """The front matter's values by name, of lines ``name: value``, without quotes; the first of a name counts."""
    line = F.lit(r"(?m)^([\w-]+):[ \t]*(.*?)[ \t\r]*$")
    names, values = F.regexp_extract_all(block, line, F.lit(1)), F.regexp_extract_all(block, line, F.lit(2))
    plain = F.transform(values, lambda v: F.regexp_replace(v, r"^(['\"])(.*)\1$", "$2"))
    pairs = F.filter(F.arrays_zip(names.alias("k"), plain.alias("v")), lambda x: x["k"].isNotNull())
    return F.map_from_entries(F.filter(pairs, lambda x, i: F.array_position(names, x["k"]) == i + 1))


def with_front(values, body):
    """A text that begins with the values of a map, in order of their names."""
    lines = F.transform(F.array_sort(F.map_entries(values)), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return F.concat(F.lit("---\n"), F.array_join(lines, "\n"), F.lit("\n---\n"), body)


def markdown(files: DataFrame) -> DataFrame:
    """(file, kind, id, label, source, target, relation, weight, type, properties, provenance) of markdown files (file, text): a node for the
    document (title of the front matter or file name; the front matter and the first 500 characters as properties), one for each
    heading, and edges for headings, wiki links and local links."""
    block, body = front_matter(F.col("text"))
    base = files.select("file", path_slug(F.col("file")).alias("doc"), block.alias("block"), body.alias("body"))
    base = base.withColumn("front", front_values(F.col("block"))).withColumn("title", F.coalesce(F.try_element_at("front", F.lit("title")), F.regexp_extract("file", r"([^/]*)$", 1)))
    none, nothing = F.lit(None).cast("string"), F.lit(None).cast("map<string,string>")
    own = F.map_concat(F.map_filter("front", lambda k, _: k != "content"), F.create_map(F.lit("content"), F.substring("body", 1, 500)))
    shape = lambda rows, kind, id, label, source, target, relation, weight, type, properties: rows.select(
        "file", F.lit(kind).alias("kind"), id.alias("id"), label.alias("label"), source.alias("source"), target.alias("target"), relation.alias("relation"),
        F.lit(weight).cast("double").alias("weight"), type.alias("type"), properties.alias("properties"), F.array("file").alias("provenance"),
    )
    node = shape(base, "node", F.col("doc"), F.col("title"), none, none, none, None, F.lit("document"), own)
    heads = base.select("file", "doc", F.posexplode(F.regexp_extract_all("body", F.lit(r"(?m)^#{1,6}\s+.+$"), F.lit(0))).alias("i", "line"))
    heads = heads.withColumn("own", F.concat("doc", F.lit("-h"), F.col("i").cast("string")))
    level, head = F.length(F.regexp_extract("line", "^(#+)", 1)).cast("string"), F.trim(F.regexp_extract("line", r"^#{1,6}\s+(.+)$", 1))
    head_nodes = shape(heads, "node", F.col("own"), head, none, none, none, None, F.lit("concept"), F.create_map(F.lit("level"), level, F.lit("source"), F.col("file")))

    def edges(rows, target, relation, weight):
        return shape(rows, "edge", F.concat_ws("-", "doc", F.lit(relation), target), none, F.col("doc"), target, F.lit(relation), weight, none, nothing)

    wiki = base.select("file", "doc", F.explode(F.regexp_extract_all("body", F.lit(r"\[\[([^\]]+)\]\]"), F.lit(1))).alias("t"))
    local = base.select("file", "doc", F.explode(F.regexp_extract_all("body", F.lit(r"\[[^\]]+\]\(([^)]+)\)"), F.lit(1))).alias("t")).filter(~F.col("t").startswith("http"))
    aim = path_slug(F.trim(F.split("t", r"\|")[0]))
    return node.unionByName(head_nodes).unionByName(edges(heads, F.col("own"), "defines", 1.0)).unionByName(edges(wiki, aim, "references", 0.8)).unionByName(edges(local, path_slug(F.col("t")), "references", 0.6))


def corpus_graph(files: DataFrame, most: int | None = MAX_BYTES) -> Graph:
    """The graph of a corpus (file, text): code (files of up to ``most`` bytes) and markdown, every row with the file it comes from; the first of an id wins."""
    parts = code(files, most).withColumns({"properties": F.when(F.col("content").isNotNull(), F.create_map(F.lit("content"), F.col("content"))), "provenance": F.array("file")})
    rows = parts.unionByName(markdown(files.filter(extractor(F.col("file")) == "frontmatter")).withColumn("ord", F.lit(0).cast("bigint")), allowMissingColumns=True)
    order = F.struct("file", "ord", "id")
    one = lambda kind, *columns: rows.filter(F.col("kind") == kind).groupBy("id").agg(F.min_by(F.struct(*columns), order).alias("r")).select("id", "r.*")
    place = F.xxhash64("id")
    nodes = one("node", F.col("file").alias("source_file"), "label", "type", "properties", "provenance").withColumn("ord", place)
    edges = one("edge", "source", "target", "weight", F.col("relation").alias("label"), "provenance").withColumn("ord", place)
    return Graph(nodes, edges)


def answer_rows(answers: DataFrame) -> DataFrame:
    """(hash, doc, nodes, edges, problems) of model answers (hash, answer): parsed, checked strictly, the first problem only. An answer that is no JSON has the
    problem ``json``."""
    item = "id string, label string, type string, confidence string"
    schema = f"id string, nodes array<struct<{item.replace(' string', ':string')}>>, edges array<struct<source:string,target:string,label:string,confidence:string>>"
    out = answers.withColumn("doc", F.from_json("answer", schema))
    rows = out.select("hash", F.col("doc.id").alias("doc"), F.col("doc.nodes").alias("nodes"), F.col("doc.edges").alias("edges"), (F.col("doc").isNull() | F.get_json_object("answer", "$").isNull()).alias("odd"))
    blank = lambda x: F.coalesce(F.trim(x), F.lit("")) == ""
    bad_node = F.exists("nodes", lambda n: blank(n["id"]) | blank(n["type"]) | n["label"].isNull())
    bad_edge = F.exists("edges", lambda e: blank(e["source"]) | blank(e["target"]) | blank(e["label"]))
    first = F.when(F.col("odd"), "json").when(blank(F.col("doc")), "id").when(F.col("nodes").isNull() | bad_node, "nodes").when(F.col("edges").isNull() | bad_edge, "edges")
    return rows.select("hash", "doc", "nodes", "edges", first.alias("problem"))


def prompts(files: DataFrame, folder: str) -> DataFrame:
    """(file, path, prompt): what a model is asked to extract from each file that no parser here reads, and where its answer goes."""
    slug = F.regexp_replace(F.regexp_extract("file", r"([^/]*)$", 1), "[^a-zA-Z0-9._-]", "_")
    rows = files.filter(extractor(F.col("file")) == "model_native").select("file", F.concat(F.lit(f"{folder}/"), slug, F.lit(".prompt.md")).alias("path"), F.concat(F.lit(f"{folder}/"), slug, F.lit(".result.json")).alias("result"))
    text = F.format_string(PROMPT, "file", "result", "file", "result")
    return rows.select("file", "path", text.alias("prompt"))


def skill_sections(files: DataFrame) -> DataFrame:
    """(file, heading, body): sections under headings of three levels at most, outside code fences; of equal headings the last counts."""
    block, body = front_matter(F.col("text"))
    lines = files.select("file", F.posexplode(F.split(body, "\n")).alias("i", "line"))
    by_file = Window.partitionBy("file").orderBy("i")
    fence = F.col("line").startswith("```").cast("int")
    rows = lines.withColumn("fences", F.sum(fence).over(by_file)).withColumn("head", (F.col("fences") % 2 == 0) & F.col("line").rlike(r"^#{1,3}\s+(.+)") & (fence == 0))
    rows = rows.withColumn("n", F.sum(F.col("head").cast("int")).over(by_file)).filter("n > 0")
    text = F.transform(F.array_sort(F.collect_list(F.when(~F.col("head"), F.struct("i", "line")))), lambda x: x["line"])
    out = rows.groupBy("file", "n").agg(F.min_by(F.regexp_replace("line", r"^#+\s+", ""), "i").alias("heading"), F.regexp_replace(F.array_join(text, "\n"), r"^\s+|\s+$", "").alias("body"))
    return out.groupBy("file", "heading").agg(F.max_by("body", "n").alias("body"))


def import_names(text):
    """Names that an import statement brings in: its words without keywords and quotes, the last part of a path."""
    words = F.filter(F.split(text, r"[\s,;{}()]+"), lambda w: (w != "") & ~w.isin("import", "from", "use", "require", "as", "*"))
    return F.transform(words, lambda w: F.regexp_extract(F.regexp_replace(w, "['\"]", ""), r"([^/.:]*)$", 1))


def transcripts(media: DataFrame, cache: DataFrame, transcribe) -> DataFrame:
    """(file, transcript, cached) of media (file, hash), those in the cache (hash, transcript) not asked again; ``transcribe(file) -> str``."""
    known = media.join(cache.select("hash", "transcript"), "hash").select("file", "transcript", F.lit(True).alias("cached"))

    def run(batches):
        for pdf in batches:
            yield pdf.assign(transcript=[transcribe(f) for f in pdf.file], cached=False)[["file", "transcript", "cached"]]

    return known.unionByName(media.join(cache.select("hash"), "hash", "left_anti").select("file").mapInPandas(run, "file string, transcript string, cached boolean"))


def model_answers(docs: DataFrame, cache: DataFrame, complete) -> DataFrame:
    """(hash, answer, cached, error): answers of ``complete(prompt) -> str`` for documents (text), those in the cache (hash, answer) not asked
    again. Equal texts are asked once; a failed call gives a null answer and what it said."""
    rows = docs.select(F.sha2("text", 256).alias("hash"), F.substring("text", 1, 8000).alias("prompt")).dropDuplicates(["hash"])
    hits = rows.select("hash").join(cache.select("hash", "answer"), "hash").withColumns({"cached": F.lit(True), "error": F.lit(None).cast("string")})

    def run(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                try:
                    out.append((r.hash, re.sub(r"^```\w*\n|\n```$", "", complete(r.prompt)), False, None))
                except Exception as e:  # a call that fails is recorded, not raised
                    out.append((r.hash, None, False, str(e)))
            yield pd.DataFrame(out, columns=["hash", "answer", "cached", "error"])

    asked = rows.join(cache.select("hash"), "hash", "left_anti").mapInPandas(run, "hash string, answer string, cached boolean, error string")
    return hits.unionByName(asked)
