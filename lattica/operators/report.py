"""Reports, prompts, logs and history as rows of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions.text import fixed
from lattica.model import Graph

from . import stats


def _part(n: int, rows: DataFrame, order: str | Column, line: Column) -> DataFrame:
    return rows.select(F.lit(n).alias("part"), (F.col(order) if isinstance(order, str) else order).cast("bigint").alias("ord"), line.alias("line"))


def _fixed(g: Graph, n: int, *lines: str) -> DataFrame:
    return g.nodes.sparkSession.createDataFrame([(n, i, x) for i, x in enumerate(lines)], "part int, ord long, line string")


def _placed(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(F.format_string("%02d-%015d", "part", "ord").alias("place"), "line")


def _row(*cells: Column | str) -> Column:
    out = [F.lit("| ")]
    for i, c in enumerate(cells):
        out += ([F.lit(" | ")] if i else []) + [F.col(c).cast("string") if isinstance(c, str) else c.cast("string")]
    return F.concat(*out, F.lit(" |"))


def graph_report(g: Graph, top: int = 10) -> DataFrame:
    """(place, line): counts, density to four places, nodes by type (most first), the nodes of most edges, and metadata."""
    s = stats.status(g)
    pairs = F.col("nodes") * (F.col("nodes") - 1)
    dense = F.when(pairs > 0, fixed(F.col("edges") / pairs, 4)).otherwise("0")
    lines = F.array(F.lit("# Report"), F.lit(""), F.lit("## Summary"), F.concat(F.lit("- Nodes: "), "nodes"), F.concat(F.lit("- Edges: "), "edges"), F.concat(F.lit("- Communities: "), "communities"), F.concat(F.lit("- Density: "), dense))
    head = s.select(F.posexplode(lines).alias("ord", "line"))
    kinds = g.nodes.groupBy(F.coalesce(F.nullif("type", F.lit("")), F.lit("unknown")).alias("type")).agg(F.count("*").alias("n"), F.min("ord").alias("first"))
    best = stats.degrees(g.edges).orderBy(F.desc("degree"), "id").limit(top).join(g.nodes.select("id", "label"), "id", "left").withColumn("label", F.coalesce("label", "id"))
    rank = F.row_number().over(Window.orderBy(F.desc("degree"), "id"))
    parts = [
        _part(0, head, "ord", F.col("line")),
        _fixed(g, 1, "", "## Nodes by Type", "| Type | Count |", "|------|-------|"),
        _part(2, kinds.withColumn("r", F.row_number().over(Window.orderBy(F.desc("n"), "first"))), "r", _row("type", "n")),
        _fixed(g, 3, "", "## Top Connected Nodes (by degree)", "| Node | Edges |", "|------|-------|"),
        _part(4, best.withColumn("r", rank), "r", _row("label", "degree")),
    ]
    if g.meta:
        parts += [_fixed(g, 5, "", "## Metadata", "| Key | Value |", "|-----|-------|", *[f"| {k} | {v} |" for k, v in g.meta.items()])]
    return _placed(parts)


def analysis_report(g: Graph, completeness: float = 0.0, top: int = 10, missing: int = 20) -> DataFrame:
    """(place, line): summary, hubs by weighted degree, surprises, and (if not complete) nodes without a provenance."""
    counts = g.nodes.agg(F.count("*").alias("n")).crossJoin(g.edges.agg(F.count("*").alias("m"))).crossJoin(stats.average_degree(g))
    lines = F.array(
        F.lit("# Analysis Report"), F.lit(""), F.lit("## Graph Summary"), F.lit(""), F.lit("| Metric | Value |"), F.lit("|--------|-------|"),
        _row(F.lit("Total Nodes"), "n"), _row(F.lit("Total Edges"), "m"), _row(F.lit("Average Degree"), fixed(F.col("average_degree"), 2)),
        _row(F.lit("Graph Completeness"), F.concat(fixed(F.lit(completeness * 100), 0), F.lit("%"))),
    )
    hubs = stats.hubs_all(g, top).select("id").join(g.nodes, "id").join(stats.degree_of(g.edges, True), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0.0)))
    by = Window.orderBy(F.desc("all"), "ord")
    hubs = hubs.join(stats.degrees(g.edges, True).withColumnRenamed("degree", "all"), "id", "left").withColumn("all", F.coalesce("all", F.lit(0.0))).withColumn("r", F.row_number().over(by))
    community = F.coalesce(F.col("community").cast("string"), F.lit("N/A"))
    found = surprises(g)
    rank = F.row_number().over(Window.orderBy("kind", "subject"))
    parts = [
        _part(0, counts.select(F.posexplode(lines).alias("ord", "line")), "ord", F.col("line")),
        _fixed(g, 1, "", "## Hubs", "", "| Node | Type | Weighted Degree | Community |", "|------|------|-----------------|-----------|"),
        _part(2, hubs, "r", _row(F.concat(F.lit("**"), "label", F.lit("**")), "type", fixed(F.col("degree"), 2), community)),
        _fixed(g, 3, "", "## Surprise Analysis", ""),
        _part(4, found.withColumn("r", rank), "r", F.format_string("### %s (%s): %s", F.replace("kind", F.lit("_"), F.lit(" ")), "severity", "subject")),
    ]
    if completeness < 1:
        bare = g.nodes.filter(F.coalesce(F.size("provenance"), F.lit(0)) <= 0)
        shown = bare.orderBy("ord").limit(missing)
        more = bare.agg((F.count("*") - missing).alias("n")).filter("n > 0")
        parts += [
            _fixed(g, 5, "", "## Missing Sources", ""),
            _part(6, shown, "ord", F.concat(F.lit("- **"), "label", F.lit("** ("), "type", F.lit(") — community: "), community)),
            _part(7, more, F.lit(0), F.format_string("- ... and %d more", "n")),
        ]
    return _placed(parts)


def surprises(g: Graph) -> DataFrame:
    """(kind, severity, subject): hubs far above the mean, communities without an edge inside, and a hub far above the next."""
    a = stats.surprising_hubs(g).select(F.lit("high_degree").alias("kind"), "severity", F.col("id").alias("subject"))
    b = stats.isolated_communities(g).select(F.lit("isolated_community").alias("kind"), "severity", F.col("community").cast("string").alias("subject"))
    return a.unionByName(b).unionByName(stats.anomalous_hub(g).select(F.lit("degree_anomaly").alias("kind"), F.lit("high").alias("severity"), F.col("id").alias("subject")))


def community_prompts(g: Graph) -> DataFrame:
    """(community, prompt): what a model is asked for a summary of each community: its nodes and the edges between them."""
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", c.alias("t")))), lambda x: x["t"]), "\n")
    nodes = g.nodes.filter("community IS NOT NULL").withColumn("label", F.coalesce("label", "id"))
    told = F.concat(F.lit("- **"), "label", F.lit("** ("), "type", F.lit(")"), F.coalesce(F.concat(F.lit(" — source: "), F.array_join("provenance", ", ")), F.lit("")))
    whole = nodes.groupBy("community").agg(F.count("*").alias("n"), F.min_by("label", "ord").alias("name"), joined(told).alias("nodes"))
    a, b = nodes.select(F.col("id").alias("source"), F.col("label").alias("la"), "community"), nodes.select(F.col("id").alias("target"), F.col("label").alias("lb"), F.col("community").alias("c"))
    line = F.concat(F.lit("- "), "la", F.lit(" --"), F.coalesce("label", F.lit("related")), F.lit("--> "), "lb", F.lit(" (weight: "), fixed(F.col("weight"), 2), F.lit(")"))
    edges = g.edges.join(a, "source").join(b, "target").filter("community = c").groupBy("community").agg(F.count("*").alias("m"), joined(line).alias("edges"))
    out = whole.join(edges, "community", "left")
    text = F.format_string("Summarize community \"%s\": %d nodes, %d edges.\n\nNodes:\n%s\n\nEdges:\n%s", "name", "n", F.coalesce("m", F.lit(0)), "nodes", F.coalesce("edges", F.lit("(none)")))
    return out.select("community", text.alias("prompt"))


def audit_line(stamp: Column, action: Column, detail: Column) -> Column:
    """A line of the log."""
    return F.format_string("- %s [%s] %s", stamp, action, detail)


def log(entries: DataFrame, path: str) -> None:
    """Entries (stamp, action, detail) appended to the log at ``path``."""
    entries.select(audit_line(F.col("stamp"), F.col("action"), F.col("detail"))).write.mode("append").text(path)


def memory_slug(question: Column) -> Column:
    return F.regexp_replace(F.substring(F.regexp_replace(F.regexp_replace(F.lower(question), r"\s+", "-"), "[^a-z0-9-]", ""), 1, 40), "-+$", "")


def memories(entries: DataFrame) -> DataFrame:
    """(file, page, content) of answers to keep (question, answer, type, nodes, stamp): the same text as a dated file and as a page."""
    q, slug = F.col("question"), memory_slug(F.col("question"))
    listed = F.concat(F.lit("["), F.array_join("nodes", ", "), F.lit("]"))
    front = F.concat(F.lit('---\ntype: memory\nquestion: "'), q, F.lit('"\nanswer: "'), F.replace("answer", F.lit('"'), F.lit('\\"')), F.lit('"\nmemory_type: '), "type", F.lit("\nnodes: "), listed, F.lit("\ncreated_at: "), "stamp", F.lit("\n---\n"))
    named = F.when(F.size("nodes") > 0, F.concat(F.lit("\n## Referenced Nodes\n"), F.array_join(F.transform("nodes", lambda n: F.concat(F.lit("- "), n)), "\n"), F.lit("\n"))).otherwise("")
    date = F.substring(F.regexp_replace("stamp", "[:.]", "-"), 1, 23)
    return entries.select(F.concat(date, F.lit("-"), slug, F.lit(".md")).alias("file"), F.concat(F.lit("queries/"), slug, F.lit(".md")).alias("page"), F.concat(front, F.lit("# "), q, F.lit("\n"), "answer", named).alias("content"))


def version_row(history: DataFrame, version: str) -> DataFrame:
    """The first row of a version in the history (version, ord, ...)."""
    return history.filter(F.col("version") == version).orderBy("ord").limit(1)


def latest_version(history: DataFrame) -> DataFrame:
    return history.orderBy(F.desc("ord")).limit(1)


def version_range(history: DataFrame, first: str, last: str) -> DataFrame:
    """Rows from the first one of ``first`` to the first one of ``last``; none if either is missing."""
    at = history.agg(F.min(F.when(F.col("version") == first, F.col("ord"))).alias("a"), F.min(F.when(F.col("version") == last, F.col("ord"))).alias("b"))
    return history.crossJoin(F.broadcast(at)).filter("ord BETWEEN a AND b").drop("a", "b")


def audit_trail(history: DataFrame) -> DataFrame:
    """(id, stamp, version, score, nodes) of the history (ord from 0, stamp, version, score, nodes)."""
    return history.select(F.concat(F.lit("audit-"), (F.col("ord") + 1).cast("string")).alias("id"), "stamp", "version", "score", F.transform("nodes", lambda n: F.coalesce(n, F.lit("unknown"))).alias("nodes"))


def score_change(history: DataFrame) -> DataFrame:
    """(version, score, before, change) of the last row against the one before."""
    out = history.withColumn("before", F.lag("score").over(Window.orderBy("ord"))).orderBy(F.desc("ord")).limit(1)
    return out.select("version", "score", "before", (F.col("score") - F.col("before")).alias("change"))


def results_table(runs: DataFrame) -> DataFrame:
    """(place, line): runs (ord, method, tokens, files, ms, precision, recall) as a table of fixed columns, and their total and mean tokens."""
    wide = F.greatest(F.lit(10), F.max(F.length("method")).over(Window.partitionBy()))
    cell = lambda c, n: F.rpad(c.cast("string"), n, " ")
    ratio = lambda c: F.when(F.coalesce(F.col(c), F.lit(0.0)) != 0, fixed(F.col(c), 2)).otherwise("N/A")
    line = F.concat_ws(" | ", F.rpad("method", F.col("w"), F.lit(" ")), cell(F.col("tokens"), 10), cell(F.col("files"), 8), cell(F.concat(F.col("ms").cast("string"), F.lit("ms")), 12), cell(ratio("precision"), 10), cell(ratio("recall"), 10))
    rows = runs.withColumn("w", wide)
    width = runs.agg(F.greatest(F.lit(10), F.max(F.length("method"))).alias("w"), F.sum("tokens").alias("total"), F.avg("tokens").alias("mean"))
    head = F.concat_ws(" | ", F.rpad(F.lit("Method"), F.col("w"), F.lit(" ")), *[F.lit(h.ljust(n)) for h, n in (("Tokens", 10), ("Files", 8), ("Duration", 12), ("Precision", 10), ("Recall", 10))])
    rule = F.concat_ws("-+-", F.repeat(F.lit("-"), F.col("w")), *[F.lit("-" * n) for n in (10, 8, 12, 10, 10)])
    parts = [
        _part(0, width, F.lit(0), head), _part(0, width, F.lit(1), rule), _part(1, rows, "ord", line), _part(2, width, F.lit(0), F.lit("")),
        _part(2, width, F.lit(1), F.concat(F.lit("Total tokens: "), F.col("total").cast("string"))), _part(2, width, F.lit(2), F.concat(F.lit("Avg tokens/query: "), fixed(F.col("mean"), 2))),
    ]
    return _placed(parts)
