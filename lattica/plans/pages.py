"""Queries of compiled pages, reports, prompts and costs, over the trade graph and the tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lattica.catalog import query
from lattica.functions import text as tf
from lattica.model import Graph
from lattica.operators import refine, report, stats, vectors, wiki

from .graph import BASE, DEG, ENDS, trade_graph
from .trade import table

INNER = "inner_ AS (SELECT * FROM x WHERE ca = cb)"
COMPILED = f"""{ENDS}, {INNER},
rel AS (SELECT id, string_agg(line, chr(10) ORDER BY ord) AS r FROM (SELECT source AS id, ord, '  - ' || source || ' --trades--> ' || target AS line FROM inner_ UNION SELECT target, ord, '  - ' || source || ' --trades--> ' || target FROM inner_) y GROUP BY id),
entry AS (SELECT nodes.*, '### ' || label || chr(10) || chr(10) || label || coalesce(chr(10) || chr(10) || 'Relationships:' || chr(10) || r, '') AS e FROM nodes LEFT JOIN rel USING (id)),
m AS (SELECT ca AS community, count(*) AS m FROM inner_ GROUP BY ca),
near AS (SELECT c AS community, string_agg(DISTINCT 'community-' || o, ', ' ORDER BY 'community-' || o) AS related FROM (SELECT ca AS c, cb AS o FROM x UNION ALL SELECT cb, ca FROM x) y WHERE c <> o GROUP BY c),
sure AS (SELECT ca AS community, bool_and(confidence = 'EXTRACTED') AS sure, avg(CASE WHEN confidence <> 'EXTRACTED' THEN 1.0 ELSE 0.0 END) AS unsure FROM inner_ GROUP BY ca),
p AS (SELECT community, min_by(label, ord) AS title, count(*) AS n_nodes, string_agg(e, chr(10) || chr(10) ORDER BY ord) AS body, string_agg('- [[' || label || ']]', chr(10) ORDER BY ord) AS links FROM entry GROUP BY community),
page AS (SELECT community, title, 'wiki/' || lower(regexp_replace(title, '\\s+', '-', 'g')) || '.md' AS path, n_nodes, coalesce(related, '') AS related,
  CASE WHEN sure THEN 'high' WHEN unsure > 0.5 THEN 'low' ELSE 'medium' END AS confidence,
  'Community ' || title || ' contains ' || n_nodes || ' nodes and ' || coalesce(m, 0) || ' edges' AS outline, body, links
  FROM p LEFT JOIN m USING (community) LEFT JOIN near USING (community) LEFT JOIN sure USING (community)),
pages_ AS (SELECT *, '# ' || title || chr(10) || chr(10) || outline || chr(10) || chr(10) || '## Nations' || chr(10) || chr(10) || body || chr(10) || chr(10) || '## Related' || chr(10) || chr(10) || links AS content FROM page)"""


def _pages(spark, sf_dir):
    return wiki.pages(trade_graph(spark, sf_dir, True))


@query("page_compile", f"WITH {BASE}, {COMPILED} SELECT community, title, path, confidence, n_nodes, outline, related, 'generated,nation,community-' || community AS tags, content FROM pages_")
def page_compile(spark, sf_dir):
    out = _pages(spark, sf_dir)
    return out.select("community", "title", "path", "confidence", "n_nodes", "outline", F.array_join("related", ", ").alias("related"), F.array_join("tags", ",").alias("tags"), "content")


@query(
    "page_files",
    f"""WITH {BASE}, {COMPILED} SELECT path, '---' || chr(10) || 'community: ' || community || chr(10) || 'label: ' || title || chr(10) || 'type: community' || chr(10) || 'confidence: ' || confidence || chr(10)
  || CASE WHEN related <> '' THEN 'related: [' || related || ']' || chr(10) ELSE '' END || 'created_at: 2024-01-01' || chr(10) || 'updated_at: 2024-01-01' || chr(10)
  || 'tags: [generated, nation, community-' || community || ']' || chr(10) || '---' || chr(10) || content AS text FROM pages_""",
)
def page_files(spark, sf_dir):
    return wiki.with_front_matter(_pages(spark, sf_dir), "2024-01-01")


@query("page_sections", f"WITH {BASE}, {COMPILED} SELECT community, 'nation' AS type, 'Nations' AS header, n_nodes AS n, body FROM pages_")
def page_sections(spark, sf_dir):
    return wiki.sections(trade_graph(spark, sf_dir, True)).select("community", "type", "header", "n", "body")


@query("page_stage3", "SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS content, true AS verified FROM nation")
def page_stage3(spark, sf_dir):
    return wiki.verified(table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("content")))


@query("pages_updated", f"WITH {BASE}, {COMPILED} SELECT community, content FROM pages_ WHERE community IN (SELECT community FROM nodes WHERE id IN ('3', '7'))")
def pages_updated(spark, sf_dir):
    return wiki.updated(trade_graph(spark, sf_dir, True), spark.createDataFrame([("3",), ("7",)], "id string")).select("community", "content")


@query("pages_appended", "SELECT 'p' || doc_id AS path, lang || chr(10) || chr(10) || source AS content FROM documents WHERE doc_id % 7 = 0")
def pages_appended(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("path"), "lang", "source", "doc_id")
    return wiki.appended(d.select("id", "path", F.col("lang").alias("content")), d.filter("doc_id % 7 = 0").select("id", F.col("source").alias("content")))


@query("node_page_map", f"WITH {BASE}, {COMPILED} SELECT path, string_agg(id, ',' ORDER BY id) AS ids FROM nodes JOIN pages_ USING (community) GROUP BY path")
def node_page_map(spark, sf_dir):
    return wiki.nodes_of_pages(wiki.pages_of_nodes(trade_graph(spark, sf_dir, True))).select("path", F.array_join("ids", ",").alias("ids"))


@query(
    "canvas_nodes",
    f"""WITH {BASE}, {COMPILED}, o AS (SELECT *, row_number() OVER (ORDER BY community) - 1 AS i, CAST(ceil(sqrt(count(*) OVER ())) AS BIGINT) AS c FROM pages_)
SELECT i AS place, '{{"id":"' || lower(title) || '","type":"file","file":"' || substr(path, 6) || '","x":' || (i % c) * 300 || ',"y":' || (i // c) * 120 || ',"width":250,"height":60}}' AS node FROM o""",
)
def canvas_nodes(spark, sf_dir):
    return wiki.canvas(_pages(spark, sf_dir), "community")


SOURCED = "s AS (SELECT id, label, 'f' || (CAST(id AS INTEGER) % 4) || '/a b.py' AS source_file, ord FROM nodes)"


def _sourced(spark, sf_dir) -> Graph:
    g = trade_graph(spark, sf_dir, True)
    return Graph(g.nodes.withColumn("source_file", F.concat(F.lit("f"), (F.col("id").cast("int") % 4).cast("string"), F.lit("/a b.py"))), g.edges)


@query(
    "source_pages",
    f"""WITH {BASE}, {SOURCED}, r AS (SELECT a.source_file, string_agg('- ' || a.label || ' → ' || b.label || ' (trades)', chr(10) ORDER BY g.ord) AS r FROM sparse g JOIN s a ON g.source = a.id JOIN s b ON g.target = b.id WHERE a.source_file = b.source_file GROUP BY 1),
n AS (SELECT source_file, count(*) AS n, string_agg('- **' || label || '** (nation)', chr(10) ORDER BY ord) AS body FROM s GROUP BY 1 HAVING count(*) >= 2)
SELECT source_file, 'wiki/sources/' || replace(replace(replace(source_file, '.py', ''), '/', '-'), ' ', '-') || '.md' AS path, n,
  '# ' || source_file || chr(10) || chr(10) || '> ' || n || ' concepts extracted' || chr(10) || chr(10) || '## Concepts' || chr(10) || chr(10) || body || coalesce(chr(10) || chr(10) || '## Relationships' || chr(10) || chr(10) || r, '') AS content FROM n LEFT JOIN r USING (source_file)""",
)
def source_pages(spark, sf_dir):
    return wiki.source_pages(_sourced(spark, sf_dir))


@query(
    "graph_report",
    f"""WITH {BASE}, {DEG}, t AS (SELECT label, degree FROM (SELECT * FROM d ORDER BY degree DESC, id LIMIT 10) x JOIN nodes USING (id))
SELECT * FROM (VALUES ('# Report'), (''), (''), (''), (''), ('## Summary'), ('## Nodes by Type'), ('| Type | Count |'), ('|------|-------|'), ('## Top Connected Nodes (by degree)'), ('| Node | Edges |'), ('|------|-------|'), ('## Metadata'), ('| Key | Value |'), ('|-----|-------|'), ('| made_by | trade |')) v(line)
UNION ALL SELECT '- Nodes: ' || count(*) FROM nodes UNION ALL SELECT '- Edges: ' || count(*) FROM sparse UNION ALL SELECT '- Communities: ' || count(DISTINCT community) FROM nodes
UNION ALL SELECT '- Density: ' || printf('%.4f', (SELECT count(*) FROM sparse) / (count(*) * (count(*) - 1.0))) FROM nodes
UNION ALL SELECT '| nation | ' || count(*) || ' |' FROM nodes UNION ALL SELECT '| ' || label || ' | ' || degree || ' |' FROM t""",
)
def graph_report(spark, sf_dir):
    g = trade_graph(spark, sf_dir, True)
    return report.graph_report(Graph(g.nodes, g.edges, meta={"made_by": "trade"})).select("line")


@query(
    "analysis_report",
    f"""WITH {BASE}, {DEG}, o AS (SELECT id, sum(weight) AS w FROM (SELECT source AS id, weight FROM sparse UNION ALL SELECT target, weight FROM sparse WHERE source <> target) x GROUP BY id),
h AS (SELECT nodes.*, coalesce(wdegree, 0) AS wd FROM nodes LEFT JOIN d USING (id) ORDER BY wd DESC, ord LIMIT 10)
SELECT * FROM (VALUES ('# Analysis Report'), (''), (''), (''), (''), (''), (''), (''), (''), ('## Graph Summary'), ('| Metric | Value |'), ('|--------|-------|'), ('| Graph Completeness | 25% |'), ('## Hubs'), ('| Node | Type | Weighted Degree | Community |'), ('|------|------|-----------------|-----------|'), ('## Surprise Analysis'), ('## Missing Sources')) v(line)
UNION ALL SELECT '| Total Nodes | ' || count(*) || ' |' FROM nodes UNION ALL SELECT '| Total Edges | ' || count(*) || ' |' FROM sparse
UNION ALL SELECT '| Average Degree | ' || printf('%.2f', round(2.0 * (SELECT count(*) FROM sparse) / count(*), 2)) || ' |' FROM nodes
UNION ALL SELECT '| **' || label || '** | nation | ' || printf('%.2f', coalesce(w, 0)) || ' | ' || community || ' |' FROM h LEFT JOIN o USING (id)
UNION ALL SELECT '- **' || label || '** (nation) — community: ' || community FROM nodes WHERE CAST(id AS INTEGER) % 4 > 0 AND CAST(id AS INTEGER) < 4
UNION ALL SELECT '### ' || 'high degree' || ' (' || CASE WHEN degree > 6 * mean THEN 'high' ELSE 'medium' END || '): ' || id FROM d, (SELECT (SELECT count(*) FROM sparse) / count(*) AS mean FROM nodes) m WHERE degree > 3 * mean AND degree > 5
UNION ALL SELECT '### isolated community (low): ' || community FROM nodes WHERE community NOT IN (SELECT a.community FROM sparse g JOIN nodes a ON g.source = a.id JOIN nodes b ON g.target = b.id WHERE a.community = b.community) GROUP BY community HAVING count(*) > 1
UNION ALL SELECT '- ... and ' || (count(*) - 3) || ' more' FROM nodes WHERE CAST(id AS INTEGER) % 4 > 0""",
)
def analysis_report(spark, sf_dir):
    g = trade_graph(spark, sf_dir, True)
    nodes = g.nodes.withColumn("provenance", F.when(F.col("id").cast("int") % 4 == 0, F.col("provenance")))
    return report.analysis_report(Graph(nodes, g.edges), 0.25, 10, 3).select("line")


@query(
    "community_prompts",
    f"""WITH {BASE}, {ENDS}, ed AS (SELECT ca AS community, count(*) AS m, string_agg('- ' || a.label || ' --trades--> ' || b.label || ' (weight: ' || printf('%.2f', x.weight) || ')', chr(10) ORDER BY x.ord) AS edges FROM x JOIN nodes a ON x.source = a.id JOIN nodes b ON x.target = b.id WHERE ca = cb GROUP BY ca),
no AS (SELECT community, count(*) AS n, min_by(label, ord) AS name, string_agg('- **' || label || '** (nation) — source: region' || community, chr(10) ORDER BY ord) AS nodes FROM nodes GROUP BY community)
SELECT community, 'Summarize community "' || name || '": ' || n || ' nodes, ' || coalesce(m, 0) || ' edges.' || chr(10) || chr(10) || 'Nodes:' || chr(10) || nodes || chr(10) || chr(10) || 'Edges:' || chr(10) || coalesce(edges, '(none)') AS prompt FROM no LEFT JOIN ed USING (community)""",
)
def community_prompts(spark, sf_dir):
    return report.community_prompts(trade_graph(spark, sf_dir, True))


@query("community_sources", f"WITH {BASE}, {SOURCED} SELECT community, string_agg(source_file, ',' ORDER BY f) AS files, 'nation' AS types, sum(n) AS n FROM (SELECT community, source_file, min(s.ord) AS f, count(*) AS n FROM s JOIN nodes USING (id) GROUP BY 1, 2) y GROUP BY community")
def community_sources(spark, sf_dir):
    return stats.community_facets(_sourced(spark, sf_dir).nodes).select("community", F.array_join("files", ",").alias("files"), F.array_join("types", ",").alias("types"), "n")


@query("token_counters", "SELECT conv_id, CAST(sum(t) AS BIGINT) AS total, count(*) AS calls, round(avg(t), 6) AS average FROM (SELECT conv_id, ceil(length(coalesce(text, '')) / 4) AS t FROM conversations) x GROUP BY conv_id")
def token_counters(spark, sf_dir):
    calls = table(spark, sf_dir, "conversations").select("conv_id", tf.tokens(F.col("text")).alias("tokens"))
    return refine.counters(calls, "conv_id").withColumn("average", F.round("average", 6))


@query("tiered_costs", """SELECT question, 'tiered' AS method, CAST(s + ceil((length('tiered approach consumed ' || s || ' tokens with optimal precision.') + 10) / 4) AS BIGINT) AS tokens, CAST(3 AS BIGINT) AS files
FROM (SELECT p_name AS question, CAST(2 * ceil(length(p_name) / 4) + 4 * 12 AS BIGINT) AS s FROM part) x""")
def tiered_costs(spark, sf_dir):
    return refine.tiered_cost(table(spark, sf_dir, "part").select(F.col("p_name").alias("question")))


@query(
    "all_costs",
    """WITH q(question) AS (VALUES ('license'), ('copyright')), f AS (SELECT text, doc_id, ceil(length(text) / 4) AS t FROM documents), own AS (SELECT question, ceil(length(question) / 4) AS o FROM q)
SELECT question, 'grep' AS method, CAST(coalesce(sum(t), 0) + min(o) AS BIGINT) AS tokens, count(t) AS files FROM own LEFT JOIN (SELECT question AS w, t FROM (SELECT question, t, row_number() OVER (PARTITION BY question ORDER BY doc_id) AS n FROM f, q WHERE contains(lower(text), question)) y WHERE n <= 10) z ON w = question GROUP BY question
UNION ALL SELECT question, 'naive', CAST(sum(t) + min(o) AS BIGINT), count(*) FROM f, own GROUP BY question
UNION ALL SELECT question, 'rag', CAST(2 * sum(t) + min(o) AS BIGINT), count(*) FROM (SELECT t FROM f ORDER BY doc_id LIMIT 5) y, own GROUP BY question
UNION ALL SELECT question, 'tiered', CAST(s + ceil((length('tiered approach consumed ' || s || ' tokens with optimal precision.') + 10) / 4) AS BIGINT), CAST(3 AS BIGINT) FROM (SELECT question, CAST(2 * o + 48 AS BIGINT) AS s FROM own) y""",
)
def all_costs(spark, sf_dir):
    return refine.all_costs(table(spark, sf_dir, "documents").select("text", F.col("doc_id").alias("ord")), ["license", "copyright"])


@query("granularity", "SELECT CAST(p_partkey AS VARCHAR) AS file, round(g, 6) AS gap, round(CASE WHEN p_size % 5 > 0 THEN (p_size % 7) * 1000.0 / (p_size % 5) ELSE 0 END, 6) AS density, CASE WHEN g >= 0.8 THEN 'good' WHEN g >= 0.5 THEN 'fair' ELSE 'poor' END AS quality FROM (SELECT *, CASE WHEN p_size % 11 > 0 THEN (p_size % 7) / (p_size % 11) ELSE 1.0 END AS g FROM part) x")
def granularity(spark, sf_dir):
    c = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("file"), (F.col("p_size") % 11).alias("parsed"), (F.col("p_size") % 7).alias("modelled"), (F.col("p_size") % 5).alias("words"))
    return refine.granularity(c).select("file", F.round("gap", 6).alias("gap"), F.round(F.col("density").cast("double"), 6).alias("density"), "quality")


@query("root_causes", "SELECT doc_id, concat_ws(',', CASE WHEN doc_id % 5 < 3 THEN 'low_tier' END, CASE WHEN quality = 0 THEN 'weak_nodes' END, CASE WHEN toxic = 1 THEN 'cache_misses' END, CASE WHEN doc_id % 7 = 0 THEN 'many_tokens' END, CASE WHEN doc_id % 4 < 3 THEN 'few_pages' END, CASE WHEN doc_id % 2 = 0 THEN 'first_prompt' END) AS causes FROM labels")
def root_causes(spark, sf_dir):
    t = table(spark, sf_dir, "labels").select(
        "doc_id", (F.col("doc_id") % 5).alias("tier"), (1 - F.col("quality")).alias("n_weak"), F.col("toxic").cast("double").alias("miss_rate"),
        F.when(F.col("doc_id") % 7 == 0, 60000).otherwise(10).alias("tokens"), (F.col("doc_id") % 4).alias("n_pages"), F.when(F.col("doc_id") % 2 == 0, "v1").otherwise("v2").alias("prompt_version"),
    )
    return t.select("doc_id", F.array_join(refine.root_causes(), ",").alias("causes"))


@query("diagnoses", """WITH t AS (SELECT doc_id AS trace, doc_id % 5 AS tier, (doc_id % 3) * 25000 AS tokens, quality AS cached, CASE WHEN toxic = 1 THEN 'v1' ELSE 'v2' END AS v FROM labels)
SELECT trace, 'n' || trace AS id, 'L' || trace AS label, round(0.1 + CASE WHEN tier < 3 THEN 0.15 ELSE 0 END + CASE WHEN trace % 2 = 1 THEN 0.2 ELSE 0 END + CASE WHEN tokens > 40000 THEN 0.1 ELSE 0 END, 6) AS impact FROM t
UNION ALL SELECT trace, 'SYSTEM', 'Cache System', 0.3 FROM t WHERE cached = 0 UNION ALL SELECT trace, 'PROMPTS', 'Extraction Prompts', 0.4 FROM t WHERE v = 'v1'""")
def diagnoses(spark, sf_dir):
    t = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("trace"), (F.col("doc_id") % 5).alias("tier"), ((F.col("doc_id") % 3) * 25000).alias("tokens"), F.col("quality").alias("cached"), F.when(F.col("toxic") == 1, "v1").otherwise("v2").alias("prompt_version"))
    weak = t.select("trace", F.concat(F.lit("n"), F.col("trace").cast("string")).alias("id"), F.concat(F.lit("L"), F.col("trace").cast("string")).alias("label"), (F.col("trace") % 2 == 0).alias("in_wiki"))
    return refine.diagnosed(weak, t).withColumn("impact", F.round("impact", 6))


def _history(spark, sf_dir):
    o = table(spark, sf_dir, "orders").filter("o_orderkey <= 400")
    rank = F.row_number().over(Window.orderBy("o_orderkey")) - 1
    return o.select(rank.cast("long").alias("ord"), F.concat(F.lit("v"), F.col("o_orderkey").cast("string")).alias("version"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("stamp"), F.col("o_totalprice").alias("score"), F.array(F.when(F.col("o_orderstatus") != "F", F.col("o_orderstatus"))).alias("nodes"))


HISTORY = "h AS (SELECT CAST(row_number() OVER (ORDER BY o_orderkey) - 1 AS BIGINT) AS ord, 'v' || o_orderkey AS version, strftime(o_orderdate, '%Y-%m-%d') AS stamp, o_totalprice AS score, o_orderstatus AS s FROM orders WHERE o_orderkey <= 400)"


@query("history_range", f"WITH {HISTORY} SELECT version, ord FROM h WHERE ord BETWEEN (SELECT ord FROM h WHERE version = 'v3') AND (SELECT ord FROM h WHERE version = 'v37')")
def history_range(spark, sf_dir):
    return report.version_range(_history(spark, sf_dir), "v3", "v37").select("version", "ord")


@query("history_lookup", f"WITH {HISTORY} SELECT 'given' AS which, version, ord FROM h WHERE version = 'v5' UNION ALL SELECT 'latest', version, ord FROM h WHERE ord = (SELECT max(ord) FROM h)")
def history_lookup(spark, sf_dir):
    h = _history(spark, sf_dir)
    return report.version_row(h, "v5").select(F.lit("given").alias("which"), "version", "ord").unionByName(report.latest_version(h).select(F.lit("latest").alias("which"), "version", "ord"))


@query("audit_trail", f"WITH {HISTORY} SELECT 'audit-' || (ord + 1) AS id, stamp, version, score, CASE WHEN s = 'F' THEN 'unknown' ELSE s END AS nodes FROM h")
def audit_trail(spark, sf_dir):
    return report.audit_trail(_history(spark, sf_dir)).withColumn("nodes", F.array_join("nodes", ","))


@query("score_change", f"WITH {HISTORY}, c AS (SELECT *, lag(score) OVER (ORDER BY ord) AS before FROM h) SELECT version, score, before, round(score - before, 6) AS change FROM c WHERE ord = (SELECT max(ord) FROM h)")
def score_change(spark, sf_dir):
    return report.score_change(_history(spark, sf_dir)).withColumn("change", F.round("change", 6))


@query("manhattan_distances", "SELECT a.vec_id, round(list_sum(list_transform(list_zip(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), lambda x: abs(x[1] - x[2]))), 6) AS manhattan FROM embeddings a JOIN embeddings b ON b.vec_id = 0")
def manhattan_distances(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    origin = v.filter("vec_id = 0").agg(F.first("x").alias("y"))
    return v.crossJoin(F.broadcast(origin)).select("vec_id", F.round(vectors.manhattan(F.col("x"), F.col("y")), 6).alias("manhattan"))
