"""Queries of the operators that work by rounds over whole graphs and texts: communities by levels, walks from many starts, weighted ways, peeling, merges, passages."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattica.catalog import query
from lattica.functions import tables
from lattica.model import Graph, scratch
from lattica.operators import cluster, substrings, traverse, trigrams, vectors, versions
from lattica.streaming import circuits, watch

from .graph import BASE, trade_graph
from .trade import table


def deals_graph(spark, sf_dir, weighted: bool = True) -> Graph:
    """Customers and suppliers, joined by the line items between them; without weights an edge for each line item."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey").join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    e = lines.groupBy("o_custkey", "l_suppkey").agg(F.count("*").cast("double").alias("weight")) if weighted else lines.withColumn("weight", F.lit(1.0))
    e = e.select(F.concat(F.lit("c"), "o_custkey").alias("source"), F.concat(F.lit("s"), "l_suppkey").alias("target"), "weight", (F.col("o_custkey") * 1_000_000 + F.col("l_suppkey")).cast("bigint").alias("ord"))
    n = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.lit("customer").alias("type"), (F.col("c_custkey") * 2).cast("bigint").alias("ord"))
    n = n.unionByName(table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.lit("supplier").alias("type"), (F.col("s_suppkey") * 2 + 1).cast("bigint").alias("ord")))
    return Graph(n, e)


@query("communities_by_levels")
def communities_by_levels(spark, sf_dir):
    return cluster.multilevel(deals_graph(spark, sf_dir), rounds=8, cycles=1)


DEALS = """deals AS (SELECT DISTINCT 'c' || o_custkey AS c, 's' || l_suppkey AS s FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
hops AS (SELECT c AS a, s AS b FROM deals UNION ALL SELECT s, c FROM deals)"""


@query(
    "depths_from_suppliers",
    f"""WITH RECURSIVE {DEALS}, walk(start, id, depth) AS (
SELECT 's' || s_suppkey, 's' || s_suppkey, 0 FROM supplier UNION SELECT start, b, depth + 1 FROM walk JOIN hops ON a = id WHERE depth < 3)
SELECT start, id, CAST(min(depth) AS INTEGER) AS depth FROM walk GROUP BY start, id""",
)
def depths_from_suppliers(spark, sf_dir):
    g = deals_graph(spark, sf_dir, weighted=False)
    return traverse.depths(g, g.nodes.filter("type = 'supplier'").select("id"), 3)


def _squared(name: str, of: str) -> str:
    return f"{name} AS (SELECT x.a, y.b, min(x.w + y.w) AS w FROM {of} x JOIN {of} y ON x.b = y.a GROUP BY 1, 2)"


@query(
    "weighted_distances",
    f"""WITH {BASE}, d1 AS (SELECT a, b, min(w) AS w FROM (SELECT source AS a, target AS b, weight AS w FROM sparse UNION ALL SELECT target, source, weight FROM sparse UNION ALL SELECT id, id, 0 FROM nodes) x GROUP BY 1, 2),
{", ".join(_squared(f"d{2 * n}", f"d{n}") for n in (1, 2, 4, 8, 16))} SELECT b AS id, w AS distance FROM d32 WHERE a = '0'""",
)
def weighted_distances(spark, sf_dir):
    return traverse.distances(trade_graph(spark, sf_dir, True), "0").select("id", "distance")


#: What leads to what: regions to nations, nations to customers and suppliers, these to orders.
LEADS = """leads(a, b) AS (SELECT 'r' || n_regionkey, 'n' || n_nationkey FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer
UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders
UNION ALL SELECT DISTINCT 's' || l_suppkey, 'o' || l_orderkey FROM lineitem)"""


@query(
    "topological_layers",
    f"""WITH RECURSIVE {LEADS}, ids AS (SELECT a AS id FROM leads UNION SELECT b FROM leads), walk(id, layer) AS (
SELECT id, 0 FROM ids WHERE id NOT IN (SELECT b FROM leads) UNION SELECT b, layer + 1 FROM walk JOIN leads ON a = id)
SELECT id, CAST(max(layer) AS INTEGER) AS layer FROM walk GROUP BY id""",
)
def topological_layers(spark, sf_dir):
    def pairs(name, a, ka, b, kb):
        return table(spark, sf_dir, name).select(F.concat(F.lit(a), ka).alias("source"), F.concat(F.lit(b), kb).alias("target"))

    e = pairs("nation", "r", "n_regionkey", "n", "n_nationkey").unionByName(pairs("customer", "n", "c_nationkey", "c", "c_custkey")).unionByName(pairs("supplier", "n", "s_nationkey", "s", "s_suppkey"))
    e = e.unionByName(pairs("orders", "c", "o_custkey", "o", "o_orderkey")).unionByName(pairs("lineitem", "s", "l_suppkey", "o", "l_orderkey"))
    return traverse.layers(Graph(e.select(F.explode(F.array("source", "target")).alias("id")).distinct(), e, True))


@query("passages_held", "SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def passages_held(spark, sf_dir):
    docs, items = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("passage"))
    held = substrings.contained(docs, "text", items, "passage")
    return docs.join(held, "text").join(items, "passage").select("doc_id", "item_id")


@query(
    "words_held",
    """WITH w AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS word FROM part) SELECT word, count(*) AS documents FROM w JOIN documents ON contains(text, word) GROUP BY word""",
)
def words_held(spark, sf_dir):
    docs, parts = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("word"))
    return docs.join(substrings.contained(docs, "text", parts, "word"), "text").groupBy("word").agg(F.count("*").alias("documents"))


def vector_nodes(spark, sf_dir):
    """Vectors as nodes of the type of their label; every third has two provenances more."""
    v = table(spark, sf_dir, "embeddings").filter("label IS NOT NULL AND embedding IS NOT NULL")
    more = F.when(F.col("vec_id") % 3 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array().cast("array<string>"))
    return v.select(F.lpad(F.col("vec_id").cast("string"), 9, "0").alias("id"), F.col("label").cast("string").alias("type"), "embedding", F.col("vec_id").cast("bigint").alias("ord"), more.alias("provenance"))


#: Pairs one after another, in the order in which they are first met; what has been absorbed so far goes along.
GREEDY = """WITH RECURSIVE v AS (SELECT lpad(CAST(vec_id AS VARCHAR), 9, '0') AS id, label, vec_id AS ord, CAST(embedding AS DOUBLE[]) AS x, CASE WHEN vec_id % 3 = 0 THEN 2 ELSE 0 END AS n
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
ways AS (SELECT a.id AS a, b.id AS b, a.ord AS ao, b.ord AS bo, list_cosine_similarity(a.x, b.x) AS similarity FROM v a JOIN v b ON a.label = b.label AND a.id <> b.id WHERE list_cosine_similarity(a.x, b.x) >= 0.3),
best AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY similarity DESC, bo) AS nth FROM ways QUALIFY nth <= 50),
met AS (SELECT least(a, b) AS a, greatest(a, b) AS b, max(similarity) AS similarity, min({'ao': ao, 'nth': nth}) AS met FROM best GROUP BY 1, 2),
line AS (SELECT met.*, x.n >= y.n AS keeps, row_number() OVER (ORDER BY met, a, b) AS i FROM met JOIN v x ON x.id = a JOIN v y ON y.id = b),
walk AS (SELECT 0::BIGINT AS i, CAST([] AS VARCHAR[]) AS gone UNION ALL
  SELECT line.i, CASE WHEN list_contains(gone, a) OR list_contains(gone, b) THEN gone ELSE list_append(gone, CASE WHEN keeps THEN b ELSE a END) END FROM walk JOIN line ON line.i = walk.i + 1)
SELECT CASE WHEN keeps THEN a ELSE b END AS merged_id, CASE WHEN keeps THEN b ELSE a END AS absorbed_id, round(similarity, 6) AS similarity
FROM walk JOIN line ON line.i = walk.i + 1 WHERE NOT list_contains(gone, a) AND NOT list_contains(gone, b)"""


@query("greedy_merges", GREEDY)
def greedy_merges(spark, sf_dir):
    nodes = vector_nodes(spark, sf_dir)
    return vectors.merges(vectors.candidates(nodes, 0.3), nodes).withColumn("similarity", F.round("similarity", 6))


#: Terms of the index queries.
TERMS = ("the and", "ion", "Of", "über", "clown")

_HITS = " UNION ALL ".join(f"SELECT '{t}' AS term, id FROM {{0}} WHERE contains(lower(text), lower('{t}'))" for t in TERMS)


@query("indexed_search", f"WITH t AS (SELECT doc_id AS id, text FROM documents) {_HITS.format('t')}")
def indexed_search(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    index = trigrams.TextIndex(spark)
    for k in range(2):  # in two batches
        index.add(docs.filter(F.pmod(F.xxhash64("id"), F.lit(2)) == k), f"b{k}")
    out = None
    for term in TERMS:
        own = index.search(term).select(F.lit(term).alias("term"), "id")
        out = own if out is None else out.unionByName(own)
    return out


@query("indexed_scores", "SELECT id, CAST(contains(t, 'steel') AS BIGINT) + CAST(contains(t, 'red') AS BIGINT) + CAST(contains(t, 'polished') AS BIGINT) AS score FROM (SELECT p_partkey AS id, lower(p_name || ' ' || p_type) AS t FROM part) x WHERE contains(t, 'steel') OR contains(t, 'red') OR contains(t, 'polished')")
def indexed_scores(spark, sf_dir):
    index = trigrams.TextIndex(spark)
    index.add(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_type").alias("text")), "parts")
    return index.scored(["steel", "red", "polished"])


#: A customer's state is their last order of a year, which is a version; where its status is P the state is removed.
STATES = """c AS (SELECT o_custkey AS id, year(o_orderdate) AS v, o_orderkey, o_orderstatus AS status, o_totalprice AS price FROM orders),
l AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY id, v ORDER BY o_orderkey DESC) = 1)"""


def _year_changes(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.year("o_orderdate").alias("version"), "o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))
    last = o.groupBy("id", "version").agg(F.max(F.struct("o_orderkey", "status", "price")).alias("l"))
    return last.select("id", "version", "l.status", "l.price", (F.col("l.status") == "P").alias("removed"))


def _versions(spark, sf_dir):
    store, changes = versions.Versions(spark), _year_changes(spark, sf_dir)
    for year in range(1995, 2002):
        store.commit(changes.filter(F.col("version") == year).drop("version"), year)
    return store


@query(
    "states_as_of",
    f"""WITH {STATES}, y AS (SELECT unnest(generate_series(1995, 2001)) AS version)
SELECT version, id, status, price FROM (SELECT version, l.*, row_number() OVER (PARTITION BY version, id ORDER BY v DESC) AS n FROM y JOIN l ON v <= version) x WHERE n = 1 AND status <> 'P'""",
)
def states_as_of(spark, sf_dir):
    store, out = _versions(spark, sf_dir), None
    for year in range(1995, 2002):
        own = store.as_of(year).select(F.lit(year).cast("long").alias("version"), "id", "status", "price")
        out = own if out is None else out.unionByName(own)
    return out


@query(
    "state_intervals",
    f"""WITH {STATES}, n AS (SELECT *, lead(v) OVER (PARTITION BY id ORDER BY v) AS next FROM l) SELECT id, status, price, CAST(v AS INTEGER) AS since, CAST(next AS INTEGER) AS until FROM n WHERE status <> 'P'""",
)
def state_intervals(spark, sf_dir):
    return versions.intervals(_year_changes(spark, sf_dir), removed="removed")


@query(
    "events_with_state",
    f"""WITH {STATES}, e AS (SELECT row_number() OVER () AS rid, l_orderkey, l_linenumber, o_custkey AS id, year(o_orderdate) - 1 AS version FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE year(o_orderdate) > 1995)
SELECT l_orderkey, l_linenumber, status FROM (SELECT e.*, l.status, row_number() OVER (PARTITION BY rid ORDER BY v DESC) AS n FROM e JOIN l ON l.id = e.id AND l.v <= e.version) x WHERE n = 1 AND status <> 'P'""",
)
def events_with_state(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").filter(F.year("o_orderdate") > 1995).select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("id"), (F.year("o_orderdate") - 1).alias("version"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").join(orders, "l_orderkey")
    return _versions(spark, sf_dir).joined(lines).select("l_orderkey", "l_linenumber", "status")


#: Three scans of the documents as files: some are there from the second on, some go, the texts of some change with each.
SCANS = """s AS (SELECT CAST(n AS INTEGER) AS number, 'doc' || doc_id AS file, CASE WHEN doc_id % 5 = 0 THEN n || '' ELSE '' END || sha256(coalesce(text, '')) AS hash
  FROM documents, (SELECT unnest([0, 1, 2]) AS n) v WHERE (n = 0 AND doc_id % 3 <> 0) OR (n = 1 AND doc_id % 3 <> 1) OR (n = 2 AND doc_id % 4 <> 0))"""


@query(
    "watched_changes",
    f"""WITH {SCANS} SELECT coalesce(b.number, a.number + 1) AS number, coalesce(b.file, a.file) AS file, CASE WHEN a.file IS NULL THEN 'add' WHEN b.file IS NULL THEN 'unlink' ELSE 'change' END AS event
FROM (SELECT * FROM s WHERE number < 2) a FULL JOIN s b ON b.number = a.number + 1 AND b.file = a.file WHERE a.hash IS DISTINCT FROM b.hash""",
)
def watched_changes(spark, sf_dir):
    """The changes as a stream over scans that come one by one; the stream is started again after each."""
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("doc"), "doc_id").alias("file"), "doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash"))
    root, out = scratch(spark, "manifests"), scratch(spark, "changes")
    for number, there in enumerate(("doc_id % 3 <> 0", "doc_id % 3 <> 1", "doc_id % 4 <> 0")):
        scan = docs.filter(there).withColumn("hash", F.concat(F.when(F.col("doc_id") % 5 == 0, str(number)).otherwise(""), "hash"))
        watch.snapshot(scan, root, number)
        stream = watch.watched(spark, root).writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
        stream.awaitTermination()
    return spark.read.schema("number int, file string, event string, hash string").parquet(f"{out}/rows").drop("hash")


@query(
    "circuit_changes",
    """WITH RECURSIVE e AS (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS "at", event_type = 'error' AS failed, row_number() OVER (PARTITION BY user_id ORDER BY CAST(floor(epoch(ts)) AS BIGINT), event_id) AS i FROM events),
walk(user_id, i, run, until, opened, closed) AS (SELECT DISTINCT user_id, 0::BIGINT, 0, 0::BIGINT, NULL::BIGINT, NULL::BIGINT FROM e UNION ALL
  SELECT user_id, i, CASE WHEN "at" < until THEN 0 WHEN n >= 2 THEN 0 ELSE n END, CASE WHEN "at" < until THEN until WHEN n >= 2 THEN "at" + 3600 ELSE 0 END,
    CASE WHEN "at" >= until AND n >= 2 THEN "at" END, CASE WHEN until > 0 AND "at" >= until THEN until END
  FROM (SELECT e.user_id, e.i, e."at", until, CASE WHEN failed THEN CASE WHEN until > 0 THEN 0 ELSE run END + 1 ELSE 0 END AS n FROM walk JOIN e ON e.user_id = walk.user_id AND e.i = walk.i + 1) x),
last AS (SELECT user_id, until FROM walk QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY i DESC) = 1)
SELECT user_id, 'opened' AS change, opened AS "at" FROM walk WHERE opened IS NOT NULL UNION ALL SELECT user_id, 'closed', closed FROM walk WHERE closed IS NOT NULL
UNION ALL SELECT user_id, 'closed', until FROM last WHERE until > 0 AND until < (SELECT epoch(max(ts)) FROM events) - 10""",
)
def circuit_changes(spark, sf_dir):
    """The events as a file stream: circuits open and close by timers, results in a table of the shared folder."""
    out = scratch(spark, "circuits")
    source = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/[e]vents.parquet")
    with circuits.timed_state(spark):
        stream = circuits.circuits(source, 2, 3600).writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
        stream.awaitTermination()
    return spark.read.schema(circuits.OUT).parquet(f"{out}/rows")


@query(
    "page_matches",
    """SELECT page_id, 'link' AS kind, CAST(i AS INTEGER) AS place, x[i] AS value FROM (SELECT page_id, x, unnest(generate_series(1, len(x))) AS i FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS x FROM pages) a) b
UNION ALL SELECT page_id, 'heading', CAST(i AS INTEGER), x[i] FROM (SELECT page_id, x, unnest(generate_series(1, len(x))) AS i FROM (SELECT page_id, regexp_extract_all(html, '<h[1-6][^>]*>([^<]*)</h', 1) AS x FROM pages) a) b""",
)
def page_matches(spark, sf_dir):
    tables.register(spark)
    pages = table(spark, sf_dir, "pages").select("page_id", "html")
    sql = "SELECT page_id, '{}' AS kind, place, value FROM matches(TABLE({{pages}}) PARTITION BY page_id, text => 'html', pattern => '{}')"
    links = spark.sql(sql.format("link", 'href="(?P<value>[^"]*)"'), pages=pages)
    return links.unionByName(spark.sql(sql.format("heading", "<h[1-6][^>]*>(?P<value>[^<]*)</h"), pages=pages))
