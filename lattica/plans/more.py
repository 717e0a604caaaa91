"""Further queries: windows, set operations, scalar functions, streams, services."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattica.catalog import query
from lattica.model import scratch
from lattica.functions import files as ff
from lattica.functions import text as tf
from lattica.operators import build, delta, refine, search, vectors, wiki
from lattica.service import Engine
from lattica.streaming import events as ev

from .graph import BASE, trade_graph
from .trade import table


@query("first_wins", "SELECT source, min_by(doc_id, doc_id) AS doc_id FROM documents GROUP BY source")
def first_wins(spark, sf_dir):
    return build.first_wins(table(spark, sf_dir, "documents").withColumn("ord", F.col("doc_id")), ["source"]).select("source", "doc_id")


@query("renumbered", "SELECT doc_id, dense_rank() OVER (ORDER BY f) - 1 AS number FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY source) AS f FROM documents) x")
def renumbered(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    firsts = d.groupBy("source").agg(F.min("doc_id").alias("f"))
    from pyspark.sql import Window

    numbers = firsts.withColumn("number", (F.dense_rank().over(Window.orderBy("f")) - 1).cast("long")).select("source", "number")
    return d.join(numbers, "source").select("doc_id", "number")


@query("set_union", "SELECT lang FROM documents UNION SELECT source FROM documents")
def set_union(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("lang").union(d.select("source")).distinct()


@query("set_difference", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def set_difference(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").subtract(table(spark, sf_dir, "labels").select("doc_id"))


@query("set_intersection", "SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels WHERE toxic = 1")
def set_intersection(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").intersect(table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id"))


@query("canvas_grid", "SELECT page_id, (row_number() OVER (ORDER BY page_id) - 1) % 4 AS col, (row_number() OVER (ORDER BY page_id) - 1) // 4 AS row FROM pages")
def canvas_grid(spark, sf_dir):
    return wiki.grid(table(spark, sf_dir, "pages").select("page_id"), "page_id", 4).select("page_id", F.col("col").cast("long").alias("col"), F.col("row").cast("long").alias("row"))


@query("page_order", f"WITH {BASE} SELECT community, count(*) AS n_nodes FROM nodes GROUP BY community ORDER BY n_nodes DESC, community LIMIT 3")
def page_order(spark, sf_dir):
    n = trade_graph(spark, sf_dir).nodes.groupBy("community").agg(F.count("*").alias("n_nodes"))
    m = n.select("community", "n_nodes", F.lit(0).alias("n_hubs"), F.lit(None).cast("int").alias("dependency_order"), F.col("community").alias("id"))
    return wiki.page_order(m).limit(3).select("community", "n_nodes")


@query("history_until", "SELECT o_orderkey FROM orders WHERE o_orderkey <= (SELECT min(o_orderkey) FROM orders WHERE o_orderstatus = 'P')")
def history_until(spark, sf_dir):
    h = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("version"), F.col("o_orderkey").alias("ord"))
    return delta.history_until(h, "P").select("o_orderkey")


@query("weak_nodes", "SELECT CAST(doc_id AS VARCHAR) AS id, 'low_confidence' AS reason FROM labels WHERE quality = 0 UNION ALL SELECT CAST(doc_id AS VARCHAR), 'no_embedding' FROM labels WHERE toxic = 1")
def weak_nodes(spark, sf_dir):
    n = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("id"), F.col("quality").cast("double").alias("confidence"), F.when(F.col("toxic") == 0, F.array(F.lit(1.0))).alias("embedding"))
    return refine.weak_nodes(n, n.select(F.col("id").alias("source"), F.col("id").alias("target")))


@query("impact", "SELECT doc_id, round(0.1 + CASE WHEN doc_id % 5 < 3 THEN 0.15 ELSE 0 END + CASE WHEN quality = 0 THEN 0.2 ELSE 0 END, 6) AS impact FROM labels")
def impact(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").select("doc_id", (F.col("doc_id") % 5).alias("tier"), (F.col("quality") == 1).alias("in_wiki"), F.lit(0).alias("tokens"))
    return rows.select("doc_id", F.round(refine.impact().cast("double"), 6).alias("impact"))


@query("missing_elements", """WITH p AS (SELECT n_nationkey AS k, n_name AS label, regexp_replace(lower(n_name), '[^a-z0-9]', '', 'g') AS x FROM nation)
SELECT label FROM p WHERE NOT EXISTS (SELECT 1 FROM p q WHERE q.k < 3 AND (contains(p.x, q.x) OR contains(q.x, p.x)))""")
def missing_elements(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    return refine.missing_elements(n.select(F.col("n_name").alias("label")), n.filter("n_nationkey < 3").select(F.col("n_name").alias("label")))


@query("token_regressions", "SELECT conv_id, turn FROM (SELECT conv_id, turn, ceil(length(text) / 4) AS t, lag(ceil(length(text) / 4)) OVER (PARTITION BY conv_id ORDER BY turn) AS l FROM conversations) x WHERE l > 0 AND t > 1.1 * l")
def token_regressions(spark, sf_dir):
    runs = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("method"), F.col("turn").alias("ord"), tf.tokens(F.col("text")).alias("tokens"))
    return refine.regressions(runs).select(F.col("method").alias("conv_id"), F.col("ord").alias("turn"))


@query("break_even", "SELECT p_partkey, CASE WHEN p_retailprice - p_size * 20 > 0 THEN ceil(1000 / (p_retailprice - p_size * 20)) ELSE CAST('inf' AS DOUBLE) END AS questions FROM part")
def break_even(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", refine.break_even(F.lit(1000), F.col("p_retailprice"), F.col("p_size") * 20).alias("questions"))


@query("cache_invalidation", "SELECT user_id FROM (SELECT DISTINCT user_id FROM events) u WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error')")
def cache_invalidation(spark, sf_dir):
    cache = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("key")).agg(F.collect_set("event_type").alias("traversed"))
    return search.cache_without(cache, spark.createDataFrame([("error",)], "id string")).select(F.col("key").alias("user_id"))


@query("rough_embedding", "SELECT p_partkey, round(0.1 * sin(length(p_name) * 1 * 0.1), 6) AS first, round(0.1 * sin(length(p_name) * 384 * 0.1), 6) AS last FROM part")
def rough_embedding(spark, sf_dir):
    e = vectors.rough_embedding(F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", F.round(F.element_at(e, 1), 6).alias("first"), F.round(F.element_at(e, -1), 6).alias("last"))


@query("rough_similarity", "SELECT p_partkey, round(1 - abs(length(p_name) - length(p_type)) / greatest(length(p_name), length(p_type)), 6) AS similarity FROM part")
def rough_similarity(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.round(vectors.rough_similarity(F.col("p_name"), F.col("p_type")), 6).alias("similarity"))


@query("backoff", "SELECT p_partkey, least(1000 * power(2, p_size % 10 - 1), 60000) AS delay FROM part")
def backoff(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", tf.backoff_ms(F.col("p_size") % 10).alias("delay"))


@query("community_colour", "SELECT n_nationkey, ['#6366f1', '#22c55e', '#f59e0b', '#ef4444', '#8b5cf6', '#06b6d4', '#ec4899', '#14b8a6', '#f97316', '#84cc16'][n_nationkey % 10 + 1] AS colour FROM nation")
def community_colour(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", tf.community_colour(F.col("n_nationkey")).alias("colour"))


@query("page_types", "SELECT page_id, CASE WHEN contains(lower(url), 'index') THEN 'index' WHEN contains(lower(url), 'overview') THEN 'overview' ELSE 'source-summary' END AS type FROM pages")
def page_types(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", ff.page_type(F.col("url")).alias("type"))


@query("missing_sources", "SELECT CAST(doc_id AS VARCHAR) AS id, -1 AS community FROM documents WHERE lang = 'en'")
def missing_sources(spark, sf_dir):
    n = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.when(F.col("lang") != "en", F.array("lang")).alias("provenance"), F.lit(None).cast("int").alias("community"))
    return wiki.missing_sources(n)


@query("change_routes", "SELECT event_id, CASE WHEN event_type = 'error' THEN 'removed' WHEN event_id % 3 = 0 THEN 'notify' WHEN event_id % 3 = 1 THEN 'modified' ELSE 'added' END AS route FROM events")
def change_routes(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    name = F.concat("event_id", F.when(F.col("event_id") % 3 == 0, ".mp3").otherwise(".py"))
    rows = e.select("event_id", name.alias("file"), F.when(F.col("event_type") == "error", "unlink").otherwise("change").alias("event"))
    return ev.routed(rows, rows.filter("event_id % 3 = 1").select("file")).select("event_id", "route")


@query("resume_files", "SELECT source AS worker, CAST(doc_id AS VARCHAR) AS file FROM documents WHERE lang <> 'en'")
def resume_files(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("worker"), F.col("doc_id").cast("string").alias("file"), "lang")
    return ev.incomplete(d.select("worker", "file"), d.filter("lang = 'en'"))


@query("stream_breaker")
def stream_breaker(spark, sf_dir):
    """The events as a file stream: state lives across batches, results in a table of the shared folder."""
    out = scratch(spark, "breaker")
    source = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/[e]vents.parquet")
    query_ = ev.breaker(source, 2, 3600).writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    query_.awaitTermination()
    return spark.read.schema("user_id long, opened long").parquet(f"{out}/rows")


@query("tool_status", f"WITH {BASE} SELECT n AS nodes, m AS edges, c AS communities, round(m / (n * (n - 1)), 4) AS density FROM (SELECT count(*) AS n, count(DISTINCT community) AS c FROM nodes) a, (SELECT count(*) AS m FROM sparse) b")
def tool_status(spark, sf_dir):
    return Engine(trade_graph(spark, sf_dir, True)).call("status")
