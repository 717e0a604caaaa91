"""Scores of answers, gates of refinement, and what strategies cost in tokens."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions.text import class_tokens, next_version, occurrences, revised_prompt, substring_difference, tokens

from .substrings import contained

FAILS_BELOW = 0.6


def composite(confidence: Column, efficiency: Column, tier: Column) -> Column:
    """0.4 confidence + 0.3 efficiency + 0.3 of the tier's third, between 0 and 1."""
    return 0.4 * confidence + 0.3 * efficiency + 0.3 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), tier / 3))


def summary(scores: DataFrame) -> DataFrame:
    """Mean score, failures and failure rate of scores (score)."""
    bad = (F.col("score") < FAILS_BELOW).cast("int")
    return scores.agg(F.coalesce(F.avg("score"), F.lit(0.0)).alias("average"), F.coalesce(F.sum(bad), F.lit(0)).alias("failures"), F.coalesce(F.avg(bad.cast("double")), F.lit(0.0)).alias("failure_rate"))


def gate(tuning: DataFrame, validation: DataFrame) -> DataFrame:
    """Passed if the validation average is 0.6 or more and at most 0.1 below the tuning one; not with an empty side."""
    a = tuning.agg(F.avg("score").alias("tuning"))
    b = validation.agg(F.avg("score").alias("validation"))
    ok = (F.col("validation") >= FAILS_BELOW) & (F.col("validation") - F.col("tuning") >= -0.1)
    return a.crossJoin(b).select("tuning", "validation", F.coalesce(ok, F.lit(False)).alias("passed"))


def improvement(before: DataFrame, after: DataFrame) -> DataFrame:
    """Changes of scores paired by place (ord): mean, greatest, and counts beyond 0.05 either way. Sides of two lengths are an error."""
    b = after.select("ord", F.col("score").alias("now"))
    pairs = before.join(b, "ord", "full_outer")
    change = F.when(F.col("score").isNull() | F.col("now").isNull(), F.raise_error(F.lit("score lists differ in length")).cast("double")).otherwise(F.col("now") - F.col("score"))
    d = pairs.select(change.alias("d"))
    return d.agg(F.avg("d").alias("mean"), F.max("d").alias("most"), F.count_if(F.col("d") > 0.05).alias("better"), F.count_if(F.col("d") < -0.05).alias("worse"))


def density(nodes: Column, words: Column) -> Column:
    """Nodes for each 1000 words; 0 without words."""
    return F.when(words > 0, nodes * 1000 / words).otherwise(0.0)


def quality(gap: Column) -> Column:
    """Grade of the ratio between model and parser nodes."""
    return F.when(gap >= 0.8, "good").when(gap >= 0.5, "fair").otherwise("poor")


def weak_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, reason): low confidence, no embedding, or no edge in a graph of over ten nodes. ``nodes`` has id, confidence, embedding."""
    lonely = nodes.join(edges.select(F.explode(F.array("source", "target")).alias("id")).distinct(), "id", "left_anti")
    many = nodes.agg((F.count("*") > 10).alias("many"))
    parts = nodes.filter("confidence < 0.7").select("id", F.lit("low_confidence").alias("reason"))
    parts = parts.unionByName(nodes.filter("embedding IS NULL").select("id", F.lit("no_embedding").alias("reason")))
    return parts.unionByName(lonely.crossJoin(F.broadcast(many)).filter("many").select("id", F.lit("isolated").alias("reason")))


def root_causes() -> Column:
    """Why a traced answer (tier, n_weak, miss_rate, tokens, n_pages, prompt_version) was poor."""
    rules = [("low_tier", "tier < 3"), ("weak_nodes", "n_weak > 0"), ("cache_misses", "miss_rate > 0.5"), ("many_tokens", "tokens > 50000"), ("few_pages", "n_pages < 3"), ("first_prompt", "prompt_version = 'v1'")]
    return F.filter(F.array(*[F.when(F.expr(c), n) for n, c in rules]), lambda x: x.isNotNull())


#: What a trace without cache entries, and one with the first prompt, adds to the diagnosis.
SYSTEM_ROWS = (("SYSTEM", "Cache System", 0.3), ("PROMPTS", "Extraction Prompts", 0.4))


def diagnosed(weak: DataFrame, traces: DataFrame) -> DataFrame:
    """(trace, id, label, impact), the greatest impact first: each weak node (trace, id, label, in_wiki) of a trace (trace, tier, tokens, cached,
    prompt_version), a row for the cache if nothing was cached, and one for the prompts if they are the first version."""
    rows = weak.join(traces, "trace").select("trace", "id", "label", impact().cast("double").alias("impact"))
    for (name, label, value), rule in zip(SYSTEM_ROWS, ("cached = 0", "prompt_version = 'v1'"), strict=True):
        rows = rows.unionByName(traces.filter(rule).select("trace", F.lit(name).alias("id"), F.lit(label).alias("label"), F.lit(value).alias("impact")))
    return rows.orderBy("trace", F.desc("impact"), "id")


def granularity(counts: DataFrame) -> DataFrame:
    """(file, gap, density, quality) of counts (file, parsed, modelled, words): model nodes for each parser node (1 without any),
    model nodes for each 1000 words, and the gap's grade."""
    gap = F.when(F.col("parsed") > 0, F.col("modelled") / F.col("parsed")).otherwise(1.0)
    return counts.select("file", gap.alias("gap"), density(F.col("modelled"), F.col("words")).alias("density"), quality(gap).alias("quality"))


def revised(prompts: DataFrame, most: int = 200) -> DataFrame:
    """(version, prompt, accepted): the prompt that a model's answer holds (version, prompt, answer), taken as the next version if it differs
    from the old one by ``most`` characters or fewer, else the old one."""
    new = revised_prompt(F.col("answer"), F.col("prompt"))
    fits = (substring_difference(F.col("prompt"), new) <= most) & (new != F.col("prompt"))
    return prompts.select(F.when(fits, next_version(F.col("version"))).otherwise(F.col("version")).alias("version"), F.when(fits, new).otherwise(F.col("prompt")).alias("prompt"), fits.alias("accepted"))


def impact() -> Column:
    """Impact of a failed query (tier, in_wiki, tokens): 0.1 and what speaks against it."""
    return F.lit(0.1) + F.when(F.col("tier") < 3, 0.15).otherwise(0.0) + F.when(~F.col("in_wiki"), 0.2).otherwise(0.0) + F.when(F.col("tokens") > 40000, 0.1).otherwise(0.0)


def missing_elements(parsed: DataFrame, modelled: DataFrame) -> DataFrame:
    """Labels of ``parsed`` that no label of ``modelled`` equals or contains, or is contained in, without punctuation."""
    plain = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    b = modelled.select(plain(F.col("label")).alias("m")).filter("m <> ''").distinct()
    a = parsed.select("label", plain(F.col("label")).alias("p"))
    own = a.select("p").filter("p <> ''").distinct()
    known = contained(own, "p", b, "m").select("p").union(contained(b, "m", own, "p").select("p")).distinct()
    blank = modelled.filter(plain(F.col("label")) != "").limit(1).select(F.lit("").alias("p"))
    return a.join(known.union(blank), "p", "left_anti").select("label")


def terms_of(question: str) -> list[str]:
    return [t for t in re.split(r"\s+", question.lower()) if t]


def grep_cost(files: DataFrame, question: str, most: int = 10, answer_tokens: int = 0) -> DataFrame:
    """(method, tokens, files): files that hold any word; the first ten are read."""
    hit = F.lit(False)
    for t in terms_of(question):
        hit = hit | F.lower("text").contains(t)
    read = files.filter(hit).orderBy("ord").limit(most)
    own = -(-len(question) // 4) + answer_tokens
    return read.agg(F.lit("grep").alias("method"), (F.coalesce(F.sum(tokens(F.col("text"))), F.lit(0)) + own).alias("tokens"), F.count("*").alias("files"))


def naive_cost(files: DataFrame, question: str) -> DataFrame:
    """(method, tokens, files, matches): every file is read; how often its words occur."""
    count = F.lit(0).cast("bigint")
    for t in terms_of(question):
        count = count + occurrences(F.col("text"), t)
    own = -(-len(question) // 4)
    return files.agg(F.lit("naive").alias("method"), (F.coalesce(F.sum(tokens(F.col("text"))), F.lit(0)) + own).alias("tokens"), F.count("*").alias("files"), F.coalesce(F.sum(count), F.lit(0)).alias("matches"))


def rag_cost(files: DataFrame, question: str, most: int = 5) -> DataFrame:
    """(method, tokens, files): the first five files, once as context and once in the message."""
    own = -(-len(question) // 4)
    return files.orderBy("ord").limit(most).agg(F.lit("rag").alias("method"), (2 * F.coalesce(F.sum(tokens(F.col("text"))), F.lit(0)) + own).alias("tokens"), F.count("*").alias("files"))


#: Fixed value: what a tiered answer loads.
TIER_CONTEXT = "Graph wiki context loaded from knowledge graph."


def tiered_cost(questions: DataFrame) -> DataFrame:
    """(question, method, tokens, files): the tiered method's cost of each question by formula: twice the question, the context once and
    three times again, and the sentence that tells it."""
    context = -(-len(TIER_CONTEXT) // 4)
    spent = 2 * tokens(F.col("question")) + 4 * context
    said = F.length(F.format_string("tiered approach consumed %d tokens with optimal precision.", spent)) + 10
    return questions.select("question", F.lit("tiered").alias("method"), (spent + F.ceil(said / 4)).cast("bigint").alias("tokens"), F.lit(3).cast("bigint").alias("files"))


def all_costs(files: DataFrame, questions: list[str]) -> DataFrame:
    """(question, method, tokens, files) of each question (a stated list) by every method."""
    out = tiered_cost(files.sparkSession.createDataFrame([(q,) for q in questions], "question string"))
    for q in questions:
        for cost in (grep_cost(files, q), naive_cost(files, q), rag_cost(files, q)):
            out = out.unionByName(cost.select(F.lit(q).alias("question"), "method", "tokens", "files"))
    return out


def cheapest(runs: DataFrame) -> DataFrame:
    """The method of least mean tokens, and the single run of least tokens, of runs (method, tokens)."""
    mean = runs.groupBy("method").agg(F.avg("tokens").alias("mean"))
    return mean.agg(F.min_by("method", F.struct("mean", "method")).alias("by_mean")).crossJoin(runs.agg(F.min_by("method", F.struct("tokens", "method")).alias("by_run")))


def break_even(build: Column, base: Column, graph: Column) -> Column:
    """Questions after which building the graph pays; infinite if it never does."""
    return F.when(base - graph > 0, F.ceil(build / (base - graph)).cast("double")).otherwise(F.lit(float("inf")))


def regressions(runs: DataFrame) -> DataFrame:
    """Runs (method, ord, tokens) that took over 10 % more tokens than the one before."""
    last = F.lag("tokens").over(Window.partitionBy("method").orderBy("ord"))
    return runs.withColumn("last", last).filter("last > 0 AND tokens > 1.1 * last")


def message_tokens(messages: DataFrame, key: str, text: str) -> DataFrame:
    """Tokens of each conversation: those of its messages, four more for each, and three."""
    return messages.groupBy(key).agg((F.sum(tokens(F.col(text)) + 4) + 3).alias("tokens"))


def counters(calls: DataFrame, by: str) -> DataFrame:
    """Tokens in all, calls, and tokens a call."""
    return calls.groupBy(by).agg(F.sum("tokens").alias("total"), F.count("*").alias("calls"), F.avg("tokens").alias("average"))


def class_message_tokens(messages: DataFrame, key: str, text: str, name: str | None = None) -> DataFrame:
    """Tokens of each conversation by the class-based count: 4 and its own for each message, its name's and 1 if it has one, and 6."""
    each = F.lit(4) + class_tokens(F.col(text)) + (F.coalesce(class_tokens(F.col(name)) + 1, F.lit(0)) if name else F.lit(0))
    return messages.groupBy(key).agg((F.sum(each) + 6).cast("bigint").alias("tokens"))


def running_tokens(calls: DataFrame, by: str, order: list[str], budget: int = 150_000) -> DataFrame:
    """Running totals of calls (tokens) within ``by``, and whether they are over 80 % of the budget."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return calls.withColumn("total", F.sum("tokens").over(w)).withColumn("warn", F.col("total") > 0.8 * budget)
