"""Scalar functions over text: HTML, hashes, slugs, escapes, token estimates."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def html_title(html: Column) -> Column:
    """Text of the first title element, trimmed; null without one."""
    return F.nullif(F.trim(F.regexp_extract(html, r"(?i)<title[^>]*>([^<]+)</title>", 1)), F.lit(""))


#: What becomes what when HTML turns to text, in this order.
HTML_STEPS = (
    (r"(?is)<script[^>]*>.*?</script>", ""),
    (r"(?is)<style[^>]*>.*?</style>", ""),
    (r"(?is)<noscript[^>]*>.*?</noscript>", ""),
    (r"(?s)<!--.*?-->", ""),
    (r"<[^>]+>", " "),
    ("&nbsp;", " "),
    ("&amp;", "&"),
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    (r"\s+", " "),
)


def html_text(html: Column) -> Column:
    out = html
    for pattern, by in HTML_STEPS:
        out = F.regexp_replace(out, pattern, by)
    return F.trim(out)


def description(text: Column) -> Column:
    return F.substring(text, 1, 500)


def og(html: Column, name: str) -> Column:
    """Content of a meta element by property or name; null without one."""
    return F.nullif(F.regexp_extract(html, rf'(?i)<meta[^>]+(?:property|name)="{name}"[^>]+content="([^"]*)"', 1), F.lit(""))


def tweet_id(url: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(url, r"/status/(\d+)", 1), F.lit("")), F.substring(F.sha2(url, 256), 1, 16))


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def cache_key(question: Column) -> Column:
    """q_ and the absolute 32-bit 31-hash of the trimmed lower-case question in base 36. Astral characters count as one."""
    codes = F.transform(F.split(F.lower(F.trim(question)), ""), lambda c: F.ascii(c).cast("bigint"))
    wrapped = lambda x: F.pmod(x + F.lit(1 << 31), F.lit(1 << 32)) - F.lit(1 << 31)
    value = F.aggregate(F.filter(codes, lambda c: c > 0), F.lit(0).cast("bigint"), lambda h, c: wrapped(h * 31 + c))
    return F.concat(F.lit("q_"), F.lower(F.conv(F.abs(value).cast("string"), 10, 36)))


def tokens(text: Column) -> Column:
    """Estimate: characters / 4, rounded up."""
    return F.ceil(F.length(F.coalesce(text, F.lit(""))) / 4).cast("bigint")


#: Where a text is cut into tokens, and what classes of tokens hold.
TOKEN_CUTS = r"(?<=\s)(?=\S)|(?<=\S)(?=\s)|(?<=[.,!?;:])(?=\S)|(?<=\S)(?=[.,!?;:])"
ASCII_WORD = r"""^[a-zA-Z0-9\s.,!?;:'"-]+$"""
CJK = r"[\x{4e00}-\x{9fff}\x{3040}-\x{30ff}]"
SYMBOLS = r"^[\[\]{}()<>@#$%^&*+=~/\\|]+$"


def class_tokens(text: Column) -> Column:
    """Estimate by class of each token: plain ASCII / 4, with CJK its characters, other Unicode / 2, symbols one each, else / 4
    (quotients rounded up, white space nothing); 3 more if there is any and no CJK in the text."""
    parts = F.filter(F.split(F.regexp_replace(text, r"\s+", " "), TOKEN_CUTS), lambda p: F.trim(p) != "")

    def each(p: Column) -> Column:
        n = F.length(p)
        return F.when(p.rlike(ASCII_WORD), F.ceil(n / 4)).when(p.rlike(CJK), n.cast("bigint")).when(p.rlike(r"[^\x00-\x7F]"), F.ceil(n / 2)).when(p.rlike(SYMBOLS), n.cast("bigint")).otherwise(F.ceil(n / 4))

    total = F.aggregate(F.transform(parts, each), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return F.when((total > 0) & ~text.rlike(CJK), total + 3).otherwise(total)


def sanitized_label(label: Column) -> Column:
    """Without control characters, 256 characters at most, HTML-escaped."""
    out = F.substring(F.regexp_replace(label, r"[\x00-\x1F\x7F]", ""), 1, 256)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def cypher_escaped(value: Column) -> Column:
    out = value
    for c in ("\\", "'", '"'):
        out = F.replace(out, F.lit(c), F.lit("\\" + c))
    return out


def xml_escaped(value: Column) -> Column:
    out = value
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def js_escaped(value: Column) -> Column:
    out = value
    for a, b in (("\\", "\\\\"), ("'", "\\'"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def file_name(name: Column) -> Column:
    return F.substring(F.trim(F.regexp_replace(F.regexp_replace(name, r'[<>:"/\\|?*]', "-"), r"\s+", " ")), 1, 100)


def path_slug(path: Column) -> Column:
    return F.regexp_replace(path, "[^a-zA-Z0-9]", "_")


def label_slug(label: Column) -> Column:
    return F.regexp_replace(F.lower(label), "[^a-z0-9]+", "-")


def question_slug(question: Column) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(question), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, 40)


def section_header(kind: Column) -> Column:
    return F.concat(F.upper(F.substring(kind, 1, 1)), F.substr(kind, F.lit(2)), F.when(kind.endswith("s"), "").otherwise("s"))


def header_type(header: Column) -> Column:
    """What a section's header was made from: in small letters, without one s at its end."""
    return F.lower(F.regexp_replace(header, "(?i)s$", ""))


def fixed(value: Column, places: int) -> Column:
    """A number with so many places, half away from zero by its decimal digits."""
    return F.format_string(f"%.{places}f", F.round(value.cast("double"), places))


def xxhash_hex(text: Column) -> Column:
    """XXH64 with seed 0, as 16 hexadecimal digits. Spark's own hash of that name has another seed; this one runs in Arrow batches."""
    @F.pandas_udf("string")
    def digest(values: pd.Series) -> pd.Series:
        import xxhash

        return values.map(lambda v: None if v is None else xxhash.xxh64_hexdigest(v.encode()))

    return digest(text)


def bpe_tokens(text: Column, encode=None) -> Column:
    """Number of tokens by ``encode(str) -> list``, in Arrow batches; without one, the estimate by characters."""
    if encode is None:
        return tokens(text)
    @F.pandas_udf("long")
    def count(values: pd.Series) -> pd.Series:
        return values.map(lambda v: len(encode(v or "")))

    return count(text)


#: Colours of communities, and of nodes without one.
PALETTE = ("#6366f1", "#22c55e", "#f59e0b", "#ef4444", "#8b5cf6", "#06b6d4", "#ec4899", "#14b8a6", "#f97316", "#84cc16")
NO_COLOUR = "#6b7280"


def community_colour(community: Column) -> Column:
    return F.when(community.isNull(), NO_COLOUR).otherwise(F.element_at(F.array(*map(F.lit, PALETTE)), (F.pmod(community, F.lit(10)) + 1).cast("int")))


def substring_difference(a: Column, b: Column, most: int = 200) -> Column:
    """|difference of lengths| and the part of the shorter text after the common prefix; one more than ``most`` if the lengths differ by more."""
    shorter = F.least(F.length(a), F.length(b))
    ca, cb = F.split(a, ""), F.split(b, "")
    same = F.aggregate(F.zip_with(F.slice(ca, 1, F.greatest(shorter, F.lit(1))), F.slice(cb, 1, F.greatest(shorter, F.lit(1))), lambda x, y: x == y), F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, e: F.struct((s["n"] + F.when(s["on"] & e, 1).otherwise(0)).alias("n"), (s["on"] & e).alias("on")))["n"]
    gap = F.abs(F.length(a) - F.length(b))
    return F.when(gap > most, F.lit(most + 1)).when(shorter == 0, gap).otherwise(gap + shorter - same)


def revised_prompt(answer: Column, original: Column) -> Column:
    """The first fenced block, else the paragraph after a marker, else the first five lines with text as one (over ten characters), else the original."""
    block, marker = r"(?s)```\w*\n?(.*?)```", r"(?is)revised prompt:\s*(.*?)(?:\n\n|\z)"
    lines = F.trim(F.array_join(F.slice(F.filter(F.split(answer, "\n"), lambda x: F.trim(x) != ""), 1, 5), " "))
    bare = lambda p: F.regexp_replace(F.regexp_extract(answer, p, 1), r"^\s+|\s+$", "")
    return F.when(answer.rlike(block), bare(block)).when(answer.rlike(marker), bare(marker)).when(F.length(lines) > 10, lines).otherwise(original)


def next_version(version: Column) -> Column:
    return F.concat(F.lit("v"), (F.regexp_extract(version, r"^v(\d+)$", 1).try_cast("int") + 1).cast("string"))


def backoff_ms(failures: Column, base: float = 1000, factor: float = 2, most: float = 60000, jitter: float = 0.0, seed: int = 0) -> Column:
    """Delay before the next attempt; with ``jitter`` up to that part of it more or less, drawn by the seed."""
    delay = F.least(base * F.pow(F.lit(factor), failures - 1), F.lit(float(most)))
    return delay * (1 + jitter * (2 * F.rand(seed) - 1)) if jitter else delay


def rate_limited(message: Column) -> Column:
    return message.rlike("(?i)rate.?limit|429|too many requests")


def cost_per_million(provider: Column, model: Column, prices: dict[str, dict[str, float]], default: float = 5.0) -> Column:
    """Price of a million tokens from a table of providers and models."""
    known = [x for p, models in prices.items() for m, cost in models.items() for x in (F.lit(f"{p}/{m}"), F.lit(float(cost)))]
    table = F.create_map(*known) if known else F.create_map().cast("map<string,double>")
    return F.coalesce(F.try_element_at(table, F.concat_ws("/", provider, model)), F.lit(default))


def stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH-mm-ss-SSS'Z'")


def occurrences(text: Column, term: str) -> Column:
    """How often a literal term occurs, without regard to case."""
    import re

    return F.regexp_count(text, F.lit("(?i)" + re.escape(term))).cast("bigint")
