"""Predicates and classes of files, URLs and model output."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Language by file extension, and the classes of other extensions.
LANGUAGES = {
    ".ts": "TypeScript", ".tsx": "TypeScript",
    ".js": "JavaScript", ".jsx": "JavaScript", ".mjs": "JavaScript", ".cjs": "JavaScript",
    ".py": "Python", ".pyi": "Python",
    ".go": "Go",
    ".rs": "Rust",
    ".java": "Java", ".kt": "Kotlin", ".kts": "Kotlin", ".scala": "Scala",
    ".c": "C", ".h": "C",
    ".cpp": "C++", ".cc": "C++", ".cxx": "C++", ".hpp": "C++", ".hxx": "C++",
    ".cs": "C#",
    ".rb": "Ruby",
    ".php": "PHP",
    ".swift": "Swift",
    ".lua": "Lua",
    ".ex": "Elixir", ".exs": "Elixir",
    ".sh": "Bash", ".bash": "Bash", ".zsh": "Bash", ".fish": "Bash",
}
IMAGES = (".png", ".jpg", ".jpeg", ".gif", ".webp", ".bmp", ".svg")
PLAIN = (".txt", ".text", ".log", ".json", ".jsonl", ".yaml", ".yml", ".toml", ".xml", ".html", ".css")
MODEL_NATIVE = (".pdf", ".docx", ".pptx", ".rtf", ".png", ".jpg", ".jpeg", ".gif", ".webp")
DOCS = (".md", ".pdf", ".txt", ".rst", ".adoc")
MEDIA = (".mp4", ".mov", ".avi", ".mkv", ".webm", ".mp3", ".wav", ".m4a", ".ogg", ".flac")


CONFIDENCES = ("EXTRACTED", "INFERRED", "AMBIGUOUS")

#: Forms of addresses, and of those that must not be fetched.
TWEET = r"(?i)^https?://(www\.)?(twitter\.com|x\.com)/"
PDF = r"(?i)\.pdf(\?.*)?$|/pdf/"
VIDEO = r"(?i)^https?://(www\.)?(youtube\.com/watch|youtu\.be/|vimeo\.com/)"
SOUND = r"(?i)\.(mp3|m4a|ogg|flac|wav|aac|opus)(\?.*)?$"
PRIVATE = r"^(127|10)\.\d+\.\d+\.\d+$|^192\.168\.\d+\.\d+$|^172\.(1[6-9]|2\d|3[01])\.\d+\.\d+$|^169\.254\.\d+\.\d+$"


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def language(path: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.try_element_at(pairs, extension(path))


def file_type(path: Column) -> Column:
    e = extension(path)
    out = F.when(e == ".pdf", "pdf").when(e == ".docx", "docx").when(e == ".pptx", "pptx").when(e == ".rtf", "rtf").when(e.isin(*IMAGES), "image")
    return out.when(e.isin(".md", ".mdx", ".markdown"), "markdown").when(e.isin(*LANGUAGES, *PLAIN), "code").otherwise("unsupported")


def extractor(path: Column) -> Column:
    """How a file is read: ast, frontmatter or model_native; null for any other."""
    e = extension(path)
    return F.when(e.isin(*LANGUAGES), "ast").when(e.isin(".md", ".mdx", ".markdown"), "frontmatter").when(e.isin(*MODEL_NATIVE), "model_native")


def watch_class(path: Column) -> Column:
    e = F.lower(F.regexp_extract(path, r"(\.[^.]*)$", 1))
    return F.when(e.isin(*MEDIA), "media").when(e.isin(*DOCS), "doc").otherwise("code")


def url_kind(url: Column) -> Column:
    """What an address holds, by its form alone: tweet, pdf, media or html."""
    out = F.when(url.rlike(TWEET), "tweet").when(url.rlike(PDF), "pdf")
    media = url.rlike(VIDEO) | url.rlike(SOUND)
    return out.when(media, "media-unsupported").otherwise("html")


def url_problem(url: Column) -> Column:
    """Why an address must not be fetched; null if it may. Hosts are judged as written."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?(\[[^\]]*\]|[^/:?#]*)", 1))
    out = F.when(url.isNull() | (scheme == ""), "invalid").when(~scheme.isin("http", "https"), "protocol").when(host == "", "invalid")
    out = out.when(host.isin("localhost", "[::1]", "0.0.0.0"), "localhost").when(host.isin("169.254.169.254", "metadata.google.internal"), "metadata")
    return out.when(host.rlike(PRIVATE), "private")


def path_problem(path: Column, root: str) -> Column:
    return F.when(path.contains("../"), "traversal").when(path.startswith("/") & ~path.startswith(root.rstrip("/") + "/"), "outside")


def glob_pattern(glob: str) -> str:
    """Regular expression of an ignore pattern: ** crosses folders, * and ? do not, a trailing / means all below."""
    out, i = "", 0
    text = glob.rstrip("/") if glob.endswith("/") else glob
    while i < len(text):
        if text.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif text.startswith("**", i):
            out, i = out + ".*", i + 2
        elif text[i] in "*?":
            out, i = out + ("[^/]*" if text[i] == "*" else "[^/]"), i + 1
        else:
            out, i = out + re.escape(text[i]), i + 1
    anchored = "" if "/" in text else "(?:.*/)?"
    return f"^{anchored}{out}(?:/.*)?$"


def ignored(path: Column, patterns: list[str]) -> Column:
    """Whether any pattern matches; false for a null path."""
    if not patterns:
        return F.lit(False)
    return F.coalesce(path.rlike("|".join(f"(?:{glob_pattern(p)})" for p in patterns)), F.lit(False))


def ignore_patterns(lines: list[str]) -> list[str]:
    """Distinct patterns of an ignore file, without blanks and comments."""
    return list(dict.fromkeys(x.strip() for x in lines if x.strip() and not x.strip().startswith("#")))


def page_type(title: Column) -> Column:
    t = F.lower(title)
    return F.when(t.contains("index"), "index").when(t.contains("overview"), "overview").when(t.contains("class ") | t.contains("interface "), "concept").when(t.contains("function ") | t.contains("()"), "entity").otherwise("source-summary")


def path_terms(text: Column) -> Column:
    """Up to five distinct CamelCase words and tails of source paths."""
    camel = F.regexp_extract_all(text, F.lit(r"\b([A-Z][a-z0-9]+(?:[A-Z][a-z0-9]+)+)\b"), F.lit(1))
    tails = F.regexp_extract_all(text, F.lit(r"(?:src|lib|components|services|utils)/([\w./-]+)"), F.lit(1))
    return F.slice(F.array_distinct(F.concat(camel, tails)), 1, 5)


def _blank(c: str) -> Column:
    return F.coalesce(F.trim(c), F.lit("")) == ""


def _problems(*tests: tuple[Column, str]) -> Column:
    return F.filter(F.array(*[F.when(c, F.lit(name)) for c, name in tests]), lambda x: x.isNotNull())


def _odd_confidence() -> Column:
    return F.coalesce(~F.col("confidence").isin(*CONFIDENCES), F.lit(False))


def node_problems() -> Column:
    """All problems of a node row (id, label, type, confidence), in order; the first of them is what a strict check reports. Any
    type that is not blank is allowed, an empty label too, and no confidence."""
    return _problems((_blank("id"), "id"), (_blank("type"), "type"), (F.col("label").isNull(), "label"), (_odd_confidence(), "confidence"))


def edge_problems() -> Column:
    """All problems of an edge row (source, target, label, confidence), as for nodes."""
    return _problems((_blank("source"), "source"), (_blank("target"), "target"), (_blank("label"), "label"), (_odd_confidence(), "confidence"))


def document_problems() -> Column:
    """All problems of an answer (id, nodes, edges): no id, no list of nodes, no list of edges."""
    return _problems((_blank("id"), "id"), (F.col("nodes").isNull(), "nodes"), (F.col("edges").isNull(), "edges"))


def _or(c: str, by: str, empty: bool = True) -> Column:
    return F.when(F.col(c).isNull() | ((F.col(c) == "") if empty else F.lit(False)), by).otherwise(F.col(c))


def _confidence() -> Column:
    return F.when(F.coalesce(F.col("confidence").isin(*CONFIDENCES), F.lit(False)), F.col("confidence")).otherwise("INFERRED")


def coerced_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes whose ids are text, whose missing labels, missing or empty types and unknown confidences have the values given for these."""
    out = nodes.withColumns({"id": F.col("id").cast("string"), "label": _or("label", "(unnamed)", False), "type": _or("type", "entity")})
    return out.withColumn("confidence", _confidence()) if "confidence" in nodes.columns else out


def coerced_edges(edges: DataFrame) -> DataFrame:
    """Edges whose ends are text, whose missing or empty relations and unknown confidences have the values given for these."""
    return edges.withColumns({"source": F.col("source").cast("string"), "target": F.col("target").cast("string"), "label": _or("label", "related_to"), "confidence": _confidence()})
