"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from . import quality

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _op5() -> str:
    rules = "\n".join(f"    | CASE WHEN {rule} THEN {1 << i} ELSE 0 END" for i, rule in enumerate(quality.RULES.values()))
    base, kept = quality.bits(quality.POLICIES["base"]), quality.bits(quality.POLICIES["v1"])
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, {WORDS} AS ws FROM documents
), starts AS (
  SELECT rid, i, array_to_string(list_slice(ws, i, i + 7), ' ') AS w
  FROM d, unnest(generate_series(1, len(ws) - 7)) AS g(i)
), dup AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, w) AS n FROM starts) x WHERE n > 1
), gaps AS (
  SELECT rid, least(8, coalesce(lead(i) OVER (PARTITION BY rid ORDER BY i) - i, 8)) AS g FROM dup
), rep AS (
  SELECT rid, sum(g) AS n_repeat_words FROM gaps GROUP BY rid
), lines AS (
  SELECT rid, count(*) AS n_lines, count(DISTINCT line) AS n_distinct
  FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d) x
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid
), m AS (
  SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
    CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(n_lines - n_distinct, 0) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
    coalesce(n_lines, 0) AS n_lines,
    length(text) - length(regexp_replace(text, '[!-/:-@\[-`{{-~]', '', 'g')) AS n_punctuation,
    length(text) - length(regexp_replace(text, '[0-9]', '', 'g')) AS n_digits
  FROM d LEFT JOIN rep USING (rid) LEFT JOIN lines USING (rid)
), f AS (
  SELECT *, CAST(0
{rules} AS BIGINT) AS failures FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (failures & {base}) <> 0 AS base_failed, (failures & {kept}) = 0 AS kept, failures,
  CASE WHEN bit_count(failures & {kept}) = 1 THEN failures & {kept} ELSE CAST(0 AS BIGINT) END AS kept_without
FROM f"""


OP10 = rf"""
WITH s AS (
  SELECT doc_id, source, CAST(len({WORDS}) AS BIGINT) AS size, md5('7:' || coalesce(CAST(doc_id AS VARCHAR), md5(text), '')) AS spot FROM documents
), by_source AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM s GROUP BY source
), ranked AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 3 * source_size AS cap FROM by_source
), line AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0) AS BIGINT) AS rest,
    CAST(sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS BIGINT) AS weight_left
  FROM ranked WINDOW before AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), level AS (
  SELECT rest, weight_left FROM line WHERE rest * weight <= cap * weight_left ORDER BY cap / weight, source NULLS LAST LIMIT 1
), aims AS (
  SELECT source, source_size, least(CAST(cap AS DOUBLE), weight * level.rest / level.weight_left) AS target FROM ranked, level
), whole AS (
  SELECT *, CAST(round(target) AS BIGINT) AS goal, CASE WHEN source_size > 0 THEN CAST(floor(CAST(round(target) AS BIGINT) / source_size) AS BIGINT) ELSE 0 END AS times FROM aims
), laid AS (
  SELECT s.*, w.source_size, w.target, w.times, w.goal - w.times * w.source_size AS extra,
    coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY spot, size, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone
  FROM s JOIN whole w ON s.source IS NOT DISTINCT FROM w.source
)
SELECT doc_id, size, source_size, target, CAST(times * size + greatest(0, least(size, extra - gone)) AS BIGINT) AS taken FROM laid"""


OP2 = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents
), w AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k, lead(line) OVER (PARTITION BY doc_id ORDER BY pos) AS nxt
  FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), runs AS (
  SELECT doc_id, k, row_number() OVER (PARTITION BY line, nxt ORDER BY doc_id NULLS FIRST, k) > 1 AS later, count(*) OVER (PARTITION BY line, nxt) AS n
  FROM w WHERE nxt IS NOT NULL
), passages AS (
  SELECT doc_id, k, row_number() OVER (PARTITION BY line ORDER BY doc_id NULLS FIRST, k) > 1 AS later
  FROM w WHERE len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) >= 5
), covers AS (
  SELECT doc_id, k + j AS k, later FROM runs, (VALUES (0), (1)) AS o(j) WHERE n > 1
), outside AS (
  SELECT doc_id, k FROM covers GROUP BY doc_id, k HAVING bool_and(later)
), gone AS (
  SELECT doc_id, k, pos FROM w JOIN (SELECT * FROM outside UNION SELECT doc_id, k FROM passages WHERE later) x USING (doc_id, k)
), kept AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (gone.pos IS NULL) AS text, count(gone.pos) AS n_removed_lines
  FROM l LEFT JOIN gone ON l.doc_id = gone.doc_id AND l.pos = gone.pos GROUP BY l.doc_id
), n AS (SELECT doc_id, count(*) AS n_lines FROM w GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed_lines, 0) AS BIGINT) AS n_removed_lines,
  sha256(coalesce(kept.text, '')) AS kept_sha256
FROM documents d LEFT JOIN kept ON d.doc_id = kept.doc_id LEFT JOIN n ON d.doc_id = n.doc_id"""


OP3 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, {WORDS} AS ws FROM documents
), starts AS (
  SELECT rid, i, md5(array_to_string(list_slice(ws, i, i + 34), ' ')) AS h FROM d, unnest(generate_series(1, len(ws) - 34)) AS g(i)
), again AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY h) AS n FROM starts) x WHERE n > 1
), gone AS (
  SELECT DISTINCT rid, i + k AS p FROM again, unnest(generate_series(0, 34)) AS g(k)
), words AS (
  SELECT rid, unnest(ws) AS w, unnest(generate_series(1, len(ws))) AS p FROM d
), kept AS (
  SELECT rid, string_agg(w, ' ' ORDER BY p) AS text, count(*) AS n FROM words ANTI JOIN gone USING (rid, p) GROUP BY rid
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (rid)"""


OP9 = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0
), links AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.x, b.x) >= 0.93
), walk(u, v) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT walk.u, links.v FROM walk JOIN links ON walk.v = links.u
), part AS (SELECT u AS vec_id, min(v) AS component_id FROM walk GROUP BY u),
n AS (SELECT u AS vec_id, count(*) AS n_links FROM links GROUP BY u)
SELECT vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept FROM part LEFT JOIN n USING (vec_id)"""


#: crc32 of an id's decimal text: eight halvings for each byte.
_CRC = (
    "xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT), "
    "lambda acc, b: list_reduce([xor(acc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"
)


def _leaf(text: str) -> str:
    parts = [f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in ("doc_id", "source", "lang", "n_chars", text)]
    return f"sha256({' || '.join(parts)})"


#: The trees grow from the leaves by a level at a time; a claim climbs with its leaf's siblings.
OP12 = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce('s' || source, '') AS k, {_leaf("text")} AS leaf, CASE WHEN {_CRC} % 2 = 0 THEN {_leaf("replace(text, chr(10), '')")} ELSE {_leaf("text")} END AS claim
  FROM documents
), rows AS (
  SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY k) AS total FROM d
), tree AS (
  SELECT k, 0 AS level, i, total AS n, leaf AS h FROM rows
  UNION ALL
  SELECT k, level + 1, i // 3, ceil(any_value(n) / 3.0)::BIGINT, sha256(string_agg(h, '' ORDER BY i)) FROM tree WHERE n > 1 GROUP BY k, level, i // 3
), subroots AS (
  SELECT k, h, row_number() OVER (ORDER BY k) - 1 AS i, count(*) OVER () AS n FROM tree WHERE n = 1
), top AS (
  SELECT 0 AS level, i, n, h FROM subroots
  UNION ALL
  SELECT level + 1, i // 3, ceil(any_value(n) / 3.0)::BIGINT, sha256(string_agg(h, '' ORDER BY i)) FROM top WHERE n > 1 GROUP BY level, i // 3
), runs AS (
  SELECT k, level, i // 3 AS run, list(h ORDER BY i) AS hs FROM tree WHERE n > 1 GROUP BY ALL
), top_runs AS (
  SELECT level, i // 3 AS run, list(h ORDER BY i) AS hs FROM top WHERE n > 1 GROUP BY ALL
), climb AS (
  SELECT k, doc_id, leaf, i AS start, 0 AS level, i, claim AS h, '' AS proof FROM rows
  UNION ALL
  SELECT c.k, doc_id, leaf, start, c.level + 1, i // 3, sha256(array_to_string(hs[:i % 3], '') || c.h || array_to_string(hs[i % 3 + 2:], '')),
    proof || array_to_string(hs[:i % 3], '') || array_to_string(hs[i % 3 + 2:], '')
  FROM climb c JOIN runs r ON r.k = c.k AND r.level = c.level AND r.run = c.i // 3
), risen AS (
  SELECT k, doc_id, leaf, h, proof FROM climb QUALIFY row_number() OVER (PARTITION BY k, start ORDER BY level DESC) = 1
), over AS (
  SELECT risen.k, doc_id, leaf, s.h AS subroot, 0 AS level, s.i, risen.h, proof, row_number() OVER () AS rid FROM risen JOIN subroots s ON s.k = risen.k
  UNION ALL
  SELECT o.k, doc_id, leaf, subroot, o.level + 1, i // 3, sha256(array_to_string(hs[:i % 3], '') || o.h || array_to_string(hs[i % 3 + 2:], '')),
    proof || array_to_string(hs[:i % 3], '') || array_to_string(hs[i % 3 + 2:], ''), rid
  FROM over o JOIN top_runs r ON r.level = o.level AND r.run = o.i // 3
), last AS (
  SELECT * FROM over QUALIFY row_number() OVER (PARTITION BY rid ORDER BY level DESC) = 1
)
SELECT doc_id, leaf, subroot, top.h AS root, sha256(proof) AS proof_sha256, last.h AS folded_root, last.h = top.h AS verified FROM last, top WHERE top.n = 1"""


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

OP13 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_TERMS} AS ts FROM documents WHERE text IS NOT NULL),
size AS (SELECT count(*) AS docs, sum(len(ts))::BIGINT AS words FROM d WHERE len(ts) > 0),
items AS (SELECT q, item_id, unnest(list_distinct({_TERMS})) AS term FROM (SELECT row_number() OVER () AS q, item_id, text FROM benchmark WHERE text IS NOT NULL) b),
tf AS (SELECT rid, doc_id, n, term, count(*) AS tf FROM (SELECT rid, doc_id, len(ts) AS n, unnest(ts) AS term FROM d) x GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY term) x, size),
p AS (SELECT rid, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // words))) AS impact FROM tf JOIN w USING (term), size),
s AS (SELECT q, item_id, rid, doc_id, sum(impact)::BIGINT AS score FROM items JOIN p USING (term) GROUP BY q, item_id, rid, doc_id HAVING score > 0)
SELECT item_id, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS FIRST, rid) AS INTEGER) AS rank, doc_id, score FROM s QUALIFY rank <= 50"""


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": OP2, "op3_substring_dedup": OP3, "op9_embedding_near_dedup": OP9, "op5_quality_rules": _op5(), "op10_source_mixing": OP10, "op12_merkle_manifest": OP12, "op13_lexical_search": OP13}
