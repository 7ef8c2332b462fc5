"""DuckDB SQL for the queries of this package that SQL can express."""


def _share(name: str, nodes: str, parent: str, order: str) -> str:
    """Budget sharing of one tree level: ``nodes`` has given, weight, capacity."""
    by = f"PARTITION BY {parent}"
    return f"""
{name}_a AS (
  SELECT *, least(given, sum(CASE WHEN weight > 0 THEN capacity ELSE 0 END) OVER ({by})) AS b,
    coalesce(sum(weight) OVER q, 0) AS w_before, coalesce(sum(capacity) OVER q, 0) AS c_before,
    sum(weight) OVER ({by}) AS w_all
  FROM ({nodes})
  WINDOW q AS ({by} ORDER BY CASE WHEN weight > 0 THEN capacity::DOUBLE / weight END ASC NULLS LAST, {order}
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
{name}_b AS (
  SELECT *, weight > 0 AND capacity::HUGEINT * (w_all - w_before) <= (b - c_before)::HUGEINT * weight AS is_full FROM {name}_a),
{name}_c AS (
  SELECT *, sum(CASE WHEN is_full THEN capacity ELSE 0 END) OVER ({by}) AS c_full,
    sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER ({by}) AS w_rest FROM {name}_b),
{name}_d AS (
  SELECT *, CASE WHEN is_full THEN capacity WHEN weight > 0 THEN ((b - c_full)::HUGEINT * weight) // w_rest ELSE 0 END AS low FROM {name}_c),
{name}_e AS (
  SELECT *, b - sum(low) OVER ({by}) AS spare, CASE WHEN weight > 0 AND low < capacity THEN 1 ELSE 0 END AS has_room FROM {name}_d),
{name} AS (
  SELECT *, low + CASE WHEN has_room = 1 AND sum(has_room) OVER ({by} ORDER BY {order} ROWS UNBOUNDED PRECEDING) <= spare
                       THEN 1 ELSE 0 END AS granted FROM {name}_e)"""


OP4 = f"""
WITH tok AS (
  SELECT doc_id, coalesce('domain' || (TRY_CAST(regexp_extract(source, '([0-9]+)', 1) AS INT) % 4), 'unknown') AS domain,
    coalesce(lang, 'und') AS lang, coalesce(source, 'unknown') AS source,
    len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS n_tokens
  FROM documents),
slim AS (SELECT * FROM tok WHERE n_tokens > 0 AND doc_id IS NOT NULL),
leaf AS (SELECT domain, lang, source, sum(n_tokens) AS tokens, 2 * sum(n_tokens) AS capacity FROM slim GROUP BY ALL),
total AS (SELECT sum(tokens) * 600 // 1000 AS budget FROM leaf),
{_share("l1", '''SELECT 0 AS root, domain, (SELECT budget FROM total) AS given, sum(capacity) AS capacity,
    CASE domain WHEN 'domain0' THEN 4 WHEN 'domain1' THEN 3 WHEN 'domain2' THEN 2 ELSE 1 END AS weight
  FROM leaf GROUP BY domain''', "root", "domain")},
{_share("l2", '''SELECT x.*, l1.granted AS given FROM (
    SELECT domain, lang, sum(capacity) AS capacity, CASE WHEN domain = 'domain1' AND lang = 'de' THEN 5
      WHEN lang = 'en' THEN 4 WHEN lang IN ('de', 'fr', 'es') THEN 2 ELSE 1 END AS weight
    FROM leaf GROUP BY domain, lang) x JOIN l1 USING (domain)''', "domain", "domain, lang")},
{_share("l3", '''SELECT x.*, l2.granted AS given FROM (
    SELECT domain, lang, source, tokens, capacity,
      CASE WHEN domain = 'domain0' AND lang = 'en' AND source = 'src0' THEN 2 ELSE 1 END AS weight
    FROM leaf) x JOIN l2 USING (domain, lang)''', "domain, lang", "domain, lang, source")},
drawn AS (
  SELECT s.*, CAST(granted // tokens AS BIGINT) AS passes, granted % tokens AS rest
  FROM slim s JOIN l3 USING (domain, lang, source)),
part AS (
  SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('17-' || (passes + 1) || '-' || doc_id), doc_id, n_tokens
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM drawn WHERE rest > 0)
SELECT doc_id, domain, lang, source, CAST(epoch AS INT) AS epoch, CAST(n_tokens AS BIGINT) AS n_tokens, CAST(take_tokens AS BIGINT) AS take_tokens FROM (
  SELECT doc_id, domain, lang, source, unnest(range(1, passes + 1)) AS epoch, n_tokens, n_tokens AS take_tokens FROM drawn WHERE passes > 0
  UNION ALL
  SELECT doc_id, domain, lang, source, passes + 1, n_tokens, least(n_tokens, rest - start) FROM part WHERE start < rest)
"""

OP9 = r"""
WITH lines AS (
  SELECT doc_id, unnest(range(0, len(parts))) AS line_no, unnest(parts) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL)),
sets AS (
  SELECT doc_id, line_no, list_sort(list_distinct(regexp_extract_all(line, '[^\x20\x09-\x0D]+'))) AS words FROM lines),
eligible AS (SELECT doc_id, line_no, words, len(words) AS n FROM sets WHERE len(words) >= 1),
firsts AS (SELECT min({'doc_id': doc_id, 'line_no': line_no}) AS pos, words, any_value(n) AS n FROM eligible GROUP BY words),
tokens AS (SELECT pos, n, unnest(words) AS word FROM firsts),
shared AS (
  SELECT a.pos AS x, b.pos AS y, a.n + b.n AS total, count(*) AS common
  FROM tokens a JOIN tokens b ON a.word = b.word AND a.pos < b.pos AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY ALL),
later AS (SELECT DISTINCT y FROM shared WHERE 100 * common >= 80 * (total - common)),
kept AS (
  SELECT pos.doc_id AS doc_id, string_agg(CAST(pos.line_no AS VARCHAR), ',' ORDER BY pos.line_no) AS kept_lines, count(*) AS n_kept
  FROM firsts WHERE pos NOT IN (SELECT y FROM later) GROUP BY pos.doc_id),
sizes AS (SELECT doc_id, count(*) AS n_eligible FROM eligible GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN text IS NULL THEN 0 ELSE len(string_split(text, chr(10))) END AS n_lines,
  coalesce(n_eligible, 0) AS n_eligible, coalesce(n_eligible, 0) - coalesce(n_kept, 0) AS n_removed, coalesce(kept_lines, '') AS kept_lines
FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def _fold_levels(name: str, leaves: str) -> str:
    """Nodes ``(g, level, idx, digest)`` of the trees over ``leaves`` (g, idx, digest), and each parent's children."""
    return f"""
{name} AS (
  SELECT g, 0 AS level, idx, digest, count(*) OVER (PARTITION BY g) AS n FROM ({leaves})
  UNION ALL
  SELECT g, level + 1, idx // 16, sha256(string_agg(digest, '' ORDER BY idx)), any_value((n + 15) // 16) FROM {name}
  WHERE n > 1 GROUP BY g, level, idx // 16),
{name}_kids AS (SELECT g, level, idx // 16 AS up, list(digest ORDER BY idx) AS kids FROM {name} WHERE n > 1 GROUP BY ALL)"""


def _walk_levels(name: str, start: str, tree: str) -> str:
    """Each of ``start`` (key, g, idx, folded, proof) carried up to the root of its tree."""
    return f"""
{name} AS (
  SELECT key, g, 0 AS level, idx, folded, proof FROM ({start})
  UNION ALL
  SELECT w.key, w.g, w.level + 1, w.idx // 16,
    sha256(array_to_string(list_concat(list_concat(kids[1:w.idx % 16], [folded]), kids[w.idx % 16 + 2:]), '')),
    proof || array_to_string(list_concat(kids[1:w.idx % 16], kids[w.idx % 16 + 2:]), '')
  FROM {name} w JOIN {tree}_kids k ON k.g = w.g AND k.level = w.level AND k.up = w.idx // 16)"""


def _mark(value: str) -> str:
    return f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR), '-')"


_LEAF = " || ".join(_mark(c) for c in ("doc_id", "source", "lang", "n_chars", "{text}"))
# CRC-32 bit by bit: a byte is mixed in, then eight shifts (marked 256) follow.
_CRC = """list_reduce(list_concat([4294967295::UBIGINT], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
      lambda x: list_concat([ord(x)::UBIGINT], list_transform(range(8), lambda k: 256::UBIGINT))))),
    lambda c, b: CASE WHEN b < 256 THEN xor(c, b) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END)"""

OP13 = f"""
WITH RECURSIVE marked AS (
  SELECT doc_id, source, sha256({_LEAF.format(text="text")}) AS leaf,
    CASE WHEN xor({_CRC}, 4294967295::UBIGINT) % 5 = 0
      THEN sha256({_LEAF.format(text="translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}) END AS tampered
  FROM documents),
placed AS (
  SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g, row_number() OVER () AS key,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM marked),
{_fold_levels("tree", "SELECT g, idx, leaf AS digest FROM placed")},
subroots AS (SELECT g, digest AS subroot FROM tree WHERE n = 1),
{_fold_levels("crown", "SELECT 0 AS g, g AS idx, subroot AS digest FROM subroots")},
top AS (SELECT digest AS root FROM crown WHERE n = 1),
{_walk_levels("low", "SELECT key, g, idx, coalesce(tampered, leaf) AS folded, '' AS proof FROM placed", "tree")},
{_walk_levels("high", '''SELECT key, 0 AS g, g AS idx, folded, proof FROM
    (SELECT *, row_number() OVER (PARTITION BY key ORDER BY level DESC) AS last FROM low) WHERE last = 1''', "crown")},
ends AS (SELECT key, arg_max(folded, level) AS folded_root, arg_max(proof, level) AS proof FROM high GROUP BY key)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded_root, folded_root = root AS verified
FROM placed JOIN subroots USING (g) JOIN ends USING (key) CROSS JOIN top
"""
