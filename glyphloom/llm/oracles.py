"""DuckDB SQL equal to the queries that SQL can express."""

from __future__ import annotations

URL_RULES = r"""
WITH rests AS (
  SELECT page_id, row_number() OVER () AS n, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), parts AS (
  SELECT n, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path
  FROM rests
), rules (rule_host, rule_path, verdict) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), fitting AS (
  SELECT n, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(verdict, length(rule_host || rule_path)) AS verdict
  FROM parts JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY n
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN fitting USING (n)
"""

_MEASURES = {
    "word_length": "100 * word_chars // greatest(n_words, 1)",
    "symbols": "1000 * n_symbols // greatest(word_chars, 1)",
    "dup_lines": "1000 * n_dup_lines // greatest(n_lines, 1)",
    "repeats": "1000 * n_repeat_words // greatest(n_words, 1)",
}
_SLACK = {"word_length": 100, "symbols": 10, "dup_lines": 30, "repeats": 15}
_TAILED = ("dup_lines", "repeats")
_BASE_FAILED = "(n_words < 20 OR 100 * n_repeat_words > 30 * n_words)"


def _quartiles(by: str) -> str:
    columns = f"{by}, " if by else ""
    return f"""
  SELECT {columns}measure, docs, min(CASE WHEN 4 * seen >= docs THEN bucket END) AS b1, min(CASE WHEN 4 * seen >= 3 * docs THEN bucket END) AS b3,
    min(CASE WHEN 100 * seen >= 99 * docs THEN bucket END) AS b99
  FROM (
    SELECT {columns}measure, bucket, sum(count(*)) OVER (PARTITION BY {columns}measure ORDER BY bucket) AS seen, sum(count(*)) OVER (PARTITION BY {columns}measure) AS docs
    FROM cells GROUP BY {columns}measure, bucket
  ) GROUP BY {columns}measure, docs"""


def _floor(b: str) -> str:
    return f"(CASE WHEN {b} < 64 THEN {b} ELSE ({b} % 32 + 32) * (1 << ({b} // 32 - 1)) END)"


_CELLS = " UNION ALL ".join(f"SELECT lang, source, '{k}' AS measure, CAST({v} AS BIGINT) AS v FROM counts WHERE NOT {_BASE_FAILED}" for k, v in _MEASURES.items())
_FENCES = ", ".join(
    f"max(CASE WHEN measure = '{k}' THEN greatest(q3 + 6 * greatest(q3 - q1, {s}), {'tail' if k in _TAILED else 0}) END) AS high_{k}" for k, s in _SLACK.items()
)
_INSIDE = " AND ".join(f"{v} <= high_{k}" for k, v in _MEASURES.items())

QUALITY = rf"""
WITH texts AS (
  SELECT row_number() OVER () AS n, doc_id, lang, source, coalesce(text, '') AS text FROM documents
), worded AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM texts
), windows AS (
  SELECT n, i, array_to_string(words[i:i + 7], ' ') AS w FROM (SELECT n, words, unnest(range(1, len(words) - 6)) AS i FROM worded WHERE len(words) >= 8)
), again AS (
  SELECT n, i FROM windows JOIN (SELECT n, w FROM windows GROUP BY n, w HAVING count(*) > 1) USING (n, w)
), repeated AS (
  SELECT n, count(DISTINCT place) AS n_repeat_words FROM (SELECT n, unnest(range(i, i + 8)) AS place FROM again) GROUP BY n
), counts AS (
  SELECT n, doc_id, lang, source, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) AS BIGINT) AS n_lines,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM worded LEFT JOIN repeated USING (n)
), measured AS ({_CELLS}
), cells AS (
  SELECT *, CASE WHEN v < 64 THEN v ELSE (length(bin(v)) - 5) * 32 + (v >> (length(bin(v)) - 6)) - 32 END AS bucket FROM measured
), own AS ({_quartiles("lang, source")}
), wider AS ({_quartiles("lang")}
), widest AS ({_quartiles("")}
), used AS (
  SELECT own.lang, own.source, own.measure,
    CASE WHEN own.docs >= 100 THEN own.b1 WHEN wider.docs >= 100 THEN wider.b1 ELSE widest.b1 END AS b1,
    CASE WHEN own.docs >= 100 THEN own.b3 WHEN wider.docs >= 100 THEN wider.b3 ELSE widest.b3 END AS b3,
    CASE WHEN own.docs >= 100 THEN own.b99 WHEN wider.docs >= 100 THEN wider.b99 ELSE widest.b99 END AS b99
  FROM own JOIN wider ON own.lang IS NOT DISTINCT FROM wider.lang AND own.measure = wider.measure JOIN widest ON own.measure = widest.measure
), floors AS (
  SELECT lang, source, measure, {_floor("b1")} AS q1, {_floor("b3")} AS q3, {_floor("(b99 + 1)")} - 1 AS tail FROM used
), fences AS (
  SELECT lang, source, {_FENCES}, max(CASE WHEN measure = 'word_length' THEN q1 // 2 END) AS low_word_length FROM floors GROUP BY lang, source
), judged AS (
  SELECT counts.*, {_BASE_FAILED} AS base_failed,
    coalesce({_INSIDE} AND {_MEASURES["word_length"]} >= low_word_length, true) AS inside
  FROM counts LEFT JOIN fences ON counts.lang IS NOT DISTINCT FROM fences.lang AND counts.source IS NOT DISTINCT FROM fences.source
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND inside AS kept FROM judged
"""

_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

RANKED = rf"""
WITH texts AS (
  SELECT row_number() OVER () AS d, doc_id, {_TERMS} AS terms FROM documents
), counted AS (
  SELECT d, doc_id, terms, CAST(len(terms) AS BIGINT) AS n FROM texts WHERE len(terms) > 0
), corpus AS (
  SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS length FROM counted
), postings AS (
  SELECT d, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT d, unnest(terms) AS term FROM counted) GROUP BY d, term
), asked AS (
  SELECT q, item_id, term, CAST(count(*) AS BIGINT) AS often
  FROM (SELECT q, item_id, unnest(terms) AS term FROM (SELECT row_number() OVER () AS q, item_id, {_TERMS} AS terms FROM benchmark)) GROUP BY q, item_id, term
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM postings GROUP BY term), corpus
), scored AS (
  SELECT q, item_id, doc_id, CAST(sum(often * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // length)))) AS BIGINT) AS score
  FROM asked JOIN weights USING (term) JOIN postings USING (term) JOIN counted USING (d), corpus
  GROUP BY q, item_id, d, doc_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id ASC NULLS LAST) AS place FROM scored WHERE score > 0
)
SELECT item_id, CAST(place AS INTEGER) AS rank, doc_id, score FROM ranked WHERE place <= 10
"""

_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE octet_length(encode(CAST({0} AS VARCHAR))) || ':' || CAST({0} AS VARCHAR) END"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"


#: CRC-32 bit by bit: each byte (0 or more) is mixed in, each -1 shifts.
_CRC = """xor(list_reduce(
  list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a >> 1, CAST(3988292384 AS BIGINT)) ELSE a >> 1 END), CAST(4294967295 AS BIGINT))"""


def _tree(name: str, start: str) -> str:
    """All nodes (tree, level, pos, n, node) above those of ``start`` on level 0, up to each tree's top."""
    return f"""{name} AS (
  {start}
  UNION ALL
  SELECT tree, level + 1, pos // 2, (any_value(n) + 1) // 2, sha256(string_agg(node, '' ORDER BY pos)) FROM {name} WHERE n > 1 GROUP BY tree, level, pos // 2
)"""


MERKLE = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, coalesce(lang, '') || CASE WHEN lang IS NULL THEN '0' ELSE '1' END AS tree, lang, {_leaf("n_chars")} AS leaf,
    CASE WHEN {_CRC} % 7 = 0 THEN {_leaf("(n_chars + 1)")} ELSE {_leaf("n_chars")} END AS presented
  FROM documents
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM leaves
), {_tree("nodes", "SELECT tree, 0 AS level, pos, n, leaf AS node FROM placed")
}, subroots AS (
  SELECT tree, lang, node AS subroot, row_number() OVER (ORDER BY lang IS NOT NULL, encode(lang)) - 1 AS place, count(*) OVER () AS langs
  FROM nodes JOIN (SELECT DISTINCT tree, lang FROM leaves) USING (tree) WHERE n = 1
), {_tree("upper_nodes", "SELECT 0 AS tree, 0 AS level, place AS pos, langs AS n, subroot AS node FROM subroots")
}, whole AS (
  SELECT node AS root FROM upper_nodes WHERE n = 1
), every_level AS (
  SELECT tree, level, pos, node, n FROM nodes
  UNION ALL
  SELECT s.tree, 1000 + u.level, u.pos, u.node, u.n FROM upper_nodes u, subroots s
), starts AS (
  SELECT p.doc_id, p.tree, p.pos, p.leaf, p.presented, s.subroot, s.place, row_number() OVER () AS r FROM placed p JOIN subroots s USING (tree)
), partners AS (
  SELECT r, l.level, k.node AS partner, spot
  FROM (
    SELECT starts.r, starts.tree, levels.level, (CASE WHEN levels.level < 1000 THEN starts.pos ELSE starts.place END) >> CAST(levels.level % 1000 AS BIGINT) AS spot
    FROM starts JOIN (SELECT DISTINCT tree, level FROM every_level WHERE n > 1) levels USING (tree)
  ) l LEFT JOIN every_level k ON k.tree = l.tree AND k.level = l.level AND k.pos = xor(l.spot, 1)
), proofs AS (
  SELECT r, sha256(coalesce(string_agg(coalesce(partner, ''), '' ORDER BY level), '')) AS proof_sha256,
    list(struct_pack(partner := coalesce(partner, ''), lft := spot % 2 = 1) ORDER BY level) AS path
  FROM partners GROUP BY r
), folded AS (
  SELECT starts.*, coalesce(proof_sha256, sha256('')) AS proof_sha256,
    list_reduce(list_prepend(struct_pack(partner := presented, lft := false), coalesce(path, [])), lambda a, x:
      struct_pack(partner := sha256(CASE WHEN x.lft THEN x.partner || a.partner ELSE a.partner || x.partner END), lft := false)).partner AS folded_root
  FROM starts LEFT JOIN proofs USING (r)
)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM folded, whole
"""

ORACLES = {"op5_quality": QUALITY, "op8_url_rules": URL_RULES, "op12_ranked_search": RANKED, "op13_merkle_manifest": MERKLE}
