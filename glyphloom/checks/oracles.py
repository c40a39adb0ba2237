"""DuckDB SQL equal to the registered queries, written without looking at their plans.

Blocks are found with windows over lines; declarations are spelled out from the templates
the code files are made of.
"""

from __future__ import annotations

from .corpora import DART, PYTHON, SCRIPT, VOCABULARY

# Written down here anew, so that a wrong class in the library does not hide in its own oracle.
LINE_BREAKS = r"\r\n|\n|\r|\x0B|\x0C|\x1C|\x1D|\x1E|\x{85}|\x{2028}|\x{2029}"
NOT_BLANK = r"[^\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _fill(template: str) -> str:
    pieces = template.split("$")
    return "concat(" + ", ".join(p if i % 2 else _text(p) for i, p in enumerate(pieces)) + ")"


def _by_lang(en: str, de: str, fr: str, es: str) -> str:
    return f"CASE lang WHEN 'en' THEN '{en}' WHEN 'de' THEN '{de}' WHEN 'fr' THEN '{fr}' ELSE '{es}' END"


def _id(length: int = 12) -> str:
    return f"substring(sha256(concat_ws(':', file_path, start_line, end_line, content)), 1, {length})"


PROSE = f"""prose AS (
  SELECT *, 'src/' || source || '/d' || doc_id || {_by_lang('.go', '.py', '.js', '.kt')} AS file_path,
    {_by_lang('go', 'python', 'javascript', 'kotlin')} AS language,
    replace(text, '. ', '.' || chr(10) || chr(10)) AS content,
    CAST(doc_id AS DOUBLE) + 1000.5 AS mtime
  FROM documents)"""


def _blocks(source: str, p: str = "", max_lines: int = 60) -> str:
    """CTEs {p}islands, {p}merged, {p}chunks (0-based spans) and {p}blocks."""
    return f"""{p}split AS (
  SELECT file_path, language, string_split_regex(content, '{LINE_BREAKS}') AS ls FROM {source}),
{p}lines AS (
  SELECT file_path, language, CASE WHEN ls[-1] = '' THEN ls[1:len(ls)-1] ELSE ls END AS ls FROM {p}split),
{p}filled AS (
  SELECT file_path, i FROM (SELECT file_path, ls, unnest(range(1, len(ls) + 1)) AS i FROM {p}lines)
  WHERE regexp_matches(ls[i], '{NOT_BLANK}')),
{p}islands AS (
  SELECT file_path, min(i) AS s, max(i) AS e FROM (
    SELECT file_path, i, i - row_number() OVER (PARTITION BY file_path ORDER BY i) AS g FROM {p}filled)
  GROUP BY file_path, g),
{p}sized AS (SELECT *, CAST(e - s + 1 >= 3 AS INT) AS big FROM {p}islands),
{p}grouped AS (
  SELECT file_path, s, e, least(
    coalesce(sum(big) OVER (PARTITION BY file_path ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0),
    greatest(sum(big) OVER (PARTITION BY file_path) - 1, 0)) AS g FROM {p}sized),
{p}merged AS (SELECT file_path, min(s) AS s, max(e) AS e FROM {p}grouped GROUP BY file_path, g),
{p}chunks AS (
  SELECT file_path, p AS s, least(p + {max_lines} - 1, e) AS e
  FROM (SELECT file_path, e, unnest(range(s, e + 1, {max_lines})) AS p FROM {p}merged)),
{p}blocks AS (
  SELECT file_path, language, CAST(s AS INT) AS start_line, CAST(e AS INT) AS end_line,
    'block' AS kind, CAST(NULL AS VARCHAR) AS name, array_to_string(ls[s:e], chr(10)) AS content,
    CAST(row_number() OVER (PARTITION BY file_path ORDER BY s) - 1 AS INT) AS ordinal
  FROM {p}chunks JOIN {p}lines USING (file_path))"""


_CODE_PATH = f"'code/' || source || '/d' || doc_id || {_by_lang('.py', '.dart', '.js', '.ts')}"
CODE = f"""parts AS (
  SELECT *, {_CODE_PATH} AS file_path, {_by_lang('python', 'dart', 'javascript', 'typescript')} AS language,
    replace(text, chr(10), chr(10) || '    # ') AS hashed,
    replace(text, chr(10), chr(10) || '  // ') AS slashed,
    {_by_lang('', '', '', ': number')} AS t1, {_by_lang('', '', '', ': string')} AS t2,
    {_by_lang('', '', '', ': Fn')} AS t3,
    len(text) - len(replace(text, chr(10), '')) + 1 AS l
  FROM documents),
code AS (
  SELECT *, CASE lang WHEN 'en' THEN {_fill(PYTHON)} WHEN 'de' THEN {_fill(DART)} ELSE {_fill(SCRIPT)} END AS content
  FROM parts)"""

_PY_FUNCTION = "@registered\ndef doc_$doc_id$(x):\n    # $hashed$\n    return $n_chars$"
_PY_SIZE = "    def size(self):\n        return $n_chars$"
_PY_ORIGIN = '    async def origin(self):\n        return "$source$"'
_PY_CLASS = 'class Doc$doc_id$(Base):\n    "About $source$."\n\n' + _PY_SIZE + "\n\n" + _PY_ORIGIN
_PY_TAIL = 'LIMIT = $n_chars$\nSOURCE = "$source$"\nLANG = "$lang$"\n'

_JS_FUNCTION = (
    "export default async function doc$doc_id$(a$t1$, b$t1$)$t2$ {\n  /* $text$ */\n"
    '  return "{";\n}'
)
_JS_SIZE = "  size()$t2$ {\n    return $n_chars$; // }\n  }"
_JS_ORIGIN = "  static async origin(x$t1$) {\n    if (x) {\n      return `}`;\n    }\n  }"
_JS_CLASS = (
    "export class Doc$doc_id$ extends Base {\n" + _JS_SIZE + "\n\n" + _JS_ORIGIN + "\n}"
)
_JS_ARROW = "const f$doc_id$$t3$ = (a) => {\n  return a;\n}"

_DART_SIZE = "  int size() {\n    return $n_chars$;\n  }"
_DART_ORIGIN = "\n  Future<String> origin(String x) async {\n    return '}';\n  }"
_DART_CLASS = (
    "abstract class Doc$doc_id$ extends Base {\n" + _DART_SIZE + "\n" + _DART_ORIGIN + "\n}"
)
_DART_FUNCTION = "\nvoid doc$doc_id$(int a, int b) {\n  // $slashed$\n  return;\n}"

# language filter, first line, last line, kind, name, content, position in the file
_DECLARATIONS = [
    ("= 'en'", "3", "5 + l", "function", "doc_$doc_id$", _PY_FUNCTION, 0),
    ("= 'en'", "7 + l", "14 + l", "class", "Doc$doc_id$", _PY_CLASS, 1),
    ("= 'en'", "10 + l", "11 + l", "method", "Doc$doc_id$.size", _PY_SIZE, 2),
    ("= 'en'", "13 + l", "14 + l", "method", "Doc$doc_id$.origin", _PY_ORIGIN, 3),
    ("IN ('fr', 'es')", "3", "5 + l", "function", "doc$doc_id$", _JS_FUNCTION, 0),
    ("IN ('fr', 'es')", "7 + l", "17 + l", "class", "Doc$doc_id$", _JS_CLASS, 1),
    ("IN ('fr', 'es')", "8 + l", "10 + l", "method", "Doc$doc_id$.size", _JS_SIZE, 2),
    ("IN ('fr', 'es')", "12 + l", "16 + l", "method", "Doc$doc_id$.origin", _JS_ORIGIN, 3),
    ("IN ('fr', 'es')", "19 + l", "21 + l", "function", "f$doc_id$", _JS_ARROW, 4),
    ("= 'de'", "3", "11", "class", "Doc$doc_id$", _DART_CLASS, 0),
    ("= 'de'", "4", "6", "method", "Doc$doc_id$.size", _DART_SIZE, 1),
    ("= 'de'", "7", "10", "method", "Doc$doc_id$.origin", _DART_ORIGIN, 2),
    ("= 'de'", "12", "15 + l", "function", "doc$doc_id$", _DART_FUNCTION, 3),
]


def _blank(template: str) -> str:
    return f"regexp_replace({_fill(template)}, '[^\\n]', ' ', 'g')"


_DECLARED = "declared AS (" + " UNION ALL ".join(
    f"SELECT file_path, language, CAST({a} AS INT) AS start_line, CAST({b} AS INT) AS end_line, "
    f"'{kind}' AS kind, {_fill(name)} AS name, {_fill(body)} AS content, {n} AS ordinal "
    f"FROM parts WHERE lang {which}"
    for which, a, b, kind, name, body, n in _DECLARATIONS
) + ")"
_LEFT = f"""uncovered AS (
  SELECT file_path, language, CASE lang
    WHEN 'en' THEN concat('import os', repeat(chr(10), 15 + l), {_fill(_PY_TAIL)})
    WHEN 'de' THEN concat({_text("import 'dart:core';")}, repeat(chr(10), 2), {_blank(_DART_CLASS)}, chr(10), {_blank(_DART_FUNCTION)})
    ELSE concat({_text("import base from './base';")}, repeat(chr(10), 2), {_blank(_JS_FUNCTION)}, repeat(chr(10), 2),
      {_blank(_JS_CLASS)}, repeat(chr(10), 2), {_blank(_JS_ARROW)}, ';', chr(10)) END AS content
  FROM parts)"""
_COLUMNS = "file_path, start_line, end_line, kind, name, language, content"
CODE_SNIPPETS = f"""{CODE}, {_DECLARED}, {_LEFT}, {_blocks('uncovered', 'u')},
code_snippets AS (
  SELECT {_id()} AS id, {_COLUMNS}, ordinal FROM declared
  UNION ALL
  SELECT {_id()}, {_COLUMNS},
    CAST(ordinal + CASE language WHEN 'python' THEN 4 WHEN 'dart' THEN 4 ELSE 5 END AS INT)
  FROM ublocks)"""
PROSE_SNIPPETS = f"""{PROSE}, {_blocks('prose', 'p')},
prose_snippets AS (SELECT {_id()} AS id, {_COLUMNS}, ordinal FROM pblocks)"""


def _keywords(t: str) -> str:
    """Keyword vector in hundredths."""
    hits = [f"contains(lower({t}), '{w}')" for w in VOCABULARY]
    slots = [f"CASE WHEN {h} THEN 100 ELSE 0 END" for h in hits]
    slots[-1] = f"CASE WHEN NOT ({' OR '.join(hits)}) THEN 1 WHEN {hits[-1]} THEN 100 ELSE 0 END"
    return f"[{', '.join(slots)}]"


def _vector_text(t: str) -> str:
    return f"array_to_string({_keywords(t)}, ',')"


_EMBEDDED = "concat_ws(chr(10), '# ' || language, CASE WHEN name <> '' THEN '# ' || name END, content)"


def _indexed(snippets: str, files: str) -> str:
    """Rows of an index of ``snippets`` whose manifest is made of ``files``."""
    return f"""SELECT id, s.file_path, start_line, end_line, kind, s.language, s.content,
  {_vector_text(_EMBEDDED.replace('language', 's.language').replace('content', 's.content'))} AS vector,
  sha256(f.content) AS content_hash, f.mtime AS mtime
FROM {snippets} s JOIN {files} f USING (file_path)"""


PATHS = f"""paths AS (
  SELECT CASE WHEN toxic = 1 THEN 'web/node_modules/' WHEN quality = 0 THEN '.hid/'
      WHEN quality = 1 THEN 'src/' ELSE 'lib/_priv/' END || source || '/' ||
    {_by_lang('d', 'd', '.d', '_d')} || doc_id || {_by_lang('.py', '.test.dart', '.js', '.md')} AS file_path,
    n_chars AS size
  FROM documents LEFT JOIN labels USING (doc_id))"""
_PATH_LANGUAGE = (
    "CASE WHEN file_path LIKE '%.py' THEN 'python' WHEN file_path LIKE '%.dart' THEN 'dart' "
    "WHEN file_path LIKE '%.js' THEN 'javascript' END"
)
_VISIBLE = "NOT regexp_matches(file_path, '^(web/node_modules|\\.hid)/')"

SNAPS = f"""{PROSE},
snaps AS (
  SELECT p.*, lang <> 'es' AS in_old, NOT coalesce(toxic = 1, false) AS in_new,
    coalesce(quality = 0, false) AS poor, source = 'src7' AS bin,
    coalesce(quality = 0, false) OR source = 'src7' OR lang = 'de' AS moved,
    content || CASE WHEN quality = 0 THEN {_text(chr(10) * 2 + 'now' + chr(10) + 'with' + chr(10) + 'more')} ELSE '' END AS text2
  FROM prose p LEFT JOIN labels USING (doc_id))"""
_STATUS = """CASE WHEN in_old AND NOT moved THEN 'UNCHANGED' WHEN bin THEN 'SKIPPED' WHEN NOT in_old THEN 'NEW'
  WHEN NOT poor THEN 'TOUCHED' ELSE 'CHANGED' END"""
UPDATED = f"""{SNAPS},
final AS (
  SELECT file_path, language, CASE WHEN in_old AND bin THEN content ELSE text2 END AS content,
    CASE WHEN moved AND NOT (in_old AND bin) THEN mtime + 1 ELSE mtime END AS mtime
  FROM snaps WHERE in_new AND (in_old OR NOT bin)),
{_blocks('final', 'f')},
final_snippets AS (SELECT {_id()} AS id, * FROM fblocks)"""

CENTRES = """cells AS (
  SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings),
centres AS (
  SELECT label AS query_id, list(m ORDER BY pos) AS centre
  FROM (SELECT label, pos, avg(CAST(x AS DOUBLE)) AS m FROM cells GROUP BY label, pos) GROUP BY label)"""


def _topk(k: int, pairs: str) -> str:
    return f"""SELECT query_id, CAST(rank AS INT) AS rank, id, score FROM (
  SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM ({pairs}))
WHERE rank <= {k}"""


_VECTOR_PAIRS = """SELECT query_id, vec_id AS id,
  round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), centre), 6) AS score FROM embeddings, centres"""
_KEYWORD_PAIRS = """SELECT query_id, id, round(list_cosine_similarity(v, q), 6) AS score, list_cosine_similarity(v, q) AS raw
FROM embedded, asked"""
FIND = f"""{PROSE_SNIPPETS},
embedded AS (SELECT id, CAST({_keywords(_EMBEDDED)} AS DOUBLE[]) AS v FROM prose_snippets),
asked AS (SELECT item_id AS query_id, CAST({_keywords('text')} AS DOUBLE[]) AS q FROM benchmark),
hits AS ({_topk(8, _KEYWORD_PAIRS)})"""
_WHITE = NOT_BLANK.replace("[^", "[")


def _preview(t: str) -> str:
    lines = f"string_split_regex({t}, '{LINE_BREAKS}')"
    trimmed = f"(CASE WHEN ({lines})[-1] = '' THEN ({lines})[:-2] ELSE {lines} END)[1:3]"
    joined = f"array_to_string(list_transform({trimmed}, lambda x: '    ' || x), chr(10))"
    return (
        f"(SELECT CASE WHEN length(j) > 200 THEN regexp_replace(left(j, 200), '{_WHITE}+$', '') || ' ...' "
        f"ELSE j END FROM (SELECT {joined} AS j))"
    )


def _header(rank: str, score: str) -> str:
    shown = "kind || CASE WHEN name IS NULL THEN '' ELSE ' ' || name END"
    return f"printf('%d. [%.3f] %s  (%s:%d)  id=%s', {rank}, {score}, {shown}, file_path, start_line, id)"


_SNIPPET_ROWS = "id, file_path, start_line, end_line, kind, name, language, content"
_PROSE_INDEX = f"WITH {PROSE_SNIPPETS} " + _indexed("prose_snippets", "prose")

ORACLES: dict[str, str] = {
    "files_table": f"""WITH {PROSE} SELECT file_path, mtime, CAST(strlen(content) AS BIGINT) AS size,
  sha256(content) AS content_hash FROM prose""",
    "files_table_relative": f"""WITH {PROSE} SELECT file_path, language, sha256(content) AS content_hash
FROM prose WHERE strlen(content) <= 2000""",
    "tree_scan": f"""WITH {CODE}, {PATHS}
SELECT file_path, CAST(strlen(content) AS BIGINT) AS size, language, sha256(content) AS content_hash
FROM code WHERE language <> 'typescript'
UNION ALL
SELECT file_path, CAST(2 AS BIGINT), {_PATH_LANGUAGE}, sha256('x' || chr(10)) FROM paths
WHERE file_path LIKE 'src/%' AND file_path NOT LIKE '%.test.%' AND {_PATH_LANGUAGE} IS NOT NULL""",
    "decode_text": "SELECT doc_id, sha256(text) AS content_hash FROM documents WHERE lang <> 'es'",
    "language_for": f"WITH {PATHS} SELECT file_path, {_PATH_LANGUAGE} AS language FROM paths",
    "content_hash": "SELECT doc_id, sha256(text) AS content_hash FROM documents",
    "snippet_id": f"""WITH {PROSE}, {_blocks('prose')},
one AS (SELECT file_path, 1 AS start_line, len(ls) AS end_line, p.content, p.lang, p.source
  FROM prose p JOIN lines USING (file_path))
SELECT file_path, {_id()} AS id, {_id(64)} AS long_id,
  CASE WHEN lang = 'es' THEN 'own' || source ELSE {_id()} END AS given_id FROM one""",
    "snippet_shape": f"""WITH {PROSE_SNIPPETS}
SELECT id, end_line - start_line + 1 AS line_count, file_path || ':' || start_line AS location FROM prose_snippets""",
    "embedding_text": f"WITH {CODE_SNIPPETS} SELECT id, {_EMBEDDED} AS embedding_text FROM code_snippets",
    "hit_header": f"""WITH {CODE_SNIPPETS}
SELECT id, {_header('ordinal + 1', 'length(content) / 4096.0')} AS header FROM code_snippets""",
    "preview": f"SELECT doc_id, {_preview('text')} AS preview FROM documents",
    "filter_extensions": f"""WITH {PATHS} SELECT file_path, size, {_PATH_LANGUAGE} AS language FROM paths
WHERE {_PATH_LANGUAGE} IS NOT NULL""",
    "filter_languages": f"""WITH {PATHS} SELECT file_path, size, {_PATH_LANGUAGE} AS language FROM paths
WHERE {_PATH_LANGUAGE} IN ('dart', 'python')""",
    "filter_ignored_dirs": f"WITH {PATHS} SELECT file_path, size FROM paths WHERE {_VISIBLE}",
    "filter_globs": f"""WITH {PATHS} SELECT file_path, size FROM paths WHERE {_VISIBLE}
  AND file_path NOT LIKE 'lib/%' AND file_path NOT LIKE '%.test.%'
  AND NOT regexp_full_match(file_path, 'src/src1[^0-4]/.*')
  AND NOT regexp_full_match(string_split(file_path, '/')[-1], '\\.d..\\.js')""",
    "filter_size": f"WITH {PATHS} SELECT file_path, size FROM paths WHERE size <= 3000",
    "block_islands": f"""WITH {PROSE}, {_blocks('prose')}
SELECT file_path, CAST(s AS INT) AS start_line, CAST(e AS INT) AS end_line FROM islands""",
    "block_merge": f"""WITH {PROSE}, {_blocks('prose')}
SELECT file_path, CAST(s AS INT) AS start_line, CAST(e AS INT) AS end_line FROM merged""",
    "block_chunk": f"""WITH {PROSE}, {_blocks('prose', max_lines=10)}
SELECT file_path, CAST(s AS INT) AS start_line, CAST(e AS INT) AS end_line FROM chunks""",
    "split_blocks": f"WITH {PROSE_SNIPPETS} SELECT * FROM prose_snippets",
    "extract_python": f"""WITH {CODE}, {_DECLARED} SELECT {_id()} AS id, * FROM declared WHERE language = 'python'""",
    "extract_braces": f"""WITH {CODE}, {_DECLARED} SELECT {_id()} AS id, * FROM declared WHERE language <> 'python'""",
    "extract_leftovers": f"WITH {CODE_SNIPPETS} SELECT {_SNIPPET_ROWS} FROM code_snippets WHERE kind = 'block'",
    "extract_snippets": f"""WITH {CODE_SNIPPETS}, {PROSE_SNIPPETS}
SELECT * FROM code_snippets UNION ALL SELECT * FROM prose_snippets""",
    "classify_files": f"WITH {SNAPS} SELECT file_path, {_STATUS} AS status FROM snaps WHERE in_new",
    "removed_files": f"WITH {SNAPS} SELECT file_path FROM snaps WHERE in_old AND NOT in_new",
    "file_paths": f"WITH {SNAPS} SELECT file_path FROM snaps WHERE in_old OR in_new",
    "manifest_upsert": f"""WITH {SNAPS} SELECT file_path,
  CASE WHEN in_new AND moved THEN mtime + 1 ELSE mtime END AS mtime,
  CASE WHEN NOT in_new THEN sha256(content) WHEN bin THEN NULL ELSE sha256(text2) END AS content_hash
FROM snaps WHERE in_old OR in_new""",
    "meta_upsert": """WITH meta AS (SELECT lang AS key, CAST(count(*) AS VARCHAR) AS value FROM documents GROUP BY lang),
later AS (SELECT CASE WHEN lang = 'en' THEN source ELSE lang END AS key, CAST(max(doc_id) AS VARCHAR) AS value
  FROM documents GROUP BY 1)
SELECT key, value FROM later UNION ALL SELECT key, value FROM meta WHERE key NOT IN (SELECT key FROM later)""",
    "upsert_snippets": f"""WITH {SNAPS},
before AS (SELECT file_path, language, content FROM snaps WHERE in_old),
after AS (SELECT file_path, language, text2 AS content FROM snaps WHERE in_new AND NOT bin),
{_blocks('before', 'b')}, {_blocks('after', 'a')},
incoming AS (SELECT {_id()} AS id, *, CASE language WHEN 'go' THEN 'block' WHEN 'python' THEN 'third' ELSE 'second' END AS k
  FROM ablocks),
existing AS (SELECT {_id()} AS id, * FROM bblocks)
SELECT id, file_path, start_line, end_line, k AS kind FROM incoming
UNION ALL
SELECT id, file_path, start_line, end_line, kind FROM existing WHERE id NOT IN (SELECT id FROM incoming)""",
    "delete_by_file": f"""WITH {PROSE_SNIPPETS}
SELECT id, file_path FROM prose_snippets WHERE file_path NOT IN (
  SELECT file_path FROM prose JOIN labels USING (doc_id) WHERE lang <> 'es' AND toxic = 1)""",
    "l2_normalize": """WITH scaled AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * (label + 2)) AS v FROM embeddings),
cells AS (SELECT vec_id AS id, v, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM scaled)
SELECT id, CAST(pos - 1 AS INT) AS pos, round(x / sqrt(list_inner_product(v, v)), 6) AS x FROM cells""",
    "cosine_pairs": f"""WITH {CENTRES} SELECT vec_id AS id, label,
  round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), centre), 6) AS score
FROM embeddings JOIN centres ON label = query_id""",
    "vector_topk": f"WITH {CENTRES} {_topk(10, _VECTOR_PAIRS)}",
    "vector_topk_cells": f"WITH {CENTRES} {_topk(10, _VECTOR_PAIRS)}",
    "topk_edges": f"""WITH {CENTRES} {_topk(500, '''SELECT a.query_id, b.query_id AS id,
  round(list_cosine_similarity(a.centre, b.centre), 6) AS score FROM centres a, centres b''')}""",
    "vector_dim": "SELECT count(*) AS vectors, CAST(max(len(embedding)) AS INT) AS dimension FROM embeddings",
    "embed_keyword": f"SELECT doc_id, {_vector_text('text')} AS vector FROM documents",
    "embed_batched": """SELECT doc_id, concat_ws(',', 100 * (length(text) % 97),
  100 * (length(text) - length(replace(text, 'e', ''))) % 8900, 100 * (length(text) - length(replace(text, chr(10), ''))) % 700) AS vector
FROM documents""",
    "embed_snippets": f"WITH {CODE_SNIPPETS} SELECT id, {_vector_text(_EMBEDDED)} AS vector FROM code_snippets",
    "index_roundtrip": _PROSE_INDEX,
    "index_count": f"WITH {PROSE_SNIPPETS} SELECT count(*) AS snippets FROM prose_snippets",
    "list_snippets": f"WITH {PROSE_SNIPPETS} SELECT file_path, start_line, end_line, id FROM prose_snippets",
    "show": f"""WITH {PROSE_SNIPPETS} SELECT id, file_path, start_line, end_line, kind, language, content,
  kind AS title, printf('%s:%d-%d  id=%s', file_path, start_line, end_line, id) AS subtitle
FROM prose_snippets WHERE id = (SELECT min(id) FROM prose_snippets)""",
    "build_index_rows": f"""WITH {CODE_SNIPPETS}, {PROSE_SNIPPETS},
snippets AS (SELECT * FROM code_snippets UNION ALL SELECT * FROM prose_snippets),
files AS (SELECT file_path, content, mtime FROM prose UNION ALL
  SELECT file_path, content, CAST(doc_id AS DOUBLE) + 2000.5 FROM code) """
    + _indexed("snippets", "files"),
    "build_summary": f"""WITH {CODE_SNIPPETS}, {PROSE_SNIPPETS}
SELECT 2 * (SELECT count(*) FROM documents) AS files_scanned,
  (SELECT count(*) FROM code_snippets) + (SELECT count(*) FROM prose_snippets) AS snippets_indexed""",
    "update_index_rows": f"WITH {UPDATED} " + _indexed("final_snippets", "final"),
    "index_versions": f"""WITH {UPDATED},
before AS (SELECT file_path, language, content, mtime FROM snaps WHERE in_old), {_blocks('before', 'o')},
before_snippets AS (SELECT {_id()} AS id, * FROM oblocks)
SELECT 1 AS version, * FROM ({_indexed("before_snippets", "before")})
UNION ALL SELECT 2, * FROM ({_indexed("final_snippets", "final")})""",
    "update_summary": f"""WITH {UPDATED}, status AS (SELECT file_path, {_STATUS} AS status FROM snaps WHERE in_new)
SELECT count(*) FILTER (status = 'NEW') AS added, count(*) FILTER (status = 'CHANGED') AS changed,
  (SELECT count(*) FROM snaps WHERE in_old AND NOT in_new) AS removed,
  count(*) FILTER (status IN ('UNCHANGED', 'TOUCHED')) AS unchanged,
  (SELECT count(*) FROM final_snippets JOIN status s USING (file_path) WHERE s.status IN ('NEW', 'CHANGED')) AS snippets_indexed
FROM status""",
    "stream_update_rows": f"WITH {UPDATED} " + _indexed("final_snippets", "final"),
    "stream_excluded_rows": f"""WITH {PROSE},
final AS (
  SELECT file_path, language, CASE doc_id % 5 WHEN 3 THEN mtime + 2 ELSE mtime END AS mtime,
    content || CASE doc_id % 5 WHEN 3 THEN {_text(chr(10) * 2 + 'now' + chr(10) + 'with' + chr(10) + 'more')} ELSE '' END AS content
  FROM prose WHERE doc_id % 5 >= 3),
{_blocks('final', 'f')},
final_snippets AS (SELECT {_id()} AS id, * FROM fblocks)
"""
    + _indexed("final_snippets", "final"),
    "find": f"""WITH {FIND}
SELECT query_id, rank, id, score, file_path, start_line,
  {_header('rank', 'score')} AS header, {_preview('content')} AS preview
FROM hits JOIN prose_snippets USING (id) WHERE rank <= 5""",
    "find_hydrated": f"""WITH {FIND} SELECT query_id, rank, id, score, content
FROM hits JOIN prose_snippets USING (id) WHERE language <> 'go'""",
}
