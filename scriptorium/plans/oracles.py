"""SQL checks of the registered queries, for a plain SQL engine on the same tables.

They state the results by other means where SQL allows: joins over all pairs instead of band joins, one
regular expression per acronym instead of one pass, recursive queries instead of rounds.
"""

from __future__ import annotations

from scriptorium.constants import (
    ANSWER_ERROR,
    ANSWER_HTTP_ERROR,
    CELLS_MISSING,
    FOLDER_EMPTY,
    FOLDER_MISSING,
    NOT_NOUNS,
    NOT_PLURAL,
    NOTHING_FOUND,
    NOTHING_RELEVANT,
    PLURAL_RULES,
    PROMPT_INSTRUCTIONS,
    PROMPT_QUESTION,
    PROMPT_ROLE,
    PROMPT_RULES,
    ROWS_FAILED,
    SPACE,
    STOP_WORDS,
)
from scriptorium.plans.tables import ODD_HTML

DOMAIN = "la colección de documentos"
NL = "chr(10)"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def listed(words) -> str:
    return ", ".join(quoted(word) for word in words)


def strip(text: str) -> str:
    return f"regexp_replace({text}, '^{SPACE}+|{SPACE}+$', '', 'g')"


# The character references that occur in the pages and in what the queries add to them; the ampersand comes last.
ENTITIES = (
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"),
    ("&agrave;", "à"), ("&ntilde;", "ñ"), ("&#8217;", "’"), ("&#x27;", "'"), ("&amp;", "&"),
)


def entities(text: str) -> str:
    for entity, character in ENTITIES:
        text = f"replace({text}, {quoted(entity)}, {quoted(character)})"
    return text


# Corpora

WORD = "upper(regexp_extract(text, '^[A-Za-z]+'))"
DOCS_MD = "docs_md AS MATERIALIZED (SELECT doc_id, replace(text, '. ', '.' || chr(10) || chr(10)) AS text FROM documents)"
DOCS_ACR = f"""docs_acr AS MATERIALIZED (SELECT doc_id, CASE lang
  WHEN 'en' THEN text || ' ' || {WORD} || ' (' || source || ')'
  WHEN 'fr' THEN text || ' (' || {WORD} || ')' ELSE text END AS text FROM documents)"""
TALKS = """talks AS MATERIALIZED (SELECT 'conv_' || conv_id || '/turn_' || turn || '.md' AS path,
  CASE WHEN role = 'user' THEN text || ' ' || upper(role) || ' (conv ' || conv_id || ')'
  ELSE text || ' (' || upper(role) || ')' END AS text FROM conversations)"""


# Pages

LINKS = f"""links AS MATERIALIZED (SELECT page_id, url, unnest(range(len(h))) AS position, {entities('unnest(h)')} AS href
  FROM (SELECT page_id, url, regexp_extract_all(
    regexp_replace(html, '(?is)<!--.*?-->|<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>', '', 'g'),
    '<a\\s[^>]*href="([^"]*)"', 1) AS h FROM pages))"""

ADDRESSES = """forms AS (SELECT page_id, unnest(range(len(u))) AS form, unnest(u) AS url FROM (SELECT page_id, [
    url, url || '/x//y.PDF', regexp_replace(url, '[?#].*$', '.pdf'), regexp_replace(url, '[?#].*$', '') || '/a.pdf?v=1',
    'mailto:' || url, regexp_extract(url, '^https?://[^/]*'), substr(url, length(regexp_extract(url, '^https?://[^/]*')) + 1)
  ] AS u FROM pages)),
addresses AS MATERIALIZED (SELECT *, regexp_replace(CASE WHEN url LIKE 'mailto:%' THEN substr(url, 8)
    WHEN url LIKE 'http%' THEN substr(url, length(regexp_extract(url, '^https?://[^/?#]*')) + 1) ELSE url END, '[?#].*$', '')
  AS path FROM forms)"""

STORED = "coalesce(nullif(array_to_string(list_filter(string_split({path}, '/'), lambda x: x <> ''), '/'), ''), 'index')"
REWRITTEN = """regexp_replace(html, '<a href="/*([^"?#]*?)/*(?:[?#][^"]*)?"', '<a href="\\1.md"', 'g')"""
def markdown(html: str) -> str:
    """A page unit by unit: one case per tag, text with its white space collapsed."""
    for element in ("!--.*?--", r"script\b.*?</script\s*", r"style\b.*?</style\s*", r"head\b.*?</head\s*"):
        html = f"regexp_replace({html}, '(?is)<{element}>', '', 'g')"
    tag, ends = "lower(regexp_extract(u, '^</?([A-Za-z][A-Za-z0-9]*)', 1))", "starts_with(u, '</')"
    target = r"""trim(regexp_extract(u, '(?is)\shref\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+)', 1), '"''')"""
    blocks = "'p', 'div', 'ul', 'ol', 'table', 'article', 'section', 'footer', 'header', 'nav', 'blockquote'"
    unit = rf"""CASE WHEN NOT regexp_full_match(u, '(?s)<[^>]*>') THEN regexp_replace(u, '[ \t\r\n]+', ' ', 'g')
      WHEN {tag} = 'a' AND {ends} THEN chr(3) WHEN {tag} = 'a' AND {target} <> '' THEN chr(1) || {target} || chr(2)
      WHEN regexp_full_match({tag}, 'h[1-6]') THEN CASE WHEN {ends} THEN {NL} || {NL} ELSE {NL} || {NL} || repeat('#', substr({tag}, 2)::INT) || ' ' END
      WHEN {tag} = 'li' AND NOT {ends} THEN {NL} || '  * ' WHEN {tag} IN ('b', 'strong') THEN '**' WHEN {tag} IN ('i', 'em') THEN '_'
      WHEN {tag} = 'br' THEN '  ' || {NL} WHEN {tag} = 'hr' THEN {NL} || {NL} || '* * *' || {NL} || {NL}
      WHEN {tag} IN ({blocks}) THEN {NL} || {NL} WHEN {tag} = 'tr' AND NOT {ends} THEN {NL} WHEN {tag} IN ('td', 'th') AND {ends} THEN ' | ' ELSE '' END"""
    made = f"array_to_string(list_transform(regexp_extract_all({html}, '<[^>]*>|[^<]+|<'), lambda u: {unit}), '')"
    made = rf"replace(regexp_replace({made}, chr(1) || '([^\x02]*)\x02([^\x03]*)\x03', '[\2](\1)', 'g'), chr(3), '')"
    made = rf"regexp_replace(regexp_replace({entities(made)}, '\n +\n', {NL} || {NL}, 'g'), '\n{{3,}}', {NL} || {NL}, 'g')"
    return strip(made) + f" || {NL}"


MARKDOWN = markdown("html")

SITE = f"""{LINKS},
firsts AS MATERIALIZED (SELECT page_id, p.url AS old, 'https://site.example.org' || coalesce(h[3], h[1], '/') AS url
  FROM pages p LEFT JOIN (SELECT page_id, list(href ORDER BY position) AS h FROM links GROUP BY page_id) USING (page_id)),
site AS MATERIALIZED (SELECT regexp_replace(f.url, '#.*', '') AS src, 'https://site.example.org' || regexp_replace(href, '#.*', '') AS dst, count(*) AS n_links
  FROM links JOIN firsts f USING (page_id) GROUP BY ALL),
captured AS MATERIALIZED (SELECT regexp_replace(url, '#.*', '') AS dst, max(page_id) AS page_id FROM firsts GROUP BY ALL)"""


# Chunks

PARAS = f"list_filter(list_transform(string_split(text, {NL} || {NL}), lambda x: {strip('x')}), lambda x: x <> '')"


def packed(text: str) -> str:
    """Pieces of a long paragraph, by a fold over the words themselves."""
    start = "{'out': []::VARCHAR[], 'cur': []::VARCHAR[], 'sz': 0}"
    return f"""list_transform([list_reduce(list_filter(string_split_regex({text}, '{SPACE}+'), lambda w: w <> ''),
      lambda a, w: CASE WHEN a.sz + length(w) + 1 <= 500
        THEN {{'out': a.out, 'cur': list_append(a.cur, w), 'sz': (a.sz + length(w) + 1)::INTEGER}}
        ELSE {{'out': list_append(a.out, array_to_string(a.cur, ' ')), 'cur': [w], 'sz': length(w)::INTEGER}} END,
      {start})], lambda r: list_append(r.out, array_to_string(r.cur, ' ')))[1]"""


def chunks(corpus: str, key: str) -> str:
    """Paragraph chunks by a fold over the paragraphs themselves, with their lines."""
    start = "{'out': []::VARCHAR[], 'cur': []::VARCHAR[], 'sz': 0}"
    return f"""folded AS MATERIALIZED (SELECT {key}, text, list_reduce({PARAS}, lambda a, p: CASE
    WHEN length(p) > 500 THEN {{'out': list_concat(a.out, {packed('p')}), 'cur': a.cur, 'sz': a.sz}}
    WHEN a.sz + length(p) > 500 THEN {{'out': list_append(a.out, array_to_string(a.cur, {NL} || {NL})),
      'cur': [a.cur[-1], p], 'sz': (length(a.cur[-1]) + length(p))::INTEGER}}
    ELSE {{'out': a.out, 'cur': list_append(a.cur, p), 'sz': (a.sz + length(p))::INTEGER}} END, {start}) AS f FROM {corpus}),
lists AS MATERIALIZED (SELECT {key}, text, CASE WHEN len(f.cur) > 0
    THEN list_append(f.out, array_to_string(f.cur, {NL} || {NL})) ELSE f.out END AS c FROM folded),
cut AS MATERIALIZED (SELECT {key}, text, unnest(range(len(c))) AS chunk_index, len(c) AS total_chunks, unnest(c) AS chunk FROM lists),
chunks AS MATERIALIZED (SELECT *, CASE WHEN found_at = 0 THEN 0 ELSE length(substr(text, 1, found_at - 1))
      - length(replace(substr(text, 1, found_at - 1), {NL}, '')) + 1 END AS start_line,
    length(chunk) - length(replace(chunk, {NL}, '')) AS inside
  FROM (SELECT *, CASE WHEN chunk = '' THEN 1 ELSE instr(text, chunk) END AS found_at FROM cut))"""


def refined(name: str, source: str, separator: str) -> str:
    """One separator of the recursive splitter: the pieces themselves are folded, a window of them at a time."""
    own = {"\n\n": f"{NL} || {NL}", "\n": NL, " ": "' '"}[separator]
    pieces = f"list_filter(list_transform(string_split(t, {own}), lambda x, i: CASE WHEN i > 1 THEN {own} || x ELSE x END), lambda x: x <> '')"
    text = "array_to_string(a.win, '')"
    done = f"CASE WHEN len(a.win) > 0 THEN list_append(a.out, {{'t': {text}, 'done': true}}) ELSE a.out END"
    rest = "array_to_string(a.win[j:], '')"
    tail = f"a.win[list_filter(range(1, len(a.win) + 2), lambda j: length({rest}) <= 50 AND length({rest}) + length(x) <= 500)[1]:]"
    return f"""{name} AS MATERIALIZED (SELECT * FROM {source} WHERE done UNION ALL
  SELECT key, list_append(place, unnest(range(len(items)))), unnest(items).t, unnest(items).done FROM (
  SELECT key, place, CASE WHEN len(a.win) > 0 THEN list_append(a.out, {{'t': {text}, 'done': true}}) ELSE a.out END AS items FROM (
  SELECT key, place, list_reduce({pieces}, lambda a, x: CASE
      WHEN length(x) >= 500 THEN {{'out': list_append({done}, {{'t': x, 'done': false}}), 'win': []::VARCHAR[]}}
      WHEN len(a.win) > 0 AND length({text}) + length(x) > 500 THEN {{'out': {done}, 'win': list_append({tail}, x)}}
      ELSE {{'out': a.out, 'win': list_append(a.win, x)}} END,
    {{'out': []::STRUCT(t VARCHAR, done BOOLEAN)[], 'win': []::VARCHAR[]}}) AS a FROM {source} WHERE NOT done)))"""


def recursive(corpus: str, key: str) -> str:
    """``recursive_rows (key, chunk_index, chunk)``: span lists refined by one separator after the other."""
    return f"""span0 AS MATERIALIZED (SELECT {key} AS key, []::BIGINT[] AS place, text AS t, false AS done FROM {corpus} WHERE text <> ''),
{refined('span1', 'span0', chr(10) * 2)},
{refined('span2', 'span1', chr(10))},
{refined('span3', 'span2', ' ')},
span4 AS (SELECT * FROM span3 WHERE done UNION ALL SELECT key, list_append(place, unnest(n)), substr(t, 1 + 450 * unnest(n), 500), true
  FROM (SELECT *, range(CASE WHEN length(t) > 500 THEN 1 + ceil((length(t) - 500) / 450.0)::BIGINT ELSE 1 END) AS n FROM span3 WHERE NOT done)),
recursive_rows AS MATERIALIZED (SELECT key, row_number() OVER (PARTITION BY key ORDER BY place) - 1 AS chunk_index, {strip('t')} AS chunk
  FROM span4 WHERE {strip('t')} <> '')"""


END_LINE = "CASE WHEN found_at = 0 THEN 0 ELSE start_line + inside END"
INDEX = f"""index_rows AS MATERIALIZED (SELECT 'doc_' || (dense_rank() OVER (ORDER BY doc_id) - 1) || '_chunk_' || chunk_index AS id,
  doc_id AS path, doc_id::VARCHAR AS filename, chunk_index, total_chunks, start_line, {END_LINE} AS end_line, chunk FROM chunks)"""


# Documents

RAGGED = f"""ragged AS MATERIALIZED (SELECT conv_id, turn, role, text,
  list_transform(string_split(text, {NL}), lambda l: string_split(l, '. ')) AS r FROM conversations),
wide AS MATERIALIZED (SELECT *, list_max(list_transform(r, lambda x: len(x))) AS n FROM ragged),
lined AS MATERIALIZED (SELECT *, list_concat(
    ['| ' || array_to_string(list_transform(range(1, n + 1), lambda i: 'Columna ' || i), ' | ') || ' |',
     '| ' || array_to_string(list_transform(range(n), lambda i: '---'), ' | ') || ' |'],
    list_transform(r, lambda x: '| ' || array_to_string(list_concat(x, list_transform(range(n - len(x)), lambda i: '')), ' | ') || ' |')
  ) AS lines FROM wide)"""
SCANNED = "'conv_' || conv_id || '.scan.pdf'"
PARAGRAPHS = f"""scan_lines AS (SELECT {SCANNED} AS doc, (turn + 1) AS page_num, unnest(range(len(l))) AS pos,
    {strip('unnest(l)')} AS line FROM (SELECT *, string_split(replace(text, '. ', '.' || chr(10) || ' ' || chr(10)), {NL}) AS l FROM conversations)),
islands AS (SELECT *, sum((line = '')::INT) OVER (PARTITION BY doc, page_num ORDER BY pos) AS island FROM scan_lines),
scan_paragraphs AS MATERIALIZED (SELECT doc, page_num, row_number() OVER (PARTITION BY doc, page_num ORDER BY island) - 1 AS position,
    paragraph FROM (SELECT doc, page_num, island, string_agg(line, ' ' ORDER BY pos) AS paragraph
    FROM islands WHERE line <> '' GROUP BY doc, page_num, island))"""
BOXES = """boxes AS MATERIALIZED (SELECT l_orderkey AS table_id, l_partkey * 10 + l_linenumber AS box_id, l_linenumber - 1 AS place,
  (l_partkey % 1000)::INT AS x, (l_suppkey % 50)::INT AS y, (l_quantity * 10)::INT AS w, round(l_discount * 2000)::INT AS h FROM lineitem)"""


# Lexicon

PARTS = 8


def part(key: str) -> str:
    return f"(('0x' || substr(md5({key}::VARCHAR), 1, 8))::BIGINT % {PARTS})::INT"


ACRONYMS = "list_filter(regexp_split_to_array(text, '[^\\p{L}\\p{N}_]+'), lambda x: regexp_full_match(x, '[A-Z]{2,}'))"


def acronyms(corpus: str, key: str) -> str:
    form1 = r"acronym || '\s*\(([^)]+)\)'"
    form2 = r"'([^(]+)\s*\(\s*' || acronym || '\s*\)'"
    return f"""acr_occ AS MATERIALIZED (SELECT {key}, unnest({ACRONYMS}) AS acronym FROM {corpus}),
acr_doc AS MATERIALIZED (SELECT {key}, acronym, count(*) AS occurrences FROM acr_occ GROUP BY ALL),
acr_def AS MATERIALIZED (SELECT {key}, acronym, CASE
    WHEN regexp_matches(text, {form1}) THEN {strip(f'regexp_extract(text, {form1}, 1)')}
    WHEN regexp_matches(text, {form2}) THEN {strip(f'regexp_extract(text, {form2}, 1)')} END AS definition
  FROM acr_doc JOIN {corpus} USING ({key})),
acr_dict AS MATERIALIZED (SELECT acronym, list(definition ORDER BY {key})[1] AS definition, count(*) AS n_files,
    list({key} ORDER BY {key}) AS files FROM acr_def GROUP BY acronym),
acr_parts AS MATERIALIZED (SELECT acronym, {part(key)} AS part, list({key} ORDER BY {key}) AS part_files FROM acr_def GROUP BY ALL)"""


def lemma(word: str) -> str:
    branches = [f"WHEN length({word}) < 4 THEN {word}"]
    for ending, replacement in PLURAL_RULES:
        branches.append(f"WHEN {word} LIKE '%{ending}' THEN left({word}, length({word}) - {len(ending)}) || '{replacement}'")
    kept = " OR ".join(f"{word} LIKE '%{ending}'" for ending in NOT_PLURAL)
    branches.append(f"WHEN {word} LIKE '%s' AND NOT ({kept}) THEN left({word}, length({word}) - 1)")
    return "CASE " + " ".join(branches) + f" ELSE {word} END"


NOUN = f"(length({{t}}) >= 5 AND {{t}} NOT IN ({listed(NOT_NOUNS)}))"


def terms(corpus: str, key: str) -> str:
    return f"""sentence_lists AS (SELECT {key}, list_filter(list_transform(string_split(
    regexp_replace(text, '([.!?]){SPACE}+', '\\1' || {NL}, 'g'), {NL}), lambda x: {strip('x')}), lambda x: x <> '') AS s FROM {corpus}),
sentence_rows AS MATERIALIZED (SELECT {key}, unnest(range(len(s))) AS sentence_no, unnest(s) AS sentence FROM sentence_lists),
token_lists AS MATERIALIZED (SELECT {key}, sentence_no, list_filter(list_transform(list_filter(
    regexp_split_to_array(sentence, '[^\\p{{L}}\\p{{N}}_''\\-]+'), lambda x: regexp_full_match(x, '\\p{{L}}+')), lambda x: lower(x)),
    lambda x: x NOT IN ({listed(STOP_WORDS)})) AS t FROM sentence_rows),
token_rows AS MATERIALIZED (SELECT {key}, sentence_no, unnest(range(len(t))) AS position, unnest(t) AS token FROM token_lists),
run_marks AS (SELECT *, {NOUN.format(t='token')} AS noun FROM token_rows),
run_groups AS (SELECT *, position - row_number() OVER (PARTITION BY {key}, sentence_no, noun ORDER BY position) AS island FROM run_marks),
run_texts AS (SELECT {key}, sentence_no, min(position) AS start, count(*) AS n, string_agg(token, ' ' ORDER BY position) AS run
  FROM run_groups WHERE noun GROUP BY {key}, sentence_no, island),
run_rows AS MATERIALIZED (SELECT {key}, sentence_no, row_number() OVER (PARTITION BY {key}, sentence_no ORDER BY start) - 1 AS run_no,
  CASE WHEN n > 1 THEN run ELSE {lemma('run')} END AS term FROM run_texts),
term_dict AS MATERIALIZED (SELECT term, count(*) AS occurrences, count(DISTINCT {key}) AS n_files, list(DISTINCT {key} ORDER BY {key}) AS files
  FROM run_rows GROUP BY term HAVING count(*) > 1),
term_parts AS MATERIALIZED (SELECT term, {part(key)} AS part, list(DISTINCT {key} ORDER BY {key}) AS part_files
  FROM run_rows SEMI JOIN term_dict USING (term) GROUP BY ALL)"""


# Graph

GRAPH = f"""{TALKS},
{acronyms('talks', 'path')},
{terms('talks', 'path')},
nodes AS MATERIALIZED (SELECT acronym AS id, 'acronimo' AS kind, definition, NULL::BIGINT AS occurrences FROM acr_dict
  UNION ALL SELECT term, 'termino', NULL, occurrences FROM term_dict),
present AS MATERIALIZED (SELECT path, id, kind, instr(lower(text), lower(id)) - 1 AS pos FROM talks JOIN nodes ON contains(lower(text), lower(id))),
relations AS MATERIALIZED (SELECT a.id AS src, a.kind AS src_kind, b.id AS dst, b.kind AS dst_kind, a.path, abs(a.pos - b.pos) AS distance
  FROM present a JOIN present b ON a.path = b.path AND (a.kind, a.id) < (b.kind, b.id) AND abs(a.pos - b.pos) < 500),
edges AS MATERIALIZED (SELECT src, src_kind, dst, dst_kind, count(*) AS weight FROM relations GROUP BY ALL),
ends AS (SELECT src AS id, src_kind AS kind FROM edges UNION ALL SELECT dst, dst_kind FROM edges),
degrees AS MATERIALIZED (SELECT n.id, n.kind, count(e.id) AS degree, round(count(e.id) / ((SELECT count(*) FROM nodes) - 1), 6) AS centrality
  FROM nodes n LEFT JOIN ends e ON e.id = n.id AND e.kind = n.kind GROUP BY n.id, n.kind),
connections AS MATERIALIZED (SELECT src AS element, src_kind AS kind, path, dst AS other FROM relations
  UNION ALL SELECT dst, dst_kind, path, src FROM relations),
connected AS (SELECT element AS id, kind, {part('path')} AS part, list(other ORDER BY path, other) AS connections FROM connections GROUP BY ALL),
listed AS (SELECT acronym AS id, 'acronimo' AS kind, part, part_files FROM acr_parts UNION ALL SELECT term, 'termino', part, part_files FROM term_parts),
entries AS MATERIALIZED (SELECT kind, id, part, n.definition, n.occurrences, coalesce(part_files, []) AS files,
    coalesce(connections, []) AS connections, d.centrality
  FROM listed FULL JOIN connected USING (id, kind, part) JOIN nodes n USING (id, kind) JOIN degrees d USING (id, kind))"""


def escaped(text: str) -> str:
    for character, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = f"replace({text}, '{character}', '{entity}')"
    return text


def data(name: str, value: str) -> str:
    return f"""coalesce('<data key="{name}">' || {escaped(value)} || '</data>', '')"""


# Vectors


def vectors(rows: str, text: str) -> str:
    """``rows`` with the column ``v``: the hashed vector of ``text``."""
    return f"""(SELECT * EXCLUDE (slots, counts, norm), list_transform(counts, lambda x: CASE WHEN norm = 0 THEN 0 ELSE x / norm END) AS v
  FROM (SELECT *, sqrt(list_sum(list_transform(counts, lambda x: x * x))) AS norm
  FROM (SELECT *, list_transform(range(1, 65), lambda i: (len(list_filter(slots, lambda s: s = i)) - len(list_filter(slots, lambda s: s = -i)))::DOUBLE) AS counts
  FROM (SELECT *, list_transform(list_transform(list_filter(regexp_split_to_array(lower({text}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> ''),
      lambda t: ('0x' || substr(md5(t), 1, 8))::BIGINT), lambda n: CASE WHEN (n // 64) % 2 = 0 THEN n % 64 + 1 ELSE -(n % 64 + 1) END) AS slots
  FROM {rows}))))"""


def knn(k: int, distance: str, corpus: str, asked: str) -> str:
    return f"""(SELECT query_id, rank, id, distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank
  FROM (SELECT q.query_id, c.id, round({distance}, 6) + 0.0 AS distance FROM {asked} q, {corpus} c)) WHERE rank <= {k})"""


COSINE = "1 - coalesce(list_dot_product(q.v, c.v) / nullif(sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(c.v, c.v)), 0), 0)"
SQUARED = "list_sum(list_transform(list_zip(q.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
OWN = """own AS MATERIALIZED (SELECT vec_id AS id, label, embedding::DOUBLE[] AS v FROM embeddings),
cells AS (SELECT label, unnest(range(len(v))) AS i, unnest(v) AS x FROM own),
means AS MATERIALIZED (SELECT label::BIGINT AS query_id, list(x ORDER BY i) AS v FROM (SELECT label, i, avg(x) AS x FROM cells GROUP BY ALL) GROUP BY label)"""
SEARCH = f"""{DOCS_MD},
{chunks('docs_md', 'doc_id')},
{INDEX},
corpus AS MATERIALIZED {vectors('index_rows', 'chunk')},
asked AS MATERIALIZED {vectors('(SELECT item_id AS query_id, text AS question FROM benchmark)', 'question')}"""
CONTEXTS = f"""{SEARCH},
found AS MATERIALIZED {knn(5, SQUARED, 'corpus', 'asked')},
parts AS (SELECT query_id, string_agg('[Fragmento ' || rank || ' - Fuente: Archivo: ' || path || ']' || {NL} || chunk, {NL} || {NL}
    ORDER BY rank) FILTER (distance < 0.9) AS near, count(*) AS n FROM found JOIN index_rows USING (id) GROUP BY query_id),
contexts AS MATERIALIZED (SELECT query_id, question, CASE WHEN n IS NULL THEN {quoted(NOTHING_FOUND)}
    WHEN near IS NULL THEN {quoted(NOTHING_RELEVANT)} ELSE near END AS context FROM asked LEFT JOIN parts USING (query_id))"""
PROMPTS = f"""{CONTEXTS},
prompts AS (SELECT query_id, {quoted(PROMPT_ROLE + DOMAIN + PROMPT_RULES)} || context || {quoted(PROMPT_QUESTION)} || question
  || {quoted(PROMPT_INSTRUCTIONS)} AS prompt FROM contexts)"""


def joined(items: str) -> str:
    return f"array_to_string({items}, '|')"


def plain_text(markdown: str) -> str:
    """Plain text line by line: links first, since they may run over lines; then the marks at the beginning of each line, then those inside it."""
    joined = f"array_to_string(list_transform(string_split({markdown}, {NL}), lambda l: CASE WHEN left(ltrim(l, ' ' || chr(9)), 3) IN ('```', '~~~') THEN '' ELSE l END), {NL})"
    linked = rf"regexp_replace(regexp_replace({joined}, '!\[[^\]]*\]\([^)]*\)', '', 'g'), '\[([^\]]*)\]\([^)]*\)', '\1', 'g')"
    marks = "replace(replace(l, ' ', ''), chr(9), '')"
    rule = rf"regexp_full_match({marks}, '\*\*\*[*_-]*|---[*_-]*|___[*_-]*')"
    heading = r"regexp_replace(l, '^[ \t]{0,3}#{1,6}[ \t]+', '')"
    quote = r"regexp_replace(l, '^[ \t]*>[ \t]?', '')"
    item = r"regexp_replace(l, '^[ \t]*(?:[*+\-]|[0-9]+\.)[ \t]+', '')"
    bold = r"regexp_replace(regexp_replace(l, '\*\*([^*]+)\*\*', '\1', 'g'), '__([^_]+)__', '\1', 'g')"
    light = r"regexp_replace(regexp_replace(regexp_replace(l, '\*([^*]+)\*', '\1', 'g'), '`([^`]+)`', '\1', 'g'), '<[^>]*>', '', 'g')"
    lines = f"list_transform(string_split({linked}, {NL}), lambda l: CASE WHEN {rule} THEN '' ELSE {heading} END)"
    for step in (quote, item, bold, light, "rtrim(l, ' ' || chr(9))"):
        lines = f"list_transform({lines}, lambda l: {step})"
    return strip(entities(rf"regexp_replace(array_to_string({lines}, {NL}), '\n{{3,}}', {NL} || {NL}, 'g')"))


#: Plain text of the Markdown of the pages.
PLAIN = plain_text("markdown")
PDF_NAMES = """pdfs AS (SELECT CASE WHEN page_id % 4 = 0 THEN 'p ' || page_id || '.pdf' ELSE 'p+' || page_id || '.PDF' END AS name, html FROM pages WHERE page_id % 4 < 2)"""


ORACLES: dict[str, str] = {
    "recursive_chunks": f"""WITH {DOCS_MD}, {recursive('docs_md', 'doc_id')} SELECT key AS doc_id, chunk_index, chunk FROM recursive_rows""",
    "recursive_search": f"""WITH plain AS MATERIALIZED (SELECT page_id AS path, {PLAIN} AS text FROM (SELECT page_id, {MARKDOWN} AS markdown FROM pages)),
      {recursive('plain', 'path')},
      numbered AS MATERIALIZED (SELECT key AS path, chunk, row_number() OVER (ORDER BY key, chunk_index) - 1 AS id FROM recursive_rows),
      corpus AS MATERIALIZED {vectors('numbered', 'chunk')},
      asked AS MATERIALIZED {vectors('(SELECT item_id AS query_id, text AS question FROM benchmark)', 'question')},
      found AS MATERIALIZED {knn(3, SQUARED, 'corpus', 'asked')},
      parts AS (SELECT query_id, string_agg('[Fragmento ' || rank || ' - Fuente: Archivo: ' || path || ']' || {NL} || chunk, {NL} || {NL}
        ORDER BY rank) FILTER (distance < 0.9) AS near, count(*) AS n FROM found JOIN numbered USING (id) GROUP BY query_id)
      SELECT query_id, question, CASE WHEN n IS NULL THEN {quoted(NOTHING_FOUND)} WHEN near IS NULL THEN {quoted(NOTHING_RELEVANT)} ELSE near END AS context
      FROM asked LEFT JOIN parts USING (query_id)""",
    "scan_corpus": "SELECT doc_id AS path, text, 'Archivo: ' || doc_id AS source FROM documents",
    "ingest_status": f"""WITH {ADDRESSES}, named AS (SELECT url, regexp_extract(path, '[^/]*$') AS name FROM addresses WHERE form = 0)
      SELECT url AS name, CASE WHEN regexp_full_match(name, '[0-9]+') THEN 'ok' ELSE 'rejected' END AS status,
      CASE WHEN regexp_full_match(name, '[0-9]+') THEN 'Successfully converted ''' || url || ''' to: ' || name::BIGINT
      ELSE 'Error converting ''' || url || ''': no number: ' || name END AS line FROM named""",
    "page_store": f"""WITH {ADDRESSES}, kept AS (SELECT p.page_id, p.url, html, {STORED.format(path='path')} AS storage_path
        FROM addresses a JOIN pages p USING (page_id) WHERE form = 0 AND p.url LIKE 'https://%'),
      last AS (SELECT *, row_number() OVER (PARTITION BY storage_path ORDER BY page_id DESC) AS n FROM kept),
      stored AS (SELECT storage_path, page_id, url, {REWRITTEN} AS html FROM last WHERE n = 1)
      SELECT storage_path, page_id, url, storage_path || '.html' AS html_file, storage_path || '.md' AS markdown_file, html,
      {MARKDOWN} AS markdown FROM stored""",
    "extract_links": f"WITH {LINKS} SELECT page_id, url, position, href FROM links",
    "resolve_links": f"""WITH {LINKS}, parts AS (SELECT *, substr(href, 2) AS rest, regexp_extract(url, '^https?://[^/?#]*') AS site,
        regexp_extract(url, '^[a-z]+') AS scheme, regexp_replace(url, '#.*$', '') AS page, regexp_replace(url, '[?#].*$', '') AS plain FROM links),
      folders AS (SELECT *, site || regexp_replace(substr(plain, length(site) + 1), '[^/]*$', '') AS folder FROM parts),
      forms AS (SELECT *, CASE WHEN folder = site || '/' THEN folder ELSE regexp_replace(folder, '[^/]+/$', '') END AS parent FROM folders)
      SELECT page_id, url, position, unnest(range(10)) AS form,
      unnest([href, rest, '../' || rest, './a/../' || rest, '?q=' || rest, '#' || rest, '//other.example.org' || href, 'mailto:' || rest,
        'http://other.example.org' || href, '']) AS href,
      unnest([site || href, folder || rest, parent || rest, folder || rest, plain || '?q=' || rest, page || '#' || rest,
        scheme || '://other.example.org' || href, 'mailto:' || rest, 'http://other.example.org' || href, url]) AS target FROM forms""",
    "url_parts": f"WITH {ADDRESSES} SELECT page_id, form, url, path, regexp_extract(path, '[^/]*$') AS name FROM addresses",
    "storage_path": f"WITH {ADDRESSES} SELECT page_id, form, url, {STORED.format(path='path')} AS storage_path FROM addresses",
    "route_by_type": f"""WITH {ADDRESSES}, named AS (SELECT *, regexp_extract(path, '[^/]*$') AS name FROM addresses)
      SELECT page_id, form, url, CASE WHEN lower(url) LIKE '%.pdf' THEN 'pdf' ELSE 'page' END AS route,
      CASE WHEN url LIKE 'http://%' OR url LIKE 'https://%' THEN 'remote' ELSE 'local' END AS place,
      CASE WHEN lower(url) LIKE '%.pdf' THEN CASE WHEN lower(name) LIKE '%.pdf' THEN name ELSE name || '.pdf' END END AS pdf_name FROM named""",
    "crawl_scope": "SELECT page_id, url FROM pages WHERE url LIKE 'https://%'",
    "rewrite_links": f"SELECT page_id, url, {REWRITTEN} AS html FROM pages",
    "html_to_markdown": f"""SELECT page_id, url, {MARKDOWN} AS markdown
      FROM (SELECT page_id, url, CASE WHEN page_id % 2 = 1 THEN html || {quoted(ODD_HTML)} ELSE html END AS html FROM pages)""",
    "page_edges": f"""WITH {SITE} SELECT src, dst, page_id, n_links FROM site LEFT JOIN captured USING (dst)""",
    "crawl_closure": f"""WITH RECURSIVE {SITE}, start AS (SELECT list(DISTINCT url) AS urls FROM (SELECT min_by(regexp_replace(url, '#.*', ''), page_id) AS url
        FROM firsts GROUP BY regexp_extract(old, '^[a-z]+://[^/]*'))),
      reached AS (SELECT urls AS fresh, urls AS seen, 0 AS depth FROM start
        UNION ALL SELECT n, list_concat(seen, n), depth + 1 FROM (SELECT seen, depth, coalesce((SELECT list(DISTINCT dst) FROM site
          WHERE list_contains(fresh, src) AND NOT list_contains(seen, dst)), []) AS n FROM reached) WHERE len(n) > 0)
      SELECT unnest(fresh) AS url, depth, 'page' AS route FROM reached""",
    "frontier_anti": f"""WITH {SITE} SELECT DISTINCT dst AS url FROM site WHERE dst NOT IN (SELECT dst FROM captured)""",
    "markdown_to_text": f"""SELECT page_id, {PLAIN} AS text FROM (SELECT page_id, {MARKDOWN} AS markdown FROM pages)""",
    "pages_scanned": f"""WITH {ADDRESSES}, kept AS (SELECT p.page_id, html, {STORED.format(path='path')} AS storage_path
        FROM addresses a JOIN pages p USING (page_id) WHERE form = 0 AND p.url LIKE 'https://%'),
      last AS (SELECT * FROM kept QUALIFY row_number() OVER (PARTITION BY storage_path ORDER BY page_id DESC) = 1),
      stored AS (SELECT storage_path, {REWRITTEN} AS html FROM last)
      SELECT storage_path || '.md' AS path, {MARKDOWN} AS text, 'Archivo: ' || storage_path || '.md' AS source FROM stored""",
    "pdfs_scanned": f"""WITH {PDF_NAMES} SELECT name, strlen(html) AS length, sha256(html) AS content_sha256 FROM pdfs""",
    "folder_status": f"""WITH {PDF_NAMES} SELECT '.' AS folder, name, CASE WHEN strlen(html) < 2000
        THEN 'Error converting ' || chr(39) || name || chr(39) || ': only ' || strlen(html) || ' bytes'
        ELSE 'Successfully converted ' || chr(39) || name || chr(39) || ' to: ' || regexp_replace(name, '[.][^.]*$', '') || '.md' END AS line FROM pdfs
      UNION ALL SELECT 'text', NULL, {quoted(FOLDER_EMPTY.format('text'))} UNION ALL SELECT 'nowhere', NULL, {quoted(FOLDER_MISSING.format('nowhere'))}""",
    "stream_upsert_index": f"""WITH latest AS MATERIALIZED (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN replace(text, '. ', '.' || chr(10) || chr(10)) ELSE text END AS text,
        CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END AS version FROM documents WHERE doc_id % 7 <> 0),
      {chunks('latest', 'doc_id')}
      SELECT doc_id, version, chunk_index, total_chunks, chunk, start_line, {END_LINE} AS end_line FROM chunks JOIN latest USING (doc_id)""",
    "rejected_vectors": """SELECT vec_id AS id, CASE WHEN vec_id % 11 = 0 THEN 'no vector' WHEN vec_id % 7 = 0 OR vec_id % 5 = 0 THEN 'wrong width' ELSE 'null in vector' END AS reason
      FROM embeddings WHERE vec_id % 11 = 0 OR vec_id % 7 = 0 OR vec_id % 5 = 0 OR vec_id % 3 = 0""",
    "paragraphs": f"""WITH {DOCS_MD} SELECT doc_id, unnest(range(len(p))) AS position, unnest(p) AS paragraph
      FROM (SELECT doc_id, {PARAS} AS p FROM docs_md)""",
    "word_packing": f"""WITH {DOCS_MD} SELECT doc_id, unnest(range(len(p))) AS piece_no, unnest(p) AS piece
      FROM (SELECT doc_id, {packed('text')} AS p FROM docs_md)""",
    "paragraph_chunks": f"WITH {DOCS_MD}, {chunks('docs_md', 'doc_id')} SELECT doc_id, chunk_index, chunk FROM chunks",
    "chunk_positions": f"""WITH {DOCS_MD}, {chunks('docs_md', 'doc_id')}
      SELECT doc_id, chunk_index, start_line, {END_LINE} AS end_line FROM chunks""",
    "chunk_index_table": f"WITH {DOCS_MD}, {chunks('docs_md', 'doc_id')}, {INDEX} SELECT * FROM index_rows",
    "attach_source": f"""WITH {DOCS_MD}, {chunks('docs_md', 'doc_id')},
      placed AS (SELECT *, row_number() OVER (ORDER BY doc_id, chunk_index) - 1 AS i FROM chunks)
      SELECT i::VARCHAR AS chunk_id, coalesce('Archivo: ' || d.doc_id, 'Fragmento Markdown ' || i) AS source, p.doc_id, chunk_index, chunk
      FROM placed p LEFT JOIN docs_md d ON d.doc_id = p.i""",
    "line_paragraphs": f"WITH {PARAGRAPHS} SELECT doc, page_num, position, paragraph FROM scan_paragraphs",
    "ragged_to_markdown": f"WITH {RAGGED} SELECT conv_id, turn, array_to_string(lines, {NL}) AS markdown FROM lined",
    "filled_cells": f"""WITH {RAGGED}, given AS (SELECT conv_id, turn, CASE WHEN role = 'system' THEN [[]] WHEN turn = 2 THEN [] ELSE r END AS r FROM ragged),
      filled AS (SELECT conv_id, turn, CASE WHEN len(r) = 0 THEN [[{quoted(ROWS_FAILED)}]] WHEN len(flatten(r)) = 0 THEN [[{quoted(CELLS_MISSING)}]] ELSE
        list_transform(r, lambda x: list_transform(x, lambda c: CASE WHEN contains(c, ',') OR {strip('c')} = '' THEN ' ' ELSE {strip('c')} END))
        END AS f FROM given)
      SELECT conv_id, turn, unnest(range(len(f))) AS row_no, array_to_string(unnest(f), '|') AS cells FROM filled""",
    "document_markdown": f"""WITH {RAGGED}, {PARAGRAPHS},
      texts AS (SELECT doc, page_num, string_agg(paragraph || {NL} || {NL}, {NL} ORDER BY position) AS body FROM scan_paragraphs GROUP BY ALL),
      bodies AS (SELECT {SCANNED} AS doc, l.turn + 1 AS page_num, '## Página ' || (l.turn + 1) || {NL} || {NL}
          || coalesce(body || {NL}, '') || CASE WHEN role = 'assistant' THEN {NL} || '### Tablas detectadas en esta página:' || {NL} || {NL}
          || {NL} || '**Tabla 1:**' || {NL} || {NL} || {NL} || array_to_string(lines, {NL} || {NL}) || {NL} || {NL} ELSE '' END
          || {NL} || '---' || {NL} AS page
        FROM lined l LEFT JOIN texts t ON t.doc = {SCANNED} AND t.page_num = l.turn + 1)
      SELECT replace(doc, '.pdf', '') AS base_name, 0 AS part, replace(doc, '.pdf', '.md') AS file,
      string_agg(page, {NL} ORDER BY page_num) AS markdown FROM bodies GROUP BY doc""",
    "reading_order_rows": f"""WITH {BOXES},
      heights AS (SELECT table_id, list(DISTINCT y ORDER BY y) AS ys FROM boxes GROUP BY table_id),
      walked AS (SELECT table_id, ys, list_reduce(ys, lambda a, y: CASE WHEN y - a[-1] <= 10 THEN list_append(a, a[-1]) ELSE list_append(a, y) END,
        [ys[1]]) AS anchors FROM heights),
      anchored AS (SELECT table_id, unnest(ys) AS y, unnest(anchors[2:]) AS anchor FROM walked),
      rows AS (SELECT b.*, dense_rank() OVER (PARTITION BY table_id ORDER BY anchor) - 1 AS row_no FROM boxes b JOIN anchored USING (table_id, y))
      SELECT table_id, box_id, x, y, w, h, row_no,
      row_number() OVER (PARTITION BY table_id, row_no ORDER BY x, box_id, y, w, h) - 1 AS col_no FROM rows""",
    "boxes_to_markdown": """WITH {BOXES}, cells AS MATERIALIZED (SELECT table_id, box_id, x, CASE WHEN box_id % 89 = 0 THEN NULL ELSE y END AS y, w, h,
        CASE WHEN x % 11 = 0 THEN ' ' ELSE w || ' x ' || h END AS cell FROM boxes),
      folded AS (SELECT table_id, list_reduce(list({'y': y, 'c': {'x': x, 'id': box_id, 'y': y, 'w': w, 'h': h, 't': cell}} ORDER BY y), lambda a, b: CASE
          WHEN len(a.rows) > 0 AND b.y - a.anchor <= 10 THEN {'anchor': a.anchor, 'rows': list_append(a.rows[:-2], list_append(a.rows[-1], b.c))}
          ELSE {'anchor': b.y, 'rows': list_append(a.rows, [b.c])} END,
          {'anchor': 0, 'rows': []::STRUCT(x INTEGER, id BIGINT, y INTEGER, w INTEGER, h INTEGER, t VARCHAR)[][]}).rows AS r
        FROM cells GROUP BY table_id HAVING count(y) = count(*)),
      texts AS (SELECT table_id, list_transform(r, lambda row: list_transform(list_sort(row), lambda c: c.t)) AS r FROM folded),
      ragged_tables AS (SELECT o_orderkey AS table_id, coalesce(r, [[ROWS_FAILED]]) AS r FROM orders LEFT JOIN texts ON o_orderkey = table_id),
      sized AS (SELECT *, list_max(list_transform(r, lambda x: len(x))) AS n FROM ragged_tables)
      SELECT table_id, 0 AS part, array_to_string(list_concat(
        ['| ' || array_to_string(list_transform(range(1, n + 1), lambda i: 'Columna ' || i), ' | ') || ' |',
         '| ' || array_to_string(list_transform(range(n), lambda i: '---'), ' | ') || ' |'],
        list_transform(r, lambda x: '| ' || array_to_string(list_concat(x, list_transform(range(n - len(x)), lambda i: '')), ' | ') || ' |')), chr(10)) AS markdown
      FROM sized""".replace("[[ROWS_FAILED]]", f"[[{quoted(ROWS_FAILED)}]]").replace("{BOXES}", BOXES),
    "region_filter": f"""WITH {BOXES} SELECT table_id, place + 1 AS id, x AS x0, y AS y0, x + w AS x1, y + h AS y1 FROM boxes
      WHERE w > 100 AND h > 100""",
    "acronym_occurrences": f"WITH {DOCS_ACR}, {acronyms('docs_acr', 'doc_id')} SELECT doc_id, acronym, occurrences FROM acr_doc",
    "acronym_definitions": f"WITH {DOCS_ACR}, {acronyms('docs_acr', 'doc_id')} SELECT doc_id, acronym, definition FROM acr_def",
    "acronym_dictionary": f"""WITH {DOCS_ACR}, {acronyms('docs_acr', 'doc_id')}
      SELECT acronym, part, definition, n_files, {joined('part_files')} AS files FROM acr_dict JOIN acr_parts USING (acronym)""",
    "sentences": f"WITH {terms('documents', 'doc_id')} SELECT doc_id, sentence_no, sentence FROM sentence_rows",
    "tokens": f"WITH {terms('documents', 'doc_id')} SELECT doc_id, sentence_no, position, token FROM token_rows",
    "tagged_tokens": f"""WITH {terms('documents', 'doc_id')} SELECT doc_id, sentence_no, position, token,
      CASE WHEN noun THEN 'NN' ELSE 'XX' END AS tag FROM run_marks""",
    "tagged_by_table": f"""WITH {terms('documents', 'doc_id')}, asked AS (SELECT DISTINCT lower(unnest(list_filter(
        regexp_split_to_array(text, '[^\\p{{L}}\\p{{N}}_''\\-]+'), lambda x: regexp_full_match(x, '\\p{{L}}+')))) AS token FROM benchmark)
      SELECT token, CASE WHEN length(token) >= 5 AND token NOT IN (SELECT token FROM asked) THEN 'NN' ELSE 'XX' END AS tag, count(*) AS n
      FROM token_rows GROUP BY ALL""",
    "noun_runs": f"WITH {terms('documents', 'doc_id')} SELECT doc_id, sentence_no, run_no, term FROM run_rows",
    "lemma_by_table": f"""WITH {terms('documents', 'doc_id')}, asked AS (SELECT DISTINCT lower(unnest(list_filter(
        regexp_split_to_array(text, '[^\\p{{L}}\\p{{N}}_''\\-]+'), lambda x: regexp_full_match(x, '\\p{{L}}+')))) AS token FROM benchmark)
      SELECT CASE WHEN n = 1 THEN coalesce(left(token, 4), run) ELSE run END AS term, count(*) AS n
      FROM (SELECT n, run, token FROM run_texts LEFT JOIN asked ON n = 1 AND run = token) GROUP BY 1""",
    "index_written": f"""WITH {chunks('documents', 'doc_id')}
      SELECT doc_id, chunk_index, total_chunks, chunk, start_line, {END_LINE} AS end_line FROM chunks""",
    "dictionary_written": f"""WITH {GRAPH} SELECT kind, id, 0 AS part, definition, occurrences, {joined('files')} AS files,
      {joined('connections')} AS connections, centrality FROM entries""",
    "relations_written": f"WITH {GRAPH} SELECT src, dst, path, distance FROM relations",
    "term_dictionary": f"""WITH {terms('documents', 'doc_id')}
      SELECT term, part, occurrences, n_files, {joined('part_files')} AS files FROM term_dict JOIN term_parts USING (term)""",
    "elements": f"WITH {GRAPH} SELECT id AS element, kind FROM nodes",
    "element_presence": f"""WITH {DOCS_ACR}, {acronyms('docs_acr', 'doc_id')}, {terms('docs_acr', 'doc_id')},
      named AS MATERIALIZED (SELECT acronym AS element, 'acronimo' AS kind, lower(acronym) AS e FROM acr_dict
        UNION ALL SELECT term, 'termino', term FROM term_dict),
      lowered AS MATERIALIZED (SELECT doc_id, lower(text) AS t FROM docs_acr)
      SELECT doc_id, element, kind, instr(t, e) - 1 AS position FROM lowered JOIN named ON contains(t, e)""",
    "cooccurrence_pairs": f"WITH {GRAPH} SELECT src, src_kind, dst, dst_kind, path, distance FROM relations",
    "graph_nodes": f"WITH {GRAPH} SELECT id, kind, definition, occurrences FROM nodes",
    "graph_edges": f"WITH {GRAPH} SELECT src, src_kind, dst, dst_kind, weight FROM edges",
    "degree_centrality": f"WITH {GRAPH} SELECT id, kind, degree, centrality FROM degrees",
    "element_connections": f"WITH {GRAPH} SELECT element, kind, path, other FROM connections",
    "semantic_dictionary": f"""WITH {GRAPH} SELECT kind, id, part, definition, occurrences, {joined('files')} AS files,
      {joined('connections')} AS connections, centrality FROM entries""",
    "semantic_dictionary_json": f"""WITH {GRAPH} SELECT kind, id, part, CASE WHEN kind = 'acronimo'
      THEN to_json({{'definicion': definition, 'archivos': files, 'conexiones': connections, 'centralidad': centrality}})
      ELSE to_json({{'ocurrencias': occurrences, 'archivos': files, 'conexiones': connections, 'centralidad': centrality}}) END::VARCHAR AS json
      FROM entries""",
    "graph_style": f"""WITH {GRAPH} SELECT 'node' AS part, id, NULL AS other, CASE WHEN kind = 'acronimo' THEN 'red' ELSE 'skyblue' END AS colour,
      CASE WHEN kind = 'acronimo' THEN 300.0 ELSE 100.0 + 10 * occurrences END::DOUBLE AS measure FROM nodes
      UNION ALL SELECT 'edge', src, dst, 'gray', (weight * 0.5)::DOUBLE FROM edges""",
    "graph_export_lines": f"""WITH {GRAPH} SELECT 'node' AS section, '<node id="' || {escaped('id')} || '">' || {data('tipo', 'kind')}
      || {data('definicion', 'definition')} || {data('ocurrencias', 'occurrences::VARCHAR')} || '</node>' AS line FROM nodes
      UNION ALL SELECT 'edge', '<edge source="' || {escaped('src')} || '" target="' || {escaped('dst')} || '">'
      || {data('weight', 'weight::VARCHAR')} || '</edge>' FROM edges""",
    "run_stats": f"""WITH {GRAPH}, {chunks('talks', 'path')} SELECT 'files' AS metric, count(*) AS value FROM talks
      UNION ALL SELECT 'acronyms', count(*) FROM acr_dict UNION ALL SELECT 'terms', count(*) FROM term_dict
      UNION ALL SELECT 'relations', count(*) FROM relations UNION ALL SELECT 'nodes', count(*) FROM nodes
      UNION ALL SELECT 'edges', count(*) FROM edges UNION ALL SELECT 'chunks', count(*) FROM chunks""",
    "enriched_texts": f"""WITH {GRAPH} SELECT kind, id, part, CASE WHEN kind = 'acronimo' THEN 'ACRÓNIMO: ' || id ELSE 'TÉRMINO: ' || id END
      || CASE WHEN kind = 'acronimo' AND definition <> '' THEN {NL} || 'DEFINICIÓN: ' || definition ELSE '' END
      || CASE WHEN kind = 'termino' THEN {NL} || 'OCURRENCIAS: ' || occurrences ELSE '' END
      || {NL} || 'APARECE EN: ' || array_to_string(files, ', ')
      || CASE WHEN len(connections) > 0 THEN {NL} || 'RELACIONADO CON: ' || array_to_string(connections, ', ') ELSE '' END AS text,
      definition, occurrences, {joined('files')} AS files, centrality FROM entries""",
    "embed_chunks": f"""WITH {DOCS_MD}, {chunks('docs_md', 'doc_id')}
      SELECT doc_id, chunk_index, array_to_string(list_transform(v, lambda x: round(x * 1000000)::BIGINT), '|') AS embedding
      FROM {vectors('chunks', 'chunk')}""",
    "semantic_search": f"WITH {SEARCH} SELECT query_id, rank, id, distance FROM {knn(5, COSINE, 'corpus', 'asked')}",
    "knn_cosine": f"WITH {OWN} SELECT query_id, rank, id, distance FROM {knn(5, COSINE, 'own', 'means')}",
    "knn_l2": f"WITH {OWN} SELECT query_id, rank, id, distance FROM {knn(3, SQUARED, 'own', 'means')}",
    "knn_cutoff": f"WITH {OWN} SELECT query_id, rank, id, distance FROM {knn(5, SQUARED, 'own', 'means')} WHERE distance < 1.5",
    "search_report": f"""WITH {SEARCH}, found AS {knn(5, COSINE, 'corpus', 'asked')}
      SELECT query_id, rank AS result_no, filename, path, start_line || ' - ' || end_line AS lines,
      (chunk_index + 1) || ' de ' || total_chunks AS chunk_of,
      printf('%.2f%%', round(round((1 - distance) * 1000000) / 100) / 100) AS relevance, chunk FROM found JOIN index_rows USING (id)""",
    "context_assembly": f"WITH {CONTEXTS} SELECT query_id, question, context FROM contexts",
    "prompt_build": f"WITH {PROMPTS} SELECT query_id, prompt FROM prompts",
    "request_payload": f"""WITH {PROMPTS} SELECT query_id, to_json({{'model': 'local-model', 'messages': [{{'role': 'user', 'content': prompt}}],
      'max_tokens': 800, 'temperature': 0.5::DOUBLE}})::VARCHAR AS payload FROM prompts""",
    "parse_responses": f"""SELECT conv_id * 1000 + turn AS query_id, CASE WHEN role = 'system' THEN {quoted(ANSWER_HTTP_ERROR + 'Internal Server Error')}
      WHEN role = 'assistant' OR (turn <> 0 AND NOT contains(text, '.')) THEN text ELSE {quoted(ANSWER_ERROR)} END AS answer FROM conversations""",
    "stream_chunk_index": f"""WITH {chunks('documents', 'doc_id')}
      SELECT doc_id, chunk_index, total_chunks, chunk, start_line, {END_LINE} AS end_line FROM chunks""",
}
