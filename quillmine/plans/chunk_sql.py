"""The chunker and its enrichment in SQL for DuckDB, as common table expressions over ``source(document_id, text, title)``."""

from __future__ import annotations

from quillmine.functions import text as T
from quillmine.operators.chunking import LEAST_TOKENS, MOST_TOKENS


def stripped(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def tokens(x: str) -> str:
    return f"CASE WHEN {stripped(x)} = '' THEN 0 ELSE CAST(ceil(length({x}) / 4.0) AS INTEGER) END"


def flat(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def preview(x: str) -> str:
    return f"CASE WHEN length({flat(x)}) <= 200 THEN {flat(x)} ELSE trim(substring({flat(x)}, 1, 197)) || '...' END"


def parts(source: str, name: str, keys: str) -> str:
    """CTEs that end with ``name``(keys, part, n_parts, piece): column ``body`` of ``source`` cut into parts of MOST_TOKENS.

    Short bodies are a part; of others the paragraphs, and the sentences of long paragraphs, fill parts in turn by recursion.
    """
    on = " AND ".join(f"x.{k} = f.{k}" for k in keys.split(", "))
    opens = f"x.begins OR ceil((f.carried + length(x.joiner) + x.n) / 4.0) > {MOST_TOKENS}"
    return f"""{name}_bodies AS MATERIALIZED (SELECT {keys}, {stripped('body')} AS body FROM {source}),
{name}_paragraphs AS (SELECT {keys}, unnest(p) AS p, generate_subscripts(p, 1) AS pos FROM (SELECT {keys}, regexp_split_to_array(body, '\\n{{2,}}') AS p FROM {name}_bodies WHERE {tokens('body')} > {MOST_TOKENS})),
{name}_sentences AS (SELECT {keys}, pos, unnest(s) AS s, generate_subscripts(s, 1) AS place FROM (SELECT {keys}, pos, regexp_extract_all(p, '[^.!?]+[.!?]+|\\S+') AS s FROM {name}_paragraphs WHERE {tokens('p')} > {MOST_TOKENS})),
{name}_units AS MATERIALIZED (SELECT *, length(piece) AS n, row_number() OVER (PARTITION BY {keys} ORDER BY pos, place) AS u FROM
  (SELECT {keys}, pos, 1 AS place, chr(10) || chr(10) AS joiner, p AS piece, false AS begins FROM {name}_paragraphs WHERE p <> '' AND {tokens('p')} <= {MOST_TOKENS}
   UNION ALL SELECT {keys}, pos, place, ' ', {stripped('s')}, place = 1 FROM {name}_sentences)),
{name}_fold AS (SELECT {keys}, u, 1 AS part, n AS carried, true AS opened FROM {name}_units WHERE u = 1
  UNION ALL SELECT {', '.join(f'x.{k}' for k in keys.split(', '))}, x.u, f.part + CASE WHEN {opens} THEN 1 ELSE 0 END, CASE WHEN {opens} THEN x.n ELSE f.carried + length(x.joiner) + x.n END, {opens}
  FROM {name}_fold f JOIN {name}_units x ON {on} AND x.u = f.u + 1),
{name}_joined AS (SELECT {keys}, part, {stripped("string_agg(CASE WHEN opened THEN piece ELSE joiner || piece END, '' ORDER BY u)")} AS piece FROM {name}_fold JOIN {name}_units USING ({keys}, u) GROUP BY {keys}, part),
{name}_all AS (SELECT {keys}, 1 AS part, body AS piece FROM {name}_bodies WHERE {tokens('body')} BETWEEN 1 AND {MOST_TOKENS} UNION ALL SELECT * FROM {name}_joined WHERE piece <> ''),
{name} AS (SELECT {keys}, row_number() OVER (PARTITION BY {keys} ORDER BY part) AS part, count(*) OVER (PARTITION BY {keys}) AS n_parts, piece FROM {name}_all)"""


#: From a line's text ``s`` without space at its ends: the level and title of a heading.
_MARKED, _NUMBERED = "'^(#{1,6})\\s+(.+)$'", "'^([0-9]+(?:\\.[0-9]+)*)\\.\\s+(.+)$'"
_LOUD = "s = upper(s)"
_LEVEL = f"""CASE WHEN s = '' OR length(s) > 120 THEN NULL WHEN regexp_matches(s, {_MARKED}) THEN length(regexp_extract(s, {_MARKED}, 1))
  WHEN regexp_matches(s, {_NUMBERED}) THEN length(regexp_replace(regexp_extract(s, {_NUMBERED}, 1), '[^.]', '', 'g')) + 1
  WHEN {_LOUD} AND length(s) BETWEEN 3 AND 60 AND regexp_matches(s, '[A-Z]') AND NOT regexp_matches(s, '^[0-9]') THEN 1
  WHEN length(s) <= 80 AND regexp_matches(s, '^[A-Z][a-zA-Z0-9\\s/&:-]+$') AND length(regexp_split_to_array(s, '\\s+')) <= 10 THEN CASE WHEN {_LOUD} THEN 1 ELSE 2 END END"""
_NAME = f"CASE WHEN regexp_matches(s, {_MARKED}) THEN trim(regexp_extract(s, {_MARKED}, 2)) WHEN regexp_matches(s, {_NUMBERED}) THEN trim(regexp_extract(s, {_NUMBERED}, 2)) ELSE trim(regexp_replace(s, '^#+\\s*', '')) END"

#: CTEs that end with topics(document_id, chunk_index, sec, text, title, topic, subtopic, section_path, level, parent_chunk_index, token_count, content_preview).
TOPICS = f"""texts AS (SELECT document_id, {stripped('text')} AS text, coalesce(nullif(title, ''), 'Document') AS title FROM source WHERE {stripped("coalesce(text, '')")} <> ''),
lines AS (SELECT *, {stripped('line')} AS s FROM (SELECT document_id, title, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM (SELECT *, regexp_split_to_array(text, '\\r?\\n') AS l FROM texts))),
heads AS (SELECT *, {_LEVEL} AS level, {_NAME} AS name FROM lines),
owned AS (SELECT *, level IS NOT NULL AND max(CASE WHEN level IS NOT NULL AND lower(name) <> lower(title) THEN 1 ELSE 0 END) OVER (PARTITION BY document_id ORDER BY i) = 1 AS own, s = '' OR level IS NOT NULL AS ends FROM heads),
placed AS MATERIALIZED (SELECT *, sum(CASE WHEN own THEN 1 ELSE 0 END) OVER w AS sec, sum(CASE WHEN ends THEN 1 ELSE 0 END) OVER w AS par FROM owned WINDOW w AS (PARTITION BY document_id ORDER BY i)),
paragraphs AS (SELECT document_id, sec, par, {stripped("string_agg(line, chr(10) ORDER BY i)")} AS p FROM placed WHERE NOT ends GROUP BY document_id, sec, par),
contents AS (SELECT document_id, sec, string_agg(p, chr(10) || chr(10) ORDER BY par) AS content FROM paragraphs GROUP BY document_id, sec),
secs AS MATERIALIZED (SELECT document_id, sec, level, name FROM placed WHERE own UNION ALL SELECT document_id, 0, 0, title FROM texts),
above AS MATERIALIZED (SELECT a.document_id, a.sec, a.name, max(b.sec) AS up FROM secs a LEFT JOIN secs b ON b.document_id = a.document_id AND b.sec < a.sec AND b.sec > 0 AND b.level < a.level WHERE a.sec > 0 GROUP BY ALL),
paths AS (SELECT document_id, sec, [name] AS path FROM above WHERE up IS NULL UNION ALL SELECT a.document_id, a.sec, list_append(p.path, a.name) FROM paths p JOIN above a ON a.document_id = p.document_id AND a.up = p.sec),
filled AS (SELECT document_id, sec, content FROM contents UNION ALL SELECT document_id, 0, text FROM texts t WHERE NOT EXISTS (SELECT 1 FROM contents c WHERE c.document_id = t.document_id) AND NOT EXISTS (SELECT 1 FROM above a WHERE a.document_id = t.document_id)),
bodies AS MATERIALIZED (SELECT f.document_id, f.sec, s.name, t.title, coalesce(p.path, [t.title]) AS path, CASE WHEN starts_with(lower(f.content), lower(s.name)) THEN f.content ELSE s.name || chr(10) || chr(10) || f.content END AS body
  FROM filled f JOIN secs s USING (document_id, sec) JOIN texts t USING (document_id) LEFT JOIN paths p USING (document_id, sec)),
{parts('bodies', 'cuts', 'document_id, sec')},
chosen AS (SELECT document_id, sec, part, piece, CASE WHEN n_parts > 1 THEN name || ' (part ' || part || ')' ELSE name END AS name, title, path, CASE WHEN lower(path[1]) = lower(title) THEN path[2:] ELSE path END AS below
  FROM cuts JOIN bodies USING (document_id, sec) WHERE n_parts > 1 OR {tokens('piece')} >= {LEAST_TOKENS}),
bare AS (SELECT document_id, text AS body, title FROM texts t WHERE NOT EXISTS (SELECT 1 FROM chosen c WHERE c.document_id = t.document_id)),
{parts('bare', 'whole', 'document_id')},
numbered AS MATERIALIZED (SELECT *, CAST(row_number() OVER (PARTITION BY document_id ORDER BY sec, part) - 1 AS INTEGER) AS chunk_index FROM chosen),
parents AS (SELECT a.document_id, a.sec, max(b.chunk_index) AS parent FROM (SELECT DISTINCT document_id, sec, path FROM numbered WHERE length(path) > 1) a JOIN numbered b ON b.document_id = a.document_id AND b.sec < a.sec AND array_to_string(b.path, '/') = array_to_string(a.path[:-2], '/') GROUP BY ALL),
topics AS MATERIALIZED (SELECT document_id, chunk_index, piece AS text, name AS title, CASE WHEN length(below) > 0 THEN below[1] ELSE title END AS topic, CASE WHEN length(below) > 1 THEN below[-1] END AS subtopic, path AS section_path,
    CASE WHEN length(below) <= 1 THEN 'topic' WHEN length(below) = 2 THEN 'subtopic' ELSE 'semantic' END AS level, parent AS parent_chunk_index, {tokens('piece')} AS token_count, {preview('piece')} AS content_preview FROM numbered LEFT JOIN parents USING (document_id, sec)
  UNION ALL SELECT document_id, CAST(part - 1 AS INTEGER), piece, title, title, NULL, [title], 'semantic', NULL, {tokens('piece')}, {preview('piece')} FROM whole JOIN bare USING (document_id))"""

_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
_WORDS = "regexp_split_to_array(lower(concat_ws(' ', title, topic, coalesce(subtopic, ''), text)), '\\W+')"
_FIRST = f"trim(coalesce(nullif(regexp_extract(regexp_replace({flat('text')}, '^[.!?]+', ''), '^[^.!?]+[.!?]+'), ''), {flat('text')}))"
_SHORT = f"CASE WHEN length({_FIRST}) > {T.SUMMARY} THEN trim(substring({_FIRST}, 1, {T.SUMMARY - 3})) || '...' ELSE {_FIRST} END"


def _first_of_each(lists: str, kept: str, name: str) -> str:
    """A list's different values that are not empty, in order of their first place."""
    return f"{name} AS (SELECT document_id, chunk_index, list(x ORDER BY pos) AS {name} FROM (SELECT document_id, chunk_index, x, min(pos) AS pos FROM (SELECT document_id, chunk_index, unnest(l) AS x, generate_subscripts(l, 1) AS pos FROM (SELECT document_id, chunk_index, {lists} AS l FROM {kept})) WHERE x <> '' GROUP BY ALL) GROUP BY ALL)"


#: CTEs behind TOPICS that end with enriched, which has the columns of ``enriched`` in quillmine.operators.chunking.
ENRICHED = f"""words AS (SELECT document_id, chunk_index, unnest({_WORDS}) AS word, generate_subscripts({_WORDS}, 1) AS pos FROM topics),
counted AS (SELECT document_id, chunk_index, word, count(*) AS n, min(pos) AS pos FROM words WHERE length(word) >= 3 AND word NOT IN ({_STOP}) GROUP BY document_id, chunk_index, word QUALIFY row_number() OVER (PARTITION BY document_id, chunk_index ORDER BY count(*) DESC, min(pos)) <= 12),
keywords AS (SELECT document_id, chunk_index, list(word ORDER BY n DESC, pos) AS keywords FROM counted GROUP BY ALL),
described AS MATERIALIZED (SELECT t.*, coalesce(k.keywords, []) AS keywords, CASE WHEN contains(lower({_SHORT}), lower(title)) THEN {_SHORT} ELSE title || ': ' || {_SHORT} END AS summary FROM topics t LEFT JOIN keywords k USING (document_id, chunk_index)),
{_first_of_each(f"section_path || [subtopic, topic] || regexp_extract_all(text, '\\b[A-Z][a-z]+(?:[A-Z][a-z]+)+\\b')[:{T.NAMES}] || list_transform(regexp_extract_all(text, '`([^`]+)`', 1)[:{T.CODES}], lambda x: trim(x))", "described", "concepts")},
{_first_of_each(f"[lower(topic), lower(subtopic), level] || keywords[:{T.TAG_WORDS}]", "described", "tags")},
enriched AS (SELECT d.*, coalesce(c.concepts, []) AS concepts, t.tags[:{T.MOST_TAGS}] AS tags FROM described d LEFT JOIN concepts c USING (document_id, chunk_index) LEFT JOIN tags t USING (document_id, chunk_index))"""
EMBEDDING = "concat_ws(chr(10), 'Topic: ' || topic, 'Subtopic: ' || nullif(subtopic, ''), 'Title: ' || title, 'Summary: ' || summary, 'Keywords: ' || array_to_string(keywords, ', '), nullif(text, ''))"
SEARCHABLE = "concat_ws(chr(10), " + ", ".join([*(f"nullif({c}, '')" for c in ("title", "topic", "subtopic", "summary")), *(f"nullif(array_to_string({c}, ' '), '')" for c in ("keywords", "concepts", "tags", "section_path")), "nullif(text, '')"]) + ")"
#: CTE behind TOPICS: ancestors(document_id, chunk_index, ancestor, distance).
ANCESTORS = """ancestors AS (SELECT document_id, chunk_index, parent_chunk_index AS ancestor, 1 AS distance FROM topics WHERE parent_chunk_index IS NOT NULL
  UNION ALL SELECT a.document_id, a.chunk_index, t.parent_chunk_index, a.distance + 1 FROM ancestors a JOIN topics t ON t.document_id = a.document_id AND t.chunk_index = a.ancestor WHERE t.parent_chunk_index IS NOT NULL)"""
