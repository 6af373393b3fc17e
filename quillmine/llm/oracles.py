"""The same as queries of this subpackage in SQL for DuckDB, where SQL can express them."""

from __future__ import annotations

from quillmine.llm.sharding import PARTS

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_CANONICAL = """CASE WHEN regexp_extract({0}, '(?s)^[^:/?#]*://([^/?#]*)', 1) <> '' THEN
  regexp_replace(lower(regexp_extract({0}, '(?s)^[^:/?#]*://([^/?#]*)', 1)), ':(80|443)$', '') ||
  CASE WHEN starts_with(regexp_extract({0}, '(?s)^[^:/?#]*://[^/?#]*([^#]*)', 1), '/') THEN '' ELSE '/' END || regexp_extract({0}, '(?s)^[^:/?#]*://[^/?#]*([^#]*)', 1) END"""

OP1 = f"""WITH p AS (SELECT page_id AS p, url, md5(coalesce(html, '')) AS digest, 1704067200 + page_id * 7919 % 2592000 AS t FROM pages),
responses AS (SELECT 2 * p AS record_id, {_CANONICAL.format("url")} AS canonical, t AS ts, '"' || digest || '"' AS tag, 't' || (t - 3600) AS changed, digest, t FROM p),
best AS (SELECT * FROM responses WHERE canonical IS NOT NULL AND ts IS NOT NULL QUALIFY row_number() OVER (PARTITION BY canonical, ts ORDER BY record_id DESC) = 1),
revisits AS (SELECT 2 * p + 1 AS record_id, {_CANONICAL.format("url")} AS canonical, t + 86400 * (p % 5 - 1) AS ts,
  CASE WHEN p % 11 = 0 THEN '"stale"' WHEN p % 7 <> 0 AND p % 13 <> 0 THEN 'W/"' || digest || '"' END AS tag, CASE WHEN p % 13 <> 0 THEN 't' || (t - 3600) END AS changed FROM p),
joined AS (SELECT r.*, b.record_id AS response_id, b.ts AS response_ts, b.tag AS old_tag, b.changed AS old_changed, b.digest AS old_digest
  FROM revisits r ASOF LEFT JOIN best b ON r.canonical = b.canonical AND r.ts > b.ts),
judged AS (SELECT *, CASE WHEN response_id IS NULL THEN 'no_response'
  WHEN tag IS NOT NULL THEN CASE WHEN regexp_replace(tag, '^W/', '') = old_tag THEN 'resolved' ELSE 'mismatch' END
  WHEN changed IS NOT NULL THEN CASE WHEN changed = old_changed THEN 'resolved' ELSE 'mismatch' END ELSE 'unvalidated' END AS outcome FROM joined)
SELECT record_id, canonical, ts, outcome, response_id, response_ts, CASE WHEN outcome = 'resolved' THEN old_digest END AS digest,
  CASE WHEN outcome = 'resolved' THEN concat_ws(chr(10), 'cache-control=max-age=60', 'content-type=text/html', 'date=' || ts, 'etag=' || coalesce(tag, old_tag), 'last-modified=' || old_changed) END AS headers
FROM judged"""

_PART = "regexp_extract({0}, '(?s)^.*?://([^/?#]*)([^?#]*)', {1})"
_FITS = [("net/", "block"), ("org/fr/", "allow"), ("example.net/en/", "allow"), ("example.com/de/", "block")]
_RULE = (
    lambda host, path, what: "CASE "
    + " ".join(
        f"WHEN ({host} = '{r.partition('/')[0]}' OR ends_with({host}, '.{r.partition('/')[0]}')) AND starts_with({path}, '/{r.partition('/')[2]}') THEN '{r if what == 'rule' else v}'"
        for r, v in sorted(_FITS, key=lambda x: -len(x[0]))
    )
    + " END"
)


def _host(u: str) -> str:
    return f"translate(coalesce({_PART.format(u, 1)}, ''), '{_UPPER}', '{_LOWER}')"


def _path(u: str) -> str:
    return f"coalesce({_PART.format(u, 2)}, '')"


def _node(u: str) -> str:
    rest = f"regexp_extract({u}, '(?s)^.*?://[^/?#]*([^#]*)', 1)"
    return f"CASE WHEN {_host(u)} <> '' THEN translate(regexp_extract({u}, '(?s)^(.*?)://', 1), '{_UPPER}', '{_LOWER}') || '://' || {_host(u)} || CASE WHEN starts_with({rest}, '/') THEN '' ELSE '/' END || {rest} END"


def _attribute(tag: str, mark: str, value: str) -> str:
    """The first value of the tags that carry the mark; RE2 has no lookahead, so tags are listed first."""
    tags = f"list_filter(regexp_extract_all(html, '(?is)<{tag}\\b[^>]*>'), lambda t: regexp_matches(t, '{mark}'))"
    return f"coalesce(regexp_extract(list_filter({tags}, lambda t: regexp_matches(t, '{value}'))[1], '{value}', 1), '')"


_REL = """(?is)\\brel\\s*=\\s*["'']?canonical["''\\s/>]"""
_HREF = """(?is)\\bhref\\s*=\\s*["'']?([^"''\\s>]+)"""
_EQUIV = """(?is)\\bhttp-equiv\\s*=\\s*["'']?refresh["''\\s/>]"""
_URL = """(?is)\\bcontent\\s*=\\s*["''][^"''>]*?url\\s*=\\s*([^"''\\s>]+)"""

OP2 = f"""WITH RECURSIVE found AS (SELECT url, unnest([{_attribute("link", _REL, _HREF)}, {_attribute("meta", _EQUIV, _URL)}]) AS raw FROM pages),
targets AS (SELECT url, replace(raw, '&amp;', '&') AS t, regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) AS origin, {_path("url")} AS path FROM found WHERE raw <> ''),
links AS (SELECT {_node("url")} AS a, {_node("target")} AS b FROM (SELECT url, CASE WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN t
  WHEN starts_with(t, '//') THEN regexp_extract(url, '(?s)^(.*?)://', 1) || ':' || t WHEN starts_with(t, '/') THEN origin || t WHEN starts_with(t, '?') THEN origin || path || t
  ELSE origin || regexp_extract(CASE WHEN path = '' THEN '/' ELSE path END, '(?s)^(.*/)', 1) || t END AS target FROM targets)),
edges AS (SELECT a, b FROM links WHERE a <> b UNION SELECT b, a FROM links WHERE a <> b),
reach(n, m) AS (SELECT a, a FROM edges UNION SELECT r.n, e.b FROM reach r JOIN edges e ON r.m = e.a),
verdicts AS (SELECT n, bool_or({_RULE(_host("m"), _path("m"), "verdict")} = 'block') AS bad, bool_or({_RULE(_host("m"), _path("m"), "verdict")} = 'allow') AS good FROM reach GROUP BY n),
rows AS (SELECT page_id, {_host("url")} AS host, {_path("url")} AS path, {_node("url")} AS node FROM pages)
SELECT page_id, host, path, {_RULE("host", "path", "rule")} AS rule,
  coalesce({_RULE("host", "path", "verdict")}, CASE WHEN bad AND NOT coalesce(good, false) THEN 'block' ELSE 'allow' END) AS verdict
FROM rows LEFT JOIN verdicts ON n = node"""


def _u(shard: int) -> str:
    return f"(CAST('0x' || substring(md5(name || ':{shard}'), 1, 12) AS BIGINT) + 0.5::DOUBLE) / {2**48}.0::DOUBLE"


_SCORES = ", ".join(f"1.0::DOUBLE / -ln({_u(i)})" for i in range(24))

OP8 = f"""WITH bits AS (SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
d AS (SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), '') AS name, strlen(coalesce(text, '')) AS n, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT doc_id, name, n + 8 AS size, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, n + 1), lambda i: CAST('0x' || substring(h, 2 * i - 1, 2) AS BIGINT))),
  lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32 FROM d, bits),
s AS (SELECT *, [{_SCORES}] AS scores, 1.0::DOUBLE / -ln({_u(24)}) AS more FROM c),
dealt AS (SELECT *, list_position(scores, list_max(scores)) - 1 AS shard, CAST('0x' || substring(md5(concat_ws(':', name, text_crc32, size)), 1, 8) AS BIGINT) % {PARTS} AS part FROM s)
SELECT doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard, row_number() OVER (PARTITION BY shard ORDER BY part, doc_id, text_crc32, size) - 1 AS slot,
  CAST(CASE WHEN more > list_max(scores) THEN 24 ELSE shard END AS INTEGER) AS grown_shard FROM dealt"""

OP3 = """WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
good AS (SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND list_count(e) = len(e) AND len(list_filter(e, lambda x: NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach(n, m) AS (SELECT a, a FROM links UNION SELECT r.n, l.b FROM reach r JOIN links l ON r.m = l.a)
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links, coalesce((SELECT min(m) FROM reach WHERE n = vec_id), vec_id) AS component_id,
  vec_id = coalesce((SELECT min(m) FROM reach WHERE n = vec_id), vec_id) AS kept FROM v"""

ORACLES = {"op1_warc_revisits": OP1, "op2_url_filters": OP2, "op3_pivot_index": OP3, "op8_rendezvous_sharding": OP8}
