"""What each query must give, as SQL over the supplied tables.

The SQL works from the tables directly: it never sees a feed document, it states the rows that
reading one back must produce. It is written independently of the library.
"""

from __future__ import annotations

import re
from html.entities import name2codepoint

# Fixed values, stated here again so that the SQL does not follow the library: white space, and block elements.
UNICODE_SPACE = r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
BLOCKS = (
    "p|div|section|article|header|footer|main|aside|nav|figure|figcaption|table|thead|tbody|tr|ul|ol|dl|dt|dd|form|"
    "fieldset|address|details|summary|blockquote|pre|h1|h2|h3|h4|h5|h6|html|body"
)

HEX16 = "substr(sha256({}), 1, 16)"
RFC = "strftime({}, '%Y-%m-%dT%H:%M:%SZ')"
# Years before 0 with a sign and four digits at least, as ISO 8601 spells them; strftime does not pad those.
RFC_FAR = "printf(CASE WHEN year({0}) < 0 THEN '%05d' ELSE '%04d' END, year({0})) || strftime({0}, '-%m-%dT%H:%M:%SZ')"
MICROS = "strftime({}, '%Y-%m-%d %H:%M:%S.%f')"


def quote(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


# Documents as items of their source's feed.
ITEMS = """
items AS (
  SELECT doc_id, lang, source, text,
    'https://' || source || '.example.com/feed.xml' AS feed_url,
    'Post ' || doc_id AS title,
    CASE WHEN lang IN ('en','fr') THEN 'https://' || source || '.example.com/p/' || doc_id END AS url,
    CASE WHEN lang <> 'es' THEN 'g' || doc_id END AS guid,
    CASE WHEN lang <> 'es' THEN TIMESTAMP '2024-01-01' + INTERVAL 97 MINUTE * doc_id END AS ts
  FROM documents),
ids AS (
  SELECT *, substr(sha256(feed_url || chr(10) || coalesce(url, guid,
      title || '|' || coalesce(strftime(ts, '%Y-%m-%dT%H:%M:%SZ'), ''))), 1, 16) AS id,
    CASE WHEN url IS NOT NULL THEN 'link' WHEN guid IS NOT NULL THEN 'guid' ELSE 'hash' END AS id_source,
    substr(sha256(text), 1, 16) AS content_hash,
    CAST((length(text) + 3) // 4 AS BIGINT) AS tokens
  FROM items)
"""

# Documents as feeds of their own, lines as entries; values come back from a parser trimmed.
LINES = """
raw_lines AS (
  SELECT doc_id, lang, source, unnest(string_split(text, chr(10))) AS raw,
    generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents),
lines AS (
  SELECT doc_id, lang, source, CAST(pos AS BIGINT) AS pos, raw,
    'https://' || source || '.example.com/' || doc_id || '/feed.xml' AS feed_url,
    'Line ' || pos AS title,
    '/d/' || doc_id || '/' || pos AS link,
    'https://' || source || '.example.com/d/' || doc_id || '/' || pos AS url,
    'd' || doc_id || '-' || pos AS guid,
    CASE WHEN lang <> 'es' THEN
      TIMESTAMP '2024-01-01' + INTERVAL 1 MINUTE * (doc_id * 97 + pos * 61) END AS ts,
    regexp_replace(raw, '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '', 'g') AS line
  FROM raw_lines)
"""

# Entries of each readable feed, newest first, bodies cut at 2,000 characters.
PICKED_CUT = (
    LINES
    + """,
bodies AS (
  SELECT *, CASE WHEN lang = 'es' THEN raw ELSE line END AS body FROM lines WHERE lang <> 'de'),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ts DESC NULLS LAST, pos) AS rn FROM bodies),
picked AS (
  SELECT *, nullif(body, '') AS whole, coalesce(length(body) > 2000, false) AS cut,
    CASE WHEN body = '' THEN NULL WHEN length(body) > 2000 THEN substr(body, 1, 2000) || ' …[truncated]' ELSE body END AS content,
    substr(sha256(feed_url || chr(10) || url), 1, 16) AS id,
    CASE WHEN body = '' THEN NULL ELSE substr(sha256(body), 1, 16) END AS content_hash
  FROM ranked),
sized AS (
  SELECT *, CAST(coalesce((length(content) + 3) // 4, 0) AS BIGINT) AS tokens,
    CASE WHEN lang = 'en' THEN ts END AS rss_published,
    strftime(CASE WHEN lang = 'fr' THEN NULL ELSE ts END, '%Y-%m-%dT%H:%M:%SZ') AS published,
    strftime(CASE WHEN lang = 'fr' THEN ts END, '%Y-%m-%dT%H:%M:%SZ') AS updated
  FROM picked),
feeds AS (
  SELECT d.doc_id AS request_pos, 'https://' || d.source || '.example.com/' || d.doc_id || '/feed.xml' AS feed_url,
    CASE WHEN d.lang = 'de' THEN 'error' ELSE 'ok' END AS status,
    CASE WHEN d.lang <> 'de' THEN 'Feed ' || d.doc_id END AS title,
    CASE WHEN d.lang <> 'de' THEN 'https://' || d.source || '.example.com/' END AS site_url,
    coalesce(p.n, 0) AS item_count, coalesce(p.tokens, 0) AS tokens, coalesce(p.n_cut, 0) AS n_cut,
    coalesce(p.n_dated, 0) AS n_dated,
    CASE WHEN d.lang = 'de' THEN 'FEED_PARSE_FAILED' END AS error_code
  FROM documents d LEFT JOIN (
    SELECT doc_id, count(*) AS n, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(CAST(cut AS INT)) AS BIGINT) AS n_cut,
      count(ts) AS n_dated
    FROM sized GROUP BY doc_id) p USING (doc_id))
"""
)

# The same with whole bodies.
PICKED = PICKED_CUT.replace("length(body) > 2000", "false")

EVENT_ITEMS = """
ev AS (
  SELECT 'u' || user_id AS feed_url, event_id, CASE WHEN event_type <> 'signup' THEN ts END AS ts
  FROM events)
"""

# Events as responses: 200 / 304 / 429 / 500 by kind.
RESPONSES = """
resp AS (
  SELECT event_id, 'https://h' || user_id || '.example.com/feed' AS feed_url, ts, props AS body, 'e' || event_id AS etag,
    CASE event_type WHEN 'error' THEN 429 WHEN 'signup' THEN 304 WHEN 'purchase' THEN 500 ELSE 200 END AS code,
    CASE WHEN event_type = 'error' THEN '30' END AS retry_after
  FROM events)
"""

FOLDED = (
    RESPONSES
    + """,
writes AS (
  SELECT feed_url, arg_max(etag, ts) AS etag, arg_max(body, ts) AS body, max(ts) AS written, min(ts) AS first_write
  FROM resp WHERE code = 200 GROUP BY feed_url),
folded AS (
  SELECT w.feed_url, w.etag, w.body, greatest(w.written, coalesce(c.confirmed, w.written)) AS fetched_at
  FROM writes w LEFT JOIN (
    SELECT r.feed_url, max(r.ts) AS confirmed FROM resp r JOIN writes USING (feed_url)
    WHERE r.code = 304 AND r.ts >= first_write GROUP BY r.feed_url) c USING (feed_url))
"""
)

# The time of the runs.
STAMP = "2024-01-31T00:00:00Z"

STREAKS = """
elog AS (
  SELECT event_id, 'h' || user_id || '.example.com:443' AS authority, ts, event_type = 'error' AS throttled,
    CASE WHEN event_type = 'error' AND value < 20 THEN floor(value * 10) END AS retry_after
  FROM events),
isl AS (
  SELECT *, sum(CASE WHEN throttled THEN 0 ELSE 1 END) OVER (PARTITION BY authority ORDER BY ts, event_id
      ROWS UNBOUNDED PRECEDING) AS island
  FROM elog),
streaks AS (
  SELECT *, CASE WHEN throttled THEN CAST(sum(CASE WHEN throttled THEN 1 ELSE 0 END) OVER (
      PARTITION BY authority, island ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) ELSE 0 END AS streak
  FROM isl),
state AS (
  SELECT authority, arg_max(streak, ts) AS streak,
    max(CASE WHEN throttled THEN ts + INTERVAL 1 SECOND *
      least(coalesce(retry_after, 2 * power(2, least(streak - 1, 30))), 60) END) AS next_allowed,
    max(CASE WHEN throttled THEN ts + INTERVAL 120 SECOND END) AS warm_until
  FROM streaks GROUP BY authority)
"""

# What a report holds: the newest 25 of them.
REPORTED = PICKED.replace("FROM ranked)", "FROM ranked WHERE rn <= 25)")
REPORTED_CUT = PICKED_CUT.replace("FROM ranked)", "FROM ranked WHERE rn <= 25)")


def with_(ctes: str, select: str) -> str:
    return f"WITH {ctes.strip()}\n{select.strip()}"


def _steps(expression: str, steps: list[tuple[str, str]]) -> str:
    for pattern, replacement in steps:
        back = re.sub(r"\$(\d)", r"\\\1", replacement)
        # Control characters go in as chr() calls, so that the SQL text stays on plain lines.
        target = " || ".join(
            "chr(10)" if piece == "\n" else quote(piece) for piece in re.split(r"(\n)", back) if piece
        )
        expression = f"regexp_replace({expression}, {quote(pattern)}, {target or quote('')}, 'g')"
    return expression


def _unescaped(expression: str) -> str:
    names = sorted(n for n in name2codepoint if n != "amp")
    for name in names:
        expression = f"replace({expression}, '&{name};', chr({name2codepoint[name]}))"
    return f"replace({expression}, '&amp;', '&')"


# HTML conversion as a chain of replacements, one tag kind after the other. The library gets to the
# same text differently (one pass over the tags).
_SQUEEZE = [
    (
        r"(?is)<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>"
        r"|<head\b[^>]*>.*?</head\s*>",
        "",
    ),
    (r"[ \t\n\x0B\f\r]+", " "),
]
_ATTR = r"""\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
_MARKDOWN = [
    *[(rf"(?i)<h{n}\b[^>]*>", "\n\n" + "#" * n + " ") for n in range(1, 7)],
    (r"(?i)</?(?:b|strong)\b[^>]*>", "**"),
    (r"(?i)</?(?:i|em)\b[^>]*>", "*"),
    (r"(?i)</?code\b[^>]*>", "`"),
    (r"(?i)<hr\b[^>]*>", "\n\n* * *\n\n"),
    (rf"(?i)<a\b[^>]*?\shref{_ATTR}[^>]*>(.*?)</a ?>", "[$4]($1$2$3)"),
]
_LAYOUT = [
    (r"(?i)</?br\b[^>]*>", "\n"),
    (r"(?i)<li\b[^>]*>", "\n* "),
    (r"(?i)</?t[dh]\b[^>]*>", " "),
    (rf"(?i)</?(?:{BLOCKS})\b[^>]*>", "\n\n"),
    (r"</?[A-Za-z!][^>]*(?:>|\z)", ""),
]
_TIDY = [(r"  +", " "), (r" *\n *", "\n"), (r"\n\n+", "\n\n"), (r"^[\n ]+|[\n ]+\z", "")]
_WRAP = [(r"([^\n]{1,80})(?: +|\n|\z)", "$1\n"), (r"\n+\z", "")]


def _to_text() -> str:
    flat = _steps("html", _SQUEEZE + _LAYOUT)
    return with_(
        f"flat AS (SELECT page_id, {_unescaped(flat)} AS t FROM pages)",
        f"SELECT page_id, {_steps('t', _TIDY + _WRAP)} AS content FROM flat",
    )


def _to_markdown() -> str:
    flat = _steps("html", _SQUEEZE + _MARKDOWN + _LAYOUT)
    return with_(
        f"flat AS (SELECT page_id, {_unescaped(flat)} AS t FROM pages)",
        f"SELECT page_id, {_steps('t', _TIDY)} AS content, false AS fell_back FROM flat",
    )


def _parsed(body: str, link: str = "link") -> str:
    return with_(
        LINES,
        f"""
SELECT doc_id, pos, title, {link} AS link, guid, {RFC.format('ts')} AS dated, source AS authors,
  lang || '|line' AS categories, {body} AS body,
  'https://cdn.example.com/' || doc_id || '/' || pos || '.mp3' AS enclosure,
  CAST(length(raw) AS BIGINT) AS length
FROM lines""",
    )


def _resolve(policy: str) -> str:
    hit = {
        "revalidate": "false",
        "no_cache": "false",
        "cache_first": "held",
        "max_age": "held AND stored_at > TIMESTAMP '2024-01-14'",
    }[policy]
    held = "false" if policy == "no_cache" else "s.feed_url IS NOT NULL"
    unchanged = "false" if policy == "no_cache" else "coalesce(code = 304, false)"
    return with_(
        RESPONSES
        + f""",
early AS (SELECT * FROM resp WHERE ts < TIMESTAMP '2024-01-15'),
written AS (
  SELECT feed_url, arg_max(body, ts) AS old_body, max(ts) AS written_at, min(ts) AS first_write FROM early WHERE code = 200 GROUP BY feed_url),
stored AS (
  SELECT feed_url, any_value(old_body) AS old_body, max(greatest(written_at, coalesce(e.ts, written_at))) AS stored_at
  FROM written w LEFT JOIN early e USING (feed_url)
  WHERE e.code IS NULL OR e.code = 200 OR e.code = 304 AND e.ts >= first_write GROUP BY feed_url),
answer AS (
  SELECT feed_url, arg_max(body, ts) AS new_body, arg_max(code, ts) AS code,
    arg_max(coalesce(retry_after, ''), ts) AS retry_after
  FROM resp WHERE ts >= TIMESTAMP '2024-01-15' GROUP BY feed_url),
j AS (
  SELECT r.feed_url, old_body, stored_at, new_body, code, nullif(retry_after, '') AS retry_after,
    {held} AS held, {unchanged} AS unchanged
  FROM (SELECT DISTINCT feed_url FROM resp) r LEFT JOIN stored s USING (feed_url) LEFT JOIN answer a USING (feed_url)),
k AS (SELECT *, ({hit}) OR (unchanged AND held) AS cached, coalesce(code = 200, false) AS fresh FROM j)""",
        """
SELECT feed_url, CASE WHEN cached THEN old_body WHEN fresh THEN new_body END AS body,
  CASE WHEN cached THEN 'not_modified' WHEN fresh THEN 'ok' ELSE 'error' END AS status,
  cached AS from_cache,
  CASE WHEN cached OR fresh THEN NULL WHEN code IS NULL OR unchanged THEN 'NETWORK_ERROR' ELSE 'FEED_FETCH_FAILED' END AS code,
  CASE WHEN cached OR fresh THEN NULL
    WHEN code IS NULL THEN 'network error: no response for ' || feed_url
    WHEN unchanged THEN 'network error: server returned 304 but no cache entry exists for ' || feed_url
    ELSE 'HTTP status ' || code || ': ' || feed_url END AS message,
  CASE WHEN cached OR fresh THEN NULL WHEN code IS NULL OR unchanged THEN '{}'
    ELSE '{"http_status":' || code || ',"retry_after":' || coalesce('"' || retry_after || '"', 'null') || '}' END AS details
FROM k""",
    )


# The report document of one feed, measured: lengths of its fixed text plus those of its values.
def _json_len(expression: str) -> str:
    return f"coalesce(length(CAST(to_json({expression}) AS VARCHAR)), 4)"


def _fields(indent: int, names: list[str]) -> int:
    """Characters of the keys of an object: line break, indent, quotes, colon, blank; commas."""
    return sum(1 + indent + len(n) + 2 + 2 for n in names) + len(names) - 1


def _item_chars(indent: int) -> str:
    """Length of one item's document, its closing brace at ``indent``."""
    item = ["id", "id_source", "feed_url", "title", "url", "authors", "published", "updated", "summary",
            "content", "content_format", "content_tokens_est", "content_truncated", "content_hash",
            "categories", "enclosures", "guid"]
    enclosure = ["url", "mime", "length"]
    # Braces: the opening one, and a line break plus indent plus the closing one.
    item_fixed = _fields(indent + 2, item) + 2 + 1 + indent
    enclosure_fixed = _fields(indent + 6, enclosure) + 2 + 1 + indent + 4
    # A list with one entry on a line of its own, and its brackets.
    one = 2 + (1 + indent + 4) + (1 + indent + 2)
    return f"""{item_fixed} + {_json_len('id')} + 6 + {_json_len('feed_url')} + {_json_len('title')} + {_json_len('url')}
    + {_json_len('source')} + {one}
    + {_json_len('published')} + {_json_len('updated')}
    + CASE WHEN lang = 'en' THEN {_json_len('line')} ELSE 4 END + {_json_len('content')} + 6
    + length(CAST(tokens AS VARCHAR)) + CASE WHEN cut THEN 4 ELSE 5 END + {_json_len('content_hash')}
    + {_json_len('lang')} + {_json_len(quote('line'))} + {one} + {2 + indent + 4}
    + {enclosure_fixed} + {one} + {_json_len("'https://cdn.example.com/' || doc_id || '/' || pos || '.mp3'")}
    + {_json_len(quote('audio/mpeg'))} + length(CAST(length(raw) AS VARCHAR))
    + {_json_len('guid')}"""


def _response_tokens(picked: str) -> str:
    fields = _fields
    feed = ["feed_url", "status", "from_cache", "title", "site_url", "updated", "item_count",
            "content_tokens_est_total", "items", "error"]
    top = ["schema_version", "fetched_at", "total_items", "total_content_tokens_est", "feeds",
           "errors", "warnings", "truncation"]
    feed_fixed = fields(6, feed) + 2 + 1 + 4
    top_fixed = fields(2, top) + 2 + 1

    def error_len(indent: int) -> str:
        fixed = fields(indent + 2, ["feed_url", "code", "message", "details"]) + 2 + 1 + indent + 2
        texts = f"{_json_len('feed_url')} + {_json_len('error_code')} + {_json_len(quote('feed parse error: malformed XML'))}"
        return f"({fixed} + {texts})"

    warning_fixed = fields(6, ["feed_url", "code", "message"]) + 2 + 1 + 4
    undated = "'all ' || item_count || ' returned item(s) lack a published/updated date; newest-first ordering falls back to the feed''s original order'"
    warning_len = f"({warning_fixed} + {_json_len('feed_url')} + {_json_len(quote('UNDATED_ITEMS'))} + {_json_len(undated)} + 2 + 5 + 3)"
    return with_(
        picked
        + f""",
texts AS (
  SELECT doc_id, {_item_chars(8)} AS chars
  FROM sized),
per_feed AS (SELECT doc_id, CAST(sum(chars) AS BIGINT) AS chars, count(*) AS n FROM texts GROUP BY doc_id),
docs AS (
  SELECT f.feed_url, f.item_count,
    {top_fixed} + 3 + 22 + length(CAST(item_count AS VARCHAR)) + length(CAST(f.tokens AS VARCHAR))
    + (2 + 5 + 3) + {feed_fixed}
    + {_json_len('f.feed_url')} + {_json_len('status')} + 5 + {_json_len('f.title')} + {_json_len('site_url')} + 4
    + length(CAST(item_count AS VARCHAR)) + length(CAST(f.tokens AS VARCHAR))
    + CASE WHEN coalesce(n, 0) = 0 THEN 2 ELSE p.chars + n * 9 + (n - 1) + 2 + 7 END
    + CASE WHEN error_code IS NULL THEN 4 ELSE {error_len(6)} END
    + CASE WHEN error_code IS NULL THEN 2 ELSE {error_len(4)} + 2 + 5 + 3 END
    + CASE WHEN item_count > 0 AND n_dated = 0 THEN {warning_len} ELSE 2 END
    + 4 AS chars
  FROM feeds f LEFT JOIN per_feed p ON p.doc_id = f.request_pos)""",
        "SELECT feed_url, item_count, CAST((chars + 3) // 4 AS BIGINT) AS estimated_tokens FROM docs",
    )


_SCHEME_HOST = "regexp_extract(url, '^([a-z]+://[^/?#]+)', 1)"
_ENCODE = (
    "array_to_string(list_transform(string_split({}, ''), lambda c: CASE WHEN regexp_matches(c, "
    "'[\\x00-\\x20\"#<>?`{{}}\\x7f-\\x{{10ffff}}]') THEN url_encode(c) ELSE c END), '')"
)

_LINK_ROWS = f"""
page_links AS (
  SELECT page_id, url AS site_url, {_SCHEME_HOST} AS origin FROM pages),
found AS (
  SELECT page_id, site_url, 0 AS pos, origin || '/feed/' || page_id || '.xml' AS url, 'rss' AS feed_type, 'News & more' AS title FROM page_links
  UNION ALL
  SELECT page_id, site_url, 1, parent || '%C3%A9/' || page_id || '.atom', 'atom', NULL FROM (
    SELECT *, origin || CASE WHEN grand = '' THEN '/' ELSE grand END AS parent FROM (
      SELECT *, regexp_extract(regexp_extract(site_url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '^(.*/)[^/]*/[^/]*$', 1) AS grand FROM page_links))
  UNION ALL
  SELECT page_id, site_url, 2, 'https://json.example.com/' || page_id, 'json', NULL FROM page_links
  UNION ALL
  SELECT page_id, site_url, 3, origin || '/plain/' || page_id || '.rss?x=1', 'unknown', NULL FROM page_links)
"""

_KEYS = (
    ITEMS
    + """,
keys AS (
  SELECT DISTINCT feed_url, CASE WHEN toxic = 1 THEN 'missing-' || doc_id WHEN quality = 1 THEN id
    ELSE coalesce(url, guid, id) END AS key
  FROM labels JOIN ids USING (doc_id)),
hits AS (
  SELECT k.feed_url, k.key, i.doc_id, i.id, row_number() OVER (PARTITION BY k.feed_url, k.key
    ORDER BY i.ts DESC NULLS LAST, i.doc_id) AS rn
  FROM keys k JOIN (
    SELECT feed_url, doc_id, id, ts, id AS key FROM ids
    UNION SELECT feed_url, doc_id, id, ts, guid FROM ids WHERE guid IS NOT NULL
    UNION SELECT feed_url, doc_id, id, ts, url FROM ids WHERE url IS NOT NULL) i
  ON i.feed_url = k.feed_url AND i.key = k.key)
"""
)

_UNDATED = (
    "'all ' || {} || ' returned item(s) lack a published/updated date; newest-first ordering falls "
    "back to the feed''s original order'"
)
_FELL_BACK = (
    "'HTML conversion failed for ' || {} || ' item(s); fell back to a plain tag strip (content may "
    "be lower fidelity)'"
)

_TEXT_FEED = """coalesce(title, feed_url) || '  [' || status || ']  ' || item_count || ' item(s)'"""

_SUMMARY = """CASE WHEN error_code IS NOT NULL THEN
    'fetch_feed: ' || feed_url || ' returned an error (' || error_code || '); see structuredContent.'
  ELSE 'Fetched ' || item_count || ' item(s) (~' || tokens || ' content tokens) from "' || title || '".'
    || CASE WHEN n_cut > 0 THEN ' Content truncated (see structuredContent.truncation).' ELSE '' END
    || ' Full data in structuredContent.' END"""

_SINCE_TEXT = """
d AS (
  SELECT event_id, event_type, ts,
    CASE event_type WHEN 'view' THEN event_id WHEN 'click' THEN event_id * 60 WHEN 'error' THEN event_id * 3600
      WHEN 'signup' THEN event_id * 86400 END AS seconds
  FROM events)
"""

ORACLE: dict[str, str] = {
    "item_identity": with_(ITEMS, "SELECT doc_id, id, id_source, sha256(feed_url) AS feed_key FROM ids"),
    "content_columns": with_(
        """
w AS (SELECT doc_id, CASE WHEN lang <> 'de' AND length(trim(text, chr(32) || chr(10) || chr(9) || chr(13))) > 0 THEN text ELSE source END AS whole FROM documents),
c AS (SELECT *, length(whole) > 200 AS cut, CASE WHEN length(whole) > 200 THEN substr(whole, 1, 200) || ' …[truncated]' ELSE whole END AS content FROM w)""",
        """SELECT doc_id, content, cut AS content_truncated, substr(sha256(whole), 1, 16) AS content_hash,
  CAST((length(content) + 3) // 4 AS BIGINT) AS content_tokens_est FROM c""",
    ),
    "feed_dates": with_(
        """
p AS (SELECT event_id, date_trunc('second', ts) AS u0, CASE event_type
    WHEN 'view' THEN date_trunc('second', ts)
    WHEN 'click' THEN date_trunc('second', ts) - INTERVAL 2 HOUR
    WHEN 'error' THEN date_trunc('minute', ts) + INTERVAL 5 HOUR
    WHEN 'signup' THEN ts END AS p FROM events)""",
        f"""SELECT event_id, {RFC.format('p')} AS published,
  {RFC.format("coalesce(p, u0 + INTERVAL 1 HOUR)")} AS effective FROM p""",
    ),
    "enclosures_links": """
WITH e AS (
  SELECT doc_id, CASE WHEN lang IN ('en','de') THEN '/page/' || doc_id WHEN lang = 'fr' THEN '/self/' || doc_id END AS link,
    CASE WHEN lang = 'es' THEN '' ELSE source || '|' || lang END AS authors,
    CASE WHEN lang = 'es' THEN '' ELSE lang || '|' || source END AS categories,
    CASE WHEN lang = 'en' THEN [{'url': '/m/' || doc_id, 'mime': 'video/mp4', 'length': NULL::BIGINT},
           {'url': '/a/' || doc_id, 'mime': 'audio/mpeg', 'length': n_chars}]
      WHEN lang IN ('de','es') THEN [{'url': '/m/' || doc_id, 'mime': 'video/mp4', 'length': NULL::BIGINT}]
      ELSE [NULL] END AS es,
    lang = 'fr' AS none
  FROM documents)
SELECT doc_id, link, authors, categories, CASE WHEN none THEN NULL ELSE CAST(i - 1 AS INT) END AS pos,
  x.url AS url, x.mime AS mime, x.length AS length
FROM (SELECT *, unnest(es) AS x, generate_subscripts(es, 1) AS i FROM e)""",
    "strip_tags": f"""SELECT page_id, trim(regexp_replace(replace(regexp_replace(html, '<[^>]*(?:>|\\z)', '', 'g'), '>', ''),
  '[{UNICODE_SPACE}]+', ' ', 'g')) AS content FROM pages""",
    "to_text": _to_text(),
    "to_markdown": _to_markdown(),
    "resolve_links": f"""
WITH a AS (
  SELECT page_id, url, unnest(hs) AS href, generate_subscripts(hs, 1) - 1 AS pos
  FROM (SELECT page_id, url, regexp_extract_all(html, '<a\\b[^>]*?\\bhref="([^"]*)"', 1) AS hs FROM pages))
SELECT page_id, CAST(pos AS INT) AS pos, href, {_SCHEME_HOST} || {_ENCODE.format('href')} AS resolved FROM a""",
    "authority": """
SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) || CASE WHEN url LIKE 'https:%' THEN ':443' ELSE ':80' END AS authority,
  regexp_replace(url, '^https?://', '') AS bare FROM pages""",
    "durations": with_(
        _SINCE_TEXT,
        f"""SELECT event_id, CAST(seconds AS BIGINT) AS seconds, CASE WHEN event_type = 'purchase' THEN {RFC.format("date_trunc('day', ts)")}
  ELSE {RFC_FAR.format("make_timestamp(TRY_CAST((1706659200 - CAST(seconds AS HUGEINT)) * 1000000 AS BIGINT))")} END AS since FROM d""",
    ),
    "lenient_int": """
SELECT event_id, CASE WHEN event_type IN ('view','click','error') THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS value,
  event_type = 'signup' AS is_error FROM events""",
    "content_format": "SELECT event_id, CASE event_type WHEN 'view' THEN 'markdown' WHEN 'click' THEN 'text' END AS content_format FROM events",
    "retry_after": """
SELECT event_id, CASE WHEN event_type = 'view' AND value >= 0 THEN floor(value)
  WHEN event_type = 'click' THEN 90.0 END AS seconds FROM events""",
    "parse_rss": _parsed("line"),
    "parse_atom": _parsed("line"),
    "parse_jsonfeed": _parsed("raw"),
    "parse_errors": """
SELECT 'https://' || source || '.example.com/' || doc_id || '/feed.xml' AS feed_url, 'FEED_PARSE_FAILED' AS code, '{}' AS details
FROM documents WHERE lang = 'de'""",
    "fetch_items": with_(
        PICKED,
        """SELECT feed_url, id, 'link' AS id_source, title, url, guid, published, updated, content,
  tokens AS content_tokens_est, cut AS content_truncated, content_hash FROM sized""",
    ),
    "fetch_since": with_(
        LINES,
        """SELECT feed_url, guid, CAST(NULL AS VARCHAR) AS content FROM lines
WHERE lang <> 'de' AND (ts IS NULL OR ts >= TIMESTAMP '2024-01-15')""",
    ),
    "fetch_feeds": with_(
        PICKED,
        """SELECT request_pos, feed_url, status, false AS from_cache, title, site_url, item_count,
  tokens AS content_tokens_est_total, error_code, n_cut FROM feeds""",
    ),
    "fetch_summary": with_(
        PICKED,
        """SELECT '1' AS schema_version, '2024-01-31T00:00:00Z' AS fetched_at, count(*) AS feeds, count(error_code) AS errors,
  CAST(sum(item_count) AS BIGINT) AS total_items, CAST(sum(tokens) AS BIGINT) AS total_content_tokens_est,
  CAST(sum(n_cut) AS BIGINT) AS n_cut FROM feeds""",
    ),
    "fetch_markdown": with_(
        LINES
        + """,
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ts DESC NULLS LAST, pos) AS rn FROM lines),
m AS (SELECT doc_id, feed_url, trim(regexp_replace(line, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), ' ') AS body FROM r WHERE rn <= 25)""",
        """SELECT feed_url, 'ok' AS status, count(*) AS item_count,
  CAST(sum((length(body) + 3) // 4) AS BIGINT) AS content_tokens_est_total FROM m GROUP BY feed_url""",
    ),
    "since": with_(EVENT_ITEMS, "SELECT event_id FROM ev WHERE ts IS NULL OR ts >= TIMESTAMP '2024-01-15'"),
    "newest_n": with_(
        EVENT_ITEMS,
        """SELECT feed_url, event_id, item_pos FROM (SELECT *, row_number() OVER (PARTITION BY feed_url
  ORDER BY ts DESC NULLS LAST, event_id) AS item_pos FROM ev) WHERE item_pos <= 5""",
    ),
    "item_positions": with_(
        EVENT_ITEMS,
        """SELECT feed_url, event_id, row_number() OVER (PARTITION BY feed_url
  ORDER BY ts DESC NULLS LAST, event_id) AS item_pos FROM ev""",
    ),
    "merge_sources": """
WITH s AS (
  SELECT 0 AS r, page_id, url FROM pages WHERE url LIKE 'https://%'
  UNION ALL SELECT 1, page_id, url FROM pages WHERE url NOT LIKE '%?%'
  UNION ALL SELECT 2, page_id, url FROM pages)
SELECT url, CAST(source_rank AS BIGINT) AS source_rank, pos FROM (
  SELECT url, r AS source_rank, page_id AS pos, row_number() OVER (PARTITION BY url ORDER BY r, page_id) AS rn FROM s) WHERE rn = 1""",
    "find_items": with_(
        _KEYS,
        """SELECT k.feed_url, k.key, h.doc_id, h.id, CASE WHEN h.id IS NULL THEN 'NOT_FOUND' END AS error_code,
  CASE WHEN h.id IS NULL THEN 'item ''' || k.key || ''' not found in ' || k.feed_url END AS message
FROM keys k LEFT JOIN (SELECT * FROM hits WHERE rn = 1) h ON h.feed_url = k.feed_url AND h.key = k.key""",
    ),
    "show_items": with_(
        LINES,
        """SELECT feed_url, guid AS key, title, guid, url FROM lines WHERE pos = 1
  AND doc_id IN (SELECT doc_id FROM labels)""",
    ),
    "cross_feed": """
WITH p AS (
  SELECT sha256(text) AS guid, 'https://' || source || '.example.com/feed.xml' AS feed_url,
    min(substr(sha256('https://' || source || '.example.com/feed.xml' || chr(10) ||
      CASE WHEN lang IN ('en','fr') THEN 'https://' || source || '.example.com/p/' || doc_id ELSE sha256(text) END), 1, 16)) AS id
  FROM documents GROUP BY ALL)
SELECT guid, n_feeds, feed_url, id FROM (SELECT *, count(*) OVER (PARTITION BY guid) AS n_feeds FROM p) WHERE n_feeds > 1""",
    "diff_snapshots": with_(
        ITEMS
        + """,
o AS (SELECT feed_url, id, content_hash AS old_hash FROM ids WHERE lang <> 'de'),
n AS (SELECT feed_url, id, substr(sha256(CASE WHEN lang = 'fr' THEN text || '!' ELSE text END), 1, 16) AS new_hash FROM ids WHERE lang <> 'es')""",
        """SELECT coalesce(o.feed_url, n.feed_url) AS feed_url, coalesce(o.id, n.id) AS id,
  CASE WHEN o.id IS NULL THEN 'added' WHEN n.id IS NULL THEN 'removed' WHEN old_hash = new_hash THEN 'unchanged' ELSE 'changed' END AS change,
  old_hash, new_hash FROM o FULL OUTER JOIN n ON o.feed_url = n.feed_url AND o.id = n.id""",
    ),
    "unseen": with_(
        ITEMS, "SELECT doc_id, feed_url, id FROM ids WHERE doc_id NOT IN (SELECT doc_id FROM labels)"
    ),
    "feed_totals": with_(
        ITEMS,
        """SELECT feed_url, count(*) AS item_count, CAST(sum(tokens) AS BIGINT) AS content_tokens_est_total FROM ids GROUP BY feed_url
UNION ALL SELECT DISTINCT feed_url || '#none', 0, 0 FROM ids""",
    ),
    "run_totals": with_(ITEMS, "SELECT count(*) AS total_items, CAST(sum(tokens) AS BIGINT) AS total_content_tokens_est FROM ids"),
    "run_status": """
SELECT count(*) AS feeds, count(*) FILTER (lang = 'de') AS failed,
  CAST(CASE WHEN count(*) FILTER (lang = 'de') = 0 THEN 0 WHEN count(*) FILTER (lang = 'de') = count(*) THEN 4 ELSE 3 END AS BIGINT) AS status
FROM documents""",
    "warnings": with_(
        ITEMS
        + """,
g AS (SELECT feed_url || '#' || lang AS feed_url, count(*) AS n, count(ts) AS dated,
    count(*) FILTER (lang = 'fr' AND length(text) > 2000) AS fb FROM items GROUP BY ALL)""",
        f"""SELECT feed_url, 'CONTENT_EXTRACTION_FALLBACK' AS code, {_FELL_BACK.format('fb')} AS message FROM g WHERE fb > 0
UNION ALL SELECT feed_url, 'UNDATED_ITEMS', {_UNDATED.format('n')} FROM g WHERE dated = 0""",
    ),
    "truncation": """
SELECT CAST(25 AS BIGINT) AS applied_limit, count(*) AS items_content_truncated, CAST(0 AS BIGINT) AS items_omitted,
  CAST(NULL AS BIGINT) AS estimated_tokens,
  'content was truncated; call get_item for the full body of a specific item' AS suggestion
FROM documents WHERE length(text) > 1000""",
    "response_tokens": _response_tokens(PICKED),
    "budget": with_(
        ITEMS
        + """,
z AS (SELECT feed_url, count(*) AS n, CAST(sum(tokens) AS BIGINT) AS est FROM ids GROUP BY feed_url),
y AS (SELECT *, greatest(1, CAST(floor(n * 9000.0::DOUBLE / est * 0.9) AS BIGINT)) AS lim, greatest(200, 25200 // n) AS chars FROM z)""",
        """SELECT feed_url, CASE WHEN est > 9000 THEN 'RESPONSE_TOO_LARGE' END AS code,
  CASE WHEN est > 9000 THEN 'response too large: ~' || est || ' tokens exceeds the 9000-token budget; retry with limit=' || lim
    || ' or max_content_chars=' || chars END AS message,
  CASE WHEN est > 9000 THEN '{"estimated_tokens":' || est || ',"budget_tokens":9000,"suggested_limit":' || lim
    || ',"suggested_max_content_chars":' || chars || '}' END AS details FROM y""",
    ),
    "report_summary": with_(PICKED, f"SELECT feed_url, {_SUMMARY} AS summary FROM feeds"),
    **{f"resolve_fetch_{p}": _resolve(p) for p in ("revalidate", "max_age", "cache_first", "no_cache")},
    "snapshots_upsert": with_(
        FOLDED, f"SELECT feed_url, etag, body, {MICROS.format('fetched_at')} AS fetched_at FROM folded"
    ),
    "snapshot_list": with_(
        FOLDED,
        f"SELECT feed_url, CAST(strlen(body) AS BIGINT) AS size_bytes, etag, {RFC.format('fetched_at')} AS fetched_at FROM folded",
    ),
    "snapshots_fresh": with_(
        FOLDED, "SELECT feed_url FROM folded WHERE fetched_at > TIMESTAMP '2024-01-30 17:00:00'"
    ),
    "throttle_streaks": with_(STREAKS, "SELECT authority, event_id, streak FROM streaks"),
    "host_cooldowns": with_(
        STREAKS,
        f"""SELECT authority, streak, {MICROS.format('next_allowed')} AS next_allowed,
  {MICROS.format('warm_until')} AS warm_until FROM state""",
    ),
    "polite_schedule": with_(
        STREAKS
        + """,
q AS (SELECT event_id, 'h' || user_id || '.example.com:443' AS authority,
    row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS turn FROM events),
t AS (
  SELECT q.*, greatest(0, coalesce(CAST(ceil((epoch_us(next_allowed) - epoch_us(TIMESTAMP '2024-01-30 23:00:00')) / 1000) AS BIGINT), 0)) AS base,
    greatest(0, coalesce(CAST(ceil((epoch_us(warm_until) - epoch_us(TIMESTAMP '2024-01-30 23:00:00')) / 1000) AS BIGINT), 0)) AS warm
  FROM q LEFT JOIN state USING (authority))""",
        """SELECT event_id AS request_pos, authority,
  CASE WHEN base <= 60000 THEN CAST(base + 1000 * least(turn - 1, ceil(greatest(warm - base, 0) / 1000)) AS BIGINT) END AS wait_ms,
  CASE WHEN base > 60000 THEN 'RATE_LIMITED' END AS code,
  CASE WHEN base > 60000 THEN '{"retry_after_seconds":' || base // 1000 || ',"retry_after_ms":' || base || '}' END AS details
FROM t""",
    ),
    "discover": with_(
        _LINK_ROWS, "SELECT page_id, site_url, CAST(pos AS BIGINT) AS pos, url, feed_type, title FROM found"
    ),
    "discovery_report": with_(
        _LINK_ROWS,
        "SELECT site_url, arg_min(url, pos) AS first_url, count(*) AS n_feeds FROM found GROUP BY page_id, site_url",
    ),
    "discovery_text": with_(
        _LINK_ROWS,
        """SELECT site_url, CAST(-1 AS BIGINT) AS pos, site_url || '  ' || count(*) || ' feed(s)' AS line FROM found GROUP BY page_id, site_url
UNION ALL SELECT site_url, pos, '  ' || url || '  [' || feed_type || ']  ' || coalesce(title, '-') FROM found""",
    ),
    "discovery_ndjson": with_(
        _LINK_ROWS, "SELECT site_url, CAST(pos AS BIGINT) AS pos, url, title FROM found"
    ),
    "ndjson_items": with_(
        PICKED,
        "SELECT feed_url, id, title, guid, source AS author, CAST(length(raw) AS BIGINT) AS length FROM sized",
    ),
    "tagged_records": with_(
        PICKED,
        """SELECT CAST(0 AS BIGINT) AS kind_rank, doc_id AS request_pos, pos, 'item' AS type, guid AS what FROM sized
UNION ALL SELECT 1, request_pos, 0, 'error', error_code FROM feeds WHERE error_code IS NOT NULL
UNION ALL SELECT 3, 0, 0, 'summary', '{"errors":' || count(error_code) || ',"feeds":' || count(*) ||
    ',"fetched_at":"' || '@STAMP@' || '","schema_version":"1","total_content_tokens_est":' || CAST(sum(tokens) AS BIGINT) ||
    ',"total_items":' || CAST(sum(item_count) AS BIGINT) || ',"truncation":' ||
    CASE WHEN sum(n_cut) > 0 THEN '{"applied_limit":null,"items_content_truncated":' || CAST(sum(n_cut) AS BIGINT) ||
      ',"items_omitted":0,"estimated_tokens":null,"suggestion":null}' ELSE 'null' END ||
    ',"type":"summary","warnings":[' || coalesce(string_agg(CASE WHEN item_count > 0 AND n_dated = 0 THEN
      '{"code":"UNDATED_ITEMS","feed_url":"' || feed_url || '","message":"all ' || item_count ||
      ' returned item(s) lack a published/updated date; newest-first ordering falls back to the feed''s original order"}' END, ',' ORDER BY request_pos), '') || ']}'
  FROM feeds""".replace("@STAMP@", STAMP),
    ),
    "tagged_warning_lines": with_(
        PICKED,
        """SELECT CAST(0 AS BIGINT) AS kind_rank, doc_id AS request_pos, pos, 'item' AS type, guid AS what FROM sized
UNION ALL SELECT 1, request_pos, 0, 'error', error_code FROM feeds WHERE error_code IS NOT NULL
UNION ALL SELECT 2, request_pos, 1, 'warning', 'UNDATED_ITEMS' FROM feeds WHERE item_count > 0 AND n_dated = 0
UNION ALL SELECT 3, 0, 0, 'summary', CAST(count(*) AS VARCHAR) FROM feeds WHERE item_count > 0 AND n_dated = 0""",
    ),
    "text_summary": with_(
        PICKED,
        f"""SELECT CAST(0 AS BIGINT) AS part, request_pos, CAST(0 AS BIGINT) AS row, CAST(0 AS BIGINT) AS pos, {_TEXT_FEED} AS line FROM feeds
UNION ALL SELECT 0, doc_id, 1, pos, '  - ' || coalesce(published, '-') || '  ' || title || '  ' || url FROM sized
UNION ALL SELECT 0, request_pos, 2, 0, '  ! FEED_PARSE_FAILED: feed parse error: malformed XML' FROM feeds WHERE error_code IS NOT NULL
UNION ALL SELECT 1, 0, 0, 0, n || ' error(s):' FROM (SELECT count(error_code) AS n FROM feeds) WHERE n > 0
UNION ALL SELECT 1, request_pos, 1, 0, '  ! [FEED_PARSE_FAILED] ' || feed_url || ': feed parse error: malformed XML' FROM feeds WHERE error_code IS NOT NULL""",
    ),
    "report_lines": with_(
        REPORTED
        + """,
firsts AS (SELECT doc_id AS request_pos, guid AS first_guid FROM sized WHERE rn = 1),
n AS (SELECT unnest([0, 2, 4, 6]) AS section)""",
        """SELECT CAST(1 AS BIGINT) AS section, request_pos, CAST(0 AS BIGINT) AS seq, feed_url, item_count AS n_items, first_guid,
  request_pos = max(request_pos) OVER () AS is_last FROM feeds LEFT JOIN firsts USING (request_pos)
UNION ALL SELECT section, 0, 0, NULL, NULL, NULL, NULL FROM n
UNION ALL SELECT 3, request_pos, 0, NULL, NULL, NULL, NULL FROM feeds WHERE error_code IS NOT NULL
UNION ALL SELECT 5, request_pos, 1, NULL, NULL, NULL, NULL FROM feeds WHERE item_count > 0 AND n_dated = 0""",
    ),
    "contract_check": with_(
        PICKED,
        """SELECT 'id' AS field, 'null' AS rule, count(*) AS rows, true AS planted FROM sized WHERE pos = 1
UNION ALL SELECT 'id_source', 'value', count(*), true FROM sized WHERE lang = 'es'
UNION ALL SELECT 'guid', 'missing', NULL, true UNION ALL SELECT 'content_tokens_est', 'type', NULL, true""",
    ),
    "stream_items": with_(PICKED, "SELECT feed_url, id, guid, content_hash FROM sized"),
    "stream_unseen": "SELECT DISTINCT 'u' || user_id AS feed_url, event_type AS id FROM events",
    "stream_changes": """
WITH v AS (
  SELECT 'u' || user_id AS feed_url, event_type AS id, ts, CASE WHEN value > 5 THEN 'long' ELSE 'short' END AS h FROM events),
p AS (SELECT *, lag(h) OVER (PARTITION BY feed_url, id ORDER BY ts) AS b FROM v)
SELECT feed_url, id, CASE WHEN b IS NULL THEN 'added' ELSE 'changed' END AS change, h AS content_hash,
  strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS fetched_at FROM p WHERE b IS NULL OR b <> h""",
}
ORACLE["bounded_report"] = with_(
    _response_tokens(REPORTED_CUT).removeprefix("WITH ").rsplit("SELECT feed_url, item_count, CAST((chars", 1)[0]
    + ", firsts AS (SELECT feed_url, id AS first_id FROM sized WHERE rn = 1)",
    f"""SELECT f.request_pos, f.feed_url, (d.chars + 3) // 4 > 10000 AS over,
  CASE WHEN (d.chars + 3) // 4 <= 10000 THEN f.item_count END AS total_items,
  CASE WHEN (d.chars + 3) // 4 <= 10000 THEN first_id END AS first_id,
  CASE WHEN (d.chars + 3) // 4 <= 10000 AND n_cut > 0 THEN n_cut END AS n_cut,
  CASE WHEN (d.chars + 3) // 4 <= 10000 THEN {_SUMMARY.replace('feed_url', 'f.feed_url').replace('item_count', 'f.item_count')} END AS summary
FROM feeds f JOIN docs d ON d.feed_url = f.feed_url LEFT JOIN firsts ON firsts.feed_url = f.feed_url""",
)
ORACLE["stream_snapshots"] = ORACLE["snapshots_upsert"]
ORACLE["stream_host_state"] = ORACLE["host_cooldowns"]

ORACLE["stream_changes_ties"] = """
WITH v AS (
  SELECT 'u' || user_id AS feed_url, event_type AS id, event_id, date_trunc('day', ts) AS ts,
    CASE WHEN value > 5 THEN 'long' ELSE 'short' END AS h FROM events),
p AS (SELECT *, lag(h) OVER (PARTITION BY feed_url, id ORDER BY ts, event_id) AS b FROM v)
SELECT feed_url, id, CASE WHEN b IS NULL THEN 'added' ELSE 'changed' END AS change, h AS content_hash,
  strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM p WHERE b IS NULL OR b <> h GROUP BY ALL"""
_HOURLY = STREAKS.replace(
    "'.example.com:443' AS authority, ts,", "'.example.com:443' AS authority, date_trunc('hour', ts) AS ts,"
).replace("arg_max(streak, ts)", "arg_max(streak, (ts, event_id))")
ORACLE["stream_host_state_ties"] = with_(
    _HOURLY,
    f"""SELECT authority, streak, {MICROS.format('next_allowed')} AS next_allowed,
  {MICROS.format('warm_until')} AS warm_until FROM state""",
)
ORACLE["fetch_captures"] = with_(
    PICKED,
    """SELECT request_pos + n AS request_pos, feed_url, item_count, error_code
FROM feeds, (SELECT unnest([0, 1000000000]) AS n)""",
)
ORACLE["throttle_streaks_one_host"] = """
WITH l AS (SELECT event_id, date_trunc('month', ts) AS m, event_type = 'error' AS throttled FROM events),
i AS (SELECT *, sum(CASE WHEN throttled THEN 0 ELSE 1 END) OVER (ORDER BY m, event_id ROWS UNBOUNDED PRECEDING) AS island FROM l)
SELECT 'one:443' AS authority, event_id, CASE WHEN throttled THEN CAST(sum(CASE WHEN throttled THEN 1 ELSE 0 END) OVER (
  PARTITION BY island ORDER BY m, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) ELSE 0 END AS streak FROM i"""
ORACLE["item_positions_one_feed"] = with_(
    EVENT_ITEMS,
    "SELECT event_id, row_number() OVER (ORDER BY date_trunc('day', ts) DESC NULLS LAST, event_id) AS item_pos FROM ev",
)
ORACLE["nested_markdown"] = """
WITH l AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
t AS (SELECT doc_id, source, i, trim(regexp_replace(raw, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), ' ') AS line FROM l),
p AS (
  SELECT doc_id, source, i, '> ' || i || '.' || CASE WHEN line = '' THEN '' ELSE ' ' || line END || chr(10) ||
    '> ' || repeat(' ', length(i || '. ')) || '* n' || i AS part FROM t)
SELECT doc_id, '> ' || chr(57344) || any_value(source) || chr(10) || '>' || chr(10) || string_agg(part, chr(10) ORDER BY i) AS content FROM p GROUP BY doc_id"""
ORACLE["fetch_warnings"] = with_(
    LINES
    + """,
g AS (SELECT doc_id AS request_pos, feed_url, any_value(lang) AS lang, count(*) AS n, count(ts) AS dated,
    count(*) FILTER (lang = 'fr' AND regexp_matches(line, '[\\p{L}\\p{N}]')) AS fb FROM lines GROUP BY ALL)""",
    f"""SELECT request_pos, feed_url, 'CONTENT_EXTRACTION_FALLBACK' AS code, {_FELL_BACK.format('fb')} AS message FROM g WHERE fb > 0
UNION ALL SELECT request_pos, feed_url, 'UNDATED_ITEMS', {_UNDATED.format('n')} FROM g WHERE dated = 0""",
)
ORACLE["fetch_truncated"] = ORACLE["fetch_items"].replace(PICKED.strip(), PICKED_CUT.strip())
ORACLE["read_documents"] = with_(
    PICKED, "SELECT request_pos, feed_url, '2024-01-15T00:00:00Z' AS fetched_at, item_count AS n FROM feeds WHERE item_count > 0"
)
ORACLE["read_body_files"] = """
SELECT dense_rank() OVER (ORDER BY source) - 1 AS request_pos, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS pos,
  'g' || doc_id AS guid FROM documents"""
ORACLE["read_url_lists"] = """
WITH l AS (
  SELECT page_id % 7 AS list, url, sum(CASE WHEN url LIKE '%?%' THEN 1 ELSE 2 END) OVER (PARTITION BY page_id % 7 ORDER BY page_id) AS upto FROM pages)
SELECT list, CAST(upto - 2 AS BIGINT) AS pos, url FROM l WHERE url NOT LIKE '%?%'"""
ORACLE["read_pages"] = with_(_LINK_ROWS, "SELECT site_url, CAST(pos AS BIGINT) AS pos, url, feed_type FROM found")
ORACLE["get_item"] = with_(
    PICKED
    + f""",
z AS (SELECT feed_url, guid, id, title, pos, doc_id, ({_item_chars(0)} + 3) // 4 AS t FROM sized)""",
    """SELECT feed_url, guid AS key, id, CASE WHEN t > 500 THEN 'RESPONSE_TOO_LARGE' END AS code,
  CASE WHEN t > 500 THEN 'response too large: ~' || t || ' tokens exceeds the 500-token budget; retry with limit=1 or max_content_chars=1400' END AS message,
  CASE WHEN t > 500 THEN '{"estimated_tokens":' || t || ',"budget_tokens":500,"suggested_limit":1,"suggested_max_content_chars":1400}' END AS details,
  CASE WHEN t <= 500 THEN 'Item ' || id || ': "' || title || '".' END AS summary
FROM z WHERE pos = 1 AND doc_id IN (SELECT doc_id FROM labels)""",
)
ORACLE["empty_guids"] = with_(
    LINES
    + """,
k AS (SELECT *, CASE WHEN lang NOT IN ('fr', 'de') THEN url END AS own, CASE WHEN lang <> 'fr' THEN guid END AS g,
    coalesce(strftime(ts, '%Y-%m-%dT%H:%M:%SZ'), '') AS published FROM lines)""",
    """SELECT feed_url, pos, g AS guid, own AS url, CASE lang WHEN 'fr' THEN 'hash' WHEN 'de' THEN 'guid' ELSE 'link' END AS id_source,
  substr(sha256(feed_url || chr(10) || coalesce(own, g, title || '|' || published)), 1, 16) AS id FROM k""",
)
ORACLE["parse_namespaces"] = with_(
    LINES,
    """SELECT doc_id, pos, '<x1:b>' || regexp_replace(replace(replace(replace(raw, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '[\\x00-\\x20]+$', '') AS body
FROM lines""",
)
