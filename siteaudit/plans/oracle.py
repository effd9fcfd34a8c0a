"""The registered queries in DuckDB's SQL.

Where a query reads elements that inputs.py adds to the pages, the SQL says what must be found in them, without
parsing anything.
"""

from __future__ import annotations

#: Start tags of the pages, by splitting texts: doc_url, page_id, ord, tag, name.
_TAGS = r"""
clean AS (SELECT page_id, url, array_to_string(list_transform(string_split(html, '<!--'), lambda x, i: CASE WHEN i = 1 THEN x WHEN contains(x, '-->') THEN substr(x, strpos(x, '-->') + 3) ELSE '' END), '') AS h FROM pages),
found AS (SELECT page_id, url AS doc_url, list_filter(string_split(h, '<'), lambda x: regexp_matches(x, '^[A-Za-z]')) AS t FROM clean),
tags AS (SELECT page_id, doc_url, (i - 1)::INT AS ord, string_split(t[i], '>')[1] AS tag, lower(string_split(string_split(t[i], '>')[1], ' ')[1]) AS name FROM found, unnest(range(1, len(t) + 1)) r(i))"""

_ORIGIN = "regexp_extract(doc_url, '^(https?://[^/?#]+)', 1)"
#: A path or fragment with what isn't allowed in it in percent signs.
_ENCODED = "array_to_string(list_transform(string_split({0}, ''), lambda c: CASE WHEN c = ' ' OR NOT regexp_matches(c, '^[ -~]$') OR c IN ('\"', '<', '>', '`', '{{', '}}', '^') THEN url_encode(c) ELSE c END), '')"
#: The pages' own links, all root-relative: doc_url, ord, raw, target.
_LINKS = f"""{_TAGS},
own AS (SELECT page_id, doc_url, ord, regexp_extract(tag, 'href="([^"]*)"', 1) AS raw FROM tags WHERE name = 'a'),
links AS (SELECT *, {_ORIGIN} || {_ENCODED.format("raw")} AS target FROM own)"""
#: The same with the bases that inputs.based_pages adds.
_BASED = f"""{_TAGS},
own AS (SELECT page_id, doc_url, (ord + CASE WHEN page_id % 8 = 0 THEN 1 ELSE 0 END)::INT AS ord, regexp_extract(tag, 'href="([^"]*)"', 1) AS raw FROM tags WHERE name = 'a' AND page_id % 8 <> 4),
links AS (SELECT *, CASE WHEN page_id % 8 = 0 THEN 'https://base.example.org' ELSE {_ORIGIN} END || {_ENCODED.format("raw")} AS target FROM own
  UNION ALL SELECT page_id, url, 0, 'https://', NULL FROM pages WHERE page_id % 8 = 4)"""
_HOST = "lower(regexp_extract({0}, '^https?://([^/?#]+)', 1))"
_PATH = "regexp_extract({0}, '^https?://[^/?#]+([^?#]*)', 1)"
_STATUS = "CASE page_id % 20 WHEN 0 THEN 404 WHEN 1 THEN 301 WHEN 2 THEN 503 ELSE 200 END"
_TARGET_STATUS = "CASE length(target) % 7 WHEN 0 THEN 404 ELSE 200 END"
_SITES = f"""
hosts AS (SELECT DISTINCT {_HOST.format("url")} AS host FROM pages),
sites AS (
  SELECT host || '/' AS site, host, '/' AS path, length(host) % 2 = 0 AS recursive FROM hosts
  UNION ALL SELECT host || CASE WHEN host LIKE 'm.%' THEN '/en' ELSE '/de' END, host, CASE WHEN host LIKE 'm.%' THEN '/en' ELSE '/de' END, length(host) % 3 = 0 FROM hosts WHERE host LIKE 'm.%' OR host LIKE 'blog.%')"""
_EDGES = """
edges AS (SELECT a.url AS src, b.url AS dst FROM pages a, (SELECT count(*) AS n FROM pages) c, pages b WHERE b.page_id IN ((a.page_id * 7 + 3) % n, (a.page_id * 2 + 1) % n) AND a.url <> b.url)"""
_RESULTS = f"{_LINKS}, results AS (SELECT doc_url, ord, raw, target, {_TARGET_STATUS} AS status FROM links)"
_METRICS = f"{_RESULTS}, metrics AS (SELECT url AS doc_url, count(*) FILTER (status = 200) AS success, count(*) FILTER (status <> 200) AS error FROM pages LEFT JOIN results ON url = doc_url GROUP BY url)"
_NOFRAG = "regexp_replace({0}, '#.*$', '')"
_VERSIONS = f"""
versions AS (
  SELECT page_id, url, {_STATUS} AS status, TIMESTAMP '2024-01-01' + to_hours(page_id::INT) AS fetched_at FROM pages
  UNION ALL SELECT page_id, url, CASE WHEN page_id % 3 = 0 THEN 500 ELSE {_STATUS} END, TIMESTAMP '2024-01-01' + to_hours(page_id::INT + 5) FROM pages),
latest AS (SELECT page_id, url, arg_max(status, fetched_at) AS status, max(fetched_at) AS fetched_at FROM versions GROUP BY ALL)""".replace("GROUP BY ALL", "GROUP BY page_id, url")
_LOG = "log AS (SELECT user_id::VARCHAR AS site, '/' || event_type AS url, ts, event_id FROM events)"
_REDIRECT_TO = "SELECT p.page_id, p.url, n.url AS next FROM pages p LEFT JOIN pages n ON n.page_id = p.page_id + 1"
_WEEKS = "CASE u WHEN 0 THEN 1 WHEN 1 THEN 1000 WHEN 2 THEN 60000 WHEN 3 THEN 3600000 WHEN 4 THEN 86400000 WHEN 5 THEN 604800000 END"

#: The links (l) of inputs.documents (d), and the faults of its documents (f).
_DOCS = f"""{_LINKS}, d AS (SELECT page_id, page_id // 7 % 6 AS k, root, root || '/d/' || page_id AS doc_url FROM (SELECT page_id, {_ORIGIN.replace("doc_url", "url")} AS root FROM pages)),
l AS (
  SELECT d.doc_url, 'a' AS element, 'href' AS attribute, raw, NULL AS hint, target FROM links JOIN d USING (page_id) WHERE k = 0
  UNION ALL SELECT doc_url, 'a', 'href', unnest(['/d/' || (page_id + 1), '#t', '#none']), NULL, unnest([root || '/d/' || (page_id + 1), doc_url || '#t', doc_url || '#none']) FROM d WHERE k = 0
  UNION ALL SELECT doc_url, '@import', '', x, 'css', root || '/d/' || x FROM (SELECT *, unnest(['a' || page_id || '.css', 'b.css']) AS x FROM d WHERE k = 1)
  UNION ALL SELECT doc_url, 'url', '', x, NULL, root || '/d/' || x FROM (SELECT *, unnest(['c' || (page_id % 9) || '.png', 'd.png', 'e.png', 'f)' || page_id || '&.png']) AS x FROM d WHERE k = 1)
  UNION ALL SELECT doc_url, unnest(['use', 'a']), unnest(['xlink:href', 'href']), unnest(['#a' || page_id, '/svg/' || page_id]), NULL, unnest([doc_url || '#a' || page_id, root || '/svg/' || page_id]) FROM d WHERE k = 2
  UNION ALL SELECT doc_url, 'loc', '', x, NULL, x FROM (SELECT *, unnest(['https://example.com/' || page_id || '?a=1&b=2', 'https://example.com/c' || page_id]) AS x FROM d WHERE k = 3 AND page_id % 2 = 0)
  UNION ALL SELECT doc_url, 'loc', '', x, 'sitemap', x FROM (SELECT *, 'https://example.com/m' || page_id || '.xml' AS x FROM d WHERE k = 3 AND page_id % 2 = 1)
  UNION ALL SELECT doc_url, 'sitemap', '', root || '/map.xml', 'sitemap', root || '/map.xml' FROM d WHERE k = 4),
f AS (
  SELECT doc_url, 'unreadable' AS kind, 'document cannot be read' AS message FROM d WHERE k = 5
  UNION ALL SELECT doc_url, 'css_syntax', 'invalid CSS: ' || CASE page_id % 5 WHEN 0 THEN 'unexpected }}' WHEN 1 THEN 'Unknown at rule: @un' || (page_id % 3) ELSE '@import rules must precede all rules aside from @charset and @layer statements' END FROM d WHERE k = 1 AND page_id % 5 < 3
  UNION ALL SELECT doc_url, 'invalid_namespace', 'namespace expected http://www.w3.org/2000/svg but got http://example.com/ns' FROM d WHERE k = 2 AND page_id % 3 = 0
  UNION ALL SELECT doc_url, 'invalid_root_element', 'root element expected svg but got g' FROM d WHERE k = 2 AND page_id % 4 = 0)"""

ORACLE_SQL: dict[str, str] = {
    "audit": f"""WITH {_BASED}, m AS (SELECT doc_url, count(*) FILTER (ok) AS success, count(*) FILTER (NOT ok) AS error FROM (SELECT doc_url, coalesce({_TARGET_STATUS} = 200 AND target IS NOT NULL, false) AS ok FROM links) GROUP BY doc_url)
      SELECT url AS doc_url, coalesce(success, 0) AS success, coalesce(error, 0) AS error FROM pages LEFT JOIN m ON url = doc_url""",
    "start_tags": f"""WITH {_TAGS} SELECT doc_url, ord, name, ((length(tag) - length(replace(tag, '="', ''))) // 2)::INT AS n_attributes, '' AS bare FROM tags
      UNION ALL SELECT doc_url, len(t)::INT + k, n, a, b FROM found, (VALUES (0, 'script', 0, ''), (1, 'input', 4, 'disabled,checked'), (2, 'i', 2, ''), (3, 'textarea', 0, ''), (4, 'title', 0, ''), (5, 'b', 1, 'hidden'), (6, 'p', 0, '')) v(k, n, a, b)
      UNION ALL SELECT doc_url, len(t)::INT + 7, 'noscript', 0, '' FROM found WHERE page_id % 3 = 1""",
    "href_links": f"""WITH {_LINKS} SELECT doc_url, 'a' AS element, 'href' AS attribute, raw FROM own
      UNION ALL SELECT url, 'a', 'xlink:href', '#x' || page_id FROM pages UNION ALL SELECT url, 'a', 'href', '#x' || (page_id % 4) FROM pages
      UNION ALL SELECT url, 'a', 'href', 'data:image/svg+xml,%3Csvg%20id=%22d' || (page_id % 7) || '%22/%3E' FROM pages""",
    "src_links": "SELECT url AS doc_url, 'script' AS element, '/x' || (page_id % 5) || '.js' AS raw FROM pages UNION ALL SELECT url, 'img', '/i/' || page_id || '.png' FROM pages",
    "srcset_links": "SELECT url AS doc_url, 'img' AS element, i::INT AS item, CASE i WHEN 2 THEN 'data:image/png;base64,AA,BB' ELSE '/i/' || page_id || '-' || (i + 1) || '.png' END AS raw FROM pages, range(3) r(i)",
    "link_element_links": "SELECT url AS doc_url, '/s/' || page_id || '.css' AS raw, 'css' AS hint FROM pages UNION ALL SELECT url, '/map.xml', 'sitemap' FROM pages",
    "meta_links": "SELECT url AS doc_url, '/og/' || page_id || '.png' AS raw FROM pages",
    "html_links": f"""WITH {_LINKS}, n AS (SELECT doc_url, count(*) AS n FROM own GROUP BY 1)
      SELECT url AS doc_url, attribute, (k + CASE attribute WHEN 'href' THEN coalesce(n, 0) ELSE 0 END)::BIGINT AS n FROM pages LEFT JOIN n ON url = doc_url, (VALUES ('href', 4), ('xlink:href', 1), ('src', 2), ('srcset', 3), ('content', 1)) v(attribute, k)""",
    "svg_links": "SELECT url AS doc_url, 1 AS ord, 'use' AS element, 'xlink:href' AS attribute, '#a' || page_id AS raw FROM pages UNION ALL SELECT url, 2, 'a', 'href', '/svg/' || page_id FROM pages",
    "css_links": """SELECT url AS doc_url, '@import' AS element, 'a' || page_id || '.css' AS raw, 'css' AS hint FROM pages UNION ALL SELECT url, '@import', 'b.css', 'css' FROM pages
      UNION ALL SELECT url, 'url', 'c' || (page_id % 9) || '.png', NULL FROM pages UNION ALL SELECT url, 'url', unnest(['d.png', 'e.png', 'f)' || page_id || '&.png']), NULL FROM pages""",
    "sitemap_links": """SELECT url AS doc_url, 'https://example.com/' || page_id || '?a=1&b=2' AS raw, NULL::VARCHAR AS hint FROM pages WHERE page_id % 2 = 0
      UNION ALL SELECT url, 'https://example.com/c' || page_id, NULL FROM pages WHERE page_id % 2 = 0 UNION ALL SELECT url, 'https://example.com/m' || page_id || '.xml', 'sitemap' FROM pages WHERE page_id % 2 = 1""",
    "robots_sitemap_links": "WITH r AS (SELECT DISTINCT regexp_extract(url, '^(https?://[^/?#]+)', 1) AS root FROM pages) SELECT root || '/robots.txt' AS doc_url, root || unnest(['/map.xml', '/news.xml']) AS raw, 'sitemap' AS hint FROM r",
    "data_svg_documents": """SELECT DISTINCT 'data:image/svg+xml,%3Csvg%20id=%22d' || (page_id % 7) || '%22/%3E' AS url, 200 AS status, '<svg id="d' || (page_id % 7) || '"/>' AS body, NULL::VARCHAR AS error FROM pages""",
    "base_url": f"""SELECT url AS doc_url, CASE page_id % 4 WHEN 0 THEN {_ORIGIN.replace("doc_url", "url")} || '/b/' WHEN 2 THEN NULL ELSE url END AS base, CASE WHEN page_id % 4 = 2 THEN 'url_parse' END AS error FROM pages""",
    "anchors": "SELECT url AS doc_url, 'x' || page_id AS anchor FROM pages UNION ALL SELECT url, 'n' || (page_id % 3) FROM pages",
    "output_element": "SELECT url AS doc_url, 'src,srcset' AS names FROM pages",
    "elements": f"WITH {_TAGS} SELECT doc_url, name, count(*) AS n FROM tags GROUP BY doc_url, name",
    "resolve_url": f"WITH {_BASED} SELECT doc_url, ord, raw, target FROM links",
    "url_parts": f"""SELECT page_id, regexp_extract(url, '^(https?):', 1) AS scheme, {_HOST.format("url")} AS host, -1 AS port, {_PATH.format("url")} AS path,
      CASE WHEN contains(url, '?') THEN regexp_extract(url, '\\?([^#]*)', 1) END AS query, CASE WHEN contains(url, '#') THEN regexp_extract(url, '#(.*)$', 1) END AS fragment,
      regexp_extract(url, '^(https?://)', 1) || {_HOST.format("url")} || CASE WHEN starts_with(url, 'https:') THEN ':443' ELSE ':80' END AS origin FROM pages""",
    "url_scalars": f"""WITH u AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'DATA:text/plain,' || url || url WHEN 1 THEN 'mailto:x@y' ELSE url END AS u FROM pages),
      f AS (SELECT *, CASE WHEN contains(u, '#') THEN regexp_extract(u, '#(.*)$', 1) END AS fragment FROM u)
      SELECT page_id, {_NOFRAG.format("u")} AS nofrag, fragment, CASE page_id % 5 WHEN 0 THEN 'data' WHEN 1 THEN 'other' ELSE 'document' END AS class,
        CASE WHEN starts_with(u, 'DATA:') AND length(u) > 64 THEN left(u, 64) || '...' ELSE u END AS short, ends_with(u, 'feed') OR contains(u, '#top') AS ignored, coalesce(fragment IN ('top', 'x'), false) AS full FROM f""",
    "timing_scalars": f"""WITH e AS (SELECT *, event_id % 7 AS u, (event_id % 6)::INT AS n, datediff('millisecond', ts, TIMESTAMP '2024-01-16') AS ago FROM events)
      SELECT event_id, coalesce((event_id % 90) * {_WEEKS}, -1)::BIGINT AS ms, (event_id * 777777 // 1000000)::BIGINT AS latency, CASE WHEN n <= 1 THEN 100 ELSE least(100 * pow(2, n - 1), 1000) END::DOUBLE AS delay, n AS retries,
        CASE WHEN ago <= 86400000 THEN 'fresh' WHEN ago <= 4 * 86400000 THEN 'stale' ELSE 'expired' END AS age FROM e""",
    "type_scalars": """WITH p AS (SELECT page_id, CASE WHEN page_id % 11 <> 0 THEN ['text/html', 'Text/CSS', 'application/xml', 'image/svg+xml', 'text/plain', 'image/png'][page_id % 6 + 1] END AS media, ['css', 'html', 'sitemap', 'svg', 'robots', NULL][(page_id // 6) % 6 + 1] AS hint FROM pages),
      t AS (SELECT *, CASE lower(media) WHEN 'text/css' THEN 'css' WHEN 'text/html' THEN 'html' WHEN 'application/xml' THEN 'sitemap' WHEN 'image/svg+xml' THEN 'svg' WHEN 'text/plain' THEN 'robots' END AS is_a FROM p)
      SELECT page_id, media, CASE WHEN media IS NULL THEN hint WHEN hint IS NULL THEN CASE WHEN is_a IN ('css', 'html', 'svg') THEN is_a END WHEN hint = is_a THEN hint END AS doc_type,
        CASE WHEN media IS NOT NULL AND hint IS NOT NULL AND hint IS DISTINCT FROM is_a THEN 'content_type_invalid' END AS error, page_id % 3 <> 0 AS utf8, page_id % 3 <> 2 AS accepted, page_id % 2 = 0 AS scheme_ok FROM t""",
    "name_scalars": """WITH k AS (SELECT page_id, page_id % 5 AS ns, ['p', 'xlink', ''][(page_id // 5) % 3 + 1] AS prefix, page_id % 3 AS p, (page_id // 3) % 3 AS v, ['exact', 'ci', 'token'][(page_id // 7) % 3 + 1] AS match FROM pages)
      SELECT page_id, CASE ns WHEN 0 THEN 'xlink:n' WHEN 2 THEN CASE prefix WHEN 'p' THEN 'p:n' WHEN 'xlink' THEN 'http://example.com/n:n' ELSE 'n' END WHEN 3 THEN NULL ELSE 'n' END AS qualified,
        CASE p WHEN 0 THEN v = 0 WHEN 1 THEN v = 1 ELSE v <> 2 END AS matches,
        CASE p WHEN 0 THEN true WHEN 1 THEN CASE v WHEN 0 THEN false WHEN 1 THEN match = 'ci' ELSE match = 'token' END ELSE CASE v WHEN 1 THEN match = 'ci' ELSE true END END AS value_ok FROM k""",
    "error_messages": f"""WITH s AS (SELECT page_id, CASE {_STATUS} WHEN 200 THEN '200 OK' WHEN 301 THEN '301 Moved Permanently' WHEN 404 THEN '404 Not Found' ELSE '503 Service Unavailable' END AS shown FROM pages)
      SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'invalid status ' || shown WHEN 1 THEN 'invalid scheme "http"' WHEN 2 THEN 'element for #x' || page_id || ' not found' WHEN 3 THEN 'content type expected css but got Text/Html' ELSE 'too many redirects' END AS message, shown, NULL::VARCHAR AS nothing FROM s""",
    "match_site": f"""WITH {_SITES} SELECT page_id, arg_max(site, length(path)) AS site, arg_max(recursive, length(path)) AS recursive
      FROM (SELECT page_id, coalesce(site, 'default') AS site, coalesce(path, '') AS path, coalesce(recursive, false) AS recursive FROM pages LEFT JOIN sites ON {_HOST.format("url")} = host AND starts_with({_PATH.format("url")}, path)) GROUP BY page_id""",
    "recursive_urls": f"WITH {_SITES} SELECT page_id, url FROM pages WHERE EXISTS (FROM sites WHERE {_HOST.format('url')} = host AND starts_with({_PATH.format('url')}, path) AND recursive)",
    "roots_by_host": f"WITH {_SITES} SELECT host, string_agg(path, ',' ORDER BY path) AS roots FROM sites GROUP BY host",
    "ignored_site_filter": "SELECT page_id, url FROM pages WHERE NOT contains(url, 'casino-win.example.com/') AND NOT contains(url, 'free-bets')",
    "broken_links": f"""WITH {_BASED} SELECT doc_url, ord, target, CASE WHEN target IS NULL THEN 'url_parse' ELSE 'http_status' END AS error_kind, CASE WHEN target IS NULL THEN 'URL cannot be parsed' ELSE 'invalid status 404 Not Found' END AS error,
      CASE WHEN target IS NOT NULL THEN 404 END AS status FROM links WHERE target IS NULL OR {_TARGET_STATUS} = 404""",
    "missing_fragments": "SELECT url AS doc_url, 'x' || (page_id % 4) AS fragment FROM pages WHERE page_id % 4 > 1 AND page_id % 4 <> page_id",
    "link_targets": f"WITH {_BASED} SELECT target AS target_nofrag, count(*) AS n FROM links WHERE target IS NOT NULL GROUP BY 1",
    "resolve_redirects": """WITH p AS (SELECT page_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) || '/r/' || page_id AS url FROM pages),
      u AS (SELECT *, 5 - page_id % 5 AS need, (SELECT max(page_id) FROM pages) - page_id AS have FROM p WHERE page_id % 5 <> 0)
      SELECT u.url, CASE WHEN need <= 3 AND have >= need THEN p.url END AS final_url, CASE WHEN have < need AND have < 3 THEN have + 1 WHEN need <= 3 THEN need ELSE 3 END::INT AS hops,
        CASE WHEN have < need AND have < 3 THEN 'redirect_location' WHEN need > 3 THEN 'too_many_redirects' END AS error FROM u LEFT JOIN p ON p.page_id = u.page_id + need""",
    "cross_origin_hops": f"""SELECT url, {_NOFRAG.format("next")} AS next FROM ({_REDIRECT_TO}) WHERE page_id % 20 = 1 AND next IS NOT NULL AND regexp_extract(url, '^(https?://[^/?#]+)', 1) <> regexp_extract(next, '^(https?://[^/?#]+)', 1)""",
    "robots_rules": f"""WITH r AS (SELECT DISTINCT regexp_extract(url, '^(https?://[^/?#]+)', 1) AS root FROM pages), o AS (SELECT root, root || CASE WHEN starts_with(root, 'https:') THEN ':443' ELSE ':80' END AS origin FROM r)
      SELECT origin, false AS allow, '/fr/' AS pattern FROM o WHERE length(root) % 4 = 0
      UNION ALL SELECT origin, false, unnest(['/en/1', '/*.html$']) FROM o WHERE length(root) % 4 <> 0 UNION ALL SELECT origin, true, '/en/1' || (length(root) % 10) FROM o WHERE length(root) % 4 <> 0""",
    "robots_filter": f"""WITH p AS (SELECT page_id, length(regexp_extract(url, '^(https?://[^/?#]+)', 1)) AS n, {_PATH.format("url")} AS path FROM pages)
      SELECT page_id, CASE WHEN n % 4 = 0 THEN NOT starts_with(path, '/fr/') WHEN ends_with(path, '.html') THEN false WHEN starts_with(path, '/en/1' || (n % 10)) THEN true ELSE NOT starts_with(path, '/en/1') END AS allowed FROM p""",
    "robots_documents": "SELECT DISTINCT regexp_extract(url, '^(https?://[^/?#]+)', 1) || '/robots.txt' AS url FROM pages",
    "unknown_tags": "SELECT url AS doc_url, 'unknown_tag' AS kind, 'blink' AS name, NULL::VARCHAR AS detail FROM pages WHERE page_id % 6 = 0",
    "disallowed_attributes": "SELECT url AS doc_url, 'attribute_not_allowed' AS kind, 'foo' AS name, NULL::VARCHAR AS detail FROM pages WHERE page_id % 6 = 2",
    "invalid_attribute_values": "SELECT url AS doc_url, 'invalid_value' AS kind, 'target' AS name, 'nowhere' AS detail FROM pages WHERE page_id % 6 = 2",
    "conflicting_attributes": "SELECT url AS doc_url, 'conflicting_attribute' AS kind, 'name' AS name, NULL::VARCHAR AS detail FROM pages WHERE page_id % 6 = 3",
    "missing_attributes": "SELECT url AS doc_url, 'missing_attribute' AS kind, 'src' AS name, NULL::VARCHAR AS detail FROM pages WHERE page_id % 6 = 1",
    "disallowed_children": "SELECT url AS doc_url, 'child_not_allowed' AS kind, CASE page_id % 6 WHEN 0 THEN 'blink' WHEN 3 THEN 'meta' ELSE 'p' END AS name, NULL::VARCHAR AS detail FROM pages WHERE page_id % 6 IN (0, 3, 4)",
    "misplaced_children": "SELECT url AS doc_url, 'misplaced_child' AS kind, unnest(CASE WHEN page_id % 56 = 0 THEN ['body', 'head'] WHEN page_id % 7 = 0 THEN ['head'] ELSE ['body'] END) AS name, NULL::VARCHAR AS detail FROM pages WHERE page_id % 7 = 0 OR page_id % 8 = 0",
    "missing_children": "SELECT url AS doc_url, 'missing_child' AS kind, 'dd' AS name, NULL::VARCHAR AS detail FROM pages WHERE page_id % 8 = 0",
    "dedup_attributes": "SELECT url AS doc_url, unnest(['class', 'id']) AS attribute, unnest(['x', 'a']) AS value FROM pages",
    "best_variant": "WITH s AS (SELECT event_id // 4 AS k, event_id % 4 AS variant, event_id * 7 % 3 AS errors, event_id * 5 % 2 AS conflicts FROM events) SELECT k::VARCHAR AS doc_url, variant FROM s QUALIFY row_number() OVER (PARTITION BY k ORDER BY errors, conflicts, variant) = 1",
    "svg_root_errors": "SELECT url AS doc_url, 'root_name' AS kind, 'g' AS detail FROM pages WHERE page_id % 4 = 0 UNION ALL SELECT url, 'root_namespace', 'http://example.com/ns' FROM pages WHERE page_id % 3 = 0",
    "document_metrics": f"WITH {_METRICS} SELECT * FROM metrics",
    "run_metrics": f"WITH {_METRICS} SELECT count(*) FILTER (error = 0) AS documents_ok, count(*) FILTER (error > 0) AS documents_failed, sum(success)::BIGINT AS items_ok, sum(error)::BIGINT AS items_failed, bool_or(error > 0) AS failed FROM metrics",
    "summary_table": f"WITH {_METRICS} SELECT 'documents' AS what, count(*) FILTER (error = 0) AS success, count(*) FILTER (error > 0) AS error, count(*) AS total FROM metrics UNION ALL SELECT 'elements', sum(success)::BIGINT, sum(error)::BIGINT, sum(success + error)::BIGINT FROM metrics",
    "error_histogram": f"WITH {_RESULTS} SELECT {_HOST.format('doc_url')} AS host, 'http_status' AS error_kind, count(*) AS n FROM results WHERE status <> 200 GROUP BY 1",
    "css_syntax_errors": """SELECT url AS doc_url, CASE page_id % 5 WHEN 0 THEN 'unexpected }' WHEN 1 THEN 'Unknown at rule: @un' || (page_id % 3) ELSE '@import rules must precede all rules aside from @charset and @layer statements' END AS errors FROM pages WHERE page_id % 5 < 3""",
    "svg_syntax_errors": "SELECT url AS doc_url, CASE page_id % 5 WHEN 0 THEN 'unclosed comment,unclosed element' ELSE 'unexpected end tag' END AS errors FROM pages WHERE page_id % 5 < 2",
    "report_json": f"""WITH {_RESULTS}, e AS (SELECT doc_url, ord, '{{"element":{{"name":"a","attributes":[["href","' || raw || '"]]}},"results":[' || CASE status WHEN 200 THEN '{{"response":{{"url":"' || target || '","status":200,"latency":0}}}}' ELSE '{{"error":"invalid status 404 Not Found"}}' END || ']}}' AS j FROM results)
      SELECT doc_url AS url, '{{"url":"' || doc_url || '","elements":[' || string_agg(j, ',' ORDER BY ord) || ']}}' AS json FROM e GROUP BY doc_url""",
    "report_lines": f"""WITH {_RESULTS}, n AS (SELECT *, row_number() OVER (PARTITION BY doc_url ORDER BY ord) AS k FROM results)
      SELECT DISTINCT doc_url, 0 AS place, doc_url AS line FROM n UNION ALL SELECT doc_url, (2 * k - 1)::INT, chr(9) || 'a href="' || raw || '"' FROM n
      UNION ALL SELECT doc_url, (2 * k)::INT, chr(9) || chr(9) || CASE status WHEN 200 THEN '✅ 200 OK ' || target || ' 0 ms' ELSE '❌ invalid status 404 Not Found' END FROM n""",
    "latest_response": f"WITH {_VERSIONS} SELECT * FROM latest",
    "write_store": f"WITH {_VERSIONS} SELECT page_id, url, status FROM latest",
    "cache_lookup": f"""WITH {_VERSIONS}, a AS (SELECT p.page_id, l.status, l.url IS NULL AS gone, datediff('millisecond', fetched_at, TIMESTAMP '2024-01-06') AS age, CASE WHEN p.page_id % 2 = 0 THEN 86400000 ELSE 3600000 END AS max_age FROM pages p LEFT JOIN latest l ON p.url = l.url AND p.page_id % 4 <> 1),
      l AS (SELECT page_id, CASE WHEN gone THEN 'miss' WHEN status = 503 THEN 'evicted' WHEN age <= max_age THEN 'hit' WHEN age <= max_age + 86400000 THEN 'stale_hit' ELSE 'expired' END AS lookup FROM a)
      SELECT page_id, lookup, CASE WHEN lookup = 'hit' THEN 'stored' WHEN page_id % 5 <> 0 THEN 'fetched' WHEN lookup = 'stale_hit' THEN 'stored' ELSE 'failed' END AS outcome FROM l""",
    "retry_outcome": """WITH a AS (SELECT 'u' || (event_id // 10) AS url, (event_id % 10)::INT AS attempt, CASE event_type WHEN 'signup' THEN NULL WHEN 'error' THEN 503 ELSE 200 END AS status FROM events QUALIFY row_number() OVER (PARTITION BY event_id // 10 ORDER BY event_id) <= 5),
      n AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY attempt) AS i, coalesce(status = 200, false) AS done FROM a)
      SELECT url, attempt, coalesce(status, -1)::INT AS status, i::INT AS used, done AS settled FROM n QUALIFY row_number() OVER (PARTITION BY url ORDER BY done DESC, CASE WHEN done THEN i ELSE -i END) = 1""",
    "rate_limit_violations": f"""WITH {_LOG}, w AS (SELECT site, date_trunc('hour', ts) AS window_start, count(*) AS n FROM log GROUP BY 1, 2)
      SELECT * FROM w WHERE n > 1 UNION ALL SELECT NULL, window_start, sum(n)::BIGINT FROM w GROUP BY window_start HAVING sum(n) > 15""",
    "rate_limited_schedule": f"WITH {_LOG} SELECT event_id, site, (row_number() OVER (PARTITION BY site ORDER BY ts, event_id) - 1) // 5 AS slot FROM log",
    "rate_limited_arrivals": f"""WITH {_LOG}, l AS (SELECT event_id, site, ts, row_number() OVER (PARTITION BY site ORDER BY ts, event_id) - 1 AS i, epoch_us(ts) // 21600000000 AS a FROM log),
      s AS (SELECT *, i + max(a - i) OVER (PARTITION BY site ORDER BY i ROWS UNBOUNDED PRECEDING) AS slot FROM l), r AS (SELECT *, greatest(epoch_us(ts), slot * 21600000000) AS sent FROM s),
      o AS (SELECT *, row_number() OVER (ORDER BY sent, ts, event_id) - 1 AS j, sent // 3600000000 AS b FROM r)
      SELECT event_id, site, slot, (j + max(b * 15 - j) OVER (ORDER BY j ROWS UNBOUNDED PRECEDING)) // 15 AS overall_slot FROM o""",
    "latest_bodies": f"""WITH {_VERSIONS}, b AS (SELECT page_id, l.url, status, strftime(fetched_at, '%Y-%m-%d %H:%M:%S') || html AS body FROM latest l JOIN pages USING (page_id))
      SELECT page_id, url, status, strlen(body)::INT AS n_bytes, sha256(body) AS digest FROM b""",
    "crawl_depth": f"WITH RECURSIVE {_EDGES}, r AS (SELECT url, 0 AS depth FROM pages WHERE page_id = 1 UNION SELECT dst, depth + 1 FROM r JOIN edges ON url = src WHERE depth < 40) SELECT url, min(depth)::INT AS depth FROM r GROUP BY url",
    "crawl": f"""WITH RECURSIVE {_SITES}, {_EDGES}, good AS (SELECT url FROM pages WHERE {_STATUS} = 200), wide AS (SELECT url FROM pages WHERE EXISTS (FROM sites WHERE {_HOST.format("url")} = host AND starts_with({_PATH.format("url")}, path) AND recursive)),
      r AS (SELECT url FROM pages WHERE page_id = 3 UNION SELECT dst FROM r JOIN edges ON r.url = src WHERE dst IN (SELECT url FROM good) AND dst IN (SELECT url FROM wide)) SELECT url FROM r""",
    "frontier_minus_visited": f"WITH {_EDGES} SELECT DISTINCT dst AS url FROM edges WHERE dst NOT IN (SELECT url FROM pages WHERE page_id % 2 = 0)",
    "distinct_documents": f"SELECT {_HOST.format('url')} AS final_url, min(url) AS url FROM pages GROUP BY 1",
    "stream_results": f"WITH {_BASED} SELECT doc_url, ord, target, target IS NOT NULL AND {_TARGET_STATUS} = 200 AS ok, CASE WHEN target IS NULL THEN 'url_parse' WHEN {_TARGET_STATUS} <> 200 THEN 'http_status' END AS error_kind FROM links",
    "stream_awaited": f"""WITH {_BASED}, k AS (SELECT doc_url, ord, target, CASE WHEN target IS NULL THEN 'url_parse' WHEN length(target) % 11 = 0 THEN 'missing_response' WHEN {_TARGET_STATUS} <> 200 THEN 'http_status' END AS error_kind FROM links)
      SELECT doc_url, ord, target, error_kind IS NULL AS ok, error_kind FROM k""",
    "stream_dedup": "SELECT url AS final_url, TIMESTAMP '2024-01-01' + to_hours(page_id::INT) AS fetched_at FROM pages",
    "stream_metrics": f"WITH {_METRICS} SELECT sum(success)::BIGINT AS success, sum(error)::BIGINT AS error FROM metrics",
    "stream_store": f"WITH {_VERSIONS} SELECT page_id, url, status FROM latest",
    "stream_rate": f"WITH {_LOG} SELECT site, date_trunc('hour', ts) AS window_start, count(*) AS n FROM log GROUP BY 1, 2 HAVING count(*) > 1",
    "read_responses": f"SELECT url, {_STATUS} AS status, 'text/html' AS media, strlen(html)::INT AS n_bytes, page_id AS duration_ms FROM pages",
    "read_sites": f"""WITH p AS (SELECT page_id, {_HOST.format("url")} AS host, {_PATH.format("url")} AS path FROM pages), e AS (SELECT min(host) AS a, max(host) AS b FROM p),
      s AS (SELECT page_id, CASE WHEN host = b AND starts_with(path, '/en') THEN 'two' WHEN host = a THEN 'one' ELSE 'default' END AS site FROM p, e)
      SELECT page_id, site, CASE site WHEN 'one' THEN 3 ELSE 16 END AS max_redirects, CASE site WHEN 'two' THEN 'https' ELSE 'http,https' END AS schemes FROM s""",
    "all_links": f"WITH {_DOCS} SELECT doc_url, element, attribute, raw, hint, target FROM l",
    "site_audit": f"""WITH {_DOCS}, v AS (SELECT *, {_NOFRAG.format("target")} AS page FROM l),
      w AS (SELECT doc_url, element, attribute, raw, target, CASE WHEN length(page) % 11 = 0 THEN 'missing_response' WHEN length(page) % 7 = 0 THEN 'http_status' WHEN hint IS NOT NULL THEN 'content_type_invalid' WHEN ends_with(target, '#none') THEN 'element_not_found' END AS e, hint FROM v)
      SELECT doc_url, element, attribute, raw, target, e IS NULL AS ok, e AS error_kind, CASE e WHEN 'missing_response' THEN 'no response' WHEN 'http_status' THEN 'invalid status 404 Not Found' WHEN 'content_type_invalid' THEN 'content type expected ' || hint || ' but got text/html' WHEN 'element_not_found' THEN 'element for #none not found' END AS error FROM w
      UNION ALL SELECT doc_url, '#document', '', NULL, NULL, false, kind, message FROM f""",
    "site_metrics": f"""WITH {_DOCS}, i AS (SELECT doc_url, hint IS NULL AND NOT ends_with(target, '#none') AS ok FROM l UNION ALL SELECT doc_url, false FROM f)
      SELECT d.doc_url, count(*) FILTER (ok) AS success, count(*) FILTER (NOT ok) AS error FROM d LEFT JOIN i ON i.doc_url = d.doc_url GROUP BY d.doc_url""",
    "check_links": f"""WITH {_LINKS}, last AS (SELECT max(page_id) AS last FROM pages),
      q0 AS (SELECT page_id, {_ORIGIN.replace("doc_url", "url")} AS root, {_NOFRAG.format("url")} AS own FROM pages),
      q AS (SELECT *, max(page_id) OVER (PARTITION BY own) AS r FROM q0),
      q1 AS (SELECT q.*, n.r AS next FROM q LEFT JOIN q n ON n.page_id = q.r + 1),
      others AS (
        SELECT page_id, 'href' AS attribute, target, NULL AS hint FROM links UNION ALL SELECT page_id, 'href', root || '/s/' || page_id || '.css', 'css' FROM q UNION ALL SELECT page_id, 'href', root || '/map.xml', 'sitemap' FROM q
        UNION ALL SELECT page_id, 'src', root || '/x' || (page_id % 5) || '.js', NULL FROM q),
      asked AS (SELECT attribute, hint, target, length(regexp_extract(target, '^(https?://[^/?#]+)', 1)) AS n, {_PATH.format("target")} AS path, NULL::BIGINT AS k, NULL::BIGINT AS r, NULL::BIGINT AS next, NULL::BIGINT AS fragment FROM others
        UNION ALL SELECT 'xlink:href', NULL, own, length(root), {_PATH.format("own")}, page_id, r, next, page_id FROM q1 UNION ALL SELECT 'href', NULL, own, length(root), {_PATH.format("own")}, page_id, r, next, page_id % 4 FROM q1),
      v AS (SELECT attribute, CASE
        WHEN NOT CASE WHEN n % 4 = 0 THEN NOT starts_with(path, '/fr/') WHEN ends_with(path, '.html') THEN false WHEN starts_with(path, '/en/1' || (n % 10)) THEN true ELSE NOT starts_with(path, '/en/1') END THEN NULL
        WHEN k IS NULL THEN CASE WHEN {_TARGET_STATUS} = 404 THEN 'http_status' WHEN hint IS NOT NULL THEN 'content_type_invalid' END
        WHEN r % 20 = 1 AND r = last THEN 'redirect_location' WHEN r % 20 IN (0, 2) OR r % 20 = 1 AND next % 20 < 3 THEN 'http_status'
        WHEN NOT EXISTS (FROM q a WHERE a.r = CASE r0 % 20 WHEN 1 THEN next ELSE r0 END AND a.page_id = fragment) THEN 'element_not_found' END AS error_kind FROM (SELECT *, r AS r0 FROM asked), last
        UNION ALL SELECT unnest(['content', 'src', 'srcset', 'srcset', 'srcset', 'href']), NULL FROM pages)
      SELECT attribute, error_kind IS NULL AS ok, error_kind, count(*) AS n FROM v GROUP BY attribute, error_kind""",
    "split_markup_errors": """WITH k AS (SELECT url, page_id % 6 AS k, page_id % 7 = 0 AS seventh, page_id % 8 = 0 AS eighth FROM pages),
      e AS (SELECT url AS doc_url, 'unknown_tag' AS kind, 'unknown tag "blink"' AS message FROM k WHERE k = 0 UNION ALL SELECT url, 'attribute_not_allowed', 'attribute "foo" not allowed' FROM k WHERE k = 2 UNION ALL SELECT url, 'invalid_value', 'attribute "target" has an invalid value' FROM k WHERE k = 2
        UNION ALL SELECT url, 'conflicting_attribute', 'attribute "name" is conflicting' FROM k WHERE k = 3 UNION ALL SELECT url, 'missing_attribute', 'missing attributes: src' FROM k WHERE k = 1
        UNION ALL SELECT url, 'child_not_allowed', 'child "' || CASE k WHEN 0 THEN 'blink' WHEN 3 THEN 'meta' ELSE 'p' END || '" not allowed' FROM k WHERE k IN (0, 3, 4)
        UNION ALL SELECT url, 'misplaced_child', 'child "head" misplaced' FROM k WHERE seventh UNION ALL SELECT url, 'misplaced_child', 'child "body" misplaced' FROM k WHERE eighth UNION ALL SELECT url, 'missing_child', 'missing children: dd' FROM k WHERE eighth)
      SELECT doc_url, kind, message FROM e""",
    "page_markup": """WITH k AS (SELECT url, page_id % 5 AS k FROM pages), e AS (SELECT url AS doc_url, 'unknown_tag' AS kind, 'blink' AS name FROM k WHERE k = 0 UNION ALL SELECT url, 'child_not_allowed', 'blink' FROM k WHERE k = 0 UNION ALL SELECT url, 'missing_attribute', 'src' FROM k WHERE k = 1
      UNION ALL SELECT url, 'attribute_not_allowed', 'foo' FROM k WHERE k = 2 UNION ALL SELECT url, 'invalid_value', 'target' FROM k WHERE k = 2 UNION ALL SELECT url, 'child_not_allowed', 'p' FROM k WHERE k = 3) SELECT doc_url, kind, name FROM e""",
}
ORACLE_SQL["report_json_sink"] = f"SELECT url, length(json)::INT AS n_chars FROM ({ORACLE_SQL['report_json']})"
ORACLE_SQL["report_text_sink"] = f"SELECT line AS value FROM ({ORACLE_SQL['report_lines']})"
