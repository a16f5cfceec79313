"""Oracle SQL fragments (DuckDB dialect), written against the stored tables only."""

# Pages whose code blocks are gone.
CLEAN = r"""
clean AS (
  SELECT page_id, url,
         regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'),
                        '(?is)<(?:script|style)\b[^>]*>.*?</(?:script|style)>', '', 'g') AS body
  FROM pages
)"""

# Normalised page URLs: no fragment, no tracking key, no trailing slash.
URLS = r"""
urls AS (
  SELECT page_id, url,
         regexp_extract(url, '^(https?://[^/?#]+)', 1) AS origin,
         regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS path,
         list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'),
                     lambda kv: kv <> '' AND NOT starts_with(kv, 'utm_')) AS kvs
  FROM pages
),
norm AS (
  SELECT page_id, url, lower(origin) AS origin, path,
         lower(origin) || CASE WHEN path IN ('', '/') THEN '/' ELSE rtrim(path, '/') END
         || CASE WHEN len(kvs) = 0 THEN '' ELSE '?' || array_to_string(kvs, '&') END AS page_norm
  FROM urls
)"""

# Deduplicated links of the stored pages; every href there is '/word'.
LINKS = (
    CLEAN
    + ","
    + URLS
    + r""",
anchors AS (
  SELECT page_id, unnest(regexp_extract_all(body, '<a href="[^"]*">[^<]*</a>')) AS a,
         generate_subscripts(regexp_extract_all(body, '<a href="[^"]*">[^<]*</a>'), 1) - 1 AS pos
  FROM clean
),
links AS (
  SELECT a.page_id, n.url AS page_url, n.page_norm, n.origin, CAST(a.pos AS INTEGER) AS pos,
         regexp_extract(a.a, 'href="([^"]*)"', 1) AS href,
         nullif(trim(regexp_extract(a.a, '>([^<]*)</a>', 1)), '') AS link_text,
         n.origin || regexp_extract(a.a, 'href="([^"]*)"', 1) AS normalized_url
  FROM anchors a JOIN norm n USING (page_id)
),
seen AS (
  SELECT * FROM links QUALIFY row_number() OVER (PARTITION BY page_id, normalized_url ORDER BY pos) = 1
)"""
)

# The rendered catalog: which page lists which part.
LISTED = """
listed AS (
  SELECT p.*, p.p_partkey % (SELECT count(*) FROM supplier) AS page_id FROM part p
),
shop AS (
  SELECT s.s_suppkey AS page_id, s.s_name, 'https://shop.example.com/suppliers/' || s.s_suppkey || '/' AS url
  FROM supplier s WHERE s.s_suppkey IN (SELECT page_id FROM listed)
)"""

# Sections of a short profile of the catalog pages.
_SUMMARY_LINES = """
  shown AS (
    SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY p_partkey) AS i, printf('$%.2f', p_retailprice) AS price,
           CASE WHEN p_size > 25 THEN 'In stock' ELSE 'Out of stock' END AS stock FROM listed),
  parts AS (
    SELECT page_id, count(*) AS n, min(p_partkey) AS first_key,
           string_agg('  ' || p_partkey || ' | ' || p_name || ' | ' || p_brand || ' | ' || p_size || ' | ' || price, chr(10) ORDER BY i) FILTER (i <= 2) AS table_lines,
           string_agg('  ''' || p_name || ''' -> ../parts/' || p_partkey, chr(10) ORDER BY i) FILTER (i <= 5) AS link_lines,
           string_agg(p_name || ' ' || p_brand || ' ' || price || ' ' || p_size || ' ' || stock, ' ' ORDER BY i) AS cards,
           string_agg(p_partkey || ' ' || p_name || ' ' || p_brand || ' ' || p_size || ' ' || price, ' ' ORDER BY i) AS lines
    FROM shown GROUP BY page_id),
  summaries AS (
    SELECT page_id, array_to_string(list_filter([
      'URL: ' || url, 'Title: ' || s_name || ' & parts', 'Meta description: Parts of ' || s_name, 'Headings:' || chr(10) || '  [h1] ' || s_name,
      'Structured data (JSON-LD): [{"type":"Organization","name":"' || s_name || '"}]',
      CASE WHEN n >= 3 THEN 'Repeated element classes (likely list/grid items): .part-card, .name, .brand, .price, .size, .stock' END,
      CASE WHEN n >= 3 THEN 'Repeated container samples:' || chr(10) || array_to_string(list_transform(['li.part-card', 'a.name', 'span.brand', 'b.price', 'i.size'], lambda x: 'Selector hint: ' || x), chr(10)) END,
      'Table samples:' || chr(10) || '  Part ID | Name | Brand | Size (cm) | Price' || chr(10) || table_lines,
      'Data attributes found:' || chr(10) || '  data-key=''' || first_key || '''',
      'Sample links:' || chr(10) || array_to_string(['  ''Home'' -> /', '  ''Top'' -> #top', '  ''Mail'' -> mailto:desk@example.com', '  ''Partner'' -> https://partner.example.org/x?utm_source=shop&b=1',
        '  ''Next supplier'' -> /suppliers/' || (page_id + 1) || '/', '  ''2'' -> ?page=2', '  ''Self'' -> /suppliers/' || page_id || '/', link_lines], chr(10)),
      'Pagination candidates: a',
      'Body text snippet: ' || left('Home Top Mail Partner Next supplier 2 Self ' || s_name || ' ' || cards || ' Part ID Name Brand Size (cm) Price ' || lines || ' All rights reserved', 600)
    ], lambda x: x IS NOT NULL), chr(10) || chr(10)) AS summary FROM shop JOIN parts USING (page_id))"""

# Summaries of the catalog pages, from the tables alone.
SUMMARIES = LISTED + "," + _SUMMARY_LINES
