"""URL functions over the page corpus and the rendered catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagesieve.functions import urls
from pagesieve.functions.globs import ONE_MORE_SEGMENT, PER_SEGMENT, compiled_rules, first_match, glob_match, literal_rule
from pagesieve.operators.links import page_links, resolve_links
from pagesieve.plans.oracle_parts import LINKS, URLS
from pagesieve.plans.registry import query
from pagesieve.sources.tables import load


@query("url_normalize", f"WITH {URLS} SELECT page_id, page_norm FROM norm")
def url_normalize(spark, folder):
    return urls.with_normalized(load(spark, folder, "pages"), "url", "page_norm").select("page_id", "page_norm")


_REFS = {
    "absolute": ("https://Other.Example.ORG/A/?b=1&utm_source=z&c=#f", "'https://other.example.org/A?b=1&c='"),
    "network": ("//cdn.example.com/x", "split_part(origin, '://', 1) || '://cdn.example.com/x'"),
    "rooted": ("/a//b/../c/", "origin || '/a/c'"),
    "query": ("?q=a b*~", "origin || CASE WHEN path = '' THEN '/' WHEN path = '/' THEN '/' ELSE rtrim(path, '/') END || '?q=a+b%2A~'"),
    "sibling": ("x/./y.html;v=1", "origin || regexp_replace(path, '[^/]*$', '') || 'x/y.html'"),
    "parent": ("../up", "origin || regexp_replace(path, '[^/]*/[^/]*$', '') || 'up'"),
}


@query(
    "url_resolve_references",
    f"WITH {URLS} "
    + " UNION ALL ".join(
        f"SELECT page_id, '{kind}' AS kind, {sql} AS resolved FROM norm" for kind, (_, sql) in _REFS.items()
    ),
)
def url_resolve_references(spark, folder):
    pages = urls.with_parts(load(spark, folder, "pages").select("page_id", "url"), "url", "b_")
    refs = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(ref).alias("ref")) for k, (ref, _) in _REFS.items()])
    rows = pages.select("*", F.inline(refs))
    return urls.with_normalized_reference(rows, "ref", "b_", "resolved").select("page_id", "kind", "resolved")


@query(
    "url_same_origin",
    r"""SELECT a.n_nationkey, p.page_id,
               false AS never, regexp_extract(p.url, '^(https?)', 1) = 'https' AS https_root
        FROM pages p JOIN nation a ON a.n_nationkey = p.page_id % 25""",
)
def url_same_origin(spark, folder):
    pages = load(spark, folder, "pages").withColumn("n_nationkey", (F.col("page_id") % 25).cast("int"))
    secure = F.concat(F.lit("HTTPS://"), F.regexp_extract("url", "://([^/?#]+)", 1), F.lit("/x"))
    return pages.select(
        "n_nationkey",
        "page_id",
        urls.same_origin(F.col("url"), F.lit("https://nowhere.example")).alias("never"),
        urls.same_origin(F.col("url"), secure).alias("https_root"),
    )


@query(
    "url_navigation_anchors",
    r"""SELECT event_id, event_type IN ('click', 'error') AS is_nav
        FROM events""",
)
def url_navigation_anchors(spark, folder):
    href = (
        F.when(F.col("event_type") == "click", F.concat(F.lit("#"), F.col("user_id").cast("string")))
        .when(F.col("event_type") == "error", F.concat(F.lit("mailto:"), F.col("user_id").cast("string")))
        .otherwise(F.concat(F.lit("JavaScript:/"), F.col("user_id").cast("string")))
    )
    return load(spark, folder, "events").select("event_id", urls.is_navigation(href).alias("is_nav"))


@query(
    "url_glob_include_exclude",
    f"""WITH {LINKS} SELECT page_id, pos, normalized_url FROM seen
        WHERE normalized_url NOT LIKE '%e' AND (normalized_url LIKE '%://%/t%' OR normalized_url LIKE '%a_')""",
)
def url_glob_include_exclude(spark, folder):
    from pagesieve.operators.links import discover_same_site

    found = discover_same_site(
        page_links(load(spark, folder, "pages")), include=("*://*/t*", "*a?"), exclude=("*e",)
    )
    return found.select("page_id", "pos", "normalized_url")


@query(
    "url_glob_match",
    f"""WITH {LINKS} SELECT page_id, pos,
          regexp_matches(href, '^/[a-f].*s$') AS by_path,
          normalized_url LIKE 'https://%' AS by_url,
          regexp_matches(href, '^/[^t].*$') AS negated FROM links""",
)
def url_glob_match(spark, folder):
    url = F.col("normalized_url")
    return resolve_links(load(spark, folder, "pages")).select(
        "page_id",
        "pos",
        glob_match(url, "/[a-f]*s").alias("by_path"),
        glob_match(url, "https://*").alias("by_url"),
        glob_match(url, "/[!t]*").alias("negated"),
    )


@query(
    "url_collection_match",
    r"""SELECT page_id, regexp_matches(regexp_extract(url, '^https?://[^/]+([^?#]*)', 1), '^/en/[^/]+/*$') AS sibling
        FROM pages""",
)
def url_collection_match(spark, folder):
    return load(spark, folder, "pages").select(
        "page_id", glob_match(F.col("url"), "/en/*", ONE_MORE_SEGMENT).alias("sibling")
    )


@query(
    "url_segment_match",
    r"""SELECT page_id, list_filter(['/*/*', '/en/*', '/*/*.html', '/de'],
            lambda p: regexp_matches(rtrim(regexp_extract(url, '^https?://[^/]+([^?#]*)', 1), '/'),
                CASE p WHEN '/*/*' THEN '^/[^/]+/[^/]+$' WHEN '/en/*' THEN '^/en/[^/]+$'
                       WHEN '/*/*.html' THEN '^/[^/]+/[^/]*\.html$' ELSE '^/de$' END))[1] AS first_hit
        FROM pages""",
)
def url_segment_match(spark, folder):
    patterns = F.array(*[F.lit(p) for p in ("/*/*", "/en/*", "/*/*.html", "/de")])
    pages = load(spark, folder, "pages").withColumn("rules", compiled_rules(patterns, PER_SEGMENT))
    return pages.select("page_id", first_match(F.col("url"), F.col("rules")).alias("first_hit"))


@query(
    "url_looks_like_pagination",
    r"""SELECT page_id, regexp_matches(url, '[?&]page=') AS paged,
               true AS by_path, false AS blank_value, false AS size_knob FROM pages""",
)
def url_looks_like_pagination(spark, folder):
    base = F.regexp_extract("url", "^(https?://[^/?#]+)", 1)
    return load(spark, folder, "pages").select(
        "page_id",
        urls.looks_like_pagination(F.col("url")).alias("paged"),
        urls.looks_like_pagination(F.concat(base, F.lit("/cat/Page-3.html"))).alias("by_path"),
        urls.looks_like_pagination(F.concat(base, F.lit("/cat?page=&x=1"))).alias("blank_value"),
        urls.looks_like_pagination(F.concat(base, F.lit("/cat?per_page=20"))).alias("size_knob"),
    )


@query(
    "url_safety_screen",
    r"""WITH hosts AS (
          SELECT c_custkey, c_custkey % 9 AS k, c_nationkey + 1 AS o FROM customer)
        SELECT c_custkey, CASE k WHEN 0 THEN 'PRIVATE_ADDRESS' WHEN 1 THEN 'LOOPBACK' WHEN 2 THEN 'LINK_LOCAL'
          WHEN 3 THEN 'MULTICAST' WHEN 4 THEN 'METADATA_IP' WHEN 5 THEN 'SCHEME_NOT_ALLOWED'
          WHEN 6 THEN 'INVALID_URL' WHEN 7 THEN NULL ELSE NULL END AS reason FROM hosts""",
)
def url_safety_screen(spark, folder):
    octet = (F.col("c_nationkey") + 1).cast("string")
    shapes = [
        ("http://10.0.{}.7/a", 0), ("https://user@127.0.{}.1:8080/", 1), ("http://169.254.{}.1/", 2),
        ("http://230.1.{}.1/x", 3), ("http://169.254.169.254/latest/{}", 4), ("ftp://8.8.8.{}/", 5),
        ("//host/{}", 6), ("http://8.8.8.{}/ok", 7), ("https://host{}.example.com/", 8),
    ]
    url = F.lit(None).cast("string")
    for shape, k in shapes:
        before, after = shape.split("{}")
        url = F.when(F.col("c_custkey") % 9 == k, F.concat(F.lit(before), octet, F.lit(after))).otherwise(url)
    rows = load(spark, folder, "customer").select("c_custkey", url.alias("url"))
    return urls.with_block_reason(rows, "url", "reason").select("c_custkey", "reason")


# Literals whose last part is filled with a hexadecimal number of the row, with their reasons.
_LITERALS = [
    ("http://[0:0:0:0:0:0:0:1]/{}", "LOOPBACK"), ("https://[::1]:8443/{}", "LOOPBACK"), ("http://[::ffff:127.0.0.1]/{}", "LOOPBACK"), ("http://[::FFFF:7f00:{}]/", "LOOPBACK"),
    ("http://[::ffff:a9fe:a9fe]/{}", "METADATA_IP"), ("http://[::ffff:a9fe:{}]/", "LINK_LOCAL"), ("http://[fe80::{}%25eth0]/", "LINK_LOCAL"), ("http://[febf:ffff::{}]/", "LINK_LOCAL"),
    ("http://[::]/{}", "PRIVATE_ADDRESS"), ("http://[2001:db8::{}]/", "PRIVATE_ADDRESS"), ("http://[100::{}]/", "PRIVATE_ADDRESS"), ("http://[fd12:3456::{}]/", "PRIVATE_ADDRESS"),
    ("http://[2002:7f00:{}::]/", "PRIVATE_ADDRESS"), ("http://[::ffff:10.1.2.3]/{}", "PRIVATE_ADDRESS"), ("http://[2001:0:{}::1]/", "PRIVATE_ADDRESS"), ("http://[ff02::{}]/", "MULTICAST"),
    ("http://[64:ff9b::7f00:{}]/", "RESERVED"), ("http://[::{}:2]/", "RESERVED"), ("http://[4000::{}]/", "RESERVED"), ("http://[fe00::{}]/", "RESERVED"), ("http://[1234:{}::9]/", "RESERVED"),
    ("http://user@[2606:4700::{}]:80/a?b", None), ("http://[2001:4:112::{}]/", None), ("http://[::ffff:8.8.8.8]/{}", None), ("http://[2a00:1450:4001:80b::{}]/", None),
    ("http://[1:2:3:4:5:6:7:8:{}]/", "INVALID_URL"), ("http://[::1::{}]/", "INVALID_URL"), ("http://[12345::{}]/", "INVALID_URL"), ("http://[host{}]/", "INVALID_URL"),
    ("http://2130706433/{}", "LOOPBACK"), ("http://0x7f.{}", "LOOPBACK"), ("http://0177.0.0.1/{}", "LOOPBACK"), ("http://192.0.0.9/{}", None), ("http://256.1.1.1/{}", None),
]


@query(
    "url_safety_literals",
    "SELECT c_custkey, CASE c_custkey % " + str(len(_LITERALS)) + " ".join(f" WHEN {i} THEN '{r}'" for i, (_, r) in enumerate(_LITERALS) if r)
    + " END AS reason, CASE WHEN c_custkey % " + str(len(_LITERALS)) + " IN (" + ", ".join(str(i) for i, (_, r) in enumerate(_LITERALS) if r == "INVALID_URL")
    + ") THEN 'INVALID_URL' WHEN c_custkey % " + str(len(_LITERALS)) + " = 4 THEN 'METADATA_IP' END AS private_allowed FROM customer",
)
def url_safety_literals(spark, folder):
    """IPv6 literals in all spellings, mapped and translated IPv4 addresses, and old IPv4 forms."""
    number = F.lower(F.hex(F.col("c_custkey") % 50 + 16))
    shapes = F.array(*[F.lit(s) for s, _ in _LITERALS])
    shape = F.get(shapes, (F.col("c_custkey") % len(_LITERALS)).cast("int"))
    shown = F.when(F.contains(shape, F.lit("0x7f.")), (F.col("c_custkey") % 50).cast("string")).otherwise(number)
    rows = load(spark, folder, "customer").select("c_custkey", F.replace(shape, F.lit("{}"), shown).alias("url"))
    judged = urls.with_block_reason(rows, "url", "reason")
    return urls.with_block_reason(judged, "url", "private_allowed", allow_private=True).drop("url")


@query(
    "url_infer_mode",
    r"""SELECT page_id, CASE WHEN regexp_matches(url, '://blog\.') AND false THEN 'CONTENT' ELSE 'STRUCTURED' END AS plain,
          'CONTENT' AS doc_path, 'CONTENT' AS doc_host,
          CASE WHEN page_id % 2 = 0 THEN 'STRUCTURED' ELSE 'CONTENT' END AS explicit_wins FROM pages""",
)
def url_infer_mode(spark, folder):
    base = F.regexp_extract("url", "^(https?://[^/?#]+)", 1)
    explicit = F.when(F.col("page_id") % 2 == 0, "STRUCTURED").otherwise("")
    return load(spark, folder, "pages").select(
        "page_id",
        urls.infer_mode(F.col("url")).alias("plain"),
        urls.infer_mode(F.concat(base, F.lit("/Docs/intro"))).alias("doc_path"),
        urls.infer_mode(F.concat(F.lit("https://lib"), F.col("page_id").cast("string"), F.lit(".ReadTheDocs.io/x"))).alias("doc_host"),
        urls.infer_mode(F.concat(base, F.lit("/wiki/a")), explicit).alias("explicit_wins"),
    )


@query(
    "url_sanitize",
    r"""SELECT page_id, regexp_extract(url, '^([^?#]*)', 1) ||
          CASE WHEN regexp_matches(url, '[?#].') THEN '?[URL_SANITIZED]' ELSE '' END AS shown FROM pages""",
)
def url_sanitize(spark, folder):
    return load(spark, folder, "pages").select("page_id", urls.sanitize_url(F.col("url")).alias("shown"))


@query(
    "url_variant_params",
    r"""SELECT page_id, regexp_extract(url, '^([^?#]*)', 1) || '?' ||
          CASE WHEN regexp_matches(url, '\?page=2&ref=x') THEN 'page=9&ref=x&unit=a+b'
               WHEN regexp_matches(url, '\?utm_source=feed') THEN 'utm_source=feed&page=9&unit=a+b'
               ELSE 'page=9&unit=a+b' END || regexp_extract(url, '(#.*)$', 1) AS variant_url FROM pages""",
)
def url_variant_params(spark, folder):
    params = F.create_map(F.lit("page"), F.lit("9"), F.lit("unit"), F.lit("a b"))
    return load(spark, folder, "pages").select("page_id", urls.variant_url(F.col("url"), params).alias("variant_url"))
