"""URL parsing, resolution and normalisation as JVM-side column expressions.

Functions named ``with_*`` add columns to a DataFrame in stages: each stage
names an intermediate column once, so Catalyst never has to expand a nested
expression several times over.  Everything stays inside generated code except
the rare branches guarded by ``when`` (dot segments, query strings).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesieve.functions.addresses import ipv4_number, ipv4_reason, ipv6_halves, ipv6_reason

# Query keys that never change what a page shows.
TRACKING_PARAMS = (
    "fbclid",
    "gclid",
    "mc_cid",
    "mc_eid",
    "msclkid",
    "utm_campaign",
    "utm_content",
    "utm_medium",
    "utm_source",
    "utm_term",
)

# Query keys that carry a page number.
PAGINATION_KEYS = (
    "p",
    "pg",
    "page",
    "pageno",
    "page_num",
    "pagenum",
    "paged",
    "offset",
    "start",
    "skip",
)

# Schemes whose references resolve against a base, per the URL standard library.
RELATIVE_SCHEMES = (
    "", "ftp", "http", "gopher", "nntp", "imap", "wais", "file", "https", "shttp", "mms",
    "prospero", "rtsp", "rtsps", "rtspu", "sftp", "svn", "svn+ssh", "ws", "wss",
)

# Hosts, path fragments and suffixes that mean prose rather than rows.
CONTENT_HOSTS = (
    "github.com",
    "gitlab.com",
    "bitbucket.org",
    "readthedocs.io",
    "readthedocs.org",
    "medium.com",
    "substack.com",
    "dev.to",
    "wikipedia.org",
    "stackoverflow.com",
)
CONTENT_PATHS = (
    "/docs", "/doc/", "/documentation", "/blog", "/article", "/wiki", "/readme",
    "/guide", "/manual", "/knowledge", "/help/", "/posts/", "/post/", "/news/",
)
CONTENT_SUFFIXES = (".md", ".rst", ".txt", ".adoc")

_URL = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#([\s\S]*))?$"
_NAVIGATION = r"^(#|mailto:|tel:|javascript:)"

SANITIZED_QUERY = "[URL_SANITIZED]"


def any_of(conditions) -> Column:
    """OR over a fixed list of conditions."""
    out = F.lit(False)
    for condition in conditions:
        out = out | condition
    return out


def clean_reference(url: Column) -> Column:
    """Drop leading control characters and embedded line breaks, as browsers do."""
    return F.regexp_replace(url, r"^[\x00-\x20]+|[\t\r\n]", "")


def with_parts(df: DataFrame, url: str, prefix: str) -> DataFrame:
    """Add <prefix>scheme, netloc, path, query, fragment for a URL column."""
    cleaned = f"{prefix}clean"
    df = df.withColumn(cleaned, clean_reference(F.col(url)))
    part = lambda group: F.regexp_extract(F.col(cleaned), _URL, group)
    return df.withColumns(
        {
            f"{prefix}scheme": F.lower(part(1)),
            f"{prefix}netloc": part(2),
            f"{prefix}path": part(3),
            f"{prefix}query": part(4),
            f"{prefix}fragment": part(5),
        }
    ).drop(cleaned)


PART_NAMES = ("scheme", "netloc", "path", "query", "fragment")


def drop_parts(df: DataFrame, prefix: str) -> DataFrame:
    return df.drop(*[prefix + name for name in PART_NAMES])


def path_of(url: Column) -> Column:
    """Path without the trailing ;parameters of its last segment."""
    return F.regexp_replace(F.regexp_extract(url, _URL, 3), r";[^/]*$", "")


def query_of(url: Column) -> Column:
    return F.regexp_extract(url, _URL, 4)


def origin_of(url: Column) -> Column:
    """Lower-cased scheme and authority; port and user info count."""
    cleaned = clean_reference(url)
    return F.concat(
        F.lower(F.regexp_extract(cleaned, _URL, 1)),
        F.lit("://"),
        F.lower(F.regexp_extract(cleaned, _URL, 2)),
    )


def same_origin(url: Column, root: Column) -> Column:
    return origin_of(url) == origin_of(root)


def segments_of(url: Column) -> Column:
    """Non-empty path segments."""
    return F.filter(F.split(path_of(url), "/"), lambda s: s != "")


def unquote_plus(text: Column) -> Column:
    """Percent-decoding that leaves malformed escapes alone."""
    return F.try_url_decode(F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25"))


def quote_plus(text: Column) -> Column:
    """Form encoding with '~' kept and '*' escaped."""
    encoded = F.url_encode(text)
    return F.replace(F.replace(encoded, F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def _pair_key(pair: Column) -> Column:
    return unquote_plus(F.substring_index(pair, "=", 1))


def _pair_value(pair: Column) -> Column:
    return F.when(
        F.instr(pair, "=") > 0, unquote_plus(F.substring(pair, F.instr(pair, "=") + 1, F.length(pair)))
    ).otherwise(F.lit(""))


def query_items(query: Column) -> Column:
    """Decoded key/value pairs in order, blanks and duplicates kept."""
    pairs = F.filter(F.split(query, "&"), lambda p: p != "")
    return F.transform(pairs, lambda p: F.struct(_pair_key(p).alias("key"), _pair_value(p).alias("value")))


def clean_query(query: Column) -> Column:
    """Remove tracking keys and re-encode; blanks, order and duplicates stay."""
    kept = F.filter(query_items(query), lambda i: ~F.lower(i["key"]).isin(*TRACKING_PARAMS))
    encoded = F.transform(kept, lambda i: F.concat(quote_plus(i["key"]), F.lit("="), quote_plus(i["value"])))
    return F.when(query == "", F.lit("")).otherwise(F.array_join(encoded, "&"))


def fold_dot_segments(path: Column) -> Column:
    """Resolve '.', '..' and empty inner segments of a merged path."""
    parts = F.split(path, "/")
    last = F.size(parts) - 1
    kept = F.filter(parts, lambda s, i: (s != "") | (i == 0) | (i == last))
    folded = F.aggregate(
        kept,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(s == ".", acc)
        .otherwise(F.concat(acc, F.array(s))),
    )
    tail = F.element_at(parts, -1)
    ended = F.when(tail.isin(".", ".."), F.concat(folded, F.array(F.lit("")))).otherwise(folded)
    joined = F.array_join(ended, "/")
    return F.when(joined == "", F.lit("/")).otherwise(joined)


_NEEDS_FOLD = r"(^|/)\.\.?(/|$)|//"


def with_resolved(df: DataFrame, ref: str, base: str, out: str) -> DataFrame:
    """Resolve a reference against <base>* part columns; adds <out>* part columns.

    ``base`` is the prefix of columns made by :func:`with_parts`; computing
    them once per page keeps the per-link work to the reference itself.
    """
    df = with_parts(df, ref, "__r_")
    r = lambda name: F.col("__r_" + name)
    b = lambda name: F.col(base + name)
    own_scheme = F.when(r("scheme") == "", b("scheme")).otherwise(r("scheme"))
    df = df.withColumns(
        {
            "__r_absolute": (own_scheme != b("scheme"))
            | ~own_scheme.isin(*RELATIVE_SCHEMES)
            | (r("netloc") != ""),
            "__r_bare": (r("path") == ""),
            f"{out}scheme": own_scheme,
        }
    )
    base_dir = F.regexp_replace(b("path"), "[^/]*$", "")
    merged = F.when(F.startswith(r("path"), F.lit("/")), r("path")).otherwise(
        F.concat(F.when(base_dir == "", F.lit("/")).otherwise(base_dir), r("path"))
    )
    df = df.withColumn("__r_merged", merged)
    m = F.col("__r_merged")
    absolute, bare = F.col("__r_absolute"), F.col("__r_bare")
    return drop_parts(
        df.withColumns(
            {
                f"{out}netloc": F.when(absolute, r("netloc")).otherwise(b("netloc")),
                f"{out}path": F.when(absolute, r("path"))
                .when(bare, b("path"))
                .when(F.rlike(m, F.lit(_NEEDS_FOLD)), fold_dot_segments(m))
                .otherwise(m),
                f"{out}query": F.when(~absolute & bare & (r("query") == ""), b("query")).otherwise(r("query")),
                f"{out}fragment": r("fragment"),
            }
        ),
        "__r_",
    ).drop("__r_absolute", "__r_bare", "__r_merged")


def render(scheme: Column, netloc: Column, path: Column, query: Column, fragment: Column | None = None) -> Column:
    """Assemble URL text from parts."""
    has_authority = (netloc != "") | scheme.isin("http", "https", "ftp", "ws", "wss", "file")
    rooted = F.when((path != "") & ~F.startswith(path, F.lit("/")), F.concat(F.lit("/"), path)).otherwise(path)
    body = F.when(has_authority & (scheme != ""), F.concat(F.lit("//"), netloc, rooted)).otherwise(path)
    text = F.concat(
        F.when(scheme == "", F.lit("")).otherwise(F.concat(scheme, F.lit(":"))),
        body,
        F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), query)),
    )
    if fragment is not None:
        text = F.concat(text, F.when(fragment == "", F.lit("")).otherwise(F.concat(F.lit("#"), fragment)))
    return text


def _finish_normalized(df: DataFrame, parts: str, out: str) -> DataFrame:
    p = lambda name: F.col(parts + name)
    bare_path = F.regexp_replace(p("path"), r";[^/]*$", "")
    df = df.withColumn("__n_path", F.when(bare_path == "", F.lit("/")).otherwise(bare_path))
    path = F.when(F.col("__n_path") == "/", F.col("__n_path")).otherwise(
        F.regexp_replace(F.col("__n_path"), "/+$", "")
    )
    brackets = F.contains(p("netloc"), F.lit("[")) != F.contains(p("netloc"), F.lit("]"))
    url = render(p("scheme"), F.lower(p("netloc")), path, clean_query(p("query")))
    return df.withColumn(out, F.when(~brackets, url)).drop("__n_path")


def with_normalized(df: DataFrame, url: str, out: str) -> DataFrame:
    """Normalise an absolute URL column; NULL when the authority is malformed."""
    df = with_parts(df, url, "__a_")
    return drop_parts(_finish_normalized(df, "__a_", out), "__a_")


def with_normalized_reference(df: DataFrame, ref: str, base: str, out: str) -> DataFrame:
    """Resolve a reference against base part columns, then normalise it."""
    df = with_resolved(df, ref, base, "__j_")
    return drop_parts(_finish_normalized(df, "__j_", out), "__j_")


def with_joined(df: DataFrame, ref: str, base_url: str, out: str) -> DataFrame:
    """Plain resolution (no normalising) of a reference against a URL column."""
    df = with_parts(df, base_url, "__b_")
    df = with_resolved(df, ref, "__b_", "__j_")
    j = lambda name: F.col("__j_" + name)
    text = render(j("scheme"), j("netloc"), j("path"), j("query"), j("fragment"))
    df = df.withColumn(out, F.when(F.col(ref) == "", F.col(base_url)).otherwise(text))
    return drop_parts(drop_parts(df, "__j_"), "__b_")


def is_navigation(href: Column) -> Column:
    """Blank, fragment, mail, phone and script anchors (case-sensitive)."""
    return (href == "") | F.rlike(href, F.lit(_NAVIGATION))


def looks_like_pagination(url: Column) -> Column:
    """Page-number query key with a value, or a /page-N style path."""
    query = F.lower(query_of(url))
    keyed = F.exists(
        F.filter(query_items(query), lambda i: i["value"] != ""),
        lambda i: F.trim(i["key"]).isin(*PAGINATION_KEYS) | F.startswith(F.trim(i["key"]), F.lit("page")),
    )
    by_path = F.rlike(F.lower(path_of(url)), F.lit(r"/page[/_-]?\d+"))
    return F.when(query != "", keyed).otherwise(F.lit(False)) | by_path


def sanitize_url(url: Column) -> Column:
    """Scheme, host and path only; a marker replaces query and fragment."""
    hidden = (query_of(url) != "") | (F.regexp_extract(url, _URL, 5) != "")
    shown = F.concat(
        F.lower(F.regexp_extract(url, _URL, 1)), F.lit("://"), F.regexp_extract(url, _URL, 2), path_of(url)
    )
    return F.when(
        url.isNotNull() & (url != ""),
        F.concat(shown, F.when(hidden, F.lit("?" + SANITIZED_QUERY)).otherwise(F.lit(""))),
    ).otherwise(url)


def host_of(url: Column) -> Column:
    """Lower-cased host without user info and port."""
    netloc = F.lower(F.regexp_extract(clean_reference(url), _URL, 2))
    return F.regexp_replace(F.regexp_replace(netloc, "^.*@", ""), r":\d*$", "")


def infer_mode(url: Column, explicit: Column | None = None) -> Column:
    """CONTENT for documentation, article and code hosts; STRUCTURED otherwise."""
    lowered = F.lower(F.trim(url))
    host, path = host_of(lowered), F.regexp_extract(lowered, _URL, 3)
    prose = (
        any_of((host == h) | F.endswith(host, F.lit("." + h)) for h in CONTENT_HOSTS)
        | any_of(F.endswith(path, F.lit(s)) for s in CONTENT_SUFFIXES)
        | any_of(F.contains(path, F.lit(p)) for p in CONTENT_PATHS)
    )
    guess = F.when(prose, F.lit("CONTENT")).otherwise(F.lit("STRUCTURED"))
    return guess if explicit is None else F.coalesce(F.nullif(explicit, F.lit("")), guess)


def with_block_reason(df: DataFrame, url: str, out: str, allow_private: bool = False) -> DataFrame:
    """Add why a URL must not be fetched (no name lookup); NULL when it may be.

    Hosts in brackets must be IPv6 literals.  ``allow_private`` blocks metadata
    addresses alone.
    """
    cleaned = clean_reference(F.col(url))
    df = df.withColumns(
        {"__scheme": F.lower(F.regexp_extract(cleaned, _URL, 1)), "__host": host_of(F.col(url))}
    ).withColumns({"__number": ipv4_number(F.col("__host")), "__halves": ipv6_halves(F.col("__host"))})
    scheme, host, number, halves = F.col("__scheme"), F.col("__host"), F.col("__number"), F.col("__halves")
    reason = (
        F.when(scheme == "", "INVALID_URL")
        .when(~scheme.isin("http", "https"), "SCHEME_NOT_ALLOWED")
        .when(host == "", "INVALID_URL")
        .when(number.isNotNull(), ipv4_reason(number, allow_private))
        .when(halves.isNotNull(), ipv6_reason(halves, allow_private))
        .when(F.contains(host, F.lit("[")) | F.contains(host, F.lit("]")), "INVALID_URL")
    )
    return df.withColumn(out, reason).drop("__scheme", "__host", "__number", "__halves")


def variant_url(url: Column, params: Column) -> Column:
    """Overwrite query keys from a map; the last duplicate wins, fragment stays."""
    cleaned = clean_reference(url)
    items = query_items(query_of(cleaned))
    extra = F.transform(
        F.map_entries(params), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"))
    )
    every = F.when(query_of(cleaned) == "", extra).otherwise(F.concat(items, extra))
    keys = F.array_distinct(F.transform(every, lambda i: i["key"]))
    last_value = lambda k: F.element_at(F.filter(every, lambda i: i["key"] == k), -1)["value"]
    query = F.array_join(F.transform(keys, lambda k: F.concat(quote_plus(k), F.lit("="), quote_plus(last_value(k)))), "&")
    part = lambda g: F.regexp_extract(cleaned, _URL, g)
    return F.when(F.size(params) == 0, url).otherwise(render(F.lower(part(1)), part(2), part(3), query, part(5)))
