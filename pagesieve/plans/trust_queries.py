"""Page quality, record quality, previews, redaction, sinks and streaming queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagesieve.functions import classify, redact
from pagesieve.operators import preview, quality
from pagesieve.plans.ledger_queries import EVENTS, L
from pagesieve.plans.oracle_parts import CLEAN
from pagesieve.plans.registry import query
from pagesieve.session import scratch_folder
from pagesieve.sources import ledger as source
from pagesieve.sources import sinks
from pagesieve.sources.tables import accepted_content_type, load, scan_pages
from pagesieve.streaming import flows


def pages(spark, folder):
    return load(spark, folder, "pages")


@query("page_scan", """SELECT page_id, sha256(html) AS content_hash, octet_length(encode(html)) AS original_bytes, octet_length(encode(html)) AS analyzed_bytes, false AS truncated FROM pages""")
def page_scan(spark, folder):
    return scan_pages(pages(spark, folder)).select("page_id", "content_hash", "original_bytes", "analyzed_bytes", "truncated")


@query("page_scan_truncated", """SELECT page_id, octet_length(encode(html)) AS original_bytes, octet_length(encode(html)) > 500 AS truncated, CASE WHEN octet_length(encode(html)) <= 500 THEN html ELSE list_aggregate(list_filter(list_transform(range(120, 501), lambda n: left(html, n)), lambda h: octet_length(encode(h)) <= 500), 'max') END AS head FROM pages""")
def page_scan_truncated(spark, folder):
    done = scan_pages(pages(spark, folder), 500)
    return done.select("page_id", "original_bytes", "truncated", F.col("html").alias("head"))


@query("page_content_type_filter", "SELECT page_id FROM pages WHERE page_id % 3 <> 1")
def page_content_type_filter(spark, folder):
    kind = F.when(F.col("page_id") % 3 == 0, "Text/HTML; charset=utf-8").when(F.col("page_id") % 3 == 2, "application/xhtml+xml").otherwise("image/png")
    return pages(spark, folder).filter(accepted_content_type(kind)).select("page_id")


@query("page_quality", """SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'structureless' WHEN 1 THEN 'structureless' WHEN 2 THEN 'binary' ELSE 'ok' END AS label,
       CASE WHEN page_id % 5 >= 3 THEN len(regexp_extract_all(html, '<[a-zA-Z!/][^>]*>')) WHEN page_id % 5 = 1 THEN 0 ELSE 0 END AS tag_count,
       CASE WHEN page_id % 5 >= 3 THEN len(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))) WHEN page_id % 5 = 1 THEN 4 ELSE 0 END AS text_length FROM pages""")
def page_quality(spark, folder):
    k = F.col("page_id") % 5
    html = F.when(k == 0, " \n ").when(k == 1, "Oops").when(k == 2, F.regexp_replace("html", "[aeiourst]", "\x01")).otherwise(F.col("html"))
    q = classify.html_quality(html)
    return pages(spark, folder).select("page_id", q.alias("q")).select("page_id", "q.label", "q.tag_count", "q.text_length")


_MARKS = ("<div class='CF-Turnstile cf-chl-x'>", "window._cf_chl_opt={}", "Just a moment... Cloudflare", "<div class='g-recaptcha'>", "hcaptcha", "just a moment")


@query("page_challenge", """SELECT page_id, ['cloudflare_turnstile', 'cloudflare_challenge', 'cloudflare_challenge', 'captcha_challenge', 'captcha_challenge', NULL][page_id % 6 + 1] AS reason FROM pages""")
def page_challenge(spark, folder):
    mark = F.get(F.array(*[F.lit(m) for m in _MARKS]), (F.col("page_id") % 6).cast("int"))
    return pages(spark, folder).select("page_id", classify.challenge_reason(F.concat(mark, F.col("html")), F.col("url")).alias("reason"))


@query("page_sparse", "SELECT page_id, len(replace(replace(html, ' ', ''), chr(10), '')) < 500 AS sparse FROM pages")
def page_sparse(spark, folder):
    return pages(spark, folder).select("page_id", classify.is_sparse(F.col("html")).alias("sparse"))


@query("page_rerender", """SELECT page_id, CASE WHEN page_id % 4 = 0 AND len(replace(replace(regexp_replace(html, '<p>.*?</p>', '', 'gs'), ' ', ''), chr(10), '')) < 500 THEN 'sparse' WHEN page_id % 4 = 1 THEN 'garbled' WHEN page_id % 3 = 0 THEN 'blocked_status' WHEN page_id % 4 = 2 THEN 'auto_solvable_challenge' END AS why FROM pages""")
def page_rerender(spark, folder):
    k = F.col("page_id") % 4
    html = F.when(k == 0, F.regexp_replace("html", "(?s)<p>.*?</p>", "")).when(k == 1, F.regexp_replace("html", "[aeiourst]", "�")).when(k == 2, F.concat("html", F.lit("/cdn-cgi/challenge-platform/"))).otherwise(F.col("html"))
    status = F.when(F.col("page_id") % 3 == 0, 429).otherwise(200)
    return pages(spark, folder).select("page_id", classify.rerender_reason(html, status, F.col("url")).alias("why"))


# --- record quality -------------------------------------------------------------------


def _records(spark, folder):
    """Orders as records of 40 runs: status and echo repeat each other, note is often empty."""
    key = F.col("o_orderkey")
    run = (F.col("o_custkey") % 40).alias("run_id")
    return load(spark, folder, "orders").select(
        run, key.alias("record_ordinal"), F.col("o_orderstatus").alias("status"), F.concat(F.lit(" "), "o_orderstatus").alias("echo"),
        F.when(key % 3 == 0, F.lit("  ")).when(key % 3 == 1, F.col("o_orderpriority")).alias("note"),
        F.when(F.col("o_custkey") % 40 < 5, F.lit(None)).otherwise(F.col("o_totalprice").cast("string")).alias("price"),
    )


_REC = """rec AS (SELECT o_custkey % 40 AS run_id, o_orderkey AS record_ordinal, o_orderstatus AS status, ' ' || o_orderstatus AS echo,
   CASE o_orderkey % 3 WHEN 0 THEN '  ' WHEN 1 THEN o_orderpriority END AS note, CASE WHEN o_custkey % 40 >= 5 THEN o_totalprice::VARCHAR END AS price FROM orders),
 rates AS (SELECT run_id, 'status' AS field, 1.0 AS s FROM rec GROUP BY 1 UNION ALL SELECT run_id, 'echo', 1.0 FROM rec GROUP BY 1
   UNION ALL SELECT run_id, 'note', avg((record_ordinal % 3 = 1)::INT) FROM rec GROUP BY 1 UNION ALL SELECT run_id, 'price', avg((run_id >= 5)::INT) FROM rec GROUP BY 1)"""
_FIELDS = ["status", "echo", "note", "price"]


def _cells(spark, folder):
    from pagesieve.functions.text import is_present

    cells = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in _FIELDS])
    return _records(spark, folder).select("run_id", "record_ordinal", F.inline(cells)).withColumn("present", F.coalesce(is_present(F.col("value")), F.lit(False)))


@query("quality_field_rates", f"WITH {_REC} SELECT run_id, field, round(s, 6) AS success_rate, round(1 - s, 6) AS missing_rate FROM rates")
def quality_field_rates(spark, folder):
    rates = quality.field_rates(_cells(spark, folder), ["run_id"])
    return rates.select("run_id", "field", F.round("success_rate", 6).alias("success_rate"), F.round("missing_rate", 6).alias("missing_rate"))


@query("quality_missing_from_first_seen", """WITH r AS (SELECT o_custkey AS run_id, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
       SELECT run_id, round(count(*) FILTER (o_orderkey % 4 = 1) / max(n), 6) AS success_rate, round((max(n) - min(i) - count(*) FILTER (o_orderkey % 4 = 1)) / max(n), 6) AS missing_rate FROM r WHERE o_orderkey % 4 <= 1 GROUP BY run_id""")
def quality_missing_from_first_seen(spark, folder):
    """Field named by two records in four, filled on one; record order per customer."""
    key = F.col("o_orderkey")
    records = load(spark, folder, "orders").select(F.col("o_custkey").alias("run_id"), key.alias("ordinal"))
    cells = records.filter(F.col("ordinal") % 4 <= 1).select("run_id", "ordinal", F.lit("f").alias("field"), (F.col("ordinal") % 4 == 1).alias("present"))
    out = quality.field_rates_from_first_seen(cells, records, ["run_id"])
    return out.select("run_id", F.round("success_rate", 6).alias("success_rate"), F.round("missing_rate", 6).alias("missing_rate"))


def _groups(spark, folder):
    return load(spark, folder, "orders").groupBy((F.col("o_custkey") % 42).alias("run_id")).agg(
        F.count_if(F.col("o_custkey") % 42 < 40).alias("n_records"), (F.max(F.col("o_custkey") % 42) / 60).alias("failure_ratio"), F.max(F.col("o_custkey") % 42 % 2 == 0).alias("full_site"),
    )


@query("quality_overall", f"""WITH {_REC}, g AS (SELECT DISTINCT o_custkey % 42 AS run_id FROM orders), m AS (SELECT run_id, min(s) AS lo FROM rates GROUP BY 1)
       SELECT g.run_id, CASE WHEN lo IS NULL THEN 'unknown' WHEN g.run_id / 60 > 0.5 THEN 'risky' WHEN g.run_id % 2 = 0 AND lo < 0.8 THEN 'risky' WHEN lo < 0.7 THEN 'needs_review' ELSE 'good' END AS overall FROM g LEFT JOIN m USING (run_id)""")
def quality_overall(spark, folder):
    return quality.overall(_groups(spark, folder), quality.field_rates(_cells(spark, folder), ["run_id"]), ["run_id"])


@query("quality_warnings", f"""WITH {_REC}, g AS (SELECT DISTINCT o_custkey % 42 AS run_id FROM orders)
       SELECT run_id, 'FIELD_LOW_SUCCESS_RATE' AS code, field, round(s, 6) AS rate FROM rates WHERE s < 0.7
       UNION ALL SELECT run_id, 'REQUIRED_FIELD_MISSING', 'price', 1.0 FROM g WHERE run_id < 5 UNION ALL SELECT run_id, 'REQUIRED_FIELD_MISSING', 'ghost', 1.0 FROM g WHERE run_id < 40
       UNION ALL SELECT run_id, 'NO_RECORDS_EXTRACTED', NULL, NULL FROM g WHERE run_id >= 40 UNION ALL SELECT run_id, 'MANY_PAGES_FAILED', NULL, round(run_id / 60, 6) FROM g WHERE run_id / 60 > 0.25""")
def quality_warnings(spark, folder):
    rates = quality.field_rates(_cells(spark, folder), ["run_id"])
    out = quality.warnings(_groups(spark, folder), rates, ["run_id"], ["status", "price", "ghost"])
    return out.withColumn("rate", F.round("rate", 6))


@query("quality_duplicate_columns", f"WITH {_REC} SELECT DISTINCT run_id, 'status' AS a, 'echo' AS b FROM rec")
def quality_duplicate_columns(spark, folder):
    return quality.duplicate_columns(_records(spark, folder), ["run_id"], _FIELDS)


@query("quality_hit_rate", "SELECT c_custkey, CASE WHEN c_nationkey = 0 THEN 0.0 ELSE round((c_nationkey - c_custkey % c_nationkey) / c_nationkey * 100, 1) END AS rate FROM customer")
def quality_hit_rate(spark, folder):
    n, missing = F.col("c_nationkey"), F.when(F.col("c_nationkey") > 0, F.expr("try_mod(c_custkey, c_nationkey)")).otherwise(0)
    return load(spark, folder, "customer").select("c_custkey", quality.hit_rate(n, missing).alias("rate"))


# --- previews -------------------------------------------------------------------------


@query("preview_selector_sample", """WITH r AS (SELECT o_orderkey // 8 AS page_id, o_orderkey, o_orderkey % 8 AS i FROM orders)
       SELECT page_id, count(*) FILTER (i < 5) AS sample_count, CASE WHEN bool_or(i < 5 AND o_orderkey % 5 = 0) THEN '' ELSE 'rare' END AS missing,
              CASE WHEN bool_or(o_orderkey % 2 = 0) AND bool_or(o_orderkey % 2 = 1) THEN 2 ELSE 1 END AS n_warnings FROM r GROUP BY 1""")
def preview_selector_sample(spark, folder):
    """Eight orders make one page of records."""
    key = F.col("o_orderkey")
    rows = load(spark, folder, "orders").select(
        F.floor(key / 8).cast("bigint").alias("page_id"), (key % 8).alias("record_ordinal"), F.col("o_orderstatus").alias("status"),
        F.when(key % 5 == 0, "x").alias("rare"), F.array(F.concat(F.lit("w"), (key % 2).cast("string"))).alias("warnings"),
    )
    out = preview.selector_preview(rows, ["status", "rare"], preview.SAMPLE_ROWS)
    return out.select("page_id", "sample_count", F.array_join("missing_fields", ",").alias("missing"), F.size("warnings").alias("n_warnings"))


@query("preview_selector_all", """SELECT o_orderkey // 8 AS page_id, count(*) AS sample_count, CASE WHEN bool_or(o_orderkey % 5 = 0) THEN '' ELSE 'rare' END AS missing FROM orders GROUP BY 1""")
def preview_selector_all(spark, folder):
    """The same preview over all records of a page."""
    key = F.col("o_orderkey")
    rows = load(spark, folder, "orders").select(
        F.floor(key / 8).cast("bigint").alias("page_id"), (key % 8).alias("record_ordinal"), F.col("o_orderstatus").alias("status"), F.when(key % 5 == 0, "x").alias("rare"), F.array().cast("array<string>").alias("warnings"),
    )
    out = preview.selector_preview(rows, ["status", "rare"])
    return out.select("page_id", "sample_count", F.array_join("missing_fields", ",").alias("missing"))


@query("preview_quality", """WITH r AS (SELECT o_custkey % 40 AS run_id, o_orderkey FROM orders), g AS (SELECT run_id, count(*) FILTER (o_orderkey % 3 <> 0) / count(*) AS note FROM r GROUP BY 1),
         w AS (SELECT run_id, 'FIELD_LOW_SUCCESS_RATE' AS code, 'note' AS field, round(note, 6) AS success_rate FROM g WHERE note < 0.7
               UNION ALL SELECT run_id, 'FIELD_MISSING_IN_PREVIEW', 'price', NULL FROM g WHERE run_id < 5 UNION ALL SELECT run_id, 'FIELD_MISSING_IN_PREVIEW', 'ghost', NULL FROM g)
       SELECT run_id, CASE WHEN note < 0.7 THEN 'needs_review' ELSE 'good' END AS overall, code, field, success_rate FROM g JOIN w USING (run_id)""")
def preview_quality(spark, folder):
    """Notes that hold only line breaks and tabs count as absent; the first runs name no price."""
    from pagesieve.functions.text import is_present

    run, key = (F.col("o_custkey") % 40).alias("run_id"), F.col("o_orderkey")
    orders = load(spark, folder, "orders")
    named = F.create_map(F.lit("status"), F.col("o_orderstatus"), F.lit("note"), F.when(key % 3 == 0, "\n\t ").otherwise(F.col("o_orderpriority")))
    priced = F.when(F.col("o_custkey") % 40 >= 5, F.create_map(F.lit("price"), F.col("o_totalprice").cast("string"))).otherwise(F.create_map().cast("map<string,string>"))
    cells = orders.select(run, F.explode(F.map_concat(named, priced)).alias("field", "value")).withColumn("present", F.coalesce(is_present(F.col("value")), F.lit(False)))
    found = quality.preview_quality(cells, orders.select(run).distinct(), ["run_id"], ["status", "note", "price", "ghost"])
    return found.withColumn("success_rate", F.round("success_rate", 6))


@query("preview_analysis_samples", """WITH f AS (SELECT c_custkey // 6 AS spec_id, c_custkey::VARCHAR AS field, c_custkey % 8 AS n FROM customer), m AS (SELECT spec_id, greatest(1, least(5, max(n))) AS rows FROM f GROUP BY 1)
       SELECT spec_id, i::INT AS row_idx, field, CASE WHEN i < n THEN field || ':' || i END AS value FROM f JOIN m USING (spec_id), range(5) t(i) WHERE i < rows""")
def preview_analysis_samples(spark, folder):
    key = F.col("c_custkey")
    values = F.transform(F.filter(F.sequence(F.lit(0), F.lit(7)), lambda i: i < key % 8), lambda i: F.concat(key.cast("string"), F.lit(":"), i.cast("string")))
    fields = load(spark, folder, "customer").select(F.floor(key / 6).cast("bigint").alias("spec_id"), key.cast("string").alias("field"), values.alias("sample_values"))
    return preview.analysis_samples(fields, preview.SAMPLE_ROWS)


@query("preview_freshness", """SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN false WHEN o_orderkey % 2 = 0 THEN o_orderkey % 3 = 0 ELSE o_orderdate <= TIMESTAMP '1998-01-01' AND o_orderkey % 5 <> 0 END AS fresh FROM orders""")
def preview_freshness(spark, folder):
    k = F.col("o_orderkey")
    fresh = preview.preview_matches(
        k % 7 != 0, F.when(k % 2 == 0, "abc"), F.when(k % 3 == 0, "abc").otherwise("xyz"), F.col("o_orderdate").cast("timestamp_ntz"),
        F.to_timestamp_ntz(F.lit("1998-01-01 00:00:00")), k % 5 != 0,
    )
    return load(spark, folder, "orders").select("o_orderkey", fresh.alias("fresh"))


@query("preview_default_fields", """SELECT p_partkey AS project_id, p_name AS name, CASE WHEN p_size % 2 = 0 THEN p_name ELSE p_brand END AS label, CASE WHEN p_partkey % 2 = 0 THEN 'string' ELSE 'number' END AS type,
       p_size / 50 >= 0.7 AS selected, p_partkey % 2 = 1 AND p_size > 10 AS required FROM part""")
def preview_default_fields(spark, folder):
    rows = load(spark, folder, "part").select(
        F.col("p_partkey").alias("project_id"), F.when(F.col("p_partkey") % 2 == 0, "CONTENT").otherwise("STRUCTURED").alias("mode"), F.col("p_name").alias("name"),
        F.when(F.col("p_size") % 2 == 0, "").otherwise(F.col("p_brand")).alias("label"), F.lit("number").alias("data_type"), (F.col("p_size") > 10).alias("required"), (F.col("p_size") / 50).alias("confidence"),
    )
    return preview.default_fields(rows)


# --- redaction and model text ---------------------------------------------------------

_SECRET_SQL = r"""regexp_replace(regexp_replace(regexp_replace({0}, '(?i)(bearer\s+)[A-Za-z0-9._~+/=-]{{8,}}', '\1[REDACTED_SECRET]', 'g'),
  '(?i)((?:api[_-]?key|x-api-key|authorization|password|token|access_token|refresh_token|secret|hashed_password|api_key_encrypted)\s*[:=]\s*)[^\s,;]+', '\1[REDACTED_SECRET]', 'g'),
  '\bsk-[A-Za-z0-9_-]{{6,}}\b', '[REDACTED_SECRET]', 'g')"""


@query("redact_documents", "SELECT doc_id, " + _SECRET_SQL.format("text") + " AS text FROM documents")
def redact_documents(spark, folder):
    return load(spark, folder, "documents").select("doc_id", redact.hide_secrets(F.col("text")).alias("text"))


@query("redact_urls_in_text", """SELECT page_id, 'see ' || regexp_extract(url, '^([^?#]*)', 1) || CASE WHEN regexp_matches(url, '[?#].') THEN '?[URL_SANITIZED]' ELSE '' END || ' and https://a.b/c?[URL_SANITIZED]) token=[REDACTED_SECRET]' AS text FROM pages""")
def redact_urls_in_text(spark, folder):
    text = F.concat(F.lit("see "), F.col("url"), F.lit(" and https://a.b/c?k=v#f) token=abc123"))
    return pages(spark, folder).select("page_id", redact.clean_text(text).alias("text"))


@query("redact_map", """SELECT page_id, '[REDACTED]' AS secret, regexp_extract(url, '^([^?#]*)', 1) || CASE WHEN regexp_matches(url, '[?#].') THEN '?[URL_SANITIZED]' ELSE '' END AS source_url, 'Bearer [REDACTED_SECRET]' AS note, 'plain' AS other FROM pages""")
def redact_map(spark, folder):
    data = F.create_map(F.lit("password"), F.col("url"), F.lit("source_url"), F.col("url"), F.lit("note"), F.lit("Bearer abcdefgh123"), F.lit("other"), F.lit("plain"))
    done = redact.clean_map(data)
    return pages(spark, folder).select("page_id", done["password"].alias("secret"), done["source_url"].alias("source_url"), done["note"].alias("note"), done["other"].alias("other"))


@query("model_error_bucket", """SELECT event_id, CASE event_type WHEN 'click' THEN 'Authentication failed' WHEN 'view' THEN 'Rate limited' WHEN 'signup' THEN 'Provider timeout' WHEN 'error' THEN 'Invalid JSON response' ELSE 'odd ' || user_id END AS bucket FROM events""")
def model_error_bucket(spark, folder):
    text = F.when(F.col("event_type") == "click", "Incorrect API key").when(F.col("event_type") == "view", "HTTP 429").when(F.col("event_type") == "signup", "read timed out").when(F.col("event_type") == "error", "schema mismatch").otherwise(F.concat(F.lit("odd "), F.col("user_id").cast("string")))
    return load(spark, folder, "events").select("event_id", classify.error_bucket(text).alias("bucket"))


@query("model_json_payload", """SELECT event_id, CASE WHEN event_id % 3 = 2 THEN NULL ELSE (props->>'k')::BIGINT END AS k, event_id % 3 <> 2 AS valid FROM events""")
def model_json_payload(spark, folder):
    n = F.col("event_id") % 3
    reply = F.when(n == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(n == 1, F.concat(F.lit("Sure: "), "props", F.lit(" done"))).otherwise("no payload here")
    parsed = F.from_json(redact.json_payload(reply), "k bigint", {"mode": "PERMISSIVE"})
    return load(spark, folder, "events").select("event_id", parsed["k"].alias("k"), parsed["k"].isNotNull().alias("valid"))


@query("model_input_cut", "SELECT doc_id, len(left(text, 8000)) AS n FROM documents")
def model_input_cut(spark, folder):
    return load(spark, folder, "documents").select("doc_id", F.length(F.substring("text", 1, 8000)).alias("n"))


# --- sinks ----------------------------------------------------------------------------


def _scratch(spark):
    return scratch_folder(spark, "sink")


@query("sink_column_order", """SELECT unnest(['status', 'unit_system', 'echo', 'note', 'source_url']) AS name, unnest([0, 1, 2, 3, 4]) AS position""")
def sink_column_order(spark, folder):
    """Keys discovered in the records' maps, then ordered by the rule."""
    rows = load(spark, folder, "orders").select(
        F.create_map(F.lit("status"), F.col("o_orderstatus"), F.lit("note"), F.col("o_orderpriority"), F.lit("source_url"), F.lit("u"), F.lit("echo"), F.col("o_orderstatus"), F.lit("unit_system"), F.lit("m")).alias("data")
    )
    found = sinks.discovered_keys(rows, "data").agg(F.collect_set("key").alias("k"))
    known = F.array(F.lit("status"), F.lit("absent"), F.lit("unit_system"))
    lead = F.array_intersect(known, F.col("k"))
    extras = F.array_sort(F.array_except(F.array_except("k", lead), F.array(F.lit("source_url"))))
    tail = F.when(F.array_contains("k", "source_url"), F.array(F.lit("source_url"))).otherwise(F.array().cast("array<string>"))
    return found.select(F.posexplode(F.concat(lead, extras, tail)).alias("position", "name"))


_SINK_ORDER = """SELECT o_orderkey::VARCHAR AS o_orderkey, nullif(CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderstatus || ',"q"' END, '') AS status FROM orders"""


def _sink_rows(spark, folder):
    return load(spark, folder, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, F.concat("o_orderstatus", F.lit(',"q"'))).alias("status"))


@query("sink_csv_round_trip", _SINK_ORDER)
def sink_csv_round_trip(spark, folder):
    path = _scratch(spark) + "/csv"
    sinks.write_csv(_sink_rows(spark, folder), ["o_orderkey", "status"], ["o_orderkey"], path)
    return spark.read.option("header", True).option("escape", '"').csv(path)


@query("sink_json_round_trip", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderstatus || ',\"q\"' END AS status FROM orders")
def sink_json_round_trip(spark, folder):
    path = _scratch(spark) + "/json"
    sinks.write_json(_sink_rows(spark, folder), ["o_orderkey", "status"], ["o_orderkey"], path)
    return spark.read.schema("o_orderkey bigint, status string").json(path)


@query("sink_markdown_table", """SELECT '| ' || p_partkey || ' | ' || p_name || '\\|x y |' AS line FROM part UNION ALL SELECT '| p_partkey | name |' UNION ALL SELECT '| --- | --- |'""")
def sink_markdown_table(spark, folder):
    path = _scratch(spark) + "/md"
    rows = load(spark, folder, "part").select("p_partkey", F.concat("p_name", F.lit("|x\ny ")).alias("name"))
    sinks.write_markdown_table(rows, ["p_partkey", "name"], ["p_partkey"], path)
    return spark.read.text(path).select(F.col("value").alias("line"))


@query("sink_markdown_content", """SELECT page_id, '[' || url || '](' || url || ')' || chr(10) || chr(10) || 'Page ' || page_id AS block FROM pages WHERE page_id % 4 <> 0""")
def sink_markdown_content(spark, folder):
    text = F.when(F.col("page_id") % 4 == 0, "  ").otherwise(F.concat(F.lit(" Page "), F.col("page_id").cast("string"), F.lit(" ")))
    rows = pages(spark, folder).select("page_id", sinks.content_block(text, F.col("url")).alias("block"))
    return rows.filter(F.col("block").isNotNull())


@query("sink_markdown_choice", """SELECT 'content' AS kind, count(*) FILTER (page_id % 4 <> 0) AS n FROM pages UNION ALL SELECT 'table', count(*) + 2 FROM pages""")
def sink_markdown_choice(spark, folder):
    """Blocks for rows with content, else a table; counted in the files written."""
    content = F.when(F.col("page_id") % 4 == 0, "\n ").otherwise(F.concat(F.lit("Page "), F.col("page_id").cast("string")))
    rows = pages(spark, folder).select("page_id", "url", F.col("url").alias("source_url"), content.alias("content"))
    out = None
    for records in (rows, rows.drop("content")):
        path = _scratch(spark) + "/markdown"
        kind = sinks.write_markdown(records, ["page_id", "url"], ["page_id"], path)
        line = F.col("value")
        counted = spark.read.text(path).agg(F.count_if((line == "---") if kind == "content" else F.startswith(line, F.lit("|"))).alias("n"))
        counted = counted.select(F.lit(kind).alias("kind"), "n")
        out = counted if out is None else out.unionByName(counted)
    return out


@query("sink_ordered_columns", """SELECT unnest(['brand', 'unit', 'a', 'b', 'source_url']) AS name, unnest([0, 1, 2, 3, 4]) AS position, (SELECT count(*) FROM part) AS n""")
def sink_ordered_columns(spark, folder):
    """Columns of real records, put in export order by the sink's rule."""
    part = load(spark, folder, "part")
    rows = part.select(F.col("p_size").alias("b"), F.lit("u").alias("source_url"), F.col("p_brand").alias("brand"), F.col("p_name").alias("a"), F.col("p_retailprice").alias("unit"))
    ordered = sinks.ordered_columns(["brand", "absent"], ["unit"], rows.columns)
    named = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(c).alias("name"), F.col(c).isNotNull().alias("there")) for i, c in enumerate(ordered)])
    return rows.select(*ordered).select(F.inline(named)).groupBy("name", "position").agg(F.count_if("there").alias("n"))


@query("sink_export_ledger", L("""SELECT run_id, 'csv' AS format, (SELECT count(*) FROM run_pages p WHERE p.run_id = r.run_id AND p.state = 'EXTRACTED') AS record_count, sha256(spec_id::VARCHAR) AS spec_hash, false AS large FROM runs r WHERE state = 'COMPLETED'"""))
def sink_export_ledger(spark, folder):
    runs = source.runs(spark, folder).withColumn("spec_hash", F.sha2(F.col("spec_id").cast("string"), 256))
    records = source.run_pages(spark, folder).filter(F.col("state") == "EXTRACTED")
    return sinks.export_ledger(runs, records, "csv")


@query("sink_idempotent_records", """SELECT l_orderkey AS run_id, l_partkey AS page_id, min(l_linenumber) AS record_ordinal FROM lineitem
       WHERE (l_orderkey, l_partkey) NOT IN (SELECT (l_orderkey, l_partkey) FROM lineitem WHERE l_returnflag = 'R') GROUP BY 1, 2""")
def sink_idempotent_records(spark, folder):
    rows = load(spark, folder, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_partkey").alias("page_id"), F.col("l_linenumber").alias("record_ordinal"), "l_returnflag")
    stored = rows.filter("l_returnflag = 'R'")
    return sinks.new_rows(rows.drop("l_returnflag"), stored, ["run_id", "page_id"], ["record_ordinal"])


# --- streaming ------------------------------------------------------------------------


def _drain(writer):
    done = writer.trigger(availableNow=True).start()
    done.awaitTermination()


def _staged(spark, folder, name, columns, parts=3):
    """Copy a table into a folder of several files, read back as a stream source."""
    path = _scratch(spark) + "/in"
    load(spark, folder, name).select(*columns).repartition(parts).write.parquet(path)
    return path


@query("stream_links_once", f"""WITH {CLEAN} SELECT page_id, count(*) AS links FROM (SELECT page_id, unnest(regexp_extract_all(body, '<a href="[^"]*">')) FROM clean) GROUP BY page_id""")
def stream_links_once(spark, folder):
    """Pages arrive in small batches, twice; each page's links are stored once."""
    from pagesieve.operators.links import extract_anchors

    out, state = _scratch(spark) + "/out", _scratch(spark)
    source_path = _staged(spark, folder, "pages", ["page_id", "url", "html"])
    load(spark, folder, "pages").select("page_id", "url", "html").write.mode("append").parquet(source_path)
    stream = spark.readStream.schema("page_id long, url string, html string").option("maxFilesPerTrigger", 2).parquet(source_path)
    links = extract_anchors(stream).select("page_id", "pos", "href")
    _drain(flows.store(flows.first_only(links, ["page_id", "pos"]), out, state))
    return spark.read.parquet(out).groupBy("page_id").agg(F.count("*").alias("links"))


@query("stream_unique_urls", "SELECT DISTINCT user_id % 20 AS run_id, 'u' || (event_id % 300) AS normalized_url FROM events")
def stream_unique_urls(spark, folder):
    out, state = _scratch(spark) + "/out", _scratch(spark)
    path = _staged(spark, folder, "events", ["event_id", "ts", "user_id"])
    # every event comes again, long after its time
    load(spark, folder, "events").select("event_id", "ts", "user_id").write.mode("append").parquet(path)
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 2).parquet(path)
    keyed = stream.select((F.col("user_id") % 20).alias("run_id"), F.concat(F.lit("u"), (F.col("event_id") % 300).cast("string")).alias("normalized_url"))
    _drain(flows.store(flows.first_only(keyed, ["run_id", "normalized_url"]), out, state))
    return spark.read.parquet(out).select("run_id", "normalized_url")


@query("stream_run_timeouts", """WITH e AS (SELECT user_id % 10 AS run_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id % 10 ORDER BY ts) < INTERVAL 2 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
       s AS (SELECT run_id, ts, sum(fresh) OVER (PARTITION BY run_id ORDER BY ts) AS sid FROM e),
       b AS (SELECT run_id, min(ts) AS started, max(ts) + INTERVAL 2 MINUTE AS quiet_since, count(*) AS pages FROM s GROUP BY run_id, sid)
       SELECT * FROM b WHERE quiet_since <= (SELECT max(ts) FROM events) - INTERVAL 1 MINUTE""")
def stream_run_timeouts(spark, folder):
    """Runs that fell quiet, raised by the stream's own clock while it reads on; what is still open at its end is not."""
    out, state, path = _scratch(spark) + "/out", _scratch(spark), _scratch(spark) + "/in"
    rows = load(spark, folder, "events").select((F.col("user_id") % 10).alias("run_id"), F.col("ts").cast("timestamp").alias("ts"))
    first, last = rows.agg(F.min("ts"), F.max("ts")).first()
    step = (last - first) / 4
    for i in range(4):  # files land in the order of time
        upper = F.lit(True) if i == 3 else F.col("ts") < first + step * (i + 1)
        rows.filter((F.col("ts") >= first + step * i) & upper).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema("run_id long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(path)
    _drain(flows.store(flows.run_timeouts(stream, "ts", "2 minutes", "1 minute"), out, state))
    return spark.read.parquet(out)


@query("stream_event_log", f"WITH {EVENTS} SELECT event_id, level FROM ev WHERE level = 'error'")
def stream_event_log(spark, folder):
    out, state = _scratch(spark) + "/out", _scratch(spark)
    path = _staged(spark, folder, "events", ["event_id", "event_type"])
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    level = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "purchase", "warning").otherwise("debug")
    _drain(flows.event_log(stream.select("event_id", level.alias("level")), "error").writeStream.format("parquet").option("path", out).option("checkpointLocation", state))
    return spark.read.parquet(out)


@query("stream_run_liveness", """WITH e AS (SELECT user_id % 10 AS run_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id % 10 ORDER BY ts) < INTERVAL 2 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
       s AS (SELECT run_id, ts, sum(fresh) OVER (PARTITION BY run_id ORDER BY ts) AS sid FROM e)
       SELECT run_id, min(ts) AS started, max(ts) + INTERVAL 2 MINUTE AS quiet_since, count(*) AS pages FROM s GROUP BY run_id, sid""")
def stream_run_liveness(spark, folder):
    """Bursts of ten runs, from a stream whose rows come in any order."""
    out, state = _scratch(spark) + "/out", _scratch(spark)
    rows = load(spark, folder, "events").select((F.col("user_id") % 10).alias("run_id"), F.col("ts").cast("timestamp").alias("ts"))
    path = _scratch(spark) + "/in"
    rows.repartition(2).write.parquet(path)
    stream = spark.readStream.schema("run_id long, ts timestamp").parquet(path)
    _drain(flows.sweep(stream.writeStream.option("checkpointLocation", state).foreachBatch(flows.activity(out, "ts", 60)), None))
    return flows.run_liveness(spark.read.parquet(out), 120)
