"""Variant, column-family and control queries over specs derived from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagesieve.functions.text import metadata_key
from pagesieve.operators import controls, variants
from pagesieve.operators.nodes import elements, place_pages
from pagesieve.plans.link_queries import rendered
from pagesieve.plans.oracle_parts import LISTED
from pagesieve.plans.registry import query
from pagesieve.sources.tables import load


def _cat(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _specs(spark, folder):
    return load(spark, folder, "supplier").select(F.col("s_suppkey").alias("spec_id"))


def _options(spark, folder):
    """Two or three option groups per spec; every fifth spec also varies by URL."""
    k = F.col("spec_id")
    none = F.lit(None).cast("string")
    rows = []

    def option(group, g_label, key, mode, i, oid, label, selected, selectors, query):
        rows.append(
            F.struct(
                F.lit(group).alias("group_idx"), F.lit(g_label).alias("group_label"), (none if key is None else F.lit(key)).alias("metadata_key"),
                F.lit(mode).alias("execution"), F.lit(i).alias("option_idx"), F.lit(oid).alias("option_id"), F.lit(label).alias("option_label"),
                selected.alias("selected"), selectors.alias("field_selectors"), query.alias("query"), F.lit(False).alias("has_recipe"),
            )
        )

    empty = F.create_map().cast("map<string,string>")
    pair = lambda a, b: F.create_map(F.lit(a), F.lit(b))
    yes = F.lit(True)
    option(0, "Units", None, "deterministic", 0, "m", "Metric", yes, empty, empty)
    option(0, "Units", None, "deterministic", 1, "i", "Imperial", yes, empty, empty)
    option(1, "Serving", None, "deterministic", 0, "", "per 100 g", yes, pair("Calories", "td:nth-child(3)"), empty)
    option(1, "Serving", None, "deterministic", 1, "", "per serving", yes, pair("Calories", "td:nth-child(5)"), empty)
    option(1, "Serving", None, "deterministic", 2, "", "per pack", k % 3 == 0, empty, empty)
    option(2, "Region", "zone", "url_param", 0, "eu", "Europe", k % 5 == 0, empty, pair("r", "eu"))
    option(2, "Region", "zone", "url_param", 1, "us", "America", k % 5 == 0, empty, pair("r", "us"))
    return _specs(spark, folder).select("spec_id", F.inline(F.array(*rows))).withColumn("max_combinations", F.lit(10))


_COMBOS = """
o0 AS (SELECT * FROM (VALUES (0, 'm', 'Metric'), (1, 'i', 'Imperial')) v(i0, id0, l0)),
o1 AS (SELECT * FROM (VALUES (0, 'per_100_g', 'per 100 g', 'td:nth-child(3)'), (1, 'per_serving', 'per serving', 'td:nth-child(5)'), (2, 'per_pack', 'per pack', NULL)) v(i1, id1, l1, sel)),
o2 AS (SELECT * FROM (VALUES (0, 'eu', 'Europe'), (1, 'us', 'America')) v(i2, id2, l2)),
three AS (SELECT s_suppkey AS spec_id, i0, i1, 0 AS i2, id0 || '__' || id1 AS id, l0 || ' · ' || l1 AS label, sel, NULL AS r, l0, l1 FROM supplier, o0, o1 WHERE s_suppkey % 5 <> 0 AND (i1 < 2 OR s_suppkey % 3 = 0)
  UNION ALL SELECT s_suppkey, i0, i1, i2, id0 || '__' || id1 || '__' || id2, l0 || ' · ' || l1 || ' · ' || l2, sel, id2, l0, l1 FROM supplier, o0, o1, o2 WHERE s_suppkey % 5 = 0 AND (i1 < 2 OR s_suppkey % 3 = 0)),
combos AS (SELECT *, row_number() OVER (PARTITION BY spec_id ORDER BY i0, i1, i2) - 1 AS combo_idx FROM three WHERE NOT (spec_id % 15 = 0))"""


@query("variant_combinations", f"""WITH {_COMBOS} SELECT spec_id, combo_idx, id AS combo_id, label, l0 AS unit_system, l1 AS serving_basis, sel AS calories, r AS region, false AS over_limit FROM combos
       UNION ALL SELECT s_suppkey, 0, NULL, NULL, NULL, NULL, NULL, NULL, true FROM supplier WHERE s_suppkey % 15 = 0""")
def variant_combinations(spark, folder):
    done = variants.combinations(_options(spark, folder), 12)
    get = lambda m, k: F.try_element_at(m, F.lit(k))
    return done.select(
        "spec_id", "combo_idx", "combo_id", "label", get("metadata", "unit_system").alias("unit_system"), get("metadata", "serving_basis").alias("serving_basis"),
        get("selectors", "Calories").alias("calories"), get("query", "r").alias("region"), "over_limit",
    )


@query("variant_field_overrides", f"""WITH {_COMBOS} SELECT spec_id, combo_idx, name, CASE WHEN name = 'f1' THEN coalesce(sel, 'td.c') ELSE 'td.' || name END AS selector
       FROM combos, (VALUES ('f1'), ('f2')) v(name)""")
def variant_field_overrides(spark, folder):
    combos = variants.combinations(_options(spark, folder), 12).filter(~F.col("over_limit"))
    listed = F.array(
        F.struct(F.lit("f1").alias("name"), F.lit("Calories").alias("label"), F.lit(None).cast("string").alias("user_label"), F.lit("td.c").alias("selector")),
        F.struct(F.lit("f2").alias("name"), F.lit("Fat").alias("label"), F.lit("Fat").alias("user_label"), F.lit("td.f2").alias("selector")),
    )
    fields = _specs(spark, folder).select("spec_id", F.inline(listed))
    return variants.override_fields(fields, combos).select("spec_id", "combo_idx", "name", "selector")


@query("variant_row_tags", f"""WITH {_COMBOS} SELECT o_orderkey, spec_id, combo_idx, l0 AS unit_system, l1 AS serving_basis FROM combos JOIN orders ON o_orderkey % (SELECT count(*) FROM supplier) = spec_id WHERE combo_idx < 2""")
def variant_row_tags(spark, folder):
    combos = variants.combinations(_options(spark, folder), 12).filter(~F.col("over_limit"))
    n = load(spark, folder, "supplier").agg(F.count("*")).scalar()
    rows = load(spark, folder, "orders").select("o_orderkey", (F.col("o_orderkey") % n).alias("spec_id"), F.explode(F.array(F.lit(0), F.lit(1))).alias("combo_idx"))
    return variants.tag_rows(rows, combos, ["unit_system", "serving_basis"])


def _variant_rows(spark, folder):
    """Eight orders make a page under two variants; some pages repeat a key, some miss a variant."""
    key, page = F.col("o_orderkey"), F.floor(F.col("o_orderkey") / 8).cast("bigint")
    rows = load(spark, folder, "orders").select(
        page.alias("page_id"), F.explode(F.array(F.lit(0), F.lit(1))).alias("combo_idx"), key.alias("row_ord"), (page % 7 != 0).alias("mergeable"),
        F.when(page % 10 == 0, F.lit("same")).otherwise(key.cast("string")).alias("name"), F.col("o_totalprice"), key,
    )
    rows = rows.filter((F.col("combo_idx") == 0) | ((F.col("o_orderkey") % 4 != 0) & (F.col("page_id") % 9 != 0)))
    price = F.when(F.col("combo_idx") == 0, F.col("o_totalprice")).otherwise(-F.col("o_totalprice"))
    return rows.withColumns({"label": F.when(F.col("combo_idx") == 0, "A").otherwise("B"), "price": price}).drop("o_totalprice", "o_orderkey")


_VROWS = """v AS (SELECT o_orderkey // 8 AS page_id, c AS combo_idx, o_orderkey AS row_ord, o_orderkey // 8 % 7 <> 0 AS mergeable, CASE WHEN o_orderkey // 8 % 10 = 0 THEN 'same' ELSE o_orderkey::VARCHAR END AS name,
   CASE c WHEN 0 THEN o_totalprice ELSE -o_totalprice END AS price FROM orders, (VALUES (0), (1)) t(c) WHERE c = 0 OR (o_orderkey % 4 <> 0 AND o_orderkey // 8 % 9 <> 0)),
 bad AS (SELECT DISTINCT page_id FROM (SELECT page_id, combo_idx, name, count(*) AS n, bool_and(mergeable) AS ok FROM v GROUP BY 1, 2, 3) WHERE n > 1 OR NOT ok)"""


@query("variant_merge", f"""WITH {_VROWS} SELECT page_id, name, row_number() OVER (PARTITION BY page_id ORDER BY min((combo_idx, row_ord))) - 1 AS record_ordinal,
       max(price) FILTER (combo_idx = 0) AS "price (A)", max(price) FILTER (combo_idx = 1) AS "price (B)" FROM v WHERE page_id NOT IN (SELECT page_id FROM bad) GROUP BY page_id, name""")
def variant_merge(spark, folder):
    return variants.merge_variants(_variant_rows(spark, folder), ["name"], ["price"], ["A", "B"])


@query("variant_unmerged_pages", f"WITH {_VROWS} SELECT page_id FROM bad")
def variant_unmerged_pages(spark, folder):
    return variants.unmerged_pages(_variant_rows(spark, folder), ["name"])


@query("variant_zero_warnings", f"""WITH {_VROWS} SELECT page_id, 'No records for variant(s): B.' AS warning FROM v GROUP BY page_id HAVING count(*) FILTER (combo_idx = 1) = 0""")
def variant_zero_warnings(spark, folder):
    rows = _variant_rows(spark, folder)
    combos = rows.select(F.col("page_id").alias("spec_id")).distinct().select(
        "spec_id", F.inline(F.array(*[F.struct(F.lit(i).alias("combo_idx"), F.lit(l).alias("label")) for i, l in ((0, "A"), (1, "B"))]))
    )
    pages = rows.select("page_id").distinct().withColumn("spec_id", F.col("page_id"))
    return variants.variant_warnings(rows, pages, combos)


@query("variant_degraded_rows", """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'Browser-rendered values for ''' || o_orderstatus || ''' could not be captured; shown values may be the page''s static defaults (stale).' END AS data_quality FROM orders""")
def variant_degraded_rows(spark, folder):
    rows = load(spark, folder, "orders").select("o_orderkey", "o_orderstatus")
    return variants.stamp_degraded(rows, F.col("o_orderstatus"), F.col("o_orderkey") % 3 == 0).drop("o_orderstatus")


@query("variant_url_pages", r"""SELECT page_id, 0 AS combo_idx, CASE WHEN url LIKE '%?page=2&ref=x' THEN page_id END AS variant_page_id FROM pages""")
def variant_url_pages(spark, folder):
    corpus = load(spark, folder, "pages").select("page_id", "url")
    pages = corpus.withColumn("spec_id", F.col("page_id"))
    combos = corpus.select(F.col("page_id").alias("spec_id"), F.lit(0).alias("combo_idx"), F.create_map(F.lit("page"), F.lit("2")).alias("query"))
    return variants.url_variants(pages, combos, corpus).select("page_id", "combo_idx", "variant_page_id")


@query("variant_metadata_key", """SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'unit_system' WHEN 1 THEN lower(c_mktsegment) || '_no_' || c_nationkey ELSE 'variant' END AS key FROM customer""")
def variant_metadata_key(spark, folder):
    k = F.col("c_custkey") % 3
    label = F.when(k == 0, "  Metric/Imperial ").when(k == 1, _cat(F.col("c_mktsegment"), " -- No. ", F.col("c_nationkey"))).otherwise("***")
    return load(spark, folder, "customer").select("c_custkey", metadata_key(label).alias("key"))


_LABELS = (
    ("Calories 2", "Calories", "num:2", "Variant 2", True), ("Calories (per 100 g)", "Calories", "per 100 g", "per 100 g", True),
    ("Serving Size (alternate column)", "Serving Size", "q:alternate column", "alternate column", False), ("Food", "Food", None, None, False),
    ("Secondary serving size", "serving size", "secondary", "Secondary", True), ("Size [first reported serving]", "Size", "first", "First reported serving", True),
    ("Weight (Metric)", "Weight", "metric", "Metric", True), ("Dose third", "Dose", "third", "Third", True),
)


def _q(v):
    return "NULL" if v is None else ("'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v).lower())


@query("variant_split_qualifier", "SELECT p_partkey, p_name || ' ' || base AS base, variant_key, option, strong FROM part JOIN (VALUES "
       + ", ".join(f"({i}, {', '.join(_q(x) for x in row[1:])})" for i, row in enumerate(_LABELS)) + ") v(i, base, variant_key, option, strong) ON p_partkey % 8 = i WHERE i <> 4 UNION ALL "
       "SELECT p_partkey, p_name || ' Secondary serving size', NULL, NULL, false FROM part WHERE p_partkey % 8 = 4")
def variant_split_qualifier(spark, folder):
    labels = F.array(*[F.lit(row[0]) for row in _LABELS])
    rows = load(spark, folder, "part").select("p_partkey", _cat(F.col("p_name"), " ", F.get(labels, (F.col("p_partkey") % 8).cast("int"))).alias("label"))
    return variants.with_qualifier(rows, "label").select("p_partkey", "base", "variant_key", "option", "strong")


# Field lists of five kinds of specs: (label, table column).
_KINDS = {
    0: (("Food", 1), ("Calories 1", 2), ("Calories 2", 4), ("Fat 1", 3), ("Fat 2", 5)),
    1: (("Serving (100g)", 2), ("Calories (per 100 g)", 3), ("Serving (alt)", 4), ("Calories (per serving)", 5)),
    2: (("Price (eur)", 2), ("Price (usd)", 3)),
    3: (("Serving size", 2), ("Calories", 3), ("Serving size (alt column)", 4), ("Calories (alt column)", 5)),
    4: (("Weight (metric)", 2), ("Weight (imperial)", 3), ("Food", 1)),
}
_OPTION_ROWS = (
    (0, 0, "Variant 1", "Calories", 2, "key"), (0, 0, "Variant 1", "Fat", 3, "key"), (0, 1, "Variant 2", "Calories", 4, "key"), (0, 1, "Variant 2", "Fat", 5, "key"),
    (1, 0, "Column 1", "Serving", 2, "position"), (1, 0, "Column 1", "Calories", 3, "position"), (1, 1, "Column 2", "Serving", 4, "position"), (1, 1, "Column 2", "Calories", 5, "position"),
    (3, 0, "default", "Serving size", 2, "key"), (3, 0, "default", "Calories", 3, "key"), (3, 1, "alt column", "Serving size", 4, "key"), (3, 1, "alt column", "Calories", 5, "key"),
    (4, 0, "metric", "Weight", 2, "key"), (4, 1, "imperial", "Weight", 3, "key"),
)


def _fields(spark, folder):
    kind = F.col("spec_id") % 5
    listed = F.lit(None)
    cast = "array<struct<field_idx:int,label:string,selector:string>>"
    for k, rows in _KINDS.items():
        arr = F.array(*[F.struct(F.lit(i).alias("field_idx"), F.lit(l).alias("label"), F.lit(f"td:nth-child({c})").alias("selector")) for i, (l, c) in enumerate(rows)])
        listed = F.when(kind == k, arr.cast(cast)).otherwise(listed)
    return _specs(spark, folder).select("spec_id", F.inline(listed))


@query("variant_column_options", "SELECT s_suppkey AS spec_id, option_idx, label, base, 'td:nth-child(' || col || ')' AS selector, aligned_by FROM supplier JOIN (VALUES "
       + ", ".join("(" + ", ".join(_q(x) for x in row) + ")" for row in _OPTION_ROWS) + ") v(kind, option_idx, label, base, col, aligned_by) ON s_suppkey % 5 = kind")
def variant_column_options(spark, folder):
    return variants.column_options(_fields(spark, folder))


_COLLAPSED = (
    (0, 0, "Food", 1), (0, 1, "Calories", 2), (0, 3, "Fat", 3), (1, 0, "Serving", 2), (1, 1, "Calories", 3), (2, 0, "Price (eur)", 2), (2, 1, "Price (usd)", 3),
    (3, 0, "Serving size", 2), (3, 1, "Calories", 3), (4, 0, "Weight", 2), (4, 2, "Food", 1),
)


@query("variant_collapsed_fields", "SELECT s_suppkey AS spec_id, field_idx, label, 'td:nth-child(' || col || ')' AS selector FROM supplier JOIN (VALUES "
       + ", ".join("(" + ", ".join(_q(x) for x in row) + ")" for row in _COLLAPSED) + ") v(kind, field_idx, label, col) ON s_suppkey % 5 = kind")
def variant_collapsed_fields(spark, folder):
    fields = _fields(spark, folder)
    return variants.collapsed_fields(fields, variants.column_options(fields))


def _cells(spark, folder):
    """Seed tables: columns 2 and 4 agree in kind 3, every other pair differs."""
    kind = F.col("spec_id") % 5
    cells = _specs(spark, folder).select("spec_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("row_idx")).select(
        "*", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("col_idx")
    )
    value = F.when((kind == 3) & F.col("col_idx").isin(2, 4), _cat("serving ", F.col("row_idx"))).otherwise(_cat(F.col("row_idx"), "/", F.col("col_idx")))
    return cells.withColumn("value", value)


@query("variant_value_agreement", """SELECT s_suppkey AS spec_id, base, NOT (kind = 3 AND base = 'Serving size') AS distinct_values, kind = 3 AND base = 'Serving size' AS same_values
       FROM supplier JOIN (VALUES (0, 'Calories'), (0, 'Fat'), (1, 'Serving'), (1, 'Calories'), (3, 'Serving size'), (3, 'Calories'), (4, 'Weight')) v(kind, base) ON s_suppkey % 5 = kind""")
def variant_value_agreement(spark, folder):
    return variants.value_agreement(variants.column_options(_fields(spark, folder)), _cells(spark, folder))


def _toggles(spark, folder):
    listed = F.array(
        F.struct(F.lit(0).alias("toggle_idx"), F.lit("serving_basis").alias("metadata_key"), F.array(F.lit("Per 100 g"), F.lit("Per serving")).alias("labels")),
        F.struct(F.lit(1).alias("toggle_idx"), F.lit("unit_system").alias("metadata_key"), F.array(F.lit("Metric"), F.lit("Imperial")).alias("labels")),
        F.struct(F.lit(2).alias("toggle_idx"), F.lit("pack").alias("metadata_key"), F.array(F.lit("One"), F.lit("Two"), F.lit("Six")).alias("labels")),
    )
    return _specs(spark, folder).select("spec_id", F.inline(listed))


@query("variant_reconcile", """SELECT s_suppkey AS spec_id, t AS toggle_idx, CASE WHEN s_suppkey % 5 = 3 AND t = 0 THEN 'merged' WHEN s_suppkey % 5 = 4 AND t = 1 THEN 'dropped' ELSE 'kept' END AS action
       FROM supplier, (VALUES (0), (1), (2)) v(t) WHERE s_suppkey % 5 <> 2""")
def variant_reconcile(spark, folder):
    columns = variants.column_options(_fields(spark, folder))
    agreement = variants.value_agreement(columns, _cells(spark, folder))
    return variants.reconcile(columns, _toggles(spark, folder), agreement).select("spec_id", "toggle_idx", "action")


@query("variant_merged_options", """SELECT s_suppkey AS spec_id, i AS option_idx, ['Per 100 g', 'Per serving'][i + 1] AS label, base, 'td:nth-child(' || (c + 2 * i) || ')' AS selector, 'mixed' AS execution
       FROM supplier, (VALUES (0), (1)) o(i), (VALUES ('Serving size', 2), ('Calories', 3)) b(base, c) WHERE s_suppkey % 5 = 3""")
def variant_merged_options(spark, folder):
    columns = variants.column_options(_fields(spark, folder))
    toggles = _toggles(spark, folder)
    actions = variants.reconcile(columns, toggles, variants.value_agreement(columns, _cells(spark, folder)))
    return variants.merged_options(columns, toggles, actions)


@query("variant_repair", """SELECT s_suppkey AS spec_id, f AS field_idx, 'tr td:nth-child(' || c || ') p' AS selector FROM supplier, (VALUES (3, 2), (4, 4)) v(f, c) WHERE s_suppkey % 2 = 0""")
def variant_repair(spark, folder):
    """Serving 1 and 2 read the same cell; odd specs have equal columns and stay as they are."""
    names = (("Food", 1), ("Calories 1", 3), ("Calories 2", 5), ("Serving 1", 2), ("Serving 2", 2))
    listed = F.array(*[F.struct(F.lit(i).alias("field_idx"), F.lit(n).alias("label"), F.lit(f"tr td:nth-child({c}) p").alias("selector")) for i, (n, c) in enumerate(names)])
    fields = _specs(spark, folder).select("spec_id", F.inline(listed))
    cells = _cells(spark, folder)
    value = F.when((F.col("spec_id") % 2 == 1) & F.col("col_idx").isin(2, 4), F.lit("equal")).otherwise(_cat("v", F.col("row_idx"), "/", F.col("col_idx")))
    return variants.repaired_selectors(fields, cells.withColumn("value", value))


@query("variant_table_cells", f"""WITH {LISTED}, r AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY p_partkey) - 1 AS row_idx, * FROM listed)
       SELECT page_id AS spec_id, row_idx, 1 AS col_idx, p_partkey::VARCHAR AS value FROM r UNION ALL SELECT page_id, row_idx, 2, p_name FROM r UNION ALL SELECT page_id, row_idx, 3, p_brand FROM r
       UNION ALL SELECT page_id, row_idx, 4, p_size::VARCHAR FROM r UNION ALL SELECT page_id, row_idx, 5, printf('$%.2f', p_retailprice) FROM r""")
def variant_table_cells(spark, folder):
    pages = place_pages(rendered(spark, folder))
    return variants.table_cells(pages, elements(pages))


def _control_pages(spark, folder):
    k = F.col("s_suppkey")
    html = _cat(
        '<html><body><nav><select name="lang"><option>EN</option><option>DE</option></select></nav>'
        '<select id="unit" aria-label="Units"><option>Metric</option><option selected>Imperial</option></select>'
        '<form><label for="r1">Per 100 g</label><input type="radio" id="r1" name="basis_choice" value="1" checked>'
        '<label>Per serving <input type="radio" name="basis_choice" value="2"></label></form>'
        '<div class="seg" data-label="Sort ', k, '"><button>Small</button><button class="x active">Large ', k, "</button></div>"
        "<div><button>Charts</button><button>More info</button></div><div><a href=\"#a\">Buy</a><a href=\"#b\">Open</a></div>"
        '<div class="top-nav"><button>Red</button><button>Blue</button></div><div><a href="https://x.example/1">North</a><a href="/2">South</a></div>'
        '<form><input type="password"><select name="x"><option>One</option><option>Two</option></select></form>'
        "<span><button>Metric</button><button>Imperial</button></span></body></html>",
    )
    return load(spark, folder, "supplier").select(k.alias("page_id"), _cat("https://c.example.com/", k).alias("url"), html.alias("html"))


@query("control_groups", """SELECT s_suppkey AS page_id, 0 AS group_idx, 'Units' AS label, 'unit_system' AS metadata_key, 'Metric|Imperial' AS labels, 1 AS default_idx FROM supplier
       UNION ALL SELECT s_suppkey, 1, 'Basis Choice', 'basis_choice', 'Per 100 g|Per serving', 0 FROM supplier
       UNION ALL SELECT s_suppkey, 2, 'Sort ' || s_suppkey, 'sort_' || s_suppkey, 'Small|Large ' || s_suppkey, 1 FROM supplier""")
def control_groups(spark, folder):
    found = controls.control_groups(_control_pages(spark, folder))
    return found.withColumn("labels", F.array_join("labels", "|"))
