"""Element table, selection, records, tables, content and profile queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pagesieve.functions.text import coerced, to_boolean
from pagesieve.operators import content, profile, prompts, records
from pagesieve.operators.nodes import attr, elements, place_pages, with_texts
from pagesieve.operators.records import FieldSpec
from pagesieve.operators.select import select_elements
from pagesieve.operators.specs import relaxed_column
from pagesieve.plans.link_queries import rendered, stored
from pagesieve.plans.oracle_parts import CLEAN, LISTED, SUMMARIES
from pagesieve.plans.registry import query
from pagesieve.sources.tables import load

_AROUND = {mode: text.replace("'", "''").split(prompts.SUMMARY) for mode, text in prompts.TEMPLATES.items()}
_TAGS = ("nav", "ul", "li", "a", "article", "h1", "p", "b", "br", "div", "footer", "title", "body")


@query(
    "dom_elements",
    f"WITH {CLEAN} "
    + " UNION ALL ".join(
        f"SELECT page_id, '{t}' AS tag, len(regexp_extract_all(body, '<{t}[ >]')) AS n FROM clean WHERE regexp_matches(body, '<{t}[ >]')"
        for t in _TAGS
    ),
)
def dom_elements(spark, folder):
    nodes = elements(place_pages(stored(spark, folder)))
    return nodes.filter(F.col("tag").isin(*_TAGS)).groupBy("page_id", "tag").agg(F.count("*").alias("n"))


@query(
    "dom_parents",
    f"""WITH {CLEAN}, a AS (SELECT page_id, body, regexp_extract(body, '(?s)<article>.*</article>') AS art, regexp_extract(body, '(?s)<nav>.*</nav>') AS nav FROM clean),
        pairs AS (
          SELECT page_id, 'nav>ul' AS edge, len(regexp_extract_all(nav, '<ul>')) AS n FROM a
          UNION ALL SELECT page_id, 'ul>li', len(regexp_extract_all(nav, '<li>')) FROM a
          UNION ALL SELECT page_id, 'li>a', len(regexp_extract_all(nav, '<a ')) FROM a
          UNION ALL SELECT page_id, 'article>p', len(regexp_extract_all(art, '<p>')) FROM a
          UNION ALL SELECT page_id, 'article>h1', len(regexp_extract_all(art, '<h1>')) FROM a
          UNION ALL SELECT page_id, 'p>b', len(regexp_extract_all(art, '<p><b>')) FROM a
          UNION ALL SELECT page_id, 'b>br', len(regexp_extract_all(art, '<br>')) FROM a)
        SELECT page_id, edge, n FROM pairs WHERE n > 0""",
)
def dom_parents(spark, folder):
    from pagesieve.operators.nodes import with_parent_value

    nodes = with_parent_value(elements(place_pages(stored(spark, folder))), F.col("tag"), "parent")
    edge = F.concat("parent", F.lit(">"), "tag")
    kept = nodes.withColumn("edge", edge).filter(
        F.col("edge").isin("nav>ul", "ul>li", "li>a", "article>p", "article>h1", "p>b", "b>br")
    )
    return kept.groupBy("page_id", "edge").agg(F.count("*").alias("n"))


@query(
    "dom_text",
    f"""WITH {CLEAN}, t AS (SELECT page_id, unnest(regexp_extract_all(body, '<p>([^<]*)</p>', 1)) AS t FROM clean)
        SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '\\s+', ' ', 'g')) AS text
        FROM t WHERE trim(t) <> ''""",
)
def dom_text(spark, folder):
    """Text of every paragraph that holds nothing but text."""
    pages = place_pages(stored(spark, folder))
    nodes = elements(pages)
    inner = F.lead("open_pos").over(Window.partitionBy("page_id").orderBy("open_pos"))
    leaves = nodes.withColumn("next", inner).filter(
        (F.col("tag") == "p") & (F.coalesce(F.col("next"), F.lit(2_000_000_000)) > F.col("close_pos")) & (F.col("close_pos") % 2 == 0)
    )
    return with_texts(leaves, pages).filter(F.col("text").isNotNull()).select("page_id", "text")


_SELECTORS = {
    "ul.parts > li.part-card": "n", "li.part-card a": "n", "a": "n + 7", "[data-key]": "n", "main li:nth-child(1) .name": "1",
    "td:nth-child(3)": "n", "tr > td:nth-of-type(2) p": "n", "thead th, tbody td": "5 * n + 5", "a[href^='/']": "3",
    "a[href*=parts]": "n", "nav > a": "7", "main, footer": "2", "table.spec tbody tr": "n", "ul[class=parts] b.price": "n", "#none": "0",
}


@query(
    "dom_select",
    f"WITH {LISTED}, c AS (SELECT page_id, count(*) AS n FROM listed GROUP BY 1) "
    + " UNION ALL ".join(
        "SELECT page_id, '{}' AS selector, {} AS n FROM c".format(s.replace("'", "''"), n) for s, n in _SELECTORS.items() if n != "0"
    ),
)
def dom_select(spark, folder):
    from pagesieve.operators.select import select_many

    nodes = elements(place_pages(rendered(spark, folder)))
    return select_many(nodes, {s: s for s in _SELECTORS}).groupBy("page_id", F.col("key").alias("selector")).agg(F.count("*").alias("n"))


@query(
    "dom_selector_counts",
    f"""WITH {LISTED} SELECT page_id, count(*) * 2 AS n_elements, count(*) AS n_anchors FROM listed GROUP BY page_id""",
)
def dom_selector_counts(spark, folder):
    return records.selector_counts(elements(place_pages(rendered(spark, folder))), "a.name, span.brand")


@query(
    "dom_relaxed_selectors",
    """WITH s AS (SELECT p_partkey, 'td:nth-child(' || p_size || ')' AS cell FROM part)
       SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN cell || ' p span|' || cell || ' p|' || cell WHEN 1 THEN cell || ' > span' WHEN 2 THEN cell || ' em p.x'
         WHEN 3 THEN cell ELSE cell || ' + b i|' || cell || ' + b' END AS options FROM s""",
)
def dom_relaxed_selectors(spark, folder):
    """Selectors held in a column: trailing wrappers go, a dangling combinator stays out."""
    tails = F.array(*map(F.lit, (" p span", " > span", " em p.x", "", " + b i")))
    selector = F.concat(F.lit("td:nth-child("), F.col("p_size").cast("string"), F.lit(")"), F.get(tails, (F.col("p_partkey") % 5).cast("int")))
    return load(spark, folder, "part").select("p_partkey", F.array_join(relaxed_column(selector), "|").alias("options"))


@query(
    "dom_attribute_values",
    f"""WITH {LISTED} SELECT page_id, p_partkey::VARCHAR AS data_key, 'part-card' AS class_name FROM listed""",
)
def dom_attribute_values(spark, folder):
    nodes = select_elements(elements(place_pages(rendered(spark, folder))), "li[data-key]")
    return nodes.select("page_id", attr("data-key").alias("data_key"), attr("class").alias("class_name"))


# --- records --------------------------------------------------------------------------

_SIBLINGS = {
    "li.part-card:last-child": "1", "li.part-card:first-child": "1", "li.part-card:not(:last-child)": "n - 1", "a:not([href^='/']):not(.name)": "4",
    "ul.parts > li:nth-child(odd)": "(n + 1) // 2", "li:nth-child(2n)": "n // 2", "li:nth-child(3n+2)": "(n + 1) // 3", "li:nth-last-child(-n+2)": "least(n, 2)",
    "h1 + ul.parts": "1", "h1 + ul.parts > li": "n", "h1 ~ table": "1", "a.name + span": "n", "a.name ~ em.stock": "n", "a.name + em": "0",
    "td:last-of-type": "n", "main > :not(h1, ul)": "1", "b.price ~ :not(i)": "2 * n",
}


@query(
    "dom_select_siblings",
    f"WITH {LISTED}, c AS (SELECT page_id, count(*) AS n FROM listed GROUP BY 1), s AS ("
    + " UNION ALL ".join(
        "SELECT page_id, '{}' AS selector, {} AS n FROM c".format(s.replace("'", "''"), n) for s, n in _SIBLINGS.items()
    )
    + ") SELECT * FROM s WHERE n > 0",
)
def dom_select_siblings(spark, folder):
    from pagesieve.operators.select import select_many

    nodes = elements(place_pages(rendered(spark, folder)))
    return select_many(nodes, {s: s for s in _SIBLINGS}).groupBy("page_id", F.col("key").alias("selector")).agg(F.count("*").alias("n"))


CARD_FIELDS = [
    FieldSpec("name", "li.part-card .name", required=True),
    FieldSpec("brand", ".brand span"),
    FieldSpec("price", "b.price", "number"),
    FieldSpec("size", "i.size", "number"),
    FieldSpec("in_stock", "em.stock", "boolean"),
    FieldSpec("link", "a.name", "url"),
    FieldSpec("image", "img", "image"),
    FieldSpec("missing", ".absent"),
    FieldSpec("skipped", ".brand", selected=False),
]

_CARDS = f"""WITH {LISTED} SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY p_partkey) - 1 AS record_ordinal,
  'https://shop.example.com/suppliers/' || page_id || '/' AS source_url, p_name AS name, p_brand AS brand,
  p_retailprice AS price, p_size::DOUBLE AS size, p_size > 25 AS in_stock,
  'https://shop.example.com/suppliers/parts/' || p_partkey AS link, 'https://shop.example.com/img/' || p_partkey || '.png' AS image,
  NULL::VARCHAR AS missing FROM listed"""


@query("record_containers", _CARDS)
def record_containers(spark, folder):
    pages = place_pages(rendered(spark, folder))
    found = records.from_containers(pages, elements(pages), CARD_FIELDS, "li.part-card")
    return records.typed(found, CARD_FIELDS).drop("strategy", "warnings", "price__text", "size__text", "in_stock__text")


@query(
    "record_bad_container",
    f"""WITH {LISTED} SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY p_partkey) - 1 AS record_ordinal, 'field_index' AS strategy, p_name AS name,
          'gone has no selector.|' || 'odd selector is invalid: b::price|Repeated item selector is invalid: li::card' AS warnings FROM listed""",
)
def record_bad_container(spark, folder):
    """An unreadable container falls through to aligned fields; every record carries the warnings."""
    pages = place_pages(rendered(spark, folder))
    fields = [FieldSpec("name", "a.name"), FieldSpec("gone"), FieldSpec("odd", "b::price"), FieldSpec("brand", ".brand")]
    found = records.extract_structured(pages, elements(pages), fields, "li::card")
    return found.select("page_id", "record_ordinal", "strategy", "name", F.array_join("warnings", "|").alias("warnings"))


@query(
    "record_containers_capped",
    f"""WITH {LISTED} SELECT page_id, p_name AS name FROM listed QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY p_partkey) <= 4""",
)
def record_containers_capped(spark, folder):
    pages = place_pages(rendered(spark, folder))
    found = records.from_containers(pages, elements(pages), CARD_FIELDS[:1], "li.part-card", max_records=4)
    return found.select("page_id", "name")


@query(
    "record_required_filter",
    f"""WITH {LISTED} SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY p_partkey) - 1 AS record_ordinal, p_name AS name
        FROM listed WHERE p_size % 3 <> 0""",
)
def record_required_filter(spark, folder):
    """Cards without a price element are dropped when price is required."""
    part = load(spark, folder, "part")
    pages = rendered(spark, folder)
    thirds = "|".join(str(n) for n in range(0, 200, 3))
    bare = F.regexp_replace("html", rf'<b class="price">[^<]*</b>(<i class="size">(?:{thirds})</i>)', "$1")
    pages = place_pages(pages.withColumn("html", bare))
    fields = [FieldSpec("name", ".name"), FieldSpec("price", "b.price", required=True)]
    return records.from_containers(pages, elements(pages), fields, "li.part-card").select("page_id", "record_ordinal", "name")


@query(
    "record_field_index",
    f"""WITH {LISTED} SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY p_partkey) - 1 AS record_ordinal,
          p_name AS name, p_brand AS brand, printf('$%.2f', p_retailprice) AS price FROM listed""",
)
def record_field_index(spark, folder):
    pages = place_pages(rendered(spark, folder))
    fields = [FieldSpec("name", "a.name"), FieldSpec("brand", ".brand"), FieldSpec("price", "b.price span")]
    return records.by_field_index(pages, elements(pages), fields).select("page_id", "record_ordinal", "name", "brand", "price")


TABLE_FIELDS = [
    FieldSpec("x1", ".none", label="Item Name"),
    FieldSpec("x2", ".none", "number", label="price"),
    FieldSpec("x3", ".none", "number", label="ID"),
    FieldSpec("x4", ".none", label="Maker", required=True),
    FieldSpec("x5", ".none", label="Size"),
    FieldSpec("x6", ".none", label="Beyond"),
]


@query(
    "record_table",
    f"""WITH {LISTED} SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY p_partkey) - 1 AS record_ordinal,
          p_name AS "Item Name", p_retailprice AS price, p_partkey::DOUBLE AS "ID", p_brand AS "Maker", p_size::VARCHAR AS "Size",
          NULL::VARCHAR AS "Beyond" FROM listed""",
)
def record_table(spark, folder):
    pages = place_pages(rendered(spark, folder))
    found = records.typed(records.from_tables(pages, elements(pages), TABLE_FIELDS), TABLE_FIELDS)
    return found.select("page_id", "record_ordinal", "Item Name", "price", "ID", "Maker", "Size", "Beyond")


@query(
    "record_best_table",
    f"""WITH {LISTED} SELECT page_id, count(*) + 1 AS n_rows, 5 AS n_cols, 'Part ID,Name,Brand,Size (cm),Price' AS headers FROM listed GROUP BY page_id""",
)
def record_best_table(spark, folder):
    pages = place_pages(rendered(spark, folder))
    tables = records.page_tables(pages, elements(pages))
    return tables.select("page_id", "n_rows", F.col("n_cols"), F.array_join("headers", ",").alias("headers"))


@query(
    "record_header_score",
    """WITH pairs AS (SELECT p.p_partkey, p_name AS h, p_type || ' ' || p_name AS f FROM part p)
       SELECT p_partkey, CASE WHEN lower(regexp_replace(h, '[^A-Za-z0-9]+', '', 'g')) = lower(regexp_replace(p_type, '[^A-Za-z0-9]+', '', 'g')) THEN 100 ELSE
         50 + (SELECT sum(len(w)) FROM (SELECT DISTINCT unnest(string_split(lower(h), ' ')) AS w)) END AS contained, 0 AS unrelated,
         100 AS same, 50 + 8 + 4 AS aliased FROM pairs JOIN part USING (p_partkey)""",
)
def record_header_score(spark, folder):
    name, kind = F.col("p_name"), F.col("p_type")
    return load(spark, folder, "part").select(
        "p_partkey",
        records.header_score(F.concat(kind, F.lit(" "), name), name).cast("bigint").alias("contained"),
        records.header_score(F.lit("Physical Activity"), F.concat(F.lit("cal"), F.substring("p_brand", 1, 0))).alias("unrelated"),
        records.header_score(name, F.upper(name)).alias("same"),
        records.header_score(F.lit("Calories kcal"), F.concat(F.lit("kcal"), F.substring("p_brand", 1, 0))).alias("aliased"),
    )


def mixed_pages(spark, folder):
    """Catalog pages in three states: as is, without card classes, without any class."""
    k = F.col("page_id") % 3
    html = (
        F.when(k == 1, F.replace("html", F.lit("part-card"), F.lit("x")))
        .when(k == 2, F.replace("html", F.lit("class="), F.lit("data-c=")))
        .otherwise(F.col("html"))
    )
    return place_pages(rendered(spark, folder).withColumn("html", html))


LADDER_FIELDS = [FieldSpec("Name", "a.name"), FieldSpec("Brand", ".brand"), FieldSpec("Price", "b.price")]


@query(
    "record_strategy_ladder",
    f"""WITH {LISTED} SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY p_partkey) - 1 AS record_ordinal,
          CASE page_id % 3 WHEN 0 THEN 'containers' WHEN 1 THEN 'field_index' ELSE 'table' END AS strategy,
          p_name AS "Name", p_brand AS "Brand", printf('$%.2f', p_retailprice) AS "Price" FROM listed""",
)
def record_strategy_ladder(spark, folder):
    pages = mixed_pages(spark, folder)
    found = records.extract_structured(pages, elements(pages), LADDER_FIELDS, "li.part-card")
    return found.select("page_id", "record_ordinal", "strategy", "Name", "Brand", "Price")


@query(
    "record_sample_values",
    f"""WITH {LISTED} SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY p_partkey) - 1 AS row_idx, p_brand AS value
        FROM listed QUALIFY row_idx < 6""",
)
def record_sample_values(spark, folder):
    pages = place_pages(rendered(spark, folder))
    field = FieldSpec("brand", "li.part-card span.brand b")
    return records.sample_values(pages, elements(pages), field, "li.part-card", 6)


@query(
    "record_selector_check",
    """WITH f AS (SELECT * FROM (VALUES ('good', '.brand', true, false), ('long', 'b.price', true, true), ('bad', '.absent', false, false)) v(field, selector, m, r))
       SELECT s_suppkey AS page_id, field, CASE WHEN s_suppkey % 3 = 2 AND field = 'long' THEN 'b.price span' ELSE selector END AS selector,
              s_suppkey % 3 = 0 AS container_matched, s_suppkey % 3 <> 2 AND m AS matched, s_suppkey % 3 <> 2 AND r AS relaxed,
              CASE WHEN s_suppkey % 3 <> 2 AND m THEN 0.9 ELSE 0.3 END AS confidence,
              CASE WHEN s_suppkey % 3 = 0 THEN 0.8 ELSE 0.4 END AS analysis_confidence
       FROM supplier, f WHERE s_suppkey < (SELECT count(*) FROM part)""",
)
def record_selector_check(spark, folder):
    nodes = elements(mixed_pages(spark, folder))
    fields = [FieldSpec("good", ".brand"), FieldSpec("long", "b.price span"), FieldSpec("bad", ".absent")]
    checked = records.check_selectors(nodes, fields, "li.part-card")
    return checked.withColumns(
        {
            "confidence": records.lint_confidence(F.lit(0.9), F.col("matched")),
            "analysis_confidence": records.analysis_confidence(F.lit(0.8), F.col("container_matched")),
        }
    )


@query(
    "record_by_variant",
    f"""WITH {LISTED}, v AS (SELECT * FROM (VALUES (0, 'Brand view', 'brand'), (1, 'Price view', 'price')) t(combo_idx, variant, axis))
        SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY combo_idx, p_partkey) - 1 AS record_ordinal, variant, axis, p_name AS name,
               CASE combo_idx WHEN 0 THEN p_brand ELSE printf('$%.2f', p_retailprice) END AS value FROM listed, v""",
)
def record_by_variant(spark, folder):
    pages = place_pages(rendered(spark, folder))
    fields = [FieldSpec("name", "a.name", required=True), FieldSpec("value", ".brand")]
    combos = [
        {"label": "Brand view", "metadata": {"axis": "brand"}, "selectors": {}},
        {"label": "Price view", "metadata": {"axis": "price"}, "selectors": {"value": "b.price"}},
    ]
    found = records.from_containers_by_variant(pages, elements(pages), fields, "li.part-card", combos)
    return found.select("page_id", "record_ordinal", "variant", "axis", "name", "value")


@query(
    "record_coerce_number",
    """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 3 THEN NULL WHEN 2 THEN 4.75 * 0 + cast('4.75' || (o_orderkey % 1000) AS DOUBLE)
              ELSE round(o_totalprice, 2) END AS value_num,
              o_orderkey % 4 = 3 AS failed, o_orderkey % 4 = 2 AS suspect, CASE WHEN o_orderkey % 4 = 3 THEN '1-' || o_orderkey END AS value_str FROM orders""",
)
def record_coerce_number(spark, folder):
    k, price = F.col("o_orderkey") % 4, F.col("o_totalprice")
    text = (
        F.when(k == 0, F.concat(F.lit("$"), F.format_number(price, 2)))
        .when(k == 1, F.concat(F.format_string("%.2f", price), F.lit(" EUR")))
        .when(k == 2, F.concat(F.lit("4.7/5 ("), (F.col("o_orderkey") % 1000).cast("string"), F.lit(" reviews)")))
        .otherwise(F.concat(F.lit("1-"), F.col("o_orderkey").cast("string")))
    )
    done = coerced(text, F.lit("number"))
    return load(spark, folder, "orders").select(
        "o_orderkey", *[done[c].alias(c) for c in ("value_num", "failed", "suspect", "value_str")]
    )


@query(
    "record_coerce_boolean",
    """SELECT event_id, CASE event_type WHEN 'click' THEN true WHEN 'view' THEN false WHEN 'error' THEN true END AS flag FROM events""",
)
def record_coerce_boolean(spark, folder):
    text = (
        F.when(F.col("event_type") == "click", " In Stock ")
        .when(F.col("event_type") == "view", "OUT OF STOCK")
        .when(F.col("event_type") == "error", "1")
        .otherwise("maybe")
    )
    return load(spark, folder, "events").select("event_id", to_boolean(text).alias("flag"))


# --- content and profile --------------------------------------------------------------


_UNESCAPE = "replace(replace(replace(replace({}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&')"
_ARTICLE = f"""{CLEAN}, art AS (SELECT page_id, url, regexp_extract(body, '(?s)<article>(.*)</article>', 1) AS a FROM clean)"""


@query(
    "content_readable_text",
    f"""WITH {_ARTICLE}, lines AS (SELECT page_id, list_filter(list_transform(string_split(regexp_replace(a, '<[^>]*>', chr(10), 'g'), chr(10)),
            lambda l: trim(regexp_replace({_UNESCAPE.format('l')}, '[ \\t\\r\\f\\v]+', ' ', 'g'))), lambda l: l <> '') AS l FROM art)
        SELECT page_id, array_to_string(l, chr(10)) AS text FROM lines WHERE len(l) > 0""",
)
def content_readable_text(spark, folder):
    pages = place_pages(stored(spark, folder))
    return content.readable_text(pages, elements(pages))


_MARKED = (
    "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(a, '\\s+', ' ', 'g'), '<h1>', '\n\n# ', 'g'), "
    "'<p><b>([^<]*?)\\s*<br>', '\n\n**\\1**', 'g'), '</?p>|</h1>', '\n\n', 'g'), '</?b>', '', 'g')"
)


@query(
    "content_records",
    f"""WITH {_ARTICLE}, md AS (SELECT page_id, url, trim(regexp_replace(regexp_replace(regexp_replace({_UNESCAPE.format(_MARKED)}, '[ \\t]+\n', '\n', 'g'),
            '\n[ \\t]+', '\n', 'g'), '\n{{3,}}', '\n\n', 'g'), E' \n') AS content FROM art)
        SELECT page_id, url AS source_url, content, len(content) < 200 AS short FROM md WHERE content <> ''""",
)
def content_records(spark, folder):
    pages = place_pages(stored(spark, folder))
    found = content.content_records(pages, elements(pages))
    return found.select("page_id", "source_url", "content", (F.size("warnings") > 0).alias("short"))


@query(
    "content_markdown_catalog",
    f"""WITH {LISTED} SELECT page_id, '# ' || s_name || chr(10) || chr(10) || (SELECT string_agg('- [' || p_name || '](../parts/' || p_partkey || ')' || p_brand
            || '**' || printf('$%.2f', p_retailprice) || '***' || p_size || '**' || CASE WHEN p_size > 25 THEN 'In stock' ELSE 'Out of stock' END || '*', chr(10) ORDER BY p_partkey)
            FROM listed l WHERE l.page_id = shop.page_id) || chr(10) || chr(10) || '| Part ID | Name | Brand | Size (cm) | Price |' || chr(10) || '| --- | --- | --- | --- | --- |' || chr(10)
            || (SELECT string_agg('| ' || p_partkey || ' | ' || p_name || ' | ' || p_brand || ' | ' || p_size || ' | ' || printf('$%.2f', p_retailprice) || ' |', chr(10) ORDER BY p_partkey)
            FROM listed l WHERE l.page_id = shop.page_id) AS text FROM shop""",
)
def content_markdown_catalog(spark, folder):
    """The whole catalog main block: list and table."""
    pages = place_pages(rendered(spark, folder))
    nodes = elements(pages)
    return content.markdown(pages, nodes, primary="main")


@query(
    "content_legacy_text",
    f"""WITH {CLEAN}, p AS (SELECT page_id, regexp_extract(body, '<title>([^<]*)</title>', 1) AS title,
             regexp_replace(regexp_replace(body, '(?s)<nav>.*?</nav>', '', 'g'), '(?s)<footer>.*?</footer>', '', 'g') AS b FROM clean),
        l AS (SELECT page_id, title, list_filter(list_transform(string_split(regexp_replace(regexp_replace(b, '<![^>]*>', '', 'g'), '<[^>]*>', chr(1), 'g'), chr(1)),
                 lambda x: trim({_UNESCAPE.format('x')}, E' \n\t\r')), lambda x: x <> '') AS l FROM p)
        SELECT page_id, 'Title: ' || trim(regexp_replace({_UNESCAPE.format('title')}, '\\s+', ' ', 'g')) || chr(10) || chr(10) || array_to_string(l, chr(10)) AS content FROM l""",
)
def content_legacy_text(spark, folder):
    pages = place_pages(stored(spark, folder))
    return content.legacy_text(pages, elements(pages))


@query(
    "profile_head",
    f"""WITH {LISTED} SELECT page_id, s_name || ' & parts' AS title, 'Parts of ' || s_name AS meta_description, 'Organization' AS ld_type, s_name AS ld_name FROM shop""",
)
def profile_head(spark, folder):
    found = profile.head_facts(rendered(spark, folder), profile.BRIEF)
    return found.select(
        "page_id", "title", "meta_description", F.get("json_ld", F.lit(0))["type"].alias("ld_type"), F.get("json_ld", F.lit(0))["name"].alias("ld_name")
    )


@query(
    "profile_headings",
    f"""WITH {CLEAN} SELECT page_id, 1 AS rank, 'h1' AS tag, left(trim({_UNESCAPE.format("regexp_extract(body, '<h1>([^<]*)</h1>', 1)")}), 200) AS text FROM clean""",
)
def profile_headings(spark, folder):
    pages = place_pages(stored(spark, folder))
    return profile.headings(pages, elements(pages), profile.BRIEF)


_FIVE = "('name', 1), ('brand', 2), ('price', 3), ('size', 4), ('stock', 5)"


@query(
    "profile_repeated_classes",
    f"""WITH {LISTED}, c AS (SELECT page_id, count(*) AS n FROM listed GROUP BY 1 HAVING count(*) >= 3),
        k AS (SELECT * FROM (VALUES ('part-card', 1), ('name', 2), ('brand', 3), ('price', 4), ('size', 5), ('stock', 6)) v(class, rank))
        SELECT page_id, rank, class, n, CASE WHEN rank > 5 THEN NULL ELSE CASE class WHEN 'part-card' THEN 'li' WHEN 'name' THEN 'a' WHEN 'brand' THEN 'span' WHEN 'price' THEN 'b' ELSE 'i' END || '.' || class END AS selector_hint
        FROM c, k""",
)
def profile_repeated_classes(spark, folder):
    pages = place_pages(rendered(spark, folder))
    nodes = elements(pages)
    hints = profile.class_samples(pages, nodes, profile.BRIEF).select("page_id", "class", "selector_hint")
    return profile.repeated_classes(nodes, profile.BRIEF).join(hints, ["page_id", "class"], "left").select("page_id", "rank", "class", "n", "selector_hint")


@query(
    "profile_table_samples",
    f"""WITH {LISTED}, r AS (SELECT page_id, 1 + row_number() OVER (PARTITION BY page_id ORDER BY p_partkey) AS row_idx,
            p_partkey || ' | ' || p_name || ' | ' || p_brand || ' | ' || p_size || ' | ' || printf('$%.2f', p_retailprice) AS line FROM listed)
        SELECT page_id, 1 AS table_idx, row_idx, line FROM r WHERE row_idx <= 3
        UNION ALL SELECT page_id, 1, 1, 'Part ID | Name | Brand | Size (cm) | Price' FROM shop""",
)
def profile_table_samples(spark, folder):
    pages = place_pages(rendered(spark, folder))
    return profile.table_samples(pages, elements(pages), profile.BRIEF)


@query(
    "profile_data_attributes",
    f"WITH {LISTED} SELECT page_id, 1 AS rank, 'data-key' AS name, min(p_partkey)::VARCHAR AS value FROM listed GROUP BY page_id",
)
def profile_data_attributes(spark, folder):
    return profile.data_attributes(elements(place_pages(rendered(spark, folder))), profile.BRIEF)


@query(
    "profile_paging_candidates",
    f"""WITH {LISTED} SELECT page_id, 1 AS rank, 'a' AS selector FROM shop""",
)
def profile_paging_candidates(spark, folder):
    pages = place_pages(rendered(spark, folder))
    return profile.paging_candidates(pages, elements(pages), profile.BRIEF)


@query(
    "profile_sample_links",
    f"""WITH {CLEAN}, a AS (SELECT page_id, unnest(regexp_extract_all(body, '<a href="[^"]*">[^<]*</a>')) AS a, generate_subscripts(regexp_extract_all(body, '<a href="[^"]*">[^<]*</a>'), 1) AS rank FROM clean)
        SELECT page_id, rank, trim(regexp_extract(a, '>([^<]*)<', 1)) AS text, left(regexp_extract(a, 'href="([^"]*)"', 1), 80) AS href FROM a
        WHERE rank <= 12 AND trim(regexp_extract(a, '>([^<]*)<', 1)) <> ''""",
)
def profile_sample_links(spark, folder):
    pages = place_pages(stored(spark, folder))
    return profile.sample_links(pages, elements(pages), profile.BRIEF)


@query(
    "profile_snippet",
    f"""WITH {CLEAN} SELECT page_id, left(trim(regexp_replace({_UNESCAPE.format("replace(replace(regexp_replace(regexp_extract(body, '(?s)<body>(.*)', 1), '<[^>]*>', ' ', 'g'), '&copy;', '©'), '&middot;', '·')")}, '\\s+', ' ', 'g')), 600) AS snippet FROM clean""",
)
def profile_snippet(spark, folder):
    pages = place_pages(stored(spark, folder))
    return profile.body_snippet(pages, elements(pages), profile.BRIEF)


@query("profile_summary", f"WITH {SUMMARIES} SELECT page_id, summary FROM summaries")
def profile_summary(spark, folder):
    """Whole summary text per catalog page."""
    return profile.summary(rendered(spark, folder), profile.BRIEF)


@query(
    "analysis_prompt",
    f"WITH {SUMMARIES} SELECT page_id, CASE page_id % 3 WHEN 0 THEN '{_AROUND['STRUCTURED'][0]}' ELSE '{_AROUND['CONTENT'][0]}' END || summary"
    f" || CASE page_id % 3 WHEN 0 THEN '{_AROUND['STRUCTURED'][1]}' ELSE '{_AROUND['CONTENT'][1]}' END AS prompt FROM summaries",
)
def analysis_prompt(spark, folder):
    """The instruction of the page's mode around its summary."""
    mode = F.when(F.col("page_id") % 3 == 0, "structured").when(F.col("page_id") % 3 == 1, "CONTENT").otherwise("other")
    return prompts.analysis_prompts(rendered(spark, folder), mode)


@query(
    "profile_alternate_mode",
    f"""WITH {LISTED}, n AS (SELECT page_id, count(*) AS n FROM listed GROUP BY 1)
        SELECT page_id, CASE WHEN page_id % 2 = 0 AND n >= 2 THEN 'STRUCTURED' END AS suggestion FROM shop JOIN n USING (page_id)""",
)
def profile_alternate_mode(spark, folder):
    pages = place_pages(rendered(spark, folder))
    mode = F.when(F.col("page_id") % 2 == 0, "CONTENT").otherwise("structured")
    return profile.alternate_mode(pages, elements(pages), mode)


@query(
    "profile_alternate_mode_articles",
    "SELECT page_id, CASE WHEN page_id % 2 = 1 THEN 'CONTENT' END AS suggestion FROM pages",
)
def profile_alternate_mode_articles(spark, folder):
    pages = place_pages(stored(spark, folder))
    mode = F.when(F.col("page_id") % 2 == 0, "CONTENT").otherwise("STRUCTURED")
    return profile.alternate_mode(pages, elements(pages), mode)
