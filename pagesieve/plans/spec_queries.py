"""Queries over stored specs: every page read with the spec of its own project."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagesieve.operators import specs
from pagesieve.operators.nodes import elements, place_pages
from pagesieve.plans.link_queries import rendered
from pagesieve.plans.oracle_parts import LISTED
from pagesieve.plans.registry import query
from pagesieve.sources.tables import load


def _field(name, selector, kind="string", label=None, selected=True, required=False):
    text = lambda x: x if not isinstance(x, (str, type(None))) else F.lit(x).cast("string")
    return F.struct(
        F.lit(name).alias("name"), text(selector).alias("selector"), F.lit(kind).alias("type"), text(label).alias("label"),
        F.lit(None).cast("string").alias("user_label"), F.lit(selected).alias("selected"), F.lit(required).alias("required"),
    )


def stored_specs(spark, folder):
    """A spec for every supplier: five kinds of containers and fields, the second one reading a column of its own."""
    key = F.col("s_suppkey")
    cell = F.concat(F.lit("td:nth-child("), (F.floor(key / 5) % 4 + 1).cast("string"), F.lit(")"))
    kinds = [
        ("ul.parts > li.part-card", [_field("name", ".name", required=True), _field("price", "b.price", "number"), _field("link", "a", "url")]),
        ("tbody > tr", [_field("cell", cell), _field("brand", "tbody > tr td:nth-of-type(3)")]),
        (None, [_field("brand", "span.brand b"), _field("stock", "em.stock", "boolean")]),
        ("li::card", [_field("name", "a[href*=parts]"), _field("gone", None), _field("odd", "b::price"), _field("size", "h1 ~ ul i.size", "number"), _field("hidden", ".brand", selected=False)]),
        (".nothing", [_field("x", ".none", label="Name"), _field("y", ".none", "number", label="Price")]),
    ]
    container, fields = F.lit(None).cast("string"), None
    for i, (own, listed) in enumerate(kinds):
        mine = key % len(kinds) == i
        container = F.when(mine, F.lit(own)).otherwise(container)
        fields = F.when(mine, F.array(*listed)) if fields is None else fields.when(mine, F.array(*listed))
    return load(spark, folder, "supplier").select(key.alias("spec_id"), container.alias("container"), fields.alias("fields"))


_RECORDS = f"""WITH {LISTED}, base AS (
    SELECT *, page_id % 5 AS k, row_number() OVER (PARTITION BY page_id ORDER BY p_partkey) - 1 AS o, printf('$%.2f', p_retailprice) AS shown FROM listed),
  cells AS (
    SELECT page_id, o, 'containers' AS strategy, 'name' AS field, p_name AS value, NULL::DOUBLE AS number, NULL::BOOLEAN AS flag FROM base WHERE k = 0
    UNION ALL SELECT page_id, o, 'containers', 'price', shown, p_retailprice, NULL FROM base WHERE k = 0
    UNION ALL SELECT page_id, o, 'containers', 'link', 'https://shop.example.com/suppliers/parts/' || p_partkey, NULL, NULL FROM base WHERE k = 0
    UNION ALL SELECT page_id, o, 'containers', 'cell', CASE page_id // 5 % 4 WHEN 0 THEN p_partkey::VARCHAR WHEN 1 THEN p_name WHEN 2 THEN p_brand ELSE p_size::VARCHAR END, NULL, NULL FROM base WHERE k = 1
    UNION ALL SELECT page_id, o, 'containers', 'brand', p_brand, NULL, NULL FROM base WHERE k = 1
    UNION ALL SELECT page_id, o, 'field_index', 'brand', p_brand, NULL, NULL FROM base WHERE k = 2
    UNION ALL SELECT page_id, o, 'field_index', 'stock', CASE WHEN p_size > 25 THEN 'In stock' ELSE 'Out of stock' END, NULL, p_size > 25 FROM base WHERE k = 2
    UNION ALL SELECT page_id, o, 'field_index', 'name', p_name, NULL, NULL FROM base WHERE k = 3
    UNION ALL SELECT page_id, o, 'field_index', 'gone', NULL, NULL, NULL FROM base WHERE k = 3
    UNION ALL SELECT page_id, o, 'field_index', 'odd', NULL, NULL, NULL FROM base WHERE k = 3
    UNION ALL SELECT page_id, o, 'field_index', 'size', p_size::VARCHAR, p_size, NULL FROM base WHERE k = 3
    UNION ALL SELECT page_id, o, 'table', 'Name', p_name, NULL, NULL FROM base WHERE k = 4
    UNION ALL SELECT page_id, o, 'table', 'Price', shown, p_retailprice, NULL FROM base WHERE k = 4)
  SELECT page_id, page_id AS spec_id, o AS record_ordinal, strategy, field, value, number, flag FROM cells"""


@query("record_stored_specs", _RECORDS)
def record_stored_specs(spark, folder):
    """Each supplier's page by the supplier's own spec."""
    pages = rendered(spark, folder).withColumn("spec_id", F.col("page_id"))
    return specs.typed_values(specs.extract_stored(pages, stored_specs(spark, folder))).drop("failed")


@query(
    "record_stored_warnings",
    """SELECT s_suppkey AS spec_id, CASE s_suppkey % 5 WHEN 3 THEN 'gone has no selector.|odd selector is invalid: b::price' ELSE '' END AS field_warnings,
              CASE s_suppkey % 5 WHEN 3 THEN 'Repeated item selector is invalid: li::card' ELSE '' END AS container_warnings,
              CASE s_suppkey % 5 WHEN 0 THEN 5 WHEN 1 THEN 7 WHEN 2 THEN 4 WHEN 3 THEN 4 ELSE 2 END AS n_steps FROM supplier""",
)
def record_stored_warnings(spark, folder):
    """What the specs themselves tell, and how many steps they compile to."""
    done = specs.compile_specs(stored_specs(spark, folder))
    return done.select(
        "spec_id", F.array_join("field_warnings", "|").alias("field_warnings"), F.array_join("container_warnings", "|").alias("container_warnings"), F.size("steps").cast("long").alias("n_steps")
    )


# Selectors of the rows, filled with a number of the page.
_ROWS = {
    "li.part-card:nth-child({})": "CASE WHEN v <= n THEN 1 ELSE 0 END", "li:nth-last-child(-n+{}) > .name": "least(v, n)", "li:nth-child({}n) ~ li": "CASE WHEN v < n THEN n - v ELSE 0 END",
    "a.name + span.brand, td:nth-child({})": "n + CASE WHEN v <= 5 THEN n ELSE 0 END", "tr:not(:nth-child({})) td:first-child": "CASE WHEN v <= n THEN n - 1 ELSE n END",
    "main [data-key] em, h1 + ul": "n + 1", "nav > a[href^='/']": "3", "a:not([href^='/']):not(.name)": "4", "td:last-of-type": "n", "ul[class=parts] b": "n", "main > :only-of-type": "3", "li.part-card > :empty": "n", "meta:empty, a[href$='/']": "4",
}


@query(
    "dom_select_stored",
    f"WITH {LISTED}, c AS (SELECT page_id, count(*) AS n, page_id % 7 + 1 AS v FROM listed GROUP BY page_id), s AS ("
    + " UNION ALL ".join("SELECT page_id, replace('{}', '{{}}', v::VARCHAR) AS selector, {} AS n FROM c".format(s.replace("'", "''").replace("{}", "{}"), n) for s, n in _ROWS.items())
    + ") SELECT page_id, selector, n::BIGINT AS n FROM s WHERE n > 0",
)
def dom_select_stored(spark, folder):
    """Selectors that differ from page to page, all in one pass."""
    pages = place_pages(rendered(spark, folder))
    texts = F.transform(F.array(*map(F.lit, _ROWS)), lambda s: F.replace(s, F.lit("{}"), (F.col("page_id") % 7 + 1).cast("string")))
    asked = pages.select("page_id", F.explode(texts).alias("text")).filter("text IS NOT NULL")
    steps = specs.compile_selectors(asked).filter("tests IS NOT NULL").groupBy("page_id").agg(
        F.collect_list(F.struct(F.col("text").alias("sel"), "alt", "step", "last", "link", "next_link", "tests", F.lit(None).cast("string").alias("uses"))).alias("steps")
    )
    found = specs.select_by_steps(specs.satisfied_steps(elements(pages), steps), 3)
    return found.groupBy("page_id", F.col("sel").alias("selector")).agg(F.count("*").alias("n"))
