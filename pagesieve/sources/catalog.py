"""A page corpus rendered from the relational tables.

Gives the markup operators pages whose right answer is a plain SELECT: one
catalog page per supplier, listing the parts whose key falls to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOST = "https://shop.example.com"


def _escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def _cat(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def listed_parts(part: DataFrame, supplier: DataFrame) -> DataFrame:
    """part rows with the page_id (supplier) that lists them."""
    return part.withColumn("page_id", F.col("p_partkey") % supplier.agg(F.count("*")).scalar())


def catalog_pages(part: DataFrame, supplier: DataFrame) -> DataFrame:
    """page_id, url, html: nav links, part cards, a table and prose per supplier."""
    price = F.format_string("$%.2f", F.col("p_retailprice"))
    card = _cat(
        '<li class="part-card" data-key="', F.col("p_partkey"), '"><a class="name" href="../parts/', F.col("p_partkey"),
        '">', _escape(F.col("p_name")), '</a><span class="brand">', F.col("p_brand"), '</span><b class="price">', price,
        '</b><i class="size">', F.col("p_size"), '</i><img src="/img/', F.col("p_partkey"), '.png"><em class="stock">',
        F.when(F.col("p_size") > 25, "In stock").otherwise("Out of stock"), "</em></li>",
    )
    row = _cat(
        "<tr><td>", F.col("p_partkey"), "</td><td><p>", _escape(F.col("p_name")), "</p></td><td>", F.col("p_brand"),
        "</td><td>", F.col("p_size"), "</td><td>", price, "</td></tr>",
    )
    # About parts/suppliers rows per page: the ratio is fixed by the data model.
    items = (
        listed_parts(part, supplier)
        .groupBy("page_id")
        .agg(F.array_sort(F.collect_list(F.struct("p_partkey", card.alias("card"), row.alias("row")))).alias("items"))
    )
    key = F.col("s_suppkey")
    join = lambda name: F.array_join(F.transform("items", lambda i: i[name]), "")
    html = _cat(
        "<!DOCTYPE html><html><head><title>", F.col("s_name"), ' &amp; parts</title><meta name="description" content="Parts of ',
        F.col("s_name"), '"><script type="application/ld+json">{"@type":"Organization","name":"', F.col("s_name"),
        '","extra":1}</script></head><body><nav><a href="/">Home</a><a href="#top">Top</a>'
        '<a href="mailto:desk@example.com">Mail</a><a href="https://partner.example.org/x?utm_source=shop&amp;b=1">Partner</a>'
        '<a href="/suppliers/', key + 1, '/">Next <b>supplier</b></a><a href="?page=2">2</a><a href="/suppliers/', key,
        '/">Self</a></nav><main><h1>', F.col("s_name"), '</h1><ul class="parts">', join("card"),
        '</ul><table class="spec"><thead><tr><th>Part ID</th><th>Name</th><th>Brand</th><th>Size (cm)</th><th>Price</th>'
        "</tr></thead><tbody>", join("row"), "</tbody></table></main><footer>All rights reserved</footer></body></html>",
    )
    return supplier.join(items, supplier.s_suppkey == items.page_id, "inner").select(
        key.alias("page_id"), _cat(HOST, "/suppliers/", key, "/").alias("url"), html.alias("html")
    )
