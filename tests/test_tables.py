"""Queries beside their SQL on small tables with odd rows."""

import duckdb
import pytest
from pyspark.sql import functions as F

from pagesieve.functions.classify import error_bucket
from pagesieve.operators.variants import url_variants
from pagesieve.plans.catalogue import ORACLES, QUERIES
from tests.compare import check


def problem(spark, folder, query, **tables):
    con = duckdb.connect()
    for name, df in tables.items():
        df.coalesce(1).write.parquet(f"{folder}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet/*.parquet'")
    return check(spark, query, QUERIES, ORACLES, str(folder), con)


def test_page_outcome_of_pages_without_small_letters(spark, tmp_path):
    html = ["<!DOCTYPE html><html><body><p>" + "NDING!! ERTH!! FROM!! " * 40 + "</p></body></html>", "<html><body><p>" + "日本語 " * 99 + "</p></body></html>"]
    pages = spark.createDataFrame([(i, f"https://h.com/{i}", html[i % 2]) for i in range(60)], "page_id long, url string, html string")
    assert problem(spark, tmp_path, "ledger_page_outcome", pages=pages) is None


def test_error_bucket_of_numbers_that_are_no_status(spark, tmp_path):
    users = [429, 1429, 4290, 42, 94290]
    events = spark.createDataFrame([(i, u, k) for i, (u, k) in enumerate((u, k) for u in users for k in ("purchase", "view", "click", "signup", "error"))], "event_id long, user_id long, event_type string")
    assert problem(spark, tmp_path, "model_error_bucket", events=events) is None


@pytest.mark.parametrize("text", ["429", "HTTP 429", "HTTP/1.1 429 x", "Error code: 429 - {}", "status=429", "Client error '429'", "RateLimitError: 429", "refused (429)", "got 429", "Too Many Requests", "rate limit hit"])
def test_error_bucket_of_status_429(spark, text):
    assert spark.range(1).select(error_bucket(F.lit(text))).first()[0] == "Rate limited"


def test_url_variants_of_pages_with_one_address(spark, tmp_path):
    rows = [(5, "https://h.com/a?page=2&ref=x"), (3, "https://H.com/a?page=2&ref=x"), (9, "https://h.com/a?page=2&ref=x#f"), (4, "https://h.com/a"), (7, "https://h.com/b?page=2&ref=x")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    assert problem(spark, tmp_path, "variant_url_pages", pages=pages.filter("url NOT LIKE '%#f'")) is None
    combos = pages.select(F.col("page_id").alias("spec_id"), F.lit(0).alias("combo_idx"), F.create_map(F.lit("ref"), F.lit("x"), F.lit("page"), F.lit("2")).alias("query"))
    asked = spark.createDataFrame([(1, 4, "https://h.com/a?page=2"), (9, 9, "https://h.com/a?page=2&ref=x#f")], "page_id long, spec_id long, url string")
    assert {(r.page_id, r.variant_page_id) for r in url_variants(asked, combos, pages).collect()} == {(1, 3), (9, 9)}
