"""Reading the input tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


CONTENT_TYPES = ("text/html", "text/plain", "application/xhtml+xml")


def scan_pages(pages: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Bodies with hash and byte counts, whole unless a byte limit is given.

    ``truncated`` reports the pages a limit touched.  A cut that would split a
    character drops that character.
    """
    size = F.octet_length("html")
    if max_bytes is None:
        whole = pages.withColumns({"original_bytes": size.cast("bigint"), "truncated": F.lit(False)})
        return whole.withColumns({"content_hash": F.sha2("html", 256), "analyzed_bytes": size.cast("bigint")})
    cut = F.substring(F.col("html").cast("binary"), 1, max_bytes).cast("string")
    head = F.regexp_replace(F.make_valid_utf8(cut), "\ufffd$", "")
    body = F.when(size > max_bytes, head).otherwise(F.col("html"))
    out = pages.withColumns({"original_bytes": size.cast("bigint"), "truncated": size > max_bytes, "html": body})
    return out.withColumns(
        {"content_hash": F.sha2("html", 256), "analyzed_bytes": F.octet_length("html").cast("bigint")}
    )


def accepted_content_type(content_type) -> "F.Column":
    """Substring allow-list over the declared type."""
    low = F.lower(F.coalesce(content_type, F.lit("")))
    out = F.lit(False)
    for kind in CONTENT_TYPES:
        out = out | F.contains(low, F.lit(kind))
    return out
