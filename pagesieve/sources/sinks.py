"""Result sinks: CSV, JSON lines, Markdown; column order; export ledger; idempotent appends.

Files are written by the tasks that hold the rows.  Order inside the output
comes from a range sort on the record key, so part files read in name order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesieve.functions.text import strip_ends

LARGE_EXPORT = 10_000


def ordered_columns(spec_order: list[str], variant_columns: list[str], found: list[str]) -> list[str]:
    """Spec fields, variant columns, other keys sorted, source_url last."""
    known = [c for c in dict.fromkeys([*spec_order, *variant_columns]) if c != "source_url"]
    present = set(found)
    lead = [c for c in known if c in present]
    extras = sorted(present - set(lead) - {"source_url"})
    return lead + extras + (["source_url"] if "source_url" in present else [])


def discovered_keys(records: DataFrame, data: str) -> DataFrame:
    """Distinct keys of a map column: one row per key, never a collected list."""
    return records.select(F.explode(F.map_keys(data)).alias("key")).distinct()


def wide(records: DataFrame, data: str, columns: list[str]) -> DataFrame:
    """Map column to one column per name; absent keys are NULL."""
    return records.select("*", *[F.try_element_at(data, F.lit(c)).alias(c) for c in columns if c not in records.columns])


def write_csv(records: DataFrame, columns: list[str], order: list[str], path: str) -> None:
    """Header plus rows, NULL as empty; lines end with LF."""
    out = records.orderBy(*order).select(*[F.col(f"`{c}`") for c in columns])
    out.write.mode("overwrite").option("header", True).option("emptyValue", "").option("nullValue", "").option(
        "escape", '"'
    ).csv(path)


def write_json(records: DataFrame, columns: list[str], order: list[str], path: str) -> None:
    """One JSON object per line, NULL fields kept."""
    out = records.orderBy(*order).select(*[F.col(f"`{c}`") for c in columns])
    out.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def content_block(content: Column, source_url: Column) -> Column:
    """Markdown block of a content row; NULL when it has no text."""
    body, url = strip_ends(content), strip_ends(F.coalesce(source_url, F.lit("")))
    header = F.when(url != "", F.concat(F.lit("["), url, F.lit("]("), url, F.lit(")\n\n"))).otherwise(F.lit(""))
    return F.when(body != "", F.concat(header, body))


def table_line(columns: list[str]) -> Column:
    """One GFM table row; pipes escaped, line breaks to spaces."""
    cell = lambda c: F.trim(
        F.replace(F.replace(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
    )
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in columns]), F.lit(" |"))


def markdown_head(columns: list[str]) -> list[str]:
    return ["| " + " | ".join(columns) + " |", "| " + " | ".join("---" for _ in columns) + " |"]


def write_markdown_table(records: DataFrame, columns: list[str], order: list[str], path: str) -> None:
    """Text lines of a GFM table; the two head lines come first."""
    spark = records.sparkSession
    head = spark.createDataFrame([(i, line) for i, line in enumerate(markdown_head(columns))], "part int, line string")
    rows = records.select(*[F.col(c).alias(f"__o{i}") for i, c in enumerate(order)], table_line(columns).alias("line"))
    keyed = [F.col(f"__o{i}") for i in range(len(order))]
    both = rows.withColumn("part", F.lit(2)).unionByName(head, allowMissingColumns=True)
    both.orderBy("part", *keyed).select("line").write.mode("overwrite").text(path)


def write_markdown_content(records: DataFrame, order: list[str], path: str) -> None:
    """Content blocks separated by horizontal rules."""
    blocks = records.select(*order, content_block(F.col("content"), F.col("source_url")).alias("block"))
    out = blocks.filter(F.col("block").isNotNull()).orderBy(*order).select(F.concat("block", F.lit("\n\n---\n")))
    out.write.mode("overwrite").text(path)


def write_markdown(records: DataFrame, columns: list[str], order: list[str], path: str) -> str:
    """One Markdown export: content blocks where rows carry content, else a table; says which."""
    if "content" in records.columns and not records.filter(strip_ends(F.col("content")) != "").isEmpty():
        write_markdown_content(records, order, path)
        return "content"
    write_markdown_table(records, columns, order, path)
    return "table"


def export_ledger(runs: DataFrame, records: DataFrame, export_format: str) -> DataFrame:
    """One row per completed run: run_id, format, record_count, spec_hash, large."""
    counts = records.groupBy("run_id").agg(F.count("*").alias("record_count"))
    done = runs.filter(F.col("state") == "COMPLETED").join(counts, "run_id", "left")
    total = F.coalesce("record_count", F.lit(0))
    return done.select(
        "run_id", F.lit(export_format).alias("format"), total.alias("record_count"), "spec_hash", (total > LARGE_EXPORT).alias("large")
    )


def new_rows(incoming: DataFrame, existing: DataFrame, keys: list[str], tie: list[str]) -> DataFrame:
    """Rows to append so that each key is stored once: first by ``tie``, existing keys skipped.

    The choice among duplicates is an aggregate, so replays give the same rows.
    """
    rest = [c for c in incoming.columns if c not in keys and c not in tie]
    first = incoming.groupBy(*keys).agg(F.min(F.struct(*tie, *rest)).alias("__r"))
    rows = first.select(*keys, *[F.col(f"__r.{c}").alias(c) for c in [*tie, *rest]])
    return rows.join(existing.select(*keys), keys, "left_anti").select(*incoming.columns)
