"""How far extracted records can be trusted: rates, warnings, labels, duplicate columns.

Input is the long form of records: group keys, ordinal, field, present.
Everything is one hash aggregate per step, combined before its shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesieve.functions.text import is_present, strip_ends

LOW_SUCCESS = 0.7
MANY_FAILURES = 0.25
RISKY_FAILURES = 0.5
FULL_SITE_SUCCESS = 0.8


def field_rates(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Success and missing rate per (group, field): keys, field, n, success_rate, missing_rate."""
    rates = cells.groupBy(*keys, "field").agg(
        F.count("*").alias("n"), F.avg(F.col("present").cast("double")).alias("success_rate")
    )
    return rates.withColumn("missing_rate", 1 - F.col("success_rate"))


def field_rates_from_first_seen(cells: DataFrame, records: DataFrame, keys: list[str]) -> DataFrame:
    """Rates where a field counts as missing only from the record that first names it.

    ``cells`` holds only named fields with ``ordinal`` and ``present``;
    ``records`` is (keys, ordinal), one row per record.  Record positions are
    never numbered: the records at or after each field's first one are counted.
    """
    first = cells.groupBy(*keys, "field").agg(
        F.count_if(F.col("present")).alias("hits"), F.min("ordinal").alias("first")
    )
    counted = records.join(first, keys).groupBy(*keys, "field").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("ordinal") >= F.col("first")).alias("since"),
        F.first("hits").alias("hits"),
    )
    return counted.select(
        *keys,
        "field",
        (F.col("hits") / F.col("n")).alias("success_rate"),
        ((F.col("since") - F.col("hits")) / F.col("n")).alias("missing_rate"),
    )


def quality_label(min_rate: Column, any_low: Column, full_site: Column, failure_ratio: Column) -> Column:
    return (
        F.when(min_rate.isNull(), "unknown")
        .when(F.coalesce(failure_ratio > RISKY_FAILURES, F.lit(False)), "risky")
        .when(full_site & (min_rate < FULL_SITE_SUCCESS), "risky")
        .when(any_low, "needs_review")
        .otherwise("good")
    )


def overall(groups: DataFrame, rates: DataFrame, keys: list[str]) -> DataFrame:
    """One label per group; ``groups`` has full_site and failure_ratio columns."""
    folded = rates.groupBy(*keys).agg(
        F.min("success_rate").alias("min_rate"), F.max(F.col("success_rate") < LOW_SUCCESS).alias("low")
    )
    joined = groups.join(folded, keys, "left")
    label = quality_label(
        F.col("min_rate"), F.coalesce("low", F.lit(False)), F.col("full_site"), F.col("failure_ratio")
    )
    return joined.select(*keys, label.alias("overall"))


def warnings(groups: DataFrame, rates: DataFrame, keys: list[str], selected: list[str]) -> DataFrame:
    """Warning rows: keys, code, field, rate.

    ``groups`` has n_records and failure_ratio.  A selected field absent from
    the rates of a group that has records counts as wholly missing.
    """
    blank = F.lit(None).cast("string")
    low = rates.filter(F.col("success_rate") < LOW_SUCCESS).select(
        *keys, F.lit("FIELD_LOW_SUCCESS_RATE").alias("code"), "field", F.col("success_rate").alias("rate")
    )
    wanted = groups.filter(F.col("n_records") > 0).select(
        *keys, F.explode(F.array(*[F.lit(s) for s in selected])).alias("field")
    )
    gone = (
        wanted.join(rates.select(*keys, "field", "missing_rate"), [*keys, "field"], "left")
        .filter(F.coalesce("missing_rate", F.lit(1.0)) >= 1.0)
        .select(*keys, F.lit("REQUIRED_FIELD_MISSING").alias("code"), "field", F.lit(1.0).alias("rate"))
    )
    empty = groups.filter(F.col("n_records") == 0).select(
        *keys, F.lit("NO_RECORDS_EXTRACTED").alias("code"), blank.alias("field"), F.lit(None).cast("double").alias("rate")
    )
    failing = groups.filter(F.col("failure_ratio") > MANY_FAILURES).select(
        *keys, F.lit("MANY_PAGES_FAILED").alias("code"), blank.alias("field"), F.col("failure_ratio").alias("rate")
    )
    return low.unionByName(gone).unionByName(empty).unionByName(failing)


def duplicate_columns(records: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Field pairs equal on every record of a group and not always empty: keys, a, b.

    A column's signature is the XOR of hashes of (record, trimmed value), 128 bits
    that merge in any order; columns of equal signature are pairs.  The work is
    linear in records and fields, and neither records nor fields are paired.
    """
    tag = F.monotonically_increasing_id()
    cells = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(f).alias("field"), strip_ends(F.col(f"`{f}`").cast("string")).alias("v")) for i, f in enumerate(fields)])
    rows = records.withColumn("__tag", tag).select(*keys, "__tag", F.inline(cells))
    signed = rows.groupBy(*keys, "i", "field").agg(
        F.bit_xor(F.xxhash64("__tag", "v")).alias("__x"), F.bit_xor(F.xxhash64(F.lit(1), "v", "__tag")).alias("__y"), F.bool_or(F.coalesce("v", F.lit("")) != "").alias("__some")
    )
    alike = signed.filter("__some").groupBy(*keys, "__x", "__y").agg(F.array_sort(F.collect_list(F.struct("i", "field"))).alias("__alike"))
    first = alike.filter(F.size("__alike") > 1).select(*keys, "__alike", F.posexplode("__alike").alias("__at", "__a"))
    after = F.slice("__alike", F.col("__at") + 2, F.size("__alike"))
    pairs = first.select(*keys, F.col("__a.field").alias("a"), F.explode(F.transform(after, lambda f: f["field"])).alias("b"))
    return pairs.filter("a <> b")


def hit_rate(selected: Column, missing: Column) -> Column:
    """Share of selected fields that were found, in percent with one decimal."""
    return F.when(selected > 0, F.round((selected - missing) / selected * 100, 1)).otherwise(F.lit(0.0))


def preview_quality(cells: DataFrame, groups: DataFrame, keys: list[str], selected: list[str]) -> DataFrame:
    """Quality of a preview: keys, overall, code, field, success_rate; one row per warning, or one without code.

    ``cells`` holds the named fields of the sample rows; ``groups`` lists the
    previews.  A selected field no sample row names is missing in the preview.
    """
    rates = field_rates(cells, keys)
    label = overall(groups.select(*keys, F.lit(False).alias("full_site"), F.lit(None).cast("double").alias("failure_ratio")), rates, keys)
    low = rates.filter(F.col("success_rate") < LOW_SUCCESS).select(*keys, F.lit("FIELD_LOW_SUCCESS_RATE").alias("code"), "field", "success_rate")
    wanted = groups.select(*keys, F.explode(F.array(*[F.lit(s) for s in selected]).cast("array<string>")).alias("field"))
    gone = wanted.join(rates.select(*keys, "field"), [*keys, "field"], "left_anti").select(
        *keys, F.lit("FIELD_MISSING_IN_PREVIEW").alias("code"), "field", F.lit(None).cast("double").alias("success_rate")
    )
    return label.join(low.unionByName(gone), keys, "left")
