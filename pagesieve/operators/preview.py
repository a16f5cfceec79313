"""Sample previews, their freshness, and the default spec of an analysis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagesieve.functions.text import is_present

# The extent of a sample.
SAMPLE_ROWS = 5
VARIANT_SAMPLE_ROWS = 10
SELECT_CONFIDENCE = 0.7


def selector_preview(records: DataFrame, keys: list[str], max_rows: int | None = None) -> DataFrame:
    """Per page: sample_count, missing_fields (selected, no value in the sample), warnings.

    The sample is all records, or the first ``max_rows`` of a page.

    ``records`` carries page_id, record_ordinal, one string column per key and
    warnings.
    """
    shown = F.lit(True) if max_rows is None else F.col("record_ordinal") < max_rows
    found = [
        F.bool_or(shown & F.coalesce(is_present(F.col(f"`{k}`")), F.lit(False))).alias(f"k{i}")
        for i, k in enumerate(keys)
    ]
    folded = records.groupBy("page_id").agg(
        F.count_if(shown).alias("sample_count"),
        F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("record_ordinal", "warnings"))), lambda r: r["warnings"]))).alias("warnings"),
        *found,
    )
    missing = F.array_compact(F.array(*[F.when(~F.col(f"k{i}"), F.lit(k)) for i, k in enumerate(keys)]))
    return folded.select("page_id", "sample_count", missing.alias("missing_fields"), "warnings")


def analysis_samples(spec_fields: DataFrame, max_rows: int | None = None) -> DataFrame:
    """Transpose analysed sample values: spec_id, row_idx, field, value.

    ``spec_fields`` is (spec_id, field, sample_values) for selected fields.
    Every field appears on each row of its spec; at least one row is made, and no
    more than ``max_rows`` if given.
    """
    size = F.coalesce(F.size("sample_values"), F.lit(0))
    per_spec = Window.partitionBy("spec_id")
    rows = F.greatest(F.lit(1), F.max(F.greatest(size, F.lit(0))).over(per_spec))
    rows = rows if max_rows is None else F.least(F.lit(max(1, max_rows)), rows)
    laid = spec_fields.withColumn("__n", rows).withColumn("row_idx", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
    return laid.select("spec_id", "row_idx", "field", F.get("sample_values", F.col("row_idx")).alias("value"))


def preview_matches(
    same_spec: Column, stored_print: Column, spec_print: Column, spec_time: Column, preview_time: Column, shape_ok: Column
) -> Column:
    """Whether a preview still validates its spec: fingerprint first, else time and shape."""
    by_time = (spec_time <= preview_time) & shape_ok
    return F.coalesce(
        same_spec & F.when(F.coalesce(stored_print, F.lit("")) != "", stored_print == spec_print).otherwise(by_time),
        F.lit(False),
    )


def default_fields(analysis: DataFrame) -> DataFrame:
    """Spec fields proposed from analysed candidates.

    ``analysis`` is (project_id, mode, name, label, data_type, required,
    confidence); content metadata is always text and never required.
    """
    confidence = F.coalesce("confidence", F.lit(0.0))
    is_content = F.col("mode") == "CONTENT"
    label = F.coalesce(F.nullif("label", F.lit("")), "name")
    return analysis.select(
        "project_id",
        "name",
        label.alias("label"),
        F.when(is_content, "string").otherwise(F.coalesce(F.nullif("data_type", F.lit("")), F.lit("string"))).alias("type"),
        (confidence >= SELECT_CONFIDENCE).alias("selected"),
        (~is_content & F.coalesce("required", F.lit(False))).alias("required"),
    )

