"""The text a model is asked with: an instruction by extraction mode around the page's summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesieve.operators import profile

SUMMARY = "{summary}"
#: Instruction by mode; ``SUMMARY`` marks where the page goes.
TEMPLATES = {
    "STRUCTURED": (
        "Find the repeated records of this page and the fields they have.\n\n{summary}\n\n"
        "Answer with one JSON object: page_type, repeated_item_selector, candidate_fields (name, label, selector, data_type, "
        "required, confidence, sample_values), detail_link_selector, pagination_selector, estimated_pages, warnings, confidence. "
        "Parallel columns of one metric are fields of their own, with the qualifier in parentheses in the label."
    ),
    "CONTENT": (
        "Find the main text of this page and the facts that describe it.\n\n{summary}\n\n"
        "Answer with one JSON object: content_type, primary_content_selector, estimated_pages, avg_content_length, "
        "recommended_chunking, metadata_fields (name, label, selector, confidence, sample_values), warnings, confidence."
    ),
}


def analysis_prompts(pages: DataFrame, mode: Column, templates: dict[str, str] = TEMPLATES, limits: profile.Limits = profile.BRIEF) -> DataFrame:
    """page_id, prompt: the template of the page's mode (upper case; unknown modes count as content) around its summary.

    ``mode`` reads a column of ``pages``.
    """
    template = F.lit(templates["CONTENT"])
    for name, text in templates.items():
        template = F.when(F.upper(mode) == name, F.lit(text)).otherwise(template)
    asked = pages.select("page_id", template.alias("template"))
    filled = F.replace("template", F.lit(SUMMARY), F.col("summary"))
    return profile.summary(pages, limits).join(asked, "page_id").select("page_id", filled.alias("prompt"))
