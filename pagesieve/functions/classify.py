"""Page classifiers as plain column expressions, computed at the scan."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagesieve.functions.text import visible_text
from pagesieve.functions.urls import any_of

BINARY_RATIO = 0.05
SPARSE_CHARS = 500

# Statuses that mean the site refused the request.
BLOCKED_STATUSES = (401, 403, 407, 429, 503)

# Markers of challenge pages, by family.
TURNSTILE_MARKS = ("cf-turnstile", "challenges.cloudflare.com/turnstile")
CHALLENGE_MARKS = (
    "cf-chl-",
    "_cf_chl_opt",
    "challenge-error-text",
    "/cdn-cgi/challenge-platform/",
    "enable javascript and cookies to continue",
    "checking if the site connection is secure",
)
CAPTCHA_MARKS = ("g-recaptcha", "www.google.com/recaptcha/")

# The status 429 of a provider error, lower-cased: first, in brackets or after a word that names it, and no part of another number.
RATE_STATUS = r"(?:^\s*|[(\[]\s*|(?:http(?:/[0-9.]+)?|status|code|error|response|returned|received|got)[^a-z0-9]*)429(?![0-9])"


def _has(text: Column, *marks: str) -> Column:
    return any_of(F.contains(text, F.lit(mark)) for mark in marks)


def html_quality(html: Column) -> Column:
    """struct(label, replacement_ratio, tag_count, text_length)."""
    body = F.coalesce(html, F.lit(""))
    bad = F.length(F.regexp_replace(body, "[^�\\x00-\\x08\\x0b\\x0e-\\x1f]", ""))
    ratio = bad / F.greatest(F.length(body), F.lit(1))
    tags = F.regexp_count(body, F.lit("<[a-zA-Z!/][^>]*>"))
    chars = F.length(visible_text(body))
    empty, binary = F.rlike(body, F.lit(r"^(?U)\s*$")), ratio > BINARY_RATIO
    counted = ~empty & ~binary
    return F.struct(
        F.when(empty, "structureless")
        .when(binary, "binary")
        .when((tags < 2) & (chars < 30), "structureless")
        .otherwise("ok")
        .alias("label"),
        F.when(empty, F.lit(0.0)).otherwise(ratio).alias("replacement_ratio"),
        F.when(counted, tags).otherwise(F.lit(0)).alias("tag_count"),
        F.when(counted, chars).otherwise(F.lit(0)).alias("text_length"),
    )


def challenge_reason(html: Column, final_url: Column) -> Column:
    """Anti-bot challenge family, interactive widget first; NULL for real pages."""
    hay = F.lower(html)
    url = F.lower(F.coalesce(final_url, F.lit("")))
    return (
        F.when(_has(hay, *TURNSTILE_MARKS), "cloudflare_turnstile")
        .when(
            _has(hay, *CHALLENGE_MARKS) | (_has(hay, "just a moment") & _has(hay, "cloudflare")),
            "cloudflare_challenge",
        )
        .when(
            _has(hay, "hcaptcha")
            | _has(hay, *CAPTCHA_MARKS)
            | (_has(url, "captcha") & _has(hay, "verify", "challenge")),
            "captcha_challenge",
        )
    )


def is_sparse(html: Column) -> Column:
    stripped = F.translate(html, " \n", "")
    return F.length(stripped) < SPARSE_CHARS


def rerender_reason(html: Column, status: Column, final_url: Column) -> Column:
    """Why a statically fetched page should be rendered instead; NULL when it is fine."""
    return (
        F.when(is_sparse(html), "sparse")
        .when(html_quality(html)["label"] == "binary", "garbled")
        .when(status.isin(*BLOCKED_STATUSES), "blocked_status")
        .when(challenge_reason(html, final_url) == "cloudflare_challenge", "auto_solvable_challenge")
    )


def page_outcome(challenge: Column, quality_label: Column, record_count: Column, fetch_error: Column) -> Column:
    """struct(state, reason) of one crawled page."""
    return F.struct(
        F.when(fetch_error.isNotNull(), "FAILED")
        .when(challenge.isNotNull(), "BLOCKED")
        .when(quality_label == "binary", "FAILED")
        .when(record_count == 0, "FAILED")
        .otherwise("EXTRACTED")
        .alias("state"),
        F.when(fetch_error.isNotNull(), fetch_error)
        .when(challenge.isNotNull(), F.lit("ANTI_BOT_CHALLENGE"))
        .when(quality_label == "binary", F.lit("PAGE_DECODE_FAILED"))
        .when(record_count == 0, F.lit("SELECTOR_ZERO_MATCH"))
        .alias("reason"),
    )


def confidence_label(confidence: Column, warning_count: Column) -> Column:
    return (
        F.when(confidence.isNull(), "Unknown")
        .when((confidence >= 0.85) & (warning_count == 0), "High")
        .when(confidence >= 0.65, "Needs review")
        .otherwise("Low")
    )


def error_bucket(message: Column) -> Column:
    """Short public text for a provider error; unknown messages pass through."""
    low = F.lower(message)
    return (
        F.when(
            _has(low, "invalid api key", "incorrect api key", "unauthorized", "authentication",
                 "permission denied", "forbidden"),
            F.lit("Authentication failed"),
        )
        .when(_has(low, "rate limit", "too many requests") | F.rlike(low, F.lit(RATE_STATUS)), F.lit("Rate limited"))
        .when(_has(low, "timeout", "timed out"), F.lit("Provider timeout"))
        .when(_has(low, "json", "schema", "validation"), F.lit("Invalid JSON response"))
        .otherwise(message)
    )
