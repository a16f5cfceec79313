"""Crawl-scope classification of links as one CASE ladder.

A scope is either written in code (:class:`CrawlScope`, patterns become
literal regexes and only the branch of its mode is planned) or stored in a
table, one row per project, joined onto the links by key.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagesieve.functions.globs import (
    ONE_MORE_SEGMENT,
    PER_SEGMENT,
    PLAIN,
    compiled_rules,
    first_match,
    literal_rule,
    rule_on_path,
    rule_regex,
)
from pagesieve.functions.urls import looks_like_pagination, origin_of

# Reason codes and their default texts.
REASON_TEXT = {
    "SEED_URL": "Seed URL.",
    "CURRENT_PAGE_SCOPE": "Mode is CURRENT_PAGE: only the seed URL is crawled.",
    "PAGINATION_SELECTOR_MATCH": "Matched the AI-detected pagination selector.",
    "FULL_SITE_SAME_ORIGIN": "Same-origin link in FULL_SITE scope.",
    "EXCLUDED_DIFFERENT_ORIGIN": "Different origin than the seed.",
    "EXCLUDED_NAVIGATION": "Skipped: looks like a navigation anchor (#, mailto, tel, javascript).",
    "EXCLUDED_DEPTH_LIMIT": "Excluded: depth limit reached for this scope.",
    "EXCLUDED_INVALID_URL": "Excluded: URL is malformed or not safe.",
}
# Text for links a mode leaves out.
MODE_TEXT = {
    "PAGINATION": "PAGINATION scope: only pagination selector/pattern matches are included.",
    "COLLECTION": "COLLECTION scope: only related-list include patterns are included.",
    "DATASET": "DATASET scope: only dataset include patterns / rules are included.",
}
INCLUDED_CODES = (
    "SEED_URL",
    "PAGINATION_SELECTOR_MATCH",
    "PAGINATION_PATTERN_MATCH",
    "DATASET_PATTERN_MATCH",
    "COLLECTION_PATTERN_MATCH",
    "DETAIL_LINK_SELECTOR_MATCH",
    "FULL_SITE_SAME_ORIGIN",
)
MODES = ("CURRENT_PAGE", "PAGINATION", "COLLECTION", "DATASET", "FULL_SITE")

SCOPE_COLUMNS = (
    "s_mode", "s_max_depth", "s_exclude", "s_include", "s_paging", "s_list_rules", "s_data_rules",
    "s_paging_selector",
)


@dataclass(frozen=True)
class CrawlScope:
    mode: str = "CURRENT_PAGE"
    max_depth: int | None = None
    include_patterns: tuple[str, ...] = ()
    exclude_patterns: tuple[str, ...] = ()
    pagination_pattern: str | None = None
    # text of the analysed pagination selector, used only when the scope names one too
    pagination_selector: str | None = None
    # (role, pattern) pairs
    link_rules: tuple[tuple[str, str], ...] = ()


@dataclass(frozen=True)
class _Plan:
    """The parts of a scope the ladder reads; each is a literal or a column."""

    mode: object
    max_depth: Column
    exclude: object
    include: object
    paging: object
    list_rules: object
    data_rules: object
    selector: Column

    def in_mode(self, mode: str, then: Column) -> Column:
        """Evaluate ``then`` only for links under ``mode``."""
        if isinstance(self.mode, str):
            return then if self.mode == mode else F.lit(None).cast("string")
        return F.when(self.mode == mode, then)


def _flavour(mode: str) -> str:
    return {"COLLECTION": ONE_MORE_SEGMENT, "DATASET": PER_SEGMENT}.get(mode, PLAIN)


def _literal_plan(scope: CrawlScope) -> _Plan:
    def rules(pairs, flavour):
        return [
            literal_rule(pattern, flavour)._replace(pattern=f"{role}|{pattern}") for role, pattern in pairs if pattern
        ]

    plain = lambda patterns: [literal_rule(p) for p in patterns if p]
    return _Plan(
        mode=scope.mode,
        max_depth=F.lit(scope.max_depth).cast("int"),
        exclude=plain(scope.exclude_patterns),
        include=[literal_rule(p, _flavour(scope.mode)) for p in scope.include_patterns if p],
        paging=plain([scope.pagination_pattern or ""]),
        list_rules=rules([r for r in scope.link_rules if r[0] in ("collection", "list")], ONE_MORE_SEGMENT),
        data_rules=rules([r for r in scope.link_rules if r[0] in ("dataset", "detail")], PER_SEGMENT),
        selector=F.lit(scope.pagination_selector).cast("string"),
    )


def _table_rules(roles: tuple[str, ...], flavour: str) -> Column:
    wanted = F.filter(
        F.coalesce(F.col("link_rules"), F.array().cast("array<struct<role:string,pattern:string>>")),
        lambda r: r["role"].isin(*roles) & (F.coalesce(r["pattern"], F.lit("")) != ""),
    )
    return F.transform(
        wanted,
        lambda r: F.struct(
            F.concat(r["role"], F.lit("|"), r["pattern"]).alias("pattern"),
            rule_on_path(r["pattern"], flavour).alias("on_path"),
            rule_regex(r["pattern"], flavour).alias("regex"),
        ),
    )


def compile_scopes(scopes: DataFrame, keys: list[str]) -> DataFrame:
    """Scope table to ladder columns; globs are translated here, once per scope.

    Expects mode, max_depth, include_patterns, exclude_patterns,
    pagination_pattern, pagination_selector, link_rules(role, pattern).
    """
    includes = (
        F.when(F.col("mode") == "COLLECTION", compiled_rules(F.col("include_patterns"), ONE_MORE_SEGMENT))
        .when(F.col("mode") == "DATASET", compiled_rules(F.col("include_patterns"), PER_SEGMENT))
        .otherwise(compiled_rules(F.col("include_patterns"), PLAIN))
    )
    return scopes.select(
        *keys,
        F.coalesce(F.col("mode"), F.lit("CURRENT_PAGE")).alias("s_mode"),
        F.col("max_depth").alias("s_max_depth"),
        compiled_rules(F.col("exclude_patterns"), PLAIN).alias("s_exclude"),
        includes.alias("s_include"),
        compiled_rules(F.array(F.coalesce(F.col("pagination_pattern"), F.lit(""))), PLAIN).alias("s_paging"),
        _table_rules(("collection", "list"), ONE_MORE_SEGMENT).alias("s_list_rules"),
        _table_rules(("dataset", "detail"), PER_SEGMENT).alias("s_data_rules"),
        F.col("pagination_selector").alias("s_paging_selector"),
    )


def _table_plan() -> _Plan:
    return _Plan(
        mode=F.col("s_mode"),
        max_depth=F.col("s_max_depth"),
        exclude=F.col("s_exclude"),
        include=F.col("s_include"),
        paging=F.col("s_paging"),
        list_rules=F.col("s_list_rules"),
        data_rules=F.col("s_data_rules"),
        selector=F.col("s_paging_selector"),
    )


def classify(links: DataFrame, scope: CrawlScope | None = None, depth: Column | None = None) -> DataFrame:
    """Add decision, reason_code, reason, role and depth to deduplicated links.

    ``links`` carries kind, href, normalized_url, page_norm, page_url and
    optionally root_url; with ``scope=None`` it also carries compiled scope
    columns.  ``depth`` is the depth of the source page (0 for a seed).
    """
    plan = _table_plan() if scope is None else _literal_plan(scope)
    url = F.col("normalized_url")
    root = F.col("root_url") if "root_url" in links.columns else F.col("page_url")
    child = (F.lit(0) if depth is None else depth) + 1
    mode = F.lit(plan.mode) if isinstance(plan.mode, str) else plan.mode
    paged = F.coalesce(
        first_match(url, plan.paging),
        F.when(looks_like_pagination(url), F.lit("\u0000heuristic")),
        F.when((plan.selector != "") & F.contains(url, plan.selector), F.lit("\u0000selector")),
    )
    facts = {
        "__exclude": first_match(url, plan.exclude),
        "__paged": F.coalesce(plan.in_mode("PAGINATION", paged), plan.in_mode("DATASET", paged)),
        "__include": first_match(url, plan.include),
        "__listed": plan.in_mode("COLLECTION", first_match(url, plan.list_rules)),
        "__data": plan.in_mode("DATASET", first_match(url, plan.data_rules)),
    }
    has_includes = (F.size(plan.include) > 0) if isinstance(plan.include, Column) else F.lit(bool(plan.include))
    x = lambda name: F.col("__" + name)
    paging_code = F.when(x("paged") == "\u0000selector", "PAGINATION_SELECTOR_MATCH").otherwise("PAGINATION_PATTERN_MATCH")
    too_deep = (plan.max_depth >= 1) & (child > plan.max_depth)
    code = (
        F.when(F.col("kind") == "navigation", "EXCLUDED_NAVIGATION")
        .when(F.col("kind") == "invalid", "EXCLUDED_INVALID_URL")
        .when(origin_of(url) != origin_of(root), "EXCLUDED_DIFFERENT_ORIGIN")
        .when(x("exclude").isNotNull(), "EXCLUDED_PATTERN")
        .when(mode == "CURRENT_PAGE", "CURRENT_PAGE_SCOPE")
        .when(url == F.col("page_norm"), "CURRENT_PAGE_SCOPE")
        .when(F.coalesce(too_deep, F.lit(False)), "EXCLUDED_DEPTH_LIMIT")
        .when(x("paged").isNotNull(), paging_code)
        .when((mode == "COLLECTION") & F.coalesce(x("include"), x("listed")).isNotNull(), "COLLECTION_PATTERN_MATCH")
        .when((mode == "DATASET") & x("include").isNotNull(), "DATASET_PATTERN_MATCH")
        .when((mode == "DATASET") & F.startswith(x("data"), F.lit("detail|")), "DETAIL_LINK_SELECTOR_MATCH")
        .when((mode == "DATASET") & x("data").isNotNull(), "DATASET_PATTERN_MATCH")
        .when((mode == "FULL_SITE") & ~has_includes, "FULL_SITE_SAME_ORIGIN")
        .when((mode == "FULL_SITE") & x("include").isNotNull(), "DATASET_PATTERN_MATCH")
        .when(mode == "FULL_SITE", "EXCLUDED_PATTERN")
        .otherwise("EXCLUDED_SCOPE_MODE")
    )
    reason_code, included = F.col("reason_code"), F.col("reason_code").isin(*INCLUDED_CODES)
    quote = lambda before, pattern, after="'.": F.concat(F.lit(before), pattern, F.lit(after))
    rule_role, rule_text = F.substring_index(x("data"), "|", 1), F.regexp_replace(x("data"), r"^[a-z]+\|", "")
    list_text = F.regexp_replace(x("listed"), r"^[a-z]+\|", "")
    by_rule = (mode == "DATASET") & x("paged").isNull() & x("include").isNull()
    role = F.when(
        included,
        F.when(mode == "PAGINATION", F.lit("pagination"))
        .when(mode == "COLLECTION", F.lit("collection"))
        .when(by_rule, rule_role)
        .when(mode == "DATASET", F.lit("dataset"))
        .otherwise("site"),
    )
    fixed = F.lit(None).cast("string")
    for name, text in REASON_TEXT.items():
        fixed = F.when(reason_code == name, F.lit(text)).otherwise(fixed)
    left_out = F.lit(None).cast("string")
    for name, text in MODE_TEXT.items():
        left_out = F.when(mode == name, F.lit(text)).otherwise(left_out)
    reason = (
        F.when((reason_code == "EXCLUDED_PATTERN") & x("exclude").isNotNull(), quote("Matched exclude pattern '", x("exclude")))
        .when(reason_code == "EXCLUDED_PATTERN", F.lit("FULL_SITE scope has include patterns and this URL matched none."))
        .when((reason_code == "CURRENT_PAGE_SCOPE") & (mode != "CURRENT_PAGE"), F.lit("Same URL as the current page."))
        .when(
            (reason_code == "PAGINATION_PATTERN_MATCH") & (x("paged") == "\u0000heuristic"),
            F.lit("URL looks like a page-number link."),
        )
        .when(reason_code == "PAGINATION_PATTERN_MATCH", quote("Matched pagination URL pattern '", x("paged")))
        .when(
            reason_code == "COLLECTION_PATTERN_MATCH",
            F.when(x("include").isNotNull(), quote("Matched related-list include pattern '", x("include")))
            .otherwise(quote("Matched related-list rule pattern '", list_text)),
        )
        .when(
            reason_code.isin("DATASET_PATTERN_MATCH", "DETAIL_LINK_SELECTOR_MATCH") & by_rule,
            F.concat(F.lit("Matched "), rule_role, F.lit(" rule pattern '"), rule_text, F.lit("'.")),
        )
        .when(
            reason_code == "DATASET_PATTERN_MATCH",
            F.when(mode == "FULL_SITE", quote("Matched include pattern '", x("include")))
            .otherwise(quote("Matched dataset include pattern '", x("include"))),
        )
        .when(
            reason_code == "EXCLUDED_SCOPE_MODE",
            F.coalesce(left_out, F.concat(F.lit("Unknown crawl scope mode '"), mode, F.lit("'."))),
        )
        .otherwise(fixed)
    )
    decided = links.withColumns(facts).withColumn("reason_code", code)
    return decided.withColumns(
        {
            "decision": F.when(included, "included").otherwise("excluded"),
            "reason": reason,
            "role": role,
            "depth": F.when(F.col("kind") == "link", child).otherwise(F.lit(0)),
            "normalized_url": F.when(F.col("kind") == "link", url).otherwise(F.col("href")),
        }
    ).drop(*facts, *(SCOPE_COLUMNS if scope is None else ()))


def included_per_page(decisions: DataFrame, limit: int | None = None) -> DataFrame:
    """Included links ranked in page order; the first ``limit`` per page if given."""
    rank = F.row_number().over(Window.partitionBy("page_id").orderBy("pos"))
    ranked = decisions.filter(F.col("decision") == "included").withColumn("rank", rank)
    return ranked if limit is None else ranked.filter(F.col("rank") <= limit)


def normalize_scopes(scopes: DataFrame) -> DataFrame:
    """Fill defaults of saved scopes.

    Missing scope (NULL mode and status) reads as a legacy FULL_SITE scope;
    page limits are 1 at least; suggested patterns fill an unconfigured
    COLLECTION or DATASET scope; a COLLECTION always has a depth bound.
    Expects mode, status, max_depth, page_limit, max_pages, include_patterns,
    link_rules, suggested_include_patterns.
    """
    missing = F.col("mode").isNull() & F.col("status").isNull()
    no_patterns = F.coalesce(F.size("include_patterns"), F.lit(0)) <= 0
    no_rules = F.coalesce(F.size("link_rules"), F.lit(0)) <= 0
    suggested = F.filter(
        F.transform(
            F.coalesce(F.col("suggested_include_patterns"), F.array().cast("array<string>")), lambda p: F.trim(p)
        ),
        lambda p: p.isNotNull() & (p != ""),
    )
    filled = F.when(
        F.col("mode").isin("COLLECTION", "DATASET") & no_patterns & no_rules & (F.size(suggested) > 0), suggested
    ).otherwise(F.coalesce(F.col("include_patterns"), F.array().cast("array<string>")))
    clamp = lambda n: F.greatest(F.lit(1), n)
    return scopes.withColumns(
        {
            "mode": F.when(missing, "FULL_SITE").otherwise(F.coalesce(F.col("mode"), F.lit("CURRENT_PAGE"))),
            "status": F.coalesce(F.col("status"), F.lit("SYSTEM_DEFAULTED")),
            "max_pages": F.coalesce(
                F.when(F.col("page_limit").isNotNull(), clamp(F.col("page_limit"))), F.col("max_pages"), F.lit(500)
            ),
            "include_patterns": filled,
            "max_depth": F.when(
                (F.col("mode") == "COLLECTION") & (F.coalesce(F.col("max_depth"), F.lit(0)) < 1), F.lit(1)
            ).otherwise(F.col("max_depth")),
        }
    )


def page_cap(spec_limit: Column, job_limit: Column, scope_pages: Column) -> Column:
    """Most pages one run may hold."""
    scoped = F.greatest(F.lit(1), F.coalesce(F.nullif(scope_pages, F.lit(0)), F.lit(500)))
    return F.least(F.coalesce(spec_limit, job_limit), job_limit, scoped)


def needs_confirmation(mode: Column, status: Column) -> Column:
    """True when a stored scope must be confirmed before it may run; legacy rows pass."""
    present = mode.isNotNull() | status.isNotNull()
    return present & ~(mode.eqNullSafe("CURRENT_PAGE")) & ~(status.eqNullSafe("USER_CONFIRMED"))


def fingerprint(struct: Column) -> Column:
    """Stable hash of a struct whose fields are given in sorted order."""
    return F.sha2(F.to_json(struct), 256)
