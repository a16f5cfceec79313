"""Variants of the same entity: option combinations, row-per-variant, key merge, column families.

Specs, fields and options are tables (one row per field or option of a saved
spec), so every operator here runs over all saved specs at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagesieve.functions.text import collapse, metadata_key, strip_ends
from pagesieve.functions.urls import variant_url, with_normalized
from pagesieve.session import cut_lineage

NO_LIMIT = 2**62
NO_MERGE = "Could not merge variants into one row per item safely; output is one row per variant instead."

_STRINGS = "map<string,string>"


def _overlay(base: Column, over: Column) -> Column:
    """Map union where the second map wins."""
    return F.map_zip_with(base, over, lambda k, a, b: F.coalesce(b, a))


def combinations(options: DataFrame, limit: int | None = None) -> DataFrame:
    """Every choice of one selected option per group: spec_id, combo_idx, combo_id, label, maps.

    ``options`` is (spec_id, group_idx, group_label, metadata_key, execution,
    option_idx, option_id, option_label, selected, field_selectors, query,
    has_recipe, max_combinations).  Specs beyond their own cap, or beyond
    ``limit`` where they name none, come back as one row
    with ``over_limit`` and no combination; the size is checked before anything
    is expanded.
    """
    label = F.coalesce(F.nullif("option_label", F.lit("")), F.nullif("option_id", F.lit("")), F.lit("option"))
    key = F.coalesce(F.nullif("metadata_key", F.lit("")), metadata_key(F.coalesce("group_label", F.lit(""))))
    empty = F.create_map().cast(_STRINGS)
    mode = F.coalesce("execution", F.lit("deterministic"))
    option = F.struct(
        "option_idx",
        F.coalesce(F.nullif("option_id", F.lit("")), metadata_key(label)).alias("id"),
        label.alias("label"),
        F.create_map(key, label).alias("metadata"),
        F.when(mode.isin("interactive", "url_param"), empty)
        .otherwise(F.map_filter(F.coalesce("field_selectors", empty), lambda k, v: F.coalesce(v, F.lit("")) != ""))
        .alias("selectors"),
        F.when(mode == "url_param", F.coalesce("query", empty)).otherwise(empty).alias("query"),
        (mode.isin("interactive", "mixed") & F.coalesce("has_recipe", F.lit(False))).alias("browser"),
    )
    # Maps have no order of their own, so sort by the index alone.
    by_index = lambda rows, i: F.array_sort(rows, lambda a, b: a[i] - b[i])
    groups = (
        options.filter(F.coalesce("selected", F.lit(True)))
        .groupBy("spec_id", "group_idx")
        .agg(by_index(F.collect_list(option), "option_idx").alias("options"), F.max("max_combinations").alias("cap"))
    )
    specs = groups.groupBy("spec_id").agg(
        by_index(F.collect_list(F.struct("group_idx", "options")), "group_idx").alias("groups"),
        F.greatest(F.lit(1), F.coalesce(F.max("cap"), F.lit(NO_LIMIT if limit is None else limit))).alias("cap"),
    )
    total = F.aggregate("groups", F.lit(1).cast("bigint"), lambda n, g: n * F.size(g["options"]))
    specs = specs.withColumn("total", total).withColumn("over_limit", F.col("total") > F.col("cap"))
    shape = f"struct<id:string,label:string,metadata:{_STRINGS},selectors:{_STRINGS},query:{_STRINGS},browser:boolean>"
    seed = F.array(
        F.struct(
            F.lit("").alias("id"), F.lit("").alias("label"), empty.alias("metadata"), empty.alias("selectors"),
            empty.alias("query"), F.lit(False).alias("browser"),
        ).cast(shape)
    )
    glue = lambda a, sep, b: F.when(a == "", b).otherwise(F.concat(a, F.lit(sep), b))
    join = lambda c, o: F.struct(
        glue(c["id"], "__", o["id"]).alias("id"),
        glue(c["label"], " · ", o["label"]).alias("label"),
        _overlay(c["metadata"], o["metadata"]).alias("metadata"),
        _overlay(c["selectors"], o["selectors"]).alias("selectors"),
        _overlay(c["query"], o["query"]).alias("query"),
        (c["browser"] | o["browser"]).alias("browser"),
    ).cast(shape)
    folded = F.aggregate(
        F.when(F.col("over_limit"), F.slice("groups", 1, 0)).otherwise(F.col("groups")),
        seed,
        lambda acc, g: F.flatten(F.transform(acc, lambda c: F.transform(g["options"], lambda o: join(c, o)))),
    )
    out = specs.select("spec_id", "over_limit", F.posexplode(folded).alias("combo_idx", "c"))
    value = lambda name: F.when(~F.col("over_limit"), F.col(f"c.{name}"))
    return out.select(
        "spec_id", "over_limit", "combo_idx", value("id").alias("combo_id"), value("label").alias("label"),
        value("metadata").alias("metadata"), value("selectors").alias("selectors"), value("query").alias("query"),
        value("browser").alias("needs_browser"),
    )


def override_fields(fields: DataFrame, combos: DataFrame) -> DataFrame:
    """Fields of every combination with its selectors: spec_id, combo_idx, field columns.

    A field is matched on user_label, label, then name.
    """
    lookup = lambda c: F.try_element_at("selectors", F.col(c))
    chosen = F.coalesce(*[F.when(F.col(c).isNotNull(), lookup(c)) for c in ("user_label", "label", "name")], F.col("selector"))
    return fields.join(combos.select("spec_id", "combo_idx", "selectors"), "spec_id").select(
        *[c for c in fields.columns if c != "selector"], "combo_idx", chosen.alias("selector")
    )


def tag_rows(rows: DataFrame, combos: DataFrame, columns: list[str]) -> DataFrame:
    """Add one column per variant axis to rows carrying (spec_id, combo_idx)."""
    tags = combos.select("spec_id", "combo_idx", *[F.try_element_at("metadata", F.lit(c)).alias(c) for c in columns])
    return rows.join(tags, ["spec_id", "combo_idx"])


def merge_variants(rows: DataFrame, keys: list[str], varying: list[str], labels: list[str]) -> DataFrame:
    """One row per entity, varying fields as 'field (label)' columns.

    ``rows`` is (page_id, combo_idx, label, row_ord, mergeable, keys, varying).
    Pages where a key repeats inside one variant, or whose variants cannot be
    compared, are left out; :func:`unmerged_pages` lists them.
    """
    bad = unmerged_pages(rows, keys)
    safe = rows.join(bad, "page_id", "left_anti")
    texts = [F.coalesce(F.col(f"`{k}`").cast("string"), F.lit("None")).alias(f"__k{i}") for i, k in enumerate(keys)]
    first = F.min(F.struct("combo_idx", "row_ord", *[F.col(f"`{k}`").alias(f"v{i}") for i, k in enumerate(keys)]))
    cells = [
        F.max(F.when(F.col("label") == label, F.col(f"`{f}`"))).alias(f"{f} ({label})") for f in varying for label in labels
    ]
    merged = safe.select("*", *texts).groupBy("page_id", *[f"__k{i}" for i in range(len(keys))]).agg(first.alias("__f"), *cells)
    order = F.row_number().over(Window.partitionBy("page_id").orderBy("__f.combo_idx", "__f.row_ord")) - 1
    return merged.select(
        "page_id", order.alias("record_ordinal"), *[F.col(f"__f.v{i}").alias(k) for i, k in enumerate(keys)],
        *[F.col(f"`{f} ({label})`") for f in varying for label in labels],
    )


def unmerged_pages(rows: DataFrame, keys: list[str]) -> DataFrame:
    """page_id of pages that must stay one row per variant."""
    texts = [F.coalesce(F.col(f"`{k}`").cast("string"), F.lit("None")).alias(f"__k{i}") for i, k in enumerate(keys)]
    per_key = rows.groupBy("page_id", "combo_idx", *texts).agg(F.count("*").alias("n"), F.min("mergeable").alias("ok"))
    return per_key.filter((F.col("n") > 1) | ~F.col("ok")).select("page_id").distinct()


def variant_warnings(rows: DataFrame, pages: DataFrame, combos: DataFrame) -> DataFrame:
    """page_id, warning for combinations without records on a page that has others."""
    have = rows.groupBy("page_id", "combo_idx").agg(F.count("*").alias("n"))
    some = have.select("page_id").distinct()
    wanted = pages.join(some, "page_id", "left_semi").join(combos.select("spec_id", "combo_idx", "label"), "spec_id")
    gone = wanted.join(have, ["page_id", "combo_idx"], "left_anti")
    listed = gone.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("combo_idx", "label"))).alias("l"))
    names = F.array_join(F.transform("l", lambda x: x["label"]), ", ")
    return listed.select("page_id", F.concat(F.lit("No records for variant(s): "), names, F.lit(".")).alias("warning"))


def stamp_degraded(rows: DataFrame, label: Column, degraded: Column) -> DataFrame:
    """Flag rows read from static markup where a rendered page was needed."""
    note = F.concat(
        F.lit("Browser-rendered values for '"), label,
        F.lit("' could not be captured; shown values may be the page's static defaults (stale)."),
    )
    return rows.withColumn("data_quality", F.when(degraded, note))


def url_variants(pages: DataFrame, combos: DataFrame, corpus: DataFrame) -> DataFrame:
    """Pages of URL-parameter combinations: page_id, combo_idx, variant_url, variant_page_id (NULL if not fetched).

    Of several pages with the variant's address the page itself comes first, then the smallest id.
    """
    wanted = pages.join(combos.filter(F.size("query") > 0), "spec_id").withColumn(
        "variant_url", variant_url(F.col("url"), F.col("query"))
    )
    wanted = with_normalized(wanted, "variant_url", "__norm")
    fetched = with_normalized(corpus, "url", "__norm")
    known = fetched.groupBy("__norm").agg(F.min("page_id").alias("__first"))
    own = fetched.select("__norm", "page_id", F.lit(True).alias("__own")).distinct()
    wanted = wanted.join(known, "__norm", "left").join(own, ["__norm", "page_id"], "left")
    found = F.when(F.col("__own"), F.col("page_id")).otherwise(F.col("__first"))
    return wanted.select("page_id", "combo_idx", "variant_url", found.alias("variant_page_id"))


# --- column families --------------------------------------------------------------------

# Ordinal words that number parallel columns.
ORDINALS = ("primary", "secondary", "tertiary", "quaternary", "first", "second", "third", "fourth", "fifth")
DEFAULT_KEY = "__default_column__"
_PAREN = r"^(.*?)\s*[\(\[]\s*(.+?)\s*[\)\]]\s*$"
_NUMBER = r"^(.*?)[\s_:#-]*(\d+)$"
_ANY_ORDINAL = r"(?i)\b(" + "|".join(ORDINALS) + r")\b"
_CELL = r":nth-(?:child|of-type)\(\s*(\d+)\s*\)"


def with_qualifier(fields: DataFrame, label: str) -> DataFrame:
    """Split a label into base, variant_key, option and strong (closed vocabulary)."""
    text = strip_ends(F.coalesce(F.col(label), F.lit("")))
    df = fields.withColumn("__t", text).withColumns(
        {
            "__pb": F.trim(F.regexp_extract("__t", _PAREN, 1)),
            "__pi": collapse(F.regexp_extract("__t", _PAREN, 2)),
            "__nb": F.trim(F.regexp_extract("__t", _NUMBER, 1)),
            "__nn": F.regexp_replace(F.regexp_extract("__t", _NUMBER, 2), "^0+(?=.)", ""),
            "__w": F.split("__t", r"\s+"),
        }
    )
    low = F.lower("__pi")
    word = lambda w: F.lower(F.regexp_replace(w, "^[:-]+|[:-]+$", ""))
    df = df.withColumns(
        {
            "__po": F.lower(F.regexp_extract("__pi", _ANY_ORDINAL, 1)),
            "__first": word(F.get("__w", F.lit(0))),
            "__last": word(F.element_at("__w", -1)),
        }
    )
    paren = (F.col("__pb") != "") & (F.col("__pi") != "")
    named = paren & F.rlike("__pi", F.lit(r"^(?i)(?:per\s+.+|metric|imperial)$"))
    exact = paren & low.isin(*ORDINALS)
    phrase = paren & (F.col("__po") != "")
    weak = paren & (F.length("__pi") <= 30)
    many = F.size("__w") >= 2
    lead, tail = many & F.col("__first").isin(*ORDINALS), many & F.col("__last").isin(*ORDINALS)
    number = (F.col("__nb") != "") & (F.col("__nn") != "")
    sentence = lambda c: F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, F.lit(2), F.length(c)))
    return df.withColumns(
        {
            "base": F.when(named | exact | phrase | weak, F.col("__pb"))
            .when(lead, F.array_join(F.slice("__w", F.lit(2), F.size("__w")), " "))
            .when(tail, F.array_join(F.slice("__w", F.lit(1), F.size("__w") - 1), " "))
            .when(number, F.col("__nb"))
            .otherwise(F.col("__t")),
            "variant_key": F.when(named | exact, low)
            .when(phrase, F.col("__po"))
            .when(weak, F.concat(F.lit("q:"), low))
            .when(lead, F.col("__first"))
            .when(tail, F.col("__last"))
            .when(number, F.concat(F.lit("num:"), "__nn")),
            "option": F.when(named, F.col("__pi"))
            .when(exact, F.initcap(low))
            .when(phrase, sentence(F.col("__pi")))
            .when(weak, F.col("__pi"))
            .when(lead, F.initcap("__first"))
            .when(tail, F.initcap("__last"))
            .when(number, F.concat(F.lit("Variant "), "__nn")),
            "strong": named | exact | phrase | (~weak & (lead | tail | number)),
        }
    ).drop("__t", "__pb", "__pi", "__nb", "__nn", "__w", "__po", "__first", "__last")


def cell_index(selector: Column) -> Column:
    return F.nullif(F.regexp_extract(selector, _CELL, 1), F.lit("")).try_cast("int")


def family_members(fields: DataFrame) -> DataFrame:
    """Qualified fields, plus a plain sibling as the default column of its family.

    ``fields`` is (spec_id, field_idx, label, selector).  Adds base,
    variant_key, option, strong, cell, key_order, key_strong; keeps families
    with at least two keys.  Groups are the fields of one spec.
    """
    rows = with_qualifier(fields, "label").withColumn("cell", cell_index(F.col("selector")))
    family = Window.partitionBy("spec_id", "base")
    tagged = F.col("variant_key").isNotNull()
    rows = rows.withColumns(
        {
            "__tagged": F.count_if(tagged).over(family),
            "__cells": F.count_if(tagged & F.col("cell").isNotNull()).over(family),
            "__plain": F.min(F.when(~tagged & F.col("cell").isNotNull(), F.col("field_idx"))).over(family),
        }
    )
    is_default = (
        ~tagged & (F.col("__tagged") > 0) & (F.col("__tagged") == F.col("__cells")) & (F.col("field_idx") == F.col("__plain"))
    )
    rows = rows.withColumns(
        {
            "variant_key": F.when(is_default, F.lit(DEFAULT_KEY)).otherwise(F.col("variant_key")),
            "option": F.when(is_default, F.lit("default")).otherwise(F.col("option")),
        }
    ).filter(F.col("variant_key").isNotNull() & (F.col("base") != ""))
    per_key = Window.partitionBy("spec_id", "variant_key")
    rows = rows.withColumns(
        {
            "key_order": F.min(F.when(F.col("variant_key") == DEFAULT_KEY, F.lit(-1)).otherwise(F.col("field_idx"))).over(per_key),
            "key_strong": F.max("strong").over(per_key),
            "key_label": F.min(F.struct("field_idx", "option")).over(per_key)["option"],
            "__n": F.size(F.collect_set("variant_key").over(Window.partitionBy("spec_id", "base"))),
        }
    )
    return rows.filter(F.col("__n") >= 2).drop("__tagged", "__cells", "__plain", "__n")


def column_options(fields: DataFrame) -> DataFrame:
    """Option rows of detected column sets: spec_id, option_idx, label, base, selector, aligned_by.

    Families that agree on their keys align by key; otherwise they align by
    table-cell position when counts match and the blocks of columns separate.
    Members and options are written: they are slim, and read by all that follows.
    """
    members = cut_lineage(family_members(fields))
    family = members.groupBy("spec_id", "base").agg(
        F.array_join(F.array_sort(F.collect_set("variant_key")), "\u0001").alias("keys"),
        F.count("*").alias("n"),
        F.count("cell").alias("n_cells"),
        F.countDistinct("cell").alias("d_cells"),
        F.bool_and("key_strong").alias("all_strong"),
    )
    spec = family.groupBy("spec_id").agg(
        F.countDistinct("keys").alias("key_sets"),
        F.count("*").alias("families"),
        F.countDistinct("n").alias("sizes"),
        F.bool_and((F.col("n") == F.col("n_cells")) & (F.col("n_cells") == F.col("d_cells"))).alias("clean_cells"),
        F.bool_and("all_strong").alias("all_strong"),
    )
    by_key = (F.col("key_sets") == 1) & (F.col("all_strong") | (F.col("families") >= 2))
    by_place = (F.col("key_sets") > 1) & (F.col("families") >= 2) & (F.col("sizes") == 1) & F.col("clean_cells")
    ranked = members.join(spec, "spec_id")
    keyed = ranked.filter(by_key & F.col("selector").isNotNull())
    first = keyed.groupBy("spec_id", "key_order", "key_label", "base").agg(F.min(F.struct("field_idx", "selector"))["selector"].alias("selector"))
    order = F.dense_rank().over(Window.partitionBy("spec_id").orderBy("key_order")) - 1
    aligned = first.select(
        "spec_id", order.alias("option_idx"), F.col("key_label").alias("label"), "base", "selector", F.lit("key").alias("aligned_by")
    )
    placed = ranked.filter(by_place).withColumn(
        "option_idx", F.row_number().over(Window.partitionBy("spec_id", "base").orderBy("cell")) - 1
    )
    blocks = placed.groupBy("spec_id", "option_idx").agg(F.min("cell").alias("lo"), F.max("cell").alias("hi"))
    next_lo = F.lead("lo").over(Window.partitionBy("spec_id").orderBy("option_idx"))
    mixed = blocks.withColumn("__next", next_lo).filter(F.col("hi") >= F.col("__next")).select("spec_id").distinct()
    by_position = placed.join(mixed, "spec_id", "left_anti").select(
        "spec_id", "option_idx", F.concat(F.lit("Column "), (F.col("option_idx") + 1).cast("string")).alias("label"),
        "base", "selector", F.lit("position").alias("aligned_by"),
    )
    return cut_lineage(aligned.unionByName(by_position))


def collapsed_fields(fields: DataFrame, options: DataFrame) -> DataFrame:
    """Field list after collapsing: the first member stands for its family.

    spec_id, field_idx, label, selector; specs without a column set keep theirs.
    """
    members = family_members(fields).select("spec_id", "field_idx", "base")
    sets = options.filter(F.col("option_idx") == 0).select("spec_id", "base", F.col("selector").alias("first_selector"))
    inside = members.join(sets, ["spec_id", "base"])
    lead = inside.groupBy("spec_id", "base").agg(F.min("field_idx").alias("field_idx"), F.min("first_selector").alias("selector"))
    rest = fields.join(inside.select("spec_id", "field_idx"), ["spec_id", "field_idx"], "left_anti")
    return rest.select("spec_id", "field_idx", "label", "selector").unionByName(
        lead.select("spec_id", "field_idx", F.col("base").alias("label"), "selector")
    )


# --- column set against toggle ----------------------------------------------------------

# Canonical axis words of option labels, first match wins.
AXES = (
    ("metric", r"(?i)\bmetric\b"),
    ("imperial", r"(?i)\bimperial\b"),
    ("per_100g", r"(?i)per\s*100|\b100\s*g\b"),
    ("per_serving", r"(?i)per\s+serving|per\s+portion|\bserving\b|\bportion\b"),
    ("primary", r"(?i)\bprimary\b"),
    ("secondary", r"(?i)\bsecondary\b"),
    ("tertiary", r"(?i)\btertiary\b"),
)
SERVING = r"(?i)\b(serving|portion)\b"


def axis_token(label: Column) -> Column:
    out = F.lit(None).cast("string")
    for token, pattern in reversed(AXES):
        out = F.when(F.rlike(label, F.lit(pattern)), F.lit(token)).otherwise(out)
    return out


def axis_tokens(labels: Column) -> Column:
    return F.array_sort(F.array_distinct(F.array_compact(F.transform(labels, axis_token))))


def option_values(options: DataFrame, cells: DataFrame) -> DataFrame:
    """Value of every column option on every row: spec_id, base, option_idx, row_idx, value.

    ``cells`` is (spec_id, row_idx, col_idx, value) of the spec's seed page.
    """
    at = options.withColumn("col_idx", cell_index(F.col("selector")))
    return at.join(cells, ["spec_id", "col_idx"]).select("spec_id", "base", "option_idx", "row_idx", "value")


def value_agreement(options: DataFrame, cells: DataFrame) -> DataFrame:
    """spec_id, base, distinct_values, same_values: whether options differ, or repeat, on some row."""
    count = options.groupBy("spec_id", "base").agg(F.countDistinct("option_idx").alias("n_options"))
    present = F.when(F.coalesce(F.col("value"), F.lit("")) != "", F.col("value"))
    rows = option_values(options, cells).groupBy("spec_id", "base", "row_idx").agg(
        F.count(present).alias("n"), F.min(present).alias("lo"), F.max(present).alias("hi")
    )
    flags = rows.join(count, ["spec_id", "base"]).groupBy("spec_id", "base").agg(
        F.bool_or((F.col("n") >= 2) & (F.col("lo") != F.col("hi"))).alias("distinct_values"),
        F.bool_or((F.col("n") == F.col("n_options")) & (F.col("n") >= 2) & (F.col("lo") == F.col("hi"))).alias("same_values"),
    )
    return count.select("spec_id", "base").join(flags, ["spec_id", "base"], "left").select(
        "spec_id", "base", F.coalesce("distinct_values", F.lit(False)).alias("distinct_values"),
        F.coalesce("same_values", F.lit(False)).alias("same_values"),
    )


def reconcile(columns: DataFrame, toggles: DataFrame, agreement: DataFrame) -> DataFrame:
    """What happens to each toggle of a spec that has a column set: merged, dropped or kept.

    ``columns`` is the option table of column sets, ``toggles`` is (spec_id,
    toggle_idx, metadata_key, labels).  Groups are the few toggles of a spec.
    """
    sets = columns.groupBy("spec_id").agg(
        F.collect_set("label").alias("col_labels"), F.countDistinct("option_idx").alias("n_cols")
    )
    facts = agreement.groupBy("spec_id").agg(
        F.collect_list(F.when(F.col("same_values"), F.col("base"))).alias("dependent"),
        F.bool_and("distinct_values").alias("all_distinct"),
        F.bool_or(F.col("distinct_values") & F.rlike("base", F.lit(SERVING))).alias("serving_distinct"),
    )
    rows = toggles.join(sets, "spec_id").join(facts, "spec_id", "left")
    same_size = F.size("labels") == F.col("n_cols")
    tog = axis_tokens(F.col("labels"))
    wide = axis_tokens(F.concat("col_labels", F.coalesce("dependent", F.array().cast("array<string>"))))
    rows = rows.withColumns(
        {
            "fits": same_size,
            "overlap": F.when(same_size, F.size(F.array_intersect(tog, wide))),
            "covers": same_size & (F.size(axis_tokens(F.col("col_labels"))) > 0) & (axis_tokens(F.col("col_labels")) == tog),
        }
    )
    spec = Window.partitionBy("spec_id")
    fit = F.when(F.col("fits"), F.struct("overlap", (-F.col("toggle_idx")).alias("first")))
    rows = rows.withColumns({"__best": F.max(fit).over(spec), "__fits": F.count_if(F.col("fits")).over(spec)})
    mergeable = (F.size(F.coalesce("dependent", F.array().cast("array<string>"))) > 0) & ~F.coalesce("all_distinct", F.lit(True))
    picked = F.col("fits") & (F.col("toggle_idx") == -F.col("__best.first"))
    merged = mergeable & picked & ((F.col("__best.overlap") >= 1) | (F.col("__fits") == 1))
    rows = rows.withColumn("__merged", F.coalesce(merged, F.lit(False)))
    rows = rows.withColumn("__spec_merged", F.max("__merged").over(spec)).withColumn(
        "__labels", F.first(F.when(F.col("__merged"), F.col("labels")), ignorenulls=True).over(
            spec.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        )
    )
    of_merged = axis_tokens(F.col("__labels"))
    covered_by_merged = F.col("fits") & (F.size(of_merged) > 0) & (of_merged == tog)
    serving = (
        F.forall("col_labels", lambda l: F.rlike(l, F.lit(SERVING))) & (F.col("n_cols") >= 2) & F.col("fits")
        & (F.col("metadata_key") == "serving_basis") & F.coalesce("serving_distinct", F.lit(False))
    )
    return rows.select(
        "spec_id", "toggle_idx", "metadata_key",
        F.when(F.col("__merged"), "merged")
        .when(F.col("__spec_merged"), F.when(covered_by_merged, "dropped").otherwise("kept"))
        .when(F.col("covers") | serving, "dropped")
        .otherwise("kept")
        .alias("action"),
    )


def merged_options(columns: DataFrame, toggles: DataFrame, actions: DataFrame) -> DataFrame:
    """Options of merged groups: the toggle's labels with the column set's selectors."""
    merged = actions.filter(F.col("action") == "merged").select("spec_id", "toggle_idx")
    labels = toggles.join(merged, ["spec_id", "toggle_idx"]).select(
        "spec_id", F.posexplode("labels").alias("option_idx", "toggle_label")
    )
    return columns.join(labels, ["spec_id", "option_idx"]).select(
        "spec_id", "option_idx", F.col("toggle_label").alias("label"), "base", "selector", F.lit("mixed").alias("execution")
    )


# --- repair of repeated column selectors ------------------------------------------------

_SIMPLE_CELL = r"^(.*?)\btd:nth-(child|of-type)\(\s*(\d+)\s*\)(.*)$"


def repaired_selectors(fields: DataFrame, cells: DataFrame) -> DataFrame:
    """Corrected selectors of column families that read one cell twice.

    ``fields`` is (spec_id, field_idx, label, selector), ``cells`` the seed
    page's table.  Sibling families with strictly rising, equally spaced columns
    set the spacing; each anchor of the broken family proposes columns, which
    must be free, filled, and differ on some row; exactly one proposal may pass.
    Returns spec_id, field_idx, selector.
    """
    rows = with_qualifier(fields, "label").withColumns(
        {
            "shape": F.concat_ws("\u0001", F.regexp_extract("selector", _SIMPLE_CELL, 1), F.regexp_extract("selector", _SIMPLE_CELL, 2), F.regexp_extract("selector", _SIMPLE_CELL, 4)),
            "cell": F.when(
                F.regexp_count("selector", F.lit(r"td:nth-(?:child|of-type)\(")) == 1,
                F.nullif(F.regexp_extract("selector", _SIMPLE_CELL, 3), F.lit("")).try_cast("int"),
            ),
        }
    )
    key_order = F.min("field_idx").over(Window.partitionBy("spec_id", "variant_key"))
    tagged = rows.filter(F.col("variant_key").isNotNull() & (F.col("base") != "")).withColumn("key_order", key_order)
    nth = F.row_number().over(Window.partitionBy("spec_id", "base", "variant_key").orderBy("field_idx"))
    tagged = tagged.withColumn("__n", nth).filter(F.col("__n") == 1).drop("__n")
    member = F.struct("key_order", "cell", "field_idx")
    family = tagged.groupBy("spec_id", "base").agg(
        F.array_sort(F.collect_list(member)).alias("m"),
        F.array_join(F.array_sort(F.collect_set("variant_key")), "\u0001").alias("keys"),
        F.count("*").alias("n"),
        F.count("cell").alias("n_cells"),
        F.countDistinct("shape").alias("shapes"),
        F.min("selector").alias("sample"),
    ).filter(F.col("n") >= 2)
    one_set = family.groupBy("spec_id").agg(F.countDistinct("keys").alias("k")).filter(F.col("k") == 1).select("spec_id")
    usable = family.join(one_set, "spec_id").filter((F.col("n_cells") == F.col("n")) & (F.col("shapes") == 1))
    usable = usable.withColumn("idx", F.transform("m", lambda x: x["cell"]))
    step = F.transform(F.sequence(F.lit(1), F.size("idx") - 1), lambda i: F.get("idx", i) - F.get("idx", i - 1))
    usable = usable.withColumns({"step": step, "broken": F.size(F.array_distinct("idx")) < F.size("idx")})
    donors = usable.filter(F.forall("step", lambda d: d > 0)).groupBy("spec_id").agg(
        F.countDistinct(F.array_join("step", ",")).alias("n_steps"), F.min("step").alias("spacing")
    ).filter(F.col("n_steps") == 1)
    broken = usable.filter("broken").join(donors.select("spec_id", "spacing"), "spec_id")
    occupied = rows.filter(F.col("cell").isNotNull()).groupBy("spec_id").agg(F.collect_set("cell").alias("occupied"))
    broken = broken.join(occupied, "spec_id").withColumn("others", F.array_except("occupied", "idx"))
    offsets = F.transform(
        F.sequence(F.lit(0), F.size("idx") - 1), lambda i: F.aggregate(F.slice("spacing", F.lit(1), i), F.lit(0), lambda a, d: a + d)
    )
    broken = broken.withColumn("offsets", offsets).select("*", F.posexplode("idx").alias("anchor", "anchor_cell"))
    proposal = F.transform("offsets", lambda o: F.col("anchor_cell") + o - F.get("offsets", F.col("anchor")))
    tries = broken.withColumn("proposal", proposal).filter(
        F.forall("proposal", lambda p: p > 0) & ~F.arrays_overlap("proposal", "others")
    ).select("spec_id", "base", "sample", "m", "proposal").dropDuplicates(["spec_id", "base", "proposal"])
    read = tries.select("spec_id", "base", "proposal", F.posexplode("proposal").alias("k", "col_idx")).join(cells, ["spec_id", "col_idx"])
    filled = read.filter(F.coalesce(F.col("value"), F.lit("")) != "")
    per_key = filled.groupBy("spec_id", "base", "proposal", "k").agg(F.count("*").alias("n"))
    all_filled = per_key.groupBy("spec_id", "base", "proposal").agg(F.count("*").alias("keys_filled"))
    differs = filled.groupBy("spec_id", "base", "proposal", "row_idx").agg(F.min("value").alias("lo"), F.max("value").alias("hi")).filter(
        F.col("lo") != F.col("hi")
    ).select("spec_id", "base", "proposal").distinct()
    good = tries.join(all_filled, ["spec_id", "base", "proposal"]).filter(F.col("keys_filled") == F.size("proposal")).join(
        differs, ["spec_id", "base", "proposal"], "left_semi"
    )
    unique = good.withColumn("__c", F.count("*").over(Window.partitionBy("spec_id", "base"))).filter(F.col("__c") == 1)
    new = unique.select("spec_id", "sample", F.posexplode("proposal").alias("k", "col"), "m")
    prefix, func, suffix = (F.regexp_extract("sample", _SIMPLE_CELL, g) for g in (1, 2, 4))
    return new.select(
        "spec_id",
        F.get("m", F.col("k"))["field_idx"].alias("field_idx"),
        F.concat(prefix, F.lit("td:nth-"), func, F.lit("("), F.col("col").cast("string"), F.lit(")"), suffix).alias("selector"),
    )


def table_cells(pages: DataFrame, nodes: DataFrame, spec_of_page: str = "page_id") -> DataFrame:
    """spec_id, row_idx, col_idx, value of td cells of each page's best table."""
    from pagesieve.operators.nodes import with_texts
    from pagesieve.operators.records import best_tables

    cells = with_texts(best_tables(nodes).filter(F.col("tag") == "td"), pages)
    row = F.dense_rank().over(Window.partitionBy("page_id").orderBy("row_pos")) - 1
    return cells.select(F.col(spec_of_page).alias("spec_id"), row.alias("row_idx"), F.col("sibling_idx").alias("col_idx"), F.col("text").alias("value"))
