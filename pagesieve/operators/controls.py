"""Interactive controls of a page: selects, radio groups and segmented toggles as variant groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagesieve.functions.text import collapse, metadata_key
from pagesieve.functions.words import SECTION_WORDS, UNSAFE_LABEL
from pagesieve.operators.nodes import attr, classes, has_attr, read_once, with_texts
from pagesieve.operators.select import assign_containers, mark_inside

MIN_OPTIONS, MAX_OPTIONS, MAX_LABEL, MAX_SEGMENT_LABEL = 2, 6, 40, 24
# Site navigation by tag, role and class or id words.
NAV_TAGS = ("nav", "header", "footer")
NAV_ROLES = ("navigation", "menubar", "menu", "banner", "contentinfo")
NAV_WORDS = (
    "nav", "navbar", "navigation", "topnav", "mainnav", "sitenav", "globalnav", "navmenu", "megamenu",
    "breadcrumb", "breadcrumbs",
)
SEGMENT_TAGS = ("div", "ul", "ol", "span", "fieldset")


def is_unsafe(label: Column) -> Column:
    text = F.trim(F.coalesce(label, F.lit("")))
    return (text == "") | (F.length(text) > MAX_LABEL) | F.rlike(text, F.lit(r"^\d+$")) | F.rlike(text, F.lit(UNSAFE_LABEL))


def _is_navigation() -> Column:
    words = F.split(F.lower(F.concat_ws(" ", F.array_join(classes(), " "), attr("id"))), r"[-_\s]+")
    return (
        F.col("tag").isin(*NAV_TAGS)
        | F.coalesce(F.lower(attr("role")).isin(*NAV_ROLES), F.lit(False))
        | F.arrays_overlap(words, F.array(*[F.lit(w) for w in NAV_WORDS]))
    )


def group_key(label: Column, labels: Column) -> Column:
    """Column name of a group: its label, else what its options speak of."""
    key = metadata_key(label)
    text = F.lower(F.array_join(labels, " "))
    return (
        F.when(~key.isin("option", "variant"), key)
        .when(F.contains(text, F.lit("imperial")) | F.contains(text, F.lit("metric")), "unit_system")
        .when(F.rlike(text, F.lit("serving|per 100|100 ?g")), "serving_basis")
        .otherwise(metadata_key(F.array_join(F.slice(labels, 1, 2), "_")))
    )


def _control_label() -> Column:
    return collapse(F.coalesce(attr("aria-label"), attr("data-label"), attr("title")))


def _grouped(rows: DataFrame, kind: int, label: Column) -> DataFrame:
    """Fold option rows (page_id, group_pos, pos, text) of a group into one row."""
    return rows.groupBy("page_id", "group_pos").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "text", "default"))), lambda o: o["text"]).alias("labels"),
        F.array_sort(F.collect_list(F.struct("pos", "text", "default"))).alias("options"),
        F.min(F.struct("pos", label.alias("l")))["l"].alias("label"),
        F.bool_or(F.coalesce("reject", F.lit(False))).alias("reject"),
    ).withColumn("kind", F.lit(kind))


#: Elements whose text names a control.
CONTROL_TAGS = ("option", "label", "button", "a")


def control_groups(pages: DataFrame, max_groups: int | None = None) -> DataFrame:
    """Groups of a page, the first ``max_groups`` if given: page_id, group_idx, label, metadata_key, labels, default_idx.

    Selects come first, then radio groups, then segmented toggles; groups in
    site navigation or sign-in forms are skipped and metadata keys are unique.
    Pages are read once.
    """
    pages, nodes = read_once(pages, CONTROL_TAGS)
    nodes = nodes.withColumn("__nav", _is_navigation())
    nodes = mark_inside(nodes, F.col("__nav"), "__in_nav")
    forms = assign_containers(
        nodes.filter(F.col("tag").isin("form", "input")), F.col("tag") == "form",
        (F.col("tag") == "input") & F.coalesce(attr("type") == "password", F.lit(False)),
    ).select("page_id", F.col("container_pos").alias("open_pos")).distinct().withColumn("__login", F.lit(True))
    nodes = nodes.join(forms, ["page_id", "open_pos"], "left")
    nodes = mark_inside(nodes, F.coalesce("__login", F.lit(False)), "__in_login")
    free = nodes.filter(~F.col("__nav") & ~F.col("__in_nav") & ~F.col("__in_login")).drop("__nav", "__in_nav", "__login", "__in_login")
    text = F.coalesce("text", F.lit(""))

    menus = free.filter(F.col("tag").isin("select", "option"))
    named = F.coalesce(attr("name"), attr("id")).isNotNull()
    heads = menus.filter((F.col("tag") == "select") & named).select(
        "page_id", F.col("open_pos").alias("group_pos"), F.coalesce(F.nullif(_control_label(), F.lit("")), F.lit("Option")).alias("head")
    )
    options = with_texts(assign_containers(menus, F.col("tag") == "select", F.col("tag") == "option"), pages)
    select_rows = (
        options.withColumns({"text": text, "group_pos": F.col("container_pos"), "pos": F.col("open_pos"), "default": has_attr("selected"), "reject": F.lit(False)})
        .filter(~is_unsafe(F.col("text")))
        .join(heads, ["page_id", "group_pos"])
    )
    selects = _grouped(select_rows, 0, F.col("head"))

    radios = free.filter((F.col("tag") == "input") & F.coalesce(attr("type") == "radio", F.lit(False)) & attr("name").isNotNull())
    labels = with_texts(nodes.filter(F.col("tag") == "label").select(*[c for c in nodes.columns if not c.startswith("__")]), pages)
    by_for = labels.filter(attr("for").isNotNull()).groupBy("page_id", attr("for").alias("rid")).agg(F.min(F.struct("open_pos", "text"))["text"].alias("for_text"))
    around = assign_containers(
        nodes.filter(F.col("tag").isin("label", "input")).select("page_id", "open_pos", "close_pos", "tag", "token"), F.col("tag") == "label", F.col("tag") == "input"
    ).groupBy("page_id", "open_pos").agg(F.max("container_pos").alias("label_pos"))
    held = around.join(labels.select("page_id", F.col("open_pos").alias("label_pos"), F.col("text").alias("held_text")), ["page_id", "label_pos"]).select("page_id", "open_pos", "held_text")
    named_radios = (
        radios.withColumn("rid", attr("id")).join(by_for, ["page_id", "rid"], "left").join(held, ["page_id", "open_pos"], "left")
        .withColumns({"text": collapse(F.coalesce("for_text", "held_text", attr("value"), F.lit(""))), "name": attr("name"), "pos": F.col("open_pos")})
    )
    first = F.min("open_pos").over(Window.partitionBy("page_id", "name"))
    radio_rows = named_radios.withColumns(
        {"group_pos": first, "default": has_attr("checked"), "reject": is_unsafe(F.col("text")) | (attr("value").isNull() & attr("id").isNull())}
    )
    groups_of_radios = _grouped(radio_rows, 1, F.initcap(F.replace("name", F.lit("_"), F.lit(" "))))

    parts = with_texts(free.filter(F.col("tag").isin("button", "a") & F.col("parent_tag").isin(*SEGMENT_TAGS)), pages).filter(F.col("text").isNotNull())
    active = (
        F.coalesce((attr("aria-pressed") == "true") | (attr("aria-selected") == "true"), F.lit(False))
        | F.rlike(F.lower(F.array_join(classes(), " ")), F.lit("active|selected|current"))
    )
    away = F.coalesce(F.rlike(attr("href"), F.lit("^(http|//)")), F.lit(False))
    parent_label = F.coalesce(
        F.nullif(collapse(F.coalesce(*[attr(a, F.col("parent_token")) for a in ("aria-label", "data-label", "title")])), F.lit("")), F.lit("Option")
    )
    segment_rows = parts.withColumns(
        {
            "group_pos": F.col("parent_pos"), "pos": F.col("open_pos"), "default": active, "head": parent_label,
            "reject": is_unsafe(F.col("text")) | (F.length("text") > MAX_SEGMENT_LABEL) | away,
        }
    )
    segments = _grouped(segment_rows, 2, F.col("head"))
    sections = F.forall("labels", lambda l: F.lower(l).isin(*SECTION_WORDS))
    segments = segments.filter((F.size(F.array_distinct("labels")) == F.size("labels")) & ~sections)

    every = selects.unionByName(groups_of_radios).unionByName(segments)
    fit = every.filter(~F.col("reject") & F.size("labels").between(MIN_OPTIONS, MAX_OPTIONS)).withColumn("metadata_key", group_key(F.col("label"), F.col("labels")))
    once = F.row_number().over(Window.partitionBy("page_id", "metadata_key").orderBy("kind", "group_pos"))
    kept = fit.withColumn("__n", once).filter(F.col("__n") == 1)
    order = F.row_number().over(Window.partitionBy("page_id").orderBy("kind", "group_pos")) - 1
    default = F.greatest(F.array_position(F.transform("options", lambda o: o["default"]), True) - 1, F.lit(0))
    ordered = kept.withColumn("group_idx", order)
    ordered = ordered if max_groups is None else ordered.filter(F.col("group_idx") < max_groups)
    return ordered.select(
        "page_id", "group_idx", "label", "metadata_key", "labels", default.cast("int").alias("default_idx")
    )
