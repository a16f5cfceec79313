"""Records from pages: repeated containers, aligned fields, data tables, and the ladder.

A spec is resolved on the driver (it is a handful of fields), because the
output columns must be known when the plan is built.  Each strategy evaluates
all selectors in one pass over the element table and then aggregates per page.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagesieve.functions.text import coerced, is_present, strip_ends
from pagesieve.functions.urls import is_navigation, origin_of, with_joined, with_normalized_reference, with_parts
from pagesieve.operators.nodes import attr, elements, place_pages, with_texts
from pagesieve.operators.select import (
    SelectorError,
    assign_containers,
    compile_selector,
    is_valid,
    mark_inside,
    mark_selected,
    relative,
    relaxed,
    select_many,
)
from pagesieve.session import cut_lineage

# Attributes read before text, and image sources, in order.
VALUE_ATTRS = ("content", "value", "title", "alt", "aria-label")
BAD_CONTAINER = "Repeated item selector is invalid: {}"
IMAGE_ATTRS = ("src", "data-src", "data-original", "srcset")


@dataclass(frozen=True)
class FieldSpec:
    name: str
    selector: str | None = None
    type: str = "string"
    label: str | None = None
    user_label: str | None = None
    selected: bool = True
    required: bool = False

    @property
    def key(self) -> str:
        return self.user_label or self.label or self.name or "field"


def chosen(fields: list[FieldSpec]) -> list[FieldSpec]:
    return [f for f in fields if f.selected]


def spec_warnings(fields: list[FieldSpec]) -> list[str]:
    """Warnings every record of the spec carries: fields that cannot be read."""
    out = []
    for f in fields:
        if not f.selector:
            out.append(f"{f.key} has no selector.")
            continue
        for candidate in relaxed(f.selector):
            try:
                compile_selector(candidate)
            except SelectorError:
                out.append(f"{f.key} selector is invalid: {candidate}")
                break
    return out


def _variants(fields: list[FieldSpec], container: str | None) -> dict[str, str]:
    """'field|variant' -> selector, readable fields only."""
    out = {}
    for i, f in enumerate(fields):
        if not f.selector:
            continue
        options = relaxed(relative(f.selector, container))
        try:
            for option in options:
                compile_selector(option)
        except SelectorError:
            continue
        for v, option in enumerate(options):
            out[f"{i}|{v}"] = option
    return out


def with_values(hits: DataFrame, pages: DataFrame, types: dict[int, str]) -> DataFrame:
    """Add field, variant and value to selected elements (key is 'field|variant')."""
    hits = hits.withColumns(
        {
            "field": F.substring_index("key", "|", 1).cast("int"),
            "variant": F.substring_index("key", "|", -1).cast("int"),
        }
    )
    rows = with_texts(hits, pages)
    of_type = lambda *kinds: F.col("field").isin(*[i for i, t in types.items() if t.lower() in kinds] or [-1])
    read = F.when(F.contains("token", F.lit("=")), strip_ends(F.coalesce(*[attr(a) for a in VALUE_ATTRS])))
    value = F.coalesce(read, F.col("text"))
    linked = [i for i, t in types.items() if t.lower() in ("url", "link", "image", "img")]
    if linked:
        first = F.regexp_extract(F.coalesce(*[attr(a) for a in IMAGE_ATTRS]), r"^\s*([^,\s]*)", 1)
        ref = F.when(of_type("url", "link"), attr("href")).when(of_type("image", "img"), first)
        rows = with_joined(rows.withColumn("__ref", ref), "__ref", "url", "__link")
        value = F.when(F.col("__ref").isNotNull(), F.col("__link")).otherwise(value)
    return rows.withColumn("value", F.nullif(value, F.lit(""))).drop("__ref", "__link")


def _finish(
    rows: DataFrame, fields: list[FieldSpec], minimum: int, strategy: str, order: str, extra: list[str] = []
) -> DataFrame:
    """Keep rows with enough values and every required one; number them per page."""
    names = [f"f{i}" for i in range(len(fields))]
    count = sum((F.col(n).isNotNull().cast("int") for n in names), F.lit(0))
    complete = F.lit(True)
    for i, f in enumerate(fields):
        if f.required:
            complete = complete & F.col(f"f{i}").isNotNull()
    kept = rows.filter((count >= minimum) & complete)
    ordinal = F.row_number().over(Window.partitionBy("page_id").orderBy(order)) - 1
    warnings = F.array(*[F.lit(w) for w in spec_warnings(fields)]).cast("array<string>")
    return kept.select(
        "page_id",
        ordinal.alias("record_ordinal"),
        F.col("url").alias("source_url"),
        F.lit(strategy).alias("strategy"),
        *[F.col(n).alias(f.key) for n, f in zip(names, fields)],
        warnings.alias("warnings"),
        *extra,
    )


def from_containers(
    pages: DataFrame, nodes: DataFrame, fields: list[FieldSpec], container: str, max_records: int | None = None
) -> DataFrame:
    """One record per container element, read with container-relative selectors; all of them unless ``max_records`` is given.

    Per container and field the first selector variant with a hit decides; its
    first non-empty value is taken.
    """
    if not is_valid(container):  # no containers, so no records of this kind
        return by_field_index(pages, nodes, fields).filter(F.lit(False))
    fields = chosen(fields)
    hits = select_many(nodes, {"c|0": container, **_variants(fields, container)})
    is_container = F.col("key") == "c|0"
    seen = Window.partitionBy("page_id").orderBy("open_pos", "key").rowsBetween(Window.unboundedPreceding, 0)
    if max_records is not None:
        nth = F.sum(F.when(is_container, 1).otherwise(0)).over(seen)
        hits = hits.withColumn("__n", nth).filter(~is_container | (F.col("__n") <= max_records)).drop("__n")
    inside = assign_containers(hits, is_container, ~is_container)
    rows = with_values(inside, pages, {i: f.type for i, f in enumerate(fields)})
    aggs = []
    for i in range(len(fields)):
        mine = F.col("field") == i
        aggs.append(F.min(F.when(mine, F.col("variant"))).alias(f"r{i}"))
        found = mine & F.col("value").isNotNull()
        aggs.append(F.min(F.when(found, F.struct("variant", "open_pos", "value"))).alias(f"b{i}"))
    wide = rows.groupBy("page_id", "container_pos").agg(F.first("url").alias("url"), *aggs)
    wide = wide.withColumns(
        {f"f{i}": F.when(F.col(f"b{i}.variant") == F.col(f"r{i}"), F.col(f"b{i}.value")) for i in range(len(fields))}
    )
    return _finish(wide, fields, 1, "containers", "container_pos")


def by_field_index(
    pages: DataFrame, nodes: DataFrame, fields: list[FieldSpec], max_records: int | None = None
) -> DataFrame:
    """The i-th match of every field across a page forms record i."""
    fields = chosen(fields)
    rows = with_values(select_many(nodes, _variants(fields, None)), pages, {i: f.type for i, f in enumerate(fields)})
    per_field = Window.partitionBy("page_id", "field")
    rows = rows.withColumn("__r", F.min("variant").over(per_field)).filter(F.col("variant") == F.col("__r"))
    rows = rows.withColumn("idx", F.row_number().over(per_field.orderBy("open_pos")))
    rows = rows if max_records is None else rows.filter(F.col("idx") <= max_records)
    wide = rows.groupBy("page_id", "idx").agg(
        F.first("url").alias("url"),
        *[F.max(F.when(F.col("field") == i, F.col("value"))).alias(f"f{i}") for i in range(len(fields))],
    )
    return _finish(wide, fields, 1 if len(fields) <= 2 else 2, "field_index", "idx")


def from_containers_by_variant(
    pages: DataFrame,
    nodes: DataFrame,
    fields: list[FieldSpec],
    container: str,
    combos: list[dict],
    max_records: int | None = None,
) -> DataFrame:
    """Row per variant: every combination reads its own selectors, in one pass.

    ``combos`` (at most twelve, resolved with the spec) are dicts with label,
    metadata and selectors.  Fields no combination overrides are read once.
    """
    fields = chosen(fields)
    reads: list[FieldSpec] = []
    column: dict[tuple[int, int], str] = {}
    for i, f in enumerate(fields):
        for c, combo in enumerate(combos):
            names = [n for n in (f.user_label, f.label, f.name) if n is not None]
            selector = next((combo["selectors"][n] for n in names if n in combo["selectors"]), f.selector)
            name = f"{i}|{selector}"
            if name not in [r.name for r in reads]:
                reads.append(FieldSpec(name, selector, f.type))
            column[i, c] = name
    wide = from_containers(pages, nodes, reads, container, max_records)
    per_combo = F.array(
        *[
            F.struct(
                F.lit(c).alias("combo_idx"),
                F.lit(combo["label"]).alias("variant"),
                *[F.lit(v).alias(k) for k, v in combo["metadata"].items()],
                *[F.col(f"`{column[i, c]}`").alias(f"f{i}") for i in range(len(fields))],
            )
            for c, combo in enumerate(combos)
        ]
    )
    rows = wide.select("page_id", F.col("record_ordinal").alias("__o"), F.col("source_url").alias("url"), F.inline(per_combo))
    rows = rows.withColumn("__order", F.struct("combo_idx", "__o"))
    tags = ["combo_idx", "variant", *combos[0]["metadata"]]
    kept = _finish(rows.withColumn("__tags", F.struct(*tags)), fields, 1, "containers", "__order", ["__tags"])
    return kept.select("*", "__tags.*").drop("__tags")


# --- data tables ------------------------------------------------------------------------

# Unit abbreviations that name the same column.
HEADER_ALIASES = {"kcal": "calories", "kj": "kilojoules"}


def _plain_key(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]+", "")


def _words(text: Column) -> Column:
    words = F.array_distinct(F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != ""))
    also = F.lit(None).cast("string")
    aliased = lambda w: F.when(w == "kcal", F.lit("calories")).when(w == "kj", F.lit("kilojoules")).otherwise(also)
    return F.array_union(words, F.array_compact(F.transform(words, aliased)))


def header_score(field: Column, header: Column) -> Column:
    """100 equal, 50 plus shared word lengths, 10 for a long substring, else 0."""
    f, h = _plain_key(field), _plain_key(header)
    shared = F.array_intersect(_words(field), _words(header))
    length = F.aggregate(shared, F.lit(0), lambda total, w: total + F.length(w))
    short_h = F.length(h) <= F.length(f)
    short, long = F.when(short_h, h).otherwise(f), F.when(short_h, f).otherwise(h)
    return (
        F.when((f == "") | (h == ""), 0)
        .when(f == h, 100)
        .when(F.size(shared) > 0, F.lit(50) + length)
        .when((F.length(short) >= 5) & F.contains(long, short), 10)
        .otherwise(0)
    )


def with_assigned_columns(df: DataFrame, keys: list[str] | Column, headers: str, n_cols: str, out: str) -> DataFrame:
    """Add array<int>: table column of each field, best header first, leftovers by position.

    ``keys`` are the names of the fields, or a column that holds them.

    One row is one table; candidates number fields x headers of that table, a
    handful.  Every stage is its own column so nothing is evaluated twice.
    """
    names = keys if isinstance(keys, Column) else F.array(*[F.lit(k) for k in keys])
    scored = F.flatten(
        F.transform(
            names,
            lambda k, fi: F.transform(
                headers,
                lambda h, hi: F.struct((-header_score(k, h)).alias("s"), fi.alias("f"), hi.alias("h")),
            ),
        )
    )
    df = df.withColumn("__scored", scored)
    df = df.withColumn(
        "__ranked", F.array_sort(F.filter("__scored", lambda c: (c["s"] < 0) & (c["h"] < F.col(n_cols))))
    )
    matched = F.aggregate(
        "__ranked",
        F.array().cast("array<struct<f:int,h:int>>"),
        lambda taken, c: F.when(
            F.exists(taken, lambda t: (t["f"] == c["f"]) | (t["h"] == c["h"])), taken
        ).otherwise(F.concat(taken, F.array(F.struct(c["f"].alias("f"), c["h"].alias("h"))))),
    )
    df = df.withColumn("__matched", matched)
    indices = F.sequence(F.lit(0), F.size(names) - 1)
    df = df.withColumns(
        {
            "__free": F.array_except(
                F.sequence(F.lit(0), F.col(n_cols) - 1), F.transform("__matched", lambda t: t["h"])
            ),
            "__open": F.array_except(indices, F.transform("__matched", lambda t: t["f"])),
        }
    )
    column = F.transform(
        indices,
        lambda i: F.coalesce(
            F.get(F.filter("__matched", lambda t: t["f"] == i), F.lit(0))["h"],
            F.get(F.col("__free"), (F.array_position(F.col("__open"), i) - 1).cast("int")),
        ),
    )
    return df.withColumn(out, column).drop("__scored", "__ranked", "__matched", "__free", "__open")


def best_tables(nodes: DataFrame) -> DataFrame:
    """Cells of each page's largest table (rows x widest row; first wins ties).

    Node columns of td/th elements plus table_pos, row_pos, in_head, n_rows and
    n_cols.  Rows and cells of nested tables count for every table around them.
    """
    parts = nodes.filter(F.col("tag").isin("table", "thead", "tr", "td", "th"))
    parts = mark_inside(parts, F.col("tag") == "thead", "in_head")
    in_tables = assign_containers(parts, F.col("tag") == "table", F.col("tag").isin("tr", "td", "th"))
    table = ("page_id", "container_pos")
    counted = in_tables.withColumn(
        "n_rows", F.count_if(F.col("tag") == "tr").over(Window.partitionBy(*table))
    ).withColumnRenamed("container_pos", "table_pos")
    cells = assign_containers(
        counted, F.col("tag") == "tr", F.col("tag") != "tr", ("page_id", "table_pos")
    ).withColumnRenamed("container_pos", "row_pos")
    width = F.count("*").over(Window.partitionBy("page_id", "table_pos", "row_pos"))
    sized = cells.withColumn("__w", width).withColumn(
        "n_cols", F.max("__w").over(Window.partitionBy("page_id", "table_pos"))
    )
    sized = sized.filter((F.col("n_rows") >= 2) & (F.col("n_cols") >= 2))
    score = F.struct((F.col("n_rows") * F.col("n_cols")).alias("score"), (-F.col("table_pos")).alias("first"))
    best = F.max(score).over(Window.partitionBy("page_id"))
    return sized.withColumn("__best", best).filter(F.col("table_pos") == -F.col("__best.first")).drop("__w", "__best")


def page_tables(pages: DataFrame, nodes: DataFrame) -> DataFrame:
    """The best table of each page on one row.

    page_id, url, n_rows, n_cols, headers, rows(row_pos, in_head, cells(open_pos,
    text, tag)).  Headers are the first head row, else the first row when it
    has a heading cell.
    """
    texts = with_texts(best_tables(nodes), pages)
    rows = texts.groupBy("page_id", "url", "n_rows", "n_cols", "row_pos", "in_head").agg(
        F.array_sort(F.collect_list(F.struct("open_pos", "text", "tag"))).alias("cells")
    )
    tables = rows.groupBy("page_id", "url", "n_rows", "n_cols").agg(
        F.array_sort(F.collect_list(F.struct("row_pos", "in_head", "cells"))).alias("rows")
    )
    head = F.get(F.filter("rows", lambda r: r["in_head"]), F.lit(0))["cells"]
    first = F.get("rows", F.lit(0))["cells"]
    headed = F.coalesce(head, F.when(F.exists(first, lambda c: c["tag"] == "th"), first))
    none = F.array().cast("array<string>")
    return tables.withColumn("__h", headed).withColumn(
        "headers", F.coalesce(F.transform("__h", lambda c: F.coalesce(c["text"], F.lit(""))), none)
    ).drop("__h")


def from_tables(
    pages: DataFrame, nodes: DataFrame, fields: list[FieldSpec], max_records: int | None = None
) -> DataFrame:
    """Read the largest table by column; required flags are not applied here."""
    fields = chosen(fields)
    data = F.filter("rows", lambda r: F.exists(r["cells"], lambda c: c["tag"] == "td"))
    tables = page_tables(pages, nodes).withColumn("rows", data).filter(F.size("rows") > 0)
    tables = tables.withColumn("__cols", F.array_max(F.transform("rows", lambda r: F.size(r["cells"]))))
    tables = with_assigned_columns(tables, [f.key for f in fields], "headers", "__cols", "__at")
    rows = tables.select("page_id", "url", "__at", F.inline("rows" if max_records is None else F.slice("rows", 1, max_records))).filter(
        F.size("cells") >= 2
    )
    wide = rows.withColumns(
        {f"f{i}": F.get("cells", F.get("__at", F.lit(i)))["text"] for i in range(len(fields))}
    )
    free = [FieldSpec(f.name, None, f.type, f.label, f.user_label) for f in fields]
    return _finish(wide, free, 1, "table", "row_pos").withColumn("warnings", F.array().cast("array<string>"))


def extract_structured(
    pages: DataFrame, nodes: DataFrame, fields: list[FieldSpec], container: str | None, max_records: int | None = None
) -> DataFrame:
    """Strategy ladder per page: containers, else aligned fields, else a data table.

    A container selector that cannot be read counts as none, with a warning on
    every record.  Later strategies parse only the pages earlier ones left empty.  The records
    of a strategy are checkpointed before the next one starts: they are far
    smaller than the pages, and knowing which pages are done must not parse
    those pages again.
    """
    steps = [by_field_index, from_tables]
    bad = bool(container) and not is_valid(container)
    if container and not bad:
        steps.insert(0, lambda p, n, f, m: from_containers(p, n, f, container, m))
    out, left = None, pages
    for i, step in enumerate(steps):
        found = step(left, nodes, fields, max_records)
        if i < len(steps) - 1:
            found = cut_lineage(found)
            left = left.join(found.select("page_id").distinct(), "page_id", "left_anti")
            nodes = elements(place_pages(left))
        out = found if out is None else out.unionByName(found)
    if bad:
        out = out.withColumn("warnings", F.array_append("warnings", F.lit(BAD_CONTAINER.format(container))))
    return out


def typed(records: DataFrame, fields: list[FieldSpec]) -> DataFrame:
    """Typed columns for number and boolean fields: NULL where the text does not convert.

    A failed conversion keeps its text in ``<key>__text``.
    """
    for f in chosen(fields):
        kind = f.type.lower()
        if kind not in ("number", "boolean"):
            continue
        value = coerced(F.col(f"`{f.key}`"), F.lit(kind))
        records = records.withColumn("__c", value).withColumns(
            {
                f"{f.key}__text": F.when(F.col("__c.failed"), F.col("__c.value_str")),
                f.key: F.col("__c.value_num" if kind == "number" else "__c.value_bool"),
            }
        ).drop("__c")
    return records


def sample_values(
    pages: DataFrame, nodes: DataFrame, field: FieldSpec, container: str | None, max_rows: int | None = None
) -> DataFrame:
    """page_id, row_idx, value: what a selector reads per container (or per match)."""
    container = container if is_valid(container) else None
    variants = _variants([field], container)
    if container is None:
        rows = with_values(select_many(nodes, variants), pages, {0: field.type})
        page = Window.partitionBy("page_id")
        rows = rows.withColumn("__r", F.min("variant").over(page)).filter(F.col("variant") == F.col("__r"))
        rows = rows.withColumn("row_idx", F.row_number().over(page.orderBy("open_pos")) - 1)
        rows = rows if max_rows is None else rows.filter(F.col("row_idx") < max_rows)
        return rows.select("page_id", "row_idx", "value")
    hits = select_many(nodes, {"c|0": container, **variants})
    is_container = F.col("key") == "c|0"
    order = Window.partitionBy("page_id", "key").orderBy("open_pos")
    hits = hits.withColumn("row_idx", F.row_number().over(order) - 1)
    hits = hits if max_rows is None else hits.filter(~is_container | (F.col("row_idx") < max_rows))
    rows = with_values(assign_containers(hits, is_container, ~is_container), pages, {0: field.type})
    best = rows.groupBy("page_id", "container_pos").agg(
        F.min("variant").alias("r"),
        F.min(F.when(F.col("value").isNotNull(), F.struct("variant", "open_pos", "value"))).alias("b"),
    )
    frames = hits.filter(is_container).select("page_id", F.col("open_pos").alias("container_pos"), "row_idx")
    value = F.when(F.col("b.variant") == F.col("r"), F.col("b.value"))
    return frames.join(best, ["page_id", "container_pos"], "left").select("page_id", "row_idx", value.alias("value"))


def check_selectors(
    nodes: DataFrame, fields: list[FieldSpec], container: str | None, max_containers: int | None = None
) -> DataFrame:
    """Match check per (page, field): matched, working variant and container presence.

    Fields are probed in the containers of a page (the first ``max_containers``
    if given), or in the whole page when the container selector finds nothing.
    """
    container = container if is_valid(container) else None
    variants = _variants(fields, None)
    keys = {"c|0": container, **variants} if container else variants
    hits = select_many(nodes, keys)
    is_container = F.col("key") == "c|0"
    nth = F.row_number().over(Window.partitionBy("page_id", "key").orderBy("open_pos"))
    if max_containers is not None:
        hits = hits.withColumn("__n", nth).filter(~is_container | (F.col("__n") <= max_containers)).drop("__n")
    has_container = F.max(F.when(is_container, 1).otherwise(0)).over(Window.partitionBy("page_id"))
    hits = hits.withColumn("has_container", has_container == 1)
    inside = mark_inside(hits, is_container, "__in").filter(~is_container & (F.col("__in") | ~F.col("has_container")))
    best = inside.groupBy("page_id", F.substring_index("key", "|", 1).cast("int").alias("field_idx")).agg(
        F.min(F.substring_index("key", "|", -1).cast("int")).alias("variant")
    )
    pages = nodes.groupBy("page_id").agg(F.lit(1).alias("one")).drop("one")
    present = hits.groupBy("page_id").agg(F.max("has_container").alias("has_container"))
    listed = F.array(
        *[
            F.struct(
                F.lit(i).alias("field_idx"), F.lit(f.key).alias("field"), F.lit(f.selector).alias("selector"),
                F.array(*[F.lit(v) for v in relaxed(f.selector or "")]).cast("array<string>").alias("options"),
            )
            for i, f in enumerate(fields)
            if f.selector
        ]
    )
    rows = pages.select("page_id", F.inline(listed))
    return (
        rows.join(best, ["page_id", "field_idx"], "left")
        .join(present, "page_id", "left")
        .select(
            "page_id",
            "field",
            F.coalesce("has_container", F.lit(False)).alias("container_matched"),
            F.col("variant").isNotNull().alias("matched"),
            F.coalesce(F.col("variant") > 0, F.lit(False)).alias("relaxed"),
            F.coalesce(F.get("options", F.col("variant")), F.col("selector")).alias("selector"),
        )
    )


def lint_confidence(confidence: Column, matched: Column) -> Column:
    """Confidence of a field after the check: at most 0.3 for a selector that found nothing."""
    return F.when(matched, confidence).otherwise(F.round(F.least(F.coalesce(confidence, F.lit(0.0)), F.lit(0.3)), 2))


def analysis_confidence(confidence: Column, container_matched: Column) -> Column:
    """Confidence of the analysis: at most 0.4 when its container found nothing."""
    lowered = F.round(F.least(F.coalesce(confidence, F.lit(0.5)), F.lit(0.4)), 2)
    return F.when(container_matched, confidence).otherwise(lowered)


def selector_counts(nodes: DataFrame, selector: str) -> DataFrame:
    """page_id, n_elements, n_anchors matched by a selector."""
    return (
        mark_selected(nodes, selector, "__hit")
        .filter("__hit")
        .groupBy("page_id")
        .agg(F.count("*").alias("n_elements"), F.count_if(F.col("tag") == "a").alias("n_anchors"))
    )


def selector_links(pages: DataFrame, nodes: DataFrame, selector: str) -> DataFrame:
    """Same-origin links of anchors the selection matches or contains.

    page_id, page_url, pos (first position), normalized_url.
    """
    flagged = mark_inside(mark_selected(nodes, selector, "__sel"), F.col("__sel") & (F.col("tag") != "a"), "__under")
    anchors = flagged.filter(
        (F.col("tag") == "a") & (F.col("__sel") | F.col("__under")) & attr("href").isNotNull()
    ).select("page_id", F.col("open_pos").alias("pos"), strip_ends(attr("href")).alias("href"))
    base = with_parts(pages.select("page_id", F.col("url").alias("page_url")), "page_url", "b_")
    links = with_normalized_reference(
        anchors.filter(~is_navigation(F.col("href"))).join(base, "page_id"), "href", "b_", "normalized_url"
    )
    return (
        links.filter(origin_of(F.col("normalized_url")) == origin_of(F.col("page_url")))
        .groupBy("page_id", "page_url", "normalized_url")
        .agg(F.min("pos").alias("pos"))
    )


# --- long form and previews -------------------------------------------------------------


def to_cells(records: DataFrame, keys: list[str], with_source: bool = True) -> DataFrame:
    """Long form: page_id, record_ordinal, field, value, present."""
    names = keys + (["source_url"] if with_source else [])
    cells = F.array(*[F.struct(F.lit(k).alias("field"), F.col(f"`{k}`").cast("string").alias("value")) for k in names])
    return records.select("page_id", "record_ordinal", F.inline(cells)).withColumn(
        "present", F.coalesce(is_present(F.col("value")), F.lit(False))
    )
