"""Structural profile of pages: the facts a page summary is written from."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagesieve.functions.text import collapse, decode_entities
from pagesieve.operators.nodes import attr, classes, read_once, with_texts
from pagesieve.operators.select import assign_containers, mark_inside


@dataclass(frozen=True)
class Limits:
    """How much of a page a profile shows; None is all of it."""

    json_ld: int | None = None
    headings: int | None = None
    links: int | None = None
    classes: int | None = None
    class_samples: int | None = None
    tables: int | None = None
    table_rows: int | None = None
    data_attributes: int | None = None
    candidates: int | None = None
    text_chars: int | None = None
    attribute_chars: int | None = None
    href_chars: int | None = None
    snippet_chars: int | None = None
    summary_chars: int | None = None


ALL = Limits()
# The extent of a short profile, as a prompt uses it.
BRIEF = Limits(3, 8, 12, 15, 5, 3, 3, 20, 4, 200, 120, 80, 600, 10_000)


def _cut(text: Column, chars: int | None) -> Column:
    return text if chars is None else F.substring(text, 1, chars)


# Words of paging controls.
PAGING_WORDS = "(?i)(next|prev|page|more|load|→|»)"

_JSON_LD = r"(?i)<script\b[^>]*type\s*=\s*[\"']?application/ld\+json[\"']?[^>]*>([\s\S]*?)</script\s*>"


def _joined(limits: Limits, pieces: str = "text_pieces") -> Column:
    """Text pieces space-joined without collapsing, cut for display."""
    return _cut(F.array_join(F.filter(pieces, lambda t: t != ""), " "), limits.text_chars)


def head_facts(pages: DataFrame, limits: Limits = ALL) -> DataFrame:
    """page_id, title, meta_description, json_ld objects, read in the row.

    Taken from the page as fetched, so script and head content is still there.
    """
    title = F.regexp_extract("html", r"(?i)<title\b[^>]*>([\s\S]*?)</title\s*>", 1)
    meta_tag = F.regexp_extract("html", r"(?i)<meta\b[^>]*\bname\s*=\s*[\"']?description\b[^>]*>", 0)
    blocks = F.transform(
        F.regexp_extract_all("html", F.lit(_JSON_LD), F.lit(1)),
        lambda b: F.struct(
            F.get_json_object(b, "$['@type']").alias("type"),
            F.get_json_object(b, "$.name").alias("name"),
            F.get_json_object(b, "$.description").alias("description"),
            F.rlike(b, F.lit(r"^\s*\{")).alias("is_object"),
        ),
    )
    kept = F.filter(blocks, lambda b: b["is_object"])
    kept = kept if limits.json_ld is None else F.slice(kept, 1, limits.json_ld)
    return pages.select(
        "page_id",
        F.nullif(_cut(collapse(decode_entities(title)), limits.text_chars), F.lit("")).alias("title"),
        _cut(attr("content", meta_tag), limits.text_chars).alias("meta_description"),
        F.transform(
            kept, lambda b: F.struct(b["type"].alias("type"), b["name"].alias("name"), b["description"].alias("description"))
        ).alias("json_ld"),
    )


def _top(ranked: DataFrame, limit: int | None, rank: str = "rank") -> DataFrame:
    return ranked if limit is None else ranked.filter(F.col(rank) <= limit)


def _first(rows: DataFrame, limit: int | None, order: str = "open_pos") -> DataFrame:
    n = F.row_number().over(Window.partitionBy("page_id").orderBy(order))
    return _top(rows.withColumn("rank", n), limit)


def headings(pages: DataFrame, nodes: DataFrame, limits: Limits = ALL) -> DataFrame:
    """h1-h3 elements: page_id, rank, tag, text."""
    rows = _first(nodes.filter(F.col("tag").isin("h1", "h2", "h3")), limits.headings)
    return with_texts(rows, pages).select("page_id", "rank", "tag", _joined(limits).alias("text"))


def repeated_classes(nodes: DataFrame, limits: Limits = ALL) -> DataFrame:
    """Classes used three times or more: page_id, rank, class, n; ties by first use."""
    counts = (
        nodes.select("page_id", "open_pos", F.posexplode(classes()).alias("i", "class"))
        .groupBy("page_id", "class")
        .agg(F.count("*").alias("n"), F.min(F.struct("open_pos", "i")).alias("first"))
        .filter(F.col("n") >= 3)
    )
    n = F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc("n"), "first"))
    return _top(counts.withColumn("rank", n), limits.classes).select("page_id", "rank", "class", "n")


def class_samples(pages: DataFrame, nodes: DataFrame, limits: Limits = ALL) -> DataFrame:
    """Selector hint of the first element of each repeated class, commonest first."""
    top = _top(repeated_classes(nodes, limits), limits.class_samples)
    uses = nodes.select("page_id", "open_pos", "tag", "token", F.explode(classes()).alias("class"))
    first = uses.groupBy("page_id", "class").agg(F.min(F.struct("open_pos", "tag", "token")).alias("e"))
    names = F.slice(classes(F.col("e.token")), 1, 2)
    hint = F.concat(F.col("e.tag"), F.lit("."), F.array_join(names, "."))
    return top.join(first, ["page_id", "class"]).select("page_id", "rank", "class", hint.alias("selector_hint"))


def table_samples(pages: DataFrame, nodes: DataFrame, limits: Limits = ALL) -> DataFrame:
    """Rows of the tables: page_id, table_idx, row_idx, line.

    One pass over the elements: tables and rows are numbered as they open, and what lies inside carries their numbers.
    """
    tag, rows = F.col("tag"), (Window.unboundedPreceding, 0)
    opened = lambda kind, *keys: F.count_if(tag == kind).over(Window.partitionBy(*keys).orderBy("open_pos").rowsBetween(*rows)).cast("int")
    parts = nodes.filter(tag.isin("table", "tr", "td", "th")).withColumn("table_idx", opened("table", "page_id"))
    inside = assign_containers(parts, tag == "table", tag != "table", carried=("table_idx",)).withColumnRenamed("container_pos", "table_pos")
    inside = _top(inside, limits.tables, "table_idx").withColumn("row_idx", opened("tr", "page_id", "table_pos"))
    cells = assign_containers(inside, tag == "tr", tag != "tr", ("page_id", "table_pos"), ("row_idx",))
    kept = _top(cells, limits.table_rows, "row_idx")
    text = with_texts(kept, pages).withColumn("cell", _joined(limits)).filter(F.col("cell") != "")
    return text.groupBy("page_id", "table_idx", "row_idx").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("open_pos", "cell"))), lambda c: c["cell"]), " | ").alias("line")
    )


def data_attributes(nodes: DataFrame, limits: Limits = ALL) -> DataFrame:
    """First value of each data-* attribute: page_id, rank, name, value."""
    pairs = F.regexp_extract_all("token", F.lit(r"(?i)\sdata-[\w-]+\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>\"']+)"), F.lit(0))
    rows = nodes.filter(F.contains(F.lower("token"), F.lit("data-"))).select(
        "page_id", "open_pos", F.posexplode(pairs).alias("i", "pair")
    )
    name = F.lower(F.regexp_extract("pair", r"(?i)(data-[\w-]+)", 1))
    value = F.regexp_replace(F.regexp_replace("pair", r"^[^=]*=\s*", ""), "^[\"']|[\"']$", "")
    first = rows.groupBy("page_id", name.alias("name")).agg(
        F.min(F.struct("open_pos", "i", _cut(decode_entities(value), limits.attribute_chars).alias("value"))).alias("f")
    )
    n = F.row_number().over(Window.partitionBy("page_id").orderBy("f.open_pos", "f.i"))
    return _top(first.withColumn("rank", n), limits.data_attributes).select(
        "page_id", "rank", "name", F.col("f.value").alias("value")
    )


def paging_candidates(pages: DataFrame, nodes: DataFrame, limits: Limits = ALL) -> DataFrame:
    """Distinct selectors of links and buttons that look like paging: page_id, rank, selector."""
    rows = with_texts(nodes.filter(F.col("tag").isin("a", "button")), pages)
    names = classes()
    looks = lambda text: F.rlike(F.coalesce(text, F.lit("")), F.lit(PAGING_WORDS))
    kept = rows.filter(looks(_joined(limits)) | looks(attr("href")) | looks(F.array_join(names, " ")))
    selector = F.concat(
        F.col("tag"), F.when(F.size(names) > 0, F.concat(F.lit("."), F.get(names, F.lit(0)))).otherwise(F.lit(""))
    )
    first = kept.groupBy("page_id", selector.alias("selector")).agg(F.min("open_pos").alias("open_pos"))
    return _first(first, limits.candidates).select("page_id", "rank", "selector")


def sample_links(pages: DataFrame, nodes: DataFrame, limits: Limits = ALL) -> DataFrame:
    """Anchors with a target, those with text shown: page_id, rank, text, href."""
    rows = _first(nodes.filter((F.col("tag") == "a") & attr("href").isNotNull()), limits.links)
    return (
        with_texts(rows, pages)
        .withColumn("label", _joined(limits))
        .filter(F.col("label") != "")
        .select("page_id", "rank", F.col("label").alias("text"), _cut(attr("href"), limits.href_chars).alias("href"))
    )


def body_snippet(pages: DataFrame, nodes: DataFrame, limits: Limits = ALL) -> DataFrame:
    rows = with_texts(nodes.filter(F.col("tag") == "body"), pages)
    return rows.select("page_id", _cut(F.col("text"), limits.snippet_chars).alias("snippet"))


def _lines(rows: DataFrame, line: Column, title: str, out: str, separator: str = "\n") -> DataFrame:
    """Fold ranked rows of a page (a bounded handful) into one section."""
    listed = F.array_sort(F.collect_list(F.struct("rank", line.alias("line"))))
    text = F.array_join(F.transform(listed, lambda r: r["line"]), separator)
    return rows.groupBy("page_id").agg(F.concat(F.lit(title), text).alias(out))


#: Elements whose text a summary shows.
SUMMARY_TAGS = ("h1", "h2", "h3", "td", "th", "a", "button", "body")


def summary(pages: DataFrame, limits: Limits = ALL) -> DataFrame:
    """page_id, summary: the profile as one text, all sections from one reading of the pages."""
    pages, nodes = read_once(pages, SUMMARY_TAGS)
    q = lambda c: F.concat(F.lit("'"), F.col(c), F.lit("'"))
    sections = [
        _lines(headings(pages, nodes, limits), F.concat(F.lit("  ["), F.col("tag"), F.lit("] "), F.col("text")), "Headings:\n", "p_headings"),
        _lines(repeated_classes(nodes, limits), F.concat(F.lit("."), F.col("class")), "Repeated element classes (likely list/grid items): ", "p_classes", ", "),
        _lines(class_samples(pages, nodes, limits), F.concat(F.lit("Selector hint: "), F.col("selector_hint")), "Repeated container samples:\n", "p_samples"),
        _lines(
            table_samples(pages, nodes, limits).withColumn("rank", F.struct("table_idx", "row_idx")),
            F.concat(F.lit("  "), F.col("line")), "Table samples:\n", "p_tables",
        ),
        _lines(data_attributes(nodes, limits), F.concat(F.col("name"), F.lit("="), q("value")), "Data attributes found:\n  ", "p_data", "\n  "),
        _lines(sample_links(pages, nodes, limits), F.concat(F.lit("  "), q("text"), F.lit(" -> "), F.col("href")), "Sample links:\n", "p_links"),
        _lines(paging_candidates(pages, nodes, limits), F.col("selector"), "Pagination candidates: ", "p_paging", ", "),
    ]
    out = pages.select("page_id", "url").join(head_facts(pages, limits), "page_id", "left")
    for section in sections:
        out = out.join(section, "page_id", "left")
    out = out.join(body_snippet(pages, nodes, limits), "page_id", "left")
    text = F.concat_ws(
        "\n\n",
        F.concat(F.lit("URL: "), F.col("url")),
        F.concat(F.lit("Title: "), F.col("title")),
        F.concat(F.lit("Meta description: "), F.col("meta_description")),
        "p_headings",
        F.when(F.size("json_ld") > 0, F.concat(F.lit("Structured data (JSON-LD): "), F.to_json("json_ld"))),
        "p_classes", "p_samples", "p_tables", "p_data", "p_links", "p_paging",
        F.concat(F.lit("Body text snippet: "), F.col("snippet")),
    )
    return out.select("page_id", _cut(text, limits.summary_chars).alias("summary"))


def alternate_mode(pages: DataFrame, nodes: DataFrame, current: Column) -> DataFrame:
    """page_id, suggestion: the other mode when the page clearly holds that kind of data.

    ``current`` reads a column of ``pages``.  All facts come from one pass over the elements.
    """
    tag = F.col("tag")
    listed = tag.isin("div", "li", "article", "section")
    parts = with_texts(nodes.filter(listed | tag.isin("table", "tr", "p")), pages, ("p",))
    ends = F.when(tag == "table", F.array("open_pos", "close_pos")).otherwise(F.array("open_pos"))
    marks = parts.withColumn("at", F.explode(ends))
    so_far = Window.partitionBy("page_id").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    marks = marks.withColumn("rows", F.count_if(tag == "tr").over(so_far))
    fact = lambda kind, key, n: F.struct(F.lit(kind).alias("kind"), key.cast("string").alias("key"), n.cast("bigint").alias("n"))
    prose = F.length(F.array_join(F.filter("text_pieces", lambda t: t != ""), " "))
    # rows of a table: those begun at its end without those begun at its start
    told = F.array(
        F.when(listed, F.transform(classes(), lambda c: fact("class", c, F.lit(1)))),
        F.when(tag == "article", F.array(fact("article", F.lit(""), F.lit(1)))),
        F.when(tag == "p", F.array(fact("prose", F.lit(""), prose))),
        F.when(tag == "table", F.array(fact("table", F.col("open_pos"), F.col("rows")))),
    )
    facts = marks.select("page_id", F.inline(F.flatten(F.array_compact(told)))).groupBy("page_id", "kind", "key").agg(
        F.sum("n").alias("n"), (F.max("n") - F.min("n")).alias("rows")
    )
    of = lambda kind: F.when(F.col("kind") == kind, F.col("n"))
    found = facts.groupBy("page_id").agg(
        F.max(of("class")).alias("max_repeat"), F.count_if((F.col("kind") == "table") & (F.col("rows") >= 3)).alias("big_tables"),
        F.max(of("prose")).alias("prose"), F.max(of("article")).alias("articles"),
    )
    facts = pages.select("page_id", F.upper(current).alias("mode")).join(found, "page_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    structured = (zero("big_tables") >= 1) | (zero("max_repeat") >= 12)
    content = (zero("prose") >= 1200) | (zero("articles") >= 1)
    return facts.select(
        "page_id",
        F.when((F.col("mode") == "STRUCTURED") & content, "CONTENT")
        .when((F.col("mode") == "CONTENT") & structured, "STRUCTURED")
        .alias("suggestion"),
    )
