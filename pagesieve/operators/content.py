"""Readable content of a page: chrome removal, container choice, text and light Markdown.

Tokens and element ends form one ordered stream per page; everything is a
running window over that stream followed by one ordered concatenation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagesieve.functions.text import decode_entities, strip_ends
from pagesieve.operators.nodes import attr, classes, has_attr, tokens
from pagesieve.operators.select import mark_selected

MIN_CONTENT_CHARS = 200
SHORT_WARNING = (
    "Extracted content is very short — the page may be mostly navigation, an image/app, or rendered by JavaScript."
)

# Page furniture, decorations, and likely content containers, best first.
CHROME_TAGS = (
    "script", "style", "noscript", "template", "nav", "header", "footer", "aside", "form", "iframe", "svg",
)
MAIN_SELECTORS = (
    "main", "article", "[role=main]", "#content", "#main-content", "#main",
    ".content", ".article", ".post", ".entry-content", ".post-content",
)


def is_furniture() -> Column:
    """Elements removed, with everything inside, before content is read."""
    hidden = F.contains("token", F.lit("=")) & (
        F.array_contains(classes(), "headerlink") | F.coalesce(attr("aria-hidden") == "true", F.lit(False))
    )
    return F.col("tag").isin(*CHROME_TAGS) | hidden | (F.contains(F.lower("token"), F.lit("hidden")) & has_attr("hidden"))


def _stream(pages: DataFrame, nodes: DataFrame, selectors: list[str], primary: str | None) -> DataFrame:
    """Element starts, ends and text pieces in page order, with flags.

    step is 1 (start), -1 (end) or 0 (text); ``rank`` is the best matching
    selector index of an element, NULL otherwise.
    """
    for i, selector in enumerate(selectors):
        nodes = mark_selected(nodes, selector, f"__s{i}")
    rank = F.coalesce(*[F.when(F.col(f"__s{i}"), F.lit(i)) for i in range(len(selectors))])
    nodes = nodes.withColumns({"rank": rank, "gone": is_furniture()})
    nodes = mark_selected(nodes, primary, "preferred") if primary else nodes.withColumn("preferred", F.lit(False))
    keep = [F.col(c) for c in ("open_pos", "close_pos", "tag", "token", "rank", "preferred", "gone", "parent_tag", "parent_token", "type_idx", "sibling_idx", "siblings")]
    marks = nodes.select(
        "page_id",
        F.inline(
            F.array(
                F.struct(F.col("open_pos").alias("at"), F.lit(1).alias("step"), *keep),
                F.struct(F.col("close_pos").alias("at"), F.lit(-1).alias("step"), *keep),
            )
        ),
    )
    texts = tokens(pages, blanks=True).filter(F.col("kind") == "text").select(
        "page_id", (F.col("pos") * 2).alias("at"), F.lit(0).alias("step"), decode_entities(F.col("token")).alias("token")
    )
    return marks.unionByName(texts, allowMissingColumns=True)


def content_pieces(pages: DataFrame, nodes: DataFrame, primary: str | None = None) -> DataFrame:
    """The stream inside each page's content container, furniture removed."""
    stream = _stream(pages, nodes, list(MAIN_SELECTORS) + ["body"], primary)
    page = Window.partitionBy("page_id")
    order = page.orderBy("at", F.desc("step"), F.desc("open_pos"))
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    reach = F.max(F.when((F.col("step") == 1) & F.col("gone"), F.col("close_pos"))).over(so_far)
    stream = stream.withColumn("__out", F.coalesce(F.col("at") <= reach, F.lit(False))).filter(~F.col("__out"))
    piece = strip_ends(F.col("token"))
    length = F.when((F.col("step") == 0) & (piece != ""), F.length(piece) + 1).otherwise(0)
    stream = stream.withColumn("chars", F.sum(length).over(so_far))
    # Text length of an element: characters counted at its end minus at its start.
    element = Window.partitionBy("page_id", "open_pos")
    stream = stream.withColumn(
        "size", F.when(F.col("step") != 0, F.max("chars").over(element) - F.min("chars").over(element) - 1)
    )
    lead = F.min(F.when(F.col("preferred"), F.col("open_pos"))).over(page)
    body = F.lit(len(MAIN_SELECTORS))
    # A primary match with enough text, else the densest likely container, else the body.
    wanted = (
        F.when((F.col("open_pos") == F.col("__lead")) & (F.col("size") >= MIN_CONTENT_CHARS), 2)
        .when((F.col("rank") < body) & (F.col("size") > 0), 1)
        .when(F.col("rank") == body, 0)
    )
    stream = stream.withColumn("__lead", lead).withColumn("wanted", wanted)
    choice = F.struct(
        F.col("wanted"),
        F.when(F.col("wanted") == 1, F.col("size")).otherwise(0).alias("size"),
        (-F.coalesce("rank", F.lit(0))).alias("by_rank"),
        (-F.col("open_pos")).alias("by_pos"),
        "open_pos",
        "close_pos",
    )
    best = F.max(F.when(F.col("wanted").isNotNull(), choice)).over(page)
    return (
        stream.withColumn("place", best)
        .filter(
            F.col("place").isNull()
            | ((F.col("at") > F.col("place.open_pos")) & (F.col("at") < F.col("place.close_pos")))
        )
        .drop("place", "chars", "size", "wanted", "__out", "__lead")
    )


def readable_text(pages: DataFrame, nodes: DataFrame, primary: str | None = None) -> DataFrame:
    """page_id, text: one line per text piece, blanks collapsed, empty lines dropped."""
    line = F.trim(F.regexp_replace("token", r"[ \t\r\f\x0b ]+", " "))
    pieces = content_pieces(pages, nodes, primary).filter(F.col("step") == 0)
    joined = pieces.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("at", line.alias("line")))).alias("l"))
    text = F.array_join(F.transform("l", lambda p: p["line"]), "\n")
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return joined.select("page_id", F.array_join(lines, "\n").alias("text"))


def _code_language(token: Column) -> Column:
    """Language named by the classes of an open tag; NULL without one."""
    found = F.filter(
        F.transform(classes(token), lambda c: F.regexp_extract(c, "^(?:language|lang|highlight)-(.+)$", 1)), lambda c: c != ""
    )
    return F.get(found, F.lit(0))


# Block elements that stand on their own lines.
_PARAGRAPHS = (
    "p", "div", "section", "article", "main", "table", "ul", "ol", "dl", "dt", "dd", "blockquote",
    "figure", "figcaption", "address", "details", "summary", "fieldset",
)


INDENT = "\x00"  # stands for a list level until blanks are trimmed; a page cannot hold it


def markdown(pages: DataFrame, nodes: DataFrame, primary: str | None = None) -> DataFrame:
    """page_id, text: headings, nested lists, links, emphasis, tables and fenced code, blank runs trimmed.

    A fence names the language of the ``pre`` element, else of its parent, else
    of a ``code`` element that opens it.  The first row of a table is its head.
    """
    pieces = content_pieces(pages, nodes, primary)
    tag, start, text = F.col("tag"), F.col("step") == 1, F.col("step") == 0
    order = Window.partitionBy("page_id").orderBy("at", F.desc("step"), F.desc("open_pos"))
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    pre_end = F.max(F.when(start & (tag == "pre"), F.col("close_pos"))).over(so_far)
    in_pre = F.coalesce(F.col("at") < pre_end, F.lit(False))
    code = F.when((F.lead("tag").over(order) == "code") & (F.lead("step").over(order) == 1), F.lead("token").over(order))
    is_list = tag.isin("ul", "ol")
    depth = F.sum(F.when(is_list, F.col("step")).otherwise(0)).over(so_far) + F.when(is_list & ~start & ~text, 1).otherwise(0)
    rows = F.sum(F.when(start & (tag == "tr"), 1).otherwise(0)).over(so_far)
    pieces = pieces.withColumns({"__code": code, "__depth": depth, "__rows": rows})
    row = F.col("__rows") - F.last(F.when(start & (tag == "table"), F.col("__rows")), ignorenulls=True).over(so_far)
    pieces = pieces.withColumn("__row", row)
    language = F.coalesce(_code_language(F.col("token")), _code_language(F.col("parent_token")), _code_language(F.col("__code")), F.lit(""))
    cell_end = F.when(
        (F.col("__row") == 1) & (F.col("sibling_idx") == F.col("siblings")),
        F.concat(F.lit(" |\n|"), F.repeat(F.lit(" --- |"), F.col("siblings").cast("int"))),
    ).otherwise(F.lit(" |"))
    level = F.regexp_extract(tag, "^h([1-6])$", 1)
    href = F.coalesce(attr("href"), F.lit(""))
    both = lambda opening, closing: F.when(start, opening).otherwise(closing)
    mark = (
        F.when(text, F.when(F.col("__pre"), F.col("token")).otherwise(F.regexp_replace("token", r"\s+", " ")))
        .when(level != "", both(F.concat(F.lit("\n\n"), F.repeat(F.lit("#"), level.cast("int")), F.lit(" ")), F.lit("\n\n")))
        .when(tag == "pre", both(F.concat(F.lit("\n\n```"), language, F.lit("\n")), F.lit("\n```\n\n")))
        .when(F.col("__pre"), F.lit(""))
        .when(
            tag == "li",
            both(
                F.concat(
                    F.lit("\n"), F.repeat(F.lit(INDENT), F.col("__depth").cast("int") - 1),
                    F.when(F.col("parent_tag") == "ol", F.concat(F.col("type_idx").cast("string"), F.lit(". "))).otherwise(F.lit("- ")),
                ),
                F.lit(""),
            ),
        )
        .when(is_list & (F.col("__depth") > 1), F.lit(""))
        .when(tag == "tr", both(F.lit("\n|"), F.lit("")))
        .when(tag.isin("td", "th"), both(F.lit(" "), cell_end))
        .when(tag.isin(*_PARAGRAPHS) & F.col("parent_tag").isin("td", "th"), F.lit(""))
        .when(tag.isin(*_PARAGRAPHS), F.lit("\n\n"))
        .when(tag == "br", both(F.lit("\n"), F.lit("")))
        .when(tag == "hr", both(F.lit("\n\n---\n\n"), F.lit("")))
        .when(tag.isin("b", "strong"), F.lit("**"))
        .when(tag.isin("em", "i"), F.lit("*"))
        .when(tag == "code", F.lit("`"))
        .when((tag == "a") & (href != ""), both(F.lit("["), F.concat(F.lit("]("), href, F.lit(")"))))
        .otherwise(F.lit(""))
    )
    pieces = pieces.withColumn("__pre", in_pre).withColumn("mark", mark).withColumn("__n", F.row_number().over(order))
    joined = pieces.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("__n", "mark"))).alias("m"))
    body = F.array_join(F.transform("m", lambda p: p["mark"]), "")
    body = F.regexp_replace(body, r"\s+\*\*(?=\n|$)", "**")
    body = F.regexp_replace(F.regexp_replace(body, r"[ \t]+\n", "\n"), r"\n[ \t]+(?=\S)", "\n")
    body = F.replace(body, F.lit(INDENT), F.lit("  "))
    return joined.select("page_id", strip_ends(F.regexp_replace(body, r"\n{3,}", "\n\n")).alias("text"))


def content_records(pages: DataFrame, nodes: DataFrame, primary: str | None = None) -> DataFrame:
    """One record per page with content: page_id, source_url, content, warnings."""
    text = markdown(pages, nodes, primary).filter(F.col("text") != "")
    short = F.when(F.length("text") < MIN_CONTENT_CHARS, F.array(F.lit(SHORT_WARNING)))
    return text.join(pages.select("page_id", "url"), "page_id").select(
        "page_id",
        F.col("url").alias("source_url"),
        F.col("text").alias("content"),
        F.coalesce(short, F.array().cast("array<string>")).alias("warnings"),
    )


def legacy_text(pages: DataFrame, nodes: DataFrame, max_chars: int | None = None) -> DataFrame:
    """page_id, content: title line and the text nodes outside page furniture, one per line."""
    from pagesieve.operators.nodes import with_texts
    from pagesieve.operators.select import mark_inside

    drop = F.col("tag").isin("nav", "footer", "header", "aside")
    titles = with_texts(nodes.filter(F.col("tag") == "title"), pages).groupBy("page_id").agg(
        F.min(F.struct("open_pos", "text")).alias("t")
    )
    holes = nodes.filter(drop).groupBy("page_id").agg(F.collect_list(F.struct("text_from", "text_to")).alias("holes"))
    from pagesieve.operators.nodes import page_texts

    joined = page_texts(pages).join(holes, "page_id", "left")
    cut = F.filter(
        "texts",
        lambda t, i: (t != "")
        & ~F.exists(F.coalesce("holes", F.array().cast("array<struct<text_from:bigint,text_to:bigint>>")), lambda h: (i >= h["text_from"]) & (i < h["text_to"])),
    )
    text = F.array_join(cut, "\n")
    text = text if max_chars is None else F.substring(text, 1, max_chars)
    return joined.withColumn("body", text).join(titles, "page_id", "left").select(
        "page_id",
        F.when(F.col("t.text").isNotNull(), F.concat(F.lit("Title: "), F.col("t.text"), F.lit("\n\n"), F.col("body")))
        .otherwise(F.col("body"))
        .alias("content"),
    )
