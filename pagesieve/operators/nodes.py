"""Markup as tables: tokens, then one row per element.

Pages are placed by ``page_id`` once (:func:`place_pages`); every later step is
a window or aggregate whose grouping starts with ``page_id``, so it sorts inside
the partition and never shuffles again.  Groups are single pages, whose size the
page scan bounds.

Elements are intervals ``[open_pos, close_pos]`` that nest or stay apart:

1. open and close tags of the same name pair up by running balance;
2. opens left without a partner (and every paragraph, which cannot nest) end
   where the next tag that implies it starts, or with the enclosing element;
3. the surviving start and end marks are matched again by depth alone, which
   repairs crossing tags.

Positions are doubled so an implied end (``2 * pos - 1``) falls between tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagesieve.functions.text import decode_entities, strip_ends, without_code
from pagesieve.session import cut_lineage

_TOKEN = r"</?[a-zA-Z](?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|<[^>]*+>|[^<]++|<"
_TAG_LIKE = r"^<[a-zA-Z/!?]"
_FOREVER = 2_000_000_000

# Elements without content, and the tags that end an open element.
VOID_TAGS = (
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param",
    "source", "track", "wbr",
)
BLOCK_TAGS = (
    "address", "article", "aside", "blockquote", "center", "dd", "details", "dir", "div", "dl",
    "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5",
    "h6", "header", "hr", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "table",
    "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
)
ENDERS = {
    "li": ("li",),
    "dt": ("dt", "dd"),
    "dd": ("dt", "dd"),
    "td": ("td", "th", "tr", "tbody", "tfoot", "thead"),
    "th": ("td", "th", "tr", "tbody", "tfoot", "thead"),
    "tr": ("tr", "tbody", "tfoot", "thead"),
    "thead": ("tbody", "tfoot", "thead"),
    "tbody": ("tbody", "tfoot", "thead"),
    "tfoot": ("tbody", "tfoot", "thead"),
    "option": ("option", "optgroup"),
    "optgroup": ("optgroup",),
}
# Elements that hold other blocks: left open, they end only with their parent.
_OPEN_ENDED = ("html", "body", "div", "ul", "ol", "dl", "table", "section", "article", "main", "nav", "form")


# Html of one task, in bytes: its tokens, elements and sort buffers take some hundred times as much memory.
TASK_BYTES = 2 << 20


def partitions_for(pages: DataFrame) -> int | None:
    """How many partitions the pages are placed in; None leaves it to adaptive execution.

    Small inputs are left to it: it merges the partitions by their real sizes.
    It goes by compressed bytes, though, and by the cores at
    hand, so a task would grow with the input: beyond ``TASK_BYTES`` of html for
    every core the bytes are counted first (one number) and give the partitions.
    """
    spark = pages.sparkSession
    if "html" not in pages.columns or pages.isStreaming:
        return None
    size = pages.agg(F.sum(F.octet_length("html").cast("bigint"))).first()[0] or 0
    if size <= TASK_BYTES * spark.sparkContext.defaultParallelism:
        return None
    # more than other shuffles have: joins by page keep these partitions, and Spark does not drop
    # the shuffle in favour of an equal one below it, which it would merge again
    return max(-(-size // TASK_BYTES), int(spark.conf.get("spark.sql.shuffle.partitions")) + 1)


def _placed(rows: DataFrame, count: int | None) -> DataFrame:
    return rows.repartition("page_id") if count is None else rows.repartition(count, "page_id")


def place_pages(pages: DataFrame) -> DataFrame:
    """Hash pages by id into as many partitions as their bytes ask for; the windows that follow are already in place."""
    return _placed(pages, partitions_for(pages))


def _raw_tokens(pages: DataFrame) -> Column:
    """Tokens of the pages, read from html unless :func:`read_once` has done so."""
    return F.col("__tokens") if "__tokens" in pages.columns else F.regexp_extract_all(without_code(F.col("html")), F.lit(_TOKEN), F.lit(0))


def _is_text(token: Column) -> Column:
    return ~F.rlike(token, F.lit(_TAG_LIKE)) & F.rlike(token, F.lit(r"(?U)\S"))


def tokens(pages: DataFrame, blanks: bool = False) -> DataFrame:
    """page_id, pos, kind (open, close, void, text), tag, token in page order.

    ``blanks`` keeps whitespace between tags as text.
    """
    token = F.col("token")
    name = F.lower(F.regexp_extract(token, r"^</?([a-zA-Z][^\s/>]*)", 1))
    return (
        pages.select("page_id", F.posexplode(_raw_tokens(pages)).alias("pos", "token"))
        .withColumn("tag", name)
        .withColumn(
            "kind",
            F.when(~F.rlike(token, F.lit(_TAG_LIKE)) if blanks else _is_text(token), "text")
            .when(F.col("tag") == "", None)
            .when(F.startswith(token, F.lit("</")), "close")
            .when(F.col("tag").isin(*VOID_TAGS) | F.endswith(token, F.lit("/>")), "void")
            .otherwise("open"),
        )
        .filter(F.col("kind").isNotNull())
    )


def page_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, texts: every text piece of a page, decoded, in order.

    Built inside the row; an element's text is the slice its node points at.
    """
    pieces = F.filter(_raw_tokens(pages), _is_text)
    return pages.select(
        "page_id", "url", F.transform(pieces, lambda t: strip_ends(decode_entities(t))).alias("texts")
    )


def with_parent_value(nodes: DataFrame, value: Column, out: str, pos: str = "open_pos") -> DataFrame:
    """Add ``out``: ``value`` evaluated at each node's parent.

    Every node is laid out twice, once at its own depth as a provider and once
    at the depth above as a seeker; the last provider before a seeker is its
    parent.  No join, and rows grow by a factor of two at most.
    """
    role = F.array(
        F.struct(F.col("depth").alias("at"), F.lit(True).alias("own")),
        F.struct((F.col("depth") - 1).alias("at"), F.lit(False).alias("own")),
    )
    laid = nodes.withColumn("__v", value).select("*", F.inline(role))
    before = Window.partitionBy("page_id", "at").orderBy(pos, "own").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("own"), F.struct(F.col("__v").alias("v"))), ignorenulls=True).over(before)
    return laid.withColumn(out, last["v"]).filter(~F.col("own")).drop("__v", "at", "own")


def _ending(rows: DataFrame) -> DataFrame:
    """Pair tags by name, then give partnerless opens an implied end."""
    in_page = Window.partitionBy("page_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    texts_so_far = F.sum(F.when(F.col("kind") == "text", 1).otherwise(0)).over(in_page)
    rows = rows.withColumn("text_from", texts_so_far).filter(F.col("kind") != "text")
    step = F.when(F.col("kind") == "open", 1).when(F.col("kind") == "close", -1).otherwise(0)
    by_tag = Window.partitionBy("page_id", "tag").orderBy("pos")
    running = by_tag.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("step", step).withColumn("balance", F.sum("step").over(running))
    level = F.when(F.col("tag") == "p", 0).when(F.col("step") == -1, F.col("balance") + 1).otherwise(F.col("balance"))
    rows = rows.withColumn("level", level)
    same = Window.partitionBy("page_id", "tag", "level").orderBy("pos")
    rows = rows.withColumns(
        {
            "next_step": F.lead("step").over(same),
            "next_pos": F.lead(F.struct("pos", "text_from")).over(same),
            "last_step": F.lag("step").over(same),
        }
    )
    paired = F.when((F.col("step") == 1) & (F.col("next_step") == -1), F.col("next_pos"))
    is_p = F.col("tag") == "p"
    rows = rows.withColumn("partner", paired).withColumn(
        "mark",
        F.when(is_p, 0)
        .when((F.col("step") == 1) & F.col("partner").isNotNull(), 1)
        .when((F.col("step") == -1) & (F.col("last_step") == 1), -1)
        .otherwise(0),
    )
    rows = rows.withColumn("covered", F.sum("mark").over(in_page)).filter(
        (F.col("kind") != "close") | (F.col("mark") == -1)
    )
    # Opens sit in the group of the element around them, a close in the group it ends.
    rows = rows.withColumn("inside", F.col("covered") - F.col("mark"))
    after = (
        Window.partitionBy("page_id", "inside").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, -1)
    )
    starts, here = F.col("kind") != "close", F.struct("pos", "text_from")
    next_of = lambda tags: F.min(F.when(starts & F.col("tag").isin(*tags), here)).over(after)
    families = sorted({tags for tags in ENDERS.values()})
    rows = rows.withColumns(
        {
            "end_parent": F.min(F.when(F.col("mark") == -1, here)).over(after),
            "end_block": next_of(BLOCK_TAGS),
            **{f"end_{i}": next_of(tags) for i, tags in enumerate(families)},
        }
    )
    nowhere = F.struct(F.lit(_FOREVER // 2).alias("pos"), F.lit(_FOREVER).cast("bigint").alias("text_from"))
    implied = F.when(F.col("tag").isin(*_OPEN_ENDED), nowhere)
    for tag, tags in ENDERS.items():
        implied = implied.when(F.col("tag") == tag, F.col(f"end_{families.index(tags)}"))
    implied = implied.otherwise(F.col("end_block"))
    before = F.least(implied, F.col("end_parent"), nowhere)
    at = lambda found, shift: F.struct((found["pos"] * 2 + shift).alias("pos"), found["text_from"].alias("text_to"))
    close = (
        F.when(F.col("kind") == "void", at(here, 1))
        .when(is_p & F.col("partner").isNotNull(), F.least(at(F.col("partner"), 0), at(before, -1)))
        .when(F.col("partner").isNotNull(), at(F.col("partner"), 0))
        .otherwise(at(before, -1))
    )
    return rows.filter(F.col("kind") != "close").select(
        "page_id", (F.col("pos") * 2).alias("open_pos"), close.alias("end"), "tag", "token", "text_from"
    )


def elements(pages: DataFrame) -> DataFrame:
    """One row per element.

    page_id, open_pos, close_pos, depth, tag, token (the open tag, read with
    :func:`attr`), class_attr, id_attr, parent_pos, parent_tag, parent_token,
    text_from/text_to (slice of :func:`page_texts`), sibling_idx and type_idx
    (1-based), siblings and type_siblings (how many there are).  Columns a query does not use are pruned.  ``pages`` should come from
    :func:`place_pages`.
    """
    spans = _ending(tokens(pages))
    marks = spans.select(
        "page_id",
        F.inline(
            F.array(
                F.struct(
                    F.col("open_pos").alias("at_pos"), F.lit(1).alias("step"), F.col("tag"), F.col("token"),
                    F.col("text_from"),
                ),
                F.struct(
                    F.col("end.pos").alias("at_pos"), F.lit(-1).alias("step"), F.lit(None).cast("string").alias("tag"),
                    F.lit(None).cast("string").alias("token"), F.col("end.text_to").alias("text_from"),
                ),
            )
        ),
    )
    in_page = Window.partitionBy("page_id").orderBy("at_pos", "step").rowsBetween(Window.unboundedPreceding, 0)
    marks = marks.withColumn("sum", F.sum("step").over(in_page)).withColumn(
        "depth", F.when(F.col("step") == 1, F.col("sum")).otherwise(F.col("sum") + 1)
    )
    # At one depth starts and ends alternate, so the next mark is the end.
    same = Window.partitionBy("page_id", "depth").orderBy("at_pos", F.desc("step"))
    nodes = (
        marks.withColumns({"close_pos": F.lead("at_pos").over(same), "text_to": F.lead("text_from").over(same)})
        .filter(F.col("step") == 1)
        .withColumnRenamed("at_pos", "open_pos")
        .drop("step", "sum")
    )
    parent = F.struct(F.col("open_pos").alias("pos"), F.col("tag").alias("tag"), F.col("token").alias("token"))
    nodes = with_parent_value(nodes, parent, "__up")
    nodes = nodes.withColumns(
        {
            "parent_pos": F.coalesce(F.col("__up.pos"), F.lit(-1)),
            "parent_tag": F.col("__up.tag"),
            "parent_token": F.col("__up.token"),
            "class_attr": attr("class"),
            "id_attr": attr("id"),
        }
    ).drop("__up")
    siblings = Window.partitionBy("page_id", "parent_pos").orderBy("open_pos")
    typed = Window.partitionBy("page_id", "parent_pos", "tag").orderBy("open_pos")
    return nodes.withColumns(
        {
            "sibling_idx": F.row_number().over(siblings),
            "type_idx": F.row_number().over(typed),
            "siblings": F.count("*").over(Window.partitionBy("page_id", "parent_pos")),
            "type_siblings": F.count("*").over(Window.partitionBy("page_id", "parent_pos", "tag")),
        }
    )


def with_texts(nodes: DataFrame, pages: DataFrame, tags: tuple[str, ...] | None = None) -> DataFrame:
    """Attach url, text_pieces and text to (selected) nodes: one page-keyed join.

    Only the slice of pieces inside the element is touched; ``tags`` names the
    elements whose text is asked for (others get NULL).  Nodes that have their
    texts are left as they are.
    """
    if "text_pieces" in nodes.columns:
        return nodes
    count = F.least(F.col("text_to"), F.size("texts").cast("bigint")) - F.col("text_from")
    inner = F.slice("texts", (F.col("text_from") + 1).cast("int"), count.cast("int"))
    inner = inner if tags is None else F.when(F.col("tag").isin(*tags), inner)
    joined = nodes.join(page_texts(pages), "page_id").withColumn("text_pieces", inner).drop("texts")
    whole = F.regexp_replace(F.array_join(F.col("text_pieces"), " "), r"(?U)\s+", " ")
    return joined.withColumn("text", F.nullif(F.trim(whole), F.lit("")))


def read_once(pages: DataFrame, tags: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """Placed pages, and all their elements with the texts of those named in ``tags``.

    For operators that look at a page from several sides: it is tokenised once,
    its tree is built once, and both are written to the shared folder.  Written
    rows no longer tell where they lie, so both are placed again, in as many
    partitions: the windows that follow would shuffle them to the session's count.
    """
    count = partitions_for(pages)
    held = _placed(cut_lineage(_placed(pages, count).withColumn("__tokens", _raw_tokens(pages))), count)
    return held, _placed(cut_lineage(with_texts(elements(held), held, tags)), count)


def _attr_regex(name: str, tail: str) -> str:
    """Open-tag regex that walks attributes in order up to ``name``."""
    value = r"(?:\s*=\s*(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"']++))?+"
    other = r"(?:\s+(?!" + name + r"[\s=/>])[^\s=>\"'/]++" + value + r"|\s*/)*+"
    return r"(?i)^<[a-z][^\s/>]*+" + other + r"\s+" + name + tail


def attr(name: str, token: Column | None = None) -> Column:
    """Value of an attribute of the open tag; NULL when absent or empty.

    Attributes are walked in order, so a name inside another value is not seen.
    Most tags fail the cheap substring test and never reach the regex; entity
    decoding is planned only for tags that hold an ampersand.
    """
    token = F.col("token") if token is None else token
    raw = F.regexp_extract(token, _attr_regex(name, r"\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>\"']+)"), 1)
    bare = F.regexp_replace(raw, r"^([\"'])([\s\S]*)\1$", "$2")
    value = F.when(F.contains(token, F.lit("&")), decode_entities(bare)).otherwise(bare)
    return F.nullif(F.when(F.contains(F.lower(token), F.lit(name)), value), F.lit(""))


def has_attr(name: str, token: Column | None = None) -> Column:
    """Whether the open tag names an attribute at all."""
    token = F.col("token") if token is None else token
    named = F.rlike(token, F.lit(_attr_regex(name, r"[\s=/>]")))
    return F.when(F.contains(F.lower(token), F.lit(name)), named).otherwise(F.lit(False))


def classes(token: Column | None = None) -> Column:
    """Class names of the element in order; empty array when it has none."""
    found = attr("class", token)
    none = F.array().cast("array<string>")
    return F.when(found.isNull(), none).otherwise(F.filter(F.split(found, r"\s+"), lambda c: c != ""))
