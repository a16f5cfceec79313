"""Extraction by stored specs: every page is read with the spec of its own project.

A spec is a row (container selector and fields).  Its selectors are compiled by
column expressions to rows as well: alternatives, steps with their combinator,
and the tests of a step (tag, class, id, attribute, place among siblings).  All
specs then run in one pass over the element table, and the plan has the same
size however many there are: only the longest chain of steps adds a round.

1. The compiled steps travel to the pages of their spec (a join of page rows,
   without html), and from there to the elements, which are placed by page.
2. An element keeps the steps it satisfies by itself; most keep none and leave.
3. Round k decides which elements complete the first k + 1 steps.  Ancestors and
   earlier siblings are a running maximum in page order, parents and direct
   siblings an exact group; both are windows inside the page.

The ladder is the one of :mod:`pagesieve.operators.records`: containers, else
aligned fields, else the largest table, page by page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagesieve.functions.text import coerced, decode_entities, strip_ends
from pagesieve.functions.urls import with_joined
from pagesieve.operators.nodes import attr, elements, place_pages, with_texts
from pagesieve.operators.records import BAD_CONTAINER, IMAGE_ATTRS, VALUE_ATTRS, page_tables, with_assigned_columns
from pagesieve.operators.select import RELAXABLE, assign_containers
from pagesieve.session import cut_lineage

SPEC_SCHEMA = (
    "spec_id long, container string, "
    "fields array<struct<name:string,selector:string,type:string,label:string,user_label:string,selected:boolean,required:boolean>>"
)

_QUOTED = r"\"[^\"]*+\"|'[^']*+'"
_BRACKET = rf"\[(?:[^\]\"']|{_QUOTED})*+\]"
_PAREN = rf"\((?:[^()\"']|{_QUOTED}|\((?:[^()\"']|{_QUOTED})*+\))*+\)"
_ALTERNATIVE = rf"(?:[^,\[(\"']|{_QUOTED}|{_BRACKET}|{_PAREN})++"
_PIECE = rf"\s*+[>+~]\s*+|\s++(?![>+~])|(?:[^\s>+~\[(\"']|{_BRACKET}|{_PAREN})++"
_SIGN = r"^\s*[>+~]\s*$|^\s+$"
_SIMPLE = rf"[A-Za-z][\w-]*+|\*|\.[\w-]++|#[\w-]++|{_BRACKET}|:[\w-]++(?:{_PAREN})?"
_ATTR_TEST = r"^\[([\w-]+)(?:([\^*$~|]?=)(?:\"([^\"]*)\"|'([^']*)'|([^\]\"']*)))?\]$"
_PLACES = "nth-child|nth-of-type|nth-last-child|nth-last-of-type"
_ENDS = "first-child|last-child|first-of-type|last-of-type"
_FORMULA = r"^\s*([+-]?\d*)n\s*(?:([+-])\s*(\d+))?\s*$"
_TEST = "array<struct<kind:string,name:string,op:string,value:string,a:int,b:int,negative:boolean>>"
_ALWAYS = 2_000_000_000
INSIDE, PLAIN, CONTAINER = 1, 2, 0


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def relaxed_column(selector: Column) -> Column:
    """The selector, then shorter ones without trailing bare wrapper tags (see ``select.relaxed``)."""
    words = F.filter(F.split(selector, r"\s+"), lambda w: w != "")
    size = F.size(words)
    none = F.struct(F.lit(0).alias("n"), F.lit(True).alias("open"))
    step = lambda acc, w: F.struct(
        F.when(acc["open"] & w.isin(*RELAXABLE), acc["n"] + 1).otherwise(acc["n"]).alias("n"), (acc["open"] & w.isin(*RELAXABLE)).alias("open")
    )
    run = F.least(F.aggregate(F.reverse(words), none, step, lambda acc: acc["n"]), size - 1)
    dangling = (run > 0) & F.coalesce(F.try_element_at(words, size - run).isin(">", "+", "~"), F.lit(False))
    last = run - dangling.cast("int")
    return F.when(size > 0, F.transform(F.sequence(F.lit(0), last), lambda d: F.array_join(F.slice(words, F.lit(1), size - d), " "))).otherwise(
        F.array().cast("array<string>")
    )


def relative_column(selector: Column, container: Column) -> Column:
    """A field selector without the container in front of it."""
    own, outer = F.btrim(selector), F.btrim(container)
    rest = F.btrim(F.substr(own, F.length(outer) + 1))
    rest = F.when(F.startswith(rest, F.lit(">")), F.btrim(F.substr(rest, F.lit(2)))).otherwise(rest)
    return F.when((outer != "") & F.startswith(own, outer), F.coalesce(F.nullif(rest, F.lit("")), selector)).otherwise(selector)


def _test(simple: Column, negative: Column) -> Column:
    """One test of a step; a null kind is one that cannot be answered."""
    part = lambda pattern, group: F.regexp_extract(simple, pattern, group)
    place = part(rf"^:({_PLACES})\(([\s\S]*)\)$", 1)
    formula = F.lower(F.btrim(part(rf"^:({_PLACES})\(([\s\S]*)\)$", 2)))
    formula = F.when(formula == "odd", "2n+1").when(formula == "even", "2n").otherwise(formula)
    times, sign, plus = (F.regexp_extract(formula, _FORMULA, g) for g in (1, 2, 3))
    a = F.when(times.isin("", "+"), 1).when(times == "-", -1).otherwise(times.try_cast("int"))
    b = F.coalesce(plus.try_cast("int"), F.lit(0)) * F.when(sign == "-", -1).otherwise(1)
    end = part(rf"^:({_ENDS})$", 1)
    only = part("^:(only-child|only-of-type|empty)$", 1)
    attribute = simple.rlike(_ATTR_TEST)
    kind = (
        F.when(simple == "*", "any").when(simple.rlike("^[A-Za-z]"), "tag").when(F.startswith(simple, F.lit(".")), "class").when(F.startswith(simple, F.lit("#")), "id")
        .when(attribute, "attr").when((place != "") & formula.rlike(_FORMULA), place).when((place != "") & formula.rlike(r"^[+-]?\d+$"), place)
        .when(end != "", F.concat(F.lit("nth-"), F.when(F.startswith(end, F.lit("last")), "last-").otherwise(""), F.regexp_replace(end, "^(first|last)-", "")))
        .when(only != "", only)
    )
    plain_place = formula.rlike(r"^[+-]?\d+$")
    value = (
        F.when(kind == "tag", F.lower(simple)).when(kind.isin("class", "id"), F.substr(simple, F.lit(2)))
        .when(attribute, F.concat(part(_ATTR_TEST, 3), part(_ATTR_TEST, 4), part(_ATTR_TEST, 5)))
    )
    return F.struct(
        kind.alias("kind"), F.when(attribute, F.lower(part(_ATTR_TEST, 1))).alias("name"), F.when(attribute, part(_ATTR_TEST, 2)).alias("op"), value.alias("value"),
        F.when(end != "", 0).when(plain_place, 0).otherwise(a).alias("a"), F.when(end != "", 1).when(plain_place, formula.try_cast("int")).otherwise(b).alias("b"), negative.alias("negative"),
    )


def _tests(compound: Column) -> Column:
    """Tests of a compound selector; NULL when it is not understood."""
    simples = _all(compound, _SIMPLE)

    def one(s):
        inner = F.btrim(F.regexp_extract(s, r"^:not\(([\s\S]*)\)$", 1))
        negated = F.startswith(s, F.lit(":not("))
        return F.when(negated & inner.rlike(rf"^(?:{_SIMPLE})$"), _test(inner, F.lit(True))).otherwise(_test(s, F.lit(False)))

    found = F.transform(simples, one)
    later = F.slice(simples, 2, F.greatest(F.size(simples) - 1, F.lit(0)))
    good = (F.array_join(simples, "") == compound) & (F.size(simples) > 0) & F.forall(found, lambda t: t["kind"].isNotNull()) & ~F.exists(later, lambda s: s.rlike(r"^[A-Za-z*]"))
    return F.when(good, found)


def compile_selectors(selectors: DataFrame) -> DataFrame:
    """Steps of the selectors in column ``text``: a row for each with ``alt``, ``step``, ``last`` and ``link`` added, ``tests`` and ``next_link``.

    A selector that is not understood has one row with null tests.
    """
    keys = selectors.columns
    alternatives = _all(F.col("text"), _ALTERNATIVE)
    whole = F.coalesce(F.array_join(alternatives, ",") == F.col("text"), F.lit(False)) & (F.size(alternatives) > 0)
    rows = selectors.withColumn("__whole", whole).select("*", F.posexplode_outer(F.when(whole, alternatives)).alias("alt", "__alternative"))
    rows = rows.withColumn("__alternative", F.btrim("__alternative", F.lit(" \t\n\r\f"))).withColumn("__pieces", _all(F.col("__alternative"), _PIECE))
    pieces = F.col("__pieces")
    is_sign = F.transform(pieces, lambda p, i: p.rlike(_SIGN) == (i % 2 == 1))
    rows = rows.withColumn("__good", F.coalesce((F.array_join(pieces, "") == F.col("__alternative")) & (F.size(pieces) % 2 == 1) & F.forall(is_sign, lambda x: x), F.lit(False)))
    steps = F.transform(
        F.filter(F.transform(pieces, lambda p, i: F.struct(p.alias("piece"), i.alias("at"))), lambda s: s["at"] % 2 == 0),
        lambda s: F.struct(
            (s["at"] / 2).cast("int").alias("step"), s["piece"].alias("compound"),
            F.coalesce(F.nullif(F.btrim(F.get(pieces, s["at"] - 1)), F.lit("")), F.lit(" ")).alias("link"), F.btrim(F.get(pieces, s["at"] + 1)).alias("next_link"),
        ),
    )
    rows = rows.withColumn("last", ((F.size(pieces) - 1) / 2).cast("int")).select("*", F.inline_outer(F.when(F.col("__good"), steps)))
    rows = rows.withColumn("tests", _tests(F.col("compound")))
    all_good = F.bool_and(F.col("tests").isNotNull()).over(Window.partitionBy(*keys))
    rows = rows.withColumn("__ok", all_good)
    kept = rows.filter("__ok").select(*keys, "alt", "step", "last", "link", "next_link", "tests")
    bad = rows.filter("NOT __ok").select(*keys, *(F.lit(0).alias(c) for c in ("alt", "step", "last")), F.lit(" ").alias("link"), F.lit(None).cast("string").alias("next_link"), F.lit(None).cast(_TEST).alias("tests"))
    return kept.unionByName(bad.dropDuplicates(keys))


def compile_specs(specs: DataFrame) -> DataFrame:
    """One row a spec: ``steps``, ``fields`` (key, kind, required), ``has_container`` and ``warnings``."""
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    chosen = F.filter("fields", lambda f: F.coalesce(f["selected"], F.lit(True)))
    own = specs.select("spec_id", F.col("container"), F.coalesce(chosen, F.array().cast(dict(specs.dtypes)["fields"])).alias("fields"))
    name = lambda f: F.coalesce(*[F.nullif(f[c], F.lit("")) for c in ("user_label", "label", "name")], F.lit("field"))
    listed = own.select("spec_id", "container", F.posexplode("fields").alias("field", "f"))
    kind = F.lower(F.coalesce("f.type", F.lit("string")))
    listed = listed.select("spec_id", "container", "field", F.col("f.selector").alias("selector"), kind.alias("kind"), name(F.col("f")).alias("key"))
    read = listed.filter(~blank(F.col("selector")))
    variants = lambda mode, text: F.transform(text, lambda t, i: F.struct(F.lit(mode).alias("mode"), i.alias("variant"), t.alias("text")))
    inside = F.when(~blank(F.col("container")), variants(INSIDE, relaxed_column(relative_column(F.col("selector"), F.col("container")))))
    uses = read.select("spec_id", "field", "kind", "key", F.inline(F.concat(F.coalesce(inside, F.array().cast("array<struct<mode:int,variant:int,text:string>>")), variants(PLAIN, relaxed_column(F.col("selector"))))))
    outer = own.filter(~blank(F.col("container"))).select("spec_id", F.lit(-1).alias("field"), F.lit("").alias("kind"), F.lit("").alias("key"), F.lit(CONTAINER).alias("mode"), F.lit(0).alias("variant"), F.btrim("container").alias("text"))
    uses = uses.unionByName(outer)
    compiled = cut_lineage(compile_selectors(uses.select("spec_id", "text").distinct()))
    judged = uses.join(compiled.groupBy("spec_id", "text").agg(F.bool_and(F.col("tests").isNotNull()).alias("valid")), ["spec_id", "text"])
    judged = judged.withColumn("readable", F.bool_and("valid").over(Window.partitionBy("spec_id", "field", "mode")))
    used = judged.filter("readable").groupBy("spec_id", "text").agg(F.collect_list(F.struct("field", "mode", "variant", "kind")).alias("uses"))
    used = used.withColumn("sel", F.row_number().over(Window.partitionBy("spec_id").orderBy("text")))
    uses_here = F.when(F.col("step") == F.col("last"), F.col("uses"))
    steps = compiled.join(used, ["spec_id", "text"]).withColumn("uses", uses_here)
    steps = steps.groupBy("spec_id").agg(F.collect_list(F.struct("sel", "alt", "step", "last", "link", "next_link", "tests", "uses")).alias("steps"))
    # warnings: one a field in order, then the container
    invalid = judged.filter(~F.col("valid") & (F.col("mode") != INSIDE)).groupBy("spec_id", "field").agg(F.min(F.struct("variant", "text", "key")).alias("w"))
    said = invalid.select(
        "spec_id", F.when(F.col("field") < 0, _ALWAYS).otherwise(F.col("field")).alias("field"),
        F.when(F.col("field") < 0, F.concat(F.lit(BAD_CONTAINER.format("")), "w.text")).otherwise(F.concat("w.key", F.lit(" selector is invalid: "), "w.text")).alias("text"),
    ).unionByName(listed.filter(blank(F.col("selector"))).select("spec_id", "field", F.concat("key", F.lit(" has no selector.")).alias("text")))
    said = said.groupBy("spec_id").agg(F.array_sort(F.collect_list(F.struct("field", "text"))).alias("said"))
    enclosed = judged.filter((F.col("mode") == CONTAINER) & F.col("valid")).select("spec_id", F.lit(True).alias("has_container"))
    out = own.join(steps, "spec_id", "left").join(said, "spec_id", "left").join(enclosed, "spec_id", "left")
    keyed = F.transform("fields", lambda f: F.struct(name(f).alias("key"), F.lower(F.coalesce(f["type"], F.lit("string"))).alias("kind"), F.coalesce(f["required"], F.lit(False)).alias("required")))
    texts = lambda test: F.coalesce(F.transform(F.filter("said", test), lambda w: w["text"]), F.array().cast("array<string>"))
    return cut_lineage(out.select(
        "spec_id", "steps", keyed.alias("fields"), F.coalesce("has_container", F.lit(False)).alias("has_container"),
        texts(lambda w: w["field"] < _ALWAYS).alias("field_warnings"), texts(lambda w: w["field"] == _ALWAYS).alias("container_warnings"),
    ))


def _attributes() -> Column:
    """Attributes of the open tag in order: name, value (empty when bare)."""
    pattern = r"([^\s=>\"'/<]++)(?:\s*+=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s>\"']++))?"
    rest = F.regexp_replace("token", r"^<[A-Za-z][^\s/>]*+", "")
    names, values = (F.regexp_extract_all(rest, F.lit(pattern), F.lit(g)) for g in (1, 2))
    value = lambda v: decode_entities(F.regexp_replace(v, r"^([\"'])([\s\S]*)\1$", "$2"))
    return F.transform(F.arrays_zip(names.alias("n"), values.alias("v")), lambda x: F.struct(F.lower(x["n"]).alias("name"), value(x["v"]).alias("value")))


def _satisfies(t: Column) -> Column:
    """Whether the element passes a test (columns of the element table, ``__classes`` and ``__attributes``)."""
    place = (
        F.when(t["kind"] == "nth-child", F.col("sibling_idx")).when(t["kind"] == "nth-of-type", F.col("type_idx"))
        .when(t["kind"] == "nth-last-child", F.col("siblings") - F.col("sibling_idx") + 1).when(t["kind"] == "nth-last-of-type", F.col("type_siblings") - F.col("type_idx") + 1)
    )
    off = place - t["b"]
    held = F.get(F.filter("__attributes", lambda a: a["name"] == t["name"]), F.lit(0))
    value, wanted = F.nullif(held["value"], F.lit("")), t["value"]
    compared = (
        F.when(t["op"] == "", held.isNotNull()).when(t["op"] == "=", value == wanted).when(t["op"] == "^=", F.startswith(value, wanted)).when(t["op"] == "$=", F.endswith(value, wanted))
        .when(t["op"] == "*=", F.contains(value, wanted)).when(t["op"] == "~=", F.array_contains(F.split(value, r"\s+"), wanted)).otherwise((value == wanted) | F.startswith(value, F.concat(wanted, F.lit("-"))))
    )
    passed = (
        F.when(t["kind"] == "any", True).when(t["kind"] == "tag", F.col("tag") == wanted).when(t["kind"] == "class", F.array_contains("__classes", wanted))
        .when(t["kind"] == "id", F.col("id_attr") == wanted).when(t["kind"] == "attr", compared)
        .when(t["kind"] == "only-child", F.col("siblings") == 1).when(t["kind"] == "only-of-type", F.col("type_siblings") == 1)
        .when(t["kind"] == "empty", (F.col("text_from") == F.col("text_to")) & (F.col("close_pos") - F.col("open_pos") <= 2))
        .when(t["a"] == 0, off == 0).otherwise((F.try_mod(off, t["a"]) == 0) & (off * F.signum(t["a"]) >= 0))
    )
    return F.coalesce(passed, F.lit(False)) != t["negative"]


_NODE = ("page_id", "open_pos", "close_pos", "tag", "token", "text_from", "text_to", "parent_pos", "sibling_idx")


def satisfied_steps(nodes: DataFrame, page_steps: DataFrame) -> DataFrame:
    """One row for an element and each step of its page (page_id, steps) that it satisfies by itself."""
    spaced = F.filter(F.split("class_attr", r"\s+"), lambda c: c != "")
    asked = F.exists("steps", lambda s: F.exists(s["tests"], lambda t: t["kind"] == "attr"))
    rows = nodes.join(page_steps.select("page_id", "steps"), "page_id").withColumns({"__classes": spaced, "__attributes": F.when(asked & F.contains("token", F.lit(" ")), _attributes())})
    held = F.filter("steps", lambda s: F.forall(s["tests"], _satisfies))
    return rows.withColumn("__held", held).filter(F.size("__held") > 0).select(*_NODE, F.inline("__held")).drop("tests")


def select_by_steps(held: DataFrame, longest: int) -> DataFrame:
    """Elements that complete a selector: ``sel`` and ``uses`` beside the columns of the element; ``longest`` is the largest step number."""
    rows = held.withColumn("__ok", F.col("step") == 0)
    chain = ["page_id", "sel", "alt"]
    for k in range(1, longest + 1):
        gives, takes = (F.col("step") == k - 1) & F.col("__ok"), F.col("step") == k
        link = F.when(F.col("step") == k - 1, F.col("next_link")).when(takes, F.col("link"))
        link = F.coalesce(F.nullif(link, F.lit("")), F.lit(" "))
        # parents and the sibling before: an exact group
        exact = F.when(link == ">", F.struct(F.when(takes, F.col("parent_pos")).otherwise(F.col("open_pos")).alias("p"), F.lit(0).alias("i"))).when(
            link == "+", F.struct(F.col("parent_pos").alias("p"), (F.col("sibling_idx") + F.when(takes, 0).otherwise(1)).alias("i"))
        )
        rows = rows.withColumns({"__link": link, "__exact": exact, "__scope": F.when(link == "~", F.col("parent_pos")).otherwise(-1)})
        beside = F.bool_or(gives & F.col("__link").isin(">", "+")).over(Window.partitionBy(*chain, "__exact"))
        # ancestors and all siblings before: the furthest end opened so far
        end = F.when(gives & (F.col("__link") == " "), F.col("close_pos")).when(gives & (F.col("__link") == "~"), _ALWAYS)
        reach = F.max(end).over(Window.partitionBy(*chain, "__scope").orderBy("open_pos").rangeBetween(Window.unboundedPreceding, -1))
        found = F.when(F.col("__link").isin(">", "+"), F.col("__beside")).otherwise(F.coalesce(F.col("__reach") > F.col("open_pos"), F.lit(False)))
        rows = rows.withColumns({"__beside": beside, "__reach": reach}).withColumn("__ok", F.when(takes, found).otherwise(F.col("__ok")))
    done = rows.filter(F.col("__ok") & (F.col("step") == F.col("last")))
    return done.select("page_id", "open_pos", "close_pos", "tag", "token", "text_from", "text_to", "sel", "uses").dropDuplicates(["page_id", "open_pos", "sel"])


def longest_chain(compiled: DataFrame) -> int:
    """The largest step number of all specs: the rounds of a selection."""
    return compiled.agg(F.max(F.array_max(F.transform("steps", lambda s: s["step"])))).first()[0] or 0


def selected_uses(pages: DataFrame, compiled: DataFrame) -> DataFrame:
    """Selected elements of all pages (page_id, url, html, spec_id): a row for each use (field, mode, variant, kind)."""
    page_steps = pages.select("page_id", "spec_id").join(compiled.select("spec_id", "steps"), "spec_id")
    held = satisfied_steps(elements(pages), page_steps)
    return select_by_steps(held, longest_chain(compiled)).select("page_id", "open_pos", "close_pos", "tag", "token", "text_from", "text_to", F.inline("uses"))


def _with_values(hits: DataFrame, pages: DataFrame) -> DataFrame:
    """What the elements hold, by the kind of their field."""
    rows = with_texts(hits, pages)
    read = F.when(F.contains("token", F.lit("=")), strip_ends(F.coalesce(*[attr(a) for a in VALUE_ATTRS])))
    first = F.regexp_extract(F.coalesce(*[attr(a) for a in IMAGE_ATTRS]), r"^\s*([^,\s]*)", 1)
    ref = F.when(F.col("kind").isin("url", "link"), attr("href")).when(F.col("kind").isin("image", "img"), first)
    rows = with_joined(rows.withColumn("__ref", ref), "__ref", "url", "__link")
    value = F.when(F.col("__ref").isNotNull(), F.col("__link")).otherwise(F.coalesce(read, F.col("text")))
    return rows.withColumn("value", F.nullif(value, F.lit(""))).drop("__ref", "__link", "text", "text_pieces", "token")


def _records(cells: DataFrame, pages: DataFrame, order: str, strategy: str, minimum: Column, required: bool = True) -> DataFrame:
    """Records of cells (page_id, ``order``, field, value) with enough values and every required one, numbered by page."""
    held = cells.filter(F.col("value").isNotNull()).groupBy("page_id", order).agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("held"))
    rows = held.join(pages.select("page_id", "url", "spec_id", "fields", "field_warnings", "container_warnings"), "page_id")
    values = F.transform("fields", lambda f, i: F.struct(f["key"].alias("field"), f["kind"].alias("kind"), F.try_element_at("held", i).alias("value")))
    whole = F.forall(F.transform("fields", lambda f, i: ~f["required"] | F.map_contains_key("held", i)), lambda x: x) if required else F.lit(True)
    kept = rows.filter((F.size("held") >= minimum) & whole)
    said = F.concat("field_warnings", "container_warnings") if required else F.col("container_warnings")
    ordinal = F.row_number().over(Window.partitionBy("page_id").orderBy(order)) - 1
    return kept.select("page_id", "spec_id", ordinal.alias("record_ordinal"), F.col("url").alias("source_url"), F.lit(strategy).alias("strategy"), values.alias("values"), said.alias("warnings"))


def extract_stored(pages: DataFrame, specs: DataFrame) -> DataFrame:
    """Records of pages (page_id, url, html, spec_id), each by its own spec (``SPEC_SCHEMA``).

    page_id, spec_id, record_ordinal, source_url, strategy, values (field, kind,
    value; a null where nothing was found) and warnings.  Pages of unknown specs
    give no records.  The selected values are written once, so the first two
    strategies parse a page once; tables are read on pages these left empty.
    """
    compiled = compile_specs(specs)
    placed = place_pages(pages.select("page_id", "url", "html", "spec_id").join(compiled.select("spec_id"), "spec_id", "left_semi"))
    uses = cut_lineage(selected_uses(placed, compiled))  # slim: the selected elements alone
    slim = placed.select("page_id", "url", "spec_id").join(compiled.drop("steps"), "spec_id")
    boxes = uses.filter(F.col("mode") == CONTAINER).select("page_id", "open_pos", "close_pos", "field", "mode", "variant", F.lit(None).cast("string").alias("value"))
    found = _with_values(uses.filter(F.col("mode") != CONTAINER), placed).select(*boxes.columns)
    marks = cut_lineage(found.unionByName(boxes))

    inside = assign_containers(marks.filter(F.col("mode") != PLAIN), F.col("mode") == CONTAINER, F.col("mode") == INSIDE)
    best = inside.groupBy("page_id", "container_pos", "field").agg(
        F.min("variant").alias("r"), F.min(F.when(F.col("value").isNotNull(), F.struct("variant", "open_pos", "value"))).alias("b")
    )
    cells = best.select("page_id", "container_pos", "field", F.when(F.col("b.variant") == F.col("r"), F.col("b.value")).alias("value"))
    out = cut_lineage(_records(cells, slim, "container_pos", "containers", F.lit(1)))

    per_field = Window.partitionBy("page_id", "field")
    plain = marks.filter(F.col("mode") == PLAIN).join(out.select("page_id").distinct(), "page_id", "left_anti")
    plain = plain.withColumn("__r", F.min("variant").over(per_field)).filter(F.col("variant") == F.col("__r"))
    plain = plain.withColumn("idx", F.row_number().over(per_field.orderBy("open_pos")))
    few = F.when(F.size("fields") <= 2, 1).otherwise(2)
    out = out.unionByName(cut_lineage(_records(plain.select("page_id", "idx", "field", "value"), slim, "idx", "field_index", few)))

    left = place_pages(placed.join(out.select("page_id").distinct(), "page_id", "left_anti"))
    data = F.filter("rows", lambda r: F.exists(r["cells"], lambda c: c["tag"] == "td"))
    tables = page_tables(left, elements(left)).withColumn("rows", data).filter(F.size("rows") > 0)
    tables = tables.drop("url").join(slim.select("page_id", F.transform("fields", lambda f: f["key"]).alias("__keys")), "page_id").filter(F.size("__keys") > 0)
    tables = tables.withColumn("__cols", F.array_max(F.transform("rows", lambda r: F.size(r["cells"]))))
    tables = with_assigned_columns(tables, F.col("__keys"), "headers", "__cols", "__at")
    rows = tables.select("page_id", "__at", F.inline("rows")).filter(F.size("cells") >= 2)
    texts = F.transform("__at", lambda at, i: F.struct(i.alias("field"), F.get("cells", at)["text"].alias("value")))
    cells = rows.select("page_id", "row_pos", F.inline(texts))
    return out.unionByName(_records(cells, slim, "row_pos", "table", F.lit(1), required=False))


def typed_values(records: DataFrame) -> DataFrame:
    """Long form of stored-spec records: field, value (text), number and flag where the field's kind converts, and ``failed``."""
    rows = records.select("page_id", "spec_id", "record_ordinal", "strategy", F.inline("values"))
    done = rows.withColumn("__c", coerced(F.col("value"), F.col("kind")))
    return done.select(
        "page_id", "spec_id", "record_ordinal", "strategy", "field", "value", F.col("__c.value_num").alias("number"), F.col("__c.value_bool").alias("flag"), F.coalesce("__c.failed", F.lit(False)).alias("failed")
    )
