"""Arbitrary JSON held as text: its values with their paths, canonical form, redaction, schema checks.

A text is cut into tokens once; everything else but redaction, which stays inside
its row, is windows over the tokens of a row.  The depth is a running sum, and the key or index on every level of a path is
the last one seen on that level, so paths of any depth take one window pass (a
column for each level; the deepest text is measured first, one number).

Texts that are no JSON, or name a key twice in one object, give no rows; ``id``
columns must tell the rows apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagesieve.functions.redact import HIDDEN_KEYS, REDACTED, URL_KEYS, hide_secrets, hide_url_queries
from pagesieve.functions.urls import sanitize_url

_TOKEN = r"\"(?:[^\"\\]|\\.)*+\"|[{}\[\]:,]|[^\s{}\[\]:,\"]++"
OBJECT_OPEN, ARRAY_OPEN = "{", "["
_PATH = "array<struct<key:string,idx:int>>"


def _decoded(token: Column) -> Column:
    """Text of a JSON string token."""
    return F.get(F.from_json(F.concat(F.lit("["), token, F.lit("]")), "array<string>"), F.lit(0))


def _encoded(text: Column) -> Column:
    """JSON string token of a text."""
    whole = F.to_json(F.array(text))
    return F.substring(whole, F.lit(2), F.length(whole) - 2)


def tokens(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Tokens of valid texts: ``id``, ``pos``, ``token``, ``depth`` (of containers around it), ``is_key``, ``starts`` (a value starts here)."""
    text = F.col(text_col).cast("string")
    found = F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0))
    each = rows.filter(F.try_parse_json(text).isNotNull()).select(F.col(id_col).alias("id"), F.posexplode(found).alias("pos", "token"))
    order = Window.partitionBy("id").orderBy("pos")
    token, up, down = F.col("token"), F.col("token").isin("{", "["), F.col("token").isin("}", "]")
    running = F.sum(F.when(up, 1).when(down, -1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    is_key = F.startswith(token, F.lit('"')) & (F.lead("token").over(order) == ":")
    placed = each.withColumns({"depth": F.when(up, running - 1).when(down, running + 1).otherwise(running).cast("int"), "is_key": F.coalesce(is_key, F.lit(False))})
    return placed.withColumn("starts", ~F.col("is_key") & ~token.isin("}", "]", ":", ","))


def _deepest(marked: DataFrame) -> int:
    return marked.agg(F.max("depth")).first()[0] or 0


def values(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Every value of the texts, containers too: ``id``, ``pos``, ``path`` (key or index a level), ``kind``, ``token``, ``empty``.

    Kinds are object, array, string, integer, number, boolean and null.
    """
    marked = tokens(rows, id_col, text_col)
    order = Window.partitionBy("id").orderBy("pos")
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    token, depth, levels = F.col("token"), F.col("depth"), range(1, _deepest(marked) + 1)
    commas = {f"__c{k}": F.sum(F.when((token == ",") & (depth == k), 1).otherwise(0)).over(running) for k in levels}
    marked = marked.withColumns({**commas, "__next": F.lead("token").over(order)})
    last = lambda value: F.last(value, ignorenulls=True).over(running)
    opened = token.isin("{", "[")
    held = {}
    for k in levels:
        held[f"__o{k}"] = last(F.when(opened & (depth == k - 1), F.struct(token.alias("t"), F.col(f"__c{k}").alias("c"))))
        held[f"__k{k}"] = last(F.when(F.col("is_key") & (depth == k), token))
    marked = marked.withColumns(held).filter("starts")
    element = lambda k: F.when(
        depth >= k,
        F.struct(F.when(F.col(f"__o{k}.t") == OBJECT_OPEN, _decoded(F.col(f"__k{k}"))).alias("key"), F.when(F.col(f"__o{k}.t") == ARRAY_OPEN, F.col(f"__c{k}") - F.col(f"__o{k}.c")).cast("int").alias("idx")),
    )
    path = F.array_compact(F.array(*map(element, levels))) if levels else F.array()
    kind = (
        F.when(token == OBJECT_OPEN, "object").when(token == ARRAY_OPEN, "array").when(F.startswith(token, F.lit('"')), "string")
        .when(token.isin("true", "false"), "boolean").when(token == "null", "null").when(token.rlike(r"^-?[0-9]+$"), "integer").otherwise("number")
    )
    return marked.select("id", "pos", path.cast(_PATH).alias("path"), kind.alias("kind"), "token", (opened & F.col("__next").isin("}", "]")).alias("empty"))


def _common(p: Column, q: Column) -> Column:
    """How many leading elements of two paths agree."""
    both = F.zip_with(p, q, lambda a, b: a.eqNullSafe(b))
    none = F.struct(F.lit(0).alias("n"), F.lit(True).alias("open"))
    return F.aggregate(both, none, lambda acc, same: F.struct((acc["n"] + (acc["open"] & same).cast("int")).alias("n"), (acc["open"] & same).alias("open")), lambda acc: acc["n"])


def canonical(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id`` and ``canonical``: the text with the keys of all objects sorted, one space after commas and colons.

    The values that hold no others are sorted by path; what stands between two of
    them follows from where their paths part.
    """
    found = values(rows, id_col, text_col)
    leaves = found.filter(~F.col("kind").isin("object", "array") | F.col("empty"))
    leaves = leaves.withColumn("value", F.when(F.col("kind") == "string", _encoded(_decoded(F.col("token")))).when(F.col("kind") == "object", "{}").when(F.col("kind") == "array", "[]").otherwise(F.col("token")))
    order = Window.partitionBy("id").orderBy("path")
    leaves = leaves.withColumns({"__before": F.lag("path").over(order), "__last": F.lead("pos").over(order).isNull()})
    here, before = F.col("path"), F.col("__before")
    closes = lambda path, first: F.array_join(
        F.transform(F.reverse(F.slice(path, first, F.greatest(F.size(path) - first + 1, F.lit(0)))), lambda e: F.when(e["key"].isNotNull(), "}").otherwise("]")), ""
    )
    label = lambda e: F.when(e["key"].isNotNull(), F.concat(_encoded(e["key"]), F.lit(": "))).otherwise("")
    opens = lambda path, first: F.array_join(
        F.transform(F.slice(path, first, F.greatest(F.size(path) - first + 1, F.lit(0))), lambda e: F.concat(F.when(e["key"].isNotNull(), "{").otherwise("["), label(e))), ""
    )
    shared = F.when(before.isNull(), -1).otherwise(_common(here, before))
    leaves = leaves.withColumn("__shared", shared)
    n = F.col("__shared")
    lead = F.when(n < 0, opens(here, F.lit(1))).otherwise(F.concat(closes(before, n + 2), F.lit(", "), label(F.get(here, n)), opens(here, n + 2)))
    piece = F.concat(lead, F.col("value"), F.when(F.col("__last"), closes(here, F.lit(1))).otherwise(""))
    pieces = leaves.select("id", "path", piece.alias("piece")).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("path", "piece"))).alias("pieces"))
    return pieces.select("id", F.array_join(F.transform("pieces", lambda x: x["piece"]), "").alias("canonical"))


def fingerprints(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id`` and ``fingerprint``: one for texts that differ in the order of keys and in blanks alone."""
    return canonical(rows, id_col, text_col).select("id", F.sha2("canonical", 256).alias("fingerprint"))


#: Blanks outside strings, and pieces of a text without them: a string, with the colon and bracket behind it if it is a key, or what stands between strings from one bracket to the next.
_BLANK = r"(\"(?:[^\"\\]|\\.)*+\")|\s++"
_PIECE = r"\"(?:[^\"\\]|\\.)*+\"(?::[{\[]?+)?+|[}\]][^{}\[\]\"]*+[{\[]?+|[^{}\[\]\"]++[{\[]?+|[{\[]"
_HIDDEN = f'"{REDACTED}"'


def _let(value: Column, f) -> Column:
    """``f`` of a value that is computed once, however often ``f`` names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _plain(token: Column) -> Column:
    """Text of a JSON string token; most hold no escapes."""
    return F.when(F.contains(token, F.lit("\\")), _decoded(token)).otherwise(F.substring(token, F.lit(2), F.length(token) - 2))


def _quoted(text: Column) -> Column:
    return F.when(F.rlike(text, F.lit(r"[\x00-\x1f\"\\]")), _encoded(text)).otherwise(F.concat(F.lit('"'), text, F.lit('"')))


def _has_key(piece: Column, keys: tuple[str, ...]) -> Column:
    """Whether the piece is one of the keys, with its colon."""
    return F.coalesce(F.startswith(piece, F.lit('"')) & ~F.endswith(piece, F.lit('"')) & _plain(F.rtrim(piece, F.lit(":{["))).isin(*keys), F.lit(False))


def _turn(piece: Column) -> Column:
    """What a piece does to the depth: -1 closes, 1 opens, 2 opens under a hidden key, 3 closes and opens again, 0 neither."""
    opens = F.endswith(piece, F.lit("{")) | F.endswith(piece, F.lit("["))
    closes = F.startswith(piece, F.lit("}")) | F.startswith(piece, F.lit("]"))
    return F.when(opens, F.when(closes, 3).when(_has_key(piece, HIDDEN_KEYS), 2).otherwise(1)).when(closes, -1).otherwise(0)


def _hidden_spans(pieces: Column) -> Column:
    """Of every container under a hidden key, and inside no other such: the pieces (from 1) that open and close it."""
    spans = F.array().cast("array<struct<opens:int,closes:int>>")
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("opens"), F.lit(0).alias("inner"), spans.alias("spans"))

    def step(acc, x):
        turn, opens = x["turn"], acc["opens"]
        depth = acc["depth"] + F.when(turn == 3, 0).when(turn == 2, 1).otherwise(turn)
        ends = (opens > 0) & turn.isin(-1, 3) & (acc["depth"] == acc["inner"])
        state = lambda opens, inner, spans: F.struct(depth.alias("depth"), opens.alias("opens"), inner.alias("inner"), spans.alias("spans"))
        return (
            F.when((opens == 0) & (turn == 2), state(x["at"], acc["depth"] + 1, acc["spans"]))
            .when(ends, state(F.lit(0), acc["inner"], F.array_append(acc["spans"], F.struct(opens.alias("opens"), x["at"].alias("closes")))))
            .otherwise(state(opens, acc["inner"], acc["spans"]))
        )

    turns = F.transform(pieces, lambda piece, i: F.struct((i + 1).alias("at"), _turn(piece).alias("turn")))
    return F.aggregate(F.filter(turns, lambda x: x["turn"] != 0), start, step, lambda acc: acc["spans"])


def _cleaned(piece: Column, before: Column) -> Column:
    """A piece without secrets, after the piece before it (null: none)."""
    text = F.startswith(piece, F.lit('"')) & F.endswith(piece, F.lit('"'))
    valued = F.coalesce(F.endswith(before, F.lit(":")), F.lit(False))
    cleaned = _let(_plain(piece), lambda t: F.when(valued & _has_key(before, URL_KEYS), sanitize_url(t)).otherwise(_let(hide_url_queries(t), lambda u: hide_secrets(u))))
    rest = F.when(F.endswith(piece, F.lit(",")), F.concat(F.lit(_HIDDEN), F.lit(","))).otherwise(F.lit(_HIDDEN))
    return F.when(valued & _has_key(before, HIDDEN_KEYS), F.when(text, F.lit(_HIDDEN)).otherwise(rest)).when(text, _quoted(cleaned)).otherwise(piece)


def _redacted(text: Column) -> Column:
    """A JSON text without secrets, at any depth, and without blanks.

    It is cut into pieces once.  Those of containers under hidden keys are found by
    counting brackets, so nothing leaves the row and no depth is bounded; what
    stands between these containers is cleaned piece by piece.
    """

    def shown(pieces):
        bounds = _let(_hidden_spans(pieces), lambda spans: F.arrays_zip(
            F.concat(F.array(F.lit(1)), F.transform(spans, lambda x: x["closes"])).alias("first"), F.concat(F.transform(spans, lambda x: x["opens"]), F.array(F.size(pieces))).alias("last")
        ))
        part = lambda own: F.array_join(F.transform(own, lambda x, i: _cleaned(x, F.get(own, i - 1))), "")
        # a part begins with the bracket that closes the container before it, and ends with the one that opens the next
        kept = lambda t, first, last: F.substring(t, F.when(first, 1).otherwise(2), F.length(t) - F.when(first, 0).otherwise(1) - F.when(last, 0).otherwise(1))
        between = lambda x, i, n: _let(F.slice(pieces, x["first"], x["last"] - x["first"] + 1), lambda own: _let(part(own), lambda t: kept(t, i == 0, i == n - 1)))
        return _let(bounds, lambda found: F.array_join(F.transform(found, lambda x, i: between(x, i, F.size(found))), _HIDDEN))

    pieces = F.regexp_extract_all(F.regexp_replace(text, _BLANK, "$1"), F.lit(_PIECE), F.lit(0))
    return _let(pieces, shown)


def redacted(rows: DataFrame, id_col: str, text_col: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """``id`` and ``redacted``, and the columns to ``keep``: the text without secrets, at any depth.

    Whole values of hidden keys go, containers too; strings of address keys lose
    their query; all other strings, those in lists too, are cleaned as free text.
    Ids may repeat here: rows are not brought together.
    """
    text = F.col(text_col).cast("string")
    return rows.filter(F.try_parse_json(text).isNotNull()).select(F.col(id_col).alias("id"), *keep, _redacted(text).alias("redacted"))


def _named(path: Column) -> Column:
    """Path as a name: keys joined by dots, ``[]`` for any index."""
    return F.array_join(F.transform(path, lambda e, i: F.when(e["key"].isNull(), "[]").when(i == 0, e["key"]).otherwise(F.concat(F.lit("."), e["key"]))), "")


def _shown(path: Column) -> Column:
    return F.array_join(F.transform(path, lambda e, i: F.when(e["key"].isNull(), F.concat(F.lit("["), e["idx"].cast("string"), F.lit("]"))).when(i == 0, e["key"]).otherwise(F.concat(F.lit("."), e["key"]))), "")


def violations(rows: DataFrame, id_col: str, text_col: str, schema: DataFrame) -> DataFrame:
    """``id`` and ``errors``, for every row: what a schema table (path, types, required) finds wrong, sorted.

    Paths are keys joined by dots, ``[]`` for the members of a list, "" for the
    whole; an integer is a number as well.  Members that no path names are errors,
    and so is a text that is no JSON.
    """
    found = values(rows, id_col, text_col).select("id", "path", "kind", _named(F.col("path")).alias("name"))
    parent = F.slice("path", F.lit(1), F.greatest(F.size("path") - 1, F.lit(0)))
    found = found.withColumns({"inside": parent, "outer": _named(parent), "key": F.try_element_at("path", F.lit(-1))["key"]})
    # the schema describes one text and goes to every task; the values are read once and stay placed by id
    known = schema.select(F.col("path").alias("name"), "types")
    needed = schema.filter("required AND path <> ''").groupBy(F.regexp_replace("path", r"\.?[^.\[\]]+$", "").alias("name")).agg(
        F.collect_set(F.regexp_extract("path", r"([^.\[\]]+)$", 1)).alias("needs")
    )
    above = schema.select(F.col("path").alias("outer")).distinct().withColumn("__told", F.lit(True))
    judged = found.join(F.broadcast(known), "name", "left").join(F.broadcast(needed), "name", "left").join(F.broadcast(above), "outer", "left")
    judged = judged.join(F.broadcast(needed.select(F.col("name").alias("outer"), F.col("needs").alias("__asked"))), "outer", "left")
    fits = F.array_contains("types", F.col("kind")) | ((F.col("kind") == "integer") & F.array_contains("types", "number"))
    wrong = F.when(
        F.col("types").isNotNull() & ~fits, F.concat(F.lit("type: "), _shown(F.col("path")), F.lit(" is "), "kind", F.lit(", not "), F.array_join("types", "|"))
    )
    # members of unknown members are not told again
    extra = F.when((F.size("path") > 0) & F.col("types").isNull() & F.col("key").isNotNull() & F.col("__told"), F.concat(F.lit("extra: "), _shown(F.col("path"))))
    none = F.lit(None).cast("string")
    facts = F.array(
        F.struct(F.col("path").alias("at"), F.coalesce(wrong, extra).alias("error"), F.when(F.col("kind") == "object", F.col("needs")).alias("needs"), none.alias("has")),
        F.struct(F.col("inside").alias("at"), none.alias("error"), F.lit(None).cast("array<string>").alias("needs"), F.when(F.array_contains("__asked", F.col("key")), F.col("key")).alias("has")),
    )
    facts = judged.select("id", F.inline(facts)).filter("error IS NOT NULL OR needs IS NOT NULL OR has IS NOT NULL")
    placed = facts.groupBy("id", "at").agg(F.collect_list("error").alias("errors"), F.first("needs", ignorenulls=True).alias("needs"), F.collect_set("has").alias("has"))
    missing = lambda k: F.concat(F.lit("missing: "), _shown(F.col("at")), F.when(F.size("at") > 0, ".").otherwise(""), k)
    gone = F.transform(F.coalesce(F.array_except("needs", "has"), F.array().cast("array<string>")), missing)
    told = placed.select("id", F.concat("errors", gone).alias("errors"))
    every = rows.select(F.col(id_col).alias("id"), F.when(F.try_parse_json(F.col(text_col).cast("string")).isNull(), F.array(F.lit("not JSON"))).otherwise(F.array().cast("array<string>")).alias("errors"))
    return every.unionByName(told).groupBy("id").agg(F.array_sort(F.flatten(F.collect_list("errors"))).alias("errors"))
