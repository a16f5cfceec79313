"""Glob patterns compiled to regular expressions.

A *rule* is ``(pattern, on_path, regex)``.  Rules written in code compile on
the driver to literal regexes (compiled once per task); rules stored in a
table compile with :func:`compiled_rules`, once per stored scope.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagesieve.functions.urls import path_of

PLAIN, ONE_MORE_SEGMENT, PER_SEGMENT = "plain", "one_more_segment", "per_segment"


class Rule(NamedTuple):
    pattern: str
    on_path: bool
    regex: str


# --- the same translation for table-held patterns, as column expressions -------------------

_PIECE = r"\[!?\]?[^\]]*\]|[\s\S]"


def _escape(piece: Column) -> Column:
    return F.regexp_replace(piece, r"([\\.^$|+(){}\[\]*?])", r"\\$1")


def _piece_regex(piece: Column, star: str, one: str) -> Column:
    inner = F.regexp_replace(F.substring(piece, 2, F.length(piece)), r"^!", "^")
    inner = F.regexp_replace(inner, r"([\\\[&])", r"\\$1")
    return (
        F.when(F.length(piece) > 1, F.concat(F.lit("["), inner))
        .when(piece == "*", F.lit(star))
        .when(piece == "?", F.lit(one))
        .otherwise(_escape(piece))
    )


def glob_regex(pattern: Column, star: str = ".*", one: str = ".") -> Column:
    """Unanchored regex text for a glob column."""
    pieces = F.regexp_extract_all(pattern, F.lit(_PIECE), F.lit(0))
    return F.array_join(F.transform(pieces, lambda p: _piece_regex(p, star, one)), "")


def _segments_regex(pattern: Column) -> Column:
    segs = F.filter(F.split(pattern, "/"), lambda s: s != "")
    parts = F.transform(
        segs, lambda s: F.when(s == "*", F.lit("[^/]+")).otherwise(glob_regex(s, "[^/]*", "[^/]"))
    )
    return F.concat(F.lit("/*"), F.array_join(parts, "/+"), F.lit("/*"))


def rule_regex(pattern: Column, flavour: str) -> Column:
    """Anchored regex for one pattern under the given matching flavour."""
    body = glob_regex(pattern)
    if flavour == ONE_MORE_SEGMENT:
        prefix = F.substring(pattern, F.lit(1), F.greatest(F.length(pattern) - 2, F.lit(0)))
        body = F.when(F.endswith(pattern, F.lit("/*")), F.concat(_escape(prefix), F.lit("/[^/]+/*"))).otherwise(body)
    elif flavour == PER_SEGMENT:
        body = F.when(F.startswith(pattern, F.lit("/")), _segments_regex(pattern)).otherwise(body)
    return F.concat(F.lit("(?s)^"), body, F.lit(r"\z"))


def rule_on_path(pattern: Column, flavour: str) -> Column:
    """Patterns with a leading slash look at the path, others at the whole URL."""
    on_path = F.startswith(pattern, F.lit("/"))
    if flavour == ONE_MORE_SEGMENT:
        on_path = on_path | F.endswith(pattern, F.lit("/*"))
    return on_path


def compiled_rules(patterns: Column, flavour: str) -> Column:
    """array<struct<pattern,on_path,regex>> for an array<string> of globs."""
    usable = F.filter(F.coalesce(patterns, F.array().cast("array<string>")), lambda p: p != "")
    return F.transform(
        usable,
        lambda p: F.struct(
            p.alias("pattern"), rule_on_path(p, flavour).alias("on_path"), rule_regex(p, flavour).alias("regex")
        ),
    )


# --- literal patterns ------------------------------------------------------------------

_META = set("\\.^$|+(){}[]*?")


def _quoted(text: str) -> str:
    return "".join("\\" + ch if ch in _META else ch for ch in text)


def _literal_body(pattern: str, star: str = ".*", one: str = ".") -> str:
    out, i = [], 0
    while i < len(pattern):
        ch = pattern[i]
        close = pattern.find("]", i + 2) if ch == "[" else -1
        if close > 0:
            inner = pattern[i + 1 : close]
            inner = "^" + inner[1:] if inner.startswith("!") else inner
            out.append("[" + inner.replace("\\", "\\\\").replace("[", "\\[").replace("&", "\\&") + "]")
            i = close
        else:
            out.append({"*": star, "?": one}.get(ch, _quoted(ch)))
        i += 1
    return "".join(out)


def literal_rule(pattern: str, flavour: str = PLAIN) -> Rule:
    on_path, body = pattern.startswith("/"), _literal_body(pattern)
    if flavour == ONE_MORE_SEGMENT and pattern.endswith("/*"):
        on_path, body = True, _quoted(pattern[:-2]) + "/[^/]+/*"
    elif flavour == PER_SEGMENT and on_path:
        segs = [s for s in pattern.split("/") if s]
        body = "/*" + "/+".join("[^/]+" if s == "*" else _literal_body(s, "[^/]*", "[^/]") for s in segs) + "/*"
    return Rule(pattern, on_path, "(?s)^" + body + r"\z")


def first_match(url: Column, rules) -> Column:
    """Pattern text of the first rule that matches, NULL when none does.

    ``rules`` is a Column from :func:`compiled_rules` or a list of :class:`Rule`.
    """
    if isinstance(rules, Column):
        hits = F.filter(
            rules, lambda r: F.rlike(F.when(r["on_path"], path_of(url)).otherwise(url), r["regex"])
        )
        return F.get(hits, F.lit(0))["pattern"]
    out = F.lit(None).cast("string")
    for rule in reversed(list(rules)):
        target = path_of(url) if rule.on_path else url
        out = F.when(F.rlike(target, F.lit(rule.regex)), F.lit(rule.pattern)).otherwise(out)
    return out


def glob_match(url: Column, pattern: str, flavour: str = PLAIN) -> Column:
    return first_match(url, [literal_rule(pattern, flavour)]).isNotNull() if pattern else F.lit(False)
