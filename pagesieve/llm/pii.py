"""Personal data: strict patterns, and candidate spans judged by boosted trees.

Strict patterns with their checks (address parts, Luhn digits, digit counts)
give the base spans.  High-recall generators propose further, overlapping
spans: anything around an at-sign or a spelled-out one, any grouped number, any
coded number.  Trees boosted on format and context features learn from the
candidates themselves which look like personal data.  Positive examples are those
that pass a check of their generator (``checked``: an address once rewritten,
an account number by its remainder mod 97, a national number after a word like
"phone") or overlap a base span.  The trees are fitted to two thirds of them.  A
threshold calibrated on all that could be added selects the spans that are: every
score from it on reaches the precision by itself.  What fails the check of its length or form is never added.

Candidates stay in their document's row as arrays, so nothing is joined.  For
the fit they are counted by feature values and the counts (at most ``CELLS``
rows, whatever the data) are all the driver sees.  All steps are DataFrame
functions; the fitted trees are a column expression.

Defined results: null is an empty text; repeated rows give one row each; without
positive and negative candidates nothing is added; an empty table gives no rows;
other columns are ignored, whatever their names.  Offsets count code points,
ends are exclusive.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesieve.llm.common import durable

# The agreed patterns in forms that find the same matches in linear time and without recursion:
# possessive runs, tried only where a run begins or the last match ended.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BASE_KINDS = ("email", "ip", "card", "phone")
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"

_AT, _DOT = r"\x20?[\[(]at[\])]\x20?", r"\x20?[\[(]dot[\])]\x20?"
AT_LIKE = rf"(?:\G|(?<![^\s@<>()\[\]]))[^\s@<>()\[\]]++(?:@|{_AT})[^\s@<>()\[\]]++(?:{_DOT}[^\s@<>()\[\]]++)*+"
NUMBER_LIKE = r"[+(]?[0-9][0-9\x20().-]{5,}[0-9]"
CODE_LIKE = r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){10,30}\b"
MORE_KINDS = ("at_like", "number_like", "code_like")

#: Feature values, all small integers; the product bounds the cells that are counted.
FEATURES = {"kind": 3, "digits": 6, "joint": 5, "letters": 2, "before": 4, "after": 4, "hint": 3, "check": 3}
CELLS = 2 * 2 * math.prod(FEATURES.values())  # by label and fold
ROUNDS, RATE, PRECISION = 25, 0.3, 0.95

CONTACT = r"(?i)(e-?mail|mail|phone|tel|call|mobile|fax|contact|account|iban|card|ssn|passport|address|kontakt|telefon|correo|courriel)[^\n]{0,12}$"
COUNTED = r"(?i)(version|order|invoice|item|page|price|total|no|nr|id|isbn|\$|€|£|#)[\x20.:=#-]{0,3}$"


def _matches(text: Column, pattern: str, worth: Column) -> Column:
    """Arrays of (text, gap before, gap after) of all matches; nothing where ``worth`` is false."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    n = F.size(found)
    triples = F.arrays_zip(found.alias("m"), F.slice(gaps, 1, n).alias("b"), F.slice(gaps, 2, n).alias("a"))
    return F.when(worth, triples).otherwise(F.array().cast("array<struct<m:string,b:string,a:string>>"))


def _placed(triples: Column, kind: str) -> Column:
    """Spans of the matches: positions are running sums of gap and match lengths."""
    none = F.array().cast("array<struct<kind:string,start:int,end:int,m:string,before:string,after:string>>")

    def step(acc, x):
        start = acc["at"] + F.char_length(x["b"])
        end = start + F.char_length(x["m"])
        own = F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), x["m"].alias("m"), F.right(x["b"], F.lit(32)).alias("before"), F.left(x["a"], F.lit(1)).alias("after"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(own)).alias("out"))

    return F.aggregate(triples, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda acc: acc["out"])


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    each = F.split(F.reverse(digits), "")
    worth = F.transform(each, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((2 * d.cast("int")) % 10 + F.floor(d.cast("int") / 5).cast("int")))
    return F.aggregate(worth, F.lit(0), lambda a, x: a + x) % 10 == 0


def base_spans(text: Column) -> Column:
    """All checked base spans, ordered by start, then kind."""
    digit = text.rlike("[0-9]")
    spans = lambda kind, pattern, worth, good: F.filter(_placed(_matches(text, pattern, worth), kind), good)

    def card(s):
        d = _digits(s["m"])
        return F.when(F.char_length(d).between(14, 19), luhn(d)).otherwise(False)

    return F.concat(
        spans("email", EMAIL, F.contains(text, F.lit("@")), lambda s: F.lit(True)),
        spans("ip", IP, digit & text.rlike(r"[0-9]\.[0-9]"), lambda s: s["m"].rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")),
        spans("card", CARD, digit & text.rlike(r"[0-9](?:[\x20-]?[0-9]){13}"), card),
        spans("phone", PHONE, F.contains(text, F.lit("+")) & digit, lambda s: F.char_length(_digits(s["m"])).between(10, 15)),
    )


def candidates(text: Column) -> Column:
    digit = text.rlike("[0-9]")
    return F.concat(
        _placed(_matches(text, AT_LIKE, F.contains(text, F.lit("@")) | F.contains(text, F.lit("at]")) | F.contains(text, F.lit("at)"))), "at_like"),
        _placed(_matches(text, NUMBER_LIKE, digit), "number_like"),
        _placed(_matches(text, CODE_LIKE, digit), "code_like"),
    )


def remainder_97(code: Column) -> Column:
    """An account number's remainder: four characters moved to the end, letters as 10 to 35 (1 for a good one)."""
    bare = F.replace(code, F.lit(" "), F.lit(""))
    each = F.split(F.concat(F.substring(bare, 5, 100), F.left(bare, F.lit(4))), "")
    step = lambda acc, c: F.when(c.rlike("[0-9]"), acc * 10 + c.try_cast("int")).otherwise(acc * 100 + F.ascii(c) - 55) % 97
    return F.aggregate(each, F.lit(0), step)


def checked(c: Column) -> Column:
    """1 for a candidate that passes the check of its generator, 2 for a number that fails the one of its length, else 0."""
    address = F.regexp_replace(F.regexp_replace(c["m"], _AT, "@"), _DOT, ".")
    spelled = c["m"].rlike(_AT)
    mail = address.rlike(r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+\.?$") | (spelled & address.rlike(r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+[.,;:]?$"))
    digits = _digits(c["m"])
    n = F.char_length(digits)
    number = F.when(n.between(7, 13) & c["before"].rlike(CONTACT), 1).when(n.between(14, 19) & ~luhn(digits), 2).otherwise(0)
    code = F.when(remainder_97(c["m"]) == 1, 1).otherwise(2)
    return F.when(c["kind"] == "at_like", mail.cast("int")).when(c["kind"] == "code_like", code).otherwise(number)


def _featured(found: Column, base: Column) -> Column:
    """Candidates with their features and whether they overlap a base span (``hit``)."""

    def one(c):
        m, n = c["m"], F.char_length(_digits(c["m"]))
        digits = F.when(n == 0, 0).when(n < 7, 1).when(n < 10, 2).when(n <= 13, 3).when(n <= 19, 4).otherwise(5)
        joint = F.when(m.rlike(r"[()]"), 4).when(m.rlike(r"[0-9]-[0-9]"), 3).when(m.rlike(r"[0-9]\x20[0-9]"), 2).when(m.rlike(r"[0-9A-Za-z]\.[0-9A-Za-z]"), 1).otherwise(0)
        side = lambda x: F.when(x == "", 0).when(x.rlike(r"\s"), 1).when(x.rlike(r"[A-Za-z0-9]"), 3).otherwise(2)
        hint = F.when(c["before"].rlike(CONTACT), 1).when(c["before"].rlike(COUNTED), 2).otherwise(0)
        kind = F.array_position(F.array(*map(F.lit, MORE_KINDS)), c["kind"]).cast("int") - 1
        check = checked(c)
        hit = F.exists(base, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
        return F.struct(
            c["kind"].alias("name"), c["start"].alias("start"), c["end"].alias("end"), kind.alias("kind"), digits.alias("digits"), joint.alias("joint"),
            m.rlike("[A-Za-z]").cast("int").alias("letters"), side(F.right(c["before"], F.lit(1))).alias("before"), side(c["after"]).alias("after"), hint.alias("hint"), check.alias("check"), hit.alias("hit"),
        )

    return F.transform(found, one)


@dataclass
class Trees:
    """Boosted trees of two splits; a split asks whether a feature has one value."""

    bias: float = 0.0
    trees: list = field(default_factory=list)  # (feature, value, (feature, value, yes, no) if yes, same if no)
    threshold: float = 2.0

    def score(self, get, when):
        """Log odds; ``get(feature)`` and ``when(test, yes, no)`` work on columns as on numbers."""
        total = self.bias
        for f, v, yes, no in self.trees:
            leaf = lambda s: when(get(s[0]) == s[1], s[2], s[3])
            total = total + when(get(f) == v, leaf(yes), leaf(no))
        return total


def _best_split(cells):
    """(gain, feature, value, yes, no) for cells (features, gradient, weight): the split with the largest gain."""
    g, h = sum(c[1] for c in cells), sum(c[2] for c in cells)
    worth = lambda a, b: a * a / (b + 1.0)
    best = (0.0, "kind", -1, 0.0, g / (h + 1.0))
    for name, size in FEATURES.items():
        gs, hs = [0.0] * size, [0.0] * size
        for x, cg, ch in cells:
            gs[x[name]] += cg
            hs[x[name]] += ch
        for v in range(size):
            gain = worth(gs[v], hs[v]) + worth(g - gs[v], h - hs[v]) - worth(g, h)
            if gain > best[0] + 1e-12:
                best = (gain, name, v, gs[v] / (hs[v] + 1.0), (g - gs[v]) / (h - hs[v] + 1.0))
    return best


def fit(cells: list[tuple[dict, int, int]], apart: list[tuple[dict, int, int]], rounds: int = ROUNDS, precision: float = PRECISION) -> Trees:
    """Boost on counted cells (features, positives, negatives); calibrate on those of ``apart``."""
    model = Trees()
    pos, neg = sum(c[1] for c in cells), sum(c[2] for c in cells)
    if not pos or not neg:
        return model
    model.bias = math.log(pos / neg)
    odds = [model.bias] * len(cells)
    when = lambda test, yes, no: yes if test else no
    for _ in range(rounds):
        graded = []
        for (x, p, n), o in zip(cells, odds, strict=True):
            sure = 1 / (1 + math.exp(-o))
            graded.append((x, p - (p + n) * sure, (p + n) * sure * (1 - sure)))
        gain, f, v, *_ = _best_split(graded)
        if gain <= 1e-9:
            break
        sides = [[c for c in graded if (c[0][f] == v) is side] for side in (True, False)]
        leaves = [(s[1], s[2], RATE * s[3], RATE * s[4]) for s in map(_best_split, sides)]
        model.trees.append((f, v, *leaves))
        one = Trees(0.0, model.trees[-1:])
        odds = [o + one.score(c[0].get, when) for c, o in zip(cells, odds, strict=True)]
    scored = sorted(((model.score(x.get, when), p, n) for x, p, n in apart), key=lambda s: -s[0])
    model.threshold = math.inf  # nothing is added where the precision is not reached
    good = bad = 0
    for i, (s, p, n) in enumerate(scored):
        good, bad = good + p, bad + n
        last = i + 1 == len(scored) or scored[i + 1][0] < s
        if last and good and good >= precision * (good + bad):
            model.threshold = s
    return model


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", precision: float = PRECISION) -> DataFrame:
    """Per row: id, ``base`` and ``more`` spans (kind, start, end)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    rows = rows.select("id", base_spans(F.col("text")).alias("base"), candidates(F.col("text")).alias("found"))
    slim = F.transform("base", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    rows = durable(rows.select("id", slim.alias("base"), _featured(F.col("found"), F.col("base")).alias("found")))
    each = rows.select(F.xxhash64("id").alias("id"), F.inline("found")).withColumn("apart", F.pmod(F.xxhash64("id", "start", "end"), F.lit(3)) == 0)
    good = F.col("check") == 1
    n = lambda test: F.count_if(test)
    counts = each.groupBy("apart", *FEATURES).agg(n(F.col("hit") | good).alias("p"), n(~F.col("hit") & ~good).alias("n"), n(~F.col("hit") & good).alias("open_p")).collect()  # CELLS at most
    features = lambda r: {f: r[f] for f in FEATURES}
    # calibrated on what could be added: a base span needs no adding, so it is no evidence
    model = fit([(features(r), r.p, r.n) for r in counts if not r.apart], [(features(r), r.open_p, r.n) for r in counts if r["check"] != 2], precision=precision)
    if not model.trees:
        more = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    else:
        when = lambda test, yes, no: F.when(test, yes).otherwise(no)
        chosen = F.filter("found", lambda c: ~c["hit"] & (c["check"] != 2) & (model.score(lambda f: c[f], when) >= model.threshold))
        more = F.transform(chosen, lambda c: F.struct(c["name"].alias("kind"), c["start"].alias("start"), c["end"].alias("end")))
    return rows.select(F.col("id").alias(id_col), "base", more.alias("more"))


def _joined(spans: Column, kinds: tuple[str, ...]) -> Column:
    rank = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.array_position(F.array(*map(F.lit, kinds)), s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.array_join(F.transform(F.sort_array(rank), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [count(kind) for kind in BASE_KINDS]
    return found.select(
        id_col, *counts, F.sha2(_joined(F.col("base"), BASE_KINDS), 256).alias("base_sha256"),
        _joined(F.concat("base", "more"), BASE_KINDS + MORE_KINDS).alias("spans"),
    )


def redact(text: Column, base: Column, more: Column) -> Column:
    """The text with every span replaced by its kind in brackets; overlapping spans become one of the first kind."""
    ordered = F.sort_array(F.transform(F.concat(base, more), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        fresh = s["start"] >= acc["at"]
        gap = F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, F.concat(acc["out"], gap, F.lit("["), s["kind"], F.lit("]"))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(ordered, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.char_length(text))))
