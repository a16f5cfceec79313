"""Mixing sources to target weights by iterative proportional fitting.

Tokens are counted by cell: source, language and topic, each a listed target
value or the rest.  The cell totals are raked until all three marginals meet
their targets.  The ratio of raked to present tokens is a cell's weight, scaled
to a token budget it is the probability by which its documents are sampled.

The cells are the product of the listed values, so what reaches the driver is
bounded by the parameters (``MAX_CELLS``), not by the data.

Defined results: null or unlisted values belong to the rest (``*``), which keeps its
present share where the targets leave nothing for it; a listed value
without tokens is left out and the other targets of its marginal are scaled up;
marginals that contradict each other are met as far as the last round got; a
text without words has no tokens and the probability of its cell (0 in a cell
without tokens); rows equal in id and text are sampled together; an empty table
gives no rows; other columns travel along, whatever their names.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesieve.llm.common import quoted

REST = "*"
MAX_CELLS = 100_000
SEED = 20240607
#: A smaller share is what rounding leaves of targets that sum to 1.
LEAST_REST = 1e-9
#: Topics by the marks of a text; the first that fits counts, others are prose.
TOPICS = {
    "legal": r"(?i)\blicen[cs]ed?\b|\bcopyright\b|\bwarranty\b",
    "contact": r"@[A-Za-z0-9-]+\.|\+[0-9]",
    "tabular": r"\x20\|\x20",
    "noise": r"[#*$%&]{3}",
}
PROSE = "prose"


@dataclass(frozen=True)
class Targets:
    """Shares of the tokens by value; the rest gets what is missing to 1, or keeps its present share if nothing is missing."""

    source: dict
    lang: dict
    topic: dict

    def axes(self) -> list[dict]:
        return [d | {REST: max(0.0, 1.0 - sum(d.values()))} for d in (self.source, self.lang, self.topic)]


def topic_of(text: Column, topics: dict = TOPICS) -> Column:
    out = F.lit(PROSE)
    for name, pattern in reversed(topics.items()):
        out = F.when(text.rlike(pattern), name).otherwise(out)
    return out


def _listed(column: Column, values: dict) -> Column:
    text = column.cast("string")
    return F.when(text.isin(list(values)), text).otherwise(REST) if values else F.lit(REST)


def measured(docs: DataFrame, targets: Targets, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic: Column | None = None, keep: list[str] | None = None, seed: int = SEED) -> DataFrame:
    """``row`` (the columns to keep), ``tokens``, the cell (``source``, ``lang``, ``topic``) and a draw ``u`` in [0, 1)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col(id_col), text), F.lit(1 << 53)) / F.lit(float(1 << 53))
    return docs.select(
        F.struct(*(quoted(c) for c in keep or docs.columns)).alias("row"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("tokens"),
        _listed(F.col(source_col), targets.source).alias("source"), _listed(F.col(lang_col), targets.lang).alias("lang"),
        _listed(topic_of(text) if topic is None else topic, targets.topic).alias("topic"), draw.alias("u"),
    )


def rake(present: np.ndarray, shares: list[np.ndarray], rounds: int = 1000, tolerance: float = 1e-10) -> np.ndarray:
    """Cell shares with the given marginals and the interactions of ``present`` (iterative proportional fitting)."""
    cells = present / present.sum()
    for _ in range(rounds):
        worst = 0.0
        for axis, share in enumerate(shares):
            others = tuple(i for i in range(cells.ndim) if i != axis)
            own = cells.sum(others)
            factor = np.divide(share, own, out=np.zeros_like(own), where=own > 0)
            worst = max(worst, np.abs(own - share).max())
            cells = cells * factor.reshape([-1 if i == axis else 1 for i in range(cells.ndim)])
        if worst < tolerance:
            break
    return cells


def probabilities(present: np.ndarray, raked: np.ndarray, budget: float) -> tuple[np.ndarray, np.ndarray]:
    """Weight (raked to present share) of each cell, and probabilities that spend ``budget`` of all tokens, at most 1 each."""
    share = present / present.sum()
    weight = np.divide(raked, share, out=np.zeros_like(raked), where=share > 0)
    low, high = 0.0, 1.0
    spent = lambda c: (np.minimum(1.0, c * weight) * share).sum()
    while spent(high) < min(budget, share[weight > 0].sum()) * (1 - 1e-12) and high < 1e18:
        high *= 2
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if spent(middle) < budget else (low, middle)
    return weight, np.minimum(1.0, high * weight)


def calibrate(docs: DataFrame, targets: Targets, budget: float) -> DataFrame:
    """A row for each cell: source, lang, topic, weight, probability."""
    axes = targets.axes()
    if math.prod(map(len, axes)) > MAX_CELLS:
        raise ValueError(f"more than {MAX_CELLS} cells")
    place = [{v: i for i, v in enumerate(axis)} for axis in axes]
    present = np.zeros([len(a) for a in axes])
    for r in docs.groupBy("source", "lang", "topic").agg(F.sum("tokens").alias("n")).collect():  # MAX_CELLS at most
        present[place[0][r.source], place[1][r.lang], place[2][r.topic]] += r.n or 0
    weight = chance = np.zeros_like(present)
    if present.sum() > 0:
        shares = []
        for i, axis in enumerate(axes):
            own = present.sum(tuple(j for j in range(3) if j != i))
            share = np.where(own > 0, np.array(list(axis.values()), float), 0.0)
            rest = place[i][REST]
            if share[rest] < LEAST_REST and own[rest] > 0:  # all is listed: the rest stays as large as it is
                share[rest] = 0.0
                kept = own[rest] / own.sum()
                share = share / max(share.sum(), 1e-300) * (1 - kept)
                share[rest] = kept
            shares.append(share / share.sum() if share.sum() > 0 else own / own.sum())
        weight, chance = probabilities(present, rake(present, shares), budget)
    rows = [(*names, float(weight[at]), float(chance[at])) for names, at in zip(itertools.product(*axes), np.ndindex(*present.shape), strict=True)]
    return docs.sparkSession.createDataFrame(rows, "source string, lang string, topic string, weight double, probability double")


def mix(docs: DataFrame, cells: DataFrame) -> DataFrame:
    """``docs`` (see ``measured``) with weight, probability and ``sampled``; the cells are bounded, so they are sent to every task."""
    return docs.join(F.broadcast(cells), ["source", "lang", "topic"]).withColumn("sampled", F.col("u") < F.col("probability"))


#: Targets of the query and of the pipeline: the large source is held down, no language falls short.
PRODUCTION = Targets(
    source={"src0": 0.20} | {f"src{i}": 0.04 for i in range(1, 20)},
    lang={"en": 0.50, "de": 0.18, "fr": 0.18, "es": 0.14},
    topic={PROSE: 0.85, "legal": 0.05, "contact": 0.06, "tabular": 0.03, "noise": 0.01},
)
BUDGET = 0.5
