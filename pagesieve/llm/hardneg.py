"""Hard negatives by a residue-number-system matrix product.

Vectors are scaled to integers.  Their scores are needed exactly, yet the fast
matrix product is the one of float32, which holds integers up to 2**24 only.  So
blocks of anchors and rows are multiplied modulo several primes: residues are
small enough for every partial sum to be exact, whatever the order of summation.
Chinese remaindering (mixed radix) puts the signed scores together again; the
number of primes follows from the longest vector of all, which bounds any score
(Cauchy-Schwarz).

Anchors are the rows whose id is divisible by ``every``; they meet all rows, in
blocks of bounded size drawn by row number, so no label, id or vector makes a
block large.  A first pass keeps each anchor's best rows of its own label, a
second one the best rows of other labels inside each positive's window of scores.
A block returns ``positives`` or ``negatives`` rows an anchor at most; these are
ranked with a bound per anchor.

Defined results: rows with a null label, a null vector or any null or non-finite
component take no part; neither do vectors whose scaled squared length is 2**50
or more (components of some 100,000; their scores would leave 64 bits); vectors
of different lengths are filled up with zeros, an empty vector is all zeros; a
null id is no anchor and comes last among ties; rows equal in id, label and
scaled vector are one row; rows of one id with other labels or vectors are rows
of their own; an empty table gives no rows; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagesieve.llm.common import durable, sums

SCALE = 256
#: Primes of ten bits, the largest first: 64 products of residues up to 510 stay under 2**24.
PRIMES = (1021, 1019, 1013, 1009, 997, 991, 983)
DEPTH = 64
MOST_LENGTH = 1 << 50
ANCHOR_BLOCK, ROW_BLOCK = 1024, 2048
NO_SCORE = np.iinfo(np.int64).min


def primes_for(bound: int) -> tuple[int, ...]:
    """The fewest primes whose product tells all integers of at most ``bound`` in size apart."""
    product = 1
    for i, p in enumerate(PRIMES):
        product *= p
        if product > 2 * bound:
            return PRIMES[: i + 1]
    raise ValueError("the scores leave 64 bits")


def _residues(matrix: np.ndarray, p: int) -> np.ndarray:
    """Residues between -p/2 and p/2."""
    return ((matrix + p // 2) % p - p // 2).astype(np.float32)


def _product(a: np.ndarray, b: np.ndarray, p: int) -> np.ndarray:
    """Residues (0 to p - 1) of a @ b.T, summed in parts that float32 holds exactly."""
    x, y = _residues(a, p), _residues(b, p)
    total = np.zeros((len(a), len(b)), np.int64)
    for k in range(0, a.shape[1], DEPTH):
        total += (x[:, k : k + DEPTH] @ y[:, k : k + DEPTH].T).astype(np.int32)
    return total % p


def scores(a: np.ndarray, b: np.ndarray, primes: tuple[int, ...]) -> np.ndarray:
    """Exact inner products of the integer rows of a and b, as int64."""
    known, size = _product(a, b, primes[0]), primes[0]
    for p in primes[1:]:
        digit = (_product(a, b, p) - known) * pow(size, -1, p) % p
        known += digit * size
        size *= p
    known[known > size // 2] -= size
    return known


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    lists = column.combine_chunks()
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(lists), width), np.int64)
    row = np.repeat(np.arange(len(lists)), sizes)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def _sorted(block: pa.Table) -> pa.Table:
    """By id, nulls last: the first of equal scores is then the one that counts first."""
    return block.sort_by([("vec_id", "ascending"), ("row_no", "ascending")])


def _best(matrix: np.ndarray, k: int):
    """The k largest of every row, one after another: places and values; the matrix is used up."""
    rows = np.arange(len(matrix))
    for _ in range(min(k, matrix.shape[1])):
        at = matrix.argmax(1)
        yield at, matrix[rows, at].copy()
        matrix[rows, at] = NO_SCORE


def _numbers(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def _positives(width: int, primes: tuple[int, ...], k: int):
    """Block pass one: of each anchor, the k best other rows of its label."""

    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        rows = _sorted(rows)
        a, b = _matrix(anchors.column("vector"), width), _matrix(rows.column("vector"), width)
        mine, theirs = _numbers(anchors, "row_no"), _numbers(rows, "row_no")
        labels, their_labels = _numbers(anchors, "label"), _numbers(rows, "label")
        parts = [(mine[:0], np.zeros(0, np.int64), mine[:0])]
        for label in np.unique(labels):
            i, j = np.flatnonzero(labels == label), np.flatnonzero(their_labels == label)
            if not len(j):
                continue
            found = scores(a[i], b[j], primes)
            found[mine[i][:, None] == theirs[j][None, :]] = NO_SCORE
            for at, score in _best(found, k):
                real = score > NO_SCORE
                parts.append((mine[i][real], j[at[real]], score[real]))
        anchor, place, score = (np.concatenate(p) for p in zip(*parts, strict=True))
        ids = rows.column("vec_id").take(pa.array(place))
        return pa.table({"anchor": anchor, "positive_id": ids, "positive": theirs[place], "positive_score": score})

    return run


def _negatives(width: int, primes: tuple[int, ...], k: int, low: int, high: int):
    """Block pass two: of each anchor and positive, the k best rows of other labels inside the window."""

    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        rows = _sorted(rows)
        mine = _numbers(anchors, "row_no")
        first = np.unique(mine, return_index=True)[1]  # an anchor comes once for each positive
        own = anchors.take(pa.array(first))
        found = scores(_matrix(own.column("vector"), width), _matrix(rows.column("vector"), width), primes)
        found[_numbers(own, "label")[:, None] == _numbers(rows, "label")[None, :]] = NO_SCORE
        of = np.searchsorted(mine[first], mine)
        wanted = _numbers(anchors, "positive_score")
        least, most = -((-low * wanted) // 100), (high * wanted) // 100
        parts = [(of[:0], of[:0], wanted[:0])]
        turn = _numbers(anchors, "positive_rank")
        for t in np.unique(turn):  # the anchors' first positives, then their second ones
            i = np.flatnonzero(turn == t)
            inside = found[of[i]]
            inside[(inside < least[i][:, None]) | (inside > most[i][:, None])] = NO_SCORE
            for at, score in _best(inside, k):
                real = score > NO_SCORE
                parts.append((i[real], at[real], score[real]))
        i, place, score = (np.concatenate(p) for p in zip(*parts, strict=True))
        pick = pa.array(i)
        return pa.table({
            "anchor": mine[i], "positive": anchors.column("positive").take(pick), "anchor_id": anchors.column("vec_id").take(pick), "positive_id": anchors.column("positive_id").take(pick),
            "positive_score": wanted[i], "negative_id": rows.column("vec_id").take(pa.array(place)), "negative": _numbers(rows, "row_no")[place], "negative_score": score,
        })

    return run


def _first(df: DataFrame, by: list[str], score: str, id_col: str, tie: str, k: int, rank: str) -> DataFrame:
    """The first k of every group; the group's bound is applied in every task before rows are shuffled."""
    order = Window.partitionBy(*by).orderBy(F.col(score).desc(), F.col(id_col).asc_nulls_last(), tie)
    return df.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= k)


def vectors(rows: DataFrame, id_col: str, vector_col: str, label: Column) -> DataFrame:
    """Distinct rows that take part: ``vec_id``, ``label``, integer ``vector``, squared ``length`` and a ``row_no``."""
    whole = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    numbers = F.transform(F.when(whole, F.col(vector_col)).otherwise(F.array().cast(rows.schema[vector_col].dataType)), lambda x: F.floor(x.cast("double") * SCALE).cast("double"))
    found = rows.where(F.col(vector_col).isNotNull() & F.coalesce(whole, F.lit(False))).select(F.col(id_col).alias("vec_id"), label.cast("long").alias("label"), numbers.alias("numbers"))
    found = found.withColumn("length", F.aggregate("numbers", F.lit(0.0), lambda a, x: a + x * x)).where((F.col("length") < float(MOST_LENGTH)) & F.col("label").isNotNull())
    found = found.select("vec_id", "label", F.transform("numbers", lambda x: x.cast("int")).alias("vector"), "length").distinct()
    return durable(found.withColumn("row_no", F.monotonically_increasing_id()))


def mine(
    rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", label: Column | None = None,
    every: int = 50, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
) -> DataFrame:
    """Per anchor and positive the first ``negatives`` rows of other labels whose score is ``low`` to ``high`` percent of the positive's.

    ``label`` replaces the label column by an expression of it.
    """
    found = vectors(rows, id_col, vector_col, F.col(label_col) if label is None else label)
    number = F.size("vector")
    n, anchors, longest, width = sums(found, F.count("*"), F.count_if(F.col("vec_id") % every == 0), F.max("length"), F.max(number))
    primes, width = primes_for(int(longest or 0) + 1), max(1, width or 0)
    row_blocks, anchor_blocks = -(-max(n, 1) // ROW_BLOCK), -(-max(anchors, 1) // ANCHOR_BLOCK)
    numbered = lambda blocks: F.sequence(F.lit(0), F.lit(blocks - 1))
    block = lambda blocks: F.pmod(F.xxhash64("row_no"), F.lit(blocks)).cast("int")
    spread = found.withColumn("rows_of", block(row_blocks)).withColumn("anchors_of", F.explode(numbered(anchor_blocks))).groupBy("anchors_of", "rows_of")
    again = found.select(*(F.col(c).alias(c) for c in found.columns))  # the two sides of a cogroup need columns of their own
    chosen = again.where(F.col("vec_id") % every == 0).withColumn("anchors_of", block(anchor_blocks)).withColumn("rows_of", F.explode(numbered(row_blocks)))
    kind = dict(found.dtypes)["vec_id"]

    near = chosen.groupBy("anchors_of", "rows_of").cogroup(spread).applyInArrow(_positives(width, primes, positives), f"anchor long, positive_id {kind}, positive long, positive_score long")
    near = durable(_first(near, ["anchor"], "positive_score", "positive_id", "positive", positives, "positive_rank"))
    sought = chosen.join(near.withColumnRenamed("anchor", "row_no"), "row_no").groupBy("anchors_of", "rows_of")
    schema = f"anchor long, positive long, anchor_id {kind}, positive_id {kind}, positive_score long, negative_id {kind}, negative long, negative_score long"
    hard = sought.cogroup(spread).applyInArrow(_negatives(width, primes, negatives, low, high), schema)
    hard = _first(hard, ["anchor", "positive"], "negative_score", "negative_id", "negative", negatives, "rank")
    return hard.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


ORACLE = r"""
WITH kept AS (
  SELECT DISTINCT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT a.vec_id AS anchor_id, a.label AS own, b.vec_id AS other_id, b.label AS label, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM kept a, kept b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
positives AS (
  SELECT anchor_id, own, other_id AS positive_id, score AS positive_score FROM pairs WHERE label = own
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.other_id) AS INTEGER) AS rank,
       n.other_id AS negative_id, p.positive_score, n.score AS negative_score
FROM positives p JOIN pairs n ON n.anchor_id = p.anchor_id AND n.label <> p.own AND 50 * p.positive_score <= 100 * n.score AND 100 * n.score <= 95 * p.positive_score
QUALIFY rank <= 3
"""
