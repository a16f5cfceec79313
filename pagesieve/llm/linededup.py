"""Line deduplication over range-partitioned, sorted line hashes.

Every long enough line becomes a 128-bit hash of its key (ends stripped, A-Z
lower-cased) with its document and position.  The hashes are range-partitioned
and sorted by hash, document (largest first) and position.  Document and
position belong to the range key, so a line that a third of all documents share
is spread over many partitions.  A partition is then streamed: of each run of
one hash the first document stays and, once enough documents are seen, the
others are given up.  Only a partition's first and last run can go on in its
neighbours; their counts, two rows a partition, are put together by the driver
and sent to all.

No text is shuffled for this.  What comes back are keep bitmaps: 64 lines a
word, only those words in which a line is lost.  They are merged by ``bit_or``
and applied to the texts that lose lines; all other texts pass unshuffled.

Defined results: a null or empty text is one empty line; documents are counted
by distinct id, a null id is one id below all others; all lines of the largest
id stay, in each of its rows; rows equal in id and text lose the same lines;
lines that are only blanks have an empty key and stay; an empty table gives no
rows; other columns are ignored, whatever their names.  Lines are told apart by
128-bit hashes.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesieve.llm.common import BitSet, durable

BLANKS = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_POINTS, MIN_DOCS = 40, 5
SEED = 20240607


def _text(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def _row_hash(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col), _text(text_col))


def line_hashes(docs: DataFrame, id_col: str, text_col: str, min_points: int) -> DataFrame:
    """``high``, ``low`` (hash), ``id``, ``own`` (the id as a number, equal for equal ids), ``row_hash``, ``pos`` and a ``turn`` that no other line has."""
    each = docs.select(F.col(id_col).alias("id"), _row_hash(id_col, text_col).alias("row_hash"), F.posexplode(F.split(_text(text_col), "\n")).alias("pos", "line"))
    bare = each.withColumn("line", F.btrim("line", F.lit(BLANKS))).where(F.char_length("line") >= min_points)
    key = F.translate("line", UPPER, LOWER)
    return bare.select(F.xxhash64(key).alias("high"), F.xxhash64(F.lit(SEED), key).alias("low"), "id", F.xxhash64("id").alias("own"), "row_hash", "pos", F.monotonically_increasing_id().alias("turn"))


def in_ranges(lines: DataFrame) -> DataFrame:
    """Partitions of the whole order, sorted, in the shared folder: both passes see the same ones.

    ``spark.sql.shuffle.partitions`` is their number.
    """
    order = ["high", "low", F.col("id").desc_nulls_last(), "pos", "turn"]
    return durable(lines.repartitionByRange(int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order))


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Whether a row differs from the one before; the first one does."""
    out = np.ones(len(columns[0]), bool)
    out[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return out


def _edges(batches):
    """Of a partition's first and last run (one row if they are the same): hash, documents, first and last document."""
    runs: list[list[int]] = []  # first and last run so far
    for batch in batches:
        if not batch.num_rows:
            continue
        high, low, own = (batch.column(c).to_numpy() for c in ("high", "low", "own"))
        new = _changes(high, low)
        starts = np.flatnonzero(new)
        docs = np.add.reduceat(new | _changes(own), starts)
        ends = np.concatenate((starts[1:], [len(high)])) - 1
        for r in sorted({0, len(starts) - 1}):
            s, e = starts[r], ends[r]
            found = [int(high[s]), int(low[s]), int(docs[r]), int(own[s]), int(own[e])]
            if runs and runs[-1][:2] == found[:2]:
                runs[-1][2] += found[2] - (runs[-1][4] == found[3])
                runs[-1][4] = found[4]
            else:
                runs[1:] = [found] if runs else []
                runs = runs or [found]
    part = TaskContext.get().partitionId()
    yield pa.record_batch([[part] * len(runs), list(range(len(runs))), *([r[i] for r in runs] for i in range(5))], pa.schema([(n, pa.int64()) for n in ("part", "turn", "high", "low", "docs", "first", "last")]))


def verdicts(ranges: DataFrame) -> dict[tuple[int, int], tuple[int, int]]:
    """Documents and first document of every hash at an edge of a partition; two rows a partition, however many lines."""
    edges = ranges.select("high", "low", "own").mapInArrow(_edges, "part long, turn long, high long, low long, docs long, first long, last long")
    out: dict[tuple[int, int], tuple[int, int]] = {}
    last: dict[tuple[int, int], int] = {}
    for r in sorted(edges.collect()):
        key = (r.high, r["low"])
        docs, first = out.get(key, (0, r["first"]))
        out[key] = (docs + r.docs - (last.get(key) == r["first"] and key in last), first)
        last[key] = r["last"]
    return out


def _given_up(edges: dict[tuple[int, int], tuple[int, int]], min_docs: int):
    """Stream a partition: lines of hashes in enough documents, but for those of the first document."""

    def run(batches):
        held, settled = None, None  # rows of a run that may go on; hash and first document of one that has enough documents
        for batch in itertools.chain(batches, [None]):
            parts = [x for x in (held, batch) if x is not None and x.num_rows]
            if not parts:
                continue
            rows, held = pa.Table.from_batches(parts).combine_chunks(), None
            high, low, own = (rows.column(c).to_numpy() for c in ("high", "low", "own"))
            new = _changes(high, low)
            starts = np.flatnonzero(new)
            first = own[starts]
            drop = np.add.reduceat(new | _changes(own), starts) >= min_docs
            for r in {0, len(starts) - 1}:
                key = (int(high[starts[r]]), int(low[starts[r]]))
                if key in edges:
                    drop[r], first[r] = edges[key][0] >= min_docs, edges[key][1]
                elif settled is not None and settled[:2] == key:
                    drop[r], first[r] = True, settled[2]
            run_of = np.cumsum(new) - 1
            gone = drop[run_of] & (own != first[run_of])
            settled = (int(high[-1]), int(low[-1]), int(first[-1])) if drop[-1] else None
            if settled is None and batch is not None:
                held = rows.slice(starts[-1]).to_batches()[0]
            yield from rows.select(["id", "row_hash", "pos"]).filter(pa.array(gone)).to_batches()

    return run


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_points: int = MIN_POINTS, min_docs: int = MIN_DOCS) -> DataFrame:
    """Of the rows that lose lines: id, ``row_hash``, ``n_dropped`` and ``keep``, the words (``word``, ``bits``) of the keep bitmap that are not all ones.

    Bit ``b`` of word ``w`` is line ``64 * w + b``; ``row_hash`` finds the row among those of its id.
    """
    ranges = in_ranges(line_hashes(docs, id_col, text_col, min_points))
    edges = verdicts(ranges)
    schema = ranges.select("id", "row_hash", "pos").schema
    gone = ranges.select("high", "low", "own", "id", "row_hash", "pos").mapInArrow(_given_up(edges, min_docs), schema)
    word, bit = F.expr("pos DIV 64").cast("int"), F.expr("shiftleft(1L, pos % 64)")
    words = gone.groupBy("id", "row_hash", word.alias("word")).agg(F.bit_or(bit).alias("lost"))
    kept = F.collect_list(F.struct("word", F.bitwise_not("lost").alias("bits")))
    return words.groupBy("id", "row_hash").agg(F.sum(F.bit_count("lost")).cast("long").alias("n_dropped"), kept.alias("keep")).withColumnRenamed("id", id_col)


def _cut(batches):
    for batch in batches:
        out = []
        for text, keep in zip(batch.column("text").to_pylist(), batch.column("keep").to_pylist(), strict=True):
            if keep:
                lines = text.split("\n")
                stays = np.full(-(-len(lines) // 64), -1, np.int64)
                stays[[k["word"] for k in keep]] = [k["bits"] for k in keep]
                bits = np.unpackbits(stays.view(np.uint8), bitorder="little")
                text = "\n".join(itertools.compress(lines, bits.tolist()))
            out.append(text)
        yield pa.record_batch([batch.column("id"), batch.column("n_lines"), batch.column("n_dropped"), pa.array(out, pa.string())], ["id", "n_lines", "n_dropped", "kept"])


def kept_texts(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 1 << 24) -> DataFrame:
    """Every row's id, ``n_lines``, ``n_dropped`` and ``kept``, the text without the lines its bitmap gives up.

    A bit set of fixed size lets texts without a bitmap pass unshuffled; its false hits only cost time.
    """
    bitmaps = durable(bitmaps.select(F.col(id_col).alias("own_id"), F.col("row_hash").alias("own_hash"), "n_dropped", "keep"))
    marked = BitSet.of(bitmaps.select("own_hash"), bits)

    @F.pandas_udf("boolean")
    def maybe(keys: pd.Series) -> pd.Series:
        return pd.Series(marked.has(keys.to_numpy().view(np.uint64)))

    text = _text(text_col)
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), _row_hash(id_col, text_col).alias("row_hash"), (F.regexp_count(text, F.lit("\n")) + 1).cast("long").alias("n_lines"))
    rows = rows.withColumn("maybe", maybe("row_hash"))
    found = rows.where("maybe").join(bitmaps, F.col("id").eqNullSafe(F.col("own_id")) & (F.col("row_hash") == F.col("own_hash")), "left")
    found = found.select("id", "n_lines", F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"), "text", "keep")
    whole = rows.where("NOT maybe").select("id", "n_lines", F.lit(0).cast("long").alias("n_dropped"), F.col("text").alias("kept"))
    return found.mapInArrow(_cut, whole.schema).union(whole).withColumnRenamed("id", id_col)


ORACLE = r"""
WITH lines AS (
  SELECT r, doc_id, i, l[i] AS line,
         translate(trim(l[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT r, doc_id, l, unnest(range(1, len(l) + 1)) AS i
        FROM (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))),
shared AS (
  SELECT k, max(doc_id) AS keeper FROM lines WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
judged AS (
  SELECT r, doc_id, i, line, keeper IS NULL OR keeper = doc_id AS stays FROM lines LEFT JOIN shared USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT stays) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (stays), '')) AS kept_sha256
FROM judged GROUP BY r, doc_id
"""
