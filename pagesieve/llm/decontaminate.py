"""Benchmark decontamination by winnowing.

Documents and test items are cut into words; of every window of
``span - k + 1`` consecutive k-gram hashes the smallest is kept as a fingerprint.
A shared run of ``span`` words therefore shares a fingerprint.  Training and test
fingerprints are joined, and each hit is extended on both sides over the words
kept beside it; only runs of ``span`` equal words count.  Test items of fewer
words (but at least one) are matched as one run of their own length.

Documents are read once.  A fixed-size bit set of the test fingerprints lets only
plausible fingerprints leave the scan; the join and the extension decide.

Defined results: null or wordless texts have no words and no hits; repeated
rows give one row each; an empty test table hits nothing; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesieve.llm.common import BitSet, durable
from pagesieve.llm.tokens import LETTERS_DIGITS, Words, signed, words

SPAN, K = 10, 5
_HIT = "fp long, size int, ctx array<long>"


def winnow(found: Words, k: int, span: int) -> np.ndarray:
    """Positions whose k-gram hash is the smallest of some window (all of equal smallest ones)."""
    grams, whole = found.grams(k)
    n, width = len(grams), span - k + 1
    if n < width:
        return np.zeros(0, np.int64)
    grams = np.where(whole, grams, np.uint64(2**64 - 1))
    least = grams[: n - width + 1].copy()
    for j in range(1, width):
        np.minimum(least, grams[j : n - width + 1 + j], out=least)
    left = np.repeat(found.offsets[1:], found.counts) - np.arange(n)
    least[left[: n - width + 1] < span] = 0  # the window crosses the end of its row
    most = np.zeros(n, np.uint64)
    for j in range(width):
        np.maximum(most[j : n - width + 1 + j], least, out=most[j : n - width + 1 + j])
    return np.flatnonzero(whole & (most == grams))


def _context(found: Words, at: np.ndarray, k: int, span: int) -> np.ndarray:
    """Word hashes from ``span - k`` words before to ``span - 1`` words after; 0 outside the row."""
    place = at[:, None] + np.arange(k - span, span)[None, :]
    row = np.searchsorted(found.offsets, at, "right") - 1
    fine = (place >= found.offsets[row][:, None]) & (place < found.offsets[row + 1][:, None])
    return np.where(fine, found.hashes[np.clip(place, 0, len(found.hashes) - 1)], np.uint64(0))


def _hits(found: Words, k: int, span: int, short: tuple[int, ...], seen: BitSet | None):
    """(word position, fingerprint, size, context) arrays; size 0 marks a fingerprint, else a short run."""
    at = winnow(found, k, span)
    grams, _ = found.grams(k)
    if seen is not None:
        at = at[seen.has(grams[at])]
    yield at, grams[at], 0, _context(found, at, k, span)
    for size in short:
        grams, whole = found.grams(size)
        at = np.flatnonzero(whole)
        if seen is not None:
            at = at[seen.has(grams[at])]
        yield at, grams[at], size, found.hashes[at[:, None] + np.arange(size)[None, :]]


def _item_rows(k: int, span: int):
    def run(batches):
        for batch in batches:
            ids, fps, sizes, ctx = [], [], [], []
            for found in words(batch.column(1), LETTERS_DIGITS):
                n_words = found.counts
                for size in range(span):  # 0: fingerprints; else items of just this many words
                    rows = np.flatnonzero(n_words == size) if size else np.flatnonzero(n_words >= span)
                    if not len(rows):
                        continue
                    for at, fp, kind, context in _hits(found, k, span, (size,) if size else (), None):
                        if kind != size:
                            continue
                        row = np.searchsorted(found.offsets, at, "right") - 1
                        keep = np.isin(row, rows)
                        ids += (found.first + row[keep]).tolist()
                        fps += signed(fp[keep]).tolist()
                        sizes += [size] * int(keep.sum())
                        ctx += signed(context[keep]).tolist()
            item = batch.column(0).take(pa.array(ids, pa.int64()))
            yield pa.record_batch([item, pa.array(fps, pa.int64()), pa.array(sizes, pa.int32()), pa.array(ctx, pa.list_(pa.int64()))], ["item", "fp", "size", "ctx"])

    return run


def _document_rows(k: int, span: int, short: tuple[int, ...], seen: BitSet):
    """One row a document: number of words, and its plausible hits, equal ones once with all positions."""
    kind = pa.list_(pa.struct([("fp", pa.int64()), ("size", pa.int32()), ("ctx", pa.list_(pa.int64())), ("at", pa.list_(pa.int32()))]))

    def run(batches):
        for batch in batches:
            counts, hits = np.zeros(batch.num_rows, np.int64), [None] * batch.num_rows
            for found in words(batch.column(2), LETTERS_DIGITS):
                counts[found.first : found.first + len(found.counts)] = found.counts
                for at, fp, size, context in _hits(found, k, span, short, seen):
                    if not len(at):
                        continue
                    row = np.searchsorted(found.offsets, at, "right") - 1
                    place = at - found.offsets[row]
                    for r, p, f, c in zip((row + found.first).tolist(), place.tolist(), signed(fp).tolist(), signed(context), strict=True):
                        own = hits[r] = hits[r] if hits[r] is not None else {}
                        own.setdefault((f, size, c.tobytes()), []).append(p)
            lists = [[{"fp": f, "size": s, "ctx": np.frombuffer(c, np.int64), "at": p} for (f, s, c), p in h.items()] if h else [] for h in hits]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(counts), pa.array(lists, kind)], ["id", "mark", "n_words", "hits"])

    return run


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", span: int = SPAN, k: int = K, bits: int = 1 << 23) -> DataFrame:
    """Per document row: id, n_words, hit word runs (``runs``: start, size), the ``items`` found and ``row_hash``.

    ``row_hash`` is ``xxhash64(id, text)``, to find the row again.

    ``bits`` sizes the bit set that thins out fingerprints in the scan: 1 MB by
    default, whatever the sizes of the tables; raise it with the test table.
    """
    if not 0 < k <= span <= 64:
        raise ValueError("1 <= k <= span <= 64")
    tests = items.select(F.col(item_col).alias("item"), F.col(item_text_col).cast("string").alias("text"))
    tests = durable(tests.mapInArrow(_item_rows(k, span), f"item {dict(tests.dtypes)['item']}, {_HIT}").distinct())
    short = tuple(sorted(r[0] for r in tests.where("size > 0").select("size").distinct().collect()))  # below span
    seen = BitSet.of(tests.select("fp"), bits)
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(id_col), F.col(text_col).cast("string")).alias("mark"), F.col(text_col).cast("string").alias("text"))
    schema = f"id {dict(texts.dtypes)['id']}, mark long, n_words long, hits array<struct<fp:long,size:int,ctx:array<long>,at:array<int>>>"
    scanned = durable(texts.mapInArrow(_document_rows(k, span, short, seen), schema))
    # equal texts under one id have equal hits: work on them once
    hits = scanned.where(F.size("hits") > 0).dropDuplicates(["id", "mark"]).select("id", "mark", F.inline("hits"))
    theirs = tests.withColumnRenamed("ctx", "theirs")
    wide, reach = span - k + 1, span - k
    offsets = F.array(*[
        F.when((F.slice("ctx", o + 1, span) == F.slice("theirs", o + 1, span)) & ~F.array_contains(F.slice("ctx", o + 1, span), 0), o - reach)
        for o in range(wide)
    ])
    starts = F.when(F.col("size") == 0, F.array_compact(offsets)).when(F.col("ctx") == F.col("theirs"), F.array(F.lit(0)))
    found = hits.join(theirs, ["fp", "size"]).withColumn("shift", starts).where(F.size("shift") > 0)
    length = F.when(F.col("size") == 0, F.lit(span)).otherwise(F.col("size"))
    runs = F.flatten(F.transform("at", lambda p: F.transform("shift", lambda s: F.struct((p + s).alias("start"), length.alias("size")))))
    found = found.select("id", "mark", "item", F.explode(runs).alias("run"))
    per_doc = found.groupBy("id", "mark").agg(F.sort_array(F.collect_set("run")).alias("runs"), F.collect_set("item").alias("items"))
    here = per_doc.withColumnsRenamed({"id": "their_id", "mark": "their_mark"})
    both = scanned.select("id", "mark", "n_words").join(here, F.col("id").eqNullSafe(F.col("their_id")) & (F.col("mark") == F.col("their_mark")), "left")
    return both.select(F.col("id").alias(id_col), "n_words", F.coalesce("runs", F.array().cast("array<struct<start:int,size:int>>")).alias("runs"), F.coalesce("items", F.array().cast(f"array<{dict(tests.dtypes)['item']}>")).alias("items"), F.col("mark").alias("row_hash"))


def covered(runs):
    """Number of words in the union of sorted runs."""
    step = lambda acc, r: F.struct(
        (acc["n"] + F.greatest(r["start"] + r["size"] - F.greatest(r["start"], acc["end"]), F.lit(0))).cast("long").alias("n"),
        F.greatest(acc["end"], r["start"] + r["size"]).alias("end"),
    )
    return F.aggregate(runs, F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")), step, lambda acc: acc["n"])


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    names = F.sort_array(F.transform("items", lambda x: x.cast("string")))
    n_hit = covered(F.col("runs"))
    return found.select(
        id_col, "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


ORACLE = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
tests AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM tests WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM windows),
grams AS (
  SELECT doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') AS g
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM words, sizes WHERE len(w) >= size)),
hits AS (SELECT doc_id, i, size, item_id FROM grams JOIN windows USING (size, g)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hits) GROUP BY doc_id),
found AS (
  SELECT doc_id, count(*) AS n, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS names
  FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(found.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(covered.n, 0) > 0 AS contaminated
FROM words LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""
