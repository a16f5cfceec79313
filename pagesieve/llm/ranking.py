"""Ranked lexical search, term-at-a-time for short lists and document-at-a-time for long ones.

Documents are searched where they are read: a slice of a partition becomes a
small inverted index of the terms that any query asks for, and all queries of a
block run over it.  For a query, the postings of its short lists are summed up
term by term; the sums are then one more list, with a bound of its own, that is
walked together with the long lists.  Blocks of documents whose bounds (of the
sums and of every long list) cannot reach the score of the ``k``-th best
document found so far in the partition are skipped; the most promising blocks
go first, so that this score rises soon.  Scores are exact integers, equal to
those of an exhaustive search.

Document counts, lengths and document frequencies are taken over all documents
first.  Queries go out in blocks of at most ``BLOCK_TERMS`` terms (or one query);
every block is one pass over the documents, whatever its queries.  A slice
returns ``k`` documents a query at most, and fewer as the partition's k-th best
score rises.

A term is a run of letters and digits, A-Z lower-cased, told apart by its 64-bit
hash.

Defined results: null texts have no terms; a query without terms, or with none
that a document holds, has no rows; every row is a document of its own, repeated
ones too, and every query row gets a list of its own; a null id comes last among
ties; without a document that has terms there are no rows; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagesieve.llm.common import BitSet, durable, sums
from pagesieve.llm.tokens import LETTERS_DIGITS, signed, words

TOP = 20
BLOCK_TERMS = 1 << 18
#: A list of so few documents in a slice is summed up at once.
SHORT = 64
NUMBERED = 4096  # queries that are numbered in one task
SKIP = 128  # documents with one bound
EAGER = 4  # blocks that are scored before the others are judged
HELD = 10_000


def _counted(groups: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (group, term) with their counts, in this order."""
    if not len(terms):
        return groups, terms, groups
    order = np.lexsort((terms, groups))
    groups, terms = groups[order], terms[order]
    new = np.ones(len(terms), bool)
    new[1:] = (groups[1:] != groups[:-1]) | (terms[1:] != terms[:-1])
    at = np.flatnonzero(new)
    return groups[at], terms[at], np.diff(np.concatenate((at, [len(terms)])))


def _query_terms(batches):
    for batch in batches:
        for found in words(batch.column(2), LETTERS_DIGITS):
            row, term, n = _counted(np.repeat(np.arange(len(found.counts)), found.counts), found.hashes)
            at = pa.array(row + found.first)
            yield pa.record_batch([batch.column(0).take(at), batch.column(1).take(at), pa.array(signed(term)), pa.array(n.astype(np.int64))], ["query", "item", "term", "times"])


def query_terms(queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row for every distinct term of a query: ``query`` (a number for each row), ``item`` (its id), ``term``, ``times``."""
    slim = queries.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    slim = slim.repartition(max(1, -(-slim.count() // NUMBERED)))
    numbered = durable(slim.select(F.monotonically_increasing_id().alias("query"), F.col("id").alias("item"), "text"))
    kind = dict(numbered.dtypes)["item"]
    return durable(numbered.mapInArrow(_query_terms, f"query long, item {kind}, term long, times long"))


def _statistics(wanted: BitSet):
    """Documents of each wanted term; documents with terms and their number of terms under a null term."""

    def run(batches):
        docs = tokens = 0
        for batch in batches:
            for found in words(batch.column(0), LETTERS_DIGITS):
                docs += int((found.counts > 0).sum())
                tokens += len(found.hashes)
                at = np.flatnonzero(wanted.has(found.hashes))
                row = np.repeat(np.arange(len(found.counts)), found.counts)
                term, n = np.unique(_counted(row[at], found.hashes[at])[1], return_counts=True)
                yield pa.record_batch([pa.array(signed(term)), pa.array(n), pa.array(np.zeros(len(n), np.int64))], ["term", "docs", "tokens"])
        yield pa.record_batch([pa.array([None], pa.int64()), pa.array([docs]), pa.array([tokens])], ["term", "docs", "tokens"])

    return run


def statistics(docs: DataFrame, terms: DataFrame, text_col: str, bits: int = 1 << 22) -> tuple[DataFrame, int, int]:
    """(term, docs) of the wanted terms, the number of documents with terms, and of all their terms."""
    wanted = BitSet.of(terms.select("term").distinct(), bits)
    found = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(_statistics(wanted), "term long, docs long, tokens long")
    found = durable(found.groupBy("term").agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")))
    n, total = sums(found.where("term IS NULL"), F.sum("docs"), F.sum("tokens"))
    return found.where("term IS NOT NULL").select("term", "docs"), n or 0, total or 0


def weight(n: Column, docs: Column) -> Column:
    return F.floor(1000 * F.ln((2 * n + 2) / (2 * docs + 1)))


@dataclass
class Queries:
    """A block of queries over numbered terms: those of query ``q`` are ``at[q]:at[q + 1]``."""

    numbers: np.ndarray  # of the queries
    items: pa.Array
    terms: np.ndarray  # ascending hashes
    at: np.ndarray
    term: np.ndarray
    worth: np.ndarray  # weight times occurrences in the query

    @classmethod
    def of(cls, rows: pa.Table) -> "Queries":
        rows = rows.sort_by([("query", "ascending"), ("term", "ascending")]).combine_chunks()
        numbers, first = np.unique(rows.column("query").to_numpy(), return_index=True)
        hashes = rows.column("term").to_numpy().view(np.uint64)
        terms, term = np.unique(hashes, return_inverse=True)
        return cls(numbers, rows.column("item").combine_chunks().take(pa.array(first)), terms, np.append(first, len(hashes)), term, rows.column("worth").to_numpy())


@dataclass
class Index:
    """Postings of a slice by term number: documents (ascending places) and impacts at ``at[t]:at[t + 1]``."""

    size: int
    at: np.ndarray
    doc: np.ndarray
    impact: np.ndarray

    @classmethod
    def of(cls, texts: pa.Array, terms: np.ndarray, n_docs: int, n_tokens: int) -> "Index":
        size, counts, places = len(texts), np.zeros(len(texts), np.int64), [np.zeros(0, np.int64)]
        for found in words(texts, LETTERS_DIGITS):
            counts[found.first : found.first + len(found.counts)] = found.counts
            number = np.minimum(np.searchsorted(terms, found.hashes), len(terms) - 1)
            asked = np.flatnonzero(terms[number] == found.hashes)
            row = np.repeat(np.arange(len(found.counts)) + found.first, found.counts)
            places.append(number[asked] * size + row[asked])
        place, tf = np.unique(np.concatenate(places), return_counts=True)  # by term, then document
        term, doc = place // size, place % size
        m = 75 + (25 * counts * n_docs) // n_tokens
        return cls(size, np.searchsorted(term, np.arange(len(terms) + 1)), doc, (1_000_000_000 * tf) // (1000 * tf + 12 * m[doc]))

    def bounds(self) -> dict[int, np.ndarray]:
        """Of each long list the largest impact in every block of documents."""
        out = {}
        for t in np.flatnonzero(np.diff(self.at) > SHORT):
            doc, impact = self.doc[self.at[t] : self.at[t + 1]], self.impact[self.at[t] : self.at[t + 1]]
            own = np.zeros(-(-self.size // SKIP), np.int64)
            block = doc // SKIP
            first = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
            own[block[first]] = np.maximum.reduceat(impact, first)
            out[int(t)] = own
        return out


def search(index: Index, bounds: dict[int, np.ndarray], terms: np.ndarray, worth: np.ndarray, least: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents (ascending places) and scores of the ``k`` best, all of at least ``least``; ties for the last place all come."""
    none = np.zeros(0, np.int64)
    sizes = index.at[terms + 1] - index.at[terms]
    short, long = np.flatnonzero((sizes > 0) & (sizes <= SHORT)), np.flatnonzero(sizes > SHORT)
    if not len(short) + len(long):
        return none, none
    blocks = -(-index.size // SKIP)
    # term at a time: short lists become one list of summed scores
    parts = [slice(index.at[t], index.at[t + 1]) for t in terms[short]]
    docs = np.concatenate([index.doc[p] for p in parts]) if parts else none
    gains = np.concatenate([worth[i] * index.impact[p] for i, p in zip(short, parts, strict=True)]) if parts else none
    summed = np.zeros(blocks * SKIP, np.int64)
    np.add.at(summed, docs, gains)
    by_block = summed.reshape(blocks, SKIP)
    bound = by_block.max(1)
    for i in long:
        bound = bound + worth[i] * bounds[int(terms[i])]

    def scored(chosen: np.ndarray) -> np.ndarray:
        """Whole scores of the documents of the chosen blocks: the summed list and all long lists, document by document."""
        own = by_block[chosen]
        place = np.full(blocks, -1)
        place[chosen] = np.arange(len(chosen))
        flat = own.reshape(-1)
        for i in long:
            p = slice(index.at[terms[i]], index.at[terms[i] + 1])
            doc = index.doc[p]
            block = place[doc // SKIP]
            inside = block >= 0
            flat[block[inside] * SKIP + doc[inside] % SKIP] += worth[i] * index.impact[p][inside]
        return flat

    order = np.argsort(-bound, kind="stable")
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for chosen in (order[:EAGER], order[EAGER:]):
        chosen = np.sort(chosen[bound[chosen] >= max(least, 1)])
        if not len(chosen):
            continue
        scores = scored(chosen)
        good = np.flatnonzero(scores >= max(least, 1))
        found.append((chosen[good // SKIP] * SKIP + good % SKIP, scores[good]))
        every = np.concatenate([s for _, s in found])
        if len(every) >= k:
            least = max(least, int(np.partition(every, len(every) - k)[len(every) - k]))
    if not found:
        return none, none
    doc, score = (np.concatenate(p) for p in zip(*found, strict=True))
    keep = np.flatnonzero(score >= least)
    keep = keep[np.argsort(doc[keep])]
    return doc[keep], score[keep]


def _slices(batches) -> Iterator[pa.RecordBatch]:
    """Small batches put together: a slice's fixed work is per query."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= HELD or sum(b.nbytes for b in held) >= 32 << 20:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _ids_first(ids: pa.Array) -> np.ndarray:
    """Place of every document in the order of ids, nulls last."""
    rank = np.empty(len(ids), np.int64)
    rank[pc.sort_indices(ids, null_placement="at_end").to_numpy()] = np.arange(len(ids))
    return rank


def _search(queries: Queries, n_docs: int, n_tokens: int, k: int):
    def run(batches):
        best = [np.zeros(0, np.int64) for _ in queries.numbers]  # k best scores of each query so far
        for batch in _slices(batches):
            index = Index.of(batch.column(1), queries.terms, n_docs, n_tokens)
            bounds, rank = index.bounds(), _ids_first(batch.column(0))
            parts = [(np.zeros(0, np.int64),) * 3]
            for q in range(len(best)):
                own = slice(queries.at[q], queries.at[q + 1])
                least = int(best[q].min()) if len(best[q]) == k else 1
                doc, score = search(index, bounds, queries.term[own], queries.worth[own], least, k)
                first = np.lexsort((rank[doc], -score))[:k]
                parts.append((np.full(len(first), q), doc[first], score[first]))
                both = np.concatenate((best[q], score[first]))
                best[q] = np.sort(both)[::-1][:k]
            q, doc, score = (np.concatenate(p) for p in zip(*parts, strict=True))
            yield pa.record_batch([pa.array(queries.numbers[q]), queries.items.take(pa.array(q)), batch.column(0).take(pa.array(doc)), pa.array(score)], ["query", "item", "id", "score"])

    return run


def _blocks(terms: DataFrame, limit: int) -> DataFrame:
    """``terms`` with a ``block`` of whole queries: ``limit`` terms at most, or one query."""
    sizes = terms.groupBy("query").agg(F.count("*").alias("n"))
    before = Window.partitionBy("part").orderBy("query").rowsBetween(Window.unboundedPreceding, -1)
    # queries are numbered by partition; sums run inside some thousand queries, and a block never crosses them
    sizes = sizes.withColumn("part", F.floor(F.col("query") / NUMBERED)).withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    large = F.col("n") > limit // 2
    block = F.struct("part", F.when(large, F.col("query")).alias("alone"), F.when(~large, F.floor(F.col("start") / (limit // 2))).alias("turn"))
    return terms.join(sizes.select("query", F.xxhash64(block).alias("block")), "query")


def rank(
    docs: DataFrame, queries: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", query_id: str = "item_id", query_text: str = "text", k: int = TOP, block_terms: int = BLOCK_TERMS,
) -> DataFrame:
    """The ``k`` best documents of every query: query id, ``rank`` (from 1), document id, ``score``; ties by id."""
    terms = query_terms(queries, query_id, query_text)
    found, n, total = statistics(docs, terms, doc_text)
    worth = (weight(F.lit(n), F.col("docs")) * F.col("times")).cast("long")
    weighted = terms.join(found, "term").select("query", "item", "term", worth.alias("worth")).where("worth > 0")
    weighted = durable(_blocks(weighted, block_terms))
    slim = docs.select(F.col(doc_id).alias("id"), F.col(doc_text).cast("string").alias("text"))
    kinds = dict(terms.dtypes), dict(slim.dtypes)
    schema = f"query long, item {kinds[0]['item']}, id {kinds[1]['id']}, score long"
    hits = docs.sparkSession.createDataFrame([], schema)
    for row in weighted.select("block").distinct().orderBy("block").collect():  # a number for each block
        block = Queries.of(weighted.where(F.col("block") == row.block).drop("block").toArrow())
        hits = hits.union(slim.mapInArrow(_search(block, n, total, k), schema))
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    ranked = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select(F.col("item").alias(query_id), F.col("rank").cast("int").alias("rank"), F.col("id").alias(doc_id), "score")


ORACLE = r"""
WITH doc_words AS (
  SELECT r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM (SELECT row_number() OVER () AS r, * FROM documents)),
item_words AS (
  SELECT r, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
  FROM (SELECT row_number() OVER () AS r, * FROM benchmark)),
totals AS (
  SELECT count(*) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM doc_words WHERE len(w) > 0),
postings AS (
  SELECT r, doc_id, n, t, count(*) AS tf FROM (SELECT r, doc_id, len(w) AS n, unnest(w) AS t FROM doc_words) GROUP BY ALL),
asked AS (
  SELECT r, item_id, t, count(*) AS times FROM item_words GROUP BY ALL),
weights AS (
  SELECT t, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT) AS w
  FROM (SELECT t, count(*) AS df FROM postings GROUP BY t), totals),
scored AS (
  SELECT a.r, item_id, p.r AS d, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM asked a JOIN weights USING (t) JOIN postings p USING (t), totals GROUP BY a.r, item_id, p.r, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 20
"""
