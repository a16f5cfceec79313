"""N-gram Jaccard self-join by prefix trees.

A document's set holds its distinct word n-grams.  Documents with equal sets are
one class.  N-grams are put in one global order: rare ones first, then by hash.
Two sets that are similar enough share an n-gram among the first few of both
(prefix filter), at places that leave enough n-grams behind (position filter).

Candidates are tested in tries: the sets to be compared with one set are stored
as a trie, common n-grams first; one walk carries the overlap found so far down
the shared paths and leaves a subtree as soon as the n-grams left on either side
cannot reach the required overlap.

Only components are asked for, so links inside a component need not all be
found.  Classes that share an n-gram with few others are paired at once; the
others are tested against one pivot, the class that shares most, and inside
chunks of fixed size.  What then still lies in different components is compared
in blocks, unless n-gram histograms exclude a link.  No candidate is capped, so
no link between components is lost.

How common an n-gram is only steers the order, never the result: bit sets mark
those above some counts, counted over all documents.

Bit sets follow the number of their keys up to a bound: full ones would let all
n-grams and all full sets through to the shuffles.

Defined results: a text without words (or null) has an empty set and is its own
component; repeated rows give one row each; components are named by their
smallest non-null id; an empty table gives no rows; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesieve.llm.common import BitSet, durable, release, small_batches, sums
from pagesieve.llm.components import components
from pagesieve.llm.tokens import NOT_BLANK, byte_slices, mix, signed, words

TOKEN_BITS = 60
TOKEN_MASK = np.uint64((1 << TOKEN_BITS) - 1)
LEVELS = (4, 64, 1024)
HISTOGRAM = 256  # buckets; counts are capped at FULL, which then bounds nothing
FULL = 65535
#: An n-gram of so few classes pairs them all at once; others first go through a pivot.
FEW = 8
BLOCK_TOKENS = 1 << 20
BLOCK_MEMBERS = 64
CHUNK = 512
_WALK = 64
#: Bits a key: of what only thins out, and of the sets that define the order.
THIN, ORDER = 8, 16
#: Most bits of a bit set (16 MB).
MOST_BITS = 1 << 27
#: Bytes of full sets that one step deals for comparison, or all sets once if they take more.
STEP_BYTES = 1 << 30


def needed(n, m, percent: int):
    """Least overlap of similar sets of sizes n and m: percent * union <= 100 * overlap."""
    return (percent * (n + m) + 99 + percent) // (100 + percent)


def prefix_size(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1


def _leveled(tokens: np.ndarray, levels: list[BitSet]) -> np.ndarray:
    """Keys of tokens; whatever a later bit set marks, an earlier one marks too."""
    keys, marked = tokens.copy(), np.arange(len(tokens))
    for level in levels:
        marked = marked[level.has(tokens[marked])]
        keys[marked] += np.uint64(1 << TOKEN_BITS)
    return keys


@dataclass
class Sets:
    """Ordered distinct keys of some rows that have words; those of ``rows[i]`` are ``keys[offsets[i]:offsets[i + 1]]``."""

    rows: np.ndarray
    keys: np.ndarray
    offsets: np.ndarray

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.offsets)

    @property
    def tokens(self) -> np.ndarray:
        return self.keys & TOKEN_MASK

    def places(self) -> np.ndarray:
        return np.arange(len(self.keys)) - np.repeat(self.offsets[:-1], self.sizes)

    def heads(self, sizes: np.ndarray) -> np.ndarray:
        """Mask of the first so many keys of each row."""
        return self.places() < np.repeat(sizes, self.sizes)

    def digests(self) -> tuple[np.ndarray, np.ndarray]:
        """128 bits of each set, whatever the levels of its n-grams."""
        with np.errstate(over="ignore"):
            total = np.add.reduceat(mix(self.tokens + np.uint64(1)), self.offsets[:-1])
            return total, np.bitwise_xor.reduceat(mix(~self.tokens), self.offsets[:-1]) + self.sizes.astype(np.uint64)


def _sets(column: pa.Array, width: int, levels: list[BitSet]) -> Iterator[Sets]:
    """The sets of all rows with words, some rows at a time; a key is level and token."""
    for found in words(column, NOT_BLANK):
        counts = found.counts
        rows = np.flatnonzero(counts)
        if not len(rows):
            continue
        grams, whole = found.grams(width)
        sizes = np.maximum(counts[rows] - width + 1, 1)
        short = np.flatnonzero(counts[rows] < width)
        firsts = found.offsets[rows]
        whole[firsts[short]] = True  # a short row is one n-gram
        grams[firsts[short]] = [found.whole(int(r)) for r in rows[short]]
        keys = _leveled(grams[whole] >> np.uint64(64 - TOKEN_BITS), levels)
        ends = np.cumsum(sizes)
        for start, end in zip((ends - sizes).tolist(), ends.tolist(), strict=True):
            keys[start:end].sort()
        fresh = np.ones(len(keys), bool)
        fresh[1:] = keys[1:] != keys[:-1]
        fresh[ends - sizes] = True
        offsets = np.concatenate(([0], np.cumsum(fresh)))[np.concatenate(([0], ends))]
        yield Sets(rows + found.first, keys[fresh], offsets)


def _marks(row_hash: np.ndarray, digest: np.ndarray) -> np.ndarray:
    return mix(row_hash.view(np.uint64) ^ digest)


def _binary(values: list[np.ndarray]) -> pa.Array:
    """Rows of equal-size little-endian values as binary."""
    flat = np.ascontiguousarray(np.stack(values, 1) if isinstance(values, list) else values)
    size = flat.itemsize * (flat.shape[1] if flat.ndim > 1 else 1)
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(size), len(flat), [None, pa.py_buffer(flat)]).cast(pa.binary())


def _flat(parts: list[np.ndarray]):
    return pa.record_batch([pa.array(signed(np.concatenate(parts) if parts else np.zeros(0, np.uint64)))], ["token"])


def _region(n, percent: int):
    """How many n-grams, by hash, the first count looks at: half more than a prefix."""
    return np.minimum(n, prefix_size(n, percent) * 3 // 2)


def _region_tokens(width: int, percent: int):
    def run(batches):
        for batch in batches:
            for sets in _sets(batch.column(0), width, []):
                yield _flat([sets.keys[sets.heads(_region(sets.sizes, percent))]])

    return run


def _late_tokens(width: int, percent: int, levels: list[BitSet]):
    """N-grams of the prefixes that the first count has not looked at in their document."""

    def run(batches):
        for batch in batches:
            late = []
            for sets in _sets(batch.column(0), width, levels):
                # without common n-grams the order is the one of the first count
                for i in np.flatnonzero(sets.keys[sets.offsets[1:] - 1] >> np.uint64(TOKEN_BITS)):
                    tokens = sets.keys[sets.offsets[i] : sets.offsets[i + 1]] & TOKEN_MASK
                    prefix, at = tokens[: prefix_size(len(tokens), percent)], _region(len(tokens), percent) - 1
                    late.append(prefix[prefix > np.partition(tokens, at)[at]])
            yield _flat(late)

    return run


def _class_rows(width: int, percent: int, levels: list[BitSet], shared: list[BitSet]):
    """One row a document: set size, digest, mark, and of the n-grams of the prefix those that others may share."""
    def run(batches):
        for batch in byte_slices(batches, 2):
            n = np.zeros(batch.num_rows, np.int32)
            hashes = batch.column(1).to_numpy(zero_copy_only=False)
            rows, digests, marks, keys, places, of, shapes = ([] for _ in range(7))
            for sets in _sets(batch.column(2), width, levels):
                n[sets.rows] = sets.sizes
                rows.append(sets.rows)
                digests.append(np.stack(sets.digests(), 1))
                marks.append(_marks(hashes[sets.rows], digests[-1][:, 0]))
                at = np.flatnonzero(sets.heads(prefix_size(sets.sizes, percent)))
                tokens = sets.keys[at] & TOKEN_MASK
                at = at[np.logical_or.reduce([s.has(tokens) for s in shared])]
                row = np.searchsorted(sets.offsets, at, "right") - 1
                keys.append(sets.keys[at])
                places.append(at - sets.offsets[row])
                of.append(sets.rows[row])
                shape = np.bincount(np.repeat(np.arange(len(sets.rows)), sets.sizes) * HISTOGRAM + (sets.keys & np.uint64(HISTOGRAM - 1)).astype(np.int64), minlength=len(sets.rows) * HISTOGRAM)
                shapes.append(np.minimum(shape, FULL).astype("<u2").reshape(-1, HISTOGRAM))
            join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
            place = np.full(batch.num_rows, -1)
            place[join(rows, np.int64)] = np.arange(len(join(rows, np.int64)))
            index = pa.array(np.maximum(place, 0), mask=place < 0)
            of = join(of, np.int64)
            alone = np.bincount(of, minlength=batch.num_rows) == 0
            shape_index = pa.array(np.maximum(place, 0), mask=(place < 0) | alone)
            # two plain lists: written as they are, a list of pairs takes more than three times as much
            offsets = pa.array(np.searchsorted(of, np.arange(batch.num_rows + 1)).astype(np.int32))
            keys = pa.ListArray.from_arrays(offsets, pa.array(signed(join(keys, np.uint64))))
            places = pa.ListArray.from_arrays(offsets, pa.array(join(places, np.int64).astype(np.int32)))
            if not rows:
                digests, shapes = [np.zeros((0, 2), np.uint64)], [np.zeros((0, HISTOGRAM), "<u2")]
            yield pa.record_batch([
                batch.column(0), batch.column(1), pa.array(n), _binary(np.concatenate(digests)).take(index), pa.array(signed(join(marks, np.uint64))).take(index), keys, places, _binary(np.concatenate(shapes)).take(shape_index),
            ], ["id", "row_hash", "n", "digest", "mark", "keys", "places", "shape"])

    return run


def _full_sets(width: int, levels: list[BitSet], wanted: BitSet, repeated: BitSet):
    """Sets of the rows whose mark is wanted, and whether other rows may have the mark."""

    def run(batches):
        for batch in batches:
            hashes = batch.column(0).to_numpy(zero_copy_only=False)
            for sets in _sets(batch.column(1), width, levels):
                digests = np.stack(sets.digests(), 1)
                marks = _marks(hashes[sets.rows], digests[:, 0])
                at = np.flatnonzero(wanted.has(marks))
                lists = pa.LargeListArray.from_arrays(pa.array(sets.offsets.astype(np.int64)), pa.array(signed(sets.keys))).take(pa.array(at)).cast(pa.list_(pa.int64()))
                yield pa.record_batch([_binary(digests[at]), pa.array(repeated.has(marks[at])), lists], ["digest", "again", "keys"])

    return run


def walk(probe: np.ndarray, members: list[np.ndarray], percent: int) -> list[int]:
    """Indexes of the members similar to the probe; all arrays ascending, walked from their last key."""
    if not members:
        return []
    paths = [m[::-1] for m in members]
    order = sorted(range(len(paths)), key=lambda i: paths[i].astype(">u8").tobytes())
    longest = max(map(len, paths))
    least = needed(min(map(len, paths)), len(probe), percent)
    overlap = np.zeros(longest + 1, np.int64)  # along the current path
    out, before, cut = [], np.zeros(0, np.uint64), None
    for i in order:
        path = paths[i]
        both = min(len(path), len(before))
        other = np.flatnonzero(path[:both] != before[:both])
        depth = int(other[0]) if len(other) else both
        if cut is not None and depth >= cut:
            continue  # inside a subtree that was left
        before, cut = path, None
        while depth < len(path):
            part = path[depth : depth + _WALK]
            at = np.searchsorted(probe, part)
            hit = probe[np.minimum(at, len(probe) - 1)] == part
            overlap[depth + 1 : depth + 1 + len(part)] = overlap[depth] + np.cumsum(hit)
            depth += len(part)
            if overlap[depth] + min(longest - depth, int(at[-1])) < least:
                cut = depth
                break
        if cut is None and overlap[len(path)] >= needed(len(path), len(probe), percent):
            out.append(i)
    return out


def _trie_test(percent: int):
    """A block: one probe (the row without a partner) and the sets to be compared with it."""

    def run(block: pa.Table) -> pa.Table:
        cls, probe = block.column("cls").to_pylist(), block.column("probe").to_pylist()
        keys = block.column("keys").combine_chunks()
        get = lambda i: keys[i].values.to_numpy(zero_copy_only=False).view(np.uint64)
        root = probe.index(True)
        members = [i for i, p in enumerate(probe) if not p]
        found = walk(get(root), [get(i) for i in members], percent)
        return pa.table({"a": pa.array([cls[members[i]] for i in found], pa.int64()), "b": pa.array([cls[root]] * len(found), pa.int64())})

    return run


def _seek(percent: int):
    """A block of sets: links that join components, between the rows that seek and all rows.

    Rows of one component are one label from the start; a link merges two
    labels, and pairs of one label are left alone.  Histograms thin out what a
    trie is built of.
    """

    def run(block: pa.Table) -> pa.Table:
        cls, n = block.column("cls").to_pylist(), block.column("n").to_numpy().astype(np.int64)
        lists = block.column("keys").combine_chunks()
        keys = [lists[i].values.to_numpy(zero_copy_only=False).view(np.uint64) for i in range(len(cls))]
        shapes = np.stack([np.minimum(np.bincount((k & np.uint64(HISTOGRAM - 1)).astype(np.int64), minlength=HISTOGRAM), FULL).astype(np.uint16) for k in keys])
        full = (shapes == FULL).any(1)
        label = np.unique(block.column("root").to_numpy(), return_inverse=True)[1]
        a, b = [], []
        for i in np.flatnonzero(block.column("seeks").to_numpy(zero_copy_only=False)):
            others = np.flatnonzero(label != label[i])
            need = needed(n[i], n[others], percent)
            fits = np.minimum(n[i], n[others]) >= need
            others, need = others[fits], need[fits]
            bound = np.minimum(shapes[i], shapes[others]).sum(1, dtype=np.int64)
            others = others[(bound >= need) | (full[i] & full[others])]
            for j in others[walk(keys[i], [keys[o] for o in others], percent)]:
                if label[j] != label[i]:
                    a.append(cls[i])
                    b.append(cls[j])
                    label[label == label[j]] = label[i]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _by_chunks(index: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links inside chunks of the classes that share a common n-gram.

    Each class takes part once, under its commonest n-gram, in a chunk drawn by
    hash; the work grows with the classes, not with the squares of groups.
    """
    rows = index.groupBy("cls").agg(F.max(F.struct("among", "key", "n", "root")).alias("p")).select("cls", "p.*")
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("cls"), F.ceil(F.col("among") / CHUNK)))
    rows = rows.join(sets, "cls").withColumn("seeks", F.lit(True))
    return rows.groupBy("key", "chunk").applyInArrow(_seek(percent), "a long, b long")


def _by_blocks(index: DataFrame, shapes: DataFrame, percent: int) -> DataFrame:
    """All pairs between components that may still link: of each n-gram, every class outside its largest component against all its classes."""
    largest = index.groupBy("key", "root").agg(F.count("*").alias("m")).groupBy("key").agg(F.max(F.struct("m", "root")).alias("p"), F.sum("m").alias("all"))
    largest = durable(largest.select("key", F.col("p.root").alias("main"), F.ceil((F.col("all") - F.col("p.m")) / CHUNK).alias("blocks"), F.ceil(F.col("all") / CHUNK).alias("chunks")))
    rows, left = index.join(largest, "key"), (F.col("n") - F.col("pos")).alias("left")
    own = rows.where(F.col("root") != F.col("main")).select(
        "key", "cls", "n", "root", left, F.pmod(F.xxhash64("cls"), F.col("blocks")).alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"), F.lit(True).alias("seeks")
    )
    every = rows.select(
        "key", "cls", "n", "root", left, F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64("cls"), F.col("chunks")).alias("chunk"), F.lit(False).alias("seeks")
    )
    return own.union(every).join(shapes, "cls").groupBy("key", "block", "chunk").applyInArrow(_candidates(percent), "a long, b long").distinct()


def _candidates(percent: int):
    """A block of histograms: pairs of a row that seeks and a row of another component whose bound allows a link."""

    def run(block: pa.Table) -> pa.Table:
        read = lambda name: block.column(name).to_numpy().astype(np.int64)
        cls, n, root, left = map(read, ("cls", "n", "root", "left"))
        shapes = np.frombuffer(b"".join(block.column("shape").to_pylist()), "<u2").reshape(-1, HISTOGRAM)
        full = (shapes == FULL).any(1)
        a, b = [cls[:0]], [cls[:0]]
        for i in np.flatnonzero(block.column("seeks").to_numpy(zero_copy_only=False)):
            others = np.flatnonzero(root != root[i])
            need = needed(n[i], n[others], percent)
            fits = np.minimum(left[i], left[others]) >= need
            others, need = others[fits], need[fits]
            bound = np.minimum(shapes[i], shapes[others]).sum(1, dtype=np.int64)
            others = others[(bound >= need) | (full[i] & full[others])]
            a.append(np.minimum(cls[i], cls[others]))
            b.append(np.maximum(cls[i], cls[others]))
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})

    return run


def _possible(percent: int):
    """Pairs whose histograms leave room for the required overlap: it is the sum of the minima at most."""

    def run(batches):
        for batch in batches:
            of = lambda name: np.frombuffer(b"".join(batch.column(name).to_pylist()), "<u2").reshape(-1, HISTOGRAM).astype(np.int64)
            least = np.minimum(of("x"), of("y"))
            bound = np.where((least == FULL).any(1), np.iinfo(np.int64).max, least.sum(1))
            sizes = [batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("an", "bn")]
            yield pa.record_batch([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(bound >= needed(*sizes, percent)))

    return run


def _orders(texts: DataFrame, width: int, percent: int, bits: int) -> tuple[list[BitSet], list[BitSet]]:
    """Bit sets that define the order, and bit sets that mark every n-gram two prefixes share.

    All documents are counted, each by a region of its n-grams that is wider
    than its prefix, so that the prefix stays inside when common n-grams move
    back; what still enters from outside is marked by one more pass.  A
    threshold is doubled until the n-grams above it fit the largest bit set (one in
    sixteen bits): a histogram by powers of two is all the driver sees.
    """
    counted = texts.select("text").mapInArrow(_region_tokens(width, percent), "token long").groupBy("token").agg(F.count("*").alias("n"))
    counted = durable(counted.where("n > 1"))
    sizes = {r[0]: r[1] for r in counted.groupBy(F.floor(F.log2("n")).alias("k")).agg(F.count("*")).collect()}  # 64 rows at most
    release(texts.sparkSession)
    above = lambda least: sum(v for k, v in sizes.items() if 2**k >= least)
    levels = []
    for least in LEVELS:
        while above(least) * ORDER > max(bits, MOST_BITS):
            least *= 2
        levels.append(BitSet.of(counted.where(F.col("n") > least).select("token"), BitSet.room(above(least), ORDER, bits, MOST_BITS)))
    late = durable(texts.select("text").mapInArrow(_late_tokens(width, percent, levels), "token long").distinct())
    return levels, [BitSet.of(counted.select("token"), BitSet.room(above(1), THIN, bits * 2, MOST_BITS)), _thin(late, bits)]


def _thin(keys: DataFrame, least: int) -> BitSet:
    """Bit set of a written column of keys, by their number."""
    return BitSet.of(keys, BitSet.room(keys.count(), THIN, least, MOST_BITS))


def _test(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links among the pairs (a, b): tries of the a's of each b, in blocks that fit in memory.

    The sets that all blocks take can be many times the sets there are, so the
    blocks are dealt and tested some at a time, and what was dealt is freed.
    """
    size = sets.select(F.col("cls").alias("a"), F.size("keys").alias("n"))
    blocks = F.greatest(F.ceil(F.sum("n") / BLOCK_TOKENS), F.ceil(F.count("*") / BLOCK_MEMBERS))
    salts = durable(pairs.join(size, "a").groupBy("b").agg(blocks.cast("int").alias("salts"), F.sum("n").alias("dealt")))
    salted = pairs.join(salts.drop("dealt"), "b").withColumn("salt", F.pmod(F.hash("a"), F.col("salts")))
    (dealt,), (there,) = sums(salts, F.sum("dealt")), sums(size, F.sum("n"))
    steps = -(-(dealt or 0) * 8 // max(STEP_BYTES, (there or 0) * 8)) or 1
    return _in_steps(salted, F.xxhash64("b", "salt"), steps, lambda some: _test_some(some, sets, percent))


def _test_some(salted: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    members = salted.join(sets.select(F.col("cls").alias("a"), "keys"), "a").select("b", "salt", F.col("a").alias("cls"), "keys", F.lit(False).alias("probe"))
    probes = salted.select("b", "salt").distinct().join(sets.select(F.col("cls").alias("b"), "keys"), "b").select("b", "salt", F.col("b").alias("cls"), "keys", F.lit(True).alias("probe"))
    return members.union(probes).groupBy("b", "salt").applyInArrow(_trie_test(percent), "a long, b long")


def _in_steps(rows: DataFrame, drawn, steps: int, links) -> DataFrame:
    """The links of all rows, which go through ``links`` in so many steps, drawn by a hash; each is written and what it shuffled freed."""
    out = None
    for step in range(steps):
        found = durable(links(rows.where(F.pmod(drawn, F.lit(steps)) == step) if steps > 1 else rows))
        release(rows.sparkSession)
        out = found if out is None else out.union(found)
    return out


def _fits(n, m, left, percent: int):
    """Column: a set of size n with ``left`` n-grams from the shared one on may link with a set of size m."""
    return left * (100 + percent) >= percent * (n + m)


def _pivot_pairs(index: DataFrame, percent: int) -> DataFrame:
    """For every class, the pivot with which it shares most; the pivot of an n-gram is the class with most shared n-grams."""
    best = F.max(F.struct("shared", F.col("cls").alias("pivot"), F.col("n").alias("pivot_n"), F.col("root").alias("pivot_root"))).alias("p")
    pivots = durable(index.groupBy("key").agg(best).select("key", "p.pivot", "p.pivot_n", "p.pivot_root"))
    n, m = F.col("n"), F.col("pivot_n")
    pairs = index.join(pivots, "key").where(F.col("root") != F.col("pivot_root")).where((100 * F.least(n, m) >= percent * F.greatest(n, m)))
    pairs = pairs.groupBy("cls", "pivot").agg(F.count("*").alias("k")).groupBy("cls").agg(F.max(F.struct("k", "pivot")).alias("p"))
    return pairs.select(F.col("cls").alias("a"), F.col("p.pivot").alias("b"))


def _open_keys(index: DataFrame, percent: int, bits: int | None = None) -> DataFrame:
    """The index without classes that can link with none of their n-gram's, and without n-grams of one component.

    What is joined back by a possibly hot key is written first: then both sides
    of the join are shuffled plainly and adaptive execution may split the key.
    With ``bits`` a bit set of the n-grams that are left thins out the index
    before it is shuffled again; the join decides.
    """
    stats = index.groupBy("key").agg(F.min("n").alias("least"), F.max(F.col("n") - F.col("pos")).alias("most_left"), F.min("root").alias("r0"), F.max("root").alias("r1"), F.count("*").alias("among"))
    stats = durable(stats.where("r0 <> r1"))
    release(index.sparkSession)
    if bits:
        index = index.mapInArrow(_marked(_thin(stats.select("key"), bits), index.columns.index("key")), index.schema)
    n, left = F.col("n"), F.col("n") - F.col("pos")
    m = F.greatest(F.col("least"), F.ceil(n * percent / 100))
    return index.drop("among").join(stats, "key").where(_fits(n, m, F.least(left, F.col("most_left")), percent)).drop("least", "most_left", "r0", "r1")


def _marked(marked: BitSet, at: int):
    """Rows whose key in column ``at`` may be in the bit set; as a filter on a Python column, Spark would queue them on disk."""

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(marked.has(batch.column(at).to_numpy(zero_copy_only=False).view(np.uint64))))

    return run


def _cross_pairs(index: DataFrame, percent: int) -> DataFrame:
    """Pairs of classes that share an n-gram of their prefixes, lie in different components and pass the length and position bounds."""
    x = index.select("key", F.col("cls").alias("a"), F.col("n").alias("an"), (F.col("n") - F.col("pos")).alias("al"), F.col("root").alias("ar"))
    y = index.select("key", F.col("cls").alias("b"), F.col("n").alias("bn"), (F.col("n") - F.col("pos")).alias("bl"), F.col("root").alias("br"))
    pairs = x.join(y, "key").where((F.col("a") < F.col("b")) & (F.col("ar") != F.col("br")) & _fits(F.col("an"), F.col("bn"), F.least("al", "bl"), percent))
    return pairs.select("a", "b").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, percent: int = 85, bits: int = 1 << 22) -> DataFrame:
    """Per row: id, ``n_shingles``, ``component_id``, ``class_size`` (rows with the same set; 1 for empty sets).

    ``keeper`` marks the document a component is named after (all its copies, if
    the row is repeated); ``row_hash`` is ``xxhash64(id, text)``, to find the row again.

    ``bits`` is the least size of a bit set (half a megabyte by default, the largest twice that); it grows with its
    keys up to ``MOST_BITS``, beyond which more candidates get through to the joins, which decide.
    """
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(id_col), F.col(text_col).cast("string")).alias("row_hash"), F.col(text_col).cast("string").alias("text"))
    levels, shared = _orders(texts, width, percent, bits)
    schema = f"id {dict(texts.dtypes)['id']}, row_hash long, n int, digest binary, mark long, keys array<long>, places array<int>, shape binary"
    release(docs.sparkSession)
    rows = durable(texts.mapInArrow(_class_rows(width, percent, levels, shared), schema))
    classes = rows.where("digest IS NOT NULL").groupBy("digest").agg(
        F.min("id").alias("id"), F.count("*").alias("class_size"), F.min("mark").alias("mark"),
        F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("places").alias("places"), F.first("shape").alias("shape"),
    )
    classes = durable(classes.withColumn("cls", F.monotonically_increasing_id()))  # written, so the numbers stay
    # rows equal in id and text have one mark: those (and a few false hits of the bit set) need a pass to keep one
    again = _thin(durable(rows.where("mark IS NOT NULL").groupBy("mark").agg(F.count("*").alias("n")).where("n > 1").select("mark")), bits)
    rows = durable(rows.select("id", "row_hash", "n", "digest"))  # prefixes and histograms are with the classes
    release(docs.sparkSession)

    index = classes.select("cls", "n", F.size("keys").alias("shared"), F.inline(F.arrays_zip("keys", "places")).alias("key", "pos"), F.col("cls").alias("root"))
    index = durable(_open_keys(index, percent, bits * 2))
    classes = durable(classes.drop("keys", "places"))
    release(docs.sparkSession)
    few, many = index.where(F.col("among") <= FEW), index.where(F.col("among") > FEW)
    shape = lambda side: classes.select(F.col("cls").alias(side), F.col("n").alias(f"{side}n"), F.col("shape").alias({"a": "x", "b": "y"}[side]))
    pairs = _cross_pairs(few, percent).union(_pivot_pairs(many, percent)).distinct().join(shape("a"), "a").join(shape("b"), "b")
    pairs = durable(pairs.mapInArrow(_possible(percent), "a long, b long"))
    release(docs.sparkSession)
    # full sets are read again, for those classes alone that may have links
    involved = pairs.select(F.explode(F.array("a", "b")).alias("cls")).union(many.select("cls")).distinct()
    involved = durable(involved.join(classes.select("cls", "mark", "digest"), "cls"))
    wanted = _thin(involved.select("mark"), bits)
    sets = texts.select("row_hash", "text").mapInArrow(_full_sets(width, levels, wanted, again), "digest binary, again boolean, keys array<long>")
    sets = durable(sets.join(involved.select("digest", "cls"), "digest").drop("digest"))
    # once, not in every use: then the uses that deal the sets by class share one shuffle
    once = durable(sets.where("again").dropDuplicates(["cls"]).drop("again"))
    sets = sets.where("NOT again").drop("again").union(once)
    release(docs.sparkSession)

    links = _test(pairs, sets, percent).union(durable(_by_chunks(many, sets, percent)))
    release(docs.sparkSession)
    left = durable(_open_keys(_rooted(many, components(links)), percent))
    pairs = durable(_by_blocks(left, classes.select("cls", "shape"), percent))
    release(docs.sparkSession)
    links = links.union(_test(pairs, sets, percent))
    roots = components(links)

    rooted = _rooted(classes.select("digest", "cls", "id", "class_size"), roots)
    first = F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "digest")).alias("first")
    names = durable(rooted.groupBy("root").agg(first).select("root", F.col("first.id").alias("component"), F.col("first.digest").alias("first_digest")))
    named = rooted.join(names, "root").select("digest", "class_size", "component", "first_digest")
    out = rows.select("id", "row_hash", "n", "digest").join(named, "digest", "left")
    alone = F.col("digest").isNull()
    keeper = alone | (F.col("id").eqNullSafe(F.col("component")) & (F.col("digest") == F.col("first_digest")))
    return out.select(
        F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.when(alone, F.col("id")).otherwise(F.col("component")).alias("component_id"),
        F.coalesce("class_size", F.lit(1)).alias("class_size"), keeper.alias("keeper"), "row_hash",
    )


def _rooted(df: DataFrame, roots: DataFrame) -> DataFrame:
    found = roots.select(F.col("node").alias("cls"), F.col("root").alias("found"))
    return df.drop("root").join(found, "cls", "left").withColumn("root", F.coalesce("found", "cls")).drop("found")
