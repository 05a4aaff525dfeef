"""Jaccard join of word n-gram sets: a size-aware heavy-light join.

Two sets link when 100 x intersection >= percent x union, so each holds at least
``percent`` hundredths of the other's size, and the smallest elements of either, in
one order of all elements, must meet: those of the first n - ceil(percent n / 100) + l
places share l elements. Light sets enumerate the subsets of two elements of these
places (l = 2); a shared subset is a far rarer event than a shared element, but their
number grows with the square of the places. Heavy sets therefore put their single
elements (l = 1) into inverted lists, which are scanned; light sets near the boundary
do so too, for pairs of a light and a heavy set. The boundary is the size at which
the summed cost of both ways over a sample of the sizes is least.

Elements found often in a sample come last in the order, so that lists stay short;
the order is the same for all sets, so the result does not depend on the sample.

Heavy sets show somewhat more elements than those places, all of the pool: the rare
elements whose hashes are least. An element of the pool that one set alone has is in
no partner, and takes one of the n - ceil(percent n / 100) places that a partner may
lack. A set so enters only the first of its other lists, as many as places are left:
unrelated sets, which share a few rare elements by chance, enter none.

Only components are asked for, so no group is expanded into its pairs. Equal sets
are one class. In each list every set is first held against its most popular one;
the links found contract the classes. Then only lists that still hold two components
are scanned for pairs across components, in blocks of bounded size, where a parity
bitmap of each set bounds the difference of two sets from below and drops pairs that
cannot link. What remains is verified on the whole sets.

Elements are 64-bit hashes of the words. Defined cases: a text without words has an
empty set, size 0, and is a component of its own; with fewer words than n the whole
sequence is one element; rows with equal ids and different texts keep their own
sets, and a component is named by its smallest id; a null id takes part and is
smaller than none; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.components import components
from tessera.llm.words import Words, mix, slices, spaced_words, windows, words_of
from tessera.runtime import bounded_batches, discard, keep, require, require_columns

SHINGLE = 3
PERCENT = 90
# Sampled texts for the order and the boundary, and elements known as common; bounds of what is broadcast.
SAMPLE_TEXTS = 4_000
COMMON = 50_000
# Elements of the sets that share a home in one tile.
TILE = 100_000
# The pool, in times of the elements that a set's partner may lack.
POOL = 1.5
# Sets of one list that a task holds against each other at once.
BLOCK = 1_024
# Comparisons in memory that cost as much as a row that is written and shuffled.
LOOKS = 50.0
# Bits of a sieve for each row it holds, and at most in all.
SIEVE_BITS, MOST_SIEVE_BITS = 32, 1 << 26
_BITS = 1_024
_LONGS = _BITS // 64

_ALPHABET = spaced_words()
_SINGLE, _DOUBLE = np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25)


def needed(n: np.ndarray, percent: int) -> np.ndarray:
    """Elements of a set of n that any partner must hold."""
    return -(-n * percent // 100)


def sets_of(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct elements of all texts, text by text, and where each text begins."""
    count = words.counts
    made = windows(words.hashes, n)
    text = np.repeat(np.arange(len(count)), np.maximum(count - n + 1, 0))
    at = np.arange(len(text)) - np.repeat(np.concatenate([[0], np.cumsum(np.maximum(count - n + 1, 0))[:-1]]), np.maximum(count - n + 1, 0))
    values = made[words.first[text] + at]
    few = np.flatnonzero((count > 0) & (count < n))
    if len(few):
        whole = np.zeros(len(few), np.uint64)
        for k, d in enumerate(few):
            run = words.hashes[words.first[d] : words.first[d + 1]]
            whole[k] = windows(run, len(run))[0] ^ np.uint64(len(run))
        text, values = np.concatenate([text, few]), np.concatenate([values, whole])
    order = np.lexsort((values, text))
    text, values = text[order], values[order]
    if len(text):
        new = np.concatenate([[True], (values[1:] != values[:-1]) | (text[1:] != text[:-1])])
        text, values = text[new], values[new]
    return values, np.searchsorted(text, np.arange(len(count) + 1))


@dataclass(frozen=True)
class Plan:
    """The order's common elements (sorted hashes with their rank) and the
    largest light size."""

    common: np.ndarray
    boundary: int
    percent: int

    def ordered(self, values: np.ndarray) -> tuple[np.ndarray, int]:
        """Elements of one set in the global order, rare ones by hash, then common ones; and the number of rare ones."""
        if len(self.common):
            at = np.searchsorted(self.common, values)
            at[at == len(self.common)] = 0
            often = self.common[at] == values
            return np.concatenate([values[~often], values[often]]), int(np.count_nonzero(~often))
        return values, len(values)

    def pool(self, ordered: np.ndarray, rare: int) -> int:
        """How many of a set's ordered elements are in the pool: the first ones."""
        last = np.uint64(min(POOL * (100 - self.percent) / 100, 0.999) * 2.0**64)
        return int(np.searchsorted(ordered[:rare], last))

    def keys(self, values: np.ndarray) -> tuple[np.ndarray, int]:
        """The keys of a set, and how many of them, the first ones, are of the pool."""
        n = len(values)
        spare = n - int(needed(np.int64(n), self.percent))
        if spare == 0 and n * 100 < self.percent * (n + 1):
            return np.zeros(0, np.uint64), 0  # links with equal sets only, which are one class
        ordered, rare = self.ordered(values)
        first = ordered[: spare + 2]
        pool = 0
        out = []
        if n > self.boundary or n * 100 >= self.percent * (self.boundary + 1):
            # All that a heavy set may link with show their whole pool, or an element would seem to be in one set alone.
            pool = self.pool(ordered, rare)
            out.append(mix(ordered[: max(spare + 1, pool)] ^ _SINGLE))
        elif n * self.percent <= 100:
            out.append(mix(first[: spare + 1] ^ _SINGLE))  # one shared element may do
        if n <= self.boundary:
            i, j = np.triu_indices(len(first), 1)
            with np.errstate(over="ignore"):
                out.append(mix(mix(first[i]) * _DOUBLE + first[j]))
        return np.concatenate(out), pool if n > self.boundary else 0


def choose_boundary(sizes: Sequence[int], others: float, percent: int = PERCENT) -> int:
    """The light size limit of least cost: a light set costs a row for each
    subset, a heavy one a row for each element and a look at each of the
    ``others`` in its list, of which ``LOOKS`` cost as much as a row."""
    n = np.asarray(sorted(s for s in sizes if s), np.int64)
    if not len(n):
        return 0
    spare = n - needed(n, percent)
    light = (spare + 2) * (spare + 1) / 2.0
    heavy = (spare + 1) * (1.0 + others / LOOKS)
    cost = np.concatenate([[0.0], np.cumsum(light)]) + np.concatenate([np.cumsum(heavy[::-1])[::-1], [0.0]])
    best = int(np.argmin(cost))
    return int(n[best - 1]) if best else 0


def make_plan(docs: DataFrame, text: str, shingle: int, percent: int, texts: int = SAMPLE_TEXTS) -> Plan:
    total = docs.count()
    if not total:
        return Plan(np.zeros(0, np.uint64), 0, percent)
    sample = docs.select(F.col(text).alias("text")).sample(fraction=min(1.0, texts / total), seed=7)
    schema = T.StructType([T.StructField("e", T.LongType()), T.StructField("n", T.LongType())])

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                values, first = sets_of(words_of(part.column(0), _ALPHABET), shingle)
                size = np.diff(first)
                # A row of size n, element null, for each set.
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([values.view(np.int64), np.zeros(len(size), np.int64)])), pa.array(np.concatenate([np.zeros(len(values), np.int64), size]))],
                    names=schema.names,
                )

    seen = keep(sample.mapInArrow(cut, schema).groupBy("e", "n").agg(F.count(F.lit(1)).alias("c")))
    sizes = [(r["n"], r["c"]) for r in seen.where("n > 0").orderBy(F.desc("c"), "n").limit(COMMON).collect()]
    often = [r["e"] for r in seen.where("n = 0 AND c >= 4").orderBy(F.desc("c"), "e").limit(COMMON).collect()]
    rare = seen.where("n = 0 AND c < 4").agg(F.sum(F.col("c") * (F.col("c") - 1)).alias("a"), F.sum("c").alias("b")).first()
    # Other sets that hold an element, in the sample and then in the whole table.
    others = (rare["a"] or 0) / (rare["b"] or 1) * max(1.0, total / max(1, sum(c for _, c in sizes)))
    common = np.sort(np.array(often, np.int64).view(np.uint64))
    return Plan(common, choose_boundary([n for n, c in sizes for _ in range(c)], others, percent), percent)


def _bitmap(values: np.ndarray, bits: int = _BITS) -> np.ndarray:
    """Parity of the elements by their place in a bitmap: two bitmaps differ in
    at most as many bits as the sets do in elements. ``bits`` is a power of two,
    so a wider bitmap folds into a narrower one."""
    place = (values >> np.uint64(17)) % np.uint64(bits)
    odd = (np.bincount(place.astype(np.int64), minlength=bits) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64)


def _wide_bits(n: int) -> int:
    """Bits of a large set's second bitmap, 0 where the first one tells enough:
    the two of unrelated sets should differ in far more bits than sets that link."""
    return 0 if n <= 2 * _BITS else 1 << (n - 1).bit_length() - 1


def _folded(x: np.ndarray, longs: int) -> np.ndarray:
    return np.bitwise_xor.reduce(x.reshape(-1, longs), axis=0)


def _signatures(docs: DataFrame, doc_id: str, text: str, shingle: int, plan: Plan) -> DataFrame:
    """(id, version, n, d1, d2, pool, keys, bitmap, wide) of each document; the version
    is a hash of the text, d1 and d2 tell sets apart, pool counts a heavy set's keys of the pool."""
    shared = docs.sparkSession.sparkContext.broadcast(plan)
    longs = T.ArrayType(T.LongType())
    schema = T.StructType(
        [T.StructField("id", docs.schema[doc_id].dataType), *[T.StructField(c, T.LongType()) for c in ("version", "n", "d1", "d2", "pool")], T.StructField("keys", longs), T.StructField("bitmap", longs), T.StructField("wide", longs)]
    )

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared.value
        for batch in batches:
            for part in slices(batch, "text"):
                values, first = sets_of(words_of(part.column(1), _ALPHABET), shingle)
                n = np.diff(first)
                with np.errstate(over="ignore"):
                    sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(values ^ np.uint64(s)))]) for s in (1, 2)]
                    d1, d2 = (s[first[1:]] - s[first[:-1]] for s in sums)
                own = [values[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
                shown = [plan.keys(v) if len(v) else (v, 0) for v in own]
                keys, pool = [k for k, _ in shown], [p for _, p in shown]
                ends = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
                flat = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
                maps = np.concatenate([_bitmap(v) if len(k) else np.zeros(0, np.int64) for v, k in zip(own, keys, strict=True)]) if own else np.zeros(0, np.int64)
                map_ends = np.concatenate([[0], np.cumsum([_LONGS if len(k) else 0 for k in keys])]).astype(np.int32)
                more = [_bitmap(v, _wide_bits(len(v))) if _wide_bits(len(v)) else np.zeros(0, np.int64) for v in own]
                more_ends = np.concatenate([[0], np.cumsum([len(m) for m in more])]).astype(np.int32)
                wide = np.concatenate(more) if more else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), part.column(2), pa.array(n, pa.int64()), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), pa.array(pool, pa.int64()),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64))), pa.ListArray.from_arrays(pa.array(map_ends), pa.array(maps)),
                        pa.ListArray.from_arrays(pa.array(more_ends), pa.array(wide)),
                    ],
                    names=schema.names,
                )

    version = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    return docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), version.alias("version")).mapInArrow(scan, schema)


def _most_apart(a: Column, b: Column, percent: int) -> Column:
    """The largest symmetric difference of two sets that link."""
    both = a + b
    return both - 2 * F.ceil(percent * both / F.lit(float(100 + percent)) - 1e-9)


def _alike(a: str, b: str, percent: int) -> Column:
    """Whether two sets may link by their sizes and bitmaps."""
    bits = F.aggregate(F.zip_with(f"bitmap_{a}", f"bitmap_{b}", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
    sized = 100 * F.least(f"n_{a}", f"n_{b}") >= percent * F.greatest(f"n_{a}", f"n_{b}")
    return sized & (bits <= _most_apart(F.col(f"n_{a}"), F.col(f"n_{b}"), percent))


def _named(classes: DataFrame, side: str) -> DataFrame:
    return classes.select(F.col("node").alias(side), F.col("n").alias(f"n_{side}"), F.col("bitmap").alias(f"bitmap_{side}"))


def _tiled(pairs: DataFrame, homes: DataFrame) -> DataFrame:
    """The pairs with a tile each. Sets that meet often have the same home, and
    a home of many sets is cut into parts by hash, so that a tile holds few sets
    and a set goes to few tiles, however many partners it has."""
    side = {c: homes.select(F.col("node").alias(c), F.col("home").alias(f"h{c}"), F.col("part").alias(f"p{c}")) for c in "ab"}
    placed = pairs.join(side["a"], "a").join(side["b"], "b")
    one, two = (F.struct(F.col(f"h{c}").alias("home"), F.col(f"p{c}").alias("part")) for c in "ab")
    return placed.select("a", "b", F.xxhash64(F.least(one, two), F.greatest(one, two)).alias("tile"))


def _homes(members: DataFrame, classes: DataFrame, elements: int) -> DataFrame:
    """(node, home, part): the most popular head of the node's lists, and one of
    the parts of about ``elements`` elements into which that home is cut."""
    nearest = members.groupBy("node").agg(F.max(F.struct("popular", "head")).alias("h")).select("node", F.col("h.head").alias("home"))
    nearest = keep(nearest.join(classes.select("node", "n"), "node"))
    # Only homes that are cut are looked up; they are at most the elements of all sets over those of a tile.
    cut = keep(nearest.groupBy("home").agg(F.ceil(F.sum("n") / elements).cast("int").alias("m")).where("m > 1"))
    parts = F.pmod(F.xxhash64("node"), F.coalesce("m", F.lit(1))).alias("part")
    homes = keep(nearest.join(cut, "home", "left").select("node", "home", parts))
    discard(nearest, cut)
    return homes


def _sieve(rows: DataFrame) -> Callable[..., Column]:
    """A test for columns such as those of ``rows``: true for each of the rows, and
    for few others. It is a bitmap of hashes of bounded size, made on the
    executors, so a table of whole texts can be thinned out before an exact join
    shuffles it, however many rows are looked for."""
    bits = min(MOST_SIEVE_BITS, max(1 << 16, 1 << (SIEVE_BITS * rows.count()).bit_length()))
    place = lambda columns: F.pmod(F.xxhash64(*columns), F.lit(bits))
    placed = rows.select(place(rows.columns).alias("p")).select(F.expr("p div 64").alias("long"), F.expr("shiftleft(1L, cast(p % 64 AS int))").alias("bit"))
    found = placed.groupBy("long").agg(F.bit_or("bit").alias("bits")).toArrow()
    sieve = np.zeros(bits // 64, np.int64)
    sieve[found.column("long").to_numpy()] = found.column("bits").to_numpy()
    shared = rows.sparkSession.sparkContext.broadcast(sieve.view(np.uint8))

    @F.arrow_udf("boolean")
    def held(at: pa.Array) -> pa.Array:
        at = np.asarray(at)
        return pa.array((shared.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool))

    return lambda *columns: held(place(columns))


_PAIR = T.StructType([T.StructField("tile", T.LongType()), T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def _pass(pairs: DataFrame, values: DataFrame, test: Callable[[int, np.ndarray, int, np.ndarray], bool]) -> DataFrame:
    """The pairs (tile, a, b) that pass the test of both sides' values (node, n,
    array x). A value is sent once to each tile in which its node has partners."""
    sides = pairs.select("tile", F.col("a").alias("node")).unionByName(pairs.select("tile", F.col("b").alias("node"))).distinct()
    sent = sides.join(values, "node").select("tile", "node", F.lit(None).cast("long").alias("other"), "n", "x")
    asked = pairs.select("tile", F.col("a").alias("node"), F.col("b").alias("other"), F.lit(None).cast("long").alias("n"), F.lit(None).cast("array<bigint>").alias("x"))

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each tile the values come first, then its pairs."""
        tile, own = None, {}
        for batch in batches:
            out = []
            lists = batch.column(4)
            flat, ends = np.asarray(lists.values), np.asarray(lists.offsets)
            for k, (t, node, other, n) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True)):
                if t != tile:
                    tile, own = t, {}
                if other is None:
                    own[node] = n, np.array(flat[ends[k] : ends[k + 1]])
                elif node in own and other in own and test(*own[node], *own[other]):
                    out.append((t, node, other))
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], pa.int64()) for c in range(3)], names=_PAIR.names)

    together = sent.unionByName(asked).repartition("tile").sortWithinPartitions("tile", F.col("other").asc_nulls_first())
    return together.mapInArrow(scan, _PAIR)


def _verified(
    pairs: DataFrame, homes: DataFrame, classes: DataFrame, docs: DataFrame, doc_id: str, text: str, shingle: int, percent: int
) -> DataFrame:
    """The pairs (a, b) whose whole sets link, kept. Only the texts of documents in a
    pair are shuffled, once, after the wide bitmaps of large sets have had their
    say; the sets are made again where the texts arrive, and sent to the tiles in
    which they have partners."""
    tiled = keep(_tiled(pairs, homes))

    def near(n: int, x: np.ndarray, m: int, y: np.ndarray) -> bool:
        if not len(x) or not len(y):
            return True  # a small set's first bitmap has been looked at
        longs = min(len(x), len(y))
        apart = int(np.bitwise_count(_folded(x, longs) ^ _folded(y, longs)).sum())
        return apart <= n + m - 2 * -(-percent * (n + m) // (100 + percent))

    pairs = keep(_pass(tiled, classes.select("node", "n", F.col("wide").alias("x")), near))
    discard(tiled)
    wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = keep(wanted.join(classes.select("node", "rep", "d1"), "node"))
    held = docs.where(_sieve(wanted.select("rep"))(F.col(doc_id))).select(F.col(doc_id).alias("rep"), F.col(text).alias("text"))
    texts = held.join(wanted, held["rep"].eqNullSafe(wanted["rep"])).select("node", "d1", "text")
    schema = T.StructType([T.StructField("node", T.LongType()), T.StructField("elements", T.ArrayType(T.LongType()))])

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                values, first = sets_of(words_of(part.column(2), _ALPHABET), shingle)
                with np.errstate(over="ignore"):
                    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(values ^ np.uint64(1)))])
                same = (sums[first[1:]] - sums[first[:-1]]).view(np.int64) == np.asarray(part.column(1))
                made = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(values.view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), made], names=schema.names).filter(pa.array(same))

    sets = texts.mapInArrow(cut, schema)

    def link(n: int, x: np.ndarray, m: int, y: np.ndarray) -> bool:
        if n > m:
            n, x, m, y = m, y, n, x
        at = np.searchsorted(y, x)
        at[at == m] = 0
        common = int((y[at] == x).sum())
        return 100 * common >= percent * (n + m - common)

    values = sets.select("node", F.size("elements").cast("long").alias("n"), F.sort_array("elements").alias("x"))
    linked = keep(_pass(pairs, values, link).select("a", "b"))
    discard(pairs, wanted)
    return linked


def _across(members: DataFrame, percent: int, block: int) -> DataFrame:
    """Pairs (a, b) of sets in one list and in two components that sizes and
    bitmaps allow. ``members`` has key, node, component, n, bitmap and the
    list's size. A list above ``block`` is cut into parts, and each two parts
    meet in a task of their own."""
    parts = F.ceil(F.col("size") / block).cast("int")
    dealt = members.withColumn("m", parts).withColumn("p", F.pmod(F.xxhash64("node"), F.col("m")).cast("int"))
    # Part p goes to the meetings (p, q) and (q, p) with every q.
    dealt = dealt.withColumn("q", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    dealt = dealt.select("key", F.least("p", "q").alias("i"), F.greatest("p", "q").alias("j"), "p", "node", "component", "n", "bitmap")
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])

    def meet(rows: dict[str, np.ndarray], lo: int, hi: int) -> list[tuple[np.ndarray, np.ndarray]]:
        out = []
        own = slice(lo, hi)
        node, comp, n, bits = rows["node"][own], rows["component"][own], rows["n"][own], rows["bitmap"][own]
        side = rows["p"][own]
        crossing = rows["i"][lo] != rows["j"][lo]
        for x in range(hi - lo):
            rest = slice(x + 1, hi - lo)
            most = n[x] + n[rest] - 2 * (-(-percent * (n[x] + n[rest]) // (100 + percent)))
            ok = (comp[rest] != comp[x]) & (100 * np.minimum(n[x], n[rest]) >= percent * np.maximum(n[x], n[rest]))
            if crossing:
                ok &= side[rest] != side[x]
            at = np.flatnonzero(ok)
            if len(at):
                apart = np.bitwise_count(bits[rest][at] ^ bits[x]).sum(axis=1)
                at = at[apart <= most[at]]
                if len(at):
                    other = node[rest][at]
                    out.append((np.full(len(at), node[x]), other))
        return out

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("key", "i", "j", "p", "node", "component", "n")
        kept: dict[str, np.ndarray] | None = None

        def joined(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
            rows = {c: np.asarray(batch.column(c)) for c in names}
            rows["bitmap"] = np.asarray(batch.column("bitmap").flatten()).reshape(-1, _LONGS).view(np.uint64)
            return rows if kept is None else {c: np.concatenate([kept[c], rows[c]]) for c in rows}

        def emit(rows: dict[str, np.ndarray], borders: np.ndarray) -> pa.RecordBatch:
            found = [p for lo, hi in zip(borders[:-1], borders[1:], strict=True) if hi - lo > 1 for p in meet(rows, lo, hi)]
            a = np.concatenate([p[0] for p in found]) if found else np.zeros(0, np.int64)
            b = np.concatenate([p[1] for p in found]) if found else np.zeros(0, np.int64)
            both = np.unique(np.column_stack([np.minimum(a, b), np.maximum(a, b)]), axis=0) if len(a) else np.zeros((0, 2), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=schema.names)

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = joined(batch)
            new = np.flatnonzero((rows["key"][1:] != rows["key"][:-1]) | (rows["i"][1:] != rows["i"][:-1]) | (rows["j"][1:] != rows["j"][:-1])) + 1
            borders = np.concatenate([[0], new])
            yield emit(rows, borders)
            kept = {c: v[borders[-1] :] for c, v in rows.items()}  # the last list may go on
        if kept is not None:
            yield emit(kept, np.array([0, len(kept["key"])]))

    dealt = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return dealt.mapInArrow(scan, schema).distinct()


def _entered(shared: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(key, node, popular) of the lists that each set enters. ``shared`` has the key,
    node and place ``at`` of every key that several sets show, and the list's size.
    Keys of a heavy set's pool that are missing there are in no other set, and so
    many of the elements that a partner may lack are known. A set whose elements many
    others have, such as the one that copies come from, is popular."""
    own = Window.partitionBy("node")
    lacks = F.expr(f"n - (n * {percent} + 99) div 100")
    met = F.sum(F.when(F.col("at") < F.col("pool"), 1).otherwise(0)).over(own)
    placed = shared.join(classes.select("node", "n", "pool", F.size("keys").alias("shown")), "node")
    placed = placed.withColumn("met", met).withColumn("rank", F.row_number().over(own.orderBy("at")))
    popular = (F.sum("size").over(own) / F.col("shown")).alias("popular")
    enters = (F.col("at") >= F.col("pool")) | (F.col("rank") <= lacks + 1 - F.col("pool") + F.col("met"))
    return placed.select("key", "node", popular, enters.alias("enters")).where("enters").drop("enters")


def _linked(docs: DataFrame, doc_id: str, text: str, shingle: int, percent: int, block: int) -> DataFrame:
    """(id, version, n, component, component_id) of each document; the component
    is a number, null for a text without words. What is kept on the way goes as
    soon as the table that is made of it is there."""
    bounded_batches(docs.sparkSession)
    plan = make_plan(docs, text, shingle, percent)
    sets = keep(_signatures(docs, doc_id, text, shingle, plan))
    ids = keep(sets.select("id", "version", "n", "d1", "d2"))
    grouped = sets.where("n > 0").groupBy("n", "d1", "d2").agg(F.min("id").alias("rep"), F.any_value("pool").alias("pool"), F.any_value("keys").alias("keys"), F.any_value("bitmap").alias("bitmap"), F.any_value("wide").alias("wide"))
    classes = keep(grouped.withColumn("node", F.monotonically_increasing_id()))
    discard(sets)
    keyed = classes.select(F.posexplode("keys").alias("at", "key"), "node")
    lists = keep(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"))
    shared = keep(_entered(keyed.join(lists, "key"), classes, percent))
    # The head of a list is its most popular set.
    heads = shared.groupBy("key").agg(F.max(F.struct("popular", "node")).alias("h"), F.count(F.lit(1)).alias("size"))
    heads = keep(heads.where("size > 1").select("key", F.col("h.node").alias("head"), F.col("h.popular").alias("popular"), "size"))
    members = keep(shared.drop("popular").join(heads, "key"))
    discard(lists, shared, heads)
    homes = _homes(members, classes, TILE)
    args = (homes, classes, docs, doc_id, text, shingle, percent)
    stars = members.where("node <> head").select(F.least("head", "node").alias("a"), F.greatest("head", "node").alias("b")).distinct()
    likely = stars.join(_named(classes, "a"), "a").join(_named(classes, "b"), "b").where(_alike("a", "b", percent)).select("a", "b")
    links = _verified(likely, *args)
    found = keep(components(links))
    placed = members.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = keep(placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key"))
    left = placed.join(mixed, "key").join(classes.select("node", "n", "bitmap"), "node")
    more = _verified(_across(left, percent, block), *args)
    named = keep(components(links.unionByName(more)))
    owned = keep(classes.join(named, "node", "left").select("n", "d1", "d2", "rep", F.coalesce("component", "node").alias("component")))
    discard(members, homes, mixed, found, links, more, classes, named)
    least = keep(owned.groupBy("component").agg(F.min("rep").alias("component_id")))
    final = keep(owned.join(least, "component").select("n", "d1", "d2", "component", "component_id"))
    discard(owned, least)
    out = ids.join(final, ["n", "d1", "d2"], "left")
    return out.select("id", "version", "n", "component", F.coalesce("component_id", "id").alias("component_id"))


def jaccard_components(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT, block: int = BLOCK,
) -> DataFrame:
    """One row per document: its id, version (a hash of its text), n_shingles and
    component_id, the smallest id that links reach."""
    require_columns(docs, [doc_id, text], "docs")
    require(0 < percent <= 100 and shingle >= 1, "percent must be in 1 to 100, shingle at least 1")
    out = _linked(docs, doc_id, text, shingle, percent, block)
    return out.select(F.col("id").alias(doc_id), "version", F.col("n").alias("n_shingles"), "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The documents with all their columns, one of each component: the one of
    smallest id, of equal ids the one whose text has the least hash; a row without
    an id stays only if no row of its component has one. Rows equal in id and text
    are one document, of which one row stays. Texts without words all stay."""
    require_columns(docs, [doc_id, text], "docs")
    found = _linked(docs, doc_id, text, shingle, percent, BLOCK)
    rows = keep(found.where("component IS NOT NULL").groupBy("component", "id", "version").agg(F.count(F.lit(1)).alias("times")))
    best = rows.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("nameless"), "id", "version", "times")).alias("b"))
    chosen = keep(best.select(F.col("b.id").alias("__id"), F.col("b.version").alias("__version"), F.col("b.times").alias("__times")))
    same = F.col("id").eqNullSafe(F.col("__id")) & (F.col("version") == F.col("__version"))
    gone = keep(rows.join(chosen, same, "left_anti").select(F.col("id").alias("__id"), F.col("version").alias("__version")))
    version = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    mine = F.col(doc_id).eqNullSafe(F.col("__id")) & (version == F.col("__version"))
    # Texts are shuffled only where a sieve of the ids and versions lets them pass.
    suspect = _sieve(gone)(F.col(doc_id), version)
    left = docs.where(~suspect).unionByName(docs.where(suspect).join(gone, mine, "left_anti"))
    # Rows of one document are rare, and looked for on the ids alone.
    repeated = keep(chosen.where("__times > 1").select("__id", "__version"))
    if repeated.isEmpty():
        return left
    suspect = _sieve(repeated)(F.col(doc_id), version)
    some = left.where(suspect)
    once = some.join(repeated, mine, "left_semi").withColumn("__v", version).dropDuplicates([doc_id, "__v"]).drop("__v")
    return left.where(~suspect).unionByName(some.join(repeated, mine, "left_anti")).unionByName(once)
