"""Benchmark decontamination by windows of normalised words.

The windows of the benchmark items form a hash set. Its size is counted first: up
to ``max_windows`` it is broadcast and every text is scanned where it lies, with no
shuffle; beyond that only a bitmap of fixed size is broadcast, and the few windows
that pass it are joined with the item windows. Either way each hit of a hash is
verified on the words themselves.

Defined cases: a null or empty text has no words, hits or items, and is never
removed; null or empty items have no windows; an item of fewer words than the
window is one window; equal items each count; an item without an id hits, but is not named; rows with equal ids are separate
documents in the scan. Extra columns are carried by ``remove_contaminated`` and
ignored by ``benchmark_hits``. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.words import Words, inside, item_words, slices, windows, words_of
from tessera.runtime import keep, require, require_columns

WINDOW = 10
# Above this many item windows the set itself is not broadcast.
MAX_WINDOWS = 500_000
_BITMAP_BITS = 24

_ALPHABET = item_words()


@dataclass
class WindowSet:
    """Item windows by their number of words: text of the window -> item ids."""

    items: dict[int, dict[bytes, list[str]]]

    def __post_init__(self) -> None:
        self.keys = {}
        for n, known in self.items.items():
            found = words_of(pa.array(list(known), pa.binary()), _ALPHABET)
            self.keys[n] = np.unique(windows(found.hashes, n)[found.first[:-1]])

    def matches(self, words: Words) -> Iterator[tuple[int, int, list[str]]]:
        """First word, number of words and items of each verified hit."""
        for n, keys in self.keys.items():
            made = windows(words.hashes, n)
            if not len(made):
                continue
            at = np.searchsorted(keys, made)
            at[at == len(keys)] = 0
            for i in np.flatnonzero((keys[at] == made) & inside(words, n)):
                if items := self.items[n].get(words.joined(i, n)):
                    yield int(i), n, items


def item_windows(items: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """Distinct (n, words, item): the windows of every item, an item of fewer
    words whole."""
    require_columns(items, [item_id, text], "items")
    require(window >= 1, "window must be at least 1")
    schema = T.StructType([T.StructField("n", T.IntegerType()), T.StructField("words", T.BinaryType()), T.StructField("item", T.StringType())])

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for part in slices(batch, "text"):
                found = words_of(part.column(1), _ALPHABET)
                for item, lo, hi in zip(part.column(0).to_pylist(), found.first[:-1], found.first[1:], strict=True):
                    n = min(window, hi - lo)
                    if n:
                        rows += [(n, found.joined(i, n), item) for i in range(lo, hi - n + 1)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.string())],
                names=["n", "words", "item"],
            )

    narrow = items.select(F.col(item_id).cast("string").alias("item"), F.col(text).alias("text"))
    return narrow.mapInArrow(cut, schema).distinct()


def _covered(words: Words, hits: Iterable[tuple[int, int, list[str]]]) -> tuple[np.ndarray, list[set[str]]]:
    """Per word whether a hit covers it; per text the items that occur."""
    change = np.zeros(len(words.hashes) + 1, np.int32)
    found: list[set[str]] = [set() for _ in words.counts]
    for i, n, items in hits:
        change[i] += 1
        change[i + n] -= 1
        found[int(np.searchsorted(words.first, i, side="right")) - 1].update(x for x in items if x is not None)
    return np.cumsum(change[:-1]) > 0, found


def _sums(flags: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[first[1:]] - total[first[:-1]]


_REPORT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("n_items", T.LongType()),
        T.StructField("items_sha256", T.StringType()),
    ]
)


def _digest(items: set[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def _small(windows_table: DataFrame, max_windows: int) -> WindowSet | None:
    """The whole set if it is small enough to broadcast, which is counted first."""
    if windows_table.count() > max_windows:
        return None
    items: dict[int, dict[bytes, list[str]]] = {}
    for row in windows_table.collect():
        items.setdefault(row["n"], {}).setdefault(bytes(row["words"]), []).append(row["item"])
    return WindowSet(items)


def benchmark_hits(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
    item_text: str = "text", window: int = WINDOW, max_windows: int = MAX_WINDOWS,
) -> DataFrame:
    """One row per document: its id, n_words, n_hit (words inside an occurring
    window), n_items, items_sha256 (of the occurring items' ids, sorted as
    strings and joined by commas) and contaminated."""
    require_columns(docs, [doc_id, text], "docs")
    table = keep(item_windows(items, item_id, item_text, window))
    known = _small(table, max_windows)
    narrow = docs.select(F.col(doc_id), F.col(text).alias("text"))
    schema = T.StructType([docs.schema[doc_id], *_REPORT.fields])
    if known is not None:
        shared = docs.sparkSession.sparkContext.broadcast(known)

        def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, "text"):
                    found = words_of(part.column(1), _ALPHABET)
                    hit, named = _covered(found, shared.value.matches(found))
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column(0), pa.array(found.counts, pa.int64()), pa.array(_sums(hit, found.first), pa.int64()),
                            pa.array([len(x) for x in named], pa.int64()), pa.array([_digest(x) for x in named], pa.string()),
                        ],
                        names=schema.names,
                    )

        report = narrow.mapInArrow(scan, schema)
    else:
        report = _hits_joined(narrow, table, doc_id)
    return report.withColumn("contaminated", F.col("n_hit") > 0)


def _hits_joined(narrow: DataFrame, table: DataFrame, doc_id: str) -> DataFrame:
    """The same for a set too large to broadcast: windows that pass a bitmap are
    joined with it, and the hit ranges of each document are merged."""
    lengths = [r["n"] for r in table.select("n").distinct().collect()]
    # At most 2^24 slots reach the driver; each item window sets one.
    slot = F.shiftrightunsigned(F.xxhash64("n", "words"), 64 - _BITMAP_BITS)
    bits = np.zeros(1 << _BITMAP_BITS, bool)
    for row in table.select(slot.alias("slot")).distinct().toLocalIterator():
        bits[row["slot"]] = True
    shared = narrow.sparkSession.sparkContext.broadcast(np.packbits(bits))
    numbered = keep(narrow.withColumn("row", F.monotonically_increasing_id()))
    made = T.StructType(
        [T.StructField("row", T.LongType()), T.StructField("at", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("words", T.BinaryType())]
    )

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        bitmap = np.unpackbits(shared.value)
        for batch in batches:
            for part in slices(batch, "text"):
                found = words_of(part.column(1), _ALPHABET)
                ids, out = np.asarray(part.column(0)), []
                for d, (lo, hi) in enumerate(zip(found.first[:-1], found.first[1:], strict=True)):
                    for n in lengths:
                        seed = xxh64_intdigest(int(n).to_bytes(4, "little"), seed=42)
                        for i in range(lo, hi - n + 1):
                            words = found.joined(i, n)
                            if bitmap[xxh64_intdigest(words, seed=seed) >> (64 - _BITMAP_BITS)]:
                                out.append((int(ids[d]), int(i - lo), n, words))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.binary()))],
                    names=made.names,
                )

    hits = keep(numbered.select("row", "text").mapInArrow(cut, made).join(table, ["n", "words"]))
    # A window's end, then the ends before it: words are counted once however many windows cover them.
    from pyspark.sql import Window

    order = Window.partitionBy("row").orderBy("at", "end").rowsBetween(Window.unboundedPreceding, -1)
    places = hits.select("row", "at", (F.col("at") + F.col("n")).alias("end")).distinct()
    covered = (
        places.withColumn("upto", F.coalesce(F.max("end").over(order), F.lit(0)))
        .groupBy("row").agg(F.sum(F.greatest(F.lit(0), F.col("end") - F.greatest("at", "upto"))).alias("n_hit"))
    )
    named = hits.groupBy("row").agg(F.sort_array(F.collect_set("item")).alias("items"))
    count = T.StructType([T.StructField("row", T.LongType()), T.StructField("n_words", T.LongType())])

    def number(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(words_of(part.column(1), _ALPHABET).counts, pa.int64())], names=count.names)

    joined = (
        numbered.select("row", doc_id).join(numbered.select("row", "text").mapInArrow(number, count), "row")
        .join(covered, "row", "left").join(named, "row", "left")
    )
    items = F.coalesce("items", F.array().cast("array<string>"))
    return joined.select(
        doc_id, "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", items), 256).alias("items_sha256"),
    )


def remove_contaminated(
    docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    window: int = WINDOW, spans: bool = False, max_windows: int = MAX_WINDOWS,
) -> DataFrame:
    """The documents with all their columns, without those that hold an item's
    window; with ``spans`` they stay and lose the bytes from the first to the
    last word of each run of hit words."""
    require_columns(docs, [text], "docs")
    table = keep(item_windows(items, item_id, item_text, window))
    known = _small(table, max_windows)
    if known is None:
        require(not spans, f"spans are removed with at most {max_windows} item windows")
        held = keep(docs.withColumn("__row", F.monotonically_increasing_id()))
        hits = benchmark_hits(held, items, "__row", text, item_id, item_text, window, max_windows)
        return held.join(hits.where("contaminated").select("__row"), "__row", "left_anti").select(*docs.columns)
    shared = docs.sparkSession.sparkContext.broadcast(known)
    at = docs.columns.index(text)

    def clean(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                column = part.column(at)
                found = words_of(column, _ALPHABET)
                hit, _ = _covered(found, shared.value.matches(found))
                dirty = _sums(hit, found.first) > 0
                if not dirty.any():
                    yield part
                elif not spans:
                    yield part.filter(pa.array(~dirty))
                else:
                    texts = column.cast(pa.large_binary()).to_pylist()
                    for d in np.flatnonzero(dirty):
                        texts[d] = _without(texts[d], found, hit, int(d))
                    columns = [c if k != at else pa.array(texts, pa.large_binary()).cast(column.type) for k, c in enumerate(part.columns)]
                    yield pa.RecordBatch.from_arrays(columns, schema=part.schema)

    return docs.mapInArrow(clean, docs.schema)


def _without(text: bytes, words: Words, hit: np.ndarray, d: int) -> bytes:
    lo, hi, base = words.first[d], words.first[d + 1], words.offsets[d]
    kept, upto, i = [], 0, lo
    while i < hi:
        if not hit[i]:
            i += 1
            continue
        j = i
        while j + 1 < hi and hit[j + 1]:
            j += 1
        kept.append(text[upto : words.starts[i] - base])
        upto = words.ends[j] - base
        i = j + 1
    return b"".join([*kept, text[upto:]])
