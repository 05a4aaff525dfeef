"""Repeated passages by a sparse suffix array.

Only the suffixes that begin at content-selected places are kept: in every run of
``length`` words the run of ``GRAM`` words with the smallest hash is chosen, so two
equal passages of ``length`` words choose the same place in both. A suffix carries
the hash of its first ``GRAM`` words and of its surroundings: all words of the runs
that chose it. The suffixes are range-sorted over the cluster by these and the
document, so that equal ones of any number lie side by side in as many tasks as they
need, and a suffix that begins as neither of its neighbours is dropped.

Suffixes with equal surroundings form a class, whose matches extend over all of its
runs. Where one beginning has several classes, the match of each is extended to the
left and to the right word by word: one member of the class tells the hashes of its
runs, and a run is repeated if two documents hold it. A word counts as repeated if a
run of ``length`` words around it occurs in another document, exactly as a comparison
of all runs would say; and as later, if a document of smaller id holds that run.

Words are compared by 64-bit hashes. Defined cases: null, empty and short texts have
no runs; rows equal in id and text are one document; passages that repeat only inside
one document do not count; extra columns are ignored; null ids come before all
others; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.words import Words, _power, inside, mix, slices, spaced_words, windows, words_of
from tessera.runtime import keep, require, require_columns

LENGTH = 50
GRAM = 16

_ALPHABET = spaced_words()
_STEP = np.uint64(0xC2B2AE3D27D4EB4F)
_BACK = np.uint64(pow(int(_STEP), -1, 1 << 64))


def _least_places(values: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` values the place of its first least one."""
    if len(values) < width:
        return np.zeros(0, np.int64)
    best, at, span = values, np.arange(len(values)), 1

    def pick(shift: int) -> tuple[np.ndarray, np.ndarray]:
        later = best[shift:] < best[: len(best) - shift]
        return np.where(later, best[shift:], best[: len(best) - shift]), np.where(later, at[shift:], at[: len(at) - shift])

    while span * 2 <= width:
        best, at = pick(span)
        span *= 2
    if span < width:
        best, at = pick(width - span)
    return at


class _Ranges:
    """Hashes of any range of words from running sums."""

    def __init__(self, hashes: np.ndarray) -> None:
        with np.errstate(over="ignore"):
            self.sums = np.zeros(len(hashes) + 1, np.uint64)
            np.cumsum(hashes * _power(_STEP, len(hashes)), out=self.sums[1:])
            self.back = _power(_BACK, len(hashes) + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[end] - self.sums[start]) * self.back[start] ^ (end - start).astype(np.uint64))


def _suffixes(words: Words, length: int) -> tuple[np.ndarray, ...]:
    """Text, place, first run, last run, hash of the beginning and of the
    surroundings of each kept suffix; places count words of the slice."""
    grams = windows(words.hashes, GRAM)
    starts = np.flatnonzero(inside(words, length))
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, none, none, none, none.view(np.uint64), none.view(np.uint64)
    place = _least_places(grams, length - GRAM + 1)[starts]
    text = np.searchsorted(words.first, starts, side="right") - 1
    new = np.concatenate([[True], (place[1:] != place[:-1]) | (text[1:] != text[:-1])])
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(starts)) - 1
    first_run, last_run, place, text = starts[at], starts[last], place[at], text[at]
    around = _Ranges(words.hashes).of(first_run, last_run + length)
    with np.errstate(over="ignore"):
        around = mix(around + (place - first_run).astype(np.uint64) * _STEP)
    return text, place, first_run, last_run, grams[place], around


def repeated_passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """One row per document (id and text): doc_id, version (a hash of the text),
    n_words, n_repeated, n_later and the two as spans, arrays of start and end in words, end exclusive."""
    require_columns(docs, [doc_id, text], "docs")
    require(length > GRAM, f"length must be above {GRAM}")
    held = docs.select(F.col(doc_id).alias("id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("version"), F.col(text).alias("text"))
    kind = docs.schema[doc_id].dataType
    longs = ("version", "gram", "around", "place", "first_run", "last_run", "n_words")
    schema = T.StructType([T.StructField("id", kind), *[T.StructField(c, T.LongType()) for c in longs]])

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words = words_of(part.column(2), _ALPHABET)
                which, place, lo, hi, gram, around = _suffixes(words, length)
                base = words.first[which]
                n, rest = part.num_rows, len(which)

                def column(of_suffix: np.ndarray, rest: int = rest, n: int = n) -> pa.Array:
                    # A row per text without a suffix comes first.
                    return pa.array(np.concatenate([np.zeros(n, np.int64), of_suffix]), mask=np.arange(n + rest) < n)

                every = pa.array(np.concatenate([np.arange(n), which]))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(every), part.column(1).take(every), column(gram.view(np.int64)), column(around.view(np.int64)),
                        column(place - base), column(lo - base), column(hi - base), pa.array(words.counts[np.concatenate([np.arange(n), which])], pa.int64()),
                    ],
                    names=schema.names,
                )

    made = keep(held.mapInArrow(cut, schema))
    texts = made.where("gram IS NULL").select("id", "version", "n_words").distinct()
    sorted_suffixes = made.where("gram IS NOT NULL").drop("n_words")
    order = ["gram", "around", "id", "version", "place"]
    close = keep(sorted_suffixes.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_neighbours, sorted_suffixes.schema))
    owner = F.struct("id", "version")
    classes = keep(close.groupBy("gram", "around").agg(
        F.min(owner).alias("lo"), F.max(owner).alias("hi"), F.min(F.struct("id", "version", "place", "first_run", "last_run")).alias("one")))
    several = keep(classes.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram"))
    whole = classes.join(several, "gram", "left_anti").where("lo <> hi")
    alone = whole.select("gram", "around", (F.col("one.place") - F.col("one.last_run")).alias("near"), (F.col("one.place") - F.col("one.first_run")).alias("far"), "lo")
    extended = _extended(classes.join(several, "gram"), held, length)
    found = keep(alone.unionByName(extended))
    spans = close.join(found, ["gram", "around"]).select(
        "id", "version", (F.col("place") - F.col("far")).alias("start"), (F.col("place") - F.col("near") + length).alias("end"), (F.col("lo") < owner).alias("later")
    )
    per_text = spans.groupBy("id", "version").agg(
        F.sort_array(F.collect_set(F.struct("start", "end"))).alias("all"), F.sort_array(F.collect_set(F.when(F.col("later"), F.struct("start", "end")))).alias("later")
    )
    merged = per_text.select(F.col("id").alias("__i"), F.col("version").alias("__v"), _merged("all").alias("repeated"), _merged("later").alias("later"))
    merged = keep(merged)
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    # The version tells rows of one id apart.
    out = texts.join(merged, texts["id"].eqNullSafe(merged["__i"]) & (texts["version"] == merged["__v"]), "left")
    repeated, later = F.coalesce("repeated", none), F.coalesce("later", none)
    return out.select(F.col("id").alias(doc_id), "version", "n_words", _total(repeated).alias("n_repeated"), _total(later).alias("n_later"), repeated.alias("repeated"), later.alias("later"))


def _neighbours(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted suffixes, those that begin as the one before or after; the
    first and last of a task stay, as their neighbours lie in another."""
    held: pa.RecordBatch | None = None
    before: int | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        gram = np.asarray(batch.column(batch.schema.get_field_index("gram")))
        same = gram[1:] == gram[:-1]
        first = True if before is None else gram[0] == before
        stays = np.concatenate([[first], same]) | np.concatenate([same, [False]])
        # The last row waits for the next batch.
        out = batch.slice(0, batch.num_rows - 1)
        yield out.filter(pa.array(stays[:-1]))
        held = batch.slice(batch.num_rows - 1)
        before = int(gram[-2]) if len(gram) > 1 else before
    if held is not None:
        yield held


def _extended(classes: DataFrame, held: DataFrame, length: int) -> DataFrame:
    """(gram, around, near, far, lo): stretches of runs, by how many words the
    suffix begins after them, that occur in several documents, of which ``lo``
    is the first. The texts of one member of each class are read again."""
    one = classes.select(
        "gram", "around", "lo", "hi", F.col("one.id").alias("i"), F.col("one.version").alias("v"), *[F.col(f"one.{c}").alias(c) for c in ("place", "first_run", "last_run")]
    )
    wanted = keep(one.groupBy("i", "v").agg(F.collect_list(F.struct("gram", "around", "place", "first_run", "last_run")).alias("runs")))
    once = held.join(wanted, held["id"].eqNullSafe(wanted["i"]) & (held["version"] == wanted["v"])).select("text", "runs")
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("gram", "around", "back", "run")])

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words = words_of(part.column(0), _ALPHABET)
                ranges = _Ranges(words.hashes)
                lists = part.column(1)
                rows = lists.flatten()
                gram, around, place, lo, hi = (np.asarray(rows.field(c)) for c in range(5))
                sizes = np.asarray(lists.value_lengths())
                base = np.repeat(words.first[:-1], sizes)
                width = hi - lo + 1
                each = np.repeat(np.arange(len(lo)), width)
                start = lo[each] + np.arange(len(each)) - np.repeat(np.cumsum(width) - width, width)
                begin = base[each] + start
                yield pa.RecordBatch.from_arrays(
                    [pa.array(gram[each]), pa.array(around[each]), pa.array(place[each] - start), pa.array(ranges.of(begin, begin + length).view(np.int64))], names=schema.names
                )

    runs = keep(once.mapInArrow(cut, schema).distinct())
    tagged = runs.join(one.select("gram", "around", "lo", "hi"), ["gram", "around"])
    shared = keep(tagged.groupBy("gram", "back", "run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo <> hi").select("gram", "back", "run", "lo"))
    hits = runs.join(shared, ["gram", "back", "run"])
    # Neighbouring runs with one first document make one stretch.
    from pyspark.sql import Window

    order = Window.partitionBy("gram", "around", "lo").orderBy("back")
    stretch = hits.withColumn("k", F.col("back") - F.row_number().over(order))
    return stretch.groupBy("gram", "around", "lo", "k").agg(F.min("back").alias("near"), F.max("back").alias("far")).select("gram", "around", "near", "far", "lo")


def _merged(column: str):
    """Sorted ranges with those that meet joined, in one pass."""
    zero = F.struct(F.array().cast("array<struct<start:bigint,end:bigint>>").alias("out"), F.lit(None).cast("struct<start:bigint,end:bigint>").alias("open"))

    def step(a, x):
        meets = x["start"] <= a["open"]["end"]
        return F.struct(
            F.when(a["open"].isNull() | meets, a["out"]).otherwise(F.array_append(a["out"], a["open"])).alias("out"),
            F.when(a["open"].isNotNull() & meets, F.struct(a["open"]["start"].alias("start"), F.greatest(a["open"]["end"], x["end"]).alias("end"))).otherwise(x).alias("open"),
        )

    return F.aggregate(F.col(column), zero, step, lambda a: F.when(a["open"].isNull(), a["out"]).otherwise(F.array_append(a["out"], a["open"])))


def _total(spans):
    return F.aggregate(spans, F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])


def remove_later(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """The documents with all their columns; words in a passage that a document
    of smaller id holds are cut out, so that one copy of each stays."""
    found = repeated_passages(docs, doc_id, text, length).where("n_later > 0")
    found = keep(found.select(F.col(doc_id).alias("__i"), F.col("version").alias("__v"), F.transform("later", lambda x: F.array(x["start"], x["end"])).alias("__later")))
    at = docs.columns.index(text)
    same = docs[doc_id].eqNullSafe(found["__i"]) & (F.xxhash64(F.coalesce(docs[text], F.lit(""))) == found["__v"])
    joined = docs.join(found, same, "left").drop("__i", "__v")

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(at)
            texts, later = column.cast(pa.large_binary()).to_pylist(), batch.column(len(batch.columns) - 1).to_pylist()
            for d, spans in enumerate(later):
                if spans and texts[d] is not None:
                    words = words_of(pa.array([texts[d]], pa.binary()), _ALPHABET)
                    kept, upto = [], 0
                    for a, b in spans:
                        kept.append(texts[d][upto : words.starts[a]])
                        upto = words.ends[b - 1]
                    texts[d] = b"".join([*kept, texts[d][upto:]])
            columns = [c if k != at else pa.array(texts, pa.large_binary()).cast(column.type) for k, c in enumerate(batch.columns[:-1])]
            yield pa.RecordBatch.from_arrays(columns, names=docs_names)

    docs_names = docs.columns
    return joined.mapInArrow(cut, docs.schema)
