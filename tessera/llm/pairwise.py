"""Quality scores by Bradley-Terry ranking of document pairs.

A document has a score w . x of its features; that a good document is preferred to
a bad one has the probability sigmoid(w . (x_good - x_bad)). The weights are learnt
by logistic loss on feature differences of labelled pairs, without an intercept, as
any constant cancels. The threshold is a quantile of the scores: the one below which
the labelled texts hold as many documents as the labels call bad. Scores are then
mapped to 0 to 1 so that the threshold falls on 0.7.

Defined cases: a null or empty text has all features 0; an infinite or missing
feature cannot arise, as every ratio's divisor is at least 1; repeated rows are
scored each by themselves; without labelled texts of both kinds all weights are 0
and all documents sit on the threshold; extra columns are carried, and columns named
like the results are replaced. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.labelled import as_vector, labelled_ids, sigmoid
from tessera.llm.words import Words, inside, slices, spaced_words, windows, words_of
from tessera.operators.order import number_rows, running_sums
from tessera.runtime import keep, require_columns

PARTNERS = 4
THRESHOLD = 0.7
FEATURES = (
    "log_words", "word_length", "symbols", "marks", "upper", "digits", "stops", "diversity", "repeated_runs", "line_repeats",
    "symbols_any", "marks_any", "upper_much", "longest_word", "short",
)

_ALPHABET = spaced_words()


def _flags(characters: str | bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(characters.encode() if isinstance(characters, str) else characters)] = True
    return out


_SYMBOLS, _MARKS = _flags("#*$%&|<>{}[]\\^~_=+"), _flags("!?")
_UPPER, _DIGITS, _STOPS = _flags(bytes(range(65, 91))), _flags("0123456789"), _flags(".,;:")


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags)])
    return (total[offsets[1:]] - total[offsets[:-1]]).astype(float)


def _distinct(values: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """Different values per text."""
    if not len(values):
        return np.zeros(n)
    order = np.lexsort((values, text))
    v, t = values[order], text[order]
    new = np.concatenate([[True], (v[1:] != v[:-1]) | (t[1:] != t[:-1])])
    return np.bincount(t[new], minlength=n).astype(float)


def _lines(words: Words, raw: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word per text, and the different ones by their words."""
    if not len(words.starts):
        return np.zeros(n), np.zeros(n)
    text = words.text_of()
    breaks = np.cumsum(raw == 10)
    line = breaks[words.starts]
    new = np.concatenate([[True], (line[1:] != line[:-1]) | (text[1:] != text[:-1])])
    at = np.flatnonzero(new)
    with np.errstate(over="ignore"):
        # The position within the line enters, so that the order of words counts.
        place = np.arange(len(line)) - np.repeat(at, np.diff(np.append(at, len(line))))
        sums = np.add.reduceat(words.hashes * (2 * place.astype(np.uint64) + np.uint64(1)), at)
    return np.bincount(text[at], minlength=n).astype(float), _distinct(sums, text[at], n)


def features_of(texts: pa.Array) -> np.ndarray:
    """One row per text: see FEATURES."""
    raw = pa.array(texts).cast(pa.large_binary())
    words = words_of(raw, _ALPHABET)
    n = len(words.first) - 1
    buffer = raw.buffers()[2]
    ends = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(buffer, np.uint8)[ends[0] : ends[-1]] if buffer is not None else np.zeros(0, np.uint8)
    count = words.counts.astype(float)
    some, text = np.maximum(count, 1.0), words.text_of()
    sizes = words.ends - words.starts
    letters = np.bincount(text, weights=sizes, minlength=n)
    longest = np.zeros(n)
    np.maximum.at(longest, text, sizes)
    symbols, marks, upper, digits, stops = (_per_text(f[data], words.offsets) / d for f, d in (
        (_SYMBOLS, some), (_MARKS, some), (_UPPER, np.maximum(letters, 1.0)), (_DIGITS, np.maximum(letters, 1.0)), (_STOPS, some)))
    kinds = _distinct(words.hashes, text, n)
    runs, fits = windows(words.hashes, 5), inside(words, 5)
    run_text = text[: len(runs)][fits]
    n_runs = np.bincount(run_text, minlength=n).astype(float)
    lines, own_lines = _lines(words, data, n)
    missing = count == 0
    out = np.column_stack([
        np.log1p(count) / 5.0, np.minimum(letters / some, 20.0) / 5.0, np.minimum(symbols, 1.0), np.minimum(marks, 1.0), upper, digits, np.minimum(stops, 1.0),
        np.log1p(kinds) / np.log1p(some), 1.0 - _distinct(runs[fits], run_text, n) / np.maximum(n_runs, 1.0) * (n_runs > 0) - (n_runs == 0),
        1.0 - own_lines / np.maximum(lines, 1.0), np.minimum(symbols * 10.0, 1.0), np.minimum(marks * 5.0, 1.0), (upper > 0.3) * 1.0,
        np.minimum(np.log1p(longest) / 5.0, 2.0), (count < 10) * 1.0,
    ])
    out[missing] = 0.0
    return out


def with_features(docs: DataFrame, text: str = "text", name: str = "features") -> DataFrame:
    """Add the array of FEATURES of each text."""
    require_columns(docs, [text], "docs")
    carried = docs.drop(name)
    at = carried.columns.index(text)
    schema = T.StructType([*carried.schema.fields, T.StructField(name, T.ArrayType(T.DoubleType()))])

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                found = features_of(part.column(at))
                made = pa.ListArray.from_arrays(pa.array(np.arange(0, found.size + 1, len(FEATURES), dtype=np.int32)), pa.array(found.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns, made], names=schema.names)

    return carried.mapInArrow(scan, schema)


@dataclass(frozen=True)
class PairwiseModel:
    weights: tuple[float, ...]
    threshold: float  # of the raw score

    def raw(self, features: Column) -> Column:
        total = F.lit(0.0)
        for i, w in enumerate(self.weights):
            total = total + w * features[i]
        return total

    def score(self, features: Column) -> Column:
        return sigmoid(self.raw(features) - self.threshold + math.log(THRESHOLD / (1.0 - THRESHOLD)))


def preference_pairs(good: DataFrame, bad: DataFrame, partners: int = PARTNERS) -> DataFrame:
    """Differences x of features, good minus bad, each text of the larger side
    with ``partners`` of the other: the numbers of the two sides meet by their
    remainder, so the pairs stay ``partners`` times the larger side."""
    n_good, n_bad = good.count(), bad.count()
    wide, narrow = (good, bad) if n_good >= n_bad else (bad, good)
    few = max(1, min(n_good, n_bad))
    left = wide.select(F.col("i"), F.col("features").alias("a"), F.explode(F.sequence(F.lit(0), F.lit(partners - 1))).alias("turn"))
    left = left.withColumn("j", F.pmod(F.xxhash64("i", "turn"), F.lit(few)))
    joined = left.join(narrow.select(F.col("i").alias("j"), F.col("features").alias("b")), "j")
    first, second = ("a", "b") if n_good >= n_bad else ("b", "a")
    # Half of the pairs are turned round, as both orders say the same.
    turned = F.xxhash64("i", "turn", F.lit("side")) % 2 == 0
    minus = F.zip_with(first, second, lambda x, y: x - y)
    return joined.select(
        F.when(turned, F.transform(minus, lambda x: -x)).otherwise(minus).alias("x"), F.when(turned, 0.0).otherwise(1.0).alias("label")
    )


def learn_quality(
    docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text", learnable: Column | None = None,
) -> PairwiseModel:
    """Weights and threshold from all different labelled texts. Only features are
    shuffled, no texts; a text that has both labels counts by the larger."""
    from pyspark.ml.classification import LogisticRegression

    ids = labelled_ids(labels, label, doc_id, learnable)
    texts = with_features(docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("text")).where("__id IS NOT NULL AND text IS NOT NULL"))
    featured = texts.select("__id", "features", F.xxhash64("text").alias("h"))
    known = featured.join(ids.select(F.col(doc_id).alias("__id"), "label"), "__id")
    # Equal texts have equal features, so any copy's will do.
    found = keep(known.groupBy("h").agg(F.first("features").alias("features"), F.max("label").alias("label")))
    sizes = {r["label"]: r["n"] for r in found.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not {0, 1} <= set(sizes):
        return PairwiseModel((0.0,) * len(FEATURES), 0.0)
    numbered = number_rows(found.where("label IN (0, 1)"), ["label"], [F.col("h")], "i", hot=True).withColumn("i", F.col("i") - 1)
    numbered = keep(numbered.select("label", "features", "i"))
    pairs = keep(preference_pairs(numbered.where("label = 1"), numbered.where("label = 0")))
    vector = as_vector([F.col("x")[i] for i in range(len(FEATURES))])
    fitted = LogisticRegression(fitIntercept=False, regParam=1e-4, maxIter=200).setFeaturesCol("v").fit(pairs.select(vector.alias("v"), "label"))
    model = PairwiseModel(tuple(float(w) for w in fitted.coefficients), 0.0)
    counted = {r["label"]: r["n"] for r in ids.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    weight = {k: counted[k] / sizes[k] for k in (0, 1)}
    return PairwiseModel(model.weights, _threshold(numbered.select(model.raw(F.col("features")).alias("s"), "label"), weight))


def _threshold(scored: DataFrame, weight: dict[int, float]) -> float:
    """The middle between the scores ``s`` on both sides of the place below which
    as much lies as is labelled bad, each text counting by its label's ``weight``."""
    both = {"n0": F.count_if(F.col("label") == 0), "n1": F.count_if(F.col("label") == 1)}
    values = keep(scored.groupBy("s").agg(*[c.alias(n) for n, c in both.items()]))
    ranked = running_sums(values, [], [F.col("s")], {"u0": "n0", "u1": "n1"}, hot=True)
    bad = values.agg(F.sum("n0")).first()[0] * weight[0]
    below = F.col("u0") * weight[0] + F.col("u1") * weight[1] <= bad * (1.0 + 1e-12)
    ends = ranked.agg(F.max(F.when(below, F.col("s"))).alias("a"), F.min(F.when(~below, F.col("s"))).alias("b")).first()
    low, high = (ends["a"] if ends["a"] is not None else ends["b"]), (ends["b"] if ends["b"] is not None else ends["a"])
    return (low + high) / 2.0


def score_quality(docs: DataFrame, model: PairwiseModel, text: str = "text") -> DataFrame:
    """Add ``score`` and ``predicted``."""
    own = [c for c in docs.columns if c not in ("score", "predicted")]
    scored = with_features(docs.select(*own), text, "__features").withColumn("score", model.score(F.col("__features")))
    return scored.select(*own, "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
