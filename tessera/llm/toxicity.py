"""Toxicity scores from a lexicon matched with spelling errors, in context.

Words are matched by one deterministic automaton: the Levenshtein automata of all
lexicon terms, intersected with the trie of the terms by running both together. A
term of up to 4 bytes must match exactly, one of 5 to 8 allows one insertion,
deletion, substitution or swap, a longer one two. A term that ends in ``*`` is a stem:
it matches every word that begins with it. The automaton walks all words of a slice at
once, and words leave at the first byte that fits no term.

A hit is weighed by its context window: other hits close by add to it, quotation
marks around it and verbs of reporting near it mark it as quoted. Sums over the hits
of a text are the features of a logistic regression. The lexicon is learnt from
labelled texts: words much commoner in toxic ones, and stems of which toxic texts hold
several words and others hardly ever do, besides a few seed terms.

Defined cases: a null or empty text has no words and gets the score of a text
without hits, which is below 0.5;
repeated rows are scored each by themselves; ties between terms go to the smaller
number of errors, then to the first term; extra columns are carried, and columns
named like the results are replaced. An empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.labelled import as_vector, labelled_sample, sigmoid
from tessera.llm.words import Words, item_words, slices, words_of
from tessera.runtime import bounded_batches, require, require_columns

# Terms known without labels.
SEEDS = ("idiot", "moron", "stupid", "scum", "loser", "worthless", "disgusting", "pathetic", "trash", "retard", "bastard", "bitch", "whore", "slut", "asshole", "fucker")
# Verbs of reporting, in the languages of the corpus.
REPORTING = ("said", "says", "called", "quoted", "wrote", "sagte", "nannte", "schrieb", "dit", "appelé", "écrit", "dijo", "llamó", "escribió")
QUOTES = tuple(c.encode() for c in "\"“”„«»‘’")

MAX_TERMS = 200
CONTEXT = 10
SAMPLE_ROWS = 3_000
FEATURES = ("exact", "misspelt", "stems", "quoted", "density", "terms", "stem_rate")

_ALPHABET = item_words()


def errors_allowed(term: bytes) -> int:
    return 0 if len(term) <= 4 or term.endswith(b"*") else 1 if len(term) <= 8 else 2


@dataclass
class Matcher:
    """``step[state, class]`` is the next state, 0 none; ``term`` and ``errors``
    tell what a word that ends in a state matches, -1 nothing; ``open`` is the
    stem that any word matches once it has come to a state."""

    terms: Sequence[bytes]
    step: np.ndarray = field(init=False)
    classes: np.ndarray = field(init=False)
    term: np.ndarray = field(init=False)
    errors: np.ndarray = field(init=False)
    open: np.ndarray = field(init=False)
    reach: int = field(init=False)

    def __post_init__(self) -> None:
        require(len(self.terms) <= MAX_TERMS, f"at most {MAX_TERMS} terms")
        stems = [t.endswith(b"*") for t in self.terms]
        spelt = [t.rstrip(b"*") for t in self.terms]
        letters = sorted({c for t in spelt for c in t})
        self.classes = np.zeros(256, np.uint8)
        for i, c in enumerate(letters):
            self.classes[c] = i + 1
        self.reach = max((len(t) + errors_allowed(t) for t in self.terms), default=0)
        # The trie holds, per node, its children, its term and the most errors below it.
        children: list[dict[int, int]] = [{}]
        ends, most = [-1], [0]
        begun: dict[int, int] = {}
        for k, t in enumerate(spelt):
            node = 0
            for c in t:
                node = children[node].setdefault(c, len(children))
                if node == len(children):
                    children.append({})
                    ends.append(-1)
                    most.append(0)
                most[node] = max(most[node], errors_allowed(self.terms[k]))
            if stems[k]:
                begun[node] = k
            else:
                ends[node] = k
        most[0] = max(most)
        # One place more per stem, which no byte leaves.
        read = {n: -1 - k for n, k in begun.items()}

        def closed(places: dict[tuple[int, int], int]) -> frozenset:
            """Add the deletions; drop places with more errors than their twins."""
            queue = list(places.items())
            while queue:
                (node, swap), e = queue.pop()
                if node < 0 or swap or places.get((node, swap), e) < e:
                    continue
                for child in children[node].values():
                    if e < most[child] and places.get((child, 0), 99) > e + 1:
                        places[child, 0] = e + 1
                        queue.append(((child, 0), e + 1))
            return frozenset((n, s, e) for (n, s), e in places.items())

        def after(state: frozenset, c: int | None) -> frozenset:
            out: dict[tuple[int, int], int] = {}

            def put(node: int, swap: int, e: int) -> None:
                if e <= most[node] and out.get((node, swap), 99) > e:
                    out[node, swap] = e

            for node, swap, e in state:
                if node < 0:
                    out[node, 0] = 0
                    continue
                if swap:  # the second byte of a swap must be the one skipped
                    if (swap, c) in swapped[node]:
                        put(swapped[node][swap, c], 0, e)
                    continue
                put(node, 0, e + 1)  # a byte too many
                for b, child in children[node].items():
                    put(child, 0, e if b == c else e + 1)
                    if b == c and e == 0 and child in read:
                        out[read[child], 0] = 0
                if c is not None:
                    for b, child in children[node].items():
                        if b != c and c in children[child]:
                            put(node, c, e + 1)
            return closed(out)

        # From a node, reading ``first`` then ``second`` where the term has them swapped.
        swapped = [{(c, b): grand for b, child in kids.items() for c, grand in children[child].items()} for kids in children]
        start = closed({(0, 0): 0})
        number: dict[frozenset, int] = {frozenset(): 0, start: 1}
        states, rows = [frozenset(), start], []
        for state in states:  # grows while it is read
            row = []
            for c in [None, *letters]:
                new = after(state, c) if state else frozenset()
                if new not in number:
                    number[new] = len(states)
                    states.append(new)
                row.append(number[new])
            rows.append(row)
        self.step = np.array(rows, np.int32).reshape(len(states), len(letters) + 1)
        best = [min(((e, ends[n]) for n, s, e in state if n >= 0 and not s and ends[n] >= 0 and e <= errors_allowed(self.terms[ends[n]])), default=(-1, -1)) for state in states]
        self.errors = np.array([b[0] for b in best], np.int8)
        self.open = np.array([min((-1 - n for n, _, _ in state if n < 0), default=-1) for state in states], np.int16)
        self.term = np.array([b[1] for b in best], np.int16)
        ended = self.term < 0
        self.errors[ended & (self.open >= 0)] = 0
        self.term[ended] = self.open[ended]

    def run(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which words match, their term and the number of errors."""
        sizes = words.ends - words.starts
        live = np.arange(len(sizes))
        state = np.ones(len(live), np.int32)
        done_words, done_states = [], []
        depth = 0
        while len(live):
            over = sizes[live] == depth
            if depth > self.reach:  # only a stem matches so long a word
                live, state = live[self.open[state] >= 0], state[self.open[state] >= 0]
                done_words.append(live)
                done_states.append(state)
                break
            if over.any():
                done_words.append(live[over])
                done_states.append(state[over])
                live, state = live[~over], state[~over]
            state = self.step[state, self.classes[words.data[words.starts[live] + depth]]]
            live, state = live[state > 0], state[state > 0]
            depth += 1
        at = np.concatenate(done_words) if done_words else np.zeros(0, np.int64)
        ended = np.concatenate(done_states) if done_states else np.zeros(0, np.int32)
        hit = self.term[ended] >= 0
        order = np.argsort(at[hit], kind="stable")
        at, ended = at[hit][order], ended[hit][order]
        return at, self.term[ended], self.errors[ended]


def _features(words: Words, matcher: Matcher, reporting: np.ndarray) -> np.ndarray:
    """One row per text: see FEATURES."""
    n = len(words.first) - 1
    out = np.zeros((n, len(FEATURES)))
    at, term, errors = matcher.run(words)
    if not len(at):
        return out
    text = np.searchsorted(words.first, at, side="right") - 1
    lo, hi = np.maximum(words.first[text], at - CONTEXT), np.minimum(words.first[text + 1], at + CONTEXT + 1)
    near = np.searchsorted(at, hi) - np.searchsorted(at, lo) - 1
    for k in range(len(at)):
        i = at[k]
        before = words.data[words.starts[lo[k]] : words.starts[i]].tobytes()
        after = words.data[words.ends[i] : words.ends[hi[k] - 1]].tobytes()
        # Bytes just outside the outermost words may hold the marks, too.
        before = words.data[max(words.offsets[text[k]], words.starts[lo[k]] - 4) : words.starts[lo[k]]].tobytes() + before
        after += words.data[words.ends[hi[k] - 1] : min(words.offsets[text[k] + 1], words.ends[hi[k] - 1] + 4)].tobytes()
        marked = any(q in before for q in QUOTES) and any(q in after for q in QUOTES)
        told = bool(np.isin(words.hashes[lo[k] : hi[k]], reporting).any())
        quoted = marked or told
        weight = (1.0 + 0.5 * min(near[k], 4)) / (1.0 + errors[k])
        row = out[text[k]]
        stem = matcher.terms[term[k]].endswith(b"*")
        if stem:
            row[2] += 1.0
        else:
            row[3 if quoted else 1 if errors[k] else 0] += weight
            row[4] = max(row[4], 0.0 if quoted else min(near[k], 4) / 4.0)
    pairs = np.unique(text * (len(matcher.terms) + 1) + term)
    np.add.at(out[:, 5], pairs // (len(matcher.terms) + 1), 1.0)
    out[:, 6] = 100.0 * out[:, 2] / (words.counts + 50.0)
    return np.log1p(out)


@dataclass(frozen=True)
class ToxicityModel:
    terms: tuple[str, ...]
    weights: tuple[float, ...]
    bias: float

    def score(self, features: Column) -> Column:
        total = F.lit(self.bias)
        for i, w in enumerate(self.weights):
            total = total + w * features[i]
        # Whatever the labels' shares, a text without a hit is not called toxic.
        return F.when(F.array_max(features) > 0, sigmoid(total)).otherwise(F.least(sigmoid(total), F.lit(0.499)))


def context_features(docs: DataFrame, terms: Sequence[str], text: str = "text", name: str = "features") -> DataFrame:
    """Add the array of FEATURES of each text."""
    require_columns(docs, [text], "docs")
    spark = docs.sparkSession
    bounded_batches(spark)
    matcher = Matcher([t.lower().encode() for t in terms])
    known = words_of(pa.array([w.encode() for w in REPORTING], pa.binary()), _ALPHABET)
    shared = spark.sparkContext.broadcast((matcher, known.hashes))  # bounded by MAX_TERMS
    carried = docs.drop(name)
    schema = T.StructType([*carried.schema.fields, T.StructField(name, T.ArrayType(T.DoubleType()))])
    at = carried.columns.index(text)

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher, reporting = shared.value
        for batch in batches:
            for part in slices(batch, text):
                found = _features(words_of(part.column(at), _ALPHABET), matcher, reporting)
                made = pa.ListArray.from_arrays(pa.array(np.arange(0, found.size + 1, len(FEATURES), dtype=np.int32)), pa.array(found.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns, made], names=schema.names)

    return carried.mapInArrow(scan, schema)


def learn_lexicon(sample: DataFrame, most: int = MAX_TERMS) -> list[str]:
    """At most ``most`` terms: words in a twentieth of the toxic texts and 20
    times as common there as in the others; and stems, with ``*``, of which a
    hundredth of the toxic texts hold two different words or more, 8 times as
    many as of the others. Of stems within each other the best one stays."""
    schema = T.StructType([T.StructField("word", T.StringType()), T.StructField("label", T.IntegerType())])

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = words_of(part.column(0), _ALPHABET)
                words, labels = [], []
                for d, label in enumerate(part.column(1).to_pylist()):
                    spelt = {found.data[found.starts[i] : found.ends[i]].tobytes() for i in range(found.first[d], found.first[d + 1])}
                    plain = [w.decode("utf-8", "replace") for w in spelt if 4 <= len(w) <= 24]
                    plain = [w for w in plain if w.isalpha()]
                    begun = Counter(w[:k] for w in plain for k in range(3, min(len(w), 9)))
                    plain += [f"{w}*" for w, n in begun.items() if n >= 2]
                    words += plain
                    labels += [label] * len(plain)
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(labels, pa.int32())], names=schema.names)

    sizes = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    bad, good = sizes.get(1, 0), sizes.get(0, 0)
    if not bad or not good:
        return []
    seen = sample.select("text", "label").mapInArrow(cut, schema).groupBy("word").agg(F.sum("label").alias("a"), F.sum(1 - F.col("label")).alias("b"))
    stem = F.col("word").endswith("*")
    share, other = F.col("a") / bad, (F.col("b") + 0.5) / (good + 1.0)
    chosen = seen.where(
        (F.col("a") >= 5) & (share >= F.when(stem, 0.01).otherwise(0.05)) & (share >= F.when(stem, 8.0).otherwise(20.0) * other)
    )
    worth = F.col("a") * F.log(share / other)
    best = chosen.withColumn("worth", worth).orderBy(F.desc("worth"), F.length("word"), "word").limit(8 * most).collect()
    terms: list[str] = [r["word"] for r in best if not r["word"].endswith("*")][:most]
    roots: list[str] = []
    for root in (r["word"][:-1] for r in best if r["word"].endswith("*")):
        # Words found already, and stems of or in a chosen stem, add nothing.
        if not any(x.startswith(root) or root.startswith(x) for x in roots) and not any(t.startswith(root) for t in terms):
            roots.append(root)
    return [*terms, *[f"{r}*" for r in roots]][:most]


def learn_toxicity(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", doc_id: str = "doc_id", text: str = "text", rows: int = SAMPLE_ROWS,
    learnable: Column | None = None, seeds: Sequence[str] = SEEDS,
) -> ToxicityModel:
    """Lexicon and weights from at most ``rows`` different labelled texts of each
    kind, each weighed so that the kinds count as they do among the labels.
    Without texts of both kinds the seeds alone count, by fixed weights."""
    from pyspark.ml.classification import LogisticRegression

    sample = labelled_sample(docs, labels, label, rows, doc_id, text, learnable)
    terms = tuple(dict.fromkeys([*seeds, *learn_lexicon(sample, most=MAX_TERMS - len(seeds))]))
    if sample.select("label").distinct().count() < 2:
        return ToxicityModel(terms, (2.0, 1.0, 0.5, 0.2, 1.0, 1.0, 0.0), -2.5)
    vector = as_vector([F.col("features")[i] for i in range(len(FEATURES))])
    found = context_features(sample, terms).select(vector.alias("x"), F.col("label").cast("double").alias("label"), F.col("weight").alias("w"))
    fitted = LogisticRegression(featuresCol="x", labelCol="label", weightCol="w", regParam=1e-4, maxIter=200).fit(found)
    return ToxicityModel(terms, tuple(float(w) for w in fitted.coefficients), float(fitted.intercept))


def score_toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """Add ``score`` and ``predicted``."""
    own = [c for c in docs.columns if c not in ("score", "predicted")]
    found = context_features(docs.select(*own), model.terms, text, "__features")
    scored = found.withColumn("score", model.score(F.col("__features")))
    return scored.select(*own, "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def remove_toxic(docs: DataFrame, model: ToxicityModel, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The documents below the threshold, all columns as they are."""
    found = context_features(docs, model.terms, text, "__features")
    return found.where(model.score(F.col("__features")) < threshold).drop("__features")
