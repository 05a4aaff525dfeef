"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Every rule is a column that says whether a text fails it. On a sample the rules'
verdicts are counted together and each rule is timed, in a job that computes it
several times, less the time of a job without it; the cascade then takes, again and again, the rule that rejects most of the sampled texts still left per second of
its cost. The order becomes one CASE, so that a text pays only for the rules up to
the first it fails. Whether a text is kept does not depend on the order.

Costs are measured, so the order, and with it ``failed_rule`` of a text that fails
several rules, may differ between runs; ``kept`` never does.

Defined cases: a null text counts as empty; an empty text has no words and fails
``few_words``; ties in the order go by name; repeated rows are judged each by
themselves; an empty table keeps the given order of rules and gives no rows; extra
columns are carried, and columns named like the results are replaced.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.runtime import keep, require, require_columns

# Character classes.
BLANKS = r"[\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5
# Texts in the sample on which costs and rejections are measured.
SAMPLE_ROWS = 1_000
# Times a rule is computed on the sample while it is timed, so that its own work outweighs the job's.
TIMED_PASSES = 8
# Seconds of a single pass beside which the job itself counts for little.
LONG_RUN = 2.0


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row."""
    return F.transform(F.array(value), body)[0]


def without(text: Column, characters: str) -> Column:
    return F.regexp_replace(text, characters, "")


def count_of(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(without(text, characters))


def word_array(text: Column) -> Column:
    """Runs of anything but the space and 0x09 to 0x0D."""
    return F.array_remove(F.split(text, BLANKS + "+"), "")


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words that lie in a run of ``window`` words found twice or more. Windows
    are compared by a 64-bit hash; only a text with equal ones sorts them, and
    the places of those found again are counted from one to the next."""
    n = F.size(words)
    hashes = F.transform(F.sequence(F.lit(1), n - (window - 1)), lambda i: F.xxhash64(F.slice(words, i, window)))

    def places(found: Column) -> Column:
        return F.sort_array(F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def again(s: Column) -> Column:
        same = F.filter(s, lambda x, k: F.get(s, k - 1)["h"].eqNullSafe(x["h"]) | F.get(s, k + 1)["h"].eqNullSafe(x["h"]))
        return F.sort_array(F.transform(same, lambda x: x["i"]))

    def covered(at: Column) -> Column:
        gaps = F.transform(at, lambda p, k: F.least(F.lit(window), F.coalesce(F.get(at, k + 1) - p, F.lit(window))))
        return F.aggregate(gaps, F.lit(0), lambda total, x: total + x)

    def repeats(found: Column) -> Column:
        full = let(places(found), lambda s: let(again(s), covered))
        return F.when(F.size(F.array_distinct(found)) == F.size(found), 0).otherwise(full)

    return F.when(n <= window, 0).otherwise(let(hashes, repeats)).cast("long")


def base_features(text: Column) -> dict[str, Column]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a text."""
    filled = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(filled, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counted = let(word_array(filled), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words")))
    return {
        "__words": counted,
        "word_chars": F.length(without(filled, BLANKS)).cast("long"),
        "n_symbols": count_of(filled, SYMBOLS).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
    }


def with_base(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the base counts and ``base_failed``."""
    require_columns(docs, [text], "docs")
    own = [c for c in docs.columns if c not in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")]
    found = docs.select(*own, *[c.alias(n) for n, c in base_features(F.col(text)).items()])
    found = found.withColumns({n: F.col(f"__words.{n}") for n in ("n_words", "n_repeat_words")}).drop("__words")
    return found.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


@dataclass(frozen=True)
class Rule:
    """``fails`` of the text says whether the rule rejects it."""

    name: str
    fails: Callable[[Column], Column]


def _share(part: Column, whole: Column) -> Column:
    return part / F.greatest(whole, F.lit(1))


def _distinct_share(text: Column) -> Column:
    return let(word_array(text), lambda w: _share(F.size(F.array_distinct(w)), F.size(w)))


def _repeated_lines(text: Column) -> Column:
    """Share of lines equal to an earlier one."""
    return let(F.split(text, "\n"), lambda x: _share(F.size(x) - F.size(F.array_distinct(x)), F.size(x)))


# Bounds far from what running text has in any of the usual languages.
RULES = (
    Rule("few_words", lambda t: F.length(without(t, BLANKS)) < 10),
    Rule("symbols", lambda t: count_of(t, SYMBOLS) > 0.03 * F.length(t)),
    Rule("shouting", lambda t: count_of(t, "[A-Z]") > 0.35 * F.length(t)),
    Rule("marks", lambda t: count_of(t, "[!?]") > 0.05 * F.length(t)),
    Rule("digits", lambda t: count_of(t, "[0-9]") > 0.3 * F.length(t)),
    Rule("blanks", lambda t: count_of(t, BLANKS) > 0.5 * F.length(t)),
    Rule("word_length", lambda t: F.length(without(t, BLANKS)) > 25 * (count_of(F.trim(t), BLANKS) + 1)),
    Rule("repeated_lines", lambda t: _repeated_lines(t) > 0.5),
    Rule("few_distinct_words", lambda t: _distinct_share(t) < 0.1),
)


@dataclass(frozen=True)
class Measured:
    name: str
    cost: float  # seconds for the sample
    rejected: float  # share of the texts that reach it in the cascade


def _seconds(sample: DataFrame, value: Column) -> float:
    """Time to compute a value of every sampled text once. The first run also
    compiles; unless it took long, the value is then computed ``TIMED_PASSES``
    times in one job."""
    for passes in (1, TIMED_PASSES):
        often = sample.select("t", F.explode(F.sequence(F.lit(1), F.lit(passes))).alias("i"))
        start = time.perf_counter()
        often.agg(F.sum(value), F.sum("i")).collect()
        spent = time.perf_counter() - start
        if spent > LONG_RUN:
            break
    return spent / passes


def order_rules(
    docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text", sample_rows: int = SAMPLE_ROWS,
    reached: Callable[[DataFrame], DataFrame] | None = None,
) -> list[Measured]:
    """The cascade's order with each rule's measured cost and rejections.
    ``reached`` narrows the sampled rows to those that come to the cascade, so
    what is tested ahead of it is computed for the sample alone."""
    require(len({r.name for r in rules}) == len(rules), "rules need distinct names")
    require(len(rules) <= 30, "at most 30 rules are ordered")
    total = docs.count()
    if not total:
        return [Measured(r.name, 0.0, 0.0) for r in rules]
    # Bounded by the sample's size, whatever the table's; twice as many are drawn as are wanted.
    drawn = keep(docs.sample(fraction=min(1.0, 2 * sample_rows / total), seed=11).limit(2 * sample_rows))
    left_over = reached(drawn) if reached else drawn
    sample = keep(left_over.select(F.coalesce(F.col(text), F.lit("")).alias("t")).limit(sample_rows).coalesce(1))
    bits = sum((F.when(r.fails(F.col("t")), F.lit(1 << i)).otherwise(0) for i, r in enumerate(rules)), F.lit(0))
    patterns = [(r["bits"], r["n"]) for r in sample.groupBy(bits.alias("bits")).agg(F.count(F.lit(1)).alias("n")).collect()]
    idle = _seconds(sample, F.length("t"))
    costs = {r.name: max(1e-5, _seconds(sample, r.fails(F.col("t")).cast("int")) - idle) for r in rules}
    left, out = dict(enumerate(rules)), []
    while left:
        reach = sum(n for _, n in patterns) or 1
        rejected = {i: sum(n for b, n in patterns if b >> i & 1) / reach for i in left}
        best = min(left, key=lambda i: (-rejected[i] / costs[left[i].name], left[i].name))
        out.append(Measured(left[best].name, costs[left[best].name], rejected[best]))
        patterns = [(b, n) for b, n in patterns if not b >> best & 1]
        del left[best]
    return out


def cascade(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text", order: Sequence[str] | None = None, passed: Column | None = None) -> DataFrame:
    """Add ``failed_rule`` (null if none) and ``kept``. Where ``passed`` is false
    no rule is evaluated and the text is not kept. Without an ``order`` it is
    measured on the rows that pass."""
    require_columns(docs, [text], "docs")
    named = {r.name: r for r in rules}
    order = order or [m.name for m in order_rules(docs, rules, text, reached=None if passed is None else lambda d: d.where(passed))]
    filled = F.coalesce(F.col(text), F.lit(""))
    ahead = F.lit(True) if passed is None else passed
    chain = F.when(~ahead, F.lit("base"))
    for name in order:
        chain = chain.when(named[name].fails(filled), F.lit(name))
    own = [c for c in docs.columns if c not in ("failed_rule", "kept")]
    judged = docs.select(*own, chain.alias("failed_rule"))
    return judged.withColumn("kept", F.col("failed_rule").isNull())
