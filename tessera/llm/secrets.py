"""Secret scans: fixed patterns, and character Markov models for what they miss.

Two first-order Markov chains over characters are trained from labelled samples,
one on random strings, one on ordinary words and identifiers. A candidate is a run
of at least ``MIN_LENGTH`` characters of the usual secret alphabet with a letter and
a digit; it is a secret if the log-likelihood ratio of the two chains exceeds
``THRESHOLD``, the log of the prior odds of ordinary against random ones. Everything
on the way is a DataFrame function: places come from the lengths of the pieces
between matches, and the chains are one array of ratios by character pair.

Defined cases: a null text counts as empty and has no spans; equal texts get equal
spans; characters outside the alphabet end a candidate; repeated rows are scanned
each by themselves; an empty table gives no rows; a training set without samples of
a class leaves that chain uniform. Extra columns are carried; columns named like the
results are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.rules import let
from tessera.runtime import require_columns

# Fixed patterns, in their order.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
BASE_KINDS = ("assign", "access", "hex")

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_.=-"
MIN_LENGTH = 20
CANDIDATE = rf"[A-Za-z0-9+/_.=-]{{{MIN_LENGTH},}}"
THRESHOLD = math.log(1e6)
# Texts from which ordinary words are taken, and random strings of each make.
SAMPLE_TEXTS = 500
SAMPLE_STRINGS = 500

_CHUNK = 512
_SIDE = len(ALPHABET) + 1


def _starts(lengths: Column) -> Column:
    """Sums of what comes before each element, in chunks so that the work stays
    near linear for texts with very many matches."""

    def before(xs: Column) -> Column:
        zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("out"))
        return F.aggregate(xs, zero, lambda a, x: F.struct((a["at"] + x).alias("at"), F.array_append(a["out"], a["at"]).alias("out")))["out"]

    def total(xs: Column) -> Column:
        return F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x)

    n = F.size(lengths)
    chunks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / _CHUNK).cast("int")), lambda c: F.slice(lengths, c * _CHUNK + 1, _CHUNK))
    whole = let(chunks, lambda cs: F.flatten(F.zip_with(cs, before(F.transform(cs, total)), lambda c, b: F.transform(before(c), lambda y: y + b))))
    return F.when(n == 0, F.array().cast("array<bigint>")).otherwise(whole)


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """Leftmost matches that do not overlap: start and end in code points, end
    exclusive, and the group's text. The pieces between the matches give their
    places; texts without a match are left at one look."""
    found = F.struct(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("v"),
        F.split(text, pattern, -1).alias("p"),
    )

    def placed(f: Column) -> Column:
        step = F.zip_with(f["p"], F.concat(F.array(F.lit("")), f["m"]), lambda p, m: (F.length(p) + F.length(m)).cast("long"))
        # Before match i lie pieces 0..i and matches 0..i-1, which are steps 0..i.
        ends_of_pieces = let(step, lambda s: F.zip_with(_starts(s), s, lambda a, b: a + b))
        rows = let(ends_of_pieces, lambda e: F.transform(f["m"], lambda m, i: F.struct(
            F.get(e, i).alias("start"), (F.get(e, i) + F.length(m)).alias("end"), F.get(f["v"], i).alias("value"))))
        return rows

    none = F.array().cast("array<struct<start:bigint,end:bigint,value:string>>")
    return F.when(text.rlike(pattern), let(found, placed)).otherwise(none)


def _tagged(found: Column, kind: str, order: int) -> Column:
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(order).alias("k"), F.lit(kind).alias("kind"), x["end"].alias("end")))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def training_samples(docs: DataFrame, text: str = "text", texts: int = SAMPLE_TEXTS, strings: int = SAMPLE_STRINGS) -> DataFrame:
    """Labelled samples (value, random): all words of at most ``texts`` different texts (those
    of smallest hash), alone and joined as identifiers are, dates and numbers; and ``strings``
    random strings of each usual make."""
    require_columns(docs, [text], "docs")
    hashed = docs.select(F.col(text).alias("t"), F.xxhash64(text).alias("h")).where("t IS NOT NULL")
    # The hashes alone find the cut, so no task gathers more texts than are wanted.
    last = hashed.select("h").distinct().orderBy("h").limit(texts).agg(F.max("h").alias("h")).first()["h"]
    chosen = hashed.where(F.col("h") <= F.lit(last).cast("long")).dropDuplicates(["h"])
    words = F.filter(F.split("t", "[^A-Za-z]+"), lambda w: F.length(w) >= 2)
    pairs = chosen.select(words.alias("w")).where("size(w) > 1").select(F.explode(F.arrays_zip(F.slice("w", 1, F.size("w") - 1).alias("a"), F.slice("w", 2, F.size("w") - 1).alias("b"))).alias("x"))
    a, b = F.col("x.a"), F.col("x.b")
    joined = F.array(a, F.concat_ws("_", a, b), F.concat_ws("-", a, b), F.concat_ws(".", a, b), F.concat_ws("/", a, b), F.concat(a, F.initcap(b)), F.upper(F.concat_ws("_", a, b)), F.concat(a, F.lit("1"), b))
    ordinary = pairs.select(F.explode(joined).alias("value"), F.lit(False).alias("random"))
    spark = docs.sparkSession
    moment = F.timestamp_seconds(F.col("id") * 7_654_321 + 1_000_000_007)
    dated = F.array(F.date_format(moment, "yyyy-MM-dd'T'HH-mm-ss.SSS"), F.date_format(moment, "yyyyMMdd'T'HHmmss'Z'"), F.concat(F.lit("v"), F.date_format(moment, "H.m.s-yyyy")), F.concat(F.lit("id-"), F.col("id") * 7_654_321))
    ordinary = ordinary.unionByName(spark.range(strings).select(F.explode(dated).alias("value"), F.lit(False).alias("random")))
    seeds = spark.range(strings).select(F.sha2(F.concat(F.lit("random"), F.col("id")), 256).alias("h"))
    coded = F.base64(F.unhex("h"))
    made = F.array(F.col("h"), coded, F.upper(F.translate(coded, "+/=", "AZ")), F.translate(coded, "+/=", "-_"))
    return ordinary.unionByName(seeds.select(F.explode(made).alias("value"), F.lit(True).alias("random")))


def markov_ratios(samples: DataFrame, value: str = "value", random: str = "random") -> list[float]:
    """log P(next | character) under random minus under ordinary, by
    ``place * side + place of the next``; place 0 is any other character. Only
    the pair counts, at most two of each of the alphabet's pairs, are collected."""
    require_columns(samples, [value, random], "samples")
    steps = F.transform(F.sequence(F.lit(1), F.length(value) - 1), lambda i: _pair(F.col(value), i))
    pairs = samples.where(F.length(value) >= 2).select(random, F.explode(steps).alias("pair"))
    counts = {True: [1.0] * _SIDE**2, False: [1.0] * _SIDE**2}
    for row in pairs.groupBy(random, "pair").agg(F.count(F.lit(1)).alias("n")).where(F.col(random).isNotNull()).collect():
        counts[row[random]][row["pair"]] += row["n"]
    out = []
    for i in range(_SIDE):
        rows = {k: c[i * _SIDE : (i + 1) * _SIDE] for k, c in counts.items()}
        sums = {k: sum(r) for k, r in rows.items()}
        out += [math.log(rows[True][j] / sums[True]) - math.log(rows[False][j] / sums[False]) for j in range(_SIDE)]
    return out


def _place(c: Column) -> Column:
    return F.call_function("locate", c, F.lit(ALPHABET))


def _pair(value: Column, i: Column) -> Column:
    return _place(F.substring(value, i, 1)) * _SIDE + _place(F.substring(value, i + 1, 1))


def log_ratio(value: Column, ratios: Sequence[float]) -> Column:
    """How much likelier the value is as a random string, in nats."""
    # One string literal, which the optimizer folds into one array.
    table = F.split(F.lit(",".join(repr(float(x)) for x in ratios)), ",").cast("array<double>")
    steps = F.sequence(F.lit(1), F.length(value) - 1)
    total = F.aggregate(steps, F.lit(0.0), lambda a, i: a + F.get(table, _pair(value, i)))
    return F.when(F.length(value) < 2, 0.0).otherwise(total)


def secret_spans(docs: DataFrame, text: str = "text", ratios: Sequence[float] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Add n_assign, n_access, n_hex, base_sha256, spans (text) and found: all
    spans as structs of start, k, kind and end, in order."""
    require_columns(docs, [text], "docs")
    ratios = ratios if ratios is not None else markov_ratios(training_samples(docs, text))
    filled = F.coalesce(F.col(text), F.lit(""))
    assign = F.filter(matches(filled, ASSIGN, 2), lambda x: F.length(x["value"]) >= 6)

    def odd(x: Column) -> Column:
        value = x["value"]
        mixed = value.rlike("[0-9]") & value.rlike("[A-Za-z]")
        return F.when(mixed, log_ratio(value, ratios) > threshold).otherwise(False)

    own = [c for c in docs.columns if c not in ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "found")]
    first = docs.select(
        *own, _tagged(assign, "assign", 0).alias("__a"), _tagged(matches(filled, ACCESS), "access", 1).alias("__c"), _tagged(matches(filled, HEX), "hex", 2).alias("__h"),
        F.filter(matches(filled, CANDIDATE), odd).alias("__m"),
    )
    assigned = F.transform("__a", lambda x: x["end"])
    known = F.transform(F.concat("__c", "__h"), lambda x: F.struct(x["start"], x["end"]))
    new = let(assigned, lambda ends: let(known, lambda ks: F.filter(
        "__m", lambda x: ~F.array_contains(ends, x["end"]) & ~F.exists(ks, lambda k: (k["start"] == x["start"]) & (k["end"] == x["end"])))))
    # A candidate that only spells out a fixed pattern's match is that match.
    spans = first.withColumn("__base", F.sort_array(F.concat("__a", "__c", "__h"))).withColumn("found", F.sort_array(F.concat("__base", _tagged(new, "markov", 3))))
    return spans.select(
        *own, F.size("__a").cast("long").alias("n_assign"), F.size("__c").cast("long").alias("n_access"), F.size("__h").cast("long").alias("n_hex"),
        F.sha2(_listed(F.col("__base")), 256).alias("base_sha256"), _listed(F.col("found")).alias("spans"), "found",
    )


def redact(docs: DataFrame, text: str = "text", ratios: Sequence[float] | None = None, mask: str = "[SECRET]", threshold: float = THRESHOLD) -> DataFrame:
    """The documents with the same columns, each run of overlapping spans in the
    text replaced by ``mask``."""
    own = docs.columns
    ratios = ratios if ratios is not None else markov_ratios(training_samples(docs, text))
    scanned = secret_spans(docs.withColumns({f"__own_{i}": F.col(c) for i, c in enumerate(own)}), text, ratios, threshold)
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))

    def cut(body: Column, spans: Column) -> Column:
        def step(a: Column, x: Column) -> Column:
            piece = F.concat(body.substr((a["at"] + 1).cast("int"), (x["start"] - a["at"]).cast("int")), F.lit(mask))
            within = x["start"] < a["at"]
            return F.struct(F.greatest(a["at"], x["end"]).alias("at"), F.when(within, a["out"]).otherwise(F.array_append(a["out"], piece)).alias("out"))

        done = F.aggregate(spans, zero, step)
        return let(done, lambda d: F.concat(F.array_join(d["out"], ""), body.substr((d["at"] + 1).cast("int"), F.length(body))))

    names = {c: f"__own_{i}" for i, c in enumerate(own)}
    cleaned = F.when(F.size("found") > 0, cut(F.col(names[text]), F.col("found"))).otherwise(F.col(names[text]))
    return scanned.select(*[(cleaned if c == text else F.col(names[c])).alias(c) for c in own])
