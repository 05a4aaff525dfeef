"""Mix sources to target weights by Pareto order sampling.

Targets: sources in code point order, null last, weigh 3, 1, 2, repeating. They
share a fraction of all words by weight; a target stops at ``most`` times its
source's words, and the excess goes to the other sources by weight until none is
above. With the sources sorted by the level at which they fill up, one running
sum gives the level of all that do not.

Samples: a source whose target is r times its words takes floor(r) whole copies of
every document. The rest is drawn by Pareto order sampling: a document's rank is
the odds of a uniform number divided by its inclusion odds, and the documents of
smallest rank are taken until the words of the sample reach what is left of the
target. The last one is taken if that comes nearer to it. The uniform number is a
hash of the document, so reruns agree. Inclusion odds fall with size, so that a
mix holds more different documents: odds ``mean / (mean + size)``, up to a factor
per source, which does not change the order.

No group is sorted as a whole. Ranks are cut into cells by value; the words of
each cell are summed with map-side combining, a running sum over the cells finds
the one in which the target is reached, and only that cell is sorted.

Defined cases: a null text has size 0; documents of size 0 take 0 words; a source
of size 0 has target 0; null ids hash as the empty string; rows equal in id share
a rank and are ordered by their text, and rows equal in both are interchangeable.
Extra columns are kept by ``mix_sources``. An empty table gives an empty mix.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.runtime import keep, require, require_columns

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
# Runs of anything but the space and 0x09 to 0x0D.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(
    sources: DataFrame, source: str = "source", size: str = "source_size", weights: Sequence[float] = WEIGHTS,
    share: float = SHARE, most: float = MOST,
) -> DataFrame:
    """Add ``target`` to one row per source. The windows run over the sources,
    of which a corpus has few, never over its documents."""
    require_columns(sources, [source, size], "sources")
    require(share <= most, "the share cannot exceed what the sources may give")
    by_name = Window.orderBy(F.col(source).asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    weighed = sources.withColumn("__w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1))
    filled = weighed.withColumn("__cap", most * F.col(size)).withColumn("__level", F.col("__cap") / F.col("__w"))
    order = Window.orderBy("__level", F.col(source).asc_nulls_last())
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    all_rows = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = share * F.sum(size).over(all_rows) - F.coalesce(F.sum("__cap").over(upto), F.lit(0.0))
    # The level if this source and all that fill up later share what is left.
    tried = filled.withColumn("__shared", left / F.sum("__w").over(rest))
    level = F.min(F.when(F.col("__level") > F.col("__shared"), F.struct("__level", "__shared"))).over(all_rows)["__shared"]
    found = F.least("__cap", F.coalesce(level * F.col("__w"), F.col("__cap")))
    return tried.withColumn("target", found).select(*sources.columns, "target")


def uniform(key: Column) -> Column:
    """A number in (0, 1) from the hash of a value; the same in every run."""
    digits = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 12)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(1 << 48))


def _rank(u: Column, size: Column, mean: Column) -> Column:
    """Pareto rank mapped into (0, 1): odds(u) / odds(inclusion) over one plus itself."""
    odds = u / (1.0 - u) * (mean + size) / mean
    return odds / (1.0 + odds)


def mix_sources(
    docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", weights: Sequence[float] = WEIGHTS,
    share: float = SHARE, most: float = MOST, cells: int = 1024, prefix: str = "",
) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target``, ``copies`` and
    ``taken`` (words the mix takes of the document, repeats counted). A
    ``prefix`` is put before these names; without it, columns of ``docs`` so
    named are replaced."""
    require_columns(docs, [text, source, doc_id], "docs")
    held = docs.withColumn("__size", word_count(F.col(text)))
    narrow = keep(held.select(source, "__size", F.col(doc_id).alias("__id")))  # no texts
    sums = narrow.groupBy(source).agg(F.sum("__size").alias("source_size"), F.count(F.when(F.col("__size") > 0, 1)).alias("__n"))
    plan = targets(sums, source, "source_size", weights, share, most)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    plan = plan.select(
        F.col(source).alias("__source"), F.col("source_size").alias("__total"), F.col("target").alias("__target"), F.floor(ratio).alias("__whole"),
        (F.col("target") - F.floor(ratio) * F.col("source_size")).alias("__rest"), (F.col("source_size") / F.greatest("__n", F.lit(1))).alias("__mean"),
    )
    plan = keep(plan)  # one row per source
    cell = F.least(F.floor(F.col("__rank") * cells), F.lit(cells - 1)).cast("int")
    ranked = _ranked(narrow, plan, source, F.col("__id")).where(F.col("__size") > 0)
    cuts = ranked.groupBy("__source", cell.alias("__cell")).agg(F.sum("__size").alias("__words"))
    running = Window.partitionBy("__source").orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    cuts = cuts.withColumn("__before", F.coalesce(F.sum("__words").over(running), F.lit(0)))
    rest = plan.select("__source", F.col("__rest").alias("__wanted"))
    cuts = cuts.join(rest, cuts["__source"].eqNullSafe(rest["__source"])).drop(rest["__source"])
    # The cell the target falls into; its predecessors are taken whole.
    edge = cuts.where("__before < __wanted").groupBy("__source").agg(F.max_by(F.struct("__cell", "__before"), "__cell").alias("e"))
    edge = keep(edge.select(F.col("__source").alias("__s"), F.col("e.__cell").alias("__edge"), F.col("e.__before").alias("__before")))
    plan = plan.join(edge, F.col("__source").eqNullSafe(F.col("__s")), "left").drop("__s")
    placed = _ranked(held, plan, source, F.col(doc_id)).withColumn("__cell", cell)
    inner = (F.col("__cell") == F.col("__edge")) & (F.col("__size") > 0)
    # Only the rows of each source's edge cell are sorted.
    order = Window.partitionBy("__source").orderBy("__rank", F.col(doc_id), F.xxhash64(text)).rowsBetween(Window.unboundedPreceding, -1)
    edged = placed.where(inner).withColumn("__sum", F.col("__before") + F.coalesce(F.sum("__size").over(order), F.lit(0)))
    edged = edged.withColumn("__extra", (2 * F.col("__sum") + F.col("__size") < 2 * F.col("__rest") + 0.0).cast("long"))
    others = placed.where(~F.coalesce(inner, F.lit(False))).withColumn(
        "__extra", F.when((F.col("__size") > 0) & (F.col("__cell") < F.col("__edge")), 1).otherwise(0).cast("long")
    )
    named = {"size": "__size", "source_size": "__total", "target": "__target", "copies": "__copies"}
    own = [c for c in docs.columns if c not in {prefix + n for n in (*named, "taken")}]
    both = edged.drop("__sum").unionByName(others).withColumn("__copies", F.col("__whole") + F.col("__extra"))
    return both.select(
        *own, *[F.col(c).alias(prefix + n) for n, c in named.items()], (F.col("__copies") * F.col("__size")).alias(prefix + "taken")
    )


def _ranked(rows: DataFrame, plan: DataFrame, source: str, key: Column) -> DataFrame:
    joined = rows.join(F.broadcast(plan) if plan.count() <= 20_000 else plan, F.col(source).eqNullSafe(F.col("__source")))
    return joined.withColumn("__rank", _rank(uniform(key), F.col("__size"), F.col("__mean")))
