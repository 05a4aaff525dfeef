"""Fixity audits of WARC archives by Merkle trees over ordered offset ranges.

Records are put in one order over the cluster (a range sort, never one task) and
dealt to archives of equal length; a record's offset is the bytes before it in its
archive. A leaf is the SHA-256 of a record's bytes; a node covers ``FANOUT``
neighbours and hashes their offset range and hashes, up to one root. A replica is
given as stored records by archive and place. Its tree is built over the manifest's
ranges, so that a lost record costs its own leaf and not all that follow. The audit
compares the roots and then, level by level, only the children of nodes that differ.

Defined cases: null urls or bodies count as empty, null keys come first; records equal
in everything keep their copies, at places of their own; a record that the replica
lacks has no hash there and is ``lost``, one with other bytes is ``corrupt``, a stored
record that the manifest does not know is ``extra``; if a place is stored twice, the
smallest hash that differs counts as the replica's. Empty tables give empty trees and
no findings. Extra columns of the records are not part of an archive.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tessera.operators.order import number_rows
from tessera.runtime import keep, require_columns

FANOUT = 16
ARCHIVE_LEVEL = 3  # an archive holds FANOUT ** ARCHIVE_LEVEL records


def record_bytes(url: Column, body: Column) -> Column:
    """A WARC response record."""
    body = F.coalesce(body, F.lit(""))
    head = F.concat(F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"))
    return F.concat(head, F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n")).cast("binary")


def manifest(records: DataFrame, key: str, payload: str) -> DataFrame:
    """(key, place, archive, record, offset, length, sha256) of every record;
    ``place`` counts from 0 in the order of key, then hash."""
    require_columns(records, [key, payload], "records")
    leaves = records.select(F.col(key), F.octet_length(payload).cast("long").alias("length"), F.sha2(payload, 256).alias("sha256"))
    numbered = number_rows(leaves, [], [F.col(key).asc_nulls_first(), F.col("sha256")], "place", hot=True)
    size = FANOUT**ARCHIVE_LEVEL
    placed = numbered.withColumn("place", F.col("place") - 1)
    placed = placed.withColumn("archive", F.floor(F.col("place") / size)).withColumn("record", F.col("place") % size)
    before = Window.partitionBy("archive").orderBy("record").rowsBetween(Window.unboundedPreceding, -1)  # an archive's records at most
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))


def _levels(rows: int) -> int:
    levels = ARCHIVE_LEVEL
    while FANOUT**levels < rows:
        levels += 1
    return levels


@dataclass(frozen=True)
class Tree:
    """A table per level with node, start, stop (offset range) and sha256; the
    leaves are level 0, the last level is the root alone."""

    levels: tuple[DataFrame, ...]

    def root(self) -> str | None:
        row = self.levels[-1].first()
        return row["sha256"] if row else None


def merkle_tree(leaves: DataFrame, rows: int) -> Tree:
    """``leaves`` has node (its place), start, stop and sha256. Up to an archive,
    ranges are offsets in it; above, the order of archives stands for them."""
    levels = [keep(leaves.select("node", "start", "stop", "sha256"))]
    for _ in range(_levels(rows)):
        children = levels[-1].groupBy(F.floor(F.col("node") / FANOUT).alias("node")).agg(
            F.min("start").alias("start"), F.max("stop").alias("stop"), F.sort_array(F.collect_list(F.struct("node", F.coalesce("sha256", F.lit("-")).alias("h")))).alias("c")
        )  # FANOUT children at most
        joined = F.array_join(F.transform("c", lambda x: x["h"]), ",")
        levels.append(keep(children.select("node", "start", "stop", F.sha2(F.concat_ws(":", "start", "stop", joined), 256).alias("sha256"))))
    return Tree(tuple(levels))


def _leaves(placed: DataFrame, sha256: str = "sha256") -> DataFrame:
    return placed.select(F.col("place").alias("node"), F.col("offset").alias("start"), (F.col("offset") + F.col("length")).alias("stop"), F.col(sha256).alias("sha256"))


def differing_leaves(a: Tree, b: Tree) -> Iterator[tuple[int, DataFrame]]:
    """(level, nodes that differ) from the root down. Only children of nodes
    found on the level above are read into a comparison; equal roots end it."""
    if a.root() == b.root():
        return
    found: DataFrame | None = None
    for level in reversed(range(len(a.levels))):
        mine, other = a.levels[level], b.levels[level].select("node", F.col("sha256").alias("other"))
        if found is not None:
            branch = F.floor(F.col("node") / FANOUT)
            mine = mine.join(found.select(F.col("node").alias("__up")), branch == F.col("__up"), "left_semi")
        found = keep(mine.join(other, "node").where(~F.col("sha256").eqNullSafe(F.col("other"))).select("node"))
        yield level, found


def audit(placed: DataFrame, replica: DataFrame, payload: str = "payload") -> DataFrame:
    """The manifest with ``status`` of each record in the replica (``intact``,
    ``corrupt`` or ``lost``), and rows of status ``extra`` for what it holds
    besides. ``replica`` has archive, record and the stored bytes."""
    require_columns(replica, ["archive", "record", payload], "replica")
    placed = keep(placed)
    rows = placed.count()
    stored = keep(replica.select("archive", "record", F.sha2(payload, 256).alias("stored")))
    judged = placed.join(stored, ["archive", "record"], "left")
    # One hash for each place, one that differs if there is any.
    wrong = F.min(F.when(F.col("stored") != F.col("sha256"), F.col("stored")))
    seen = judged.groupBy("place", "offset", "length").agg(F.coalesce(wrong, F.min("stored")).alias("stored"))
    mine, other = merkle_tree(_leaves(placed), rows), merkle_tree(_leaves(seen, "stored"), rows)
    bad = None
    for _, nodes in differing_leaves(mine, other):
        bad = nodes  # the last level's are records
    if bad is None:
        known = placed.withColumn("status", F.lit("intact"))
    else:
        held = other.levels[0].select(F.col("node").alias("place"), F.col("sha256").alias("__stored")).join(bad.select(F.col("node").alias("place")), "place")
        found = held.select("place", F.when(F.col("__stored").isNull(), "lost").otherwise("corrupt").alias("status"))
        known = placed.join(found, "place", "left").withColumn("status", F.coalesce("status", F.lit("intact")))
    extra = stored.join(placed.select("archive", "record"), ["archive", "record"], "left_anti")
    return known.unionByName(extra.select("archive", "record", F.lit("extra").alias("status")), allowMissingColumns=True)


def archive_roots(placed: DataFrame) -> DataFrame:
    """(archive, archive_sha256): the tree nodes that cover one archive each."""
    tree = merkle_tree(_leaves(placed), FANOUT**ARCHIVE_LEVEL)
    return tree.levels[ARCHIVE_LEVEL].select(F.col("node").alias("archive"), F.col("sha256").alias("archive_sha256"))
