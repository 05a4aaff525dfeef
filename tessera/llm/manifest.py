"""Merkle manifest of a dataset, by cogrouped subtree exchange.

Every row is a leaf of its tree (a language, say), in the order of a key. Runs of ``FAN``
neighbours are hashed together, level by level, to the tree's subroot; the subroots are
reduced in the same way to one root. The proof of a leaf are the other digests of each run
on its way up, so one row can be held against the root without the rest of the dataset.

Neighbours under four levels of runs, 4,096 of them, are a superblock. Going up, each superblock gives
one digest, and these are the nodes of the next tier, until every tree is one node; the
subroots are tiers of one further tree. Going down, the nodes of a tier are cogrouped by
superblock with the one outer row the superblock needs: the proof of its own digest.
``applyInPandas`` reduces the superblock, joins local and outer proofs and folds them. A
group is a superblock, so it is bounded whatever a tree holds, and of a superblock only 32
bytes go up and some 1.5 KB come down. Rows are numbered by a range sort over the cluster.

Defined cases: null keys come first and equal keys stand by their digests; rows equal in
all fields are leaves of their own with equal digests; a null tree is a tree, the first; a
tree of one leaf has that leaf as its subroot, a single subroot is the root; texts are
hashed whole; empty tables have no leaves and no root; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.order import number_rows
from tessera.runtime import keep, require_columns

FAN = 8
BLOCK_LEVELS = 4  # a superblock has FAN ** BLOCK_LEVELS nodes


def encoded(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(fields: Sequence[Column]) -> Column:
    """SHA-256 of a row's fields, 32 bytes."""
    return F.unhex(F.sha2(F.concat(*[encoded(f) for f in fields]), 256))


def _joined(digests: Sequence[bytes]) -> bytes:
    """SHA-256 of digests written as hexadecimal text."""
    return hashlib.sha256(b"".join(digests).hex().encode()).digest()


def levels_of(n: int) -> int:
    """Reductions until ``n`` nodes are one."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FAN), levels + 1
    return levels


def _reduced(nodes: pd.DataFrame, block_levels: int) -> list[list[bytes]]:
    """The levels of a superblock, its own nodes first; ``n`` nodes are in its tier."""
    levels = [list(nodes["digest"])]
    for _ in range(min(block_levels, levels_of(int(nodes["n"].iloc[0])))):
        levels.append([_joined(levels[-1][i : i + FAN]) for i in range(0, len(levels[-1]), FAN)])
    return levels


def fold(leaf: bytes, path: Sequence[int], proof: Sequence[bytes]) -> bytes:
    """The root that a leaf and its proof give: at each level the leaf's side of the run is
    put among the others at its place."""
    for place, others in zip(path, proof, strict=True):
        at = 32 * place
        leaf = hashlib.sha256((others[:at] + leaf + others[at:]).hex().encode()).digest()
    return leaf


def _block_root(block_levels: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def root(nodes: pd.DataFrame) -> pd.DataFrame:
        nodes = nodes.sort_values("place")
        return pd.DataFrame({"owner": nodes["owner"][:1], "place": nodes["block"][:1], "digest": _reduced(nodes, block_levels)[-1]})

    return root


def _proven(columns: list[str], block_levels: int, folded: bool) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def prove(nodes: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        if nodes.empty:
            return pd.DataFrame(columns=columns)
        nodes = nodes.sort_values("place").reset_index(drop=True)
        levels = _reduced(nodes, block_levels)
        # The other digests of the run of each node, once for all leaves below it.
        others = []
        for level in levels[:-1]:
            runs = [level[i : i + FAN] for i in range(0, len(level), FAN)]
            others.append([b"".join(run[:k] + run[k + 1 :]) for run in runs for k in range(len(run))])
        above = outer.iloc[0]
        out = nodes.copy()
        path, proof = list(above["path"]), list(above["proof"])
        steps = [FAN**k for k in range(len(others))]
        out["path"] = [[i // s % FAN for s in steps] + path for i in range(len(out))]
        out["proof"] = [[side[i // s] for s, side in zip(steps, others, strict=True)] + proof for i in range(len(out))]
        out["subroot"], out["root"] = above["subroot"], above["root"]
        if folded:
            claims = [d if c is None else c for c, d in zip(out["claimed"], out["digest"], strict=True)]
            out["folded_root"] = [fold(*x) for x in zip(claims, out["path"], out["proof"], strict=True)]
        return out[columns]

    return prove


def _blocks(nodes: DataFrame, block_levels: int) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("place") / FAN**block_levels))


def _descend(nodes: DataFrame, outer: DataFrame, block_levels: int, folded: bool = False) -> DataFrame:
    """Path, proof, subroot and root of every node of a tier."""
    nodes = _blocks(nodes, block_levels)
    binary = T.BinaryType()
    added = [T.StructField("path", T.ArrayType(T.IntegerType())), T.StructField("proof", T.ArrayType(binary)), T.StructField("subroot", binary), T.StructField("root", binary)]
    schema = T.StructType([*nodes.schema.fields, *added, *([T.StructField("folded_root", binary)] if folded else [])])
    return nodes.groupBy("owner", "block").cogroup(outer.groupBy("owner", "block")).applyInPandas(_proven(schema.names, block_levels, folded), schema)


def _ascend(nodes: DataFrame, most: int, block_levels: int) -> list[DataFrame]:
    """Tiers of (owner, place, n, digest) above ``nodes``, until each owner is one node.
    ``most`` is the largest owner's count of nodes."""
    tiers = []
    while most > 1:
        blocks = _blocks(nodes, block_levels).select("owner", "block", "place", "n", "digest").groupBy("owner", "block")
        roots = blocks.applyInPandas(_block_root(block_levels), "owner long, place long, digest binary")
        counts = nodes.groupBy("owner").agg(F.ceil(F.max("n") / FAN**block_levels).alias("n"))
        nodes = keep(keep(roots).join(counts, "owner").select("owner", "place", "n", "digest"))
        tiers.append(nodes)
        most = -(-most // FAN**block_levels)
    return tiers


def merkle_proofs(leaves: DataFrame, tree: str, key: str, digest: str = "digest", claimed: str | None = None, block_levels: int = BLOCK_LEVELS) -> DataFrame:
    """One row per row of ``leaves``: tree, key, place in the tree, digest, subroot, root,
    ``path`` (place in its run at each level), ``proof`` (the run's other digests at each
    level, 32 bytes each, put together), ``folded_root`` and ``verified``. What is folded
    is ``claimed``, where it is given and not null, else the digest itself. The size of a
    superblock does not change the result."""
    require_columns(leaves, [tree, key, digest, claimed], "leaves")
    claim = F.col(claimed) if claimed else F.lit(None).cast("binary")
    rows = keep(leaves.select(F.col(tree).alias("tree"), F.col(key).alias("key"), F.col(digest).alias("digest"), claim.alias("claimed")))
    numbered = number_rows(rows, ["tree"], [F.col("key").asc_nulls_first(), F.col("digest")], "place", hot=True)
    counts = keep(rows.groupBy("tree").agg(F.count(F.lit(1)).alias("n")))
    trees = keep(number_rows(counts, [], [F.col("tree").asc_nulls_first()], "owner"))
    size = trees.agg(F.count(F.lit(1)).alias("trees"), F.max("n").alias("most")).first()
    named = trees.select(F.col("tree").alias("__tree"), "owner", "n")
    # The key travels as text: pandas has no integers with nulls.
    placed = numbered.join(named, F.col("tree").eqNullSafe(F.col("__tree"))).select(
        "owner", (F.col("place") - 1).alias("place"), "n", "tree", F.col("key").cast("string").alias("key"), "digest", "claimed"
    )
    tiers = [placed, *_ascend(placed, size["most"] or 0, block_levels)]
    # A tree of one row has no tier above its leaf, so subroots are the last tier's nodes.
    subroots = tiers[-1].select(F.lit(0).cast("long").alias("owner"), (F.col("owner") - 1).alias("place"), F.lit(size["trees"]).cast("long").alias("n"), "digest")
    upper = [subroots, *_ascend(subroots, size["trees"], block_levels)]
    zero = F.lit(0).cast("long")
    outer = upper[-1].select(
        zero.alias("owner"), zero.alias("block"), F.array().cast("array<int>").alias("path"), F.array().cast("array<binary>").alias("proof"),
        F.lit(None).cast("binary").alias("subroot"), F.col("digest").alias("root"),
    )
    for nodes in reversed(upper):
        proven = _descend(nodes, outer, block_levels)
        outer = keep(proven.select("owner", F.col("place").alias("block"), "path", "proof", F.col("digest").alias("subroot"), "root"))
    # The place of a subroot names its tree, whose last tier is one block.
    outer = outer.select((F.col("block") + 1).alias("owner"), zero.alias("block"), "path", "proof", "subroot", "root")
    for nodes in reversed(tiers[1:]):
        proven = _descend(nodes, outer, block_levels)
        outer = keep(proven.select("owner", F.col("place").alias("block"), "path", "proof", "subroot", "root"))
    proven = _descend(placed, outer, block_levels, folded=True)
    verified = F.col("folded_root") == F.col("root")
    return proven.select(
        F.col("tree").alias(tree), F.col("key").cast(leaves.schema[key].dataType).alias(key), "place", F.col("digest").alias(digest),
        "subroot", "root", "path", "proof", "folded_root", verified.alias("verified"),
    )
