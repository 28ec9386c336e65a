"""A Merkle manifest of a table, and proofs that rows belong to it.

Each row is a leaf; the leaves of a tree (a language) stand in order of their ids, every two neighbours hash into
their parent, and the roots of the trees are the leaves of one more tree. ``build`` stores all of it: leaves with
their places, and nodes by tree, level and index.

Trees are built in aligned blocks of two to the power of ``levels`` neighbours: a task turns a block into its subtree, the roots
of the blocks are the next round's leaves. A tree that holds all rows is as many blocks as any other split of
the rows, and rounds are as many as the height over ``levels``.

Proofs are octopus multiproofs. The rows to prove are dealt by block. From their places alone a block works out
the smallest set of coordinates it can't derive: going up, a sibling is missing only if nothing known lies
below it. All that is missing is fetched at once by a join with the stored nodes; the block derives the interior
nodes its rows share, each once, and spells out every row's own proof.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidings.plans.skew import row_numbers, salted_join
from tidings.llm.common import materialize, prepare

LEVELS = 10  # levels that a task builds or derives at once; a block has two to the power of that leaves
TOP = -1  # the tree whose leaves are the roots of the others
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
NODE = "tree bigint, level int, index bigint, digest binary"


@dataclass(frozen=True)
class Manifest:
    """Stored tables: ``leaves`` (``tree``, ``index``, ``size``, ``id``, ``leaf``, ...), ``nodes`` (``NODE``), ``trees`` (``name``, ``tree``, ``size``)."""

    leaves: DataFrame
    nodes: DataFrame
    trees: DataFrame
    root: bytes | None
    levels: int


def encoded(value: Column) -> Column:
    """A field inside a leaf: length in bytes, colon, value; ``-`` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(fields: Iterable[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*[encoded(f) for f in fields]), 256))


def join_digest(children: Sequence[bytes]) -> bytes:
    """Parent of a run of nodes; digests enter as hex text."""
    return sha256("".join(c.hex() for c in children).encode()).digest()


def height(size: int) -> int:
    """Levels above the leaves of a tree."""
    return (size - 1).bit_length()


def width(size: int, level: int) -> int:
    """Nodes of a tree of ``size`` leaves at a level."""
    return -(-size >> level)


def placed_leaves(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``leaves`` (``name``, ``id``, ``leaf``, ...) with ``tree``, ``index`` and ``size``; and the trees.

    One sort by tree and id deals a large tree to many tasks. Rows are numbered as they are written, so a place is
    the row's number less the first number of its tree in the same file, plus what earlier files have of the tree.
    """
    ordered = leaves.orderBy("name", "id", "leaf", "row").withColumn("_at", F.monotonically_increasing_id())
    ordered = materialize(ordered.withColumn("_file", F.shiftright("_at", 33)), "manifest-order")
    parts = ordered.groupBy("name", "_file").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("n"))
    parts = materialize(parts, "manifest-parts")
    names = row_numbers(parts.groupBy("name").agg(F.sum("n").alias("size")), ["name"], name="tree")
    trees = materialize(names.select("name", (F.col("tree") - 1).alias("tree"), "size"), "manifest-trees")
    earlier = Window.partitionBy("name").orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)  # a row per file that has the tree
    before = parts.withColumn("_before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    offsets = before.alias("b").join(trees.alias("t"), F.col("b.name").eqNullSafe(F.col("t.name")))
    offsets = offsets.select(F.col("b.name").alias("_name"), F.col("_file").alias("_part"), "_first", "_before", "tree", "size")
    same = F.col("name").eqNullSafe(F.col("_name")) & (F.col("_file") == F.col("_part"))
    index = F.col("_at") - F.col("_first") + F.col("_before")
    out = ordered.join(offsets, same).withColumn("index", index).drop("_at", "_file", "_name", "_part", "_first", "_before")
    return materialize(out, "manifest-leaves"), trees


def _subtree(levels: int):
    """Nodes above a block's nodes, up to ``levels`` levels or the root."""

    def run(table: pa.Table) -> pa.Table:
        tree, level, size = (table[c][0].as_py() for c in ("tree", "level", "size"))
        rows = sorted(zip(table["index"].to_pylist(), table["digest"].to_pylist()))
        first, nodes, made = rows[0][0], [d for _, d in rows], []
        for up in range(level + 1, min(level + levels, height(size)) + 1):
            nodes = [join_digest(nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
            first >>= 1
            made += [(up, first + i, d) for i, d in enumerate(nodes)]
        return pa.table({
            "tree": pa.array([tree] * len(made), pa.int64()), "level": pa.array([m[0] for m in made], pa.int32()),
            "index": pa.array([m[1] for m in made], pa.int64()), "digest": pa.array([m[2] for m in made], pa.binary()),
            "size": pa.array([size] * len(made), pa.int64()),
        })

    return run


def tree_nodes(leaves: DataFrame, levels: int = LEVELS) -> DataFrame:
    """All nodes over ``leaves`` (``tree``, ``index``, ``digest``, ``size``), leaves as level 0 included, stored round by round."""
    nodes = [leaves.select("tree", F.lit(0).alias("level"), "index", "digest", "size")]
    top = leaves.agg(F.max("size")).first()[0] or 1
    for base in range(0, height(top), levels):
        # a block starts at an aligned place, so its parents are its own
        open_ = nodes[-1].where((F.col("level") == base) & (F.col("size") > (1 << base)))
        dealt = open_.withColumn("block", F.shiftright("index", levels))
        nodes.append(materialize(dealt.groupBy("tree", "block").applyInArrow(_subtree(levels), NODE + ", size bigint"), "manifest-nodes"))
    return reduce(DataFrame.unionByName, nodes)


def build(
    docs: DataFrame, fields: Sequence[str] = FIELDS, id_column: str = "doc_id", tree_column: str = "lang", claim: Column | None = None,
    levels: int = LEVELS,
) -> Manifest:
    """Manifest of ``docs``; ``claim``, if given, is a second leaf digest that travels along as ``claim``.

    Leaves of a tree ascend by id, null first, then by digest; trees by name, null first. Repeated rows are leaves of
    their own. An empty table has no root. Columns that are not among the fields are not part of a leaf.
    """
    prepare(docs.sparkSession)
    leaf = leaf_digest([F.col(f"`{f}`") for f in fields])
    leaves = docs.select(
        F.col(tree_column).alias("name"), F.col(id_column).alias("id"), leaf.alias("leaf"), (leaf if claim is None else claim).alias("claim"),
        F.monotonically_increasing_id().alias("row"),
    )
    placed, trees = placed_leaves(materialize(leaves, "leaves"))
    own = tree_nodes(placed.select("tree", "index", F.col("leaf").alias("digest"), "size"), levels)
    roots = own.where(F.col("index") == 0).where(F.expr("level = if(size = 1, 0, length(bin(size - 1)))")).select("tree", "digest")
    n_trees = trees.count()
    upper = roots.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("index"), "digest", F.lit(n_trees).cast("long").alias("size"))
    top = tree_nodes(materialize(upper, "manifest-roots"), levels)
    root = top.where(F.col("level") == height(n_trees)).first() if n_trees else None
    return Manifest(placed, own.unionByName(top).drop("size"), trees, bytes(root["digest"]) if root else None, levels)


def missing_nodes(known: Iterable[int], size: int) -> list[tuple[int, int]]:
    """Octopus: level and index of the fewest nodes that with the ``known`` leaves give the root of a tree."""
    found, level, here = [], 0, set(known)
    for level in range(height(size)):
        last = width(size, level) - 1
        found += [(level, i ^ 1) for i in sorted(here) if i ^ 1 not in here and i ^ 1 <= last]
        here = {i >> 1 for i in here}
    return found


def _needs(n_trees: int):
    def run(table: pa.Table) -> pa.Table:
        tree, block, size = (table[c][0].as_py() for c in ("tree", "block", "size"))
        own = [(tree, *c) for c in missing_nodes(table["index"].to_pylist(), size)]
        top = [(TOP, *c) for c in missing_nodes([tree], n_trees)]
        rows = own + top
        return pa.table({
            "asker": pa.array([tree] * len(rows), pa.int64()), "block": pa.array([block] * len(rows), pa.int64()),
            "tree": pa.array([r[0] for r in rows], pa.int64()), "level": pa.array([r[1] for r in rows], pa.int32()),
            "index": pa.array([r[2] for r in rows], pa.int64()),
        })

    return run


class Path:
    """Digests known of one tree by level and index; parents are derived once, when they can be."""

    def __init__(self, size: int, leaves: dict[int, bytes], fetched: dict[tuple[int, int], bytes]):
        self.size, self.levels = size, [dict(leaves)]
        for level in range(height(size)):
            here, last = self.levels[level], width(size, level) - 1
            here.update((i, d) for (at, i), d in fetched.items() if at == level)
            whole = (i for i in here if not i & 1 and (i == last or i + 1 in here))
            self.levels.append({i >> 1: join_digest([here[j] for j in (i, i + 1) if j <= last]) for i in list(whole)})

    def siblings(self, leaf: int) -> list[bytes]:
        places = ((level, (leaf >> level) ^ 1) for level in range(height(self.size)))
        return [self.levels[level][i] for level, i in places if i < width(self.size, level)]

    def fold(self, leaf: int, value: bytes, siblings: list[bytes], memo: dict) -> bytes:
        """Root from a leaf and its siblings; equal runs are hashed once."""
        given = iter(siblings)
        for level in range(height(self.size)):
            at = leaf >> level
            run = (value,) if at ^ 1 >= width(self.size, level) else (next(given), value) if at & 1 else (value, next(given))
            if run not in memo:
                memo[run] = join_digest(run)
            value = memo[run]
        return value


def _expand(n_trees: int):
    def run(key: tuple, leaves: pa.Table, fetched: pa.Table) -> pa.Table:
        tree, size = key[0].as_py(), leaves["size"][0].as_py()
        known = {TOP: {}, tree: {}}
        for t, level, i, d in zip(*(fetched[c].to_pylist() for c in ("tree", "level", "index", "digest"))):
            known[t][level, i] = d
        places, digests, claims = (leaves[c].to_pylist() for c in ("index", "leaf", "claim"))
        own = Path(size, dict(zip(places, digests)), known[tree])
        subroot = own.levels[-1][0]
        top = Path(n_trees, {tree: subroot}, known[TOP])
        above, memo, proofs, folded = top.siblings(tree), {}, [], []
        for at, claim in zip(places, claims):
            below = own.siblings(at)
            proofs.append(b"".join(below + above))
            folded.append(top.fold(tree, own.fold(at, claim, below, memo), above, memo))
        n = len(places)
        return pa.table({
            "id": leaves["id"], "tree": leaves["tree"], "index": leaves["index"], "leaf": leaves["leaf"],
            "subroot": pa.array([subroot] * n, pa.binary()), "derived_root": pa.array([top.levels[-1][0]] * n, pa.binary()),
            "proof": pa.array(proofs, pa.binary()), "folded_root": pa.array(folded, pa.binary()),
        })

    return run


def prove(made: Manifest, wanted: DataFrame | None = None) -> DataFrame:
    """Proofs of the leaves ``wanted`` (rows of ``made.leaves``; all by default).

    One row per leaf: ``id``, ``tree``, ``index``, ``leaf``, ``subroot`` and ``derived_root`` (as this block's leaves and the fetched
    nodes give them), ``proof`` (siblings' digests in a row, from the leaf up through its tree's root to the root), ``folded_root``
    (what ``claim`` and the proof give). Without leaves there are no rows.
    """
    leaves = made.leaves if wanted is None else wanted
    n_trees = made.trees.count()
    dealt = leaves.withColumn("block", F.shiftright("index", made.levels))
    needs = dealt.select("tree", "block", "index", "size").groupBy("tree", "block").applyInArrow(
        _needs(n_trees), "asker bigint, block bigint, tree bigint, level int, index bigint"
    )
    # a node near the root is asked for by half of all blocks
    fetched = salted_join(materialize(needs, "missing"), made.nodes, ["tree", "level", "index"])
    kind = leaves.schema["id"].dataType.simpleString()
    schema = f"id {kind}, tree bigint, index bigint, leaf binary, subroot binary, derived_root binary, proof binary, folded_root binary"
    return dealt.select("tree", "block", "index", "size", "id", "leaf", "claim").groupBy("tree", "block").cogroup(
        fetched.groupBy("asker", "block")
    ).applyInArrow(_expand(n_trees), schema)
