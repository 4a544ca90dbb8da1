"""Merkle manifest of a data set: aligned subtrees in van Emde Boas order, recursing over their roots.

The leaves of a tree have dense positions. Every ``fanout ** height`` consecutive ones form a block, which one task turns into an aligned
subtree; its nodes are stored so that a subtree split at half its height is contiguous, recursively. Where a node lies is arithmetic on
its depth and number; construction and the retrieval of siblings use the same arithmetic. Block roots are the leaves of the next tier,
until one block is left. Each source has a tree, however large; the roots of the sources form one more tree.

A proof goes the other way: the way from a block's root to the top is found once per block and handed down, so that a document's proof
is its siblings within its block and what its block was given.

Digests are SHA-256. A null field counts as ``-``, any other as its UTF-8 byte count, ``:`` and the value; a null source is a tree of its
own, before all others. Rows with equal ids are ordered by digest, repeated rows are leaves of their own, a null id comes first and is
not tampered with. A single leaf is its tree's root. An empty table gives no rows. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.rank import ranked
from lodestone.llm.text import type_of
from lodestone.session import cut_lineage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

FANOUT, HEIGHT = 16, 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    """A field as it enters a leaf."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def size(levels: int, fanout: int) -> int:
    """Nodes of a complete tree of so many levels."""
    return (fanout ** levels - 1) // (fanout - 1)


def address(depth: int, number: np.ndarray, levels: int, fanout: int) -> np.ndarray:
    """Where the nodes of a depth lie in a tree of ``levels`` levels laid out in van Emde Boas order."""
    if levels == 1:
        return np.zeros_like(number)
    top = levels // 2
    if depth < top:
        return address(depth, number, top, fanout)
    below = fanout ** (depth - top)
    return (size(top, fanout) + number // below * size(levels - top, fanout)
            + address(depth - top, number % below, levels - top, fanout))


def parent(run: bytes) -> bytes:
    """Digest over the hexadecimal text of the digests in ``run``."""
    return hashlib.sha256(run.hex().encode()).digest()


class Subtree:
    """Nodes of one block in van Emde Boas order, 32 bytes each."""

    def __init__(self, nodes: np.ndarray, leaves: int, height: int, fanout: int):
        self.nodes, self.leaves, self.height, self.fanout = nodes, leaves, height, fanout

    @classmethod
    def build(cls, digests: list[bytes], height: int, fanout: int) -> "Subtree":
        tree = cls(np.zeros((size(height + 1, fanout), 32), np.uint8), len(digests), height, fanout)
        tree.put(height, np.frombuffer(b"".join(digests), np.uint8).reshape(-1, 32))
        for depth in range(height - 1, -1, -1):
            rows = [parent(tree.run(depth + 1, p)) for p in range(tree.width(depth))]
            tree.put(depth, np.frombuffer(b"".join(rows), np.uint8).reshape(-1, 32))
        return tree

    def width(self, depth: int) -> int:
        """Nodes present at a depth."""
        return -(-self.leaves // self.fanout ** (self.height - depth))

    def put(self, depth: int, rows: np.ndarray) -> None:
        self.nodes[address(depth, np.arange(len(rows)), self.height + 1, self.fanout)] = rows

    def get(self, depth: int, first: int, last: int) -> bytes:
        return self.nodes[address(depth, np.arange(first, last), self.height + 1, self.fanout)].tobytes()

    def run(self, depth: int, above: int) -> bytes:
        """The children, at ``depth``, of node ``above``."""
        return self.get(depth, above * self.fanout, min((above + 1) * self.fanout, self.width(depth)))

    def steps(self) -> list[tuple[list[bytes], list[tuple[int, bytes]]]]:
        """For each leaf, level by level up to the root of the block, (place in its run, siblings)."""
        runs = {(d, p): self.run(d, p) for d in range(self.height, 0, -1) for p in range(self.width(d - 1))}
        found = []
        for leaf in range(self.leaves):
            way, number = [], leaf
            for depth in range(self.height, 0, -1):
                number, place = divmod(number, self.fanout)
                run = runs[depth, number]
                way.append((place, run[:32 * place] + run[32 * (place + 1):]))
            found.append(way)
        return found


def fold(digest: bytes, way: list[tuple[int, bytes]]) -> bytes:
    """The root that a leaf and its siblings lead to."""
    for place, others in way:
        digest = parent(others[:32 * place] + digest + others[32 * place:])
    return digest


def _one(table: pa.Table) -> dict:
    return {name: table.column(name)[0].as_py() for name in table.column_names if name not in ("way", "payload")}


class Manifest:
    """Blocks of all tiers of a set of trees, and one root per tree.

    ``tiers``: frames ``tree, block, leaves, height, nodes, root`` and, in the first, ``payload`` (what each leaf carries).
    ``roots``: ``tree, digest, tier``.
    """

    def __init__(self, tiers: list[DataFrame], roots: DataFrame, fanout: int):
        self.tiers, self.roots, self.fanout = tiers, roots, fanout


def build(leaves: DataFrame, payload: str | None = None, fanout: int = FANOUT, height: int = HEIGHT) -> Manifest:
    """Trees over ``leaves``: tree (string), position (from 0, dense within a tree), digest (32 bytes)."""
    carried = type_of(leaves, payload) if payload else "boolean"
    rows = leaves.select("tree", "position", "digest", (F.col(payload) if payload else F.lit(None).cast("boolean")).alias("payload"))
    full = fanout ** height

    def block(table: pa.Table) -> pa.Table:
        table = table.sort_by("position")
        number = table.column("block")[0].as_py()
        levels = height
        if number == 0 and len(table) < full:  # the only block of its tree ends where one node is left
            levels = 0
            while fanout ** levels < len(table):
                levels += 1
        tree = Subtree.build(table.column("digest").to_pylist(), levels, fanout)
        whole = table.column("payload").combine_chunks()
        return pa.table({"tree": table.column("tree").slice(0, 1), "block": [number], "leaves": [len(table)], "height": [levels],
                         "nodes": [tree.nodes.tobytes()], "root": [tree.get(0, 0, 1)],
                         "payload": pa.ListArray.from_arrays(pa.array([0, len(table)], pa.int32()), whole)})

    tiers, finished = [], []
    while True:
        grouped = rows.withColumn("block", F.floor(F.col("position") / full).cast("long")).groupBy("tree", "block")
        tiers.append(cut_lineage(grouped.applyInArrow(
            block, f"tree string, block long, leaves long, height long, nodes binary, root binary, payload array<{carried}>")))
        roots = tiers[-1].select("tree", "block", "root")
        # A first block that is not full, or has no second one beside it, is the whole tree.
        more = roots.where("block > 0").select("tree").distinct()
        finished.append(roots.join(more, "tree", "left_anti").select("tree", F.col("root").alias("digest"), F.lit(len(tiers) - 1).alias("tier")))
        if more.isEmpty():
            break
        carried = "boolean"
        rows = roots.join(more, "tree", "left_semi").select("tree", F.col("block").alias("position"), F.col("root").alias("digest"),
                                                            F.lit(None).cast("boolean").alias("payload"))
    result = finished[0]
    for part in finished[1:]:
        result = result.unionByName(part)
    return Manifest(tiers, result, fanout)


_WAY = "way array<struct<place:int,others:binary>>"


def _way_rows(found: list[list[tuple[int, bytes]]]) -> pa.Array:
    kind = pa.list_(pa.struct([("place", pa.int32()), ("others", pa.binary())]))
    return pa.array([[{"place": p, "others": o} for p, o in way] for way in found], kind)


def _descent(fanout: int, extra: list[str], leaf: Callable | None) -> Callable:
    """Hands the way from a block's root to the top down to the block's leaves: the blocks below, or, in the lowest tier, ``leaf``."""

    def descend(blocks: pa.Table, given: pa.Table) -> pa.Table:
        row, carried = _one(blocks), _one(given)
        tree = Subtree(np.frombuffer(row["nodes"], np.uint8).reshape(-1, 32), row["leaves"], row["height"], fanout)
        steps, n = tree.steps(), row["leaves"]
        rest = [(s["place"], s["others"]) for s in given.column("way")[0].as_py()]
        if leaf is not None:
            row["digests"] = tree.get(row["height"], 0, n)
            row["payload"] = blocks.column("payload").combine_chunks().flatten()
            return leaf(row, carried, steps, rest)
        first = row["block"] * fanout ** row["height"]
        return pa.table({"under": [row["tree"]] * n, "home": pa.array(range(first, first + n), pa.int64()),
                         "way": _way_rows([way + rest for way in steps]),
                         **{c: pa.array([carried[c]] * n) for c in extra}})
    return descend


def ways(manifest: Manifest, above: DataFrame, leaf: Callable, schema: str) -> DataFrame:
    """Proofs of all leaves. ``above``: tree, way (from the tree's root to the top), and the columns handed down.

    ``leaf(block row, columns handed down, ways within the block, way from its root)`` makes an Arrow table of ``schema`` of a first-tier
    block; a way is a list of (place, siblings).
    """
    extra = [c for c in above.columns if c not in ("tree", "way")]
    kinds = "".join(f", {c} {type_of(above, c)}" for c in extra)
    top = above.join(manifest.roots.select("tree", "tier"), "tree")
    fanout = manifest.fanout
    handed = None
    for tier in range(len(manifest.tiers) - 1, -1, -1):
        own = top.where(F.col("tier") == tier).select(F.col("tree").alias("under"), F.lit(0).cast("long").alias("home"), "way", *extra)
        handed = own if handed is None else own.unionByName(handed)

        met = manifest.tiers[tier].groupBy("tree", "block").cogroup(handed.groupBy("under", "home"))
        if tier == 0:
            return met.applyInArrow(_descent(fanout, extra, leaf), schema)
        handed = cut_lineage(met.applyInArrow(_descent(fanout, extra, None), f"under string, home long, {_WAY}{kinds}"))
    raise ValueError("a manifest has at least one tier")


def dataset_manifest(docs: DataFrame, id_column: str = "doc_id", tree_column: str = "source", fields: tuple[str, ...] = FIELDS,
                     changed: Column | None = None, altered: dict[str, Column] | None = None, fanout: int = FANOUT,
                     height: int = HEIGHT) -> tuple[Manifest, Manifest]:
    """Manifest of the trees of ``tree_column`` and of the tree of their roots.

    Leaves carry their id and, where ``changed`` holds, the digest of the leaf with the ``altered`` fields, for ``prove`` to fold.
    """
    named = {f: F.col(f"`{f}`") for f in fields}
    leaf = F.unhex(F.sha2(F.concat(*[field(c) for c in named.values()]), 256))
    other = F.unhex(F.sha2(F.concat(*[field((altered or {}).get(f, c)) for f, c in named.items()]), 256))
    tree = F.coalesce(F.concat(F.lit("+"), F.col(f"`{tree_column}`").cast("string")), F.lit(""))
    carried = F.struct(F.col(f"`{id_column}`").alias("id"), F.when(F.coalesce(changed if changed is not None else F.lit(False), F.lit(False)), other).alias("other"))
    rows = docs.select(tree.alias("tree"), leaf.alias("digest"), carried.alias("payload"))
    low = build(ranked(rows, ["tree"], [F.col("payload.id"), F.col("digest")]), "payload", fanout, height)
    tops = ranked(low.roots.select(F.col("tree").alias("payload"), "digest"), [], [F.col("payload")])
    high = build(tops.withColumn("tree", F.concat(F.lit("roots"), F.substring("payload", 1, 0))), "payload", fanout, height)
    return low, high


def prove(low: Manifest, high: Manifest, id_type: str = "long", with_siblings: bool = False) -> DataFrame:
    """Per document: id, leaf, subroot, root (lowercase hex), siblings (their digests, level by level, left to right; only on request),
    proof (digest of their hexadecimal text) and folded (the root that the changed, else the original leaf leads to)."""

    def trees(row: dict, given: dict, steps: list, rest: list) -> pa.Table:
        names, digests = row["payload"], row["digests"]
        return pa.table({"tree": names, "way": _way_rows([way + rest for way in steps]),
                         "subroot": pa.array([digests[32 * i: 32 * i + 32] for i in range(len(names))], pa.binary()),
                         "top": pa.array([given["top"]] * len(names), pa.binary())})

    whole = high.roots.select("tree", F.array().cast("array<struct<place:int,others:binary>>").alias("way"), F.col("digest").alias("top"))
    above = cut_lineage(ways(high, whole, trees, f"tree string, {_WAY}, subroot binary, top binary"))

    def documents(row: dict, given: dict, steps: list, rest: list) -> pa.Table:
        ids, others = (row["payload"].field(i) for i in (0, 1))
        tail = b"".join(o for _, o in rest).hex().encode()
        leaves, proofs, folds, siblings = [], [], [], []
        for i, (way, other) in enumerate(zip(steps, others.to_pylist())):
            digest = row["digests"][32 * i: 32 * i + 32]
            own = b"".join(o for _, o in way)
            proof = hashlib.sha256(own.hex().encode())
            proof.update(tail)
            leaves.append(digest.hex())
            proofs.append(proof.hexdigest())
            folds.append(fold(other or digest, way + rest).hex())
            siblings.append(own + b"".join(o for _, o in rest) if with_siblings else None)
        n = len(leaves)
        return pa.table({"id": ids, "leaf": leaves, "subroot": [given["subroot"].hex()] * n, "root": [given["top"].hex()] * n,
                         "proof": proofs, "folded": folds, "siblings": pa.array(siblings, pa.binary())})

    found = ways(low, above, documents, f"id {id_type}, leaf string, subroot string, root string, proof string, folded string, siblings binary")
    return found if with_siblings else found.drop("siblings")
