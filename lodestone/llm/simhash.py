"""SimHash near-duplicates by exact tiled comparison.

Fingerprints are 64-bit majority votes over word shingles. Equal fingerprints are one node from the start, so a
text with a million copies is compared once. Nodes are dealt into tiles; a pair of tiles is compared by exclusive-or
and bit counts over numpy blocks sorted by population count, skipping blocks whose population counts differ beyond
the radius. A tile pair returns a spanning forest of its links rather than the links, so dense groups cost rows in
proportion to their nodes. Components are found by star contraction in Spark.

Which tiles meet depends on the use; both rules lose no link:
* ``near_duplicates`` (small radius, 64 bits): two fingerprints cut into more blocks than they have differing bits agree
  on some blocks, so only groups agreeing on some choice of blocks are compared. The number of blocks follows the number
  of fingerprints, which keeps groups small at any size.
* ``keep_one`` (similarity 0.8, 256 bits): sets that similar have sizes within that ratio, so only tiles of the same or the
  next band of sizes meet. Work is quadratic in the texts of a band. Fingerprints only propose: inside a component of
  proposed links, pairs become links when the sets of their shingle hashes have that Jaccard similarity.

Null text counts as empty; empty texts have fingerprint zero and link like any other. Rows with the same text, or the
same id, keep a row each. A null id takes part in linking, but names a component only where no id is present. An
empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import itertools
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.text import arrow_map, slices, text_or_empty, unused
from lodestone.session import cut_lineage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

TILE = 1 << 14
STEP = 1024
#: Shingles of a tile of sets; a node counts as 32 more.
SET_TILE = 1 << 16
SEED = 42
#: Odd multipliers that derive further hash words of a shingle from its first.
MORE = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 of every shingle of one text, in reading order."""
    import xxhash

    parts = text.lower().split()  # bytes: lower-cases A-Z only and splits at ASCII white space
    if not parts:
        return np.zeros(0, np.uint64)
    joined = b" ".join(parts)
    digest = xxhash.xxh64_intdigest
    lengths = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
    ends = np.cumsum(lengths)
    width = min(width, len(parts))
    begins = (ends - lengths)[: len(parts) - width + 1].tolist()
    stops = (ends - 1)[width - 1:].tolist()
    return np.fromiter((digest(joined[s:e], SEED) for s, e in zip(begins, stops)), "<u8", len(begins))


def votes(found: np.ndarray, words: int = 1) -> np.ndarray:
    """Fingerprint of shingle hashes as 64-bit words. A bit is set when more than half of the hashes set it; the first
    word is the fingerprint over plain XXH64."""
    counts = np.zeros(64 * words, np.int64)
    for a in range(0, len(found), 1 << 15):  # bounds the unpacked bits of a very long text
        hashes = found[a: a + (1 << 15)]
        table = np.empty((len(hashes), words), "<u8")
        table[:, 0] = hashes
        for k in range(1, words):
            h = hashes * MORE[k - 1]
            table[:, k] = (h ^ (h >> np.uint64(32))) * MORE[k - 1] ^ (h >> np.uint64(29))
        counts += np.unpackbits(table.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return np.packbits(2 * counts > len(found), bitorder="little").view("<u8")


def fingerprints(docs: DataFrame, width: int = 4, words: int = 1, id_column: str = "doc_id", text_column: str = "text",
                 keys: tuple[Column, ...] = (), distinct: bool = False) -> DataFrame:
    """(doc_id, further columns given in ``keys``, fp array of signed 64-bit words, shingles) per row. With ``distinct`` a
    repeated shingle votes and counts once."""
    rows = docs.select(docs[f"`{id_column}`"].alias("doc_id"), *keys, text_or_empty(text_column).alias("text"))
    kept = [f for f in rows.schema if f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = []
            for t in batch.column("text").cast(pa.binary()).to_pylist():
                hashes = shingle_hashes(t, width)
                hashes = np.unique(hashes) if distinct else hashes
                found.append((votes(hashes, words).view(np.int64).tolist(), len(hashes)))
            fp = pa.array([f for f, _ in found], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(f.name) for f in kept] + [fp, pa.array([n for _, n in found], pa.int64())],
                                             [f.name for f in kept] + ["fp", "shingles"])

    return arrow_map(rows, run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept) + ", fp array<bigint>, shingles long")


def block_plan(n: int, radius: int, group: int = 4096) -> tuple[int, list[tuple[int, ...]]]:
    """How many blocks to cut 64 bits into, and the choices of blocks that links must agree on one of.

    More blocks agree on more bits, so random groups stay near ``group`` rows, at the price of more choices.
    """
    for blocks in range(radius + 1, 2 * radius + 2):
        agreeing = blocks - radius
        if n / 2 ** (agreeing * (64 // blocks)) <= group:
            break
    return blocks, list(itertools.combinations(range(blocks), agreeing))


def masks(blocks: int, choices: list[tuple[int, ...]]) -> list[int]:
    """Bits of each choice, as signed longs."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    bits = [sum(1 << b for b in range(edges[i], edges[i + 1])) for i in range(blocks)]
    return [int(np.uint64(sum(bits[i] for i in choice)).astype(np.int64)) for choice in choices]


def roots(pairs: np.ndarray, n: int) -> np.ndarray:
    """Smallest node each of n nodes is connected to through ``pairs`` (two rows of node numbers)."""
    label = np.arange(n)
    a, b = pairs
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new[new]]
        if np.array_equal(new, label):
            return label
        label = new


def bit_counts(words: np.ndarray) -> np.ndarray:
    return np.bitwise_count(words).sum(axis=1, dtype=np.int64)


def tile_links(left: np.ndarray, right: np.ndarray | None, radius: int, earlier: np.ndarray) -> np.ndarray:
    """Spanning forest of the links within a tile (``right`` is None) or between two, as two rows of positions;
    positions of ``right`` follow those of ``left``. Tiles are sorted by population count, one row of words a node.

    ``earlier``: masks of choices tried before; a pair that agrees on one of them was linked there.
    """
    other = left if right is None else right
    shift = 0 if right is None else len(left)
    n = shift + len(other)
    a_pop, b_pop = bit_counts(left), bit_counts(other)
    forest = np.zeros((2, 0), np.int64)
    for i in range(0, len(left), STEP):
        rows, low, high = left[i: i + STEP], a_pop[i], a_pop[min(i + STEP, len(left)) - 1]
        for j in range(i if right is None else 0, len(other), STEP):
            if b_pop[j] > high + radius or b_pop[min(j + STEP, len(other)) - 1] < low - radius:
                continue
            columns = other[j: j + STEP]
            apart = np.bitwise_count(rows[:, None, 0] ^ columns[None, :, 0]).astype(np.uint16)
            for k in range(1, rows.shape[1]):
                apart += np.bitwise_count(rows[:, None, k] ^ columns[None, :, k])
            a, b = np.nonzero(apart <= radius)
            if right is None and i == j:
                a, b = a[a < b], b[a < b]
            if len(a) and len(earlier):
                agree = ((rows[a, 0] ^ columns[b, 0])[:, None] & earlier == 0).any(axis=1)
                a, b = a[~agree], b[~agree]
            if len(a):
                forest = np.concatenate([forest, np.stack([a + i, b + j + shift])], axis=1)
                if forest.shape[1] > 2 * n:  # keep no more links than nodes
                    forest = stars(forest, n)
    return stars(forest, n)


def stars(pairs: np.ndarray, n: int) -> np.ndarray:
    label = roots(pairs, n)
    child = np.flatnonzero(label != np.arange(n))
    return np.stack([label[child], child])


def compared(tile_pairs: DataFrame, radius: int, earlier: list[int]) -> DataFrame:
    """(a, b) links that connect what all links connect. ``tile_pairs``: choice, left and right as arrays of
    struct(pop, node, fp) in ascending order; right is null for a tile with itself."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.array(earlier, np.int64).view(np.uint64)

        def nodes_of(tile: pa.ListScalar) -> tuple[np.ndarray, np.ndarray]:
            rows = tile.values
            fps = rows.field("fp")
            values = fps.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            return rows.field("node").to_numpy(zero_copy_only=False), values.reshape(len(rows), -1)

        for batch in batches:
            found = [np.zeros((2, 0), np.int64)]
            for choice, left, right in zip(*(batch.column(i) for i in range(3))):
                ids, words = nodes_of(left)
                others, more = nodes_of(right) if right.is_valid else (ids[:0], None)
                links = tile_links(words, more, radius, bits[: choice.as_py()])
                if links.shape[1]:
                    found.append(np.concatenate([ids, others])[links])
            a, b = np.concatenate(found, axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return arrow_map(tile_pairs.select("choice", "left", "right"), run, "a long, b long").distinct()


def tile_of(nodes: DataFrame, group: list[str], tile: int) -> DataFrame:
    """Nodes (group columns, node, pop, fp) as tiles (group columns, tile, low, high, members). A group beyond ``tile``
    nodes is cut by population count, and a count beyond that by hash, so no task gets an unbounded group."""
    spread = nodes.groupBy(*group, "pop").agg(F.count("*").alias("n"))
    sizes = spread.groupBy(*group).agg(F.sum("n").alias("total"), F.collect_list(F.struct("pop", "n")).alias("pops"))
    plan = sizes.where("total > 1").select(*group, "total", F.explode("pops").alias("p")).select(
        *group, F.col("p.pop").alias("pop"), F.when(F.col("total") <= tile, F.lit(-1)).otherwise(F.col("p.pop")).alias("part"),
        F.when(F.col("total") <= tile, F.lit(1)).otherwise(F.ceil(F.col("p.n") / tile)).cast("int").alias("of"))
    dealt = nodes.join(plan, [*group, "pop"]).withColumn("tile", F.pmod(F.xxhash64("node"), F.col("of")).cast("int"))
    return dealt.groupBy(*group, "part", "tile").agg(
        F.min("pop").alias("low"), F.max("pop").alias("high"), F.array_sort(F.collect_list(F.struct("pop", "node", "fp"))).alias("members"))


def block_links(nodes: DataFrame, n: int, radius: int) -> DataFrame:
    """Links of 64-bit fingerprints (node, fp) within ``radius``: tiles of nodes that agree on a choice of blocks."""
    blocks, choices = block_plan(n, radius)
    bits = masks(blocks, choices)
    keyed = nodes.select("node", "fp", F.bit_count(F.col("fp")[0]).alias("pop"), F.posexplode(F.array(*[
        F.col("fp")[0].bitwiseAND(F.lit(m)) for m in bits])).alias("choice", "key"))
    tiles = tile_of(keyed, ["choice", "key"], TILE)
    alone = tiles.select("choice", F.col("members").alias("left"), F.lit(None).cast(tiles.schema["members"].dataType).alias("right"))
    large = tiles.where("part >= 0")
    pairs = large.alias("a").join(large.alias("b"), (F.col("a.choice") == F.col("b.choice")) & (F.col("a.key") == F.col("b.key"))
                                  & (F.col("b.part") - F.col("a.part") <= radius)
                                  & (F.struct("a.part", "a.tile") < F.struct("b.part", "b.tile")))
    pairs = pairs.select(F.col("a.choice").alias("choice"), F.col("a.members").alias("left"), F.col("b.members").alias("right"))
    return compared(alone.unionByName(pairs), radius, bits)


def band_links(nodes: DataFrame, radius: int, similarity: float) -> DataFrame:
    """Links of (node, fp, shingles) within ``radius`` in the same or the next band of shingle counts, which holds every pair
    with counts in the ratio ``similarity`` or nearer."""
    band = F.floor(F.log(F.greatest("shingles", F.lit(1)).cast("double")) / float(-np.log(similarity)) + 1e-9).cast("int")
    pop = F.aggregate("fp", F.lit(0), lambda total, word: total + F.bit_count(word))
    banded = nodes.select(band.alias("band"), "node", pop.alias("pop"), "fp")
    spread = banded.groupBy("band").agg(F.ceil(F.count("*") / (TILE // 4)).cast("int").alias("of"))
    tiles = banded.join(spread, "band").withColumn("tile", F.pmod(F.xxhash64("node"), F.col("of")).cast("int")).groupBy("band", "tile").agg(
        F.array_sort(F.collect_list(F.struct("pop", "node", "fp"))).alias("members"))
    tiles = cut_lineage(tiles)
    other = tiles.select(F.explode(F.array("band", F.col("band") - 1)).alias("meets"), F.col("band").alias("b_band"),
                         F.col("tile").alias("b_tile"), F.col("members").alias("right"))
    pairs = tiles.join(other, (F.col("band") == F.col("meets")) & ((F.col("b_band") > F.col("band")) | (F.col("b_tile") >= F.col("tile"))))
    itself = (F.col("b_band") == F.col("band")) & (F.col("b_tile") == F.col("tile"))
    pairs = pairs.select(F.lit(0).alias("choice"), F.col("members").alias("left"), F.when(~itself, F.col("right")).alias("right"))
    return compared(pairs, radius, [])


def similar_links(fps: np.ndarray, sets: list[np.ndarray], cut: int, radius: int, similarity: float) -> np.ndarray:
    """Spanning forest, as two rows of positions, of the pairs with Jaccard similarity ``similarity`` or more among those
    within ``radius``. The first ``cut`` nodes meet the others; if there are no others, they meet each other.

    ``fps``: one row of words a node; ``sets``: ascending distinct shingle hashes. Pairs already connected are not compared.
    """
    sizes, label, links = np.array([len(s) for s in sets]), np.arange(len(sets)), []
    for i in range(cut):
        left = np.arange(i + 1 if cut == len(sets) else cut, len(sets))
        small, large = np.minimum(sizes[left], sizes[i]), np.maximum(sizes[left], sizes[i])
        left = left[(small / np.maximum(large, 1) >= similarity) | (large == 0)]
        left = left[bit_counts(fps[left] ^ fps[i]) <= radius]
        left, step = left[label[left] != label[i]], 1
        while len(left):
            some, left, step = left[:step], left[step:], 4 * step
            if sizes[i]:  # then no set of ``some`` is empty
                hashes = np.concatenate([sets[j] for j in some])
                at = np.minimum(np.searchsorted(sets[i], hashes), sizes[i] - 1)
                common = np.add.reduceat((sets[i][at] == hashes).astype(np.int64), np.cumsum(sizes[some]) - sizes[some])
                some = some[common / (sizes[some] + sizes[i] - common) >= similarity]
            for j in some:
                if label[j] != label[i]:
                    label[label == label[j]] = label[i]
                    links.append((i, j))
            left = left[label[left] != label[i]]
    return np.array(links, np.int64).reshape(-1, 2).T


def verified(members: DataFrame, width: int, radius: int, similarity: float) -> DataFrame:
    """(a, b) links that connect what all similar pairs inside a ``root`` connect. ``members``: root, node, fp, shingles, text.

    A root with many shingles is dealt into tiles by node, and every pair of its tiles is a row of its own.
    """
    total = members.groupBy("root").agg(F.ceil(F.sum(F.col("shingles") + 32) / SET_TILE).cast("int").alias("of"))
    rows = members.join(total, "root").select("root", "of", F.pmod(F.xxhash64("node"), F.col("of")).cast("int").alias("tile"), "node", "fp", "text")

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = [np.unique(shingle_hashes(t, width)).view(np.int64) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sets, pa.list_(pa.int64()))], ["root", "of", "tile", "node", "fp", "hashes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def nodes_of(tile: pa.ListScalar) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
            rows = tile.values
            flat = [rows.field(name).flatten().to_numpy(zero_copy_only=False).view(np.uint64) for name in ("fp", "hashes")]
            ends = np.cumsum(rows.field("hashes").value_lengths().to_numpy(zero_copy_only=False))
            return rows.field("node").to_numpy(zero_copy_only=False), flat[0].reshape(len(rows), -1), np.split(flat[1], ends[:-1])

        for batch in batches:
            found = [np.zeros((2, 0), np.int64)]
            for left, right in zip(batch.column(0), batch.column(1)):
                ids, fps, sets = nodes_of(left)
                cut = len(ids)
                if right.is_valid:
                    more = nodes_of(right)
                    ids, fps, sets = np.concatenate([ids, more[0]]), np.concatenate([fps, more[1]]), sets + more[2]
                found.append(ids[similar_links(fps, sets, cut, radius, similarity)])
            a, b = np.concatenate(found, axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    sets = arrow_map(rows, sets_of, "root long, of int, tile int, node long, fp array<bigint>, hashes array<bigint>")
    tiles = cut_lineage(sets.groupBy("root", "of", "tile").agg(F.collect_list(F.struct("node", "fp", "hashes")).alias("members")))
    low = tiles.select("root", F.col("tile").alias("low"), F.explode(F.sequence("tile", F.col("of") - 1)).alias("high"), F.col("members").alias("left"))
    high = tiles.where("tile > 0").select("root", F.explode(F.sequence(F.lit(0), F.col("tile") - 1)).alias("low"), F.col("tile").alias("high"),
                                          F.col("members").alias("right"))
    pairs = low.join(high, ["root", "low", "high"], "left").where("low = high or right is not null")
    return arrow_map(pairs.select("left", "right"), run, "a long, b long")


def star_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): alternating large and small stars until all edges are stars.

    Each round is two aggregations and joins on the node, checkpointed, so a lost executor repeats one round.
    A root is the smallest node of its component.
    """
    edges = cut_lineage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    while True:
        seen = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(
            edges.select("v", F.lit(0), F.lit(1))).groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        if seen.where("up > 1 or up = 1 and down = 1").isEmpty():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            low.where("m < u").select("u", F.col("m").alias("v"))).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            down.select("u", F.col("m").alias("v")))
        edges = cut_lineage(small.where("u <> v").distinct())


def near_duplicates(docs: DataFrame, width: int = 4, radius: int = 4, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, fp long, component_id) per row of ``docs``; component_id is the smallest id that links reach.

    The fingerprints, some 30 bytes a document, are checkpointed because several steps read them.
    """
    marked = cut_lineage(fingerprints(docs, width, 1, id_column, text_column).select("doc_id", F.col("fp")[0].alias("fp")))
    nodes = cut_lineage(marked.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    linked = star_components(block_links(nodes.select(F.col("fp").alias("node"), F.array("fp").alias("fp")), nodes.count(), radius))
    member = nodes.join(linked, nodes.fp == linked.node, "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    least = member.groupBy("root").agg(F.min("least_id").alias("component_id"))
    return marked.join(member.join(least, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, width: int = 5, similarity: float = 0.8, radius: int = 72, id_column: str = "doc_id",
             text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each component the row with the smallest id stays.

    Links: pairs whose sets of shingles have Jaccard similarity ``similarity`` or more, up to equal 64-bit hashes of
    different shingles. Compared are pairs with 256-bit fingerprints over distinct shingles at most ``radius`` apart. Sets of
    similarity 0.8 differ in 39 of 256 bits on average (48 for sets of four and five) with deviation 6, so fewer than one
    pair in ten million at that limit is missed (one in ten thousand of the smallest), and more similar ones are nearer.
    Of rows with the same id, the one with the smallest text hash counts as first; a repeated row stays once. Rows
    without an id come after the others.
    """
    mark = F.xxhash64(text_or_empty(text_column))
    marked = cut_lineage(fingerprints(docs, width, 4, id_column, text_column, (mark.alias("node"),), distinct=True))
    first = F.struct(F.col("doc_id").isNull().alias("missing"), F.col("doc_id"), F.col("node"))
    nodes = cut_lineage(marked.groupBy("node").agg(F.min(first).alias("first"), F.first("fp").alias("fp"), F.first("shingles").alias("shingles")))
    near = star_components(band_links(nodes.select("node", "fp", "shingles"), radius, similarity))
    near = near.unionByName(near.select(F.col("root").alias("node"), "root").distinct()).join(nodes, "node")
    # Of each distinct text in question one row is read again; equal rows of one id are one member.
    near = near.select("root", "node", "fp", "shingles", F.col("first.doc_id").alias("first_id"))
    texts = docs.select(docs[f"`{id_column}`"].alias("doc_id"), mark.alias("mark"), text_or_empty(text_column).alias("text"))
    texts = texts.join(near, texts["doc_id"].eqNullSafe(near["first_id"]) & (texts["mark"] == near["node"])).dropDuplicates(["doc_id", "mark"])
    texts = cut_lineage(texts.select("root", "node", "fp", "shingles", "text"))
    linked = star_components(verified(texts, width, radius, similarity))
    roots_of = nodes.join(linked, "node", "left").select(F.coalesce("root", "node").alias("root"), "first")
    stay_id, stay_node = unused(docs, "stay_id"), unused(docs, "stay_node")
    stays = roots_of.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.doc_id").alias(stay_id), F.col("first.node").alias(stay_node))
    kept = docs.join(stays, docs[f"`{id_column}`"].eqNullSafe(stays[stay_id]) & (mark == stays[stay_node]))
    # Equal rows were dealt to one partition by the join, so dropping repeats needs no further shuffle.
    return kept.dropDuplicates([id_column, stay_node]).drop(stay_id, stay_node)
