"""Merkle manifest of a documents table, its trees stored in van Emde Boas order (operator 11).

A row's leaf is the SHA-256 of its five columns, each as ``-`` or ``bytes:value``. The leaves of a source, by ascending doc_id,
are the bottom of a tree of arity three; the roots of the sources, by source, are the bottom of one more tree. Hashes
are taken over digests as hex text; digests are stored as 32 bytes.

A tree is cut into aligned subtrees of ``LEVELS`` levels (729 entries). Each is one row, its nodes in one byte string:
the subtree is split at half its height, the upper part comes first, then the lower parts from left to right, each laid
out by the same rule. ``address`` gives a node's place by arithmetic; the nodes that a ragged subtree lacks are left out of
the string. Construction fills a block at these places and retrieval of siblings reads them there. The roots of the blocks
are the entries of the next layer of blocks, so every task holds a few blocks, however large a source is, and the number of
layers is the logarithm of the largest tree to the base 729.

Positions come from a range partitioning by (source, doc_id) and the counts per source and partition: no source has to
fit into one task. Paths to the root go down the layers by joins of blocks; a document meets its block only, in a cogroup.

Nulls in any column, null doc_id included, are hashed as ``-``; a null source is a tree of its own, before all others, and a
null doc_id comes first in its source. Rows that share a doc_id are ordered by their leaf; equal rows are leaves of their
own. Long texts are hashed as a whole in the JVM. Other columns are ignored. An empty table has no root and gives no row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from skylag.llm.tables import written

ARITY = 3
#: Levels of a block above its entries, and its entries.
LEVELS = 6
ENTRIES = ARITY ** LEVELS
HASHED = ("doc_id", "source", "lang", "n_chars", "text")

BLOCK = "tree string, block bigint, total bigint, n int, nodes binary"
PATH = "tree string, block bigint, path binary, subroot binary"
PROOF = "doc_id bigint, leaf string, subroot string, proof_sha256 string, folded_root string"


def encoded(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(**replaced: Column) -> Column:
    """A row's leaf as 32 bytes; columns can be replaced by an expression."""
    parts = [encoded(replaced.get(name, F.col(name))) for name in HASHED]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def parent(children: bytes) -> bytes:
    return hashlib.sha256(children.hex().encode()).digest()


def nodes_of(height: int) -> int:
    return (ARITY ** height - 1) // (ARITY - 1)


def address(height: int, depth: int, index: np.ndarray) -> np.ndarray:
    """Places of the nodes ``index`` of a depth (the root has 0) in a full tree with ``height`` rows of nodes."""
    if height == 1:
        return np.zeros_like(index)
    top = height // 2
    if depth < top:
        return address(top, depth, index)
    width = ARITY ** (depth - top)
    return nodes_of(top) + index // width * nodes_of(height - top) + address(height - top, depth - top, index % width)


@lru_cache(maxsize=128)
def layout(levels: int, n: int) -> tuple[tuple[np.ndarray, ...], int]:
    """Places of the nodes of each level, entries first, in a stored block of n entries; and the number of nodes."""
    counts = [n]
    for _ in range(levels):
        counts.append(-(-counts[-1] // ARITY))
    full = [address(levels + 1, levels - level, np.arange(c)) for level, c in enumerate(counts)]
    order = np.argsort(np.concatenate(full))
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    return tuple(np.split(place, np.cumsum(counts)[:-1])), len(order)


def levels_of(total: int, n: int) -> int:
    """Levels that a block has above its n entries: all where the tree goes on above, else up to the tree's root."""
    if total > ENTRIES:
        return LEVELS
    levels = 0
    while n > 1:
        n, levels = -(-n // ARITY), levels + 1
    return levels


def build_block(total: int, entries: list[bytes]) -> bytes:
    """The nodes of a block in stored order."""
    places, size = layout(levels_of(total, len(entries)), len(entries))
    nodes: list[bytes] = [b""] * size
    for place, digest in zip(places[0], entries):
        nodes[place] = digest
    for below, above in zip(places, places[1:]):
        for k, place in enumerate(above):
            nodes[place] = parent(b"".join([nodes[p] for p in below[ARITY * k:ARITY * k + ARITY]]))
    return b"".join(nodes)


def siblings(total: int, n: int, nodes: bytes, entry: int) -> list[tuple[bytes, bytes]]:
    """Level by level, what stands left and right of the node above ``entry`` in its run."""
    places, _ = layout(levels_of(total, n), n)
    out = []
    for level in places[:-1]:
        first = entry // ARITY * ARITY
        run = [nodes[32 * p:32 * p + 32] for p in level[first:first + ARITY].tolist()]
        out.append((b"".join(run[:entry - first]), b"".join(run[entry - first + 1:])))
        entry //= ARITY
    return out


def packed(path: list[tuple[bytes, bytes]]) -> bytes:
    return b"".join(bytes([len(a) // 32, len(b) // 32]) + a + b for a, b in path)


def unpacked(path: bytes) -> list[tuple[bytes, bytes]]:
    out, at = [], 0
    while at < len(path):
        a, b = 32 * path[at], 32 * path[at + 1]
        out.append((path[at + 2:at + 2 + a], path[at + 2 + a:at + 2 + a + b]))
        at += 2 + a + b
    return out


def fold(digest: bytes, path: list[tuple[bytes, bytes]]) -> bytes:
    for left, right in path:
        digest = parent(left + digest + right)
    return digest


def _numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """Rows with ``position`` in their ``tree`` and its ``total``; ``order`` must keep the rows of a tree together."""
    placed = written(rows.repartitionByRange(*order).sortWithinPartitions(*order)
                     .withColumn("place", F.monotonically_increasing_id()), "places")
    placed = placed.withColumn("part", F.shiftright("place", 33))
    runs = placed.groupBy("tree", "part").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("rows"))
    whole = Window.partitionBy("tree")
    earlier = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.select("tree", "part", (F.coalesce(F.sum("rows").over(earlier), F.lit(0)) - F.col("first")).alias("shift"),
                         F.sum("rows").over(whole).alias("total"))
    return (placed.join(starts, ["tree", "part"]).withColumn("position", F.col("place") + F.col("shift"))
            .drop("part", "place", "shift"))


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.to_pydict()
        nodes = [build_block(t, e) for t, e in zip(rows["total"], rows["entries"])]
        yield pa.RecordBatch.from_arrays(
            [batch.column("tree"), batch.column("block"), batch.column("total"),
             pa.array([len(e) for e in rows["entries"]], pa.int32()), pa.array(nodes, pa.binary())],
            names=["tree", "block", "total", "n", "nodes"])


def _layers(entries: DataFrame) -> list[DataFrame]:
    """Entries (tree, position, total, digest) to layers of blocks, the lowest first. A layer's blocks with ``total`` up to
    ``ENTRIES`` hold the root of their tree, the others go on as entries of the next."""
    layers = []
    while True:
        members = F.transform(F.sort_array(F.collect_list(F.struct("position", "digest"))), lambda e: e["digest"])
        grouped = (entries.groupBy("tree", F.expr(f"position div {ENTRIES}").alias("block"))
                   .agg(F.max("total").alias("total"), members.alias("entries")))
        blocks = written(grouped.mapInArrow(_build, BLOCK), "blocks")
        layers.append(blocks)
        largest = blocks.agg(F.max("total")).first()[0]
        if largest is None or largest <= ENTRIES:
            return layers
        entries = blocks.filter(F.col("total") > ENTRIES).select(
            "tree", F.col("block").alias("position"),
            F.expr(f"(total + {ENTRIES - 1}) div {ENTRIES}").alias("total"), _root().alias("digest"))


def _root() -> Column:
    return F.substring("nodes", 1, 32)


def _roots(layers: list[DataFrame]) -> DataFrame:
    """(tree, digest) of every tree's root."""
    found = [layer.filter(F.col("total") <= ENTRIES).select("tree", _root().alias("digest")) for layer in layers]
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def _descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks with their own path to one row per entry with its path; the entry is a block of the layer below."""
    for batch in batches:
        for row in batch.to_pylist():
            paths = [packed(siblings(row["total"], row["n"], row["nodes"], e)) + row["path"] for e in range(row["n"])]
            first = row["block"] * ENTRIES
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["tree"]] * row["n"], pa.string()), pa.array(range(first, first + row["n"]), pa.int64()),
                 pa.array(paths, pa.binary()), pa.array([row["subroot"]] * row["n"], pa.binary())],
                names=["tree", "block", "path", "subroot"])


def _with_paths(layers: list[DataFrame], starts: DataFrame) -> DataFrame:
    """The lowest layer's blocks with ``path`` to the end of ``starts`` (tree, path, subroot)."""
    above = None
    for layer in reversed(layers):
        rows = layer.filter(F.col("total") <= ENTRIES).join(starts, "tree")
        if above is not None:
            inner = layer.filter(F.col("total") > ENTRIES).join(above, ["tree", "block"])
            rows = rows.unionByName(inner)
        above = rows.mapInArrow(_descend, PATH)
    return rows


@dataclass
class Manifest:
    """Written tables: the leaves with their positions, the blocks of the sources' trees, those of the tree above."""

    leaves: DataFrame
    sources: list[DataFrame]
    top: list[DataFrame]
    subroots: DataFrame
    root: bytes | None


def build(docs: DataFrame, claim: Column | None = None) -> Manifest:
    """The manifest of ``docs``. ``claim`` is the leaf to hold against it later, as 32 bytes; by default the row's own."""
    leaf = leaf_digest()
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source"), encoded(F.col("source")).alias("tree"),
                       leaf.alias("digest"), (leaf if claim is None else claim).alias("claim"))
    leaves = _numbered(written(rows, "leaves"), ["source", "doc_id", "digest"])
    sources = _layers(leaves.select("tree", "position", "total", "digest"))
    name = F.when(F.col("tree") != "-", F.expr("substring(tree, instr(tree, ':') + 1)"))
    roots = _roots(sources).select(F.lit("").alias("tree"), F.col("tree").alias("member"), name.alias("source"), "digest")
    subroots = _numbered(roots, ["source"])
    top = _layers(subroots.select("tree", "position", "total", "digest"))
    last = _roots(top).first()
    return Manifest(leaves, sources, top, subroots, bytes(last["digest"]) if last else None)


def _prove(rows: pa.Table, blocks: pa.Table) -> pa.Table:
    """The documents of one block (729 at most) against it."""
    (block,) = blocks.to_pylist()
    above, out = unpacked(block["path"]), []
    for row in rows.to_pylist():
        own = siblings(block["total"], block["n"], block["nodes"], row["position"] % ENTRIES)
        path = own + above
        proof = hashlib.sha256(b"".join(a + b for a, b in path).hex().encode()).hexdigest()
        out.append((row["doc_id"], row["digest"].hex(), block["subroot"].hex(), proof, fold(row["claim"], path).hex()))
    kinds = [pa.int64(), *[pa.string()] * 4]
    names = ["doc_id", "leaf", "subroot", "proof_sha256", "folded_root"]
    return pa.table([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names=names)


def verify(manifest: Manifest) -> DataFrame:
    """Per row: doc_id, leaf, subroot, root, proof_sha256, folded_root (from the claimed leaf), verified."""
    start = manifest.subroots.limit(0).sparkSession.createDataFrame([("", b"", b"")], "tree string, path binary, subroot binary")
    members = _with_paths(manifest.top, start).mapInArrow(_descend, PATH).select(F.col("block").alias("position"), "path")
    starts = (members.join(manifest.subroots, "position")
              .select(F.col("member").alias("tree"), "path", F.col("digest").alias("subroot")))
    blocks = _with_paths(manifest.sources, starts)
    rows = manifest.leaves.select("tree", F.expr(f"position div {ENTRIES}").alias("block"), "position", "doc_id", "digest", "claim")
    proven = rows.groupBy("tree", "block").cogroup(blocks.groupBy("tree", "block")).applyInArrow(_prove, PROOF)
    root = F.lit(manifest.root.hex() if manifest.root else None).cast("string")
    return proven.select("doc_id", "leaf", "subroot", root.alias("root"), "proof_sha256", "folded_root",
                         F.coalesce(F.col("folded_root") == root, F.lit(False)).alias("verified"))


def tampered_leaf() -> Column:
    """The leaf after every line feed of the text is gone, where the checksum of doc_id is even; else the row's own."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return F.when(hit, leaf_digest(text=F.replace(F.col("text"), F.lit("\n"), F.lit("")))).otherwise(leaf_digest())
