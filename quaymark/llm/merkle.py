"""Merkle manifest of a table of records.

A leaf is the digest of the columns of a row.  The leaves of a tree (one for each group) are ranked in order, and while
there are several nodes, every FAN consecutive ones become their digest; the roots of the trees, in the
order of their groups, become one root in the same way.

Nodes are labelled by nested intervals: a node carries the ranks [lo, hi) of the leaves below it, in its tree.  Levels are
taken in bands of BAND: all nodes of a band above one node of the level on top of the band form a cell, which is one row
of at most FAN ** BAND labelled nodes.  Upwards each cell gives one node to the next band.  Downwards the path
of each node (what stands before and after it among its siblings, level by level up to the root) is attached to the cell
below it by a join on tree and bucket, where the interval of the one contains that of the other; inside a cell, a
node's siblings are what the parent's interval has beyond its own: [parent.lo, lo) before it and [hi, parent.hi) behind it.

A tree of n leaves has about log8(n) / 3 bands, each a few hundred times smaller than the one below.  Ranks come from
ranges: a task numbers its sorted range, and the ranges' counts, summed up, give what lies before.  A group
that holds most rows, or very many equal rows, is dealt over ranges like any other.  The texts are only read where they lie.

Defined cases: a null column counts as `-`; a null group is a group and comes first; rows of equal order key go by their
leaf, equal rows are leaves of their own; a null key comes first and is never altered; an empty table has no rows and
no root; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaymark.llm.common import keep, released

FAN, BAND = 8, 3
CELL = FAN**BAND
#: The tree over the roots of all trees.
TOP = "top"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def leaf_digest(*columns: Column | str) -> Column:
    """SHA-256 (32 bytes) of the columns one after another, each as `-` if null, else its size in bytes, `:`, its value."""
    text = [(F.col(c) if isinstance(c, str) else c).cast("string") for c in columns]
    return F.unhex(F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in text]).cast("binary"), 256))


def document_leaves(docs: DataFrame) -> DataFrame:
    """(grp, key, leaf, altered): the leaf of each document, and that of its altered form if the checksum of its id says so."""
    text = F.col("text").cast("string")
    as_is, lower = (leaf_digest("doc_id", "source", "lang", "n_chars", t) for t in (text, F.translate(text, _UPPER, _LOWER)))
    altered = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, lower)
    return docs.select(F.col("lang").cast("string").alias("grp"), F.col("doc_id").cast("long").alias("key"), as_is.alias("leaf"), altered.alias("altered"))


def _h(parts: str) -> str:
    return hashlib.sha256(parts.encode()).hexdigest()


def _levels_up(n: int) -> int:
    """Levels that a band raises the nodes of a tree with n nodes: all, or as many as leave one node."""
    k = 0
    while k < BAND and FAN**k < n:
        k += 1
    return k


class Cell:
    """The nodes of one cell by levels: lists of digests (hexadecimal) with the ranks that each covers."""

    def __init__(self, digests: list[bytes], lo: np.ndarray, hi: np.ndarray, n: int) -> None:
        self.digests, self.lo, self.hi = [[d.hex() for d in digests]], [lo], [hi]
        for _ in range(_levels_up(n)):
            below, starts = self.digests[-1], np.arange(0, len(self.digests[-1]), FAN)
            self.digests.append([_h("".join(below[k : k + FAN])) for k in starts])
            self.lo.append(self.lo[-1][starts])
            self.hi.append(self.hi[-1][np.minimum(starts + FAN, len(below)) - 1])

    def root(self) -> tuple[str, int, int]:
        return self.digests[-1][0], int(self.lo[-1][0]), int(self.hi[-1][0])

    def siblings(self) -> list[tuple[np.ndarray, list[tuple[str, str]]]]:
        """By level, but the last: the place of each node's parent, and the digests before and behind the node in its parent's interval."""
        out = []
        for level in range(len(self.digests) - 1):
            lo, hi, d = self.lo[level], self.hi[level], self.digests[level]
            parent = np.searchsorted(self.lo[level + 1], lo, "right") - 1  # the interval that contains this one
            begin, end = np.searchsorted(lo, self.lo[level + 1][parent]), np.searchsorted(lo, self.hi[level + 1][parent])
            before, after = np.searchsorted(lo, lo), np.searchsorted(lo, hi)
            out.append((parent, [("".join(d[b:x]), "".join(d[y:e])) for b, x, y, e in zip(begin.tolist(), before.tolist(), after.tolist(), end.tolist(), strict=True)]))
        return out

    def paths(self) -> list[list[tuple[str, str]]]:
        """For each node of the lowest level: (before, after) of each level of the cell."""
        at, out = np.arange(len(self.digests[0])), [[] for _ in self.digests[0]]
        for parent, sides in self.siblings():
            for path, k in zip(out, at.tolist(), strict=True):
                path.append(sides[k])
            at = parent[at]
        return out


def _cells(batches: Iterator[pa.RecordBatch], *more: str) -> Iterator[tuple]:
    """(tree, cell, n, Cell, further columns...) of each row."""
    for batch in (b.slice(at, 16) for b in batches for at in range(0, b.num_rows, 16)):
        for r in batch.to_pylist():
            lo, hi = (np.asarray([m[c] for m in r["nodes"]], np.int64) for c in ("lo", "hi"))
            yield r, Cell([m["digest"] for m in r["nodes"]], lo, hi, r["n"]), *[r[c] for c in more]


def ranked(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """`rows` (written) with `rank`, from 0 in the order of `order` in each tree, and `n`, the tree's number of rows.

    `tree` is a string that is never null.  The order of rows that agree in all of `order` is that of the input.
    """

    def number(batches):
        last, seen = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            trees = batch.column(tree)
            heads = np.flatnonzero(pc.not_equal(trees.slice(1), trees.slice(0, batch.num_rows - 1)).to_numpy(zero_copy_only=False)) + 1
            starts = np.concatenate([[0], heads])
            sizes = np.diff(np.append(starts, batch.num_rows))
            at = np.arange(batch.num_rows) - np.repeat(starts, sizes)
            if trees[0].as_py() == last:
                at[: sizes[0]] += seen
            last, seen = trees[batch.num_rows - 1].as_py(), int(at[-1]) + 1
            yield batch.append_column("at", pa.array(at, pa.int64()))

    spread = rows.withColumn("__tie", F.monotonically_increasing_id())
    spread = spread.repartitionByRange(tree, *order, "__tie").sortWithinPartitions(tree, *order, "__tie").drop("__tie").withColumn("part", F.spark_partition_id())
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in spread.schema)
    numbered = keep(spread.mapInArrow(released(number), f"{kinds}, at long"), "ranges")
    sizes = numbered.groupBy(tree, "part").agg(F.count("*").alias("size"))
    whole = Window.partitionBy(tree)
    sizes = sizes.select(tree, "part", F.coalesce(F.sum("size").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("size").over(whole).alias("n"))
    return numbered.join(sizes, [tree, "part"]).withColumn("rank", F.col("at") + F.col("before")).drop("at", "before", "part")


def _band(nodes: DataFrame, name: str, *more: str) -> DataFrame:
    """Cells (written) of the nodes (tree, rank, lo, hi, digest, n): one row for each run of CELL ranks."""
    member = F.struct("rank", "lo", "hi", "digest", *more)
    cells = nodes.groupBy("tree", "n", F.floor(F.col("rank") / CELL).alias("cell")).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.array_sort(F.collect_list(member), lambda a, b: F.signum(a["rank"] - b["rank"]).cast("int")).alias("nodes"))
    return keep(cells, name)


def _up(cells: DataFrame) -> DataFrame:
    """The nodes (tree, rank, lo, hi, digest, n) of the next band: one for each cell."""

    def run(batches):
        for batch in batches:
            rows = [(r["tree"], r["cell"], c.root(), -(-r["n"] // CELL)) for r, c in _cells([batch])]
            yield pa.RecordBatch.from_pydict({
                "tree": pa.array([r[0] for r in rows], pa.string()), "rank": pa.array([r[1] for r in rows], pa.int64()), "lo": pa.array([r[2][1] for r in rows], pa.int64()), "hi": pa.array([r[2][2] for r in rows], pa.int64()),
                "digest": pa.array([bytes.fromhex(r[2][0]) for r in rows], pa.binary()), "n": pa.array([r[3] for r in rows], pa.int64()),
            })

    return cells.select("tree", "cell", "n", "nodes").mapInArrow(released(run), "tree string, rank long, lo long, hi long, digest binary, n long")


def _raise(nodes: DataFrame, name: str, *more: str) -> tuple[list[DataFrame], DataFrame]:
    """The bands of a forest, lowest first, and its roots (tree, digest)."""
    bands, most = [], nodes.agg(F.max("n")).first()[0] or 0
    while most:
        bands.append(_band(nodes, f"{name}-{len(bands)}", *(more if not bands else ())))
        nodes = _up(bands[-1])
        most = -(-most // CELL) if most > CELL else 0
    return bands, nodes.select("tree", "digest")


class Manifest(NamedTuple):
    """Cells of the trees and of the tree over their roots, bands from the lowest up; the roots of the trees."""

    trees: list[DataFrame]
    top: list[DataFrame]
    subroots: DataFrame


def build(leaves: DataFrame) -> Manifest:
    """The manifest of (grp string, key long, leaf binary, altered binary or null)."""
    rows = leaves.select(F.coalesce(F.concat(F.lit("="), F.col("grp")), F.lit("")).alias("tree"), "key", F.col("leaf").alias("digest"), "altered")
    rows = ranked(keep(rows, "leaves"), "tree", ["key", "digest"])
    trees, roots = _raise(rows.select("tree", "rank", F.col("rank").alias("lo"), (F.col("rank") + 1).alias("hi"), "digest", "n", "key", "altered"), "cells", "key", "altered")
    subroots = keep(roots, "subroots")
    over = ranked(subroots.select(F.lit(TOP).alias("tree"), F.col("tree").alias("grp"), "digest"), "tree", ["grp"])
    top, _ = _raise(over.select("tree", "rank", F.col("rank").alias("lo"), (F.col("rank") + 1).alias("hi"), "digest", "n", "grp"), "tops", "grp")
    return Manifest(trees, top, subroots)


_PATH = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))
_PATH_TYPE = "array<struct<before: string, after: string>>"


def _attached(cells: DataFrame, paths: DataFrame) -> DataFrame:
    """Cells with the path of the node on top of each: same tree and bucket, and that node's interval contains the cell's."""
    up = paths.select(F.col("tree").alias("t"), F.col("rank").alias("bucket"), F.col("lo").alias("from"), F.col("hi").alias("to"), "path", "root")
    contains = (F.col("from") <= F.col("lo")) & (F.col("hi") <= F.col("to"))
    return cells.join(up, (F.col("tree") == F.col("t")) & (F.col("cell") == F.col("bucket")) & contains).drop("t", "bucket", "from", "to")


def _down(cells: DataFrame, own: str = "tree") -> DataFrame:
    """(tree, rank, lo, hi, path, root) of the lowest nodes of the cells (tree, cell, n, nodes, path, root).

    With `own` = "grp" the nodes are the roots of the trees that they name: each is rank 0 of its own tree.
    """

    def run(batches):
        for r, cell, path, root in _cells(batches, "path", "root"):
            above = [(p["before"], p["after"]) for p in path]
            paths, of = cell.paths(), r["nodes"]
            named = [m["grp"] for m in of] if own == "grp" else [r["tree"]] * len(of)
            rank = [0] * len(of) if own == "grp" else [m["rank"] for m in of]
            yield pa.RecordBatch.from_pydict({
                "tree": pa.array(named, pa.string()), "rank": pa.array(rank, pa.int64()), "lo": pa.array([0 if own == "grp" else m["lo"] for m in of], pa.int64()),
                "hi": pa.array([1 << 62 if own == "grp" else m["hi"] for m in of], pa.int64()),
                "path": pa.array([[{"before": b, "after": a} for b, a in p + above] for p in paths], _PATH), "root": pa.array([root] * len(of), pa.string()),
            })

    return cells.mapInArrow(released(run), f"tree string, rank long, lo long, hi long, path {_PATH_TYPE}, root string")


def fold(digest: str, path: list[tuple[str, str]]) -> str:
    """The root that a leaf and its siblings lead to."""
    for before, after in path:
        digest = _h(before + digest + after)
    return digest


def verify(manifest: Manifest, proofs: bool = False) -> DataFrame:
    """(key, grp, leaf, subroot, root, proof_sha256, folded_root, verified) of each leaf; with `proofs` also `proof`, its path.

    The proof is what the siblings' digests, level by level, left to right, hash to; `folded_root` is computed from the
    altered leaf, if there is one, else from the leaf, and the original siblings.
    """

    def prove(batches):
        for r, cell, path, root, subroot in _cells(batches, "path", "root", "subroot"):
            above = [(p["before"], p["after"]) for p in path]
            tail = "".join(b + a for b, a in above)
            leaf, folded, proof, paths = cell.digests[0], [], [], cell.paths()
            for m, own, d in zip(r["nodes"], paths, leaf, strict=True):
                folded.append(fold(m["altered"].hex() if m["altered"] is not None else d, own + above))
                proof.append(_h("".join(b + a for b, a in own) + tail))
            out = {
                "key": pa.array([m["key"] for m in r["nodes"]], pa.int64()), "grp": pa.array([r["tree"][1:] if r["tree"] else None] * len(leaf), pa.string()), "leaf": pa.array(leaf),
                "subroot": pa.array([subroot] * len(leaf)), "root": pa.array([root] * len(leaf)), "proof_sha256": pa.array(proof), "folded_root": pa.array(folded), "verified": pa.array([f == root for f in folded]),
            }
            if proofs:
                out["proof"] = pa.array([[{"before": b, "after": a} for b, a in p + above] for p in paths], _PATH)
            yield pa.RecordBatch.from_pydict(out)

    spark = manifest.subroots.sparkSession
    kinds = "key long, grp string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean" + (f", proof {_PATH_TYPE}" if proofs else "")
    if not manifest.trees:
        return spark.createDataFrame([], kinds)
    root = _up(manifest.top[-1])
    paths = root.select("tree", "rank", "lo", "hi", F.from_json(F.lit("[]"), _PATH_TYPE).alias("path"), F.lower(F.hex("digest")).alias("root"))
    for k in range(len(manifest.top) - 1, -1, -1):
        paths = _down(_attached(manifest.top[k], paths), "tree" if k else "grp")
    for cells in reversed(manifest.trees[1:]):
        paths = _down(_attached(cells, paths))
    subroots = manifest.subroots.select("tree", F.lower(F.hex("digest")).alias("subroot"))
    return _attached(manifest.trees[0], paths).join(subroots, "tree").mapInArrow(released(prove), kinds)
