"""Near-duplicate embeddings by a forest of random-projection trees (operator 6).

Trees are grown on a bounded sample: each node splits at the median of a random projection, and what lies within the
spill margin of the split goes to both children. Every vector runs down all trees; vectors that meet in a leaf are
compared by cosine in double precision. Leaves larger than a block are compared block against block in separate tasks,
so no task holds more than two blocks. Equal vectors are compared once for all their rows. A pair is verified wherever
its vectors meet, counted in the first of those leaves only, and never becomes a row: leaves hand on each member's count
and a spanning forest of their links.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kontolith.llm.common import cut, map_batches, mix64
from kontolith.llm.components import connected_components


@dataclass
class Tree:
    """Inner nodes in order of creation: direction, split, children (an inner node's number, or -1 - leaf)."""

    directions: np.ndarray
    splits: np.ndarray
    children: np.ndarray
    n_leaves: int


def grow_tree(x: np.ndarray, rng: np.random.Generator, leaf: int, spill: float, max_depth: int) -> Tree:
    """Grow on the rows of ``x`` (unit vectors). A node of which over a quarter would go to both children becomes a leaf: its
    rows lie closer together than the margin, so further splits would part links or repeat rows."""
    dirs, splits, kids = [], [], []
    leaves = 0
    todo = [(np.arange(len(x)), 0, -1, 0)]
    while todo:
        rows, depth, parent, side = todo.pop()
        me = None
        if len(rows) > leaf and depth < max_depth:
            direction = rng.standard_normal(x.shape[1])
            p = x[rows] @ direction
            t = float(np.median(p))
            left, right = rows[p <= t + spill], rows[p >= t - spill]
            if len(left) + len(right) <= 1.25 * len(rows):
                me = len(dirs)
                dirs.append(direction)
                splits.append(t)
                kids.append([0, 0])
                todo += [(left, depth + 1, me, 0), (right, depth + 1, me, 1)]
        if me is None:
            me, leaves = -1 - leaves, leaves + 1
        if parent >= 0:
            kids[parent][side] = me
    return Tree(np.array(dirs).reshape(len(dirs), x.shape[1]), np.array(splits), np.array(kids, np.int64).reshape(len(kids), 2), leaves)


def route(tree: Tree, x: np.ndarray, spill: float) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and leaves of the rows of ``x``; a row is in several leaves if it came near a split."""
    if not len(tree.splits):
        return np.arange(len(x)), np.zeros(len(x), np.int64)
    rows, leaves, todo = [], [], [(0, np.arange(len(x)))]
    while todo:
        node, own = todo.pop()
        if not len(own):
            continue
        if node < 0:
            rows.append(own)
            leaves.append(np.full(len(own), -1 - node))
            continue
        p = x[own] @ tree.directions[node]
        todo += [(int(tree.children[node, 0]), own[p <= tree.splits[node] + spill]), (int(tree.children[node, 1]), own[p >= tree.splits[node] - spill])]
    return np.concatenate(rows), np.concatenate(leaves)


def _unit(x: np.ndarray) -> np.ndarray:
    big = np.abs(x).max(axis=1, keepdims=True)
    x = x / big
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _doubled(batch: pa.RecordBatch, column: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By vector length: row numbers and unit vectors of a batch."""
    flat, ends = batch.column(column).flatten().to_numpy(), np.concatenate(([0], np.cumsum(batch.column(column).value_lengths().to_numpy())))
    size = np.diff(ends)
    found = {int(n): np.flatnonzero(size == n) for n in np.unique(size)}
    return {n: (at, _unit(flat[ends[at][:, None] + np.arange(n)])) for n, at in found.items()}


def _once(cells: list[np.ndarray], own: int, left: np.ndarray, right: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Which pairs of rows meet in no cell before ``own``."""
    at = np.concatenate([np.full(len(cells[r]), r) for r in range(len(cells))]) if cells else np.empty(0, np.int64)
    flat = np.concatenate(cells) if cells else np.empty(0, np.int64)
    before = flat < own
    names, col = np.unique(flat[before], return_inverse=True)
    held = np.zeros((len(cells), len(names)), np.float32)
    held[at[before], col] = 1
    held = held[:, held.sum(0) > 1]
    if not held.shape[1]:
        return np.ones(len(p), bool)
    return (held[left] @ held[right].T)[p, q] == 0


def _spanning(p: np.ndarray, q: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a forest with the same components as the edges ``p - q`` among ``n`` nodes: each node to its component's smallest."""
    low = np.arange(n)
    while True:
        step = low.copy()
        np.minimum.at(step, p, low[q])
        np.minimum.at(step, q, low[p])
        step = step[step]
        if np.array_equal(step, low):
            break
        low = step
    at = np.flatnonzero(low != np.arange(n))
    return at, low[at]


def near_counts(vectors: DataFrame, threshold: float, trees: int, leaf: int, spill: float, sample: int, block: int, seed: int) -> DataFrame:
    """What rows ``(id, v, n)`` that meet in a leaf link to by cosine, as a table of ``(id, links, root)`` to be summed and united.

    ``links`` adds up to the weights ``n`` of the rows that ``id`` links with; ``root`` is another row that links reach, or
    null. Pairs are counted where they are found and not handed on, so the rows grow with the members of a leaf, not
    with their pairs. A pair that meets in several leaves counts in the first. ``v``: arrays of doubles, finite, not
    zero; those of each length have trees of their own.
    """
    n = vectors.count()
    share = int(1_000_000 * min(1.0, sample / max(1, n))) + 1
    picked = vectors.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1_000_000)) < share).orderBy("id", "v").select("v").collect()
    forests: dict[int, list[Tree]] = {}
    for size in sorted({len(r.v) for r in picked}):
        x = _unit(np.array([r.v for r in picked if len(r.v) == size], float))
        rng = np.random.default_rng([seed, size])
        forests[size] = [grow_tree(x, rng, leaf, spill, 40) for _ in range(trees)]  # a unit vector's projections have variance 1
    sent = vectors.sparkSession.sparkContext.broadcast(forests)  # bounded by the sample: at most sample / leaf nodes a tree

    def leaves_of(batch: pa.RecordBatch, column: int) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and cells, in order of the rows; a cell is named by length, tree and leaf."""
        rows, cells = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for size, (at, m) in _doubled(batch, column).items():
            for k, tree in enumerate(sent.value.get(size, [Tree(np.empty((0, size)), np.empty(0), np.empty((0, 2), np.int64), 1)])):
                r, c = route(tree, m, spill)
                rows.append(at[r])
                cells.append(((size * trees + k) << 32) + c)
        rows, cells = np.concatenate(rows), np.concatenate(cells)
        order = np.lexsort((cells, rows))
        return rows[order], cells[order]

    def count():
        def step(batch: pa.RecordBatch):
            names, k = np.unique(leaves_of(batch, 0)[1], return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(names), pa.array(k)], ["cell", "k"])

        return step

    # a row per leaf: bounded by the sample
    sizes = map_batches(vectors.select("v"), count, "cell long, k long").groupBy("cell").agg(F.sum("k").alias("k")).where(F.col("k") > block).collect()
    blocks = vectors.sparkSession.sparkContext.broadcast({r.cell: -(-r.k // block) for r in sizes})

    def deal():
        def step(batch: pa.RecordBatch):
            rows, cells = leaves_of(batch, 1)
            if not len(rows):
                return
            parts = np.array([blocks.value.get(c, 1) for c in cells.tolist()])
            own = (mix64(batch.column(0).to_numpy().astype(np.int64).view(np.uint64))[rows] % parts.astype(np.uint64)).astype(np.int64)
            each = np.repeat(np.arange(len(rows)), parts)
            other = np.arange(len(each)) - np.repeat(np.cumsum(parts) - parts, parts)
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(rows, np.arange(batch.num_rows + 1)).astype(np.int32)), pa.array(cells))
            for at in range(0, len(each), 2000):
                e, o = each[at : at + 2000], other[at : at + 2000]
                r = pa.array(rows[e])
                i, j = np.minimum(own[e], o), np.maximum(own[e], o)
                cols = [pa.array(cells[e]), pa.array(i), pa.array(j), pa.array(own[e]), batch.column(0).take(r), batch.column(1).take(r), batch.column(2).take(r), lists.take(r)]
                yield pa.RecordBatch.from_arrays(cols, ["cell", "i", "j", "mine", "id", "v", "n", "cells"])

        def run(batch):
            for at in range(0, batch.num_rows, 500):
                yield from step(batch.slice(at, 500))

        return run

    def compare(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        cell, i, j = (int(x) for x in key)
        ids, weight, mine = pdf["id"].to_numpy(), pdf["n"].to_numpy(), pdf["mine"].to_numpy()
        m = _unit(np.array(pdf["v"].tolist(), float).reshape(len(pdf), -1))
        left, right = (np.flatnonzero(mine == i), np.flatnonzero(mine == j)) if i != j else (np.arange(len(pdf)),) * 2
        p, q = np.nonzero(m[left] @ m[right].T >= threshold)
        a, b = left[p], right[q]
        new = ids[a] != ids[b]
        if i == j:
            new &= a < b
        links = np.zeros(len(pdf), np.int64)
        if new.any():
            p, q, a, b = p[new], q[new], a[new], b[new]
            first = _once([np.asarray(c) for c in pdf["cells"]], cell, left, right, p, q)
            np.add.at(links, a[first], weight[b[first]])
            np.add.at(links, b[first], weight[a[first]])
            at, low = _spanning(a, b, len(pdf))
        else:
            at = low = np.empty(0, np.int64)
        root = np.full(len(pdf), -1)
        root[at] = low
        some = (links > 0) | (root >= 0)
        return pd.DataFrame({"id": ids[some], "links": links[some], "root": pd.array(np.where(root < 0, 0, ids[np.maximum(root, 0)]), dtype="Int64").take(np.flatnonzero(some)), "rooted": (root >= 0)[some]})

    dealt = map_batches(vectors.select("id", "v", "n"), deal, "cell long, i long, j long, mine long, id long, v array<double>, n long, cells array<long>")
    found = dealt.groupBy("cell", "i", "j").applyInPandas(compare, "id long, links long, root long, rooted boolean")
    return cut(found.select("id", "links", F.when(F.col("rooted"), F.col("root")).alias("root")), "near")


def embedding_classes(table: DataFrame, threshold: float = 0.9, trees: int = 8, leaf: int = 64, spill: float = 0.08, sample: int = 20_000, block: int = 1024, seed: int = 11, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` per row: vectors linked directly, the smallest id that links reach, id = component.

    Null and zero vectors and those with null or non-finite components link with nothing; vectors link with those of
    their own length only. Rows that repeat an id are one node: it links if any of its vectors does. A null id links with
    nothing and has a null component. ``sample`` bounds what the trees are grown on; every row is indexed.
    """
    v = F.col(vec_col).cast("array<double>")
    finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = table.select(F.col(id_col).cast("long").alias("id"), v.alias("v"), (F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))).alias("good"))
    good = rows.where("good and id is not null").select("id", "v")
    classes = cut(good.groupBy("v").agg(F.min("id").alias("rep"), F.countDistinct("id").alias("n")), "vectors")
    near = near_counts(classes.select(F.col("rep").alias("id"), "v", "n"), threshold, trees, leaf, spill, sample, block, seed)
    same = good.join(classes.where("n > 1"), "v").select(F.col("id"), "rep", "n")
    outer = near.groupBy(F.col("id").alias("rep")).agg(F.sum("links").alias("outer"))
    member = good.select("id").distinct().join(same.groupBy("id").agg(F.min("rep").alias("rep"), F.max("n").alias("n")), "id", "left").select("id", F.coalesce("rep", "id").alias("rep"), F.coalesce("n", F.lit(1)).alias("n"))
    counted = member.join(outer, "rep", "left").select("id", (F.col("n") - 1 + F.coalesce("outer", F.lit(0))).cast("long").alias("n_links"))
    comp = connected_components(near.where("root is not null").select(F.col("id").alias("u"), F.col("root").alias("v")).distinct().union(same.where("id <> rep").select("id", "rep")))
    out = rows.select("id").join(counted, "id", "left").join(comp.withColumnRenamed("node", "id"), "id", "left")
    root = F.coalesce("component", "id")
    return out.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), root.alias("component_id"), F.coalesce(root == F.col("id"), F.lit(False)).alias("kept"))
