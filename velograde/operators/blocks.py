"""Work inside blocks of the plane: rows of a block come together, and NumPy goes through whole blocks at a time.

A block holds the nodes of a square of the grid (:func:`block`), so most edges stay inside one. What a step cannot end inside its block it gives out as rows for
another one, and the next round takes them. Memory is bounded by a block and ``ROWS`` rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velograde.shipping import ship

#: A block's side in cells is two to this power.
SIDE_BITS = 14
ROWS = 200_000
#: Half a side: blocks lie around the origin, not beside it, as many coordinates begin there.
HALF = 2 ** (SIDE_BITS - 1)
Shift = tuple[int, int]


def block(node: Column, shift: Shift = (HALF, HALF)) -> Column:
    """The block of a node, as one number; ``shift``: by how many cells along and across blocks begin before the origin."""
    x = F.shiftright(F.shiftright(node, 32) + F.lit(shift[0]), SIDE_BITS)
    y = F.shiftright(node.bitwiseAND(F.lit(2**32 - 1)) + F.lit(shift[1]), SIDE_BITS)
    return x * F.lit(2 ** (33 - SIDE_BITS)) + y


def block_of(node: np.ndarray, shift: Shift = (HALF, HALF)) -> np.ndarray:
    """:func:`block` of an array."""
    return ((node >> 32) + shift[0] >> SIDE_BITS) * 2 ** (33 - SIDE_BITS) + ((node & (2**32 - 1)) + shift[1] >> SIDE_BITS)


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole blocks, from batches in the order of blocks."""
    held, rows, look = [], 0, ROWS
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= look:
            table = pa.Table.from_batches(held)
            blocks = numbers(table, "block")
            cut = int(np.searchsorted(blocks, blocks[-1]))
            if cut:
                yield table.slice(0, cut)
                held, rows, look = table.slice(cut).to_batches(), table.num_rows - cut, ROWS
            look = max(look, 2 * rows)
    if rows:
        yield pa.Table.from_batches(held)


def by_block(rows: DataFrame, step: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``step`` over the rows (block, ...), each block in one piece."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole(batches):
            yield from step(table)

    return rows.repartition("block").sortWithinPartitions("block").mapInArrow(run, schema)


def numbers(table: pa.Table, name: str) -> np.ndarray:
    """A column without nulls as an array."""
    return table.column(name).combine_chunks().to_numpy(zero_copy_only=False)


def roots(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """The least number that a way of links u-v leads to, for each of n."""
    up = np.arange(n)
    while len(u):
        pu, pv = up[u], up[v]
        apart = pu != pv
        u, v, pu, pv = u[apart], v[apart], pu[apart], pv[apart]
        np.minimum.at(up, np.maximum(pu, pv), np.minimum(pu, pv))
        while not np.array_equal(above := up[up], up):
            up = above
    return up


PARTS = "node long, root long, z_m double, into boolean, own boolean"


def parts(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """Links (block, a, b, za, zb) of whole blocks: each node with the least node it is linked with here; ``own`` if its block is here."""
    a, b = numbers(table, "a"), numbers(table, "b")
    node, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    z, into = np.full(len(node), np.inf), np.zeros(len(node), bool)
    np.minimum.at(z, u, numbers(table, "za"))
    np.minimum.at(z, v, numbers(table, "zb"))
    into[v] = True
    own = np.isin(block_of(node), np.unique(numbers(table, "block")))
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (node, node[roots(u, v, len(node))], z, into, own)], names=["node", "root", "z_m", "into", "own"])


def skyline(grp: np.ndarray, node: np.ndarray, e: np.ndarray, d: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    """Places of the labels that no other of their group and node beats in e and d; of equal ones, one that is not fresh."""
    order = np.lexsort((fresh, -d, -e, node, grp))
    g, n, far = grp[order], node[order], d[order]
    begins = np.ones(len(order), bool)
    begins[1:] = (g[1:] != g[:-1]) | (n[1:] != n[:-1])
    # Distances of each group and node above all of those before them.
    height = far + np.cumsum(begins) * (int(far.max(initial=0)) + 1)
    keep = np.ones(len(order), bool)
    keep[1:] = height[1:] > np.maximum.accumulate(height)[:-1]
    return order[keep]


def ways(a: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of edges in the order of their beginnings ``a``, those that leave each of the nodes: places of nodes and of edges."""
    first = np.searchsorted(a, node)
    many = np.searchsorted(a, node, "right") - first
    of = np.repeat(np.arange(len(many)), many)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first, many)


LABELS = "grp long, node long, e long, d long, leaves boolean"


def coast(least: int, quantum_j: float, farthest: bool) -> Callable[[pa.Table], Iterator[pa.RecordBatch]]:
    """A step over edges (block, node, b, keep, gain_j, d: length) and labels (block, node, grp, e, d; b null): all labels that grow from these inside the blocks.

    Labels at nodes of other blocks have ``leaves``. With ``farthest`` only the label of most d of each group is given out of the others.
    """

    def step(table: pa.Table) -> Iterator[pa.RecordBatch]:
        is_edge = pc.is_valid(table.column("b"))
        edges, labels = table.filter(is_edge), table.filter(pc.invert(is_edge))
        if not labels.num_rows:
            return
        here = np.unique(numbers(table, "block"))
        a = numbers(edges, "node")
        order = np.argsort(a, kind="stable")
        a = a[order]
        b, keep, gain, length = (numbers(edges, c)[order] for c in ("b", "keep", "gain_j", "d"))
        held = [numbers(labels, c) for c in ("grp", "node", "e", "d")]
        best = skyline(*held, np.zeros(len(held[0]), bool))
        held = [x[best] for x in held]
        front = held
        while len(front[0]):
            of, edge = ways(a, front[1])
            e = np.floor((front[2][of] * quantum_j * keep[edge] + gain[edge]) / quantum_j).astype(np.int64)
            go = e > least
            of, edge = of[go], edge[go]
            grown = [front[0][of], b[edge], e[go], front[3][of] + length[edge]]
            # Only what stands at nodes that got labels is compared again.
            near = np.isin(held[1], grown[1])
            both = [np.concatenate([x[near], y]) for x, y in zip(held, grown, strict=True)]
            fresh = np.arange(len(both[0])) >= np.count_nonzero(near)
            stay = skyline(*both, fresh)
            held = [np.concatenate([x[~near], y[stay]]) for x, y in zip(held, both, strict=True)]
            new = stay[fresh[stay]]
            front = [x[new] for x in both]
        leaves = ~np.isin(block_of(held[1]), here)
        if farthest:
            # In the order of groups, then of falling distances: the first of each.
            inner = np.flatnonzero(~leaves)
            inner = inner[np.lexsort((-held[3][inner], held[0][inner]))]
            inner = inner[np.unique(held[0][inner], return_index=True)[1]]
            out = np.concatenate([inner, np.flatnonzero(leaves)])
            held, leaves = [x[out] for x in held], leaves[out]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*held, leaves)], names=["grp", "node", "e", "d", "leaves"])

    return step


BEAMS = "grp long, d long, leaves boolean"


def beam(least: int, quantum_j: float, width: int, reach: Callable[[np.ndarray, np.ndarray], np.ndarray], shift: Shift) -> Callable[[pa.Table], Iterator[pa.RecordBatch]]:
    """A step over edges (block, node, b, z: of b, keep, gain_j, d: length) and first labels (block, node, grp, e; b null), all of a group in one block: the most d of each group.

    ``reach(e, z)`` bounds the metres that are left. Groups do not see each other, so each goes on for all its rounds here; one that has to go on
    at a node of a block that is not here has ``leaves`` instead.
    """

    def step(table: pa.Table) -> Iterator[pa.RecordBatch]:
        is_edge = pc.is_valid(table.column("b"))
        edges, labels = table.filter(is_edge), table.filter(pc.invert(is_edge))
        if not labels.num_rows:
            return
        here = np.unique(numbers(table, "block"))
        a = numbers(edges, "node")
        order = np.argsort(a, kind="stable")
        a = a[order]
        b, z, keep, gain, length = (numbers(edges, c)[order] for c in ("b", "z", "keep", "gain_j", "d"))
        held = [numbers(labels, c) for c in ("grp", "node", "e")]
        held.append(np.zeros(len(held[0]), np.int64))
        groups = np.unique(held[0])
        best, gone = np.zeros(len(groups), np.int64), np.zeros(len(groups), bool)
        front = held
        while len(front[0]):
            away = ~np.isin(block_of(front[1], shift), here)
            if away.any():
                gone[np.searchsorted(groups, front[0][away])] = True
                held, front = ([x[~gone[np.searchsorted(groups, rows[0])]] for x in rows] for rows in (held, front))
            of, edge = ways(a, front[1])
            e = np.floor((front[2][of] * quantum_j * keep[edge] + gain[edge]) / quantum_j).astype(np.int64)
            go = e > least
            of, edge = of[go], edge[go]
            grown = [front[0][of], b[edge], e[go], front[3][of] + length[edge]]
            near = np.isin(held[1], grown[1])
            both = [np.concatenate([x[near], y]) for x, y in zip(held, grown, strict=True)]
            fresh = np.arange(len(both[0])) >= np.count_nonzero(near)
            stay = skyline(*both, fresh)
            held = [np.concatenate([x[~near], y[stay]]) for x, y in zip(held, both, strict=True)]
            new = stay[fresh[stay]]
            grp, node, e, d = (x[new] for x in both)
            group = np.searchsorted(groups, grp)
            np.maximum.at(best, group, d)
            hope = d + 1000.0 * reach(e, z[edge[new - np.count_nonzero(near)]])
            order = np.lexsort((-d, -e, node, -hope, grp))
            order = order[(hope > best[group])[order]]
            order = order[np.arange(len(order)) - np.searchsorted(grp[order], grp[order]) < width]
            front = [x[order] for x in (grp, node, e, d)]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (groups, best, gone)], names=["grp", "d", "leaves"])

    return step
