"""The road graph: nodes from shared ends of edges, and components inside it.

An edge's ends are its first and last sample, snapped to a grid in metres; ends in one cell are one
node, and a node's elevation is the lowest of its ends. So edges agree about heights, and what a rider loses on
one edge another does not give back.

Components are found inside blocks of the plane first; what is left are links between the blocks' parts. These come from a table of parents: each round every node takes the least parent that it, its
parent or a neighbour's grandparent offers, which are minima over groups (combined before the shuffle), and
paths to roots halve. Rounds grow with the logarithm of the nodes.

Defined cases: an edge of which an end has a null or non-finite coordinate is in no graph (:func:`unplaced` lists it with the reason);
edges with both ends in one node stay as edges, and link nothing; repeated edges are edges of their own; edges with a null id are one edge per group of
samples, as in the other operators; empty tables give empty graphs; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velograde.functions.physics import finite
from velograde.operators import blocks
from velograde.operators.profiles import with_chainage
from velograde.sources.scratch import Scratch

SNAP_M = 1.0


def node_id(x: Column, y: Column, snap_m: float = SNAP_M) -> Column:
    """The grid cell around a point, as one number: both coordinates must lie within 2**31 cells of the origin."""
    cell = lambda c: F.floor(c / snap_m + 0.5)
    return cell(x) * F.lit(2**32) + cell(y) + F.lit(2**31)


def _ends(samples: DataFrame) -> DataFrame:
    place = F.struct("x_m", "y_m", "elevation_m")
    return with_chainage(samples.select("edge_id", "sample_idx", "x_m", "y_m", "elevation_m")).groupBy("edge_id").agg(F.min_by(place, "sample_idx").alias("p"), F.max_by(place, "sample_idx").alias("q"), F.max("chainage_m").alias("horizontal_length_m"))


def _placed() -> Column:
    ok = F.lit(True)
    for end in ("p", "q"):
        for c in ("x_m", "y_m", "elevation_m"):
            ok = ok & finite(F.col(f"{end}.{c}"))
    return ok & (F.col("horizontal_length_m") > 0)


def network(samples: DataFrame, snap_m: float = SNAP_M) -> DataFrame:
    """(edge_id, a, b, za, zb, horizontal_length_m) of sampled edges: from node a to node b, with the nodes' elevations."""
    return network_of_ends(_ends(samples), snap_m)


def network_of_ends(ends: DataFrame, snap_m: float = SNAP_M) -> DataFrame:
    """The same of edges (edge_id, p, q, horizontal_length_m) with the ends p and q, each row an edge whatever its id."""
    ends = ends.where(_placed())
    ends = ends.select("edge_id", *[node_id(F.col(f"{e}.x_m"), F.col(f"{e}.y_m"), snap_m).alias(n) for e, n in (("p", "a"), ("q", "b"))], F.col("p.elevation_m").alias("za"), F.col("q.elevation_m").alias("zb"), "horizontal_length_m")
    # Both are read several times.
    scratch = Scratch(ends.sparkSession, "ends")
    ends = scratch.keep(ends)
    both = ends.select(F.col("a").alias("node"), F.col("za").alias("z")).union(ends.select("b", "zb"))
    heights = scratch.keep(both.groupBy("node").agg(F.min("z").alias("z")))
    of = lambda n: heights.select(F.col("node").alias(n), F.col("z").alias(f"z{n}"))
    return ends.drop("za", "zb").join(of("a"), "a").join(of("b"), "b").select("edge_id", "a", "b", "za", "zb", "horizontal_length_m")


def unplaced(samples: DataFrame) -> DataFrame:
    """(edge_id, reason): edges that have no place in the graph."""
    at = F.when(~(finite(F.col("p.x_m")) & finite(F.col("p.y_m")) & finite(F.col("q.x_m")) & finite(F.col("q.y_m"))), "missing_coordinates")
    at = at.when(~(finite(F.col("p.elevation_m")) & finite(F.col("q.elevation_m"))), "missing_elevation").otherwise("no_length")
    return _ends(samples).where(~F.coalesce(_placed(), F.lit(False))).select("edge_id", at.alias("reason"))


def nodes(net: DataFrame) -> DataFrame:
    """(node, z_m, edges_in, edges_out) of a network."""
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    ends = net.select(F.col("a").alias("node"), F.col("za").alias("z_m"), none.alias("in"), one.alias("out")).union(net.select("b", "zb", one, none))
    return ends.groupBy("node").agg(F.min("z_m").alias("z_m"), F.sum("in").alias("edges_in"), F.sum("out").alias("edges_out"))


def _parts(scratch: Scratch, links: DataFrame) -> DataFrame:
    """(node, root, z_m, into, own) of links (a, b, za, zb): the parts inside blocks; a node that links lead to from other blocks stands in theirs too, without ``own``."""
    rows = links.select(blocks.block(F.col("a")).alias("block"), "a", "b", "za", "zb")
    far = blocks.block(F.col("b"))
    # The block of a node that is led to from elsewhere has a row of it, so that its part there is known, and that an edge leads to it.
    alone = links.where(blocks.block(F.col("a")) != far).select(far.alias("block"), F.col("b").alias("a"), "b", F.col("zb").alias("za"), "zb")
    return scratch.keep(blocks.by_block(rows.unionByName(alone), blocks.parts, blocks.PARTS))


def _joined(scratch: Scratch, parts: DataFrame) -> DataFrame:
    """(node, component) of the roots that links between blocks join to others."""
    away = parts.where("not own").select("node", F.col("root").alias("from"))
    between = away.join(parts.where("own").select("node", "root"), "node").select(F.col("from").alias("u"), F.col("root").alias("v"))
    return _rounds(scratch, between)


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of all nodes at links; component: the least node that a way of links leads to."""
    scratch = Scratch(links.sparkSession, "components")
    none = F.lit(0.0)
    ends = links.select(F.coalesce(a, b).cast("long").alias("a"), F.coalesce(b, a).cast("long").alias("b"), none.alias("za"), none.alias("zb"))
    parts = _parts(scratch, ends.where("a is not null"))
    joined = _joined(scratch, parts)
    found = parts.where("own").join(joined.withColumnRenamed("node", "root"), "root", "left").select("node", F.coalesce("component", "root").alias("component"))
    found = scratch.keep(found)
    scratch.close(found)
    return found


def _rounds(scratch: Scratch, ends: DataFrame) -> DataFrame:
    """(node, component) of links (u, v), by rounds over a table of parents."""
    both = scratch.keep(ends.union(ends.select("v", "u")).distinct())
    if both.isEmpty():
        return both.select(F.col("u").alias("node"), F.col("v").alias("component"))
    now = scratch.keep(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("p")))
    while True:
        # g: the parent's parent.
        up = now.join(now.select(F.col("u").alias("p"), F.col("p").alias("g")), "p").select("u", "p", "g")
        up = scratch.keep(up)
        near = both.join(up.select(F.col("u").alias("v"), "g"), "v").groupBy("u").agg(F.min("g").alias("m"))
        offers = up.join(near, "u").select("u", "p", "g", F.least("m", "g").alias("m"))
        spread = offers.select(F.inline(F.array(*[F.struct(F.col(k).alias("u"), F.col(m).alias("p")) for k, m in (("u", "m"), ("u", "p"), ("p", "m"))])))
        following = scratch.keep(spread.groupBy("u").agg(F.min("p").alias("p")))
        changed = not following.join(now.withColumnRenamed("p", "before"), "u").where("p <> before").isEmpty()
        scratch.drop(now, up)
        now = following
        if not changed:
            return now.select(F.col("u").alias("node"), F.col("p").alias("component"))


def downhill(net: DataFrame, least_drop_m: float = 0.0) -> DataFrame:
    """The edges that fall by more than ``least_drop_m``."""
    return net.where(F.col("za") - F.col("zb") > least_drop_m)


def downhill_components(net: DataFrame, least_drop_m: float = 0.0) -> DataFrame:
    """(node, component, z_m, is_seed): nodes that falling edges link, whichever way; a seed has no falling edge into it."""
    scratch = Scratch(net.sparkSession, "downhill")
    parts = _parts(scratch, downhill(net, least_drop_m).select("a", "b", "za", "zb"))
    joined = _joined(scratch, parts).withColumnRenamed("node", "root")
    own = parts.where("own").join(joined, "root", "left")
    found = scratch.keep(own.select("node", F.coalesce("component", "root").alias("component"), "z_m", (~F.col("into")).alias("is_seed")))
    scratch.close(found)
    return found


def summary(found: DataFrame) -> DataFrame:
    """(component, nodes, seeds, top_m, bottom_m) of downhill components."""
    return found.groupBy("component").agg(F.count(F.lit(1)).alias("nodes"), F.count_if("is_seed").alias("seeds"), F.max("z_m").alias("top_m"), F.min("z_m").alias("bottom_m"))
