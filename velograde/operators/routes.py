"""Search for coasting routes over the road graph, without time stepping.

On an edge of one grade, without wind, the kinetic energy E over the travelled distance s follows dE/ds = f - k E (slope, rolling
and air resistance), so E(s) = f/k + (E(0) - f/k) exp(-k s): a closed form, increasing in E(0) and monotone in s, hence positive inside where it
is at both ends. The state is the energy in whole quanta, rounded down after each edge, so that equal states are equal and no way is rated too high;
more energy at a node is never worse. Distances are whole millimetres, for the same reason. A rider goes on while the energy is above that of the stopping speed.

Every exact search goes on inside blocks of the plane until nothing improves there; a round hands the states that leave a block to the next one, for which only
those blocks are read. The groups of a beam are apart: each goes through all its rounds in the block where it begins. One that has to leave that begins anew in blocks that
lie otherwise, and what leaves all of these relaxes a frontier: states that go on after one round are joined to the edges that leave their nodes. Friction takes energy on every metre and
nodes have one height, so states that come back to a node have less energy and searches end. The tables of rounds cut the lineage.

Defined cases: seeds that are null or at no node of the graph yield themselves only; repeated seeds count once; edges without a grade within 0.5 are not ridden; edges in parallel are tried each;
equal labels are one; empty graphs give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from velograde.functions.physics import MAX_GRADE, Scenario
from velograde.operators import blocks
from velograde.sources.scratch import Scratch

QUANTUM_J = 1.0
#: Local skylines before the one of a node.
SALTS = 8


def _mass(s: Scenario) -> tuple[float, float]:
    real = s.rider_mass_kg + s.bicycle_mass_kg
    return real, real + s.rotating_equivalent_mass_kg


def energy(speed_m_s: float, scenario: Scenario, quantum_j: float = QUANTUM_J) -> int:
    """The kinetic energy of a speed in whole quanta."""
    return math.floor(0.5 * _mass(scenario)[1] * speed_m_s * speed_m_s / quantum_j)


def rideable(net: DataFrame, scenario: Scenario) -> DataFrame:
    """(edge_id, a, b, zb, length_mm, keep, gain_j): the energy behind an edge is keep * E + gain_j."""
    if scenario.along_route_wind_m_s:
        raise ValueError("the closed form holds without wind")
    real, effective = _mass(scenario)
    grade = (F.col("zb") - F.col("za")) / F.col("horizontal_length_m")
    hyp = F.sqrt(1.0 + F.col("grade") * F.col("grade"))
    rows = net.where("horizontal_length_m > 0").withColumn("grade", grade).where(F.abs("grade") <= MAX_GRADE)
    rows = rows.withColumn("length_m", F.col("horizontal_length_m") * hyp)
    k = scenario.air_density_kg_m3 * scenario.drag_area_m2 / effective
    force = -(real * scenario.gravity_m_s2) * (F.col("grade") + scenario.rolling_resistance_coefficient) / hyp
    keep = F.exp(-k * F.col("length_m"))
    return rows.select("edge_id", "a", "b", "zb", F.floor(F.col("length_m") * 1000.0 + 0.5).alias("length_mm"), keep.alias("keep"), ((force / k) * (1.0 - keep)).alias("gain_j"))


def _after(quantum_j: float) -> Column:
    return F.floor((F.col("e") * quantum_j * F.col("keep") + F.col("gain_j")) / quantum_j)


def _least(scenario: Scenario, quantum_j: float) -> int:
    return energy(scenario.stop_speed_m_s, scenario, quantum_j)


def best_energy(net: DataFrame, scenario: Scenario, seeds: DataFrame, quantum_j: float = QUANTUM_J) -> DataFrame:
    """(node, e): the most energy (quanta) with which a rider who starts at a seed (node) at the initial speed can be at a node."""
    starts = seeds.select(F.lit(0).alias("grp"), "node").where("node is not null").distinct()
    return _blocked(net, scenario, starts, quantum_j, energy_only=True).select("node", "e")


#: Blocks that a round reads are sent to the tasks up to so many, and joined beyond that.
BLOCKS_SENT = 200_000


def _active(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """The edges of the blocks that labels are in."""
    active = labels.select("block").distinct()
    return edges.join(F.broadcast(active) if active.limit(BLOCKS_SENT + 1).count() <= BLOCKS_SENT else active, "block", "left_semi")


def _blocked(net: DataFrame, scenario: Scenario, starts: DataFrame, quantum_j: float, energy_only: bool = False, farthest: bool = False, few: bool = False) -> DataFrame:
    """The labels (grp, node, e, d) of starts (grp, node) that no other of group and node beats; with ``energy_only`` d is 0, with ``farthest`` (grp, d) alone.

    With ``few`` the first round, too, reads only the blocks that starts are in.

    A label that comes into a block again, beaten or not, is gone on with there once more: that costs time, not labels.
    """
    scratch = Scratch(net.sparkSession, "blocks")
    block = blocks.block(F.col("node"))
    length = F.lit(0).cast("long") if energy_only else F.col("length_mm")
    nothing = F.lit(None).cast("long")
    edges = rideable(net, scenario).select(F.col("a").alias("node"), "b", "keep", "gain_j", length.alias("d"), nothing.alias("grp"), nothing.alias("e")).withColumn("block", block)
    step = blocks.coast(_least(scenario, quantum_j), quantum_j, farthest)
    start = F.lit(energy(scenario.initial_speed_m_s, scenario, quantum_j)).cast("long")
    entering = starts.select(F.col("grp").cast("long").alias("grp"), "node", start.alias("e"), F.lit(0).cast("long").alias("d"))
    rounds = []
    while True:
        labels = entering.withColumn("block", block)
        read = _active(edges, labels) if rounds or few else edges
        done = scratch.keep(blocks.by_block(read.unionByName(labels, allowMissingColumns=True), step, blocks.LABELS))
        rounds.append(done)
        entering = done.where("leaves").select("grp", "node", "e", "d")
        if entering.isEmpty():
            break
    held = rounds[0].where("not leaves")
    for more in rounds[1:]:
        held = held.union(more.where("not leaves"))
    if farthest:
        return held.groupBy("grp").agg(F.max("d").alias("d"))
    # Only labels at nodes that a later round reached meet others.
    if len(rounds) == 1:
        return held.drop("leaves")
    return skyline(held.drop("leaves"), ("grp", "node"), 1)


def skyline(labels: DataFrame, keys: tuple[str, ...] = ("node",), salts: int = SALTS) -> DataFrame:
    """Of labels (keys, e, d, ...), those that no other of their keys beats in e and d; of equal ones, one.

    In the order of falling e (then d) a label stands if its d is above all before it. The keys' labels are dealt over ``salts``
    parts first, each with its own skyline, so that a hot node's labels are thinned by several tasks.
    """

    def once(rows: DataFrame, by: list[str]) -> DataFrame:
        before = W.partitionBy(*by).orderBy(F.desc("e"), F.desc("d")).rowsBetween(W.unboundedPreceding, -1)
        return rows.withColumn("most", F.max("d").over(before)).where("most is null or d > most").drop("most")

    if salts == 1:
        return once(labels, list(keys))
    local = once(labels.withColumn("salt", F.pmod(F.xxhash64("e", "d"), F.lit(salts))), [*keys, "salt"])
    return once(local.drop("salt"), list(keys))


#: Labels of a round of a beam are sent to the tasks up to so many, and joined beyond that.
LABELS_SENT = 200_000
Prune = Callable[[DataFrame, DataFrame], DataFrame]


def _search(net: DataFrame, scenario: Scenario, starts: DataFrame, keys: tuple[str, ...], quantum_j: float, prune: Prune) -> DataFrame:
    """Labels (keys, e, d) that no other beats, by rounds; ``prune(found, fresh)`` thins the labels to go on with."""
    scratch = Scratch(net.sparkSession, "labels")
    edges = scratch.keep(rideable(net, scenario).select("a", "b", "zb", "length_mm", "keep", "gain_j"))
    least, columns = _least(scenario, quantum_j), [*keys, "z", "e", "d"]
    held = frontier = scratch.keep(starts.select(*columns, F.lit(False).alias("fresh")))
    while True:
        sent = F.broadcast(frontier) if frontier.limit(LABELS_SENT + 1).count() <= LABELS_SENT else frontier
        grown = sent.join(edges, F.col("node") == F.col("a")).select(
            *[F.col("b").alias("node") if k == "node" else F.col(k) for k in keys], F.col("zb").alias("z"), _after(quantum_j).alias("e"), (F.col("d") + F.col("length_mm")).alias("d"), F.lit(True).alias("fresh")
        )
        # A label that is held already is not gone on with again.
        both = held.withColumn("fresh", F.lit(False)).union(grown.where(F.col("e") > least)).groupBy(*columns).agg(F.min("fresh").alias("fresh"))
        following = scratch.keep(skyline(both, keys))
        fresh = following.where("fresh")
        fresh = scratch.keep(prune(following, fresh))
        done = fresh.isEmpty()
        scratch.drop(held, frontier)
        if done:
            scratch.close(following)
            return following.drop("fresh")
        held, frontier = following, fresh


def _starts(seeds: DataFrame, net: DataFrame, scenario: Scenario, quantum_j: float, *keys: str) -> DataFrame:
    heights = net.select(F.col("a").alias("node"), F.col("za").alias("z")).union(net.select("b", "zb")).groupBy("node").agg(F.min("z").alias("z"))
    own = seeds.select(*keys, "node").where("node is not null").distinct().join(heights, "node", "left")
    return own.select(*keys, "node", "z", F.lit(energy(scenario.initial_speed_m_s, scenario, quantum_j)).cast("long").alias("e"), F.lit(0).cast("long").alias("d"))


def labels(net: DataFrame, scenario: Scenario, seeds: DataFrame, quantum_j: float = QUANTUM_J) -> DataFrame:
    """(node, e, d): per node the pairs of energy (quanta) and distance coasted since a seed (mm) that no other beats in both."""
    starts = seeds.select(F.lit(0).alias("grp"), "node").where("node is not null").distinct()
    return _blocked(net, scenario, starts, quantum_j).select("node", "e", "d")


def reach_m(scenario: Scenario, e: Column, z: Column, lowest: Column, quantum_j: float = QUANTUM_J) -> Column:
    """No way from here is longer: energy and height above the lowest place, over the least rolling resistance a metre."""
    real, _ = _mass(scenario)
    weight = real * scenario.gravity_m_s2
    friction = weight * scenario.rolling_resistance_coefficient / math.sqrt(1.0 + MAX_GRADE * MAX_GRADE)
    return (e * quantum_j + weight * (z - lowest)) / friction


def longest(net: DataFrame, scenario: Scenario, seeds: DataFrame, quantum_j: float = QUANTUM_J, beam: int | None = None, few: bool = False) -> DataFrame:
    """(grp, d): the longest distance (mm) coasted along whole edges by a rider who starts at a seed (grp, node) of each group; groups are whole numbers.

    With ``beam`` only so many labels of a group, the best by their distance and a bound on the rest, go on after each round, and none whose sum does not
    pass the group's best: a heuristic whose results are never above the exact ones. ``few``: seeds are in few of the blocks.
    """
    if beam is None:
        kind = seeds.schema["grp"].dataType
        starts = seeds.select("grp", "node").where("node is not null and grp is not null").distinct()
        return _blocked(net, scenario, starts, quantum_j, farthest=True, few=few).select(F.col("grp").cast(kind).alias("grp"), "d")
    return _beam(net, scenario, seeds, quantum_j, beam)


#: How blocks lie in the passes of a beam: groups that cross an edge of one lie inside one of another.
SHIFTS = ((blocks.HALF, blocks.HALF), (0, blocks.HALF), (blocks.HALF, 0), (0, 0))


def _beam(net: DataFrame, scenario: Scenario, seeds: DataFrame, quantum_j: float, beam: int) -> DataFrame:
    scratch = Scratch(net.sparkSession, "beam")
    kind = seeds.schema["grp"].dataType
    # One row: the least height of all.
    least_z = net.agg(F.min(F.least("za", "zb"))).head()[0] or 0.0
    reach = lambda e, z: reach_m(scenario, e, z, least_z, quantum_j)
    nothing = F.lit(None).cast("long")
    edges = scratch.keep(rideable(net, scenario).select(F.col("a").alias("node"), "b", F.col("zb").alias("z"), "keep", "gain_j", F.col("length_mm").alias("d"), nothing.alias("grp"), nothing.alias("e")))
    start = F.lit(energy(scenario.initial_speed_m_s, scenario, quantum_j)).cast("long").alias("e")
    left = seeds.select(F.col("grp").cast("long").alias("grp"), "node").where("node is not null and grp is not null").distinct()
    found = []
    for shift in SHIFTS:
        homes = left.groupBy("grp").agg(F.min("node").alias("home")).select("grp", blocks.block(F.col("home"), shift).alias("block"))
        labels = left.join(homes, "grp").select("block", "grp", "node", start)
        read = edges.withColumn("block", blocks.block(F.col("node"), shift))
        step = blocks.beam(_least(scenario, quantum_j), quantum_j, beam, reach, shift)
        done = scratch.keep(blocks.by_block((_active(read, labels) if found else read).unionByName(labels, allowMissingColumns=True), step, blocks.BEAMS))
        found.append(done.where("not leaves").select("grp", "d"))
        left = scratch.keep(left.join(done.where("leaves").select("grp"), "grp", "left_semi"))
        if left.isEmpty():
            break
    else:
        found.append(_relaxed_beam(net, scenario, left, quantum_j, beam, least_z))
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out.select(F.col("grp").cast(kind).alias("grp"), "d")


def _relaxed_beam(net: DataFrame, scenario: Scenario, seeds: DataFrame, quantum_j: float, beam: int, least_z: float) -> DataFrame:
    """The same for groups of any reach, a round at a time."""

    def prune(found: DataFrame, fresh: DataFrame) -> DataFrame:
        best = found.groupBy("grp").agg(F.max("d").alias("best"))
        hope = (F.col("d") + 1000.0 * reach_m(scenario, F.col("e"), F.col("z"), F.lit(least_z), quantum_j)).alias("hope")
        open_ = fresh.join(best, "grp").select(*fresh.columns, "best", hope).where("hope > best")
        rank = F.row_number().over(W.partitionBy("grp").orderBy(F.desc("hope"), "node", F.desc("e"), F.desc("d")))
        open_ = open_.withColumn("rank", rank).where(F.col("rank") <= beam)
        return open_.select(*fresh.columns)

    starts = _starts(seeds, net, scenario, quantum_j, "grp")
    return _search(net, scenario, starts, ("grp", "node"), quantum_j, prune).groupBy("grp").agg(F.max("d").alias("d"))


def tiles(seeds: DataFrame, scenario: Scenario, lowest: DataFrame, coarse_m: float, fine_m: float, quantum_j: float = QUANTUM_J) -> DataFrame:
    """(grp, node, coarse, fine, hope): seeds (node, x_m, y_m, z_m) in tiles of two sizes, with the bound on what one can reach from each."""
    at = lambda size: F.struct(F.floor(F.col("x_m") / size).alias("x"), F.floor(F.col("y_m") / size).alias("y"))
    start = F.lit(energy(scenario.initial_speed_m_s, scenario, quantum_j))
    # One row: the least height of all.
    rows = seeds.where("node is not null").crossJoin(F.broadcast(lowest))
    return rows.select(F.col("node").alias("grp"), "node", at(coarse_m).alias("coarse"), at(fine_m).alias("fine"), (1000.0 * reach_m(scenario, start, F.col("z_m"), F.col("lowest"), quantum_j)).alias("hope"))


#: Each search reads the edges anew, so that few of them must do.
WIDER = 64


def best_starts(net: DataFrame, scenario: Scenario, seeds: DataFrame, k: int, coarse_m: float = 4800.0, fine_m: float = 1200.0, quantum_j: float = QUANTUM_J) -> tuple[DataFrame, DataFrame]:
    """The ``k`` seeds (node, x_m, y_m, z_m) from which one coasts farthest, (node, d); and (tiles, tiles_read, seeds, seeds_read) of fine tiles.

    Coarse to fine, with bounds: coarse tiles are opened in the order of their bounds, four first and ``WIDER`` times as many each time; of an opened one, the fine
    tiles whose bound passes the k-th best so far are searched. It ends when no closed coarse tile's bound passes that. No seed of a tile
    that is left out can be among the best, ties included. Gathered on the driver: ``k`` distances and a threshold.
    """
    scratch = Scratch(net.sparkSession, "best-starts")
    lowest = net.agg(F.min(F.least("za", "zb")).alias("lowest"))
    placed = scratch.keep(tiles(seeds.dropDuplicates(["node"]), scenario, lowest, coarse_m, fine_m, quantum_j))
    bounds = W.orderBy(F.desc("hope"), "coarse")
    # One row per coarse tile, which cover the area: the window numbers tiles, not seeds.
    coarse = scratch.keep(placed.groupBy("coarse").agg(F.max("hope").alias("hope")).withColumn("rank", F.row_number().over(bounds)))
    fine = scratch.keep(placed.groupBy("coarse", "fine").agg(F.max("hope").alias("hope")))
    found, read, first, many, threshold = None, None, 1, 4, -1
    while not (batch := coarse.where(F.col("rank").between(first, first + many - 1) & (F.col("hope") >= threshold))).isEmpty():
        opened = scratch.keep(fine.where(F.col("hope") >= threshold).join(batch.select("coarse"), "coarse").select("coarse", "fine"))
        here = placed.join(opened, ["coarse", "fine"]).where(F.col("hope") >= threshold).select("grp", "node")
        got = scratch.keep(longest(net, scenario, here, quantum_j, few=found is None).withColumnRenamed("grp", "node"))
        found, read = (got, opened) if found is None else (found.union(got), read.union(opened))
        best = found.orderBy(F.desc("d"), "node").limit(k).agg(F.count(F.lit(1)).alias("n"), F.min("d").alias("d")).head()
        threshold = best.d if best.n == k else -1
        first, many = first + many, WIDER * many
    if found is None:
        empty = placed.select("node", F.lit(0).cast("long").alias("d"))
        return empty, placed.agg(*[F.lit(0).cast("long").alias(c) for c in ("tiles", "tiles_read", "seeds", "seeds_read")])
    count = lambda rows, name: rows.agg(F.count(F.lit(1)).alias(name))
    report = count(fine, "tiles").crossJoin(count(read, "tiles_read")).crossJoin(count(placed, "seeds")).crossJoin(count(found, "seeds_read"))
    return found.orderBy(F.desc("d"), "node").limit(k), report
