"""The road graph and the searches over it against plain Python on small random graphs."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from velograde.functions.physics import Scenario
from velograde.operators import graph, routes
from velograde.plans import route_queries

SCENARIO = Scenario(initial_speed_m_s=6.0)


def samples_of(rng, places, count):
    """Edges between numbered places on a plane, with ends up to 30 cm off."""
    where = {i: (rng.randrange(0, 4000, 50), rng.randrange(0, 4000, 50), rng.uniform(0, 60)) for i in range(places)}
    rows = []
    for e in range(count):
        for k, i in enumerate(rng.sample(range(places), 2) if e % 17 else [3, 3]):
            x, y, z = where[i]
            rows.append((e, k, x + rng.uniform(-0.3, 0.3), y + rng.uniform(-0.3, 0.3), z, "extra"))
    return rows


@pytest.fixture(scope="module", params=[1])
def net(spark, request):
    rows = samples_of(random.Random(request.param), 40, 90)
    return graph.network(spark.createDataFrame(rows, "edge_id long, sample_idx int, x_m double, y_m double, elevation_m double, a string")).cache()


def rides(net):
    """(a, b) -> what an edge does to (energy, distance), straight from the forces."""
    real, mass = 90.0, 91.5
    k = 1.225 * 0.55 / mass
    out = []
    for r in net.collect():
        g = (r.zb - r.za) / r.horizontal_length_m
        if abs(g) > 0.5:
            continue
        length = r.horizontal_length_m * math.sqrt(1 + g * g)
        force = -real * 9.80665 * (g + 0.006) / math.sqrt(1 + g * g)
        out.append((r.a, r.b, math.exp(-k * length), force / k * (1 - math.exp(-k * length)), math.floor(length * 1000 + 0.5)))
    return out


def walk(net, starts):
    """All (start, node, energy, distance) that any way reaches."""
    least = routes.energy(SCENARIO.stop_speed_m_s, SCENARIO)
    leaving = {}
    for a, *rest in rides(net):
        leaving.setdefault(a, []).append(rest)
    found = {(s, n, routes.energy(SCENARIO.initial_speed_m_s, SCENARIO), 0) for s, n in starts}
    stack = list(found)
    while stack:
        s, n, e, d = stack.pop()
        for b, keep, gain, mm in leaving.get(n, []):
            state = (s, b, math.floor(e * keep + gain), d + mm)
            if state[2] > least and state not in found:
                found.add(state)
                stack.append(state)
    return found


def test_snapping_and_heights(net):
    rows = net.collect()
    assert len(rows) == 90 - sum(e % 17 == 0 for e in range(90)) or len(rows) == 90
    assert len({n for r in rows for n in (r.a, r.b)}) <= 40
    heights = {}
    for r in rows:
        assert heights.setdefault(r.a, r.za) == r.za and heights.setdefault(r.b, r.zb) == r.zb


def test_components_equal_a_union_find(net):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for r in net.where("za > zb").collect():
        parent[max(root(r.a), root(r.b))] = min(root(r.a), root(r.b))
    found = graph.downhill_components(net).collect()
    assert {r.node: r.component for r in found} == {n: root(n) for n in parent}
    into = {r.b for r in net.where("za > zb").collect()}
    assert {r.node for r in found if r.is_seed} == set(parent) - into


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    kept = []
    keep = graph.Scratch.keep
    monkeypatch.setattr(graph.Scratch, "keep", lambda self, df: kept.append(1) or keep(self, df))
    order = list(range(100))
    random.Random(5).shuffle(order)
    links = spark.createDataFrame(list(zip(order, order[1:], strict=False)), "a long, b long")
    assert {r.component for r in graph.components(links).collect()} == {0}
    assert len(kept) <= 2 + 2 * 10


def test_best_energy_and_labels(net):
    seeds = graph.nodes(net).select("node").orderBy("node").limit(6).cache()
    states = walk(net, [(0, r.node) for r in seeds.collect()])
    best = {}
    for _, n, e, _d in states:
        best[n] = max(best.get(n, 0), e)
    assert {r.node: r.e for r in routes.best_energy(net, SCENARIO, seeds.union(seeds)).collect()} == best
    pairs = {(n, e, d) for _, n, e, d in states}
    front = {p for p in pairs if not any(q != p and q[0] == p[0] and q[1] >= p[1] and q[2] >= p[2] for q in pairs)}
    assert {tuple(r) for r in routes.labels(net, SCENARIO, seeds).collect()} == front


def test_bounded_search_is_exact_and_beams_are_not_above(net):
    seeds = graph.nodes(net).select((F.col("node") % 3).alias("grp"), "node").orderBy("node").limit(6).cache()
    longest = {}
    for s, _n, _e, d in walk(net, [tuple(r) for r in seeds.collect()]):
        longest[s] = max(longest.get(s, 0), d)
    assert {r.grp: r.d for r in routes.longest(net, SCENARIO, seeds).collect()} == longest
    beams = [{r.grp: r.d for r in routes.longest(net, SCENARIO, seeds, beam=k).collect()} for k in (1, 1000)]
    assert all(beams[0][g] <= d for g, d in longest.items()) and beams[1] == longest


def test_best_starts_with_pruning(net):
    placed = graph.nodes(net).select("node", F.floor(F.col("node") / 2**32).cast("double").alias("x_m"), (F.pmod("node", F.lit(2**32)) - 2**31).cast("double").alias("y_m"), "z_m").orderBy("node").limit(8).cache()
    far = {}
    for s, _n, _e, d in walk(net, [(r.node, r.node) for r in placed.collect()]):
        far[s] = max(far.get(s, 0), d)
    found, report = routes.best_starts(net, SCENARIO, placed, 5, 1600.0, 400.0)
    want = sorted(far.items(), key=lambda x: (-x[1], x[0]))[:5]
    assert [tuple(r) for r in found.collect()] == want
    row = report.first()
    assert 0 < row.tiles_read <= row.tiles and 5 <= row.seeds_read <= row.seeds == placed.count()


def test_odd_cases(spark):
    schema = "edge_id long, sample_idx int, x_m double, y_m double, elevation_m double"
    rows = [(1, 0, 0.0, 0.0, 5.0), (1, 1, None, 0.0, 4.0), (2, 0, 0.0, 0.0, float("nan")), (2, 1, 9.0, 0.0, 4.0), (3, 0, 0.0, 0.0, 5.0), (4, 0, 0.0, 0.0, 5.0), (4, 1, 100.0, 0.0, 1.0)]
    samples = spark.createDataFrame(rows, schema)
    assert {tuple(r) for r in graph.unplaced(samples).collect()} == {(1, "missing_coordinates"), (2, "missing_elevation"), (3, "no_length")}
    one = graph.network(samples)
    assert [r.edge_id for r in one.collect()] == [4]
    seeds = spark.createDataFrame([(None,), (7,), (7,)], "node long")
    assert [tuple(r) for r in routes.best_energy(one, SCENARIO, seeds).collect()] == [(7, routes.energy(6.0, SCENARIO))]
    assert routes.longest(one, SCENARIO, seeds.select(F.lit(1).alias("grp"), "node")).collect()[0].d == 0
    none = graph.network(samples.limit(0))
    assert none.collect() == [] and graph.downhill_components(none).collect() == []
    assert routes.labels(none, SCENARIO, seeds.limit(0)).collect() == []
    with pytest.raises(ValueError, match="wind"):
        routes.rideable(one, Scenario(along_route_wind_m_s=1.0))


def line_items(spark, folder, rows):
    """A lineitem table of (order, part, supplier, number of the line, quantity)."""
    table = spark.createDataFrame([(*r, 1.0) for r in rows], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double")
    table.write.parquet(f"{folder}/lineitem.parquet")
    return str(folder)


def test_edges_with_one_id_as_in_sql(spark, tmp_path):
    """An order of 18 lines: its last two share ids with lines of the next order."""
    duckdb = pytest.importorskip("duckdb")
    folder = line_items(spark, tmp_path, [(7, 40 + k, k, k % 7 + 1, float(k)) for k in range(18)] + [(8, 90 + k, k, k + 1, 3.0) for k in range(3)])
    found = route_queries.QUERIES["road_network"](spark, folder).collect()
    con = duckdb.connect()
    con.sql(f"create view lineitem as select * from '{folder}/lineitem.parquet/*.parquet'")
    want = con.sql(route_queries.SQL["road_network"]).fetchall()
    assert len(want) == 17 + 2 * 3 + 2 and sorted(map(tuple, found)) == sorted(want)


def kept_tables(monkeypatch):
    kept = []
    keep = graph.Scratch.keep
    monkeypatch.setattr(graph.Scratch, "keep", lambda self, df: kept.append(1) or keep(self, df))
    return kept


def chain(spark, x0, count):
    """A falling road of ``count`` edges of 50 m from x0 on."""
    node = lambda k: (x0 + 50 * k) * 2**32 + 2**31
    rows = [(k, node(k), node(k + 1), 900.0 - k, 899.0 - k, 50.0) for k in range(count)]
    return spark.createDataFrame(rows, "edge_id long, a long, b long, za double, zb double, horizontal_length_m double"), node


def test_components_take_few_tables(spark, monkeypatch):
    """Within a block one pass does; a chain over two blocks is one component with one seed."""
    kept = kept_tables(monkeypatch)
    inside, node = chain(spark, 0, 60)
    assert {r.component for r in graph.downhill_components(inside).collect()} == {node(0)} and len(kept) <= 4
    across, node = chain(spark, 15000, 60)
    found = graph.downhill_components(across).collect()
    assert {r.node: r.component for r in found} == {node(k): node(0) for k in range(61)}
    assert [r.node for r in found if r.is_seed] == [node(0)]


def test_searches_take_a_table_a_block(spark, monkeypatch):
    """A ride through one block takes one round, through two blocks two."""
    for x0, most in ((0, 1), (15000, 2)):
        net, node = chain(spark, x0, 60)
        seeds = spark.createDataFrame([(node(0),)], "node long")
        states = walk(net, [(0, node(0))])
        kept = kept_tables(monkeypatch)
        assert {tuple(r) for r in routes.labels(net, SCENARIO, seeds).collect()} == {s[1:] for s in states}
        assert len(kept) <= most
        monkeypatch.undo()


def test_searches_over_blocks(spark):
    """Places around a corner of four blocks."""
    rows = [(e, k, x + 14500.0, y - 2000.0, *rest) for e, k, x, y, *rest in samples_of(random.Random(9), 40, 90)]
    net = graph.network(spark.createDataFrame(rows, "edge_id long, sample_idx int, x_m double, y_m double, elevation_m double, a string")).cache()
    seeds = graph.nodes(net).select((F.col("node") % 3).alias("grp"), "node").orderBy("node").limit(6).cache()
    states = walk(net, [tuple(r) for r in seeds.collect()])
    pairs = {s[1:] for s in states}
    front = {p for p in pairs if not any(q != p and q[0] == p[0] and q[1] >= p[1] and q[2] >= p[2] for q in pairs)}
    assert {tuple(r) for r in routes.labels(net, SCENARIO, seeds).collect()} == front
    longest = {}
    for s, _n, _e, d in states:
        longest[s] = max(longest.get(s, 0), d)
    assert {r.grp: r.d for r in routes.longest(net, SCENARIO, seeds).collect()} == longest


def test_best_starts_take_few_tables(spark, monkeypatch):
    """Three of seeds and tiles, and three of one search of one block."""
    net, node = chain(spark, 0, 60)
    seeds = spark.createDataFrame([(node(k), 50.0 * k, 0.0, 900.0 - k) for k in (0, 20)], "node long, x_m double, y_m double, z_m double")
    kept = kept_tables(monkeypatch)
    found = routes.best_starts(net, SCENARIO, seeds, 1)[0].collect()
    want = max((d, -n) for s, _n, _e, d in walk(net, [(r.node, r.node) for r in seeds.collect()]) for n in (s,))
    assert [(r.d, -r.node) for r in found] == [want] and len(kept) <= 6


def test_beams_take_a_table_a_block_and_equal_rounds(spark, monkeypatch):
    """A beam goes through a block in one pass, however many edges it rides; passes in blocks give what rounds over all labels give."""
    net, node = chain(spark, 8000, 60)
    seeds = spark.createDataFrame([(1, node(0))], "grp long, node long")
    kept = kept_tables(monkeypatch)
    want = max(d for *_, d in walk(net, [(1, node(0))]))
    assert [tuple(r) for r in routes.longest(net, SCENARIO, seeds, beam=8).collect()] == [(1, want)] and len(kept) <= 5
    monkeypatch.undo()
    rows = [(e, k, x + 6200.0, y - 2000.0, *rest) for e, k, x, y, *rest in samples_of(random.Random(9), 40, 90)]
    net = graph.network(spark.createDataFrame(rows, "edge_id long, sample_idx int, x_m double, y_m double, elevation_m double, a string")).cache()
    seeds = graph.nodes(net).select((F.col("node") % 3).alias("grp"), "node").orderBy("node").limit(6).cache()
    for width in (1, 3):
        inside = sorted(tuple(r) for r in routes.longest(net, SCENARIO, seeds, beam=width).collect())
        with monkeypatch.context() as m:
            m.setattr(routes, "SHIFTS", routes.SHIFTS[:1])
            assert sorted(tuple(r) for r in routes.longest(net, SCENARIO, seeds, beam=width).collect()) == inside
            rounds = routes._relaxed_beam(net, SCENARIO, seeds, 1.0, width, net.agg(F.min(F.least("za", "zb"))).head()[0])
            assert sorted(tuple(r) for r in rounds.collect()) == inside
