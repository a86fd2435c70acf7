"""The simulator against published model outputs and against its own invariants."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pytest

from velograde.functions.physics import Scenario, acceleration_m_s2, scenario_error, scenarios
from velograde.operators import simulate

SHORT = [(20.0, 0.012 if k % 3 == 0 else -0.025) for k in range(24)] + [(500.0, -0.01)]
CROSSED = [(500.0, -0.04), (15.0, 0.025), (800.0, -0.012)]

#: Profile, time step, rotating mass, elapsed time, distance, final speed, how it ends.
GOLDEN = {
    "flat": ([(10000.0, 0.0)], 0.05, 1.5, 52.312649121, 100.706193596, 0.183805138, "speed_threshold"),
    "gentle": ([(12000.0, -0.012)], 0.05, 1.5, 3025.010522923, 12000.0, 3.964671355, "route_end"),
    "steep": ([(2000.0, -0.08)], 0.05, 1.5, 152.273865459, 2000.0, 13.901777314, "route_end"),
    "crossed": (CROSSED, 0.05, 1.5, 235.829360854, 1315.0, 3.983309374, "route_end"),
    "stopped": ([(180.0, -0.04), (2000.0, 0.045)], 0.05, 1.5, 42.932391716, 237.203723109, 0.0, "speed_threshold"),
    "short": (SHORT, 0.2, 1.5, 259.270088149, 980.0, 3.281084196, "route_end"),
    "no_rotation": (CROSSED, 0.05, 0.0, 236.222016635, 1315.0, 3.981510408, "route_end"),
    "step_0.2": (CROSSED, 0.2, 1.5, 235.911434109, 1315.0, 3.982999573, "route_end"),
    "step_0.1": (CROSSED, 0.1, 1.5, 235.856752275, 1315.0, 3.983205681, "route_end"),
    "step_0.025": (CROSSED, 0.025, 1.5, 235.815533095, 1315.0, 3.983361503, "route_end"),
}


def run(spark, cases: dict[str, tuple[list, dict]], what: str = "summary"):
    """Simulate named (profile, scenario options)."""
    rows = []
    for name, (profile, options) in cases.items():
        s = Scenario(name, **options)
        rows.append((name, profile, *[getattr(s, n) for n in simulate.PARAMETERS]))
    schema = "run_id string, profile array<struct<length_m:double,grade_ratio:double>>, " + ", ".join(f"{n} double" for n in simulate.PARAMETERS)
    found = simulate.simulate(spark.createDataFrame(rows, schema).coalesce(1), what).collect()
    return {r["run_id"]: r for r in found} if what == "summary" else found


def test_published_outputs(spark):
    found = run(spark, {k: (v[0], {"time_step_s": v[1], "rotating_equivalent_mass_kg": v[2]}) for k, v in GOLDEN.items()})
    for name, (_, _, _, elapsed, distance, speed, reason) in GOLDEN.items():
        r = found[name]
        assert r["elapsed_time_s"] == pytest.approx(elapsed, abs=1e-6), name
        assert r["distance_m"] == pytest.approx(distance, abs=1e-6), name
        assert r["final_speed_m_s"] == pytest.approx(speed, abs=1e-6), name
        assert (r["stop_reason"], r["completed_route"]) == (reason, reason == "route_end")


def test_time_metrics(spark):
    found = run(
        spark,
        {
            "stop": ([(10000.0, 0.0)], {}),
            "recover": ([(4.9, 0.1), (300.0, -0.08)], {"initial_speed_m_s": 3.3, "stop_speed_m_s": 1.0, "stop_dwell_s": 30.0}),
            "start_below": ([(100.0, 0.0)], {"initial_speed_m_s": 0.2, "stop_dwell_s": 0.0}),
            "never": ([(200.0, -0.05)], {}),
            "zero_threshold": ([(500.0, 0.02)], {"stop_speed_m_s": 0.0, "stop_dwell_s": 1.0}),
        },
    )
    s = found["stop"]
    assert s["qualified_stop_time_s"] == s["elapsed_time_s"] and s["first_below_threshold_time_s"] == pytest.approx(s["elapsed_time_s"] - 2.0, abs=1e-9)
    r = found["recover"]
    assert r["stop_reason"] == "route_end" and r["qualified_stop_time_s"] is None and 0 < r["first_below_threshold_time_s"] < r["elapsed_time_s"]
    b = found["start_below"]
    assert (b["elapsed_time_s"], b["first_below_threshold_time_s"], b["stop_reason"]) == (0.0, 0.0, "speed_threshold")
    n = found["never"]
    assert n["first_below_threshold_time_s"] is None and n["first_zero_speed_time_s"] is None and n["stationary_time_s"] == 0.0
    z = found["zero_threshold"]
    assert z["stop_reason"] == "speed_threshold" and z["final_speed_m_s"] == 0.0
    assert z["stationary_time_s"] == pytest.approx(1.0) and z["moving_time_s"] == pytest.approx(z["elapsed_time_s"] - 1.0)


def test_max_time_is_exact_and_beats_arrival(spark):
    found = run(spark, {"cut": ([(5000.0, 0.0)], {"max_time_s": 7.03}), "both": ([(10.0, 0.0)], {"max_time_s": 2.0, "initial_speed_m_s": 5.0, "drag_area_m2": 1e-12, "rolling_resistance_coefficient": 0.0})})
    assert found["cut"]["elapsed_time_s"] == pytest.approx(7.03, abs=1e-12) and found["cut"]["stop_reason"] == "max_time"
    assert found["both"]["stop_reason"] == "max_time" and not found["both"]["completed_route"]


def test_energy_and_terminal_speed(spark):
    lossless = {"drag_area_m2": 1e-12, "rolling_resistance_coefficient": 0.0, "rotating_equivalent_mass_kg": 0.0}
    found = run(spark, {"energy": ([(1000.0, -0.2)], lossless), "terminal": ([(30000.0, -0.04)], {})})
    drop = 1000.0 * math.sin(math.atan(0.2))
    assert found["energy"]["final_speed_m_s"] == pytest.approx(math.sqrt((15 / 3.6) ** 2 + 2 * 9.80665 * drop), rel=1e-9)
    g = math.atan(0.04)
    force = 90 * 9.80665 * (math.sin(g) - 0.006 * math.cos(g))
    assert found["terminal"]["final_speed_m_s"] == pytest.approx(math.sqrt(force / (0.5 * 1.225 * 0.55)), rel=0.005)


def test_trace_is_monotone_and_ends_like_the_summary(spark):
    case = {"a": (CROSSED, {"time_step_s": 0.2}), "b": ([(40.0, 0.05)], {"time_step_s": 0.2})}
    rows, summary = run(spark, case, "trace"), run(spark, case)
    for name in case:
        mine = sorted((r for r in rows if r["run_id"] == name), key=lambda r: r["step"])
        assert [r["step"] for r in mine] == list(range(len(mine)))
        assert all(x["time_s"] < y["time_s"] and x["distance_m"] <= y["distance_m"] for x, y in zip(mine, mine[1:]))
        assert mine[-1]["time_s"] == summary[name]["elapsed_time_s"]


def test_unusable_profiles_are_left_out(spark):
    assert not run(spark, {"grade": ([(10.0, 0.51)], {}), "length": ([(0.0, 0.0)], {}), "none": ([], {}), "nan": ([(1.0, float("nan"))], {})})
    assert run(spark, {"edge": ([(10.0, 0.5)], {})})


def test_acceleration_signs_and_scenario_rules(spark):
    from pyspark.sql import functions as F

    s = scenarios(spark, Scenario("calm"), Scenario("tail", along_route_wind_m_s=5.0), Scenario("bad", rider_mass_kg=float("nan")), Scenario("crr", rolling_resistance_coefficient=0.1))
    a = {r["scenario_id"]: (r["down"], r["up"], r["error"]) for r in s.select("scenario_id", acceleration_m_s2(F.lit(3.0), F.lit(-0.05)).alias("down"), acceleration_m_s2(F.lit(3.0), F.lit(0.05)).alias("up"), scenario_error().alias("error")).collect()}
    assert a["calm"][0] > 0 > a["calm"][1] and a["tail"][0] > a["calm"][0]
    assert a["calm"][2] is None and "rider_mass_kg" in a["bad"][2] and "rolling" in a["crr"][2]


def test_refused_runs(spark):
    good, bad = [(100.0, -0.03)], float("nan")
    schema = "run_id string, profile array<struct<length_m:double,grade_ratio:double>>, " + ", ".join(f"{n} double" for n in simulate.PARAMETERS)
    cases = {"good": (good, {}), "null": (good, {"time_step_s": None}), "nan": (good, {"max_time_s": bad}), "held": (good, {"time_step_s": 0.0}), "back": (good, {"time_step_s": -1.0}), "empty": ([], {}), "none": (None, {}), "steep": ([(10.0, 0.6)], {})}
    runs = spark.createDataFrame([(k, p, *[getattr(Scenario(k, **o), n) for n in simulate.PARAMETERS]) for k, (p, o) in cases.items()], schema)
    why = {r["run_id"]: r["reject_reason"] for r in simulate.rejects(runs).collect()}
    profile = "profile cannot be simulated"
    assert why == {"null": "time_step_s must be finite", "nan": "max_time_s must be finite", "held": "time_step_s must be positive", "back": "time_step_s must be positive", "empty": profile, "none": profile, "steep": profile}
    assert [r["run_id"] for r in simulate.simulate(runs).collect()] == ["good"]
    assert simulate.simulate(runs.limit(0)).collect() == [] and simulate.rejects(runs.limit(0)).collect() == []
    assert [r["run_id"] for r in simulate.simulate(runs.where("run_id = 'good'"), strict=True).collect()] == ["good"]
    with pytest.raises(Exception, match="time_step_s must be positive"):
        simulate.simulate(runs.where("run_id in ('good', 'back')"), strict=True).collect()


def some_runs(n: int, seed: int, odd: bool = False):
    """Profiles one after the other, and parameters; ``odd``: with lengths, steps, winds and speeds where events meet."""
    rng = np.random.default_rng(seed)
    counts = rng.integers(1, 8, n)
    lengths, grades = 10.0 + rng.integers(1, 51, counts.sum()), rng.integers(-10, 9, counts.sum()) / 100
    p = {k: np.full(n, float(getattr(Scenario(), k))) for k in simulate.PARAMETERS}
    if odd:
        lengths = np.where(rng.random(len(lengths)) < 0.1, lengths * 10.0 ** rng.integers(-13, 1, len(lengths)), lengths)
        values = {"time_step_s": (0.05, 0.5, 3.0, 60.0), "max_time_s": (0.03, 20.0, 60.0), "stop_speed_m_s": (0.0, 0.3, 4.0, 15.0 / 3.6), "stop_dwell_s": (0.0, 0.1, 30.0), "initial_speed_m_s": (1e-13, 0.3, 15.0 / 3.6, 40.0), "along_route_wind_m_s": (-20.0, 0.0, 30.0)}
        p |= {k: rng.choice(v, n) for k, v in values.items()}
    return counts, lengths, grades, p


@pytest.mark.parametrize("odd", [False, True])
def test_whole_steps_give_the_bits_of_single_substeps(odd):
    cases = some_runs(300, 5, odd)
    one, many, single = simulate.Runs(*cases), simulate.Runs(*cases), []
    live = np.flatnonzero(one.reason == 0)
    while len(live):
        one.advance(live)
        live = live[one.reason[live] == 0]
    plain = many.advance
    many.advance = lambda k: plain(single.append(len(k)) or k)
    for _ in many.rounds():
        pass
    for name in ("t", "d", "v", "reason", "steps", "still", "first_below", "first_zero"):
        assert np.array_equal(getattr(one, name), getattr(many, name), equal_nan=True), name
    assert odd or sum(single) < one.steps.sum() / 5


def test_a_long_profile_does_not_pad_the_others():
    counts = np.array([1] * 200 + [20_000])
    lengths = np.linspace(0.1, 3.0, counts.sum())
    _, _, _, p = some_runs(201, 1)
    runs = simulate.Runs(counts, lengths, np.zeros(counts.sum()), p)
    assert runs.ends.size == counts.sum()
    assert np.array_equal(runs.ends[200:], np.cumsum(lengths[200:])) and runs.ends[7] == lengths[7]


def test_small_batches_share_a_pool():
    batches = [pa.record_batch({"k": list(range(at, at + 10))}) for at in range(0, 100, 10)]
    pools = list(simulate._pools(iter(batches), 40))
    assert [x.num_rows for x in pools] == [40, 40, 20]
    assert [v for x in pools for v in x.column(0).to_pylist()] == list(range(100))
    assert list(simulate._pools(iter([]), 40)) == []
