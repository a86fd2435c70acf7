"""Coasting over piecewise-constant grades: an event-split fold, many runs in lock-step.

A run's state is time, distance, speed, time below the stopping speed and what is left of the
nominal time step. Each substep has constant acceleration and ends at the first of: the step's
end, zero speed, the segment's end, the end of the stopping dwell. All runs of a
pool, some Arrow batches, take their substeps together in NumPy; ended runs leave the arrays.
Most substeps are whole time steps inside a segment, well above the stopping speed. :meth:`Runs.cruise` takes these,
in the same operations on the same numbers, so to the same bits, and leaves all others to :meth:`Runs.advance`.

Distances: one running sum gives both the segment ends and the length (its last
value), so that the last end is the end of the route.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velograde.functions.physics import PARAMETERS, scenario_error
from velograde.shipping import ship

EPS = 1e-12
#: Substeps of a run at most, against endless loops; it then ends as ``substep_cap``.
MAX_SUBSTEPS = 50_000_000
#: Runs of a pool: as some run much longer than most, small pools are mostly calls over few runs.
POOL, TRACED = 65_536, 8_192
#: Bytes of the Arrow batches of a pool, about.
POOL_BYTES = 32 << 20
#: Whole steps in a row at most before the other runs go on, and runs that take them together (their arrays stay in the cache).
CRUISE, BLOCK = 64, 4_096
#: Whole steps end that far (m, and parts of the segment) before their segment's end, and above that speed (m/s): far beyond rounding.
CLEAR_M, CLEAR_PART, CLEAR_M_S = 1e-3, 1e-7, 1e-9

SUMMARY = (
    "run_id string, elapsed_time_s double, distance_m double, final_speed_m_s double, completed_route boolean, stop_reason string, "
    "moving_time_s double, first_below_threshold_time_s double, first_zero_speed_time_s double, qualified_stop_time_s double, stationary_time_s double, substeps long"
)
TRACE = "run_id string, step int, time_s double, distance_m double, speed_m_s double"
REASONS = np.array(["", "route_end", "speed_threshold", "max_time", "substep_cap"])
ROUTE_END, STOPPED, MAX_TIME, CAPPED = 1, 2, 3, 4


class Runs:
    """State of the runs of one pool; the segments (``lengths``, ``g``) of all profiles stand one after the other, ``counts`` of each run."""

    def __init__(self, counts: np.ndarray, lengths: np.ndarray, g: np.ndarray, parameters: dict[str, np.ndarray]):
        n = len(counts)
        self.last = np.cumsum(counts) - 1
        self.ends = _running(lengths, self.last - counts + 1, counts)
        p = self.p = parameters
        self.length = self.ends[self.last]
        mass = p["rider_mass_kg"] + p["bicycle_mass_kg"]
        self.inertia = mass + p["rotating_equivalent_mass_kg"]
        # Forces that do not depend on speed, per segment; the air's factor, per run.
        weight, rolling = (np.repeat(x, counts) for x in (mass * p["gravity_m_s2"], p["rolling_resistance_coefficient"]))
        hyp = np.sqrt(1.0 + g * g)
        self.steady = -weight * (g / hyp) - rolling * weight * (1.0 / hyp)
        self.drag = 0.5 * p["air_density_kg_m3"] * p["drag_area_m2"]
        self.clear = self.ends - (CLEAR_M + CLEAR_PART * lengths)
        self.slow = np.maximum(p["stop_speed_m_s"], CLEAR_M_S)
        self.t, self.d, self.v = np.zeros(n), np.zeros(n), p["initial_speed_m_s"].astype(float).copy()
        self.below, self.rest, self.seg = np.zeros(n), np.zeros(n), self.last - counts + 1
        self.reason, self.steps = np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.still = np.zeros(n)
        stop = p["stop_speed_m_s"]
        self.first_below = np.where(self.v <= stop, 0.0, np.nan)
        self.first_zero = np.full(n, np.nan)
        self.reason[(self.v <= stop) & (p["stop_dwell_s"] == 0)] = STOPPED

    def acceleration(self, k: np.ndarray, v: np.ndarray) -> np.ndarray:
        air = v - self.p["along_route_wind_m_s"][k]
        return (self.steady[self.seg[k]] - self.drag[k] * air * np.abs(air)) / self.inertia[k]

    def rounds(self, put: Callable | None = None) -> Iterator[None]:
        """Run all to their ends, some substeps a round; ``put`` gets what each substep leaves (run, step, time, distance, speed)."""
        live = np.flatnonzero(self.reason == 0)
        while len(live):
            odd = np.concatenate([self.cruise(live[at : at + BLOCK], put) for at in range(0, len(live), BLOCK)])
            # What is left of a step after an event is mostly taken in one more.
            for _ in range(2):
                odd = self.advance(odd)
                if put is not None and len(odd):
                    put(odd, self.steps[odd], self.t[odd], self.d[odd], self.v[odd])
                odd = odd[(self.reason[odd] == 0) & (self.rest[odd] > EPS)]
            live = live[self.reason[live] == 0]
            yield

    def cruise(self, k: np.ndarray, put: Callable | None = None) -> np.ndarray:
        """Whole time steps of the runs k, until a quarter of them has no more without an event; returns the runs whose next substep is another."""
        p, seg = self.p, self.seg[k]
        t, d, v, h, latest, wind = self.t[k], self.d[k], self.v[k], p["time_step_s"][k], p["max_time_s"][k], p["along_route_wind_m_s"][k]
        steady, clear, drag, inertia, slow = self.steady[seg], self.clear[seg], self.drag[k], self.inertia[k], self.slow[k]
        go = (self.rest[k] <= EPS) & (h > CLEAR_M_S) & (v > slow) & (d < clear) & (self.steps[k] < MAX_SUBSTEPS - CRUISE)
        made = np.zeros(len(k), np.int64)
        air, a, v1, d1, x, ok = *(np.empty(len(k)) for _ in range(5)), np.empty(len(k), bool)
        with np.errstate(all="ignore"):
            for _ in range(CRUISE):
                np.subtract(v, wind, out=air)
                np.multiply(drag, air, out=a)
                np.abs(air, out=air)
                a *= air
                np.subtract(steady, a, out=a)
                a /= inertia
                np.multiply(a, h, out=v1)
                v1 += v
                np.multiply(v, h, out=d1)
                d1 += d
                np.multiply(a, 0.5, out=x)
                x *= h
                x *= h
                d1 += x
                np.maximum(d, d1, out=d1)
                np.subtract(latest, t, out=x)
                for left, right in ((x, h), (v1, slow), (clear, d1)):
                    # A step may end with the time, but not at a speed or place where something happens.
                    (np.greater_equal if left is x else np.greater)(left, right, out=ok)
                    go &= ok
                going = np.count_nonzero(go)
                if not going:
                    break
                np.add(t, h, out=x)
                for old, new in ((t, x), (d, d1), (v, v1)):
                    np.copyto(old, new, where=go)
                made += go
                if put is not None:
                    put(k[go], self.steps[k[go]] + made[go], t[go], d[go], v[go])
                if 4 * going < 3 * len(k):
                    break
        self.t[k], self.d[k], self.v[k] = t, d, v
        self.steps[k] += made
        moved = k[made > 0]
        self.rest[moved] = self.below[moved] = 0.0
        return k[~go]

    def advance(self, k: np.ndarray) -> np.ndarray:
        """One substep of the runs k; returns those that made one (the others ended)."""
        p = self.p
        fresh = self.rest[k] <= EPS
        if fresh.any():
            f = k[fresh]
            over = self.t[f] >= p["max_time_s"][f] - EPS
            self.reason[f[over]] = MAX_TIME
            f = f[~over]
            self.rest[f] = np.minimum(p["time_step_s"][f], p["max_time_s"][f] - self.t[f])
            k = k[self.reason[k] == 0]
        home = self.d[k] >= self.length[k] - EPS
        if home.any():
            h = k[home]
            self.d[h], self.reason[h] = self.length[h], ROUTE_END
            k = k[~home]
        if not len(k):
            return k
        while (ahead := (self.d[k] >= self.ends[self.seg[k]]) & (self.seg[k] < self.last[k])).any():
            self.seg[k[ahead]] += 1
        t, d, v, rest, below = self.t[k], self.d[k], self.v[k], self.rest[k], self.below[k]
        stop, dwell, length, end = p["stop_speed_m_s"][k], p["stop_dwell_s"][k], self.length[k], self.ends[self.seg[k]]
        a = self.acceleration(k, v)
        a = np.where((v <= EPS) & (a < 0), 0.0, a)  # resistance holds a standing bicycle, it does not push it back
        with np.errstate(all="ignore"):
            zero = np.where((a < 0) & (v > 0), -v / a, np.inf)
            h = np.minimum(rest, zero)
            gap = end - d
            square = v * v + 2.0 * a * gap
            down = v + np.sqrt(np.maximum(0.0, square))
            reach = np.where(np.abs(a) < 1e-15, np.where(v > 0, gap / v, np.inf), np.where(square < 0, np.inf, np.where(down > 0, 2.0 * gap / down, np.inf)))
            reach = np.where(gap <= EPS, 0.0, reach)
            hit = reach <= h + EPS
            h = np.where(hit, np.maximum(0.0, reach), h)
            cross = (stop - v) / a
            v1 = np.maximum(0.0, v + a * h)
            within = np.where((v <= stop) & (v1 <= stop), h, np.where((v > stop) & (v1 < stop), h - cross, np.where((v < stop) & (v1 > stop), cross, 0.0)))
            ended = (within > 0) & (below + within >= dwell - EPS)
            need = np.maximum(0.0, dwell - below)
            h = np.where(ended, np.where(v <= stop, need, cross + need), h)
            hit &= ~ended
            v1 = np.maximum(0.0, v + a * h)
            v1 = np.where(~ended & ~hit & (h == zero), 0.0, v1)  # the event is zero speed: no residue of rounding
            d1 = np.where(hit, end, d + v * h + 0.5 * a * h * h)
            d1 = np.minimum(length, np.maximum(d, d1))
            t1 = t + h
            first = np.isnan(self.first_below[k]) & (v > stop) & (v1 <= stop)
            self.first_below[k] = np.where(first, t + np.minimum(h, cross), self.first_below[k])
        self.first_zero[k] = np.where(np.isnan(self.first_zero[k]) & (v1 <= EPS), t1, self.first_zero[k])
        self.still[k] += np.where((v <= EPS) & (v1 <= EPS), h, 0.0)
        self.below[k] = np.where((v <= stop) & (v1 <= stop), below + h, np.where((v > stop) & (v1 < stop), within, np.where(v1 > stop, 0.0, below)))
        # A substep without time at a boundary steps over it.
        stuck = hit & (h <= EPS) & ~ended
        arrived = (h <= EPS) & ~ended & (end >= length - EPS) & hit
        d1 = np.where(arrived, length, np.where(stuck, np.nextafter(end, np.inf), d1))
        self.t[k], self.d[k], self.v[k], self.rest[k] = t1, d1, v1, rest - h
        self.reason[k] = np.where(ended, STOPPED, np.where(arrived, ROUTE_END, self.reason[k]))
        self.steps[k] += 1
        self.reason[k[(self.steps[k] >= MAX_SUBSTEPS) & (self.reason[k] == 0)]] = CAPPED
        return k


def _running(x: np.ndarray, first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The running sum of each run's segments, added one by one."""
    out, at = x.copy(), 1
    while len(first := first[(more := counts > at)]):
        counts = counts[more]
        if len(first) < 16:
            for i, n in zip(first.tolist(), counts.tolist(), strict=True):
                out[i : i + n] = np.cumsum(x[i : i + n])
            break
        out[first + at] = out[first + at - 1] + x[first + at]
        at += 1
    return out


def _runs(batch: pa.RecordBatch) -> Runs:
    column = lambda name: batch.column(batch.schema.get_field_index(name))
    profile = column("profile")
    lengths, grades = (profile.flatten().field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
    return Runs(profile.value_lengths().to_numpy(), lengths, grades, {n: column(n).to_numpy(zero_copy_only=False) for n in PARAMETERS})


def _pools(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in pools of about so many, of fewer where profiles are long."""
    held: list[pa.RecordBatch] = []
    for whole in batches:
        for at in range(0, whole.num_rows, rows):
            held.append(whole.slice(at, rows))
            if sum(x.num_rows for x in held) >= rows or sum(x.nbytes for x in held) >= POOL_BYTES:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held = []
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _pools(batches, POOL):
        runs = _runs(batch)
        for _ in runs.rounds():
            pass
        nullable = lambda x: pa.array(x, mask=np.isnan(x))
        stopped = np.where(runs.reason == STOPPED, runs.t, np.nan)
        columns = [batch.column(batch.schema.get_field_index("run_id")), runs.t, runs.d, runs.v, runs.reason == ROUTE_END, REASONS[runs.reason].astype(object), runs.t - runs.still]
        columns += [nullable(runs.first_below), nullable(runs.first_zero), nullable(stopped), runs.still, runs.steps]
        yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=[x.split()[0] for x in SUMMARY.split(", ")])


def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All points of each run, given out every few hundred substeps."""
    names = [x.split()[0] for x in TRACE.split(", ")]
    for batch in _pools(batches, TRACED):
        runs, ids = _runs(batch), batch.column(batch.schema.get_field_index("run_id"))
        # A row says how far a run is after each substep; the last says where it ended.
        held = [(np.arange(batch.num_rows), runs.steps.copy(), runs.t.copy(), runs.d.copy(), runs.v.copy())]

        def put(*row: np.ndarray, held=held) -> None:
            held.append(row)

        def give(held=held, ids=ids) -> pa.RecordBatch:
            k, step, t, d, v = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            return pa.RecordBatch.from_arrays([ids.take(pa.array(k)), pa.array(step, pa.int32()), pa.array(t), pa.array(d), pa.array(v)], names=names)

        for _ in runs.rounds(put):
            if sum(len(x[0]) for x in held) > 100_000:
                yield give()
        if held:
            yield give()


def with_scenarios(profiles: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Runs: every profile (edge_id, profile) under every scenario. Scenarios are a table of parameters, a few rows by design."""
    runs = profiles.crossJoin(F.broadcast(scenarios))
    return runs.withColumn("run_id", F.concat_ws("/", F.col("edge_id").cast("string"), "scenario_id"))


def valid_profile() -> "F.Column":
    """Whether ``profile`` can be simulated: at least one segment, lengths positive, grades within 0.5."""
    good = F.forall("profile", lambda s: (s["length_m"] > 0) & (s["length_m"] < float("inf")) & ~F.isnan(s["grade_ratio"]) & (F.abs(s["grade_ratio"]) <= 0.5))
    return (F.size("profile") > 0) & F.coalesce(good, F.lit(False))


def run_error() -> "F.Column":
    """Why a run is refused, null if it is not: its scenario first, then its profile."""
    return F.coalesce(scenario_error(), F.when(~F.coalesce(valid_profile(), F.lit(False)), F.lit("profile cannot be simulated")))


def rejects(runs: DataFrame) -> DataFrame:
    """(run_id, reject_reason) of the runs that :func:`simulate` leaves out."""
    return runs.select("run_id", run_error().alias("reject_reason")).where("reject_reason is not null")


def simulate(runs: DataFrame, what: str = "summary", strict: bool = False) -> DataFrame:
    """Simulate runs (run_id, profile, parameters of a scenario): one summary row per run, or its trace.

    Runs with a parameter (null ones too) or a profile that cannot be simulated are left out, and :func:`rejects`
    has them with the reason; ``strict`` ends the job at the first of them instead. No runs give no rows.
    """
    ship(runs.sparkSession)
    reason = run_error()
    kept = F.when(reason.isNull(), F.lit(True)).otherwise(F.raise_error(reason) if strict else F.lit(False))
    rows = runs.where(kept).select("run_id", "profile", *PARAMETERS)
    return rows.mapInArrow(summarise, SUMMARY) if what == "summary" else rows.mapInArrow(trace, TRACE)
