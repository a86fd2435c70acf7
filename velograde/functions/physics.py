"""Coasting physics as column expressions.

sin and cos of atan(g) are written as g/sqrt(1+g*g) and 1/sqrt(1+g*g): the same
mathematics, with correctly rounded operations only, so that any engine gives the same bits.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_GRADE = 0.5


@dataclass(frozen=True)
class Scenario:
    """One rider, bicycle, environment and set of simulation controls (SI units)."""

    scenario_id: str = "default"
    rider_mass_kg: float = 75.0
    bicycle_mass_kg: float = 15.0
    rotating_equivalent_mass_kg: float = 1.5
    rolling_resistance_coefficient: float = 0.006
    drag_area_m2: float = 0.55
    gravity_m_s2: float = 9.80665
    air_density_kg_m3: float = 1.225
    along_route_wind_m_s: float = 0.0
    initial_speed_m_s: float = 15.0 / 3.6
    time_step_s: float = 0.05
    stop_speed_m_s: float = 0.30
    stop_dwell_s: float = 2.0
    max_time_s: float = 21600.0


#: Names of the numbers of a scenario.
PARAMETERS = tuple(f.name for f in fields(Scenario) if f.name != "scenario_id")
SCENARIO_SCHEMA = "scenario_id string, " + ", ".join(f"{n} double" for n in PARAMETERS)


def scenarios(spark: SparkSession, *rows: Scenario) -> DataFrame:
    return spark.createDataFrame([tuple(getattr(r, f.name) for f in fields(r)) for r in rows or (Scenario(),)], SCENARIO_SCHEMA)


def finite(x: Column) -> Column:
    """True for numbers that are neither null, NaN nor infinite (NaN sorts above all numbers in Spark)."""
    return F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))


def checked(value: Column, ok: Column, message: str) -> Column:
    """The value, or an error of the job where the condition does not hold."""
    return F.when(F.coalesce(ok, F.lit(False)), value).otherwise(F.raise_error(F.lit(message)))


def grade_percent_to_ratio(percent: Column) -> Column:
    return checked(percent / 100.0, finite(percent), "grade percentage must be finite")


def grade_ratio_to_angle_rad(grade: Column) -> Column:
    return checked(F.atan(grade), finite(grade) & (F.abs(grade) <= MAX_GRADE), "grade ratio must be finite and within 0.5")


def real_mass_kg() -> Column:
    return F.col("rider_mass_kg") + F.col("bicycle_mass_kg")


def effective_mass_kg() -> Column:
    return real_mass_kg() + F.col("rotating_equivalent_mass_kg")


def acceleration_m_s2(speed: Column, grade: Column) -> Column:
    """Forward acceleration for a row that has a scenario's columns; positive wind is a tailwind."""
    hyp = F.sqrt(1.0 + grade * grade)
    weight = real_mass_kg() * F.col("gravity_m_s2")
    air = speed - F.col("along_route_wind_m_s")
    force = -weight * (grade / hyp) - F.col("rolling_resistance_coefficient") * weight * (1.0 / hyp) - 0.5 * F.col("air_density_kg_m3") * F.col("drag_area_m2") * air * F.abs(air)
    return force / effective_mass_kg()


def scenario_error() -> Column:
    """Why a scenario is refused, null if it is not; the first rule that fails decides."""
    problem = F.lit(None).cast("string")
    rules = [(finite(F.col(n)), f"{n} must be finite") for n in PARAMETERS]
    positive = ("rider_mass_kg", "bicycle_mass_kg", "drag_area_m2", "gravity_m_s2", "air_density_kg_m3", "initial_speed_m_s", "time_step_s", "max_time_s")
    rules += [(F.col(n) > 0, f"{n} must be positive") for n in positive]
    rules += [(F.col(n) >= 0, f"{n} cannot be negative") for n in ("rotating_equivalent_mass_kg", "stop_speed_m_s", "stop_dwell_s")]
    crr = F.col("rolling_resistance_coefficient")
    rules.append(((crr >= 0) & (crr < 0.1), "rolling_resistance_coefficient must be within [0, 0.1)"))
    for ok, message in reversed(rules):
        problem = F.when(~ok, F.lit(message)).otherwise(problem)
    return problem


def km(metres: Column) -> Column:
    return metres / 1000.0


def km_h(metres_per_second: Column) -> Column:
    return metres_per_second * 3.6


def percent(ratio: Column) -> Column:
    return ratio * 100.0
