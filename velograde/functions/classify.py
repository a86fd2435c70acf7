"""Access, structure and direction rules over a map of tags.

A missing tag is null, and ``null not in (...)`` is null: each lookup has its default.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the rules.
REFUSED = ("no", "private")
GRANTED = ("yes", "designated", "permissive")
MOTORWAYS = ("motorway", "motorway_link")
OPEN_ROADS = ("primary", "secondary", "tertiary", "unclassified", "residential", "living_street", "service", "cycleway")
ONEWAY_FORWARD = ("yes", "1", "true")
GROUND_LAYERS = ("0", "+0", "-0")


def tag(tags: Column, key: str, default: str = "") -> Column:
    return F.coalesce(F.try_element_at(tags, F.lit(key)), F.lit(default))


def access(tags: Column) -> Column:
    """admissible, prohibited or review: the first rule that matches."""
    bicycle, highway = tag(tags, "bicycle"), tag(tags, "highway")
    granted = bicycle.isin(*GRANTED)
    return (
        F.when(bicycle.isin(*REFUSED), "prohibited")
        .when((tag(tags, "access").isin(*REFUSED) | tag(tags, "vehicle").isin(*REFUSED)) & ~granted, "prohibited")
        .when(highway.isin(*MOTORWAYS), "prohibited")
        .when(granted | highway.isin(*OPEN_ROADS), "admissible")
        .otherwise("review")
    )


def structure(tags: Column) -> Column:
    return (
        F.when(tag(tags, "bridge", "no") != "no", "bridge")
        .when((tag(tags, "tunnel", "no") != "no") | (tag(tags, "covered") == "yes"), "tunnel")
        .when(~tag(tags, "layer", "0").isin(*GROUND_LAYERS), "stacked")
        .otherwise("normal")
    )


def directions(tags: Column) -> Column:
    """The directions that may be ridden: forward, reverse or both."""
    oneway = tag(tags, "oneway", "no")
    both = F.array(F.lit("forward"), F.lit("reverse"))
    return (
        F.when(tag(tags, "oneway:bicycle") == "no", both)
        .when(oneway.isin(*ONEWAY_FORWARD), F.array(F.lit("forward")))
        .when(oneway == "-1", F.array(F.lit("reverse")))
        .otherwise(both)
    )
