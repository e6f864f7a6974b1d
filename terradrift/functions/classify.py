"""Rule classifiers. Class words are data: every default can be replaced by the caller."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from terradrift.functions.geo import _c

# Class words in hint order, and the size/shape labels of the grid differencer.
CLASSES = (
    "Structure",
    "Road",
    "Airstrip",
    "Tower",
    "GradedArea",
    "Revetment",
    "Berm",
    "PerimeterFence",
    "WaterBody",
    "MilitaryPost",
    "Unknown",
)
BOX_LABELS = (
    "Newly Paved Runway / Access Extension",
    "Graded Logistics Connector Road",
    "Cleared Heavy Staging Platform",
    "Hardened Revetment Bastion",
    "Excavated Structural Enclosure",
)


def circularity(area_m2, perimeter_m) -> Column:
    return (4 * math.pi * _c(area_m2)) / F.greatest(_c(perimeter_m) * _c(perimeter_m), F.lit(1e-4))


def class_from_hint(hint, classes: Sequence[str] = CLASSES) -> Column:
    """First class (in the given order) whose name occurs in the hint, else NULL."""
    text = F.lower(F.trim(_c(hint)))
    return F.coalesce(*[F.when(text.contains(name.lower()), F.lit(name)) for name in classes])


def class_from_shape(area_m2, aspect_ratio, perimeter_m) -> Column:
    area, aspect, roundness = _c(area_m2), _c(aspect_ratio), circularity(area_m2, perimeter_m)
    return (
        F.when((aspect >= 8.0) & (area >= 5000.0), "Airstrip")
        .when(aspect >= 4.5, "Road")
        .when((area < 150.0) & (roundness >= 0.70), "Tower")
        .when((area >= 15000.0) & (aspect < 2.5), "GradedArea")
        .when(area.between(300.0, 4000.0) & (roundness < 0.40), "Revetment")
        .when(area >= 50.0, "Structure")
        .otherwise("Unknown")
    )


def classify_geometry(area_m2, aspect_ratio, perimeter_m, hint=None, classes: Sequence[str] = CLASSES) -> Column:
    by_shape = class_from_shape(area_m2, aspect_ratio, perimeter_m)
    return by_shape if hint is None else F.coalesce(class_from_hint(hint, classes), by_shape)


def classify_box(area_m2, aspect_ratio, rank, labels: Sequence[str] = BOX_LABELS) -> Column:
    """Label of a composite change box; ``rank`` (1-based) gives the letter or number suffix."""
    area, aspect = _c(area_m2), _c(aspect_ratio)
    letter = F.char((F.lit(65) + (_c(rank) - 1) % 26).cast("int"))
    return (
        F.when((aspect >= 4.5) & (area >= 5000), labels[0])
        .when(aspect >= 3.0, labels[1])
        .when(area >= 10000, labels[2])
        .when((area <= 3500) & (aspect < 2.0), F.concat(F.lit(labels[3] + " "), letter))
        .otherwise(F.concat(F.lit(labels[4] + " #"), _c(rank).cast("string")))
    )


def box_confidence(n_cells) -> Column:
    return F.least(F.lit(0.98), F.greatest(F.lit(0.72), 0.85 + (_c(n_cells) / 100.0) * 0.1))


def relation_type(
    distance_m,
    class_a,
    class_b,
    road_classes: Sequence[str] = ("Road", "Airstrip"),
    defence_classes: Sequence[str] = ("Revetment",),
    adjacent_m: float = 150.0,
    connect_roads: bool = True,
) -> Column:
    """Relation of a proximity edge from its length and the classes at both ends."""
    a, b = _c(class_a), _c(class_b)
    road = (a.isin(*road_classes) | b.isin(*road_classes)) & F.lit(connect_roads)
    return (
        F.when(road, "CONNECTED_BY_ROAD")
        .when(_c(distance_m) <= adjacent_m, "ADJACENT_TO")
        .when(a.isin(*defence_classes) | b.isin(*defence_classes), "DEFENDS")
        .otherwise("NEAR")
    )
